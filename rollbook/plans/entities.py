"""Registered queries: entity matching (JN3-JN7, JN9, SF13/UD1).

Compare-input lines come from two sources, typed text and an upload that repeats a part of it; both are
derived from ``customer``, one line per customer, its shape by the market segment:
  HOUSEHOLD   the id, six digits at least       (id)
  MACHINERY   the name without its last letter  (fuzzy)
  FURNITURE   the name as is                    (exact)
  AUTOMOBILE  the name plus " x"                (fuzzy)
  BUILDING    "qq" and other letters            (no match)
Records are all customers and suppliers. A name is three words of letters that stand for the digest of the table's name, so names grow with the tables
and no two of different digests come near each other; the last word's length hangs on the nation. A supplier's name is
cut from the digest of the customer of its number, so it equals, begins or goes on beyond that customer's: the ratio of such a pair
follows from the length of what they share, which is what the SQL states.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook.operators import extraction as EX
from rollbook.operators import matching as M
from rollbook.plans.registry import padded, register, rounded
from rollbook.session import read_table


_LETTERS = "aeiounhtrlsmkvbd"  # one for each hexadecimal digit


def _name(digest, nation):
    """Three words: 5, 6 and 4 to 9 letters."""
    x = F.translate(digest, "0123456789abcdef", _LETTERS)
    return F.concat(F.substring(x, 1, 5), F.lit(" "), F.substring(x, 6, 6), F.lit(" "), F.substring(x, F.lit(12), F.lit(4) + nation % 6))


def people(spark, sf):
    """(row_ord, id, name, digest, segment, nation) of customers and suppliers."""
    md5 = lambda c: F.md5(c.cast("binary"))
    c = read_table(spark, sf, "customer")
    c = c.select(F.col("c_custkey").alias("row_ord"), padded(F.col("c_custkey"), 6).alias("id"), md5(F.col("c_name")).alias("digest"),
                 F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    s = read_table(spark, sf, "supplier")
    s = s.select((F.col("s_suppkey") + F.lit(10**12)).alias("row_ord"), padded(F.col("s_suppkey") + F.lit(900000000), 9).alias("id"),
                 md5(F.regexp_replace("s_name", "Supplier", "Customer")).alias("digest"), F.lit(None).cast("string").alias("segment"), F.col("s_nationkey").alias("nation"))
    return c.unionByName(s).withColumn("name", _name(F.col("digest"), F.col("nation")))


def compare_lines(spark, sf):
    p = people(spark, sf).where("segment IS NOT NULL")
    line = (F.when(F.col("segment") == "HOUSEHOLD", F.col("id"))
            .when(F.col("segment") == "MACHINERY", F.expr("substring(name, 1, length(name) - 1)"))
            .when(F.col("segment") == "FURNITURE", F.col("name"))
            .when(F.col("segment") == "AUTOMOBILE", F.concat("name", F.lit(" x")))
            .otherwise(F.concat(F.lit("qq "), F.substring(F.translate("digest", "0123456789abcdef", _LETTERS), 20, 10))))
    typed = p.select(F.lit("typed").alias("src"), F.col("row_ord").alias("rec_id"), F.lit(0).cast("bigint").alias("line_no"), line.alias("line"), "nation")
    upload = typed.where("nation < 5").withColumn("src", F.lit("file"))
    return upload.unionByName(typed).drop("nation")


def compare_inputs(spark, sf):
    """SF7 extraction + SO5 de-duplication: distinct (kind, item), ordered by first position."""
    sets = EX.item_sets(EX.compare_items(compare_lines(spark, sf)), ["src", "rec_id", "line_no"])
    return sets.select("kind", "item", F.col("first_rec_id").alias("input_order"))


def person_records(spark, sf):
    p = people(spark, sf)
    family = F.substring_index("name", " ", 1)
    return M.records_view(p.select("row_ord", "id", family.alias("ho_dem"), F.expr("substring(name, 7)").alias("ten")), F.col("id"), "ho_dem", "ten", "row_ord")


def _sql_padded(number: str, width: int) -> str:
    return f"lpad(CAST({number} AS VARCHAR), CAST(greatest(length(CAST({number} AS VARCHAR)), {width}) AS INTEGER), '0')"


SQL_COMPARE = f"""WITH people AS (
  SELECT *, substring(x, 1, 5) || ' ' || substring(x, 6, 6) || ' ' || substring(x, 12, 4 + nation % 6) AS name FROM (
    SELECT *, translate(digest, '0123456789abcdef', '{_LETTERS}') AS x FROM (
      SELECT c_custkey AS row_ord, {_sql_padded("c_custkey", 6)} AS id, md5(c_name) AS digest, c_mktsegment AS segment, c_nationkey AS nation FROM customer
      UNION ALL
      SELECT s_suppkey + 1000000000000, {_sql_padded("(s_suppkey + 900000000)", 9)}, md5(replace(s_name, 'Supplier', 'Customer')), NULL, s_nationkey FROM supplier))),
typed AS (
  SELECT row_ord AS rec_id, nation,
    CASE segment WHEN 'HOUSEHOLD' THEN id WHEN 'MACHINERY' THEN substring(name, 1, length(name) - 1) WHEN 'FURNITURE' THEN name
                 WHEN 'AUTOMOBILE' THEN name || ' x' ELSE 'qq ' || substring(x, 20, 10) END AS line FROM people WHERE segment IS NOT NULL),
lines AS (SELECT 'typed' AS src, rec_id, line FROM typed UNION ALL SELECT 'file', rec_id, line FROM typed WHERE nation < 5),
items AS (SELECT CASE WHEN regexp_full_match(line, '[0-9]{{6,10}}') THEN 'mssv' ELSE 'names' END AS kind,
                 line AS item, src, rec_id FROM lines
          WHERE regexp_full_match(line, '[0-9]{{6,10}}')
             OR (len(string_split_regex(line, '\\s+')) BETWEEN 2 AND 5 AND NOT regexp_matches(line, '\\d')
                 AND length(line) BETWEEN 5 AND 40)),
inputs AS (SELECT kind, item, min(struct_pack(src := src, rec_id := rec_id)).rec_id AS input_order FROM items GROUP BY kind, item),
recs AS (SELECT row_ord, id AS student_id, name AS full_name, digest FROM people),
p1 AS (SELECT r.student_id, r.row_ord, i.item AS input_value, i.input_order, 1.0::DOUBLE AS match_score,
              'mssv_exact' AS match_type
       FROM inputs i JOIN (SELECT student_id, min(row_ord) AS row_ord FROM recs GROUP BY student_id) r
         ON i.item = r.student_id WHERE i.kind = 'mssv'),
elig AS (SELECT * FROM recs WHERE student_id NOT IN (SELECT student_id FROM p1)),
p2 AS (SELECT e.student_id, e.row_ord, i.item AS input_value, i.input_order, 1.0::DOUBLE AS match_score,
              'name_exact_combined' AS match_type
       FROM inputs i JOIN (SELECT full_name, arg_min(student_id, row_ord) AS student_id, min(row_ord) AS row_ord
                           FROM elig GROUP BY full_name) e ON lower(i.item) = e.full_name WHERE i.kind = 'names'),
-- an edited name and a record of the same digest have equal beginnings and nothing else in common
scored AS (
  SELECT i.item, i.input_order, e.student_id, e.row_ord, 2 * least(length(regexp_replace(i.item, ' x$', '')), length(e.full_name)) / CAST(length(i.item) + length(e.full_name) AS DOUBLE) AS score
  FROM inputs i JOIN people o ON o.row_ord = i.input_order JOIN elig e ON e.digest = o.digest
  WHERE i.kind = 'names' AND i.item NOT LIKE 'qq %' AND i.item NOT IN (SELECT input_value FROM p2)),
p3 AS (
  SELECT student_id, row_ord, item AS input_value, input_order, score AS match_score, 'name_fuzzy_combined' AS match_type FROM (
    SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, row_ord) AS rn FROM scored WHERE score >= 0.85) WHERE rn = 1),
resolved AS (
  SELECT student_id, row_ord, input_value, input_order, match_score, match_type FROM (
    SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY match_score DESC, input_order) AS rn
    FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3)) WHERE rn = 1)
"""


@register("jn3_match_by_id", "JN3 SF7 SO5", SQL_COMPARE + "SELECT * FROM p1")
def jn3_match_by_id(spark, sf):
    items = compare_inputs(spark, sf)
    return M.match_ids(items.where("kind = 'mssv'"), person_records(spark, sf))


@register("jn4_match_exact_name", "JN4", SQL_COMPARE + "SELECT * FROM p2")
def jn4_match_exact_name(spark, sf):
    items = compare_inputs(spark, sf)
    recs = person_records(spark, sf)
    p1 = M.match_ids(items.where("kind = 'mssv'"), recs)
    return M.match_exact_names(items.where("kind = 'names'").select("item", "input_order"), recs, p1)


@register("jn6_resolve_exact", "JN6 UD4", SQL_COMPARE + """
SELECT student_id, row_ord, input_value, input_order, match_score, match_type FROM (
  SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY match_score DESC, input_order) AS rn
  FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2)) WHERE rn = 1""")
def jn6_resolve_exact(spark, sf):
    return M.match_extracted(compare_inputs(spark, sf), person_records(spark, sf), fuzzy=False)


@register("jn5_fuzzy_name", "JN5 SF13 UD1", SQL_COMPARE + "SELECT student_id, row_ord, input_value, input_order, round(match_score, 6) AS match_score, match_type FROM p3")
def jn5_fuzzy_name(spark, sf):
    return rounded(M.match_phases(compare_inputs(spark, sf), person_records(spark, sf))[2])


@register("jn9_compare_end_to_end", "JN9 JN3 JN4 JN5 JN6 SF7", SQL_COMPARE + "SELECT student_id, row_ord, input_value, input_order, round(match_score, 6) AS match_score, match_type FROM resolved")
def jn9_compare_end_to_end(spark, sf):
    items = compare_inputs(spark, sf)
    return rounded(M.match_extracted(items, person_records(spark, sf)))


@register("jn9_compare_totals", "JN9", SQL_COMPARE + """
SELECT match_type, count(*) AS matches, (SELECT count(*) FROM inputs) AS total_inputs FROM resolved GROUP BY match_type""")
def jn9_compare_totals(spark, sf):
    from rollbook.session import cut_lineage
    items = cut_lineage(compare_inputs(spark, sf))
    return M.match_totals(items, M.match_extracted(items, person_records(spark, sf)))


@register("jn7_pair_score", "JN7 SF13")
def jn7_pair_score(spark, sf):
    p = read_table(spark, sf, "part")
    pairs = p.select("p_partkey", padded(F.col("p_partkey"), 6).alias("rid"), "p_name",
                     F.expr("substring(p_name, 1, length(p_name) - 1)").alias("input_text"))
    return rounded(M.pair_score(pairs, "input_text", "rid", "p_name"))


@register("sf13_similarity_ratio", "SF13 UD1", """
SELECT p_partkey, p_name, p_name || ' x' AS other, round(2 * length(p_name) / CAST(2 * length(p_name) + 2 AS DOUBLE), 6) AS ratio,
       round(2 * length(p_name) / CAST(2 * length(p_name) + 2 AS DOUBLE), 6) AS ratio_reversed FROM part""")
def sf13_similarity_ratio(spark, sf):
    from rollbook.functions.similarity import similarity_ratio
    p = read_table(spark, sf, "part")
    return rounded(p.select("p_partkey", "p_name", F.concat(F.col("p_name"), F.lit(" x")).alias("other"))
                   .withColumn("ratio", similarity_ratio("p_name", "other"))
                   .withColumn("ratio_reversed", similarity_ratio("other", "p_name")))
