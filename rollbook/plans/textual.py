"""Registered queries: text lines and extraction (SC4, SC5, SC6, SF5-SF7, SF9, SO5).

The ``lines`` binding is every line of every document (whole texts) plus lines that Spark
derives from the tables so that ids, names, classes and dates occur at a known rate:
  customer -> "<c_name> <c_custkey as 10 digits>", "20<c_custkey as 6 digits>",
              "<c_nationkey><segment prefix>"
  part     -> the part name with capitalised words
  orders   -> the order date as dd/MM/yyyy

DuckDB's regular expressions have an ASCII-only ``\\b``; the oracle spells the Unicode
word boundary out with explicit classes (doubling separators so that neighbouring
matches do not share one).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook.functions import extract as X
from rollbook.operators import extraction as EX
from rollbook.plans.registry import padded, register
from rollbook.session import read_table


def doc_lines(spark, sf):
    d = read_table(spark, sf, "documents")
    return (EX.text_to_lines(d, "text", ["doc_id"])
            .select(F.lit("doc").alias("src"), F.col("doc_id").alias("rec_id"),
                    F.col("line_no").cast("bigint").alias("line_no"), "line"))


def lines(spark, sf):
    c = read_table(spark, sf, "customer")
    p = read_table(spark, sf, "part")
    o = read_table(spark, sf, "orders")
    key = F.col("c_custkey").cast("string")
    cust = c.select(F.lit("customer").alias("src"), F.col("c_custkey").alias("rec_id"), F.explode(F.array(
        F.struct(F.lit(0).cast("bigint").alias("line_no"), F.concat_ws(" ", "c_name", padded(key, 10)).alias("line")),
        F.struct(F.lit(1).cast("bigint").alias("line_no"), F.concat(F.lit("20"), padded(key, 6)).alias("line")),
        F.struct(F.lit(2).cast("bigint").alias("line_no"),
                 F.concat(F.col("c_nationkey").cast("string"), F.substring("c_mktsegment", 1, 3)).alias("line")),
    )).alias("l")).select("src", "rec_id", "l.line_no", "l.line")
    parts = p.select(F.lit("part").alias("src"), F.col("p_partkey").alias("rec_id"),
                     F.lit(0).cast("bigint").alias("line_no"), F.initcap("p_name").alias("line"))
    dates = o.select(F.lit("orders").alias("src"), F.col("o_orderkey").alias("rec_id"),
                     F.lit(0).cast("bigint").alias("line_no"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("line"))
    # parsing a line costs far more than moving it: lines are always dealt out by their key, so neither a
    # long text nor a table in one file leaves the regular expressions to one task
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return doc_lines(spark, sf).unionByName(cust).unionByName(parts).unionByName(dates).repartition(n, "rec_id", "line_no")


TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
SQL_DOC_LINES = f"""WITH dsplit AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
doc_lines AS (SELECT 'doc' AS src, doc_id AS rec_id, CAST(i - 1 AS BIGINT) AS line_no,
                     {TRIM.format('parts[i]')} AS line
              FROM dsplit, range(1, len(parts) + 1) r(i)
              WHERE {TRIM.format('parts[i]')} <> '')"""

SQL_LINES = SQL_DOC_LINES + """,
lines AS (
  SELECT * FROM doc_lines
  UNION ALL SELECT 'customer', c_custkey, CAST(0 AS BIGINT), c_name || ' ' || lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(length(CAST(c_custkey AS VARCHAR)), 10) AS INTEGER), '0')
            FROM customer
  UNION ALL SELECT 'customer', c_custkey, CAST(1 AS BIGINT), '20' || lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(length(CAST(c_custkey AS VARCHAR)), 6) AS INTEGER), '0') FROM customer
  UNION ALL SELECT 'customer', c_custkey, CAST(2 AS BIGINT), CAST(c_nationkey AS VARCHAR) || substring(c_mktsegment, 1, 3)
            FROM customer
  UNION ALL SELECT 'part', p_partkey, CAST(0 AS BIGINT),
            array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')
            FROM part
  UNION ALL SELECT 'orders', o_orderkey, CAST(0 AS BIGINT), strftime(o_orderdate, '%d/%m/%Y') FROM orders)"""

# ---------------------------------------------------------------- DuckDB spellings of the rules
WORD = "\\p{L}\\p{N}_"


def _re2(p: str) -> str:
    return p.replace("(?U)", "").replace("(?iU)", "(?i)").replace("'", "''")


def sql_words(line: str) -> str:
    return f"string_split_regex({line}, '\\s+')"


def sql_is_pure_id(line: str) -> str:
    n = f"length({line})"
    return (f"(regexp_full_match({line}, '[0-9]{{6,10}}') AND (({n} = 8 AND starts_with({line}, '20')) OR "
            f"({n} = 10 AND starts_with({line}, '20')) OR {n} = 7 OR {n} = 6))")


def sql_is_name_line(line: str, max_len: int = 50, tech=X.TECH_WORDS) -> str:
    ws = sql_words(line)
    tech_list = ", ".join(f"'{t}'" for t in tech)
    proper = (f"list_bool_and(list_transform({ws}, lambda w: regexp_full_match(w, '\\p{{Lu}}') OR "
              f"regexp_full_match(w, '\\p{{Lu}}[^\\p{{Lu}}\\p{{Lt}}]*\\p{{Ll}}[^\\p{{Lu}}\\p{{Lt}}]*')))")
    caps = f"list_bool_and(list_transform({ws}, lambda w: regexp_full_match(w, '[^\\p{{Ll}}]*[\\p{{Lu}}\\p{{Lt}}][^\\p{{Ll}}]*')))"
    return (f"(len({ws}) BETWEEN 2 AND 5 AND NOT regexp_matches({line}, '\\d') "
            f"AND length({line}) BETWEEN 5 AND {max_len} "
            f"AND (regexp_matches(lower({line}), '[{X.VI_LOWER}]') OR {proper} OR {caps} "
            f"OR regexp_matches(lower({line}), '[{X.VI_COMMON}]')) "
            f"AND NOT list_bool_or(list_transform({ws}, lambda w: lower(w) IN ({tech_list}))))")


def sql_is_compare_name_line(line: str) -> str:
    ws = sql_words(line)
    tech_list = ", ".join(f"'{t}'" for t in X.TECH_WORDS_SHORT)
    return (f"(len({ws}) BETWEEN 2 AND 5 AND NOT regexp_matches({line}, '\\d') "
            f"AND length({line}) BETWEEN 5 AND 40 "
            f"AND NOT list_bool_or(list_transform({ws}, lambda w: lower(w) IN ({tech_list}))))")


def sql_is_class_line(line: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({line}, '(?i){_re2(p)}')" for p in X.CLASS_LINE_PATTERNS) + ")"


def sql_is_date_line(line: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({line}, '{_re2(p)}')" for p in X.DATE_LINE_PATTERNS) + ")"


def _findall(line: str, core: str, keep: str = "", flags: str = "") -> str:
    """Find-all of ``\\b(core)\\b`` with a Unicode word boundary: every separator that may
    sit between two matches (all non-word characters except ``keep``) is doubled first."""
    doubled = f"regexp_replace({line}, '([^{WORD}{keep}])', '\\1\\1', 'g')"
    pat = f"{flags}(?:^|[^{WORD}])({core})(?:[^{WORD}]|$)"
    return f"regexp_extract_all({doubled}, '{pat}', 1)"


_UP = f"A-Z{X.VI_UPPER}"
_LO = f"a-z{X.VI_LOWER}"
NAME_CORE = f"[{_UP}][{_LO}]+(?:\\s+[{_UP}][{_LO}]+)+"


def sql_find_ids(line):
    return _findall(line, "\\d{6,10}")


def sql_find_names(line, max_len=50, min_word=1):
    runs = _findall(line, NAME_CORE, keep="\\s")
    cond = f"len(string_split_regex(m, '\\s+')) BETWEEN 2 AND 5 AND length(m) BETWEEN 5 AND {max_len}"
    if min_word > 1:
        cond += f" AND list_bool_and(list_transform(string_split_regex(m, '\\s+'), lambda w: length(w) >= {min_word}))"
    return f"list_filter({runs}, lambda m: {cond})"


def sql_find_classes(line):
    return _findall(line, "\\d{1,2}[A-Z]{1,4}\\d{0,2}", flags="(?i)")


def sql_find_dates(line):
    return _findall(line, "\\d{1,2}[/-]\\d{1,2}[/-]\\d{4}", keep="/\\-")


def _tag_sql(kind, arr):
    return f"list_transform(list_distinct({arr}), lambda x: {{'kind': '{kind}', 'item': x}})"


def sql_mixed(line):
    return (f"list_concat({_tag_sql('mssv', sql_find_ids(line))}, {_tag_sql('names', sql_find_names(line))}, "
            f"{_tag_sql('classes', sql_find_classes(line))}, {_tag_sql('dates', sql_find_dates(line))})")


SQL_RULE = (f"CASE WHEN {sql_is_pure_id('line')} THEN 'mssv' WHEN {sql_is_name_line('line')} THEN 'names' "
            f"WHEN {sql_is_class_line('line')} THEN 'classes' WHEN {sql_is_date_line('line')} THEN 'dates' END")

SQL_ITEMS = SQL_LINES + f""",
ruled AS (SELECT *, {SQL_RULE} AS rule_kind FROM lines),
items AS (SELECT src, rec_id, line_no, line, rule_kind IS NOT NULL AS via_rule,
                 unnest(CASE WHEN rule_kind IS NOT NULL THEN [{{'kind': rule_kind, 'item': line}}]
                             ELSE {sql_mixed('line')} END) AS it FROM ruled)
"""


@register("sc5_input_lines", "SC5 SC4 SF2", SQL_DOC_LINES + " SELECT * FROM doc_lines")
def sc5_input_lines(spark, sf):
    return doc_lines(spark, sf)


@register("sf6_line_items", "SF6 SF5 SF9", SQL_ITEMS + """
SELECT src, rec_id, line_no, line, it.kind AS kind, it.item AS item, via_rule FROM items""")
def sf6_line_items(spark, sf):
    return EX.extract_items(lines(spark, sf))


@register("so5_item_sets", "SO5 SF6", SQL_ITEMS + """,
flat AS (SELECT src, rec_id, line_no, it.kind AS kind, it.item AS item FROM items)
SELECT kind, item, arg_min(src, (src, rec_id, line_no)) AS first_src, arg_min(rec_id, (src, rec_id, line_no)) AS first_rec_id,
       arg_min(line_no, (src, rec_id, line_no)) AS first_line_no, count(*) AS n
FROM flat GROUP BY kind, item""")
def so5_item_sets(spark, sf):
    return EX.item_sets(EX.extract_items(lines(spark, sf)), ["src", "rec_id", "line_no"])


@register("sf9_mixed_parse", "SF9", SQL_LINES + f""",
m AS (SELECT src, rec_id, line_no, line, unnest({sql_mixed('line')}) AS it FROM lines)
SELECT src, rec_id, line_no, line, it.kind AS kind, it.item AS item FROM m""")
def sf9_mixed_parse(spark, sf):
    return EX.mixed_parse(lines(spark, sf))


_SF7_INNER = (f"list_concat({_tag_sql('mssv', sql_find_ids('line'))}, CASE WHEN regexp_matches(line, '\\d') THEN "
              f"{_tag_sql('names', sql_find_names('line', 40, 2))} ELSE [] END)")


@register("sf7_compare_items", "SF7", SQL_LINES + f""",
c AS (SELECT src, rec_id, line_no, line, unnest(CASE
        WHEN regexp_full_match(line, '[0-9]{{6,10}}') THEN [{{'kind': 'mssv', 'item': line}}]
        WHEN {sql_is_compare_name_line('line')} THEN [{{'kind': 'names', 'item': line}}]
        ELSE {_SF7_INNER} END) AS it FROM lines)
SELECT src, rec_id, line_no, line, it.kind AS kind, it.item AS item FROM c""")
def sf7_compare_items(spark, sf):
    return EX.compare_items(lines(spark, sf))


# ---------------------------------------------------------------- SC6
def upload_lines(spark, sf):
    """Uploaded lookup lists, one "file" per nation: a note line, a header, then one line per
    customer of that nation in one of four shapes chosen by market segment."""
    n = read_table(spark, sf, "nation")
    c = read_table(spark, sf, "customer")
    head = n.select(F.col("n_nationkey").alias("file"), F.explode(F.array(
        F.struct(F.lit(-1).cast("bigint").alias("line_no"), F.concat(F.lit("note, "), F.col("n_name")).alias("line")),
        F.struct(F.lit(0).cast("bigint").alias("line_no"), F.lit("Name,MSSV").alias("line")))).alias("l")) \
        .select("file", "l.line_no", "l.line")
    seg = F.col("c_mktsegment")
    body_line = (F.when(seg == "HOUSEHOLD", F.concat_ws(",", "c_name", "c_mktsegment"))
                 .when(seg == "MACHINERY", F.col("c_name"))
                 .when(seg == "AUTOMOBILE", F.concat(F.lit(","), F.col("c_name"), F.lit(", ,")))
                 .otherwise(F.concat(F.col("c_name"), F.lit(", "), padded(F.col("c_custkey"), 8))))
    body = c.select(F.col("c_nationkey").cast("int").alias("file"),
                    (F.col("c_custkey") + 1).cast("bigint").alias("line_no"), body_line.alias("line"))
    return head.unionByName(body)


SQL_UPLOAD = """WITH up AS (
  SELECT n_nationkey AS file, CAST(-1 AS BIGINT) AS line_no, 'note, ' || n_name AS line FROM nation
  UNION ALL SELECT n_nationkey, CAST(0 AS BIGINT), 'Name,MSSV' FROM nation
  UNION ALL SELECT c_nationkey, CAST(c_custkey + 1 AS BIGINT),
    CASE c_mktsegment WHEN 'HOUSEHOLD' THEN c_name || ',' || c_mktsegment WHEN 'MACHINERY' THEN c_name
         WHEN 'AUTOMOBILE' THEN ',' || c_name || ', ,'
         ELSE c_name || ', ' || lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(length(CAST(c_custkey AS VARCHAR)), 8) AS INTEGER), '0') END FROM customer),
flag AS (SELECT *, (contains(lower(line), 'họ tên') OR contains(lower(line), 'mssv') OR contains(lower(line), 'name')
                    OR contains(lower(line), 'student')) AS hdr FROM up),
fh AS (SELECT file, min(line_no) AS first_hdr FROM flag WHERE hdr GROUP BY file),
parts AS (SELECT f.*, fh.first_hdr,
  list_filter(list_transform(string_split(line, ','), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')),
              lambda p: p <> '') AS ps
  FROM flag f LEFT JOIN fh ON f.file = fh.file),
vals AS (SELECT file, line_no, CASE WHEN contains(line, ',') AND first_hdr IS NOT NULL AND line_no > first_hdr THEN
    (CASE WHEN len(ps) >= 2 THEN (CASE WHEN regexp_full_match(ps[2], '[0-9]{6,}') THEN ps[2] ELSE ps[1] END)
          WHEN len(ps) = 1 THEN ps[1] END)
    ELSE line END AS input_value FROM parts WHERE NOT hdr)
"""


@register("sc6_lookup_upload", "SC6", SQL_UPLOAD + "SELECT * FROM vals WHERE input_value IS NOT NULL")
def sc6_lookup_upload(spark, sf):
    return EX.sniff_lookup_lines(upload_lines(spark, sf))


@register("so5_upload_dedupe", "SO5 SC6", SQL_UPLOAD + """
SELECT input_value, p.file AS first_file, p.line_no AS first_line, n FROM (SELECT input_value, min(struct_pack(file := CAST(file AS BIGINT), line_no := line_no)) AS p, count(*) AS n
FROM vals WHERE input_value IS NOT NULL GROUP BY input_value)""")
def so5_upload_dedupe(spark, sf):
    v = EX.sniff_lookup_lines(upload_lines(spark, sf))
    return (v.groupBy("input_value").agg(
        F.min(F.struct(F.col("file").cast("bigint").alias("file"), "line_no")).alias("p"),
        F.count(F.lit(1)).cast("bigint").alias("n"))
        .select("input_value", F.col("p.file").alias("first_file"), F.col("p.line_no").alias("first_line"), "n"))
