"""Registered queries: typed batch lookup (SR3-SR8, SF1, SF3, SF4).

Lookup inputs are derived from ``orders`` (one input line per order, its kind picked by
the order priority) and looked up in ``customer``, so both sides grow with the data:
  1-URGENT        -> the customer id as 10-digit text        (kind mssv)
  2-HIGH          -> the customer name                       (kind name)
  3-MEDIUM        -> month + segment prefix, e.g. ``7FUR``   (kind class)
  4-NOT SPECIFIED -> the order date as d/M/yyyy              (kind date)
  5-LOW           -> a name that matches nobody              (kind name, miss)
Customers carry an id text, a name, a class ``<nation><segment prefix>`` and a birth date
``1995-01-01 + c_custkey days``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook.functions.text import DATE_FORMATS, input_kind, parse_date
from rollbook.operators import search as SR
from rollbook.plans.registry import padded, register
from rollbook.session import read_table


def lookup_inputs(spark, sf):
    o = read_table(spark, sf, "orders")
    pr = F.col("o_orderpriority")
    cust = F.col("o_custkey").cast("string")
    seg = (F.when(F.col("o_orderstatus") == "F", "FUR").when(F.col("o_orderstatus") == "O", "HOU")
           .otherwise("MAC"))
    v = (F.when(pr == "1-URGENT", padded(cust, 10))
         .when(pr == "2-HIGH", F.concat(F.lit("Customer#"), padded(cust, 9)))
         .when(pr == "3-MEDIUM", F.concat(F.month("o_orderdate").cast("string"), seg))
         .when(pr == "4-NOT SPECIFIED", F.date_format("o_orderdate", "d/M/yyyy"))
         .otherwise(F.concat(F.lit("  Nobody "), F.col("o_orderkey").cast("string"))))
    return o.select(F.col("o_orderkey").alias("input_order"), v.alias("input_value"))


SQL_INPUTS = """WITH inputs AS (
  SELECT o_orderkey AS input_order,
    CASE o_orderpriority
      WHEN '1-URGENT' THEN lpad(CAST(o_custkey AS VARCHAR), CAST(greatest(length(CAST(o_custkey AS VARCHAR)), 10) AS INTEGER), '0')
      WHEN '2-HIGH' THEN 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), CAST(greatest(length(CAST(o_custkey AS VARCHAR)), 9) AS INTEGER), '0')
      WHEN '3-MEDIUM' THEN CAST(month(o_orderdate) AS VARCHAR) ||
           CASE o_orderstatus WHEN 'F' THEN 'FUR' WHEN 'O' THEN 'HOU' ELSE 'MAC' END
      WHEN '4-NOT SPECIFIED' THEN strftime(o_orderdate, '%-d/%-m/%Y')
      ELSE '  Nobody ' || CAST(o_orderkey AS VARCHAR) END AS input_value
  FROM orders)"""


def lookup_targets(spark, sf):
    c = read_table(spark, sf, "customer")
    return c.select(
        "c_custkey", "c_name",
        padded(F.col("c_custkey"), 10).alias("ma"),
        F.concat(F.col("c_nationkey").cast("string"), F.substring("c_mktsegment", 1, 3)).alias("lop"),
        F.date_format(F.date_add(F.lit("1995-01-01").cast("date"), F.col("c_custkey").cast("int")), "dd/MM/yyyy")
        .alias("ngay_sinh"))


ROLES = {
    "mssv": [("ma", "ma")],
    "name": [("c_name", "c_name")],
    "class": [("lop", "lop")],
    "date": [("ngay_sinh", "ngay_sinh")],
}

TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_SQL_FORMATS = {  # DuckDB spelling of SF1, with the digit shapes Python's strptime insists on
    "d/M/yyyy": ("[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}", "%d/%m/%Y"),
    "M/d/yyyy": ("[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}", "%m/%d/%Y"),
    "yyyy-M-d": ("[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}", "%Y-%m-%d"),
    "d-M-yyyy": ("[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}", "%d-%m-%Y"),
    "yyyy/M/d": ("[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}", "%Y/%m/%d"),
}


def sql_parse_date(expr: str) -> str:
    t = TRIM.format(expr)
    arms = [f"CASE WHEN regexp_full_match({t}, '{_SQL_FORMATS[f][0]}') THEN "
            f"CAST(try_strptime({t}, '{_SQL_FORMATS[f][1]}') AS DATE) END" for f in DATE_FORMATS]
    return "coalesce(" + ", ".join(arms) + ")"


def sql_kind(t: str) -> str:
    return (f"CASE WHEN regexp_full_match({t}, '[0-9]{{6,10}}') THEN 'mssv' "
            f"WHEN regexp_matches({t}, '[0-9]{{1,2}}[/-][0-9]{{1,2}}[/-][0-9]{{2,4}}') THEN 'date' "
            f"WHEN regexp_full_match({t}, '[0-9]+[A-Za-z]+[0-9]*') AND length({t}) <= 15 THEN 'class' "
            f"ELSE 'name' END")


SQL_KEYED = SQL_INPUTS + f""",
cls AS (SELECT input_order, input_value, {TRIM.format('input_value')} AS t FROM inputs),
kinded AS (SELECT input_order, input_value, t, {sql_kind('t')} AS kind FROM cls WHERE t <> ''),
keyed AS (SELECT input_order, input_value, kind,
    CASE WHEN kind = 'mssv' THEN t WHEN kind = 'date' THEN strftime({sql_parse_date('t')}, '%Y-%m-%d')
         ELSE lower(t) END AS key FROM kinded),
tgt0 AS (SELECT c_custkey, c_name, lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(length(CAST(c_custkey AS VARCHAR)), 10) AS INTEGER), '0') AS ma,
    CAST(c_nationkey AS VARCHAR) || substring(c_mktsegment, 1, 3) AS lop,
    strftime(DATE '1995-01-01' + CAST(c_custkey AS INTEGER), '%d/%m/%Y') AS ngay_sinh FROM customer),
tgt AS (
  SELECT 'mssv' AS kind, regexp_replace({TRIM.format('ma')}, '\\.0$', '') AS key, 0 AS col_ord, 'ma' AS field,
         c_custkey AS row_ord, c_name FROM tgt0
  UNION ALL SELECT 'name', lower({TRIM.format('c_name')}), 0, 'c_name', c_custkey, c_name FROM tgt0
  UNION ALL SELECT 'class', lower({TRIM.format('lop')}), 0, 'lop', c_custkey, c_name FROM tgt0
  UNION ALL SELECT 'date', strftime({sql_parse_date('ngay_sinh')}, '%Y-%m-%d'), 0, 'ngay_sinh', c_custkey, c_name
            FROM tgt0)
"""

SQL_FIRST_HIT = SQL_KEYED + """,
first_hit AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind, key ORDER BY col_ord, row_ord) AS rn
                             FROM tgt WHERE key IS NOT NULL) WHERE rn = 1),
matches AS (SELECT k.input_order, k.input_value, k.kind, CAST(1.0 AS DOUBLE) AS match_score, f.field AS match_field,
                   f.row_ord, f.c_name
            FROM keyed k JOIN first_hit f ON k.kind = f.kind AND k.key = f.key)
"""


def typed_matches(spark, sf):
    return SR.typed_lookup(lookup_inputs(spark, sf), lookup_targets(spark, sf), ROLES, "c_custkey", ["c_name"])


@register("sr3_batch_lookup", "SR3 TK7 SF4 SR4 SR5 SR6 SR7 UD4", SQL_FIRST_HIT + "SELECT * FROM matches")
def sr3_batch_lookup(spark, sf):
    return typed_matches(spark, sf)


@register("sr8_coverage", "SR8", SQL_FIRST_HIT + """
SELECT count(*) AS total_inputs, count(m.input_order) AS found, count(*) - count(m.input_order) AS not_found
FROM (SELECT input_order FROM inputs WHERE regexp_replace(input_value, '^\\s+|\\s+$', '', 'g') <> '') i
LEFT JOIN (SELECT DISTINCT input_order FROM matches) m ON i.input_order = m.input_order""")
def sr8_coverage(spark, sf):
    return SR.coverage(lookup_inputs(spark, sf), typed_matches(spark, sf))


SQL_DISTINCT_KEYED = SQL_KEYED.replace(
    "cls AS (SELECT input_order, input_value, " + TRIM.format('input_value') + " AS t FROM inputs),",
    "dins AS (SELECT arg_min(input_order, input_order) AS input_order, arg_min(input_value, input_order) AS input_value, count(*) AS n_inputs"
    " FROM inputs WHERE " + TRIM.format('input_value') + " <> '' GROUP BY " + TRIM.format('input_value') + "),\n"
    "cls AS (SELECT input_order, input_value, n_inputs, " + TRIM.format('input_value') + " AS t FROM dins),").replace(
    "kinded AS (SELECT input_order, input_value, t,", "kinded AS (SELECT input_order, input_value, n_inputs, t,").replace(
    "keyed AS (SELECT input_order, input_value, kind,", "keyed AS (SELECT input_order, input_value, n_inputs, kind,")


def _by_kind(kind_sql: str, first: bool) -> str:
    hits = f"(SELECT * FROM tgt WHERE kind = '{kind_sql}' AND key IS NOT NULL)"
    if first:
        hits = (f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key, col_ord ORDER BY row_ord) AS rn "
                f"FROM {hits}) WHERE rn = 1)")
    assert SQL_DISTINCT_KEYED != SQL_KEYED
    return SQL_DISTINCT_KEYED + f"""
SELECT k.input_order, k.input_value, k.n_inputs, h.field AS match_field, h.col_ord, h.row_ord, h.c_name
FROM keyed k JOIN {hits} h ON k.key = h.key WHERE k.kind = '{kind_sql}'"""


def _all_hits(spark, sf, kind, first):
    return SR.lookup_all_hits(lookup_inputs(spark, sf), lookup_targets(spark, sf), kind, ROLES[kind],
                              "c_custkey", ["c_name"], first_per_column=first)


@register("sr4_lookup_by_id", "SR4 CL5", _by_kind("mssv", True))
def sr4_lookup_by_id(spark, sf):
    return _all_hits(spark, sf, "mssv", True)


@register("sr5_lookup_by_name", "SR5", _by_kind("name", True))
def sr5_lookup_by_name(spark, sf):
    return _all_hits(spark, sf, "name", True)


@register("sr6_lookup_by_class", "SR6", _by_kind("class", False))
def sr6_lookup_by_class(spark, sf):
    return _all_hits(spark, sf, "class", False)


@register("sr7_lookup_by_date", "SR7 SF1", _by_kind("date", False))
def sr7_lookup_by_date(spark, sf):
    return _all_hits(spark, sf, "date", False)


@register("sf4_input_kinds", "SF4 SF3", SQL_INPUTS + f""",
cls AS (SELECT input_order, input_value, {TRIM.format('input_value')} AS t FROM inputs)
SELECT input_order, input_value, {sql_kind('t')} AS kind, regexp_full_match(t, '[0-9]{{6,10}}') AS id_shape
FROM cls WHERE t <> ''""")
def sf4_input_kinds(spark, sf):
    from rollbook.functions.text import is_id_shape, utrim
    i = lookup_inputs(spark, sf)
    return (i.where(utrim("input_value") != "")
            .select("input_order", "input_value", input_kind("input_value").alias("kind"),
                    is_id_shape("input_value").alias("id_shape")))


# SF1: each order date rendered in one of the five formats (by priority), parsed back.
_RENDER = [("1-URGENT", "dd/MM/yyyy", "%d/%m/%Y"), ("2-HIGH", "MM/dd/yyyy", "%m/%d/%Y"),
           ("3-MEDIUM", "yyyy-M-d", "%Y-%-m-%-d"), ("4-NOT SPECIFIED", "d-M-yyyy", "%-d-%-m-%Y"),
           ("5-LOW", "yyyy/MM/dd", "%Y/%m/%d")]


@register("sf1_date_parse", "SF1", "WITH r AS (SELECT o_orderkey, CASE o_orderpriority " + " ".join(
    f"WHEN '{p}' THEN strftime(o_orderdate, '{d}')" for p, _, d in _RENDER) + """ END AS rendered FROM orders)
SELECT o_orderkey, rendered, strftime(""" + sql_parse_date("rendered") + """, '%Y-%m-%d') AS parsed FROM r""")
def sf1_date_parse(spark, sf):
    o = read_table(spark, sf, "orders")
    rendered = None
    for p, fmt, _ in _RENDER:
        arm = F.date_format("o_orderdate", fmt)
        rendered = (F.when(F.col("o_orderpriority") == p, arm) if rendered is None
                    else rendered.when(F.col("o_orderpriority") == p, arm))
    r = o.select("o_orderkey", rendered.alias("rendered"))
    return r.select("o_orderkey", "rendered", F.date_format(parse_date("rendered"), "yyyy-MM-dd").alias("parsed"))
