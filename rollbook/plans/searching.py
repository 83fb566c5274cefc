"""Registered queries: scored search (SR1, SR2, SR9, SF8) with generated DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook.operators import search as SR
from rollbook.plans import bindings as B
from rollbook.plans.registry import register, rounded
from rollbook.session import read_table

CUSTOMER_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _trim_sql(expr: str) -> str:
    return f"regexp_replace(CAST({expr} AS VARCHAR), '^\\s+|\\s+$', '', 'g')"


def _norm_sql(expr: str) -> str:
    v = f"lower({_trim_sql(expr)})"
    return f"(CASE WHEN {v} <> '' AND {v} <> 'nan' THEN {v} END)"


def sr1_sql(table: str, query: str, id_cols, name_col, class_cols, cols_out: str) -> str:
    """DuckDB spelling of SR1 for one fixed query."""
    qq = query.strip().lower()
    parts, reasons = [], []
    for c in id_cols:
        v = _norm_sql(c)
        parts.append(f"CASE WHEN contains({v}, {q(qq)}) THEN (CASE WHEN {v} = {q(qq)} THEN 1.0 ELSE 0.8 END) END")
        reasons.append(f"CASE WHEN contains({v}, {q(qq)}) THEN (CASE WHEN {v} = {q(qq)} THEN "
                       f"{q(SR.REASON_ID_EXACT)} ELSE {q(SR.REASON_ID_PART)} END) || {_trim_sql(c)} END")
    n = _norm_sql(name_col)
    words = qq.split()
    overlap = ("0.7 * ((" + " + ".join(f"(CASE WHEN contains({n}, {q(w)}) THEN 1 ELSE 0 END)" for w in words)
               + f") / {float(len(words))})")
    parts.append(f"CASE WHEN {n} = {q(qq)} THEN 0.95 WHEN contains({n}, {q(qq)}) OR contains({q(qq)}, {n}) "
                 f"THEN 0.85 WHEN {overlap} > 0.3 THEN {overlap} END")
    reasons.append(f"CASE WHEN {n} = {q(qq)} THEN {q(SR.REASON_NAME_EXACT)} || {n} "
                   f"WHEN contains({n}, {q(qq)}) OR contains({q(qq)}, {n}) THEN {q(SR.REASON_NAME_PART)} || {n} "
                   f"WHEN {overlap} > 0.3 THEN {q(SR.REASON_NAME_WORDS)} || {n} END")
    for c in class_cols:
        v = _norm_sql(c)
        parts.append(f"CASE WHEN contains({v}, {q(qq)}) THEN (CASE WHEN {v} = {q(qq)} THEN 0.9 ELSE 0.7 END) END")
        reasons.append(f"CASE WHEN contains({v}, {q(qq)}) THEN (CASE WHEN {v} = {q(qq)} THEN "
                       f"{q(SR.REASON_CLASS_EXACT)} ELSE {q(SR.REASON_CLASS_PART)} END) || {_trim_sql(c)} END")
    score = "greatest(" + ", ".join(f"coalesce({p}, 0.0)" for p in parts) + ")"
    details = "concat_ws('; ', " + ", ".join(reasons) + ")"
    return (f"SELECT * FROM (SELECT {cols_out}, round(CAST({score} AS DOUBLE), 6) AS match_score, "
            f"{details} AS match_details FROM {table}) WHERE match_score > 0.3")


def sr2_score_sql(query: str, columns, id_cols, name_cols):
    """Per-column SR2 scores in DuckDB, in column order."""
    text = query.strip()
    low = text.lower()
    is_id = text.isdigit() and text.isascii() and 6 <= len(text) <= 10
    out = []
    for c in columns:
        v = f"lower({_trim_sql(c)})"
        if is_id and c in id_cols:
            s = f"CASE WHEN {v} = {q(text)} THEN 1.0 WHEN contains({v}, {q(text)}) THEN 0.9 ELSE 0.0 END"
        elif c in name_cols:
            allw = " AND ".join(f"contains({v}, {q(w)})" for w in low.split()) or "TRUE"
            s = (f"CASE WHEN {v} = {q(low)} THEN 0.95 WHEN contains({v}, {q(low)}) OR contains({q(low)}, {v}) "
                 f"THEN 0.8 WHEN {allw} THEN 0.7 ELSE 0.0 END")
        else:
            s = f"CASE WHEN {v} = {q(low)} THEN 0.6 WHEN contains({v}, {q(low)}) THEN 0.5 ELSE 0.0 END"
        out.append(f"coalesce(({s}), 0.0)")
    return out


def sr2_best_sql(query, columns, id_cols, name_cols):
    scores = sr2_score_sql(query, columns, id_cols, name_cols)
    best = "greatest(" + ", ".join(scores) + ")"
    field = "CASE " + " ".join(f"WHEN {s} = {best} THEN {q(c)}" for s, c in zip(scores, columns)) + " END"
    return best, field


# ---------------------------------------------------------------- SR1
@register("sr1_scored_name_search", "SR1 SF8", B.with_ctes(B.SQL_ROSTER) + sr1_sql(
    "roster", "red widget", ["ma_sinh_vien"], "ho_ten", ["lop"], "ma_sinh_vien, ho_ten, lop"))
def sr1_scored_name_search(spark, sf):
    r = B.roster(spark, sf)
    out = SR.scored_search(r, "red widget", ["ma_sinh_vien"], F.col("ho_ten"), ["lop"], ["ma_sinh_vien"])
    return rounded(out.select("ma_sinh_vien", "ho_ten", "lop", "match_score",
                              F.array_join("match_details", "; ").alias("match_details")))


@register("sr1_scored_id_search", "SR1", sr1_sql(
    "customer", "123", ["c_custkey"], "c_name", ["c_mktsegment"], "c_custkey, c_name, c_mktsegment"))
def sr1_scored_id_search(spark, sf):
    c = read_table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    out = SR.scored_search(c, "123", ["c_custkey"], F.col("c_name"), ["c_mktsegment"], ["c_custkey"])
    return rounded(out.select("c_custkey", "c_name", "c_mktsegment", "match_score",
                              F.array_join("match_details", "; ").alias("match_details")))


# ---------------------------------------------------------------- SR2
SR2_QUERY = "Customer#00000010"
_best, _field = sr2_best_sql(SR2_QUERY, CUSTOMER_COLS, ["c_custkey"], ["c_name"])


@register("sr2_simple_search", "SR2", f"""
SELECT * FROM (SELECT c_custkey, c_name, round(CAST({_best} AS DOUBLE), 6) AS match_score, {_field} AS match_field
FROM customer) WHERE match_score >= 0.5""")
def sr2_simple_search(spark, sf):
    c = read_table(spark, sf, "customer")
    out = SR.simple_search(c, SR2_QUERY, CUSTOMER_COLS, ["c_custkey"], ["c_name"], ["c_custkey"])
    return rounded(out.select("c_custkey", "c_name", "match_score", "match_field"))


# ---------------------------------------------------------------- SR9
SR9_LINES = ["Customer#000000007", "AUTOMOBILE", "000000123", "  ", "customer#000000042"]


def _sr9_sql():
    lines = [ln.strip() for ln in SR9_LINES if ln.strip()]
    sel = []
    for i, ln in enumerate(lines):
        b, f = sr2_best_sql(ln, CUSTOMER_COLS, ["c_custkey"], ["c_name"])
        sel.append(f"SELECT c_custkey, c_name, {i} AS line_order, {q(ln)} AS input_value, "
                   f"CAST({b} AS DOUBLE) AS match_score, {f} AS match_field FROM customer")
    union = "\nUNION ALL\n".join(sel)
    return f"""WITH m AS ({union}),
r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY line_order, match_score DESC) AS rn
      FROM m WHERE match_score >= 0.5)
SELECT c_custkey, c_name, input_value, round(match_score, 6) AS match_score, match_field, line_order
FROM r WHERE rn = 1"""


@register("sr9_multi_line_search", "SR9 SO6", _sr9_sql())
def sr9_multi_line_search(spark, sf):
    c = read_table(spark, sf, "customer")
    out = SR.multi_line_search(c, SR9_LINES, CUSTOMER_COLS, ["c_custkey"], ["c_name"],
                               key=F.concat(F.lit("mssv_"), F.col("c_custkey").cast("string")),
                               order=["c_custkey"])
    return rounded(out.select("c_custkey", "c_name", "input_value", "match_score", "match_field",
                              F.col("line_order").cast("int").alias("line_order")))


#: One line per order, its shape by the priority: a whole name, an id's last six digits, words of a name, upper case, or nothing there.
_SR9_LINE = """CASE o_orderpriority WHEN '1-URGENT' THEN concat('Customer#', {padded9}) WHEN '2-HIGH' THEN right({padded9}, 6)
  WHEN '3-MEDIUM' THEN concat(right({padded9}, 5), ' ', 'customer') WHEN '4-NOT SPECIFIED' THEN concat(' CUSTOMER#', {padded9}) ELSE concat('no such ', {padded9}) END"""


def _sr9_table_sql():
    low, v = "low", "v"
    is_id = "regexp_full_match(line, '[0-9]{6,10}')"
    words = "list_bool_and(list_transform(list_filter(string_split_regex(low, '\\s+'), lambda w: w <> ''), lambda w: contains(v, w)))"
    name = f"CASE WHEN {v} = {low} THEN 0.95 WHEN contains({v}, {low}) OR contains({low}, {v}) THEN 0.8 WHEN {words} THEN 0.7 ELSE 0.0 END"
    plain = f"CASE WHEN {v} = {low} THEN 0.6 WHEN contains({v}, {low}) THEN 0.5 ELSE 0.0 END"
    ident = f"CASE WHEN {v} = {low} THEN 1.0 WHEN contains({v}, {low}) THEN 0.9 ELSE 0.0 END"
    cells = " UNION ALL ".join(f"SELECT c_custkey, {i} AS pos, '{c}' AS field, lower({_trim_sql(c)}) AS v FROM customer" for i, c in enumerate(CUSTOMER_COLS))
    return f"""WITH asked AS (SELECT trim(line) AS line, lower(trim(line)) AS low, min(o_orderkey) AS line_order FROM (
  SELECT o_orderkey, {_SR9_LINE.format(padded9="lpad(CAST(o_custkey AS VARCHAR), 9, '0')")} AS line FROM orders) GROUP BY ALL),
cells AS ({cells}),
cell AS (SELECT DISTINCT pos, field, v FROM cells),
scored AS (SELECT pos, field, v, line, line_order, CASE WHEN field = 'c_custkey' AND {is_id} THEN {ident} WHEN field = 'c_name' THEN {name} ELSE {plain} END AS s
           FROM cell, asked),
r AS (SELECT c_custkey, line, line_order, s, field, row_number() OVER (PARTITION BY c_custkey ORDER BY line_order, s DESC, pos) AS rn
      FROM cells JOIN scored USING (pos, field, v) WHERE s >= 0.5)
SELECT r.c_custkey, c_name, line AS input_value, round(CAST(s AS DOUBLE), 6) AS match_score, field AS match_field, line_order
FROM r JOIN customer USING (c_custkey) WHERE rn = 1"""


@register("sr9_search_lines", "SR9 SO6", _sr9_table_sql())
def sr9_search_lines(spark, sf):
    """Every order asks a line; customers are searched by all of them."""
    o = read_table(spark, sf, "orders")
    lines = o.select(F.col("o_orderkey").alias("line_order"), F.expr(_SR9_LINE.format(padded9="lpad(CAST(o_custkey AS STRING), greatest(9, length(CAST(o_custkey AS STRING))), '0')")).alias("line"))
    c = read_table(spark, sf, "customer")
    out = SR.search_lines(c, lines, CUSTOMER_COLS, ["c_custkey"], ["c_name"], key=F.concat(F.lit("mssv_"), F.col("c_custkey").cast("string")), order=["c_custkey"])
    return rounded(out.select("c_custkey", "c_name", "input_value", "match_score", "match_field", "line_order"))
