"""Scored search and typed batch lookup (SR1-SR9).

Scores are projections: every candidate row is scored by one expression, no per-row
Python. Batch lookups are equi-joins against the target unpivoted to ``(kind, key)``;
when only the first hit matters the target is reduced to one row per key *before* the
join (partial aggregation), so a key held by a third of the table costs one row, not a
fan-out.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions.text import as_col, input_kind, parse_date, utrim, word_overlap
from rollbook.session import cut_lineage

# Reason texts attached to scored-search matches (SR1).
REASON_ID_EXACT = "MSSV khớp chính xác: "
REASON_ID_PART = "MSSV chứa: "
REASON_NAME_EXACT = "Tên khớp chính xác: "
REASON_NAME_PART = "Tên chứa: "
REASON_NAME_WORDS = "Tên khớp một phần: "
REASON_CLASS_EXACT = "Lớp khớp chính xác: "
REASON_CLASS_PART = "Lớp chứa: "

SEARCH_TYPES = ("all", "mssv", "name", "class")


def keep_scored(df: DataFrame, result: Column, keep) -> DataFrame:
    """Add the fields of ``result`` (a struct) and keep rows where ``keep(result)`` holds,
    evaluating the (expensive) result once per row.

    ``withColumn(score).where(score > t)`` lets the optimizer push the filter below the
    projection with the score expression substituted, i.e. compute it twice. Filtering
    inside a one-element array and exploding it is opaque to that rewrite.
    """
    kept = df.select("*", F.explode(F.filter(F.array(result), keep)).alias("_kept"))
    return kept.select(*[F.col(f"`{c}`") for c in df.columns], "_kept.*")


def _norm(c) -> Column:
    """``str(v).strip().lower()`` with missing and ``nan`` as NULL."""
    v = F.lower(utrim(as_col(c).cast("string")))
    return F.when((v != "") & (v != "nan"), v)


# ---------------------------------------------------------------- SR1
def scored_search(df: DataFrame, query: str, id_cols: Sequence[str], name: Column | None,
                  class_cols: Sequence[str], order: Sequence[str], search_type: str = "all",
                  keep_above: float = 0.3) -> DataFrame:
    """SR1: score = max of id equal 1.0 / contains 0.8, name equal 0.95 / contains either way
    0.85 / word overlap 0.7*share (if > 0.3), class equal 0.9 / contains 0.7; keep > 0.3; all
    matches in original row order with the list of reasons."""
    q = query.strip().lower()
    if not q:
        return df.limit(0).withColumn("match_score", F.lit(None).cast("double")) \
                 .withColumn("match_details", F.array().cast("array<string>"))
    parts: list[Column] = []
    reasons: list[Column] = []
    if search_type in ("all", "mssv"):
        for c in id_cols:
            v = _norm(c)
            hit = v.contains(q)
            parts.append(F.when(hit, F.when(v == q, 1.0).otherwise(0.8)))
            raw = utrim(F.col(c).cast("string"))
            reasons.append(F.when(hit, F.when(v == q, F.concat(F.lit(REASON_ID_EXACT), raw))
                                  .otherwise(F.concat(F.lit(REASON_ID_PART), raw))))
    if search_type in ("all", "name") and name is not None:
        n = _norm(name)
        overlap = F.lit(0.7) * word_overlap(n, q)
        exact, contains = n == q, n.contains(q) | F.lit(q).contains(n)
        parts.append(F.when(exact, 0.95).when(contains, 0.85).when(overlap > 0.3, overlap))
        reasons.append(F.when(exact, F.concat(F.lit(REASON_NAME_EXACT), n))
                       .when(contains, F.concat(F.lit(REASON_NAME_PART), n))
                       .when(overlap > 0.3, F.concat(F.lit(REASON_NAME_WORDS), n)))
    if search_type in ("all", "class"):
        for c in class_cols:
            v = _norm(c)
            hit = v.contains(q)
            parts.append(F.when(hit, F.when(v == q, 0.9).otherwise(0.7)))
            raw = utrim(F.col(c).cast("string"))
            reasons.append(F.when(hit, F.when(v == q, F.concat(F.lit(REASON_CLASS_EXACT), raw))
                                  .otherwise(F.concat(F.lit(REASON_CLASS_PART), raw))))
    if not parts:
        parts, reasons = [F.lit(None).cast("double")], [F.lit(None).cast("string")]
    score = F.greatest(*parts, F.lit(0.0))
    out = (keep_scored(df, F.struct(score.alias("match_score")), lambda m: m["match_score"] > keep_above)
           .withColumn("match_details", F.array_compact(F.array(*reasons))))
    return out.orderBy(*order) if order else out


# ---------------------------------------------------------------- SR2
def _simple_scores(query: str, columns: Sequence[str], id_cols: Sequence[str],
                   name_cols: Sequence[str]) -> Column:
    """SR2 per-column scores as an array of ``struct(score, -ordinal, field)``."""
    text = query.strip()
    low = text.lower()
    is_id = text.isdigit() and text.isascii() and 6 <= len(text) <= 10
    words = low.split()
    items = []
    for i, c in enumerate(columns):
        raw = as_col(c).cast("string")
        v = F.lower(utrim(raw))
        if is_id and c in id_cols:
            s = F.when(v == text, 1.0).when(v.contains(text), 0.9)
        elif c in name_cols:
            all_words = F.lit(True)
            for w in words:
                all_words = all_words & v.contains(w)
            s = (F.when(v == low, 0.95).when(v.contains(low) | F.lit(low).contains(v), 0.8)
                 .when(all_words, 0.7))
        else:
            s = F.when(v == low, 0.6).when(v.contains(low), 0.5)
        items.append(F.struct(F.coalesce(s, F.lit(0.0)).alias("score"), F.lit(-i).alias("neg_ord"),
                              F.lit(c).alias("field")))
    return F.array(*items)


def simple_search(df: DataFrame, query: str, columns: Sequence[str], id_cols: Sequence[str],
                  name_cols: Sequence[str], order: Sequence[str], keep_at_least: float = 0.5) -> DataFrame:
    """SR2: any-field search; best field per row (first column on ties); score >= 0.5;
    best score first, then original order."""
    if not query.strip():
        return df.limit(0).withColumn("match_score", F.lit(None).cast("double")) \
                 .withColumn("match_field", F.lit(None).cast("string"))
    best = F.array_max(_simple_scores(query, columns, id_cols, name_cols))
    m = F.struct(best["score"].alias("match_score"), best["field"].alias("match_field"))
    return (keep_scored(df, m, lambda x: x["match_score"] >= keep_at_least)
            .orderBy(F.desc("match_score"), *order))


# ---------------------------------------------------------------- SR9 / SO6
def _inside(text: Column):
    """The predicate that a word stands in ``text``."""
    return lambda word: text.contains(word)


def multi_line_search(df: DataFrame, lines: Sequence[str], columns: Sequence[str], id_cols: Sequence[str],
                      name_cols: Sequence[str], key: Column, order: Sequence[str],
                      keep_at_least: float = 0.5) -> DataFrame:
    """SR9: SR2 for every query line, one result per record key.

    Each column is trimmed and lower-cased once; the lines (parameters, not data) are one array
    that a single expression walks, so the plan grows with the columns but not with the lines, and there
    is no join at all. A record matched by several lines keeps the first line, then the best
    score. Records sharing a key keep the first in that order (one shuffle on the key, matched
    rows only).
    """
    from rollbook.operators.ranking import first_by_key

    lines = [ln.strip() for ln in lines if ln.strip()]
    if not lines:
        return df.limit(0)
    asked = F.array(*[F.struct(F.lit(i).alias("line_order"), F.lit(ln).alias("line"), F.lit(ln.lower()).alias("low"),
                               F.lit(ln.isdigit() and ln.isascii() and 6 <= len(ln) <= 10).alias("is_id"),
                               F.array(*[F.lit(w) for w in ln.lower().split()]).alias("words")) for i, ln in enumerate(lines)])
    cleaned = df.select("*", F.array(*[F.lower(utrim(as_col(c).cast("string"))) for c in columns]).alias("_norm"))

    def best(line: Column) -> Column:
        low, items = line["low"], []
        for i, c in enumerate(columns):
            v = F.col("_norm")[i]
            if c in name_cols:
                score = (F.when(v == low, 0.95).when(v.contains(low) | low.contains(v), 0.8)
                         .when(F.forall(line["words"], _inside(v)), 0.7))
            else:
                score = F.when(v == low, 0.6).when(v.contains(low), 0.5)
            if c in id_cols:
                score = F.when(line["is_id"], F.when(v == low, 1.0).when(v.contains(low), 0.9)).otherwise(score)
            items.append(F.struct(F.coalesce(score, F.lit(0.0)).alias("score"), F.lit(-i).alias("neg_ord"), F.lit(c).alias("field")))
        return F.array_max(F.array(*items))

    scored = F.transform(asked, lambda ln: F.struct(ln["line_order"].alias("line_order"), ln["line"].alias("line"), best(ln).alias("b")))
    kept = F.transform(F.filter(scored, lambda x: x["b"]["score"] >= keep_at_least), lambda x: F.struct(
        x["line_order"].alias("line_order"), (-x["b"]["score"]).alias("neg_score"), x["b"]["field"].alias("field"), x["line"].alias("line")))
    hits = (cleaned.select("*", F.explode(F.slice(F.array_sort(kept), 1, 1)).alias("_m"))
            .select(*[F.col(f"`{c}`") for c in df.columns], key.alias("_key"),
                    F.col("_m.line_order").alias("line_order"), F.col("_m.neg_score").alias("_neg_score"),
                    F.col("_m.field").alias("match_field"), F.col("_m.line").alias("input_value"))
            .where(F.col("_key").isNotNull()))
    # one row per record key: first line, best score, then original order (an aggregate,
    # so a key repeated across many rows is combined map-side)
    first = first_by_key(hits, ["_key"], [("line_order", True), ("_neg_score", True)] + [(c, True) for c in order])
    return first.select(*df.columns, "input_value", (-F.col("_neg_score")).alias("match_score"),
                        "match_field", "line_order")


#: Lengths of the grams that lines and cells are indexed by; each word uses the longest that fits into it.
GRAM_LENGTHS = (6, 5, 4, 3, 2, 1)


def _words_of(text: Column) -> Column:
    """The white-space separated words of a trimmed text, as ``multi_line_search`` splits lines."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _grams_of(words: Column, q: Column | int) -> Column:
    """Distinct grams of q characters inside words."""
    q = q if isinstance(q, Column) else F.lit(q)
    each = F.transform(words, lambda w: F.when(F.length(w) >= q, F.transform(
        F.sequence(F.lit(1), F.length(w) - q + 1), lambda i: F.substring(w, i, q))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.flatten(each))


def _containing(small: DataFrame, large: DataFrame) -> DataFrame:
    """(s, l): texts of ``small`` with those of ``large`` that hold all their words; both have a column ``v`` of distinct texts.

    An inverted index: a text that holds every word of another holds any gram of it, so each small text is looked up under one gram only, the one
    that the fewest large texts have, of all its words: the longest word may be the one that all large texts have. Words of one or two characters
    are looked up only where there are no others. Work follows the rarest grams, not the product of the sides.
    """
    length_of = lambda w: functools.reduce(lambda out, n: F.when(F.length(w) >= n, n).otherwise(out), reversed(GRAM_LENGTHS), F.lit(0))
    own = lambda w: _grams_of(F.array(w), length_of(w))
    words = _words_of(F.col("v"))
    telling = F.filter(words, lambda w: F.length(w) >= 3)
    picked = F.when(F.size(telling) > 0, telling).otherwise(words)
    mine = cut_lineage(small.where(F.size(words) > 0).select(F.col("v").alias("s"), F.explode(F.array_distinct(F.flatten(F.transform(picked, own)))).alias("gram")), "lines")
    used = sorted(r["q"] for r in mine.select(F.length("gram").alias("q")).distinct().collect())  # of GRAM_LENGTHS
    if not used:
        return small.select(F.col("v").alias("s"), F.col("v").alias("l")).limit(0)
    held = F.flatten(F.transform(F.array(*[F.lit(n) for n in used]), lambda n: _grams_of(words, n)))
    dealt = large.select("v").repartition(int(large.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("v"))
    index = dealt.select(F.col("v").alias("l"), F.explode(held).alias("gram"))
    index = cut_lineage(index.join(mine.select("gram").distinct(), "gram", "left_semi"), "grams")
    often = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # a gram that no large text has rules the small one out
    rarest = (mine.join(often, "gram", "left").groupBy("s")
              .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n > 0").select("s", "r.gram"))
    return rarest.join(index, "gram").where(F.forall(_words_of(F.col("s")), lambda w: F.col("l").contains(w))).select("s", "l")


def search_lines(df: DataFrame, lines: DataFrame, columns: Sequence[str], id_cols: Sequence[str], name_cols: Sequence[str], key: Column,
                 order: Sequence[str], keep_at_least: float = 0.5) -> DataFrame:
    """SR9 with the query lines as a table ``(line_order, line)``: the results of ``multi_line_search``, for any number of lines.

    Distinct cells meet distinct lines by an index of rare grams (``_containing``, both ways for names), each cell keeps its first line at its
    best score, and rows look their cells up by equality. A blank name is part of any line, so it takes the first.
    Lines that are NULL or blank ask nothing.
    """
    from rollbook.operators.ranking import first_by_key

    text = utrim("line")
    asked = cut_lineage(lines.where(text != "").groupBy(text.alias("line")).agg(F.min("line_order").alias("line_order"))
                        .withColumn("low", F.lower("line")).withColumn("is_id", F.col("line").rlike("^[0-9]{6,10}$")), "lines")
    names = [F.lower(utrim(as_col(c).cast("string"))) for c in columns]
    rows = df.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in df.columns])).select(
        "_row", key.alias("_key"), F.posexplode(F.array(*names)).alias("_at", "_v")).where(F.col("_key").isNotNull() & F.col("_v").isNotNull())
    cells = cut_lineage(rows.select(F.col("_at").alias("at"), F.col("_v").alias("v")).distinct(), "cells")
    is_name = F.col("at").isin([i for i, c in enumerate(columns) if c in name_cols])
    is_id_col = F.col("at").isin([i for i, c in enumerate(columns) if c in id_cols])
    low = asked.select(F.col("low").alias("v")).distinct()
    pairs = _containing(low, cells.select("v").distinct()).select(F.col("s").alias("low_"), F.col("l").alias("v_"))
    within = _containing(cells.where(is_name).select("v").distinct(), low).select(F.col("l").alias("low_"), F.col("s").alias("v_"))
    pairs = pairs.unionByName(within).distinct()
    first = asked.orderBy("line_order").limit(1).select("low").collect()  # what a blank name takes
    if first:
        blank = cells.where(is_name & (F.col("v") == "")).select(F.lit(first[0]["low"]).alias("low_"), F.col("v").alias("v_"))
        pairs = pairs.unionByName(blank.distinct())
    met = cells.join(pairs, F.col("v") == F.col("v_")).drop("v_").join(asked, F.col("low") == F.col("low_")).drop("low_")
    v, line = F.col("v"), F.col("low")
    named = F.when(v == line, 0.95).when(v.contains(line) | line.contains(v), 0.8).when(F.forall(_words_of(line), lambda w: v.contains(w)), 0.7)
    plain = F.when(v == line, 0.6).when(v.contains(line), 0.5)
    score = F.when(is_id_col & F.col("is_id"), F.when(v == line, 1.0).when(v.contains(line), 0.9)).when(is_name, named).otherwise(plain)
    best = (met.withColumn("score", score).where(F.col("score") >= keep_at_least)
            .groupBy(F.col("at").alias("_at2"), F.col("v").alias("_v2")).agg(F.min(F.struct("line_order", (-F.col("score")).alias("neg_score"), "line")).alias("_m")))
    hits = rows.join(best, (F.col("_at") == F.col("_at2")) & (F.col("_v") == F.col("_v2"))).select(
        "_row.*", "_key", F.col("_m.line_order").alias("line_order"), F.col("_m.neg_score").alias("_neg_score"), "_at", F.col("_m.line").alias("input_value"))
    one = first_by_key(hits, ["_key"], [("line_order", True), ("_neg_score", True)] + [(c, True) for c in order] + [("_at", True)])
    field = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("_at") + 1)
    return one.select(*df.columns, "input_value", (-F.col("_neg_score")).alias("match_score"), field.alias("match_field"), "line_order")


# ---------------------------------------------------------------- SR3 - SR8
KINDS = ("mssv", "name", "class", "date")


def normalize_input(kind: Column, value: Column) -> Column:
    """Lookup key of an input of the given kind."""
    v = utrim(value)
    return (F.when(kind == "mssv", v)
            .when(kind == "date", F.date_format(parse_date(v), "yyyy-MM-dd"))
            .otherwise(F.lower(v)))


def normalize_target(kind: str, c: Column) -> Column:
    """Lookup key of a target column playing role ``kind``."""
    v = utrim(c.cast("string"))
    if kind == "mssv":
        return F.regexp_replace(v, r"\.0$", "")
    if kind == "date":
        return F.date_format(parse_date(v), "yyyy-MM-dd")
    return F.lower(v)


NO_KEY = "\u0000"  # never a target key: stands for "unparseable" so the key is never NULL


def classify_inputs(inputs: DataFrame, value: str = "input_value", order: str = "input_order") -> DataFrame:
    """SF4 on a lookup list: blank lines drop out, each input gets ``kind`` and ``key``.

    The key is non-nullable on purpose: a nullable computed join key makes the optimizer
    infer an ``isnotnull`` filter and push it below the projection, which evaluates the
    whole classification a second time per row."""
    v = utrim(value)
    return (inputs.where(v != "")
            .withColumn("kind", input_kind(value))
            .withColumn("key", F.coalesce(normalize_input(F.col("kind"), F.col(value)), F.lit(NO_KEY))))


def unpivot_roles(target: DataFrame, roles: dict[str, Sequence[tuple[str, Column | str]]], row_ord: str,
                  payload: Sequence[str]) -> DataFrame:
    """Target rows as ``(kind, key, col_ord, row_ord, field, payload...)``, one row per role column."""
    items = []
    for kind, cols in roles.items():
        for i, (field, c) in enumerate(cols):
            items.append(F.struct(F.lit(kind).alias("kind"), normalize_target(kind, as_col(c)).alias("key"),
                                  F.lit(i).alias("col_ord"), F.lit(field).alias("field")))
    return (target.select(F.explode(F.array(*items)).alias("_u"), F.col(row_ord).alias("row_ord"), *payload)
            .select("_u.*", "row_ord", *payload).where(F.col("key").isNotNull()))


def typed_lookup(inputs: DataFrame, target: DataFrame, roles: dict[str, Sequence[tuple[str, Column]]],
                 row_ord: str, payload: Sequence[str], value: str = "input_value",
                 order: str = "input_order") -> DataFrame:
    """SR3 (with SR4-SR7 as its per-kind branches): classify each input, look it up in the
    columns of its kind only, exact match, first hit per input, input order kept.

    The target is reduced to its first row per ``(kind, key)`` by ``min(struct(col_ord,
    row_ord, ...))``, a partial aggregate, before joining, so hot keys never fan out.
    """
    ins = classify_inputs(inputs, value, order)  # inner join drops NULL keys
    # only what the inputs ask for is reduced: the whole target is neither sorted nor shuffled for few inputs
    asked = ins.select("kind", "key").where(F.col("key").isNotNull()).distinct()
    u = unpivot_roles(target, roles, row_ord, payload).join(asked, ["kind", "key"], "left_semi")
    first = (u.groupBy("kind", "key")
             .agg(F.min(F.struct("col_ord", "row_ord", "field", *payload)).alias("_hit"))
             .select("kind", "key", "_hit.*"))
    out = ins.join(first, ["kind", "key"], "inner")
    return out.select(
        F.col(order).alias("input_order"), F.col(value).alias("input_value"), "kind",
        F.lit(1.0).alias("match_score"), F.col("field").alias("match_field"), "row_ord", *payload
    ).orderBy("input_order")


def distinct_inputs(inputs: DataFrame, value: str = "input_value", order: str = "input_order") -> DataFrame:
    """SO5 on a lookup list: each distinct (trimmed) value once, at its first position, with the
    number of inputs that give it."""
    t = utrim(value)
    return (inputs.where(t != "").groupBy(t.alias("_v"))
            .agg(F.min(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))).alias("_f"), F.count(F.lit(1)).alias("n_inputs"))
            .select(F.col("_f.o").alias(order), F.col("_f.v").alias(value), F.col("n_inputs").cast("bigint").alias("n_inputs")))


def lookup_all_hits(inputs: DataFrame, target: DataFrame, kind: str, cols: Sequence[tuple[str, Column]],
                    row_ord: str, payload: Sequence[str], first_per_column: bool = False,
                    value: str = "input_value", order: str = "input_order") -> DataFrame:
    """SR4-SR7 individually: inputs of one kind against that kind's columns.

    SR6 (class) and SR7 (date) return every hit; SR4 (id) keeps the first row per id column
    (``first_per_column=True``); SR5 (name) keeps the first row. One row per distinct value and
    hit, with ``n_inputs``, the number of inputs that give the value: a value repeated by many inputs
    does not repeat its (possibly large) hit list.
    """
    # the kind is part of the join key rather than a filter on the inputs: a filter on a
    # computed column is pushed below the projection and would classify every row twice
    ins = classify_inputs(distinct_inputs(inputs, value, order), value, order) \
        .select(order, value, "n_inputs", "kind", "key")
    # only what the inputs ask for is reduced and shuffled, not the whole target
    u = unpivot_roles(target, {kind: cols}, row_ord, payload).join(ins.select("kind", "key").distinct(), ["kind", "key"], "left_semi")
    if first_per_column:
        u = (u.groupBy("kind", "key", "col_ord")
             .agg(F.min(F.struct("row_ord", "field", *payload)).alias("_hit"))
             .select("kind", "key", "col_ord", "_hit.*"))
    out = ins.join(u, ["kind", "key"], "inner")
    return out.select(F.col(order).alias("input_order"), F.col(value).alias("input_value"), "n_inputs",
                      F.col("field").alias("match_field"), "col_ord", "row_ord", *payload)


def coverage(inputs: DataFrame, matches: DataFrame, value: str = "input_value",
             order: str = "input_order") -> DataFrame:
    """SR8: inputs (non-blank), found, not found."""
    ins = inputs.where(utrim(value) != "").select(order)
    found = matches.select(F.col("input_order").alias(order)).distinct().withColumn("_f", F.lit(1))
    j = ins.join(found, order, "left")
    return j.agg(F.count(F.lit(1)).cast("bigint").alias("total_inputs"),
                 F.count("_f").cast("bigint").alias("found"),
                 (F.count(F.lit(1)) - F.count("_f")).cast("bigint").alias("not_found"))
