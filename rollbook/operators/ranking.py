"""Filters, ranking, sorting and paging (PF2-PF8, TK1-TK10, CS3, VW5).

Row order ("first row wins", "original order") always comes from an explicit order column
(a business key, or the ingest ordinal) so results are deterministic on any cluster.
Top-k and pages are ``orderBy(...).limit`` / ``offset``, which Spark plans as
``TakeOrderedAndProject``: a per-partition top-k and a small final merge, no full sort.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.functions import labels as L
from rollbook.functions.text import as_col, as_number, numeric_or_null, utrim

# Medal tiers for ranks 1, 2, 3.
MEDALS = ("gold", "silver", "bronze")
PAGE_SIZE = 20
SEARCH_CAP = 100
TOP_K = 10


# ---------------------------------------------------------------- PF2 / PF3 / TK8
def text_search(df: DataFrame, query: str, columns: Sequence[str] | None = None,
                order: Sequence[str] = (), cap: int | None = None, regex: bool = False) -> DataFrame:
    """PF2/PF3: case-insensitive containment over the given (default: all string) columns;
    all of them, or the first ``cap`` rows in ``order``, which a cap needs. ``regex=True`` treats the
    query as a pattern."""
    if cap is not None and not order:
        raise ValueError("a cap needs an order: which rows are the first?")
    cols = list(columns) if columns else [f.name for f in df.schema.fields
                                          if f.dataType.simpleString() == "string"]
    q = query.strip().lower()
    cond = F.lit(False)
    for c in cols:
        v = F.lower(F.col(c).cast("string"))
        cond = cond | F.coalesce(v.rlike("(?iu)" + query) if regex else v.contains(q), F.lit(False))
    out = df.where(cond)
    if order:
        out = out.orderBy(*order)
    return out.limit(cap) if cap is not None else out


def keyword_search(df: DataFrame, query: str, keyword_columns: Sequence[str],
                   order: Sequence[str] = (), cap: int | None = None) -> DataFrame:
    """PF3: search the role columns; fall back to all text columns when there are none."""
    return text_search(df, query, keyword_columns or None, order, cap)


# ---------------------------------------------------------------- PF4 / PF5 / PF6 / PF8
def class_equals(df: DataFrame, klass: str, value: str, trimmed: bool = True) -> DataFrame:
    """PF4: class equality (trimmed on both sides by default)."""
    c = utrim(klass) if trimmed else F.col(klass)
    return df.where(c == (value.strip() if trimmed else value))


def min_score(df: DataFrame, score: str, threshold: float) -> DataFrame:
    """PF5: score (coerced) at least ``threshold``."""
    return df.where(as_number(df, score) >= threshold)


def low_credit(df: DataFrame, credits: str, year: str, max_credits: float = 50,
               min_year: int = 3, order: Sequence[str] = ()) -> DataFrame:
    """PF6: fewer than ``max_credits`` credits in year ``min_year`` or later, fewest first."""
    return df.where((F.col(credits) < max_credits) & (F.col(year) >= min_year)).orderBy(
        F.asc(credits), *order)


def point_lookup(df: DataFrame, key: str, value) -> DataFrame:
    """PF8: one record by its ordinal / key (a pushed-down equality on the scan)."""
    return df.where(F.col(key) == F.lit(value))


# ---------------------------------------------------------------- TK1 / TK2 / TK3 / TK6
def top_k(df: DataFrame, score: str, order_key: Sequence[str], k: int = TOP_K,
          descending: bool = True, where: Column | None = None, medals: bool = True) -> DataFrame:
    """TK1/TK2/TK3 + TK6: k best (or worst) by score, first row on ties, rank 1..k and medal.

    Usable scores only. The rank is numbered on the k rows that survive the top-k, so the
    window runs on k rows, never on the table.
    """
    s = as_number(df, score)
    d = df.withColumn("_score", s).where(F.col("_score").isNotNull())
    if where is not None:
        d = d.where(where)
    primary = F.desc("_score") if descending else F.asc("_score")
    keys = [primary] + [F.asc(c) for c in order_key]
    top = d.orderBy(*keys).limit(k)
    w = Window.orderBy(*keys)
    out = top.withColumn("rank", F.row_number().over(w))
    if medals:
        out = out.withColumn("medal", F.when(F.col("rank") == 1, MEDALS[0])
                             .when(F.col("rank") == 2, MEDALS[1]).when(F.col("rank") == 3, MEDALS[2]))
    return out.withColumnRenamed("_score", "score")


def bottom_k(df: DataFrame, score: str, order_key: Sequence[str], k: int = TOP_K,
             below: float = L.PASS_MARK) -> DataFrame:
    """TK2: the k lowest scores among those under the pass mark."""
    return top_k(df, score, order_key, k, descending=False,
                 where=F.col("_score") < below, medals=False)


# ---------------------------------------------------------------- TK4 / TK10
SORT_CHOICES = ("name", "id", "class", "score")


def sort_listing(df: DataFrame, sort_by: str, roles: dict[str, str], tiebreak: Sequence[str]) -> DataFrame:
    """TK4: sort by name / id / class ascending or by score descending, nulls last, then a
    unique tie-break. Spark's ascending default is nulls first, so the null order is explicit."""
    col = roles[sort_by]
    if sort_by == "score":
        key = as_number(df, col).desc_nulls_last()
    else:
        key = F.col(col).asc_nulls_last()
    return df.orderBy(key, *[F.asc(c) for c in tiebreak])


# ---------------------------------------------------------------- TK5 / VW5
def page(df: DataFrame, order: Sequence[Column], page_no: int, size: int = PAGE_SIZE) -> DataFrame:
    """TK5: page ``page_no`` (1-based) of ``size`` rows under a total order."""
    start = max(page_no - 1, 0) * size
    return df.orderBy(*order).offset(start).limit(size)


def page_after(df: DataFrame, order_cols: Sequence[str], last_key: Sequence, size: int = PAGE_SIZE) -> DataFrame:
    """TK5, deep pages: key-seek (rows strictly after the last key of the previous page),
    so page n costs one top-k and not an offset over n*size rows."""
    cond = None
    for i in range(len(order_cols) - 1, -1, -1):
        gt = F.col(order_cols[i]) > F.lit(last_key[i])
        eq_prefix = F.lit(True)
        for j in range(i):
            eq_prefix = eq_prefix & (F.col(order_cols[j]) == F.lit(last_key[j]))
        term = eq_prefix & gt
        cond = term if cond is None else (cond | term)
    return df.where(cond).orderBy(*order_cols).limit(size)


def page_info(filtered: DataFrame, total: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    """TK5: filtered count, total count and page count ``ceil(n/size)``, one row."""
    n = filtered.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    return total.agg(F.count(F.lit(1)).cast("bigint").alias("total_count")).select(
        n.cast("bigint").alias("filtered_count"), "total_count",
        F.ceil(n / F.lit(float(size))).cast("bigint").alias("page_count"))


def pages_for(n: int, size: int = PAGE_SIZE) -> int:
    return math.ceil(n / size) if n else 0


# ---------------------------------------------------------------- TK7
def first_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]]) -> DataFrame:
    """TK7 as an aggregate: per key, the row that is first under ``order`` (a list of
    ``(column, ascending)`` of any orderable type; NULLs come last either way). Ties on all of them
    fall to the remaining columns, so the result does not depend on the order of arrival.

    ``min_by``/``max_by`` over the whole row combine map-side (partial aggregation), so a key that
    holds a third of the table is reduced in every partition before the shuffle instead of
    being sorted in one task as a window would.
    """
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(f"`{c}`") for c in rest])
    orderable = [f.name for f in df.schema.fields if f.name in rest and f.dataType.typeName() not in ("map", "variant")]
    ties = [c for c in orderable if c not in [o for o, _ in order]]
    if order and not any(asc for _, asc in order):  # all descending: the greatest, a NULL being least
        keep = F.max_by(row, F.struct(*[x for i, (c, _) in enumerate(order) for x in (F.col(f"`{c}`").isNotNull().alias(f"n{i}"), F.col(f"`{c}`").alias(f"o{i}"))],
                                      *[F.col(f"`{c}`").alias(f"t{i}") for i, c in enumerate(ties)]))
    else:
        keep = F.min_by(row, F.struct(*[x for i, (c, asc) in enumerate(order) for x in (
            F.col(f"`{c}`").isNull().alias(f"n{i}"), (F.col(f"`{c}`") if asc else _reversed(df, c)).alias(f"o{i}"))],
            *[F.col(f"`{c}`").alias(f"t{i}") for i, c in enumerate(ties)]))
    return df.groupBy(*keys).agg(keep.alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def _reversed(df: DataFrame, name: str) -> Column:
    """A value whose ascending order is the column's descending order."""
    c, kind = F.col(f"`{name}`"), df.schema[name].dataType.typeName()
    if kind in ("byte", "short", "integer", "long"):
        return F.bitwise_not(c)  # never overflows
    if kind in ("float", "double", "decimal"):
        return -c
    if kind == "boolean":
        return ~c
    if kind == "date":
        return -F.unix_date(c)
    if kind == "timestamp":
        return F.bitwise_not(F.unix_micros(c))
    if kind == "timestamp_ntz":  # a fixed zone maps it one to one
        return F.bitwise_not(F.unix_micros(F.to_utc_timestamp(c, "UTC")))
    raise ValueError(f"{name} ({kind}) can't be descending beside an ascending column; order by all columns in one direction")


# ---------------------------------------------------------------- TK9
def mixed_sort_keys(value, descending: bool = False, collation: str | None = None) -> list[Column]:
    """TK9: numbers first (numerically), then text; a total order unlike the UI comparator. Text goes by code points, or by a ``collation``
    such as ``vi`` (Vietnamese letters in their own order) and then by code points."""
    v = as_col(value)
    num, text = numeric_or_null(v), v.cast("string")
    keys = [text] if collation is None else [F.collate(text, collation), text]
    if descending:
        return [num.isNull().asc(), num.desc(), *[k.desc() for k in keys]]
    return [num.isNull().asc(), num.asc(), *[k.asc() for k in keys]]


# ---------------------------------------------------------------- CS3
def listing_projection(df: DataFrame, preferences: Sequence[tuple[Sequence[str], str]],
                       last_wins: bool = True) -> DataFrame:
    """CS3: for each output label pick the first available source column of its candidate
    list (or the last occurrence when a name repeats) and rename it to the display label."""
    names = df.columns
    positional = df.toDF(*[f"_c{i}" for i in range(len(names))])  # repeated headers: go by position
    out = []
    for candidates, label in preferences:
        chosen = None
        for cand in candidates:
            hits = [i for i, n in enumerate(names) if n == cand]
            if hits:
                chosen = hits[-1] if last_wins else hits[0]
                break
        if chosen is not None:
            out.append(F.col(f"_c{chosen}").alias(label))
    return positional.select(*out)
