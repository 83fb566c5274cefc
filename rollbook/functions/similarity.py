"""SF13 / UD1: the longest-matching-blocks similarity ratio, and the grams and bounds that block the fuzzy join.

The ratio is ``2*M / (len(a) + len(b))`` where ``M`` is the size of the matching blocks
found by ``difflib.SequenceMatcher(None, a, b)``. It is not symmetric. It is the only
Python UDF in the library and it runs Arrow-batched, after blocking, on distinct pairs.
"""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.functions.text import as_col


def ratio_py(a: str | None, b: str | None) -> float | None:
    if a is None or b is None:
        return None
    return SequenceMatcher(None, a, b).ratio()


def _make_ratio_udf():
    """The Arrow-batched UDF, built from a closure so it is shipped to the Python workers by
    value (it needs only the standard library and pandas there, not this package)."""

    def ratio_batch(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher as _SM

        import pandas as _pd

        return _pd.Series([None if x is None or y is None else _SM(None, x, y).ratio() for x, y in zip(a, b)],
                          dtype="float64")

    return F.pandas_udf(ratio_batch, T.DoubleType())


_RATIO_UDF = None


def similarity_ratio(a, b) -> Column:
    """SF13 over two string columns (null if either is null)."""
    global _RATIO_UDF
    if _RATIO_UDF is None:
        _RATIO_UDF = _make_ratio_udf()
    return _RATIO_UDF(as_col(a), as_col(b))


def length_band(len_a, len_b, threshold: float) -> Column:
    """Lossless: ratio >= t needs len(a)*t/(2-t) <= len(b) <= len(a)*(2-t)/t."""
    la, lb = as_col(len_a).cast("double"), as_col(len_b).cast("double")
    t = float(threshold)
    return (lb >= la * (t / (2 - t)) - 1e-9) & (lb <= la * ((2 - t) / t) + 1e-9)


def shared_bound(q: int, threshold: float) -> tuple[float, float]:
    """(slope, intercept): two strings of total length T whose ratio is at least t share at least
    ``slope * T + intercept`` grams of q characters (as multisets, in matching blocks).

    M >= t*T/2 matched characters lie in B matching blocks; two neighbouring blocks are
    separated by at least one unmatched character, so B <= (T - 2M) + 1, and a block of
    length k holds at least k - q + 1 grams that the other string holds too. Hence the shared count is
    at least M - (q - 1) * B >= (t/2 - (q - 1) * (1 - t)) * T - (q - 1).
    """
    return threshold / 2 - (q - 1) * (1 - threshold), -(q - 1.0)


def min_shared(q: int, total_len: float, threshold: float) -> int:
    """The least number of shared grams (``shared_bound``), 0 where the bound says nothing."""
    slope, base = shared_bound(q, threshold)
    return max(0, math.ceil(slope * total_len + base - 1e-9))


def grams(s, q: int) -> Column:
    """The grams of q characters, in order."""
    c = as_col(s)
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (q - 1), F.lit(1))), lambda i: F.substring(c, i, q))
    return F.filter(every, lambda g: F.length(g) == q)


def tagged(of) -> Column:
    """The grams ``of`` (a column or lambda variable that holds an array, as every one is compared with every other) as
    ``array<struct<token, pos>>``. A token is a gram and its occurrence number (``ab#1``, ``ab#2``), so that the set overlap of two token arrays
    is the multiset overlap of their grams. ``pos`` is the gram's place, or NULL if the string holds the gram more than once: then
    a tag says nothing about places."""
    c = as_col(of)
    same = lambda part, g: F.size(part) - F.size(F.array_remove(part, g))
    entry = lambda g, nth, pos: F.struct(F.concat(g, F.lit("#"), nth.cast("string")).alias("token"), pos.alias("pos"))
    plain = F.transform(c, lambda g, i: entry(g, F.lit(1), i))
    return F.when(F.size(F.array_distinct(c)) == F.size(c), plain).otherwise(
        F.transform(c, lambda g, i: entry(g, same(F.slice(c, 1, i + 1), g), F.when(same(c, g) == 1, i))))
