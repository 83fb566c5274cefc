"""Registry of the queries bound to the driver's tables, with their DuckDB oracle SQL.

``register(name, operators, sql)`` records a callable ``(spark, sf_dir) -> DataFrame``,
the survey operator ids it exercises, and (when the semantics are SQL-expressible) the
equivalent SQL over the pre-registered table views.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}
OPERATORS: dict[str, tuple[str, ...]] = {}

PLACES = 6


def register(name: str, operators: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        OPERATORS[name] = tuple(operators.split())
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn
    return deco


def padded(c, width: int):
    """An id as text with leading zeros; a longer one stays whole (a plain ``lpad`` would cut it)."""
    text = c.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


def rounded(df: DataFrame, places: int = PLACES) -> DataFrame:
    """Round every double column (summation order differs between engines)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f"`{f.name}`"), places).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)
