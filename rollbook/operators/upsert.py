"""Appends, upserts, de-duplication and change logs (SO1-SO7, JN8).

Parquet has no MERGE, so an upsert is a pure function ``(current, incoming) -> next``:
union both with a batch number, keep the last row per key with one partitioned window,
and write the result to a *new* path (never overwrite the path being read).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.functions.text import utrim

STATUS_IMPORTED = "imported"
STATUS_EXISTING = "skipped_existing"
STATUS_DUPLICATE = "skipped_duplicate"
STATUS_REJECTED = "rejected"


def _present(c: str) -> Column:
    return F.coalesce(utrim(c) != "", F.lit(False))


# ---------------------------------------------------------------- JN8
def anti_existing(incoming: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """JN8: incoming rows whose key is not in the existing table (left anti join)."""
    return incoming.join(existing.select(key).distinct(), key, "left_anti")


# ---------------------------------------------------------------- SO1 / SO2
def append_checked(existing: DataFrame, incoming: DataFrame, key: str, required: Sequence[str],
                   order: Sequence[str] = ()) -> DataFrame:
    """SO1: append incoming rows that have every required field and a key not present yet. Of rows
    that give a new key several times, the first in ``order`` is appended."""
    from rollbook.operators.ranking import first_by_key

    ok = incoming
    for c in required:
        ok = ok.where(_present(c))
    new = first_by_key(anti_existing(ok, existing, key), [key], [(c, True) for c in order]).select(*incoming.columns)
    return existing.unionByName(new, allowMissingColumns=True)


def widen_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """SO2: union by name; a column missing on one side is NULL there."""
    return a.unionByName(b, allowMissingColumns=True)


# ---------------------------------------------------------------- SO3
def classify_import(existing: DataFrame, batch: DataFrame, key: str, order: str | Sequence[str],
                    required: Sequence[str], skip_duplicates: bool = True) -> DataFrame:
    """SO3: status of every row of an import batch: rejected (a required field missing),
    skipped because the key exists, skipped because an earlier row of the same batch had
    the key (the table grows while importing), else imported. With ``skip_duplicates``
    off there is no key check at all and every complete row is imported.

    "Earlier" is by the columns of ``order`` (NULL last), then by all other columns; of rows that
    are equal throughout, one is imported."""
    order = [order] if isinstance(order, str) else list(order)
    ok = F.lit(True)
    for c in required:
        ok = ok & _present(c)
    flagged = batch.withColumn("_ok", ok)
    known = existing.select(key).distinct().withColumn("_known", F.lit(True))
    ranked = [x for i, c in enumerate(order) for x in (F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"o{i}"))]
    place = F.struct(*ranked, *[F.col(c).alias(f"t{i}") for i, c in enumerate(batch.columns) if c not in order])
    # equal rows are counted, then numbered again: a total order without a window over a hot key
    valid = flagged.where("_ok").groupBy(*flagged.columns).agg(F.count(F.lit(1)).alias("_n")).withColumn("_place", place)
    first = valid.groupBy(key).agg(F.min("_place").alias("_first"))  # partial aggregate: hot keys combine
    valid = valid.join(first, key, "inner").join(known, key, "left").withColumn("_nth", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    status = (F.when(F.lit(not skip_duplicates), F.lit(STATUS_IMPORTED))
              .when(F.col("_known").isNotNull(), F.lit(STATUS_EXISTING))
              .when((F.col("_place") > F.col("_first")) | (F.col("_nth") > 1), F.lit(STATUS_DUPLICATE))
              .otherwise(F.lit(STATUS_IMPORTED)))
    rejected = flagged.where(~F.col("_ok")).drop("_ok").withColumn("status", F.lit(STATUS_REJECTED))
    return valid.withColumn("status", status).select(*batch.columns, "status").unionByName(rejected)


def import_counts(classified: DataFrame) -> DataFrame:
    """SO3 result line: rows per status."""
    return classified.groupBy("status").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


# ---------------------------------------------------------------- SO4
def upsert(current: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """SO4: keyed upsert, last row wins (incoming after current; within a batch, the larger
    ``order``, NULL being least). One aggregate on the key with map-side combine, so a key repeated
    across a third of the rows is collapsed before the shuffle."""
    from rollbook.operators.ranking import first_by_key

    tagged = (current.withColumn("_batch", F.lit(0)).unionByName(incoming.withColumn("_batch", F.lit(1)),
                                                                 allowMissingColumns=True))
    cols = [c for c in tagged.columns if c != "_batch"]
    out = first_by_key(tagged, [key], [("_batch", False), (order, False)])
    return out.select(*cols)


def upsert_buckets(table, incoming: DataFrame, order: str) -> int:
    """SO4 on a written table (``rollbook.sources.buckets.BucketTable``): only the buckets that the batch's keys fall into are read
    and written, as the next version, whose number is returned."""
    touched = table.touched(incoming)
    current = table.read(touched)
    merged = upsert(current if current is not None else incoming.limit(0), incoming, table.key, order)
    version = table.next_version()
    table.write(merged, version)
    return version


# ---------------------------------------------------------------- SO6
def dedupe_by_key(df: DataFrame, id_col: str, name_col: str, order: Sequence[str]) -> DataFrame:
    """SO6: one row per ``mssv_<id>`` or else ``name_<name>``; rows with neither are dropped;
    the first row in ``order`` (ascending) wins; aggregated map-side."""
    idt, nm = utrim(id_col), utrim(name_col)
    k = F.coalesce(F.when(idt != "", F.concat(F.lit("mssv_"), idt)),
                   F.when(nm != "", F.concat(F.lit("name_"), nm)))
    from rollbook.operators.ranking import first_by_key

    keyed = df.withColumn("_dedupe_key", k).where(F.col("_dedupe_key").isNotNull())
    out = first_by_key(keyed, ["_dedupe_key"], [(c, True) for c in order])
    return out.select(*df.columns, "_dedupe_key")


# ---------------------------------------------------------------- SO7
def change_log(df: DataFrame, key: str, ts: str, value: str, tiebreak: Sequence[str] = (),
               segments: int | None = None, lead: Sequence[str] = ()) -> DataFrame:
    """SO7: one log row per update of ``value``: key, ``UPDATE``, old value, new value, time.

    Every update is logged, also one to the same value. The previous value is a ``lag``
    over time per key, computed so that no key lands in one task however hot it is: the
    rows are range-partitioned on (key, time) into ``segments`` ranges (Spark samples the
    bounds, so a key holding a third of all rows is cut into many ranges), ``lag`` runs
    inside each (key, range) segment, and the first row of a segment takes the last value
    of the key's previous segment from a small per-segment aggregate. Exact for any skew.

    The bounds are sampled anew whenever a range exchange runs, so the segment numbers are fixed
    once by a reliable checkpoint, and both branches read those. ``lead`` orders before ``ts``.
    """
    from rollbook.session import cut_lineage

    spark = df.sparkSession
    n = segments or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order_cols = [*lead, ts, *tiebreak]
    d = cut_lineage(df.repartitionByRange(n, key, *order_cols).withColumn("_seg", F.spark_partition_id()))
    w = Window.partitionBy(key, "_seg").orderBy(*[F.asc(c) for c in order_cols])
    rows = (d.withColumn("_prev", F.lag(value).over(w))
            .withColumn("_first", F.row_number().over(w) == 1))
    last_key = F.struct(*[F.col(c) for c in order_cols])
    ws = Window.partitionBy(key).orderBy("_seg")
    seg = (d.groupBy(key, "_seg").agg(F.max_by(F.col(value), last_key).alias("_last"))
           .withColumn("_seg_prev", F.lag("_last").over(ws))
           .withColumn("_earlier", F.lag(F.lit(1)).over(ws).isNotNull())
           .select(key, "_seg", "_seg_prev", "_earlier"))
    j = rows.join(seg, [key, "_seg"], "left")
    old = F.when(F.col("_first"), F.col("_seg_prev")).otherwise(F.col("_prev"))
    return j.where(~F.col("_first") | F.col("_earlier")).select(
        F.col(key), F.lit("UPDATE").alias("change_type"), old.alias("old_value"),
        F.col(value).alias("new_value"), F.col(ts).alias("change_date"), *tiebreak)


def snapshot_changes(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """SO7 between two snapshots of a keyed table: a row for every key inserted, updated or deleted, with the old and new ``value``.

    Rows are compared by a digest of all columns (the same in both, in any order), so a key whose row was rewritten unchanged leaves no row. What
    travels is key, digest and value; keys are expected to be unique in each snapshot, and of repeated ones the row that sorts first by digest counts.
    """
    from rollbook.operators.ranking import first_by_key

    columns = sorted(c for c in before.columns if c != key)
    if columns != sorted(c for c in after.columns if c != key):
        raise ValueError("snapshots differ in their columns")

    def side(df: DataFrame, name: str) -> DataFrame:
        row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"}), 256)
        rows = first_by_key(df.select(F.col(f"`{key}`").alias("k"), row.alias("d"), F.col(f"`{value}`").alias("v")), ["k"], [("d", True)])
        return rows.select(F.col("k").alias(f"k_{name}"), F.col("d").alias(f"d_{name}"), F.col("v").alias(f"v_{name}"))

    both = side(before, "old").join(side(after, "new"), F.col("k_old").eqNullSafe(F.col("k_new")), "full_outer")
    kind = F.when(F.col("d_old").isNull(), "INSERT").when(F.col("d_new").isNull(), "DELETE").otherwise("UPDATE")
    return both.where(~F.col("d_old").eqNullSafe(F.col("d_new"))).select(
        F.coalesce("k_old", "k_new").alias(key), kind.alias("change_type"), F.col("v_old").alias("old_value"), F.col("v_new").alias("new_value"))
