"""Structured Streaming forms of the batch operators (ST1-ST3).

* ST1 ``kpi_stream``: continuously refreshed per-class metrics (complete mode). Only
  aggregates with bounded state are used (count, sums, min, max); ``sketch_stream`` adds distinct counts and
  quantiles by mergeable sketches.
* ST2 ``ingest_stream``: drop-folder ingest; normalise, de-duplicate each micro-batch,
  skip known keys and append through ``foreachBatch``. Each micro-batch writes its own
  ``batch=<id>`` partition in overwrite mode, so a replayed batch (after a failure)
  rewrites the same files instead of appending twice.
* ST3 ``change_log_stream``: previous and new value per key from an update feed: every
  micro-batch is logged by the batch operator, with a keyed table of last values ahead of
  it, of which only the buckets of its keys are read and written. With a ``delay``, rows wait until
  the newest time seen is that far ahead, so rows that come late, in later micro-batches, are logged in order of time.

All checkpoints and outputs live under the session's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.session import scratch_path
from rollbook.sources.buckets import BUCKETS, BucketTable, committed


def file_stream(spark: SparkSession, folder: str, name: str, schema: T.StructType,
                max_files_per_trigger: int | None = None, fmt: str = "parquet") -> DataFrame:
    """A file stream over ``folder``, restricted to files matching ``name`` (a glob).

    ``fmt="csv"`` reads a drop folder of uploads: header line, explicit schema (bound by
    position), PERMISSIVE mode, UTF-8."""
    r = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "csv":
        return (r.option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE")
                .option("encoding", "UTF-8").csv(folder))
    return r.format(fmt).load(folder)


def drain(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


# ---------------------------------------------------------------- ST1
def kpi_aggregate(df: DataFrame, klass: str, score: str, pass_mark: float) -> DataFrame:
    """The stream-safe part of the KPI/class metrics (also used as the batch twin)."""
    s = F.col(score).cast("double")
    return df.groupBy(klass).agg(
        F.count(F.lit(1)).alias("n"), F.avg(s).alias("mean"), F.stddev_samp(s).alias("std_dev"),
        F.min(s).alias("min"), F.max(s).alias("max"),
        F.avg(F.when(s >= pass_mark, 100.0).otherwise(0.0)).alias("pass_rate"))


def kpi_stream(spark: SparkSession, source: DataFrame, klass: str, score: str, pass_mark: float,
               out_path: str | None = None, checkpoint: str | None = None, available_now: bool = True,
               refresh_seconds: int = 30):
    """ST1: run the metrics over a stream; each trigger adds the snapshot ``batch=<id>`` at
    ``out_path``, and :func:`latest_snapshot` reads the newest complete one, so a reader never sees
    half a snapshot. Running continuously it refreshes every ``refresh_seconds`` (the dashboard's 30 s poll)."""
    out_path = out_path or scratch_path(spark, "st1-out")
    checkpoint = checkpoint or scratch_path(spark, "st1-ckpt")
    agg = kpi_aggregate(source, klass, score, pass_mark)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id:012d}")

    w = agg.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(write)
    q = (w.trigger(availableNow=True).start() if available_now
         else w.trigger(processingTime=f"{refresh_seconds} seconds").start())
    if available_now:
        drain(q)
    return q, out_path


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The newest committed snapshot under ``path`` (one with ``_SUCCESS``); its files alone are read."""
    return spark.read.parquet(f"{path}/batch={max(committed(spark, path, 'batch')):012d}")


#: Precision of the sketches: relative standard error of distinct counts about 1.04 / 2 ** (LG_K / 2); ranks of quantiles off by about 2.3 / QUANTILE_K ** 0.9.
LG_K, QUANTILE_K = 12, 2000


def sketches(df: DataFrame, klass: str, value: str, distinct: str) -> DataFrame:
    """Per class a mergeable row of fixed size: count, sum, sketch of distinct values, sketch of quantiles."""
    v = F.col(value).cast("double")
    return df.groupBy(klass).agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("total"), F.count(v).alias("n_values"),
                                 F.hll_sketch_agg(F.col(distinct), F.lit(LG_K)).alias("distinct_sketch"), F.kll_sketch_agg_double(v, QUANTILE_K).alias("quantile_sketch"))


def merge_sketches(rows: DataFrame, klass: str | None = None) -> DataFrame:
    """Sketch rows of several batches or classes as one for each class, or one for all."""
    return rows.groupBy(*([klass] if klass else [])).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("n_values").alias("n_values"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"))


def sketch_stream(spark: SparkSession, source: DataFrame, klass: str, value: str, distinct: str, out_path: str | None = None,
                  checkpoint: str | None = None, available_now: bool = True):
    """ST1, AG2, AG6 on a stream: every micro-batch's sketches are merged with those of the version before and written as
    ``batch=<id>``; a replayed batch reads the same predecessor and writes the same version."""
    out_path = out_path or scratch_path(spark, "st1-sketches")
    checkpoint = checkpoint or scratch_path(spark, "st1-sketches-ckpt")

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = sketches(batch, klass, value, distinct)
        earlier = [n for n in committed(spark, out_path, "batch") if n < batch_id]
        if earlier:
            rows = merge_sketches(rows.unionByName(spark.read.parquet(f"{out_path}/batch={earlier[-1]:012d}")), klass)
        rows.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id:012d}")

    q = source.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    q = q.trigger(availableNow=True).start() if available_now else q.start()
    if available_now:
        drain(q)
    return q, out_path


def read_sketches(rows: DataFrame, shares: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Estimates from sketch rows: count, mean, distinct values and quantiles (an array)."""
    keys = [c for c in rows.columns if c not in ("n", "total", "n_values", "distinct_sketch", "quantile_sketch")]
    quantiles = F.array(*[F.when(F.col("n_values") > 0, F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(float(s)))) for s in shares])
    return rows.select(*keys, "n", (F.col("total") / F.col("n_values")).alias("mean"), F.hll_sketch_estimate("distinct_sketch").alias("n_distinct"), quantiles.alias("quantiles"))


# ---------------------------------------------------------------- ST2


def ingest_stream(spark: SparkSession, source: DataFrame, key: str, base: DataFrame,
                  required: Sequence[str] = (), order: str | None = None, out_root: str | None = None,
                  checkpoint: str | None = None, available_now: bool = True, buckets: int = BUCKETS):
    """ST2: append new rows (required fields present, key not known yet) to a table.

    ``base`` is written once as ``batch=base``. There is no streaming de-duplication state
    (it would keep every key ever seen): each micro-batch is de-duplicated on its own (first
    row by ``order``), its keys are looked up in the table written so far, and the new rows
    are written as ``batch=<id>`` in overwrite mode, so a replayed batch is idempotent. The table
    is partitioned by a hash of the key as well, so a batch reads the ``bucket``s of its own keys only;
    ``buckets`` should be well above the keys of a batch where batches are small against the table.
    """
    from rollbook.functions.text import utrim
    from rollbook.operators.ranking import first_by_key

    out_root = out_root or scratch_path(spark, "st2-table")
    checkpoint = checkpoint or scratch_path(spark, "st2-ckpt")
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    base.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{out_root}/batch=base")
    cleaned = source
    for c in required:
        cleaned = cleaned.where(F.coalesce(utrim(c) != "", F.lit(False)))

    def write(batch: DataFrame, batch_id: int) -> None:
        tag = f"b{batch_id:012d}"
        batch = (first_by_key(batch, [key], [(order, True)]) if order else batch.dropDuplicates([key]))
        batch = batch.withColumn("bucket", bucket).persist()
        mine = [r[0] for r in batch.select("bucket").distinct().collect()]  # numbers below ``buckets``
        table = spark.read.option("basePath", out_root).parquet(out_root)
        known = table.where((F.col("batch") != tag) & F.col("bucket").isin(mine)).select(key, "bucket")
        new = batch.join(known, [key, "bucket"], "left_anti")
        new.write.mode("overwrite").partitionBy("bucket").parquet(f"{out_root}/batch={tag}")
        batch.unpersist()

    w = cleaned.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    q = w.trigger(availableNow=True).start() if available_now else w.start()
    if available_now:
        drain(q)
    return q, out_root


# ---------------------------------------------------------------- ST3
def change_log_stream(spark: SparkSession, source: DataFrame, key: str, ts: str, value: str,
                      tiebreak: Sequence[str] = (), out_path: str | None = None,
                      checkpoint: str | None = None, available_now: bool = True, delay: timedelta | None = None, buckets: int = BUCKETS):
    """ST3: stream of ``(key, UPDATE, old_value, new_value, change_date)`` rows, under ``<out_path>/log``.

    Each micro-batch is logged like SO7, with the last values of its keys ahead of its rows, so a key that fills the whole batch is spread
    over many tasks. Last values are a ``BucketTable``: a batch reads and writes the buckets of its own keys.

    With ``delay``, a row is logged once the newest time seen is ``delay`` past it; until then it waits in ``<out_path>/waiting``. So rows that
    arrive up to ``delay`` late get their right place. Rows later than that are not logged but kept, in ``<out_path>/late``. A drained
    stream (``available_now``) logs what still waits at its end. Without ``delay``, arrival orders the batches.
    All tables are written in versions by batch: a replayed batch reads the same predecessors and writes the same rows.
    """
    from rollbook.operators.upsert import change_log

    out_path = out_path or scratch_path(spark, "st3-out")
    checkpoint = checkpoint or scratch_path(spark, "st3-ckpt")
    order = [ts, *tiebreak]
    rows = source.select(key, ts, F.col(value).cast("double").alias(value), *tiebreak)
    last = BucketTable(spark, f"{out_path}/last", key, buckets)

    def log(ready: DataFrame, version: int) -> None:
        ready = ready.persist()
        touched = last.touched(ready)
        both = ready.withColumn("_new", F.lit(1))
        before = last.read(touched, before=version)
        if before is not None:
            both = both.unionByName(before.withColumn("_new", F.lit(0)))
        both = both.persist()
        change_log(both, key, ts, value, tiebreak, lead=["_new"]).write.mode("overwrite").parquet(f"{out_path}/log/batch={version:012d}")
        now = both.groupBy(key).agg(F.max_by(F.struct(value, *order), F.struct("_new", *order)).alias("_l"))
        last.write(now.select(key, "_l.*"), version)
        last.expire(version - 1)  # a replay of this version still finds its predecessors
        both.unpersist()
        ready.unpersist()

    def state(version: int) -> tuple[DataFrame | None, object]:
        """What waits before a version, and the time up to which rows were logged."""
        earlier = [n for n in committed(spark, f"{out_path}/waiting", "batch") if n < version]
        if not earlier:
            return None, None
        mark = spark.read.parquet(f"{out_path}/mark/batch={earlier[-1]:012d}").first()
        return spark.read.parquet(f"{out_path}/waiting/batch={earlier[-1]:012d}"), mark["newest"]

    def remember(waiting: DataFrame, newest: object, version: int) -> None:
        kind = T.StructType([T.StructField("newest", source.schema[ts].dataType)])
        spark.createDataFrame([(newest,)], kind).write.mode("overwrite").parquet(f"{out_path}/mark/batch={version:012d}")
        waiting.write.mode("overwrite").parquet(f"{out_path}/waiting/batch={version:012d}")

    def write(batch: DataFrame, batch_id: int) -> None:
        version = 2 * batch_id  # odd ones are for what is logged at a stream's end
        if delay is None:
            log(batch, version)
            return
        waiting, newest = state(version)
        late = F.lit(False) if newest is None else F.col(ts) <= F.lit(newest - delay).cast(batch.schema[ts].dataType)
        batch = batch.persist()
        top = batch.agg(F.max(ts)).first()[0]
        top = max((t for t in (top, newest) if t is not None), default=None)
        batch.where(late).write.mode("overwrite").parquet(f"{out_path}/late/batch={version:012d}")
        held = batch.where(~F.coalesce(late, F.lit(False)))
        held = (held if waiting is None else held.unionByName(waiting)).persist()
        due = F.col(ts) <= F.lit(top - delay).cast(batch.schema[ts].dataType) if top is not None else F.lit(True)
        due = F.coalesce(due, F.lit(True))  # rows without a time wait for nothing
        log(held.where(due), version)
        remember(held.where(~due), top, version)
        held.unpersist()
        batch.unpersist()

    w = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    q = w.trigger(availableNow=True).start() if available_now else w.start()
    if available_now:
        drain(q)
        done = committed(spark, f"{out_path}/waiting", "batch")
        if delay is not None and done and done[-1] % 2 == 0:
            waiting, newest = state(done[-1] + 1)
            log(waiting, done[-1] + 1)
            remember(waiting.limit(0), None if newest is None else newest + delay, done[-1] + 1)
    return q, f"{out_path}/log"
