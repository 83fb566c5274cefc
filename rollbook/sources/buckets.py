"""Keyed tables in versions: each version holds the buckets that it changed, a reader takes every bucket's newest one.

Layout: ``<path>/version=<n>/bucket=<b>/*.parquet``. A version counts when Spark's job commit has left its
``_SUCCESS`` file, so a reader sees none or all of a write, and a write that is repeated (a replayed batch) replaces
its own version only. Buckets are a hash of the key; what is read and written follows the buckets a batch touches, not the table.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def listing(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob, by the file system that Spark reads them with."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [s.getPath().toString() for s in found or []]


def committed(spark: SparkSession, path: str, name: str = "version") -> list[int]:
    """Numbers of the committed ``<name>=<n>`` folders under ``path``, ascending."""
    return sorted(int(re.search(rf"{name}=(\d+)/_SUCCESS$", p)[1]) for p in listing(spark, f"{path}/{name}=*/_SUCCESS"))


class BucketTable:
    """A table of rows with a key, under ``path``. The number of buckets is fixed when the table is made."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets that rows fall into; numbers below ``buckets``."""
        return sorted(r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect())

    def newest(self, before: int | None = None) -> dict[int, str]:
        """Each bucket's folder in its newest committed version, below ``before`` if given."""
        valid = {n for n in committed(self.spark, self.path) if before is None or n < before}
        best: dict[int, tuple[int, str]] = {}
        for p in listing(self.spark, f"{self.path}/version=*/bucket=*"):
            n, b = map(int, re.search(r"version=(\d+)/bucket=(\d+)$", p).groups())
            if n in valid and best.get(b, (-1, ""))[0] < n:
                best[b] = (n, p)
        return {b: p for b, (_, p) in best.items()}

    def read(self, buckets: Sequence[int] | None = None, before: int | None = None) -> DataFrame | None:
        """Rows of the given buckets (all by default); None where there are none."""
        newest = self.newest(before)
        paths = [p for b, p in newest.items() if buckets is None or b in set(buckets)]
        if not paths:
            return None
        return self.spark.read.option("basePath", self.path).parquet(*paths).drop("version", "bucket")

    def write(self, rows: DataFrame, version: int) -> None:
        """Make ``rows`` the whole content of the buckets they fall into."""
        rows.withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/version={version:012d}")

    def next_version(self) -> int:
        return max(committed(self.spark, self.path), default=-1) + 1

    def expire(self, keep_from: int) -> None:
        """Delete bucket folders of versions below ``keep_from`` that a newer version below it, or it, has replaced."""
        newest = set(self.newest(keep_from + 1).values())
        for p in listing(self.spark, f"{self.path}/version=*/bucket=*"):
            if int(re.search(r"version=(\d+)/", p)[1]) < keep_from and p not in newest:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(p)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
