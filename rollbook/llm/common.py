"""Shared plumbing of the training-data operators: shipping the package to Python workers,
scratch tables in the shared checkpoint folder, and reading ``documents``."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.session import read_table, scratch_path

PACKAGE_DIR = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers (once per context).

    The sources travel with ``addPyFile``, so no executor needs a checkout of its own; the archive is only
    read by the driver, which serves it to them.
    """
    sc = spark.sparkContext
    if getattr(sc, "_rollbook_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="rollbook-src-"), "rollbook-src.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(PACKAGE_DIR):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("rollbook", os.path.relpath(full, PACKAGE_DIR)))
    sc.addPyFile(target)
    sc._rollbook_shipped = True


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to a fresh table in the shared folder and read it back: cuts the lineage,
    and a lost executor costs only the tasks it was running. Such tables stay until the folder is cleared."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def keyed_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just (doc_id, text): whatever else the input carries can't clash with later columns."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
