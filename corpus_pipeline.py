"""A training corpus from ``documents``: five stages, each one operator over all its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet to the shared
folder and read again as the next stage's input; a lost executor costs the tasks it was running.
All but the last keep the columns of ``documents``.

Defined results: rows with NULL or letterless text are rejected by the first stage; rows without
doc_id are never near-duplicates; an empty table gives an empty corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.llm.bpe import bpe_round_trip
from rollbook.llm.common import documents, stored
from rollbook.llm.decontam import decontaminate
from rollbook.llm.langid import keep_identified
from rollbook.llm.neardup import drop_near_duplicates
from rollbook.llm.secrets import redact_secrets
from rollbook.session import read_table

#: A text whose best language has less than this share of the probability, over the learned languages and planted noise, is rejected.
MIN_LANGUAGE_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; learned from their own labelled rows and planted noise. A NULL lang becomes the predicted one."""
    return keep_identified(docs, MIN_LANGUAGE_SCORE)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8."""
    return drop_near_duplicates(docs, threshold=80, width=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word window of a benchmark item."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"), remove="documents")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; n_chars follows the text."""
    masked = redact_secrets(docs)
    return masked.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType))) if "n_chars" in docs.columns else masked


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the decoded text, and the ids themselves."""
    return bpe_round_trip(docs, keep_ids=True)


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicate),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("bpe_encoding", encoding),
]

#: The network and the merges are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
