"""Benchmark decontamination, in DataFrame expressions only.

The benchmark's normalised n-grams make a hash set that is broadcast (its size is counted
first; beyond ``BROADCAST_WINDOWS`` it is joined by a shuffle instead). One scan of the
documents hashes every window of words and probes the set. Only documents with a probable
hit are read again, to compare the window's words themselves.

Defined results: NULL and empty texts have no words and no hits; an item with fewer words
than the window, but not none, is one window; items without words and NULL item ids add no
id; rows that repeat a (doc_id, text) give a row each; other columns of either table
may have any name. Without items every document is clean.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rollbook.llm.common import keyed_text, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A word: digits, a to z, and whatever is not ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A window takes under 200 bytes in the hash relation: 100 MB at most are broadcast.
BROADCAST_WINDOWS = 500_000


def words_of(text: Column) -> Column:
    """Normalised words; none for NULL."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _window_hashes(hashes: Column, count: Column, n: int) -> Column:
    """Hash of the ``n`` words from each position on (none in shorter texts)."""
    return F.when(count >= n, F.transform(F.sequence(F.lit(1), count - (n - 1)), lambda i: F.xxhash64(F.slice(hashes, i, n)))
                  ).otherwise(F.array().cast("array<bigint>"))


def benchmark_windows(items: DataFrame, n: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, len, win, h): every window of ``n`` words of every item, in plain text and hashed."""
    words = keyed_text(items, id_col, text_col).select(F.col("doc_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    each = words.select("item_id", F.least(F.size("w"), F.lit(n)).alias("len"), "w").select(
        "item_id", "len", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("i"))
    return each.select("item_id", "len", F.slice("w", F.col("i"), F.col("len")).alias("s")).select(
        "item_id", "len", F.array_join("s", " ").alias("win"),
        F.xxhash64(F.transform("s", lambda x: F.xxhash64(x))).alias("h")).distinct()


def contamination(docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, th (hash of the text), n_words, n_hit (words inside any
    window of the benchmark), item_ids (sorted strings) and ranges (first word and length of
    each hit window, from 1)."""
    base = keyed_text(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))
    windows = stored(benchmark_windows(items, n, item_id_col, item_text_col), "windows")
    lengths = sorted(r["len"] for r in windows.select("len").distinct().collect())  # n numbers at most
    texts = windows.select("h", "len", "win").distinct()
    probe = texts.select(F.col("h").alias("probe_h"), F.col("len").alias("probe_len")).distinct()
    small = windows.count() <= BROADCAST_WINDOWS
    sized = F.broadcast if small else (lambda d: d)

    words = base.select("doc_id", "th", words_of(F.col("text")).alias("w"))
    hashed = words.select("doc_id", "th", F.size("w").cast("bigint").alias("n_words"), F.transform("w", lambda x: F.xxhash64(x)).alias("wh"))

    def scan(k: int, first: bool) -> DataFrame:
        """Windows of ``k`` words that the set holds, by position; position 0 carries each row's word count."""
        found = _window_hashes(F.col("wh"), F.col("n_words").cast("int"), k)
        rows = hashed.select("doc_id", "th", F.posexplode(F.concat(F.array("n_words"), found)).alias("pos", "h"))
        hit = rows.join(sized(probe.where(F.col("probe_len") == k)), (F.col("pos") > 0) & (F.col("h") == F.col("probe_h")), "left")
        keep = F.col("probe_h").isNotNull() | (F.col("pos") == 0) if first else F.col("probe_h").isNotNull()
        return hit.where(keep).select("doc_id", "th", "pos", F.lit(k).alias("len"), "h")

    probed = stored(functools.reduce(DataFrame.unionByName, [scan(k, not j) for j, k in enumerate(lengths or [n])]), "probed")
    counts = probed.where("pos = 0").select("doc_id", "th", F.col("h").alias("n_words"))
    # compare the words of probable hits; a document's windows are as many as its words
    likely = probed.where("pos > 0").groupBy("doc_id", "th").agg(F.collect_set(F.struct("pos", "len")).alias("at")).select(
        F.col("doc_id").alias("l_id"), F.col("th").alias("l_th"), "at")
    again = base.join(likely, F.col("doc_id").eqNullSafe(F.col("l_id")) & (F.col("th") == F.col("l_th"))).select(
        "doc_id", "th", words_of(F.col("text")).alias("w"), "at")
    spelled = again.select("doc_id", "th", F.explode(F.transform("at", lambda a: F.struct(
        a["pos"].alias("pos"), a["len"].alias("len"), F.array_join(F.slice(F.col("w"), a["pos"], a["len"]), " ").alias("win")))).alias("x")
    ).select("doc_id", "th", "x.pos", "x.len", "x.win").distinct()
    true_hits = stored(spelled.join(sized(texts.select("win").distinct()), "win"), "hits")

    order = Window.partitionBy("doc_id", "th").orderBy("pos", "len").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("pos") + F.col("len")
    covered = true_hits.withColumn("before", F.coalesce(F.max(end).over(order), F.lit(0))).groupBy("doc_id", "th").agg(
        F.sum(F.greatest(F.lit(0), end - F.greatest("pos", "before"))).cast("bigint").alias("n_hit"),
        F.collect_list(F.struct("pos", "len")).alias("ranges"))
    named = true_hits.select("doc_id", "th", "win").distinct().join(sized(windows.select("win", "item_id").distinct()), "win").groupBy(
        "doc_id", "th").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])
    hits = covered.join(named, same(covered, named), "left").select(
        covered["doc_id"].alias("h_id"), covered["th"].alias("h_th"), "n_hit", "ranges", "item_ids")
    return counts.join(hits, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("th") == F.col("h_th")), "left").select(
        "doc_id", "th", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.coalesce("ranges", F.array().cast("array<struct<pos:int,len:int>>")).alias("ranges"))


def decontaminate(docs: DataFrame, items: DataFrame, remove: str = "documents", n: int = 10, id_col: str = "doc_id",
                  text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The input without what it shares with the benchmark, with all its columns.

    ``remove='documents'`` drops every document with a hit; ``'spans'`` cuts the hit words
    with what stands before each out of the text. Clean rows pass unchanged.
    """
    found = contamination(docs, items, n, id_col, text_col, item_id_col, item_text_col).where("n_hit > 0").select(
        F.col("doc_id").alias("_hit_id"), F.col("th").alias("_hit_th"), F.col("ranges").alias("_hit_ranges")).dropDuplicates(["_hit_id", "_hit_th"])
    same = docs[f"`{id_col}`"].eqNullSafe(F.col("_hit_id")) & (F.xxhash64(docs[f"`{text_col}`"].cast("string")) == F.col("_hit_th"))
    if remove == "documents":
        return docs.join(found, same, "left_anti")
    if remove != "spans":
        raise ValueError(f"remove must be 'documents' or 'spans', not {remove!r}")
    text = F.col(f"`{text_col}`")
    word = F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
    pieces = F.regexp_extract_all(text, word, F.lit(0))
    gaps = F.split(text, "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", -1)
    outside = F.zip_with(F.slice(gaps, 1, F.size(pieces)), F.transform(pieces, lambda w, i: F.struct(w.alias("w"), F.exists(
        "_hit_ranges", lambda r: (i + 1 >= r["pos"]) & (i + 1 < r["pos"] + r["len"])).alias("hit"))),
        lambda g, p: F.when(p["hit"], F.lit("")).otherwise(F.concat(g, p["w"])))
    cut = F.concat(F.array_join(outside, ""), F.element_at(gaps, -1))
    return docs.join(found, same, "left").select(*[
        F.when(F.col("_hit_ranges").isNull(), text).otherwise(cut).alias(c) if c == text_col else docs[f"`{c}`"] for c in docs.columns])
