"""Shards of near-equal bytes, tokens and rows: vector bin packing by the dot product.

Equal texts form a group. Groups become items with a vector of bytes, tokens and rows: a
group of over 1 / ``GRAIN`` of a shard in any of them is an item of its own, and only one that does not fit into a
shard (a text that very many rows share) is dealt by a hash of the id, in pieces of 1 / ``SPLIT`` of a shard; all
other groups are gathered by a hash to ``GRAIN`` items a shard. So there are at most
7 * shards * GRAIN items, whatever the input, and the driver packs them: largest first, each to the shard
where the dot product of its vector with the shard's residual capacity is highest; then the fullest and
the emptiest shards trade items until their bytes are level, of all trades those that level tokens and rows with them. Rows find their shard by a broadcast
join with those items.

The rows of a shard are numbered without gaps from 0: each shard is numbered in ``STRANDS`` strands, dealt by
a hash, whose counts give their offsets, so no task orders a whole shard.

Defined results: NULL has no bytes and no tokens, and NULL texts are one group; repeated rows are rows like
others; rows without doc_id are numbered first in their strand; no documents give no rows. Other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rollbook.llm.common import keyed_text, stored

GRAIN = 512
SPLIT = 4
#: Partners tried for an item on either side of the wanted size, and what bytes weigh against each other measure.
NEAR, WEIGHT = 8, 4.0
STRANDS = 256
ROW_BYTES = 16
MEASURES = ("bytes", "tokens", "n")


#: What a byte-pair vocabulary makes a token of, about: a character of a script that has no spaces, up to six letters, up to three digits, a run of signs.
TOKEN = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsThai}]|[\p{L}\p{M}]{1,6}|\p{N}{1,3}|[^\s\p{L}\p{M}\p{N}]+"


def tokens_of(text: Column) -> Column:
    """A token count that needs no tokenizer and holds for any script."""
    return F.regexp_count(text, F.lit(TOKEN))


def pack(items: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item (rows of ``items`` are vectors): largest first, to the shard whose residual
    capacity has the highest dot product with it; ties go to the first."""
    total = items.sum(axis=0)
    share = items / np.maximum(total / shards, 1e-12)
    order = np.lexsort((np.arange(len(items)), -share.sum(axis=1), -share.max(axis=1)))
    residual = np.ones((shards, items.shape[1]))
    out = np.empty(len(items), np.int64)
    for i in order.tolist():
        s = int((residual @ share[i]).argmax())
        out[i] = s
        residual[s] -= share[i]
    return out


def level(items: np.ndarray, shard: np.ndarray, shards: int, moves: int | None = None) -> np.ndarray:
    """Even out what packing left: again and again, the shards with the most and the fewest bytes (the first column) trade a pair of
    items, or one item, until no trade narrows their gap by a thousandth of a share. Of each item's partners near the wanted size, the one counts
    that leaves the two shards closest in all columns together, bytes ``WEIGHT`` times."""
    out = shard.copy()
    load = np.stack([np.bincount(out, column, shards) for column in items.T], axis=1)
    aim = np.maximum(load.sum(axis=0) / shards, 1e-12)
    weight = np.array([WEIGHT, *[1.0] * (items.shape[1] - 1)])
    for _ in range(100 * shards if moves is None else moves):
        f, e = int(load[:, 0].argmax()), int(load[:, 0].argmin())
        gap = load[f] - load[e]
        if gap[0] <= aim[0] * 1e-3:
            break
        mine, theirs = np.flatnonzero(out == f), np.append(np.flatnonzero(out == e), -1)
        other = np.vstack([items[theirs[:-1]], np.zeros((1, items.shape[1]))])  # the last: no item in return
        order = np.argsort(other[:, 0], kind="stable")
        at = np.searchsorted(other[order, 0], items[mine, 0] - gap[0] / 2)
        near = np.clip(at[:, None] + np.arange(-NEAR, NEAR), 0, len(order) - 1)
        left = np.abs(gap - 2 * (items[mine][:, None] - other[order[near]])) / aim
        cost = np.where(left[:, :, 0] <= gap[0] / aim[0] - 1e-3, (left * weight).sum(axis=2), np.inf)
        i, k = np.unravel_index(int(cost.argmin()), cost.shape)
        if not np.isfinite(cost[i, k]):
            break
        for item, to in ((int(mine[i]), e), (int(theirs[order[near[i, k]]]), f)):
            if item >= 0:
                load[out[item]] -= items[item]
                load[to] += items[item]
                out[item] = to
    return out


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None) -> DataFrame:
    """One row per row of the input: doc_id, size (bytes and ``ROW_BYTES``), tokens, text_crc32, shard and slot.

    ``tokens`` is an expression over a column ``text``; ``tokens_of`` by default."""
    spark = docs.sparkSession
    text = keyed_text(docs, id_col, text_col)
    content = F.coalesce("text", F.lit(""))
    rows = stored(text.select("doc_id", F.xxhash64("text").alias("g"), (F.octet_length(content) + ROW_BYTES).cast("bigint").alias("size"),
                              F.coalesce(tokens if tokens is not None else tokens_of(F.col("text")), F.lit(0)).cast("bigint").alias("tokens"),
                              F.crc32(content.cast("binary")).alias("text_crc32")), "rows")
    groups = stored(rows.groupBy("g").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")), "groups")
    total = groups.agg(*[F.sum(m).alias(m) for m in MEASURES]).first()
    cap = {m: max((total[m] or 0) / shards, 1e-12) for m in MEASURES}
    # the largest share of a shard that a group takes, over bytes, tokens and rows
    part = F.greatest(*[F.col(m) / F.lit(float(cap[m])) for m in MEASURES])
    # a shard's share times shards sums to `shards` in each measure: at most 3 * shards * GRAIN groups pass
    large = groups.where(part > 1.0 / GRAIN).select(F.col("g").alias("large_g"), F.when(part > 1.0, F.ceil(part * SPLIT)).otherwise(F.lit(1)).cast("bigint").alias("pieces"))
    item = F.when(F.col("large_g").isNull(), F.struct(F.lit(0).alias("own"), F.pmod("g", F.lit(shards * GRAIN)).alias("a"), F.lit(0).cast("bigint").alias("b"))).otherwise(
        F.struct(F.lit(1).alias("own"), F.col("g").alias("a"), F.pmod(F.xxhash64("doc_id"), F.col("pieces")).alias("b")))
    placed = rows.join(F.broadcast(large), F.col("g") == F.col("large_g"), "left").withColumn("item", item)
    items = placed.groupBy("item").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")).toPandas()
    items = sorted(items.itertuples(index=False), key=lambda r: tuple(r.item))
    vectors = np.array([[r.bytes, r.tokens, r.n] for r in items], float).reshape(-1, 3)
    where = level(vectors, pack(vectors, shards), shards)
    chosen = spark.createDataFrame([(*map(int, r.item), int(s)) for r, s in zip(items, where)], "own int, a bigint, b bigint, shard int")
    found = placed.join(F.broadcast(chosen.select(F.struct("own", "a", "b").alias("of"), "shard")), F.col("item") == F.col("of")).select(
        "doc_id", "size", "tokens", "text_crc32", "g", "shard", F.pmod(F.xxhash64("doc_id", "g"), F.lit(STRANDS)).cast("int").alias("strand"))
    found = stored(found, "placed")
    counts = found.groupBy("shard", "strand").agg(F.count("*").alias("n"))  # shards * STRANDS rows at most
    before = counts.select(F.col("shard").alias("s"), F.col("strand").alias("t"), F.coalesce(F.sum("n").over(
        Window.partitionBy("shard").orderBy("strand").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("shard", "strand").orderBy("doc_id", "g"))
    return found.withColumn("nth", nth).join(F.broadcast(before), (F.col("shard") == F.col("s")) & (F.col("strand") == F.col("t"))).select(
        "doc_id", "size", "tokens", "text_crc32", "shard", (F.col("before") + F.col("nth") - 1).cast("bigint").alias("slot"))
