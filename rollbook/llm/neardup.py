"""Near-duplicate documents: b-bit MinHash signatures joined by a multi-index under Hamming distance.

A document's set holds its distinct word shingles. Documents with equal sets fall together
first, by a digest of the whole set: a digest is a node, its documents hang on it. Each node has a signature of ``k`` MinHash
values of ``LANE`` bits; the distance of two signatures is the number of values that differ.
The signature is split into ``m`` chunks, each packed into one 64-bit word, so that two signatures within distance ``2 m - 1`` have,
by the pigeonhole principle, a chunk with one error at most. Every chunk is therefore indexed once for
each of its positions with that position masked out: two chunks with one error at most share
such a key, wherever the error is. ``m`` is the smallest number for which a pair at the similarity
threshold exceeds the distance with a probability below ``MISS``; pairs above it do so less often.

Pairs that share a key are compared in full, and linked if 100 * intersection >= threshold * union, after what every node carries
has spared most of that without losing a link: the sizes, a
bit map of the parities of hashed shingles, as two sets differ in at least as many shingles as their bit maps differ in bits, and the distance of the signatures.

The work has a fixed number of rounds. In each of ``LEADER_ROUNDS`` the members of a key's group are compared with one of them;
members that fall into one component need no more. Then all pairs of different components that share a key meet in
a join that tests sizes and bit maps as it goes, so that only what passes becomes rows, each pair once after a distinct; groups of more than ``BLOCK`` are cut into blocks
and their pairs of blocks dealt over tasks. What passes is compared in full: where it is much, one pair for each node first, for ``THIN_ROUNDS``, so that members
of one component drop out, then all that is left. Nothing is sampled or capped, and no pair of different components goes unseen.

Defined results: texts without words have an empty set and are linked with nothing; texts with fewer
words than a shingle have one shingle, all their words; NULL is without words. Rows that repeat a
doc_id are in one component, and all texts of that id link it to others; rows without doc_id have no component and are kept. Other columns
are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm.common import keyed_text, ship, stored
from rollbook.llm.components import connected
from rollbook.llm.flat import U64, chunks, lower_ascii, mix64, span_hashes, text_bytes, word_spans

VALUES = 72
MISS = 1e-6
#: Bits of a MinHash value, and values that a 64-bit word holds.
LANE, LANES = 10, 6
LEADER_ROUNDS, THIN_ROUNDS = 1, 3
#: Groups take their leaders by one of so many orders, so that one text that is unlike the others does not lead all groups of a cluster.
LEADERS = 8
#: Pairs are thinned out where more than so many are left for each node; the result is the same either way.
PAIRS_PER_NODE = 4
#: Members of a group that one task compares with each other.
BLOCK = 4096
#: 64-bit words of a set's bit map.
MAP_WORDS = 16
_rng = np.random.Generator(np.random.PCG64(7))
_SEEDS = _rng.integers(0, 2**63, 512, dtype=np.uint64)
_FACTORS = _rng.integers(0, 2**63, 512, dtype=np.uint64) * U64(2) + U64(1)


@functools.lru_cache
def chunk_count(values: int, threshold: int, miss: float = MISS) -> int:
    """Chunks needed to find pairs of ``threshold`` per cent similarity but for a probability ``miss``."""
    differ = 1 - threshold / 100
    for m in range(1, values):
        if sum(comb(values, i) * differ**i * (1 - differ)**(values - i) for i in range(2 * m, values + 1)) <= miss:
            return m
    return values


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes."""
    buf = lower_ascii(buf)
    starts, ends, first = word_spans(buf, offsets)
    words = span_hashes(buf, starts, ends)
    n = len(words)
    rolled = np.zeros(n, U64)
    for j in range(min(width, n)):  # the shingle that begins at each word; a chunk may have fewer words than one
        rolled[:n - j] = mix64(rolled[:n - j] * U64(0x9E3779B97F4A7C15) + words[j:])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(rolled[a:b - width + 1]))
        elif b > a:
            h = np.full(1, b - a, U64)
            for j in range(a, b):
                h = mix64(h * U64(0x9E3779B97F4A7C15) + words[j:j + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, U64))
    return out


def chunk_edges(values: int, m: int) -> list[tuple[int, int]]:
    """(first value, values) of each chunk."""
    chunk = np.arange(values) * m // values
    return [(int((chunk < j).sum()), int((chunk == j).sum())) for j in range(m)]


def signatures(sets: list[np.ndarray], values: int, m: int) -> np.ndarray:
    """Chunks of MinHash values of non-empty sets, packed: (rows, m) of 64-bit words, the chunk's first value lowest."""
    flat = np.concatenate(sets)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.zeros((len(sets), m), np.int64)
    for j, (first, count) in enumerate(chunk_edges(values, m)):
        for i in range(count):
            h = (flat ^ _SEEDS[first + i]) * _FACTORS[first + i]
            out[:, j] |= ((np.minimum.reduceat(h, at) >> U64(24)) & U64((1 << LANE) - 1)).astype(np.int64) << (LANE * i)
    return out


def parity_maps(sets: list[np.ndarray]) -> np.ndarray:
    """Bit maps of sets, a row of ``MAP_WORDS`` words each: bit i is the parity of the shingles hashed to i."""
    out = np.zeros((len(sets), MAP_WORDS), np.int64)
    for k, s in enumerate(sets):
        odd = np.bincount((s >> U64(20)).astype(np.int64) % (64 * MAP_WORDS), minlength=64 * MAP_WORDS) & 1
        out[k] = np.packbits(odd.astype(np.uint8)).view(np.int64)
    return out


def _digest(items: np.ndarray) -> bytes | None:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None


def _sketches(docs: DataFrame, width: int, values: int, m: int) -> DataFrame:
    """(doc_id, n_shingles, fp, c0.., w0..): the set's size, digest, signature and bit map (NULL for the empty set)."""
    words = [f"c{j}" for j in range(m)] + [f"w{i}" for i in range(MAP_WORDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_bytes(batch.column(1))
            for lo, hi in chunks(offsets):
                part = offsets[lo:hi + 1]
                sets = shingle_sets(buf[part[0]:part[-1]], part - part[0], width)
                full = [s for s in sets if len(s)]
                empty = np.array([not len(s) for s in sets], bool)
                traits = np.zeros((len(sets), len(words)), np.int64)
                if full:
                    traits[~empty] = np.concatenate([signatures(full, values, m), parity_maps(full)], axis=1)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(_digest, sets), pa.binary()),
                    *[pa.array(traits[:, k], mask=empty) for k in range(len(words))]], ["doc_id", "n_shingles", "fp", *words])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_shingles bigint, fp binary, " + ", ".join(f"{w} bigint" for w in words))


def _keys(nodes: DataFrame, values: int, m: int) -> DataFrame:
    """(place, key, node): a row for each value, with its chunk but for that value; ``place`` is 8 * chunk + position."""
    rows = []
    for j, (_, count) in enumerate(chunk_edges(values, m)):
        for i in range(count):
            mask = ((1 << LANE) - 1) << (LANE * i)
            rows.append(F.struct(F.lit(8 * j + i).alias("place"), F.col(f"c{j}").bitwiseAND(F.lit(~mask)).alias("key")))
    return nodes.select("node", F.explode(F.array(*rows)).alias("k")).select("k.place", "k.key", "node")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(of, items): digests and whole shingle sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_bytes(batch.column(1))
            for lo, hi in chunks(offsets):
                part = offsets[lo:hi + 1]
                sets = shingle_sets(buf[part[0]:part[-1]], part - part[0], width)
                edge = np.cumsum([0] + [len(s) for s in sets])
                items = np.concatenate(sets) if sets else np.zeros(0, U64)
                yield pa.RecordBatch.from_arrays([pa.array(map(_digest, sets), pa.binary()), pa.ListArray.from_arrays(
                    pa.array(edge, pa.int32()), pa.array(items.view(np.int64)))], ["of", "items"])

    return docs.mapInArrow(run, "of binary, items array<bigint>")


def _errors(j: int, p: str, q: str) -> Column:
    """Values in which the chunks j of two rows differ: a lane's top bit is set where the lane is not zero."""
    low = sum(((1 << (LANE - 1)) - 1) << (LANE * i) for i in range(LANES))
    top = sum((1 << (LANE - 1)) << (LANE * i) for i in range(LANES))
    x = F.col(f"{p}c{j}").bitwiseXOR(F.col(f"{q}c{j}"))
    return F.bit_count((x.bitwiseAND(F.lit(low)) + F.lit(low)).bitwiseOR(x).bitwiseAND(F.lit(top)))


def near_duplicates(docs: DataFrame, threshold: int = 85, width: int = 3, values: int = VALUES, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per row of the input: doc_id, n_shingles, component_id (the smallest doc_id that
    links reach) and kept (whether that is the row's own id)."""
    ship(docs.sparkSession)
    m = max(chunk_count(values, threshold), -(-values // LANES))
    base = keyed_text(docs, id_col, text_col)
    sketch = stored(_sketches(base, width, values, m), "sketches")
    chunk_words, map_words = [f"c{j}" for j in range(m)], [f"w{i}" for i in range(MAP_WORDS)]
    traits = ["size", *chunk_words, *map_words]
    full = sketch.where(F.col("fp").isNotNull() & F.col("doc_id").isNotNull()).withColumnRenamed("n_shingles", "size")
    # equal rows go before any join, so that nothing behind it holds together the rows of a digest that very
    # many rows share, and Spark may split them
    member = stored(full.select("doc_id", "fp").distinct(), "members")
    nodes = full.groupBy("fp").agg(F.min("doc_id").alias("doc"), *[F.first(c).alias(c) for c in traits])
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    named = nodes.select(F.col("fp").alias("of"), "node")
    # digests of one id belong together
    several = member.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z").select(F.col("doc_id").alias("r_id"), "a")
    links = member.join(several, F.col("doc_id") == F.col("r_id")).where("a <> fp").select("a", "fp").distinct()
    links = links.join(named, F.col("a") == F.col("of")).select(F.col("node").alias("a"), "fp").join(named, F.col("fp") == F.col("of")).select("a", F.col("node").alias("b"))

    # groups of nodes that share a key; a key of one node says nothing
    keys = _keys(nodes, values, m)
    shared = keys.groupBy("place", "key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("place").alias("g_place"), F.col("key").alias("g_key"))
    groups = stored(keys.join(shared, (F.col("place") == F.col("g_place")) & (F.col("key") == F.col("g_key"))).select("place", "key", "node"), "groups")
    concerned = nodes.join(groups.select(F.col("node").alias("c")).distinct(), F.col("node") == F.col("c"), "left_semi").select("node", "doc", "fp", "size")
    text = base.join(concerned.select(F.col("doc").alias("c")).distinct(), F.col("doc_id") == F.col("c"), "left_semi")
    sets = stored(_sets(text, width).join(concerned, F.col("of") == F.col("fp")).select("node", "items", "size").dropDuplicates(["node"]), "sets")
    known = nodes.select("node", "size", *map_words)

    def similar(pairs: DataFrame) -> DataFrame:
        """Of (a, b), those whose whole sets are similar enough."""
        left = sets.select(F.col("node").alias("a_"), F.col("items").alias("x"), F.col("size").alias("nx"))
        right = sets.select(F.col("node").alias("b_"), F.col("items").alias("y"), F.col("size").alias("ny"))
        both = F.size(F.array_intersect("x", "y"))
        return pairs.join(right, F.col("b") == F.col("b_")).join(left, F.col("a") == F.col("a_")).where(
            100 * both >= threshold * (F.col("nx") + F.col("ny") - both)).select("a", "b")

    total = lambda terms: functools.reduce(lambda x, y: x + y, terms)

    def near(p: str, q: str) -> Column:
        """The sizes and bit maps of two rows allow the similarity."""
        n, k = F.col(f"{p}size"), F.col(f"{q}size")
        apart = total([F.bit_count(F.col(f"{p}w{i}").bitwiseXOR(F.col(f"{q}w{i}"))) for i in range(MAP_WORDS)])
        return (100 * F.least(n, k) >= threshold * F.greatest(n, k)) & (apart * (100 + threshold) <= (100 - threshold) * (n + k))

    def within(pairs: DataFrame) -> DataFrame:
        """Of distinct (a, b), those whose signatures are within the distance that the keys stand for."""
        both = pairs.join(prefixed(nodes.select("node", *chunk_words), "p_"), F.col("a") == F.col("p_node")).join(
            prefixed(nodes.select("node", *chunk_words), "q_"), F.col("b") == F.col("q_node"))
        return both.where(total([_errors(j, "p_", "q_") for j in range(m)]) < 2 * m).select("a", "b")

    def prefixed(rows: DataFrame, p: str) -> DataFrame:
        return rows.select(*[F.col(c).alias(f"{p}{c}") for c in rows.columns])

    def merged(component: DataFrame, pairs: DataFrame) -> DataFrame:
        return stored(connected(component.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(similar(pairs))), "components")

    links = stored(links, "links")
    component = links.select(F.col("a").alias("node"), F.col("b").alias("component")) if links.isEmpty() else stored(connected(links), "components")
    rest = groups
    for r in range(LEADER_ROUNDS + 1):
        comp = component.select(F.col("node").alias("c"), "component")
        rest = rest.select("place", "key", "node").join(comp, F.col("node") == F.col("c"), "left").select(
            "place", "key", "node", F.coalesce("component", "node").alias("comp"))
        heads = rest.groupBy("place", "key").agg(F.min(F.struct(F.xxhash64("node", F.col("place") % LEADERS, F.lit(r)), "node", "comp")).alias("h"), F.count("*").alias("n"),
                                                 F.min("comp").alias("low"), F.max("comp").alias("high"))
        heads = heads.where("low < high").select(F.col("place").alias("g_place"), F.col("key").alias("g_key"), F.col("h.node").alias("lead"), F.col("h.comp").alias("lead_comp"), "n")
        rest = stored(rest.join(heads, (F.col("place") == F.col("g_place")) & (F.col("key") == F.col("g_key"))).drop("g_place", "g_key"), "open")
        if r == LEADER_ROUNDS:
            break
        pairs = rest.where("comp <> lead_comp").select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()
        near_pairs = pairs.join(prefixed(known, "p_"), F.col("a") == F.col("p_node")).join(prefixed(known, "q_"), F.col("b") == F.col("q_node")).where(near("p_", "q_"))
        component = merged(component, within(near_pairs.select("a", "b")))

    # all pairs of different components that share a key, under the first chunk with one error at most: blocks against blocks
    rows = rest.join(known.withColumnRenamed("node", "k_node"), F.col("node") == F.col("k_node")).drop("k_node", "lead", "lead_comp")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), blocks).cast("int")).withColumn("blocks", blocks)
    lower = prefixed(rows.withColumn("other", F.explode(F.sequence("block", F.col("blocks") - 1))), "p_")
    upper = prefixed(rows.withColumn("other", F.explode(F.sequence(F.lit(0), "block"))), "q_")
    met = lower.join(upper, (F.col("p_place") == F.col("q_place")) & (F.col("p_key") == F.col("q_key")) & (F.col("p_block") == F.col("q_other"))
                     & (F.col("p_other") == F.col("q_block")) & ((F.col("p_block") < F.col("q_block")) | (F.col("p_node") < F.col("q_node")))
                     & (F.col("p_comp") != F.col("q_comp")) & near("p_", "q_"))
    left = stored(met.select(F.least("p_node", "q_node").alias("a"), F.greatest("p_node", "q_node").alias("b")).distinct(), "near")
    left = stored(within(left), "met")
    thin = THIN_ROUNDS if left.count() > PAIRS_PER_NODE * nodes.count() else 0  # a few pairs are compared at once
    for r in range(thin + 1):
        if left.isEmpty():
            break
        if r == thin:
            component = merged(component, left)
            break
        some = stored(left.groupBy("a").agg(F.min_by("b", F.xxhash64("a", "b")).alias("b")), "some")
        component = merged(component, some)
        of = lambda c, as_: component.select(F.col("node").alias(f"{c}_"), F.col("component").alias(as_))  # noqa: B023, E731
        left = left.join(some.select(F.col("a").alias("t_a"), F.col("b").alias("t_b")), (F.col("a") == F.col("t_a")) & (F.col("b") == F.col("t_b")), "left_anti")
        left = left.join(of("a", "ca"), F.col("a") == F.col("a_"), "left").join(of("b", "cb"), F.col("b") == F.col("b_"), "left")
        left = stored(left.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"), "met")

    # a component's name is the smallest doc_id of its digests
    placed = nodes.select("fp", "node", "doc").join(component.select(F.col("node").alias("c"), "component"), F.col("node") == F.col("c"), "left").select(
        "fp", "doc", F.coalesce("component", "node").alias("component"))
    names = placed.groupBy("component").agg(F.min("doc").alias("name")).select(F.col("component").alias("c"), "name")
    of = placed.join(names, F.col("component") == F.col("c")).select(F.col("fp").alias("of"), "name")
    found = member.join(of, F.col("fp") == F.col("of")).groupBy("doc_id").agg(F.min("name").alias("name")).select(F.col("doc_id").alias("m_id"), "name")
    out = sketch.select("doc_id", "n_shingles").join(found, F.col("doc_id") == F.col("m_id"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("name", "doc_id").alias("component_id"),
                      F.coalesce(F.col("name") == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, threshold: int = 80, width: int = 5, values: int = VALUES, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """The input without the rows of all but each component's smallest doc_id; all columns stay.
    Rows that repeat a kept doc_id all stay."""
    gone = near_duplicates(docs, threshold, width, values, id_col, text_col).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[f"`{id_col}`"] == F.col("_gone"), "left_anti")
