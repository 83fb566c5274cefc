"""A Merkle manifest of a dataset, and proofs for its rows by octopus multiproofs.

Every row is a leaf: the SHA-256 of its fields. Each group of rows is a tree over its leaves in id
order, eight children to a node; the groups' subroots, in the order of their names, are the leaves of one more tree,
whose root stands for the dataset. All nodes are kept in a table (tree, level, idx, hash): that is the manifest.

Leaves get exact positions by a range partitioning: every partition numbers its own rows and
the partitions' counts, summed in order, give each one its first position. Trees grow by blocks of ``8 ** TIER`` leaves, each a
task's group of bounded size; the blocks' roots are the leaves of the next tier.

Proofs are made block by block. For the leaves it holds, a block names the smallest set of node coordinates
that it can't derive from them (``missing``: a sibling that is neither held nor an
ancestor of what is held), fetches these with one join, derives all shared inner nodes once, and writes out every leaf's own proof
from them. A subset of the leaves needs more coordinates, the whole set only the path above the block.

Defined results: rows are ordered by id, NULL first, then by their digest, so that rows that repeat an id,
or repeat altogether, are leaves of their own; a NULL group is a tree of its own, before the others; a tree of one leaf is that leaf. An
empty table has no leaves and no root. NULL fields and empty texts have different digests. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.llm.common import ship, stored

#: Children of a node.
FAN = 8
#: Levels that one block of leaves covers: 8 ** 4 = 4096 leaves a block.
TIER = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree over the groups' subroots; groups' own names begin with "-" (NULL) or ":".
TOP = ""


def digest(fields: Sequence[Column]) -> Column:
    """Lower-case hex SHA-256 of fields, each written as ``-`` if NULL, else its UTF-8 length, ``:`` and its value."""
    def field(c: Column) -> Column:
        s = c.cast("string")
        return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))

    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


def group_name(c: Column) -> Column:
    """A group's tree name: sorts NULL first, then by UTF-8 bytes."""
    return F.when(c.isNull(), "-").otherwise(F.concat(F.lit(":"), c.cast("string")))


def height(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    h = 0
    while n > 1:
        n, h = -(-n // FAN), h + 1
    return h


def widths(n: int) -> list[int]:
    """Nodes on every level, leaves first."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // FAN))
    return out


def node(children: Sequence[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


def missing(held: Sequence[int], n: int) -> list[tuple[int, int]]:
    """The fewest (level, idx) of a tree of n leaves that, with the leaves ``held``, give all their proofs and the root."""
    known, out = np.unique(np.asarray(held, np.int64)), []
    for level, width in enumerate(widths(n)[:-1]):
        parents = np.unique(known // FAN)
        run = (parents[:, None] * FAN + np.arange(FAN)).ravel()
        out += [(level, int(i)) for i in np.setdiff1d(run[run < width], known, assume_unique=True)]
        known = parents
    return out


def climb(known: dict[tuple[int, int], str], held: Sequence[int], n: int) -> str:
    """Add to ``known`` (by level and idx) every node above the leaves ``held``; returns the root."""
    wide, now = widths(n), sorted(set(held))
    for level, width in enumerate(wide[:-1]):
        now = sorted({i // FAN for i in now})
        for p in now:
            known[level + 1, p] = node([known[level, c] for c in range(p * FAN, min(p * FAN + FAN, width))])
    return known[len(wide) - 1, 0]


def siblings(known: dict[tuple[int, int], str], idx: int, n: int) -> list[tuple[list[str], list[str]]]:
    """A leaf's proof: for each level its run's nodes before and after the path."""
    out = []
    for level, width in enumerate(widths(n)[:-1]):
        first = idx // FAN * FAN
        out.append(([known[level, c] for c in range(first, idx)], [known[level, c] for c in range(idx + 1, min(first + FAN, width))]))
        idx //= FAN
    return out


def fold(leaf: str, proof: Sequence[tuple[list[str], list[str]]]) -> str:
    """The root that a leaf has with these siblings."""
    for before, after in proof:
        leaf = node([*before, leaf, *after])
    return leaf


@dataclass
class Manifest:
    """leaves (tree, idx, n, the ordered columns and those carried), nodes (tree, level, idx, hash; leaves are level 0) and
    trees (tree, n, top_idx, n_top)."""

    leaves: DataFrame
    nodes: DataFrame
    trees: DataFrame


def place(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``rows`` with their position idx among their tree's rows, and the tree's size n."""
    ship(rows.sparkSession)
    keys = ["tree", *order]
    # rows that are equal in all keys are told apart by a number fixed in the written table
    rows = stored(rows.withColumn("tie", F.monotonically_increasing_id()), name)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, tree, nth = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            runs = pc.run_end_encode(batch.column("tree"))
            at, out = 0, []
            for end, value in zip(runs.run_ends.to_pylist(), runs.values.to_pylist()):
                nth = nth if value == tree else 0
                out.append(np.arange(nth, nth + end - at))
                tree, nth, at = value, nth + end - at, end
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)),
                                              pa.array(np.concatenate(out) if out else np.zeros(0, np.int64), pa.int64())],
                                             [*batch.schema.names, "part", "nth"])

    ordered = rows.repartitionByRange(*keys, "tie").sortWithinPartitions(*keys, "tie").drop("tie")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema.fields)
    numbered = stored(ordered.mapInArrow(number, f"{schema}, part int, nth bigint"), name)
    # a row for each partition and tree in it
    counts = numbered.groupBy("tree", "part").agg(F.count("*").alias("c"))
    each = Window.partitionBy("tree")
    first = counts.select(F.col("tree").alias("t_"), F.col("part").alias("p_"), F.sum("c").over(each).alias("n"),
                          F.coalesce(F.sum("c").over(each.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    return numbered.join(first, (F.col("tree") == F.col("t_")) & (F.col("part") == F.col("p_"))).withColumn(
        "idx", F.col("first") + F.col("nth")).drop("t_", "p_", "part", "nth", "first")


def grow(leaves: DataFrame) -> DataFrame:
    """All nodes of the trees over (tree, idx, n, hash): (tree, level, idx, hash)."""
    spark = leaves.sparkSession
    tallest = height(leaves.agg(F.max("n")).first()[0] or 0)

    def tier(base: int):
        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by("idx")
            tree, n, idx = table["tree"][0].as_py(), table["n"][0].as_py(), table["idx"][0].as_py()
            now, levels, at, out = table["hash"].to_pylist(), [], [], []
            for level in range(base, min(base + TIER, height(n))):
                now = [node(now[k:k + FAN]) for k in range(0, len(now), FAN)]
                idx //= FAN
                levels += [level + 1] * len(now)
                at += range(idx, idx + len(now))
                out += now
            return pa.table({"tree": pa.array([tree] * len(out), pa.string()), "n": pa.array([n] * len(out), pa.int64()),
                             "level": pa.array(levels, pa.int32()), "idx": pa.array(at, pa.int64()), "hash": pa.array(out, pa.string())})
        return run

    level = leaves.select("tree", "n", F.lit(0).alias("level"), "idx", "hash")
    built = [level]
    for base in range(0, tallest, TIER):
        block = F.floor(F.col("idx") / F.lit(FAN**TIER)).alias("block")
        level = stored(level.where(F.col("level") == base).groupBy("tree", block).applyInArrow(
            tier(base), "tree string, n bigint, level int, idx bigint, hash string"), "nodes")
        built.append(level)
    ship(spark)
    return reduce(DataFrame.unionByName, built).drop("n")


def build(leaves: DataFrame, order: Sequence[str]) -> Manifest:
    """The manifest of (tree, hash, the columns of ``order`` and others to carry along)."""
    placed = stored(place(leaves, order, "leaves"), "placed")
    nodes = grow(placed)
    sizes = placed.groupBy("tree").agg(F.max("n").alias("size")).select(F.col("tree").alias("t_"), "size")
    tops = nodes.groupBy("tree").agg(F.max_by("hash", "level").alias("hash")).join(sizes, F.col("tree") == F.col("t_"))
    subroots = stored(place(tops.select(F.lit(TOP).alias("tree"), F.col("tree").alias("name"), "hash", "size"), ["name"], "subroots"), "subroots")
    trees = subroots.select(F.col("name").alias("tree"), F.col("size").alias("n"), F.col("idx").alias("top_idx"), F.col("n").alias("n_top"))
    return Manifest(placed, nodes.unionByName(grow(subroots)), trees)


def prove(manifest: Manifest, wanted: DataFrame, claim: str = "hash", keep_proofs: bool = False) -> DataFrame:
    """For each row of ``wanted`` (rows of the manifest's leaves): its columns, subroot, root, proof_sha256, folded_root (the
    root that ``claim``, a column with the leaf that is claimed, has with the manifest's siblings) and, if asked, the proof."""
    ship(wanted.sparkSession)
    trees = manifest.trees.select(F.col("tree").alias("t_"), "top_idx", "n_top")
    held = wanted.join(trees, F.col("tree") == F.col("t_")).drop("t_").withColumn("block", F.floor(F.col("idx") / F.lit(FAN**TIER)))

    def ask(table: pa.Table) -> pa.Table:
        """The coordinates that one block lacks."""
        tree, block, n, top, n_top = (table[c][0].as_py() for c in ("tree", "block", "n", "top_idx", "n_top"))
        need = [(tree, *at) for at in missing(table["idx"].to_numpy(), n)] + [(TOP, *at) for at in missing([top], n_top)]
        return pa.table({"tree": pa.array([tree] * len(need), pa.string()), "block": pa.array([block] * len(need), pa.int64()),
                         "of": pa.array([k[0] for k in need], pa.string()), "level": pa.array([k[1] for k in need], pa.int32()),
                         "at": pa.array([k[2] for k in need], pa.int64())})

    asked = held.select("tree", "block", "idx", "n", "top_idx", "n_top").groupBy("tree", "block").applyInArrow(
        ask, "tree string, block bigint, of string, level int, at bigint")
    nodes = manifest.nodes.select(F.col("tree").alias("of_"), F.col("level").alias("level_"), F.col("idx").alias("at_"), "hash")
    fetched = asked.join(nodes, (F.col("of") == F.col("of_")) & (F.col("level") == F.col("level_")) & (F.col("at") == F.col("at_"))).select(
        "tree", "block", "of", "level", "at", "hash")

    kept = [f for f in wanted.schema.fields if f.name != "n"]
    names = [f.name for f in kept]

    def expand(rows: pa.Table, more: pa.Table) -> pa.Table:
        """Inner nodes of one block, once; then each leaf's proof and what its claim folds to."""
        if not rows.num_rows:
            return pa.table({f: pa.array([], t) for f, t in out_types})
        n, top, n_top = (rows[c][0].as_py() for c in ("n", "top_idx", "n_top"))
        idx, leaf, claimed = (rows[c].to_pylist() for c in ("idx", "hash", claim))
        inside, above = dict(zip(((0, i) for i in idx), leaf)), {}
        for of, level, at, value in zip(*(more[c].to_pylist() for c in ("of", "level", "at", "hash"))):
            (above if of == TOP else inside)[level, at] = value
        subroot = climb(inside, idx, n)
        above[0, top] = subroot
        root = climb(above, [top], n_top)
        crown = siblings(above, top, n_top)
        folded: dict[tuple[int, int, str], str] = {}
        proofs, digests, roots = [], [], []
        for i, value in zip(idx, claimed):
            proof = siblings(inside, i, n) + crown
            flat = [s for before, after in proof for s in (*before, *after)]
            at = i
            for level, (before, after) in enumerate(proof):  # leaves under one node with equal values fold alike from there on
                known = (level, at, value)
                if known not in folded:
                    folded[known] = node([*before, value, *after])
                value, at = folded[known], at // FAN if level < len(proof) - len(crown) else 0
            proofs.append(flat)
            digests.append(node(flat))
            roots.append(value)
        out = {c: rows[c] for c in names}
        out |= {"subroot": pa.array([subroot] * len(idx), pa.string()), "root": pa.array([root] * len(idx), pa.string()),
                "proof_sha256": pa.array(digests, pa.string()), "folded_root": pa.array(roots, pa.string())}
        if keep_proofs:
            out["proof"] = pa.array(proofs, pa.list_(pa.string()))
        return pa.table(out)

    from pyspark.sql.pandas.types import to_arrow_type

    added = ["subroot", "root", "proof_sha256", "folded_root"]
    out_types = [(f.name, to_arrow_type(f.dataType)) for f in kept] + [(c, pa.string()) for c in added]
    out_types += [("proof", pa.list_(pa.string()))] * keep_proofs
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{c} string" for c in added)]) + ", proof array<string>" * keep_proofs
    return held.groupBy("tree", "block").cogroup(fetched.groupBy("tree", "block")).applyInArrow(expand, schema)


def row_manifest(docs: DataFrame, claims: dict[str, Column] | None = None, fields: Sequence[str] = FIELDS, group: str = "lang",
                 id_col: str = "doc_id") -> Manifest:
    """The manifest of a table's rows: leaves with doc_id, hash and claim, the digest of the row after ``claims`` replaced some fields."""
    claims = claims or {}
    column = {c: F.col(f"`{c}`") for c in fields}
    return build(docs.select(group_name(F.col(f"`{group}`")).alias("tree"), F.col(f"`{id_col}`").alias("doc_id"),
                             digest(list(column.values())).alias("hash"),
                             digest([claims.get(c, column[c]) for c in fields]).alias("claim")), ["doc_id", "hash"])
