"""Merkle fixity audit of WARC replicas.

A WARC file is a run of records; a replica is described by its records' ranges and digests, its leaves,
which are hashed in place: record bytes never leave the task that reads them. ``FANOUT`` neighbouring nodes,
in the order of their offsets, make a node of the next level, up to one root per file and then over files to
one root per replica. An audit compares the replicas' nodes level by level from the root, and
descends only below nodes that differ, down to the leaves that differ. Below a file that differs, these are aligned by record and content and not by place
alone, so that a record lost, inserted or changed in length in mid-file leaves those behind it what they are: ``moved``; the rest is changed, missing or extra.

Defined results: records without page_id are put into files by a hash of their content; NULL url and html are
empty; equal records are ordered alike in all replicas, so it does not matter which is which; an empty archive has no
root and equals another one. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rollbook.llm.common import stored

FANOUT = 16
RECORDS_PER_FILE = 256
LOOSE_FILES = 1024


def warc_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, file_no, record): each page as a WARC/1.0 response record, in bytes."""
    p = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")).alias("url"),
                     F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"))
    file_no = F.when(F.col("page_id").isNotNull(), F.floor(F.col("page_id") / RECORDS_PER_FILE)).otherwise(
        -1 - F.pmod(F.xxhash64("url", "html"), F.lit(LOOSE_FILES)))
    record = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:md5:"), F.md5(F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(" "), F.col("url")).cast("binary")),
                      F.lit(">\r\nWARC-Target-URI: "), F.col("url"), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
                      F.octet_length("html").cast("string"), F.lit("\r\n\r\n"), F.col("html"), F.lit("\r\n\r\n")).cast("binary")
    return p.select("page_id", file_no.cast("bigint").alias("file_no"), record.alias("record"))


def leaves(records: DataFrame) -> DataFrame:
    """(file_no, idx, page_id, offset, length, digest): the records of each file laid end to end in id order."""
    hashed = records.select("file_no", "page_id", F.octet_length("record").cast("bigint").alias("length"), F.sha2("record", 256).alias("digest"))
    order = Window.partitionBy("file_no").orderBy("page_id", "digest")
    return hashed.select("file_no", (F.row_number().over(order) - 1).cast("bigint").alias("idx"), "page_id", F.coalesce(F.sum("length").over(
        order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"), "length", "digest")


def leaf_hash() -> Column:
    """What a leaf adds to the tree: its place as well as its content."""
    return F.sha2(F.concat_ws(":", F.lit("leaf"), F.col("offset"), F.col("length"), F.col("digest")).cast("binary"), 256)


def _parent(nodes: DataFrame, keys: list[str], index: str) -> DataFrame:
    """The next level: up to ``FANOUT`` neighbours under one node."""
    up = F.floor(F.col(index) / FANOUT).cast("bigint")
    return nodes.groupBy(*keys, up.alias("up")).agg(F.array_sort(F.collect_list(F.struct(index, "hash"))).alias("c")).select(
        *keys, F.col("up").alias(index), F.sha2(F.concat(F.lit("node:"), F.array_join(F.transform("c", lambda x: x["hash"]), "")).cast("binary"), 256).alias("hash"))


class Tree:
    """A replica's levels: within files from the leaves up to the file roots, then over files. Each is a
    table, a ``FANOUT``-th of the one below."""

    def __init__(self, leaf_table: DataFrame, height: int, span: int) -> None:
        level = leaf_table.select("file_no", "idx", leaf_hash().alias("hash"))
        self.inner = [level]
        for _ in range(height):
            level = stored(_parent(level, ["file_no"], "idx"), "nodes")
            self.inner.append(level)
        level = level.select("file_no", "hash")
        self.outer = [level]
        for _ in range(span):
            level = stored(_parent(level, [], "file_no"), "nodes")
            self.outer.append(level)

    def file_roots(self) -> DataFrame:
        return self.outer[0]


def _levels(n: int) -> int:
    """Levels until ``n`` neighbours are under one node."""
    k = 0
    while n > 1:
        n, k = -(-n // FANOUT), k + 1
    return k


def heights(*leaf_tables: DataFrame) -> tuple[int, int]:
    """(levels within files, levels over files) that hold every given replica."""
    high = wide = 0
    for t in leaf_tables:
        r = t.agg(F.max("idx").alias("i"), F.max(F.abs("file_no")).alias("f")).first()
        high, wide = max(high, _levels((r["i"] or 0) + 1)), max(wide, _levels((r["f"] or 0) + 1))
    return high, wide + 1  # negative file numbers have a node of their own


def _differ(one: DataFrame, two: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose hashes are unequal or on one side only."""
    b = two.select(*[F.col(k).alias(f"{k}_b") for k in keys], F.col("hash").alias("hash_b"))
    on = [F.col(k) == F.col(f"{k}_b") for k in keys]
    return one.join(b, on, "full").where(~F.col("hash").eqNullSafe(F.col("hash_b"))).select(*[F.coalesce(k, f"{k}_b").alias(k) for k in keys])


def _below(nodes: DataFrame, marked: DataFrame, keys: list[str], index: str) -> DataFrame:
    """The nodes whose parents are marked."""
    m = marked.select(*[F.col(k).alias(f"{k}_m") for k in (*keys, index)])
    on = [F.col(k) == F.col(f"{k}_m") for k in keys] + [F.floor(F.col(index) / FANOUT).cast("bigint") == F.col(f"{index}_m")]
    return nodes.join(m, on, "left_semi")


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """The records where the replica departs from the primary (both as ``leaves``): file_no, idx, page_id, offset, length, verdict, the digests on both sides
    and the replica's offset. Verdicts: ``moved`` (the same record with the same content, elsewhere in the file), ``changed`` (the same record
    or, of records without an id, the same place, with other content), ``missing`` and ``extra``. Equal records are told apart by their order."""
    high, wide = heights(primary, replica)
    a, b = Tree(primary, high, wide), Tree(replica, high, wide)
    marked = stored(_differ(a.outer[-1], b.outer[-1], ["file_no"]), "marked")
    for k in range(wide - 1, -1, -1):
        marked = stored(_differ(_below(a.outer[k], marked, [], "file_no"), _below(b.outer[k], marked, [], "file_no"), ["file_no"]), "marked")
    marked = marked.select("file_no", F.lit(0).cast("bigint").alias("idx"))
    for k in range(high - 1, -1, -1):
        marked = stored(_differ(_below(a.inner[k], marked, ["file_no"], "idx"), _below(b.inner[k], marked, ["file_no"], "idx"), ["file_no", "idx"]), "marked")
    m = marked.select(F.col("file_no").alias("f"), F.col("idx").alias("i"))
    names = ("page_id", "idx", "offset", "length", "digest")

    def side(t: DataFrame, c: str) -> DataFrame:
        """Marked leaves of one replica, equal ones numbered."""
        rows = m.join(t, (F.col("f") == F.col("file_no")) & (F.col("i") == F.col("idx"))).select("file_no", *names)
        nth = F.row_number().over(Window.partitionBy("file_no", "page_id", "digest").orderBy("idx"))
        return stored(rows.withColumn("nth", nth).select(*[F.col(x).alias(f"{x}_{c}") for x in ("file_no", *names, "nth")]), "marked")

    one, two = side(primary, "a"), side(replica, "b")
    same = ((F.col("file_no_a") == F.col("file_no_b")) & F.col("page_id_a").eqNullSafe(F.col("page_id_b")) & (F.col("digest_a") == F.col("digest_b"))
            & (F.col("nth_a") == F.col("nth_b")))
    moved = one.join(two, same).withColumn("verdict", F.lit("moved"))

    def rest(t: DataFrame, c: str) -> DataFrame:
        """What found no equal: numbered by record, those without an id by their place."""
        key = F.coalesce(F.concat(F.lit("id:"), F.col(f"page_id_{c}").cast("string")), F.concat(F.lit("at:"), F.col(f"idx_{c}").cast("string")))
        rows = t.withColumn(f"key_{c}", key)
        return rows.withColumn(f"turn_{c}", F.row_number().over(Window.partitionBy(f"file_no_{c}", f"key_{c}").orderBy(f"idx_{c}")))

    left = rest(one.join(two, same, "left_anti"), "a").join(
        rest(two.join(one, same, "left_anti"), "b"), (F.col("file_no_a") == F.col("file_no_b")) & (F.col("key_a") == F.col("key_b")) & (F.col("turn_a") == F.col("turn_b")), "full")
    left = left.withColumn("verdict", F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "extra").otherwise("changed"))
    out = [F.coalesce(f"{c}_a", f"{c}_b").alias(c) for c in ("file_no", "idx", "page_id", "offset", "length")]
    out += ["verdict", F.col("digest_a").alias("digest"), F.col("digest_b").alias("replica_digest"), F.col("offset_b").alias("replica_offset")]
    return moved.select(*out).unionByName(left.select(*out))
