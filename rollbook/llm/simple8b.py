"""Token files: ids packed word-aligned (Simple-8b) in blocks that decode with array operations.

A 64-bit word holds a 4-bit selector (its high bits) and 60 bits of payload: the selector
says how many ids of which width the word packs, low bits first. An id too wide for 60 bits
is escaped: its selector is ``ESCAPE`` and the id is the whole next word. Ids are packed in
blocks of ``BLOCK`` and every block's first word is recorded, so that blocks are encoded
side by side, and any of them can be decoded without the ones before it.

A token file is one part of a Parquet table written by Spark, holding ids in ascending
doc_id order. Each of its rows is a run of whole documents:

==============  =========================================================
file_no         the file's place in doc_id order
segment         the run's place in the file
first_id        ids in the file before this run
doc_id          the documents, ascending (NULL first)
n_tokens        ids of each document, the end id included
n_ids           ids of the run
words           the packed words, little-endian
block_at        first word of each block of ``BLOCK`` ids
==============  =========================================================

Defined results: NULL and empty text hold the end id alone; rows with equal doc_id are kept,
ordered by their text; other columns are ignored; no documents give no files' rows.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rollbook.llm.bpe import Encoder, default_vocabulary
from rollbook.llm.common import keyed_text, ship
from rollbook.llm.flat import CHUNK_BYTES, chunks, text_bytes
from rollbook.session import scratch_path

U64 = np.uint64
# Ids per word and bits per id of each selector.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = 15
BLOCK = 512
SEGMENT_IDS = 1 << 20


def _bits(values: np.ndarray) -> np.ndarray:
    """Bit length of each value, 1 at least."""
    if not len(values) or int(values.max()) < 1 << 31:
        return np.maximum(np.frexp(values.astype(np.float64))[1], 1).astype(np.int8)
    out = np.ones(len(values), np.int8)
    for k in range(1, 64):
        out[values >> U64(k) > 0] = k + 1
    return out


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block) of unsigned 64-bit values."""
    values = np.asarray(values, U64)
    n = len(values)
    if not n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    # bits per id, a block a row, with zeros behind: a block's last word may be short of ids
    blocks, pitch = -(-n // BLOCK), BLOCK + int(COUNTS[0])
    bits = np.zeros((blocks, pitch), np.int8)
    bits[:, :BLOCK].flat[:n] = _bits(values)
    if n % BLOCK:
        bits[-1, n % BLOCK:] = 0
    bits = bits.ravel()
    # walk all blocks side by side: every step packs one word of each
    at = np.arange(blocks) * pitch
    shift = np.arange(blocks) * (pitch - BLOCK)
    stop = at + np.append(np.full(blocks - 1, BLOCK), n - (blocks - 1) * BLOCK)
    step = np.append(COUNTS, [1, 1])
    heads, selectors, takes = [], [], []
    while len(at):
        s = np.full(len(at), ESCAPE)
        widest = np.zeros(len(at), np.int8)
        done = 0
        for k in range(len(COUNTS) - 1, -1, -1):  # the selector of most ids wins
            for ahead in range(done, int(COUNTS[k])):
                np.maximum(widest, bits.take(at + ahead), out=widest)
            done = int(COUNTS[k])
            s[widest <= WIDTHS[k]] = k
            if not (widest <= WIDTHS[max(k - 1, 0)]).any():
                break
        heads.append(at - shift)
        selectors.append(s)
        new = np.minimum(at + step[s], stop)
        takes.append(new - at)
        go = new < stop
        at, stop, shift = new[go], stop[go], shift[go]
    head = np.concatenate(heads)
    order = np.argsort(head)
    head, sel, took = head[order], np.concatenate(selectors)[order], np.concatenate(takes)[order]
    size = 1 + (sel == ESCAPE)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), U64)
    words[place] = sel.astype(U64) << U64(60)
    for s in range(len(COUNTS)):
        mine = np.flatnonzero(sel == s)
        for k in range(int(COUNTS[s])):
            mine = mine[took[mine] > k]
            if not len(mine):
                break
            words[place[mine]] |= values[head[mine] + k] << U64(k * int(WIDTHS[s]))
    far = np.flatnonzero(sel == ESCAPE)
    words[place[far] + 1] = values[head[far]]
    block_at = place[np.searchsorted(head, np.arange(0, n, BLOCK))]
    return words, block_at


def unpack(words: np.ndarray, n: int, block_at: np.ndarray | None = None) -> np.ndarray:
    """The ``n`` values of packed words; ``block_at`` has the first word of each block (without it, one block)."""
    words = np.asarray(words, U64)
    if not n:
        return np.zeros(0, U64)
    sel = (words >> U64(60)).astype(np.int64)
    head = np.ones(len(words), bool)
    for k in np.flatnonzero(sel == ESCAPE).tolist():  # rare: the word behind an escape is a value, whatever its high bits
        if head[k]:
            head[k + 1] = False
    place = np.flatnonzero(head)
    s = sel[place]
    took = np.append(COUNTS, [1, 1])[s]
    # the last word of each block holds what its block still lacks
    if block_at is None:
        block_at = np.zeros(1, np.int64)
    first = np.searchsorted(place, block_at)
    total = np.minimum(np.arange(1, len(block_at) + 1) * BLOCK, n) - np.arange(len(block_at)) * BLOCK
    last = np.append(first[1:], len(place)) - 1
    run = np.concatenate([[0], np.cumsum(took)])
    took[last] -= run[last + 1] - run[first] - total
    out = np.zeros(n, U64)
    to = np.cumsum(took) - took
    for i in range(len(COUNTS)):
        mine = np.flatnonzero(s == i)
        w = int(WIDTHS[i])
        mask = U64((1 << w) - 1)
        for k in range(int(COUNTS[i])):
            mine = mine[took[mine] > k]
            if not len(mine):
                break
            out[to[mine] + k] = words[place[mine]] >> U64(k * w) & mask
    far = np.flatnonzero(s == ESCAPE)
    out[to[far]] = words[place[far] + 1]
    return out


@functools.lru_cache(maxsize=2)
def library_encoder(path: str) -> Encoder:
    """Encoder whose words' ids come from the tokenizers library; kept by the worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = {t.content.encode(): i for i, t in tokenizer.get_added_tokens_decoder().items()}

    def ids(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw, edge = data.tobytes(), np.concatenate([[0], np.cumsum(lengths)]).tolist()
        words = [raw[a:b].decode() for a, b in zip(edge[:-1], edge[1:])]
        found = [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return (np.array([i for f in found for i in f], np.int64), np.array([len(f) for f in found], np.int64))

    return Encoder(ids, special)


SCHEMA = ("file_no int, segment int, first_id bigint, doc_id array<{id}>, n_tokens array<bigint>, n_ids bigint, "
          "words binary, block_at array<int>")


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2,
                      id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, end it with ``end_id``, and write token files to ``path`` (any Spark path).

    Documents are range-partitioned by id, one file per partition, so that file order is id
    order whatever the size. Ties are ordered by text.
    """
    vocabulary = tokenizer or default_vocabulary()
    ship(docs.sparkSession)
    frame = keyed_text(docs, id_col, text_col)
    id_type = frame.schema["doc_id"].dataType.simpleString()
    ordered = frame.repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from rollbook.llm.simple8b import library_encoder

        enc = library_encoder(vocabulary)
        file_no, segment, before = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal segment, before
            ids = np.concatenate([h[1] for h in held])
            counts = np.concatenate([h[2] for h in held])
            names = pa.concat_arrays([h[0] for h in held])
            words, block_at = pack(ids)
            as_list = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            row = [pa.array([file_no], pa.int32()), pa.array([segment], pa.int32()), pa.array([before], pa.int64()),
                   as_list(names), as_list(pa.array(counts, pa.int64())), pa.array([len(ids)], pa.int64()),
                   pa.array([words.astype("<u8").tobytes()], pa.binary()), as_list(pa.array(block_at, pa.int32()))]
            segment, before = segment + 1, before + len(ids)
            held.clear()
            return pa.RecordBatch.from_arrays(row, ["file_no", "segment", "first_id", "doc_id", "n_tokens", "n_ids", "words", "block_at"])

        for batch in batches:
            buf, offsets = text_bytes(batch.column(1))
            for lo, hi in chunks(offsets, CHUNK_BYTES // 2):
                part = offsets[lo:hi + 1]
                ids, counts = enc.encode(buf[part[0]:part[-1]], part - part[0])
                ended = np.empty(len(ids) + hi - lo, U64)
                stop = np.cumsum(counts + 1) - 1
                body = np.ones(len(ended), bool)
                body[stop] = False
                ended[body] = ids
                ended[stop] = end_id
                held.append((batch.column(0).slice(lo, hi - lo), ended, counts + 1))
                if sum(len(h[1]) for h in held) >= SEGMENT_IDS:
                    yield flush()
        if held:
            yield flush()

    ordered.mapInArrow(run, SCHEMA.format(id=id_type)).write.parquet(path)


def read_token_files(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """One row per document from token files: doc_id, start (ids of all documents before it),
    n_tokens and ids_crc32 (of its ids as little-endian unsigned 32-bit integers)."""
    ship(spark)
    table = spark.read.parquet(path)
    id_type = table.schema["doc_id"].dataType.elementType.simpleString()
    # one row per file: their number is that of the write's partitions
    files = table.groupBy("file_no").agg(F.sum("n_ids").alias("ids"))
    base = files.select(F.col("file_no").alias("base_no"), F.coalesce(
        F.sum("ids").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = table.join(F.broadcast(base), F.col("file_no") == F.col("base_no")).select(
        "doc_id", "n_tokens", "n_ids", "words", "block_at", (F.col("base") + F.col("first_id")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                names, counts, n, words, block_at, start = (batch.column(c)[k] for c in range(6))
                ids = unpack(np.frombuffer(words.as_buffer(), "<u8"), n.as_py(),
                             block_at.values.to_numpy(zero_copy_only=False).astype(np.int64)).astype("<u4")
                counts = counts.values.to_numpy(zero_copy_only=False)
                edge = np.concatenate([[0], np.cumsum(counts)])
                out = [names.values, pa.array(start.as_py() + edge[:-1], pa.int64()), pa.array(counts, pa.int64()),
                       pa.array([zlib.crc32(ids[a:b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())], pa.int64())]
                cols = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if keep_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(ids, pa.int64())))
                    cols.append("ids")
                yield pa.RecordBatch.from_arrays(out, cols)

    schema = f"doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * keep_ids
    return placed.mapInArrow(run, schema)


def token_files(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, **cols: str) -> DataFrame:
    """Write token files to a fresh folder in the shared checkpoint folder and read them back."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer, end_id, **cols)
    return read_token_files(docs.sparkSession, path)
