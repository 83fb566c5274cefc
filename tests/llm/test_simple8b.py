"""Simple-8b packing round trips, and token files against whole-text library encoding."""

import zlib

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from llm_fixtures import SF_SMALL, edge_docs, no_docs  # noqa: F401
from rollbook.llm.simple8b import BLOCK, pack, token_files, unpack

PATH = P.path("byte_bpe_50k.json")


def test_pack_sizes_and_escapes():
    r = np.random.default_rng(1)
    for n in (0, 1, 5, BLOCK - 1, BLOCK, BLOCK + 1, 5000):
        for hi in (1, 2, 200, 50257, 2**31, 2**59, 2**64 - 1):
            v = r.integers(0, hi, n, dtype=np.uint64)
            v[10:40] = 0
            words, block_at = pack(v)
            assert (unpack(words, n, block_at) == v).all()
            if n:  # a block decodes on its own
                b = len(block_at) - 1
                assert (unpack(words[block_at[b]:], n - b * BLOCK) == v[b * BLOCK:]).all()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 70000) | st.just(0), max_size=1500))
def test_pack_any(values):
    v = np.array(values, np.uint64)
    words, block_at = pack(v)
    assert unpack(words, len(v), block_at).tolist() == values


def test_token_files(spark, edge_docs):
    library = Tokenizer.from_file(PATH)
    rows = sorted(((r["doc_id"], r["text"] or "") for r in edge_docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want, start = [], 0
    for doc_id, text in rows:
        ids = np.array(library.encode(text, add_special_tokens=False).ids + [2], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = sorted((tuple(r) for r in token_files(edge_docs).collect()), key=lambda x: x[1])
    assert got == want


def test_no_documents(no_docs):
    assert token_files(no_docs).collect() == []


def test_query_matches_whole_text_encoding(spark):
    from rollbook.llm.queries import QUERIES

    library = Tokenizer.from_file(PATH)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    start, want = 0, {}
    for r, e in zip(docs, library.encode_batch([r["text"] or "" for r in docs], add_special_tokens=False)):
        ids = np.array(e.ids + [2], "<u4")
        want[r["doc_id"]] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in QUERIES["op1_token_files"](spark, SF_SMALL).collect()}
    assert got == want
