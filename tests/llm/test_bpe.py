"""Byte-level BPE against the tokenizers library, and exact round trips."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from llm_fixtures import edge_docs, no_docs  # noqa: F401
from rollbook.llm import bpe
from rollbook.llm.flat import chunks, text_bytes

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def encode(texts, limit=2 << 20):
    words, enc = bpe.encoder(PATH)
    buf, offsets = text_bytes(pa.array(texts, pa.string()))
    out = []
    for lo, hi in chunks(offsets, limit):
        part = offsets[lo:hi + 1]
        ids, counts = enc.encode(buf[part[0]:part[-1]], part - part[0])
        out += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    return out


def test_awkward_texts(library):
    rnd = random.Random(5)
    parts = list("abst're ve ll m d 's't  \n\t\r 　\u0085éñß日本語123٣²!?-_<|>​́🙂𝒳") + [
        "<|endoftext|>", "'re", "'ll", " '", "\n\n", "  ", "aaaa", "\U000113d1"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(5000)]
    texts += ["", "a" * 5000, "<|endoftext|>", " " * 50 + "a" * 40, "<|endof", "text|>"]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert encode(texts) == want
    assert encode(texts, limit=64) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=8))
def test_any_text(texts):
    library = Tokenizer.from_file(PATH)
    assert encode(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_tables_stay_exact_when_emptied(library, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STORED_IDS", 50)
    texts = [f"alpha beta {i} gamma{i % 7}" for i in range(300)]
    assert encode(texts, limit=200) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_operator_round_trip(spark, edge_docs, library):
    got = bpe.bpe_round_trip(edge_docs, keep_ids=True, keep_text=True).collect()
    assert len(got) == edge_docs.count()
    texts = {(r["doc_id"], r["text"] or "") for r in edge_docs.collect()}
    for r in got:
        assert (r["doc_id"], r["decoded"]) in texts
        ids = library.encode(r["decoded"], add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()


def test_empty_table(no_docs):
    assert bpe.bpe_round_trip(no_docs).collect() == []


def test_malformed_bytes_decode_like_the_library(library):
    words, _ = bpe.encoder(PATH)
    for ids in ([256 - 33, 100, 220, 130], [50256, 187, 222], [162, 245]):
        assert words.decode(np.array(ids)).tobytes().decode("utf-8", "replace") == library.decode(ids, skip_special_tokens=False)


def test_long_words_are_merged_rank_by_rank(library):
    """Unbroken words of any kind give the library's ids, at a cost near its own."""
    import time

    rnd = random.Random(12)
    make = lambda n, letters: "".join(rnd.choice(letters) for _ in range(n))
    low = "abcdefghijklmnopqrstuvwxyz"
    texts = [make(3000, low), make(2500, "ab"), "a" * 4001, "ab" * 3000, make(5000, "aé日"), "short " + make(2100, "aab") + " end", make(20_000, "etaoin")]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert encode(texts) == want
    text = make(1_000_000, low)
    start = time.perf_counter()
    ids = library.encode(text, add_special_tokens=False).ids
    theirs, start = time.perf_counter() - start, time.perf_counter()
    assert encode([text])[0] == ids
    ours = time.perf_counter() - start
    print(f"1 MB of letters: library {theirs:.2f} s, here {ours:.2f} s")
    assert ours < 10 * theirs + 1


def test_pairs_follow_the_pairs_that_made_them():
    words, _ = bpe.encoder(PATH)
    maker = {int(m): r for r, m in reversed(list(enumerate(words.made.tolist())))}
    for key, r in zip(words.keys.tolist(), words.rank.tolist()):
        assert all(maker.get(x, -1) < r for x in (key >> 32, key & 0xFFFFFFFF))
