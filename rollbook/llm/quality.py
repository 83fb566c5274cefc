"""Line quality: a linear-chain conditional random field marks each line content or boilerplate.

A line is described by a few yes/no features (its length, its share of capitals, symbols and
digits, how it begins and ends, whether it repeats an earlier line, whether it repeats itself). The
field's weights are fitted here by exact gradients (forward and backward sums) on a bounded
sample of labelled documents. Their labels are of documents, not of lines, so line labels are made known by splicing: into every second sample text a
run of lines of a text of the other label is set, at its beginning, inside or at its end, and each line keeps the label of the text it
comes from. So labels change inside sequences, and the chain learns where. Viterbi decoding then
labels the lines of every whole text, all texts of a chunk in step; a document stays if at
least half of its words are in content lines and it passes the base rules.

Base rules, on words between white space: fewer than 50 words fail, and so does a text of
whose words over half lie in three-word windows that occur twice or more.

Defined results: NULL and empty texts have no words and fail; lines without a word are not labelled; without
labelled documents every line is content; a document that is labelled several times takes its lowest label. Rows that repeat get the same result; other columns
of either table are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.common import keyed_text, ship
from rollbook.llm.flat import U64, chunks, mix64, span_hashes, spans, text_bytes, word_spans

CONTENT, BOILERPLATE = 0, 1
SAMPLE_DOCS, PIECE = 3000, 4000
ROUNDS, RATE, PENALTY = 80, 0.1, 1e-3
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SEQUENCE = 64
_WORD = re.compile(r"[^ \t\n\x0b\x0c\r]")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_LETTER[0x80:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_MARK = np.zeros(256, bool)
_MARK[np.frombuffer(b"!?", np.uint8)] = True
_STOP = np.zeros(256, bool)
_STOP[np.frombuffer(b".!?:;\"')", np.uint8)] = True


@dataclass
class Texts:
    """Words and lines of a chunk of texts; lines are those with a word."""

    words: np.ndarray        # per text
    word_chars: np.ndarray
    symbols: np.ndarray
    dup_lines: np.ndarray
    repeat_words: np.ndarray
    line_first: np.ndarray   # text i has the lines line_first[i]:line_first[i + 1]
    line_words: np.ndarray   # per line
    features: np.ndarray     # (lines, features)


def _per(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    run = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=run[1:])
    return run[ends] - run[starts]


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is any equal key elsewhere, is any equal key before) for each key."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    any_, before = np.empty(len(k), bool), np.empty(len(k), bool)
    any_[order] = same[1:] | same[:-1]
    before[order] = same[:-1]
    return any_, before


def analyse(buf: np.ndarray, offsets: np.ndarray) -> Texts:
    rows = len(offsets) - 1
    w_start, w_end, w_first = word_spans(buf, offsets)
    words = np.diff(w_first)
    row_of_word = np.repeat(np.arange(rows), words).astype(U64)
    w_hash = span_hashes(buf, w_start, w_end)
    inside = np.zeros(len(buf) + 1, np.int8)
    inside[w_start] += 1
    inside[w_end] -= 1
    chars = (np.cumsum(inside[:-1]) > 0) & (buf & 0xC0 != 0x80)
    word_chars = _per(chars, offsets[:-1], offsets[1:])
    symbols = _per(_SYMBOL[buf], offsets[:-1], offsets[1:])

    n = len(w_hash)
    covered = np.zeros(n + 2, bool)
    if n >= 3:
        three = mix64(mix64(w_hash[:-2] * U64(3) + w_hash[1:-1]) * U64(5) + w_hash[2:])
        whole = row_of_word[:-2] == row_of_word[2:]
        at = np.flatnonzero(whole)
        again, _ = _repeated(mix64(three[at] + row_of_word[at] * U64(0x9E3779B97F4A7C15)))
        at = at[again]
        covered[at] = covered[at + 1] = covered[at + 2] = True
    repeat_words = _per(covered[:n], w_first[:-1], w_first[1:])

    l_start, l_end, l_first = spans(buf != 0x0A, offsets)
    in_line = np.searchsorted(w_start, l_end) - np.searchsorted(w_start, l_start)
    some = in_line > 0
    row_of_line = np.repeat(np.arange(rows), np.diff(l_first))[some]
    l_start, l_end, in_line = l_start[some], l_end[some], in_line[some]
    line_first = np.searchsorted(row_of_line, np.arange(rows + 1))
    l_hash = span_hashes(buf, l_start, l_end)
    _, earlier = _repeated(mix64(l_hash + row_of_line.astype(U64) * U64(0x9E3779B97F4A7C15)))
    dup_lines = _per(earlier, line_first[:-1], line_first[1:])

    # features of lines
    size = np.maximum(l_end - l_start, 1)
    first_word = np.searchsorted(w_start, l_start)
    line_of_word = np.repeat(np.arange(len(l_start)), in_line).astype(U64)
    pick = np.repeat(first_word - (np.cumsum(in_line) - in_line), in_line) + np.arange(len(line_of_word))
    again, before = _repeated(mix64(w_hash[pick] + line_of_word * U64(0x9E3779B97F4A7C15)))
    fresh = in_line - _per(before, np.cumsum(in_line) - in_line, np.cumsum(in_line))
    letters = np.maximum(_per(_LETTER[buf], l_start, l_end), 1)
    share = lambda table, of: _per(table[buf], l_start, l_end) / of
    upper, symbol, digit, mark = share(_UPPER, letters), share(_SYMBOL, size), share(_DIGIT, size), share(_MARK, size)
    head, tail = buf[w_start[first_word]] if len(l_start) else np.zeros(0, np.uint8), buf[np.minimum(w_end[first_word + in_line - 1], len(buf)) - 1] if len(l_start) else np.zeros(0, np.uint8)
    mean = size / np.maximum(in_line, 1)
    pipes = _per(buf == 0x7C, l_start, l_end)
    features = np.stack([
        np.ones(len(l_start), bool), in_line <= 2, (in_line > 2) & (in_line <= 6), (in_line > 6) & (in_line <= 15), in_line > 15,
        upper > 0.5, (upper > 0.15) & (upper <= 0.5), symbol > 0.02, symbol > 0.1, digit > 0.1, mark > 0.05, pipes > 1,
        _UPPER[head] | (head >= 0x80), _STOP[tail], mean > 12, mean < 4, earlier, fresh < 0.5 * in_line, fresh < 0.25 * in_line], axis=1)
    return Texts(words, word_chars, symbols, dup_lines, repeat_words, line_first, in_line, features)


@dataclass
class Field:
    """Weights of a linear chain over two labels."""

    weights: np.ndarray      # (features, 2)
    moves: np.ndarray        # (2, 2): from, to

    def decode(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The likeliest labels (Viterbi) of sequences ``first[i]:first[i + 1]``, all sequences in step."""
        emit = features @ self.weights
        label = np.zeros(len(emit), np.int8)
        length = np.diff(first)
        order = np.argsort(-length, kind="stable")
        start, length = first[:-1][order], length[order]
        go = int((length > 0).sum())
        if not go:
            return label
        back = np.zeros((len(emit), 2), np.int8)
        best = emit[start[:go]].copy()
        final = np.empty((go, 2))
        t = 1
        while go:
            live = int(np.searchsorted(-length, -t, side="left"))  # sequences longer than t
            final[live:go] = best[live:go]
            go = live
            if not go:
                break
            step = best[:go, :, None] + self.moves
            at = start[:go] + t
            back[at] = step.argmax(axis=1)
            best = step.max(axis=1) + emit[at]
            t += 1
        count = len(final)
        now = final.argmax(axis=1).astype(np.int8)
        for t in range(int(length[0]) - 1, -1, -1):
            live = int(np.searchsorted(-length[:count], -t, side="left"))
            at = start[:live] + t
            label[at] = now[:live]
            now[:live] = back[at, now[:live]]
        return label


def lines_with_words(text: str) -> list[str]:
    return [line for line in text.split("\n") if _WORD.search(line)]


def splice(texts: list[str], labels: list[int], seed: int = 4) -> tuple[list[str], list[list[int]]]:
    """The texts, and for each one more in which a run of lines of a text of the other label stands, with the labels of all lines that have a word."""
    rng = random.Random(seed)
    lines = [lines_with_words(t) for t in texts]
    by = {k: [i for i, y in enumerate(labels) if y == k and lines[i]] for k in (CONTENT, BOILERPLATE)}
    out, marks = list(texts), [[y] * len(n) for n, y in zip(lines, labels)]
    for own, y in zip(lines, labels):
        if not own or not by[1 - y]:
            continue
        other = lines[rng.choice(by[1 - y])]
        first = rng.randrange(len(other))
        run = other[first:first + rng.randint(1, max(1, min(len(other), 2 * len(own))))]
        at = rng.choice([0, len(own), rng.randint(0, len(own))])
        out.append("\n".join([*own[:at], *run, *own[at:]]))
        marks.append([y] * at + [1 - y] * len(run) + [y] * (len(own) - at))
    return out, marks


def train(texts: list[str], labels: list[int] | list[list[int]]) -> Field | None:
    """Maximum likelihood with a quadratic penalty, by Adam on exact gradients. Labels are of texts, or of each text's lines with a word."""
    if labels and isinstance(labels[0], int):
        labels = [[y] * len(lines_with_words(t)) for t, y in zip(texts, labels)]
    buf, offsets = text_bytes(pa.array(texts, pa.string()))
    y = np.array([v for of in labels for v in of], np.int64)
    if not len(buf) or len(set(y.tolist())) < 2:
        return None
    seen = analyse(buf, offsets)
    x = seen.features.astype(np.float64)
    row = np.repeat(np.arange(len(texts)), np.diff(seen.line_first))
    nth = np.arange(len(row)) - seen.line_first[row]
    begin = np.flatnonzero(nth % SEQUENCE == 0)  # longer texts give several sequences
    size = np.diff(np.append(begin, len(row)))
    longest = int(size.max())
    at = begin[:, None] + np.arange(longest)
    real = np.arange(longest) < size[:, None]
    at = np.minimum(at, len(row) - 1)
    balance = np.where(y[begin] == 1, len(begin) / max(2 * (y[begin] == 1).sum(), 1), len(begin) / max(2 * (y[begin] == 0).sum(), 1))
    field = Field(np.zeros((x.shape[1], 2)), np.zeros((2, 2)))
    params = [field.weights, field.moves]
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    truth = np.eye(2)[y]
    pairs = real[:, 1:]
    true_moves = np.einsum("s,sta,stb->ab", balance, truth[at][:, :-1] * pairs[:, :, None], truth[at][:, 1:])
    for step in range(1, ROUNDS + 1):
        emit = (x @ field.weights)[at]
        ahead, behind = np.zeros_like(emit), np.zeros_like(emit)
        ahead[:, 0] = emit[:, 0]
        for t in range(1, longest):
            new = np.logaddexp.reduce(ahead[:, t - 1, :, None] + field.moves, axis=1) + emit[:, t]
            ahead[:, t] = np.where(real[:, t, None], new, ahead[:, t - 1])
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        for t in range(longest - 2, -1, -1):
            new = np.logaddexp.reduce(field.moves + (emit[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
            behind[:, t] = np.where(real[:, t + 1, None], new, 0)
        belief = np.exp(ahead + behind - total[:, None, None]) * real[:, :, None]
        both = np.exp(ahead[:, :-1, :, None] + field.moves + (emit + behind)[:, 1:, None, :] - total[:, None, None, None]) * pairs[:, :, None, None]
        gap = (belief - truth[at] * real[:, :, None]) * balance[:, None, None]
        flat = np.zeros_like(truth)
        np.add.at(flat, at[real], gap[real])
        grads = [x.T @ flat / len(begin) + PENALTY * field.weights, (np.einsum("s,stab->ab", balance, both) - true_moves) / len(begin) + PENALTY * field.moves]
        for p, g, m, s in zip(params, grads, mean, square):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-9)
    return field


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality",
        sample_docs: int = SAMPLE_DOCS, piece: int = PIECE) -> Field | None:
    """Train on about ``sample_docs`` labelled documents, chosen by a hash of the id, of each a piece
    of ``piece`` characters at a hashed place."""
    marks = labels.select(F.col(f"`{id_col}`").alias("l_id"), F.col(f"`{quality_col}`").cast("int").alias("q")).where("l_id is not null and q is not null")
    total = marks.count()
    if not total:
        return None
    lot = F.pmod(F.xxhash64("l_id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    marks = marks.where(lot < min(1.0, sample_docs / total)).groupBy("l_id").agg(F.min("q").alias("q"))
    text = keyed_text(docs, id_col, text_col)
    at = F.pmod(F.xxhash64("doc_id", "text"), F.greatest(F.length("text") - piece, F.lit(1))).cast("int")
    # the sample is small by its bound, the documents are not
    rows = text.join(F.broadcast(marks), F.col("doc_id") == F.col("l_id")).where("text is not null").select(
        "doc_id", "q", F.substring("text", at + 1, F.lit(piece)).alias("t")).collect()
    rows = sorted((r["doc_id"], r["t"], r["q"]) for r in rows)
    return train(*splice([t for _, t, _ in rows], [CONTENT if q else BOILERPLATE for _, _, q in rows]))


def quality(docs: DataFrame, field: Field | None, min_content: float = 0.5, id_col: str = "doc_id", text_col: str = "text",
            keep_labels: bool = False) -> DataFrame:
    """One row per row of the input: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    content_share (of words in content lines) and kept; with ``keep_labels`` also the label of each line with a word."""
    ship(docs.sparkSession)
    frame = keyed_text(docs, id_col, text_col)
    kind = frame.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"]
    schema = f"doc_id {kind}, " + ", ".join(f"{n} bigint" for n in names[1:6]) + ", base_failed boolean, content_share double, kept boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from rollbook.llm.quality import analyse

        for batch in batches:
            buf, offsets = text_bytes(batch.column(1))
            for lo, hi in chunks(offsets, 1 << 20):
                part = offsets[lo:hi + 1]
                t = analyse(buf[part[0]:part[-1]], part - part[0])
                label = field.decode(t.features, t.line_first) if field is not None else np.zeros(len(t.line_words), np.int8)
                content = _per(t.line_words * (label == CONTENT), t.line_first[:-1], t.line_first[1:])
                share = content / np.maximum(t.words, 1)
                failed = (t.words < MIN_WORDS) | (100 * t.repeat_words > MAX_REPEAT_PERCENT * t.words)
                out = [batch.column(0).slice(lo, hi - lo), *(pa.array(a, pa.int64()) for a in (t.words, t.word_chars, t.symbols, t.dup_lines, t.repeat_words)),
                       pa.array(failed), pa.array(share, pa.float64()), pa.array(~failed & (share >= min_content))]
                if keep_labels:
                    out.append(pa.ListArray.from_arrays(pa.array(t.line_first, pa.int32()), pa.array(label.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names + ["labels"] * keep_labels)

    return frame.mapInArrow(run, schema + ", labels array<int>" * keep_labels)
