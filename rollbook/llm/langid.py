"""Language identification by a byte convolutional network trained here, in numpy.

Bytes (A to Z folded to lower case) are embedded; filters of several widths slide over a window
of fixed length; each filter's maximum goes through one layer to a softmax over the languages.
For prediction the embedding and the filters are multiplied out to a table per filter position, so that
a window costs additions of looked-up rows. A text's windows are laid side by side, all of them, and
its distribution is the mean of theirs, weighted by their letters.

The network is fitted on a bounded sample: about ``PER_LANGUAGE`` rows of each language, chosen by
a hash of the row, of each a piece of ``PIECE`` characters at a hashed place. Prediction reads
the text alone.

To reject texts of no learned language, ``keep_identified`` trains a network with one class more, ``OTHER``. Its bounded material is planted
(``noise``): sample pieces with their letters or syllables dealt anew, made-up syllable languages, other scripts, hexadecimal and base64 runs, and program text.

Defined results: NULL, empty and letterless texts are ``und`` with score 0; so is every text if there was
nothing to learn from. Rows that repeat are predicted alike; other columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm.bpe import LETTER, byte_classes
from rollbook.llm.common import keyed_text, ship
from rollbook.llm.flat import lower_ascii, ranges, text_bytes

UNKNOWN, OTHER = "und", "?"
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS, EMBEDDING = 16, 8
PER_LANGUAGE, PIECE = 500, 600
EPOCHS, BATCH, RATE = 12, 64, 0.01
STRIP = 512  # windows in memory at a time


@dataclass
class Network:
    """Languages and weights; a few tens of kilobytes."""

    languages: list[str]
    embedding: np.ndarray           # (256, EMBEDDING)
    filters: list[np.ndarray]       # for each width (width * EMBEDDING, FILTERS)
    biases: list[np.ndarray]        # for each width (FILTERS,)
    out: np.ndarray                 # (FILTERS * widths, languages)
    out_bias: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """For each width and position the (256, FILTERS) contribution of a byte."""
        e = self.embedding.shape[1]
        return [[(self.embedding @ f[j * e:(j + 1) * e]).astype(np.float32) for j in range(w)] for w, f in zip(WIDTHS, self.filters)]

    def windows(self, x: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        """Distributions over the languages of byte windows (rows of ``x``)."""
        pooled = []
        for w, table, bias in zip(WIDTHS, tables, self.biases):
            n = x.shape[1] - w + 1
            total = table[0][x[:, :n]]
            for j in range(1, w):
                total += table[j][x[:, j:j + n]]
            pooled.append(np.maximum(total.max(axis=1) + bias, 0))
        z = np.concatenate(pooled, axis=1) @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _cut(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, length) of consecutive windows that cover every row's bytes, row by row."""
    size = np.diff(offsets)
    count = -(-size // WINDOW)
    nth = ranges(np.zeros(len(count), np.int64), count)
    row = np.repeat(np.arange(len(count)), count)
    first = offsets[row] + nth * WINDOW
    return first, np.minimum(WINDOW, offsets[row + 1] - first)


def _matrix(buf: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Windows as rows; short ones are filled up with spaces."""
    at = first[:, None] + np.arange(WINDOW)
    x = buf[np.minimum(at, len(buf) - 1)]
    x[np.arange(WINDOW) >= length[:, None]] = 0x20
    return x


def train(texts: list[str], labels: list[str], seed: int = 1) -> Network | None:
    """Fit the network by Adam on the windows of labelled texts; None without any."""
    languages = sorted(set(labels))
    if not languages:
        return None
    buf, offsets = text_bytes(pa.array(texts, pa.string()))
    buf = lower_ascii(buf)
    first, length = _cut(buf, offsets)
    keep = length >= min(32, int(length.max(initial=0)))
    row = np.searchsorted(offsets, first, side="right") - 1
    first, length, row = first[keep], length[keep], row[keep]
    if not len(first):
        return None
    x = _matrix(buf, first, length)
    y = np.searchsorted(languages, np.array(labels))[row]
    rng = np.random.Generator(np.random.PCG64(seed))
    weight = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape).astype(np.float32)
    net = Network(languages, rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32), [weight(w * EMBEDDING, FILTERS) for w in WIDTHS],
                  [np.zeros(FILTERS, np.float32) for _ in WIDTHS], weight(FILTERS * len(WIDTHS), len(languages)), np.zeros(len(languages), np.float32))
    params = [net.embedding, *net.filters, *net.biases, net.out, net.out_bias]
    mean, square, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for lo in range(0, len(order), BATCH):
            pick = order[lo:lo + BATCH]
            for p, g, m, s in zip(params, _gradients(net, x[pick], y[pick]), mean, square):
                m *= 0.9
                m += 0.1 * g
                s *= 0.999
                s += 0.001 * g * g
                p -= RATE * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(s / (1 - 0.999 ** (step + 1))) + 1e-7)
            step += 1
    return net


def _gradients(net: Network, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean cross-entropy; through the pooling they reach the winning positions only."""
    n, who = len(x), np.arange(len(x))
    seen = net.embedding[x]
    pooled, places = [], []
    for w, f, b in zip(WIDTHS, net.filters, net.biases):
        last = x.shape[1] - w + 1
        total = sum(seen[:, j:j + last] @ f[j * EMBEDDING:(j + 1) * EMBEDDING] for j in range(w))
        place = total.argmax(axis=1)
        pooled.append(np.maximum(np.take_along_axis(total, place[:, None], 1)[:, 0] + b, 0))
        places.append(place)
    h = np.concatenate(pooled, axis=1)
    z = h @ net.out + net.out_bias
    z = np.exp(z - z.max(axis=1, keepdims=True))
    z /= z.sum(axis=1, keepdims=True)
    z[who, y] -= 1
    z /= n
    back = (z @ net.out.T) * (h > 0)
    g_embedding = np.zeros_like(net.embedding)
    g_filters, g_biases = [], []
    for i, (w, f) in enumerate(zip(WIDTHS, net.filters)):
        g = back[:, i * FILTERS:(i + 1) * FILTERS]
        g_biases.append(g.sum(axis=0))
        g_f = np.zeros_like(f)
        for j in range(w):
            at = places[i] + j                                      # (n, FILTERS)
            part = slice(j * EMBEDDING, (j + 1) * EMBEDDING)
            g_f[part] = np.einsum("nkd,nk->dk", seen[who[:, None], at], g)
            np.add.at(g_embedding, x[who[:, None], at], g[:, :, None] * f[part].T[None])
        g_filters.append(g_f)
    return [g_embedding, *g_filters, *g_biases, h.T @ z, z.sum(axis=0)]


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


#: Letters of scripts for planted texts, as (first code point, how many).
SCRIPTS = ((0x430, 32), (0x3B1, 25), (0x3042, 80), (0x4E00, 3000), (0x627, 36), (0x5D0, 27), (0xAC00, 2000), (0x905, 50), (0xE01, 46))


def noise(texts: list[str], count: int, seed: int = 11) -> list[str]:
    """Planted texts that are in no language of the sample."""
    rng, out = random.Random(seed), []
    consonants, vowels = "bcdfghjklmnpqrstvwxz", "aeiouy"

    def shuffled(piece: str) -> str:
        letters = [c for c in piece if not c.isspace()]
        rng.shuffle(letters)
        left = iter(letters)
        return "".join(c if c.isspace() else next(left) for c in piece)

    def backwards(piece: str) -> str:
        return " ".join(w[::-1] for w in piece.split(" "))

    def syllables(_: str) -> str:
        own = [rng.choice(consonants) + rng.choice(["", "", "r", "l", "h"]) + rng.choice(vowels) + rng.choice(["", "", "n", "s", "l", "r"]) for _ in range(rng.randint(8, 60))]
        return " ".join("".join(rng.choice(own) for _ in range(rng.randint(1, 4))) for _ in range(90))

    def script(_: str) -> str:
        first, many = rng.choice(SCRIPTS)
        own = [chr(first + rng.randrange(many)) for _ in range(rng.randint(20, 300))]
        return " ".join("".join(rng.choice(own) for _ in range(rng.randint(1, 8))) for _ in range(60))

    def digits(_: str) -> str:
        letters = rng.choice(["0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "01", "0123456789"])
        width = rng.choice([8, 32, 40, 64, 300])
        return rng.choice([" ", "\n", ""]).join("".join(rng.choice(letters) for _ in range(width)) for _ in range(max(1, 500 // width)))

    def program(_: str) -> str:
        names = ["".join(rng.choice(consonants + vowels) for _ in range(rng.randint(1, 9))) for _ in range(20)]
        name = lambda: rng.choice([*names, "function", "return", "var", "if", "for", "int", "def", "self", "null", "const", "class", "import"])
        return "".join(rng.choice([f"{name()}({name()},{name()});", f"{name()}={name()}+{rng.randrange(99)};", f"if({name()}){{return {name()}.{name()}}}", f"<{name()} {name()}='x'>", f"{name()}[{rng.randrange(9)}]&&{name()}!=="]) for _ in range(60))

    makers = [shuffled, backwards, syllables, syllables, script, script, digits, program]
    for k in range(count):
        out.append(makers[k % len(makers)](rng.choice(texts))[:PIECE])
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE,
        piece: int = PIECE, with_other: bool = False) -> Network | None:
    """Train on the sample of the labelled rows that are not held out; ``with_other`` adds the class of planted texts."""
    known = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").alias("lang")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = F.element_at(F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, per_language / n))]), F.col("lang"))
    lot = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    at = F.pmod(F.xxhash64("text", "doc_id"), F.greatest(F.length("text") - piece, F.lit(1))).cast("int")
    rows = known.where(lot < share).select("lang", F.substring("text", at + 1, F.lit(piece)).alias("t")).collect()
    rows = sorted((r["lang"], r["t"]) for r in rows)
    texts, names = [t for _, t in rows], [k for k, _ in rows]
    if with_other and texts:
        planted = noise(texts, -(-len(texts) // len(set(names))))
        texts, names = texts + planted, names + [OTHER] * len(planted)
    return train(texts, names)


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) for every row, from the whole text."""
    ship(docs.sparkSession)
    frame = keyed_text(docs, id_col, text_col)
    kind = frame.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from rollbook.llm.langid import label

        tables = net.tables() if net else None
        for batch in batches:
            names, score = label(batch.column(1), net, tables)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return frame.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def label(texts: pa.Array, net: Network | None, tables: list | None) -> tuple[list[str], np.ndarray]:
    """(language, score) of each text."""
    rows = len(texts)
    if net is None:
        return [UNKNOWN] * rows, np.zeros(rows)
    buf, offsets = text_bytes(texts)
    first, length = _cut(buf, offsets)
    row = np.searchsorted(offsets, first, side="right") - 1
    total, weight = np.zeros((rows, len(net.languages))), np.zeros(rows)
    for lo in range(0, len(first), STRIP):
        f, n, r = first[lo:lo + STRIP], length[lo:lo + STRIP], row[lo:lo + STRIP]
        a, b = int(f[0]), int(f[-1] + n[-1])
        # characters cut at a window's edge are counted with the window that has their first byte
        lead = a
        while lead > 0 and buf[lead] & 0xC0 == 0x80:
            lead -= 1
        tail = b
        while tail < len(buf) and buf[tail] & 0xC0 == 0x80:
            tail += 1
        letter = (byte_classes(buf[lead:tail])[a - lead:b - lead] == LETTER) & (buf[a:b] & 0xC0 != 0x80)
        letters = np.add.reduceat(letter, f - a, dtype=np.int64)
        p = net.windows(_matrix(lower_ascii(buf[a:b]), f - a, n), tables)
        np.add.at(total, r, p * letters[:, None])
        np.add.at(weight, r, letters)
    best = total.argmax(axis=1)
    score = np.where(weight > 0, total[np.arange(rows), best] / np.maximum(weight, 1), 0.0)
    return [net.languages[k] if w > 0 else UNKNOWN for k, w in zip(best.tolist(), weight.tolist())], np.clip(score, 0, 1)


def keep_identified(docs: DataFrame, min_score: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    with_other: bool = True) -> DataFrame:
    """The rows whose text's language is a learned one with at least ``min_score``, with all columns as they are, but that a NULL language becomes
    the predicted one. Without labelled rows nothing can be told, and every row stays."""
    ship(docs.sparkSession)
    net = fit(docs, id_col, text_col, lang_col, with_other=with_other)
    if net is None:
        return docs
    at, place = docs.columns.index(text_col), docs.columns.index(lang_col)
    named = docs.schema[lang_col].dataType.simpleString() == "string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from rollbook.llm.langid import OTHER, UNKNOWN, label

        tables = net.tables()
        for batch in batches:
            names, score = label(batch.column(at), net, tables)
            if named:
                batch = batch.set_column(place, batch.schema.field(place), pc.coalesce(batch.column(place), pa.array(names, batch.schema.field(place).type)))
            yield batch.filter(pa.array([n not in (OTHER, UNKNOWN) and s >= min_score for n, s in zip(names, score.tolist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
