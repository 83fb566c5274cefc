"""Byte-level BPE, encoded and decoded in numpy.

Pre-tokens are cut with array operations over a class per byte; the merges of many distinct
words run together: all symbols lie in one flat array, every adjacent pair's rank is found
by binary search over the sorted pair keys, and each round merges every word's lowest-ranked
pair. Words met before come from a bounded table, so running text costs a lookup per word.

Defined results: NULL and empty text have no ids and decode to the empty text; a text that
contains the vocabulary's special token has that token's id there, as in the library.
Repeated rows are encoded alike; any other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rollbook.llm.common import keyed_text, ship
from rollbook.llm.flat import U64, chunks, ranges, text_bytes

LETTER, NUMBER, OTHER, SPACE = 1, 2, 3, 4
TABLE_BITS = 21
#: Bytes from which a word is merged by itself, rank by rank.
LONG = 2048
MAX_STORED_IDS = 6_000_000


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


# Letters and numbers of Unicode 16.0, which the library knows, that older
# releases of Python's own character data lack (first, last).
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
               (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
# Unicode's White_Space (first, last).
WHITE_SPACE = [(0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
               (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]


@functools.lru_cache(maxsize=1)
def code_point_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    import unicodedata

    kind = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    for ranges_, k in ((NEW_LETTERS, LETTER), (NEW_NUMBERS, NUMBER), (WHITE_SPACE, SPACE)):
        for a, b in ranges_:
            table[a:b + 1] = k
    return table


def byte_classes(buf: np.ndarray) -> np.ndarray:
    """Class of the character that each UTF-8 byte belongs to."""
    table = code_point_classes()
    cls = table[buf]
    lead = np.flatnonzero(buf >= 0xC0)
    if len(lead):
        b0 = buf[lead].astype(np.int32)
        last = len(buf) - 1
        b1, b2, b3 = (buf[np.minimum(lead + k, last)].astype(np.int32) & 63 for k in (1, 2, 3))
        two, three = b0 < 0xE0, (b0 >= 0xE0) & (b0 < 0xF0)
        cp = np.where(two, (b0 & 31) << 6 | b1,
                      np.where(three, (b0 & 15) << 12 | b1 << 6 | b2, (b0 & 7) << 18 | b1 << 12 | b2 << 6 | b3))
        kind = table[cp]
        cls[lead] = kind
        cls[lead + 1] = kind
        cls[lead[~two] + 2] = kind[~two]
        four = b0 >= 0xF0
        cls[lead[four] + 3] = kind[four]
    return cls


def pretoken_starts(buf: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """First byte of every pre-token. ``cuts`` are the starts of the non-empty segments,
    ascending from 0; no pre-token crosses one.

    A pre-token is a run of letters, numbers or other characters, with the one space before
    it; white space before it otherwise stands apart; an apostrophe contraction is cut off.
    """
    n = len(buf)
    cls = byte_classes(buf)
    fresh = np.zeros(n + 4, bool)  # a segment begins here
    fresh[cuts] = True
    fresh[n:] = True
    start = np.zeros(n, bool)
    start[1:] = cls[1:] != cls[:-1]
    start |= fresh[:n]
    # the last white-space character before a run: alone, or the run's first character if a space
    r = np.flatnonzero(start & (cls != SPACE) & ~fresh[:n])
    r = r[cls[r - 1] == SPACE]
    q = r - 1
    for _ in range(3):
        q = np.where(buf[q] & 0xC0 == 0x80, q - 1, q)
    start[q] = True
    start[r[buf[r - 1] == 0x20]] = False
    # contractions: a lone apostrophe that begins a pre-token, then s t m d or re ve ll
    a = np.flatnonzero((buf == 0x27) & start)
    a = a[(a + 1 < n) & ~fresh[a + 1]]
    a = a[cls[a + 1] == LETTER]
    if len(a):
        one = np.isin(buf[a + 1], np.frombuffer(b"stmd", np.uint8))
        pair = buf[a + 1].astype(np.int32) << 8 | buf[np.minimum(a + 2, n - 1)]
        two = ~fresh[a + 2] & np.isin(pair, [0x7265, 0x7665, 0x6C6C])
        start[a[one | two] + 1] = False
        for hit, width in ((one, 2), (two, 3)):
            e = a[hit] + width
            e = e[e < n]
            start[e] = True
    return np.flatnonzero(start)


class Vocabulary:
    """A byte-level BPE vocabulary file as arrays."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves
        hidden = [b for b in range(256) if b not in set(shown)]
        letter = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.byte_of = {c: b for b, c in letter.items()}
        self.first = np.array([vocab[letter[b]] for b in range(256)], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys)
        self.keys, self.rank, self.made = keys[order], order.astype(np.int32), made
        self.special = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        pieces = [b""] * size
        for token, i in vocab.items():
            pieces[i] = bytes(self.byte_of[c] for c in token) if all(c in self.byte_of for c in token) else token.encode()
        for token, i in self.special.items():
            pieces[i] = token
        self.piece_len = np.array([len(p) for p in pieces], np.int64)
        self.piece_at = np.concatenate([[0], np.cumsum(self.piece_len)[:-1]])
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def ranks(self, left: np.ndarray, right: np.ndarray, none: int) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], none).astype(np.int32)

    def merge_long(self, data: np.ndarray) -> np.ndarray:
        """Ids of one word. Rounds go by rank, lowest first, each over the pairs of its rank alone, so that a word of many letters
        costs its merges and not a pass over it for every few of them. A merge makes only pairs of higher rank, as in the table every
        pair follows those that made its symbols."""
        none, n = len(self.made), len(data)
        sym = self.first[data]
        after, before = np.arange(1, n + 2), np.arange(-1, n)  # neighbours; place n is the end
        rank, alive = np.full(n + 1, none, np.int32), np.ones(n, bool)
        rank[:n - 1] = self.ranks(sym[:-1], sym[1:], none)
        order = np.argsort(rank[:n], kind="stable")
        present, first = np.unique(rank[order], return_index=True)
        waiting: dict[int, list[np.ndarray]] = {int(r): [order[a:b]] for r, a, b in zip(present, first, np.append(first[1:], n)) if r < none}
        ranks = list(waiting)
        heapq.heapify(ranks)
        while ranks:
            r = heapq.heappop(ranks)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            clash = after[at[:-1]] == at[1:]
            if clash.any():  # of a a a the first goes, the next not, and so on
                head = np.concatenate([[True], ~clash])
                nth = np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
                at = at[nth % 2 == 0]
            gone = after[at]
            behind = after[gone]
            sym[at] = self.made[r]
            after[at], before[np.minimum(behind, n)] = behind, at
            rank[gone], alive[gone] = none, False
            ahead = before[at]
            changed = np.unique(np.concatenate([at, ahead[ahead >= 0]]))
            last = after[changed] >= n
            rank[changed[last]] = none
            changed = changed[~last]
            rank[changed] = self.ranks(sym[changed], sym[after[changed]], none)
            changed = changed[rank[changed] < none]
            if len(changed):
                by = changed[np.argsort(rank[changed], kind="stable")]
                found, start = np.unique(rank[by], return_index=True)
                for k, a, b in zip(found.tolist(), start.tolist(), [*start[1:].tolist(), len(by)]):
                    if k not in waiting:
                        waiting[k] = []
                        heapq.heappush(ranks, k)
                    waiting[k].append(by[a:b])
        return sym[alive].astype(np.int64)

    def merge(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words whose bytes lie end to end in ``data``: (ids, count per word)."""
        long = np.flatnonzero(lengths > LONG)
        if len(long):
            ends = np.cumsum(lengths)
            own = {int(k): self.merge_long(data[ends[k] - lengths[k]:ends[k]]) for k in long}
            short = np.ones(len(lengths), bool)
            short[long] = False
            ids, count = self._rounds(data[np.repeat(short, lengths)], lengths[short])
            total = np.zeros(len(lengths), np.int64)
            total[short] = count
            at, parts = 0, []
            for k in range(len(lengths)):
                if k in own:
                    parts.append(own[k])
                    total[k] = len(own[k])
                else:
                    parts.append(ids[at:at + total[k]])
                    at += int(total[k])
            return np.concatenate(parts), total
        return self._rounds(data, lengths)

    def _rounds(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``merge`` of short words, all of them in step."""
        none = len(self.made)
        total = np.zeros(len(lengths), np.int64)
        sym = self.first[data]
        word = np.repeat(np.arange(len(lengths)), lengths)
        done_sym, done_word = [], []
        rank = np.full(len(sym), none, np.int32)
        if len(sym) > 1:
            inner = np.flatnonzero(word[1:] == word[:-1])
            rank[inner] = self.ranks(sym[inner], sym[inner + 1], none)
        while len(sym):
            begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            size = np.diff(np.append(begin, len(sym)))
            low = np.minimum.reduceat(rank, begin)
            open_ = low < none
            live = np.repeat(open_, size)
            if not open_.all():  # finished words leave
                done_sym.append(sym[~live])
                done_word.append(word[~live])
                sym, word, rank = sym[live], word[live], rank[live]
                low, size = low[open_], size[open_]
                if not len(sym):
                    break
            take = rank == np.repeat(low, size)
            # where chosen pairs overlap (a a a), the first goes, the next not, and so on
            clash = take[1:] & take[:-1]
            if clash.any():
                at = np.flatnonzero(take)
                head = np.concatenate([[True], np.diff(at) != 1])
                nth = np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
                take[at[nth % 2 == 1]] = False
            at = np.flatnonzero(take)
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            shift = np.cumsum(keep) - 1
            sym, word, rank = sym[keep], word[keep], rank[keep]
            new = shift[at]
            touched = np.zeros(len(sym), bool)
            touched[new] = True
            touched[np.maximum(new - 1, 0)] = True
            again = np.flatnonzero(touched)
            inner = again[again + 1 < len(sym)]
            rank[again] = none
            inner = inner[word[inner] == word[inner + 1]]
            rank[inner] = self.ranks(sym[inner], sym[inner + 1], none)
        if not done_sym:
            return np.zeros(0, np.int64), total
        ids, owner = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(owner, kind="stable")
        np.add.at(total, owner, 1)
        return ids[order], total

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the ids' pieces, end to end."""
        return self.piece_bytes[ranges(self.piece_at[ids], self.piece_len[ids])]


class Encoder:
    """Encodes batches of texts. ``merge(data, lengths)`` gives the ids of distinct words.

    Words of at most 16 bytes are looked up in a direct-mapped table by their packed bytes
    (compared in full, so a hit is exact); longer ones in a dictionary. Both are emptied when
    the stored ids pass a fixed number, which bounds a worker's memory.
    """

    def __init__(self, merge: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]],
                 special: dict[bytes, int]) -> None:
        self.merge, self.special = merge, special
        self.reset()

    def reset(self) -> None:
        size = 1 << TABLE_BITS
        self.lo, self.hi = np.zeros(size, U64), np.zeros(size, U64)
        self.width = np.zeros(size, np.int16)
        self.entry = np.zeros(size, np.int32)
        self.long: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.used, self.words = 0, 0
        self.at, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)

    def _store(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Numbers of newly stored words."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.words + len(counts) > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
            self.count = np.concatenate([self.count, np.zeros_like(self.count)])
        self.ids[self.used:self.used + len(ids)] = ids
        new = np.arange(self.words, self.words + len(counts))
        self.at[new] = self.used + np.cumsum(counts) - counts
        self.count[new] = counts
        self.used += len(ids)
        self.words += len(counts)
        return new

    def _segments(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cuts, special starts, special ids): special tokens stand apart from the text around."""
        cuts = offsets[:-1][offsets[:-1] < offsets[1:]]
        if not self.special:
            return cuts, np.zeros(0, np.int64), np.zeros(0, np.int64)
        import re
        found = [(m.start(), m.end(), self.special[m.group()]) for m in
                 re.finditer(b"|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)), buf.tobytes())]
        if found:  # one that spans two rows is none
            row = np.searchsorted(offsets, [f[0] for f in found], side="right")
            found = [f for f, r in zip(found, row) if f[1] <= offsets[r]]
        at = np.array([f[0] for f in found], np.int64)
        end = np.array([f[1] for f in found], np.int64)
        return (np.unique(np.concatenate([cuts, at, end[end < len(buf)]])), at, np.array([f[2] for f in found], np.int64))

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts per row) of a chunk of texts."""
        rows = len(offsets) - 1
        if not len(buf):
            return np.zeros(0, np.int32), np.zeros(rows, np.int64)
        if self.used > MAX_STORED_IDS:
            self.reset()
        cuts, special_at, special_id = self._segments(buf, offsets)
        start = pretoken_starts(buf, cuts)
        if len(special_at):  # what the rules cut inside a special token is one pre-token
            inside = np.zeros(len(buf) + 1, np.int8)
            ends = cuts[np.minimum(np.searchsorted(cuts, special_at, side="right"), len(cuts) - 1)]
            ends = np.where(ends > special_at, ends, len(buf))
            np.add.at(inside, special_at + 1, 1)
            np.add.at(inside, ends, -1)
            start = start[np.cumsum(inside[:-1])[start] == 0]
        width = np.diff(np.append(start, len(buf)))
        number = np.empty(len(start), np.int64)

        padded = np.concatenate([buf, np.zeros(16, np.uint8)])
        window = np.ndarray((len(buf) + 8,), "<u8", padded, strides=(1,))
        mask = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
        lo = window[start] & mask[np.minimum(width, 8)]
        hi = window[np.minimum(start + 8, len(buf))] & mask[np.clip(width - 8, 0, 8)]
        key = (lo ^ (lo >> U64(29))) * U64(0xBF58476D1CE4E5B9) + hi * U64(0x94D049BB133111EB) + width.astype(U64)
        slot = ((key ^ (key >> U64(31))) * U64(0x9E3779B97F4A7C15) >> U64(64 - TABLE_BITS)).astype(np.int64)
        short = width <= 16
        plain = short.copy()
        if len(special_at):
            mine = np.searchsorted(start, special_at)
            plain[mine] = False
            number[mine] = self._store(special_id, np.ones(len(special_id), np.int64))
            short[mine] = True
        hit = plain & (self.lo[slot] == lo) & (self.hi[slot] == hi) & (self.width[slot] == width)
        number[hit] = self.entry[slot[hit]]
        miss = np.flatnonzero(plain & ~hit)
        if len(miss):
            order = miss[np.lexsort((hi[miss], lo[miss], width[miss]))]
            lo_, hi_, w_ = lo[order], hi[order], width[order]
            head = np.concatenate([[True], (lo_[1:] != lo_[:-1]) | (hi_[1:] != hi_[:-1]) | (w_[1:] != w_[:-1])])
            first = order[head]
            ids, counts = self.merge(buf[ranges(start[first], width[first])], width[first])
            new = self._store(ids, counts)
            number[order] = new[np.cumsum(head) - 1]
            s = slot[first]
            self.lo[s], self.hi[s], self.width[s], self.entry[s] = lo[first], hi[first], width[first], new
            # two words in one slot: the last written must be whole
            self.width[s[(self.entry[s] != new)]] = -1
        far = np.flatnonzero(~short)
        if len(far):
            raw = buf.tobytes()
            keys = [raw[a:a + w] for a, w in zip(start[far].tolist(), width[far].tolist())]
            fresh = [k for k in dict.fromkeys(keys) if k not in self.long]
            if fresh:
                ids, counts = self.merge(np.frombuffer(b"".join(fresh), np.uint8), np.array([len(k) for k in fresh]))
                self.long.update(zip(fresh, self._store(ids, counts).tolist()))
            number[far] = [self.long[k] for k in keys]
        counts = self.count[number].astype(np.int64)
        ids = self.ids[ranges(self.at[number], counts)]
        edge = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(edge[np.searchsorted(start, offsets)])


_ENCODERS: dict[str, tuple[Vocabulary, Encoder]] = {}


def encoder(path: str) -> tuple[Vocabulary, Encoder]:
    """This worker's vocabulary and encoder; kept between batches and tasks."""
    if path not in _ENCODERS:
        vocabulary = Vocabulary(path)
        _ENCODERS[path] = vocabulary, Encoder(vocabulary.merge, vocabulary.special)
    return _ENCODERS[path]


def bpe_round_trip(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id",
                   text_col: str = "text", keep_ids: bool = False, keep_text: bool = False) -> DataFrame:
    """Encode and decode every whole text.

    Returns doc_id, n_tokens, ids_sha256 and decoded_sha256, with ``ids`` (array of int) and
    ``decoded`` (the decoded text, malformed bytes replaced) when asked for.
    """
    path = vocabulary or default_vocabulary()
    ship(docs.sparkSession)
    frame = keyed_text(docs, id_col, text_col)
    id_type = frame.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" * keep_ids + ", decoded string" * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from rollbook.llm.bpe import encoder

        words, enc = encoder(path)
        for batch in batches:
            buf, offsets = text_bytes(batch.column(1))
            for lo, hi in chunks(offsets):
                part = offsets[lo:hi + 1]
                ids, counts = enc.encode(buf[part[0]:part[-1]], part - part[0])
                edge = np.concatenate([[0], np.cumsum(counts)])
                wire = ids.astype("<u4")
                text = words.decode(ids)
                reach = np.concatenate([[0], np.cumsum(words.piece_len[ids])])[edge]
                sha = lambda a, at: [hashlib.sha256(a[x:y]).hexdigest() for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
                out = [batch.column(0).slice(lo, hi - lo), pa.array(counts, pa.int64()), pa.array(sha(wire, edge)),
                       pa.array(sha(text, reach))]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(ids, pa.int32())))
                    names.append("ids")
                if keep_text:
                    out.append(pa.array([text[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(reach[:-1].tolist(), reach[1:].tolist())], pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(out, names)

    return frame.mapInArrow(run, schema)
