"""Main text of web pages by a recurrent block labeller trained here, in numpy.

A page is read as its sequence of text blocks (``markup.blocks``). A block's vector holds the mean of the vectors of its tag path's words
(tags, and words of class, id and role, hashed), the mean of its hashed words' vectors, and a few shapes (lengths, share of linked characters, punctuation,
place). A bidirectional LSTM reads the whole sequence, so that each block is labelled main text or not in sight of all others; the main
text is the blocks so labelled, in page order.

Learning needs no labelled table: pages of a bounded sample (``SAMPLE`` pages, those with the least hash) give labels where they mark their
article themselves (``article`` or ``main``), and their texts are laid out anew, labels known, in made-up layouts: other containers,
headers, menus, sidebars, notices, adverts, forms and reader comments. Prediction reads the html alone, whole.

Defined results: NULL, empty and textless pages have an empty text and 0 characters. White space is what Python's ``split`` takes for it. Pages
that repeat are treated alike, each row is kept; other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import random
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from html import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.common import ship
from rollbook.llm.flat import U64, chunks, lower_ascii, ranges, span_hashes, text_bytes, word_spans
from rollbook.llm.markup import Block, blocks

#: Bounds of what is learned from: pages, blocks of one sequence, characters of one page.
SAMPLE, TRAIN_BLOCKS, TRAIN_CHARS = 200, 96, 60_000
PATHS, WORDS, DIM, HIDDEN = 512, 2048, 12, 16
SHAPES = 8
EPOCHS, BATCH, RATE = 8, 24, 0.01
#: Share of the word vectors that each step takes away: words are a hint, path and context decide.
WORD_DECAY = 0.002
LAYOUTS = 3
#: Steps times sequences that are in memory at a time.
CELLS = 1 << 15

#: What marks blocks that are not main text inside an article of a sample page.
ASIDE_TAGS = frozenset("nav aside footer form button select".split())
ASIDE_WORDS = frozenset(".ad .ads .advert .advertisement .banner .sponsored .promo .cookie .cookies .newsletter .subscribe .comment .comments .reply .sidebar .menu .related .share .social".split())


@functools.lru_cache(1 << 16)
def path_buckets(path: tuple[str, ...]) -> tuple[int, ...]:
    return tuple(zlib.crc32(w.encode()) % PATHS for w in path) or (0,)


def _segment_means(table: np.ndarray, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean of ``table``'s rows ``ids[first[i]:first[i + 1]]`` for each i; zeros where there are none."""
    n = np.diff(first)
    out = np.zeros((len(n), table.shape[1]), np.float32)
    if len(ids):
        full = n > 0
        out[full] = np.add.reduceat(table[ids], first[:-1][full], axis=0) / n[full, None]
    return out


@dataclass
class Features:
    """Blocks of some pages: path and word buckets as flat arrays with offsets, shapes, and each page's first block."""

    paths: np.ndarray
    path_at: np.ndarray
    words: np.ndarray
    word_at: np.ndarray
    shapes: np.ndarray
    pages: np.ndarray


def features(sequences: Sequence[Sequence[Block]]) -> Features:
    flat = [b for s in sequences for b in s]
    pages = np.cumsum([0, *map(len, sequences)])
    lists = [path_buckets(b.path) for b in flat]
    raw = [b.text.encode() for b in flat]
    at = np.cumsum([0, *map(len, raw)])
    buf = lower_ascii(np.frombuffer(b"".join(raw), np.uint8))
    hashes, counts = [], []
    for lo, hi in chunks(at):
        part = at[lo:hi + 1]
        piece = buf[part[0]:part[-1]]
        starts, ends, first = word_spans(piece, part - part[0])
        hashes.append((span_hashes(piece, starts, ends) % U64(WORDS)).astype(np.int64))
        counts.append(np.diff(first))
    n_words = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    size, n = np.diff(pages), len(flat)
    place = ranges(np.zeros(len(size), np.int64), size) / np.maximum(np.repeat(size, size), 1)
    chars = np.array([len(b.text) for b in flat], np.float64)
    shapes = np.column_stack([
        np.log1p(n_words) / 6, np.log1p(chars) / 8, np.array([b.linked for b in flat], np.float64) / np.maximum(chars, 1),
        np.array([b.text[-1] in ".!?。！？" for b in flat], np.float64), np.array([len(b.path) for b in flat], np.float64) / 16,
        place, np.log1p(np.repeat(size, size)) / 6, np.array([len(b.path) > 0 and b.path[-1][:1] == "h" and b.path[-1][1:].isdigit() for b in flat], np.float64),
    ]).astype(np.float32) if n else np.zeros((0, SHAPES), np.float32)
    return Features(np.array([i for x in lists for i in x], np.int64), np.cumsum([0, *map(len, lists)]),
                    np.concatenate(hashes) if hashes else np.zeros(0, np.int64), np.concatenate([[0], np.cumsum(n_words)]).astype(np.int64), shapes, pages)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Labeller:
    """Weights of the network; about a hundred kilobytes."""

    path: np.ndarray    # (PATHS, DIM)
    word: np.ndarray    # (WORDS, DIM)
    into: list[np.ndarray]   # forward and backward: (inputs, 4 * HIDDEN), gates in the order input, forget, output, candidate
    round: list[np.ndarray]  # (HIDDEN, 4 * HIDDEN)
    bias: list[np.ndarray]   # (4 * HIDDEN,)
    out: np.ndarray     # (2 * HIDDEN,)
    out_bias: np.ndarray     # (1,)

    def params(self) -> list[np.ndarray]:
        return [self.path, self.word, *self.into, *self.round, *self.bias, self.out, self.out_bias]

    def vectors(self, f: Features) -> np.ndarray:
        return np.concatenate([_segment_means(self.path, f.paths, f.path_at), _segment_means(self.word, f.words, f.word_at), f.shapes], axis=1)

    def run(self, d: int, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states of one direction for (steps, sequences, inputs), in order of the steps as given; ``keep`` collects what learning needs."""
        steps, rows, _ = x.shape
        h, c = np.zeros((rows, HIDDEN), np.float32), np.zeros((rows, HIDDEN), np.float32)
        hidden = np.empty((steps, rows, HIDDEN), np.float32)
        for lo in range(0, steps, max(1, CELLS // rows)):
            given = x[lo:lo + max(1, CELLS // rows)] @ self.into[d] + self.bias[d]
            for k in range(len(given)):
                z = given[k] + h @ self.round[d]
                gates = _sigmoid(z[:, :3 * HIDDEN])
                i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN:2 * HIDDEN], gates[:, 2 * HIDDEN:]
                g = np.tanh(z[:, 3 * HIDDEN:])
                m = mask[lo + k][:, None]
                c_new = f * c + i * g
                t = np.tanh(c_new)
                if keep is not None:
                    keep.append((i, f, o, g, c, h, t, m))
                h, c = m * (o * t) + (1 - m) * h, m * c_new + (1 - m) * c
                hidden[lo + k] = h
        return hidden

    def scores(self, f: Features) -> np.ndarray:
        """Probability of main text for every block; sequences are batched by length, none is cut."""
        x, size = self.vectors(f), np.diff(f.pages)
        out = np.zeros(len(x), np.float32)
        order, at = np.argsort(size, kind="stable"), 0
        at = int(np.searchsorted(size[order], 1))
        while at < len(order):
            stop = at + 1
            while stop < len(order) and (stop + 1 - at) * size[order[stop]] <= CELLS:
                stop += 1
            some, at = order[at:stop], stop
            steps = int(size[some].max())
            where = f.pages[some][None, :] + np.arange(steps)[:, None]
            mask = (np.arange(steps)[:, None] < size[some]).astype(np.float32)
            where = np.where(mask > 0, where, 0)
            batch = x[where]
            logit = self.run(0, batch, mask) @ self.out[:HIDDEN] + (self.run(1, batch[::-1], mask[::-1])[::-1]) @ self.out[HIDDEN:] + self.out_bias
            out[where[mask > 0]] = _sigmoid(logit)[mask > 0]
        return out


def new_labeller(seed: int = 3) -> Labeller:
    rng = np.random.Generator(np.random.PCG64(seed))
    draw = lambda *shape, scale=None: rng.normal(0, scale or shape[0] ** -0.5, shape).astype(np.float32)
    width = 2 * DIM + SHAPES
    bias = np.zeros(4 * HIDDEN, np.float32)
    bias[HIDDEN:2 * HIDDEN] = 1
    return Labeller(draw(PATHS, DIM, scale=0.5), draw(WORDS, DIM, scale=0.1), [draw(width, 4 * HIDDEN) for _ in range(2)],
                    [draw(HIDDEN, 4 * HIDDEN) for _ in range(2)], [bias.copy(), bias.copy()], draw(2 * HIDDEN), np.zeros(1, np.float32))


def gradients(net: Labeller, f: Features, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy over the blocks of ``f`` and its gradient for each of ``net.params()``."""
    size = np.diff(f.pages)
    steps, rows = int(size.max()), len(size)
    mask = (np.arange(steps)[:, None] < size).astype(np.float32)
    where = np.where(mask > 0, f.pages[:-1][None, :] + np.arange(steps)[:, None], 0)
    flat = net.vectors(f)
    x = flat[where] * mask[..., None]
    seen: list[list] = [[], []]
    hidden = [net.run(0, x, mask, seen[0]), net.run(1, x[::-1], mask[::-1], seen[1])]
    both = np.concatenate([hidden[0], hidden[1][::-1]], axis=2)
    p = _sigmoid(both @ net.out + net.out_bias)
    y, total = labels[where], mask.sum()
    loss = float(-(mask * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / total)
    dz = mask * (p - y) / total
    d_out, d_bias = np.einsum("tb,tbh->h", dz, both), np.array([dz.sum()])
    dx = np.zeros_like(x)
    d_into, d_round, d_b = [], [], []
    for d in range(2):
        sign = -1 if d else 1
        dh_out = dz[::sign, :, None] * net.out[d * HIDDEN:(d + 1) * HIDDEN]
        dh, dc = np.zeros((rows, HIDDEN), np.float32), np.zeros((rows, HIDDEN), np.float32)
        grads = np.empty((steps, rows, 4 * HIDDEN), np.float32)
        before = np.empty((steps, rows, HIDDEN), np.float32)
        for k in range(steps - 1, -1, -1):
            i, forget, o, g, c, h, t, m = seen[d][k]
            dh = dh + dh_out[k]
            inner, kept = dh * m, dh * (1 - m)
            dc_new = inner * o * (1 - t * t) + dc * m
            gates = np.concatenate([dc_new * g * i * (1 - i), dc_new * c * forget * (1 - forget), inner * t * o * (1 - o), dc_new * i * (1 - g * g)], axis=1)
            grads[k], before[k] = gates, h
            dh = gates @ net.round[d].T + kept
            dc = dc_new * forget + dc * (1 - m)
        ordered = x[::sign]
        d_into.append(np.einsum("tbi,tbj->ij", ordered, grads, optimize=True))
        d_round.append(np.einsum("tbi,tbj->ij", before, grads, optimize=True))
        d_b.append(grads.sum(axis=(0, 1)))
        dx += (grads @ net.into[d].T)[::sign]
    dx *= mask[..., None]
    back = np.zeros_like(flat)
    back[where[mask > 0]] = dx[mask > 0]

    def spread(like: np.ndarray, ids: np.ndarray, first: np.ndarray, of: np.ndarray) -> np.ndarray:
        out, n = np.zeros_like(like), np.diff(first)
        np.add.at(out, ids, np.repeat(of / np.maximum(n, 1)[:, None], n, axis=0))
        return out

    return loss, [spread(net.path, f.paths, f.path_at, back[:, :DIM]), spread(net.word, f.words, f.word_at, back[:, DIM:2 * DIM]),
                  *d_into, *d_round, *d_b, d_out, d_bias]


def train(sequences: Sequence[Sequence[Block]], seed: int = 3) -> Labeller:
    """Fit by Adam on labelled sequences, in cuts of ``TRAIN_BLOCKS`` blocks."""
    net = new_labeller(seed)
    pieces = [s[k:k + TRAIN_BLOCKS] for s in sequences for k in range(0, len(s), TRAIN_BLOCKS)]
    rng = random.Random(seed)
    params = net.params()
    mean, square, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    pieces.sort(key=len)
    made = []
    for k in range(0, len(pieces), BATCH):
        some = pieces[k:k + BATCH]
        made.append((features(some), np.array([b.label for s in some for b in s], np.float32)))
    for _ in range(EPOCHS):
        rng.shuffle(made)
        for f, y in made:
            _, grads = gradients(net, f, y)
            step += 1
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            for p, g, m, v in zip(params, grads, mean, square):
                g = g * min(1.0, 5 / (norm + 1e-9))
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            net.word *= 1 - WORD_DECAY
    return net


def own_labels(page: list[Block]) -> bool:
    """Label a page's blocks from its ``article`` or ``main``; False if it has none."""
    marked = [any(t in ("article", "main") for t in b.path) for b in page]
    for b, inside in zip(page, marked):
        b.label = int(inside and not any(t in ASIDE_TAGS or t in ASIDE_WORDS for t in b.path))
    return any(marked)


#: Words of menus, notices, forms and comments for the made-up layouts.
MENU = "Home|About us|Contact|News|Products|Blog|Log in|Sign up|Search|Archive|Impressum|Datenschutz|Accueil|Mentions légales|Inicio|Contacto|FAQ|Terms of use".split("|")
NOTICES = ("We use cookies to improve your experience.", "This site uses cookies. Accept all", "Diese Website verwendet Cookies.", "Ce site utilise des cookies.",
           "Este sitio utiliza cookies.", "Please enable JavaScript.", "You have 3 free articles left this month.", "Advertisement", "Sponsored content", "Anzeige", "Skip to content")
FOOTERS = ("© 2024 All rights reserved.", "Copyright 2023 Example Inc.", "Powered by a content system", "Alle Rechte vorbehalten.", "Tous droits réservés.", "Privacy policy", "Follow us on social media")
FORMS = ("Subscribe to our newsletter", "Your e-mail address", "Submit", "Search this site", "Leave a comment", "Name (required)", "Post comment")
REMARKS = ("Great post, thanks!", "Reply", "I don't agree with this.", "Danke für den Beitrag!", "posted 2 days ago", "Merci beaucoup", "Muy interesante.", "Like", "Report")


def layout(rng: random.Random, main: Sequence[str], other: Sequence[str]) -> list[Block]:
    """A made-up page around main texts, its blocks labelled; ``other`` are texts for sidebars, adverts and comments."""
    pick = lambda values: rng.choice(values)
    words = lambda a, b: " ".join((pick(other) if other else "more text").split()[:rng.randint(a, b)]) or "more"
    some = lambda make, a, b: "".join(make() for _ in range(rng.randint(a, b)))
    mark = lambda y, html: f"<!--y{y}-->{html}"
    off = lambda html: mark(0, html)
    named = lambda tag, *names: f'<{tag} {pick(["class", "id"])}="{pick(names)}">'

    def menu() -> str:
        links = some(lambda: f'<li><a href="#">{escape(pick([pick(MENU), words(1, 3)]))}</a></li>', 2, 8)
        return pick([f"<nav><ul>{links}</ul></nav>", named("ul", "menu", "nav-links", "topnav", "breadcrumbs") + links + "</ul>", named("div", "navbar", "menu") + links + "</div>",
                     f"<nav>{links}</nav>"])

    def header() -> str:
        name = f"<{pick(['h1', 'h2', 'div', 'p'])}>{escape(words(1, 5))}"
        return pick([f"<header>{name}<p>{escape(words(2, 9))}</p>{menu()}</header>", named("div", "header", "masthead", "site-top", "branding") + name + "</div>" + menu(), menu()])

    def advert() -> str:
        body = pick([escape(words(3, 15)), f"<a href='#'>{escape(words(3, 12))}</a>", f"<p>{escape(words(5, 30))}</p>"])
        return named("div", "ad", "ads", "advert", "sponsored", "banner-ad", "promo box") + body + "</div>"

    def notice() -> str:
        return named("div", "cookie-notice", "notice", "cookie banner", "gdpr consent", "alert", "popup") + f"<p>{escape(pick([pick(NOTICES), words(4, 20)]))}</p></div>"

    def sidebar() -> str:
        rows = some(lambda: pick([f"<li><a href='#'>{escape(words(2, 9))}</a></li>", f"<h3>{escape(words(1, 4))}</h3>", f"<p>{escape(words(5, 40))}</p>"]), 2, 7)
        return pick([f"<aside>{rows}</aside>", named("div", "sidebar", "widget", "related-posts", "recommended", "right-column") + rows + "</div>",
                     f'<aside class="{pick(["related", "sidebar", "widget"])}">{rows}</aside>'])

    def form() -> str:
        return f"<form action='/x'><label>{escape(pick(FORMS))}</label><input name=q><button>{escape(pick(FORMS))}</button><p>{escape(words(2, 12))}</p></form>"

    def comments() -> str:
        one = lambda: pick([f'<div class="comment"><b>{escape(words(1, 2))}</b><p>{escape(pick([pick(REMARKS), words(5, 80)]))}</p></div>',
                            f'<li class="comment"><p>{escape(pick([pick(REMARKS), words(5, 80)]))}</p></li>', f'<article class="comment"><p>{escape(words(5, 60))}</p></article>'])
        return named("section", "comments", "comment-list", "reader-comments", "responses discussion") + f"<h3>{pick(['Comments', 'Kommentare', 'Commentaires', '3 responses'])}</h3>" + some(one, 1, 5) + "</section>"

    def footer() -> str:
        rows = some(lambda: f"<{pick(['p', 'div', 'span'])}>{escape(pick([pick(FOOTERS), words(2, 15)]))}", 1, 3)
        return pick([f"<footer>{rows}</footer>", named("div", "footer", "site-footer", "copyright bottom") + rows + "</div>", f"<footer>{rows}{menu()}</footer>"])

    maybe = lambda make, chance: off(make()) if rng.random() < chance else ""
    inner = []
    short = lambda: pick([words(1, 3), words(1, 3), pick(pick([MENU, NOTICES, FOOTERS, FORMS, REMARKS]))])
    main = [x for text in main for x in ([text, short()] if rng.random() < 0.15 else [text])]  # such words occur in articles too: place decides
    for k, text in enumerate(main):
        tag = pick(["h1", "h1", "h2"]) if k == 0 and len(main) > 1 else pick(["p"] * 12 + ["h2", "li", "blockquote", "div", "pre", "td"])
        close = f"</{tag}>" if rng.random() < 0.9 else ""
        inner.append(mark(1, f"<{tag}>{escape(text)}{close}"))
        if rng.random() < 0.04:
            inner.append(off(pick([advert, form, sidebar, notice])()))
    body = "".join(inner)
    tail = maybe(comments, 0.2)  # inside the article's own element
    start, end = pick([("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ("<div><article>", "</article></div>"),
                       (named("div", "content", "main-content", "post-body", "entry", "article-text", "story"), "</div>"),
                       (named("section", "content", "post", "entry-content", "article"), "</section>"), ("<div>", "</div>"), ("<table><tr><td>", "</table>"),
                       ('<div role="main">', "</div>"), ("", "")])
    side = maybe(sidebar, 0.4)
    page = (maybe(notice, 0.3) + maybe(header, 0.85) + maybe(advert, 0.4) + (side if rng.random() < 0.4 else "") + start + body + tail + end
            + (side if rng.random() < 0.6 else "") + maybe(comments, 0.35) + maybe(form, 0.25) + maybe(advert, 0.15) + maybe(footer, 0.85) + maybe(notice, 0.1))
    return blocks(f"<html><body>{page}</body></html>", labelled=True)


def training_set(pages: Sequence[str], seed: int = 5) -> list[list[Block]]:
    """Labelled sequences: sample pages that mark their article, and ``LAYOUTS`` new layouts of every page's texts."""
    rng, out = random.Random(seed), []
    read = [blocks(p[:TRAIN_CHARS]) for p in pages]
    texts = [b.text for page in read for b in page if len(b.text) < 4000] or ["A few plain words.", "Some more of them, to read."]
    for page in read:
        if own_labels(page):
            out.append(page)
        own = [b.text for b in page if b.label] or [b.text for b in page if len(b.text) > 60] or [b.text for b in page]
        for _ in range(LAYOUTS):
            first = rng.randrange(len(own)) if own and rng.random() < 0.3 else 0
            out.append(layout(rng, own[first:first + rng.randint(1, 40)] or texts[:3], rng.sample(texts, min(len(texts), 60))))
    return [s for s in out if s]


def fit(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE) -> Labeller:
    """Train on the ``sample`` pages with the least hash of their html; more of the same page count once."""
    html = F.col(f"`{html_col}`").cast("string")
    some = pages.select(F.xxhash64(html).alias("h"), F.substring(html, 1, TRAIN_CHARS).alias("html")).where(F.length(F.trim("html")) > 0)
    # hashes first: every task sends its least ones to the driver, so they must be small
    least = [r["h"] for r in some.select("h").distinct().orderBy("h").limit(sample).collect()]
    rows = some.where(F.col("h").isin(least)).groupBy("h").agg(F.min("html").alias("html")).orderBy("h").collect()
    return train(training_set([r["html"] for r in rows]))


def main_texts(net: Labeller, pages: Sequence[str]) -> list[str]:
    read = [blocks(p) for p in pages]
    scores = net.scores(features(read)) > 0.5
    out, at = [], 0
    for page in read:
        out.append(" ".join(b.text for b, keep in zip(page, scores[at:at + len(page)].tolist()) if keep))
        at += len(page)
    return out


def extract(pages: DataFrame, net: Labeller, html_col: str = "html") -> DataFrame:
    """page_id, url, text (the main text) and n_chars (its code points) of every page."""
    spark = pages.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(net)  # a model of fixed size
    base = pages.select("page_id", "url", F.col(f"`{html_col}`").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = text_bytes(batch.column(2))
            for lo, hi in chunks(offsets):
                texts = main_texts(shared.value, [h or "" for h in batch.column(2).slice(lo, hi - lo).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(texts, pa.string()),
                                                  pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema.fields[:2])
    return base.mapInArrow(run, f"{kind}, text string, n_chars bigint")
