"""Language identification: held-out accuracy, gradients, and defined results."""

import numpy as np
from llm_fixtures import SF_MID, edge_docs, no_docs  # noqa: F401
from pyspark.sql import functions as F

from rollbook.llm import langid as L


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    found = L.predict(docs, L.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id")
    r = found.where(L.held_out(F.col("doc_id"))).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert r[0] >= 0.97 and 0 <= r[1] and r[2] <= 1


def test_prediction_ignores_everything_but_the_text(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    net = L.fit(docs)
    one = docs.limit(40)
    other = one.select((F.col("doc_id") + 1000).alias("doc_id"), "text", F.lit("xx").alias("lang"), F.lit(1).alias("score"))
    a = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.predict(one, net).collect()}
    b = {r["doc_id"] - 1000: (r["lang_pred"], r["score"]) for r in L.predict(other, net).collect()}
    assert a == b


def test_defined_results(spark, edge_docs, no_docs):
    net = L.train(["the and of " * 30, "der die und " * 30], ["en", "de"])
    got = {(r["doc_id"], r["lang_pred"] == L.UNKNOWN, r["score"] == 0) for r in L.predict(edge_docs, net).collect()}
    assert {(1, True, True), (2, True, True), (6, True, True)} <= got and (0, False, False) in got
    assert L.predict(no_docs, net).collect() == []
    assert all(r["lang_pred"] == L.UNKNOWN for r in L.predict(edge_docs, None).collect())
    assert L.fit(no_docs) is None and L.keep_identified(no_docs).collect() == []
    kept = L.keep_identified(edge_docs, min_score=0.0, with_other=False)
    assert kept.columns == edge_docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["0", "3", "3", "4", "None", "5", "7"])


def test_gradients():
    rng = np.random.default_rng(1)
    net = L.train(["abcabc" * 60, "xyzxyz" * 60], ["a", "b"], seed=3)
    x, y = rng.integers(97, 123, (5, L.WINDOW)).astype(np.uint8), np.array([0, 1, 0, 1, 1])
    loss = lambda: -np.log(net.windows(x, net.tables())[np.arange(5), y]).mean()
    params = [net.embedding, *net.filters, *net.biases, net.out, net.out_bias]
    for p, g in zip(params, L._gradients(net, x, y)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        keep, h = p[at], 1e-2
        p[at] = keep + h
        up = loss()
        p[at] = keep - h
        down = loss()
        p[at] = keep
        assert abs((up - down) / (2 * h) - g[at]) < 0.05 * max(abs(g[at]), 0.02)


def test_windows_cover_long_texts_whole(spark):
    """A language that only the end of a long text speaks still counts."""
    net = L.train(["the and of that " * 40, "der die und nicht " * 40], ["en", "de"])
    docs = spark.createDataFrame([(1, "the and of that " * 50 + "der die und nicht " * 3000)], "doc_id bigint, text string")
    assert L.predict(docs, net).first()["lang_pred"] == "de"


def plain_scores(net, text):
    """Window by window and letter by letter, in loops."""
    raw = text.encode()
    total, weight = np.zeros(len(net.languages)), 0
    for at in range(0, len(raw), L.WINDOW):
        cut = bytes(b + 32 if 65 <= b <= 90 else b for b in raw[at:at + L.WINDOW]).ljust(L.WINDOW, b" ")
        pooled = []
        for w, f, bias in zip(L.WIDTHS, net.filters, net.biases):
            rows = [np.concatenate([net.embedding[b] for b in cut[k:k + w]]) @ f for k in range(len(cut) - w + 1)]
            pooled.append(np.maximum(np.max(rows, axis=0) + bias, 0))
        z = np.exp(np.concatenate(pooled) @ net.out + net.out_bias)
        starts = [k for k in range(at, min(at + L.WINDOW, len(raw))) if raw[k] & 0xC0 != 0x80]
        letters = sum(c.isalpha() for c in text[len([k for k in range(at) if raw[k] & 0xC0 != 0x80]):][:len(starts)])
        total, weight = total + letters * z / z.sum(), weight + letters
    return total / max(weight, 1)


def test_labels_against_a_plain_forward_pass():
    import pyarrow as pa

    net = L.train(["the and of that " * 20, "der die und nicht " * 20, "le la les des " * 20], ["en", "de", "fr"])
    texts = ["short one", "Der Hund und die Katze. " * 30, "le chat — des étés, ÉTÉ 123 " * 15, "the end of it 日本語 " * 20]
    names, score = L.label(pa.array(texts), net, net.tables())
    for t, n, s in zip(texts, names, score):
        want = plain_scores(net, t)
        assert n == net.languages[int(want.argmax())] and abs(s - want.max()) < 1e-4


UNLEARNED = [
    "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, che la diritta via era smarrita. " * 3,
    "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему. " * 3,
    "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。" * 5,
    "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a08 " * 6,
    "function a(b,c){var d=b.e,f=0;for(;f<c.length;f++)d[f]=c[f]&&b(g);return d}var h=function(){return a(h,[1,2])};" * 3,
    "TWFuIGlzIGRpc3Rpbmd1aXNoZWQsIG5vdCBvbmx5IGJ5IGhpcyByZWFzb24sIGJ1dCBieSB0aGlz" * 4]


def test_texts_of_no_learned_language_go_and_clean_ones_stay(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    planted = spark.createDataFrame([(10_000 + k, t, None, "x", len(t)) for k, t in enumerate(UNLEARNED)], docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    kept = {r["doc_id"]: r["lang"] for r in L.keep_identified(docs.select(*planted.columns).union(planted)).collect()}
    whole = docs.where("text is not null and text <> ''").count()
    assert sum(d < 10_000 for d in kept) >= 0.99 * whole
    assert not [d for d in kept if d >= 10_000]
