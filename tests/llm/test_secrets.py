"""Secret scan against Python's re, and the ledger's increments."""

import random
import re

from llm_fixtures import edge_docs, no_docs  # noqa: F401

from rollbook.llm import secrets as S
from rollbook.session import scratch_path


def brute(text):
    text, out = text or "", []
    for rank, r in enumerate(S.RULES):
        out += [(m.start(), rank, r.kind, m.end()) for m in re.finditer(r.pattern, text) if len(m.group(r.group)) >= r.least]
    return sorted(out)


def test_brute_force(spark, edge_docs):
    rnd = random.Random(4)
    parts = ["password", "PassWD", "secret", "token", "api_key", "apikey", "APIKEY", "=", " = ", ":", '"', "'", "AKIA", "AKIA" + "Z9" * 8, "deadbeef" * 3, "abc123", "x",
             " ", "é", "🙂", "\n", "==", "0123456789abcdef01234567", "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "ghp_" + "a" * 36, "xoxb-1234567890-a", "ſecret=abcdef"]
    rows = [(k, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))) for k in range(300)] + [(1000, None), (1001, ""), (1002, "token=" + "f" * 50_000), (None, "token=abcdef"), (5, "a" * 24)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((str(r["doc_id"]), [tuple(s) for s in r["spans"]]) for r in S.find_secrets(docs).collect())
    assert got == sorted((str(i), brute(t)) for i, t in rows)
    assert S.find_secrets(edge_docs).count() == edge_docs.count()


def test_ledger_scans_only_what_is_new(spark):
    path = scratch_path(spark, "ledger")
    one = spark.createDataFrame([(1, "token=abcdef"), (2, "token=abcdef"), (3, "nothing")], "doc_id bigint, text string")
    assert S.update_ledger(one, path).count() == 2 * len(S.RULES)
    assert S.update_ledger(one, path).count() == 2 * len(S.RULES)                       # nothing is scanned again
    two = one.union(spark.createDataFrame([(4, "AKIA" + "A" * 16)], "doc_id bigint, text string"))
    newer = (*S.RULES[1:], S.Rule("assign", S.RULES[0].pattern, 2, 3, version=2))
    assert S.update_ledger(two, path, newer).count() == 2 * len(S.RULES) + len(newer) + 2  # a new blob, and a new version for two
    found = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in S.find_secrets(two, path, newer).collect()}
    assert found == {1: ["assign"], 2: ["assign"], 3: [], 4: ["access"]}


def test_a_repeated_append_doubles_nothing(spark):
    path = scratch_path(spark, "ledger")
    docs = spark.createDataFrame([(1, "token=abcdef " + "a1" * 15), (2, "AKIA" + "B" * 18), (3, None)], "doc_id bigint, text string")
    once = sorted(map(str, S.find_secrets(docs, path).collect()))
    rows = spark.createDataFrame(S.read_ledger(spark, path).collect(), S.LEDGER_SCHEMA)
    rows.write.mode("append").parquet(path)  # the retry of a writer that had already appended
    assert sorted(map(str, S.find_secrets(docs, path).collect())) == once
    assert sorted(map(str, S.redact_secrets(docs, path).collect())) == sorted(map(str, S.redact_secrets(docs).collect()))


def test_redaction_keeps_everything_else(spark, no_docs):
    docs = spark.createDataFrame([(1, "a token=abcdef0123456789abcdef0123 b password: hunter22 c", "t"), (2, "clean", "u"), (3, None, None), (2, "clean", "u")],
                                 "doc_id bigint, text string, blob string")
    got = sorted(map(tuple, S.redact_secrets(docs).collect()), key=str)
    assert got == sorted([(1, "a [SECRET] b [SECRET] c", "t"), (2, "clean", "u"), (2, "clean", "u"), (3, None, None)], key=str)
    assert S.redact_secrets(no_docs).collect() == []
