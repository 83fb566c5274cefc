"""Conversation repair: the search against all edit sequences, whole results against a plain version, pieces, awkward rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from llm_fixtures import SF_SMALL
from pyspark.sql import functions as F

from rollbook.llm import queries_structure as Q
from rollbook.llm import repair as R

COLUMNS = ("conv_id", *R.RESULT)
SCHEMA = "conv_id bigint, turn bigint, role string, text string, audit string, part int"


def all_audits(rows, longest):
    """Every audit with up to two insertions in a row: (cost, audit, repaired initials) of those that give legal roles."""
    found = []
    inserts = ["", "I", "II"]
    for letters in itertools.product("DKR", repeat=len(rows)):
        for gaps in itertools.product(inserts, repeat=len(rows) + 1):
            audit = gaps[0] + "".join(x + g for x, g in zip(letters, gaps[1:]))
            if len(audit) > longest:
                continue
            for fills in itertools.product("ua", repeat=sum(x in "RI" for x in audit)):
                fill, at, cost, out, bad = iter(fills), 0, 0, "", False
                for x in audit:
                    if x == "I":
                        cost, out = cost + 2, out + next(fill)
                        continue
                    initial, forced, cut = rows[at]
                    at += 1
                    bad |= forced and x != "D"
                    cost += {"K": 0, "R": 2, "D": 3}[x] + (cut and x != "D")
                    out += {"K": initial or "?", "D": "", "R": ""}[x]
                    if x == "R":
                        out += next(fill)
                if not bad and re.fullmatch("(s?(ua)+)?", out):
                    found.append((cost, audit))
    return min(found)


def test_search_against_every_edit_sequence():
    rng = random.Random(0)
    for n in range(4):
        for initials in itertools.product(["s", "u", "a", ""], repeat=n):
            rows = [(x, rng.random() < 0.15, rng.random() < 0.3) for x in initials]
            assert R.search(rows) == all_audits(rows, 6), rows


def cheapest(rows):
    """(cost, audit) by one pass over the rows: the least for each sequence state."""
    def fill(best):
        for _ in range(2):
            for q, (c, a) in list(best.items()):
                to = R.FILL[q]
                best[to] = min(best.get(to, (R.NEVER, "")), (c + 2, a + "I"))
        return best

    best = fill({R.START: (0, "")})
    for initial, forced, cut in rows:
        new = {}
        for q, (c, a) in best.items():
            ways = [("D", 3, q)]
            if not forced:
                ways.append(("R", 2 + cut, R.FILL[q]))
            if not forced and initial in R.STEP[q]:
                ways.append(("K", cut, R.STEP[q][initial]))
            for x, more, to in ways:
                new[to] = min(new.get(to, (R.NEVER, "")), (c + more, a + x))
        best = fill(new)
    return min(best[q] for q in R.ENDS if q in best)


def test_search_on_long_conversations():
    rng = random.Random(1)
    for n in (10, 60, 400):
        for _ in range(10):
            rows = [(rng.choice("ua") if rng.random() < 0.2 else "ua"[k % 2], rng.random() < 0.1, rng.random() < 0.1) for k in range(n)]
            assert R.search(rows) == cheapest(rows)


def expected(rows):
    """Plain version of the whole query."""
    groups = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        of = groups[conv]
        role, text = role if role is not None else " ", text if text is not None else " "
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if lot == 0:
            continue
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        role = "user" if lot == 4 else role
        of += [(turn, role, text)] * (2 if lot == 3 else 1)
    out = []
    for conv, of in groups.items():
        digest = lambda r: hashlib.sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()
        of.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), digest(r)))
        seen, problem, blank, dup, cut = set(), [], 0, 0, 0
        for _, role, text in of:
            kept = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "b" if not kept else "d" if (role, text) in seen else "t" if kept[-1] not in ".!?" else ""
            seen.add((role, text))
            blank, dup, cut = blank + (fault == "b"), dup + (fault == "d"), cut + (fault == "t")
            problem.append((role[:1], fault in ("b", "d"), fault == "t"))
        turns = [t for t, *_ in of if t is not None]
        cost, audit = cheapest(problem)
        repaired = R.apply(audit, [(r, t) for _, r, t in of])
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in repaired))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(problem, problem[1:]))
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, blank, dup, cut, illegal, cost, audit,
                    hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def sample(n, seed):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, rng.choice([None, turn, turn, turn * 2]), rng.choice([None, "", "system", "user", "assistant", "user", "assistant", "User", "x"]),
                         rng.choice([None, "", " \n", "Yes.", "Same.", f"Text {turn}.", f"No end {conv}", "Ünï! \t", "ends。"]), "clash", 3))
    return rows + rows[:7]


def test_whole_query_against_a_plain_version(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = Q.op12_conversation_repair(spark, SF_SMALL)
    assert got.columns == list(COLUMNS)
    assert result(got) == expected(table)


@pytest.mark.parametrize("partitions", [1, 5, 40])
def test_awkward_rows(spark, partitions, monkeypatch):
    rows = sample(25, partitions)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, SCHEMA)
        assert result(R.repair_all(Q.damaged(df), df)) == expected(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_one_conversation_over_many_partitions(spark):
    """A third of all rows in one conversation, dealt over partitions and put together again."""
    rng = random.Random(4)
    hot = [(7, t, rng.choice(["user", "assistant"]) if t % 5 == 0 else ("user", "assistant")[t % 2], rng.choice(["Same.", f"Turn {t}.", f"cut {t}"]), "", 0) for t in range(600)]
    hot += [(7, 90, "user", "again and again.", "", 0)] * 60
    rows = hot + [r for r in sample(150, 9) if r[0] != 7]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, SCHEMA)
        assert result(R.repair_all(Q.damaged(df), df)) == expected(rows)
        lines = R.repaired_rows(df.where("conv_id = 7")).orderBy("part", "line_no").collect()
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in lines))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_empty_and_very_long(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert R.repair_all(Q.damaged(none), none).collect() == []
    rows = [(1, 0, "user", "word " * 100_000 + ".", "", 0), (1, 1, "assistant", "x" * 300_000, "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = R.repair(df.withColumn("turn", F.col("turn"))).collect()
    assert [(r["audit"], r["cost"], r["truncated"]) for r in got] == [("KK", 1, 1)]


def test_sql_agrees_on_awkward_rows():
    rows = sample(25, 3)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [r[:4] for r in rows])
    assert sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({Q.OP12_SQL})").fetchall(), key=repr) == expected(rows)
