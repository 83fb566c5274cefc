"""License notices: known notices, near misses, runs of lines, and the whole table against a plain loop."""

import random
import re
import textwrap
from itertools import combinations

import pytest
from llm_fixtures import SF_SMALL, edge_docs, no_docs  # noqa: F401

from rollbook.llm import licenses as C

TRIGGER = re.compile(C.TRIGGER)


def blocks(text):
    out, run = [], []
    for i, line in enumerate((text or "").split("\n")):
        if TRIGGER.search(line):
            if run and run[-1][0] == i - 1:
                run.append((i, line))
            else:
                run and out.append(run)
                run = [(i, line)]
    run and out.append(run)
    return [(r[0][0], r[-1][0], "\n".join(x for _, x in r)) for r in out]


def test_notices_and_near_misses():
    findings = C.Notices(C.NOTICES).findings
    names = lambda text: [f[2] for f in findings(text)]
    for name, text in C.NOTICES:
        assert names(text) == [name] and names("\n" + text.upper()) == [name]
    assert names("This work is licensed under the GNU General Public License, version 2.") == ["GPL-2.0-only"]
    assert names("This work is licensed under the GNU Lesser General Public License, version 3.") == ["LGPL-3.0-only"]
    (found,) = findings("This work is licenced under the GNU General Public License, version 3.")
    assert found[2] == "GPL-3.0-only" and found[4] == "-licensed +licenced"
    for other in ("Licensed under CC BY-NC 3.0.", "You need a driving license for this.", "licence", "This work is licensed under the GNU General Public License, version 9."):
        assert names(other) == [None]


def test_rank_chooses_and_loses_nothing():
    """Of two notices that fit the same words the one whose dictionary saves more takes them; the other keeps its own elsewhere."""
    long = "Permission is granted to anyone to copy this little program and its papers freely."
    short = "Permission is granted to anyone to copy this little program"
    pair = C.Notices((("Short", short), ("Long", long)))
    alone = lambda text: [(f[2], f[4]) for f in pair.findings(text + "\nlicense")if f[2]]
    assert [k for _, k in pair.rank(long.lower())][0] == 1
    assert alone(long) == [("Long", "")]
    assert alone(short + ".") == [("Short", "")]
    assert sorted(alone(f"{long} And then: {short}, they said.")) == [("Long", ""), ("Short", "")]
    every = C.Notices(C.NOTICES)
    rnd = random.Random(6)
    for _ in range(60):  # paragraphs of several notices: each stands in the result, whatever its rank
        some = rnd.sample(C.NOTICES, rnd.randint(1, 4))
        got = [f[2] for f in every.findings(" And so on it goes. ".join(t for _, t in some))]
        assert sorted(got, key=str) == sorted((n for n, _ in some), key=str)


@pytest.mark.parametrize("width", [72, 80])
@pytest.mark.parametrize("sign", ["", "# ", " * "])
def test_wrapped_notices(spark, width, sign):
    """Every notice is found whole on its lines, wrapped inside a longer text."""
    rows, want = [], []
    for k, (name, notice) in enumerate(C.NOTICES):
        before, behind = "Some words stand before it in the paragraph.", "More words come behind it there."
        body = textwrap.wrap(f"{before} {notice} {behind}", width - len(sign), break_long_words=False, break_on_hyphens=False)
        text = "\n".join((sign + x).rstrip() if x else "" for x in ["Title", "", *body, "", "The last line."])
        rows.append((k, text))
        ends = [0]
        for x in body:
            ends.append(ends[-1] + len(C.words_of(x)))
        a = len(C.words_of(before))
        z = a + len(C.words_of(notice)) - 1
        want.append((k, 2 + next(i for i, e in enumerate(ends[1:]) if a < e), 2 + next(i for i, e in enumerate(ends[1:]) if z < e), name, ""))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["first_line"], r["last_line"], r["license"], r["differences"]) for r in C.find_notices(docs).collect() if r["license"])
    assert got == want


def test_every_notice_of_a_block(spark):
    """Neither long neighbours that share a notice's wording nor a second notice hide one."""
    near = ["This program is distributed without any warranty; you can redistribute it under the terms of the GNU license as published.",
            "This Source Code Form is subject to the terms of a license; you may not use this file except in compliance with the license."]
    short = "All rights reserved."
    notices = C.Notices(C.NOTICES)
    assert [k for _, k in notices.rank("\n".join([*near, short]))].index([t for _, t in C.NOTICES].index(short)) >= 4
    docs = spark.createDataFrame([(1, "\n".join([*near, short])), (2, "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY 4.0.\nLicensed under CC BY-NC 3.0."),
                                  (3, "All rights reserved. All rights reserved."), (3, "All rights reserved. All rights reserved."),
                                  (None, "Licensed under CC BY 4.0 and\nreleased under the MIT License."), (4, C.NOTICES[3][1]), (5, None), (6, ""), (7, "a\n\nb"),
                                  (8, "All rights\n\nreserved.")], "doc_id bigint, text string")
    got = sorted((str(r["doc_id"]), r["first_line"], r["last_line"], str(r["license"])) for r in C.find_notices(docs).collect())
    assert got == [("1", 0, 1, "None"), ("1", 2, 2, "LicenseRef-all-rights-reserved"), ("2", 0, 0, "Apache-2.0"), ("2", 1, 1, "CC-BY-4.0"), ("2", 2, 2, "None"),
                   *[("3", 0, 0, "LicenseRef-all-rights-reserved")] * 4, ("4", 0, 0, "Apache-2.0"), ("None", 0, 0, "CC-BY-4.0"), ("None", 1, 1, "MIT")]


def test_whole_table_of_notices(spark, edge_docs, no_docs):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").union(edge_docs.select("doc_id", "text"))
    findings = C.Notices(C.NOTICES).findings
    want = sorted((str(r["doc_id"]), a, b, str(name), str(s), d) for r in docs.collect() for a, b, name, s, d in findings(r["text"] or ""))
    got = sorted((str(r["doc_id"]), r["first_line"], r["last_line"], str(r["license"]), str(r["saving"]), r["differences"]) for r in C.find_notices(docs).collect())
    assert got == want and got
    marked = {(str(r["doc_id"]), k) for r in docs.collect() for a, b, _ in blocks(r["text"]) for k in range(a, b + 1)}
    assert marked <= {(i, k) for i, a, b, *_ in got for k in range(a, b + 1)}
    assert C.find_notices(no_docs).collect() == []


def test_alignment_against_all_subsets():
    """The fewest words lacking, then the fewest between, among all ways to lay a notice over the words."""
    rnd = random.Random(4)
    notices = C.Notices((("X", "a b a c 1 d e a f g b h k c"),))
    want = notices.words[0]

    def brute(block):
        best = None
        for gone in (g for n in range(notices.spare[0] + 1) for g in combinations(range(len(want)), n)):
            if any(C.telling(want[i]) for i in gone):
                continue
            kept = [w for i, w in enumerate(want) if i not in gone]
            if kept[0] != block[0]:
                continue
            ends = {0}
            for w in kept[1:]:  # a telling word may not be passed over
                ends = {j for e in ends for j in range(e + 1, len(block)) if block[j] == w and not any(map(C.telling, block[e + 1:j]))}
            for e in ends:
                best = min(best or (99, 99), (len(gone), e + 1 - len(kept)))
        return best if best and best[1] <= len(want) else None

    seen = 0
    for _ in range(400):
        block = list(want)
        for _ in range(rnd.randrange(6)):
            k = rnd.randrange(len(block))
            block[k:k + rnd.randrange(2)] = rnd.choice([[], ["x"], ["a"], ["c", "b"], ["2"]])
        block = block[:2 * len(want)]
        hit = notices.align(0, block)
        assert (hit and (len(hit[0]), len(hit[1]))) == brute(block)
        seen += hit is not None
    assert 50 < seen < 390
