"""License notices by conditional compression.

Paragraphs (lines between blank ones) with a license trigger are the candidate blocks. Each is compressed alone and with
every notice's wording as a raw zstandard dictionary, and the notices are ranked by the bytes that this saves. In that order they are
confirmed by exact differences of words, however those are wrapped: a notice is confirmed on a span of the block if nearly all
its words stand there in order, all its telling words (versions, and words that part one license from
another) among them, with no other telling word and not more words than its own between. A winner takes its spans, and the next in rank may
only take what is left, until no notice is. None is left out by its rank; those whose words the block lacks in any order are passed over.

Defined results: NULL and empty texts have no findings; trigger lines that no confirmed notice touches are returned
without a license, joined where they follow each other; repeated rows each have their findings; a line may be of
any length. Other columns are ignored.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.common import keyed_text, ship, stored

TRIGGER = (r"(?i)licen[cs]e|copyright|all rights reserved|public domain|redistribut|permission (?:is hereby|to use)"
           r"|warrant(?:y|ies)|creative commons|\bcc[ -](?:by|0)|spdx|released under")
# The same where a phrase may be wrapped, with comment signs before its next line.
WRAPPED = (r"(?i)licen[cs]e|copyright|all\W+rights\W+reserved|public\W+domain|redistribut|permission\W+(?:is\W+hereby|to\W+use)"
           r"|warrant(?:y|ies)|creative\W+commons|\bcc\W+(?:by|0)|spdx|released\W+under")

# Wordings of public license notices, by SPDX identifier.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
            "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
                   "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                         "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                         "option) any later version."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
                     "the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 into the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("LicenseRef-all-rights-reserved", "All rights reserved."),
)
# Words that part one license from another; so do numbers.
TELLING = frozenset("mit apache gnu gpl lgpl agpl lesser affero general mozilla mpl bsd isc cc cc0 by sa nc nd creative commons "
                    "attribution noncommercial noderivatives sharealike unencumbered reserved".split())
MAX_MISSING = 0.15
LEVEL = 3

_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
_WRAPPED = re.compile(WRAPPED, re.ASCII)
_LACK = 1 << 20


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def fold(text: str) -> bytes:
    """What is compressed: case and the width of white space say nothing about the license."""
    return " ".join(text.lower().split()).encode()


def telling(word: str) -> bool:
    return word in TELLING or word[0].isdigit()


class Notices:
    """The notices with their dictionaries; a worker builds them once."""

    def __init__(self, notices: tuple[tuple[str, str], ...]) -> None:
        self.notices = notices
        self.words = [words_of(t) for _, t in notices]
        self.bags = [Counter(w) for w in self.words]
        self.spare = [int(MAX_MISSING * len(w)) for w in self.words]
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.given = [zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(
            fold(t), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for _, t in notices]

    def rank(self, block: str) -> list[tuple[float, int]]:
        """(share of compressed bytes that the notice saves, notice), the largest first."""
        raw = fold(block)
        alone = len(self.plain.compress(raw))
        return sorted(((1 - len(c.compress(raw)) / alone, k) for k, c in enumerate(self.given)), key=lambda x: (-x[0], x[1]))

    def differences(self, notice: int, block: list[str]) -> tuple[list[str], list[str]]:
        """(words of the notice that the block lacks, words of the block between those it has)."""
        want = self.words[notice]
        same = [m for m in difflib.SequenceMatcher(None, want, block, autojunk=False).get_matching_blocks() if m.size]
        if not same:
            return list(want), []
        has = {m.a + k for m in same for k in range(m.size)}
        used = {m.b + k for m in same for k in range(m.size)}
        inside = range(same[0].b, same[-1].b + same[-1].size)
        return [w for i, w in enumerate(want) if i not in has], [block[i] for i in inside if i not in used]

    def fits(self, notice: int, has: Counter) -> bool:
        """Whether so many words can hold the notice, in whatever order."""
        spare = self.spare[notice]
        for w, n in self.bags[notice].items():
            lack = n - has[w]
            if lack > 0:
                spare -= lack
                if spare < 0 or telling(w):
                    return False
        return True

    def align(self, notice: int, block: list[str]) -> tuple[list[str], list[str], int] | None:
        """(words lacking, words between, words spanned) where the notice is confirmed from the block's first word on:
        the fewest lacking, then the fewest between."""
        want = self.words[notice]
        n = len(want)
        tail = [0] * (n + 1)  # the cost of lacking all words from here on; none if one is telling
        for i in range(n - 1, -1, -1):
            tail[i] = None if tail[i + 1] is None or telling(want[i]) else tail[i + 1] + _LACK
        column: list[tuple | None] = [None] * (n + 1)  # by words of the notice passed: (cost, path of (place, place in block))
        best = None
        for j, word in enumerate(block):
            new: list[tuple | None] = [None] * (n + 1)
            if j and not any(column):
                break
            for i in range(n):
                if want[i] == word:
                    if j == 0:
                        if not any(map(telling, want[:i])) and (new[i + 1] is None or i * _LACK < new[i + 1][0]):
                            new[i + 1] = (i * _LACK, (i, 0, None))
                    elif column[i] is not None and (new[i + 1] is None or column[i][0] < new[i + 1][0]):
                        new[i + 1] = (column[i][0], (i, j, column[i][1]))
                    if new[i + 1] is not None and tail[i + 1] is not None and new[i + 1][1][:2] == (i, j):
                        whole = new[i + 1][0] + tail[i + 1]
                        if best is None or whole < best[0]:
                            best = (whole, new[i + 1][1])
            if j and not telling(word):
                for i in range(n + 1):
                    if column[i] is not None and (new[i] is None or column[i][0] + 1 < new[i][0]):
                        new[i] = (column[i][0] + 1, column[i][1])
            for i in range(n):
                if new[i] is not None and not telling(want[i]) and (new[i + 1] is None or new[i][0] + _LACK < new[i + 1][0]):
                    new[i + 1] = (new[i][0] + _LACK, new[i][1])
            column = new
        if best is None:
            return None
        has, used, path = set(), set(), best[1]
        end = path[1] + 1
        while path is not None:
            has.add(path[0])
            used.add(path[1])
            path = path[2]
        lacks, adds = [w for i, w in enumerate(want) if i not in has], [block[j] for j in range(end) if j not in used]
        return (lacks, adds, end) if len(lacks) <= self.spare[notice] and len(adds) <= n else None

    def spans(self, notice: int, words: list[str], places: dict[str, list[int]], taken: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
        """(first word, word behind, differences) of the notice in the words; spans do not overlap those taken nor each other, the closest stay."""
        want, found = self.words[notice], []
        for s in sorted({p for w in set(want[:self.spare[notice] + 1]) for p in places.get(w, ())}):
            window = words[s:s + 2 * len(want)]
            if self.fits(notice, Counter(window)) and (hit := self.align(notice, window)):
                lacks, adds, length = hit
                if any(a < s + length and s < b for a, b in taken):
                    continue
                found.append((len(lacks) + len(adds), s, s + length, " ".join([*(f"-{w}" for w in lacks), *(f"+{w}" for w in adds)])))
        return [f[1:] for f in apart(sorted(found), lambda f: f[1:3])]

    def confirmed(self, text: str) -> list[tuple[int, int, int, float, str]]:
        """(first place, last place, notice, saving, differences) of every notice in a lower-case text."""
        at = [m.span() for m in _WORD.finditer(text)]
        words = [text[a:b] for a, b in at]
        places: dict[str, list[int]] = {}
        for p, w in enumerate(words):
            places.setdefault(w, []).append(p)
        has = Counter({w: len(p) for w, p in places.items()})
        # the notices in the order of what their dictionaries save of the whole block; each takes the spans that the ones before left
        found, taken = [], []
        for _, k in self.rank(text):
            if not self.fits(k, has):
                continue
            for s, e, differences in self.spans(k, words, places, taken):
                raw = fold(text[at[s][0]:at[e - 1][1]])
                taken.append((s, e))
                found.append((s, e, k, 1 - len(self.given[k].compress(raw)) / len(self.plain.compress(raw)), differences))
        return [(at[s][0], at[e - 1][1] - 1, k, saving, differences) for s, e, k, saving, differences in sorted(found)]

    def findings(self, text: str) -> list[tuple[int, int, str | None, float, str]]:
        """(first line, last line, license or None, saving, differences) of a whole text, lines counted from 0."""
        out, lines = [], text.split("\n")
        for lo, hi in paragraphs(lines):
            part = "\n".join(lines[lo:hi]).lower()
            marked = [m.span() for m in _WRAPPED.finditer(part)]
            if not marked:
                continue
            edges = [0, *(m.end() for m in re.finditer("\n", part))]

            def line(place: int) -> int:
                return bisect_right(edges, place) - 1

            free = {k for a, b in marked for k in range(line(a), line(b - 1) + 1)}
            for a, z, k, saving, differences in self.confirmed(part):
                out.append((lo + line(a), lo + line(z), self.notices[k][0], saving, differences))
                free.difference_update(range(line(a), line(z) + 1))
            for first in sorted(k for k in free if k - 1 not in free):
                last = first
                while last + 1 in free:
                    last += 1
                block = "\n".join(lines[lo + first:lo + last + 1])
                saving, k = self.rank(block)[0]
                lacks, adds = self.differences(k, words_of(block))
                out.append((lo + first, lo + last, None, saving, " ".join([*(f"-{w}" for w in lacks), *(f"+{w}" for w in adds)])))
        return out


def apart(found: list[tuple], span) -> list[tuple]:
    """Those that overlap none before them, in their order."""
    starts: list[int] = []
    ends: list[int] = []
    out = []
    for f in found:
        s, e = span(f)
        i = bisect_right(starts, s)
        if (i == 0 or ends[i - 1] <= s) and (i == len(starts) or starts[i] >= e):
            starts.insert(i, s)
            ends.insert(i, e)
            out.append(f)
    return out


def paragraphs(lines: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of lines between blank ones."""
    lo = None
    for k, line in enumerate(lines):
        if line.strip():
            lo = k if lo is None else lo
        elif lo is not None:
            yield lo, k
            lo = None
    if lo is not None:
        yield lo, len(lines)


def find_notices(docs: DataFrame, notices: tuple[tuple[str, str], ...] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per notice and per run of trigger lines without one: doc_id, first_line, last_line, license (NULL for
    the latter), saving and differences."""
    ship(docs.sparkSession)
    # the few texts with a trigger are kept, so that all texts are read once
    text = stored(keyed_text(docs, id_col, text_col).where(F.col("text").rlike(WRAPPED)).withColumn("row", F.sha2("text", 256)), "triggers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from rollbook.llm.licenses import Notices

        findings = Notices(notices).findings
        for batch in batches:
            for k, t in enumerate(batch.column(1).to_pylist()):
                found = findings(t)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[k].as_py()] * len(found)), *(
                        pa.array([f[i] for f in found], kind) for i, kind in enumerate(
                            (pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string())))],
                        ["of", "first_line", "last_line", "license", "saving", "differences"])

    found = text.groupBy("row").agg(F.first("text").alias("text")).mapInArrow(
        run, "of string, first_line int, last_line int, license string, saving double, differences string")
    return text.select("doc_id", "row").join(found, F.col("row") == F.col("of")).select(
        "doc_id", "first_line", "last_line", "license", "saving", "differences")
