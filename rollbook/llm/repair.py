"""Repair of conversation structure by depth-first branch-and-bound.

A conversation's rows, by turn, are to give the roles ``(system? (user assistant)+)?`` by the cheapest edits:
Keep a row (K, 0), Rerole it to user or assistant (R, 2), Delete it (D, 3), Insert an empty user or assistant turn
anywhere (I, 2). Blank rows and duplicates must go; a truncated row that stays adds 1. The audit is the edits' letters in order;
of equally cheap repairs the one whose audit sorts least is taken.

The search walks prefixes of edits on an explicit stack. A node is (next row, state of the roles). Edits are tried in
the order of their letters, so prefixes come in the order of their audits, and of two prefixes that reach a node at equal
cost the first has the lesser audit: a node's table entry is the least cost that has reached it, and prefixes
that don't better it are cut. So are those whose cost and suffix bound pass the limit or don't better the incumbent (cost, audit).
Suffix bounds are the cheapest completions of each suffix from each state when audits are ignored. The limit starts at the
bound of the whole; an incumbent of that cost is proved to be the best, else the limit is raised.

Rows are range-partitioned by conversation, turn, role and digest of the text, so a conversation lies in one partition or
in consecutive ones. Those inside a partition are solved as it streams by. The first and the last of each may go on in others: their
rows are set aside, every (conversation, partition) is a piece that is solved from each state to each state, and pieces are put together in
order. So no task holds more rows than a partition, whatever the size of a conversation; its audit, one cell of the result,
is what grows with it. Texts of such conversations are hashed in a stream.

Defined results: NULL roles and texts are read as one space. Rows are ordered by turn, NULL first, then by role and the digest of the text; rows that
repeat altogether are duplicates from the second on. A NULL conv_id is a conversation like others. A role whose first letter is not
s, u or a, an empty one too, can't be kept. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from rollbook.llm.common import ship, stored

SPACE = " \t\n\x0b\x0c\r"
#: What a role sequence has come to: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an initial, where it is legal.
STEP = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
#: The state after the one turn that may be inserted, or given to a row, there.
FILL = (USER, USER, ASSISTANT, USER)
ENDS = (START, ASSISTANT)
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
LEGAL = frozenset(("su", "ua", "au"))
NEVER = 1 << 60


def row_moves(initial: str, forced: bool, cut: bool, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits of one row, in the order of their letters."""
    moves = [("D", DELETE, state)]
    kept = None if forced else STEP[state].get(initial)
    if kept is not None:
        moves.append(("K", TRUNCATED * cut, kept))
    if not forced and kept != FILL[state]:  # to keep is cheaper than to give a row the role it has
        moves.append(("R", REROLE + TRUNCATED * cut, FILL[state]))
    return moves


def _relax(bound: list[int]) -> list[int]:
    """Lower a row of bounds by insertions: two lead from any state to any that insertions reach."""
    for _ in range(2):
        bound = [min(b, INSERT + bound[FILL[q]]) for q, b in enumerate(bound)]
    return bound


def suffix_bounds(rows: Sequence[tuple[str, bool, bool]], goals: Sequence[int]) -> list[list[int]]:
    """For each suffix and state the least cost that any completion has, audits ignored."""
    bounds = [_relax([0 if q in goals else NEVER for q in range(4)])]
    for initial, forced, cut in reversed(rows):
        after = bounds[-1]
        bounds.append(_relax([min(cost + after[to] for _, cost, to in row_moves(initial, forced, cut, q)) for q in range(4)]))
    bounds.reverse()
    return bounds


def search(rows: Sequence[tuple[str, bool, bool]], entry: int = START, goals: Sequence[int] = ENDS,
           bounds: list[list[int]] | None = None) -> tuple[int, str] | None:
    """The cheapest (cost, audit) that leads from ``entry`` over all rows to one of ``goals``; None if nothing does.

    Rows are (initial of the role, must be deleted, is truncated).
    """
    bounds = bounds or suffix_bounds(rows, goals)
    limit, end = bounds[0][entry], len(rows)
    while limit < NEVER:
        best: tuple[int, str] | None = None
        table: dict[tuple[int, int], int] = {}
        path: list[str] = []
        stack = [(0, 0, entry, 0, "")]  # depth, next row, state, cost, letter
        while stack:
            depth, at, state, cost, letter = stack.pop()
            total = cost + bounds[at][state]
            if total > limit or best is not None and total >= best[0] or table.get((at, state), NEVER) <= cost:
                continue
            table[at, state] = cost
            del path[max(depth - 1, 0):]
            if letter:
                path.append(letter)
            if at == end and state in goals:
                best = (cost, "".join(path))
                if cost == bounds[0][entry]:
                    return best
            moves = [("I", INSERT, FILL[state], at)]
            if at < end:
                moves += [(x, c, to, at + 1) for x, c, to in row_moves(*rows[at], state)]
            for x, c, to, nxt in sorted(moves, reverse=True):
                stack.append((depth + 1, nxt, to, cost + c, x))
        if best is not None:
            return best
        limit += 1
    return None


def apply(audit: str, rows: Sequence[tuple[str, str]], state: int = START) -> list[tuple[str, str]]:
    """The repaired (role, text) rows that an audit makes of (role, text) rows."""
    out, at = [], 0
    for letter in audit:
        if letter in "IR":
            out.append(("assistant" if FILL[state] == ASSISTANT else "user", rows[at][1] if letter == "R" else ""))
            state = FILL[state]
        elif letter == "K":
            out.append(rows[at])
            state = STEP[state][rows[at][0][:1]]
        at += letter != "I"
    return out


def _facts(rows: list[dict]) -> dict:
    """Counts and edges of consecutive rows of one conversation."""
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    initials = [r["role"][:1] for r in rows]
    return {"blank": sum(r["empty"] for r in rows), "duplicate": sum(r["again"] and not r["empty"] for r in rows),
            "truncated": sum(r["cut"] and not r["empty"] and not r["again"] for r in rows),
            "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), "n_turns": len(set(turns)),
            "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None, "first": initials[0], "last": initials[-1]}


def _problem(rows: list[dict]) -> list[tuple[str, bool, bool]]:
    return [(r["role"][:1], r["empty"] or r["again"], r["cut"]) for r in rows]


def _pairs(rows: list[dict]) -> list[tuple[str, str]]:
    return [(r["role"], r["text"]) for r in rows]


def _gaps(first: int | None, last: int | None, distinct: int) -> int:
    return 0 if first is None else min(last - first + 1 - distinct, 2**63 - 1)


def solve(rows: list[dict]) -> tuple[dict, list[tuple[str, str]]]:
    """Result and repaired rows of one conversation whose rows (turn, role, text, digest, empty, cut) are in order."""
    seen: set[bytes] = set()
    for r in rows:
        r["again"] = r["digest"] in seen
        seen.add(r["digest"])
    facts = _facts(rows)
    cost, audit = search(_problem(rows))
    out = apply(audit, _pairs(rows))
    return {"gaps": _gaps(facts["first_turn"], facts["last_turn"], facts["n_turns"]), **{c: facts[c] for c in COUNTS}, "cost": cost, "audit": audit,
            "repaired_sha256": sha256("\n".join(f"{role}:{text}" for role, text in out).encode()).hexdigest()}, out


COUNTS = ("blank", "duplicate", "truncated", "illegal")
RESULT = ("gaps", *COUNTS, "cost", "audit", "repaired_sha256")
RESULT_TYPES = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
PAIRS = "array<struct<role: string, text: string>>"


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{c: r.get(c) for c in schema.names} for r in rows], schema)


def _table(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches([_batch(rows, schema)])


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def _streamed(ordered: DataFrame, keep_rows: bool) -> DataFrame:
    """One pass over sorted partitions: results of the conversations inside, and the rows of the first and the last one (with part and nth)."""
    conv, turn = (ordered.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    ddl = f"conv_id {conv}, {RESULT_TYPES}, repaired {PAIRS}, turn {turn}, role string, text string, digest binary, empty boolean, cut boolean, part int, nth bigint"
    shape = _arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, nth, first, begun, now, held = TaskContext.get().partitionId(), 0, True, False, None, []

        def aside() -> list[dict]:
            nonlocal nth
            out = [{**r, "part": part, "nth": nth + k} for k, r in enumerate(held)]
            nth += len(out)
            held.clear()
            return out

        for batch in batches:
            out: list[dict] = []
            for r in batch.to_pylist():
                if begun and r["conv_id"] != now:
                    if first:
                        out += aside()
                    else:
                        found, repaired = solve(held)
                        pairs = [{"role": a, "text": b} for a, b in repaired] if keep_rows else None
                        out.append({"conv_id": now, **found, "repaired": pairs})
                    first, held = False, []
                begun, now = True, r["conv_id"]
                held.append(r)
            if first:  # may go on from the partition before: its rows leave as they come
                out += aside()
            yield _batch(out, shape)
        if held:
            yield _batch(aside(), shape)

    return ordered.mapInArrow(run, ddl)


def _pieced(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that may lie in several partitions: their results, and their repaired rows (conv_id, part, line_no, role, text)."""
    conv = rows.schema["conv_id"].dataType.simpleString()
    turn = rows.schema["turn"].dataType.simpleString()
    at = F.struct("part", "nth")
    earliest = rows.groupBy("conv_id", "digest").agg(F.min(at).alias("earliest")).select(F.col("conv_id").alias("c_"), F.col("digest").alias("d_"), "earliest")
    rows = stored(rows.join(earliest, F.col("conv_id").eqNullSafe(F.col("c_")) & (F.col("digest") == F.col("d_"))).withColumn(
        "again", at != F.col("earliest")).drop("c_", "d_", "earliest"), "pieces")
    facts = f"n_turns bigint, first_turn {turn}, last_turn {turn}, first string, last string, blank bigint, duplicate bigint, truncated bigint, illegal bigint"
    ways = f"conv_id {conv}, part int, {facts}, ways array<struct<entry: int, leave: int, cost: bigint, audit: string>>"
    chosen = f"conv_id {conv}, part int, entry int, steps string, {RESULT_TYPES}"
    lines = f"conv_id {conv}, part int, line_no bigint, role string, text string"
    hashed = f"c_ {conv}, hashed string"
    ways_shape, chosen_shape, lines_shape, hashed_shape = map(_arrow, (ways, chosen, lines, hashed))

    def piece(table: pa.Table) -> pa.Table:
        """The cheapest way through one piece from each state to each state."""
        of = table.sort_by("nth").to_pylist()
        problem, found = _problem(of), []
        for leave in range(4):
            bounds = suffix_bounds(problem, (leave,))
            for entry in range(4):
                way = search(problem, entry, (leave,), bounds)
                if way is not None:
                    found.append({"entry": entry, "leave": leave, "cost": way[0], "audit": way[1]})
        return _table([{"conv_id": of[0]["conv_id"], "part": of[0]["part"], **_facts(of), "ways": found}], ways_shape)

    def stitch(table: pa.Table) -> pa.Table:
        """The pieces of one conversation, in order: for each state reached the least (cost, audit) and the states it went through."""
        of = table.sort_by("part").to_pylist()
        best = {START: (0, "", ())}
        for p in of:
            reached: dict[int, tuple] = {}
            for w in p["ways"]:
                if w["entry"] in best:
                    cost, audit, through = best[w["entry"]]
                    way = (cost + w["cost"], audit + w["audit"], (*through, (w["entry"], w["audit"])))
                    if w["leave"] not in reached or way[:2] < reached[w["leave"]][:2]:
                        reached[w["leave"]] = way
            best = reached
        cost, audit, through = min((best[q] for q in ENDS if q in best), key=lambda w: w[:2])
        turned = [p for p in of if p["first_turn"] is not None]
        distinct = sum(p["n_turns"] for p in turned) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(turned, turned[1:]))
        result = {c: sum(p[c] for p in of) for c in COUNTS}
        result["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(of, of[1:]))
        result |= {"gaps": _gaps(turned[0]["first_turn"], turned[-1]["last_turn"], distinct) if turned else 0, "cost": cost, "audit": audit}
        return _table([{"conv_id": p["conv_id"], "part": p["part"], "entry": entry, "steps": steps, **(result if k == 0 else {})}
                       for k, (p, (entry, steps)) in enumerate(zip(of, through))], chosen_shape)

    def edit(left: pa.Table, right: pa.Table) -> pa.Table:
        of, way = left.sort_by("nth").to_pylist(), right.to_pylist()[0]
        repaired = apply(way["steps"], _pairs(of), way["entry"])
        return _table([{"conv_id": way["conv_id"], "part": way["part"], "line_no": k, "role": a, "text": b} for k, (a, b) in enumerate(repaired)], lines_shape)

    def hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, now, running = False, None, sha256()
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if begun and r["conv_id"] != now:
                    out.append({"c_": now, "hashed": running.hexdigest()})
                    running, begun = sha256(), False
                running.update(f"{chr(10) * begun}{r['role']}:{r['text']}".encode())
                begun, now = True, r["conv_id"]
            yield _batch(out, hashed_shape)
        if begun:
            yield _batch([{"c_": now, "hashed": running.hexdigest()}], hashed_shape)

    choice = stored(rows.groupBy("conv_id", "part").applyInArrow(piece, ways).groupBy("conv_id").applyInArrow(stitch, chosen), "ways")
    repaired = rows.groupBy("conv_id", "part").cogroup(choice.groupBy("conv_id", "part")).applyInArrow(edit, lines)
    hashes = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "part", "line_no").mapInArrow(hash_lines, hashed)
    found = choice.where(F.col("audit").isNotNull()).drop("repaired_sha256").join(hashes, F.col("conv_id").eqNullSafe(F.col("c_")), "left")
    return found.withColumn("repaired_sha256", F.coalesce("hashed", F.sha2(F.lit(""), 256))).select("conv_id", *RESULT), repaired


def _solved(rows: DataFrame, keep_rows: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    ship(rows.sparkSession)
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = rows.select(F.col("`conv_id`"), F.col("`turn`"), role.alias("role"), text.alias("text"))
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    rows = rows.select("*", F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("digest"),
                       (end == "").alias("empty"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    keys = ["conv_id", "turn", "role", "digest"]
    # equal rows may be very many: a number lets the range partitioning part them
    ordered = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys, "tie").sortWithinPartitions(*keys, "tie").drop("tie")
    found = stored(_streamed(ordered, keep_rows), "conversations")
    inside = found.where(F.col("part").isNull())
    edges, lines = _pieced(found.where(F.col("part").isNotNull()).select("conv_id", "turn", "role", "text", "digest", "empty", "cut", "part", "nth"))
    return inside, edges, lines


def repair(rows: DataFrame) -> DataFrame:
    """One row for each conv_id of (conv_id, turn, role, text): gaps, counts of faults, cost, audit and the digest of the repaired
    rows (``role:text``, joined by line feeds)."""
    inside, edges, _ = _solved(rows, False)
    return inside.select("conv_id", *RESULT).unionByName(edges)


def repaired_rows(rows: DataFrame) -> DataFrame:
    """The repaired rows: (conv_id, part, line_no, role, text), in order of part and line_no in each conversation."""
    inside, _, lines = _solved(rows, True)
    flat = inside.select("conv_id", F.posexplode("repaired").alias("line_no", "r"))
    return flat.select("conv_id", F.lit(0).alias("part"), F.col("line_no").cast("bigint").alias("line_no"), "r.role", "r.text").unionByName(lines)


def repair_all(rows: DataFrame, original: DataFrame) -> DataFrame:
    """``repair`` with a row for every conv_id of ``original``; those without rows have zeros, an empty audit and no rows to hash."""
    found = repair(rows).withColumnRenamed("conv_id", "c_")
    ids = original.select("conv_id").distinct()
    count = [F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c) for c in ("gaps", *COUNTS, "cost")]
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("c_")), "left").select(
        "conv_id", *count, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
