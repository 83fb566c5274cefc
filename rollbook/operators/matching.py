"""Entity matching of extracted ids and names against a record table (JN3-JN7, JN9, UD1).

Phases (each a join, no per-row loop):
  JN3  ids: exact id text, first record per id;
  JN4  names: exact full name among records not matched by id, first record per name;
  JN5  names without an exact hit: best similarity ratio >= 0.85 among those records,
       earliest record on ties;
  JN6  one result per record (best score, then earliest input).

The fuzzy phase is a *lossless* blocked join. The ratio bounds the number of grams that two strings must
share (``rollbook.functions.similarity.shared_bound``): o of them. With each string's grams in one global order, rarest first, the
first two shared ones are among its first ``n - o + 2`` (prefix filtering), so a pair that can reach the threshold
shares a *pair* of prefix grams, and that pair is the join key. Long strings use three characters a gram, shorter ones two, the shortest
single grams of two; which one depends on the input's length alone, and a target is indexed for all that inputs
of its length band use. Candidates also pass the length band and a position bound: matched characters stand at most
``max(la, lb) - t * (la + lb) / 2`` places apart, and bit maps of their grams of two, which differ in no more bits than the
strings do in grams. All this is tested as keys meet, so that only pairs that pass it become rows. Keys that very many targets share are split over tasks. What is
left is cut by the whole gram overlap, counted natively, before the ratio UDF runs, once per distinct pair of strings.

The best target of an input is first looked for at half the allowed difference, where strings have few keys. An input that has one
there needs nothing below; the others go on to the threshold itself.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.functions.similarity import grams, length_band, min_shared, shared_bound, similarity_ratio, tagged
from rollbook.functions.text import utrim
from rollbook.session import cut_lineage

FUZZY_THRESHOLD = 0.85
PAIR_THRESHOLD = 0.6

TYPE_ID = "mssv_exact"
TYPE_NAME = "name_exact_combined"
TYPE_FUZZY = "name_fuzzy_combined"


def _name_key(c) -> F.Column:
    return F.lower(utrim(c))


def records_view(target: DataFrame, id_expr, first_name: str, last_name: str, row_ord: str) -> DataFrame:
    """Records as ``(row_ord, student_id, full_name)`` with the combined, lower-cased name."""
    full = F.lower(utrim(F.concat_ws(" ", utrim(F.coalesce(F.col(first_name), F.lit(""))),
                                     utrim(F.coalesce(F.col(last_name), F.lit(""))))))
    return target.select(F.col(row_ord).alias("row_ord"),
                         F.regexp_replace(utrim(id_expr), r"\.0$", "").alias("student_id"),
                         full.alias("full_name"))


# ---------------------------------------------------------------- JN3
def match_ids(ids: DataFrame, records: DataFrame) -> DataFrame:
    """JN3: ``ids(input_order, item)`` -> first record with that id text."""
    first = (records.where(F.col("student_id").isNotNull())
             .groupBy("student_id").agg(F.min("row_ord").alias("row_ord")))
    return (ids.withColumn("student_id", utrim("item")).join(first, "student_id", "inner")
            .select("student_id", "row_ord", F.col("item").alias("input_value"), "input_order",
                    F.lit(1.0).alias("match_score"), F.lit(TYPE_ID).alias("match_type")))


# ---------------------------------------------------------------- JN4
def match_exact_names(names: DataFrame, records: DataFrame, exclude: DataFrame, collation: str | None = None) -> DataFrame:
    """JN4: exact combined name among records whose id was not matched in JN3. With a ``collation`` names are equal as it has them:
    ``UNICODE_CI_AI`` takes no account of accents."""
    eligible = records.join(exclude.select("student_id").distinct(), "student_id", "left_anti")
    key = (lambda c: c) if collation is None else (lambda c: F.collate(c, collation))
    first = eligible.groupBy(key(F.col("full_name")).alias("full_name")).agg(F.min(F.struct("row_ord", "student_id")).alias("_r"))
    return (names.withColumn("full_name", key(_name_key("item"))).join(first, "full_name", "inner")
            .select(F.col("_r.student_id").alias("student_id"), F.col("_r.row_ord").alias("row_ord"),
                    F.col("item").alias("input_value"), "input_order",
                    F.lit(1.0).alias("match_score"), F.lit(TYPE_NAME).alias("match_type")))


# ---------------------------------------------------------------- JN5
#: Targets of one key that a task joins; keys with more are split.
HOT_KEY = 2000


def _fewest(q: int, threshold: float, length) -> F.Column:
    """The grams of q characters that a string of this length shares at least with any partner inside the length band."""
    slope, base = shared_bound(q, threshold)
    total = length + F.ceil(length * F.lit(threshold / (2 - threshold)) - F.lit(1e-9))
    return F.greatest(F.ceil(F.lit(slope) * total + F.lit(base) - F.lit(1e-9)), F.lit(0)).cast("int")


#: (characters of a gram, grams of a key), the most selective first.
SCHEMES = ((3, 2), (2, 2), (2, 1))


def _scheme(length, threshold: float) -> F.Column:
    """Index into SCHEMES of the first whose bound holds for inputs of this length; it does for longer ones too."""
    out = F.lit(len(SCHEMES) - 1)
    for k in range(len(SCHEMES) - 2, -1, -1):
        q, ways = SCHEMES[k]
        out = F.when(_fewest(q, threshold, length) >= ways, F.lit(k)).otherwise(out)
    return out


#: Grams are ranked by the frequency of the bucket that they hash to; the ranks are two bytes each.
BUCKETS = 1 << 14


def _bucket(token) -> F.Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def _ranks(tokens: DataFrame) -> tuple[bytes, bytes]:
    """The rank of each bucket of ``token``, rarest first, and the first rank that more than ``HOT_KEY`` tokens have. At most ``BUCKETS`` counts reach the driver."""
    count = dict(tokens.groupBy(_bucket("token").alias("k")).agg(F.count(F.lit(1)).alias("n")).collect())
    order = sorted(range(BUCKETS), key=lambda k: (count.get(k, 0), k))
    rank = {k: i for i, k in enumerate(order)}
    rare = sum(count.get(k, 0) <= HOT_KEY for k in order)
    return b"".join(rank[k].to_bytes(2, "big") for k in range(BUCKETS)), rare.to_bytes(2, "big")


def _keys(strings: DataFrame, ranks: bytes, k: int, threshold: float) -> DataFrame:
    """(id, len, m0, m1, key, p1, p2, rank): the keys of strings under SCHEMES[k], with the places of their grams and the rank of the rarer one."""
    q, ways = SCHEMES[k]
    o = F.greatest(_fewest(q, threshold, F.col("len")), F.lit(ways))
    # all grams of a string, rarest first; their number goes by the string's length
    ranked = F.sort_array(F.transform(f"t{q}", lambda x: F.struct(
        F.substring(F.lit(ranks), _bucket(x["token"]) * 2 + 1, F.lit(2)).alias("rank"), F.xxhash64(x["token"]).alias("h"), x["pos"].alias("pos"))))
    head = F.slice(ranked, F.lit(1), F.greatest(F.size(f"t{q}") - o + F.lit(ways), F.lit(0)))
    if ways == 1:
        rows = F.transform(head, lambda x: F.struct(x["h"].alias("key"), x["pos"].alias("p1"), F.lit(None).cast("int").alias("p2"), x["rank"].alias("rank")))
    else:  # the head is bound to a variable, as it is read for each of its grams
        pairs = lambda g: F.flatten(F.transform(g, lambda x, i: F.transform(F.slice(g, i + 2, F.size(g)), lambda y: F.struct(
            F.xxhash64(x["h"], y["h"]).alias("key"), x["pos"].alias("p1"), y["pos"].alias("p2"), x["rank"].alias("rank")))))
        rows = F.flatten(F.transform(F.array(head), pairs))
    return strings.select("id", "len", "m0", "m1", F.explode(rows).alias("x")).select("id", "len", "m0", "m1", "x.key", "x.p1", "x.p2", "x.rank")


def _with_tokens(strings: DataFrame) -> DataFrame:
    """Strings with an id, their tagged grams of two and three characters and a bit map (m0, m1) of the parities of the hashed grams of two."""
    tags = lambda q: F.flatten(F.transform(F.array(grams("s", q)), tagged))
    # strings are small beside their keys: dealt out over all partitions, however few files held them
    dealt = strings.repartition(int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("s"))
    rows = cut_lineage(dealt.withColumn("id", F.monotonically_increasing_id()).withColumn("t2", tags(2)).withColumn("t3", tags(3)))
    half = lambda odd: F.expr(f"""aggregate(transform(t2, x -> xxhash64(x.token)), 0L, (m, h) ->
        CASE WHEN (shiftright(h, 6) & 1) = {odd} THEN m ^ shiftleft(1L, CAST(h & 63 AS INT)) ELSE m END)""")  # noqa: E731
    return rows.withColumn("m0", half(0)).withColumn("m1", half(1))


def _split_hot(left: DataFrame, right: DataFrame, often: bytes) -> tuple[DataFrame, DataFrame]:
    """Give both sides a part number: targets of a key that more than HOT_KEY of them have are dealt over parts, inputs of it go to each.
    Only keys of grams that are frequent themselves (rank ``often`` and above) are counted."""
    hot = right.where(F.col("rank") >= F.lit(often)).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_KEY)
    hot = cut_lineage(hot.select("key", F.ceil(F.col("n") / HOT_KEY).cast("int").alias("parts")))
    left, right = left.drop("rank"), right.drop("rank")
    if hot.isEmpty():
        return left.withColumn("part", F.lit(0)), right.withColumn("part", F.lit(0))
    count = F.coalesce("parts", F.lit(1))
    left = left.join(hot, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), count - 1))).drop("parts")
    return left, right.join(hot, "key", "left").withColumn("part", F.pmod(F.xxhash64("id"), count).cast("int")).drop("parts")


def fuzzy_candidates(inputs: DataFrame, targets: DataFrame, threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """Distinct ``(a, b)`` string pairs that can reach ``ratio(a, b) >= threshold``.

    ``inputs``/``targets`` hold a column ``s``; strings of one character are left out, NULL too. Lossless for thresholds
    above 5/6, where even two strings of two characters need a shared gram; a ``ValueError`` below.
    """
    if min_shared(2, 4, threshold) < 1:
        raise ValueError("blocking is only lossless for thresholds above 5/6")
    t = float(threshold)
    low, high = t / (2 - t), (2 - t) / t
    length = F.length("s")
    # each side's distinct strings and their grams are read by several branches
    # below, so they are materialised once instead of recomputed
    a = inputs.select("s").distinct().withColumn("len", length).where("len >= 2").withColumn("scheme", _scheme(F.col("len"), t))
    b = targets.select("s").distinct().withColumn("len", length).where("len >= 2")
    # inputs of the band go from the length whose scheme is the least selective to the longest
    b = b.withColumn("last", _scheme(F.ceil(F.col("len") * low - 1e-9).cast("int"), t)).withColumn("first", _scheme(F.floor(F.col("len") * high + 1e-9).cast("int"), t))
    # lengths that no string of the other side can pair with
    ends = lambda side: side.agg(F.min("len"), F.max("len")).first()
    shortest, longest = ends(a)
    b = b.where(F.col("len").between(math.ceil(shortest * low - 1e-9), math.floor(longest * high + 1e-9)) if shortest else F.lit(False))
    a, b = _with_tokens(a), _with_tokens(b)
    slope, base = shared_bound(2, t)
    need = lambda la, lb: F.ceil(F.lit(slope) * (la + lb) + F.lit(base) - F.lit(1e-9))
    found = []
    for k, (q, _) in enumerate(SCHEMES):
        mine, theirs = a.where(F.col("scheme") == k), b.where((F.col("first") <= k) & (F.col("last") >= k))
        if mine.isEmpty() or theirs.isEmpty():
            continue
        tokens = [side.select(F.explode(F.col(f"t{q}")["token"]).alias("token")) for side in (mine, theirs)]
        ranks, often = _ranks(tokens[0].unionByName(tokens[1]))
        left, right = _split_hot(_keys(mine, ranks, k, t), _keys(theirs, ranks, k, t), often)
        side = lambda rows, x: rows.select("key", "part", *[F.col(c).alias(f"{x}_{c}") for c in ("id", "len", "m0", "m1", "p1", "p2")])
        la, lb = F.col("a_len"), F.col("b_len")
        reach = F.floor(F.greatest(la, lb) - F.lit(t / 2) * (la + lb) + 1e-9)
        near = lambda p: F.coalesce(F.abs(F.col(f"a_{p}") - F.col(f"b_{p}")) <= reach, F.lit(True))  # noqa: B023, E731
        apart = F.bit_count(F.col("a_m0").bitwiseXOR(F.col("b_m0"))) + F.bit_count(F.col("a_m1").bitwiseXOR(F.col("b_m1")))
        # sizes are estimated without the explosion into keys, so a broadcast would rest on a wrong figure
        met = side(left, "a").hint("merge").join(side(right, "b"), ["key", "part"]).where(
            length_band(la, lb, t) & near("p1") & near("p2") & (apart <= la + lb - 2 - 2 * need(la, lb)))
        found.append(met.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))
    if not found:
        return a.sparkSession.createDataFrame([], "a string, b string")
    pairs = cut_lineage(reduce(DataFrame.unionByName, found).distinct())
    # the whole bigram overlap that the ratio needs, counted natively, before any Python runs
    text = lambda side, x: side.select(F.col("id").alias(x), F.col("s").alias(f"s{x}"), F.col("t2")["token"].alias(f"t{x}"))
    both = pairs.join(text(a, "a"), "a").join(text(b, "b"), "b")
    return both.where(F.size(F.array_intersect("ta", "tb")) >= need(F.length("sa"), F.length("sb"))).select(F.col("sa").alias("a"), F.col("sb").alias("b"))


def best_fuzzy(inputs: DataFrame, targets: DataFrame, threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """For each input string ``a``: the target string with the highest ratio >= threshold,
    ties to the target with the earliest ``row_ord``. ``targets`` has ``(s, row_ord)``.

    Inputs with a target at half the allowed difference have their best one there; only the others are looked up at the threshold."""
    from rollbook.operators.ranking import first_by_key

    first_row = cut_lineage(targets.groupBy("s").agg(F.min("row_ord").alias("row_ord")))
    todo, found = cut_lineage(inputs.select("s").distinct()), []
    for level in ((1 + threshold) / 2, threshold):
        cand = fuzzy_candidates(todo, first_row, level)
        scored = (cand.withColumn("score", similarity_ratio("a", "b")).where(F.col("score") >= level)
                  .join(first_row.withColumnRenamed("s", "b"), "b", "inner"))
        best = cut_lineage(first_by_key(scored, ["a"], [("score", False), ("row_ord", True)]).select("b", "a", "score", "row_ord"))
        found.append(best)
        todo = cut_lineage(todo.join(best.select(F.col("a").alias("s")), "s", "left_anti"))
    return reduce(DataFrame.unionByName, found)


def match_fuzzy_names(names: DataFrame, records: DataFrame, exclude: DataFrame, exact: DataFrame,
                      threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """JN5: name inputs without an exact hit -> best fuzzy record (ratio >= threshold)."""
    eligible = records.join(exclude.select("student_id").distinct(), "student_id", "left_anti")
    todo = names.join(exact.select("input_order").distinct(), "input_order", "left_anti") \
                .withColumn("s", _name_key("item"))
    best = best_fuzzy(todo.select("s"), eligible.select(F.col("full_name").alias("s"), "row_ord"), threshold)
    hit = todo.join(best.withColumnRenamed("a", "s"), "s", "inner")
    return (hit.join(eligible.select("row_ord", "student_id"), "row_ord", "inner")
            .select("student_id", "row_ord", F.col("item").alias("input_value"), "input_order",
                    F.col("score").alias("match_score"), F.lit(TYPE_FUZZY).alias("match_type")))


# ---------------------------------------------------------------- JN6 / JN9
def resolve(*phases: DataFrame) -> DataFrame:
    """JN6: one row per record: best score, then the earliest input. Each input matched at
    most one record in its phase, so the result never exceeds the number of inputs."""
    from rollbook.operators.ranking import first_by_key

    u = phases[0]
    for p in phases[1:]:
        u = u.unionByName(p)
    best = first_by_key(u, ["student_id"], [("match_score", False), ("input_order", True)]).select(*u.columns)
    return best.orderBy(F.desc("match_score"), F.asc("input_order"))


def match_extracted(items: DataFrame, records: DataFrame, fuzzy: bool = True,
                    threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """JN3-JN6 on extracted ``(kind, item, input_order)`` rows (kinds ``mssv`` and ``names``)."""
    phases = match_phases(items, records, fuzzy, threshold)
    return resolve(*phases)


def match_phases(items: DataFrame, records: DataFrame, fuzzy: bool = True,
                 threshold: float = FUZZY_THRESHOLD) -> list[DataFrame]:
    """JN3, JN4 (and JN5) results. Inputs, records and the exact phases feed several later
    branches, so each is checkpointed once instead of recomputed per branch."""
    items = cut_lineage(items.select("kind", "item", "input_order"))
    records = cut_lineage(records)
    ids = items.where(F.col("kind") == "mssv").select("item", "input_order")
    names = items.where(F.col("kind") == "names").select("item", "input_order")
    p1 = cut_lineage(match_ids(ids, records))
    p2 = cut_lineage(match_exact_names(names, records, p1))
    if not fuzzy:
        return [p1, p2]
    return [p1, p2, match_fuzzy_names(names, records, p1, p2, threshold)]


def match_totals(items: DataFrame, matches: DataFrame) -> DataFrame:
    """JN9 summary: inputs, matches, and matches per type."""
    n_in = items.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    return matches.groupBy("match_type").agg(F.count(F.lit(1)).cast("bigint").alias("matches")) \
        .select("match_type", "matches", n_in.cast("bigint").alias("total_inputs"))


# ---------------------------------------------------------------- JN7
def pair_score(pairs: DataFrame, input_col: str, id_col: str, name_col: str,
               threshold: float = PAIR_THRESHOLD) -> DataFrame:
    """JN7: one input against one record: id equal -> 1.0 ``mssv_exact``; else the name ratio
    when >= threshold -> ``name_fuzzy``; else 0 ``no_match``. Runs on given pairs only."""
    inp = F.lower(utrim(input_col))
    rid = F.lower(utrim(F.col(id_col).cast("string")))
    ratio = similarity_ratio(inp, F.lower(utrim(name_col)))
    score = F.when(inp == rid, F.lit(1.0)).when(ratio >= threshold, ratio).otherwise(F.lit(0.0))
    kind = (F.when(inp == rid, F.lit("mssv_exact")).when(ratio >= threshold, F.lit("name_fuzzy"))
            .otherwise(F.lit("no_match")))
    return pairs.withColumn("match_score", score).withColumn("match_type", kind)
