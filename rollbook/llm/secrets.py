"""Secret scan with an incremental blob ledger, in DataFrame expressions only.

Every version of every path is addressed by the SHA-256 of its content. The ledger is a
table with one row per (blob, rule version) that was ever scanned, with the findings. A scan
addresses all versions, takes the pairs the ledger lacks, reads one copy of each such
blob, adds its rows to the ledger, and joins the findings back to every path: a blob that
a third of all paths share is scanned once, and a second scan of the same input scans nothing.

Positions are counted in code points from 0, ends exclusive. Matches of a kind are leftmost and
do not overlap; the text between them gives their positions.

Defined results: NULL and empty text are the empty blob without findings; repeated rows each
get the findings; the columns of the input other than id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException
from pyspark.sql.window import Window

from rollbook.llm.common import keyed_text, stored
from rollbook.session import scratch_path


@dataclass(frozen=True)
class Rule:
    """A kind of secret: ``pattern`` (Java syntax); of a match, ``group`` must have ``least``
    characters, else the match is dropped. Change ``version`` whenever the meaning changes."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1


# The base kinds, in the order in which spans that start alike are listed.
BASE_RULES = (
    Rule("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|"""
                   r"""[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
# Kinds that this scan adds: private keys, hosting and chat tokens, signed web tokens.
VENDOR_RULES = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("hosting", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + VENDOR_RULES
#: What a text must hold for a rule to be tried, cheaper to look for than the rule itself.
_HINTS = {("assign", 1): r"[:=]", ("access", 1): "AKIA", ("hex", 1): "[0-9a-f]{24}", ("pem", 1): "PRIVATE KEY",
          ("hosting", 1): "gh[pousr]_", ("chat", 1): "xox[abprs]-", ("jwt", 1): "eyJ"}

LEDGER_SCHEMA = "blob string, kind string, version int, start array<int>, stop array<int>"


def blob_of(text: Column) -> Column:
    """Content address of a version; NULL is the empty content."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _scan(texts: DataFrame, rule: Rule) -> DataFrame:
    """(blob, kind, version, start, stop) of one rule, a row for every blob with a kept match.

    The gaps between matches and the matches' lengths add up to the positions: one running
    sum per blob, whatever the number of matches."""
    maybe = texts.where(F.col("text").rlike(_hint(rule))).where(F.col("text").rlike(rule.pattern))
    found = maybe.select(
        "blob", F.split("text", rule.pattern, -1).alias("gap"), F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group)).alias("part"))
    each = found.select("blob", F.posexplode(F.arrays_zip(
        F.transform("gap", lambda g: F.length(g)).alias("gap"), F.transform("hit", lambda h: F.length(h)).alias("hit"),
        F.transform("part", lambda p: F.length(p)).alias("part"))).alias("k", "m")).select(
        "blob", "k", "m.gap", F.coalesce("m.hit", F.lit(0)).alias("hit"), F.coalesce("m.part", F.lit(-1)).alias("part"))
    upto = Window.partitionBy("blob").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("stop", F.sum(F.col("gap") + F.col("hit")).over(upto))
    kept = placed.where(F.col("part") >= max(rule.least, 0)).select("blob", F.struct((F.col("stop") - F.col("hit")).cast("int").alias("a"), F.col("stop").cast("int").alias("b")).alias("s"))
    lists = kept.groupBy("blob").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return lists.select("blob", F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), F.col("s.a").alias("start"), F.col("s.b").alias("stop"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's rows; none if it does not exist yet."""
    try:
        return spark.read.schema(LEDGER_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER_SCHEMA)


def update_ledger(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Scan what the ledger at ``path`` lacks of these versions and append it.

    A blob that was scanned has a row for every rule version, without positions where
    nothing was found. Returns the ledger. Two writers, or one that repeats its append, leave equal rows, which readers take as one.
    """
    spark = docs.sparkSession
    versions = keyed_text(docs, id_col, text_col)
    blobs = versions.groupBy(blob_of(F.col("text")).alias("blob")).agg(F.min("doc_id").alias("doc_id"))
    known = read_ledger(spark, path).groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("done"))
    pairs = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    todo = stored(blobs.join(known, "blob", "left").withColumn("todo", F.array_except(pairs, F.coalesce("done", F.slice(pairs, 1, 0)))).where(
        F.size("todo") > 0).select("blob", "doc_id", "todo"), "unseen")
    # one copy of each unseen blob; its address is checked, as several versions may share an id
    copies = versions.select(F.col("doc_id").alias("v_id"), F.coalesce("text", F.lit("")).alias("text"))
    unseen = copies.join(todo, F.col("v_id").eqNullSafe(F.col("doc_id")) & (blob_of(F.col("text")) == F.col("blob"))).select("blob", "todo", "text")
    texts = stored(unseen.where(F.col("text").rlike("|".join(f"(?:{_hint(r)})" for r in rules))).dropDuplicates(["blob"]), "blobs")
    found = None
    for rule in rules:
        mine = _scan(texts.where(F.array_contains("todo", F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version")))).select("blob", "text"), rule)
        found = mine if found is None else found.unionByName(mine)
    asked = todo.select("blob", F.explode("todo").alias("t")).select("blob", "t.kind", "t.version")
    none = F.array().cast("array<int>")
    rows = asked.join(found, ["blob", "kind", "version"], "left").select(
        "blob", "kind", "version", F.coalesce("start", none).alias("start"), F.coalesce("stop", none).alias("stop"))
    rows.write.mode("append").parquet(path)
    return read_ledger(spark, path)


def _hint(rule: Rule) -> str:
    return _HINTS.get((rule.kind, rule.version), rule.pattern)


def find_secrets(docs: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per row of the input: doc_id, blob and spans, an array of (start, order, kind,
    stop) sorted by start, then by the rules' order. Without a path the ledger is a new one in the shared folder."""
    path = ledger_path or scratch_path(docs.sparkSession, "ledger")
    ledger = update_ledger(docs, path, rules, id_col, text_col)
    order = {r.kind: k for k, r in enumerate(rules)}
    mine = F.lit(False)
    for r in rules:
        mine = mine | ((F.col("kind") == r.kind) & (F.col("version") == r.version))
    rank = F.element_at(F.create_map(*[x for k, v in order.items() for x in (F.lit(k), F.lit(v))]), F.col("kind"))
    findings = ledger.where(mine & (F.size("start") > 0)).select("blob", F.zip_with(
        "start", "stop", lambda a, b: F.struct(a.alias("start"), rank.alias("rank"), F.col("kind").alias("kind"), b.alias("stop"))).alias("s")).groupBy(
        "blob").agg(F.array_sort(F.flatten(F.collect_set("s"))).alias("spans"))  # an append that was repeated says the same twice
    paths = keyed_text(docs, id_col, text_col).select("doc_id", blob_of(F.col("text")).alias("blob"))
    return paths.join(findings, "blob", "left").select("doc_id", "blob", F.coalesce(
        "spans", F.array().cast("array<struct<start:int,rank:int,kind:string,stop:int>>")).alias("spans"))


def redact_secrets(docs: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]",
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input, each run of overlapping spans in its texts replaced by ``mask``; every other
    row and column as it is."""
    found = find_secrets(docs, ledger_path, rules, id_col, text_col).where(F.size("spans") > 0).select(
        F.col("blob").alias("_blob"), F.col("spans").alias("_spans")).dropDuplicates(["_blob"])
    text = F.col(f"`{text_col}`").cast("string")
    # walk the spans: (text so far, end of the last span), each overlapping one widening it
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    cut = F.aggregate("_spans", start, lambda acc, s: F.when(s["stop"] <= acc["at"], acc).otherwise(F.struct(
        F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(
            acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))).alias("out"),
        s["stop"].alias("at"))), lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return docs.join(found, blob_of(F.col(f"`{text_col}`").cast("string")) == F.col("_blob"), "left").select(*[
        F.when(F.col("_spans").isNull(), F.col(f"`{c}`")).otherwise(cut).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
