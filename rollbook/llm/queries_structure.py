"""Registered queries of the operators on whole-table structure: manifests, conversations, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.llm.common import documents
from rollbook.llm.manifest import prove, row_manifest
from rollbook.llm.pagetext import extract, fit
from rollbook.llm.repair import repair_all
from rollbook.session import read_table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def proofs(docs: DataFrame) -> DataFrame:
    """Every row's proof; where 3 divides the crc32 of the decimal doc_id, the claimed text is in lower case."""
    text = F.col("text")
    harmed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate(text, _UPPER, _LOWER)).otherwise(text)
    manifest = row_manifest(docs, {"text": harmed})
    found = prove(manifest, manifest.leaves, "claim")
    return found.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root",
                        (F.col("folded_root") == F.col("root")).alias("verified"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proofs(documents(spark, sf_dir))


#: The table of CRC-32, made by its rule, and the checksum of an ASCII text by it.
_CRC_TABLE = """crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i)))"""


def _crc32(text: str) -> str:
    return (f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))), "
            "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)")


def _levels(prefix: str, count: int) -> str:
    """Common table expressions of ``count`` levels over {prefix}n0 (tree, idx, h, n) and of the paths over {prefix}p0 (..., idx, f, proof)."""
    out = []
    for k in range(count):
        out.append(f"""
{prefix}r{k} AS MATERIALIZED (SELECT tree, n, idx // 8 AS up, list(h ORDER BY idx) AS run FROM {prefix}n{k} WHERE n > 1 GROUP BY tree, n, up),
{prefix}n{k + 1} AS MATERIALIZED (
  SELECT tree, up AS idx, sha256(array_to_string(run, '')) AS h, (n + 7) // 8 AS n FROM {prefix}r{k}
  UNION ALL SELECT tree, idx, h, n FROM {prefix}n{k} WHERE n = 1),
{prefix}p{k + 1} AS MATERIALIZED (
  SELECT p.* EXCLUDE (idx, f, proof), p.idx // 8 AS idx,
         CASE WHEN run IS NULL THEN f ELSE sha256(concat(array_to_string(run[1:p.idx % 8], ''), f, array_to_string(run[p.idx % 8 + 2:], ''))) END AS f,
         concat(proof, array_to_string(run[1:p.idx % 8], ''), array_to_string(run[p.idx % 8 + 2:], '')) AS proof
  FROM {prefix}p{k} p LEFT JOIN {prefix}r{k} r ON r.tree = p.tree AND r.up = p.idx // 8),""")
    return "".join(out)


#: Levels that the SQL is written out for: 8 ** 8 rows of a language, 8 ** 8 languages.
_SQL_LEVELS = 8
OP11_SQL = f"""
WITH {_CRC_TABLE},
d AS (
  SELECT *, CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 3 = 0
                 THEN translate(text, '{_UPPER}', '{_LOWER}') ELSE text END AS claimed
  FROM documents, crc),
hashed AS (
  SELECT doc_id, lang,
         {", ".join("sha256(concat(" + ", ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen(CAST({c} AS VARCHAR)), ':', {c}) END" for c in ("doc_id", "source", "lang", "n_chars", text)) + f")) AS {name}" for text, name in (("text", "leaf"), ("claimed", "claim")))}
  FROM d),
leaf AS MATERIALIZED (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '-' ELSE concat(':', lang) END AS tree, leaf, claim,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n
  FROM hashed),
n0 AS (SELECT tree, idx, leaf AS h, n FROM leaf),
p0 AS (SELECT doc_id, tree, leaf, idx, claim AS f, '' AS proof FROM leaf),
{_levels("", _SQL_LEVELS)}
sub AS MATERIALIZED (SELECT tree AS name, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM n{_SQL_LEVELS}),
tn0 AS (SELECT 'top' AS tree, pos AS idx, subroot AS h, n FROM sub),
tp0 AS (SELECT doc_id, leaf, subroot, 'top' AS tree, pos AS idx, f, proof FROM p{_SQL_LEVELS} p JOIN sub ON sub.name = p.tree),
{_levels("t", _SQL_LEVELS)}
top AS (SELECT h AS root FROM tn{_SQL_LEVELS})
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified FROM tp{_SQL_LEVELS}, top"""

QUERIES["op11_merkle_manifest"] = op11_merkle_manifest
ORACLE_SQL["op11_merkle_manifest"] = OP11_SQL


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows damaged at places that a hash of conversation and turn chooses: 0 dropped, 1 emptied, 2 without its sentence ends,
    3 repeated, 4 of role user. NULLs are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), lot.alias("lot")).where("lot <> 0")
    text = F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("lot") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(F.col("lot") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       F.explode(F.sequence(F.lit(1), copies))).drop("col")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read_table(spark, sf_dir, "conversations")
    return repair_all(damaged(conversations), conversations)


#: The least (cost, audit) for each sequence state (0 nothing yet, 1 after system, 2 after user, 3 after assistant), row after row.
OP12_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
ids AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id NULLS FIRST) AS cid FROM (SELECT DISTINCT conv_id FROM conversations)),
lots AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc32("concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS lot FROM conversations, crc),
harmed AS (
  SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
         CASE lot WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN lot = 3 THEN 2 ELSE 1 END)) AS copy
  FROM lots WHERE lot <> 0),
placed AS (
  SELECT cid, turn, role, text, rtrim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS body,
         row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, sha256(concat(strlen(role), ':', role, text)), copy) AS k
  FROM harmed JOIN ids ON ids.conv_id IS NOT DISTINCT FROM harmed.conv_id),
r AS MATERIALIZED (
  SELECT *, left(role, 1) AS initial, body = '' AS blank, body <> '' AND again > 1 AS dup, body <> '' AND again = 1 AND right(body, 1) NOT IN ('.', '!', '?') AS cut
  FROM (SELECT *, row_number() OVER (PARTITION BY cid, role, text ORDER BY k) AS again FROM placed)),
facts AS (
  SELECT cid, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE dup) AS duplicate,
         count(*) FILTER (WHERE cut) AS truncated, count(*) FILTER (WHERE concat(before, initial) NOT IN ('su', 'ua', 'au') AND k > 1) AS illegal, max(k) AS n
  FROM (SELECT *, lag(initial) OVER (PARTITION BY cid ORDER BY k) AS before FROM r) GROUP BY cid),
ins(q, p, more, letters, turns) AS (
  VALUES (0, 0, 0, '', []), (0, 2, 2, 'I', ['user:']), (0, 3, 4, 'II', ['user:', 'assistant:']),
         (1, 1, 0, '', []), (1, 2, 2, 'I', ['user:']), (1, 3, 4, 'II', ['user:', 'assistant:']),
         (2, 2, 0, '', []), (2, 3, 2, 'I', ['assistant:']), (3, 3, 0, '', []), (3, 2, 2, 'I', ['user:'])),
move(p, letter, initial, z) AS (
  VALUES (0, 'D', NULL, 0), (1, 'D', NULL, 1), (2, 'D', NULL, 2), (3, 'D', NULL, 3), (0, 'K', 's', 1), (0, 'K', 'u', 2), (1, 'K', 'u', 2), (2, 'K', 'a', 3), (3, 'K', 'u', 2),
         (0, 'R', NULL, 2), (1, 'R', NULL, 2), (2, 'R', NULL, 3), (3, 'R', NULL, 2)),
walk(cid, k, q, best) AS (
  SELECT cid, CAST(0 AS BIGINT), 0, struct_pack(cost := CAST(0 AS BIGINT), audit := '', turns := CAST([] AS VARCHAR[])) FROM facts
  UNION ALL
  SELECT walk.cid, r.k, move.z, min(struct_pack(
           cost := CAST(best.cost + more + CASE letter WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN cut AND letter <> 'D' THEN 1 ELSE 0 END AS BIGINT),
           audit := concat(best.audit, letters, letter),
           turns := list_concat(list_concat(best.turns, ins.turns), CASE letter WHEN 'D' THEN CAST([] AS VARCHAR[]) WHEN 'K' THEN [concat(role, ':', text)]
                                                                  ELSE [concat(CASE move.z WHEN 3 THEN 'assistant' ELSE 'user' END, ':', text)] END)))
  FROM walk JOIN r ON r.cid = walk.cid AND r.k = walk.k + 1 JOIN ins ON ins.q = walk.q
       JOIN move ON move.p = ins.p AND (move.initial IS NULL OR move.initial = r.initial) AND (letter = 'D' OR NOT (blank OR dup))
  GROUP BY walk.cid, r.k, move.z),
done AS (
  SELECT walk.cid, min(struct_pack(cost := CAST(best.cost + more AS BIGINT), audit := concat(best.audit, letters), turns := list_concat(best.turns, ins.turns))) AS best
  FROM walk JOIN facts ON facts.cid = walk.cid AND facts.n = walk.k JOIN ins ON ins.q = walk.q WHERE ins.p IN (0, 3) GROUP BY walk.cid)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit,
       sha256(coalesce(array_to_string(best.turns, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN facts USING (cid) LEFT JOIN done USING (cid)"""

QUERIES["op12_conversation_repair"] = op12_conversation_repair
ORACLE_SQL["op12_conversation_repair"] = OP12_SQL


def op13_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return extract(pages, fit(pages))


QUERIES["op13_page_text"] = op13_page_text
