"""The registered queries of the training-data operators: each applies one operator, with
production parameters, to the whole of its table, and derives the columns to compare."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.llm import queries_structure
from rollbook.llm.bpe import bpe_round_trip
from rollbook.llm.common import documents, stored
from rollbook.llm.decontam import contamination
from rollbook.llm.langid import fit, held_out, predict
from rollbook.llm.licenses import find_notices
from rollbook.llm.neardup import near_duplicates
from rollbook.llm.quality import fit as fit_field
from rollbook.llm.quality import quality
from rollbook.llm.secrets import BASE_RULES, VENDOR_RULES, find_secrets, update_ledger
from rollbook.llm.sharding import shard
from rollbook.llm.simple8b import token_files
from rollbook.llm.warc import Tree, audit, heights, leaves, warc_records
from rollbook.session import read_table, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn
    return keep


@query("op1_token_files")
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(documents(spark, sf_dir)).select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op4_bpe")
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(documents(spark, sf_dir)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


OP3_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM (
    SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM iw WHERE len(w) > 0)),
dwin AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM (
    SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hit AS (SELECT DISTINCT doc_id, i, k, item_id FROM dwin JOIN win USING (k, win)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS items_sha256
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)"""


@query("op3_decontamination", OP3_SQL)
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_OP5_ASSIGN = BASE_RULES[0].pattern.replace("'", "''")
OP5_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
raw AS (
  SELECT doc_id, 0 AS rank, 'assign' AS kind, 6 AS least, string_split_regex(text, '{_OP5_ASSIGN}') AS g,
         regexp_extract_all(text, '{_OP5_ASSIGN}') AS h, regexp_extract_all(text, '{_OP5_ASSIGN}', 2) AS p FROM d
  UNION ALL SELECT doc_id, 1, 'access', 20, string_split_regex(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+'),
         regexp_extract_all(text, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT doc_id, 2, 'hex', 24, string_split_regex(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+'),
         regexp_extract_all(text, '[0-9a-f]+') FROM d),
vendor AS (
  {" UNION ALL ".join(f"SELECT doc_id, {3 + k} AS rank, '{r.kind}' AS kind, 0 AS least, string_split_regex(text, '{r.pattern}') AS g, regexp_extract_all(text, '{r.pattern}') AS h, regexp_extract_all(text, '{r.pattern}') AS p FROM d" for k, r in enumerate(VENDOR_RULES))}),
each AS (
  SELECT doc_id, rank, kind, least, len(g[k]) AS gap, len(h[k]) AS hit, len(p[k]) AS part, k
  FROM (SELECT *, unnest(range(1, len(h) + 1)) AS k FROM (SELECT * FROM raw UNION ALL SELECT * FROM vendor))),
placed AS (
  SELECT *, sum(gap + hit) OVER (PARTITION BY doc_id, rank ORDER BY k ROWS UNBOUNDED PRECEDING) AS stop FROM each),
kept AS (SELECT doc_id, rank, kind, CAST(stop - hit AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM placed WHERE part >= least),
named AS (SELECT doc_id, rank, kind, start, concat(kind, ':', start, ':', stop) AS s FROM kept)
SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access,
       count(*) FILTER (WHERE rank = 2) AS n_hex,
       sha256(coalesce(string_agg(s, ',' ORDER BY start, rank) FILTER (WHERE rank <= 2), '')) AS base_sha256,
       coalesce(string_agg(s, ',' ORDER BY start, rank), '') AS spans
FROM d LEFT JOIN named USING (doc_id) GROUP BY doc_id"""


@query("op5_secrets", OP5_SQL)
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    ledger = scratch_path(spark, "ledger")
    # an earlier state of the corpus, scanned by the base rules alone: of its blobs, the second scan runs the other rules only
    update_ledger(docs.where("lang = 'en'"), ledger, BASE_RULES)
    found = find_secrets(docs, ledger)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_RULES))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text(base), 256).alias("base_sha256"),
                        text(F.col("spans")).alias("spans"))


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (
    SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT reach.doc_id, edge.b FROM reach JOIN edge ON edge.a = reach.r WHERE edge.b <> reach.doc_id),
comp AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id,
       coalesce(component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN comp ON comp.doc_id = w.doc_id"""


@query("op8_near_duplicates", OP8_SQL)
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), threshold=85, width=3)


@query("op2_language")
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = predict(docs, fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op9_line_quality")
def op9_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality(docs, fit_field(docs, read_table(spark, sf_dir, "labels")))


@query("op10_sharding")
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir), shards=40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


@query("op6_licenses")
def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_notices(documents(spark, sf_dir)).select("doc_id", "first_line", "last_line", "license", F.round("saving", 6).alias("saving"), "differences")


OP7_SQL = r"""
WITH rec AS (
  SELECT page_id, page_id // 256 AS file_no,
         concat('WARC/1.0', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Record-ID: <urn:md5:', md5(concat(page_id, ' ', url)), '>',
                chr(13), chr(10), 'WARC-Target-URI: ', url, chr(13), chr(10), 'Content-Type: text/html', chr(13), chr(10), 'Content-Length: ', strlen(html),
                chr(13), chr(10), chr(13), chr(10), html, chr(13), chr(10), chr(13), chr(10)) AS record FROM pages),
h AS (SELECT page_id, file_no, CAST(strlen(record) AS BIGINT) AS length, sha256(record) AS digest FROM rec),
leaf AS (
  SELECT *, row_number() OVER w - 1 AS idx, CAST(coalesce(sum(length) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
         count(*) OVER (PARTITION BY file_no) AS n
  FROM h WINDOW w AS (PARTITION BY file_no ORDER BY page_id)),
l1 AS (SELECT file_no, idx // 16 AS up, sha256('node:' || string_agg(sha256(concat_ws(':', 'leaf', "offset", length, digest)), '' ORDER BY idx)) AS hash
       FROM leaf GROUP BY ALL),
root AS (SELECT file_no, sha256('node:' || string_agg(hash, '' ORDER BY up)) AS file_root FROM l1 GROUP BY file_no),
harm AS (
  SELECT *, CASE WHEN md5('file' || file_no)[1] = '0' AND idx >= n - 3 THEN 'cut' WHEN md5(CAST(page_id AS VARCHAR))[1:2] = '05' THEN 'lost'
                 WHEN md5(CAST(page_id AS VARCHAR))[1:2] = '06' THEN 'grown' WHEN md5(CAST(page_id AS VARCHAR))[1:2] IN ('00', '01', '02', '03', '04') THEN 'changed' ELSE '' END AS harm
  FROM leaf),
shift AS (
  SELECT *, coalesce(sum(CASE harm WHEN 'lost' THEN -length WHEN 'grown' THEN 5 ELSE 0 END) OVER w, 0) AS bytes,
         coalesce(sum(CASE harm WHEN 'lost' THEN -1 ELSE 0 END) OVER w, 0) AS places
  FROM harm WINDOW w AS (PARTITION BY file_no ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT page_id, file_no, idx, "offset", length, digest, file_root,
       CASE WHEN harm IN ('cut', 'lost') THEN 'missing' WHEN harm IN ('grown', 'changed') THEN 'changed'
            WHEN bytes <> 0 OR places <> 0 THEN 'moved' ELSE 'intact' END AS verdict
FROM shift JOIN root USING (file_no)"""


@query("op7_warc_fixity", OP7_SQL)
def op7_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive of all pages audited against a replica with damage at places that hashes of ids choose: flipped
    bytes, records overwritten by zeros, records lost or grown in mid-file, and files that lack their last three records."""
    records = warc_records(read_table(spark, sf_dir, "pages"))
    primary = stored(leaves(records), "leaves")
    lot = F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 2)
    sizes = primary.groupBy("file_no").agg(F.count("*").alias("n")).select(F.col("file_no").alias("s"), "n")
    cut = F.substring(F.md5(F.concat(F.lit("file"), F.col("file_no").cast("string")).cast("binary")), 1, 1) == "0"
    gone = primary.join(sizes, F.col("file_no") == F.col("s")).where(cut & (F.col("idx") >= F.col("n") - 3)).select(F.col("page_id").alias("gone"))
    harmed = records.where(lot != "05").join(gone, F.col("page_id").eqNullSafe(F.col("gone")), "left_anti")
    harmed = harmed.withColumn("record", F.when(lot.isin("00", "01", "02"), F.overlay("record", F.lit(b"\x7f"), F.lit(60), F.lit(1))).when(
        lot.isin("03", "04"), F.unhex(F.repeat(F.lit("00"), F.octet_length("record")))).when(lot == "06", F.concat("record", F.lit(b"grown"))).otherwise(F.col("record")))
    found = audit(primary, stored(leaves(harmed), "replica")).where("verdict <> 'extra'").select(F.col("file_no").alias("f"), F.col("idx").alias("i"), "verdict")
    roots = Tree(primary, heights(primary)[0], 0).file_roots().select(F.col("file_no").alias("r"), F.col("hash").alias("file_root"))
    return primary.join(found, (F.col("file_no") == F.col("f")) & (F.col("idx") == F.col("i")), "left").join(roots, F.col("file_no") == F.col("r")).select(
        "page_id", "file_no", "idx", "offset", "length", "digest", "file_root", F.coalesce("verdict", F.lit("intact")).alias("verdict"))


QUERIES.update(queries_structure.QUERIES)
ORACLE_SQL.update(queries_structure.ORACLE_SQL)
