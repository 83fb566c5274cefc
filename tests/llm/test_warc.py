"""Merkle audit: every kind of damage is found, nothing else, and the descent reads little."""

import hashlib

from llm_fixtures import SF_SMALL  # noqa: F401
from pyspark.sql import functions as F

from rollbook.llm import warc as W


def pages(spark, n=700):
    rows = [(k, f"http://x/{k}", f"<p>page {k} é</p>" * (k % 5)) for k in range(n)]
    rows += [(None, None, None), (None, "u", None), (None, "u", None), (5, "http://x/5", None), (5, "http://x/5", None), (256 * 40 + 1, "far", "")]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit("clash"))


def test_damage_is_located(spark):
    records = W.warc_records(pages(spark))
    one = W.leaves(records).persist()
    assert W.audit(one, W.leaves(records)).collect() == []
    torn = records.withColumn("record", F.when(F.col("page_id").isin(3, 300, 699), F.overlay("record", F.lit(b"\x00"), F.lit(20), F.lit(1))).otherwise(F.col("record")))
    two = W.leaves(torn).where("not (file_no = 1 and idx >= 250)")
    extra = spark.createDataFrame([(2, 500, 9999, 10**6, 10, "f" * 64), (77, 0, 1, 0, 1, "e" * 64)], one.schema)
    got = sorted((r["file_no"], r["idx"], r["verdict"]) for r in W.audit(one, two.union(extra)).collect())
    place = {r["page_id"]: (r["file_no"], r["idx"]) for r in one.where("page_id in (3, 300, 699)").collect()}
    want = [(*place[k], "changed") for k in (3, 300, 699)] + [(1, k, "missing") for k in range(250, 256)] + [(2, 500, "extra"), (77, 0, "extra")]
    assert got == sorted(want)


def test_offsets_and_digests_are_those_of_the_file(spark):
    records = W.warc_records(pages(spark, 40))
    table = [(r["file_no"], r["page_id"], bytes(r["record"])) for r in records.collect()]
    for f in {t[0] for t in table}:
        data = b"".join(x for _, x in sorted((((p is not None, p or 0), hashlib.sha256(x).hexdigest()), x) for g, p, x in table if g == f))
        for r in W.leaves(records).where(F.col("file_no") == f).collect():
            assert hashlib.sha256(data[r["offset"]:r["offset"] + r["length"]]).hexdigest() == r["digest"]
    assert table[1][2].startswith(b"WARC/1.0\r\nWARC-Type: response\r\n") and table[1][2].endswith(b"\r\n\r\n")


def test_empty_archives(spark):
    none = W.leaves(W.warc_records(pages(spark).limit(0)))
    some = W.leaves(W.warc_records(pages(spark, 20)))
    assert W.audit(none, none).collect() == []
    assert {r["verdict"] for r in W.audit(some, none).collect()} == {"missing"}
    assert W.audit(none, some).count() == some.count()


def test_records_behind_a_loss_an_insertion_or_a_growth_are_moved(spark):
    """One record lost, one inserted and one longer in mid-file: three findings, and the rest of the file is where it went."""
    records = W.warc_records(pages(spark)).persist()
    one = W.leaves(records).persist()
    where = {r["page_id"]: (r["file_no"], r["idx"], r["offset"]) for r in one.where("file_no >= 0 and page_id <> 5").collect()}
    files = {f: sum(1 for g, _, _ in where.values() if g == f) for f in (1, 2)}
    lost = W.audit(one, W.leaves(records.where("page_id is null or page_id <> 266"))).collect()
    assert sorted({(r["file_no"], r["verdict"]) for r in lost}) == [(1, "missing"), (1, "moved")]
    assert [r["page_id"] for r in lost if r["verdict"] == "missing"] == [266] and len(lost) == files[1] - 10
    assert all(r["offset"] - r["replica_offset"] == [x["length"] for x in lost if x["verdict"] == "missing"][0] for r in lost if r["verdict"] == "moved")
    grown = records.withColumn("record", F.when(F.col("page_id") == 600, F.concat("record", F.lit(b"xyz"))).otherwise(F.col("record")))
    got = W.audit(one, W.leaves(grown)).collect()
    assert [(r["page_id"]) for r in got if r["verdict"] == "changed"] == [600]
    assert {r["verdict"] for r in got} == {"changed", "moved"} and all(r["replica_offset"] - r["offset"] in (0, 3) for r in got)
    more = records.unionByName(spark.createDataFrame([(300, 1, b"an inserted record")], "page_id bigint, file_no bigint, record binary"))
    got = W.audit(one, W.leaves(more)).collect()
    assert [(r["page_id"], r["digest"]) for r in got if r["verdict"] == "extra"] == [(300, None)]
    assert {r["verdict"] for r in got} <= {"extra", "moved"}
