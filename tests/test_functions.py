"""Edge rows from FIXTURES.md section 7 for the scalar rules."""

import math

from pyspark.sql import functions as F

from rollbook.functions import labels as L
from rollbook.functions import text as TX
from rollbook.functions.similarity import ratio_py


def one_col(spark, values, typ="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {typ}")


def test_key_filter(spark):
    df = one_col(spark, [None, "200120000", "2001200001", " 2001200001", "2001200001.0"])
    out = [r.v for r in df.where(TX.is_valid_key("v")).collect()]
    assert out == ["2001200001"]


def test_clean_number(spark):
    vals = ["8.5", " 8.5 ", "", "5d", "8,5", "1e3", "NaN"]
    got = [r.x for r in one_col(spark, vals).select(TX.clean_number("v").alias("x")).orderBy(F.lit(1)).collect()]
    df = one_col(spark, vals).select("i", TX.clean_number("v").alias("x")).orderBy("i").collect()
    assert [r.x for r in df] == [8.5, 8.5, None, None, None, 1000.0, None]
    assert len(got) == 7


def test_id_text_suffix_only(spark):
    out = one_col(spark, ["2001200001.0", "10.05"]).select("i", TX.id_text("v").alias("x")).orderBy("i").collect()
    assert [r.x for r in out] == ["2001200001", "10.05"]


def test_unicode_trim(spark):
    out = one_col(spark, ["  x\t"]).select(TX.utrim("v").alias("x")).collect()
    assert out[0].x == "x"


def test_parse_date(spark):
    vals = ["01/02/2000", "12/31/2000", "2000-1-5", "5-6-2001", "2001/7/8", "31/02/2000", "1/2/00"]
    out = one_col(spark, vals).select("i", F.date_format(TX.parse_date("v"), "yyyy-MM-dd").alias("x")) \
        .orderBy("i").collect()
    assert [r.x for r in out] == ["2000-02-01", "2000-12-31", "2000-01-05", "2001-06-05", "2001-07-08", None, None]


def test_parse_date_matches_strptime(spark):
    import random
    from datetime import datetime
    rnd = random.Random(7)
    vals = []
    for _ in range(300):
        d, m, y = rnd.randint(1, 31), rnd.randint(1, 13), rnd.choice([99, 1999, 2000, 2024, 12345])
        sep = rnd.choice(["/", "-"])
        vals.append(rnd.choice([f"{d}{sep}{m}{sep}{y}", f"{y}{sep}{m}{sep}{d}", f"{d:02d}{sep}{m:02d}{sep}{y}"]))

    def py(s):
        for fmt in ("%d/%m/%Y", "%m/%d/%Y", "%Y-%m-%d", "%d-%m-%Y", "%Y/%m/%d"):
            try:
                return datetime.strptime(s, fmt).date().isoformat()
            except ValueError:
                continue
        return None

    out = one_col(spark, vals).select("i", F.date_format(TX.parse_date("v"), "yyyy-MM-dd").alias("x")) \
        .orderBy("i").collect()
    assert [r.x for r in out] == [py(v) for v in vals]


def test_input_kind(spark):
    vals = ["2001200001", "12345", "01/02/2000", "14DHTH01", "CNTT1", "Nguyễn Văn A"]
    out = one_col(spark, vals).select("i", TX.input_kind("v").alias("k")).orderBy("i").collect()
    assert [r.k for r in out] == ["mssv", "name", "date", "class", "name", "name"]


def test_gpa_label_and_status(spark):
    df = spark.createDataFrame([(3.60,), (3.59,), (1.00,), (0.99,), (None,)], "g double")
    out = [r.x for r in df.select(L.gpa_label("g").alias("x")).collect()]
    assert out == ["Xuất sắc", "Giỏi", "Yếu", "Kém", "Kém"]
    notes = spark.createDataFrame([("có Cảnh báo học vụ",), ("đã Thôi học",), (None,)], "n string")
    out = [r.x for r in notes.select(L.status_label("n").alias("x")).collect()]
    assert out == ["Cảnh báo", "Thôi học", "Bình thường"]


def test_full_name_null_rules(spark):
    df = spark.createDataFrame([("Nguyễn Văn", None)], "a string, b string")
    r = df.select(TX.full_name("a", "b").alias("s"), TX.full_name("a", "b", null_safe=False).alias("p")).first()
    assert r.s == "Nguyễn Văn" and r.p is None


def test_word_overlap(spark):
    df = spark.createDataFrame([("nguyen van an",)], "n string")
    r = df.select(TX.word_overlap("n", "van binh").alias("x")).first()
    assert r.x == 0.5


def test_ratio_is_asymmetric():
    assert ratio_py("tide", "diet") == 0.25
    assert ratio_py("diet", "tide") == 0.5


def test_histogram_bins(spark):
    from rollbook.operators.stats import score_histogram
    df = spark.createDataFrame([(float(x),) for x in (-1, 0, 2, 5, 8, 10, 10.1)], "s double")
    out = score_histogram(df, "s").orderBy("bin").collect()
    assert [r["count"] for r in out] == [1, 1, 0, 1, 0, 2]
    assert math.isclose(sum(r.percentage for r in out), 5 / 7 * 100)
