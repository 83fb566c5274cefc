"""Sources, sinks and header resolution on hand-made files shaped like the reference's."""

import os
import tempfile

from pyspark.sql import functions as F

from rollbook.sources import files as FS
from rollbook.sources import schema as SC
from rollbook.sources import sinks as SK

WIDE_HEADER = ("STT,Mã sinh viên,Họ đệm,Tên,Giới tính,Ngày sinh,Lớp,Số MH đăng ký,Số TC đăng ký,Số MH đạt,"
               "Điểm 10,Điểm 4,Điểm chữ,Xếp loại,Điểm rèn luyện,Xếp loại rèn luyện,"
               "Điểm 10,Điểm 4,Điểm chữ,Xếp loại,Xếp hạng,Năm thứ,Số TC tích lũy,Điểm rèn luyện,,Ghi chú")


def _write(tmp, name, text):
    path = os.path.join(tmp, name)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_wide_file_by_position(spark):
    tmp = tempfile.mkdtemp()
    rows = [
        "1,2001200001,Nguyễn Văn,An,Nam,01/02/2000,14DHTH01,8.0,20,8,8.5,3.6,A,Giỏi,85,Tốt,8.1,3.4,B+,Giỏi,12,3.0,90,80,Tốt,",
        "2,200120000,Trần Thị,Bình,Nữ,31/02/2000,14DHTH01,7,18,7,5d,,C,TB,70,Khá,6.0,2.4,C,TB,50,3,40,70,Khá,Cảnh báo lần 1",
        "3, 2001200003,Lê,Chi,Nữ,2000-1-5,15A1,6,15,6,1e1,4,A+,XS,90,XS,9.5,4.0,A+,XS,1,2,60,90,XS,",
    ]
    path = _write(tmp, "grades.csv", WIDE_HEADER + "\n" + "\n".join(rows) + "\n")
    raw = FS.read_csv(spark, path, SC.WIDE_TEXT_SCHEMA)
    assert raw.where(F.col(FS.CORRUPT).isNotNull()).collect() == []
    valid = raw.where(F.col("ma_sinh_vien").rlike("^[0-9]{10}$"))
    typed = SC.type_wide(valid)
    out = {r.ma_sinh_vien: r for r in typed.collect()}
    assert set(out) == {"2001200001"}  # 9 digits and a leading space are rejected
    r = out["2001200001"]
    assert r.so_mh_dang_ky == 8 and r.diem_10 == 8.5 and r.diem_10_tich_luy == 8.1
    assert r.xep_loai_tich_luy == "Giỏi" and r.ngay_sinh.isoformat() == "2000-02-01" and r.ghi_chu is None
    students, semester, cumulative = SK.split_wide(typed)
    assert students.columns[0] == "ma_sinh_vien" and "diem_4_tich_luy" in cumulative.columns
    assert "diem_10" in semester.columns


def test_header_roles():
    roles = SC.resolve_roles(["Mã sinh viên", "Họ và tên", "Middle name", "Tên", "Lớp", "Ngày sinh",
                              "Điểm 10", "Điểm 10", "Xếp loại", "student_id", "Email", "Số điện thoại"])
    assert roles["mssv"] == [0, 9]
    assert roles["full_name"] == [1, 2]
    assert roles["ten"] == [3] and roles["class"] == [4] and roles["birth_date"] == [5]
    assert roles["score"] == [6, 7] and roles["rank"] == [8]
    assert roles["email"] == [10] and roles["phone"] == [11]


def test_import_template(spark):
    cols = ["Mã sinh viên", "Họ và tên", "Giới tính", "Ngày sinh", "Lớp", "Điểm 10", "Xếp loại", "Ghi chú"]
    df = spark.createDataFrame([("2001200001", "Nguyễn Văn An", "Nam", "01/02/2000", "14DHTH01", "8.5", "Giỏi", ""),
                                ("", "Trần Thị Bình", "Nữ", "", "14DHTH01", "x", "", ""),
                                ("2001200003", "  ", "Nữ", "", "15A1", "7", "", "")], cols)
    out = SC.normalise_import(df).collect()
    assert [(r.mssv, r.ho_ten, r.diem, r.reject_reason) for r in out] == [
        ("2001200001", "Nguyễn Văn An", 8.5, None), (None, "Trần Thị Bình", None, "missing id"),
        ("2001200003", None, 7.0, "missing name")]


def test_score_column_detection(spark):
    df = spark.createDataFrame([("n/a", "8.5"), ("-", "x")], ["Điểm chữ", "Điểm 10"])
    got = {r.column: r.n_numeric for r in SC.score_column_counts(df).collect()}
    assert got == {"Điểm chữ": 0, "Điểm 10": 1}


def test_headerless_and_mixed(spark):
    tmp = tempfile.mkdtemp()
    a = _write(tmp, "a.csv", "1,An,14A\n2,Binh,14B\n")
    df = FS.read_headerless(spark, a, 3)
    assert df.columns == ["Column_1", "Column_2", "Column_3"] and df.count() == 2
    d1 = os.path.join(tmp, "g1"); os.makedirs(d1)
    d2 = os.path.join(tmp, "g2"); os.makedirs(d2)
    _write(d1, "x.csv", "ma,ten\n1,An\n")
    _write(d2, "y.csv", "ma,lop\n2,14B\n")
    m = FS.read_mixed(spark, [(d1, ["ma", "ten"]), (d2, ["ma", "lop"])])
    assert sorted(tuple(r) for r in m.select("ma", "ten", "lop").collect()) == [("1", "An", ""), ("2", "", "14B")]


def test_guard_and_audit(spark):
    tmp = tempfile.mkdtemp()
    _write(tmp, "ok.csv", "ma,ten\n1,An\n")
    _write(tmp, "big.csv", "ma,ten\n" + "".join(f"{i},Ten{i}\n" for i in range(2000)))
    _write(tmp, "bad.pdf", "ma,ten\n9,X\n")
    df = spark.read.option("header", True).csv(tmp)
    acc, rej = FS.guarded(df, max_bytes=1024)
    assert acc.count() == 1
    assert {(r.file_name, r.reason) for r in rej.collect()} == {("big.csv", "size"), ("bad.pdf", "extension")}
    audit = {r.file_name: r.rows for r in FS.ingest_audit(df).collect()}
    assert audit["big.csv"] == 2000


def test_global_row_number(spark):
    df = spark.range(0, 1000, 1, 7).withColumn("k", (F.col("id") * 7919) % 1000)
    out = SK.global_row_number(df, ["k"]).collect()
    assert sorted((r.k, r.row_no) for r in out) == [(k, k + 1) for k in range(1000)]


def test_write_tables_partitions_by_cohort(spark):
    tmp = tempfile.mkdtemp()
    wide = spark.createDataFrame([("2001200001", "An", "14DHTH01", 3.2), ("2001200002", "Binh", "15A1", 2.0)],
                                 "ma_sinh_vien string, ten string, lop string, diem_4_tich_luy double")
    paths = SK.write_tables(wide, tmp)
    st = SK.read_partitioned(spark, paths["students"], ["khoa"])
    assert sorted(r.khoa for r in st.collect()) == ["14", "15"]
    assert spark.read.parquet(paths["cumulative_scores"]).count() == 2


def test_json_records_keep_nulls(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert SK.json_records(df).first().json == '{"a":1,"b":null}'


def _put(folder, name, body):
    import os

    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", encoding="utf-8", newline="") as f:
        f.write(body)


def test_folder_of_headers_nobody_named(spark, tmp_path):
    from rollbook.sources import files as FS

    d = str(tmp_path / "in put")
    _put(d, "a.csv", "\ufeffMSSV,Họ tên\n2001200001,An\n")
    _put(d, "b.csv", "Lớp,mssv,mssv\r\nCNTT1,2001200002,9\r\n")
    _put(d, "c.csv", "MSSV,Họ tên\n")
    _put(d, "d 1.csv", "\"note, long\",Họ tên\nx,Binh\n")
    _put(d, "e.csv", "")
    got = sorted((r["mssv"], r["full_name"], r["class"], r["note"]) for r in FS.read_folder(spark, d).collect())
    assert got == [("", "Binh", "", "x"), ("2001200001", "An", "", ""), ("2001200002", "", "CNTT1", "")]
    _put(str(tmp_path / "none"), "x.csv", "")
    assert FS.read_folder(spark, str(tmp_path / "none")).count() == 0


def test_audit_has_a_row_for_every_file(spark, tmp_path):
    from rollbook.sources import files as FS

    d = str(tmp_path)
    _put(d, "good one.txt", "2001200001\n\nTran Thi Binh\n")
    _put(d, "blank.csv", " \n\n")
    _put(d, "empty.txt", "")
    _put(d, "bad.exe", "2001200001\n")
    _put(d, "large.txt", "2001200001\n" * 50)
    got = {r["file_name"]: (r["status"], r["lines"], r["items"]) for r in FS.folder_audit(spark, d, max_bytes=400).collect()}
    assert got == {"good one.txt": ("ok", 2, 2), "blank.csv": ("empty", 0, 0), "empty.txt": ("empty", 0, 0), "bad.exe": ("extension", 0, 0), "large.txt": ("size", 0, 0)}


def test_ordinals_across_splits_and_pruned_lookup(spark, tmp_path):
    from pyspark.sql import types as T

    from rollbook.sources import files as FS

    d = str(tmp_path / "in")
    for k in range(3):
        _put(d, f"{k}.csv", "id,name\n" + "".join(f"{k * 1000 + i},name {i}\n" for i in range(1000)))
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType())])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = spark.read.schema(schema).option("header", True).csv(d)
        assert rows.rdd.getNumPartitions() > 5
        out = FS.with_ordinals(rows)
        assert all(r["id"] == r["row_ord"] for r in out.collect())
        FS.write_ordinals(out, str(tmp_path / "t"), block=500)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    hit = FS.row_at(spark, str(tmp_path / "t"), 1234, block=500)
    assert [tuple(r) for r in hit.collect()] == [(1234, "name 234", 1234)]
    plan = hit._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ord_block" in plan and FS.row_at(spark, str(tmp_path / "t"), 9999, block=500).count() == 0
