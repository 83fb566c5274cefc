"""Scored search, typed lookup and paging (SR1, SR2, SR3, SR8, TK5)."""

from pyspark.sql import functions as F

from rollbook.operators import ranking as R
from rollbook.operators import search as SR


def students(spark):
    return spark.createDataFrame([
        (1, "2001200001", "Nguyen Van An", "14DHTH01", "01/02/2000"),
        (2, "2001200002", "Tran Thi Binh", "14DHTH01", "02/03/2001"),
        (3, "2001200003", "Le Van Chi", "14DHTH01", "05/06/2000"),
        (4, "2001200004", "Pham An", "15A1", "07/08/1999")],
        "ord long, mssv string, ho_ten string, lop string, ngay_sinh string")


def test_scored_search_order_and_scores(spark):
    out = SR.scored_search(students(spark), "van", ["mssv"], F.col("ho_ten"), ["lop"], ["ord"]).collect()
    assert [r.ord for r in out] == [1, 3]
    assert all(r.match_score == 0.85 for r in out)
    exact = SR.scored_search(students(spark), "2001200002", ["mssv"], F.col("ho_ten"), ["lop"], ["ord"]).collect()
    assert [(r.ord, r.match_score) for r in exact] == [(2, 1.0)]


def test_typed_lookup(spark):
    inputs = spark.createDataFrame([(0, "14DHTH01"), (1, "nobody here"), (2, "   "), (3, "2001200004"),
                                    (4, "5/6/2000"), (5, "tran thi binh")], "input_order long, input_value string")
    roles = {"mssv": [("mssv", "mssv")], "name": [("ho_ten", "ho_ten")], "class": [("lop", "lop")],
             "date": [("ngay_sinh", "ngay_sinh")]}
    out = SR.typed_lookup(inputs, students(spark), roles, "ord", ["ho_ten"]).collect()
    assert [(r.input_order, r.row_ord) for r in out] == [(0, 1), (3, 4), (4, 3), (5, 2)]
    cov = SR.coverage(inputs, SR.typed_lookup(inputs, students(spark), roles, "ord", ["ho_ten"])).first()
    assert (cov.total_inputs, cov.found, cov.not_found) == (5, 4, 1)


def test_paging(spark):
    df = spark.range(41).withColumnRenamed("id", "k")
    assert R.page(df, [F.col("k")], 3).count() == 1
    assert R.page(df, [F.col("k")], 4).count() == 0
    assert R.pages_for(0) == 0 and R.pages_for(41) == 3
    seek = R.page_after(df, ["k"], [19])
    assert [r.k for r in seek.collect()] == list(range(20, 40))


def test_simple_search_best_field(spark):
    out = SR.simple_search(students(spark), "14dhth01", ["mssv", "ho_ten", "lop"], ["mssv"], ["ho_ten"],
                           ["ord"]).collect()
    assert {(r.ord, r.match_score, r.match_field) for r in out} == {(1, 0.6, "lop"), (2, 0.6, "lop"), (3, 0.6, "lop")}


def test_lines_as_a_table_equal_lines_as_parameters(spark):
    """Same rows, scores, fields and lines as the walk over all lines, whatever the texts: short words, blank names, repeats, ids."""
    import random

    from rollbook.operators import search as SR

    rnd = random.Random(4)
    words = ["an", "binh", "nguyen", "phuong mai", "a", "14dhth01", "cntt", "le", "x", "2001200001", "200120", "tran thi"]
    phrase = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 3)))
    rows = [(k // 2, rnd.choice(["2001200001", f"20012{k:05d}", None]), rnd.choice([phrase(), phrase().upper(), "", None, " "]), rnd.choice(["14DHTH01", "CNTT", phrase()])) for k in range(80)]
    df = spark.createDataFrame(rows, "k long, mssv string, ten string, lop string")
    lines = [rnd.choice([phrase(), phrase(), "2001200001", "20012000", "  ", "nguyen", "An  Binh", "mai phuong", "zz"]) for _ in range(40)]
    key = F.concat(F.lit("k"), F.col("k").cast("string"))
    walk = SR.multi_line_search(df, lines, ["mssv", "ten", "lop"], ["mssv"], ["ten"], key, ["k", "mssv"])
    kept = [(n, ln) for n, ln in enumerate([x for x in lines if x.strip()])]
    table = spark.createDataFrame(kept + [(99, None), (98, " ")], "line_order int, line string")
    joined = SR.search_lines(df, table, ["mssv", "ten", "lop"], ["mssv"], ["ten"], key, ["k", "mssv"])
    cols = ["k", "mssv", "ten", "lop", "input_value", "match_score", "match_field", "line_order"]
    see = lambda d: sorted(str(tuple(r[c] for c in cols)) for r in d.collect())
    assert see(joined) == see(walk) and joined.count() > 10
    assert SR.search_lines(df, table.limit(0), ["ten"], [], ["ten"], key, ["k"]).count() == 0


def test_lines_with_a_common_long_word_go_by_their_rarest_word(spark, monkeypatch):
    """Every cell holds the longest word of every line: each line meets the cells of its other word alone."""
    cells = [f"customer#{k:09d}" for k in range(300)]
    lines = [f"{k:05d} customer" for k in range(0, 300, 3)] + ["customer 12", "no such 000000003", "x"]
    frames, kept = [], SR.cut_lineage
    monkeypatch.setattr(SR, "cut_lineage", lambda df, *name: (frames.append((name, kept(df, *name))), frames[-1][1])[1])
    pairs = SR._containing(spark.createDataFrame([(x,) for x in lines], "v string"), spark.createDataFrame([(x,) for x in cells], "v string"))
    assert {(r.s, r.l) for r in pairs.collect()} == {(x, y) for x in lines for y in cells if all(w in y for w in x.split())}
    index = next(f for name, f in frames if name == ("grams",))
    often = {r["gram"]: r["count"] for r in index.groupBy("gram").count().collect()}
    mine = {}
    for r in next(f for name, f in frames if name == ("lines",)).collect():
        mine.setdefault(r["s"], []).append(often.get(r["gram"], 0))
    assert max(min(mine[x]) for x in lines if x.endswith(" customer") and x > "001") <= 1
