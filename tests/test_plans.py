"""Plan-shape regressions: the optimisations that only show in the plan."""

from pyspark.sql import functions as F

from rollbook.operators import extraction as EX
from rollbook.operators import search as SR


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_search_score_is_not_pushed_into_a_filter(spark):
    df = spark.createDataFrame([(1, "nguyen van an", "14A")], "k long, n string, c string")
    out = SR.scored_search(df, "van an", [], F.col("n"), ["c"], [])
    plan = _optimized(out)
    filters = [ln for ln in plan.split("\n") if "Filter" in ln]
    assert not any("greatest" in ln for ln in filters), plan


def test_line_rules_are_evaluated_once(spark):
    lines = spark.createDataFrame([(1, "2001200001 Nguyen Van An 14DHTH01")], "k long, line string")
    plan = _optimized(EX.extract_items(lines))
    assert not any("Filter" in ln and "rlike" in ln.lower() for ln in plan.split("\n")), plan


def test_lookup_key_is_not_nullable(spark):
    ins = spark.createDataFrame([(0, "31/02/2000"), (1, "2001200001")], "input_order long, input_value string")
    keyed = SR.classify_inputs(ins)
    assert not keyed.schema["key"].nullable and not keyed.schema["kind"].nullable
    assert sorted(r.key for r in keyed.collect()) == [SR.NO_KEY, "2001200001"]
