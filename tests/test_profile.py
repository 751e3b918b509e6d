import math
import random

import pytest
from pyspark.sql import functions as F

from pairbench.operators import profile


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def people(spark):
    data = [(1, "a", "x"), (2, "", None), (3, None, "x"), (None, "a", "a"), (1, "a", "a")]
    return spark.createDataFrame(data, "id int, v string, w string")


def test_shape_and_distinct(people):
    assert rows(profile.table_shape(people)) == [(5, 3)]
    assert rows(profile.nunique(people, "id")) == [(4,)]
    assert rows(profile.nunique(people, "id", approximate=True)) == [(4,)]


def test_value_counts(people):
    assert rows(profile.value_counts(people, "v")) == [("a", 3), ("", 1), (None, 1)]
    assert rows(profile.value_counts(people, "v", dropna=True)) == [("a", 3), ("", 1)]
    assert rows(profile.value_counts(people, "v", top=1)) == [("a", 3)]


def test_group_sizes_leave_out_nulls(people):
    assert sorted(rows(profile.group_sizes(people, "v", "w"))) == [("a", "a", 2), ("a", "x", 1)]


def test_null_profile(people):
    assert rows(profile.null_profile(people)) == [("id", 1, 1, 4), ("v", 1, 2, 4), ("w", 1, 1, 4)]


def test_column_equality(people):
    assert dict(rows(profile.column_equality(people, "v", "w"))) == {True: 2, False: 1, None: 2}


def test_duplicates(people, spark):
    assert rows(profile.duplicate_profile(people, "id")) == [(2, 1)]
    assert rows(profile.duplicate_profile(people, "v")) == [(3, 2)]
    assert rows(profile.duplicate_profile(spark.createDataFrame([], "k int"), "k")) == [(0, 0)]


def test_cohort_stats(spark):
    df = spark.createDataFrame([(1, 1), (1, None), (None, 2)], "person_id int, visit_occurrence_id int")
    assert rows(profile.cohort_stats(df)) == [(3, 2, 3)]


def test_cost(spark):
    df = spark.createDataFrame([(1000,), (500,), (None,)], "tokens int")
    total, cost = rows(profile.cost_estimate(df, "tokens"))[0]
    assert total == 1500 and cost == pytest.approx(0.09)


@pytest.mark.parametrize("scale", ["linear", "log"])
def test_histogram_against_brute_force(spark, scale):
    rng = random.Random(3)
    data = [rng.uniform(-5, 300) for _ in range(2000)] + [None, 0.0]
    df = spark.createDataFrame([(x,) for x in data], "x double")
    values = [math.log(x) for x in data if x and x > 0] if scale == "log" else [int(x) for x in data if x is not None]
    lo, hi = min(values), max(values)
    want = [0] * 20
    for x in values:
        want[min(int((x - lo) / (hi - lo) * 20), 19)] += 1
    got = sorted(rows(profile.histogram(df, "x", scale)))
    assert [r[3] for r in got] == want
    assert got[0][1] == pytest.approx(lo) and got[-1][2] == pytest.approx(hi)


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(7,), (7,)], "x int")
    got = sorted(rows(profile.histogram(df, "x")))
    assert [r[3] for r in got] == [2] + [0] * 19
    with pytest.raises(ValueError):
        profile.histogram(df, "x", "cubic")


def test_section_prevalence(spark):
    df = spark.createDataFrame([("Y", "N"), ("Y", "Y")], "a string, b string")
    got = sorted(rows(profile.section_prevalence(df, ["a", "b"])))
    assert got == [("a", "Y", 2), ("b", "N", 1), ("b", "Y", 1)]


def test_funnel_against_brute_force(spark):
    rng = random.Random(5)
    data = [
        (rng.choice([None, 1, 1, 1, 2, 3, 4]), rng.choice([None, 10, 20, 30]), rng.choice(["x", "y", None]))
        for _ in range(500)
    ]
    df = spark.createDataFrame(data, "visit_occurrence_id int, age int, kind string")
    steps = [("all", F.lit(True)), ("age", F.col("age") >= 20), ("kind", F.col("kind") == "x")]
    tests = [lambda r: True, lambda r: r[1] is not None and r[1] >= 20, lambda r: r[2] == "x"]
    want, left = [], data
    for number, ((name, _), test) in enumerate(zip(steps, tests), 1):
        left = [r for r in left if test(r)]
        want.append((number, name, len(left), len({r[0] for r in left})))
    assert sorted(rows(profile.attrition_funnel(df, steps))) == want
    none = profile.attrition_funnel(df.filter("age > 99"), steps)
    assert [r[2:] for r in sorted(rows(none))] == [(0, 0)] * 3


def test_histogram_keeps_values_beyond_int(spark):
    df = spark.createDataFrame([(1.5,), (5e9,), (-6e9,), (None,), (float("nan"),), (1e300,)], "x double")
    got = profile.histogram(df.filter("x IS NULL OR x < 1e200 OR isnan(x)"), "x").collect()
    assert sum(r["count"] for r in got) == 3
    assert (min(r.bin_start for r in got), max(r.bin_end for r in got)) == (-6e9, 5e9)
    assert sum(r["count"] for r in profile.histogram(df, "x").collect()) == 4


def test_checks_are_counted_while_a_stage_is_written(spark):
    df = spark.range(100).selectExpr("id", "if(id % 4 = 0, NULL, id) AS x").repartition(7)
    checks = {"no x": F.col("x").isNull(), "large": F.col("x") > 90, "never": F.col("id") < 0}
    staged, report = profile.staged_with_checks(df, checks)
    assert {r["check"]: r["violations"] for r in report.collect()} == {"no x": 25, "large": 7, "never": 0}
    assert staged.count() == 100 and len(staged.inputFiles()) > 0
    empty, report = profile.staged_with_checks(df.filter("id < 0"), checks)
    assert empty.count() == 0 and [r["violations"] for r in report.collect()] == [0, 0, 0]
