from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairbench.operators import tables


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_rename_is_simultaneous_and_ignores_unknown_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    renamed = tables.rename_columns(df, {"a": "b", "b": "a", "x": "y"})
    assert renamed.columns == ["b", "a", "c"]
    assert rows(renamed) == [(1, 2, 3)]
    with pytest.raises(ValueError):
        tables.rename_columns(df, ["a", "b"])


LEFT = [(1, "a"), (1, "b"), (2, "c"), (None, "d"), (4, "e")]
RIGHT = [(1, "x"), (1, "y"), (3, "z"), (None, "w")]


@pytest.mark.parametrize("how", ["inner", "left", "outer"])
def test_merge_against_brute_force(spark, how):
    left = spark.createDataFrame(LEFT, "id int, v string")
    right = spark.createDataFrame(RIGHT, "key int, v string")
    merged = tables.merge(left, right, "id", "key", how)
    assert merged.columns == ["id", "v", "v_right"]
    want = [(k, v, w) for k, v in LEFT for m, w in RIGHT if k is not None and k == m]
    if how != "inner":
        want += [(k, v, None) for k, v in LEFT if k not in (1, 3)]
    if how == "outer":
        want += [(3, None, "z"), (None, None, "w")]
    assert rows(merged) == sorted(want, key=repr)


def test_merge_rejects_other_kinds(spark):
    df = spark.range(1)
    with pytest.raises(ValueError):
        tables.merge(df, df.withColumnRenamed("id", "k"), "id", "k", "cross")


def test_two_hop_lookup(spark):
    facts = spark.createDataFrame([(1, 10), (2, 11), (3, None)], "fact int, site int")
    sites = spark.createDataFrame([(10, 100), (11, None), (12, 101)], "site int, place int")
    places = spark.createDataFrame([(100, "p"), (102, "q")], "place int, name string")
    found = tables.two_hop_lookup(facts, sites, places, "site", "place", "name")
    assert rows(found.select("fact", "name")) == [(1, "p"), (2, None), (3, None)]


def test_semi_and_anti_join(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, v string")
    other = spark.createDataFrame([(1,), (1,), (3,), (None,)], "k int")
    assert rows(tables.keep_matching(df, other, "k")) == [(1, "a"), (1, "b")]
    assert rows(tables.keep_unmatched(df, other, "k")) == sorted([(2, "c"), (None, "d")], key=repr)


def test_key_overlap_counts_products_without_making_them(spark):
    a = [1] * 5000 + [2, 2, 3, None]
    b = [1] * 4000 + [2, 4, None]
    left = spark.createDataFrame([(x,) for x in a], "k int")
    right = spark.createDataFrame([(x,) for x in b], "k int")
    counts_a, counts_b = Counter(a), Counter(b)
    shared = [k for k in counts_a if k is not None and k in counts_b]
    want = (sum(counts_a[k] * counts_b[k] for k in shared), len(shared))
    overlap = tables.key_overlap(left, right, "k")
    assert rows(overlap) == [want]
    assert rows(tables.key_overlap(left, right.filter("k > 9"), "k")) == [(0, 0)]


def test_drop_value_keeps_null(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "v string")
    assert rows(tables.drop_value(df, "v", "a")) == sorted([("b",), (None,)], key=repr)


def test_null_filters(spark):
    df = spark.createDataFrame([("a",), (None,)], "v string")
    assert rows(tables.keep_null(df, "v")) == [(None,)]
    assert rows(tables.keep_not_null(df, "v")) == [("a",)]


def test_first_per_key_with_a_hot_key(spark):
    hot = [("hot", i % 977, i) for i in range(20000)]
    cold = [(f"k{i}", 5, i) for i in range(100)] + [(None, 1, 1), (None, None, 0)]
    df = spark.createDataFrame(hot + cold, "k string, t int, id int").repartition(16)
    first = tables.first_per_key(df, "k", [F.asc_nulls_last("t"), F.desc("id")])
    got = {r.k: (r.t, r.id) for r in first.collect()}
    assert len(got) == 102
    assert got["hot"] == (0, max(i for i in range(20000) if i % 977 == 0))
    assert got[None] == (1, 1)


def test_drop_duplicates(spark):
    df = spark.createDataFrame([(1, 1, 3), (1, 1, 2), (2, 1, 1)], "a int, b int, c int")
    assert rows(tables.drop_duplicates(df, ["a", "b"]).select("a", "b")) == [(1, 1), (2, 1)]
    assert rows(tables.drop_duplicates(df, ["a", "b"], [F.asc("c")])) == [(1, 1, 2), (2, 1, 1)]


def test_last_value_wins(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 3), ("a", "z", 2)], "k string, v string, o int")
    assert rows(tables.last_value_per_key(df, "k", "v", F.col("o"))) == [("a", "y")]


def test_sorting(spark):
    df = spark.createDataFrame([(2, 1), (1, 2), (1, 1), (None, 0)], "a int, b int")
    down = [tuple(r) for r in tables.sort_values(df, "a", "b", "descending").collect()]
    assert down == [(2, 1), (1, 2), (1, 1), (None, 0)]
    up = [tuple(r) for r in tables.sort_values(df, "a").select("a").collect()]
    assert up == [(None,), (1,), (1,), (2,)]
    with pytest.raises(ValueError):
        tables.sort_values(df, "a", how="sideways")
    assert [tuple(r) for r in tables.top_n(df, 2, [F.desc("a"), F.asc("b")]).collect()] == [(2, 1), (1, 1)]


def test_sorting_spreads_a_value_that_most_rows_share(spark):
    df = spark.range(40000).select((F.col("id") % 10 > 2).cast("int").alias("a"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = (
            tables.sort_values(df, "a").groupBy(F.spark_partition_id().alias("p")).count().select("count").collect()
        )
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert max(r[0] for r in sizes) < 40000 * 0.3
