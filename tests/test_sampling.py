import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairbench.operators import sampling


def order(seed, *parts):
    digest = hashlib.md5("-".join([str(seed), *map(str, parts)]).encode()).hexdigest()
    return int(digest[:15], 16)


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


@pytest.mark.parametrize("k", [0, 1, 37, 499, 500, 900])
@pytest.mark.parametrize("bits", [1, 4, 16])
def test_exact_sample_against_brute_force(spark, k, bits):
    df = spark.range(500)
    want = sorted(sorted(range(500), key=lambda i: (order(9, i), i))[:k])
    marked = sampling.mark_exact(df, k, "id", 9, bits=bits)
    assert ids(marked.filter("selected")) == want
    assert marked.count() == 500


def test_samples_do_not_depend_on_partitions_but_on_the_seed(spark):
    one, many = spark.range(0, 3000, 1, 1), spark.range(3000).repartition(64)
    assert ids(sampling.exact_sample(one, 100, "id", 1)) == ids(sampling.exact_sample(many, 100, "id", 1))
    assert ids(sampling.exact_sample(one, 100, "id", 1)) != ids(sampling.exact_sample(one, 100, "id", 2))
    assert ids(sampling.sample_rows(one, 10, "id")) == ids(sampling.sample_rows(many, 10, "id"))


def test_split_is_a_partition_of_the_rows(spark):
    df = spark.range(1000).withColumn("text", F.repeat(F.lit("x"), 10))
    kept, rest = sampling.split_exact(df, 333, "id", 7)
    assert len(ids(kept)) == 333
    assert sorted(ids(kept) + ids(rest)) == list(range(1000))


def _strata(spark, partitions):
    # Stratum 'hot' has most of the rows.
    level = F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 < 9, "warm").when(F.col("id") < 500, "rare")
    return spark.range(0, 5000, 1, partitions).withColumn("level", level).withColumn("text", F.col("id").cast("string"))


@pytest.mark.parametrize("bits", [2, 12])
def test_ranks_are_dense_and_independent_of_buckets(spark, bits):
    df = _strata(spark, 5).filter("level IS NOT NULL")
    ranks, sizes = sampling.stratum_ranks(df, "level", "id", 3, bits=bits)
    members = {}
    for r in df.select("level", "id").collect():
        members.setdefault(r.level, []).append(r.id)
    want = {}
    for level, found in members.items():
        for rank, i in enumerate(sorted(found, key=lambda i: (order(3, i), i))):
            want[(level, i)] = rank
    assert {(r.level, r.id): r["rank"] for r in ranks.collect()} == want
    assert {r.level: r["size"] for r in sizes.collect()} == {k: len(v) for k, v in members.items()}


@pytest.mark.parametrize("n", [1, 1000, 5000])
@pytest.mark.parametrize("strata", [None, ["hot", "rare"]])
def test_stratified_sample_sizes(spark, n, strata):
    sample = sampling.stratified_sample(_strata(spark, 5), "level", "id", n, 42, strata)
    rows = sample.select("level", "id", "slot", "seed", "text").collect()
    assert Counter(r.level for r in rows) == {s: n for s in strata or ["hot", "warm", "rare"]}
    assert {r.seed for r in rows} == {42}
    assert len({(r.level, r.slot) for r in rows}) == len(rows)
    assert all(r.text == str(r.id) for r in rows)


def test_stratified_sample_is_with_replacement_and_even(spark):
    rows = sampling.stratified_sample(_strata(spark, 3), "level", "id", 5000, 1, ["rare"]).collect()
    picks = Counter(r.id for r in rows)
    assert len(picks) == 50  # 50 rows in the stratum, 5000 draws
    assert 50 < min(picks.values()) and max(picks.values()) < 170


def test_stratified_sample_does_not_depend_on_partitions(spark):
    def drawn(partitions):
        sample = sampling.stratified_sample(_strata(spark, partitions), "level", "id", 200, 8)
        return sorted((r.level, r.slot, r.id) for r in sample.collect())

    assert drawn(1) == drawn(64)


def test_sample_fraction(spark):
    def drawn(partitions, seed=42):
        return sorted(r.id for r in sampling.sample_fraction(spark.range(0, 20000, 1, partitions), 1000, "id", seed).collect())

    for seed in range(6):
        rows = drawn(1, seed)
        assert 850 <= len(rows) <= 1000 and rows == drawn(64, seed)
        # No part of the table is favoured, also where the cap cuts.
        assert abs(sum(rows) / len(rows) - 10000) < 800
    assert any(len(drawn(1, seed)) == 1000 for seed in range(6))
    assert sampling.sample_fraction(spark.range(10), 1000, "id").count() == 10
    assert sampling.sample_fraction(spark.range(0), 5, "id").count() == 0


def test_slots_are_spread(spark):
    from pyspark.sql import functions as F

    df = spark.range(100).select(F.col("id"), (F.col("id") % 2).alias("level"))
    sample = sampling.stratified_sample(df, "level", "id", 200_000, 3)
    # Slots meet the ranks in several tasks and are all there.
    assert sample.groupBy("level").agg(F.count_distinct("slot").alias("n")).collect() == [(0, 200_000), (1, 200_000)] or sorted(
        tuple(r) for r in sample.groupBy("level").agg(F.count_distinct("slot")).collect()
    ) == [(0, 200_000), (1, 200_000)]


def test_shuffle_keeps_all_rows_in_hash_order(spark):
    rows = sampling.shuffle_rows(spark.range(2000), "id", 5).collect()
    assert sorted(r.id for r in rows) == list(range(2000))
    keys = [r.shuffle_key for r in rows]
    assert keys == sorted(keys)
    assert [r.id for r in rows] != list(range(2000))
