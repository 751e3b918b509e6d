"""Sampling and pair building."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairbench.constants import PAIR_LEVELS, SAMPLE_SEED, SPLIT_SEED
from pairbench.functions import labels as L
from pairbench.operators import pairing, sampling, scoring, tables
from pairbench.sources import testbed
from pairbench.sources.files import stage
from pairbench.workload import inputs
from pairbench.workload.checks import hash_number
from pairbench.workload.registry import query

_HALF = inputs.N * len(PAIR_LEVELS) // 2
_SIDES = ("visit_occurrence_id", "acuitylevel", "history_text", "seed")


@query(
    "sample_n",
    f"""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders
    ORDER BY md5('{SAMPLE_SEED}-' || o_orderkey), o_orderkey LIMIT 20""",
)
def sample_n(spark, folder):
    df = testbed.table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return sampling.sample_rows(df, 20, "o_orderkey")


@query(
    "sample_fraction",
    f"""SELECT o_orderkey, o_custkey, o_totalprice
    FROM (SELECT *, {hash_number(f"'{SAMPLE_SEED}-' || o_orderkey")} AS place, count(*) OVER () AS total FROM orders)
    WHERE place < CAST(floor(least(1000::DOUBLE / total, 1) * (1::BIGINT << 60)) AS BIGINT)
    QUALIFY row_number() OVER (ORDER BY place, o_orderkey) <= 1000""",
)
def sample_fraction(spark, folder):
    df = testbed.table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return sampling.sample_fraction(df, 1000, "o_orderkey")


@query(
    "stratified_sample_replace",
    f"""WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority
            ORDER BY md5('{SAMPLE_SEED}-' || o_orderkey), o_orderkey) - 1 AS r,
            count(*) OVER (PARTITION BY o_orderpriority) AS size FROM orders),
        slots AS (SELECT o_orderpriority, size, slot
            FROM (SELECT DISTINCT o_orderpriority, size FROM ranked) CROSS JOIN range(1000) AS s(slot))
    SELECT o_orderkey, o_orderpriority, o_totalprice, slot, {SAMPLE_SEED} AS seed
    FROM slots JOIN ranked USING (o_orderpriority, size)
    WHERE r = {hash_number(f"'{SAMPLE_SEED}-' || o_orderpriority || '-' || slot")} % size""",
)
def stratified_sample_replace(spark, folder):
    df = testbed.table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return sampling.stratified_sample(df, "o_orderpriority", "o_orderkey", 1000, SAMPLE_SEED)


@query(
    "exact_sample",
    f"""SELECT o_orderkey, o_custkey, o_totalprice FROM orders
    QUALIFY row_number() OVER (ORDER BY md5('{SPLIT_SEED}-' || o_orderkey), o_orderkey) <= 5000""",
)
def exact_sample(spark, folder):
    df = testbed.table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return sampling.exact_sample(df, 5000, "o_orderkey", SPLIT_SEED)


@query(
    "shuffle_rows",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
        md5('{SPLIT_SEED}-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey) AS shuffle_key FROM lineitem""",
)
def shuffle_rows(spark, folder):
    df = testbed.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"
    )
    return sampling.shuffle_rows(df, ["l_orderkey", "l_linenumber", "l_partkey"], SPLIT_SEED)


@query("balanced_pairs", "SELECT * FROM balanced", ["balanced"])
def balanced_pairs(spark, folder):
    return inputs.balanced(spark, folder)


_COUNTERBALANCED = "SELECT * FROM counterbalanced"


@query("counterbalance", _COUNTERBALANCED, ["counterbalanced"])
def counterbalance(spark, folder):
    return pairing.counterbalance(stage(inputs.balanced(spark, folder)), _HALF)


@query("union_halves", _COUNTERBALANCED, ["counterbalanced"])
def union_halves(spark, folder):
    """The same in three steps: a sample, its complement with sides swapped, and their union."""
    kept, rest = sampling.split_exact(stage(inputs.balanced(spark, folder)), _HALF, ["pair_class", "slot"], SPLIT_SEED)
    return tables.union_rows(kept, pairing.swap_sides(rest, F.lit(False)))


@query(
    "anti_join_rest",
    f"""SELECT pair_class, slot, visit_occurrence_id_combined FROM balanced
    WHERE visit_occurrence_id_combined NOT IN (SELECT visit_occurrence_id_combined FROM balanced
        QUALIFY row_number() OVER (ORDER BY md5('{SPLIT_SEED}-' || pair_class || '-' || slot), pair_class, slot)
            <= {_HALF})""",
    ["balanced"],
)
def anti_join_rest(spark, folder):
    """Pairs whose id is not in the sampled half; repeated ids leave with it."""
    drawn = stage(inputs.balanced(spark, folder).select("pair_class", "slot", scoring.PAIR_ID))
    half = sampling.exact_sample(drawn, _HALF, ["pair_class", "slot"], SPLIT_SEED)
    return tables.keep_unmatched(drawn, half, scoring.PAIR_ID)


@query(
    "pair_truth",
    """SELECT pair_class, slot, acuitylevel_int_A, acuitylevel_int_B, acuity_level_int_BminusA, higher_acuity_patient
    FROM pairs""",
    ["pairs"],
)
def pair_truth(spark, folder):
    return inputs.pairs(spark, folder).select(
        "pair_class", "slot", "acuitylevel_int_A", "acuitylevel_int_B", "acuity_level_int_BminusA",
        "higher_acuity_patient",
    )


@query("build_prompt", "SELECT pair_class, slot, prompt, prompt_tokens FROM pairs", ["pairs"])
def build_prompt(spark, folder):
    return inputs.pairs(spark, folder).select("pair_class", "slot", "prompt", "prompt_tokens")


@query(
    "pair_keys",
    "SELECT pair_class, slot, visit_occurrence_id_combined, acuitylevel_combined FROM pairs",
    ["pairs"],
)
def pair_keys(spark, folder):
    return inputs.pairs(spark, folder).select("pair_class", "slot", scoring.PAIR_ID, "acuitylevel_combined")


@query(
    "pair_class",
    "SELECT slot, acuitylevel_combined, pair_class AS drawn_class, pair_class AS acuity_pair_class FROM pairs",
    ["pairs"],
)
def pair_class(spark, folder):
    number = L.pair_class(F.col("acuitylevel_combined"))
    return inputs.pairs(spark, folder).select(
        "slot", "acuitylevel_combined", F.col("pair_class").alias("drawn_class"), number.alias("acuity_pair_class")
    )


@query("pair_dataset", "SELECT * FROM pairs", ["pairs"])
def pair_dataset(spark, folder):
    return inputs.pairs(spark, folder)
