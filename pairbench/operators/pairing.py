"""Balanced, counterbalanced pairs of visits across acuity levels."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairbench.constants import (
    ACUITY_RANK,
    ANSWER_RESERVE,
    INTRO_TOKENS,
    MODEL_TOKEN_LIMIT,
    PAIR_LEVELS,
    PAIRS_PER_CLASS,
    PROMPT_FRAME,
    SPLIT_SEED,
)
from pairbench.functions import labels as L
from pairbench.functions.text import token_count
from pairbench.operators import sampling

SIDE_COLUMNS = ("visit_occurrence_id", "acuitylevel", "history_text", "seed")
_CLASSES = len(PAIR_LEVELS)


def class_seeds(seed: int) -> list[tuple[int, int]]:
    """A seed for either side of each pair class."""
    return [(seed + 2 * c, seed + 2 * c + 1) for c in range(_CLASSES)]


def _at(values: Sequence, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index + 1)


def balanced_pairs(
    refined: DataFrame,
    n: int = PAIRS_PER_CLASS,
    seed: int = 0,
    seeds: Sequence[tuple[int, int]] | None = None,
) -> DataFrame:
    """n pairs for each of the ten ordered level pairs, side A the more acute.

    Both sides are drawn with replacement, each with its own seed. Only ids and
    levels are ranked; texts join the picks at the end. ``refined`` is read
    three times, so it should be a stage table.
    """
    seeds = list(seeds or class_seeds(seed))
    levels = refined.filter(F.col("acuitylevel").isin(list(ACUITY_RANK)))
    ranks, sizes = sampling.stratum_ranks(
        levels, "acuitylevel", "visit_occurrence_id", seed, strata=len(ACUITY_RANK)
    )

    # One request per class, slot and side, numbered by a range instead of a
    # product of tables.
    length = 2 * _CLASSES * n
    requests = refined.sparkSession.range(length).select(
        F.expr(f"id div 2 % {_CLASSES}").cast("int").alias("pair_class"),
        F.expr(f"id div {2 * _CLASSES}").alias("slot"),
        F.expr("id % 2").cast("int").alias("side"),
    )
    place = F.col("pair_class") * 2 + F.col("side")
    requests = requests.withColumns(
        {
            "acuitylevel": _at([x for pair in PAIR_LEVELS for x in pair], place),
            "seed": _at([x for pair in seeds for x in pair], place),
        }
    )
    side = F.when(F.col("side") == 0, "A").otherwise("B")
    number = sampling.hash_number(F.md5(F.concat_ws("-", "seed", "pair_class", side, "slot").cast("binary")))
    picks = sampling.draw(requests, ranks, sizes, "acuitylevel", number, length)
    texts = refined.select("visit_occurrence_id", "history_text")
    sides = (
        sampling.broadcast_if_short(picks, length)
        .join(texts, "visit_occurrence_id")
        .select("pair_class", "slot", "side", F.struct(*SIDE_COLUMNS).alias("visit"))
    )
    pairs = sides.groupBy("pair_class", "slot").agg(
        F.any_value(F.when(F.col("side") == 0, F.col("visit")), True).alias("A"),
        F.any_value(F.when(F.col("side") == 1, F.col("visit")), True).alias("B"),
    )
    # A class has no pairs unless both of its levels occur.
    return pairs.filter("A IS NOT NULL AND B IS NOT NULL").select(
        "pair_class",
        "slot",
        *[F.col(f"{side}.{c}").alias(f"{c}_{side}") for side in "AB" for c in SIDE_COLUMNS],
        L.joined_key(F.col("A.visit_occurrence_id"), F.col("B.visit_occurrence_id")).alias(
            "visit_occurrence_id_combined"
        ),
    )


def swap_sides(pairs: DataFrame, keep: Column) -> DataFrame:
    """Exchange every A and B column where ``keep`` is false; the pair id stays."""
    swapped = {}
    for c in SIDE_COLUMNS:
        a, b = F.col(f"{c}_A"), F.col(f"{c}_B")
        swapped[f"{c}_A"] = F.when(keep, a).otherwise(b)
        swapped[f"{c}_B"] = F.when(keep, b).otherwise(a)
    return pairs.withColumns(swapped)


def counterbalance(pairs: DataFrame, keep: int, seed: int = SPLIT_SEED) -> DataFrame:
    """Leave exactly ``keep`` random pairs as they are and swap the sides of all others."""
    marked = sampling.mark_exact(pairs, keep, ["pair_class", "slot"], seed, "__keep")
    return swap_sides(marked, F.col("__keep")).drop("__keep")


def add_truth(pairs: DataFrame) -> DataFrame:
    """Numeric levels, their difference and the side of higher acuity."""
    return (
        pairs.withColumns({f"acuitylevel_int_{s}": L.acuity_rank(F.col(f"acuitylevel_{s}")) for s in "AB"})
        .withColumn("acuity_level_int_BminusA", F.col("acuitylevel_int_B") - F.col("acuitylevel_int_A"))
        .withColumn("higher_acuity_patient", L.side_from_difference(F.col("acuity_level_int_BminusA")))
    )


def add_level_key(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn(
        "acuitylevel_combined", L.joined_key(F.col("acuitylevel_A"), F.col("acuitylevel_B"))
    )


def add_prompt(pairs: DataFrame, count: Callable[[Column], Column] = token_count) -> DataFrame:
    return pairs.withColumn(
        "prompt", L.pair_prompt(F.col("history_text_A"), F.col("history_text_B"))
    ).withColumn("prompt_tokens", count(F.col("prompt")))


def unordered_pair_counts(pairs: DataFrame) -> DataFrame:
    """Pairs per combination of levels, whichever side they are on."""
    ordered = pairs.dropna(subset=["acuitylevel_A", "acuitylevel_B"]).groupBy("acuitylevel_A", "acuitylevel_B").count()
    label = L.unordered_label(F.col("acuitylevel_A"), F.col("acuitylevel_B"))
    return ordered.groupBy(label.alias("labels")).agg(F.sum("count").alias("count")).orderBy("count", "labels")


def prompt_budget(
    pairs: DataFrame,
    model_limit: int = MODEL_TOKEN_LIMIT,
    intro_tokens: int = INTRO_TOKENS,
    answer_reserve: int = ANSWER_RESERVE,
    count: Callable[[Column], Column] = token_count,
) -> DataFrame:
    """Longest prompt and number of prompts over the limit the model leaves for them.

    ``counted_intro_tokens`` is the length of the empty prompt in the tokenizer
    in use, next to the ``intro_tokens`` that the limit is based on.
    """
    limit = model_limit - intro_tokens - answer_reserve
    return pairs.agg(
        F.any_value(count(F.lit(PROMPT_FRAME))).alias("counted_intro_tokens"),
        F.lit(limit).alias("token_limit"),
        F.max("prompt_tokens").alias("max_prompt_tokens"),
        F.count_if(F.col("prompt_tokens") > limit).alias("prompts_over_limit"),
    )


def pair_invariants(pairs: DataFrame) -> DataFrame:
    """Violations of each property that finished pairs should have.

    Pairs drawn twice are counted too; sampling with replacement may produce some.
    """
    checks = {
        "line break in history": F.contains(F.col("history_text_A"), F.lit("\n"))
        | F.contains(F.col("history_text_B"), F.lit("\n")),
        "no prompt": F.col("prompt").isNull(),
        "visit paired with itself": F.col("visit_occurrence_id_A") == F.col("visit_occurrence_id_B"),
        "equal acuity": F.col("acuitylevel_A") == F.col("acuitylevel_B"),
    }
    names = list(checks)
    per_pair = pairs.groupBy("visit_occurrence_id_combined").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.coalesce(checks[c], F.lit(False))).alias(f"check_{i}") for i, c in enumerate(names)],
    )
    totals = [(c, F.sum(f"check_{i}")) for i, c in enumerate(names)] + [
        ("repeated pair id", F.sum(F.col("n") - 1))
    ]
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("check"), F.coalesce(total, F.lit(0)).alias("violations"))
            for c, total in totals
        ]
    )
    return per_pair.agg(rows.alias("report")).select(F.inline("report"))
