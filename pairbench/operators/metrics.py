"""Accuracy and F1, overall, by pair class and by rater."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairbench.functions import labels as L
from pairbench.operators import tables

# Answers '0' and '1' stand for side A and side B.
ANSWER_SIDES = {"0": "A", "1": "B"}
TRUTH = "higher_acuity_patient"
STRATUM = "acuity_pair_class"


def mark_results(df: DataFrame) -> DataFrame:
    """Answers as sides, correctness and pair class of processed responses."""
    return (
        df.withColumn("label", L.relabel(F.col("label"), ANSWER_SIDES))
        .withColumn("correct_label", L.correct_flag(F.col("label"), F.col(TRUTH)))
        .withColumn(STRATUM, L.pair_class(F.col("acuitylevel_combined")))
    )


def outcome_counts(
    df: DataFrame, by: Sequence[str], truth: str, predicted: str, weight: str | None = None, positive: str = "A"
) -> DataFrame:
    """Additive counts per group, from which all metrics follow.

    ``weight`` names a column that says how many results a row stands for.
    """
    times = F.col(weight) if weight else F.lit(1)
    is_true = F.coalesce(F.col(truth) == positive, F.lit(False))
    is_predicted = F.coalesce(F.col(predicted) == positive, F.lit(False))
    conditions = {
        "n": F.lit(True),
        "truth_a": is_true,
        "truth_b": F.col(truth) == "B",
        "n_correct": F.col(truth) == F.col(predicted),
        "tp": is_true & is_predicted,
        "fp": ~is_true & is_predicted,
        "fn": is_true & ~is_predicted,
    }
    return df.groupBy(*by).agg(
        *[F.coalesce(F.sum(F.when(c, times)), F.lit(0)).alias(name) for name, c in conditions.items()]
    )


def total_counts(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts of coarser groups."""
    names = ("n", "truth_a", "truth_b", "n_correct", "tp", "fp", "fn")
    return counts.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])


def _f1() -> Column:
    denominator = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return F.when(denominator == 0, F.lit(0.0)).otherwise(2.0 * F.col("tp") / denominator)


def rates(counts: DataFrame) -> DataFrame:
    """Accuracy and F1 in place of the raw outcome counts."""
    accuracy = F.when(F.col("n") > 0, F.col("n_correct").cast("double") / F.col("n"))
    return counts.withColumns({"accuracy": accuracy, "f1": _f1()}).drop("tp", "fp", "fn")


def overall(df: DataFrame, truth: str = TRUTH, predicted: str = "label") -> DataFrame:
    return rates(outcome_counts(df, [], truth, predicted))


def by_class(df: DataFrame, truth: str = TRUTH, predicted: str = "label", stratum: str = STRATUM) -> DataFrame:
    """Metrics of each stratum in its order; rows without a stratum are left out."""
    known = df.filter(F.col(stratum).isNotNull())
    return rates(outcome_counts(known, [stratum], truth, predicted)).orderBy(stratum)


def rater_counts(
    df: DataFrame, raters: Mapping[str, str], by: Sequence[str] = (), truth: str = TRUTH
) -> DataFrame:
    """Outcome counts of several label columns; ``raters`` maps name to column.

    Results are counted per combination of group, truth and labels first, so that
    only those few rows are laid out once per rater.
    """
    columns = list(dict.fromkeys([*by, truth, *raters.values()]))
    combos = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("times"))
    labels = F.array(
        *[F.struct(F.lit(name).alias("rater"), F.col(c).alias("rated")) for name, c in raters.items()]
    )
    long = combos.select(*by, truth, "times", F.inline(labels))
    return outcome_counts(long, ["rater", *by], truth, "rated", weight="times")


def by_rater(
    df: DataFrame, raters: Mapping[str, str], by: Sequence[str] = (), truth: str = TRUTH
) -> DataFrame:
    """Metrics of several label columns side by side."""
    return rates(rater_counts(df, raters, by, truth))


def annotated_subset(results: DataFrame, annotations: DataFrame, key: str) -> DataFrame:
    """Results of the annotated keys with their annotations.

    Keeping the annotated keys and then attaching the annotations is one inner join.
    """
    return tables.merge(results, annotations, key)
