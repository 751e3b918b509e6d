"""Counts, profiles and histograms, each as one small DataFrame.

Every profile aggregates in its tasks before anything is shuffled, and reads
its input once unless its docstring says otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairbench.constants import SECTION_HEADERS, TOKEN_RATE_PER_1000
from pairbench.sources.files import stage


def _report(df: DataFrame, rows: Sequence[Sequence[Column]], names: Sequence[str]) -> DataFrame:
    """One global aggregate, laid out as a table with one row per entry."""
    table = F.array(*[F.struct(*[c.alias(n) for c, n in zip(row, names)]) for row in rows])
    return df.agg(table.alias("report")).select(F.inline("report"))


def _count(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"))


def nunique(df: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    """Number of distinct values; NULL counts as one of them."""
    if approximate:
        has_null = F.coalesce(F.max(F.col(column).isNull().cast("bigint")), F.lit(0))
        return df.agg((F.approx_count_distinct(column) + has_null).alias("n_unique"))
    return df.select(column).distinct().agg(F.count(F.lit(1)).alias("n_unique"))


def value_counts(df: DataFrame, column: str, dropna: bool = False, top: int | None = None) -> DataFrame:
    """Frequency of each value, most frequent first; ties in order of the value."""
    if dropna:
        df = df.filter(F.col(column).isNotNull())
    counts = df.groupBy(column).count().orderBy(F.desc("count"), F.asc_nulls_last(column))
    return counts.limit(top) if top is not None else counts


def group_sizes(df: DataFrame, *columns: str) -> DataFrame:
    """Rows per combination of the columns; combinations with a NULL are left out."""
    return df.dropna(subset=list(columns)).groupBy(*columns).count()


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NULLs, NULLs or empty strings, and other values of each column."""
    rows = []
    for name in columns or df.columns:
        value = F.col(name)
        text = isinstance(df.schema[name].dataType, T.StringType)
        blank = (value.isNull() | (value == "")) if text else value.isNull()
        rows.append([F.lit(name), _count(value.isNull()), _count(blank), F.count(value)])
    return _report(df, rows, ["column_name", "n_null", "n_null_or_empty", "n_not_null"])


def column_equality(df: DataFrame, first: str, second: str) -> DataFrame:
    """How often two columns are equal, different, or not comparable (NULL)."""
    return df.groupBy((F.col(first) == F.col(second)).alias("match_y_n")).count()


def duplicate_profile(df: DataFrame, key: str) -> DataFrame:
    """Rows that share their key with others, and rows beyond the first of their key."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)), F.lit(0)).alias("rows_in_groups"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("rows_beyond_first"),
    )


def staged_with_checks(df: DataFrame, checks: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Write a stage table and count violations on the way: the table, and rows (check, violations).

    The counts are metrics of the write itself, so checks cost no further pass. A task
    that runs twice is counted once. NULL conditions are no violations.
    """
    seen = Observation()
    counts = [_count(condition).alias(name) for name, condition in checks.items()]
    staged = stage(df.observe(seen, F.count(F.lit(1)).alias("__rows"), *counts))
    found = seen.get
    rows = [(name, int(found.get(name, 0))) for name in checks]
    return staged, df.sparkSession.createDataFrame(rows, "check string, violations long")


def cost_estimate(df: DataFrame, tokens: str, rate_per_1000: float = TOKEN_RATE_PER_1000) -> DataFrame:
    return df.agg(
        F.sum(F.col(tokens).cast("bigint")).alias("total_tokens"),
        (F.sum(F.col(tokens).cast("bigint")).cast("double") * F.lit(rate_per_1000) / 1000).alias("cost"),
    )


def histogram(df: DataFrame, column: str, scale: str = "linear", bins: int = 20) -> DataFrame:
    """Equal-width bins over the integer part of a column, or over its natural log.

    Reads the column twice: once for its range and once for the counts. Values
    that are no finite numbers are left out.
    """
    if scale not in ("linear", "log"):
        raise ValueError(f"scale must be linear or log, not {scale!r}")
    raw = F.col(column).try_cast("double")
    finite = F.when(F.abs(raw) < F.lit(float("inf")), raw)
    value = F.when(finite > 0, F.ln(finite)) if scale == "log" else finite - finite % 1
    values = df.select(value.alias("x")).filter("x IS NOT NULL")
    span = values.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi")).alias("span"))
    binned = values.withColumn("span", span.scalar()).select(
        F.when(F.col("span.hi") == F.col("span.lo"), 0)
        .otherwise(
            F.least(
                F.floor((F.col("x") - F.col("span.lo")) / (F.col("span.hi") - F.col("span.lo")) * bins),
                F.lit(bins - 1),
            )
        )
        .cast("int")
        .alias("bin")
    )
    counts = binned.groupBy("bin").count()
    every_bin = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    width = (F.col("span.hi") - F.col("span.lo")) / bins
    return (
        every_bin.join(counts, "bin", "left")
        .withColumn("span", span.scalar())
        .select(
            "bin",
            (F.col("span.lo") + F.col("bin") * width).alias("bin_start"),
            (F.col("span.lo") + (F.col("bin") + 1) * width).alias("bin_end"),
            F.coalesce("count", F.lit(0)).alias("count"),
        )
    )


def cohort_stats(df: DataFrame, patient: str = "person_id", visit: str = "visit_occurrence_id") -> DataFrame:
    """Rows, distinct patients and distinct visits; NULL counts as one value."""

    def distinct(name):
        has_null = F.coalesce(F.max(F.col(name).isNull().cast("bigint")), F.lit(0))
        return F.count_distinct(F.col(name)) + has_null

    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        distinct(patient).alias("n_patients"),
        distinct(visit).alias("n_visits"),
    )


def section_prevalence(df: DataFrame, flags: Sequence[str] = tuple(SECTION_HEADERS)) -> DataFrame:
    """How many notes have and lack each section."""
    rows = [
        [F.lit(name), F.lit(flag), _count(F.col(name) == flag)] for name in flags for flag in ("Y", "N")
    ]
    return _report(df, rows, ["section", "flag", "count"]).filter("count > 0")


def attrition_funnel(
    df: DataFrame, steps: Sequence[tuple[str, Column]], key: str = "visit_occurrence_id"
) -> DataFrame:
    """Rows and distinct keys left after each of several successive filters.

    Each row gets the number of leading filters it passes. Rows are counted and
    the best row of each key is found in one aggregation by key; a second one
    over the keys gives all steps at once.
    """
    total = len(steps)
    passed = F.when(F.lit(False), F.lit(0))
    for number, (_, condition) in enumerate(steps):
        passed = passed.when(~F.coalesce(condition, F.lit(False)), F.lit(number))
    per_key = (
        df.select(F.col(key).alias("key"), passed.otherwise(F.lit(total)).alias("passed"))
        .groupBy("key")
        .agg(
            F.max("passed").alias("best"),
            *[F.count_if(F.col("passed") > i).alias(f"rows_{i}") for i in range(total)],
        )
    )
    rows = [
        [
            F.lit(i + 1),
            F.lit(name),
            F.coalesce(F.sum(f"rows_{i}"), F.lit(0)),
            F.count_if(F.col("best") > i),
        ]
        for i, (name, _) in enumerate(steps)
    ]
    return _report(per_key, rows, ["step", "filter", "n_rows", "n_visits"])
