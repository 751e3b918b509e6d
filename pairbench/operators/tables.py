"""Projections, filters, joins, set operations and ordering of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename by dictionary, all at once; names that do not occur are ignored."""
    if not isinstance(names, dict):
        raise ValueError("names must be a dict of old to new column names")
    return df.toDF(*[names.get(c, c) for c in df.columns])


def keep_not_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull())


def keep_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def differs(column: Column, value) -> Column:
    """Predicate that drops one value and keeps all others, NULL included."""
    return ~column.eqNullSafe(F.lit(value))


def drop_value(df: DataFrame, column: str, value) -> DataFrame:
    return df.filter(differs(F.col(column), value))


def merge(
    left: DataFrame,
    right: DataFrame,
    left_on: str,
    right_on: str | None = None,
    how: str = "inner",
    suffix: str = "_right",
) -> DataFrame:
    """Equi-join that keeps one key column, under the left name.

    Right columns whose names occur on the left get ``suffix``. An outer merge
    keeps the keys of rows that only the right side has.

    Adaptive execution splits hot keys of inner and left joins but not of full
    outer ones, so an outer merge is a left join plus the right rows without a
    partner.
    """
    right_on = right_on or left_on
    if how not in ("inner", "left", "outer"):
        raise ValueError(f"how must be inner, left or outer, not {how!r}")
    key = "__right_key"
    taken = set(left.columns)
    names = {c: c + suffix for c in right.columns if c in taken}
    names[right_on] = key
    right = rename_columns(right, names)
    joined = left.join(right, F.col(left_on) == F.col(key), "inner" if how == "inner" else "left").drop(key)
    if how != "outer":
        return joined
    left_keys = left.select(F.col(left_on).alias("__left_key")).distinct()
    alone = right.join(left_keys, F.col(key) == F.col("__left_key"), "left_anti")
    return joined.unionByName(alone.withColumnRenamed(key, left_on), allowMissingColumns=True)


def two_hop_lookup(
    fact: DataFrame, near: DataFrame, far: DataFrame, fact_key: str, far_key: str, value: str
) -> DataFrame:
    """Attach a value of a dimension that is reached through another dimension."""
    dimension = merge(near, far, far_key, how="outer").select(fact_key, value)
    return merge(fact, dimension, fact_key, how="left")


def keep_matching(df: DataFrame, other: DataFrame, key: str, other_key: str | None = None) -> DataFrame:
    """Rows whose key occurs in the other table."""
    keys = other.select(F.col(other_key or key).alias(key)).distinct()
    return df.join(keys, key, "left_semi")


def keep_unmatched(df: DataFrame, other: DataFrame, key: str, other_key: str | None = None) -> DataFrame:
    """Rows whose key does not occur in the other table; NULL keys stay."""
    keys = other.select(F.col(other_key or key).alias(key)).distinct()
    return df.join(keys, key, "left_anti")


def key_overlap(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows an inner join on the key would have, and distinct shared keys.

    Both sides are counted per key before they meet, so a key that is frequent
    on both sides costs one row, not the product of its rows.
    """
    a = first.groupBy(key).agg(F.count(F.lit(1)).alias("n_first"))
    b = second.groupBy(key).agg(F.count(F.lit(1)).alias("n_second"))
    return a.join(b, key).agg(
        F.coalesce(F.sum(F.col("n_first") * F.col("n_second")), F.lit(0)).alias("joined_rows"),
        F.count(F.lit(1)).alias("shared_keys"),
    )


def union_rows(*parts: DataFrame) -> DataFrame:
    """All rows of all parts, columns matched by name."""
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def first_per_key(df: DataFrame, keys: str | Sequence[str], order_by: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order.

    Spark applies the limit of one row per key before the shuffle as well, so a
    hot key brings one row per task to its partition.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    window = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn("__rank", F.row_number().over(window)).filter("__rank = 1").drop("__rank")


def drop_duplicates(
    df: DataFrame, subset: Sequence[str], order_by: Sequence[Column] | None = None
) -> DataFrame:
    """One row per key: the first by ``order_by``, or any row without it."""
    if order_by is None:
        return df.dropDuplicates(list(subset))
    return first_per_key(df, subset, order_by)


def last_value_per_key(df: DataFrame, key: str, value: str, order: Column) -> DataFrame:
    """The value that comes last in ``order`` for each key."""
    return df.groupBy(key).agg(F.max_by(F.col(value), order).alias(value))


def sort_values(df: DataFrame, column1: str, column2: str | None = None, how: str = "ascending") -> DataFrame:
    """Sort by one or two columns, both ascending or both descending.

    Ties are ordered by a hash of the row. It also lets Spark cut the range of a
    value that most rows share into several partitions.
    """
    if how not in ("ascending", "descending"):
        raise ValueError(f"how must be ascending or descending, not {how!r}")
    columns = [F.col(c) for c in (column1, column2) if c is not None]
    ordered = [c.asc() if how == "ascending" else c.desc() for c in columns]
    return df.orderBy(*ordered, F.xxhash64(*df.columns))


def top_n(df: DataFrame, n: int, order_by: Sequence[Column]) -> DataFrame:
    """The first n rows in the given order, for reports (n is small)."""
    return df.orderBy(*order_by).limit(n)
