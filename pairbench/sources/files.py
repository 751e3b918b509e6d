"""Readers, writers and stage tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairbench.session import shared_dir

# One option set for both directions, so that quotes, backslashes, line breaks,
# padding, empty strings, NULLs and microseconds come back as they were written.
_CSV_OPTIONS = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "nullValue": "\\N",
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    # The default formats end at milliseconds.
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
}
_INDEX_COLUMN = "__row_index"
# Lengths of CSV rows in a class differ by this factor at most.
_CLASS = 16


def read_parquet(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    schema: T.StructType | None = None,
    merge_schema: bool = False,
) -> DataFrame:
    reader = spark.read.option("mergeSchema", merge_schema)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.parquet(path)
    return df.select(*columns) if columns else df


def read_table(spark: SparkSession, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.table(name)
    return df.select(*columns) if columns else df


def read_sql(spark: SparkSession, statement: str) -> DataFrame:
    return spark.sql(statement)


def register_view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType, index_column: bool = False
) -> DataFrame:
    """Read a CSV stage; ``index_column`` drops a leading row-number column."""
    if index_column:
        schema = T.StructType([T.StructField(_INDEX_COLUMN, T.StringType()), *schema.fields])
    df = (
        spark.read.schema(schema)
        .options(**_CSV_OPTIONS)
        .option("multiLine", True)
        .option("enforceSchema", True)
        .csv(path)
    )
    return df.drop(_INDEX_COLUMN)


def _csv_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes, quotes and separators included; fields that are no strings count as 32."""
    text = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if isinstance(f.dataType, T.StringType)]
    return sum(text, F.lit(35 * max(1, len(df.columns)))).cast("long")


def csv_classes(df: DataFrame, max_bytes: int) -> list[tuple[int, int, int]]:
    """Classes of row lengths: (bytes above, bytes up to, rows that fit into ``max_bytes``), in one pass.

    A class spans a factor of ``_CLASS``, so its files are filled to that share at least, and a few very
    long rows do not cut the others into small files.
    """
    size = _csv_bytes(df)
    top = F.ceil(F.log(float(_CLASS), size.cast("double")) - F.lit(1e-9)).cast("int")
    found = df.groupBy(top.alias("top")).agg(F.max(size).alias("longest")).orderBy("top").collect()
    edges = [0, *[r["longest"] for r in found]]
    return [(a, b, max(1, max_bytes // b)) for a, b in zip(edges, edges[1:])]


def write_csv(
    df: DataFrame,
    path: str,
    mode: str = "overwrite",
    max_rows_per_file: int = 500_000,
    max_bytes_per_file: int | None = 256 << 20,
) -> None:
    """Write CSV with every field quoted.

    A file whose texts hold line breaks is read back by one task, hence the
    bounds on rows and bytes per file. Only a row that is longer itself makes a
    longer file. Rows are written class by class of their length, each class with
    the number of rows a file that its longest row allows; a table whose rows are of
    similar length is written at once. None for the bytes spares that look at the table.
    """
    classes = [(0, None, max_rows_per_file)]
    if max_bytes_per_file is not None:
        found = csv_classes(df, max_bytes_per_file)
        fits = max_bytes_per_file // found[-1][1] if found else 0
        if found and fits < max_rows_per_file:
            classes = found
    size = _csv_bytes(df)
    for number, (above, upto, rows) in enumerate(classes):
        part = df if len(classes) == 1 else df.filter((size > above) & (size <= upto))
        (
            part.write.mode(mode if number == 0 else "append")
            .options(**_CSV_OPTIONS)
            .option("quoteAll", True)
            .option("maxRecordsPerFile", min(rows, max_rows_per_file))
            .csv(path)
        )


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int | None = None, path: str | None = None) -> DataFrame:
    """Write a catalog table bucketed and sorted by ``key``, and read it back.

    Joins by the key then read this side as it lies, without a shuffle, and deal out
    the other side to its buckets. There are as many buckets as a shuffle has
    partitions, unless told otherwise; with fewer, Spark would rather shuffle than
    lose parallelism. The files go to ``path`` or to the shared folder, one per
    bucket, as rows are dealt out by the key before they are written. A table of that
    name is replaced; it may be part of ``df`` if its files lie elsewhere.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = path or shared_dir(spark)
    dealt = df.repartition(buckets, key).sortWithinPartitions(key)
    fresh = f"{name}_{uuid.uuid4().hex}"
    dealt.write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(fresh)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"ALTER TABLE {fresh} RENAME TO {name}")
    return spark.table(name)


def stage(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` to parquet in the shared folder and read it back.

    Later steps then start from a column-pruned scan of files instead of
    repeating the work upstream, and a lost executor costs no more than a
    reread of them.
    """
    spark = df.sparkSession
    path = path or shared_dir(spark)
    write_parquet(df, path)
    for scope in _scopes:
        scope.paths.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


class _Stages:
    """The stage tables made within a scope."""

    def __init__(self) -> None:
        self.paths: list[tuple[SparkSession, str]] = []

    def keep(self) -> None:
        """The latest stage table stays, and those before it that are not kept go."""
        self._remove(self.paths[:-1])
        self.paths.clear()

    def _remove(self, paths) -> None:
        for spark, path in paths:
            remove(spark, path)


_scopes: list[_Stages] = []


@contextmanager
def stages() -> Iterator[_Stages]:
    """A scope whose stage tables are removed at its end, but for those kept."""
    scope = _Stages()
    _scopes.append(scope)
    try:
        yield scope
    finally:
        _scopes.remove(scope)
        scope._remove(scope.paths)


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever file system."""
    place, system = _place(spark, path)
    return system.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, in whatever file system."""
    place, system = _place(spark, path)
    system.delete(place, True)
