import datetime

import pytest
from pyspark.sql import types as T

from pairbench import session
from pairbench.sources import files

NASTY = [
    (1, 'a "quoted" word', 1.5, datetime.datetime(2020, 1, 2, 3, 4, 5, 678901)),
    (2, "back\\slash \\n and \\", None, None),
    (3, "line\nbreak\r\nand,comma", -0.0, datetime.datetime(1999, 12, 31)),
    (4, "  padded  ", 2.0, None),
    (5, "", None, None),
    (6, None, None, None),
    (7, "émoji 😀", 1e300, None),
    (8, '"', 0.1, None),
]
SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("at", T.TimestampNTZType()),
    ]
)


def test_csv_roundtrip(spark, tmp_path):
    df = spark.createDataFrame(NASTY, SCHEMA).repartition(3)
    path = str(tmp_path / "csv")
    files.write_csv(df, path)
    files.write_csv(df, path)  # overwrites
    assert sorted(map(tuple, files.read_csv(spark, path, SCHEMA).collect())) == NASTY


def test_csv_splits_into_files(spark, tmp_path):
    path = tmp_path / "csv"
    files.write_csv(spark.range(100).coalesce(1), str(path), max_rows_per_file=30)
    assert len(list(path.glob("part-*"))) == 4


def test_csv_index_column_of_another_writer(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('"","id","text"\n"0","1","a ""b""\nc"\n"1","2",""\n')
    schema = T.StructType(SCHEMA.fields[:2])
    rows = files.read_csv(spark, str(path), schema, index_column=True).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, 'a "b"\nc'), (2, "")]


def test_parquet_overwrite_and_merge(spark, tmp_path):
    path = str(tmp_path / "p")
    files.write_parquet(spark.range(5), path)
    files.write_parquet(spark.range(3), path)
    assert files.read_parquet(spark, path).count() == 3
    files.write_parquet(spark.range(2).selectExpr("id", "'x' AS extra"), path, mode="append")
    assert sorted(files.read_parquet(spark, path, merge_schema=True).columns) == ["extra", "id"]
    assert files.read_parquet(spark, path, ["id"]).columns == ["id"]


def test_views(spark):
    files.register_view(spark.range(4), "four_rows")
    assert files.read_sql(spark, "SELECT * FROM four_rows WHERE id > 1").count() == 2
    assert files.read_table(spark, "four_rows", ["id"]).count() == 4


def test_stage_goes_below_the_shared_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    df = files.stage(spark.range(10).selectExpr("id", "id * 2 AS twice"))
    assert all(f.removeprefix("file://").startswith(root) for f in df.inputFiles())
    assert df.agg({"twice": "sum"}).collect()[0][0] == 90
    assert session.shared_dir(spark) != session.shared_dir(spark)


class _Cluster:
    class conf:
        @staticmethod
        def get(name, default):
            return default

    class sparkContext:
        master = "spark://host:7077"


def test_no_local_folder_on_a_cluster():
    with pytest.raises(ValueError):
        session.shared_dir(_Cluster)


def test_csv_files_are_bounded_by_bytes(spark, tmp_path):
    rows = [(i, "long text\n" * 100) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, t string").coalesce(1)
    files.write_csv(df, str(tmp_path / "c"), max_bytes_per_file=20_000)
    sizes = [p.stat().st_size for p in (tmp_path / "c").glob("*.csv")]
    assert len(sizes) > 5 and max(sizes) <= 20_000 + 100
    back = files.read_csv(spark, str(tmp_path / "c"), df.schema)
    assert sorted(map(tuple, back.collect())) == rows


def test_one_long_row_does_not_cut_the_others_into_small_files(spark, tmp_path):
    short = spark.range(100_000).selectExpr("id", "concat('line\n', id) AS t")
    df = short.unionAll(spark.range(1).selectExpr("-1L AS id", "repeat('long ', 400000) AS t")).coalesce(2)
    for times in range(2):  # overwrites
        files.write_csv(df, str(tmp_path / "c"), max_bytes_per_file=1 << 20)
    sizes = sorted(p.stat().st_size for p in (tmp_path / "c").glob("*.csv"))
    # About 100 bytes a row count as the estimate, so a dozen files do; the long row has one for itself.
    assert len(sizes) < 20 and sizes[-2] <= 1 << 20 and sizes[-1] > 2_000_000
    back = files.read_csv(spark, str(tmp_path / "c"), df.schema)
    assert back.count() == 100_001 and back.exceptAll(df).count() == 0


def test_classes_of_row_lengths(spark):
    df = spark.createDataFrame([(n, "x" * n) for n in (0, 10, 100, 5000, 5001, 10**6, 10**6)], "n int, t string")
    got = files.csv_classes(df, 1 << 20)
    lengths = [n + 70 for n in (0, 10, 100, 5000, 5001, 10**6)]
    assert got[0][0] == 0 and got[-1][1] == 10**6 + 70 and got[-1][2] == 1
    assert [a for a, _, _ in got[1:]] == [b for _, b, _ in got[:-1]]
    for above, upto, rows in got:
        inside = [x for x in lengths if above < x <= upto]
        assert inside and max(inside) <= 16 * min(inside) + 1 and rows == max(1, (1 << 20) // upto)
    assert files.csv_classes(df.limit(0), 100) == []


def test_stages_are_removed_unless_kept(spark):
    with files.stages() as made:
        first = files.stage(spark.range(3))
        second = files.stage(first)
        made.keep()
        third = files.stage(second)
        paths = [df.inputFiles()[0] for df in (second, third)]
        with pytest.raises(Exception, match="(?i)exist"):
            first.count()
    assert second.count() == 3
    assert files.exists(spark, paths[0]) and not files.exists(spark, paths[1])
