import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def docs(spark):
    """Make a table of documents with nulls in any column and a further column of a clashing name."""
    from pyspark.sql import types as T

    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
            T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
            T.StructField("n_chars", T.LongType()), T.StructField("id", T.StringType()),
        ]
    )

    def make(rows):
        full = [(r + (None,) * 6)[:6] if len(r) < 6 else r for r in (tuple(r) for r in rows)]
        return spark.createDataFrame(full, schema)

    return make
