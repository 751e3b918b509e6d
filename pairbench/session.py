"""Session settings and the shared folder for stage tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime settings the plans count on. Adaptive execution picks broadcast or
# sort-merge from measured sizes and splits skewed join partitions, also where
# that costs one more shuffle.
ADAPTIVE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Note headers are a few percent of the texts they pick; a Bloom filter of
    # their keys spares the shuffle of all other texts. It has a bounded size itself.
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g",
}


def tune(spark: SparkSession) -> SparkSession:
    """Switch on the adaptive settings; sizes and partition counts stay the user's."""
    for name, value in ADAPTIVE_CONF.items():
        spark.conf.set(name, value)
    return spark


# Texts travel to Python in batches of about this many rows and bytes at most.
BATCH_ROWS = 512
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> SparkSession:
    """Arrow batches that bound a Python worker's memory, however large a partition is."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    Only a local session may do without that setting; it then gets a temporary
    folder, which no other machine has to see.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="pairbench-")
    return f"{root.rstrip('/')}/pairbench-{uuid.uuid4().hex}"
