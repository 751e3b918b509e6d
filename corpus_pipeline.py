"""A training corpus from ``documents``, in five stages of operators in ``pairbench.llm``.

Every stage but the last returns the columns it gets, those of ``documents``; others
may be there too, under any names but those that begin with two underscores:

1. ``toxicity``: rows whose score is at or above the threshold go.
2. ``ngram_jaccard_join``: of each component of near duplicates (five words,
   similarity of 0.8 or more) the row with the smallest id stays, rows without an id
   last. Rows that share an id are told apart by their texts, so unrelated ones all
   stay; of rows with the same id and text, the first by their other columns stays.
3. ``benchmark_decontamination``: rows in which an item is found go.
4. ``mixing``: all rows stay; they are put, and written, in the order of the mix.
5. ``token_id_output``: token files in that order, read back: one row per document
   with the ids before it, its number of ids and their checksum.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairbench.llm import decontaminate, mixing, ngram_join, rans, toxicity
from pairbench.llm.common import prepare, stage, table
from pairbench.operators import tables


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that a model of the labelled rows scores as toxic."""
    prepare(spark)
    known = toxicity.labelled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, toxicity.fit(known), "__score")
    return scored.filter(F.col("__score") < toxicity.THRESHOLD).select(*docs.columns)


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with a key of their id and text, and another one that tells apart those that share a key by chance."""
    parts = ["doc_id", F.col("doc_id").isNull(), "text", F.col("text").isNull()]
    return docs.withColumns({"__key": F.xxhash64(*parts), "__other": F.xxhash64(F.lit(1), *parts)})


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of near duplicates."""
    prepare(spark)
    keyed = _keyed(docs)
    found = ngram_join.similar_components(keyed.select("__key", "text"), words=5, percent=80, id="__key")
    ids = keyed.select("__key", "doc_id").distinct().join(found.select("__key", "component_id").distinct(), "__key")
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__key"))["__key"]
    kept = ids.groupBy("component_id").agg(best.alias("__key")).select("__key")
    rows = keyed.join(kept, "__key", "left_semi")
    order = [F.asc_nulls_last(c) for c in docs.columns if c not in ("doc_id", "text")]
    return tables.first_per_key(rows, ["__key", "__other"], order or [F.lit(0)]).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold an item of the benchmark."""
    prepare(spark)
    keyed = _keyed(docs)
    found = decontaminate.contaminated(keyed.select("__key", "text"), table(spark, sf_dir, "benchmark"), id="__key")
    gone = found.select(F.col("doc_id").alias("__key")).distinct()
    return keyed.join(gone, "__key", "left_anti").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put documents in the order of the mix; written files keep it."""
    prepare(spark)
    packed = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("__row"))
    placed = mixing.interleave(packed, keep=["__row"])
    order = ["slot", "start_char", "order"]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).select("__row.*")


def written_order(file: Column, row: Column) -> list[Column]:
    """The order of rows in a folder that Spark has written: by the number of the part, however long, then by row."""
    return [F.regexp_extract(file, r"part-(\d+)", 1).cast("long").alias("part"), file.alias("file"), row.alias("row")]


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write token files in the order in which the documents were written, and read them back."""
    prepare(spark)
    place = written_order(F.col("_metadata.file_name"), F.col("_metadata.row_index"))
    placed = docs.select("doc_id", "text", *place)
    manifest = rans.write(placed, public_tokenizers.path("word_bpe_49k.json"), order=["part", "file", "row"])
    return rans.read(manifest)


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", without_near_duplicates),
    ("benchmark_decontamination", without_benchmark),
    ("mixing", mixed),
    ("token_id_output", token_files),
]

#: A model and an approximate index take part, so no SQL gives these rows; tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and reread by the next."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, step) in enumerate(STAGES, 1):
        docs = step(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = stage(docs)
    return docs
