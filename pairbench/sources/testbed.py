"""Domain tables derived from the generic test tables, and an offline scorer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairbench import schemas
from pairbench.constants import CALL_FAILED, UNSPECIFIED_ACUITY
from pairbench.operators.scoring import PAIR_ID, Scorer

_LEVEL_OF_PRIORITY = {"1": "Immediate", "2": "Emergent", "3": "Urgent", "4": "Less Urgent", "5": "Non-Urgent"}
SCORER_INPUTS = ("history_text_A", "history_text_B", "prompt_tokens")

# Declared, so that opening a table starts no job to read file footers.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")


def _shaped(df: DataFrame, schema: T.StructType, values: dict[str, str]) -> DataFrame:
    """Select the columns of a schema by SQL expressions; those without one are NULL."""
    return df.selectExpr(
        *[f"CAST({values.get(f.name, 'NULL')} AS {f.dataType.simpleString()}) AS {f.name}" for f in schema.fields]
    )


def visits(spark: SparkSession, folder: str) -> DataFrame:
    n_parts = table(spark, folder, "part").agg(F.count(F.lit(1))).scalar()
    orders = table(spark, folder, "orders").withColumn("agekey", F.col("o_orderkey") % n_parts)
    levels = " ".join(f"WHEN '{digit}' THEN '{name}'" for digit, name in _LEVEL_OF_PRIORITY.items())
    return _shaped(
        orders,
        schemas.VISITS,
        {
            "person_id": "o_custkey",
            "person_id2": "o_custkey",
            "ed_visit_occurrence_id": "o_orderkey",
            "visit_occurrence_id": "o_orderkey",
            "agekey": "agekey",
            "agekeyvalue": "agekey",
            "arrival_datetime": "o_orderdate",
            "eddisposition": "o_orderstatus",
            "acuitylevel": f"CASE WHEN o_orderkey % 50 = 49 THEN '{UNSPECIFIED_ACUITY}' "
            f"ELSE CASE left(o_orderpriority, 1) {levels} END END",
        },
    )


def patients(spark: SparkSession, folder: str) -> DataFrame:
    return _shaped(
        table(spark, folder, "customer"),
        schemas.PATIENTS,
        {
            "person_id": "c_custkey",
            "sex": "if(c_custkey % 2 = 0, 'F', 'M')",
            "ethnicity": "c_mktsegment",
            "firstrace": "c_nationkey",
            "multiracial": "if(c_custkey % 10 = 0, 'Y', 'N')",
        },
    )


def durations(spark: SparkSession, folder: str) -> DataFrame:
    values = {"durationkey": "p_partkey", "days": "p_size * 365"}
    return _shaped(table(spark, folder, "part"), schemas.DURATIONS, values)


def care_sites(spark: SparkSession, folder: str) -> DataFrame:
    values = {"care_site_id": "n_nationkey", "location_id": "n_regionkey"}
    return _shaped(table(spark, folder, "nation"), schemas.CARE_SITES, values)


def locations(spark: SparkSession, folder: str) -> DataFrame:
    values = {"location_id": "r_regionkey", "location_source_value": "r_name"}
    return _shaped(table(spark, folder, "region"), schemas.LOCATIONS, values)


def note_metadata(spark: SparkSession, folder: str) -> DataFrame:
    visit = "doc_id div 2"
    return _shaped(
        table(spark, folder, "documents"),
        schemas.NOTE_METADATA,
        {
            "person_id": visit,
            "deid_note_key": "doc_id",
            "visit_occurrence_id": visit,
            "note_type": "if(doc_id % 10 = 9, 'Progress Notes', 'ED Provider Notes')",
            "prov_specialty": "CASE doc_id % 8 WHEN 0 THEN 'UCSF' WHEN 1 THEN 'Pediatrics' ELSE 'Emergency Medicine' END",
            "deid_service_date": f"date_add(DATE '2020-01-01', CAST(({visit}) % 365 + if(doc_id % 4 = 1, 1, 0) AS INT))",
        },
    )


def note_text(spark: SparkSession, folder: str) -> DataFrame:
    """Notes with the whole document text, under headings that vary with the key."""
    head, middle = "substring(text, 1, 200)", "substring(text, 201, 200)"
    rest, tail = "substring(text, 201)", "substring(text, 401)"
    note = f"""CASE doc_id % 20
        WHEN 3 THEN text
        WHEN 5 THEN concat('Physical Exam ', {head}, ' Chief Complaint ', {rest}, ' Initial Assessment x')
        WHEN 6 THEN concat('CHIEF COMPLAINT ', {head}, ' PHYSICAL EXAM ', {middle}, ' ED COURSE ', {tail})
        WHEN 7 THEN concat('Chief Complaint ', {head}, ' Physical Exam ', {rest})
        ELSE concat('History Chief Complaint ', {head}, '\\n', '  Review of Systems Physical Exam ', {middle},
            ' Initial Assessment ', {tail}, ' Plan: rest') END"""
    values = {"deid_note_key": "doc_id", "note_text": note}
    return _shaped(table(spark, folder, "documents"), schemas.NOTE_TEXT, values)


def domain(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    makers = (visits, patients, durations, note_metadata, note_text)
    return {make.__name__: make(spark, folder) for make in makers}


def annotations(pairs: DataFrame, per_class: int) -> DataFrame:
    """Labels of an imagined second rater for the first pairs of each class."""
    m = F.conv(F.substring(F.md5(F.col(PAIR_ID).cast("binary")), 1, 8), 16, 10).cast("bigint")
    truth = F.col("higher_acuity_patient")
    side = F.when(m % 7 != 0, truth).when(truth == "A", "B").otherwise("A")
    chosen = pairs.filter(F.col("slot") < per_class).select(PAIR_ID, side.alias("rater_label_binary"))
    # A pair drawn twice is annotated once.
    return chosen.groupBy(PAIR_ID).agg(F.min("rater_label_binary").alias("rater_label_binary")).select(
        PAIR_ID,
        F.when(F.col("rater_label_binary") == "A", "0").otherwise("1").alias("rater_label"),
        "rater_label_binary",
    )


def offline_scorer(second_model: bool = False) -> Scorer:
    """A deterministic stand-in for a model: it prefers the longer history.

    Everything it uses is bound here, so that workers need no import of this module.
    """
    failed = CALL_FAILED

    def score(row) -> str:
        import hashlib
        import json

        m = int(hashlib.md5(row["visit_occurrence_id_combined"].encode()).hexdigest()[:8], 16)
        if m % 29 == 0:
            return failed
        lead = m % 50 if second_model else 0
        if m % 31 == 0:
            content = "Unable to say"
        elif len(row["history_text_A"]) + lead >= len(row["history_text_B"]):
            content = "0: Patient A is of higher acuity"
        else:
            content = "1: Patient B is of higher acuity"
        document = {
            "choices": [{"message": {"content": content}}],
            "usage": {"prompt_tokens": int(row["prompt_tokens"]), "completion_tokens": 9},
        }
        return json.dumps(document, separators=(",", ":"))

    return score
