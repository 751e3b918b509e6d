"""Sources, projections, filters, joins, sets and ordering."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairbench.functions import labels as L
from pairbench.operators import notes, tables
from pairbench.plans import jobs
from pairbench.session import shared_dir
from pairbench.sources import files, testbed
from pairbench.workload import inputs
from pairbench.workload.checks import acuity_rank
from pairbench.workload.registry import query


@query("scan_parquet", "SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem")
def scan_parquet(spark, folder):
    return files.read_parquet(
        spark, f"{folder}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_quantity", "l_shipdate"]
    )


@query(
    "scan_sql_view",
    "SELECT care_site_id, location_id, location_source_value FROM care_sites JOIN locations USING (location_id)",
    ["care_sites", "locations"],
)
def scan_sql_view(spark, folder):
    files.register_view(testbed.care_sites(spark, folder), "care_site")
    files.register_view(testbed.locations(spark, folder), "location")
    sites = files.read_sql(spark, "SELECT * FROM care_site")
    places = files.read_table(spark, "location", ["location_id", "location_source_value"])
    return sites.join(places, "location_id").select("care_site_id", "location_id", "location_source_value")


_SPARSE = "CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE text END"


@query("csv_roundtrip", f"SELECT doc_id, text, lang, source, n_chars, {_SPARSE} AS sparse_text FROM documents")
def csv_roundtrip(spark, folder):
    df = testbed.table(spark, folder, "documents").withColumn("sparse_text", F.expr(_SPARSE))
    path = shared_dir(spark)
    files.write_csv(df, path)
    return files.read_csv(spark, path, df.schema)


@query("csv_index_column", "SELECT doc_id, text FROM documents")
def csv_index_column(spark, folder):
    """A CSV whose first column is a nameless row number, as some writers leave it."""
    df = testbed.table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("row_number"), "doc_id", "text"
    )
    path = shared_dir(spark)
    files.write_csv(df, path)
    schema = T.StructType(df.schema.fields[1:])
    return files.read_csv(spark, path, schema, index_column=True)


@query("parquet_roundtrip", "SELECT * FROM cohort", ["cohort"])
def parquet_roundtrip(spark, folder):
    path = shared_dir(spark)
    files.write_parquet(inputs.cohort(spark, folder), path)
    return files.read_parquet(spark, path, merge_schema=True)


@query("select_columns", "SELECT person_id, visit_occurrence_id, arrival_datetime, acuitylevel FROM visits", ["visits"])
def select_columns(spark, folder):
    names = ["person_id", "visit_occurrence_id", "arrival_datetime", "acuitylevel"]
    return tables.select_columns(testbed.visits(spark, folder), names)


@query(
    "rename_columns",
    "SELECT deid_note_key AS visit_occurrence_id, visit_occurrence_id AS deid_note_key, note_type FROM note_metadata",
    ["note_metadata"],
)
def rename_columns(spark, folder):
    df = testbed.note_metadata(spark, folder).select("deid_note_key", "visit_occurrence_id", "note_type")
    names = {"deid_note_key": "visit_occurrence_id", "visit_occurrence_id": "deid_note_key", "absent": "x"}
    return tables.rename_columns(df, names)


@query(
    "visit_age", "SELECT visit_occurrence_id, days, round(edvisit_age, 9) AS edvisit_age FROM aged_visits", ["aged_visits"]
)
def visit_age(spark, folder):
    aged = jobs.visits_with_age(testbed.visits(spark, folder), testbed.durations(spark, folder))
    return aged.select("visit_occurrence_id", "days", F.round("edvisit_age", 9).alias("edvisit_age"))


@query(
    "timestamp_year",
    """SELECT o_orderkey, year(try_strptime(stamp, '%d/%m/%Y %H:%M'))::INTEGER AS order_year
    FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'no date'
        ELSE strftime(o_orderdate, '%d/%m/%Y %H:%M') END AS stamp FROM orders)""",
)
def timestamp_year(spark, folder):
    stamp = F.when(F.col("o_orderstatus") == "P", "no date").otherwise(
        F.date_format("o_orderdate", "dd/MM/yyyy HH:mm")
    )
    year = L.timestamp_year(stamp, "dd/MM/yyyy HH:mm")
    return testbed.table(spark, folder, "orders").select("o_orderkey", year.alias("order_year"))


@query(
    "recode_map",
    f"SELECT visit_occurrence_id, acuitylevel, {acuity_rank('acuitylevel')} AS acuity_rank FROM visits",
    ["visits"],
)
def recode_map(spark, folder):
    rank = L.acuity_rank(F.col("acuitylevel"))
    return testbed.visits(spark, folder).select("visit_occurrence_id", "acuitylevel", rank.alias("acuity_rank"))


@query(
    "relabel",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'B' ELSE o_orderstatus END AS label FROM orders",
)
def relabel(spark, folder):
    label = L.relabel(F.col("o_orderstatus"), {"F": "A", "O": "B"})
    return testbed.table(spark, folder, "orders").select("o_orderkey", label.alias("label"))


@query(
    "cohort_adults",
    """SELECT visit_occurrence_id, person_id, days, round(edvisit_age, 9) AS edvisit_age FROM aged_visits
    WHERE edvisit_age >= 18""",
    ["aged_visits"],
)
def cohort_adults(spark, folder):
    aged = jobs.visits_with_age(testbed.visits(spark, folder), testbed.durations(spark, folder))
    return aged.filter("edvisit_age >= 18").select(
        "visit_occurrence_id", "person_id", "days", F.round("edvisit_age", 9).alias("edvisit_age")
    )


@query(
    "null_filters",
    """SELECT v.visit_occurrence_id, n.deid_note_key,
        CASE WHEN n.deid_note_key IS NULL THEN 'without note' ELSE 'with note' END AS part
    FROM visits v LEFT JOIN note_metadata n USING (visit_occurrence_id)""",
    ["visits", "note_metadata"],
)
def null_filters(spark, folder):
    headers = testbed.note_metadata(spark, folder).select("visit_occurrence_id", "deid_note_key")
    visits = testbed.visits(spark, folder).select("visit_occurrence_id")
    merged = tables.merge(visits, headers, "visit_occurrence_id", how="left")
    return tables.union_rows(
        tables.keep_not_null(merged, "deid_note_key").withColumn("part", F.lit("with note")),
        tables.keep_null(merged, "deid_note_key").withColumn("part", F.lit("without note")),
    )


@query(
    "drop_value",
    """SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS priority FROM orders
    WHERE nullif(o_orderpriority, '5-LOW') IS DISTINCT FROM '1-URGENT'""",
)
def drop_value(spark, folder):
    priority = F.nullif(F.col("o_orderpriority"), F.lit("5-LOW"))
    df = testbed.table(spark, folder, "orders").select("o_orderkey", priority.alias("priority"))
    return tables.drop_value(df, "priority", "1-URGENT")


@query(
    "merge_inner",
    """SELECT l_orderkey, l_linenumber, l_extendedprice, o_custkey, o_orderdate
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def merge_inner(spark, folder):
    items = testbed.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    orders = testbed.table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return tables.merge(items, orders, "l_orderkey", "o_orderkey")


@query("merge_left", "SELECT o_orderkey, o_custkey, lang, n_chars FROM orders LEFT JOIN documents ON o_orderkey = doc_id")
def merge_left(spark, folder):
    orders = testbed.table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    documents = testbed.table(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    return tables.merge(orders, documents, "o_orderkey", "doc_id", how="left")


@query(
    "merge_outer",
    """SELECT coalesce(l.doc_id, p.page_id) AS doc_id, l.quality, l.url, p.url AS url_page
    FROM (SELECT doc_id, quality, 'label ' || toxic AS url FROM labels) l
    FULL JOIN pages p ON l.doc_id = p.page_id""",
)
def merge_outer(spark, folder):
    label = F.concat(F.lit("label "), F.col("toxic").cast("string"))
    labels = testbed.table(spark, folder, "labels").select("doc_id", "quality", label.alias("url"))
    pages = testbed.table(spark, folder, "pages").select("page_id", "url")
    return tables.merge(labels, pages, "doc_id", "page_id", how="outer", suffix="_page")


@query("visit_demographics", "SELECT * FROM visits LEFT JOIN patients USING (person_id)", ["visits", "patients"])
def visit_demographics(spark, folder):
    return jobs.visits_with_demographics(testbed.visits(spark, folder), testbed.patients(spark, folder))


@query(
    "notes_with_text",
    """SELECT n.* EXCLUDE (person_id), n.person_id AS person_id_notes, note_text
    FROM note_metadata n LEFT JOIN note_text USING (deid_note_key)""",
    ["note_metadata", "note_text"],
)
def notes_with_text(spark, folder):
    headers = jobs.note_headers(testbed.note_metadata(spark, folder))
    return notes.attach_text(headers, testbed.note_text(spark, folder))


def _bucketed_texts(spark, folder):
    return files.write_bucketed(testbed.note_text(spark, folder), f"note_text_{uuid.uuid4().hex}", "deid_note_key")


@query(
    "notes_with_text_bucketed",
    """SELECT n.* EXCLUDE (person_id), n.person_id AS person_id_notes, note_text
    FROM note_metadata n LEFT JOIN note_text USING (deid_note_key)""",
    ["note_metadata", "note_text"],
)
def notes_with_text_bucketed(spark, folder):
    """The same with texts that lie in buckets by note key, as they would for repeated cohorts."""
    headers = jobs.note_headers(testbed.note_metadata(spark, folder))
    return notes.attach_text(headers, _bucketed_texts(spark, folder))


@query("cohort_notes_bucketed", "SELECT * FROM cohort", ["cohort"])
def cohort_notes_bucketed(spark, folder):
    return jobs.cohort_notes(**{**testbed.domain(spark, folder), "note_text": _bucketed_texts(spark, folder)})


@query(
    "two_hop_lookup",
    """SELECT c_custkey, care_site_id, location_source_value
    FROM (SELECT c_custkey, c_nationkey::BIGINT AS care_site_id FROM customer)
    LEFT JOIN (SELECT care_site_id, location_source_value
        FROM (SELECT care_site_id, nullif(location_id, 0) AS location_id FROM care_sites)
        FULL JOIN locations USING (location_id)) USING (care_site_id)""",
    ["care_sites", "locations"],
)
def two_hop_lookup(spark, folder):
    facts = testbed.table(spark, folder, "customer").select(
        "c_custkey", F.col("c_nationkey").cast("bigint").alias("care_site_id")
    )
    # Sites without a location and a location without sites, for the outer join.
    sites = testbed.care_sites(spark, folder).withColumn("location_id", F.nullif("location_id", F.lit(0)))
    places = testbed.locations(spark, folder)
    return tables.two_hop_lookup(facts, sites, places, "care_site_id", "location_id", "location_source_value")


@query(
    "anti_join_null_keys",
    """SELECT o_orderkey, custkey FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS custkey
        FROM orders)
    WHERE custkey IS NULL OR custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')""",
)
def anti_join_null_keys(spark, folder):
    key = F.when(F.col("o_orderstatus") != "P", F.col("o_custkey"))
    orders = testbed.table(spark, folder, "orders").select("o_orderkey", key.alias("custkey"))
    machinery = testbed.table(spark, folder, "customer").filter("c_mktsegment = 'MACHINERY'")
    return tables.keep_unmatched(orders, machinery, "custkey", "c_custkey")


@query("drop_duplicates_keys", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def drop_duplicates_keys(spark, folder):
    df = testbed.table(spark, folder, "lineitem")
    return tables.drop_duplicates(df, ["l_suppkey", "l_returnflag"]).select("l_suppkey", "l_returnflag")


@query(
    "drop_duplicates_ordered",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey
        ORDER BY l_shipdate DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice) = 1""",
)
def drop_duplicates_ordered(spark, folder):
    """The last shipped line of each order."""
    order = [F.desc("l_shipdate"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    df = testbed.table(spark, folder, "lineitem")
    return tables.drop_duplicates(df, ["l_orderkey"], order).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate"
    )


@query("sort_values", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC")
def sort_values(spark, folder):
    df = testbed.table(spark, folder, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return tables.sort_values(df, "o_orderdate", "o_orderkey", "descending")


@query("top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 200")
def top_n(spark, folder):
    df = testbed.table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return tables.top_n(df, 200, [F.desc("o_totalprice"), F.asc("o_orderkey")])
