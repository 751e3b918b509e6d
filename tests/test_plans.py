"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pairbench.operators import metrics, notes, pairing, sampling, scoring, tables
from pairbench.plans import jobs
from pairbench.sources import files, testbed

FOLDER = "/root/testdata/sf0.001"
# Queries that call a scorer or a tokenizer of the user's.
PYTHON = {
    name
    for name in entry.queries()
    if name in ("token_count_tokenizer", "score_pairs", "score_pairs_resume")
}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def cohort(spark):
    return jobs.cohort_notes(**testbed.domain(spark, FOLDER))


@pytest.fixture
def no_broadcast(spark):
    """Plans as for tables that are too large to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize(
    "name",
    sorted(n for n in entry.queries() if not re.search("pair|score|metrics|result|respon|evaluat|annot|label|prompt|"
                                                       "balance|halves|semi|anti_join_rest|roundtrip|csv|correct|usage|"
                                                       "cost|^op[0-9]+_|pipeline", n)),
)
def test_no_products_and_no_python(spark, name):
    text = plan(entry.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name not in PYTHON:
        assert "Python" not in text and "InPandas" not in text


def test_cohort_reads_only_what_it_needs(cohort):
    text = plan(cohort.select("visit_occurrence_id", "acuitylevel", "note_text"))
    schemas = re.findall(r"ReadSchema: struct<(.*?)>", text)
    assert all("o_totalprice" not in s and "lang" not in s and "n_chars" not in s for s in schemas)
    assert sum("text" in s for s in schemas) == 1


def test_cohort_filters_come_before_every_join(cohort):
    text = optimized(cohort)
    for table in ("doc_id", "p_partkey"):
        assert re.search(rf"Filter .*\n.*Relation \[.*{table}", text)
    # The age filter turns the duration lookup into an inner join.
    assert text.count("LeftOuter") == 2


def test_texts_are_joined_last(cohort, no_broadcast):
    # In a plan without broadcasts, texts go through one shuffle, by note key.
    exchanges = re.findall(r"Exchange hashpartitioning\((\w+)#", plan(cohort))
    assert exchanges[0] == "deid_note_key"


def test_texts_are_never_broadcast(spark):
    domain = testbed.domain(spark, FOLDER)
    cohort = jobs.cohort_notes(**domain)
    texts = domain.pop("note_text")
    by_header = jobs.prepare_from_headers(jobs.cohort_headers(**domain), texts)
    text = plan(cohort)
    # The one join that meets the texts is a merge join, and it is the last.
    assert text.index("SortMergeJoin [deid_note_key") < text.index("BroadcastHashJoin")
    assert len(re.findall(r"ReadSchema: struct<[^>]*\btext:", text)) == 1
    by_header.collect()
    text = plan(by_header).split("Initial Plan")[0]
    # Visits with one candidate and with several share the scan and the shuffle of texts,
    # below which the wanted keys pick them.
    assert len(re.findall(r"ReadSchema: struct<[^>]*\btext:", text)) == 1 and "ReusedExchange" in text
    below = text[text.index("Exchange hashpartitioning(__right_key"):]
    assert "LeftSemi" in below[: below.index("FileScan")]


def test_bucketed_texts_are_not_shuffled(spark, no_broadcast, tmp_path):
    domain = testbed.domain(spark, FOLDER)
    texts = files.write_bucketed(domain["note_text"], "bucketed_texts", "deid_note_key", path=str(tmp_path / "texts"))
    assert texts.count() == domain["note_text"].count()
    assert len(list((tmp_path / "texts").glob("part-*"))) <= 8
    headers = jobs.note_headers(domain["note_metadata"])
    domain["note_text"] = texts
    for df in (notes.attach_text(headers, texts), jobs.cohort_notes(**domain)):
        text = plan(df)
        assert text.startswith("AdaptiveSparkPlan") and text.index("SortMergeJoin [deid_note_key") < text.index("Exchange")
        # The texts are the last input of the last join; headers are dealt out to their buckets.
        side = text[text.rindex("Sort [__right_key"):]
        assert "Bucketed: true" in side and "Exchange" not in side
        assert "Exchange hashpartitioning(deid_note_key" in text
    # Written anew, also with another number of buckets.
    again = files.write_bucketed(domain["note_text"].limit(5), "bucketed_texts", "deid_note_key", 3, str(tmp_path / "more"))
    assert again.count() == 5
    spark.sql("DROP TABLE bucketed_texts")


def test_headers_are_read_once(spark, no_broadcast):
    domain = testbed.domain(spark, FOLDER)
    domain.pop("note_text")
    text = plan(notes.earliest_notes(notes.with_visit(jobs.cohort_headers(**domain))))
    assert text.count("o_orderkey:") == 1 and text.count("doc_id:") == 1


def test_profiles_of_headers_read_no_texts(spark):
    for name in ("cohort_stats", "duplicate_profile"):
        text = plan(entry.queries()[name](spark, FOLDER))
        assert not re.search(r"ReadSchema: struct<[^>]*\btext:", text) and "[deid_note_key" not in text


def test_prompts_are_shuffled_once(spark):
    pairs = spark.createDataFrame([("a", "p", 1)], "visit_occurrence_id_combined string, prompt string, x int")
    for df in (
        scoring.score_pairs(pairs, lambda row: "0", ("x",), 6),
        scoring.score_pairs(pairs, lambda row: "0", ("x",), 6, last_by=F.col("x")),
    ):
        text = plan(df)
        assert text[text.index("MapInPandas"):].count("Exchange") == 1 and "hashpartitioning" in text
    responses = spark.createDataFrame([("a", "p", "r")], "visit_occurrence_id_combined string, prompt string, response_json string")
    keys = re.findall(r"Join \[([^\]]*)\]", plan(scoring.attach_responses(pairs, responses)))
    assert keys and all("prompt#" not in k.replace("__prompt#", "") for k in keys)


def test_first_note_is_limited_before_the_shuffle(cohort):
    text = plan(jobs.prepare_notes(cohort))
    assert re.search(r"WindowGroupLimit.*row_number\(\), 1, Final", text)
    assert re.search(r"WindowGroupLimit.*row_number\(\), 1, Partial", text)


def test_only_raw_texts_travel(cohort):
    text = plan(jobs.prepare_notes(cohort))
    below = text[text.index("row_number(), 1, Final"):]
    assert "AS note_text_processed" not in below


def test_headings_are_searched_once(cohort):
    text = plan(jobs.refine_notes(jobs.prepare_notes(cohort)).select("visit_occurrence_id", "history_text"))
    assert text.count("instr(") == 9  # spellings of the four headings


def test_exact_split_neither_shuffles_nor_sorts_the_rows(spark):
    rows = spark.read.parquet(f"{FOLDER}/orders.parquet")
    text = plan(sampling.mark_exact(rows, 100, "o_orderkey", 7))
    main = "\n".join(line for line in text.splitlines() if line.startswith(("+-", "   +-")))
    assert "Exchange" not in main and "Sort" not in main
    # Only counts per bucket meet in one partition.
    for at in [m.start() for m in re.finditer("Exchange SinglePartition", text)]:
        assert "HashAggregate(keys=[bucket" in text[at:].split("\n")[1]


def test_ranks_spread_each_stratum(spark, no_broadcast):
    refined = spark.range(1000).selectExpr(
        "string(id) AS visit_occurrence_id", "if(id % 10 < 7, 'Urgent', 'Immediate') AS acuitylevel", "'t' AS history_text"
    )
    text = plan(pairing.balanced_pairs(refined, 50))
    assert "Exchange SinglePartition" not in text and "CartesianProduct" not in text
    windows = re.findall(r"Window \[row_number\(\) windowspecdefinition\((\w+)#\d+L?, (\w+)#", text)
    assert windows and set(windows) == {("acuitylevel", "bucket")}
    # Texts take no part in the ranking.
    below = text[text.index("Window [row_number"):]
    assert "history_text" not in below.split("Window [sum")[0]


def test_outer_merge_is_made_of_joins_that_split_hot_keys(spark, no_broadcast):
    left, right = spark.range(10), spark.range(5, 15).withColumnRenamed("id", "k")
    text = plan(tables.merge(left, right, "id", "k", "outer"))
    assert "FullOuter" not in text and "LeftOuter" in text and "LeftAnti" in text


def test_metrics_of_all_classes_come_from_one_scan(spark):
    df = spark.read.parquet(f"{FOLDER}/labels.parquet").selectExpr(
        "doc_id", "quality AS acuity_pair_class", "'A' AS higher_acuity_patient", "'B' AS label"
    )
    assert plan(metrics.by_class(df)).count("FileScan") == 1
    assert plan(metrics.by_rater(df, {"x": "label"})).count("FileScan") == 1


def test_filters_reach_the_files(spark):
    orders = spark.read.parquet(f"{FOLDER}/orders.parquet").filter(F.col("o_orderkey") >= 10).select("o_orderkey")
    assert "GreaterThanOrEqual(o_orderkey,10)" in plan(orders)
