"""Scoring, response parsing and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairbench.constants import CALL_FAILED
from pairbench.functions import labels as L
from pairbench.operators import metrics, scoring, tables
from pairbench.plans import jobs
from pairbench.session import shared_dir
from pairbench.sources import testbed
from pairbench.sources.files import stage
from pairbench.workload import checks, inputs
from pairbench.workload.registry import query

@query(
    "dedup_prompts",
    """SELECT visit_occurrence_id_combined, prompt FROM pairs
    QUALIFY row_number() OVER (PARTITION BY visit_occurrence_id_combined ORDER BY pair_class DESC, slot DESC) = 1""",
    ["pairs"],
)
def dedup_prompts(spark, folder):
    return scoring.prompts_by_id(inputs.pairs(spark, folder), F.struct("pair_class", "slot"))


@query("score_pairs", "SELECT * FROM responses", ["responses"])
def score_pairs(spark, folder):
    return inputs.responses(inputs.staged_pairs(spark, folder))


@query("score_pairs_resume", "SELECT * FROM responses", ["responses"])
def score_pairs_resume(spark, folder):
    """A first run of which the failed calls are not kept, and its completion."""
    pairs = inputs.staged_pairs(spark, folder)
    stored = tables.drop_value(inputs.responses(pairs), "response_json", CALL_FAILED)
    return scoring.score_remaining(pairs, stored, testbed.offline_scorer(), inputs=testbed.SCORER_INPUTS)


@query("score_pairs_logged", "SELECT * FROM responses", ["responses"])
def score_pairs_logged(spark, folder):
    """A first run that got as far as one side of the pairs and left only its log, and its completion."""
    pairs = inputs.staged_pairs(spark, folder)
    scorer, log = testbed.offline_scorer(), shared_dir(spark)
    stage(scoring.score_pairs(pairs.filter("higher_acuity_patient = 'A'"), scorer, testbed.SCORER_INPUTS, log=log))
    return scoring.score_logged(pairs, scorer, log, inputs=testbed.SCORER_INPUTS)


@query(
    "attach_responses",
    """SELECT pair_class, slot, visit_occurrence_id_combined, response_json
    FROM pairs JOIN responses USING (visit_occurrence_id_combined, prompt)""",
    ["pairs", "responses"],
)
def attach_responses(spark, folder):
    pairs = inputs.staged_pairs(spark, folder)
    answered = scoring.attach_responses(pairs, inputs.responses(pairs))
    return answered.select("pair_class", "slot", scoring.PAIR_ID, "response_json")


@query("parse_response", "SELECT visit_occurrence_id_combined, prompt, response_content FROM responses_answers",
       ["responses_answers"])
def parse_response(spark, folder):
    responses = inputs.responses(inputs.staged_pairs(spark, folder))
    content = L.response_content(F.col("response_json"))
    return responses.select(scoring.PAIR_ID, "prompt", content.alias("response_content"))


_COUNTER = """CASE WHEN json_valid(response_json)
    THEN try_cast(json_extract_string(response_json, '$.usage.{name}') AS INTEGER) END AS {name}"""


@query(
    "parse_usage",
    f"""SELECT visit_occurrence_id_combined, prompt, {_COUNTER.format(name="prompt_tokens")},
        {_COUNTER.format(name="completion_tokens")} FROM responses""",
    ["responses"],
)
def parse_usage(spark, folder):
    responses = inputs.responses(inputs.staged_pairs(spark, folder))
    return scoring.add_usage(responses).select(scoring.PAIR_ID, "prompt", "prompt_tokens", "completion_tokens")


@query(
    "parse_event_properties",
    "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events",
)
def parse_event_properties(spark, folder):
    k = F.get_json_object("props", "$.k").try_cast("int")
    return testbed.table(spark, folder, "events").select("event_id", k.alias("k"))


@query(
    "retrieve_label",
    "SELECT visit_occurrence_id_combined, prompt, response_content, label FROM responses_answers",
    ["responses_answers"],
)
def retrieve_label(spark, folder):
    responses = inputs.responses(inputs.staged_pairs(spark, folder))
    return scoring.parse_responses(responses).select(scoring.PAIR_ID, "prompt", "response_content", "label")


@query("retrieve_label_text", f"SELECT doc_id, {checks.answer_label('text')} AS label FROM documents")
def retrieve_label_text(spark, folder):
    """The same rule over long free text."""
    return testbed.table(spark, folder, "documents").select("doc_id", L.answer_label(F.col("text")).alias("label"))


@query(
    "process_responses",
    """SELECT p.*, r.response_json, a.response_content, a.label FROM pairs p
    JOIN responses r USING (visit_occurrence_id_combined, prompt)
    JOIN responses_answers a USING (visit_occurrence_id_combined, prompt)""",
    ["pairs", "responses", "responses_answers"],
)
def process_responses(spark, folder):
    pairs = inputs.staged_pairs(spark, folder)
    return scoring.process_responses(pairs, inputs.responses(pairs))


@query(
    "correct_flag",
    "SELECT pair_class, slot, label, higher_acuity_patient, correct_label FROM results",
    ["results"],
)
def correct_flag(spark, folder):
    results = inputs.results(inputs.staged_pairs(spark, folder))
    return results.select("pair_class", "slot", "label", "higher_acuity_patient", "correct_label")


@query(
    "result_overlap",
    """SELECT (SELECT count(*) FROM results JOIN results2 USING (visit_occurrence_id_combined)) AS joined_rows,
        (SELECT count(*) FROM (SELECT visit_occurrence_id_combined FROM results
            INTERSECT SELECT visit_occurrence_id_combined FROM results2)) AS shared_keys""",
    ["results", "results2"],
)
def result_overlap(spark, folder):
    pairs = inputs.staged_pairs(spark, folder)
    return tables.key_overlap(inputs.results(pairs), inputs.results(pairs, True), scoring.PAIR_ID)


@query(
    "semi_join_subset",
    """SELECT pair_class, slot, visit_occurrence_id_combined, label FROM results2
    WHERE visit_occurrence_id_combined IN (SELECT visit_occurrence_id_combined FROM annotations)""",
    ["results2", "annotations"],
)
def semi_join_subset(spark, folder):
    pairs = inputs.staged_pairs(spark, folder)
    subset = tables.keep_matching(inputs.results(pairs, True), inputs.annotations(pairs), scoring.PAIR_ID)
    return subset.select("pair_class", "slot", scoring.PAIR_ID, "label")


@query(
    "attach_annotations",
    """SELECT pair_class, slot, visit_occurrence_id_combined, label, rater_label, rater_label_binary FROM annotated""",
    ["annotated"],
)
def attach_annotations(spark, folder):
    return inputs.annotated(spark, folder).select(
        "pair_class", "slot", scoring.PAIR_ID, "label", "rater_label", "rater_label_binary"
    )


def _rounded(df):
    return df.withColumns({c: F.round(c, 9) for c in ("accuracy", "f1")})


def _rounded_sql(select: str) -> str:
    return f"SELECT * REPLACE (round(accuracy, 9) AS accuracy, round(f1, 9) AS f1) FROM ({select})"


_MODEL = checks.metrics("higher_acuity_patient", "label")
_RATER = checks.metrics("higher_acuity_patient", "rater_label_binary")


@query("metrics_overall", _rounded_sql(f"SELECT {_MODEL} FROM results"), ["results"])
def metrics_overall(spark, folder):
    return _rounded(metrics.overall(inputs.results(inputs.staged_pairs(spark, folder))))


@query(
    "metrics_by_class",
    _rounded_sql(f"SELECT acuity_pair_class, {_MODEL} FROM results WHERE acuity_pair_class IS NOT NULL GROUP BY 1"),
    ["results"],
)
def metrics_by_class(spark, folder):
    return _rounded(metrics.by_class(inputs.results(inputs.staged_pairs(spark, folder))))


@query(
    "metrics_by_class_rater",
    _rounded_sql(f"SELECT acuity_pair_class, {_RATER} FROM annotated WHERE acuity_pair_class IS NOT NULL GROUP BY 1"),
    ["annotated"],
)
def metrics_by_class_rater(spark, folder):
    return _rounded(metrics.by_class(inputs.annotated(spark, folder), predicted="rater_label_binary"))


@query(
    "metrics_by_rater",
    _rounded_sql(
        f"SELECT 'model' AS rater, {_MODEL} FROM annotated UNION ALL SELECT 'person', {_RATER} FROM annotated"
    ),
    ["annotated"],
)
def metrics_by_rater(spark, folder):
    raters = {"model": "label", "person": "rater_label_binary"}
    return _rounded(metrics.by_rater(inputs.annotated(spark, folder), raters))


_AS_SIDES = "CASE {c} WHEN 1 THEN 'A' WHEN 0 THEN 'B' END"


@query(
    "label_metrics_by_language",
    _rounded_sql(
        f"""SELECT lang, {checks.metrics('truth', 'predicted')}
        FROM (SELECT lang, {_AS_SIDES.format(c='quality')} AS truth, {_AS_SIDES.format(c='toxic')} AS predicted
            FROM labels JOIN documents USING (doc_id)) GROUP BY lang"""
    ),
)
def label_metrics_by_language(spark, folder):
    """Metrics of one binary label against another, by a stratum of another table."""
    documents = testbed.table(spark, folder, "documents").select("doc_id", "lang")
    labelled = tables.merge(testbed.table(spark, folder, "labels"), documents, "doc_id").withColumns(
        {"truth": L.recode(F.col("quality"), {1: "A", 0: "B"}), "predicted": L.recode(F.col("toxic"), {1: "A", 0: "B"})}
    )
    return _rounded(metrics.by_class(labelled, "truth", "predicted", "lang"))


def _evaluation_sql() -> str:
    parts = []
    for name, table in (("model 1", "results"), ("model 2", "results2")):
        subset = f"(SELECT r.*, a.rater_label_binary FROM {table} r JOIN annotations a USING (visit_occurrence_id_combined))"
        for scope, source, rater, select in (
            ("all", table, name, _MODEL),
            ("annotated", subset, name, _MODEL),
            ("annotated", subset, f"rater on {name}", _RATER),
        ):
            head = f"SELECT '{scope}' AS scope, '{rater}' AS rater"
            parts.append(f"{head}, acuity_pair_class, {select} FROM {source} GROUP BY ALL")
            parts.append(f"{head}, NULL::INTEGER AS acuity_pair_class, {select} FROM {source}")
    return _rounded_sql(" UNION ALL ".join(parts))


@query("evaluate", _evaluation_sql(), ["results", "results2", "annotations"])
def evaluate(spark, folder):
    pairs = inputs.staged_pairs(spark, folder)
    # Only what is counted is written.
    columns = [scoring.PAIR_ID, metrics.STRATUM, metrics.TRUTH, "label"]
    results = {
        "model 1": stage(inputs.results(pairs).select(*columns)),
        "model 2": stage(inputs.results(pairs, True).select(*columns)),
    }
    return _rounded(jobs.evaluate(results, inputs.annotations(pairs)))
