"""Shared inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairbench.constants import PAIRS_PER_CLASS
from pairbench.operators import metrics, notes, pairing, scoring
from pairbench.plans import jobs
from pairbench.sources import testbed
from pairbench.sources.files import stage
from pairbench.workload.checks import ANNOTATED_PER_CLASS

N = PAIRS_PER_CLASS


def cohort(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.cohort_notes(**testbed.domain(spark, folder))


def headers(spark: SparkSession, folder: str) -> DataFrame:
    """The cohort without texts."""
    domain = testbed.domain(spark, folder)
    domain.pop("note_text")
    return jobs.cohort_headers(**domain)


def first_notes(spark: SparkSession, folder: str) -> DataFrame:
    note_text = testbed.domain(spark, folder)["note_text"]
    return notes.first_clean_notes_by_header(headers(spark, folder), note_text)


def prepared(spark: SparkSession, folder: str) -> DataFrame:
    domain = testbed.domain(spark, folder)
    note_text = domain.pop("note_text")
    return jobs.prepare_from_headers(jobs.cohort_headers(**domain), note_text)


def refined(spark: SparkSession, folder: str) -> DataFrame:
    """Refined notes as a stage table, which the pair draw reads several times.

    Only the three columns that pairs are made of are written.
    """
    return stage(
        jobs.refine_notes(prepared(spark, folder)).select("visit_occurrence_id", "acuitylevel", "history_text")
    )


def balanced(spark: SparkSession, folder: str) -> DataFrame:
    return pairing.balanced_pairs(refined(spark, folder), N)


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.build_pairs(refined(spark, folder), N)


def staged_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return stage(pairs(spark, folder))


def responses(staged: DataFrame, second_model: bool = False) -> DataFrame:
    """Stub responses, staged, so that nothing is scored twice."""
    scorer = testbed.offline_scorer(second_model)
    return stage(scoring.score_pairs(staged, scorer, inputs=testbed.SCORER_INPUTS))


def results(staged: DataFrame, second_model: bool = False) -> DataFrame:
    return metrics.mark_results(scoring.process_responses(staged, responses(staged, second_model)))


def annotations(staged: DataFrame) -> DataFrame:
    return testbed.annotations(staged, ANNOTATED_PER_CLASS)


def annotated(spark: SparkSession, folder: str) -> DataFrame:
    """Results of the second model on the annotated subset."""
    staged = staged_pairs(spark, folder)
    return metrics.annotated_subset(results(staged, True), annotations(staged), scoring.PAIR_ID)
