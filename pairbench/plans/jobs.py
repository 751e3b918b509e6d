"""The four jobs and their chain: cohort, notes, pairs, evaluation."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairbench.constants import (
    HISTORY_TOKEN_LIMIT,
    MIN_AGE_YEARS,
    NOTE_TYPE,
    PAIRS_PER_CLASS,
    SPECIALTIES,
    SPLIT_SEED,
)
from pairbench.functions import labels as L
from pairbench.functions.text import token_count
from pairbench.operators import metrics, notes, pairing, profile, sampling, scoring, tables
from pairbench.schemas import COHORT_VISIT_COLUMNS, DEMOGRAPHIC_COLUMNS, NOTE_METADATA, PAIRS
from pairbench.sources.files import stage, stages


def visits_with_demographics(visits: DataFrame, patients: DataFrame) -> DataFrame:
    return tables.merge(visits, patients.select("person_id", *DEMOGRAPHIC_COLUMNS), "person_id", how="left")


def visits_with_age(visits: DataFrame, durations: DataFrame) -> DataFrame:
    joined = tables.merge(visits, durations.select("durationkey", "days"), "agekey", "durationkey", how="left")
    return joined.withColumn("edvisit_age", L.age_in_years(F.col("days")))


def note_headers(note_metadata: DataFrame) -> DataFrame:
    headers = tables.select_columns(note_metadata, NOTE_METADATA.names)
    return tables.rename_columns(headers, {"person_id": "person_id_notes"})


def cohort_steps(
    min_age: float = MIN_AGE_YEARS, note_type: str = NOTE_TYPE, specialties: Sequence[str] = SPECIALTIES
) -> list[tuple[str, Column]]:
    """The cohort filters, in order, by name."""
    return [
        ("visit has a note", F.lit(True)),
        ("adult", F.col("edvisit_age") >= min_age),
        ("note type", F.col("note_type") == note_type),
        ("specialty", F.col("prov_specialty").isin(list(specialties))),
    ]


def cohort_headers(
    visits: DataFrame,
    patients: DataFrame,
    durations: DataFrame,
    note_metadata: DataFrame,
    steps: Sequence[tuple[str, Column]] | None = None,
) -> DataFrame:
    """Adult visits with the headers of their accepted notes, one row per note."""
    matched = tables.merge(visits_with_age(visits, durations), note_headers(note_metadata), "visit_occurrence_id")
    kept = notes.apply_steps(matched, steps if steps is not None else cohort_steps())
    header_columns = [c for c in NOTE_METADATA.names if c not in ("person_id", "visit_occurrence_id")]
    return visits_with_demographics(kept, patients).select(*COHORT_VISIT_COLUMNS, "person_id_notes", *header_columns)


def cohort_notes(
    visits: DataFrame,
    patients: DataFrame,
    durations: DataFrame,
    note_metadata: DataFrame,
    note_text: DataFrame,
    steps: Sequence[tuple[str, Column]] | None = None,
) -> DataFrame:
    """The cohort with note texts.

    Every filter acts on ids and note headers. Texts are joined last, by the note
    key: it is unique, so texts shuffle evenly even if one visit has most of the
    notes, and only once.
    """
    return notes.attach_text(cohort_headers(visits, patients, durations, note_metadata, steps), note_text)


def cohort_funnel(visits: DataFrame, durations: DataFrame, note_metadata: DataFrame) -> DataFrame:
    matched = tables.merge(visits_with_age(visits, durations), note_headers(note_metadata), "visit_occurrence_id")
    return profile.attrition_funnel(matched, cohort_steps())


def _sections_and_counts(first: DataFrame, count: Callable[[Column], Column]) -> DataFrame:
    return notes.add_token_counts(notes.add_sections(notes.add_section_flags(first)), count)


def prepare_notes(cohort: DataFrame, count: Callable[[Column], Column] = token_count) -> DataFrame:
    """One cleaned, flagged and sectioned note per visit, from a stored cohort."""
    return _sections_and_counts(notes.first_clean_notes(cohort), count)


def prepare_from_headers(
    headers: DataFrame, note_text: DataFrame, count: Callable[[Column], Column] = token_count
) -> DataFrame:
    """The same from cohort headers, fetching only the texts of notes that may stay."""
    return _sections_and_counts(notes.first_clean_notes_by_header(headers, note_text), count)


def refine_notes(prepared: DataFrame, token_limit: int = HISTORY_TOKEN_LIMIT) -> DataFrame:
    return notes.apply_steps(prepared, notes.refine_steps(token_limit))


def build_pairs(
    refined: DataFrame,
    n: int = PAIRS_PER_CLASS,
    seed: int = 0,
    split_seed: int = SPLIT_SEED,
    count: Callable[[Column], Column] = token_count,
) -> DataFrame:
    """Balanced, counterbalanced pairs with truth and prompt, in random order.

    ``refined`` should be a stage table. The drawn pairs are staged here, as the
    exact split reads them several times.
    """
    drawn = stage(pairing.balanced_pairs(refined, n, seed))
    keep = n * len(pairing.PAIR_LEVELS) // 2
    pairs = pairing.add_level_key(pairing.add_truth(pairing.counterbalance(drawn, keep, split_seed)))
    # Prompts repeat both histories, so they are put together after the shuffle.
    shuffled = sampling.shuffle_rows(pairs, ["pair_class", "slot"], split_seed)
    return pairing.add_prompt(shuffled, count).select(*PAIRS.names)


def evaluate(
    results: Mapping[str, DataFrame], annotations: DataFrame, rater: str = "rater"
) -> DataFrame:
    """All metrics of all models, and of the rater on the annotated subset, in one table.

    ``scope`` tells full results from the annotated subset; a NULL class stands
    for all classes together. The results of all models are counted per class in
    one pass, and so is the subset; the totals come from those counts.
    """
    columns = [scoring.PAIR_ID, metrics.STRATUM, metrics.TRUTH, "label"]
    every = tables.union_rows(*[df.select(*columns, F.lit(name).alias("model")) for name, df in results.items()])
    subset = metrics.annotated_subset(every, annotations, scoring.PAIR_ID)
    by = ["model", metrics.STRATUM]
    full = metrics.rater_counts(every, {"model": "label"}, by).withColumn("scope", F.lit("all"))
    part = metrics.rater_counts(subset, {"model": "label", rater: "rater_label_binary"}, by)
    per_class = tables.union_rows(full, part.withColumn("scope", F.lit("annotated")))
    model = F.col("model")
    rated_by = F.when(F.col("rater") == rater, F.concat(F.lit(f"{rater} on "), model)).otherwise(model)
    per_class = per_class.withColumn("rater", rated_by).drop("model")
    total = metrics.total_counts(per_class, ["scope", "rater"]).withColumn(metrics.STRATUM, F.lit(None).cast("int"))
    known = per_class.filter(F.col(metrics.STRATUM).isNotNull())
    return metrics.rates(tables.union_rows(known, total))


def run_chain(
    domain: Mapping[str, DataFrame],
    scorers: Mapping[str, scoring.Scorer],
    annotate: Callable[[DataFrame], DataFrame],
    n: int = PAIRS_PER_CLASS,
    seed: int = 0,
    inputs: tuple[str, ...] = (),
    partitions: int | None = None,
) -> dict[str, DataFrame]:
    """All jobs in a row with a stage table after each; returns the stages by name.

    Stage tables that only lead to a returned one are removed.
    """
    results = {}
    with stages() as made:
        headers = stage(cohort_headers(*[domain[t] for t in ("visits", "patients", "durations", "note_metadata")]))
        refined = stage(refine_notes(prepare_from_headers(headers, domain["note_text"])))
        made.keep()
        pairs = stage(build_pairs(refined, n, seed))
        made.keep()
        for name, scorer in scorers.items():
            responses = stage(scoring.score_pairs(pairs, scorer, inputs, partitions))
            results[name] = stage(metrics.mark_results(scoring.process_responses(pairs, responses)))
            made.keep()
    annotations = annotate(pairs)
    return {
        "refined": refined,
        "pairs": pairs,
        "annotations": annotations,
        **{f"results_{name}": df for name, df in results.items()},
        "evaluation": evaluate(results, annotations),
    }
