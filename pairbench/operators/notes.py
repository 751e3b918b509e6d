"""From raw notes to one cleaned, sectioned note per visit."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairbench.constants import (
    CHIEF_COMPLAINT,
    ED_COURSE,
    HISTORY_TOKEN_LIMIT,
    INITIAL_ASSESSMENT,
    NOT_EXTRACTED,
    PHYSICAL_EXAM,
    SECTION_HEADERS,
    SECTION_TEXTS,
    UNSPECIFIED_ACUITY,
)
from pairbench.functions import text as X
from pairbench.operators import tables
from pairbench.operators.sampling import BROADCAST_ROWS
from pairbench.sources.files import stage


def bind(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are computed exactly once per row.

    Spark moves a filter below an ordinary projection by repeating the projected
    expressions in it. Text searches are too dear for that, and it does not
    happen below a generator, here one that yields one row.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def attach_text(headers: DataFrame, note_text: DataFrame, rows: int | None = None) -> DataFrame:
    """Add the texts of notes.

    Only wanted texts should shuffle. If the number of header rows is known and
    small, their keys are broadcast and pick the texts at the scan. Otherwise the
    texts join by sorting, and Spark builds a Bloom filter of the keys where
    headers are a small part (``tune`` raises its size limit). Texts themselves
    are never broadcast: compressed files say little about their size.
    """
    texts = note_text.select("deid_note_key", "note_text")
    if rows is not None and rows <= BROADCAST_ROWS:
        wanted = headers.select(F.col("deid_note_key").alias("__wanted")).distinct()
        texts = texts.join(F.broadcast(wanted), F.col("deid_note_key") == F.col("__wanted"), "left_semi")
    return tables.merge(headers, texts.hint("merge"), "deid_note_key", how="left")


def with_visit(df: DataFrame) -> DataFrame:
    """Visit id as string and service date as timestamp.

    Rows without a visit id are dropped: they belong to no visit.
    """
    date = F.col("deid_service_date")
    if isinstance(df.schema["deid_service_date"].dataType, T.StringType):
        date = F.try_to_timestamp(date).cast("timestamp_ntz")
    return df.filter(F.col("visit_occurrence_id").isNotNull()).withColumns(
        {"visit_occurrence_id": F.col("visit_occurrence_id").cast("string"), "deid_service_date": date}
    )


def measure_notes(df: DataFrame) -> DataFrame:
    """Add the length of the cleaned text.

    It counts characters; its name is part of the data contract.
    """
    text = F.col("note_text").cast("string")
    return df.withColumns({"note_text": text, "note_length_words": F.char_length(X.clean_note(text))})


def clean_notes(df: DataFrame) -> DataFrame:
    return df.withColumn("note_text_processed", X.clean_note(F.col("note_text")))


def first_clean_notes(cohort: DataFrame) -> DataFrame:
    """One cleaned note per visit, from notes that have their text.

    Only raw texts travel: those that stay are cleaned again after the shuffle.
    """
    return clean_notes(first_note_per_visit(measure_notes(with_visit(cohort))))


def earliest_notes(headers: DataFrame) -> DataFrame:
    """All notes of the earliest date of each visit; missing dates count as latest.

    Headers are read once. Spark applies the limit of the rank before the shuffle
    as well, so later notes of a hot visit do not travel.
    """
    by_date = Window.partitionBy("visit_occurrence_id").orderBy(F.asc_nulls_last("deid_service_date"))
    return headers.withColumn("__rank", F.rank().over(by_date)).filter("__rank = 1").drop("__rank")


def first_clean_notes_by_header(headers: DataFrame, note_text: DataFrame) -> DataFrame:
    """One cleaned note per visit, from note headers and the table of texts.

    The date alone rules out most notes of a visit, so it is compared before any
    text is fetched; lengths decide among those that are left. Only texts of
    visits with several candidates shuffle again, by visit. The candidates' headers
    are staged, so that they are found once and their number is known.
    """
    visit = Window.partitionBy("visit_occurrence_id")
    several = F.count(F.lit(1)).over(visit) > 1
    candidates = stage(earliest_notes(with_visit(headers)).withColumn("__several", several))
    measured = measure_notes(attach_text(candidates, note_text, candidates.count()))
    alone = measured.filter("NOT __several")
    chosen = first_note_per_visit(measured.filter("__several"))
    return clean_notes(alone.unionByName(chosen).drop("__several"))


def first_note_per_visit(df: DataFrame) -> DataFrame:
    """The earliest note of each visit, the longest of that time, then the lowest key."""
    return tables.first_per_key(
        df,
        "visit_occurrence_id",
        [F.asc_nulls_last("deid_service_date"), F.desc_nulls_last("note_length_words"), F.asc("deid_note_key")],
    )


def add_section_flags(df: DataFrame, text: str = "note_text_processed") -> DataFrame:
    return df.withColumns({c: X.contains_flag(F.col(text), h) for c, h in SECTION_HEADERS.items()})


def add_sections(df: DataFrame, text: str = "note_text_processed") -> DataFrame:
    """History, examination and assessment text of each note.

    The text is searched once for each heading, and every slice reuses the
    positions.
    """
    note = F.col(text)
    headings = {
        "__complaint": CHIEF_COMPLAINT,
        "__exam": PHYSICAL_EXAM,
        "__assessment": INITIAL_ASSESSMENT,
        "__course": ED_COURSE,
    }
    complaint, exam, assessment, course = (F.col(c) for c in headings)
    closing = F.coalesce(assessment, course)
    sections = {
        "history_text": X.slice_between(note, complaint, exam),
        "examination_text": X.slice_between(note, exam, closing),
        "assessment_plan_text": X.slice_to_end(note, closing),
    }
    found = bind(df, {c: X.first_position(note, p) for c, p in headings.items()})
    return bind(found, sections).drop(*headings)


def add_token_counts(df: DataFrame, count: Callable[[Column], Column] = X.token_count) -> DataFrame:
    return df.withColumns(
        {f"{c}_tokens": count(F.col(c)) for c in ("note_text_processed", "history_text")}
    )


def note_checks(text: str = "note_text_processed") -> dict[str, Column]:
    """What must hold for no cleaned note, by name; for ``profile.staged_with_checks``."""
    note = F.col(text)
    return {
        "no text": note.isNull(),
        "line break in note": F.contains(note, F.lit("\n")),
        "run of spaces in note": F.contains(note, F.lit("  ")),
        "no visit": F.col("visit_occurrence_id").isNull(),
        "no service date": F.col("deid_service_date").isNull(),
    }


def refine_steps(token_limit: int = HISTORY_TOKEN_LIMIT) -> list[tuple[str, Column]]:
    """The filters between prepared and refined notes, in order, by name."""
    steps = [("acuity specified", tables.differs(F.col("acuitylevel"), UNSPECIFIED_ACUITY))]
    steps += [(f"{c} not null", F.col(c).isNotNull()) for c in SECTION_TEXTS]
    steps += [(f"{c} extracted", tables.differs(F.col(c), NOT_EXTRACTED)) for c in SECTION_TEXTS]
    steps += [(f"{c} not empty", tables.differs(F.col(c), "")) for c in SECTION_TEXTS]
    steps += [("history within budget", F.col("history_text_tokens") <= token_limit)]
    return steps


def apply_steps(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    for _, condition in steps:
        df = df.filter(condition)
    return df
