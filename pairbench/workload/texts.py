"""Text cleaning, sections and note preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairbench.constants import (
    CHIEF_COMPLAINT,
    ED_COURSE,
    INITIAL_ASSESSMENT,
    NOT_EXTRACTED,
    PHYSICAL_EXAM,
    SECTION_HEADERS,
)
from pairbench.functions import text as X
from pairbench.operators import notes, tables
from pairbench.plans import jobs
from pairbench.session import bound_batches
from pairbench.sources import testbed
from pairbench.sources.files import stage
from pairbench.workload import inputs
from pairbench.workload.checks import between, cleaned, position, quoted, to_end, tokens
from pairbench.workload.registry import query


def _notes(spark, folder):
    """Every note, cleaned."""
    text = X.clean_note(F.col("note_text"))
    return testbed.note_text(spark, folder).select("deid_note_key", text.alias("note"))


_CLEAN_NOTES = f"(SELECT deid_note_key, {cleaned('note_text')} AS note FROM note_text)"


@query("clean_text", f"SELECT doc_id, {cleaned('text')} AS clean_text FROM documents")
def clean_text(spark, folder):
    text = X.clean_note(F.col("text"))
    return testbed.table(spark, folder, "documents").select("doc_id", text.alias("clean_text"))


@query(
    "section_flags",
    "SELECT deid_note_key, "
    + ", ".join(
        f"CASE WHEN contains(note, {quoted(h)}) THEN 'Y' ELSE 'N' END AS {c}" for c, h in SECTION_HEADERS.items()
    )
    + f" FROM {_CLEAN_NOTES}",
    ["note_text"],
)
def section_flags(spark, folder):
    return notes.add_section_flags(_notes(spark, folder), "note").drop("note")


_START, _END = ("The ", "And "), ("Is ", "Of ")


@query(
    "extract_between",
    f"SELECT doc_id, {between('text', position('text', _START), position('text', _END))} AS passage FROM documents",
)
def extract_between(spark, folder):
    passage = X.extract_between(F.col("text"), _START, _END)
    return testbed.table(spark, folder, "documents").select("doc_id", passage.alias("passage"))


@query(
    "extract_page_body",
    f"""SELECT page_id, {between('html', position('html', ['<article']), position('html', ['</body>']))} AS body
    FROM pages""",
)
def extract_page_body(spark, folder):
    body = X.extract_between(F.col("html"), ["<article"], ["</body>"])
    return testbed.table(spark, folder, "pages").select("page_id", body.alias("body"))


@query(
    "extract_fallback",
    f"""SELECT deid_note_key, CASE WHEN ia IS NOT NULL THEN {between('note', 'pe', 'ia')}
        WHEN ec IS NOT NULL THEN {between('note', 'pe', 'ec')} ELSE {quoted(NOT_EXTRACTED)} END AS examination_text
    FROM (SELECT *, {position('note', PHYSICAL_EXAM)} AS pe, {position('note', INITIAL_ASSESSMENT)} AS ia,
        {position('note', ED_COURSE)} AS ec FROM {_CLEAN_NOTES})""",
    ["note_text"],
)
def extract_fallback(spark, folder):
    section = X.extract_with_fallback(F.col("note"), PHYSICAL_EXAM, [INITIAL_ASSESSMENT, ED_COURSE])
    return _notes(spark, folder).select("deid_note_key", section.alias("examination_text"))


@query(
    "extract_to_end",
    f"""SELECT deid_note_key, {to_end('note', f"coalesce({position('note', INITIAL_ASSESSMENT)}, "
                                      f"{position('note', ED_COURSE)})")} AS assessment_plan_text
    FROM {_CLEAN_NOTES}""",
    ["note_text"],
)
def extract_to_end(spark, folder):
    section = X.extract_to_end(F.col("note"), [INITIAL_ASSESSMENT, ED_COURSE])
    return _notes(spark, folder).select("deid_note_key", section.alias("assessment_plan_text"))


@query(
    "extract_history",
    f"""SELECT deid_note_key, {between('note', position('note', CHIEF_COMPLAINT), position('note', PHYSICAL_EXAM))}
        AS history_text FROM {_CLEAN_NOTES}""",
    ["note_text"],
)
def extract_history(spark, folder):
    section = X.extract_between(F.col("note"), CHIEF_COMPLAINT, PHYSICAL_EXAM)
    return _notes(spark, folder).select("deid_note_key", section.alias("history_text"))


@query("token_count", f"SELECT doc_id, {tokens('text')} AS n_tokens FROM documents")
def token_count(spark, folder):
    return testbed.table(spark, folder, "documents").select(
        "doc_id", X.token_count(F.col("text")).alias("n_tokens")
    )


@query("token_count_tokenizer", "SELECT doc_id, len(regexp_extract_all(text, '[^ \\n]+'))::INTEGER AS n_tokens FROM documents")
def token_count_tokenizer(spark, folder):
    """A tokenizer of the user's; here one that splits at spaces and line feeds."""

    def load():
        import re

        return re.compile("[^ \n]+").findall

    count = X.tokenizer_count(load)
    return testbed.table(bound_batches(spark), folder, "documents").select("doc_id", count(F.col("text")).alias("n_tokens"))


@query(
    "first_note_per_visit",
    """SELECT visit_occurrence_id, deid_note_key, deid_service_date, note_length_words, note_text_processed
    FROM first_notes""",
    ["first_notes"],
)
def first_note_per_visit(spark, folder):
    first = notes.first_clean_notes(inputs.cohort(spark, folder))
    return first.select(
        "visit_occurrence_id", "deid_note_key", "deid_service_date", "note_length_words", "note_text_processed"
    )


@query(
    "longest_turn_per_conversation",
    """SELECT conv_id, turn, role, text FROM conversations
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) = 1""",
)
def longest_turn_per_conversation(spark, folder):
    """The same deduplication over longer groups."""
    df = testbed.table(spark, folder, "conversations")
    return tables.first_per_key(df, "conv_id", [F.char_length("text").desc(), F.asc("turn")])


@query("cohort_notes", "SELECT * FROM cohort", ["cohort"])
def cohort_notes(spark, folder):
    return inputs.cohort(spark, folder)


@query("prepare_notes", "SELECT * FROM prepared", ["prepared"])
def prepare_notes(spark, folder):
    return inputs.prepared(spark, folder)


@query("prepare_notes_from_cohort", "SELECT * FROM prepared", ["prepared"])
def prepare_notes_from_cohort(spark, folder):
    """The same from a written cohort."""
    return jobs.prepare_notes(stage(inputs.cohort(spark, folder)))


@query("refine_notes", "SELECT * FROM refined", ["refined"])
def refine_notes(spark, folder):
    return jobs.refine_notes(inputs.prepared(spark, folder))
