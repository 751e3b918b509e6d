"""Profiles, counts, histograms and funnels."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairbench.constants import (
    ANSWER_RESERVE,
    INTRO_TOKENS,
    MODEL_TOKEN_LIMIT,
    NOT_EXTRACTED,
    PROMPT_FRAME,
    SECTION_HEADERS,
    SECTION_TEXTS,
)
from pairbench.operators import notes, pairing, profile
from pairbench.plans import jobs
from pairbench.sources import testbed
from pairbench.workload import inputs
from pairbench.workload.checks import quoted, tokens
from pairbench.workload.registry import query


@query("table_shape", "SELECT count(*) AS n_rows, 11 AS n_columns FROM lineitem")
def table_shape(spark, folder):
    return profile.table_shape(testbed.table(spark, folder, "lineitem"))


def _users(spark, folder):
    """Event users, one of them blanked to NULL."""
    user = F.nullif(F.col("user_id"), F.lit(8))
    return testbed.table(spark, folder, "events").select(user.alias("user_id"))


@query(
    "nunique",
    """SELECT count(DISTINCT nullif(user_id, 8)) + max((nullif(user_id, 8) IS NULL)::BIGINT) AS n_unique FROM events""",
)
def nunique(spark, folder):
    return profile.nunique(_users(spark, folder), "user_id")


_COUNTS = """SELECT nullif(user_id, 8) AS user_id, count(*) AS count FROM events {where}
    GROUP BY 1 ORDER BY 2 DESC, 1 NULLS LAST {limit}"""


@query("value_counts", _COUNTS.format(where="", limit="LIMIT 200"))
def value_counts(spark, folder):
    return profile.value_counts(_users(spark, folder), "user_id", top=200)


@query("value_counts_dropna", _COUNTS.format(where="WHERE user_id <> 8", limit=""))
def value_counts_dropna(spark, folder):
    return profile.value_counts(_users(spark, folder), "user_id", dropna=True)


@query(
    "pair_counts_ordered",
    "SELECT acuitylevel_A, acuitylevel_B, count(*) AS count FROM counterbalanced GROUP BY 1, 2",
    ["counterbalanced"],
)
def pair_counts_ordered(spark, folder):
    return profile.group_sizes(inputs.pairs(spark, folder), "acuitylevel_A", "acuitylevel_B")


@query(
    "pair_counts_unordered",
    """SELECT least(acuitylevel_A, acuitylevel_B) || '-' || greatest(acuitylevel_A, acuitylevel_B) AS labels,
        count(*) AS count FROM counterbalanced GROUP BY 1""",
    ["counterbalanced"],
)
def pair_counts_unordered(spark, folder):
    return pairing.unordered_pair_counts(inputs.pairs(spark, folder))


_PROFILED = {
    name: True
    for name in ("departmentname", "acuitylevel", "ethnicity", "note_type", "encounter_type", "history_text",
                 "examination_text", "assessment_plan_text")
} | {name: False for name in ("person_id", "admission_visit_occurrence_id", "disposition_datetime",
                              "arrival_datetime", "edvisit_age", "history_text_tokens")}


@query(
    "null_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS n_null,
        count(*) FILTER (WHERE {c} IS NULL{f" OR {c} = ''" if text else ""}) AS n_null_or_empty,
        count({c}) AS n_not_null FROM prepared"""
        for c, text in _PROFILED.items()
    ),
    ["prepared"],
)
def null_profile(spark, folder):
    return profile.null_profile(inputs.prepared(spark, folder), list(_PROFILED))


@query(
    "column_equality",
    "SELECT quality = toxic AS match_y_n, count(*) AS count FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
)
def column_equality(spark, folder):
    labels = testbed.table(spark, folder, "labels")
    df = testbed.table(spark, folder, "documents").select("doc_id").join(labels, "doc_id", "left")
    return profile.column_equality(df, "quality", "toxic")


@query(
    "duplicate_profile",
    """SELECT coalesce(sum(n) FILTER (WHERE n > 1), 0)::BIGINT AS rows_in_groups,
        coalesce(sum(n - 1), 0)::BIGINT AS rows_beyond_first
    FROM (SELECT count(*) AS n FROM cohort GROUP BY visit_occurrence_id)""",
    ["cohort"],
)
def duplicate_profile(spark, folder):
    return profile.duplicate_profile(inputs.headers(spark, folder), "visit_occurrence_id")


_LIMIT = MODEL_TOKEN_LIMIT - INTRO_TOKENS - ANSWER_RESERVE


@query(
    "prompt_budget",
    f"""SELECT {tokens(quoted(PROMPT_FRAME))} AS counted_intro_tokens, {_LIMIT} AS token_limit,
        max(prompt_tokens) AS max_prompt_tokens,
        count(*) FILTER (WHERE prompt_tokens > {_LIMIT}) AS prompts_over_limit FROM pairs""",
    ["pairs"],
)
def prompt_budget(spark, folder):
    return pairing.prompt_budget(inputs.pairs(spark, folder))


@query(
    "cost_estimate",
    """SELECT sum(prompt_tokens)::BIGINT AS total_tokens,
        round(sum(prompt_tokens)::DOUBLE * 0.06::DOUBLE / 1000, 6) AS cost FROM pairs""",
    ["pairs"],
)
def cost_estimate(spark, folder):
    costs = profile.cost_estimate(inputs.pairs(spark, folder), "prompt_tokens")
    return costs.withColumn("cost", F.round("cost", 6))


def _histogram_sql(value: str) -> str:
    return f"""SELECT b.bin::INTEGER AS bin, round(lo + b.bin * (hi - lo) / 20, 6) AS bin_start,
        round(lo + (b.bin + 1) * (hi - lo) / 20, 6) AS bin_end, count(x) AS count
    FROM range(20) AS b(bin)
    CROSS JOIN (SELECT min({value}) AS lo, max({value}) AS hi FROM orders)
    LEFT JOIN (SELECT {value} AS x FROM orders) ON b.bin = least(floor((x - lo) / (hi - lo) * 20), 19)
    GROUP BY b.bin, lo, hi"""


def _rounded_edges(df):
    return df.withColumns({c: F.round(c, 6) for c in ("bin_start", "bin_end")})


@query("histogram_linear", _histogram_sql("trunc(o_totalprice)"))
def histogram_linear(spark, folder):
    return _rounded_edges(profile.histogram(testbed.table(spark, folder, "orders"), "o_totalprice"))


@query("histogram_log", _histogram_sql("CASE WHEN o_totalprice > 0 THEN ln(o_totalprice) END"))
def histogram_log(spark, folder):
    return _rounded_edges(profile.histogram(testbed.table(spark, folder, "orders"), "o_totalprice", "log"))


@query(
    "cohort_stats",
    """SELECT count(*) AS n_rows, count(DISTINCT person_id) AS n_patients,
        count(DISTINCT visit_occurrence_id) AS n_visits FROM cohort""",
    ["cohort"],
)
def cohort_stats(spark, folder):
    return profile.cohort_stats(inputs.headers(spark, folder))


@query(
    "section_prevalence",
    " UNION ALL ".join(
        f"SELECT '{c}' AS section, {c} AS flag, count(*) AS count FROM flagged GROUP BY {c}" for c in SECTION_HEADERS
    ),
    ["flagged"],
)
def section_prevalence(spark, folder):
    return profile.section_prevalence(notes.add_section_flags(inputs.first_notes(spark, folder)))


def _funnel_sql(table: str, steps) -> str:
    rows = []
    for number, (name, _) in enumerate(steps, 1):
        kept = " AND ".join(f"({condition})" for _, condition in steps[:number])
        rows.append(
            f"SELECT {number} AS step, '{name}' AS filter, count(*) AS n_rows, "
            f"count(DISTINCT visit_occurrence_id) AS n_visits FROM {table} WHERE {kept}"
        )
    return " UNION ALL ".join(rows)


@query(
    "attrition_funnel",
    _funnel_sql(
        "ed_notes",
        [
            ("visit has a note", "true"),
            ("adult", "edvisit_age >= 18"),
            ("note type", "note_type = 'ED Provider Notes'"),
            ("specialty", "prov_specialty IN ('Emergency Medicine', 'UCSF')"),
        ],
    ),
    ["ed_notes"],
)
def attrition_funnel(spark, folder):
    domain = testbed.domain(spark, folder)
    return jobs.cohort_funnel(domain["visits"], domain["durations"], domain["note_metadata"])


@query(
    "refine_funnel",
    _funnel_sql(
        "prepared",
        [("acuity specified", "acuitylevel IS DISTINCT FROM '*Unspecified'")]
        + [(f"{c} not null", f"{c} IS NOT NULL") for c in SECTION_TEXTS]
        + [(f"{c} extracted", f"{c} IS DISTINCT FROM '{NOT_EXTRACTED}'") for c in SECTION_TEXTS]
        + [(f"{c} not empty", f"{c} IS DISTINCT FROM ''") for c in SECTION_TEXTS]
        + [("history within budget", "history_text_tokens <= 2000")],
    ),
    ["prepared"],
)
def refine_funnel(spark, folder):
    return profile.attrition_funnel(inputs.prepared(spark, folder), notes.refine_steps())


@query(
    "pair_invariants",
    """SELECT 'line break in history' AS "check", count(*) FILTER (
            WHERE contains(history_text_A, chr(10)) OR contains(history_text_B, chr(10))) AS violations FROM pairs
    UNION ALL SELECT 'no prompt', count(*) FILTER (WHERE prompt IS NULL) FROM pairs
    UNION ALL SELECT 'visit paired with itself',
        count(*) FILTER (WHERE visit_occurrence_id_A = visit_occurrence_id_B) FROM pairs
    UNION ALL SELECT 'equal acuity', count(*) FILTER (WHERE acuitylevel_A = acuitylevel_B) FROM pairs
    UNION ALL SELECT 'repeated pair id', count(*) - count(DISTINCT visit_occurrence_id_combined) FROM pairs""",
    ["pairs"],
)
def pair_invariants(spark, folder):
    return pairing.pair_invariants(inputs.pairs(spark, folder))


@query(
    "note_invariants",
    """SELECT 'no text' AS "check", count(*) FILTER (WHERE note_text_processed IS NULL) AS violations FROM prepared
    UNION ALL SELECT 'line break in note', count(*) FILTER (WHERE contains(note_text_processed, chr(10))) FROM prepared
    UNION ALL SELECT 'run of spaces in note', count(*) FILTER (WHERE contains(note_text_processed, '  ')) FROM prepared
    UNION ALL SELECT 'no visit', count(*) FILTER (WHERE visit_occurrence_id IS NULL) FROM prepared
    UNION ALL SELECT 'no service date', count(*) FILTER (WHERE deid_service_date IS NULL) FROM prepared""",
    ["prepared"],
)
def note_invariants(spark, folder):
    """All cleaned notes, counted while they are written."""
    return profile.staged_with_checks(inputs.prepared(spark, folder), notes.note_checks())[1]


@query(
    "raw_note_invariants",
    """SELECT 'no text' AS "check", count(*) FILTER (WHERE note_text IS NULL) AS violations FROM note_text
    UNION ALL SELECT 'line break in note', count(*) FILTER (WHERE contains(note_text, chr(10))) FROM note_text
    UNION ALL SELECT 'run of spaces in note', count(*) FILTER (WHERE contains(note_text, '  ')) FROM note_text""",
    ["note_text"],
)
def raw_note_invariants(spark, folder):
    """The same before cleaning, where violations are many."""
    checks = notes.note_checks("note_text")
    raw = testbed.note_text(spark, folder)
    return profile.staged_with_checks(raw, {c: checks[c] for c in list(checks)[:3]})[1]
