"""Plain SQL definitions of the derived tables, for checks in another engine.

Each is written from the meaning of the step, not from the plan Spark runs: ranks
are single window functions, sections are CASE expressions, and so on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pairbench.constants import (
    ACUITY_RANK,
    CALL_FAILED,
    CHIEF_COMPLAINT,
    ED_COURSE,
    INITIAL_ASSESSMENT,
    NOT_EXTRACTED,
    PAIR_LEVELS,
    PAIRS_PER_CLASS,
    PHYSICAL_EXAM,
    PROMPT_BEFORE_A,
    PROMPT_BEFORE_B,
    PROMPT_END,
    PROMPT_INTRO,
    SECTION_HEADERS,
    SECTION_TEXTS,
    SPLIT_SEED,
)
from pairbench.schemas import COHORT_VISIT_COLUMNS

ANNOTATED_PER_CLASS = PAIRS_PER_CLASS // 20


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(str(x) for x in row) + ")" for row in rows) + ")"


def position(text: str, patterns: Sequence[str]) -> str:
    found = [f"nullif(instr({text}, {quoted(p)}), 0)" for p in patterns]
    return found[0] if len(found) == 1 else f"least({', '.join(found)})"


def between(text: str, start: str, end: str) -> str:
    return (
        f"CASE WHEN {start} IS NOT NULL AND {end} IS NOT NULL "
        f"THEN substr({text}, {start}, greatest({end} - {start}, 0)) ELSE {quoted(NOT_EXTRACTED)} END"
    )


def to_end(text: str, start: str) -> str:
    return f"CASE WHEN {start} IS NOT NULL THEN substr({text}, {start}) ELSE {quoted(NOT_EXTRACTED)} END"


def tokens(text: str) -> str:
    return f"len(regexp_extract_all({text}, '[A-Za-z0-9]+|[^A-Za-z0-9 ]'))::INTEGER"


def cleaned(text: str) -> str:
    return f"regexp_replace(replace({text}, chr(10), ''), ' +', ' ', 'g')"


def hash_number(text: str, digits: int = 15) -> str:
    return f"('0x' || substr(md5({text}), 1, {digits}))::BIGINT"


def rates(n: str, correct: str, tp: str, fp: str, fn: str) -> str:
    return (
        f"CASE WHEN {n} > 0 THEN {correct}::DOUBLE / {n} END AS accuracy, "
        f"CASE WHEN 2 * {tp} + {fp} + {fn} = 0 THEN 0.0::DOUBLE "
        f"ELSE 2.0::DOUBLE * {tp} / (2 * {tp} + {fp} + {fn}) END AS f1"
    )


def metrics(truth: str, predicted: str) -> str:
    """Select list of all metrics of a group."""

    def count(condition):
        return f"count(*) FILTER (WHERE {condition})"

    tp = count(f"{truth} = 'A' AND {predicted} = 'A'")
    fp = count(f"{truth} IS DISTINCT FROM 'A' AND {predicted} = 'A'")
    fn = count(f"{truth} = 'A' AND {predicted} IS DISTINCT FROM 'A'")
    correct = count(f"{truth} = {predicted}")
    return (
        f"count(*) AS n, {count(truth + chr(32) + '= ' + quoted('A'))} AS truth_a, "
        f"{count(truth + ' = ' + quoted('B'))} AS truth_b, {correct} AS n_correct, "
        + rates("count(*)", correct, tp, fp, fn)
    )


_COHORT_NOTE_COLUMNS = [
    "person_id_notes", "deid_note_key", "note_type", "encounter_type", "enc_dept_name",
    "enc_dept_specialty", "auth_prov_type", "prov_specialty", "deid_service_date",
]

_LEVEL_CASE = " ".join(
    f"WHEN {quoted(str(rank))} THEN {quoted(level)}" for level, rank in ACUITY_RANK.items()
)
_RANK_CASE = " ".join(f"WHEN {quoted(level)} THEN {rank}" for level, rank in ACUITY_RANK.items())
_CLASS_ROWS = values(
    (number, side, quoted(level))
    for number, levels in enumerate(PAIR_LEVELS)
    for side, level in enumerate(levels)
)
_CLASS_CASE = " ".join(
    f"WHEN {quoted(a + '_' + b)} THEN {number}"
    for number, pair in enumerate(PAIR_LEVELS)
    for a, b in (pair, pair[::-1])
)


def acuity_rank(level: str) -> str:
    return f"CASE {level} {_RANK_CASE} END"


def pair_class(key: str) -> str:
    return f"CASE {key} {_CLASS_CASE} END"


def prompt(a: str, b: str) -> str:
    return (
        f"({quoted(PROMPT_INTRO + PROMPT_BEFORE_A)} || {a} || {quoted(PROMPT_BEFORE_B)} || {b} "
        f"|| {quoted(PROMPT_END)})"
    )


def _response(lead: str) -> str:
    head, tail = '{"choices":[{"message":{"content":"', '"}}],"usage":{"prompt_tokens":'
    m = hash_number("visit_occurrence_id_combined", 8)
    return f"""
    SELECT DISTINCT visit_occurrence_id_combined, prompt, CASE WHEN m % 29 = 0 THEN {quoted(CALL_FAILED)}
        ELSE {quoted(head)} || CASE
            WHEN m % 31 = 0 THEN 'Unable to say'
            WHEN length(history_text_A) + {lead} >= length(history_text_B)
                THEN '0: Patient A is of higher acuity'
            ELSE '1: Patient B is of higher acuity' END
        || {quoted(tail)} || prompt_tokens || ',"completion_tokens":9}}}}' END AS response_json
    FROM (SELECT *, {m} AS m FROM pairs)"""


def _results(responses: str) -> str:
    return f"""
    SELECT p.*, r.response_json, a.response_content,
        CASE a.label WHEN '0' THEN 'A' WHEN '1' THEN 'B' ELSE a.label END AS label,
        (CASE WHEN CASE a.label WHEN '0' THEN 'A' WHEN '1' THEN 'B' END = p.higher_acuity_patient
            THEN 1 ELSE 0 END)::INTEGER AS correct_label,
        {pair_class('p.acuitylevel_combined')} AS acuity_pair_class
    FROM pairs p
    JOIN {responses} r USING (visit_occurrence_id_combined, prompt)
    JOIN {responses}_answers a USING (visit_occurrence_id_combined, prompt)"""


def answer_label(content: str) -> str:
    return (
        f"CASE WHEN contains({content}, '0') THEN '0' WHEN contains({content}, '1') THEN '1' "
        f"WHEN contains({content}, {quoted(CALL_FAILED)}) THEN 'error' ELSE 'neither' END"
    )


def _answers(responses: str) -> str:
    content = (
        f"CASE WHEN json_valid(response_json) THEN coalesce(json_extract_string(response_json, "
        f"'$.choices[0].message.content'), {quoted(CALL_FAILED)}) ELSE {quoted(CALL_FAILED)} END"
    )
    return f"""
    SELECT visit_occurrence_id_combined, prompt, response_content, {answer_label('response_content')} AS label
    FROM (SELECT *, {content} AS response_content FROM {responses})"""


# Name -> (tables it uses, definition).
_TABLES: dict[str, tuple[Sequence[str], str]] = {
    "visits": ((), f"""
    SELECT o_custkey AS person_id, o_orderkey AS ed_visit_occurrence_id, o_custkey AS person_id2,
        o_orderkey % (SELECT count(*) FROM part) AS agekey,
        o_orderkey % (SELECT count(*) FROM part) AS agekeyvalue,
        NULL::BIGINT AS admission_visit_occurrence_id, o_orderkey AS visit_occurrence_id,
        o_orderdate AS arrival_datetime, NULL::TIMESTAMP AS admissiondecision_datetime,
        NULL::TIMESTAMP AS departure_datetime, NULL::TIMESTAMP AS disposition_datetime,
        NULL::VARCHAR AS departmentname, NULL::VARCHAR AS departmentspecialty,
        NULL::VARCHAR AS admissiondepartmentname, NULL::VARCHAR AS admissiondepartmentspecialty,
        o_orderstatus AS eddisposition, NULL::VARCHAR AS dischargedisposition,
        CASE WHEN o_orderkey % 50 = 49 THEN '*Unspecified'
            ELSE CASE substr(o_orderpriority, 1, 1) {_LEVEL_CASE} END END AS acuitylevel
    FROM orders"""),
    "patients": ((), """
    SELECT c_custkey AS person_id, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex,
        c_mktsegment AS ethnicity, c_nationkey::VARCHAR AS firstrace,
        CASE WHEN c_custkey % 10 = 0 THEN 'Y' ELSE 'N' END AS multiracial
    FROM customer"""),
    "durations": ((), "SELECT p_partkey AS durationkey, (p_size * 365)::INTEGER AS days FROM part"),
    "care_sites": ((), """
    SELECT n_nationkey::BIGINT AS care_site_id, n_regionkey::BIGINT AS location_id FROM nation"""),
    "locations": ((), """
    SELECT r_regionkey::BIGINT AS location_id, r_name AS location_source_value FROM region"""),
    "note_metadata": ((), """
    SELECT doc_id // 2 AS person_id, doc_id AS deid_note_key, doc_id // 2 AS visit_occurrence_id,
        CASE WHEN doc_id % 10 = 9 THEN 'Progress Notes' ELSE 'ED Provider Notes' END AS note_type,
        NULL::VARCHAR AS encounter_type, NULL::VARCHAR AS enc_dept_name,
        NULL::VARCHAR AS enc_dept_specialty, NULL::VARCHAR AS auth_prov_type,
        CASE doc_id % 8 WHEN 0 THEN 'UCSF' WHEN 1 THEN 'Pediatrics' ELSE 'Emergency Medicine' END
            AS prov_specialty,
        (DATE '2020-01-01' + ((doc_id // 2) % 365 + CASE WHEN doc_id % 4 = 1 THEN 1 ELSE 0 END)::INTEGER)
            ::TIMESTAMP AS deid_service_date
    FROM documents"""),
    "note_text": ((), """
    SELECT doc_id AS deid_note_key, CASE doc_id % 20
        WHEN 3 THEN text
        WHEN 5 THEN 'Physical Exam ' || substr(text, 1, 200) || ' Chief Complaint ' || substr(text, 201)
            || ' Initial Assessment x'
        WHEN 6 THEN 'CHIEF COMPLAINT ' || substr(text, 1, 200) || ' PHYSICAL EXAM ' || substr(text, 201, 200)
            || ' ED COURSE ' || substr(text, 401)
        WHEN 7 THEN 'Chief Complaint ' || substr(text, 1, 200) || ' Physical Exam ' || substr(text, 201)
        ELSE 'History Chief Complaint ' || substr(text, 1, 200) || chr(10)
            || '  Review of Systems Physical Exam ' || substr(text, 201, 200) || ' Initial Assessment '
            || substr(text, 401) || ' Plan: rest' END AS note_text
    FROM documents"""),
    "aged_visits": (("visits", "durations"), """
    SELECT v.*, d.days, d.days::DOUBLE / 365.25::DOUBLE AS edvisit_age
    FROM visits v LEFT JOIN durations d ON v.agekey = d.durationkey"""),
    "ed_notes": (("aged_visits", "note_metadata"), """
    SELECT v.*, n.person_id AS person_id_notes, n.* EXCLUDE (person_id, visit_occurrence_id)
    FROM aged_visits v JOIN note_metadata n USING (visit_occurrence_id)"""),
    "cohort": (("ed_notes", "patients", "note_text"), f"""
    SELECT {', '.join(COHORT_VISIT_COLUMNS + _COHORT_NOTE_COLUMNS)}, note_text
    FROM ed_notes LEFT JOIN patients USING (person_id) LEFT JOIN note_text USING (deid_note_key)
    WHERE edvisit_age >= 18 AND note_type = 'ED Provider Notes'
        AND (prov_specialty = 'Emergency Medicine' OR prov_specialty = 'UCSF')"""),
    "cleaned": (("cohort",), f"""
    SELECT * REPLACE (visit_occurrence_id::VARCHAR AS visit_occurrence_id),
        {cleaned('note_text')} AS note_text_processed,
        length({cleaned('note_text')})::INTEGER AS note_length_words
    FROM cohort WHERE visit_occurrence_id IS NOT NULL"""),
    "first_notes": (("cleaned",), """
    SELECT * FROM cleaned
    QUALIFY row_number() OVER (PARTITION BY visit_occurrence_id
        ORDER BY deid_service_date NULLS LAST, note_length_words DESC NULLS LAST, deid_note_key) = 1"""),
    "flagged": (("first_notes",), "SELECT *, " + ", ".join(
        f"CASE WHEN contains(note_text_processed, {quoted(h)}) THEN 'Y' ELSE 'N' END AS {c}"
        for c, h in SECTION_HEADERS.items()
    ) + " FROM first_notes"),
    "sectioned": (("flagged",), f"""
    SELECT * EXCLUDE (cc, pe, ia, ec),
        {between('note_text_processed', 'cc', 'pe')} AS history_text,
        CASE WHEN ia IS NOT NULL THEN {between('note_text_processed', 'pe', 'ia')}
            WHEN ec IS NOT NULL THEN {between('note_text_processed', 'pe', 'ec')}
            ELSE {quoted(NOT_EXTRACTED)} END AS examination_text,
        CASE WHEN ia IS NOT NULL THEN substr(note_text_processed, ia)
            WHEN ec IS NOT NULL THEN substr(note_text_processed, ec)
            ELSE {quoted(NOT_EXTRACTED)} END AS assessment_plan_text
    FROM (SELECT *, {position('note_text_processed', CHIEF_COMPLAINT)} AS cc,
            {position('note_text_processed', PHYSICAL_EXAM)} AS pe,
            {position('note_text_processed', INITIAL_ASSESSMENT)} AS ia,
            {position('note_text_processed', ED_COURSE)} AS ec
        FROM flagged)"""),
    "prepared": (("sectioned",), f"""
    SELECT *, {tokens('note_text_processed')} AS note_text_processed_tokens,
        {tokens('history_text')} AS history_text_tokens
    FROM sectioned"""),
    "refined": (("prepared",), "SELECT * FROM prepared WHERE acuitylevel IS DISTINCT FROM '*Unspecified' "
        + " ".join(f"AND {c} IS NOT NULL AND {c} <> {quoted(NOT_EXTRACTED)} AND {c} <> ''" for c in SECTION_TEXTS)
        + " AND history_text_tokens <= 2000"),
    "level_ranks": (("refined",), """
    SELECT visit_occurrence_id, acuitylevel, history_text,
        row_number() OVER (PARTITION BY acuitylevel
            ORDER BY md5('0-' || visit_occurrence_id), visit_occurrence_id) - 1 AS r,
        count(*) OVER (PARTITION BY acuitylevel) AS size
    FROM refined"""),
    "picks": (("level_ranks",), f"""
    SELECT pair_class, slot, side, seed, v.*
    FROM (SELECT c.pair_class, c.side, c.level, 2 * c.pair_class + c.side AS seed, s.slot
        FROM {_CLASS_ROWS} AS c(pair_class, side, level), range({PAIRS_PER_CLASS}) AS s(slot)) q
    JOIN (SELECT DISTINCT acuitylevel AS level, size FROM level_ranks) z USING (level)
    JOIN level_ranks v ON v.acuitylevel = level AND v.r = {hash_number(
        "seed || '-' || pair_class || '-' || CASE side WHEN 0 THEN 'A' ELSE 'B' END || '-' || slot")} % z.size"""),
    "balanced": (("picks",), """
    SELECT a.pair_class, a.slot,
        a.visit_occurrence_id AS visit_occurrence_id_A, a.acuitylevel AS acuitylevel_A,
        a.history_text AS history_text_A, a.seed AS seed_A,
        b.visit_occurrence_id AS visit_occurrence_id_B, b.acuitylevel AS acuitylevel_B,
        b.history_text AS history_text_B, b.seed AS seed_B,
        a.visit_occurrence_id || '_' || b.visit_occurrence_id AS visit_occurrence_id_combined
    FROM picks a JOIN picks b USING (pair_class, slot) WHERE a.side = 0 AND b.side = 1"""),
    "counterbalanced": (("balanced",), f"""
    SELECT pair_class, slot, visit_occurrence_id_combined, """ + ", ".join(
        f"CASE WHEN keep THEN {c}_A ELSE {c}_B END AS {c}_A, CASE WHEN keep THEN {c}_B ELSE {c}_A END AS {c}_B"
        for c in ("visit_occurrence_id", "acuitylevel", "history_text", "seed")
    ) + f"""
    FROM (SELECT *, row_number() OVER (
            ORDER BY md5('{SPLIT_SEED}-' || pair_class || '-' || slot), pair_class, slot)
            <= {PAIRS_PER_CLASS * len(PAIR_LEVELS) // 2} AS keep
        FROM balanced)"""),
    "pairs": (("counterbalanced",), f"""
    SELECT *, {tokens('prompt')} AS prompt_tokens,
        acuitylevel_int_B - acuitylevel_int_A AS acuity_level_int_BminusA,
        CASE WHEN acuitylevel_int_B > acuitylevel_int_A THEN 'A'
            WHEN acuitylevel_int_B < acuitylevel_int_A THEN 'B' END AS higher_acuity_patient,
        md5('{SPLIT_SEED}-' || pair_class || '-' || slot) AS shuffle_key
    FROM (SELECT *, acuitylevel_A || '_' || acuitylevel_B AS acuitylevel_combined,
            {acuity_rank('acuitylevel_A')} AS acuitylevel_int_A,
            {acuity_rank('acuitylevel_B')} AS acuitylevel_int_B,
            {prompt('history_text_A', 'history_text_B')} AS prompt
        FROM counterbalanced)"""),
    "responses": (("pairs",), _response("0")),
    "responses_answers": (("responses",), _answers("responses")),
    "results": (("responses_answers",), _results("responses")),
    "responses2": (("pairs",), _response("m % 50")),
    "responses2_answers": (("responses2",), _answers("responses2")),
    "results2": (("responses2_answers",), _results("responses2")),
    "annotations": (("pairs",), f"""
    SELECT visit_occurrence_id_combined, CASE WHEN rater_label_binary = 'A' THEN '0' ELSE '1' END AS rater_label,
        rater_label_binary
    FROM (SELECT visit_occurrence_id_combined, min(CASE
                WHEN {hash_number('visit_occurrence_id_combined', 8)} % 7 <> 0 THEN higher_acuity_patient
                WHEN higher_acuity_patient = 'A' THEN 'B' ELSE 'A' END) AS rater_label_binary
        FROM pairs WHERE slot < {ANNOTATED_PER_CLASS} GROUP BY 1)"""),
    "annotated": (("results2", "annotations"), """
    SELECT r.*, a.rater_label, a.rater_label_binary
    FROM results2 r JOIN annotations a USING (visit_occurrence_id_combined)"""),
}


def with_tables(names: Sequence[str], select: str) -> str:
    """``select`` behind the definitions of the tables it names and of those they use."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in ordered:
            for used in _TABLES[name][0]:
                visit(used)
            ordered.append(name)

    for name in names:
        visit(name)
    if not ordered:
        return select.strip()
    return "WITH " + ",\n".join(f"{n} AS ({_TABLES[n][1].strip()})" for n in ordered) + "\n" + select.strip()
