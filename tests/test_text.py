import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pairbench.constants import ED_COURSE, INITIAL_ASSESSMENT, NOT_EXTRACTED, PHYSICAL_EXAM, CHIEF_COMPLAINT
from pairbench.functions import text as X
from pairbench.operators import notes


def apply(spark, texts, *expressions):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    named = [e.alias(f"c{n}") for n, e in enumerate(expressions)]
    return [tuple(r)[1:] for r in df.select("i", *named).orderBy("i").collect()]


def first(text, patterns):
    found = [text.find(p) for p in patterns if p in text]
    return min(found) if found else None


def between(text, start, end):
    a, b = first(text, start), first(text, end)
    return NOT_EXTRACTED if a is None or b is None else text[a:b]


def test_cleaning(spark):
    texts = ["a\nb", "a  b   c", " \n a", "tab\t\tstays", "a\r\nb", "", None, "a" + " " * 9 + "b", "\n\n"]
    want = [None if t is None else re.sub(" +", " ", t.replace("\n", "")) for t in texts]
    assert [r[0] for r in apply(spark, texts, X.clean_note(F.col("t")))] == want


PIECES = ["Chief Complaint", "CHIEF COMPLAINT", "Physical Exam", "PHYSICAL EXAM", "Initial Assessment",
          "INITIAL ASSESSMENT", "ED Course", "ED course", "ED COURSE", "ed course", "😀", "é", " ", "text", "Plan:"]


def test_sections_against_brute_force(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choices(PIECES, k=rng.randint(0, 12))) for _ in range(400)]
    column = F.col("t")
    got = apply(
        spark,
        texts,
        X.extract_between(column, CHIEF_COMPLAINT, PHYSICAL_EXAM),
        X.extract_with_fallback(column, PHYSICAL_EXAM, [INITIAL_ASSESSMENT, ED_COURSE]),
        X.extract_to_end(column, [INITIAL_ASSESSMENT, ED_COURSE]),
    )
    for t, row in zip(texts, got):
        end = INITIAL_ASSESSMENT if first(t, INITIAL_ASSESSMENT) is not None else ED_COURSE
        start = first(t, INITIAL_ASSESSMENT)
        start = first(t, ED_COURSE) if start is None else start
        tail = NOT_EXTRACTED if start is None else t[start:]
        assert row == (between(t, CHIEF_COMPLAINT, PHYSICAL_EXAM), between(t, PHYSICAL_EXAM, end), tail)

    # The same through the job step that searches each heading once.
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, note_text_processed string")
    rows = notes.add_sections(df).orderBy("i").select("history_text", "examination_text", "assessment_plan_text")
    assert [tuple(r) for r in rows.collect()] == got


def test_null_text(spark):
    column = F.col("t")
    got = apply(
        spark,
        [None],
        X.extract_between(column, ["a"], ["b"]),
        X.extract_to_end(column, [["a"]]),
        X.contains_flag(column, "a"),
        X.token_count(column),
    )
    assert got == [(NOT_EXTRACTED, NOT_EXTRACTED, "N", None)]


def test_flags_are_case_sensitive(spark):
    got = apply(spark, ["Plan: x", "plan: x", "Plans"], X.contains_flag(F.col("t"), "Plan"))
    assert [r[0] for r in got] == ["Y", "N", "Y"]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\0"), max_size=60),
                min_size=100, max_size=150))
def test_token_count_against_regex(spark, texts):
    want = [len(re.findall("[A-Za-z0-9]+|[^A-Za-z0-9 ]", t)) for t in texts]
    assert [r[0] for r in apply(spark, texts, X.token_count(F.col("t")))] == want


def test_tokenizer_of_the_user(spark):
    def load():
        return lambda s: s.split("-")

    count = X.tokenizer_count(load)
    assert apply(spark, ["a-b-c", "", None], count(F.col("t"))) == [(3,), (1,), (None,)]


def test_tokenizer_gets_bounded_batches(spark, tmp_path):
    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n in names:
            spark.conf.unset(n)
        texts = spark.range(3000).selectExpr("id AS doc_id", "repeat('ab ', 4 * cast(id AS int)) AS text", "'en' AS lang", "'s' AS source", "0L AS n_chars")
        texts.write.parquet(str(tmp_path / "documents.parquet"))
        found = entry.queries()["token_count_tokenizer"](spark, str(tmp_path))
        assert all(r.n_tokens == 4 * r.doc_id for r in found.collect())
        assert int(spark.conf.get(names[0])) <= 512 and int(spark.conf.get(names[1]).rstrip("b")) <= 8 << 20
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)


def test_first_note_per_visit(spark):
    data = [
        (1, 10, "2020-01-02", "later but much longer"),
        (1, 11, "2020-01-01", "short"),
        (1, 12, "2020-01-01", "longer one"),
        (2, 13, None, "no date"),
        (2, 14, "2020-05-01", "dated"),
        (3, 16, "2020-01-01", "tied"),
        (3, 15, "2020-01-01", "tied"),
        (None, 17, "2020-01-01", "no visit"),
    ]
    df = spark.createDataFrame(data, "visit_occurrence_id long, deid_note_key long, d string, note_text string")
    df = df.withColumn("deid_service_date", F.to_timestamp_ntz("d")).drop("d")
    got = notes.first_clean_notes(df).select("visit_occurrence_id", "deid_note_key").collect()
    assert sorted(tuple(r) for r in got) == [("1", 12), ("2", 14), ("3", 15)]


def test_first_note_by_header_against_brute_force(spark):
    rng = random.Random(4)
    data = [
        (rng.choice([None, 1, 1, 1, 2, 3, 4, 5]), i, rng.choice([None, 1, 2, 3]), "x" * rng.randint(0, 3) + "\n  y")
        for i in range(300)
    ] + [(9, 300, None, "only an undated one"), (9, 301, None, "short")]
    df = spark.createDataFrame(data, "visit_occurrence_id long, deid_note_key long, day int, note_text string")
    date = F.date_add(F.lit("2020-01-01").cast("date"), F.col("day")).cast("timestamp_ntz")
    df = df.withColumn("deid_service_date", date).drop("day")
    best = {}
    for visit, key, day, text in data:
        rank = (day is None, day or 0, -len(re.sub(" +", " ", text.replace("\n", ""))), key)
        if visit is not None and (visit not in best or rank < best[visit]):
            best[visit] = rank
    want = sorted((str(v), r[-1]) for v, r in best.items())
    with_text = notes.first_clean_notes(df)
    by_header = notes.first_clean_notes_by_header(df.drop("note_text"), df.select("deid_note_key", "note_text"))
    for got in (with_text, by_header):
        assert sorted(tuple(r) for r in got.select("visit_occurrence_id", "deid_note_key").collect()) == want


def test_service_date_as_text(spark):
    df = spark.createDataFrame(
        [(1, 1, "2020-01-02 00:00:00", "a"), (1, 2, "not a date", "b")],
        "visit_occurrence_id long, deid_note_key long, deid_service_date string, note_text string",
    )
    assert [r.deid_note_key for r in notes.first_clean_notes(df).collect()] == [1]


def test_refine_steps_drop_sentinels_and_long_histories(spark):
    good = ("Urgent", "h", "e", "a", 10)
    data = [
        good,
        ("*Unspecified", "h", "e", "a", 10),
        (None, "h", "e", "a", 10),
        ("Urgent", NOT_EXTRACTED, "e", "a", 10),
        ("Urgent", "h", "", "a", 10),
        ("Urgent", "h", "e", None, 10),
        ("Urgent", "h", "e", "a", 2001),
        ("Urgent", "h", "e", "a", None),
    ]
    df = spark.createDataFrame(
        data,
        "acuitylevel string, history_text string, examination_text string, assessment_plan_text string, "
        "history_text_tokens int",
    )
    got = [tuple(r) for r in notes.apply_steps(df, notes.refine_steps()).collect()]
    assert sorted(got, key=repr) == sorted([good, (None, "h", "e", "a", 10)], key=repr)
