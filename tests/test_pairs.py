import hashlib
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from pairbench import constants as C
from pairbench.functions import labels as L
from pairbench.operators import pairing, profile
from pairbench.plans import jobs
from pairbench.schemas import PAIRS
from pairbench.sources.files import stage

LEVELS = list(C.ACUITY_RANK)


def _refined(spark, sizes=(7, 400, 30, 3, 55), partitions=4):
    rows = [
        (f"v{level}-{i}", name, f"history {level} {i}")
        for level, (name, size) in enumerate(zip(LEVELS, sizes))
        for i in range(size)
    ]
    rows += [("odd", None, "no level"), ("other", "Unknown", "no such level")]
    schema = "visit_occurrence_id string, acuitylevel string, history_text string"
    return spark.createDataFrame(rows, schema).repartition(partitions)


@pytest.fixture(scope="module")
def balanced(spark):
    return stage(pairing.balanced_pairs(_refined(spark), 200, seed=5))


@pytest.fixture(scope="module")
def pairs(spark):
    return stage(jobs.build_pairs(_refined(spark), 200, seed=5))


def test_pair_classes_follow_the_levels():
    assert C.PAIR_LEVELS == list(combinations(LEVELS, 2))
    assert C.PAIR_LEVELS[0] == ("Immediate", "Emergent") and C.PAIR_LEVELS[9] == ("Less Urgent", "Non-Urgent")


def test_every_class_has_exactly_n_pairs(balanced):
    counts = Counter((r.pair_class, r.acuitylevel_A, r.acuitylevel_B) for r in balanced.collect())
    assert counts == {(i, *levels): 200 for i, levels in enumerate(C.PAIR_LEVELS)}


def test_pairs_are_whole_visits_with_their_seeds(balanced):
    for r in balanced.collect():
        for side in "AB":
            level, number = r[f"visit_occurrence_id_{side}"][1:].split("-")
            assert r[f"history_text_{side}"] == f"history {level} {number}"
            assert LEVELS[int(level)] == r[f"acuitylevel_{side}"]
        assert (r.seed_A, r.seed_B) == (5 + 2 * r.pair_class, 6 + 2 * r.pair_class)
        assert r.visit_occurrence_id_combined == f"{r.visit_occurrence_id_A}_{r.visit_occurrence_id_B}"


def test_draw_against_brute_force(spark, balanced):
    def number(*parts):
        return int(hashlib.md5("-".join(map(str, parts)).encode()).hexdigest()[:15], 16)

    members = {}
    for r in _refined(spark).collect():
        members.setdefault(r.acuitylevel, []).append(r.visit_occurrence_id)
    for found in members.values():
        found.sort(key=lambda v: (number(5, v), v))
    for r in balanced.collect():
        for side in "AB":
            options = members[r[f"acuitylevel_{side}"]]
            pick = number(r[f"seed_{side}"], r.pair_class, side, r.slot) % len(options)
            assert r[f"visit_occurrence_id_{side}"] == options[pick]


def test_draw_does_not_depend_on_partitions(spark):
    one = pairing.balanced_pairs(_refined(spark, partitions=1), 20).collect()
    many = pairing.balanced_pairs(_refined(spark, partitions=32), 20).collect()
    assert sorted(one) == sorted(many)
    assert sorted(one) != sorted(pairing.balanced_pairs(_refined(spark), 20, seed=1).collect())


def test_a_level_without_visits_leaves_out_its_classes(spark):
    df = pairing.balanced_pairs(_refined(spark, (4, 0, 3, 2, 1)), 10)
    counts = Counter(r.pair_class for r in df.collect())
    assert counts == {i: 10 for i, pair in enumerate(C.PAIR_LEVELS) if "Emergent" not in pair}


def test_counterbalance_swaps_exactly_the_rest(balanced):
    after = {(r.pair_class, r.slot): r for r in pairing.counterbalance(balanced, 1000).collect()}
    kept = 0
    for r in balanced.collect():
        s = after[(r.pair_class, r.slot)]
        assert s.visit_occurrence_id_combined == r.visit_occurrence_id_combined
        same = all(r[f"{c}_{x}"] == s[f"{c}_{x}"] for c in pairing.SIDE_COLUMNS for x in "AB")
        swapped = all(r[f"{c}_{x}"] == s[f"{c}_{y}"] for c in pairing.SIDE_COLUMNS for x, y in ("AB", "BA"))
        assert same != swapped
        kept += same
    assert kept == 1000


def test_pair_dataset(pairs):
    assert pairs.columns == PAIRS.names
    assert [(f.name, f.dataType) for f in pairs.schema] == [(f.name, f.dataType) for f in PAIRS]
    rows = pairs.collect()
    assert Counter(r.higher_acuity_patient for r in rows) == {"A": 1000, "B": 1000}
    for r in rows:
        assert r.prompt == (
            f'{C.PROMPT_INTRO}  \n  Patient A: """{r.history_text_A}"""  \n  Patient B: """{r.history_text_B}"""'
        )
        assert r.acuity_level_int_BminusA == r.acuitylevel_int_B - r.acuitylevel_int_A != 0
        more_acute = r.acuitylevel_A if r.higher_acuity_patient == "A" else r.acuitylevel_B
        assert more_acute == C.PAIR_LEVELS[r.pair_class][0]
    classes = pairs.select("pair_class", L.pair_class(F.col("acuitylevel_combined")).alias("c"))
    assert classes.filter("pair_class <> c OR c IS NULL").count() == 0


def test_invariants_hold_and_violations_are_found(pairs):
    found = dict(tuple(r) for r in pairing.pair_invariants(pairs).collect())
    repeated = found.pop("repeated pair id")
    assert set(found.values()) == {0}
    assert repeated == pairs.count() - pairs.select("visit_occurrence_id_combined").distinct().count() > 0
    broken = pairs.withColumns(
        {"prompt": F.lit(None).cast("string"), "acuitylevel_A": F.col("acuitylevel_B"),
         "history_text_A": F.lit("a\nb"), "visit_occurrence_id_A": F.col("visit_occurrence_id_B")}
    )
    found = dict(tuple(r) for r in pairing.pair_invariants(broken).collect())
    found.pop("repeated pair id")
    assert set(found.values()) == {2000}


def test_pair_counts(pairs):
    unordered = {r["labels"]: r["count"] for r in pairing.unordered_pair_counts(pairs).collect()}
    assert unordered == {"-".join(sorted(pair)): 200 for pair in C.PAIR_LEVELS}
    ordered = profile.group_sizes(pairs, "acuitylevel_A", "acuitylevel_B").collect()
    assert len(ordered) == 20 and sum(r["count"] for r in ordered) == 2000


def test_prompt_is_null_if_a_history_is(spark):
    df = spark.createDataFrame([("a", None), ("a", "b")], "a string, b string")
    prompts = [r[0] for r in df.select(L.pair_prompt(F.col("a"), F.col("b"))).collect()]
    assert prompts[0] is None and prompts[1] is not None


def test_prompt_budget(pairs):
    row = pairing.prompt_budget(pairs, model_limit=205, intro_tokens=50, answer_reserve=5).collect()[0]
    tokens = [r.prompt_tokens for r in pairs.select("prompt_tokens").collect()]
    assert row.token_limit == 150 and row.max_prompt_tokens == max(tokens)
    assert row.prompts_over_limit == sum(t > 150 for t in tokens)


def test_recodes(spark):
    df = spark.createDataFrame([("Urgent",), ("*Unspecified",), (None,)], "v string")
    got = [tuple(r) for r in df.select(L.acuity_rank(F.col("v")), L.relabel(F.col("v"), {"Urgent": "u"})).collect()]
    assert got == [(3, "u"), (None, "*Unspecified"), (None, None)]
    numbers = spark.createDataFrame([(2,), (-1,), (0,), (None,)], "d int")
    sides = [r[0] for r in numbers.select(L.side_from_difference(F.col("d"))).collect()]
    assert sides == ["A", "B", None, None]


def test_cohort_with_a_hot_visit(spark):
    """A third of all notes belong to one visit and one patient."""
    n = 3000
    visits = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).cast("long").alias("person_id"),
        F.col("id").alias("visit_occurrence_id"), (F.col("id") % 50).alias("agekey"),
        *[F.lit(None).cast("long").alias(c) for c in ("ed_visit_occurrence_id", "person_id2", "agekeyvalue",
                                                      "admission_visit_occurrence_id")],
        *[F.lit(None).cast("timestamp_ntz").alias(c) for c in (
            "arrival_datetime", "admissiondecision_datetime", "departure_datetime", "disposition_datetime")],
        *[F.lit(None).cast("string").alias(c) for c in (
            "departmentname", "departmentspecialty", "admissiondepartmentname", "admissiondepartmentspecialty",
            "eddisposition", "dischargedisposition")],
        F.lit("Urgent").alias("acuitylevel"),
    )
    patients = spark.range(n).select(
        F.col("id").alias("person_id"), *[F.lit("x").alias(c) for c in ("sex", "ethnicity", "firstrace", "multiracial")]
    )
    durations = spark.range(50).select(F.col("id").alias("durationkey"), (F.col("id") * 365 * 2).cast("int").alias("days"))
    note = F.col("id")
    metadata = spark.range(2 * n).select(
        note.alias("deid_note_key"), F.lit(1).cast("long").alias("person_id"),
        F.when(note % 3 == 0, 49).otherwise(note % n).cast("long").alias("visit_occurrence_id"),
        F.when(note % 7 == 0, "Progress Notes").otherwise("ED Provider Notes").alias("note_type"),
        *[F.lit(None).cast("string").alias(c) for c in ("encounter_type", "enc_dept_name", "enc_dept_specialty",
                                                        "auth_prov_type")],
        F.lit("UCSF").alias("prov_specialty"),
        F.lit("2020-01-01").cast("date").cast("timestamp_ntz").alias("deid_service_date"),
    )
    texts = spark.range(2 * n).select(
        note.alias("deid_note_key"), F.concat(F.lit("Chief Complaint "), note.cast("string")).alias("note_text")
    )
    cohort = jobs.cohort_notes(visits, patients, durations, metadata, texts)
    rows = cohort.select("visit_occurrence_id", "deid_note_key", "note_text", "edvisit_age").collect()
    want = {
        (49 if i % 3 == 0 else i % n, i)
        for i in range(2 * n)
        if i % 7 and (((49 if i % 3 == 0 else i % n) % 50) * 730 / 365.25 >= 18)
    }
    assert {(r.visit_occurrence_id, r.deid_note_key) for r in rows} == want and len(rows) == len(want)
    assert all(r.note_text == f"Chief Complaint {r.deid_note_key}" and r.edvisit_age >= 18 for r in rows)
    prepared = jobs.prepare_notes(cohort)
    assert prepared.count() == len({v for v, _ in want})
    hot = prepared.filter("visit_occurrence_id = '49'").select("deid_note_key").collect()
    longest = max(len(str(i)) for v, i in want if v == 49)
    assert [r[0] for r in hot] == [min(i for v, i in want if v == 49 and len(str(i)) == longest)]
    headers = jobs.cohort_headers(visits, patients, durations, metadata)
    by_header = jobs.prepare_from_headers(headers, texts)
    assert by_header.columns == prepared.columns
    assert sorted(by_header.collect(), key=repr) == sorted(prepared.collect(), key=repr)
    funnel = jobs.cohort_funnel(visits, durations, metadata).orderBy("step").collect()
    assert [r.n_rows for r in funnel][0] == 2 * n and [r.n_rows for r in funnel][-1] == len(want)


def test_draw_above_the_broadcast_limit(spark):
    def number(*parts):
        return int(hashlib.md5("-".join(map(str, parts)).encode()).hexdigest()[:15], 16)

    n = 10_000
    members = {}
    for r in _refined(spark).collect():
        members.setdefault(r.acuitylevel, []).append(r.visit_occurrence_id)
    for found in members.values():
        found.sort(key=lambda v: (number(5, v), v))
    drawn = pairing.balanced_pairs(_refined(spark), n, seed=5).drop("history_text_A", "history_text_B").collect()
    assert Counter(r.pair_class for r in drawn) == {i: n for i in range(10)}
    for r in drawn[::97]:
        for side in "AB":
            options = members[r[f"acuitylevel_{side}"]]
            pick = number(r[f"seed_{side}"], r.pair_class, side, r.slot) % len(options)
            assert r[f"visit_occurrence_id_{side}"] == options[pick]
