import random

import pytest

from pairbench.operators import metrics
from pairbench.plans import jobs

SCHEMA = "visit_occurrence_id_combined string, acuity_pair_class int, higher_acuity_patient string, label string"


def brute(rows):
    tp = sum(t == "A" and p == "A" for t, p in rows)
    fp = sum(t != "A" and p == "A" for t, p in rows)
    fn = sum(t == "A" and p != "A" for t, p in rows)
    right = sum(t == p for t, p in rows)
    f1 = 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0
    return (len(rows), sum(t == "A" for t, _ in rows), sum(t == "B" for t, _ in rows), right, right / len(rows), f1)


def values(row):
    return tuple(row[c] for c in ("n", "truth_a", "truth_b", "n_correct", "accuracy", "f1"))


@pytest.fixture(scope="module")
def data():
    rng = random.Random(1)
    return [
        (f"p{i}", rng.choice([0, 1, 2, None]), rng.choice("AB"), rng.choice(["A", "A", "B", "neither", "error", None]))
        for i in range(600)
    ]


def test_overall_and_by_class(spark, data):
    df = spark.createDataFrame(data, SCHEMA)
    assert values(metrics.overall(df).collect()[0]) == pytest.approx(brute([r[2:] for r in data]))
    rows = metrics.by_class(df).collect()
    assert [r.acuity_pair_class for r in rows] == [0, 1, 2]
    for r in rows:
        assert values(r) == pytest.approx(brute([d[2:] for d in data if d[1] == r.acuity_pair_class]))


def test_empty_and_one_sided_groups(spark):
    df = spark.createDataFrame([("p", 0, "B", "B"), ("q", 0, "B", "error")], SCHEMA)
    assert values(metrics.overall(df).collect()[0]) == (2, 0, 2, 1, 0.5, 0.0)
    assert values(metrics.overall(df.filter("false")).collect()[0]) == (0, 0, 0, 0, None, 0.0)


def test_raters_and_evaluation(spark, data):
    rng = random.Random(2)
    person = {f"p{i}": rng.choice("AB") for i in range(0, 600, 3)}
    df = spark.createDataFrame(data, SCHEMA)
    notes = spark.createDataFrame([(k, "x", v) for k, v in person.items()],
                                  "visit_occurrence_id_combined string, rater_label string, rater_label_binary string")
    subset = metrics.annotated_subset(df, notes, "visit_occurrence_id_combined")
    assert subset.count() == len(person)
    rows = {r.rater: values(r) for r in metrics.by_rater(subset, {"m": "label", "p": "rater_label_binary"}).collect()}
    chosen = [d for d in data if d[0] in person]
    assert rows["m"] == pytest.approx(brute([d[2:] for d in chosen]))
    assert rows["p"] == pytest.approx(brute([(d[2], person[d[0]]) for d in chosen]))

    other = spark.createDataFrame([(a, b, c, "A") for a, b, c, _ in data], SCHEMA)
    table = {
        (r.scope, r.rater, r.acuity_pair_class): values(r)
        for r in jobs.evaluate({"one": df, "two": other}, notes).collect()
    }
    assert len(table) == 2 * 3 * 4
    assert table[("all", "one", None)] == pytest.approx(brute([d[2:] for d in data]))
    assert table[("all", "two", 1)] == pytest.approx(brute([(d[2], "A") for d in data if d[1] == 1]))
    assert table[("annotated", "one", 2)] == pytest.approx(brute([d[2:] for d in chosen if d[1] == 2]))
    for model in ("one", "two"):
        want = brute([(d[2], person[d[0]]) for d in chosen])
        assert table[("annotated", f"rater on {model}", None)] == pytest.approx(want)


def test_results_are_marked(spark):
    df = spark.createDataFrame(
        [("0", "A", "Urgent_Immediate"), ("1", "A", "Immediate_Urgent"), ("neither", "B", "Urgent_Urgent"), (None, "B", None)],
        "label string, higher_acuity_patient string, acuitylevel_combined string",
    )
    got = [(r.label, r.correct_label, r.acuity_pair_class) for r in metrics.mark_results(df).collect()]
    assert got == [("A", 1, 1), ("B", 0, 1), ("neither", 0, None), (None, 0, None)]
