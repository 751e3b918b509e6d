import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairbench.constants import CALL_FAILED
from pairbench.functions import labels as L
from pairbench.operators import scoring
from pairbench.schemas import RESPONSES


def answer(content, **usage):
    return json.dumps({"choices": [{"message": {"content": content}}], "usage": usage})


def test_response_content_and_usage(spark):
    data = [
        answer("0: Patient A", prompt_tokens=12, completion_tokens=9),
        CALL_FAILED,
        None,
        "{broken",
        '{"choices": []}',
        '{"choices": [{"message": {"content": null}}], "usage": {"prompt_tokens": "many"}}',
    ]
    df = spark.createDataFrame(list(enumerate(data)), "i int, r string").orderBy("i")
    column = F.col("r")
    got = [tuple(r) for r in df.select(L.response_content(column), L.response_usage(column, "prompt_tokens")).collect()]
    assert got == [("0: Patient A", 12)] + [(CALL_FAILED, None)] * 5


def test_answer_label(spark):
    texts = ["0", "it is 1", "10", "no idea", CALL_FAILED, CALL_FAILED + " 1", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    plain = [r[0] for r in df.select(L.answer_label(F.col("t"))).collect()]
    assert plain == ["0", "1", "0", "neither", "error", "1", "neither"]
    both = [r[0] for r in df.select(L.answer_label(F.col("t"), detect_both=True)).collect()]
    assert both == ["0", "1", "both_present", "neither", "error", "1", "neither"]


def _pairs(spark, n=40):
    return spark.range(n).select(
        F.concat(F.lit("p"), (F.col("id") % 30).cast("string")).alias("visit_occurrence_id_combined"),
        F.concat(F.lit("prompt "), (F.col("id") % 30).cast("string")).alias("prompt"),
        "id",
    )


def test_each_prompt_is_scored_once_and_failures_stay_rows(spark, tmp_path):
    log = str(tmp_path)

    def scorer(row):
        import uuid

        with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
            f.write(row["prompt"])
        if row["prompt"].endswith("7"):
            raise RuntimeError("the service said no")
        return "ok " + row["prompt"]

    got = scoring.score_pairs(_pairs(spark), scorer, partitions=5).collect()
    assert len(got) == 30 and set(got[0].asDict()) == set(RESPONSES.names)
    for r in got:
        want = CALL_FAILED if r.prompt.endswith("7") else "ok " + r.prompt
        assert r.response_json == want
    assert sorted(p.read_text() for p in tmp_path.iterdir()) == sorted(f"prompt {i}" for i in range(30))


def test_scoring_runs_in_as_many_tasks_as_asked_for(spark):
    def scorer(row):
        from pyspark import TaskContext

        return str(TaskContext.get().partitionId())

    got = scoring.score_pairs(_pairs(spark, 30), scorer, partitions=6).collect()
    assert {int(r.response_json) for r in got} <= set(range(6))
    assert len({r.response_json for r in got}) >= 4


def test_resume_scores_only_what_is_missing(spark):
    pairs = _pairs(spark)
    stored = spark.createDataFrame([(f"p{i}", f"prompt {i}", f"old {i}") for i in range(10)], RESPONSES)
    # The same id with another prompt is not stored yet.
    changed = pairs.withColumn("prompt", F.when(F.col("id") == 3, "new prompt").otherwise(F.col("prompt")))

    def scorer(row):
        return "new " + row["prompt"]

    got = {(r.visit_occurrence_id_combined, r.prompt): r.response_json
           for r in scoring.score_remaining(changed, stored, scorer).collect()}
    assert len(got) == 31
    assert all(got[(f"p{i}", f"prompt {i}")] == f"old {i}" for i in range(10))
    assert all(got[(f"p{i}", f"prompt {i}")] == f"new prompt {i}" for i in range(10, 30))
    assert got[("p3", "new prompt")] == "new new prompt"


def test_attach_responses_needs_id_and_prompt(spark):
    pairs = spark.createDataFrame(
        [("a", "p", 1), ("a", "q", 2), ("b", "p", 3), ("a", "p", 4)], "visit_occurrence_id_combined string, prompt string, n int"
    )
    responses = spark.createDataFrame([("a", "p", "r"), ("b", "p", None)], RESPONSES)
    got = scoring.attach_responses(pairs, responses)
    assert sorted((r.n, r.response_json) for r in got.collect()) == [(1, "r"), (4, "r")]


class Clock:
    def __init__(self):
        self.now, self.slept = 0.0, []

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.slept.append(seconds)
        self.now += seconds


def test_pacing():
    clock = Clock()
    wait = scoring.paced(2.0, clock, clock.sleep)
    times = []
    for work in (0.0, 0.5, 5.0, 0.0, 0.0):
        wait()
        times.append(clock.now)
        clock.now += work
    assert times == [0.0, 2.0, 4.0, 9.0, 11.0]


def test_quota_is_shared_by_the_tasks():
    clock, calls = Clock(), []

    def scorer(row):
        calls.append(clock.now)
        return "x"

    pause = scoring.quota_share(295, 4)
    run = scoring.scoring_task(scorer, pause, pacer=lambda s: scoring.paced(s, clock, clock.sleep))
    batch = pd.DataFrame({"visit_occurrence_id_combined": list("abcdef"), "prompt": list("abcdef")})
    out = pd.concat(run(iter([batch.iloc[:4], batch.iloc[4:]])))
    assert list(out.columns) == RESPONSES.names and list(out.response_json) == ["x"] * 6
    gaps = [b - a for a, b in zip(calls, calls[1:])]
    assert gaps == pytest.approx([pause] * 5)


def test_quota_runs_on_spark(spark):
    got = scoring.score_pairs(_pairs(spark, 4), lambda row: "x", partitions=2, calls_per_minute=60000).collect()
    assert [r.response_json for r in got] == ["x"] * 4


def test_a_small_quota_takes_as_few_tasks_by_itself(spark):
    got = scoring.score_pairs(_pairs(spark, 1), lambda row: "x", calls_per_minute=3).collect()
    assert [r.response_json for r in got] == ["x"]
    with pytest.raises(ValueError, match="quota"):
        scoring.score_pairs(_pairs(spark, 2), lambda row: "x", partitions=4, calls_per_minute=3)


def test_calls_by_lists_and_several_at_a_time(spark):
    def scorer(rows):
        if any(r["prompt"].endswith("7") for r in rows):
            raise RuntimeError("no")
        return ["ok " + r["prompt"] for r in rows]

    frame = pd.DataFrame({"visit_occurrence_id_combined": list("abcdef"), "prompt": [f"p{i}" for i in (1, 2, 3, 7, 5, 6)]})
    starts = []
    task = scoring.scoring_task(scorer, 1.0, pacer=lambda s: lambda: starts.append(s), rows_per_call=2, calls_at_once=3)
    found = list(next(task(iter([frame])))["response_json"])
    assert found == ["ok p1", "ok p2", CALL_FAILED, CALL_FAILED, "ok p5", "ok p6"] and len(starts) == 3
    short = scoring.scoring_task(lambda rows: ["one"], rows_per_call=3)
    assert list(next(short(iter([frame])))["response_json"]) == [CALL_FAILED] * 6


def test_only_the_last_prompt_of_an_id(spark):
    rows = [("a", "first", 0, 1_500_000), ("a", "last", 1, 0), ("b", "only", 0, 3)]
    pairs = spark.createDataFrame(rows, "visit_occurrence_id_combined string, prompt string, pair_class int, slot long")
    order = F.struct("pair_class", "slot")
    assert {tuple(r) for r in scoring.prompts_by_id(pairs, order).collect()} == {("a", "last"), ("b", "only")}
    scored = scoring.score_pairs(pairs, lambda row: row["prompt"].upper(), partitions=2, last_by=order)
    assert {(r.visit_occurrence_id_combined, r.response_json) for r in scored.collect()} == {("a", "LAST"), ("b", "ONLY")}


def test_a_share_of_the_quota_is_whole_calls():
    for calls, tasks in ((295, 4), (295, 64), (10, 10), (7, 2)):
        pause = scoring.quota_share(calls, tasks)
        # Calls at equal distances: the most that any half-open window of 60 seconds holds.
        assert sum(k * pause < 60 - 1e-9 for k in range(400)) * tasks <= calls
    with pytest.raises(ValueError, match="quota"):
        scoring.quota_share(10, 11)


def test_the_log_of_calls(tmp_path):
    clock = Clock()
    log = scoring.CallLog(str(tmp_path), 3, clock)
    assert log.latest() is None and list(log.batches()) == []
    wait = log.paced(2.0, clock.sleep)
    wait(), wait()
    assert clock.now == 2.0 and log.latest() == 2.0
    frame = pd.DataFrame({"visit_occurrence_id_combined": ["a", "b"], "prompt": ["p", None], "response_json": ["r", "s"]})
    log.commit(frame)
    # Half a file of a lost attempt does not count.
    (tmp_path / "p000003" / ".half.parquet").write_bytes(b"PAR1")
    clock.now = 2.5
    again = scoring.CallLog(str(tmp_path), 3, clock)
    assert [b.to_dict("records") for b in again.batches()] == [frame.to_dict("records")]
    again.paced(2.0, clock.sleep)()
    assert clock.now == 4.0
    assert scoring.CallLog(str(tmp_path), 4, clock).latest() is None
    # The first attempt has lost the partition.
    with pytest.raises(RuntimeError, match="taken over"):
        log.started()


def _dying_scorer(folder, after):
    """Records each prompt with the time of its call; its process dies once, at the given call of some task."""

    def scorer(row):
        import os
        import time
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(f"{time.time()} {row['prompt']}")
        if len(os.listdir(folder)) >= after and not os.path.exists(f"{folder}.died"):
            open(f"{folder}.died", "w").close()
            os._exit(1)
        return "ok " + row["prompt"]

    return scorer


def _sent(folder):
    calls = [p.read_text().split(" ", 1) for p in folder.iterdir()]
    return sorted((float(t), prompt) for t, prompt in calls)


def test_a_quota_holds_over_a_lost_task_and_little_is_sent_twice(spark, tmp_path):
    calls, log = tmp_path / "calls", str(tmp_path / "log")
    calls.mkdir()
    # Two tasks, each a call every 0.1 seconds.
    scored = scoring.score_pairs(
        _pairs(spark, 60), _dying_scorer(str(calls), 13), partitions=2, calls_per_minute=1200, log=log, commit_rows=4
    )
    got = scored.collect()
    assert (tmp_path / "calls.died").exists()
    assert sorted(r.response_json for r in got) == sorted(f"ok prompt {i}" for i in range(30))
    times = [t for t, _ in _sent(calls)]
    # As a minute holds 1200 calls at most, so does a second 20.
    assert all(sum(a <= t < a + 1 for t in times) <= 20 for a in times)
    # Beyond the open batches of both tasks, nothing is sent twice; a second read sends nothing.
    assert 30 < len(times) <= 30 + 2 * 4
    assert len(scored.collect()) == 30 and len(_sent(calls)) == len(times)


def test_a_lost_job_is_taken_up_from_its_log(spark, tmp_path):
    calls, log = tmp_path / "calls", str(tmp_path / "log")
    calls.mkdir()
    scorer = _dying_scorer(str(calls), 20)
    assert scoring.logged_responses(spark, log).count() == 0
    with pytest.raises(Exception):
        scoring.score_pairs(_pairs(spark, 60), scorer, partitions=2, log=log, commit_rows=3).collect()
    before = _sent(calls)
    known = scoring.logged_responses(spark, log).collect()
    assert 0 < len(known) < 30 and len(before) <= len(known) + 2 * 3
    got = scoring.score_logged(_pairs(spark, 60), scorer, log, partitions=2, commit_rows=3).collect()
    assert sorted(r.response_json for r in got) == sorted(f"ok prompt {i}" for i in range(30))
    assert len(_sent(calls)) == len(before) + 30 - len(known)
    # All is on record now.
    assert len(scoring.score_logged(_pairs(spark, 60), scorer, log, partitions=3).collect()) == 30
    assert len(_sent(calls)) == len(before) + 30 - len(known)
