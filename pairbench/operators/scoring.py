"""Scoring of prompts by a model of the user's, and reading of its answers."""

from __future__ import annotations

import hashlib
import sys
import time
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import partial
from urllib.parse import unquote, urlparse

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairbench.constants import CALL_FAILED, QUOTA_SECONDS
from pairbench.functions import labels as L
from pairbench.operators import tables
from pairbench.schemas import RESPONSES
from pairbench.sources.files import exists, stage

# The functions below travel to the workers whole, which need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PAIR_ID = "visit_occurrence_id_combined"

# A scorer gets one row as a mapping and returns the response as a string; a batch
# scorer gets a list of rows and returns a list of responses.
Scorer = Callable[[Mapping], str] | Callable[[Sequence[Mapping]], Sequence[str]]


def paced(seconds_per_call: float, clock=time.monotonic, sleep=time.sleep, due: float | None = None) -> Callable[[], None]:
    """A function that, called before each request, keeps requests that far apart, the first from ``due`` on."""

    def wait() -> None:
        nonlocal due
        now = clock()
        if due is not None and now < due:
            sleep(due - now)
            now = due
        due = now + seconds_per_call

    return wait


def quota_share(calls_per_minute: float, partitions: int) -> float:
    """Seconds between the calls of each of several tasks, so that no minute holds more than the quota.

    A task gets a whole number of calls a minute: calls at equal distances then never have one more of
    them in any window of that length.
    """
    each = int(calls_per_minute // partitions)
    if each < 1:
        raise ValueError(f"a quota of {calls_per_minute} calls a minute does not do for {partitions} tasks")
    return QUOTA_SECONDS / each


class CallLog:
    """What one partition of a scoring run has done, in a folder that all executors share.

    An attempt reads what those before it wrote: the time of the latest call, and finished batches of
    responses, a file of its own each, which appears whole or not at all. The latest attempt owns the
    partition; one that was given up but still runs finds that out before its next call, and ends.
    """

    def __init__(self, folder: str, partition: int, clock=time.time):
        parts = urlparse(folder)
        if parts.scheme in ("", "file"):
            self.system, path = fs.LocalFileSystem(), unquote(parts.path) if parts.scheme else folder
        else:
            self.system, path = fs.FileSystem.from_uri(folder)
        self.path, self.clock = f"{path}/p{partition:06d}", clock
        self.system.create_dir(self.path, recursive=True)
        self.attempt = uuid.uuid4().hex
        self._put("owner", self.attempt.encode())

    def _put(self, name: str, data: bytes) -> None:
        local = isinstance(self.system, fs.LocalFileSystem)
        place = f"{self.path}/{name}"
        # Stores show an object when it is closed, local folders a file when it gets its name.
        with self.system.open_output_stream(f"{self.path}/.{name}" if local else place, compression=None) as out:
            out.write(data)
        if local:
            self.system.move(f"{self.path}/.{name}", place)

    def _files(self) -> list[str]:
        found = self.system.get_file_info(fs.FileSelector(self.path))
        return sorted(f.path for f in found if not f.base_name.startswith("."))

    def batches(self) -> Iterator[pd.DataFrame]:
        for path in self._files():
            if path.endswith(".parquet"):
                with self.system.open_input_file(path) as source:
                    yield pq.read_table(source).to_pandas()

    def commit(self, responses: pd.DataFrame) -> None:
        table = pa.table({c: pa.array(responses[c], pa.string()) for c in RESPONSES.names})
        sink = pa.BufferOutputStream()
        pq.write_table(table, sink)
        self._put(f"{uuid.uuid4().hex}.parquet", sink.getvalue().to_pybytes())

    def _get(self, name: str) -> str:
        with self.system.open_input_file(f"{self.path}/{name}") as source:
            return source.read().decode()

    def started(self) -> None:
        """Record a call. A later owner that this one does not see here yet reads the record."""
        self._put("latest-call", repr(self.clock()).encode())
        if self._get("owner") != self.attempt:
            raise RuntimeError("another attempt has taken over this partition")

    def latest(self) -> float | None:
        return float(self._get("latest-call")) if f"{self.path}/latest-call" in self._files() else None

    def paced(self, seconds_per_call: float, sleep=time.sleep) -> Callable[[], None]:
        """Like ``paced``, going on from the latest call of any earlier attempt."""
        latest = self.latest()
        wait = paced(seconds_per_call, self.clock, sleep, None if latest is None else latest + seconds_per_call)

        def start() -> None:
            wait()
            self.started()

        return start


def _row_key(row: Mapping) -> bytes:
    return hashlib.sha256(f"{len(row[PAIR_ID] or '')}:{row[PAIR_ID]}{row['prompt']}".encode()).digest()


def scoring_task(
    scorer: Scorer,
    seconds_per_call: float = 0.0,
    failed: str = CALL_FAILED,
    pacer=paced,
    rows_per_call: int | None = None,
    calls_at_once: int = 1,
    log: str | None = None,
    commit_rows: int = 64,
) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The work of one partition: one attempt per call, a failed call gives the sentinel.

    With ``rows_per_call`` the scorer gets lists of rows. Calls start one after
    another, at the pace of the quota, and ``calls_at_once`` of them may be open.
    With a ``log``, responses are kept in it every ``commit_rows`` rows, and an
    attempt after a lost one sends only prompts that the log does not have.
    """
    columns = RESPONSES.names

    def call(rows: list[dict]) -> list[str]:
        try:
            found = list(scorer(rows)) if rows_per_call else [scorer(rows[0])]
            if len(found) != len(rows):
                raise ValueError("a scorer must give one response per row")
            return found
        except Exception:
            return [failed] * len(rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = CallLog(log, TaskContext.get().partitionId()) if log else None
        wait = (own.paced if own else pacer)(seconds_per_call) if seconds_per_call else None
        size = rows_per_call or 1

        def started(pool, rows):
            if wait is not None:
                wait()
            return pool.submit(call, rows).result if calls_at_once > 1 else partial(list, call(rows))

        def scored(batch: pd.DataFrame) -> pd.DataFrame:
            rows = batch.to_dict("records")
            with ThreadPoolExecutor(calls_at_once) as pool:
                calls = [started(pool, rows[i : i + size]) for i in range(0, len(rows), size)]
                responses = [r for result in calls for r in result()]
            return batch.assign(response_json=pd.Series(responses, index=batch.index, dtype=object))[columns]

        if own is None:
            yield from map(scored, batches)
            return
        done = set()
        for finished in own.batches():
            keys = [_row_key(r) for r in finished.to_dict("records")]
            fresh = [k not in done and k not in keys[:i] for i, k in enumerate(keys)]
            done.update(keys)
            yield finished.loc[fresh, columns]
        step = max(size, commit_rows // size * size)
        for batch in batches:
            left = batch[[_row_key(r) not in done for r in batch.to_dict("records")]]
            for at in range(0, len(left), step):
                if wait is None:
                    own.started()
                responses = scored(left.iloc[at : at + step])
                own.commit(responses)
                yield responses

    return run


def logged_responses(spark: SparkSession, log: str) -> DataFrame:
    """All responses that any run has left in a log, each once."""
    if not exists(spark, log):
        return spark.createDataFrame([], RESPONSES)
    found = spark.read.schema(RESPONSES).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(log)
    return found.dropDuplicates([PAIR_ID, "prompt"])


def prompts_by_id(pairs: DataFrame, order) -> DataFrame:
    """The last prompt of each pair id."""
    return tables.last_value_per_key(pairs, PAIR_ID, "prompt", order)


def score_pairs(
    pairs: DataFrame,
    scorer: Scorer,
    inputs: tuple[str, ...] = (),
    partitions: int | None = None,
    calls_per_minute: float | None = None,
    last_by: Column | None = None,
    rows_per_call: int | None = None,
    calls_at_once: int = 1,
    log: str | None = None,
    commit_rows: int = 64,
) -> DataFrame:
    """Score each distinct prompt of each pair id once.

    With ``last_by``, only the last prompt of each id in that order is scored.

    ``inputs`` names further columns the scorer needs. With a quota, each of the
    ``partitions`` tasks keeps to its share of it, which holds however many of
    them run at a time. The result has pair id, prompt and response; it should be
    written before it is read (``stage``), so that no prompt is sent again.

    ``log`` names a folder that all executors share. Responses are kept there as
    they come, below a folder of this run: a task that is lost, or a second read of
    the result, sends only what is not there yet, and ``logged_responses`` reads
    them if the whole job is lost. With a log, a quota also holds over lost tasks:
    they run in a barrier stage, which starts them together (so there must be as many
    slots as ``partitions``) and has no speculative copies, and go on from the latest
    call on record.
    """
    if partitions is None:
        partitions = pairs.sparkSession.sparkContext.defaultParallelism
        if calls_per_minute:
            partitions = max(1, min(partitions, int(calls_per_minute)))
    pause = quota_share(calls_per_minute, partitions) if calls_per_minute else 0.0
    columns = [PAIR_ID, "prompt", *inputs]
    # Dealt out by number first: that is the shuffle of the deduplication too, and
    # its partitions are not merged, so all of them are left to score.
    if last_by is None:
        spread = pairs.select(*columns).repartition(partitions, PAIR_ID, "prompt").dropDuplicates([PAIR_ID, "prompt"])
    else:
        spread = pairs.select(*columns, last_by.alias("__order")).repartition(partitions, PAIR_ID)
        last = F.max_by(F.struct(*columns), "__order").alias("last")
        spread = spread.groupBy(PAIR_ID).agg(last).select("last.*")
    run = f"{log.rstrip('/')}/run-{uuid.uuid4().hex}" if log else None
    task = scoring_task(
        scorer, pause, rows_per_call=rows_per_call, calls_at_once=calls_at_once, log=run, commit_rows=commit_rows
    )
    if not (run and calls_per_minute):
        return spread.mapInPandas(task, schema=RESPONSES)
    # Spark runs a barrier stage again only if a shuffle follows it.
    return spread.mapInPandas(task, schema=RESPONSES, barrier=True).repartition(partitions, PAIR_ID, "prompt")


def _prompt_hash() -> Column:
    """Stands for the prompt in joins, which then carry no long keys."""
    return F.sha2("prompt", 256)


def score_remaining(pairs: DataFrame, stored: DataFrame, scorer: Scorer, **options) -> DataFrame:
    """Score only what has no stored response, and return old and new responses."""
    key = [PAIR_ID, "__prompt"]
    known = stored.select(PAIR_ID, _prompt_hash().alias("__prompt")).distinct()
    open_pairs = pairs.withColumn("__prompt", _prompt_hash()).join(known, key, "left_anti").drop("__prompt")
    fresh = stage(score_pairs(open_pairs, scorer, **options))
    return tables.union_rows(stored.select(*RESPONSES.names), fresh)


def score_logged(pairs: DataFrame, scorer: Scorer, log: str, **options) -> DataFrame:
    """Score what no earlier run with this log has a response for; returns old and new responses."""
    return score_remaining(pairs, stage(logged_responses(pairs.sparkSession, log)), scorer, log=log, **options)


def attach_responses(pairs: DataFrame, responses: DataFrame) -> DataFrame:
    """Add the response to every pair with the same id and prompt; others are dropped."""
    answered = responses.filter("response_json IS NOT NULL").select(
        PAIR_ID, _prompt_hash().alias("__prompt"), "response_json"
    )
    columns = [PAIR_ID, "prompt", *[c for c in pairs.columns if c not in (PAIR_ID, "prompt")], "response_json"]
    return pairs.withColumn("__prompt", _prompt_hash()).join(answered, [PAIR_ID, "__prompt"]).select(*columns)


def parse_responses(df: DataFrame, detect_both: bool = False) -> DataFrame:
    return (
        df.withColumn("response_content", L.response_content(F.col("response_json")))
        .withColumn("label", L.answer_label(F.col("response_content"), detect_both))
    )


def add_usage(df: DataFrame) -> DataFrame:
    """Prompt and completion tokens as the model counted them."""
    return df.withColumns(
        {c: L.response_usage(F.col("response_json"), c) for c in ("prompt_tokens", "completion_tokens")}
    )


def process_responses(pairs: DataFrame, responses: DataFrame) -> DataFrame:
    return parse_responses(attach_responses(pairs, responses))
