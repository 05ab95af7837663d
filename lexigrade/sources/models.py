"""Pluggable models: a judge, a generator, an encoder or a reranker behind a function.

The function gets a prompt and returns a text (or raises). Calls are retried
with growing waits, one row's failure does not stop the others, and the number
of partitions is the number of calls at a time. Stubs make tests deterministic.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A failure that another payload may cure, so that it is not retried with the same one.
class Rejected(Exception):
    pass


Call = Callable[[str], str]


def with_retries(variants: Sequence[Call], prompt: str, tries: int = 3, base_wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """The first variant's reply; a rejected payload goes to the next variant at once, another failure waits base * 2 ** attempt."""
    last: Exception | None = None
    for call in variants:
        for attempt in range(tries):
            try:
                return call(prompt)
            except Rejected as e:
                last = e
                break
            except Exception as e:  # noqa: BLE001  any failure of a remote model
                last = e
                if attempt + 1 < tries:
                    sleep(base_wait * 2**attempt)
    raise RuntimeError(f"no reply: {last}")


def replies(rows: DataFrame, prompt_col: str, variants: Sequence[Call], parallel: int | None = None, tries: int = 3, base_wait: float = 1.0, gap: float = 0.0) -> DataFrame:
    """rows with reply and error. Blank prompts are not sent. ``parallel`` calls run at a time; 1 is one after the other."""
    schema = rows.withColumns({"reply": F.lit(None).cast("string"), "error": F.lit(None).cast("string")}).schema
    dealt = rows if parallel is None else rows.repartition(parallel) if parallel > 1 else rows.coalesce(1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            said, wrong = [], []
            for prompt in frame[prompt_col]:
                reply = error = None
                if prompt is not None and str(prompt).strip():
                    try:
                        reply = with_retries(variants, prompt, tries, base_wait)
                    except RuntimeError as e:
                        error = str(e)
                    if gap:
                        time.sleep(gap)
                said.append(reply)
                wrong.append(error)
            yield frame.assign(reply=said, error=wrong)

    return dealt.mapInPandas(run, schema)


_LOADED: dict[str, Call] = {}
_LOADING = threading.Lock()


def loaded(name: str, loaders: Sequence[Callable[[], Call]], warm_up: str | None = None) -> Call:
    """This worker process's model of a name: the first caller loads and warms it, all others, in this and in later tasks, get the same one."""
    with _LOADING:
        if name not in _LOADED:
            _LOADED[name] = first_that_loads(loaders, warm_up)
        return _LOADED[name]


class Late(Exception):
    """A call that took longer than its deadline."""


def within(call: Call, prompt: str, deadline_s: float | None) -> str:
    """The call's reply if it comes in time; a late call is left to itself, in a thread that ends with the process."""
    if deadline_s is None:
        return call(prompt)
    said: list[str] = []
    wrong: list[BaseException] = []

    def run() -> None:
        try:
            said.append(call(prompt))
        except BaseException as e:  # noqa: BLE001  whatever a model raises is the caller's to see
            wrong.append(e)

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(deadline_s)
    if thread.is_alive():
        raise Late(f"no reply within {deadline_s} s")
    if wrong:
        raise wrong[0]
    return said[0]


def called(
    rows: DataFrame, prompt_col: str, name: str, loaders: Sequence[Callable[[], Call]], *, warm_up: str | None = None, tries: int = 3, base_wait: float = 1.0,
    deadline_s: float | None = None, gap: float = 0.0, lanes: int | None = None, profile: ResourceProfile | None = None,
) -> DataFrame:
    """rows with reply, error, tries, waited (seconds) and late, by a model that each worker process loads once.

    Each row's call has its own retries and its own deadline, which ends its
    retries, too; a failed or late one is a row like the others. With ``lanes``
    rows are dealt over so many tasks, and a lane waits ``lanes * gap`` between the
    starts of two calls, so that all together start one a ``gap``. ``profile`` asks for
    what a task needs of an executor: one that takes a whole device leaves room
    for a single model there. A job tag on the session's context cancels the run.
    """
    added = {"reply": "string", "error": "string", "tries": "int", "waited": "double", "late": "boolean"}
    schema = rows.withColumns({k: F.lit(None).cast(v) for k, v in added.items()}).schema
    dealt = rows if lanes is None else rows.repartition(lanes)
    pause = gap * (lanes or 1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        began = None
        for frame in frames:
            out = []
            for prompt in frame[prompt_col]:
                if prompt is None or not str(prompt).strip():
                    out.append((None, None, 0, 0.0, False))
                    continue
                if pause and began is not None:
                    time.sleep(max(0.0, began + pause - time.monotonic()))
                began = time.monotonic()
                counted, waits = [0], []

                def once(text: str, counted: list[int] = counted) -> str:
                    counted[0] += 1
                    return loaded(name, loaders, warm_up)(text)

                def wait(seconds: float, waits: list[float] = waits) -> None:
                    waits.append(seconds)
                    time.sleep(seconds)

                reply = error = None
                late = False
                try:
                    reply = within(lambda text: with_retries([once], text, tries, base_wait, wait), prompt, deadline_s)  # noqa: B023  called before the next row
                except Late as e:
                    error, late = str(e), True
                except RuntimeError as e:
                    error = str(e)
                out.append((reply, error, counted[0], float(sum(waits)), late))
            yield frame.assign(**{k: [x[i] for x in out] for i, k in enumerate(added)})

    return dealt.mapInPandas(run, schema, profile=profile)


def scorer(function: Callable[[pd.Series, pd.Series], pd.Series]) -> Callable[[Column, Column], Column]:
    """A cross-encoder as a Column function of (query, passage)."""
    return F.pandas_udf(function, "double")


def encoder(function: Callable[[pd.Series], pd.Series]) -> Callable[[Column], Column]:
    """An embedding model as a Column function; vectors are to be normalised by index.unit_vector."""
    return F.pandas_udf(function, "array<float>")


def first_that_loads(loaders: Sequence[Callable[[], Call]], warm_up: str | None = None) -> Call:
    """The call of the first loader that loads, and answers a prompt if one is given: a smaller model stands in for one that does not fit."""
    last: Exception | None = None
    for load in loaders:
        try:
            call = load()
            if warm_up is not None:
                call(warm_up)
            return call
        except Exception as e:  # noqa: BLE001  any failure of a model
            last = e
    raise RuntimeError(f"no model loads: {last}")


def closed_loop(spark: SparkSession, call: Call, prompts: Sequence[str], rounds: int = 3, warm_up: int = 2, concurrency: int = 2, clock: Callable[[], float] = time.monotonic) -> DataFrame:
    """(repetition, request, ok, latency_s, wall_s) of a load test: each worker sends its next request when it has the last one's reply.

    Round 0 is the warm-up. The load is the driver's own: it measures a server, not Spark.
    """

    def one(prompt: str) -> tuple[bool, float]:
        began = clock()
        try:
            call(prompt)
            return True, clock() - began
        except Exception:  # noqa: BLE001  a failed request is a row
            return False, clock() - began

    rows = []
    with ThreadPoolExecutor(concurrency) as workers:
        for r in range(rounds + 1):
            began = clock()
            done = list(workers.map(one, prompts if r else prompts[:warm_up]))
            wall = clock() - began
            rows += [(r, i, ok, latency, wall) for i, (ok, latency) in enumerate(done)]
    return spark.createDataFrame(rows, "repetition int, request int, ok boolean, latency_s double, wall_s double")


def timeouts(requests: DataFrame, limit_s: float) -> DataFrame:
    """Requests (..., ok, latency_s) that took longer than the limit, with over_s; failed ones count if they took as long."""
    return requests.where(F.col("latency_s") > limit_s).withColumn("over_s", F.col("latency_s") - limit_s)
