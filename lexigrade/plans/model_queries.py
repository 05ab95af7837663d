"""Queries of what needs a model, with deterministic stand-ins, and of retrieval around one."""

from __future__ import annotations

import time
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..operators import answers, index, metrics, quality, retrieval, segments
from ..sources import models
from ..sources.shared import shared_path
from .base import sql_words, table
from .retrieval_queries import _CONFS, _HYBRID, _TOP4, _TOP, best, both_rankings, out, questions, sql_bm25, units

QUERIES, ORACLES = {}, {}


def _add(name: str, query: object, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


# ---------------------------------------------------------------- index and retrieval

_add(
    "e4_document_frequency",
    lambda s, d: index.document_frequency(index.postings(units(s, d))),
    f"SELECT t AS term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({sql_words('text')}) AS t FROM documents) GROUP BY t",
)


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), F.col("source").alias("doc"), F.col("doc_id").alias("article_no"), F.lit("").alias("title"), "text")


def e8_index_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of an index that was written in two segments, and is read by another object from its folder alone."""
    rows = units(spark, sf)
    made = segments.Segments(spark, shared_path(spark, "segments"))
    late = F.xxhash64("unit") < 0
    made.add(rows.where(~late), 0)
    made.add(rows.where(late), 1)
    made.add(rows.where(late), 1)  # a segment that is written again is replaced
    return segments.Segments(spark, made.path).terms()


_add("e8_index_cache", e8_index_cache, f"SELECT t AS term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({sql_words('text')}) AS t FROM documents) GROUP BY t")


@F.pandas_udf(DoubleType())
def _length_scorer(q: pd.Series, p: pd.Series) -> pd.Series:
    """A cross-encoder's stand-in: texts of like length fit."""
    return -(q.str.len() - p.str.len()).abs().astype(float)


def f9_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """The twelve best of BM25 in another order, four of which stay."""
    hits = best(spark, sf, 12).select("qid", "unit", "rank")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("unit"), "text")
    both = hits.join(docs, "unit").join(questions(spark, sf), "qid")
    return out(retrieval.reranked(both, _length_scorer("question", "text")), "rank")


_add(
    "f9_rerank",
    f9_rerank,
    f"""WITH {sql_bm25()}, {_TOP.format(x='sc')}, c AS (SELECT r.item_id, r.doc_id, r.rank AS old, -abs(length(b.text) - length(d.text))::DOUBLE AS s FROM r JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id) WHERE rank <= 12),
    n AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY s DESC, old) AS INT) AS rank FROM c) SELECT item_id, doc_id, rank, s AS score FROM n WHERE rank <= 4""",
)


def f11_dynamic_weights(spark: SparkSession, sf: str) -> DataFrame:
    lexical, _ = both_rankings(spark, sf, 11)
    w = retrieval.weights_of(retrieval.confidence(lexical))
    return w.select(F.col("qid").alias("item_id"), F.round("w", 6).alias("w"))


_add("f11_dynamic_weights", f11_dynamic_weights, f"WITH {_HYBRID}, {_CONFS} SELECT item_id, round(1 + 0.6::DOUBLE * c, 6) AS w FROM k1c")


def f14_top_k(spark: SparkSession, sf: str) -> DataFrame:
    """The first k of every question, for three k, each by its own search of the index, and whether a k below 1 is refused."""
    try:
        best(spark, sf, 0)
        refused = False
    except ValueError:
        refused = True
    parts = [best(spark, sf, k).select(F.lit(k).alias("k"), F.col("qid").alias("item_id"), F.col("unit").alias("doc_id"), "rank", F.lit(refused).alias("refused")) for k in (1, 3, 7)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_add("f14_top_k", f14_top_k, f"WITH {sql_bm25()}, {_TOP4} SELECT k, item_id, doc_id, rank, true AS refused FROM r, (VALUES (1), (3), (7)) v(k) WHERE rank <= k")


def vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Vectors of documents, and of the questions that have one."""
    e, q = table(spark, sf, "embeddings"), questions(spark, sf)
    own = e.join(table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    asked = e.join(q.select(F.col("qid").alias("vec_id")), "vec_id", "left_semi")
    return own.select(F.col("vec_id").alias("unit"), F.col("embedding").alias("v")), asked.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))


def _found(df: DataFrame, *more: object) -> DataFrame:
    return df.select(F.col("qid").alias("item_id"), "article_no", "rank", F.round("score", 6).alias("score"), *more)


def f15_mode_switch(spark: SparkSession, sf: str) -> DataFrame:
    r = retrieval.Retriever(corpus(spark, sf), *vectors(spark, sf))
    parts = [_found(r.search(questions(spark, sf), 3, mode), F.lit(mode).alias("mode")) for mode in ("bm25", "dense", "rrf")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_SET_HYBRID = _HYBRID.replace("count(*) AS qtf", "1 AS qtf").replace("SELECT item_id, t, count(*)", "SELECT item_id, t, 1")
_add(
    "f15_mode_switch",
    f15_mode_switch,
    f"""WITH {_SET_HYBRID}, al AS (
      SELECT item_id, doc_id, 1.0::DOUBLE / (60 + rank) AS s, 0 AS li, rank FROM l1 WHERE rank <= 12 UNION ALL SELECT item_id, doc_id, 1.0::DOUBLE / (60 + rank), 1, rank FROM l2 WHERE rank <= 12
    ), fz AS (SELECT item_id, doc_id, sum(s) AS s, min(li * 1000 + rank) AS f FROM al GROUP BY ALL), l3 AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(s, 9) DESC, f) AS rank FROM fz),
    x AS (SELECT 'bm25' AS mode, item_id, doc_id, s, rank FROM l1 UNION ALL SELECT 'dense', item_id, doc_id, s, rank FROM l2 UNION ALL SELECT 'rrf', item_id, doc_id, s, rank FROM l3)
    SELECT mode, item_id, doc_id AS article_no, CAST(rank AS INT) AS rank, round(s, 6) AS score FROM x WHERE rank <= 3""",
)


@F.pandas_udf(ArrayType(DoubleType()))
def _broken_encoder(texts: pd.Series) -> pd.Series:
    raise RuntimeError("no memory")


def f16_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """An encoder that fails: the search goes on by BM25, and keeps to it."""
    own, _ = vectors(spark, sf)
    r = retrieval.Retriever(corpus(spark, sf), own, questions(spark, sf).select("qid", _broken_encoder("question").alias("q")))
    first = r.search(questions(spark, sf), 3)
    return _found(first, F.lit(r.vectors is None and "no memory" in r.failure).alias("gave_up"))


_add("f16_fallback", f16_fallback, f"WITH {_SET_HYBRID} SELECT item_id, doc_id AS article_no, CAST(rank AS INT) AS rank, round(s, 6) AS score, true AS gave_up FROM l1 WHERE rank <= 3")
_K1B = sql_bm25().replace("2.2::DOUBLE", "(1 + 0.9::DOUBLE)").replace("1.2::DOUBLE", "0.9::DOUBLE").replace("(0.25::DOUBLE + 0.75::DOUBLE *", "(0.6::DOUBLE + 0.4::DOUBLE *")
_add(
    "f19_bm25_parameters",
    lambda s, d: out(retrieval.bm25(units(s, d), retrieval.question_terms(questions(s, d), "qid", "question"), k1=0.9, b=0.4)),
    f"WITH {_K1B} SELECT item_id, doc_id, round(s, 6) AS score FROM sc",
)

# ---------------------------------------------------------------- answers by a model

_FORMS = ("yesno", "single", "multi", "enum")
_add(
    "g2_token_budget",
    lambda s, d: table(s, d, "documents").select("doc_id", answers.token_budget(F.element_at(F.array(*map(F.lit, _FORMS)), (F.col("doc_id") % 4 + 1).cast("int"))).alias("budget")),
    "SELECT doc_id, [256, 288, 384, 512][doc_id % 4 + 1]::INT AS budget FROM documents",
)


def _stub(prompt: str) -> str:
    """A generator's stand-in: the prompt's first sentence."""
    return prompt.split(". ")[0]


def _prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts, a blank one now and then."""
    return table(spark, sf, "benchmark").select("item_id", F.when(F.col("item_id") % 9 == 4, F.lit("  ")).otherwise(F.col("text")).alias("prompt"))


_SQL_REPLY = "CASE WHEN item_id % 9 <> 4 THEN string_split(text, '. ')[1] END"
_add("g16_generation", lambda s, d: models.replies(_prompts(s, d), "prompt", [_stub]).select("item_id", "reply", "error"), f"SELECT item_id, {_SQL_REPLY} AS reply, CAST(NULL AS VARCHAR) AS error FROM benchmark")


def g20_smaller_model(spark: SparkSession, sf: str) -> DataFrame:
    """The first model does not load, the second one fails at its first prompt, the third one answers."""

    def too_large() -> models.Call:
        raise MemoryError("7B")

    def broken(prompt: str) -> str:
        raise RuntimeError("no kernel")

    call = models.first_that_loads([too_large, lambda: broken, lambda: _stub], warm_up="hello")
    return models.replies(_prompts(spark, sf), "prompt", [call]).select("item_id", "reply")


_add("g20_smaller_model", g20_smaller_model, f"SELECT item_id, {_SQL_REPLY} AS reply FROM benchmark")


def _judge(prompt: str) -> str:
    """A judge's stand-in: axes from lengths."""
    n = len(prompt)
    return f'```json\n{{"accuracy": {n % 11}, "grounding": {n % 7}, "completeness": {n % 5}, "clarity": {n % 3}}}\n```'


def _strict(prompt: str) -> str:
    """A payload that is rejected for every other prompt."""
    if len(prompt) % 2:
        raise models.Rejected("400")
    return _judge(prompt)


def a20_judge(spark: SparkSession, sf: str) -> DataFrame:
    """Replies of a judge with two payloads, parsed to axes and a score."""
    got = models.replies(_prompts(spark, sf), "prompt", [_strict, _judge])
    axes = F.from_json(F.regexp_extract("reply", r"(?s)(\{.*\})", 1), "accuracy double, grounding double, completeness double, clarity double")
    rows = got.where("reply IS NOT NULL").select("item_id", axes.alias("x")).select("item_id", "x.*")
    return rows.select("item_id", F.round(metrics.judge_score({k: k for k in ("accuracy", "grounding", "completeness", "clarity")}), 6).alias("judge"))


_add("a20_judge", a20_judge, "SELECT item_id, round(10 * (0.40::DOUBLE * (length(text) % 11) + 0.25::DOUBLE * (length(text) % 7) + 0.20::DOUBLE * (length(text) % 5) + 0.15::DOUBLE * (length(text) % 3)), 6) AS judge FROM benchmark WHERE item_id % 9 <> 4")


class Flaky:
    """A remote model that fails a prompt's first tries, as many as its length says."""

    def __init__(self) -> None:
        self.tries: dict[str, int] = {}

    def __call__(self, prompt: str) -> str:
        self.tries[prompt] = self.tries.get(prompt, 0) + 1
        if self.tries[prompt] <= len(prompt) % 5:
            raise TimeoutError("busy")
        del self.tries[prompt]
        return _stub(prompt)


def k1_retries(spark: SparkSession, sf: str) -> DataFrame:
    """What each document's retries in its task were: tries, seconds waited, and whether a reply came, for 0 to 4 failures."""
    rows = table(spark, sf, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(" "), "text").alias("prompt"))
    got = models.called(rows, "prompt", f"flaky {uuid.uuid4().hex}", [Flaky], base_wait=0.0005)
    return got.select("doc_id", "tries", F.round("waited", 6).alias("waited"), F.md5(F.col("reply").cast("binary")).alias("reply"), "error")


_add(
    "k1_retries",
    k1_retries,
    """WITH p AS (SELECT doc_id, doc_id || ' ' || text AS t, length(doc_id || ' ' || text) % 5 AS f FROM documents)
    SELECT doc_id, CAST(least(f + 1, 3) AS INT) AS tries, CASE f WHEN 0 THEN 0 WHEN 1 THEN 0.0005 ELSE 0.0015 END::DOUBLE AS waited, CASE WHEN f < 3 THEN md5(string_split(t, '. ')[1]) END AS reply, CASE WHEN f >= 3 THEN 'no reply: busy' END AS error FROM p""",
)


def _slow() -> models.Call:
    def call(prompt: str) -> str:
        if len(prompt) % 9 == 2:
            time.sleep(30)
        return _stub(prompt)

    return call


_add(
    "k4_deadlines",
    lambda s, d: models.called(_prompts(s, d), "prompt", "slow", [_slow], deadline_s=0.3).select("item_id", "reply", "error", "late"),
    f"SELECT item_id, CASE WHEN length(text) % 9 <> 2 THEN {_SQL_REPLY} END AS reply, CASE WHEN item_id % 9 <> 4 AND length(text) % 9 = 2 THEN 'no reply within 0.3 s' END AS error, item_id % 9 <> 4 AND length(text) % 9 = 2 AS late FROM benchmark",
)


class Warm:
    """A model that is slow until it has been called once, and says so."""

    def __init__(self) -> None:
        self.calls = 0

    def __call__(self, prompt: str) -> str:
        self.calls += 1
        return f"{'cold' if self.calls == 1 else 'warm'} {_stub(prompt)}"


def _too_large() -> models.Call:
    raise MemoryError("does not fit")


_add(
    "k8_warm_up",
    lambda s, d: models.called(table(s, d, "documents").select("doc_id", "text"), "text", f"warm {uuid.uuid4().hex}", [_too_large, Warm], warm_up="hello").select("doc_id", F.md5(F.col("reply").cast("binary")).alias("reply")),
    "SELECT doc_id, CASE WHEN trim(text) <> '' THEN md5('warm ' || string_split(text, '. ')[1]) END AS reply FROM documents",
)


def _picky(prompt: str) -> str:
    if len(prompt) % 4 == 1:
        raise ValueError("refused")
    return _stub(prompt)


_add(
    "k6_failure_isolation",
    lambda s, d: models.replies(_prompts(s, d), "prompt", [_picky], tries=2, base_wait=0.0).select("item_id", "reply", "error"),
    f"SELECT item_id, CASE WHEN length(text) % 4 <> 1 THEN {_SQL_REPLY} END AS reply, CASE WHEN item_id % 9 <> 4 AND length(text) % 4 = 1 THEN 'no reply: refused' END AS error FROM benchmark",
)


GAP = 0.002


def k2_sequential_pacing(spark: SparkSession, sf: str) -> DataFrame:
    """Calls one after the other in one lane, which starts one every GAP seconds: their replies, their task, and whether each was sent and late enough."""
    timed = lambda: lambda prompt: f"{time.monotonic()!r} {_stub(prompt)}"
    got = models.called(_prompts(spark, sf), "prompt", "clock", [timed], gap=GAP, lanes=1).withColumn("part", F.spark_partition_id())
    at, said = F.substring_index("reply", " ", 1).cast("double"), F.regexp_replace("reply", "^[^ ]* ", "")
    starts = Window.partitionBy("part").orderBy("at")
    rows = got.select("item_id", "part", at.alias("at"), said.alias("reply")).withColumn("since", F.col("at") - F.lag("at").over(starts))
    return rows.select("item_id", "reply", "part", F.col("at").isNotNull().alias("sent"), F.coalesce(F.col("since") > 0.875 * GAP, F.lit(True)).alias("paced"))


_add("k2_sequential_pacing", k2_sequential_pacing, f"SELECT item_id, {_SQL_REPLY} AS reply, 0 AS part, item_id % 9 <> 4 AS sent, true AS paced FROM benchmark")


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """A load test of a stand-in whose clock ticks a quarter of a second a look: latencies and walls are sure."""
    prompts = [r["text"] for r in table(spark, sf, "benchmark").orderBy("item_id").limit(12).collect()]  # as many as a round sends
    ticks = iter(range(1 << 20))
    return models.closed_loop(spark, _picky, prompts, concurrency=1, clock=lambda: next(ticks) / 4)


def k5_closed_loop(spark: SparkSession, sf: str) -> DataFrame:
    rounds = metrics.latency_rounds(requests(spark, sf).where("repetition > 0"))
    return rounds.select("repetition", "requests", "success", "fail", "success_rate", "throughput_rps", "wall_s", "p50", "p95")


_SQL_LOAD = "p AS (SELECT item_id, length(text) % 4 <> 1 AS ok FROM benchmark ORDER BY item_id LIMIT 12), n AS (SELECT count(*) AS n, count(*) FILTER (ok) AS s FROM p)"
_add(
    "k5_closed_loop",
    k5_closed_loop,
    f"""WITH {_SQL_LOAD} SELECT CAST(r AS INT) AS repetition, n AS requests, s AS success, n - s AS fail, round_even(s::DOUBLE / n, 4) AS success_rate, round_even(s / (n * 0.5::DOUBLE + 0.25), 4) AS throughput_rps,
    n * 0.5::DOUBLE + 0.25 AS wall_s, CASE WHEN s > 0 THEN 0.25::DOUBLE END AS p50, CASE WHEN s > 0 THEN 0.25::DOUBLE END AS p95 FROM n, (VALUES (1), (2), (3)) v(r)""",
)
_add(
    "i15_timeout_list",
    lambda s, d: models.timeouts(table(s, d, "events").select("event_id", (F.col("event_type") != "error").alias("ok"), F.col("value").alias("latency_s")), 120.0).select("event_id", "ok", F.round("over_s", 6).alias("over_s")),
    "SELECT event_id, event_type <> 'error' AS ok, round(value - 120, 6) AS over_s FROM events WHERE value > 120",
)


def k9_contract_run(spark: SparkSession, sf: str) -> DataFrame:
    """The whole run with a stand-in for the model: retrieval, answers, and what the contract says of each."""
    hits = best(spark, sf, 4)
    refs = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", F.lit("d").alias("doc"), F.col("unit").alias("article")))).alias("r"))  # four a question
    asked = models.replies(questions(spark, sf), "question", [_stub]).join(refs, "qid", "left")
    pairs = F.transform("r", lambda x: F.struct(x["doc"].alias("doc"), x["article"].cast("string").alias("article")))
    return asked.select(F.col("qid").alias("item_id"), F.size("r").alias("n_refs"), "reply", F.size(quality.contract_problems("reply", pairs, ["d"])).alias("problems"))


_add(
    "k9_contract_run",
    k9_contract_run,
    f"WITH {sql_bm25()}, {_TOP4}, n AS (SELECT item_id, count(*) AS n FROM r WHERE rank <= 4 GROUP BY item_id) SELECT item_id, CAST(n AS INT) AS n_refs, string_split(text, '. ')[1] AS reply, 0 AS problems FROM benchmark LEFT JOIN n USING (item_id)",
)
