"""Queries of overlap metrics, judge scores, totals and latencies.

A pair is a document (the answer) with a benchmark item (whose sentences are
the key facts): item = doc_id modulo the number of items. A source is a
candidate; labels give two judge axes and leave gaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.fixed import SUFFIXES
from ..operators import metrics
from .base import hangul, sql_grams, sql_hangul, sql_no_space, sql_stem, table
from .text_queries import _STOPS

QUERIES, ORACLES = {}, {}


def _add(name: str, query: object, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def answered(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The documents with the item that they answer, and the items' facts (item_id, facts)."""
    items = table(spark, sf, "benchmark")
    n = items.agg(F.count(F.lit(1)).alias("k"))
    docs = table(spark, sf, "documents").crossJoin(F.broadcast(n)).withColumn("item_id", F.col("doc_id") % F.col("k")).drop("k")
    return docs, items.select("item_id", F.split("text", r"\. ").alias("facts"))


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, source, answer, item_id, facts)."""
    docs, items = answered(spark, sf)
    return docs.join(items, "item_id").select("doc_id", "source", F.col("text").alias("answer"), "item_id", "facts")


SQL_PAIRS = "pr AS (SELECT d.doc_id, d.source, d.text AS answer, b.item_id, string_split(b.text, '. ') AS facts FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark))"
_ALL = "array_join(facts, ' ')"
_SQL_ALL = "array_to_string(facts, ' ')"
_SQL_SET = "list_distinct(list_filter(regexp_extract_all({x}, '[0-9A-Za-z가-힣]+'), lambda w: NOT regexp_full_match(w, '[0-9]+')))"


def set_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf).select("doc_id", T.set_tokens("answer").alias("a"), T.set_tokens(F.expr(_ALL)).alias("g"), F.transform("facts", lambda f: T.set_tokens(f)).alias("fs"))


_SQL_SETS = f"{SQL_PAIRS}, st AS (SELECT doc_id, source, answer, {_SQL_SET.format(x='answer')} AS a, {_SQL_SET.format(x=_SQL_ALL)} AS g, list_transform(facts, lambda f: {_SQL_SET.format(x='f')}) AS fs FROM pr)"
_SQL_F1 = "CASE WHEN len(list_intersect(a, g)) > 0 THEN 2.0::DOUBLE * len(list_intersect(a, g)) / (len(a) + len(g)) ELSE 0 END"
_add(
    "h5_set_f1",
    lambda s, d: set_pairs(s, d).select("doc_id", F.round(metrics.set_f1(F.col("a"), F.col("g")), 6).alias("f1")),
    f"WITH {_SQL_SETS} SELECT doc_id, round({_SQL_F1}, 6) AS f1 FROM st",
)


def _prf(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "overlap", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def _sql_prf(ta: str, tg: str, facts: str = "facts", rows: str = "pr") -> str:
    """Counts by histograms: of an answer per document, of the facts once per item."""
    return f"""hg AS (SELECT item_id, histogram(t) AS mg, count(*) AS ng FROM (SELECT item_id, unnest({tg}) AS t FROM (SELECT DISTINCT item_id, {facts} FROM {rows})) GROUP BY item_id),
    ha AS (SELECT doc_id, any_value(item_id) AS item_id, histogram(t) AS ma, count(*) AS na FROM (SELECT doc_id, item_id, unnest({ta}) AS t FROM {rows}) GROUP BY doc_id),
    bo AS (SELECT pr.doc_id, coalesce(na, 0) AS na, coalesce(ng, 0) AS ng, coalesce(list_sum(list_transform(map_entries(mg), lambda e: least(e.value, coalesce(ma[e.key], 0)))), 0)::BIGINT AS overlap FROM {rows} AS pr LEFT JOIN ha USING (doc_id) LEFT JOIN hg ON hg.item_id = pr.item_id),
    pf AS (SELECT doc_id, overlap, CASE WHEN na > 0 AND ng > 0 THEN overlap::DOUBLE / na ELSE 0 END AS p, CASE WHEN na > 0 AND ng > 0 THEN overlap::DOUBLE / ng ELSE 0 END AS r FROM bo)"""


_OUT_PRF = 'SELECT doc_id, overlap, round(p, 6) AS "precision", round(r, 6) AS recall, round(CASE WHEN overlap > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM pf'


def sql_content(x: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({sql_hangul(x)}, '[0-9]+|[A-Za-z]+|[가-힣]+'), lambda w: lower({sql_stem('w', SUFFIXES)})), lambda w: length(w) >= 2 AND w NOT IN ({_STOPS}))"


def content_prf(spark: SparkSession, sf: str) -> DataFrame:
    rows = pairs(spark, sf).select("doc_id", T.content_tokens(hangul("answer")).alias("ta"), T.content_tokens(hangul(F.expr(_ALL))).alias("tg"))
    return metrics.multiset_prf(rows, "doc_id", "ta", "tg")


_SQL_CONTENT = f"{SQL_PAIRS}, {_sql_prf(sql_content('answer'), sql_content(_SQL_ALL))}"
_add("h6_multiset_f1", lambda s, d: _prf(content_prf(s, d)), f"WITH {_SQL_CONTENT} {_OUT_PRF}")


def h7_bigram_f1(spark: SparkSession, sf: str) -> DataFrame:
    rows = pairs(spark, sf).select("doc_id", T.char_bigrams("answer").alias("ta"), T.char_bigrams(F.expr(_ALL)).alias("tg"))
    return _prf(metrics.multiset_prf(rows, "doc_id", "ta", "tg"))


_BARE = f"bare AS (SELECT doc_id, item_id, {sql_no_space('answer')} AS xa, {sql_no_space(_SQL_ALL)} AS xg FROM pr)"
_SQL_H7 = _sql_prf("CASE WHEN length(xa) > 1 THEN list_transform(list_zip(regexp_extract_all(xa, '(?s).')[:-2], regexp_extract_all(xa, '(?s).')[2:]), lambda z: z[1] || z[2]) ELSE [] END", "CASE WHEN length(xg) > 1 THEN list_transform(list_zip(regexp_extract_all(xg, '(?s).')[:-2], regexp_extract_all(xg, '(?s).')[2:]), lambda z: z[1] || z[2]) ELSE [] END", "xg", "bare")
_add("h7_bigram_f1", h7_bigram_f1, f"WITH {SQL_PAIRS}, {_BARE}, {_SQL_H7} {_OUT_PRF}")
_add(
    "h8_fact_recall",
    lambda s, d: set_pairs(s, d).select("doc_id", *[F.round(metrics.fact_recall(F.col("a"), F.col("fs"), t), 6).alias(n) for n, t in (("recall_50", 0.5), ("recall_70", 0.7))]),
    f"WITH {_SQL_SETS} SELECT doc_id, "
    + ", ".join(f"round(len(list_filter(fs, lambda f: len(f) > 0 AND len(list_intersect(f, a))::DOUBLE / len(f) >= {t}::DOUBLE))::DOUBLE / len(fs), 6) AS {n}" for n, t in (("recall_50", 0.5), ("recall_70", 0.7)))
    + " FROM st",
)


def marked(spark: SparkSession, sf: str, **marks: object) -> DataFrame:
    """The documents with a mark per fact."""
    docs, items = answered(spark, sf)
    return metrics.fact_marks(docs, items, "item_id", "text", "facts", **marks)


def _per_fact(df: DataFrame, mark: str, name: str) -> DataFrame:
    rows = df.select("doc_id", F.posexplode_outer(mark).alias("fact_no", name))
    return rows.where("fact_no IS NOT NULL")


_SQL_FACTS = f"{SQL_PAIRS}, fa AS (SELECT doc_id, answer, unnest(facts) AS fact, unnest(range(0, len(facts)))::INT AS fact_no FROM pr)"


def _sql_window(fact: str, text: str, n: int) -> str:
    return f"len(list_filter({sql_grams(fact, n)}, lambda y: contains({text}, y))) > 0"


_add(
    "h9_hard_covered",
    lambda s, d: _per_fact(marked(s, d, hard=8), "hard", "covered"),
    f"WITH {_SQL_FACTS}, w AS (SELECT doc_id, fact_no, {sql_no_space('fact')} AS f, {sql_no_space('answer')} AS a FROM fa) SELECT doc_id, fact_no, {_sql_window('f', 'a', 8)} AS covered FROM w",
)
_add(
    "h10_soft_recall",
    lambda s, d: _per_fact(marked(s, d, soft=3), "soft", "recall").withColumn("recall", F.round("recall", 6)),
    f"""WITH {_SQL_FACTS}, w AS (SELECT doc_id, fact_no, {sql_no_space('fact')} AS f, {sql_no_space('answer')} AS a FROM fa), gr AS (SELECT doc_id, fact_no, list_distinct({sql_grams('f', 3)}) AS gf, list_distinct({sql_grams('a', 3)}) AS ga FROM w)
    SELECT doc_id, fact_no, round(CASE WHEN len(gf) > 0 THEN len(list_intersect(gf, ga))::DOUBLE / len(gf) ELSE 0 END, 6) AS recall FROM gr""",
)
_add(
    "h11_fact_found",
    lambda s, d: _per_fact(marked(s, d, hard=12, form=T.one_space), "hard", "found"),
    f"WITH {_SQL_FACTS}, w AS (SELECT doc_id, fact_no, trim(regexp_replace(fact, '{T.WS}+', ' ', 'g')) AS f, trim(regexp_replace(answer, '{T.WS}+', ' ', 'g')) AS a FROM fa) SELECT doc_id, fact_no, {_sql_window('f', 'a', 12)} AS found FROM w",
)

# ---------------------------------------------------------------- judge and totals


def axes(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, accuracy, grounding, completeness, clarity) of labelled documents; out of range now and then."""
    one = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    return one.select("doc_id", (F.col("q") * 10).alias("accuracy"), (10 - 8 * F.col("t")).alias("grounding"), (F.col("doc_id") % 13).alias("completeness"), (7 + F.col("q")).alias("clarity"))


_SQL_AXES = "ax AS (SELECT doc_id, max(quality) * 10 AS accuracy, 10 - 8 * max(toxic) AS grounding, doc_id % 13 AS completeness, 7 + max(quality) AS clarity FROM labels GROUP BY doc_id)"
_SQL_JUDGE = "(10 * (0.40::DOUBLE * greatest(0, least(10, accuracy)) + 0.25::DOUBLE * greatest(0, least(10, grounding)) + 0.20::DOUBLE * greatest(0, least(10, completeness)) + 0.15::DOUBLE * greatest(0, least(10, clarity))))"
_NAMES = {k: k for k in ("accuracy", "grounding", "completeness", "clarity")}
_add("h12_judge_total", lambda s, d: axes(s, d).select("doc_id", F.round(metrics.judge_score(_NAMES), 6).alias("judge")), f"WITH {_SQL_AXES} SELECT doc_id, round({_SQL_JUDGE}, 6) AS judge FROM ax")
_REPLY = "concat('```json\n{\"accuracy\": ', accuracy + 0.5, ', \"grounding\": ', grounding, ', \"completeness\": ', completeness, CASE WHEN doc_id % 7 = 0 THEN '' ELSE ', \"clarity\": {\"score\": 6.5}' END, '}\n```')"


def h13_axis_parsing(spark: SparkSession, sf: str) -> DataFrame:
    rows = axes(spark, sf).withColumn("reply", F.expr(_REPLY))
    plain = F.expr(_REPLY.replace('{\"score\": 6.5}', "6"))
    loose, strict = metrics.parsed_axes("reply", strict=False), metrics.parsed_axes(plain)
    return rows.select("doc_id", loose["accuracy"].alias("accuracy"), loose["completeness"].alias("completeness"), loose["clarity"].alias("clarity"), strict["completeness"].alias("strict_completeness"))


_add(
    "h13_axis_parsing",
    h13_axis_parsing,
    f"""WITH {_SQL_AXES} SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN least(10, greatest(0, round_even(accuracy + 0.5::DOUBLE, 0))) END::DOUBLE AS accuracy, CASE WHEN doc_id % 7 <> 0 THEN least(10, completeness) END::DOUBLE AS completeness,
    CASE WHEN doc_id % 7 <> 0 THEN 6.0 END::DOUBLE AS clarity, CASE WHEN doc_id % 7 <> 0 AND accuracy + 0.5 <= 10 AND completeness <= 10 THEN completeness END::DOUBLE AS strict_completeness FROM ax""",
)


def candidate_rows(spark: SparkSession, sf: str) -> DataFrame:
    """(blind_id, qid, rr, f1, judge, has_refs) per document; every eleventh answer is missing and counts 0."""
    docs = table(spark, sf, "documents").select(F.col("source").alias("blind_id"), F.col("doc_id").alias("qid"))
    f1 = set_pairs(spark, sf).select(F.col("doc_id").alias("qid"), metrics.set_f1(F.col("a"), F.col("g")).alias("f1"))
    judged = axes(spark, sf).select(F.col("doc_id").alias("qid"), metrics.judge_score(_NAMES).alias("judge"))
    rows = docs.join(f1, "qid", "left").join(judged, "qid", "left")
    gone = F.col("qid") % 11 == 0
    zero = F.lit(0.0)
    rr = F.when(F.col("qid") % 5 == 0, zero).otherwise(1.0 / (1 + F.col("qid") % 4))
    return rows.select("blind_id", "qid", F.when(gone, zero).otherwise(rr).alias("rr"), F.when(gone, zero).otherwise(F.col("f1")).alias("f1"), F.when(gone, zero).otherwise(F.col("judge")).alias("judge"), (F.col("blind_id") != "src3").alias("has_refs"))


_SQL_ROWS = f"""{_SQL_SETS}, {_SQL_AXES}, cr AS (
    SELECT st.source AS blind_id, st.doc_id AS qid, st.source <> 'src3' AS has_refs, CASE WHEN st.doc_id % 11 = 0 OR st.doc_id % 5 = 0 THEN 0 ELSE 1.0::DOUBLE / (1 + st.doc_id % 4) END AS rr,
      CASE WHEN st.doc_id % 11 = 0 THEN 0 ELSE {_SQL_F1} END AS f1, CASE WHEN st.doc_id % 11 = 0 THEN 0 WHEN ax.doc_id IS NOT NULL THEN {_SQL_JUDGE} END AS judge
    FROM st LEFT JOIN ax USING (doc_id))"""
_STATUS = "CASE WHEN count(judge) = 0 THEN 'failed' WHEN count(judge) < count(*) THEN 'partial' ELSE 'completed' END AS status"
_add(
    "h14_candidate_total",
    lambda s, d: metrics.candidate_totals(candidate_rows(s, d)).select("blind_id", "n", F.round("total", 6).alias("total")),
    f"WITH {_SQL_ROWS} SELECT blind_id, count(*) AS n, round(greatest(0, least(100, 20 * avg(rr) + 30 * avg(f1) + 50 * avg(judge) / 100)), 6) AS total FROM cr GROUP BY blind_id",
)
_add(
    "h15_renormalised_total",
    lambda s, d: metrics.candidate_totals(candidate_rows(s, d), style="renormalised").select("blind_id", F.round("total", 6).alias("total")),
    f"WITH {_SQL_ROWS} SELECT blind_id, round((30 * 100 * avg(f1) FILTER (judge IS NOT NULL) + 50 * avg(judge)) / 80, 6) AS total FROM cr GROUP BY blind_id",
)
_add(
    "h16_status",
    lambda s, d: metrics.candidate_totals(candidate_rows(s, d).withColumn("judge", F.when(F.col("blind_id") != "src5", F.col("judge")))).select("blind_id", "status"),
    f"WITH {_SQL_ROWS}, c2 AS (SELECT blind_id, CASE WHEN blind_id <> 'src5' THEN judge END AS judge FROM cr) SELECT blind_id, {_STATUS} FROM c2 GROUP BY blind_id",
)
_add(
    "h17_missing_answers",
    lambda s, d: candidate_rows(s, d).select("blind_id", "qid", *[F.round(c, 6).alias(c) for c in ("rr", "f1", "judge")]),
    f"WITH {_SQL_ROWS} SELECT blind_id, qid, round(rr, 6) AS rr, round(f1, 6) AS f1, round(judge, 6) AS judge FROM cr",
)


def scored_answers(spark: SparkSession, sf: str) -> DataFrame:
    docs = pairs(spark, sf).select("doc_id", "source", F.char_length("answer").alias("chars"))
    rows = docs.join(content_prf(spark, sf), "doc_id")
    return rows.withColumn("rr", F.element_at(F.array(*map(F.lit, (0.0, 1.0, 0.5, 1.0 / 3, 0.25))), (F.col("doc_id") % 5).cast("int") + 1))


_SQL_SCORED = f"{_SQL_CONTENT}, sa AS (SELECT pf.doc_id, pr.source, length(pr.answer) AS chars, p, r, CASE WHEN overlap > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1, [0.0, 1.0, 0.5, 1.0::DOUBLE / 3, 0.25][pf.doc_id % 5 + 1]::DOUBLE AS rr FROM pf JOIN pr USING (doc_id))"
_MEANS = 'round(avg(f1), 6) AS f1, round(avg(p), 6) AS "precision", round(avg(r), 6) AS recall, round(avg(rr), 6) AS rr, round(avg(chars), 6) AS chars'


def h18_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.leaderboard(scored_answers(spark, sf), "source")
    return out.select("source", *[F.round(c, 6).alias(c) for c in ("f1", "precision", "recall", "rr", "chars", "score")])


_add("h18_leaderboard", h18_leaderboard, f"WITH {_SQL_SCORED} SELECT source, {_MEANS}, round(20 * avg(rr) + 30 * avg(f1), 6) AS score FROM sa GROUP BY source")


def h19_variant_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """Means per variant and, pivoted, per question type, in one pass over the marks."""
    per = marked(spark, sf, soft=3, hard=8).select("source", "lang", metrics.array_mean("soft").alias("soft"), metrics.array_mean(F.transform("hard", lambda x: x.cast("int"))).alias("hard"))
    typed = [F.round(F.avg(F.when(F.col("lang") == x, F.col("soft"))), 6).alias(x) for x in ("de", "en", "es", "fr")]
    return per.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("soft"), 6).alias("soft"), F.round(F.avg("hard"), 6).alias("hard"), *typed)


_add(
    "h19_variant_pivot",
    h19_variant_pivot,
    f"""WITH {_SQL_FACTS}, w AS (SELECT doc_id, fact_no, {sql_no_space('fact')} AS f, {sql_no_space('answer')} AS a FROM fa), gr AS (SELECT *, list_distinct({sql_grams('f', 3)}) AS gf, list_distinct({sql_grams('a', 3)}) AS ga FROM w),
    so AS (SELECT doc_id, avg(CASE WHEN len(gf) > 0 THEN len(list_intersect(gf, ga))::DOUBLE / len(gf) ELSE 0 END) AS soft, avg(({_sql_window('f', 'a', 8)})::INT::DOUBLE) AS hard FROM gr GROUP BY doc_id)
    SELECT source, count(*) AS n, round(avg(soft), 6) AS soft, round(avg(hard), 6) AS hard, {', '.join(f"round(avg(soft) FILTER (lang = '{x}'), 6) AS {x}" for x in ('de', 'en', 'es', 'fr'))} FROM so JOIN documents USING (doc_id) GROUP BY source""",
)


def h20_agreement(spark: SparkSession, sf: str) -> DataFrame:
    totals = metrics.candidate_totals(candidate_rows(spark, sf)).select(F.round("total", 6).alias("a"), F.round(F.col("mrr") * 100, 6).alias("b"))
    return metrics.agreement(totals, "a", "b").select("n", *[F.round(c, 6).alias(c) for c in ("mae", "max_err", "spearman")])


_add(
    "h20_agreement",
    h20_agreement,
    f"""WITH {_SQL_ROWS}, t AS (SELECT round(greatest(0, least(100, 20 * avg(rr) + 30 * avg(f1) + 50 * avg(judge) / 100)), 6) AS a, round(100 * avg(rr), 6) AS b FROM cr GROUP BY blind_id),
    k AS (SELECT a, b, rank() OVER (ORDER BY a DESC) AS ra, rank() OVER (ORDER BY b DESC) AS rb FROM t)
    SELECT count(*) AS n, round(avg(abs(a - b)), 6) AS mae, round(max(abs(a - b)), 6) AS max_err, round(1 - 6.0::DOUBLE * sum((ra - rb) * (ra - rb)) / (count(*) * (count(*) * count(*) - 1)), 6) AS spearman FROM k""",
)


def h21_diagnose(spark: SparkSession, sf: str) -> DataFrame:
    """Words that are missing and words that are too many, of all pairs."""
    rows = set_pairs(spark, sf)
    missing, extra = F.array_sort(F.array_except("g", "a")), F.array_sort(F.array_except("a", "g"))
    return rows.select("doc_id", F.array_join(missing, " ").alias("missing"), F.size(extra).alias("n_extra"), F.md5(F.array_join(extra, " ").cast("binary")).alias("extra"))


_add(
    "h21_diagnose",
    h21_diagnose,
    f"""WITH {_SQL_SETS}, x AS (SELECT doc_id, list_sort(list_filter(g, lambda w: NOT list_contains(a, w))) AS mi, list_sort(list_filter(a, lambda w: NOT list_contains(g, w))) AS ex FROM st)
    SELECT doc_id, coalesce(array_to_string(mi, ' '), '') AS missing, CAST(len(ex) AS INT) AS n_extra, md5(coalesce(array_to_string(ex, ' '), '')) AS extra FROM x""",
)


def h30_objective_points(spark: SparkSession, sf: str) -> DataFrame:
    out = candidate_rows(spark, sf).groupBy("blind_id").agg(F.avg("rr").alias("m"), F.avg(F.bround("f1", 4)).alias("f"))
    return out.select("blind_id", F.round(20 * F.col("m"), 3).alias("mrr_points"), F.round(30 * F.col("f"), 3).alias("keyfact_points"), F.round(20 * F.col("m") + 30 * F.col("f"), 3).alias("objective_points"))


_add("h30_objective_points", h30_objective_points, f"WITH {_SQL_ROWS} SELECT blind_id, round(20 * avg(rr), 3) AS mrr_points, round(30 * avg(round_even(f1, 4)), 3) AS keyfact_points, round(20 * avg(rr) + 30 * avg(round_even(f1, 4)), 3) AS objective_points FROM cr GROUP BY blind_id")


def h31_answer_report(spark: SparkSession, sf: str) -> DataFrame:
    """Hard and soft recall of answered questions only; labelled documents stand for them."""
    docs, items = answered(spark, sf)
    docs = docs.join(table(spark, sf, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    got = metrics.fact_marks(docs, items, "item_id", "text", "facts", soft=3, hard=8)
    per = got.select("doc_id", metrics.array_mean(F.transform("hard", lambda x: x.cast("int"))).alias("hard"), metrics.array_mean("soft").alias("soft"), F.char_length("text").alias("chars"))
    return per.select("doc_id", F.round("hard", 6).alias("hard"), F.round("soft", 6).alias("soft"), "chars")


_add(
    "h31_answer_report",
    h31_answer_report,
    f"""WITH {_SQL_FACTS}, w AS (SELECT doc_id, length(answer) AS chars, {sql_no_space('fact')} AS f, {sql_no_space('answer')} AS a FROM fa WHERE doc_id IN (SELECT doc_id FROM labels)), gr AS (SELECT *, list_distinct({sql_grams('f', 3)}) AS gf, list_distinct({sql_grams('a', 3)}) AS ga FROM w)
    SELECT doc_id, round(avg(({_sql_window('f', 'a', 8)})::INT::DOUBLE), 6) AS hard, round(avg(CASE WHEN len(gf) > 0 THEN len(list_intersect(gf, ga))::DOUBLE / len(gf) ELSE 0 END), 6) AS soft, CAST(max(chars) AS INT) AS chars FROM gr GROUP BY doc_id""",
)
_add(
    "h32_official_report",
    lambda s, d: scored_answers(s, d).select("doc_id", *[F.round(c, 6).alias(c) for c in ("rr", "f1", "precision", "recall")], "chars"),
    f'WITH {_SQL_SCORED} SELECT doc_id, round(rr, 6) AS rr, round(f1, 6) AS f1, round(p, 6) AS "precision", round(r, 6) AS recall, CAST(chars AS INT) AS chars FROM sa',
)

# ---------------------------------------------------------------- latencies


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """events as a latency log: three rounds by user, errors are failures, a round lasts its latencies' sum."""
    rows = table(spark, sf, "events").select((F.col("user_id") % 3 + 1).alias("repetition"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("latency_s"))
    walls = rows.groupBy("repetition").agg(F.round(F.sum("latency_s"), 3).alias("wall_s"))
    return rows.join(walls, "repetition")


_SQL_REQ = """rq AS (SELECT user_id % 3 + 1 AS repetition, event_type <> 'error' AS ok, value AS l FROM events),
    rd AS (SELECT repetition, count(*) AS requests, count(*) FILTER (ok) AS success, round(sum(l), 3) AS w, list_sort(list(l) FILTER (ok AND l IS NOT NULL)) AS ls FROM rq GROUP BY repetition),
    pe AS (SELECT repetition, requests, success, requests - success AS fail, round_even(success::DOUBLE / requests, 4) AS success_rate, CASE WHEN w > 0 THEN round_even(success::DOUBLE / w, 4) ELSE 0 END AS throughput_rps, round_even(w, 4) AS wall_s,
      round_even(ls[CAST(floor((len(ls) - 1) * 0.5) AS BIGINT) + 1], 4) AS p50, round_even(ls[CAST(floor((len(ls) - 1) * 0.95) AS BIGINT) + 1], 4) AS p95 FROM rd)"""
_PERF = ("success_rate", "throughput_rps", "wall_s", "p50", "p95")
_add(
    "h24_percentile",
    lambda s, d: metrics.exact_percentiles(table(s, d, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95}),
    "WITH g AS (SELECT event_type, list_sort(list(value) FILTER (value IS NOT NULL)) AS ls FROM events GROUP BY event_type) SELECT event_type, round_even(ls[CAST(floor((len(ls) - 1) * 0.5) AS BIGINT) + 1], 4) AS p50, round_even(ls[CAST(floor((len(ls) - 1) * 0.95) AS BIGINT) + 1], 4) AS p95 FROM g",
)
_add("h25_median", lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.round(F.median("value"), 6).alias("median")), "SELECT event_type, round(median(value), 6) AS median FROM events GROUP BY event_type")
_add("h26_perf_round", lambda s, d: metrics.latency_rounds(requests(s, d)), f"WITH {_SQL_REQ} SELECT * FROM pe")
_add(
    "h27_perf_summary",
    lambda s, d: metrics.latency_summary(metrics.latency_rounds(requests(s, d))),
    f"WITH {_SQL_REQ} SELECT CAST(median(success) AS BIGINT) AS success, CAST(median(fail) AS BIGINT) AS fail, {', '.join(f'round_even(median({c}), 4) AS {c}' for c in _PERF)} FROM pe",
)


def h28_cost(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "benchmark").agg(F.count(F.lit(1)).alias("n"), F.avg(F.char_length("text")).alias("chars"))
    c = table(spark, sf, "documents").agg(F.countDistinct("source").alias("candidates"))
    calls = F.col("n") * F.col("candidates")
    usd = metrics.cost(calls, F.col("chars"))
    return q.crossJoin(c).select(calls.alias("calls"), F.round(usd, 6).alias("usd"), F.round(usd * 1430, 4).alias("krw"))


_SQL_USD = "n * k * ((ch / 1.7::DOUBLE + 4000 / 1.7::DOUBLE * 0.4::DOUBLE) * 1.5::DOUBLE + 300 * 9.0::DOUBLE) / 1e6"
_add(
    "h28_cost",
    h28_cost,
    f"WITH q AS (SELECT count(*) AS n, avg(length(text)) AS ch FROM benchmark), c AS (SELECT count(DISTINCT source) AS k FROM documents) SELECT n * k AS calls, round({_SQL_USD}, 6) AS usd, round({_SQL_USD} * 1430, 4) AS krw FROM q, c",
)
_add(
    "h29_usage",
    lambda s, d: table(s, d, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.char_length("text")).alias("tokens")),
    "SELECT role, count(*) AS calls, CAST(sum(length(text)) AS BIGINT) AS tokens FROM conversations GROUP BY role",
)


def h34_fit_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = set_pairs(spark, sf).join(pairs(spark, sf).select("doc_id", "item_id"), "doc_id")
    got = rows.select("item_id", F.bround(metrics.set_f1(F.col("a"), F.col("g")), 4).alias("fit"), ((F.col("doc_id") % 100) / 100).alias("observed"))
    return got.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("fit") - F.col("observed"))), 6).alias("mae"))


_add("h34_fit_report", h34_fit_report, f"WITH {_SQL_SETS} SELECT pr.item_id, count(*) AS n, round(avg(abs(round_even({_SQL_F1}, 4) - (doc_id % 100) / 100.0::DOUBLE)), 6) AS mae FROM st JOIN pr USING (doc_id) GROUP BY pr.item_id")
