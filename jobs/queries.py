"""The jobs as queries: each runs twice into one new folder and returns what is there then."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrade.plans.base import sql_words
from lexigrade.sources.shared import shared_path

from . import score_candidates, update_index
from .common import config_of


def job1_update_index(spark: SparkSession, sf: str) -> DataFrame:
    """Every entry of an index of all documents; the second run finds nothing new."""
    root = shared_path(spark, "job1")  # below: file streams take a folder or a pattern, and the table may be one file
    for _ in range(2):
        update_index.run(spark, f"{sf}/documents.parque[t]", f"{root}/index", f"{root}/state")
    blocks = update_index.segments_of(spark, f"{root}/index", config_of("update_index")).postings()
    return blocks.select("term", F.inline("entries")).select("term", F.col("unit").alias("doc_id"), "tf", "dl")


JOB1_SQL = f"""
WITH d AS (SELECT doc_id, {sql_words("coalesce(text, '')")} AS ts FROM documents)
SELECT t AS term, doc_id, CAST(count(*) AS INT) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, CAST(len(ts) AS INT) AS dl, unnest(ts) AS t FROM d) GROUP BY doc_id, t
"""


def job2_score_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Every answer with its scores and its candidate's total; the second run replaces what the first one wrote."""
    root = shared_path(spark, "job2")
    for _ in range(2):
        answers, totals = score_candidates.run(spark, *(f"{sf}/{t}.parquet" for t in ("documents", "benchmark", "labels")), root)
    rows = answers.join(totals.drop("judge", "covered").withColumnRenamed("candidate", "of"), F.col("candidate").eqNullSafe(F.col("of")))
    return rows.select("candidate", "question", "item", "chars", "n_facts", "covered", "shared", "missing", *[F.round(c, 6).alias(c) for c in ("f1", "judge", "facts", "keyfact", "total")], "status", "place", "passed")


_SET = "list_distinct(list_filter(regexp_extract_all({}, '[0-9A-Za-z가-힣]+'), lambda w: NOT regexp_full_match(w, '[0-9]+')))"
_AXES = "0.40::DOUBLE * 10 * max(quality) + 0.25::DOUBLE * max(10 - 8 * toxic) + 0.20::DOUBLE * max(3 + 5 * quality) + 0.15::DOUBLE * max(7 + quality - 2 * toxic)"
JOB2_SQL = f"""
WITH i AS (SELECT item_id, string_split(text, '. ') AS fs FROM benchmark),
g AS (SELECT item_id, list_transform(fs, lambda f: {_SET.format('f')}) AS facts, {_SET.format("array_to_string(fs, ' ')")} AS wanted FROM i),
j AS (SELECT doc_id, 10 * ({_AXES}) AS judge FROM labels GROUP BY doc_id),
a AS (
  SELECT d.source AS candidate, d.doc_id AS question, g.item_id AS item, CAST(length(d.text) AS INT) AS chars, facts, wanted, {_SET.format('d.text')} AS toks, judge
  FROM documents d JOIN g ON g.item_id = d.doc_id % (SELECT count(*) FROM benchmark) LEFT JOIN j USING (doc_id)
), s AS (
  SELECT candidate, question, item, chars, judge, len(facts) AS n_facts, len(list_intersect(toks, wanted)) AS shared, len(wanted) AS nw, len(toks) AS nt,
    len(list_filter(facts, lambda f: len(f) > 0 AND len(list_intersect(f, toks))::DOUBLE / len(f) >= 0.7::DOUBLE)) AS covered FROM a
), f AS (SELECT *, CASE WHEN shared > 0 THEN 2.0::DOUBLE * shared / (nw + nt) ELSE 0 END AS f1 FROM s),
c AS (
  SELECT candidate, avg(n_facts) AS facts, avg(f1) FILTER (judge IS NOT NULL) AS keyfact, (30 * 100 * avg(f1) FILTER (judge IS NOT NULL) + 50 * avg(judge)) / 80 AS total,
    CASE WHEN count(judge) = 0 THEN 'failed' WHEN count(judge) < count(*) THEN 'partial' ELSE 'completed' END AS status FROM f GROUP BY candidate
), r AS (SELECT *, CAST(row_number() OVER (ORDER BY round(total, 9) DESC NULLS LAST, candidate) AS INT) AS place, coalesce(total >= 30, false) AS passed FROM c)
SELECT f.candidate, question, item, chars, CAST(n_facts AS INT) AS n_facts, CAST(covered AS INT) AS covered, CAST(shared AS INT) AS shared, CAST(nw - shared AS INT) AS missing,
  round(f1, 6) AS f1, round(judge, 6) AS judge, round(facts, 6) AS facts, round(keyfact, 6) AS keyfact, round(total, 6) AS total, status, place, passed
FROM f JOIN r ON f.candidate IS NOT DISTINCT FROM r.candidate
"""

QUERIES = {"job1_update_index": job1_update_index, "job2_score_candidates": job2_score_candidates}
ORACLES = {"job1_update_index": JOB1_SQL, "job2_score_candidates": JOB2_SQL}
