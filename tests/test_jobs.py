"""The two jobs: their queries against SQL, growing input, reruns, failures and command lines."""

import json
import logging
import shutil

import pytest
from compare import check
from pyspark.sql import functions as F

from jobs import common, queries, score_candidates, update_index
from lexigrade.operators import index, retrieval

DOCS = "doc_id long, text string, source string"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_match_sql(spark, sf, name):
    before = dict(spark.conf.getAll)
    check(queries.QUERIES[name](spark, sf), queries.ORACLES[name], sf)
    assert before == dict(spark.conf.getAll)


def test_jobs_need_no_llm():
    for module in (common, queries, score_candidates, update_index):
        text = open(module.__file__, encoding="utf-8").read()
        assert "llm" not in text and "corpus_pipeline" not in text


# ---------------------------------------------------------------- 1


@pytest.fixture
def growing(spark, sf, tmp_path):
    """A folder of documents, and what puts more of them there."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    folder = tmp_path / "documents"
    folder.mkdir()

    def grow(where, name):
        docs.where(where).coalesce(1).write.parquet(str(tmp_path / name))
        for part in (tmp_path / name).glob("part-*"):
            shutil.copy(part, folder / f"{name}.parquet")

    return str(folder), grow, docs, tmp_path


def rows_of(found):
    return sorted(map(tuple, found.postings().select("term", F.inline("entries")).select("term", "unit", "tf", "dl").collect()))


def test_growing_index(spark, growing, caplog):
    source, grow, docs, tmp = growing
    out, state, settings = str(tmp / "index"), str(tmp / "state"), common.config_of("update_index")
    grow("doc_id < 100", "a")
    with caplog.at_level(logging.INFO, "jobs"):
        assert [tuple(r)[:2] for r in update_index.run(spark, source, out, state).collect()] == [(0, docs.where("doc_id < 100").count())]
    assert "read" in caplog.text and "segments" in caplog.text
    once = update_index.segments_of(spark, out, settings)
    before = rows_of(once)
    update_index.run(spark, source, out, state)
    assert rows_of(once) == before
    # A file with documents that are there already, and new ones.
    grow("doc_id >= 90", "b")
    now = {r.segment: r.units for r in update_index.run(spark, source, out, state).collect()}
    assert now == {0: docs.where("doc_id < 100").count(), 1: docs.where("doc_id >= 100").count()}
    whole = str(tmp / "whole")
    update_index.segments_of(spark, whole, settings).add(index.tokenised(docs, "doc_id", "text"), 0)
    built = update_index.segments_of(spark, whole, settings)
    assert rows_of(built) == rows_of(update_index.segments_of(spark, out, settings))
    # Searching both gives the same as scoring the documents.
    questions = docs.where("doc_id % 40 = 0").select(F.col("doc_id").alias("qid"), F.substring("text", 1, 60).alias("question"))
    want = retrieval.ranked(retrieval.bm25(index.tokenised(docs, "doc_id", "text"), retrieval.question_terms(questions, "qid", "question")), k=4)
    want = sorted((r.qid, r.rank, r.unit, round(r.score, 9)) for r in want.collect())
    for path in (out, whole):
        assert sorted((r.qid, r.rank, r.unit, round(r.score, 9)) for r in update_index.search(spark, path, questions).collect()) == want
    plan = update_index.search(spark, out, questions)._jdf.queryExecution().executedPlan().toString()
    assert "documents" not in plan


def test_repeated_batch_replaces_its_segment(spark, growing):
    """A batch that is run again, as after a failure before the checkpoint took note of it."""
    source, grow, docs, tmp = growing
    grow("doc_id < 50", "a")
    out, settings = str(tmp / "index"), common.config_of("update_index")
    update_index.run(spark, source, out, str(tmp / "state"))
    before = rows_of(update_index.segments_of(spark, out, settings))
    update_index.run(spark, source, out, str(tmp / "lost_state"))
    assert rows_of(update_index.segments_of(spark, out, settings)) == before


def test_odd_documents(spark, tmp_path):
    rows = [(1, None, "a"), (2, "", "a"), (3, "b a", "a"), (3, "a a", "a"), (None, "x", "a")]
    spark.createDataFrame(rows, DOCS).coalesce(1).write.parquet(str(tmp_path / "d"))
    got = {r.segment: (r.units, r.length) for r in update_index.run(spark, str(tmp_path / "d"), str(tmp_path / "i"), str(tmp_path / "s")).collect()}
    assert got == {0: (3, 2)}
    assert rows_of(update_index.segments_of(spark, str(tmp_path / "i"), common.config_of("update_index"))) == [("a", 3, 2, 2)]
    none = spark.createDataFrame([(1, "")], "qid long, question string")
    assert update_index.search(spark, str(tmp_path / "i"), none).collect() == []


# ---------------------------------------------------------------- 2


def test_rerun_and_single_candidates(spark, sf, tmp_path, caplog):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    paths = f"{sf}/benchmark.parquet", f"{sf}/labels.parquet", str(tmp_path / "out")
    names = sorted(r.source for r in docs.select("source").distinct().collect())
    docs.where(F.col("source") != names[0]).write.parquet(str(tmp_path / "first"))
    docs.where(F.col("source") == names[0]).write.parquet(str(tmp_path / "second"))
    with caplog.at_level(logging.INFO, "jobs"):
        score_candidates.run(spark, str(tmp_path / "first"), *paths)
    assert "read" in caplog.text and "candidates" in caplog.text
    read = lambda p: sorted(map(str, spark.read.schema(score_candidates.ANSWERS if p.endswith("answers") else score_candidates.TOTALS).parquet(p).collect()))
    files = lambda: sorted(p.name for p in (tmp_path / "out" / "answers" / f"candidate={names[1]}").glob("part-*"))
    held = files()
    score_candidates.run(spark, str(tmp_path / "second"), *paths)
    assert files() == held
    once = [read(f"{paths[2]}/{t}") for t in ("answers", "totals")]
    score_candidates.run(spark, f"{sf}/documents.parquet", *paths)
    assert [read(f"{paths[2]}/{t}") for t in ("answers", "totals")] == once


def test_scores_of_a_small_set(spark, tmp_path):
    spark.createDataFrame([(1, "red fox and blue bird", "x"), (2, None, "x"), (3, "red", None), (9, "no item", "y")], "doc_id long, text string, source string").write.parquet(str(tmp_path / "a"))
    spark.createDataFrame([(1, "red fox. blue bird"), (2, "red")], "item_id long, text string").write.parquet(str(tmp_path / "g"))
    spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "j"))
    settings = common.config_of("score_candidates") | {"item": "CASE WHEN doc_id < 9 THEN 1 + pmod(doc_id + 1, n_items) END"}
    answers, totals = score_candidates.run(spark, *(str(tmp_path / t) for t in "agj"), str(tmp_path / "out"), settings)
    got = {r.question: (r.item, r.n_facts, r.covered, r.shared, r.missing, round(r.f1, 6)) for r in answers.collect()}
    assert got == {1: (1, 2, 2, 4, 0, round(8 / 9, 6)), 2: (2, 1, 0, 0, 1, 0.0), 3: (1, 2, 0, 1, 3, 0.4), 9: (None, 0, 0, 0, 0, 0.0)}
    board = {r.candidate: (r.n, r.status, r.place, r.passed) for r in totals.collect()}
    assert board == {"x": (2, "completed", 1, True), None: (1, "failed", 3, False), "y": (1, "failed", 2, False)}


def test_config_files(tmp_path):
    mine = tmp_path / "mine.json"
    mine.write_text(json.dumps({"buckets": 3}))
    assert common.config_of("update_index", str(mine))["buckets"] == 3
    mine.write_text(json.dumps({"bucket": 3}))
    with pytest.raises(ValueError, match="bucket"):
        common.config_of("update_index", str(mine))


def test_command_lines(monkeypatch, spark, sf, tmp_path):
    """main() makes the session and stops it; here it gets the tests' one."""

    class Lent:
        def __getattr__(self, name):
            return getattr(spark, name)

        def stop(self):
            stopped.append(True)

    stopped = []
    for job in (update_index, score_candidates):
        monkeypatch.setattr(job, "session", lambda name: Lent())
    update_index.main(["--input", f"{sf}/documents.parque[t]", "--output", str(tmp_path / "i"), "--checkpoint", str(tmp_path / "s")])
    score_candidates.main(["--answers", f"{sf}/documents.parquet", "--gold", f"{sf}/benchmark.parquet", "--judged", f"{sf}/labels.parquet", "--output", str(tmp_path / "o")])
    assert stopped == [True, True] and spark.read.parquet(str(tmp_path / "o" / "totals")).count() > 0
