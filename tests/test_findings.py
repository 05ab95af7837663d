"""Steps that were found slow, large or lessened: their plans on small tables, and their results."""

import contextlib
import io

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrade.functions import text as T
from lexigrade.operators import chunking, fitting, metrics
from lexigrade.plans import catalog


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_docx_lines_pass_python_twice(spark, sf):
    """Once as a whole text and once as articles; every nested normal form used to repeat the pass three times."""
    found = plan(catalog.QUERIES["c3_docx_articles"](spark, sf))
    assert found.count("pythonUDF0") > 0 and "pythonUDF1" not in found


def test_docx_headings_and_lines(spark):
    text = "front\n 제​ 1  조 ( a&amp;b )\nx y &#10; z\n\n제2조에 따라\n제 3 조 b\rc\n﷐ end\nKOR"
    rows = chunking.docx_articles(spark.createDataFrame([(1, text), (2, None), (3, "no heading")], "id long, t string"), "id", "t").collect()
    assert sorted((r.doc, r.article_no, r.title, r.text, r.ord) for r in rows) == [(1, 1, "a&b", "x y z\n제2조에 따라", 0), (1, 3, "b c", "﷐ end", 1)]


def test_clean_lines_end_and_go(spark):
    rows = [("a \t b ​\nKOR\r\nc&lt;",), ("x\n공고일자 : 1\ny",), ("",), (None,)]
    got = spark.createDataFrame(rows, "t string").select(T.clean_lines("t").alias("t")).collect()
    assert [r.t for r in got] == ["a b\nc<", "x", "", None]


@pytest.mark.parametrize("few", [0, 1 << 10])
def test_marks_of_facts(spark, few, monkeypatch):
    """As the marks of single facts; an answer's n-grams are in the plan once, where they used to be for every mention."""
    monkeypatch.setattr(metrics, "FEW_GRAMS", few)
    docs = spark.createDataFrame([(1, 7, "the red fox sleeps in the den"), (2, 8, "x"), (3, 7, None), (4, 8, "a 𝒳 blue whale sings")], "id long, item long, t string")
    items = spark.createDataFrame([(7, ["a red fox sleeps", "no", ""]), (8, ["blue whale sings 𝒳", "a 𝒳 b"])], "item long, fs array<string>")
    got = metrics.fact_marks(docs, items, "item", "t", "fs", soft=3, hard=8)
    one = docs.join(items, "item").select("id", "t", F.posexplode("fs").alias("i", "f")).select("id", "i", metrics.soft_recall("t", "f").alias("s"), metrics.hard_covered("t", "f").alias("h"))
    want = {(r.id, r.i): (r.s, r.h) for r in one.collect()}
    assert {(r.id, i): (s, h) for r in got.collect() for i, (s, h) in enumerate(zip(r.soft, r.hard, strict=True))} == want
    assert plan(got.select("id", F.explode_outer("soft"))).count("(?s)(?=(.{3}))") <= 2 * 2  # facts and answers, each in the tree and in the details


def test_refusal_and_replies_are_in_the_sql(spark, sf):
    assert {"refused"} <= set(catalog.QUERIES["f14_top_k"](spark, sf).columns) and "refused" in catalog.ORACLES["f14_top_k"]
    assert {"reply", "part", "sent", "paced"} == set(catalog.QUERIES["k2_sequential_pacing"](spark, sf).columns) - {"item_id"}


def test_alignment_sends_a_row_per_article(spark):
    """Every start of an article was a row, and the starts of all of a question's articles were sorted together."""
    words = "x x want that x want that too x".split()
    arts = spark.createDataFrame([("q", 3, words), ("q", 2, ["that", "x"]), ("q", 1, []), ("r", 1, ["a"]), ("r", 0, None)], "qid string, article int, words array<string>")
    facts = spark.createDataFrame([("q", 0, "want that too"), ("q", 1, "그 none"), ("r", 0, "b"), ("s", 0, "a")], "qid string, fact_no int, fact string")
    found = fitting.aligned(facts, arts)
    assert "Generate" not in plan(found) and "Window" not in plan(found)
    assert sorted(map(tuple, found.collect())) == [("q", 0, 3, 5, 8, 1.0), ("q", 1, 1, 0, 2, 0.0), ("r", 0, 1, 0, 1, 0.0)]


def test_fit_takes_the_words_within_reach(spark):
    """All articles of a question, whole, were one list, and each had a table of its words by the tokens of all."""
    words = [f"w{i * i % 89}" for i in range(300)]
    spans = [("q", 0, 7, 100, 104), ("q", 1, 7, 2, 3), ("q", 2, 8, 298, 300)]
    arts = [("q", 7, words), ("q", 8, words[::-1]), *(("q", 10 + i, [f"other{i}x{j}" for j in range(50)]) for i in range(40))]
    seen = [("q", "t", " ".join(words[92:115]), 0.9), ("q", "u", " ".join(words[:9] + words[:4]), 0.6)]
    got = fitting.refined(
        spark.createDataFrame(spans, "qid string, fact_no int, article int, start int, end int"), spark.createDataFrame(arts, "qid string, article int, words array<string>"),
        spark.createDataFrame(seen, "qid string, team string, answer string, f1 double"), margin=4, rounds=3,
    )
    assert "LeftSemi" in plan(got) and "slice(" in plan(got)
    whole, now = dict((a, w) for _, a, w in arts), [(a, s, e) for _, _, a, s, e in spans]
    fit = fitting.Fit([whole[a] for a, *_ in now], [set(x[2].split()) for x in seen], [x[3] for x in seen])
    cover = lambda now: [fit.span(k, s, e) for k, (_, s, e) in enumerate(now)]
    error = float(fit.errors(np.array(cover(now)).any(axis=0)[None])[0])
    for _ in range(3):
        for k, (a, s, e) in enumerate(now):
            least, lo, hi = fit.best_ends(k, s, e, np.delete(np.array(cover(now)), k, axis=0).any(axis=0), 4)
            if least < error - 1e-9:
                error, now[k] = least, (a, lo, hi)
    assert sorted((r.fact_no, r.article, r.start, r.end) for r in got.collect()) == [(k, *x) for k, x in enumerate(now)]
    assert now[0][2] - now[0][1] > 10 and got.first().mae == error


def test_judge_prompts_of_odd_rows_are_those_of_the_sql(spark, tmp_path):
    """Missing and empty texts and sources were given stand-ins that the SQL does not give."""
    texts, sources = [None, "", "x", "a. b", " ", "(빈 답변)"], [None, "", "src"]
    docs = [(3 * (3 * i + j) + k - 4, t, s) for i, t in enumerate(texts) for j, s in enumerate(sources) for k in range(3)]
    items = list(enumerate(["f one. f two", None, "", ". ", "a. "]))
    spark.createDataFrame(docs, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = catalog.QUERIES["g18_judge_prompt"](spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.n, r.digest) for r in got} == {i: (n, d) for i, n, d in con.execute(catalog.ORACLES["g18_judge_prompt"]).fetchall()} and len(got) > 40
