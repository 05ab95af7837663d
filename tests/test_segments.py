"""The kept index: appends, searches against full scoring, skipped rows, and what its plans read."""

import random

import pytest
from pyspark.sql import functions as F

from lexigrade.operators import index, retrieval, segments, similarity


def corpus(n=400):
    """Words of very unlike frequency; a passage that few units hold; units of one word, of none, and copies."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 60)))) for i in range(n)]
    rows += [(n + i, "rare0 rare1 w5 w9 " + rows[i][1]) for i in range(6)] + [(n + 10 + i, "w0 w1 w2") for i in range(20)] + [(n + 50, ""), (n + 51, "w0")]
    return rows


QUESTIONS = [(0, "rare0 rare1 w0 w1 w2 w3"), (1, "w0 w0 w1"), (2, "w290 w291 w0 w1 w2 w3 w4 w5"), (3, "none at all"), (4, ""), (5, " ".join(f"w{i}" for i in range(0, 300, 7)))]


@pytest.fixture(scope="module")
def parts(spark):
    rows = index.tokenised(spark.createDataFrame(corpus(), "id long, text string"), "id", "text").cache()
    asked = retrieval.question_terms(spark.createDataFrame(QUESTIONS, "qid long, question string"), "qid", "question").cache()
    return rows, asked


def ranks(df):
    return sorted((r.qid, r.rank, r.unit, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("first, lead, units, k", [(1 << 11, 16, 1 << 16, 4), (1, 1, 50, 4), (20, 2, 1 << 16, 1), (5, 4, 7, 30)])
def test_search_is_exact(spark, parts, tmp_path, monkeypatch, first, lead, units, k):
    for name, value in (("FIRST", first), ("LEAD", lead), ("UNITS", units), ("PLAIN", 0)):
        monkeypatch.setattr(segments, name, value)
    rows, asked = parts
    found = segments.Segments(spark, str(tmp_path), buckets=4)
    found.add(rows.where("unit % 3 = 0"), 0)
    found.add(rows.where("unit % 3 > 0"), 7)
    want = ranks(retrieval.ranked(retrieval.bm25(rows, asked), k=k))
    assert ranks(found.search(asked, k)) == want
    assert ranks(retrieval.ranked(found.scores(asked), k=k)) == want
    other = retrieval.ranked(retrieval.bm25(rows, asked, 0.9, 0.2), k=k)
    assert ranks(found.search(asked, k, 0.9, 0.2)) == ranks(other)


def test_terms_are_left_out(spark, parts, tmp_path, monkeypatch):
    """A question of two rare and four common words is answered without the common words' entries."""
    monkeypatch.setattr(segments, "FIRST", 20)
    rows, asked = parts
    found = segments.Segments(spark, str(tmp_path))
    found.add(rows, 0)
    passes = found.passes(found.weighted(asked.where("qid = 0")), 4)
    matches = passes["weights"].agg(F.sum("df")).first()[0]
    assert passes["second"].count() == 0 and passes["first"].count() + passes["hopeful"].count() < 0.1 * matches


def test_segments_add_up(spark, parts, tmp_path):
    """Appends in any number equal one build; a segment written again is replaced; other sessions read the folder."""
    rows, asked = parts
    one, many = segments.Segments(spark, str(tmp_path / "one")), segments.Segments(spark, str(tmp_path / "many"))
    one.add(rows, 0)
    for k in range(3):
        many.add(rows.where(f"unit % 3 = {k}"), k)
    many.add(rows.where("unit % 3 = 2"), 2)
    entries = lambda s: sorted(map(tuple, s.postings().select("term", F.inline("entries")).collect()))
    assert entries(one) == entries(many) and sorted(map(tuple, one.terms().collect())) == sorted(map(tuple, many.terms().collect()))
    again = segments.Segments(spark.newSession(), str(tmp_path / "many"))
    assert entries(again) == entries(one)
    plan = many.scores(asked)._jdf.queryExecution().executedPlan().toString()
    assert "lower(text" not in plan and "postings" in plan
    bound = many.postings().select(F.max(F.size("entries")).alias("n")).first().n
    assert bound <= segments.UNITS


def test_vector_search(spark, monkeypatch):
    """Blocks of few queries, ties, copies and ids of the queries' own."""
    import numpy as np

    rng = np.random.default_rng(1)
    base = np.round(rng.normal(size=(300, 6)), 2)
    base[100:220] = base[100]
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(base)], "unit long, v array<double>").repartition(3)
    q = v.where("unit % 25 = 0").select(F.col("unit").alias("qid"), F.col("v").alias("q"))
    for block in (1 << 20, 100):
        monkeypatch.setattr(similarity, "BLOCK_BYTES", block)
        for same in (False, True):
            want = retrieval.ranked(retrieval.dense(q, v, same=same), k=7)
            assert ranks(similarity.top(q, v, 7, same)) == ranks(want)
    every = retrieval.ranked(retrieval.dense(q, v, same=True))
    some = every.where("rank % 13 = 1 OR unit IN (100, 150)")
    got = sorted(map(tuple, similarity.ranks_by_vectors(some.select("qid", "unit", "score"), q, v).collect()))
    assert got == sorted((r.qid, r.unit, r["rank"]) for r in some.collect())
    assert similarity.top(q.where("false"), v, 3).count() == 0


def test_ranks_by_counting(spark, parts, monkeypatch):
    rows, asked = parts
    scores = retrieval.bm25(rows, asked)
    qs = asked.select("qid").distinct()
    every = retrieval.ranked(retrieval.completed(scores, qs, rows)).select("qid", "unit", "rank")
    for pairs in (1 << 20, 3):
        monkeypatch.setattr(similarity, "PAIRS", pairs)
        got = similarity.ranks_by_counting(every.where("unit % 5 = 0 OR rank < 4"), scores, rows.select("unit"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, every.where("unit % 5 = 0 OR rank < 4").collect()))


def test_fusion_depth():
    """Beyond the depth nothing can reach the first k, at the most unlike weights."""
    for k in (1, 4, 12):
        d = retrieval.fusion_depth(k)
        assert (1 + 1.6) / (retrieval.RRF_K + d + 1) < 1 / (retrieval.RRF_K + k)


@pytest.mark.parametrize("bracket", [0.002, 0.0])
def test_percentiles_of_large_and_odd_groups(spark, monkeypatch, bracket):
    """Against sorting, for groups of one value, of many equal ones, of few rows, and with nulls; too narrow brackets are mended."""
    from lexigrade.operators import metrics

    monkeypatch.setattr(metrics, "BRACKET", bracket)
    monkeypatch.setattr(metrics, "ACCURACY", 10_000 if bracket else 5)
    rng = random.Random(3)
    groups = {"hot": [rng.lognormvariate(0, 1) for _ in range(5000)], "one": [0.25], "same": [2.0] * 900 + [3.0] * 100, "few": [3.0, 1.0, 2.0], "none": [None], "mixed": [None, 1.0, None, 2.0], None: [7.0, 8.0]}
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double").repartition(4)
    ratios = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.g: tuple(r)[1:] for r in metrics.exact_percentiles(rows, ["g"], "v", ratios).collect()}
    want = {}
    for g, vs in groups.items():
        s = sorted(v for v in vs if v is not None)
        if s:
            want[g] = tuple(round(s[int((len(s) - 1) * r)], 4) for r in ratios.values())
    assert got == want
