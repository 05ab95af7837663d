"""Retrieval by passes over counts of the questions' words: results, copies, blocks, and that no pairs are shuffled."""

import contextlib
import io
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexigrade.operators import chunking, index, lexical, retrieval, segments, similarity
from lexigrade.plans import catalog, retrieval_queries


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def rows(df, *cols):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def parts(spark):
    words = [f"w{i}" for i in range(12)]
    docs = [(i, " ".join(words[(i * j) % 12] for j in range(1, 1 + i % 9))) for i in range(60)] + [(60 + i, "w1 w2 w3") for i in range(9)] + [(80, ""), (81, None), (82, "none of them")]
    units = index.tokenised(spark.createDataFrame(docs, "id long, t string").repartition(5), "id", "t")
    questions = spark.createDataFrame([(1, "w1 w2 w2 w7"), (2, "w3"), (3, "nothing here"), (4, ""), (5, "w11 w1 of w5")], "qid long, question string")
    return units, questions, retrieval.question_terms(questions, "qid", "question")


@pytest.mark.parametrize("block", [2, 1 << 12])
def test_scan_as_ranked_sums(parts, block, monkeypatch):
    monkeypatch.setattr(lexical, "QUESTIONS", block)
    units, questions, terms = parts
    units = units.withColumn("toks", F.coalesce("toks", F.array().cast("array<string>"))).withColumn("dl", F.size("toks"))
    scan, scores = lexical.Scan(units, terms, questions), retrieval.bm25(units, terms)
    every = retrieval.ranked(retrieval.completed(scores, questions, units))
    for k in (1, 4, 30):
        assert rows(scan.top(k), "qid", "unit", "rank", "score") == rows(retrieval.ranked(scores, k=k), "qid", "unit", "rank", "score")
        assert rows(scan.top(k, zeros=True), "qid", "unit", "rank", "score") == rows(every.where(F.col("rank") <= k), "qid", "unit", "rank", "score")
    assert rows(scan.all(), "qid", "unit", "score") == rows(every, "qid", "unit", "score")
    assert rows(scan.ranks(every.where("unit % 3 < 2")), "qid", "unit", "rank") == rows(every.where("unit % 3 < 2"), "qid", "unit", "rank")
    assert rows(scan.spreads(), "qid", "spread") == rows(every.groupBy("qid").agg((F.max("score") - F.min("score")).alias("spread")), "qid", "spread")


def test_rows_of_a_unit_are_its_parts(parts):
    units, _, terms = parts
    units = units.where("toks IS NOT NULL")
    halves = units.withColumn("part", F.struct("unit")).withColumn("parent", F.floor(F.col("unit") / 2))
    want = retrieval.ranked(retrieval.max_pool(retrieval.bm25(units, terms), halves.select("unit", "parent")), k=3)
    assert rows(lexical.Scan(units.withColumn("unit", F.floor(F.col("unit") / 2)), terms).top(3), "qid", "unit", "rank") == rows(want, "qid", "unit", "rank")


def test_bonus_of_a_group(spark, parts):
    units, questions, terms = parts
    units = units.where("toks IS NOT NULL").withColumn("group", F.concat(F.lit("g"), (F.col("unit") % 4).cast("string")))
    bonus = spark.createDataFrame([(1, "g2", 0.5), (2, "g0", 9.0), (3, "g1", 0.1), (5, "gone", 1.0)], "qid long, group string, bonus double")
    got = lexical.Scan(units, terms, questions).top(5, zeros=True, bonus=bonus)
    sums = retrieval.completed(retrieval.bm25(units.drop("group"), terms), questions, units).join(units.select("unit", "group"), "unit").join(bonus, ["qid", "group"], "left")
    want = retrieval.ranked(sums.select("qid", "unit", (F.col("score") + F.coalesce("bonus", F.lit(0.0))).alias("score")), k=5)
    assert rows(got, "qid", "unit", "rank", "score") == rows(want, "qid", "unit", "rank", "score")


def test_copies_have_equal_scores(spark):
    """Terms were added in the order in which a shuffle brought them, so copies of a text could differ in the last place, and so in rank."""
    text, asked = " ".join(f"w{i * i % 97}" for i in range(150)), " ".join(f"w{i}" for i in range(97))
    others = [(1000 + i, " ".join(f"w{j}" for j in range(i % 90))) for i in range(200)]
    docs = index.tokenised(spark.createDataFrame([(i, text) for i in range(300)] + others, "id long, t string").repartition(8), "id", "t")
    questions = spark.createDataFrame([(1, asked)], "qid long, question string")
    got = lexical.Scan(docs, retrieval.question_terms(questions, "qid", "question")).all().where("unit < 1000")
    assert [r[0] for r in got.groupBy("score").count().select("count").collect()] == [300]


@pytest.mark.parametrize("name", ["f2_bm25_set_top4", "f10_confidence", "f12_rrf", "f13_rrf_pooled", "h2_rr_no_cutoff", "h33_breakdown"])
def test_no_index_is_built_for_a_batch(spark, sf, name, monkeypatch):
    """The index of all postings, and a row per question, term and document from it, were shuffled."""

    def refuse(*_):
        raise AssertionError("postings are shuffled")

    monkeypatch.setattr(segments.Segments, "add", refuse)
    monkeypatch.setattr(similarity, "ranks_by_counting", refuse)
    monkeypatch.setattr(retrieval_queries, "_KEPT", {})
    catalog.QUERIES[name](spark, sf).count()


@pytest.mark.parametrize("name", ["f4_clause_maxpool", "f6_doc_boost", "f15_mode_switch", "f16_fallback", "f18_hybrid_search", "h22_config_grid"])
def test_no_tokens_are_shuffled(spark, sf, name, monkeypatch):
    def refuse(*_):
        raise AssertionError("a row per question and document is shuffled")

    monkeypatch.setattr(retrieval, "bm25", refuse)
    monkeypatch.setattr(retrieval, "dense", refuse)
    monkeypatch.setattr(segments.Segments, "add", refuse)
    monkeypatch.setattr(retrieval_queries, "_KEPT", {})
    catalog.QUERIES[name](spark, sf).count()


@pytest.mark.parametrize("few", [0, 1 << 12])
def test_texts_are_looked_through_where_they_are_read(spark, sf, few, monkeypatch):
    monkeypatch.setattr(retrieval, "FEW_ITEMS", few)
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    found = retrieval.holding(docs, "doc_id", "text", items, "item_id", "text")
    want = docs.join(items.select("item_id", F.col("text").alias("part")), F.contains("text", "part")).select("item_id", "doc_id")
    assert rows(found, "qid", "unit") == rows(want, "item_id", "doc_id")
    if few:
        assert plan(found).count("struct<doc_id:bigint,text:string>") == 2


def test_repair_folds_once(spark):
    """A fold that copied all it had built at every line took time with the square of the text."""
    lines = [["alpha", "bet", "x y", "ab", "cd", "ef gh", "i"], [], None, ["zz", "zz"], ["a b", "c", "d", "e f"]]
    docs = spark.createDataFrame(list(enumerate(lines)), "id int, ls array<string>")
    words = spark.createDataFrame([("alphabet",), ("abcd",), ("abcdef",), ("bcde",), ("bc",)], "word string")
    got = chunking.repaired(docs, "ls", words)
    assert "aggregate(" not in plan(got)
    assert {r.id: r.repaired for r in got.collect()} == {0: "alphabet x y abcdef gh i", 1: "", 2: None, 3: "zz zz", 4: "a bc d e f"}


def test_parts_of_the_table_that_match_nothing(spark):
    """Sums of no entries are no doubles by themselves."""
    units = index.tokenised(spark.createDataFrame([(i, "a b" if i == 7 else "c") for i in range(8)], "id long, t string").repartition(8), "id", "t")
    questions = spark.createDataFrame([(1, "b")], "qid long, question string")
    scan = lexical.Scan(units, retrieval.question_terms(questions, "qid", "question"), questions)
    assert rows(scan.ranks(scan.all()), "qid", "unit", "rank") == [(1, i, i + 2) for i in range(7)] + [(1, 7, 1)]


def test_scores_are_the_terms_of_the_sql_rounded_once(spark):
    """Terms, and their sums in one order, were rounded otherwise than the SQL does, so near the middle between two places ranks could differ."""
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 90)))) for i in range(120)]
    asked = "a b c d e f g h a b a q r s t u v"
    units = index.tokenised(spark.createDataFrame(docs, "id long, t string").repartition(3), "id", "t")
    questions = spark.createDataFrame([(1, asked)], "qid long, question string")
    got = {r.unit: r.score for r in lexical.Scan(units, retrieval.question_terms(questions, "qid", "question")).all().collect()}
    tokens = {i: t.split() for i, t in docs}
    n, mean = len(docs), sum(map(len, tokens.values())) / len(docs)
    df = Counter(w for ts in tokens.values() for w in set(ts))

    def term(w, qtf, ts):
        return qtf * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * ts.count(w) * 2.2 / (ts.count(w) + 1.2 * (0.25 + 0.75 * len(ts) / mean))

    assert got == {i: math.fsum(term(w, k, ts) for w, k in Counter(asked.split()).items() if w in ts) for i, ts in tokens.items()}
