"""Fusion ranks documents and questions that have no vector, too."""

import pytest

from lexigrade.plans import catalog


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The documents that answer the questions have no vector, nor has the second question."""
    path = str(tmp_path_factory.mktemp("tables"))
    docs = [(i, f"filler words number {i}", "s") for i in range(1, 7)] + [(50, "where the red fox sleeps", "s"), (51, "how a blue whale sings", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "red fox sleeps"), (90, "blue whale sings")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    vectors = [(i, [float(i), 1.0]) for i in range(1, 4)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.mark.parametrize("name, column", [("f12_rrf", "doc_id"), ("f13_rrf_pooled", "doc_id"), ("f18_hybrid_search", "article_no")])
def test_documents_without_vectors_are_hits(spark, tables, name, column):
    hits = {(r.item_id, r[column]) for r in catalog.QUERIES[name](spark, tables).collect()}
    assert {(1, 50), (90, 51)} <= hits


def test_confidence_of_questions_without_vectors(spark, tables):
    got = {r.item_id: r for r in catalog.QUERIES["f10_confidence"](spark, tables).collect()}
    assert got[1].c_lexical == got[90].c_lexical == 1.0
    assert got[1].c_dense is not None and got[90].c_dense is None


def test_sweep_counts_gold_without_vectors(spark, tables):
    got = {r.weight: (r.n, r.mrr) for r in catalog.QUERIES["h23_fusion_sweep"](spark, tables).collect()}
    assert got[0.0] == (2, 1.0)
