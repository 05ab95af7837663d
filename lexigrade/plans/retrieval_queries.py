"""Queries of retrieval and its metrics.

Corpus: documents. Questions: benchmark. Gold: the documents that hold a
question's text. Vectors: embeddings, whose ids are those of the documents that
have one; a question's vector is the one of its own id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import chunking, index, lexical, metrics, retrieval, similarity
from .base import sql_words, table
from .text_queries import SQL_CLAUSES, _CLAUSES

QUERIES, ORACLES = {}, {}


def _add(name: str, query: object, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def units(spark: SparkSession, sf: str, tokeniser: str = "word") -> DataFrame:
    return index.tokenised(table(spark, sf, "documents"), "doc_id", "text", tokeniser)


_KEPT: dict[tuple, lexical.Scan] = {}


def scan(spark: SparkSession, sf: str, query_tf: str = "multiset") -> lexical.Scan:
    """The questions' scan of the documents. Its table of counts is made once per session and state of the files."""
    key = (spark.sparkContext.applicationId, sf, query_tf)
    for name in ("documents", "benchmark"):
        files = table(spark, sf, name).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
        key += tuple(files.agg(F.count(F.lit(1)), F.sum(F.xxhash64("*").cast("decimal(38,0)"))).first())
    if key in _KEPT:
        try:
            for block in _KEPT[key].blocks:
                block.counts.first()
            return _KEPT[key]
        except Exception:  # noqa: BLE001  the folder has been cleared
            del _KEPT[key]
    q = questions(spark, sf)
    _KEPT[key] = lexical.Scan(units(spark, sf), retrieval.question_terms(q, "qid", "question", "word", query_tf), q)
    return _KEPT[key]


def best(spark: SparkSession, sf: str, k: int, query_tf: str = "multiset") -> DataFrame:
    """The first k documents of every question that share a term with it: (qid, unit, score, rank)."""
    if k < 1:
        raise ValueError("top_k must be positive")
    return scan(spark, sf, query_tf).top(k)


def out(df: DataFrame, *more: str) -> DataFrame:
    return df.select(F.col("qid").alias("item_id"), F.col("unit").alias("doc_id"), *more, F.round("score", 6).alias("score"))


def gold(spark: SparkSession, sf: str) -> DataFrame:
    """(qid, unit): the documents that hold a question's text, as a table: texts are looked through once."""
    return retrieval.kept(retrieval.holding(table(spark, sf, "documents"), "doc_id", "text", questions(spark, sf), "qid", "question"), "gold")


def sql_bm25(qtf: str = "count(*)", toks: str = sql_words("text")) -> str:
    """CTEs up to sc(item_id, doc_id, s): the scores of units that share a term."""
    return f"""d AS (SELECT doc_id, {toks} AS ts FROM documents),
    st AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM d),
    p AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS t FROM d) GROUP BY ALL),
    df AS (SELECT t, count(*) AS df FROM p GROUP BY t),
    q AS (SELECT item_id, t, {qtf} AS qtf FROM (SELECT item_id, unnest({toks}) AS t FROM benchmark) GROUP BY item_id, t),
    sc AS (SELECT q.item_id, p.doc_id, sum(q.qtf * ln(1 + (st.n - df.df + 0.5::DOUBLE) / (df.df + 0.5::DOUBLE)) * p.tf * 2.2::DOUBLE
        / (p.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(d.ts) / st.avgdl))) AS s
      FROM q JOIN p USING (t) JOIN df USING (t) JOIN d USING (doc_id), st GROUP BY ALL)"""


SQL_GOLD = "g AS (SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
_TOP = "r AS (SELECT item_id, doc_id, s, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(s, 9) DESC, doc_id) AS INT) AS rank FROM {x})"
_TOP4 = _TOP.format(x="sc")


def f1_bm25_top4(spark: SparkSession, sf: str) -> DataFrame:
    return out(best(spark, sf, 4), "rank")


_add("f1_bm25_top4", f1_bm25_top4, f"WITH {sql_bm25()}, {_TOP4} SELECT item_id, doc_id, rank, round(s, 6) AS score FROM r WHERE rank <= 4")
_add(
    "f2_bm25_set_top4",
    lambda s, d: out(best(s, d, 4, "set"), "rank"),
    f"WITH {sql_bm25('1')}, {_TOP4} SELECT item_id, doc_id, rank, round(s, 6) AS score FROM r WHERE rank <= 4",
)


_FULL = "fu AS (SELECT b.item_id, d.doc_id, coalesce(sc.s, 0) AS s FROM benchmark b CROSS JOIN documents d LEFT JOIN sc ON sc.item_id = b.item_id AND sc.doc_id = d.doc_id)"
_add(
    "f3_full_ranking",
    lambda s, d: out(retrieval.ranked(scan(s, d).all()), "rank"),
    f"WITH {sql_bm25()}, {_FULL}, {_TOP.format(x='fu')} SELECT item_id, doc_id, rank, round(s, 6) AS score FROM r",
)


def f4_clause_maxpool(spark: SparkSession, sf: str) -> DataFrame:
    """Questions against the clauses of all documents; a document scores as its best clause."""
    rows = chunking.units(table(spark, sf, "documents").select("doc_id", "source", F.expr(_CLAUSES).alias("t")), "clause", "source", "t")
    parts = index.tokenised(rows, "doc_id", "unit_text")
    terms = retrieval.question_terms(questions(spark, sf), "qid", "question", "word", "set")
    return out(lexical.Scan(parts, terms).top(4), "rank")


_add(
    "f4_clause_maxpool",
    f4_clause_maxpool,
    f"""WITH {SQL_CLAUSES}, d AS (SELECT doc_id, unit_no, {sql_words('unit_text')} AS ts FROM u), st AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM d),
    po AS (SELECT doc_id, unit_no, t, count(*) AS tf FROM (SELECT doc_id, unit_no, unnest(ts) AS t FROM d) GROUP BY ALL),
    df AS (SELECT t, count(*) AS df FROM po GROUP BY t),
    q AS (SELECT DISTINCT item_id, unnest({sql_words('text')}) AS t FROM benchmark),
    us AS (SELECT q.item_id, po.doc_id, po.unit_no, sum(ln(1 + (st.n - df.df + 0.5::DOUBLE) / (df.df + 0.5::DOUBLE)) * po.tf * 2.2::DOUBLE
        / (po.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(d.ts) / st.avgdl))) AS s
      FROM q JOIN po USING (t) JOIN df USING (t) JOIN d USING (doc_id, unit_no), st GROUP BY ALL),
    sc AS (SELECT item_id, doc_id, greatest(max(s), 0) AS s FROM us GROUP BY ALL), {_TOP4}
    SELECT item_id, doc_id, rank, round(s, 6) AS score FROM r WHERE rank <= 4""",
)


def naming(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Questions that name a source, and the names (a row per source)."""
    q = questions(spark, sf).withColumn("question", F.concat("question", F.lit(" src "), (F.col("qid") % 25).cast("string")))
    return q, table(spark, sf, "documents").select(F.col("source").alias("name")).distinct()


def f5_named_document(spark: SparkSession, sf: str) -> DataFrame:
    q, names = naming(spark, sf)
    named = retrieval.named_document(q, "qid", "question", names)
    return q.join(named, "qid", "left").select(F.col("qid").alias("item_id"), "named")


_NAMED = "nm AS (SELECT b.item_id, arg_max(n.source, (length(n.source), n.source)) AS named FROM benchmark b JOIN (SELECT DISTINCT source FROM documents) n ON contains(regexp_replace(b.text, '\\s+', '', 'g') || 'src' || (b.item_id % 25), n.source) GROUP BY b.item_id)"
_add("f5_named_document", f5_named_document, f"WITH {_NAMED} SELECT b.item_id, named FROM benchmark b LEFT JOIN nm USING (item_id)")


def f6_doc_boost(spark: SparkSession, sf: str) -> DataFrame:
    q, names = naming(spark, sf)
    docs = table(spark, sf, "documents")
    rows = index.tokenised(docs.withColumn("id", F.struct("doc_id", "source")), "id", "text").select("unit.doc_id", F.col("unit.source").alias("group"), "toks", "dl").withColumnRenamed("doc_id", "unit")
    found = lexical.Scan(rows, retrieval.question_terms(questions(spark, sf), "qid", "question"), q)
    bonus = retrieval.named_document(q, "qid", "question", names).join(found.spreads(), "qid").select("qid", F.col("named").alias("group"), (0.5 * F.col("spread")).alias("bonus"))
    return out(found.top(4, zeros=True, bonus=bonus), "rank")


_add(
    "f6_doc_boost",
    f6_doc_boost,
    f"""WITH {sql_bm25()}, {_FULL}, {_NAMED}, sp AS (SELECT item_id, max(s) - min(s) AS spread FROM fu GROUP BY item_id),
    bo AS (SELECT fu.item_id, fu.doc_id, fu.s + CASE WHEN x.source = nm.named THEN 0.5::DOUBLE * spread ELSE 0 END AS s FROM fu JOIN sp USING (item_id) JOIN documents x USING (doc_id) LEFT JOIN nm USING (item_id)),
    {_TOP.format(x='bo')} SELECT item_id, doc_id, rank, round(s, 6) AS score FROM r WHERE rank <= 4""",
)

# ---------------------------------------------------------------- vectors and fusion


def f7_dense_top4(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    queries, vectors = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")), e.select(F.col("vec_id").alias("unit"), F.col("embedding").alias("v"))
    return out(similarity.top(queries, vectors, 4), "rank").withColumnsRenamed({"item_id": "query_id", "doc_id": "vec_id"})


_DOT = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_add(
    "f7_dense_top4",
    f7_dense_top4,
    f"""WITH sc AS (SELECT a.vec_id AS query_id, b.vec_id, {_DOT} AS s FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS INT) AS rank FROM sc) SELECT query_id, vec_id, rank, round(s, 6) AS score FROM r WHERE rank <= 4""",
)


def asked_vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(qid, q) of the questions that have a vector, and (unit, v) of the documents that have one."""
    e = table(spark, sf, "embeddings")
    asked = e.join(questions(spark, sf).select(F.col("qid").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    own = e.join(table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("unit"), F.col("embedding").alias("v"))
    return asked, own


def both_rankings(spark: SparkSession, sf: str, k: int) -> tuple[DataFrame, DataFrame]:
    """The first k of the rankings of all documents by BM25, and of those that have a vector by dot product."""
    return scan(spark, sf).top(k, zeros=True), similarity.top(*asked_vectors(spark, sf), k, same=True)


def dynamic(sparse: DataFrame, dense: DataFrame) -> DataFrame:
    weights = [retrieval.weights_of(retrieval.confidence(x)) for x in (sparse, dense)]
    return retrieval.fused([(sparse, weights[0]), (dense, weights[1])])


_HYBRID = f"""{sql_bm25()},
    fu AS (SELECT b.item_id, d.doc_id, coalesce(sc.s, 0) AS s FROM benchmark b CROSS JOIN documents d LEFT JOIN sc ON sc.item_id = b.item_id AND sc.doc_id = d.doc_id),
    de AS (SELECT a.vec_id AS item_id, b.vec_id AS doc_id, {_DOT} AS s FROM embeddings a JOIN benchmark q ON q.item_id = a.vec_id, embeddings b JOIN documents dd ON dd.doc_id = b.vec_id),
    l1 AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(s, 9) DESC, doc_id) AS rank FROM fu),
    l2 AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(s, 9) DESC, doc_id) AS rank FROM de)"""
_CONF = """{n} AS (SELECT item_id, max(s) FILTER (rank = 1) AS top, list_sort(list(s) FILTER (rank > 1 AND rank <= 11)) AS tl FROM {l} WHERE rank <= 11 GROUP BY item_id),
    {n}c AS (SELECT item_id, CASE WHEN len(tl) = 0 OR tl IS NULL OR top <= 0 THEN 0 ELSE greatest(0, least(1, (top - tl[len(tl) // 2 + 1]) / top)) END AS c FROM {n})"""
_CONFS = _CONF.format(n="k1", l="l1") + ", " + _CONF.format(n="k2", l="l2")


def f10_confidence(spark: SparkSession, sf: str) -> DataFrame:
    sparse, dense = both_rankings(spark, sf, 11)
    a, b = retrieval.confidence(sparse), retrieval.confidence(dense)
    w = lambda x, n: x.select("qid", F.round("confidence", 6).alias(f"c_{n}"), F.round(1 + 0.6 * F.col("confidence"), 6).alias(f"w_{n}"))
    return w(a, "lexical").join(w(b, "dense"), "qid", "left").withColumnRenamed("qid", "item_id")


_add(
    "f10_confidence",
    f10_confidence,
    f"""WITH {_HYBRID}, {_CONFS} SELECT item_id, round(k1c.c, 6) AS c_lexical, round(1 + 0.6::DOUBLE * k1c.c, 6) AS w_lexical, round(k2c.c, 6) AS c_dense, round(1 + 0.6::DOUBLE * k2c.c, 6) AS w_dense
    FROM k1c LEFT JOIN k2c USING (item_id)""",
)


def f12_rrf(spark: SparkSession, sf: str) -> DataFrame:
    """Fusion of whole rankings, of which only the first ones are made: beyond them no document can be among the first four.

    The four first by BM25 have w / (60 + 4) at least; what is in neither list's
    first ``depth`` has less than (w + w') / (60 + depth). Those that are in one of
    them are ranked in the other one by counting.
    """
    depth = retrieval.fusion_depth(4)
    asked, own = asked_vectors(spark, sf)
    found = scan(spark, sf)
    sparse = found.top(depth, zeros=True)
    dense = similarity.top(asked, own, depth, same=True)
    weights = [retrieval.weights_of(retrieval.confidence(x)) for x in (sparse, dense)]
    pool = retrieval.kept(sparse.select("qid", "unit").unionByName(dense.select("qid", "unit")).distinct(), "pool")
    first = found.ranks(pool)
    second = similarity.ranks_by_vectors(similarity.pair_scores(pool, asked, own), asked, own)
    return out(retrieval.ranked(retrieval.fused([(first, weights[0]), (second, weights[1])]), k=4), "rank")


_add(
    "f12_rrf",
    f12_rrf,
    f"""WITH {_HYBRID}, {_CONFS}, al AS (
      SELECT item_id, doc_id, (1 + 0.6::DOUBLE * c) / (60 + rank) AS s FROM l1 JOIN k1c USING (item_id) UNION ALL SELECT item_id, doc_id, (1 + 0.6::DOUBLE * c) / (60 + rank) FROM l2 JOIN k2c USING (item_id)
    ), fz AS (SELECT item_id, doc_id, sum(s) AS s FROM al GROUP BY ALL), {_TOP.format(x='fz')} SELECT item_id, doc_id, rank, round(s, 6) AS score FROM r WHERE rank <= 4""",
)


def f13_rrf_pooled(spark: SparkSession, sf: str) -> DataFrame:
    sparse, dense = both_rankings(spark, sf, retrieval.POOL)
    return out(retrieval.ranked(retrieval.fused([(sparse, 1.0), (dense, 2.0)]), "first", k=4), "rank")


_add(
    "f13_rrf_pooled",
    f13_rrf_pooled,
    f"""WITH {_HYBRID}, al AS (
      SELECT item_id, doc_id, 1.0::DOUBLE / (60 + rank) AS s, 0 AS li, rank FROM l1 WHERE rank <= 12 UNION ALL SELECT item_id, doc_id, 2.0::DOUBLE / (60 + rank), 1, rank FROM l2 WHERE rank <= 12
    ), fz AS (SELECT item_id, doc_id, sum(s) AS s, min(li * 1000 + rank) AS f FROM al GROUP BY ALL),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(s, 9) DESC, f) AS INT) AS rank FROM fz) SELECT item_id, doc_id, rank, round(s, 6) AS score FROM r WHERE rank <= 4""",
)
_REFS = "array(doc_id % 3, doc_id % 2, doc_id % 5, doc_id % 7, doc_id % 11)"
_add(
    "f17_first_refs",
    lambda s, d: table(s, d, "documents").select("doc_id", F.array_join(retrieval.first_refs(F.expr(_REFS)).cast("array<string>"), ",").alias("refs")),
    """WITH e AS (SELECT doc_id, unnest([doc_id % 3, doc_id % 2, doc_id % 5, doc_id % 7, doc_id % 11]) AS v, unnest([1, 2, 3, 4, 5]) AS k FROM documents),
    f AS (SELECT doc_id, v, min(k) AS k FROM e GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i FROM f)
    SELECT doc_id, string_agg(CAST(v AS VARCHAR), ',' ORDER BY k) AS refs FROM o WHERE i <= 4 GROUP BY doc_id""",
)


def f18_hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    """The facade: all documents, searched in hybrid mode."""
    e = table(spark, sf, "embeddings")
    corpus = table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), F.col("source").alias("doc"), F.col("doc_id").alias("article_no"), F.lit("").alias("title"), "text")
    q = questions(spark, sf)
    asked = e.join(q.select(F.col("qid").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    own = e.join(corpus.select(F.col("ord").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("unit"), F.col("embedding").alias("v"))
    found = retrieval.Retriever(corpus, own, asked).search(q)
    return found.select(F.col("qid").alias("item_id"), "doc", "article_no", "rank", F.round("score", 6).alias("score"))


_add(
    "f18_hybrid_search",
    f18_hybrid_search,
    f"""WITH {_HYBRID.replace('count(*) AS qtf', '1 AS qtf').replace('SELECT item_id, t, count(*)', 'SELECT item_id, t, 1')}, al AS (
      SELECT item_id, doc_id, 1.0::DOUBLE / (60 + rank) AS s, 0 AS li, rank FROM l1 WHERE rank <= 12 UNION ALL SELECT item_id, doc_id, 1.0::DOUBLE / (60 + rank), 1, rank FROM l2 WHERE rank <= 12
    ), fz AS (SELECT item_id, doc_id, sum(s) AS s, min(li * 1000 + rank) AS f FROM al GROUP BY ALL),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(s, 9) DESC, f) AS INT) AS rank FROM fz)
    SELECT item_id, x.source AS doc, r.doc_id AS article_no, rank, round(s, 6) AS score FROM r JOIN documents x USING (doc_id) WHERE rank <= 4""",
)

# ---------------------------------------------------------------- retrieval metrics


def hits4(spark: SparkSession, sf: str, query_tf: str = "multiset") -> DataFrame:
    return best(spark, sf, 4, query_tf).select("qid", "unit", "rank")


_SQL_TOP4 = f"{sql_bm25()}, {_TOP4}, h AS (SELECT item_id, doc_id, rank FROM r WHERE rank <= 4)"
_add(
    "h1_rr",
    lambda s, d: metrics.reciprocal_rank(hits4(s, d), gold(s, d)).select(F.col("qid").alias("item_id"), F.round("rr", 6).alias("rr")),
    f"WITH {_SQL_TOP4}, {SQL_GOLD} SELECT h.item_id, round(coalesce(1.0::DOUBLE / min(CASE WHEN g.doc_id IS NOT NULL THEN h.rank END), 0), 6) AS rr FROM h LEFT JOIN g USING (item_id, doc_id) GROUP BY h.item_id",
)


def h2_rr_no_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    """Gold documents are ranked by counting those that stand before them; nothing else is."""
    ranks = scan(spark, sf).ranks(gold(spark, sf))
    every = questions(spark, sf).select("qid").join(ranks.groupBy("qid").agg(F.min("rank").alias("r")), "qid", "left")
    return every.select(F.col("qid").alias("item_id"), F.round(F.coalesce(1.0 / F.col("r"), F.lit(0.0)), 6).alias("rr"))


_add(
    "h2_rr_no_cutoff",
    h2_rr_no_cutoff,
    f"WITH {sql_bm25()}, {_FULL}, {_TOP.format(x='fu')}, {SQL_GOLD} SELECT r.item_id, round(coalesce(1.0::DOUBLE / min(CASE WHEN g.doc_id IS NOT NULL THEN r.rank END), 0), 6) AS rr FROM r LEFT JOIN g USING (item_id, doc_id) GROUP BY r.item_id",
)
_SQL_SCORES = """x AS (SELECT g.item_id, count(h.rank) / count(*) AS recall, (count(h.rank) = count(*))::INT::DOUBLE AS fu1, coalesce(1.0::DOUBLE / min(h.rank), 0) AS rr, coalesce((min(h.rank) = 1)::INT::DOUBLE, 0) AS hit1
    FROM g LEFT JOIN h USING (item_id, doc_id) GROUP BY g.item_id)"""
_MEANS = "count(*) AS n, round(avg(recall), 6) AS recall, round(avg(fu1), 6) AS \"full\", round(avg(rr), 6) AS rr, round(avg(hit1), 6) AS hit1"


def _means(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("recall", "full", "rr", "hit1")})


def scores4(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.retrieval_scores(hits4(spark, sf), gold(spark, sf))


_add("h3_retrieval_metrics", lambda s, d: _means(metrics.retrieval_means(scores4(s, d))), f"WITH {_SQL_TOP4}, {SQL_GOLD}, {_SQL_SCORES} SELECT {_MEANS} FROM x")
_add(
    "h4_by_group",
    lambda s, d: _means(metrics.retrieval_means(scores4(s, d).withColumn("ptype", F.expr("CASE qid % 3 WHEN 0 THEN 'basic' WHEN 1 THEN 'trap' END")), "ptype")),
    f"WITH {_SQL_TOP4}, {SQL_GOLD}, {_SQL_SCORES} SELECT CASE item_id % 3 WHEN 0 THEN 'basic' WHEN 1 THEN 'trap' ELSE '?' END AS ptype, {_MEANS} FROM x GROUP BY 1",
)
CONFIGS = (("word", "multiset"), ("word", "set"), ("plain", "multiset"), ("plain", "set"))
_TOKS = {"word": sql_words("text"), "plain": "flatten(list_transform(regexp_extract_all(text, '[0-9A-Za-z가-힣]+'), lambda w: list_concat([w], CASE WHEN regexp_full_match(w, '[가-힣]+') THEN [w] ELSE [] END)))"}


def h22_config_grid(spark: SparkSession, sf: str) -> DataFrame:
    """All configurations, each with its means and its place. A tokeniser's units are scored once, for both kinds of query weights."""
    g = gold(spark, sf)
    parts = []
    for tok in dict.fromkeys(t for t, _ in CONFIGS):
        kinds = [tf for t, tf in CONFIGS if t == tok]
        terms = [retrieval.question_terms(questions(spark, sf), "qid", "question", tok, tf).select(F.struct("qid", F.lit(f"{tok}/{tf}").alias("config")).alias("qid"), "term", "qtf") for tf in kinds]
        every = terms[0]
        for t in terms[1:]:
            every = every.unionByName(t)
        parts.append(lexical.Scan(units(spark, sf, tok), every).top(4).select(F.col("qid.qid").alias("qid"), "qid.config", "unit", "rank"))
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    order = {f"{tok}/{tf}": i for i, (tok, tf) in enumerate(CONFIGS)}
    config = F.explode(F.array(*[F.lit(c) for c in order])).alias("config")
    keyed = lambda df, *more: df.select(F.struct("qid", "config").alias("qid"), "unit", *more)
    scores = metrics.retrieval_scores(keyed(hits, "rank"), keyed(g.select("qid", "unit", config))).withColumn("config", F.col("qid.config"))
    means = _means(metrics.retrieval_means(scores, "config")).withColumn("ord", F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("config")))
    place = Window.orderBy(F.desc("recall"), F.desc("full"), F.desc("rr"), F.desc("hit1"), "ord")  # as many rows as configurations
    return means.select("config", "n", "recall", "full", "rr", "hit1", F.row_number().over(place).alias("place"))


def _sql_grid() -> str:
    parts = []
    for i, (tok, tf) in enumerate(CONFIGS):
        body = sql_bm25("count(*)" if tf == "multiset" else "1", _TOKS[tok])
        parts.append(f"SELECT '{tok}/{tf}' AS config, {i} AS ord, y.* FROM (WITH {body}, {_TOP4}, h AS (SELECT item_id, doc_id, rank FROM r WHERE rank <= 4), {SQL_GOLD}, {_SQL_SCORES} SELECT {_MEANS} FROM x) y")
    return f'WITH z AS ({" UNION ALL ".join(parts)}) SELECT config, n, recall, "full", rr, hit1, CAST(row_number() OVER (ORDER BY recall DESC, "full" DESC, rr DESC, hit1 DESC, ord) AS INT) AS place FROM z'


_add("h22_config_grid", h22_config_grid, _sql_grid())
WEIGHTS = (0.0, 1.0, 2.0, 3.0, 5.0, 8.0)


def h23_fusion_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Mean ranks of gold documents for every dense weight: the weight is a column, so the sweep is one job."""
    sparse, dense = both_rankings(spark, sf, retrieval.POOL)
    grid = F.explode(F.array(*[F.lit(w) for w in WEIGHTS])).alias("weight")
    a = sparse.select("qid", "unit", grid, (1.0 / (60 + F.col("rank"))).alias("score"), F.struct(F.lit(0).alias("l"), "rank").alias("first"))
    b = dense.select("qid", "unit", "rank", grid).select("qid", "unit", "weight", (F.col("weight") / (60 + F.col("rank"))).alias("score"), F.struct(F.lit(1).alias("l"), "rank").alias("first"))
    fused = a.unionByName(b).groupBy("qid", "unit", "weight").agg(F.sum("score").alias("score"), F.min("first").alias("first"))
    keyed = fused.select(F.struct("qid", "weight").alias("qid"), "unit", "score", "first")
    top = retrieval.ranked(keyed, "first", k=4).select("qid.qid", "qid.weight", "unit", "rank")
    g = gold(spark, sf).select(F.col("qid").alias("gq"), F.col("unit").alias("gu")).distinct()
    per = top.join(g, (F.col("qid") == F.col("gq")) & (F.col("unit") == F.col("gu")), "left").groupBy("weight", "qid")
    scores = per.agg(F.min(F.when(F.col("gu").isNotNull(), F.col("rank"))).alias("r"))
    return scores.groupBy("weight").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce(1.0 / F.col("r"), F.lit(0.0))), 6).alias("mrr"))


_add(
    "h23_fusion_sweep",
    h23_fusion_sweep,
    f"""WITH {_HYBRID}, {SQL_GOLD}, wt AS (SELECT unnest([0.0, 1.0, 2.0, 3.0, 5.0, 8.0])::DOUBLE AS weight), al AS (
      SELECT weight, item_id, doc_id, 1.0::DOUBLE / (60 + rank) AS s, 0 AS li, rank FROM l1, wt WHERE rank <= 12 UNION ALL SELECT weight, item_id, doc_id, weight / (60 + rank), 1, rank FROM l2, wt WHERE rank <= 12
    ), fz AS (SELECT weight, item_id, doc_id, sum(s) AS s, min(li * 1000 + rank) AS f FROM al GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY weight, item_id ORDER BY round(s, 9) DESC, f) AS rank FROM fz),
    m AS (SELECT weight, r.item_id, min(CASE WHEN g.doc_id IS NOT NULL THEN r.rank END) AS b FROM r LEFT JOIN g USING (item_id, doc_id) WHERE rank <= 4 GROUP BY ALL)
    SELECT weight, count(*) AS n, round(avg(coalesce(1.0::DOUBLE / b, 0)), 6) AS mrr FROM m GROUP BY weight""",
)


def h33_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    """Every hit with whether it is gold, and every gold document that was missed."""
    g = gold(spark, sf).distinct().withColumn("g", F.lit(True))
    both = hits4(spark, sf).join(g, ["qid", "unit"], "full")
    status = F.when(F.col("rank").isNull(), "MISS").when(F.col("g"), "GOLD").otherwise("-")
    return both.select(F.col("qid").alias("item_id"), F.col("unit").alias("doc_id"), "rank", status.alias("status"))


_add(
    "h33_breakdown",
    h33_breakdown,
    f"WITH {_SQL_TOP4}, {SQL_GOLD} SELECT coalesce(h.item_id, g.item_id) AS item_id, coalesce(h.doc_id, g.doc_id) AS doc_id, h.rank, CASE WHEN h.rank IS NULL THEN 'MISS' WHEN g.doc_id IS NOT NULL THEN 'GOLD' ELSE '-' END AS status FROM h FULL JOIN g ON h.item_id = g.item_id AND h.doc_id = g.doc_id",
)
