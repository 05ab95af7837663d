"""Retrieval for whole batches of questions: BM25, vectors, boosts, fusion, top-k.

Scores are (qid, unit, score). Ranks order by descending score and then by the
unit's position, which is data: rounding to 9 places keeps sums of doubles, whose
order of addition is not fixed, from deciding ties.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.fixed import CUTOFF, RRF_K
from ..sources.shared import shared_path
from . import chunking, index

K1, B = 1.2, 0.75
POOL = 12


def question_terms(questions: DataFrame, id_col: str, text_col: str, tokeniser: str = "word", query_tf: str = "multiset") -> DataFrame:
    """(qid, term, qtf): each term's occurrences, or 1 where the query is a set."""
    rows = questions.select(F.col(id_col).alias("qid"), F.explode(T.tokenise(text_col, tokeniser)).alias("term"))
    if query_tf == "set":
        return rows.distinct().withColumn("qtf", F.lit(1).cast("long"))
    if query_tf != "multiset":
        raise ValueError("query_tf must be multiset or set")
    return rows.groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))


#: Most rows of question terms that are broadcast; they do not grow with the corpus, and beyond this they are joined otherwise.
FEW_TERMS = 1 << 18
#: A token that no text has: a unit's row of itself.
_UNIT = "\x00"


def bm25(units: DataFrame, terms: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """Scores of the units (unit, toks, dl) that share a term with a question, for terms (qid, term, qtf).

    Units are tokenised once. Tokens meet the questions' vocabulary before
    anything is shuffled; the shuffle by unit then serves the counts of terms,
    the statistics, the document frequencies and the sums of scores alike.
    """
    vocabulary = terms.select("term").distinct()
    few = terms.count() <= FEW_TERMS
    small = F.broadcast if few else (lambda df: df)
    own = terms.sparkSession.createDataFrame([(_UNIT,)], "term string")
    found = units.select("unit", "dl", F.explode(F.concat(F.array(F.lit(_UNIT)), "toks")).alias("term"))
    found = found.join(small(vocabulary.unionByName(own)), "term", "left_semi").repartition("unit")
    posts = found.groupBy("unit", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))
    stats = posts.where(F.col("term") == _UNIT).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))
    freq = index.document_frequency(posts.where(F.col("term") != _UNIT))
    weights = terms.join(freq, "term").crossJoin(F.broadcast(stats))  # statistics are one row
    weights = weights.select("term", "qid", "avgdl", (F.col("qtf") * index.idf(F.col("n"), F.col("df"))).alias("w"))
    scored = posts.join(small(weights), "term")
    ratio = F.when(F.col("avgdl") > 0, F.col("dl") / F.col("avgdl")).otherwise(F.lit(0.0))
    part = F.col("w") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * ratio))
    return scored.groupBy("qid", "unit").agg(F.sum(part).alias("score"))


def topped(scores: DataFrame, questions: DataFrame, units: DataFrame, k: int, order: str = "unit") -> DataFrame:
    """The first k of the ranking in which every unit has a score, 0 where nothing matched: (qid, unit, score, rank).

    Of the units that match nothing only the first ones in order can be among
    them, as many as a question has matches too few; the first 2 k units hold
    them. So nothing is paired but the questions that fall short and 2 k units.
    """
    best = ranked(scores, k=k).select("qid", "unit", "score")
    short = questions.select("qid").distinct().join(best.groupBy("qid").agg(F.count(F.lit(1)).alias("have")), "qid", "left").where(F.coalesce("have", F.lit(0)) < k)
    early = units.select("unit").orderBy(order).limit(2 * k)
    fill = short.select("qid").crossJoin(F.broadcast(early)).join(best.select("qid", "unit"), ["qid", "unit"], "left_anti")
    return ranked(best.unionByName(fill.select("qid", "unit", F.lit(0.0).alias("score"))), k=k)


def completed(scores: DataFrame, questions: DataFrame, units: DataFrame) -> DataFrame:
    """Scores of every question and unit, 0 where nothing matched. Of |questions| x |units| rows: for rankings of whole small corpora."""
    every = questions.select("qid").distinct().crossJoin(units.select("unit"))
    return every.join(scores, ["qid", "unit"], "left").select("qid", "unit", F.coalesce("score", F.lit(0.0)).alias("score"))


def ranked(scores: DataFrame, *order: str | Column, k: int | None = None, places: int = 9) -> DataFrame:
    """Adds rank, from 1; with k only the first k, which Spark limits before the shuffle."""
    if k is not None and k < 1:
        raise ValueError("top_k must be positive")
    by = Window.partitionBy("qid").orderBy(F.round("score", places).desc(), *(order or ("unit",)))
    out = scores.withColumn("rank", F.row_number().over(by))
    return out if k is None else out.where(F.col("rank") <= k)


def max_pool(scores: DataFrame, parents: DataFrame) -> DataFrame:
    """Scores of the parents (unit, parent) of units: the greatest, 0 at least."""
    pooled = scores.join(parents, "unit").groupBy("qid", "parent").agg(F.max("score").alias("score"))
    return pooled.select("qid", F.col("parent").alias("unit"), F.greatest("score", F.lit(0.0)).alias("score"))


def named_document(questions: DataFrame, id_col: str, text_col: str, names: DataFrame) -> DataFrame:
    """(qid, named): the longest of the names (name) that a question contains, white space aside.

    A question's parts of the lengths that names have meet the names by equality.
    """
    n = names.select("name", T.no_space("name").alias("key")).where("key <> ''")
    sizes = [r[0] for r in n.select(F.char_length("key")).distinct().collect()]  # lengths of names
    if not sizes:
        return questions.select(F.col(id_col).alias("qid"), F.lit(None).cast("string").alias("named")).where("false")
    q = questions.select(F.col(id_col).alias("qid"), T.no_space(text_col).alias("q"))
    parts = q.select("qid", F.explode(F.array_distinct(F.concat(*[T.grams("q", size) for size in sorted(sizes)]))).alias("key"))
    return parts.join(n, "key").groupBy("qid").agg(F.max_by("name", F.struct(F.char_length("name"), "name")).alias("named"))


def boosted(scores: DataFrame, docs_of: DataFrame, named: DataFrame, boost: float = 0.5, k: int = CUTOFF) -> DataFrame:
    """The first k with boost times the spread of a question's scores added to the units (unit, doc) of the document that it names.

    scores has the units that match; all others score 0, and of these only the
    first ones in order, of the named document and of all, can be among the first k.
    """
    n = docs_of.agg(F.count(F.lit(1)).alias("units"))
    spread = scores.groupBy("qid").agg(F.max("score").alias("hi"), F.min("score").alias("lo"), F.count(F.lit(1)).alias("have")).crossJoin(F.broadcast(n))
    spread = spread.select("qid", (F.col("hi") - F.when(F.col("have") < F.col("units"), F.least("lo", F.lit(0.0))).otherwise(F.col("lo"))).alias("spread"))
    asked = spread.join(named, "qid", "left")
    own = scores.join(docs_of, "unit").join(asked, "qid")
    bonus = F.when(F.col("doc") == F.col("named"), boost * F.col("spread")).otherwise(F.lit(0.0))
    best = ranked(own.select("qid", "unit", (F.col("score") + bonus).alias("score")), k=2 * k).select("qid", "unit", "score")
    early = docs_of.withColumn("i", F.row_number().over(Window.partitionBy("doc").orderBy("unit"))).where(F.col("i") <= 2 * k)
    fill = asked.join(early, F.col("named") == F.col("doc")).select("qid", "unit", (boost * F.col("spread")).alias("score"))
    first = asked.crossJoin(F.broadcast(docs_of.orderBy("unit").limit(2 * k))).where(~F.coalesce(F.col("doc") == F.col("named"), F.lit(False))).select("qid", "unit", F.lit(0.0).alias("score"))
    fill = fill.unionByName(first).join(scores.select("qid", "unit"), ["qid", "unit"], "left_anti")
    return ranked(best.unionByName(fill), k=k)


#: Most items whose words every document is looked through for at once.
FEW_ITEMS = 1 << 12


def holding(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str, part_col: str) -> DataFrame:
    """(qid, unit): the documents whose text holds an item's text.

    A text that holds another one also holds, between spaces, each of its words
    but the first and the last. Items meet documents by the longest of these,
    and the pairs are checked: of few items where the document is read, so that no
    text is shuffled. Items of one or two words have none and meet all.
    """
    inner = lambda c: F.slice(F.split(c, " "), F.lit(2), F.greatest(F.size(F.split(c, " ")) - 2, F.lit(0)))
    q = items.select(F.col(item_col).alias("qid"), F.col(part_col).alias("part"))
    longest = F.array_max(F.transform(inner(F.col("part")), lambda w: F.struct(F.char_length(w).alias("n"), w.alias("w"))))
    q = q.withColumn("word", F.nullif(longest["w"], F.lit("")))
    d = docs.select(F.col(id_col).alias("unit"), F.col(text_col).alias("text"))
    named = q.where("word IS NOT NULL").select("word", "qid", "part")
    if q.count() <= FEW_ITEMS:
        asked = named.agg(F.collect_set("word").alias("asked"))
        words = d.crossJoin(F.broadcast(asked)).select("unit", "text", F.explode(F.array_intersect(F.split("text", " "), "asked")).alias("word"))
        near = words.join(F.broadcast(named), "word").where(F.contains("text", "part")).select("qid", "unit")
    else:
        words = d.select("unit", F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
        pairs = words.join(named.select("word", "qid"), "word").select("qid", "unit")
        near = pairs.join(d, "unit").join(named.select("qid", "part"), "qid").where(F.contains("text", "part")).select("qid", "unit")
    bare = q.where("word IS NULL").select("qid", "part")
    return near.unionByName(d.join(bare, F.contains("text", "part")).select("qid", "unit"))


def dot(a: T.Text, b: T.Text) -> Column:
    double = "array<double>"
    return F.aggregate(F.zip_with(T.col(a).cast(double), T.col(b).cast(double), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def dense(queries: DataFrame, vectors: DataFrame, same: bool = False) -> DataFrame:
    """Scores of every query (qid, q) and vector (unit, v) by dot product; pairs of one id only if asked for.

    Queries are a stated set; all vectors pass by them. Spark broadcasts the side
    that it finds small and else pairs partitions.
    """
    pairs = vectors.crossJoin(queries)
    if not same:
        pairs = pairs.where("qid <> unit")
    return pairs.select("qid", "unit", dot("q", "v").alias("score"))


def confidence(ranks: DataFrame, k: int = 10) -> DataFrame:
    """(qid, confidence): how far a ranking's first score is above the middle one of the next k, from 0 to 1."""
    top = F.max(F.when(F.col("rank") == 1, F.col("score")))
    tail = F.array_sort(F.collect_list(F.when((F.col("rank") > 1) & (F.col("rank") <= k + 1), F.col("score"))))
    rows = ranks.where(F.col("rank") <= k + 1).groupBy("qid").agg(top.alias("top"), tail.alias("tail"))
    mid = F.element_at("tail", F.floor(F.size("tail") / 2).cast("int") + 1)
    value = F.when((F.size("tail") == 0) | (F.col("top") <= 0), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("top") - mid) / F.col("top"))))
    return rows.select("qid", value.alias("confidence"))


def weights_of(conf: DataFrame, strength: float = 0.6) -> DataFrame:
    """(qid, w) from (qid, confidence)."""
    return conf.select("qid", (1.0 + strength * F.col("confidence")).alias("w"))


def fused(rankings: Sequence[tuple[DataFrame, float | DataFrame]], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of rankings (qid, unit, rank), each with a weight or a table (qid, w).

    Also first: the earliest list and rank that a unit comes from, by which pooled lists break ties.
    """
    parts = []
    for i, (ranks, weight) in enumerate(rankings):
        rows = ranks.select("qid", "unit", "rank")
        rows = rows.withColumn("w", F.lit(float(weight))) if isinstance(weight, int | float) else rows.join(weight, "qid")
        parts.append(rows.select("qid", "unit", (F.col("w") / (k + F.col("rank"))).alias("score"), F.struct(F.lit(i).alias("list"), "rank").alias("first")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("qid", "unit").agg(F.sum("score").alias("score"), F.min("first").alias("first"))


def fusion_depth(k: int, rrf_k: int = RRF_K, spread: float = 1.6) -> int:
    """How far two rankings have to be known for the first k of their fusion to be certain.

    ``spread`` is the greatest ratio of the second list's weight to the first one's.
    The first list ranks all units, so its first k have w / (rrf_k + k) at least;
    what is in neither list up to a depth has less than w * (1 + spread) / (rrf_k + depth).
    """
    return math.floor((rrf_k + k) * (1 + spread)) - rrf_k + 1


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, so that it is not computed again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def first_refs(c: T.Text, k: int = CUTOFF) -> Column:
    """References without repeats, in order, k at most."""
    return F.slice(F.array_distinct(T.col(c)), 1, k)


class Retriever:
    """Search over a corpus (ord, doc, article_no, title, text), for batches of questions (qid, question).

    What a batch asks of the corpus's texts is counted once per granularity,
    tokeniser and kind of query weights. Vectors are a table (unit, v) of the
    corpus and (qid, q) of the questions.
    """

    def __init__(self, corpus: DataFrame, vectors: DataFrame | None = None, question_vectors: DataFrame | None = None, pool: int = POOL):
        self.corpus, self.vectors, self.question_vectors, self.pool = corpus, vectors, question_vectors, pool
        self._scans: list[tuple[tuple, DataFrame, object]] = []
        self.checked, self.failure = False, ""

    def units(self, granularity: str, tokeniser: str) -> DataFrame:
        """(unit, toks, dl): rows of the corpus's ords, one per article or clause."""
        return index.tokenised(chunking.units(self.corpus, granularity), "ord", "unit_text", tokeniser)

    def lexical(self, questions: DataFrame, top_k: int, granularity: str = "article", tokeniser: str = "word", query_tf: str = "set") -> DataFrame:
        from .lexical import Scan  # which needs this module

        key = (granularity, tokeniser, query_tf)
        for known, asked, scan in self._scans:
            if known == key and asked.sameSemantics(questions):
                return scan.top(top_k, zeros=True)
        terms = question_terms(questions, "qid", "question", tokeniser, query_tf)
        self._scans.append((key, questions, Scan(self.units(granularity, tokeniser), terms, questions)))
        return self._scans[-1][2].top(top_k, zeros=True)

    def by_vectors(self, top_k: int) -> DataFrame:
        from . import similarity  # which needs this module

        if self.vectors is None or self.question_vectors is None:
            raise ValueError("no vectors")
        return similarity.top(self.question_vectors, self.vectors, top_k, same=True)

    def search(self, questions: DataFrame, top_k: int = CUTOFF, mode: str = "rrf", granularity: str = "article", tokeniser: str = "word", dense_weight: float = 1.0) -> DataFrame:
        """(qid, doc, article_no, score, rank). Without vectors, or once their making has failed, every mode is lexical."""
        if top_k < 1:
            raise ValueError("top_k must be positive")
        if mode not in ("bm25", "dense", "rrf"):
            raise ValueError("mode must be one of: bm25, dense, rrf")
        near = None if mode == "bm25" else self.checked_vectors(top_k if mode == "dense" else self.pool)
        if near is None:
            best = self.lexical(questions, top_k, granularity, tokeniser)
        elif mode == "dense":
            best = near
        else:
            lists = [(self.lexical(questions, self.pool, granularity, tokeniser), 1.0), (near, dense_weight)]
            best = ranked(fused(lists), "first", k=top_k)
        names = self.corpus.select(F.col("ord").alias("unit"), "doc", "article_no")
        return best.join(names, "unit").select("qid", "doc", "article_no", "score", "rank")

    def checked_vectors(self, top_k: int) -> DataFrame | None:
        """by_vectors, or None if there are none. An encoder that fails, which only reading its vectors shows, is given up for good."""
        if self.vectors is None or self.question_vectors is None:
            return None
        if not self.checked:
            try:
                self.question_vectors, self.vectors = self.question_vectors.cache(), self.vectors.cache()
                self.question_vectors.count(), self.vectors.count()
                self.checked = True
            except Exception as e:  # noqa: BLE001  whatever a model raises
                self.failure, self.vectors, self.question_vectors = str(e), None, None
                return None
        return self.by_vectors(top_k)


def reranked(candidates: DataFrame, score: Column, k: int = CUTOFF) -> DataFrame:
    """Candidates (qid, unit, rank, ...) in the order of another score, a Column or a pandas UDF's; ties keep the old order."""
    rows = candidates.withColumnRenamed("rank", "old_rank").withColumn("score", score)
    return ranked(rows, "old_rank", k=k)
