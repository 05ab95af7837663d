"""Queries of the readers and sinks: files are made from table rows, read or written, and told by their rows."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality
from ..sources import readers, sinks
from ..sources.shared import shared_path
from .base import sql_one_line, sql_unescape, table
from .text_queries import _SQL_STRIP

QUERIES, ORACLES = {}, {}


def _add(name: str, query: object, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


# ---------------------------------------------------------------- gold sets and answers

_FACTS = "array_append(split(text, '\\\\. '), '')"
#: A question in one of two spellings.
_SPELL = f"""CASE WHEN item_id % 2 = 0
  THEN to_json(named_struct('id', cast(item_id AS string), 'question', text, 'ptype', 'basic', 'key_facts', {_FACTS}, 'gold_articles', array(named_struct('doc', 'd', 'article', item_id), named_struct('doc', 'e', 'article', 1))))
  ELSE to_json(named_struct('qid', cast(item_id AS string), 'q', text, 'keyfacts', {_FACTS}, 'gold', array(array('d', cast(item_id AS string))))) END"""


def gold_file(spark: SparkSession, sf: str, again: bool = False, bare: bool = False) -> DataFrame:
    """(path, raw): all benchmark items as one gold file; with ``again`` every fifth one is there twice."""
    items = table(spark, sf, "benchmark").withColumn("k", F.lit(0))
    if again:
        items = items.unionByName(items.where("item_id % 5 = 0").withColumns({"k": F.lit(1), "text": F.concat(F.lit("again "), "text")}))
    rows = items.select("k", "item_id", F.expr(_SPELL).alias("json")).agg(F.array_sort(F.collect_list(F.struct("k", "item_id", "json"))).alias("r"))  # a gold file is small
    body = F.concat(F.lit("["), F.array_join(F.transform("r", lambda x: x["json"]), ","), F.lit("]"))
    return rows.select(F.lit("/x/gold.json").alias("path"), (body if bare else F.concat(F.lit('{"questions":'), body, F.lit("}"))).alias("raw"))


def _questions(df: DataFrame) -> DataFrame:
    return df.select("qid", "question", "ptype", F.size("key_facts").alias("n_facts"), F.size("gold").alias("n_gold"), F.col("gold")[0]["article"].alias("article"))


_SQL_ITEM = "CAST(item_id AS VARCHAR) AS qid, {q} AS question, CASE WHEN item_id % 2 = 0 THEN 'basic' END AS ptype, CAST({n} AS INT) AS n_facts, CASE WHEN item_id % 2 = 0 THEN 2 ELSE 1 END AS n_gold, CAST(item_id AS VARCHAR) AS article FROM benchmark"
_SQL_AGAIN = "CASE WHEN item_id % 5 = 0 THEN 'again ' || text ELSE text END"
_add(
    "a1_gold_dev",
    lambda s, d: _questions(readers.questions(gold_file(s, d, again=True), strict=False)),
    "SELECT " + _SQL_ITEM.format(q=_SQL_AGAIN, n=f"len(list_filter(string_split({_SQL_AGAIN}, '. '), lambda x: x <> ''))"),
)
_add("a2_gold_final", lambda s, d: _questions(readers.questions(gold_file(s, d))), "SELECT " + _SQL_ITEM.format(q="text", n="len(string_split(text, '. ')) + 1"))


def a22_question_loaders(spark: SparkSession, sf: str) -> DataFrame:
    """Two sets of questions in different shapes as one table."""
    first, second = gold_file(spark, sf), gold_file(spark, sf, bare=True)
    both = readers.questions(first).withColumn("kind", F.lit("public")).unionByName(readers.questions(second).withColumn("kind", F.lit("validation")))
    return both.select("kind", F.col("qid").alias("id"), F.col("question").alias("q"), F.transform("gold", lambda g: F.concat_ws(":", g["doc"], g["article"])).alias("g")).select("kind", "id", "q", F.array_join("g", ",").alias("gold"))


_add(
    "a22_question_loaders",
    a22_question_loaders,
    "SELECT kind, CAST(item_id AS VARCHAR) AS id, text AS q, CASE WHEN item_id % 2 = 0 THEN 'd:' || item_id || ',e:1' ELSE 'd:' || item_id END AS gold FROM benchmark, (VALUES ('public'), ('validation')) v(kind)",
)

#: Raw files by document: of four structures, of none, and no JSON at all.
_RAW = """CASE doc_id % 7
  WHEN 0 THEN '{"questions":[{"id":"' || doc_id || '"}]}' WHEN 1 THEN ' {"team":"' || source || '","answers":[]}' WHEN 2 THEN '[{"doc":"' || source || '","article":' || doc_id || '}]'
  WHEN 3 THEN '[{"document":"x","title":"no number"}]' WHEN 4 THEN '[{"key_facts":["' || lang || '"]}]' WHEN 5 THEN '{"questions":[' ELSE '{"other":' || doc_id || '}' END"""


def uploads(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.concat(F.lit("/x/"), F.col("doc_id").cast("string"), F.lit(".json")).alias("path"), F.expr(_RAW).alias("raw"))


_SQL_KIND = f"""WITH r AS (SELECT '/x/' || doc_id || '.json' AS path, {_RAW} AS raw FROM documents), j AS (SELECT path, raw, CASE WHEN json_valid(raw) THEN json(raw) END AS j FROM r),
    k AS (SELECT path, CASE WHEN json_type(j) = 'OBJECT' AND json_extract(j, '$.questions') IS NOT NULL THEN 'gold' WHEN json_type(j) = 'OBJECT' AND json_extract(j, '$.answers') IS NOT NULL THEN 'answers'
      WHEN json_type(j) = 'ARRAY' AND json_extract(j, '$[0].article') IS NOT NULL AND (json_extract(j, '$[0].document') IS NOT NULL OR json_extract(j, '$[0].doc') IS NOT NULL) THEN 'terms' WHEN json_type(j) = 'ARRAY' AND json_extract(j, '$[0].key_facts') IS NOT NULL THEN 'gold' END AS kind FROM j)
    SELECT path, kind FROM k WHERE kind IS NOT NULL"""
_add("a5_classified_uploads", lambda s, d: readers.classified(uploads(s, d)).select("path", "kind"), _SQL_KIND)


def a6_checked_uploads(spark: SparkSession, sf: str) -> DataFrame:
    """All uploads but the gold ones, and one gold file: what is left after the check."""
    files = uploads(spark, sf).where(~F.col("raw").startswith('{"questions"') & ~F.contains("raw", F.lit("key_facts"))).unionByName(gold_file(spark, sf))
    return readers.checked_uploads(files).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


_add("a6_checked_uploads", a6_checked_uploads, f"SELECT kind, count(*) AS n FROM ({_SQL_KIND}) WHERE kind <> 'gold' GROUP BY kind UNION ALL SELECT 'gold', 1")


def a7_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Article files of both spellings, with rows that lack a part."""
    raw = "CASE doc_id % 3 WHEN 0 THEN to_json(array(named_struct('document', ' ' || source || ' ', 'article', '제' || doc_id || '조', 'text', text))) WHEN 1 THEN to_json(named_struct('articles', array(named_struct('doc', source, 'article_no', doc_id, 'content', text)))) ELSE to_json(named_struct('terms', array(named_struct('doc', source, 'article', 'none', 'text', text)))) END"
    files = table(spark, sf, "documents").select(F.lit("/x/t.json").alias("path"), F.expr(raw).alias("raw"))
    return readers.terms(files).select("doc", "article", F.md5(F.col("text").cast("binary")).alias("digest"))


_add("a7_terms", a7_terms, "SELECT trim(source) AS doc, CAST(doc_id AS INT) AS article, md5(text) AS digest FROM documents WHERE doc_id % 3 < 2 AND text <> '' AND trim(source) <> ''")


def a8_json_lines(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "lines")
    table(spark, sf, "documents").select("doc_id", "source", "text").write.json(path)
    rows = readers.json_lines(spark, path, "doc_id long, source string, text string")
    return rows.select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("digest"))


_add("a8_json_lines", a8_json_lines, "SELECT doc_id, source, md5(text) AS digest FROM documents")


def a23_corpus_list(spark: SparkSession, sf: str) -> DataFrame:
    """A corpus file that is one JSON list, written and read back."""
    path = shared_path(spark, "corpus")
    rows = table(spark, sf, "benchmark").select("item_id", "text")
    sinks.write_lines(sinks.json_lines_of(rows, "item_id", F.lit("["), F.lit("]")), path)
    return readers.listed_lines(spark, path, "item_id long, text string")


_add("a23_corpus_list", a23_corpus_list, "SELECT item_id, text FROM benchmark")


def a9_docx_text(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as Word files: lines are paragraphs, with tabs, other tags and references among them."""
    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        def one(text: str) -> bytes:
            body = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("\n", "</w:t></w:p><w:p><w:t>")
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as z:
                z.writestr("word/document.xml", f"<w:body><w:p><w:r><w:tab/><w:t>{body}</w:t></w:r></w:p ></w:body>")
            return out.getvalue()

        return texts.map(one)

    files = table(spark, sf, "documents").select(F.concat(F.lit("/x/"), F.col("doc_id").cast("string"), F.lit(".docx")).alias("path"), packed("text").alias("content"))
    return readers.docx_texts(files).select("doc", F.md5(F.col("text").cast("binary")).alias("digest"))


_add("a9_docx_text", a9_docx_text, "SELECT CAST(doc_id AS VARCHAR) AS doc, md5(' ' || text || chr(10)) AS digest FROM documents")


def a11_html_pages(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "pages").select(F.concat(F.lit("file:/x/a%20"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("raw"))
    return readers.html_texts(files).select("doc", "title", F.char_length("text").alias("n"), F.md5(F.col("text").cast("binary")).alias("digest"))


_add(
    "a11_html_pages",
    a11_html_pages,
    f"""WITH s AS (SELECT page_id, {sql_one_line("regexp_extract(html, '<title\\b[^>]*>(.*?)</title\\s*>', 1, 'si')")} AS title, {sql_unescape(_SQL_STRIP.format(x='html'))} AS t FROM pages),
    l AS (SELECT page_id, title, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: {sql_one_line('x')}), lambda x: x <> ''), chr(10)) AS t FROM s)
    SELECT 'a ' || page_id AS doc, title, CAST(length(t) AS INT) AS n, md5(t) AS digest FROM l""",
)
_add(
    "a12_documents",
    lambda s, d: readers.named(table(s, d, "documents").select(F.concat(F.lit("/corpus/v1.2/"), F.col("source"), F.lit("+"), F.col("doc_id").cast("string"), F.lit(".x.md")).alias("path"), F.col("text").alias("raw"))).select("doc", F.md5(F.col("text").cast("binary")).alias("digest")),
    "SELECT source || '+' || doc_id || '.x' AS doc, md5(text) AS digest FROM documents",
)

# ---------------------------------------------------------------- sinks

_TOTALS = "SELECT source AS blind_id, CASE WHEN count(*) % 2 = 0 THEN CAST(avg(doc_id % 100) AS DOUBLE) END AS total, CASE WHEN count(*) % 2 = 0 THEN 'completed' ELSE 'failed' END AS status FROM documents GROUP BY source"


def a14_results_sink(spark: SparkSession, sf: str) -> DataFrame:
    """What the results sink writes, read back from its JSON."""
    docs = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("doc_id") % 100).alias("t"))
    even, path = F.col("n") % 2 == 0, shared_path(spark, "results")
    sinks.write_results(docs.select(F.col("source").alias("blind_id"), F.when(even, F.col("t")).alias("total"), F.when(even, "completed").otherwise("failed").alias("status")), path)
    return readers.listed_lines(spark, path, "blind_id string, total double, status string")


_add("a14_results_sink", a14_results_sink, _TOTALS)


def a16_submission_sink(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("answer"), F.array(F.struct(F.lit("d").alias("doc"), F.col("item_id").alias("article"))).alias("retrieved"), F.lit(None).cast("string").alias("error"))
    path = shared_path(spark, "submission")
    sinks.write_submission(F.lit("7"), rows, F.struct(F.lit(3).alias("violations")), path)
    around = readers.around_lines(spark, path, "team string, meta struct<violations:int>")
    answers = readers.listed_lines(spark, path, "qid long, answer string, retrieved array<struct<doc:string,article:long>>")
    out = answers.crossJoin(F.broadcast(around))  # one row
    return out.select("team", "meta.violations", "qid", "answer", F.col("retrieved")[0]["article"].alias("article"))


_add("a16_submission_sink", a16_submission_sink, "SELECT '7' AS team, 3 AS violations, item_id AS qid, text AS answer, item_id AS article FROM benchmark")


def a15_detail_sink(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "details")
    sinks.write_details(table(spark, sf, "documents").select(F.col("source").alias("blind_id"), F.col("doc_id").alias("qid"), F.char_length("text").alias("chars")), path)
    return spark.read.schema("qid long, chars int, blind_id string").json(path).select("blind_id", "qid", "chars")


_add("a15_detail_sink", a15_detail_sink, "SELECT source AS blind_id, doc_id AS qid, CAST(length(text) AS INT) AS chars FROM documents")


def a17_corpus_sink(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "articles")
    sinks.write_corpus(table(spark, sf, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("article_no"), "text"), path)
    back = spark.read.schema("article_no long, text string, doc string").parquet(path)
    return quality.corpus_checks(back).select("doc", "n", "n_distinct", "lo", "hi", "blank")


_add("a17_corpus_sink", a17_corpus_sink, "SELECT source AS doc, count(*) AS n, count(DISTINCT doc_id) AS n_distinct, min(doc_id) AS lo, max(doc_id) AS hi, count(*) FILTER (trim(text) = '') AS blank FROM documents GROUP BY source")


def a18_pending_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs that the judge's cache still lacks, after the labelled documents were judged in two goes."""
    asked = table(spark, sf, "documents").select(F.col("source").alias("blind_id"), F.col("doc_id").cast("string").alias("qid"))
    judged = asked.join(table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("qid")).distinct(), "qid")
    axes = judged.select("blind_id", "qid", *[F.lit(5.0).alias(c) for c in ("accuracy", "grounding", "completeness", "clarity")])
    cache = sinks.JudgeCache(spark, shared_path(spark, "judged"))
    cache.add(axes.where("qid % 2 = 0"))
    cache.add(cache.pending(axes))
    return cache.pending(asked).select("blind_id", "qid")


_add("a18_judge_cache", a18_pending_pairs, "SELECT source AS blind_id, CAST(doc_id AS VARCHAR) AS qid FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")

# ---------------------------------------------------------------- constraints on files


def i5_count_guard(spark: SparkSession, sf: str) -> DataFrame:
    """All questions, as their number is the expected one; no number expects nothing."""
    items = table(spark, sf, "benchmark")
    return quality.require_count(items, items.count()).join(quality.require_count(items, None).select("item_id"), "item_id").select("item_id", F.char_length("text").alias("n"))


_add("i5_count_guard", i5_count_guard, "SELECT item_id, CAST(length(text) AS INT) AS n FROM benchmark")


def i17_spec_builders(spark: SparkSession, sf: str) -> DataFrame:
    """Questions of specs: a cross question's references begin with its owner, others default to it."""
    ref = lambda d, a: F.struct(d.alias("doc"), a.cast("int").alias("article"))
    items = table(spark, sf, "benchmark")
    one, other = ref(F.concat(F.lit("d"), F.col("item_id") % 3), F.col("item_id")), ref(F.lit("zz"), F.lit(0))
    cross = F.col("item_id") % 4 == 0
    specs = items.select(F.col("item_id").cast("int").alias("k"), one.alias("owner"), F.col("text").alias("question"), F.when(cross, "cross").otherwise("basic").alias("ptype"), F.lit("easy").alias("difficulty"), F.when(cross, F.array(other)).alias("gold"), F.split("text", r"\. ").alias("key_facts"))
    articles = items.select(F.concat(F.lit("d"), F.col("item_id") % 3).alias("doc"), F.col("item_id").cast("int").alias("article_no"), F.lit("t").alias("title"))
    out = quality.numbered(specs, "k", articles.unionByName(articles.limit(1).select(F.lit("zz").alias("doc"), F.lit(0).alias("article_no"), F.lit("z").alias("title"))).distinct())
    return out.select("id", "ptype", F.array_join(F.transform("gold_articles", lambda g: F.concat_ws(":", g["doc"], g["article"], g["citation"])), "|").alias("refs"), F.size("key_facts").alias("n_facts"))


_add(
    "i17_spec_builders",
    i17_spec_builders,
    """SELECT printf('S%03d', item_id) AS id, CASE WHEN item_id % 4 = 0 THEN 'cross' ELSE 'basic' END AS ptype,
    'd' || item_id % 3 || ':' || item_id || ':d' || item_id % 3 || ' 제' || item_id || '조(t)' || CASE WHEN item_id % 4 = 0 THEN '|zz:0:zz 제0조(z)' ELSE '' END AS refs, CAST(len(string_split(text, '. ')) AS INT) AS n_facts FROM benchmark""",
)
