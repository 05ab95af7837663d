"""Readers: gold sets, answers, articles and raw sources.

Files are read whole where their structure decides what they are; values that
may be of several shapes stay JSON text until an operator parses them.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def whole_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, raw): a row per file."""
    return spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def json_list(spark: SparkSession, path: str) -> DataFrame:
    """The objects of a file that is one JSON list; anything else is an error."""
    raw = whole_files(spark, path)
    items = F.from_json("raw", "array<string>")
    checked = F.when(items.isNotNull() & F.trim("raw").startswith("["), items).otherwise(F.raise_error(F.lit("a JSON list is expected")).cast("array<string>"))
    return raw.select("path", F.posexplode(checked).alias("ord", "item"))


def listed_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of an object's list that has a row to a line, as the sinks write it; files may be as many and as large as they are."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"^,?\{.*\}$"))
    return lines.select(F.from_json(F.regexp_replace("value", "^,", ""), schema).alias("x")).select("x.*")


def around_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row: what stands around that list, which is empty here."""
    ends = spark.read.text(path).where(~F.col("value").rlike(r"^,?\{.*\}$"))  # two lines
    whole = ends.agg(F.array_join(F.sort_array(F.collect_list(F.struct(F.col("value").startswith("]").alias("k"), "value")))["value"], "").alias("raw"))
    return whole.select(F.from_json("raw", schema).alias("x")).select("x.*")


def _kind(raw: Column) -> Column:
    """What a file is, by its structure: gold, answers, terms, or null."""
    is_object = F.trim(raw).startswith("{")
    first = F.get_json_object(raw, "$[0]")
    has = lambda c, k: F.get_json_object(c, f"$.{k}").isNotNull()
    terms = has(first, "article") & (has(first, "document") | has(first, "doc"))
    return (
        F.when(is_object & has(raw, "questions"), "gold").when(is_object & has(raw, "answers"), "answers")
        .when(~is_object & terms, "terms").when(~is_object & has(first, "key_facts"), "gold")
    )


def classified(files: DataFrame) -> DataFrame:
    """files (path, raw) with kind; files that are no JSON or of no known structure go."""
    ok = F.try_parse_json("raw").isNotNull()
    return files.where(ok).withColumn("kind", _kind(F.col("raw"))).where("kind IS NOT NULL")


def checked_uploads(files: DataFrame) -> DataFrame:
    """classified, and an error unless there are one gold file and some answers."""
    rows = classified(files)
    n = rows.agg(F.sum((F.col("kind") == "gold").cast("int")).alias("g"), F.sum((F.col("kind") == "answers").cast("int")).alias("a")).first()
    if n["g"] != 1 or not n["a"]:
        raise ValueError(f"one gold file and at least one answers file are expected, found {n['g'] or 0} and {n['a'] or 0}")
    return rows


_QUESTION = "array<struct<id:string,qid:string,question:string,q:string,ptype:string,difficulty:string,gold_articles:array<struct<doc:string,article:string,citation:string>>,gold:array<array<string>>,key_facts:array<string>,keyfacts:array<string>,facts:array<string>>>"


def questions(files: DataFrame, strict: bool = True) -> DataFrame:
    """(qid, question, ptype, difficulty, gold, key_facts) of gold files (path, raw), in all accepted spellings.

    Files hold ``questions`` or are a bare list. strict: a missing or repeated id
    is an error. Otherwise the last of repeated ids stays and empty facts go.
    """
    raw = F.col("raw")
    body = F.when(F.trim(raw).startswith("{"), F.get_json_object(raw, "$.questions")).otherwise(raw)
    rows = files.select("path", F.posexplode(F.from_json(body, _QUESTION)).alias("ord", "x"))
    pairs = F.transform("x.gold", lambda g: F.struct(F.get(g, F.lit(0)).alias("doc"), F.get(g, F.lit(1)).alias("article"), F.lit(None).cast("string").alias("citation")))
    out = rows.select(
        "ord", F.coalesce("x.qid", "x.id").alias("qid"), F.coalesce("x.question", "x.q", F.lit("")).alias("question"), F.col("x.ptype").alias("ptype"), F.col("x.difficulty").alias("difficulty"),
        F.coalesce("x.gold_articles", pairs, F.array()).alias("gold"), F.coalesce("x.key_facts", "x.keyfacts", "x.facts", F.array()).alias("key_facts"),
    )
    if strict:
        bad = out.groupBy("qid").count().where("qid IS NULL OR count > 1").select("qid").limit(5).collect()
        if bad:
            raise ValueError(f"question ids are missing or repeated: {[r['qid'] for r in bad]}")
        return out.drop("ord")
    out = out.where("qid IS NOT NULL").withColumn("key_facts", F.filter("key_facts", lambda f: f.isNotNull() & (f != "")))
    last = out.groupBy("qid").agg(F.max_by(F.struct("question", "ptype", "difficulty", "gold", "key_facts"), "ord").alias("x")).select("qid", "x.*")
    if last.isEmpty():
        raise ValueError("no questions")
    return last


_ANSWER = "array<struct<qid:string,id:string,answer:string,text:string,retrieved:array<string>,error:string>>"


def answers(files: DataFrame, style: str = "final") -> DataFrame:
    """(blind_id, qid, answer, retrieved, ord) of answer files (path, raw).

    retrieved holds JSON texts. final: the first of repeated qids stays; dev: the
    last, and id and text are accepted for qid and answer.
    """
    raw = F.col("raw")
    body = F.when(F.trim(raw).startswith("{"), F.get_json_object(raw, "$.answers")).otherwise(raw)
    rows = files.select(blind_id(F.col("path"), raw, style).alias("blind_id"), F.posexplode(F.from_json(body, _ANSWER)).alias("ord", "x"))
    if style == "dev":
        qid, answer = F.coalesce(F.nullif("x.qid", F.lit("")), "x.id"), F.coalesce(F.nullif("x.answer", F.lit("")), "x.text", F.lit(""))
    else:
        qid, answer = F.col("x.qid"), F.coalesce("x.answer", F.lit(""))
    rows = rows.select("blind_id", qid.alias("qid"), answer.alias("answer"), F.coalesce("x.retrieved", F.array().cast("array<string>")).alias("retrieved"), "ord").where("qid IS NOT NULL AND qid <> ''")
    pick = F.max_by if style == "dev" else F.min_by
    return rows.groupBy("blind_id", "qid").agg(pick(F.struct("answer", "retrieved", "ord"), "ord").alias("x")).select("blind_id", "qid", "x.answer", "x.retrieved", "x.ord")


def file_name(path: Column) -> Column:
    return F.url_decode(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\+", "%2B"))


def blind_id(path: Column, raw: Column, style: str = "final") -> Column:
    """A candidate's id. final: field, meta, file name (two digits at least), team, stem. dev: the file name first, as it is."""
    name = file_name(path)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    field = lambda k: F.nullif(F.trim(F.get_json_object(raw, f"$.{k}")), F.lit(""))
    if style == "dev":
        in_name = F.nullif(F.upper(F.regexp_extract(name, "(?i)(BLIND[0-9]+)", 1)), F.lit(""))
        return F.coalesce(in_name, field("blind_id"), field("blindId"), field("id"), field("team"), stem)
    digits = F.nullif(F.regexp_extract(name, r"(?i)BLIND[\t-\r ]*0*([0-9]+)", 1), F.lit(""))
    numbered = F.concat(F.lit("BLIND"), F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits))
    given = [F.upper(field(k)) for k in ("blind_id", "blindId", "meta.blind_id", "meta.blindId")]
    return F.coalesce(*given, numbered, field("team"), stem)


def team_problem(c: T.Text, numeric: bool = True, most: int = 32, allowed: str = "0-9A-Za-z_-") -> Column:
    """What is wrong with a team's identifier, or null."""
    team = F.trim(F.coalesce(T.col(c), F.lit("")))
    out = F.when(team == "", "empty")
    if numeric:
        out = out.when(~team.rlike("^[1-9][0-9]*$"), "not a number")
    return out.when(F.char_length(team) > most, "too long").when(~team.rlike(f"^[가-힣{allowed}]+$"), "character")


def terms(files: DataFrame) -> DataFrame:
    """(doc, article, text) of article files: a list, or an object with articles or terms; rows that lack a part go."""
    raw = F.col("raw")
    body = F.when(F.trim(raw).startswith("["), raw).otherwise(F.coalesce(F.get_json_object(raw, "$.articles"), F.get_json_object(raw, "$.terms")))
    rows = files.select(F.explode(F.from_json(body, "array<struct<document:string,doc:string,article:string,article_no:string,title:string,text:string,content:string>>")).alias("x"))
    out = rows.select(F.trim(F.coalesce("x.document", "x.doc")).alias("doc"), T.first_number(F.coalesce("x.article", "x.article_no")).alias("article"), F.coalesce(F.nullif("x.text", F.lit("")), "x.content").alias("text"))
    return out.where("doc <> '' AND article IS NOT NULL AND text <> ''")


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def named(files: DataFrame) -> DataFrame:
    """(doc, text) of text files (path, raw), each named by its stem."""
    return files.select(stem(F.col("path")).alias("doc"), F.col("raw").alias("text"))


def markdown(spark: SparkSession, *paths: str) -> DataFrame:
    """(doc, text): a row per file, named by its stem."""
    return named(whole_files(spark, *paths))


def html_texts(files: DataFrame) -> DataFrame:
    """(doc, title, text) of HTML files (path, raw): the page's title, and its text by cleaned lines."""
    title = F.regexp_extract("raw", r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)
    return files.select(stem(F.col("path")).alias("doc"), T.one_line(title).alias("title"), T.clean_lines(T.strip_html("raw")).alias("text"))


def docx(spark: SparkSession, *paths: str) -> DataFrame:
    """docx_texts of the Word files in some paths."""
    return docx_texts(spark.read.format("binaryFile").load(list(paths)).select("path", "content"))


def docx_texts(files: DataFrame) -> DataFrame:
    """(doc, text) of Word files (path, content): paragraphs end lines, tabs are spaces, other tags go. Unpacking needs Python; a row is a file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    out.append((path, z.read("word/document.xml").decode("utf-8")))
            yield pd.DataFrame(out, columns=["path", "xml"])

    xml = F.regexp_replace("xml", r"</w:p\s*>", "\n")
    text = T.unescape(F.regexp_replace(F.regexp_replace(xml, r"<w:tab\s*/?>", " "), "<[^>]+>", ""))
    return files.select("path", "content").mapInPandas(run, "path string, xml string").select(stem(F.col("path")).alias("doc"), text.alias("text"))


def page_text(c: T.Text) -> Column:
    """Text that an external tool took from a PDF, without the lines that are page numbers."""
    return F.array_join(F.filter(F.split(T.col(c), "\n"), lambda x: ~x.rlike(r"^[\t-\r ]*[0-9]+[\t-\r ]*$")), "\n")


def blob_text(c: T.Text) -> Column:
    """The text in a base64 gzip blob. Base64 is the JVM's; gzip needs Python."""

    @F.pandas_udf("string")
    def unzip(s: pd.Series) -> pd.Series:
        import gzip

        return s.map(lambda b: None if b is None else gzip.decompress(bytes(b)).decode("utf-8"))

    return unzip(F.unbase64(T.col(c)))


def blob(c: T.Text) -> Column:
    """A text as a base64 gzip blob whose bytes depend on the text alone."""

    @F.pandas_udf("binary")
    def zipped(s: pd.Series) -> pd.Series:
        import gzip

        return s.map(lambda t: None if t is None else gzip.compress(t.encode("utf-8"), mtime=0))

    return F.regexp_replace(F.base64(zipped(T.col(c))), "[\r\n]", "")
