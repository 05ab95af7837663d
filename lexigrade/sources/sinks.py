"""Sinks: results, details, submissions, corpora, and the judge's cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def json_lines_of(rows: DataFrame, order: str, head: Column, tail: Column) -> DataFrame:
    """(part, key, value): the lines of one JSON object whose list has a row to a line; head and tail are what stands around the list.

    The first row by order and text is a line of its own; all others, and the
    rows that are like it, have a comma before them. No row holds the list.
    """
    made = rows.select(F.col(order).alias("key"), F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))
    first = made.agg(F.min(F.struct("key", "value")).alias("first"))  # one row
    marked = made.crossJoin(F.broadcast(first)).withColumn("same", F.struct("key", "value") == F.col("first"))
    same = F.coalesce("same", F.struct("key", "value").eqNullSafe(F.col("first")))
    alike = marked.where(same).agg(F.count(F.lit(1)).cast("int").alias("n"), F.first("first").alias("x"))
    ends = [F.struct(F.lit(0).alias("part"), F.lit(None).cast(made.schema["key"].dataType).alias("key"), head.alias("value"))]
    ends.append(F.struct(F.lit(4).alias("part"), F.lit(None).cast(made.schema["key"].dataType).alias("key"), tail.alias("value")))
    around = alike.select(F.explode(F.array(*ends)).alias("y")).select("y.*")
    own = alike.where("n > 0").select(F.lit(1).alias("part"), "x.key", "x.value")
    again = alike.where("n > 1").select("x", F.explode(F.sequence(F.lit(2), "n"))).select(F.lit(2).alias("part"), "x.key", F.concat(F.lit(","), "x.value").alias("value"))
    body = marked.where(~same).select(F.lit(3).alias("part"), "key", F.concat(F.lit(","), "value").alias("value"))
    return around.unionByName(own).unionByName(again).unionByName(body)


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines (part, key, value) as text files that, one after another by name, are the object: each task writes a range of the sorted lines."""
    lines.orderBy("part", "key", "value").select("value").write.mode("overwrite").text(path)


def results_lines(results: DataFrame) -> DataFrame:
    """The lines of an object with all results (blind_id, total, status), by id."""
    return json_lines_of(results.select("blind_id", "total", "status"), "blind_id", F.lit('{"results":['), F.lit("]}"))


def write_results(results: DataFrame, path: str) -> None:
    write_lines(results_lines(results), path)


def write_details(details: DataFrame, path: str, key: str = "blind_id") -> None:
    """Per-question rows, a folder per candidate."""
    details.write.mode("overwrite").partitionBy(key).json(path)


def submission_lines(team: Column, answers: DataFrame, meta: Column) -> DataFrame:
    """The lines of an object with team, answers (qid, answer, retrieved, error) and meta. team and meta are literals."""
    whole = F.to_json(F.struct(team.alias("team"), meta.alias("meta")))
    head = F.concat(F.regexp_replace(F.to_json(F.struct(team.alias("team"))), r"\}$", ""), F.lit(',"answers":['))
    tail = F.concat(F.lit('],"meta":'), F.get_json_object(whole, "$.meta"), F.lit("}"))
    return json_lines_of(answers.select("qid", "answer", "retrieved", "error"), "qid", head, tail)


def write_submission(team: Column, answers: DataFrame, meta: Column, path: str) -> None:
    write_lines(submission_lines(team, answers, meta), path)


def write_corpus(articles: DataFrame, path: str, doc: str = "doc") -> None:
    articles.write.mode("overwrite").partitionBy(doc).parquet(path)


class JudgeCache:
    """Judged axes by (blind_id, qid) in a Parquet folder: only pairs that are not there are asked again.

    Appends are atomic per job, so a run that stops goes on where it stopped.
    """

    SCHEMA = "blind_id string, qid string, accuracy double, grounding double, completeness double, clarity double"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], self.SCHEMA)

    def pending(self, asked: DataFrame) -> DataFrame:
        return asked.join(self.rows().select("blind_id", "qid"), ["blind_id", "qid"], "left_anti")

    def add(self, axes: DataFrame) -> None:
        axes.select("blind_id", "qid", "accuracy", "grounding", "completeness", "clarity").write.mode("append").parquet(self.path)
