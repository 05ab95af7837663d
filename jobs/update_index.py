"""Keeps a search index up to date with a growing folder of documents.

    spark-submit jobs/update_index.py --input documents/ --output index/ --checkpoint state/

The input is a folder of Parquet files, or a pattern of them. A file stream takes
those that its checkpoint has not seen, in batches of so many files, until none is
left. Each batch is tokenised and becomes a segment of
the index under the batch's number, so a batch that is repeated after a failure
replaces what it wrote. A document that an earlier segment has is not indexed
again; of rows of one id in a batch the one with the least text counts; rows
without an id are left out. Reruns with nothing new change nothing.

``search`` reads the index without the documents.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if __package__ in (None, ""):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from jobs.common import arguments, config_of, log, session
from lexigrade.operators import index, retrieval
from lexigrade.operators.segments import Segments


def segments_of(spark: SparkSession, output: str, settings: dict) -> Segments:
    return Segments(spark, output, "long", settings["buckets"])


def run(spark: SparkSession, source: str, output: str, checkpoint: str, settings: dict | None = None) -> DataFrame:
    """Indexes what is new in ``source`` and returns the segments (segment, units, length) as they are then."""
    settings = settings or config_of("update_index")
    found = segments_of(spark, output, settings)
    schema = spark.read.parquet(source).schema

    def take(rows: DataFrame, batch: int) -> None:
        one = rows.select(F.col(settings["id"]).cast("long").alias("unit"), F.coalesce(F.col(settings["text"]), F.lit("")).alias("text")).where("unit IS NOT NULL")
        one = one.groupBy("unit").agg(F.min("text").alias("text"))
        if batch > 0:
            one = one.join(found.units().where(F.col("segment") < batch).select("unit"), "unit", "left_anti")
        found.add(index.tokenised(one, "unit", "text", settings["tokeniser"]), batch)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", settings["files_per_batch"]).parquet(source)
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    for p in query.recentProgress:
        if p["numInputRows"]:
            log.info("batch %s: read %s rows of %s", p["batchId"], p["numInputRows"], source)
    now = found.segments()
    for r in now.agg(F.count(F.lit(1)).alias("n"), F.sum("units").alias("units"), F.sum("length").alias("length")).collect():
        log.info("index %s: %s segments, %s documents, %s tokens", output, r["n"], r["units"], r["length"])
    return now


def search(spark: SparkSession, output: str, questions: DataFrame, k: int = 4, settings: dict | None = None) -> DataFrame:
    """The first k documents (qid, unit, score, rank) of questions (qid, question)."""
    settings = settings or config_of("update_index")
    return segments_of(spark, output, settings).search(retrieval.question_terms(questions, "qid", "question", settings["tokeniser"]), k)


def main(argv: list[str] | None = None) -> None:
    args = arguments(__doc__.split("\n")[0], argv, "input", "output", "checkpoint")
    spark = session("update_index")
    try:
        run(spark, args.input, args.output, args.checkpoint, config_of("update_index", args.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
