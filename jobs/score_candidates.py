"""Scores the answers of many candidates against a gold set and ranks the candidates.

    spark-submit jobs/score_candidates.py --answers documents/ --gold benchmark/ --judged labels/ --output scores/

Config entries are SQL expressions over the three tables; ``item`` may use n_items,
the number of gold rows. Each answer meets its item: token overlap with the item's
key facts, the facts that it covers, the tokens shared and missing, and the judge's
score where there is one. Answers of equal candidate and question count each; of
several judgements of a question each axis counts with its greatest value; an
answer without an item scores 0.

``answers`` is partitioned by candidate. Each run replaces the folders of the
candidates that it is given and leaves others alone, so a rerun gives the same
rows, and candidates can be handed in one after another. ``totals`` is then made of
all ``answers`` there are: each candidate's means, total, status and place.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

if __package__ in (None, ""):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from jobs.common import arguments, config_of, log, session
from lexigrade.functions import text as T
from lexigrade.operators import metrics

ANSWERS = "question long, item long, chars int, n_facts int, covered int, shared int, missing int, f1 double, judge double, candidate string"
TOTALS = "candidate string, n long, facts double, covered double, keyfact double, judge double, total double, status string, place int, passed boolean"


def scored(answers: DataFrame, gold: DataFrame, judged: DataFrame, settings: dict) -> DataFrame:
    """A row per answer; nothing but the small sides of joins moves: tokens stay in their row."""
    sized = answers.withColumn("n_items", F.lit(gold.count()))
    rows = sized.select(
        F.expr(settings["candidate"]).cast("string").alias("candidate"), F.expr(settings["question"]).cast("long").alias("question"),
        F.coalesce(F.expr(settings["answer"]), F.lit("")).alias("answer"), F.expr(settings["item"]).cast("long").alias("item"),
    )
    facts = gold.select(F.expr(settings["item_id"]).cast("long").alias("item"), F.expr(settings["facts"]).alias("facts"))
    facts = facts.select("item", F.transform("facts", lambda f: T.set_tokens(f)).alias("facts"), T.set_tokens(F.array_join("facts", " ")).alias("wanted"))
    axes = judged.select(F.expr(settings["judged"]).cast("long").alias("question"), *[F.expr(x).alias(k) for k, x in settings["axes"].items()])
    axes = axes.groupBy("question").agg(*[F.max(k).alias(k) for k in settings["axes"]])
    judge = axes.select("question", metrics.judge_score({k: k for k in settings["axes"]}).alias("judge"))
    rows = rows.join(facts, "item", "left").join(judge, "question", "left").withColumn("tokens", T.set_tokens("answer"))
    none = F.array().cast("array<string>")
    wanted, facts_of = F.coalesce("wanted", none), F.coalesce("facts", F.array().cast("array<array<string>>"))
    shared = F.size(F.array_intersect("tokens", wanted))
    covered = F.size(F.filter(facts_of, lambda f: metrics.covered(F.col("tokens"), f, settings["fact_threshold"])))
    return rows.select(
        "candidate", "question", "item", F.char_length("answer").alias("chars"), F.size(facts_of).alias("n_facts"), covered.alias("covered"),
        shared.alias("shared"), (F.size(wanted) - shared).alias("missing"), metrics.set_f1(F.col("tokens"), wanted).alias("f1"), "judge",
    )


def totals(rows: DataFrame, settings: dict) -> DataFrame:
    """Candidates by total; those of equal totals by name. Candidates without a judgement have no total and come last."""
    per = rows.select(F.col("candidate").alias("blind_id"), F.lit(0.0).alias("rr"), "f1", "judge", F.lit(False).alias("has_refs"))
    out = metrics.candidate_totals(per, style="renormalised").withColumnRenamed("blind_id", "candidate")
    share = rows.groupBy(F.col("candidate").alias("of")).agg(F.avg("n_facts").alias("facts"), (F.sum("covered") / F.nullif(F.sum("n_facts"), F.lit(0))).alias("covered"))
    out = out.join(share, F.col("candidate").eqNullSafe(F.col("of"))).drop("of")
    place = Window.orderBy(F.desc_nulls_last(F.round("total", 9)), F.asc_nulls_last("candidate"))  # a row per candidate
    out = out.withColumn("place", F.row_number().over(place)).withColumn("passed", F.coalesce(F.col("total") >= settings["pass_total"], F.lit(False)))
    return out.select("candidate", "n", "facts", "covered", "keyfact", "judge", "total", "status", "place", "passed")


def run(spark: SparkSession, answers: str, gold: str, judged: str, output: str, settings: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Scores ``answers`` and returns (answers, totals) as they are on disk then."""
    settings = settings or config_of("score_candidates")
    given = spark.read.parquet(answers)
    rows = scored(given, spark.read.parquet(gold), spark.read.parquet(judged), settings)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("candidate").parquet(f"{output}/answers")
    back = spark.read.schema(ANSWERS).parquet(f"{output}/answers")
    totals(back, settings).write.mode("overwrite").parquet(f"{output}/totals")
    board = spark.read.schema(TOTALS).parquet(f"{output}/totals")
    log.info("read %s answers from %s", given.count(), answers)
    for r in board.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("answers"), F.sum(F.col("passed").cast("int")).alias("passed")).collect():
        log.info("wrote %s: %s candidates with %s answers, %s passed", output, r["n"], r["answers"], r["passed"])
    return back, board


def main(argv: list[str] | None = None) -> None:
    args = arguments(__doc__.split("\n")[0], argv, "answers", "gold", "judged", "output")
    spark = session("score_candidates")
    try:
        run(spark, args.answers, args.gold, args.judged, args.output, config_of("score_candidates", args.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
