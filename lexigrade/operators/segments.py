"""A lexical index kept as Parquet tables: segments that are added, and a top-k search that reads them.

``units`` has each unit's length and the counts of its terms, so texts are
tokenised once, when they are added. ``postings`` has blocks of a term's entries,
partitioned by segment and by a bucket of the term. A block holds entries of like
impact (how near a term's frequency, given the unit's length, brings its weight to
the most it can be), with the greatest frequency and the least length among them:
together they bound what any of its entries adds to a score, whatever the mean
length is once other segments have come. Units are dealt over blocks by their hash,
so a block has UNITS entries or so at most and no task holds a common term alone.

A segment is written whole under its own number: writing it again, after a failure
or by a stream that repeats a batch, replaces it. Document frequencies and lengths
are sums over the segments that are there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import index, retrieval

#: Entries of all terms up to which a search is one sum.
PLAIN = 1 << 24
#: Impact levels, units per block, postings that a question's first pass reads unless its first term has more, and how many times k units set the floor.
LEVELS, UNITS, FIRST, LEAD = 16, 1 << 16, 1 << 11, 16
#: What sums of doubles may be off by.
SLACK = 1e-7
COUNTS = "array<struct<term:string,tf:int>>"


def saturated(tf: Column, dl: Column, avgdl: float, k1: float, b: float) -> Column:
    """The part of a term's weight that a frequency earns in a unit of a length; it grows with tf and falls with dl."""
    ratio = dl / F.lit(avgdl) if avgdl > 0 else F.lit(0.0)
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * ratio))


class Segments:
    """The index in a folder. ``unit`` is the SQL type of the units' ids."""

    def __init__(self, spark: SparkSession, path: str, unit: str = "long", buckets: int = 16):
        self.spark, self.path, self.unit, self.buckets = spark, path, unit, buckets

    # ------------------------------------------------------------ tables

    def units(self) -> DataFrame:
        """(unit, dl, counts, segment)."""
        return self.spark.read.schema(f"unit {self.unit}, dl int, counts {COUNTS}, segment long").parquet(f"{self.path}/units")

    def postings(self) -> DataFrame:
        """(segment, bucket, term, level, n, tf, dl, entries): blocks with their greatest tf and least dl."""
        entries = f"array<struct<unit:{self.unit},tf:int,dl:int>>"
        return self.spark.read.schema(f"term string, level int, n long, tf int, dl int, entries {entries}, segment long, bucket int").parquet(f"{self.path}/postings")

    def segments(self) -> DataFrame:
        """(segment, units, length): a row per segment."""
        return self.units().groupBy("segment").agg(F.count(F.lit(1)).alias("units"), F.sum("dl").alias("length"))

    def terms(self) -> DataFrame:
        """(term, df, cf) over all segments."""
        return self.postings().groupBy("term").agg(F.sum("n").alias("df"), F.sum(F.aggregate("entries", F.lit(0).cast("long"), lambda s, e: s + e["tf"])).alias("cf"))

    def bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    # ------------------------------------------------------------ adding

    def add(self, tokenised: DataFrame, segment: int) -> None:
        """Writes a segment of units (unit, toks, dl); one of this number is replaced."""
        own = f"{self.path}/units/segment={segment}"
        tokenised.select("unit", "dl", index.term_counts("toks").alias("counts")).write.mode("overwrite").parquet(own)
        rows = self.spark.read.schema(f"unit {self.unit}, dl int, counts {COUNTS}").parquet(own)
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
        salts = max(1, -(-size["n"] // UNITS))
        rows = rows.select("unit", "dl", F.inline("counts"), F.pmod(F.xxhash64("unit"), F.lit(salts)).alias("salt"))
        part = saturated(F.col("tf"), F.col("dl"), size["avgdl"] or 0.0, retrieval.K1, retrieval.B) / (retrieval.K1 + 1)
        rows = rows.select("*", self.bucket(F.col("term")).alias("bucket"), F.floor(part * LEVELS).cast("int").alias("level"))
        blocks = rows.repartition("bucket", "salt").groupBy("bucket", "salt", "term", "level").agg(  # all of a group is in one task already
            F.count(F.lit(1)).alias("n"), F.max("tf").alias("tf"), F.min("dl").alias("dl"), F.collect_list(F.struct("unit", "tf", "dl")).alias("entries")
        )
        blocks.drop("salt").sortWithinPartitions("bucket", "term", "level").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/segment={segment}")

    # ------------------------------------------------------------ search

    def weighted(self, asked: DataFrame, k1: float = retrieval.K1, b: float = retrieval.B) -> DataFrame:
        """Terms (qid, term, qtf) that the index has, with df, w (the weight) and most (the most that a unit can earn by it). No entry is read."""
        total = self.segments().agg(F.sum("units").alias("n"), F.sum("length").alias("length")).first()
        n = total["n"] or 0
        avgdl = (total["length"] or 0) / n if n else 0.0
        words = asked.select("term").distinct()
        wanted = [r[0] for r in words.select(self.bucket(F.col("term"))).distinct().collect()]  # buckets at most
        blocks = self.postings().where(F.col("bucket").isin(wanted)) if wanted else self.postings().where("false")
        known = blocks.join(words, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"), F.max(saturated(F.col("tf"), F.col("dl"), avgdl, k1, b)).alias("top"))
        w = F.col("qtf") * index.idf(F.lit(n), F.col("df"))
        return asked.join(known, "term").select("qid", "term", "df", w.alias("w"), (w * F.col("top")).alias("most"), F.lit(avgdl).alias("avgdl"), self.bucket(F.col("term")).alias("bucket"))

    def search(self, asked: DataFrame, k: int, k1: float = retrieval.K1, b: float = retrieval.B) -> DataFrame:
        """The first k units of every question's terms (qid, term, qtf): (qid, unit, score, rank). Exact, and a table: what uses it does not search again.

        Where all terms have PLAIN entries or fewer together, one sum over them takes less than the passes do.
        """
        if k < 1:
            raise ValueError("top_k must be positive")
        known = retrieval.kept(self.weighted(asked, k1, b), "weights")
        few = (known.agg(F.sum("df")).first()[0] or 0) <= PLAIN
        scores = self._sums(known, k1, b) if few else self.passes(known, k, k1, b)["scores"]
        return retrieval.kept(retrieval.ranked(scores, k=k), "found")

    def scores(self, asked: DataFrame, k1: float = retrieval.K1, b: float = retrieval.B) -> DataFrame:
        """(qid, unit, score) of all units that have one of a question's terms (qid, term, qtf)."""
        return self._sums(self.weighted(asked, k1, b), k1, b)

    def passes(self, known: DataFrame, k: int, k1: float = retrieval.K1, b: float = retrieval.B) -> dict[str, DataFrame]:
        """The passes of a search for ``weighted`` terms, as tables.

        1. ``first``: a question's weightiest terms, which are rare, score their
           units. The best of these get all other terms, from the units' own
           counts: the k-th best of them is a floor of the k-th score.
        2. ``second``: of the other terms those are left out that even together
           stay below the floor: a unit with no other term is not among the
           first k. Of the rest, blocks are left out that with the most that all
           other terms give stay below it.
        3. ``hopeful``: units whose sum may still reach the floor get the terms
           that were left out.

        A unit of the first k is in no block that was left out, so its sum is whole.
        """
        by_weight = Window.partitionBy("qid").orderBy(F.desc("w"), "term")  # the terms of a question
        before = F.sum("df").over(by_weight.rowsBetween(Window.unboundedPreceding, 0)) - F.col("df")
        known = known.withColumn("early", (before + F.col("df") <= FIRST) | (F.row_number().over(by_weight) == 1))
        first = retrieval.kept(self._sums(known.where("early"), k1, b), "first")
        lead = retrieval.ranked(first, k=LEAD * k).select("qid", "unit", "score")
        floor = _floor(self._completed(lead, known.where("NOT early"), k1, b), k)
        rest = known.where("NOT early").join(floor, "qid", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
        light = F.sum("most").over(Window.partitionBy("qid").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0))
        rest = retrieval.kept(rest.withColumn("left_out", light < F.col("floor") - SLACK), "rest")
        every = known.groupBy("qid").agg(F.sum("most").alias("every"))
        heavy = rest.where("NOT left_out").join(every, "qid").withColumn("least", F.col("floor") - SLACK - (F.col("every") - F.col("most")))
        second = self._entries(heavy, k1, b)
        sums = first.unionByName(second).groupBy("qid", "unit").agg(F.sum("score").alias("score"))
        spare = rest.groupBy("qid").agg(F.sum(F.when(F.col("left_out"), F.col("most")).otherwise(F.lit(0.0))).alias("spare"), F.first("floor").alias("floor"))
        hopeful = sums.join(spare, "qid", "left").where(F.col("score") + F.coalesce("spare", F.lit(0.0)) >= F.coalesce("floor", F.lit(0.0)) - SLACK).select("qid", "unit", "score")
        hopeful = retrieval.kept(hopeful, "hopeful")
        # Left-out terms come from the units' counts, or, if those of the hopeful units are more, from their blocks.
        light = rest.where("left_out")
        cost = light.agg(F.sum("df").alias("entries"), F.max("avgdl").alias("avgdl")).first()
        if hopeful.count() * (cost["avgdl"] or 0) <= (cost["entries"] or 0):
            scores = self._completed(hopeful, light, k1, b)
        else:
            more = self._entries(light, k1, b).join(hopeful.select("qid", "unit"), ["qid", "unit"], "left_semi")
            scores = hopeful.unionByName(more).groupBy("qid", "unit").agg(F.sum("score").alias("score"))
        return {"weights": known, "first": first, "second": second, "hopeful": hopeful, "scores": scores}

    def _completed(self, sums: DataFrame, terms: DataFrame, k1: float, b: float) -> DataFrame:
        """Sums (qid, unit, score) with what the terms add to them, from the units' counts."""
        rows = sums.select("qid", "unit").join(self.units().select("unit", "dl", "counts"), "unit").select("qid", "unit", "dl", F.inline("counts"))
        more = rows.join(terms.select("qid", "term", "w", "avgdl"), ["qid", "term"]).select("qid", "unit", (F.col("w") * _part(F.col("tf"), F.col("dl"), k1, b)).alias("score"))
        return sums.unionByName(more).groupBy("qid", "unit").agg(F.sum("score").alias("score"))

    def _entries(self, terms: DataFrame, k1: float, b: float) -> DataFrame:
        """(qid, unit, score): what each entry of the terms' blocks adds; with ``least``, blocks that can add no more than that are not opened."""
        blocks = self.postings().join(terms, ["bucket", "term"])
        if "least" in terms.columns:
            blocks = blocks.where(F.col("w") * _part(F.col("tf"), F.col("dl"), k1, b) >= F.col("least"))
        rows = blocks.select("qid", "w", "avgdl", F.inline("entries"))
        return rows.select("qid", "unit", (F.col("w") * _part(F.col("tf"), F.col("dl"), k1, b)).alias("score"))

    def _sums(self, terms: DataFrame, k1: float, b: float) -> DataFrame:
        return self._entries(terms, k1, b).groupBy("qid", "unit").agg(F.sum("score").alias("score"))


def _part(tf: Column, dl: Column, k1: float, b: float) -> Column:
    ratio = F.when(F.col("avgdl") > 0, dl / F.col("avgdl")).otherwise(F.lit(0.0))
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * ratio))


def _floor(sums: DataFrame, k: int) -> DataFrame:
    """(qid, floor): the k-th best sum of the questions that have so many."""
    best = retrieval.ranked(sums, k=k)
    return best.where(F.col("rank") == k).select("qid", F.col("score").alias("floor"))
