"""Mixing sources to target weights by cube-method balanced sampling.

A source's share of all words sets its target; no target exceeds ``cap`` times
its source's words, and the excess is shared again by weight. A document of a
source with ratio r = target / words is taken floor(r) times, and once more
with the fractional probability. Which documents are taken once more is drawn
by the cube method: probabilities move along the null space of the balancing
constraints (number of documents, number of words), three documents at a time,
until at most two of a block stay fractional. The leftovers of a source's
blocks meet in the next round of blocks, until one block is left; it keeps a
few documents of spread sizes back and its landing takes the roundings of what
is open that miss the target least.

Blocks hold about ``block`` documents by a hash of the row, so a source that
holds a third of all rows is many blocks, and the draw depends on the data and
the seed alone, not on partitions.

Defined cases: a null text has size 0; null sources are one source, the last; a
source without words has target 0; documents of size 0 follow their source's
ratio (0 where it has none); repeated rows are drawn each; an empty table gives
no rows; extra columns play no part in the draw.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Shelf, fresh, int_words, table

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
BLOCK = 4096
#: Documents that a source's last block keeps for the landing.
HELD = 10


def flight(probs: list[float], sizes: list[float], rng: np.random.Generator) -> list[float]:
    """Moves probabilities to 0 or 1 while their sum and their sum of sizes hold; at most 2 stay fractional.

    Sizes may be in any unit. With three units open, the null space of the two
    constraints is the cross product of (1, 1, 1) and their sizes; equal sizes
    leave more room and two of them move against each other.
    """
    probs = list(probs)
    draws = iter(rng.random(3 * len(probs) + 8).tolist())
    open_ = []
    for k, p in enumerate(probs):
        if 1e-9 < p < 1 - 1e-9:
            open_.append(k)
        else:
            probs[k] = float(round(p))
        while len(open_) >= 3 or (len(open_) == 2 and sizes[open_[0]] == sizes[open_[1]]):
            if len(open_) == 2:
                ids, u = open_[:2], (1.0, -1.0)
            else:
                ids = open_[:3]
                a, b, c = (sizes[i] for i in ids)
                u = (c - b, a - c, b - a)
                if u == (0.0, 0.0, 0.0):
                    u = (1.0, -1.0, 0.0)
            up = min(((1 - probs[i]) / x if x > 0 else probs[i] / -x) for i, x in zip(ids, u, strict=True) if x)
            down = min((probs[i] / x if x > 0 else (1 - probs[i]) / -x) for i, x in zip(ids, u, strict=True) if x)
            step = up if next(draws, 0.5) * (up + down) < down else -down
            for i, x in zip(ids, u, strict=True):
                p = probs[i] + step * x
                probs[i] = 0.0 if p < 1e-9 else 1.0 if p > 1 - 1e-9 else p
            open_ = [i for i in open_ if 0.0 < probs[i] < 1.0]
    return probs


def held_back(probs: list[float], sizes: list[float], most: int = HELD) -> list[int]:
    """Open units that the last flight leaves for the landing: evenly spaced by size, so that their sums are dense."""
    ids = sorted((k for k, p in enumerate(probs) if 1e-9 < p < 1 - 1e-9), key=lambda k: (sizes[k], k))
    if len(ids) <= most:
        return ids
    return sorted({ids[(2 * j + 1) * len(ids) // (2 * most)] for j in range(most)})


def landing(probs: list[float], sizes: list[float]) -> list[float]:
    """Rounds the few open units together: of all roundings, the one that misses the expected words, and next to
    that the expected number of documents, least. A document counts as a twentieth of a mean size."""
    ids = [k for k, p in enumerate(probs) if 0.0 < p < 1.0]
    if not ids:
        return list(probs)
    own, size = np.array([probs[i] for i in ids]), np.array([sizes[i] for i in ids])
    picks = (np.arange(1 << len(ids))[:, None] >> np.arange(len(ids)) & 1).astype(float)
    cost = np.abs(picks @ size - own @ size) / max(1.0, size.mean()) + 0.05 * np.abs(picks.sum(axis=1) - own.sum())
    out = list(probs)
    for i, pick in zip(ids, picks[int(np.argmin(np.round(cost, 9)))].tolist(), strict=True):
        out[i] = pick
    return out


_UNIT = "source string, id long, size long, mark long, prob double"


def _round(units: DataFrame, blocks: DataFrame | None, seed: int, level: int) -> DataFrame:
    """One round of flights in blocks of each source; ``blocks`` (of, parts) has the number of blocks of each source, None means one (and the landing)."""
    if blocks is None:
        dealt = units.withColumn("part", F.lit(0))
    else:
        dealt = units.join(blocks, units["source"].eqNullSafe(blocks["of"])).drop("of")
        dealt = dealt.withColumn("part", F.pmod(F.xxhash64("id", "mark", F.lit(seed + level)), F.col("parts")).cast("int")).drop("parts")
    last = blocks is None

    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("id", "ascending"), ("size", "ascending"), ("mark", "ascending"), ("prob", "ascending")])
        source, part = key[0].as_py(), key[1].as_py()
        rng = np.random.default_rng([seed, level, part, *(source.encode() if source is not None else (256,))])
        # Documents in random order, so that neighbours in id are not balanced against each other alone.
        order = rng.permutation(group.num_rows)
        group = group.take(pa.array(order))
        sizes = [float(s) for s in group["size"].to_pylist()]
        probs = group["prob"].to_pylist()
        held = held_back(probs, sizes) if last else []
        fly = sorted(set(range(len(probs))) - set(held))
        for k, p in zip(fly, flight([probs[k] for k in fly], [sizes[k] for k in fly], rng), strict=True):
            probs[k] = p
        if last:
            probs = landing(probs, sizes)
        return pa.table({"source": group["source"], "id": group["id"], "size": group["size"], "mark": group["mark"], "prob": pa.array(probs, pa.float64())})

    return dealt.groupBy("source", "part").applyInArrow(run, _UNIT)


def ranked_sources(sized: DataFrame, shelf: Shelf, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """(of, words, docs, weight) per source; weights repeat in the order of the sources, by code point, null last.

    Sources are numbered within ranges of names; only the number of sources of each range comes to the driver.
    """
    order = F.col("source").asc_nulls_last()
    rows = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs"))
    rows = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("n", F.monotonically_increasing_id())
    rows = shelf.put(rows, "names").withColumns({"range": F.shiftrightunsigned("n", 33), "n": F.col("n").bitwiseAND(F.lit((1 << 33) - 1))})
    before, at = [], 0
    for r in rows.groupBy("range").count().orderBy("range").collect():
        before.append((r["range"], at))
        at += r["count"]
    starts = sized.sparkSession.createDataFrame(before, "range long, start long")  # a row per range
    rank = (F.col("start") + F.col("n")) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank + 1).cast("int"))
    return rows.join(F.broadcast(starts), "range").select(F.col("source").alias("of"), "words", "docs", weight.alias("weight"))


def with_targets(sources: DataFrame, cap: float = CAP) -> DataFrame:
    """sources (words, weight, ...) with target: shares of all words by weight, none above cap times a source's words.

    A word of weight is worth ``unit`` words. What targets above the cap lose
    raises it, and more targets may pass the cap; so aggregates over the sources
    repeat until no more do.
    """
    unit, capped = 0.0, -1
    while True:
        over = (F.col("words") > 0) & (F.col("weight") * F.lit(unit) > cap * F.col("words"))
        free = (F.col("words") > 0) & ~over
        got = sources.agg(
            F.sum("words").alias("total"), F.count(F.when(over, 1)).alias("capped"), F.coalesce(F.sum(F.when(over, F.col("words"))), F.lit(0)).alias("words"), F.sum(F.when(free, F.col("weight"))).alias("weight")
        ).first()
        if got["capped"] == capped or not got["weight"]:
            break
        unit, capped = (got["total"] - cap * got["words"]) / got["weight"], got["capped"]
    target = F.when(F.col("words") == 0, F.lit(0.0)).when(over, cap * F.col("words")).otherwise(F.col("weight") * F.lit(unit))
    return sources.withColumn("target", target.cast("double"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, cap: float = CAP, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """(source, id, size, mark, source_size, target, copies) of every row; mark is a hash of its text.

    Words are counted once; from there on rows are narrow. The levels after the
    first hold two rows per block of the one before.
    """
    shelf = Shelf(docs.sparkSession, "mix")
    sized = shelf.put(docs.select(F.col(source_col).alias("source"), F.col(id_col).cast("long").alias("id"), int_words(text_col).alias("size"), F.xxhash64(text_col).alias("mark")), "sized")
    sources = shelf.put(with_targets(shelf.put(ranked_sources(sized, shelf, weights), "ranked"), cap), "sources")
    ratio = F.when(F.col("words") > 0, F.col("target") / F.col("words")).otherwise(F.lit(0.0))
    ratio = F.when(F.abs(ratio - F.round(ratio)) < 1e-9, F.round(ratio)).otherwise(ratio)
    facts = shelf.put(
        sources.select("of", "words", "target", F.floor(ratio).cast("long").alias("whole"), (ratio - F.floor(ratio)).alias("prob"), F.ceil(F.col("docs") / block).cast("long").alias("parts")), "facts"
    )  # a row per source: Spark broadcasts it if it finds it small
    units = sized.join(facts, sized["source"].eqNullSafe(facts["of"])).select("source", "id", "size", "mark", "prob")
    done, level, parts = [], 0, facts.select("of", "parts")
    while True:
        most = parts.agg(F.max("parts")).first()[0] or 1
        out = shelf.put(_round(units, parts if most > 1 else None, seed, level), f"round{level}")
        if most <= 1:
            done.append(out)
            break
        done.append(out.where("prob = 0 OR prob = 1"))
        units = out.where("prob > 0 AND prob < 1")
        parts = parts.select("of", F.ceil(2 * F.col("parts") / block).cast("long").alias("parts"))
        level += 1
    shelf.clear("facts", *(f"round{k}" for k in range(level + 1)))
    drawn = done[0]
    for d in done[1:]:
        drawn = drawn.unionByName(d)
    return drawn.join(facts, drawn["source"].eqNullSafe(facts["of"])).select(
        "source", "id", "size", "mark", F.col("words").alias("source_size"), "target", (F.col("whole") + drawn["prob"].cast("long")).alias("copies")
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options: object) -> DataFrame:
    """docs as the mix takes them: each row as many times as it was drawn, with its own columns, whatever their names are.

    Rows and draws meet by id, source and hash of the text; rows that agree in
    all of these are alike, and the n-th of them gets the n-th draw.
    """
    names = fresh(docs.columns, "own_id", "own_source", "own_mark", "drawn_id", "drawn_source", "drawn_mark", "copies", "alike", "times", "turn")
    own, of, (copies, alike, times, turn) = names[:3], names[3:6], names[6:]
    drawn = mix(docs, id_col, text_col, source_col, **options).groupBy("id", "source", "mark").agg(F.sum("copies").alias(copies), F.count(F.lit(1)).alias(alike))
    drawn = drawn.select(*(F.col(c).alias(k) for c, k in zip(("id", "source", "mark"), of, strict=True)), copies, alike)
    rows = docs.withColumns(dict(zip(own, (F.col(id_col).cast("long"), F.col(source_col), F.xxhash64(text_col)), strict=True)))
    # The hash alone would do for the join; the null-safe rest tells rows with one text apart.
    both = rows.join(drawn, (F.col(own[2]) == F.col(of[2])) & F.col(own[0]).eqNullSafe(F.col(of[0])) & F.col(own[1]).eqNullSafe(F.col(of[1])))
    # Among k alike rows with c copies in all, each is taken c // k times and the rest falls to the first of them.
    each = F.floor(F.col(copies) / F.col(alike))
    if drawn.where(F.col(alike) > 1).isEmpty():
        count = F.col(copies)
    else:
        nth = F.row_number().over(Window.partitionBy(*own).orderBy(F.lit(0)))
        count = each + F.when(nth <= F.col(copies) - each * F.col(alike), 1).otherwise(0)
    taken = both.withColumn(times, count.cast("int")).where(F.col(times) > 0)
    return taken.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by the contract's weights."""
    out = mix(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


#: The columns that the contract fixes; which documents are drawn is no SQL.
FACTS_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS words, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS weight FROM d GROUP BY source
), t AS (SELECT sum(words) AS total FROM s),
-- The unit is where all words are spent: sources by words per weight, the first k of them at the cap.
o AS (
  SELECT *, coalesce(sum(words) OVER w, 0) AS capped, sum(weight) OVER (ORDER BY words / weight DESC, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS free, row_number() OVER (ORDER BY words / weight, source NULLS FIRST) AS k
  FROM s WHERE words > 0 WINDOW w AS (ORDER BY words / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), u AS (SELECT min_by((total - 3 * capped) / free, k) AS unit FROM o, t WHERE (total - 3 * capped) / free * weight <= 3 * words)
SELECT d.doc_id, d.size, s.words AS source_size, CASE WHEN s.words = 0 THEN 0 ELSE least(3 * s.words, s.weight * u.unit) END::DOUBLE AS target
FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source, u
"""


def fixed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6 that the contract fixes."""
    return op6_mixing(spark, sf_dir).select("doc_id", "size", "source_size", "target")
