"""Vector similarity of a stated set of queries against all vectors, by matrix products.

Queries come in blocks of bounded bytes, which are sent to every task; a pass over
the vectors serves a block. A task keeps the best k of each query, or counts; so
what leaves it does not grow with its vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_path
from . import retrieval

#: Bytes of a block of queries as doubles, and vectors that are multiplied at a time.
BLOCK_BYTES, ROWS = 32 << 20, 4096
#: Rows of Arrow batches, so that a batch of vectors is of bounded size.
BATCH_ROWS = 8192
#: What ranks compare: scores to so many places.
PLACES = 9


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a list column as rows of doubles; all have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Table]]:
    """Queries (qid, q, ...) in blocks, written once in folders: ids, vectors, and all columns."""
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("q")).alias("width")).first()
    if not size["n"]:
        return
    blocks = max(1, -(-size["n"] * max(1, size["width"] or 0) * 8 // BLOCK_BYTES))
    path = shared_path(queries.sparkSession, "queries")
    rows = queries.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int"))
    rows.write.partitionBy("block").parquet(path)
    held = queries.sparkSession.read.schema(rows.schema).parquet(path)
    for b in range(blocks):
        got = held.where(F.col("block") == b).toArrow()  # of BLOCK_BYTES or so
        if got.num_rows:
            yield got["qid"].to_numpy(), _matrix(got["q"]), got


def _scored(vectors: DataFrame) -> DataFrame:
    vectors.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return vectors.select(F.col("unit").cast("long").alias("unit"), F.col("v").cast("array<double>").alias("v"))


def _best(scores: np.ndarray, units: np.ndarray, k: int) -> np.ndarray:
    """Which of some scores may be among the first k by rounded score and unit.

    Rounding here and in Spark may differ in the last place, so all values that
    near to the k-th stay, each with its k least units.
    """
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k] - 3 * 10.0**-PLACES
        at = np.flatnonzero(scores >= floor)
    else:
        at = np.arange(len(scores))
    keys = np.round(scores[at], PLACES)
    order = np.lexsort((units[at], -keys))
    starts = np.flatnonzero(np.diff(keys[order], prepend=np.inf))
    place = np.arange(len(order)) - np.repeat(starts, np.diff([*starts, len(order)]))
    return at[order[place < k]]


def top(queries: DataFrame, vectors: DataFrame, k: int, same: bool = False) -> DataFrame:
    """The k vectors (unit, v) with the greatest product with each query (qid, q): (qid, unit, score, rank); pairs of one id only if asked for."""
    rows, session = _scored(vectors), queries.sparkSession
    kind, path = dict(queries.dtypes)["qid"], shared_path(session, "products")
    schema = f"qid {kind}, unit long, score double"
    session.createDataFrame([], schema).write.parquet(path)
    for block in _blocks(queries):
        sent = session.sparkContext.broadcast(block[:2])  # of bounded bytes

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            ids, q = sent.value
            held_units: list[np.ndarray] = [np.zeros(0, np.int64)] * len(ids)
            held: list[np.ndarray] = [np.zeros(0)] * len(ids)
            for batch in batches:
                for a in range(0, batch.num_rows, ROWS):
                    part = batch.slice(a, ROWS)
                    units = part.column(0).to_numpy()
                    scores = q @ _matrix(part.column(1)).T
                    for i in range(len(ids)):
                        own = np.flatnonzero(units != ids[i]) if not same else slice(None)
                        u, s = np.concatenate([held_units[i], units[own]]), np.concatenate([held[i], scores[i][own]])
                        keep = _best(s, u, k)
                        held_units[i], held[i] = u[keep], s[keep]
            n = [len(x) for x in held]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(np.concatenate(held_units)), pa.array(np.concatenate(held))], ["qid", "unit", "score"])

        rows.mapInArrow(run, schema).write.mode("append").parquet(path)
    return retrieval.ranked(session.read.schema(schema).parquet(path), k=k)


def _greater(scores: np.ndarray, units: np.ndarray, own: np.ndarray, own_units: np.ndarray) -> np.ndarray:
    """For each pair (own, own_units) how many of the others rank before it: a greater rounded score, or an equal one and a lesser unit."""
    rounded, half = np.round(scores, PLACES), 0.5 * 10.0**-PLACES
    order = np.sort(rounded)
    low, high = np.searchsorted(order, own - half), np.searchsorted(order, own + half)
    out = len(order) - high
    for j in np.flatnonzero(high > low).tolist():
        out[j] += int(((np.abs(rounded - own[j]) < half) & (units < own_units[j])).sum())
    return out


def _asked(pairs: DataFrame) -> DataFrame:
    """(qid, asked): a query's pairs (score, unit) as an array, as many as are asked for of one query."""
    return pairs.groupBy("qid").agg(F.collect_list(F.struct(F.round("score", PLACES).alias("score"), "unit")).alias("asked"))


def _pairs(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.array([x["score"] for x in row], float), np.array([x["unit"] for x in row], np.int64)) for row in table["asked"].to_pylist()]


def _emit(ids: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], counts: list[np.ndarray]) -> pa.RecordBatch:
    n = [len(x) for x in counts]
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(np.concatenate([u for _, u in pairs])), pa.array(np.concatenate(counts))], ["qid", "unit", "n"])


def ranks_by_vectors(pairs: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(qid, unit, rank) of pairs (qid, unit, score) among all vectors: one more than those that rank before them."""
    rows, session = _scored(vectors), queries.sparkSession
    kind, path = dict(queries.dtypes)["qid"], shared_path(session, "places")
    schema = f"qid {kind}, unit long, n long"
    session.createDataFrame([], schema).write.parquet(path)
    for ids, q, table in _blocks(queries.select("qid", "q").join(_asked(pairs), "qid")):
        sent = session.sparkContext.broadcast((ids, q, _pairs(table)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            ids, q, pairs = sent.value
            counts = [np.zeros(len(s), np.int64) for s, _ in pairs]
            for batch in batches:
                for a in range(0, batch.num_rows, ROWS):
                    part = batch.slice(a, ROWS)
                    units, scores = part.column(0).to_numpy(), q @ _matrix(part.column(1)).T
                    for i, own in enumerate(pairs):
                        counts[i] += _greater(scores[i], units, *own)
            yield _emit(ids, pairs, counts)

        rows.mapInArrow(run, schema).write.mode("append").parquet(path)
    return session.read.schema(schema).parquet(path).groupBy("qid", "unit").agg((F.sum("n") + 1).alias("rank"))


#: Pairs whose ranks are counted in one pass.
PAIRS = 1 << 20


def ranks_by_counting(pairs: DataFrame, scores: DataFrame, units: DataFrame) -> DataFrame:
    """(qid, unit, rank) of pairs (qid, unit) in the ranking of all units by score, in which those without one count 0.

    Nothing is sorted and no unit without a score is paired: a scored unit ranks
    after those that it counts before it. One without a score ranks after all scored
    ones, which are above 0, and after the lesser units that have none either.
    Questions come in blocks of so many pairs; a pass over a block's scores serves it.
    """
    session = scores.sparkSession
    asked = pairs.select("qid", "unit").distinct()
    blocks = max(1, -(-asked.count() // PAIRS))
    block = F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int").alias("block")
    kind, root = dict(scores.dtypes)["qid"], shared_path(session, "counted")
    scores.select("qid", F.col("unit").cast("long").alias("unit"), "score", block).write.partitionBy("block").parquet(f"{root}/scores")
    held = session.read.schema(f"qid {kind}, unit long, score double, block int").parquet(f"{root}/scores")
    mine = asked.join(held.select("qid", "unit", "score"), ["qid", "unit"], "left").select("qid", "unit", F.coalesce("score", F.lit(0.0)).alias("score"), F.col("score").isNotNull().alias("scored"))
    mine.withColumn("block", block).write.partitionBy("block").parquet(f"{root}/asked")
    mine = session.read.schema(f"qid {kind}, unit long, score double, scored boolean, block int").parquet(f"{root}/asked")
    schema = f"qid {kind}, unit long, n long"
    session.createDataFrame([], schema).write.parquet(f"{root}/counts")
    for b in range(blocks):
        table = _asked(mine.where(F.col("block") == b)).toArrow()  # PAIRS or so
        if not table.num_rows:
            continue
        sent = session.sparkContext.broadcast((table["qid"].to_numpy(), _pairs(table)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            ids, pairs = sent.value
            at = {q: i for i, q in enumerate(ids.tolist())}
            counts = [np.zeros(len(s), np.int64) for s, _ in pairs]
            for batch in batches:
                qids, units, values = (batch.column(k).to_numpy() for k in range(3))
                order = np.argsort(qids, kind="stable")
                cuts = np.flatnonzero(np.diff(qids[order])) + 1
                for part in np.split(order, cuts) if len(order) else []:
                    i = at.get(int(qids[part[0]]))
                    if i is None:
                        continue
                    counts[i] += _greater(values[part], units[part], *pairs[i])
                    zero = np.flatnonzero(pairs[i][0] == 0)  # of no score: lesser units that have one do not stand before it twice
                    counts[i][zero] -= (units[part][:, None] < pairs[i][1][zero][None, :]).sum(axis=0)
            yield _emit(ids, pairs, counts)

        held.where(F.col("block") == b).select("qid", "unit", "score").mapInArrow(run, schema).write.mode("append").parquet(f"{root}/counts")
    counted = session.read.schema(schema).parquet(f"{root}/counts").groupBy("qid", "unit").agg(F.sum("n").alias("n"))
    out = mine.select("qid", "unit", "scored").join(counted, ["qid", "unit"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    bare = out.where("NOT scored").join(places(units), "unit").select("qid", "unit", (F.col("n") + F.col("place") + 1).alias("rank"))
    return out.where("scored").select("qid", "unit", (F.col("n") + 1).alias("rank")).unionByName(bare)


def places(units: DataFrame) -> DataFrame:
    """(unit, place): how many units are less. The units are sorted in ranges, each is numbered in its own, and the ranges before it are added."""
    session, path = units.sparkSession, shared_path(units.sparkSession, "order")
    dealt = units.select(F.col("unit").cast("long").alias("unit")).repartitionByRange(int(session.conf.get("spark.sql.shuffle.partitions")), "unit").sortWithinPartitions("unit")
    dealt.withColumn("i", F.monotonically_increasing_id()).write.parquet(path)
    rows = session.read.schema("unit long, i long").parquet(path).withColumn("range", F.shiftright("i", 33))
    sizes = sorted(map(tuple, rows.groupBy("range").agg(F.min("i"), F.count(F.lit(1))).collect()))  # a row per range
    shift, before = [], 0
    for of, first, n in sizes:
        shift.append((of, before - first))
        before += n
    return rows.join(F.broadcast(session.createDataFrame(shift, "range long, shift long")), "range").groupBy("unit").agg(F.min(F.col("i") + F.col("shift")).alias("place"))


def pair_scores(pairs: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(qid, unit, score) of pairs (qid, unit) whose query and vector are there."""
    both = pairs.select("qid", "unit").join(queries.select("qid", "q"), "qid").join(vectors.select("unit", "v"), "unit")
    return both.select("qid", "unit", retrieval.dot("q", "v").alias("score"))
