"""Exact top-k search with vector-approximation files.

A vector is turned into integers floor(scale * x), kept as doubles in units of
UNIT: a double beyond 2**53 is an integer already, so none loses a digit however
large it is. Equal vectors fall together with the smallest ids that hold them, so a
very common vector is searched once. The approximation file, written once, has a
byte per component: the number of its cell. The marks between cells are quantiles
of a bounded sample, the outermost cells end at the least and the greatest
component of all vectors. Vectors with a component from WIDE on have no cells, as
one of them would stretch the outermost cells of all: every query reads them
exactly.

1. A query's product with a vector lies between bounds that follow from the
   cells alone; two matrix products give them for a block of queries and a batch
   of cells. Queries come in blocks of bounded bytes, which are sent to every
   task; the tasks scan the approximation file and nothing else. A vector whose
   upper bound is below a query's k-th best lower bound is passed over.
2. The bounds that are left meet per query, and the k-th best lower bound of all
   tasks sifts them again.
3. Exact vectors are fetched by id in the order of the bounds: first the k with
   the greatest upper bounds; then those whose upper bound still reaches the
   k-th score found, if any. So the k-th result is certain.

Scores are exact: products are summed in 64 bits where they provably fit, and
in Python's integers where they might not. A score among the results that is
beyond a long is an error, as it is in SQL; scores beyond a long that are not among
the results do no harm.

Defined cases: vectors that are null or hold nulls or non-finite components take no
part, all others do; vectors of other lengths than the query's are no candidates (of very many lengths, only the most
frequent ones have cells; vectors of others are all read exactly); equal scores
go to the smaller id; query rows that repeat an id are ranked each by its own
vector, so an id given n times has n results of each rank; a row is never its
own candidate, nor are rows that repeat its id; candidates that repeat an id
are candidates each; null ids take no part; fewer candidates give fewer rows;
an empty table gives none; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Shelf, small_batches, table

SCALE = 64.0
#: What a stored component of 1 stands for, and the least stored component, in absolute terms, of a vector without cells.
UNIT, WIDE = 2.0**64, 2.0**-19
#: Cells of a component: their numbers fill a byte.
CELLS = 256
LONG = 1 << 63
#: Sums of products below this, in doubles, fit a long.
SAFE = float(1 << 62)
#: Vectors that the marks are fitted on, and lengths of vectors that have marks.
SAMPLE, LENGTHS = 4096, 64
#: Bytes of a block of queries as doubles, and queries and bounds that a task handles at a time.
BLOCK_BYTES, CHUNK, HELD = 16 << 20, 256, 1 << 20


def usable(vectors: DataFrame, id_col: str, vec_col: str, scale: float = SCALE) -> DataFrame:
    """(id, v): ids and integer vectors, in units of UNIT, of the rows that take part."""
    x = F.col(vec_col).cast("array<double>")
    ok = F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()
    good = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    # Doubles from 2**53 on are integers; floor() would turn them into longs.
    ints = F.transform(x, lambda e: F.when(F.abs(e) < 2.0**52 / scale, F.floor(e * scale).cast("double") / UNIT).otherwise(_whole(e, scale)))
    return vectors.where(ok).where(F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), ints.alias("v"))


def _whole(e: Column, scale: float) -> Column:
    """floor(e * scale) / UNIT of a large e: e * scale may be beyond doubles, and below 2**53 it has a fraction at most."""
    product = e * scale
    small = F.abs(product) < 2.0**53
    return F.when(small, F.floor(F.when(small, product).otherwise(F.lit(0.0))).cast("double") / UNIT).otherwise(e * (scale / UNIT))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(v, ids, sole): every different vector with the k + 1 smallest ids that hold it, each with its number of rows.

    More of them cannot be among the k results of a query, which leaves out its
    own id alone. sole is the id of a vector that only one has. Rows are counted
    per id first, and of a vector that many ids hold each task sends k + 1 on.
    """
    counted = rows.groupBy("id", "v").agg(F.count(F.lit(1)).alias("n"))
    least = counted.withColumn("i", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("i") <= k + 1)
    ids = F.array_sort(F.collect_list(F.struct("id", F.least("n", F.lit(k)).alias("n"))))
    return least.groupBy("v").agg(ids.alias("ids")).withColumn("sole", F.when(F.size("ids") == 1, F.col("ids")[0]["id"]))


# ---------------------------------------------------------------- cells


def ranges(classes: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The least and greatest integers of every component, for the lengths that are most frequent."""
    sizes = [r["size"] for r in classes.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").limit(LENGTHS).collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, _, block in by_length(batch.column(0)):
                block = block[~is_wide(block)]
                if size in sizes and size and len(block):
                    both = np.stack([block.min(axis=0), block.max(axis=0)])
                    old = seen.get(size, both)
                    seen[size] = np.stack([np.minimum(old[0], both[0]), np.maximum(old[1], both[1])])
        for size, (low, high) in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([size] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array(low), pa.array(high)], ["size", "at", "low", "high"])

    small_batches(classes)
    got = classes.select("v").mapInArrow(run, "size int, at int, low double, high double").groupBy("size", "at").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    got = got.orderBy("size", "at").toArrow()  # as many rows as these lengths have components
    size, low, high = (got[c].to_numpy() for c in ("size", "low", "high"))
    return {int(s): (low[size == s], high[size == s]) for s in np.unique(size)}


def fit_edges(classes: DataFrame, cells: int = CELLS, sample: int = SAMPLE) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: marks (cells - 1, size), and least and greatest integers of every cell (cells, size). Marks affect speed only."""
    limits = ranges(classes)
    n = classes.count()
    some = classes.sample(fraction=min(1.0, sample / max(1, n)), seed=11).select("v").limit(2 * sample).toArrow()
    out = {}
    blocks = {size: block for size, _, block in by_length(some["v"].combine_chunks())} if some.num_rows else {}
    for size, (low, high) in limits.items():
        block = blocks.get(size, np.stack([low, high]))
        block = block[~is_wide(block)] if not is_wide(block).all() else np.stack([low, high])
        marks = np.quantile(block, np.arange(1, cells) / cells, axis=0, method="nearest")
        out[size] = (marks, np.vstack([low[None], marks]), np.vstack([marks - 1 / UNIT, high[None]]))  # cells without vectors may cross; nothing reads them
    return out


def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The vectors of a list column by their length: the length, the rows, a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    starts, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(starts)
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        yield size, rows, values[starts[rows][:, None] + np.arange(size)]


def is_wide(block: np.ndarray) -> np.ndarray:
    """Which vectors have no cells."""
    return (np.abs(block) >= WIDE).any(axis=1)


def approximate(block: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The cell of every component."""
    out = np.empty(block.shape, np.uint8)
    for d in range(block.shape[1]):
        out[:, d] = np.searchsorted(marks[:, d], block[:, d], side="right")
    return out


def approximations(classes: DataFrame, edges: dict) -> DataFrame:
    """(cid, sole, size, cells) of classes (cid, v, sole, ...); cells are null for lengths without marks, and for wide vectors."""
    marks = {size: e[0] for size, e in edges.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, cells = np.zeros(batch.num_rows, np.int32), [None] * batch.num_rows
            for size, rows, block in by_length(batch.column(2)):
                sizes[rows] = size
                if size in marks:
                    near = ~is_wide(block)
                    for r, c in zip(rows[near].tolist(), approximate(block[near], marks[size]), strict=True):
                        cells[r] = c.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes), pa.array(cells, pa.binary())], ["cid", "sole", "size", "cells"])

    small_batches(classes)
    return classes.select("cid", "sole", "v").mapInArrow(run, "cid long, sole long, size int, cells binary")


# ---------------------------------------------------------------- bounds


class Scan:
    """A block of queries of one length, the best lower bounds so far, and the bounds that may still count."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, vectors: np.ndarray, edges: tuple | None, k: int):
        self.keys, self.ids, self.k = keys, ids, k
        self.q = vectors
        self.abs = np.abs(self.q)
        self.best = np.full((len(ids), k), -np.inf)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0
        if edges is not None:
            low, high = edges[1], edges[2]
            self.mid, self.half = (low + high) / 2, (high - low) / 2
            # Doubles round sums of large products: the bounds are widened by more than that.
            top = np.maximum(np.abs(low), np.abs(high)).max(axis=0)
            self.slack = (self.abs @ top) * max(1e-12, 4e-16 * vectors.shape[1]) + 1e-6 / UNIT**2

    def meet(self, cids: np.ndarray, sole: np.ndarray, alone: np.ndarray, cells: np.ndarray) -> None:
        """Takes a batch of approximations into account; a vector that the query's id alone has is left out."""
        at = np.arange(cells.shape[1])
        mid, half = self.mid[cells, at].T, self.half[cells, at].T
        for a in range(0, len(self.ids), CHUNK):
            part = slice(a, a + CHUNK)
            centre, reach = self.q[part] @ mid, self.abs[part] @ half + self.slack[part, None]
            own = (self.ids[part, None] == sole[None, :]) & alone[None, :]
            lower, upper = centre - reach, centre + reach
            lower[own] = upper[own] = -np.inf
            n = lower.shape[1]
            top = np.partition(lower, n - self.k, axis=1)[:, n - self.k :] if n > self.k else lower
            both = np.concatenate([self.best[part], top], axis=1)
            self.best[part] = np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k :]
            floor = self.best[part].min(axis=1)
            q, r = np.nonzero((upper >= floor[:, None]) & ~own)
            self._hold(q + a, cids[r], lower[q, r], upper[q, r])

    def unbounded(self, cids: np.ndarray, sole: np.ndarray, alone: np.ndarray) -> None:
        """Vectors without cells may all count."""
        for q in range(len(self.ids)):
            rows = np.flatnonzero(~((sole == self.ids[q]) & alone))
            self._hold(np.full(len(rows), q), cids[rows], np.full(len(rows), -np.inf), np.full(len(rows), np.inf))

    def _hold(self, q: np.ndarray, cids: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> None:
        self.found.append((q, cids, lower, upper))
        self.held += len(q)

    def flush(self) -> pa.RecordBatch:
        """The bounds that are left, as rows."""
        q, cids, lower, upper = (np.concatenate(x) for x in zip(*self.found, (np.zeros(0, np.int64),) * 2 + (np.zeros(0),) * 2, strict=True))
        keep = upper >= self.best.min(axis=1)[q] if len(q) else np.zeros(0, bool)
        self.found, self.held = [], 0
        return pa.RecordBatch.from_arrays([pa.array(self.keys[q[keep]]), pa.array(cids[keep]), pa.array(lower[keep]), pa.array(upper[keep])], ["qkey", "cid", "lower", "upper"])


def bounds(cells: DataFrame, block: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], edges: dict, k: int) -> DataFrame:
    """(qkey, cid, lower, upper): what a scan of the approximations leaves to a block of queries (length, keys, ids, vectors)."""
    sent = cells.sparkSession.sparkContext.broadcast((block, {s: edges.get(s) for s, *_ in block}))  # of bounded bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, marks = sent.value
        scans = {size: Scan(keys, ids, vectors, marks[size], k) for size, keys, ids, vectors in queries}
        for batch in batches:
            alone, bounded = (batch.column(k).is_valid().to_numpy(zero_copy_only=False) for k in (1, 3))
            cids, sole, sizes = batch.column(0).to_numpy(), batch.column(1).fill_null(0).to_numpy(), batch.column(2).to_numpy()
            for size, scan in scans.items():
                rows = np.flatnonzero(sizes == size)
                for s in range(0, len(rows), 4096):
                    part = rows[s : s + 4096]
                    bare, part = part[~bounded[part]], part[bounded[part]]
                    if len(bare):
                        scan.unbounded(cids[bare], sole[bare], alone[bare])
                    if len(part):
                        raw = b"".join(batch.column(3).take(pa.array(part)).to_pylist())
                        scan.meet(cids[part], sole[part], alone[part], np.frombuffer(raw, np.uint8).reshape(len(part), size))
                    if scan.held > HELD:
                        yield scan.flush()
        for scan in scans.values():
            yield scan.flush()

    return cells.mapInArrow(run, "qkey long, cid long, lower double, upper double")


def query_blocks(asked: DataFrame, blocks: int) -> Iterator[list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """The blocks of the queries (block, qkey, id, v), a folder each."""
    for b in range(blocks):
        got = asked.where(F.col("block") == b).select("qkey", "id", "v").toArrow()
        if got.num_rows:
            keys, ids = got["qkey"].to_numpy(), got["id"].to_numpy()
            yield [(size, keys[rows], ids[rows], block) for size, rows, block in by_length(got["v"])]


# ---------------------------------------------------------------- exact scores


def integer(x: float) -> int:
    """The integer that a stored component stands for."""
    a, b = x.as_integer_ratio()
    return (a << 64) // b


def exact_scores(pairs: DataFrame, asked: DataFrame, classes: DataFrame) -> DataFrame:
    """(qkey, cid, score, over) of pairs (qkey, cid), by the exact vectors. over says that a score is beyond a long, and on which side."""
    both = pairs.select("qkey", "cid").join(classes.select("cid", "v"), "cid").join(asked.select("qkey", F.col("v").alias("q")), "qkey").select("qkey", "cid", "q", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, over = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int32)
            asks = {size: (rows, block) for size, rows, block in by_length(batch.column(2))}
            for size, rows, block in by_length(batch.column(3)):  # both sides have the same length
                q = asks[size][1]
                fits = ~is_wide(q) & ~is_wide(block)
                fits[fits] = np.abs(q[fits] * UNIT).sum(axis=1) * np.abs(block[fits] * UNIT).max(axis=1, initial=0) < SAFE
                scores[rows[fits]] = np.einsum("ij,ij->i", (q[fits] * UNIT).astype(np.int64), (block[fits] * UNIT).astype(np.int64))
                for i in np.flatnonzero(~fits).tolist():
                    s = sum(integer(a) * integer(b) for a, b in zip(q[i].tolist(), block[i].tolist(), strict=True))
                    scores[rows[i]], over[rows[i]] = min(max(s, -LONG), LONG - 1), (s >= LONG) - (s < -LONG)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array(over)], ["qkey", "cid", "score", "over"])

    small_batches(both)
    return both.mapInArrow(run, "qkey long, cid long, score long, over int")


def _kth(rows: DataFrame, value: Column, k: int) -> DataFrame:
    """(qkey, floor): the k-th greatest value of every query; minus infinity if there are fewer."""
    best = rows.select("qkey", value.cast("double").alias("x")).withColumn("i", F.row_number().over(Window.partitionBy("qkey").orderBy(F.desc("x")))).where(F.col("i") <= k)
    return best.groupBy("qkey").agg(F.when(F.count(F.lit(1)) == k, F.min("x")).otherwise(F.lit(float("-inf"))).alias("floor"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of ``vectors`` with the greatest product with each query row, except rows of its own id."""
    shelf = Shelf(vectors.sparkSession, "vectors")
    classes = distinct_vectors(usable(vectors, id_col, vec_col, scale), k)
    classes = shelf.put(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    asked = usable(queries, id_col, vec_col, scale).groupBy("id", "v").agg(F.count(F.lit(1)).alias("n"))
    asked = shelf.put(asked.withColumn("qkey", F.monotonically_increasing_id()), "asked")
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    if not size["n"]:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks = max(1, -(-size["n"] * max(1, size["width"] or 0) * 8 // BLOCK_BYTES))
    dealt = shelf.put(asked.withColumn("block", F.pmod(F.xxhash64("qkey"), F.lit(blocks)).cast("int")), "dealt", "block")
    edges = fit_edges(classes)
    cells = shelf.put(approximations(classes, edges), "cells")
    for block in query_blocks(dealt, blocks):
        left = shelf.add(bounds(cells, block, edges, k), "bounds")
    left = left.join(_kth(left, F.col("lower"), k), "qkey").where("upper >= floor").drop("floor")
    left = shelf.put(left.withColumn("i", F.row_number().over(Window.partitionBy("qkey").orderBy(F.desc("upper"), "cid"))), "left")
    near = shelf.put(exact_scores(left.where(F.col("i") <= k), asked, classes), "near")
    open_ = left.where(F.col("i") > k).join(_kth(near, F.when(F.col("over") == 0, F.col("score") / UNIT**2).otherwise(F.col("over") * float("inf")), k), "qkey").where("upper >= floor")
    far = exact_scores(open_, asked, classes)
    scored = shelf.put(near.unionByName(far), "scored")
    shelf.clear("classes", "asked", "scored")
    rows = scored.join(classes.select("cid", "ids"), "cid").join(asked.select("qkey", F.col("id").alias("query_id"), "n"), "qkey")
    rows = rows.select("qkey", "query_id", "n", "score", "over", F.explode("ids").alias("c")).where(F.col("c.id") != F.col("query_id"))
    rows = rows.select("*", F.col("c.id").alias("vec_id"), F.explode(F.sequence(F.lit(1).cast("long"), "c.n")))
    order = Window.partitionBy("qkey").orderBy(F.desc("over"), F.desc("score"), "vec_id")
    score = F.when(F.col("over") == 0, F.col("score")).otherwise(F.raise_error(F.lit("a score is beyond a long")).cast("long"))
    best = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    again = best.select("query_id", "rank", "vec_id", "score", "over", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    return again.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", score.alias("score"))


def op4_va_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all embeddings for every vec_id divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 20 = 0"))


ORACLE_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
