"""Document fingerprints by winnowing.

Every k-gram of code points gets a rolling 64-bit hash; of each window of w
consecutive grams the smallest hash is chosen, the rightmost of equal ones. So
any passage of at least ``w + k - 1`` code points that two texts share puts a
common hash into both fingerprints, at a known position. The rolling hash is a
prefix sum and the window minimum two running minima, all in numpy.

Defined cases: a null text is empty; an empty text has an empty fingerprint; a
text of 1 to k - 1 code points has one gram, itself; two empty fingerprints
have likeness 1, an empty and another one 0; rows of equal ids are ordered by
a hash of the text, then by text, and null ids come last; a single row is its
own next; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import range_hashes, shuffle_partitions, small_batches, table

K, WINDOW = 32, 64


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def winnowed(points: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (32 bits) and positions of the chosen grams, by position."""
    n = len(points)
    if n == 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    starts = np.arange(max(1, n - k + 1))
    hashes = range_hashes(points, starts, np.minimum(starts + k, n))
    m = len(hashes)
    window = min(window, m)
    # Hash above, position counted down below: the least key of a window is its least hash, the rightmost of equal ones.
    low = np.uint64(0xFFFFFFFF)
    keys = (hashes & ~low) | (low - starts.astype(np.uint64))
    # Minima from each block's start and to each block's end; a window spans the end of one block and the start of the next.
    blocks = -(-m // window)
    grid = np.full(blocks * window, np.iinfo(np.uint64).max, np.uint64)
    grid[:m] = keys
    grid = grid.reshape(blocks, window)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[: m - window + 1], ahead[window - 1 : m])
    chosen = least[np.concatenate([[True], least[1:] != least[:-1]])]
    return (chosen >> np.uint64(32)).astype(np.uint32), (low - (chosen & low)).astype(np.int64)


def printed(fingerprint: tuple[np.ndarray, np.ndarray]) -> str:
    """``hash@position`` of every chosen gram, both in hexadecimal, joined by spaces."""
    hashes, positions = fingerprint
    return " ".join([f"{h:x}@{p:x}" for h, p in zip(hashes.tolist(), positions.tolist(), strict=True)])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two fingerprints' sets of hashes."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def edited(text: str, following: str) -> str:
    """text with its last quarter replaced by as much of the start of the following one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """id_col, n_chars, fingerprint of every row: a map over the rows, without a shuffle."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    small_batches(rows)
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            prints = [printed(winnowed(code_points(t), k, window)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(prints, pa.string())], ["id", "n_chars", "fingerprint"])

    return rows.mapInArrow(run, f"id {kind}, n_chars long, fingerprint string").withColumnRenamed("id", id_col)


def in_order(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """Rows (bucket, tail, id, h, g, text, copies) in buckets of the order, each followed by the first row of the next; and the number of buckets.

    Bounds of buckets are approximate quantiles of the ids, of a number that
    follows the number of shuffle partitions. An id with more rows than two
    buckets should have is split by the hash of its texts, and a text that is
    repeated as often under one id is one row with its number of copies. There
    are at most as many such ids and texts as buckets.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("h"), F.xxhash64(text, F.lit(1)).alias("g"))
    n = shuffle_partitions(spark)
    asked = F.percentile_approx("id", [i / n for i in range(1, n)] or [0.5], 10_000)
    total, cuts = rows.agg(F.count(F.lit(1)), asked).first()
    most = max(1, 2 * total // n)
    heavy = {r["id"]: r["count"] for r in rows.groupBy("id").count().where(F.col("count") > most).collect()}
    rows = rows.withColumn("copies", F.lit(1).cast("long"))
    if heavy:
        again = rows.groupBy("id", "h", "g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).collect()
        if again:
            known = F.broadcast(spark.createDataFrame([tuple(r)[:3] for r in again], "i long, x long, y long"))
            same = F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("x")) & (F.col("g") == F.col("y"))
            packed = rows.join(known, same, "left_semi").groupBy("id", "h", "g").agg(F.min("text").alias("text"), F.sum("copies").alias("copies"))
            rows = rows.join(known, same, "left_anti").unionByName(packed)
    cuts = sorted({*(cuts or []), *(i for i in heavy if i is not None)})
    parts = {i: -(-2 * c // most) for i, c in heavy.items()}
    # Places: ids by the cuts below or at them, null ids after all; of a split id by hash, what follows it in its range behind.
    first, places = {}, 0
    for base, start in enumerate([None, *cuts, "null"]):
        first[base] = places
        places += 1 + (parts.get(None, 0) if start == "null" else parts.get(start, 0) if start is not None else 0)
    bounds = F.array(*map(F.lit, cuts)).cast("array<long>")
    base = F.when(F.col("id").isNull(), F.lit(len(cuts) + 1)).otherwise(F.size(F.filter(bounds, lambda c: c <= F.col("id"))))
    share = F.col("h").cast("double") / 2.0**64 + 0.5
    sub = F.lit(0)
    for i, m in parts.items():
        within = F.least(F.lit(m - 1), F.floor(share * m).cast("int"))
        behind = (F.col("id") > F.lit(i)) & (F.col("id") < F.lit(min((c for c in cuts if c > i), default=(1 << 63) - 1))) if i is not None else F.lit(False)
        sub = F.when(F.col("id").eqNullSafe(F.lit(i).cast("long")), within).when(F.coalesce(behind, F.lit(False)), F.lit(m)).otherwise(sub)
    place = F.element_at(F.array(*[F.lit(first[b]) for b in sorted(first)]), base + 1) + sub
    rows = rows.withColumn("place", place.cast("int"))
    key = F.struct(F.col("id").isNull().alias("none"), "id", "h", "g")
    least = rows.groupBy("place").agg(F.min(key).alias("k")).orderBy("place").collect()  # a row per bucket
    if not least:
        return rows.selectExpr("0 AS bucket", "0 AS tail", "id", "h", "g", "text", "copies"), 1
    of = {r["place"]: b for b, r in enumerate(least)}
    buckets = len(of)
    number = F.create_map(*[F.lit(x) for pair in of.items() for x in pair])
    rows = rows.select(F.element_at(number, F.col("place")).alias("bucket"), F.lit(0).alias("tail"), "id", "h", "g", "text", "copies")
    heads = F.broadcast(spark.createDataFrame([((b - 1) % buckets, r["k"]["id"], r["k"]["h"], r["k"]["g"]) for b, r in enumerate(least)], "to int, i long, x long, y long"))
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("x")) & (F.col("g") == F.col("y"))
    tails = rows.join(heads, same).groupBy(F.col("to").alias("bucket"), "id", "h", "g").agg(F.min("text").alias("text"))
    return rows.unionByName(tails.withColumns({"tail": F.lit(1), "copies": F.lit(1).cast("long")})), buckets


_PAIR_FIELDS = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, copies long"


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprints of every row and of its edited text, and their likeness.

    A bucket is a task; it is streamed in order with one row held back, so memory
    holds two texts, and texts are shuffled once.
    """
    rows, buckets = in_order(docs, id_col, text_col)
    small_batches(rows)
    dealt = rows.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "tail", F.col("id").asc_nulls_last(), "h", "g", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out = []
            for tail, doc, text, copies in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                own = winnowed(code_points(text), k, window)
                for before, was, mark, after, follows, n in _neighbours(held, text, own):
                    new = edited(before, after)
                    other = mark if new == before else winnowed(code_points(new), k, window)
                    digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((was, len(before), digest, printed(mark), printed(other), likeness(mark[0], other[0]), likeness(mark[0], follows[0]), n))
                held = None if tail else (doc, text, own, copies)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64())
            columns = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _PAIR_FIELDS.split(", ")])

    out = dealt.select("tail", "id", "text", "copies").mapInArrow(run, _PAIR_FIELDS).withColumnRenamed("id", id_col)
    return out.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies")


def _neighbours(held: tuple | None, text: str, own: tuple) -> Iterator[tuple]:
    """(text, id, fingerprint, next text, its fingerprint, times) of a row held back: its copies follow each other, the last one is followed by text."""
    if held is not None:
        doc, before, mark, copies = held
        if copies > 1:
            yield before, doc, mark, before, mark, copies - 1
        yield before, doc, mark, text, own, 1


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and its edited text."""
    return with_next(table(spark, sf_dir, "documents"))


#: The columns that SQL can tell of what the contract fixes.
FACTS_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
o AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS following FROM t)
SELECT doc_id, length(t) AS n_chars, sha256(substr(t, 1, length(t) - length(t) // 4) || substr(following, 1, length(t) // 4)) AS edited_sha256 FROM o
"""


def fixed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op7 that SQL can tell."""
    return op7_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")
