"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A labelled text's grade is its quality plus one if it is not toxic: 0 to 2. One
vector of weights over hashed text features scores a text; ordered thresholds
turn the score into ``P(grade > k) = 1 / (1 + exp(threshold_k - score))``. Hence
the expected grade, and the tail probability of the best grade, by which texts
are selected.

Features are the distinct words (letters and digits, lower-cased), the distinct
runs of other characters, and binned shares of the text: capitals, marks,
repeats of the word before, distinct words, words per mark. The model is fitted on the driver on
a sample of the labelled rows that ``SAMPLE`` bounds; every row is then scored
by a map over the table, with no shuffle.

Defined cases: a null or empty text has the bins alone; labels that are null or
outside 0 and 1 are not used; a text with several labels counts for each, equal
ones as a weight; with
no labelled rows every text has the neutral score and is kept; repeated rows
are scored each; an empty table gives no rows; columns of the table pass through,
and an added one whose name is taken has underscores before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alnum_mask, flat, fresh, lower_table, mixed, range_hashes, slices, small_batches, spans, table

#: log2 of the number of weights, and the most labelled rows that are fitted on.
WIDTH, SAMPLE = 18, 12_000
GRADES = 3
#: Least tail probability of the best grade for a text to stay.
KEEP = 0.5


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of every text, ascending and distinct, and n + 1 offsets."""
    data, offsets = flat(column)
    words_in, lower = alnum_mask(), lower_table()
    marks_in = ~words_in
    marks_in[[9, 10, 11, 12, 13, 32]] = False
    upper_in = np.zeros(256, bool)
    upper_in[65:91] = True
    parts, counts = [], []
    for at, to in slices(offsets):
        raw, offs = data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        low, n = lower[raw], to - at
        ws, we, wf = spans(low, offs, words_in)
        ms, me, mf = spans(low, offs, marks_in)
        wh, mh = range_hashes(low, ws, we), range_hashes(low, ms, me) ^ np.uint64(0x5BD1E995)
        word_count, mark_count = np.diff(wf), np.diff(mf)
        wd, md = np.repeat(np.arange(n), word_count), np.repeat(np.arange(n), mark_count)
        again = np.zeros(len(wh), bool)
        again[1:] = (wh[1:] == wh[:-1]) & (wd[1:] == wd[:-1])
        by_row = lambda rows: np.bincount(rows, minlength=n)
        upper = np.concatenate([[0], np.cumsum(upper_in[raw])])
        distinct = np.unique((wd.astype(np.uint64) << np.uint64(40)) | (wh >> np.uint64(24)))
        size, words = np.maximum(np.diff(offs), 1), np.maximum(word_count, 1)
        shares = (
            (upper[offs[1:]] - upper[offs[:-1]]) / size,
            np.bincount(md, weights=(me - ms), minlength=n) / size,
            by_row(wd[again]) / words,
            by_row((distinct >> np.uint64(40)).astype(np.int64)) / words / np.maximum(1, np.log2(words)) * 4,
            mark_count / words,
        )
        rows, ids = [wd, md], [wh, mh]
        for k, share in enumerate(shares):
            bins = np.minimum(np.floor(np.asarray(share) * 20), 40).astype(np.uint64)
            rows.append(np.arange(n))
            ids.append(mixed(bins + np.uint64(1000 * (k + 1))))
        keys = (np.concatenate(rows).astype(np.uint64) << np.uint64(WIDTH)) | (np.concatenate(ids) >> np.uint64(64 - WIDTH))
        keys = np.unique(keys)
        counts.append(by_row((keys >> np.uint64(WIDTH)).astype(np.int64)))
        parts.append((keys & np.uint64((1 << WIDTH) - 1)).astype(np.int32))
    return np.concatenate([*parts, np.zeros(0, np.int32)]), np.concatenate([[0], np.cumsum(np.concatenate([*counts, np.zeros(0, np.int64)]))]).astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


@dataclass
class Model:
    """Weights by feature, and thresholds between the grades, ascending."""

    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        return _sums(self.weights[ids].astype(np.float64), first)

    def tails(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """P(grade > k) for every k but the last, a column each."""
        return _sigmoid(self.scores(ids, first)[:, None] - self.thresholds[None, :])


def neutral() -> Model:
    """All grades but the best are unlikely: nothing is known against any text."""
    return Model(np.zeros(1 << WIDTH, np.float32), np.arange(-GRADES + 1, 0, dtype=np.float64))


def fit(ids: np.ndarray, first: np.ndarray, grades: np.ndarray, steps: int = 120, rate: float = 0.08, decay: float = 2e-4, counts: np.ndarray | None = None) -> Model:
    """Maximum likelihood with a small L2 penalty, by Adam on all rows, each as often as ``counts`` says; the gradients are exact.

    Thresholds are a first one and positive gaps, so they stay in order.
    """
    n = len(grades)
    if not n:
        return neutral()
    counts = np.ones(n) if counts is None else counts
    total = counts.sum()
    used, at = np.unique(ids, return_inverse=True)
    row = np.repeat(np.arange(n), np.diff(first))
    share = [np.clip(counts[grades > k].sum() / total, 0.01, 0.99) for k in range(GRADES - 1)]
    cuts = np.array([-np.log(s / (1 - s)) for s in share])
    gaps = np.log(np.maximum(np.diff(cuts), 0.1))
    w = np.zeros(len(used))
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, cuts[:1], gaps)]
    params = [w, cuts[:1].copy(), gaps]
    for step in range(1, steps + 1):
        w, base, gap = params
        theta = np.concatenate([base, base + np.cumsum(np.exp(gap))])
        score = _sums(w[at], first)
        below = np.concatenate([np.zeros((n, 1)), _sigmoid(theta[None, :] - score[:, None]), np.ones((n, 1))], axis=1)
        hi, lo = below[np.arange(n), grades + 1], below[np.arange(n), grades]
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = counts * hi * (1 - hi) / p, counts * lo * (1 - lo) / p
        dscore = (dhi - dlo) / total  # of the negative log likelihood
        gw = np.bincount(at, weights=dscore[row], minlength=len(used)) + decay * w
        dtheta = np.array([(-dhi[grades == k].sum() + dlo[grades == k + 1].sum()) / total for k in range(GRADES - 1)])
        grads = [gw, np.array([dtheta.sum()]), np.exp(gap) * np.cumsum(dtheta[::-1])[::-1][1:]]
        for j, g in enumerate(grads):
            m, v = state[j]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            params[j] = params[j] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    w, base, gap = params
    weights = np.zeros(1 << WIDTH, np.float32)
    weights[used] = w
    return Model(weights, np.concatenate([base, base + np.cumsum(np.exp(gap))]))


def graded(labels: DataFrame) -> DataFrame:
    """(key, grade) of the labels that are in order."""
    ok = F.col("quality").isin(0, 1) & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()
    return labels.where(ok).select(F.col("doc_id").cast("long").alias("key"), (F.col("quality") + 1 - F.col("toxic")).cast("int").alias("grade"))


def chosen_labels(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(key, grade, count): about ``sample`` rows at most, however often labels repeat.

    Of N labels one in ``every`` = N / sample counts. Those of one id and grade
    are one row: a hash of the id takes it with probability n / every and count
    1, or for certain, with count n / every, where they are more than that.
    """
    known = graded(labels)
    every = max(1, -(-known.count() // sample))
    groups = known.groupBy("key", "grade").agg(F.count(F.lit(1)).alias("n"))
    chosen = groups.where(F.pmod(F.xxhash64("key"), F.lit(every)) < F.col("n"))
    return chosen.select("key", "grade", F.greatest(F.lit(1.0), F.col("n") / every).alias("count"))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, offsets, grades and counts of at most about ``sample`` labelled texts, chosen by a hash of their ids.

    Of rows that share an id one stands for it, that with the least hash of its
    text, so an id that many rows have weighs no more than another one.
    """
    chosen = chosen_labels(labels, sample)
    texts = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "key")  # of bounded size
    texts = texts.groupBy("key", "grade", "count").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("key", "text", "grade", "count")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, first = features(batch.column(1))
            raw = [ids[first[i] : first[i + 1]].tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:4], pa.array(raw, pa.binary())], ["key", "grade", "count", "ids"])

    small_batches(texts)
    got = texts.mapInArrow(run, "key long, grade int, count double, ids binary").toArrow().sort_by([("key", "ascending"), ("grade", "ascending"), ("ids", "ascending")])
    parts = [np.frombuffer(x, np.int32) for x in got["ids"].to_pylist()]
    return np.concatenate([*parts, np.zeros(0, np.int32)]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64), got["grade"].to_numpy().astype(np.int64), got["count"].to_numpy()


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    *rows, counts = training_rows(docs, labels, id_col, text_col, sample)
    return fit(*rows, counts=counts)


ADDED = ("expected_grade", "tail", "p_above_0", "keep")


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with expected_grade, tail (of the best grade), p_above_0 and keep added, by names that docs leaves free."""
    names = fresh(docs.columns, *ADDED)
    kinds = [(T.DoubleType(), pa.float64())] * 3 + [(T.BooleanType(), pa.bool_())]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, kind) for n, (kind, _) in zip(names, kinds, strict=True))])
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))  # 2**WIDTH weights
    place = docs.columns.index(text_col)
    small_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for batch in batches:
            tails = own.tails(*features(batch.column(place)))
            values = [tails.sum(axis=1), tails[:, -1], tails[:, 0], tails[:, -1] >= KEEP]
            arrays = [*batch.columns, *(pa.array(v, kind) for v, (_, kind) in zip(values, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, [f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)


def selected(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that the model keeps, with their own columns."""
    keep = fresh(docs.columns, *ADDED)[-1]
    return scored(docs, model, text_col).where(F.col(keep)).select(*docs.columns)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored by a model of the labelled ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).drop("text")
