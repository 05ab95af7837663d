"""What the operators share: tables, the scratch folder, and text in numpy.

Texts reach Python as Arrow batches. They are handled as one byte array per
slice of a few MB, so word splitting and hashing are a handful of numpy passes
and the memory a task needs does not depend on the number of rows in a batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch that goes to Python; a longer row is a batch of its own.
BATCH_BYTES = 8 << 20
#: Bytes of text that numpy handles at a time.
SLICE_BYTES = 2 << 20
#: Parquet's settings for tables of rows of MBs: bytes of a row group, and after how many rows, at least and at most, sizes are looked at.
LONG_ROWS = {"parquet.block.size": str(4 << 20)} | {f"parquet.{x}.size.row.check.{y}": "1" for x in ("block", "page") for y in ("min", "max")}
#: Word separators: space and \x09-\x0D.
SPACES = (9, 10, 11, 12, 13, 32)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, which spark.checkpoint.dir names.

    Only a session within one machine may leave that setting out.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "/tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/lexigrade-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends here."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Shelf:
    """The tables that one run of an operator writes; ``clear`` deletes those that its result does not read."""

    def __init__(self, spark: SparkSession, name: str, codec: str = "zstd"):
        """zstd makes the smaller files; its buffers lie outside the heap, where tasks that write many small files heap them up."""
        self.spark, self.root, self.count, self.codec = spark, scratch(spark, name), 0, codec

    def put(self, df: DataFrame, name: str, *by: str, long_rows: bool = False) -> DataFrame:
        """df as a table, in folders by some columns.

        Parquet's writer looks at its buffers every 100 rows, and its reader takes up
        to 4096 of a row group at once: with rows of MBs (``long_rows``) it looks at
        each one, and row groups are small.
        """
        self.count += 1
        path = f"{self.root}/{self.count:03}-{name}"
        df.write.options(compression=self.codec, **(LONG_ROWS if long_rows else {})).partitionBy(*by).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def add(self, df: DataFrame, name: str) -> DataFrame:
        """Appends df to the table of this name, and returns it as it is then."""
        path = f"{self.root}/000-{name}"
        df.write.option("compression", self.codec).mode("append").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self, *keep: str) -> None:
        """Deletes all tables but the latest of each name in ``keep``; a new run writes what it needs again."""
        self._delete(lambda found: set(found) - {max(p for p in found if p[4:] == k) for k in keep if any(p[4:] == k for p in found)})

    def drop(self, *names: str) -> None:
        """Deletes the tables of some names: those that no later step, and no repeat of one, reads."""
        self._delete(lambda found: {p for p in found if p[4:] in names})

    def _delete(self, which: Callable[[list[str]], set[str]]) -> None:
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        files = root.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not files.exists(root):
            return
        for p in which([s.getPath().getName() for s in files.listStatus(root)]):
            files.delete(jvm.org.apache.hadoop.fs.Path(root, p), True)


def small_batches(df: DataFrame) -> None:
    """Bounds the bytes of Arrow batches. All operators want the same bound, so it holds for plans that run later, too."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to clash with no column; Spark ignores case."""
    have, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def int_words(text_col: str) -> F.Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` of a text; null counts 0."""
    tidy = F.trim(F.translate(F.col(text_col), "\t\n\x0b\x0c\r", "     "))
    return F.when(F.length(F.coalesce(tidy, F.lit(""))) == 0, F.lit(0)).otherwise(
        F.size(F.split(tidy, " +", -1))
    ).cast("long")


# ---------------------------------------------------------------- text in numpy


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and n + 1 offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes, or of one longer row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


def lower_table() -> np.ndarray:
    """Byte map that lower-cases A-Z alone."""
    lut = np.arange(256, dtype=np.uint8)
    lut[65:91] += 32
    return lut


def space_mask() -> np.ndarray:
    """Which bytes are within a word, for words parted by white space."""
    inside = np.ones(256, bool)
    inside[list(SPACES)] = False
    return inside


def alnum_mask() -> np.ndarray:
    """Which bytes are within a word, for words of letters, digits and all beyond ASCII."""
    inside = np.zeros(256, bool)
    inside[48:58] = inside[65:91] = inside[97:123] = inside[128:] = True
    return inside


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the first word of every row (n + 1 values).

    No word crosses from one row into the next.
    """
    mask = np.zeros(len(data) + 2, np.int8)
    mask[1:-1] = inside[data]
    step = np.diff(mask)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    cuts = offsets[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
    if len(cuts):
        cuts = cuts[(mask[cuts] == 1) & (mask[cuts + 1] == 1)]  # a word on both sides of a row's edge
        if len(cuts):
            starts = np.sort(np.concatenate([starts, cuts]))
            ends = np.sort(np.concatenate([ends, cuts]))
    return starts, ends, np.searchsorted(starts, offsets)


_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of x reaches every bit of the result."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base of the rolling hash, and of its inverse."""
    if len(_powers["up"]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _P), ("down", _P_INV)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            with np.errstate(over="ignore"):
                _powers[name] = np.multiply.accumulate(row)
    return _powers["up"][:n], _powers["down"][:n]


def range_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of symbols[start:end] for every range.

    A polynomial over prefix sums modulo 2**64, so the cost does not depend on
    how far the ranges overlap; the length is mixed in.
    """
    up, down = powers(len(symbols) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum((symbols.astype(np.uint64) + np.uint64(0x1F35)) * up[:-1], out=sums[1:])
        out = (sums[ends] - sums[starts]) * down[starts]
        return mixed(out + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def ragged(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and n + 1 offsets."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values, kind))
