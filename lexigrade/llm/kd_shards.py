"""Shards by a k-d tree over metadata, in DataFrame functions alone.

Law ``bytes``: the leaves of the tree are the shards, and their sizes are near
equal. The tree's points are the groups of equal texts, weighted by their bytes,
so copies share a shard unless a cut falls into a large group: one with more than
1/GRAIN of a shard's bytes, or 1/ROW_GRAIN of its rows, is dealt into pieces of
about that size, which keep its place in the tree.

1. Rows are reduced to id, size, checksum, a hash of the text, and metadata.
   Groups are summed before they are shuffled; the large ones are fewer than
   (GRAIN + ROW_GRAIN) * shards and are broadcast.
2. Every point has a coordinate per dimension: 30 bits of the value's place
   between the least and the greatest one, and 32 bits of the point's hash, which
   part points of equal values.
3. Level by level, every node is cut along its widest dimension where its left
   side holds its share of the bytes: half, or the nearest to it that whole shards
   allow. The weighted median is found by histograms, a partial aggregation each:
   the bin that holds it is parted again until it is light enough. A pass brings
   BINS rows a node to the driver, so as many as shards ask for, whatever the rows.
4. Rows meet their point's shard. They are sorted by shard and group into ranges
   and written, and a row's slot follows from its place within its range and the
   counts of the ranges before it.

Defined cases: a null text counts no bytes and equals an empty one; null
metadata and ids have the least coordinate; rows that repeat id and text are
told apart by their place in the input, so they can be dealt like any others;
fewer points than shards leave shards empty, and so does a document that is
larger than a shard's share; an empty table gives no rows; other columns play no
part, whatever their names are.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shelf, shuffle_partitions, table

#: Bytes that a row counts besides its text.
ROW_BYTES = 16
#: The parts of a shard's bytes and rows beyond which a group is dealt into pieces.
GRAIN, ROW_GRAIN = 32, 4
#: Bins of a histogram, and the part of a shard's bytes that a cut may miss.
BINS, MISS = 256, 1 / 1000
#: Steps of a dimension.
STEPS = 1 << 30


def metadata() -> dict[str, Column]:
    """The dimensions of documents, as doubles: length, source, language, and the order of ids. Names are placed by their hash."""
    return {
        "length": F.log(F.col("size").cast("double")),
        "source": F.xxhash64("source").cast("double"),
        "lang": F.xxhash64("lang").cast("double"),
        "order": F.col("id").cast("double"),
    }


@dataclass
class Node:
    """Shards first to first + count - 1; and, while its cut is sought, the range of keys that holds it and the bytes before that."""

    first: int
    count: int
    dim: int = 0
    low: int = 0
    high: int = 0
    below: float = 0.0
    total: float = 0.0
    cut: int | None = None

    @property
    def left(self) -> int:
        return self.count // 2

    @property
    def open(self) -> bool:
        return self.cut is None and self.count > 1 and self.total > 0


def reduced(docs: DataFrame, id_col: str, text_col: str, source_col: str | None, lang_col: str | None) -> DataFrame:
    """(id, source, lang, size, crc, key, place) of every row; key stands for the text, place for the row."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    part = lambda c: (F.col(c) if c in docs.columns else F.lit(None)).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), part(source_col).alias("source"), part(lang_col).alias("lang"), text.alias("text"))
    return rows.select(
        "id", "source", "lang", (F.octet_length("text") + F.lit(ROW_BYTES)).cast("long").alias("size"), F.crc32("text").alias("crc"),
        F.xxhash64("text").alias("key"), F.monotonically_increasing_id().alias("place"),
    )


def points(shelf: Shelf, rows: DataFrame, shards: int, dims: Mapping[str, Column]) -> tuple[DataFrame, DataFrame, float]:
    """rows with the piece of their group; the points (key, piece, bytes, at), at being their keys per dimension; and all bytes."""
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.approx_count_distinct("id").alias("ids"), F.min(F.struct("id", "source", "lang", "size")).alias("meta"))
    groups = shelf.put(groups, "groups")
    whole = groups.agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).first()
    grain_bytes, grain_rows = (max(1.0, (whole[c] or 0) / (g * shards)) for c, g in (("bytes", GRAIN), ("n", ROW_GRAIN)))
    pieces = F.ceil(F.greatest(F.col("bytes") / grain_bytes, F.col("n") / grain_rows)).cast("int")
    large = groups.where((pieces > 1) & (F.col("n") > 1)).select(
        "key", pieces.alias("pieces"), (F.col("ids") >= GRAIN * pieces).alias("by_id"), F.col("meta").alias("large")
    )  # under (GRAIN + ROW_GRAIN) * shards rows
    dealt = F.when(F.col("by_id"), F.xxhash64("id")).otherwise(F.xxhash64("place"))
    rows = rows.join(F.broadcast(large), "key", "left").withColumn("piece", F.coalesce(F.pmod(dealt, F.col("pieces").cast("long")), F.lit(0)).cast("int"))
    rows = shelf.put(rows.drop("pieces", "by_id"), "rows")
    units = rows.groupBy("key", "piece").agg(F.sum("size").cast("double").alias("bytes"), F.coalesce(F.first("large"), F.min(F.struct("id", "source", "lang", "size"))).alias("meta"))
    named = units.select("key", "piece", "bytes", "meta.*").select("key", "piece", "bytes", *[F.when(~F.isnan(c), c).alias(k) for k, c in dims.items()])
    named = shelf.put(named, "points")
    ends = named.agg(*[f(k).alias(f"{k}_{at}") for k in dims for at, f in (("low", F.min), ("high", F.max))]).first()
    tie = F.xxhash64("key", "piece").bitwiseAND(F.lit((1 << 32) - 1))

    def coordinate(k: str) -> Column:
        low, high = ends[f"{k}_low"], ends[f"{k}_high"]
        if low is None or high <= low:
            return tie
        at = F.coalesce(F.floor((F.col(k) - F.lit(low)) / F.lit(high - low) * F.lit(STEPS - 1)), F.lit(0)).cast("long")
        return F.shiftleft(at, 32) + tie

    return rows.drop("large"), named.select("key", "piece", "bytes", F.array(*[coordinate(k) for k in dims]).alias("at")), float(whole["bytes"] or 0)


def moved(units: DataFrame, nodes: list[Node], below: list[Node]) -> DataFrame:
    """units with ``node`` numbered by the level below."""
    first = {n.first: k for k, n in enumerate(below)}
    left = [first[n.first] for n in nodes]
    right = [first[n.first + n.left] if n.cut is not None else first[n.first] for n in nodes]
    cut = F.get(F.lit([n.cut if n.cut is not None else 0 for n in nodes]).cast("array<long>"), F.col("node"))
    key = F.get(F.col("at"), F.get(F.lit([n.dim for n in nodes]), F.col("node")))
    child = F.when(key < cut, F.get(F.lit(left), F.col("node"))).otherwise(F.get(F.lit(right), F.col("node")))
    return units.withColumn("node", child)


def widest(units: DataFrame, nodes: list[Node], dims: int) -> None:
    """Sets every node's widest dimension, the range of its keys there, and its bytes."""
    ends = [f(F.get("at", F.lit(d))).alias(f"{k}{d}") for d in range(dims) for k, f in (("low", F.min), ("high", F.max))]
    for r in units.groupBy("node").agg(F.sum("bytes").alias("bytes"), *ends).collect():  # a row a node
        n = nodes[r["node"]]
        n.dim = max(range(dims), key=lambda d: ((r[f"high{d}"] >> 32) - (r[f"low{d}"] >> 32), -d))
        n.low, n.high, n.total = r[f"low{n.dim}"], r[f"high{n.dim}"], r["bytes"]


def narrowed(units: DataFrame, nodes: list[Node], miss: float) -> None:
    """One histogram over the ranges that still hold a cut: the bin with the cut is the next range, or gives the cut."""
    search = [n.open for n in nodes]
    low, high = ([getattr(n, k) for n in nodes] for k in ("low", "high"))
    width = [max(1, -(-(n.high - n.low + 1) // BINS)) for n in nodes]
    at = lambda values, kind: F.get(F.lit(values).cast(f"array<{kind}>"), F.col("node"))
    key = F.get(F.col("at"), at([n.dim for n in nodes], "int"))
    rows = units.where(at(search, "boolean")).select("node", "bytes", key.alias("k"), at(low, "long").alias("low"), at(high, "long").alias("high"), at(width, "long").alias("width"))
    rows = rows.where("k BETWEEN low AND high").groupBy("node", F.expr("(k - low) div width").alias("bin"))
    bins = rows.agg(F.sum("bytes").alias("bytes"), F.min("k").alias("low"), F.max("k").alias("high")).collect()  # BINS rows a node
    for r in sorted(bins, key=lambda r: (r["node"], r["bin"])):
        n = nodes[r["node"]]
        share = n.total * n.left / n.count
        if n.cut is not None or not search[r["node"]]:
            continue
        if n.below + r["bytes"] < share:
            n.below += r["bytes"]
            continue
        search[r["node"]] = False
        if r["bytes"] <= miss or r["low"] == r["high"]:
            before = share - n.below <= n.below + r["bytes"] - share  # the nearer side of the bin
            n.cut = r["low"] if before else r["high"] + 1
        else:
            n.low, n.high = r["low"], r["high"]


def leaves(shelf: Shelf, units: DataFrame, shards: int, dims: int, total: float) -> DataFrame:
    """units with their shard in ``node``. Each level is written, so that none is computed again by the passes over the next."""
    nodes, at = [Node(0, shards)], shelf.put(units.withColumn("node", F.lit(0)), "level")
    while any(n.count > 1 for n in nodes):
        widest(at, nodes, dims)
        while any(n.open for n in nodes):
            before = [(n.low, n.high) for n in nodes]
            narrowed(at, nodes, total / shards * MISS)
            for n, old in zip(nodes, before, strict=True):
                if n.open and (n.low, n.high) == old:
                    n.cut = n.high + 1  # sums of doubles fell short of the share: all goes left
        below = []
        for n in nodes:
            if n.count > 1:
                n.cut = n.low if n.cut is None else n.cut  # of a node without points any cut will do
                below.append(Node(n.first, n.left))
            below.append(Node(n.first + n.left, n.count - n.left) if n.count > 1 else Node(n.first, 1))
        at, nodes = shelf.put(moved(at, nodes, below), "level"), below
    return at


def numbered(shelf: Shelf, rows: DataFrame) -> DataFrame:
    """rows (shard, ...) with slot, from 0 without gaps within a shard, equal texts together.

    No task numbers a whole shard: ranges of the sorted rows are numbered each.
    """
    order = ["shard", "key", "piece", "id", "size", "place"]
    ranges = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    ranges = shelf.put(ranges.withColumn("i", F.monotonically_increasing_id()), "sorted").withColumn("range", F.shiftright("i", 33))
    parts = ranges.groupBy("shard", "range").agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("n")).collect()  # shards and ranges, added
    seen: dict[int, int] = {}
    offsets = []
    for r in sorted(parts, key=lambda r: (r["shard"], r["range"])):
        offsets.append((r["shard"], r["range"], seen.get(r["shard"], 0) - r["first"]))
        seen[r["shard"]] = seen.get(r["shard"], 0) + r["n"]
    shift = rows.sparkSession.createDataFrame(offsets, "shard int, range long, shift long")
    return ranges.join(F.broadcast(shift), ["shard", "range"]).withColumn("slot", F.col("i") + F.col("shift"))


def sharded(
    docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", lang_col: str = "lang", dims: Mapping[str, Column] | None = None,
) -> DataFrame:
    """(id, size, crc, shard, slot): all rows in so many shards, or in as many as leaves of ``target_bytes`` take."""
    if (shards is None) == (target_bytes is None) or (shards or target_bytes) < 1:
        raise ValueError("either shards or target_bytes must be given, and positive")
    dims = dims or metadata()
    shelf = Shelf(docs.sparkSession, "shards", "snappy")  # a dozen narrow tables
    rows = shelf.put(reduced(docs, id_col, text_col, source_col, lang_col), "reduced")
    if shards is None:
        shards = max(1, -(-(rows.agg(F.sum("size")).first()[0] or 0) // target_bytes))
    rows, units, total = points(shelf, rows, shards, dims)
    at = leaves(shelf, units, shards, len(dims), total).select("key", "piece", F.col("node").alias("shard"))
    out = numbered(shelf, rows.join(at, ["key", "piece"]))
    shelf.clear("sorted")
    return out.select("id", "size", "crc", "shard", "slot")


SHARDS = 40


def op12_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    out = sharded(table(spark, sf_dir, "documents"), SHARDS)
    return out.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def fixed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document what SQL can tell: its size and law, and that its shard and slot are in bounds and its shard near the mean."""
    out = op12_kd_shards(spark, sf_dir)
    sizes = out.groupBy("shard").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.countDistinct("slot").alias("slots"), F.max("slot").alias("last"), F.max("size").alias("longest"))
    mean = sizes.agg((F.sum("bytes") / SHARDS).alias("mean"), F.max("longest").alias("longest"))
    even = sizes.crossJoin(F.broadcast(mean.withColumnRenamed("longest", "most"))).select(
        "shard", (F.abs(F.col("bytes") - F.col("mean")) <= F.greatest(F.col("mean") * 0.02, F.col("most"))).alias("even"), ((F.col("n") == F.col("slots")) & (F.col("last") + 1 == F.col("n"))).alias("gapless")
    )
    return out.join(even, "shard").select("doc_id", "size", "law", "grown_shard", F.col("shard").between(0, SHARDS - 1).alias("in_bounds"), "even", "gapless")


FACTS_SQL = f"""
SELECT doc_id, CAST(strlen(coalesce(text, '')) + {ROW_BYTES} AS BIGINT) AS size, 'bytes' AS law, CAST(NULL AS INT) AS grown_shard,
  true AS in_bounds, true AS even, true AS gapless
FROM documents
"""
