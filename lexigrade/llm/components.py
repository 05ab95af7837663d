"""Connected components of a table of edges, by hooking and contraction.

In each round every node points to its least neighbour (itself, if it is the
least), pointers are doubled until they end at roots, and edges are drawn anew
between roots. A component that has an edge left always merges, so the number
of nodes halves at least. Each step's table is written, so its joins shuffle
two plain tables that adaptive execution can split at a hot node, and a lost
executor costs no more than a step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shelf

#: Rows of a task's part of a step's table: the tables shrink from round to round, and with them the files.
ROWS = 1 << 18


def components(edges: DataFrame, shelf: Shelf | None = None) -> DataFrame:
    """(node, comp) of every node that an edge (a, b) touches; comp is the least node of its component."""
    shelf = shelf or Shelf(edges.sparkSession, "components")
    edges = shelf.put(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b"), "edges")
    labels: DataFrame | None = None
    most = 0
    while left := edges.count():
        parts = 1 + 2 * left // ROWS
        most = max(most, parts)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = shelf.put(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).select("node", F.least("node", "to").alias("to")).coalesce(parts), "point")
        while True:
            onward = point.select(F.col("node").alias("to"), F.col("to").alias("end"))
            jumped = shelf.put(point.join(onward, "to").select("node", F.col("end").alias("to"), (F.col("end") != F.col("to")).alias("moved")).coalesce(parts), "jump")
            point = jumped.select("node", "to")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = point.withColumnRenamed("to", "comp")
        else:
            step = point.withColumnRenamed("node", "comp")
            labels = labels.join(step, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
        labels = shelf.put(labels.coalesce(most), "labels")
        drawn = edges.join(point.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
        drawn = drawn.join(point.select(F.col("node").alias("b"), F.col("to").alias("y")), "b").where("x <> y")
        edges = shelf.put(drawn.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().coalesce(parts), "edges")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return labels
