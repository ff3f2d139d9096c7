"""Spark helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raincourse.session import sized

WORD = "[^\\x20\\x09-\\x0D]+"


def rank_within(df: DataFrame, group: list[str], order: list[str], tie: str, rank: str = "_rank") -> DataFrame:
    """Rank from 0 of each row in its ``group`` by ``order`` and then by ``tie``, a hexadecimal hash.

    No task holds a group: rows are counted per (group, order value, first three digits of
    the tie), the counts are summed up to each cell, and only the rows of a cell are sorted.
    A window runs over the distinct order values of a group and over the at most 4096 cells
    of an order value, never over the rows of a group. Columns of ``group`` and ``order``
    must not be null. Rows equal in all of them may swap ranks.
    """
    cell = [*group, *order, "_cell"]
    rows = df.withColumn("_cell", F.substring(tie, 1, 3))
    cells = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
    inside = Window.partitionBy(*group, *order).orderBy("_cell")
    before = cells.select(*cell, (F.sum("_n").over(inside) - F.col("_n")).alias("_before"))
    if order:
        values = cells.groupBy(*group, *order).agg(F.sum("_n").alias("_n"))
        earlier = Window.partitionBy(*group).orderBy(*order)
        values = values.select(*group, *order, (F.sum("_n").over(earlier) - F.col("_n")).alias("_lower"))
        before = before.join(values, [*group, *order]).select(*cell, (F.col("_before") + F.col("_lower")).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*cell).orderBy(tie))
    return (rows.join(sized(before, "cells"), cell)
            .withColumn(rank, F.col("_before") + place - 1).drop("_cell", "_before"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): one row (node, root) per node of an edge.

    Every node moves to the smallest node around it, edges are rewritten between the new
    nodes, and so on until none is left. The order of nodes is their own in the first round
    and that of a new hash in each later one, so chains of any length shrink by a constant
    share a round. Each round is written to the shared folder; nothing comes to the driver.
    """
    pairs = edges.select("a", "b").where("a != b")
    pairs = sized(pairs.union(pairs.select("b", "a")).distinct(), "edges")
    labels, turn = None, 0
    while labels is None or not pairs.isEmpty():
        place = (lambda c: F.lit(0)) if turn == 0 else (lambda c, t=turn: F.xxhash64(F.lit(t), c))
        near = pairs.groupBy("a").agg(F.min(F.struct(place(F.col("b")).alias("h"), F.col("b").alias("n"))).alias("near"))
        moves = sized(near.select(F.col("a").alias("old"), F.least("near", F.struct(place(F.col("a")).alias("h"), F.col("a").alias("n")))["n"].alias("new")), "moves")
        if labels is None:
            labels = moves.select(F.col("old").alias("node"), F.col("new").alias("root"))
        else:
            labels = sized(labels.join(moves, labels.root == moves.old, "left").select("node", F.coalesce("new", "root").alias("root")), "labels")
        left = moves.select(F.col("old").alias("a"), F.col("new").alias("na"))
        right = moves.select(F.col("old").alias("b"), F.col("new").alias("nb"))
        pairs = pairs.join(left, "a").join(right, "b").where("na != nb").select(F.col("na").alias("a"), F.col("nb").alias("b")).distinct()
        pairs = sized(pairs, "edges")
        turn += 1
    return labels


def binary_md5(*columns) -> F.Column:
    """md5 of the columns, nulls told apart from empty strings."""
    return F.md5(F.to_json(F.array(*[c.cast("string") for c in columns])))
