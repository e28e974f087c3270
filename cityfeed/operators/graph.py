"""Connected components by alternating star operations, in DataFrame operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityfeed.sources.tables import stage, unstage

#: Neighbours on one side from which on a node is joined by broadcast; there are few such nodes, 2 * edges / HEAVY at most.
HEAVY = 100_000


def _least(edges: DataFrame) -> DataFrame:
    """``node, low``: the smallest neighbour of every node that has a smaller one."""
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))


def _look_up(edges: DataFrame, key: str, low: DataFrame, heavy: bool) -> DataFrame:
    """``edges`` with the ``low`` of the node ``key``, null without one.

    A node with very many edges would gather them in one task; its row is
    broadcast, and the edges of such nodes don't move.
    """
    if not heavy:
        return edges.join(low, F.col(key) == F.col("node"), "left").select("a", "b", "low")
    nodes = edges.groupBy(F.col(key).alias("node")).agg(F.count("*").alias("n")).where(F.col("n") >= HEAVY).select("node")
    nodes = stage(nodes.join(low, "node", "left").select(F.col("node").alias("_node"), F.col("low").alias("_low"), F.lit(True).alias("_heavy")), "heavy")
    met = edges.join(F.broadcast(nodes), F.col(key) == F.col("_node"), "left")
    light = met.where("_heavy is null").select("a", "b").join(low, F.col(key) == F.col("node"), "left").select("a", "b", "low")
    return light.union(met.where("_heavy").select("a", "b", F.col("_low").alias("low")))


def _hang_larger(edges: DataFrame, heavy: bool) -> DataFrame:
    """Each node's larger neighbours move to its smallest neighbour, or stay where it is the smallest itself."""
    return _look_up(edges, "b", _least(edges), heavy).select("a", F.coalesce("low", "b").alias("b")).distinct()


def _hang_smaller(edges: DataFrame, heavy: bool) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of them."""
    low = _least(edges)
    moved = _look_up(edges, "a", low, heavy).where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.union(low.select(F.col("node").alias("a"), F.col("low").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` edges to ``(node, root)``: every node of an edge and the least node of its component.

    Null ends and loops are ignored; no edge gives no row. Each round is
    linear in the edges, its result is staged in the shared folder, and the
    number of rounds grows with the logarithm of the component size. Nothing
    but counts and a checksum reaches the driver.
    """
    now = stage(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        ends = now.select(F.xxhash64("a", "b").cast("decimal(38,0)").alias("h"), F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("node")), F.struct(F.lit(1).alias("side"), F.col("b").alias("node")))).alias("end"))
        mark = ends.groupBy("end").agg(F.count("*").alias("n"), F.sum("h").alias("h")).agg(F.sum("n"), F.sum("h"), F.max("n")).first()
        if not mark[0] or mark[:2] == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen, heavy = mark[:2], mark[2] >= HEAVY
        half = _hang_larger(now, heavy)
        then, now = now, stage(_hang_smaller(stage(half, "edges") if heavy else half, heavy), "edges")
        unstage(then)
