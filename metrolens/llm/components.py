"""Connected components of a link table (union-find, then star contraction).

Tasks of at most ``LINKS_PER_TASK`` links first contract these with a
union-find, so what is shuffled afterwards is one star link per node and task. Rounds of large-star
and small-star steps then join the tasks' views: every node is linked to the
smallest node among its neighbours until nothing changes, which takes a number
of rounds logarithmic in the size of a component. Links are never collected;
hot nodes (the centre of a large star) are split by the skew join, because
both sides of each join are plain tables.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metrolens.llm.common import stored

LINKS_PER_TASK = 250_000     # links that one task contracts by union-find


class Forest:
    """Union-find over the nodes of one task."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (up := self.parent.get(root, root)) != root:
            root = up
        while x != root:
            up = self.parent.get(x, root)
            self.parent[x] = root
            x = up
        return root

    def join(self, a: int, b: int) -> bool:
        """Whether the two were apart."""
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def local_stars(batches):
    """mapInArrow step: links (a, b) of a task -> (node, smallest node of its
    component among the task's links)."""
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.join(a, b)
    nodes = list(forest.parent)
    roots = [forest.find(x) for x in nodes]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], names=["a", "b"])


def _is_done(links: DataFrame) -> bool:
    """Whether every node has one link only, to a node without a smaller one."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        links.select("b", F.lit(0), F.lit(1)))
    open_ = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return open_.where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """links (a, b: long) -> (node, component), where component is the smallest
    node reachable; nodes that are the smallest themselves, or without links,
    are left out. Repeated links and loops are allowed."""
    plain = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    links = stored(spark, plain, "links")
    tasks = -(-links.count() // LINKS_PER_TASK)
    stars = links.coalesce(max(1, tasks)).mapInArrow(local_stars, "a long, b long")
    links = stored(spark, stars.distinct() if tasks > 1 else stars, "stars")
    while tasks > 1 and not _is_done(links):       # a single task's stars are the components
        links = stored(spark, _large_star(spark, links), "large-star")
        links = stored(spark, _small_star(spark, links), "small-star")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _large_star(spark: SparkSession, links: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node with the smallest neighbour.
    Links are kept as (larger a, smaller b)."""
    least = stored(spark, links.groupBy("a").agg(F.min("b").alias("least")), "least")
    moved = links.join(least.withColumnRenamed("a", "centre"), F.col("b") == F.col("centre"), "left")
    return moved.select("a", F.coalesce("least", "b").alias("b"))


def _small_star(spark: SparkSession, links: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours with the smallest of them."""
    least = stored(spark, links.groupBy("a").agg(F.min("b").alias("least")), "least")
    joined = links.join(least, "a")
    own = least.select("a", F.col("least").alias("b"))
    others = joined.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return own.union(others).distinct()
