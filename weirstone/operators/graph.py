"""Graph operators: neighbours, bounded breadth-first search, components, ego graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def undirected(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(node, other), both ways, without loops and repeats."""
    e = edges.select(F.col(source).alias("node"), F.col(target).alias("other")).where("node is not null and other is not null and node <> other")
    return e.unionByName(e.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct()


def neighbours(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes one hop from the seeds that are no seeds."""
    s = seeds.select("node").distinct()
    return links.join(s, "node", "left_semi").select(F.col("other").alias("node")).distinct().join(s, "node", "left_anti")


def bounded_bfs(seeds: DataFrame, links: DataFrame, hops: int) -> DataFrame:
    """(node, depth) of all nodes within so many hops, each at its least depth. The frontier is cut after each hop."""
    seen = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    front = seen
    for depth in range(1, hops + 1):
        reached = links.join(front.select("node"), "node", "left_semi").select(F.col("other").alias("node")).distinct()
        front = cut(reached.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(front)
    return seen


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the least node that each node is connected with.

    Large-star and small-star steps alternate until nothing changes, so rounds grow with
    the logarithm of the size, and a hub's edges are rewritten, never gathered."""
    edges = cut(links.where("node <> other").select(F.greatest("node", "other").alias("u"), F.least("node", "other").alias("v")).distinct())
    nodes = links.select("node").distinct()
    state = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = cut(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def top_edges(edges: DataFrame, roots: DataFrame, order: list, most: int = 4) -> DataFrame:
    """The first ``most`` edges of every root in the given order, one for each neighbour."""
    near = edges.join(roots.select("node").distinct(), "node", "left_semi")
    one = near.withColumn("_k", F.row_number().over(Window.partitionBy("node", "other").orderBy(*order))).where("_k = 1").drop("_k")
    return one.withColumn("edge_rank", F.row_number().over(Window.partitionBy("node").orderBy(*order))).where(F.col("edge_rank") <= most)
