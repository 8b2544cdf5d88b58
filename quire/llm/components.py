"""Connected components of a link table, distributed.

Alternating large-star and small-star rounds (Kiveris et al., "Connected Components in
MapReduce and Beyond", 2014): every round links nodes to the least node they know, until each
node points straight at its component's least node.  A round is a minimum per node, aggregated
before the shuffle, and a join; a hub with a third of all links is one row of minima on one side
of the join, and adaptive execution splits the other side.  Links stay as many as they were or
fewer, rounds grow with the logarithm of the component's size, and each round is a written table
under the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialize, narrow


def _star(pairs: DataFrame) -> DataFrame:
    """(node, other) -> (node, other, least): the least of a node and its others."""
    least = pairs.groupBy("node").agg(F.min("other").alias("least"))
    return narrow(pairs.join(least.select(F.col("node").alias("_n"), F.least("node", "least").alias("least")),
                             F.col("node") == F.col("_n")).drop("_n"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(
        links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    return _star(both).filter("other > node").select(F.col("other").alias("a"), F.col("least").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other"))
    # one link for each: the link to the least is the node's own, the others point at the least
    return _star(down).select(F.when(F.col("other") == F.col("least"), F.col("node")).otherwise(F.col("other")).alias("a"),
                              F.col("least").alias("b"))


def _settled(links: DataFrame) -> DataFrame:
    return narrow(links.filter("a <> b").distinct())


def _stars(links: DataFrame) -> bool:
    """Whether every node points straight at its component's least node: at one node only, which
    points at none and is less."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("points"), (F.col("a") < F.col("b")).alias("wrong")).unionAll(
        links.select(F.col("b").alias("node"), F.lit(0).alias("points"), F.lit(False).alias("wrong")))
    nodes = ends.groupBy("node").agg(F.sum("points").alias("out"), F.count(F.lit(1)).alias("n"), F.max("wrong").alias("wrong"))
    return narrow(nodes.filter("wrong or out > 1 or (out = 1 and n > 1)")).isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of an undirected link table; the component's name
    is its least node.  Null ends and loops don't count; repeated links count once; a table
    without links gives no rows."""
    now = materialize(_settled(links.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna()))
    while not _stars(now):
        now = materialize(_settled(_small_star(_large_star(now))))
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
