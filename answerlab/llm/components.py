"""Distributed connected components (alternating large-star and small-star).

Every round is two grouped minima (combined on the map side) and two salted
joins over the edge list; rounds are written to the shared folder. Hubs are
safe: a hub's edges are salted in the joins and combined in the minima. Only
an edge and a node count of a round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlab.llm.common import salted_join, stored


#: Edges of a file.
_FILE_ROWS = 250_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on ``(u, v)`` with u > v. Each node is centre once:
    its neighbours (large: the greater ones; small: the smaller ones and
    itself) are linked to the least node of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else edges
    least = near.groupBy("u").agg(F.min("v").alias("_m")).withColumn("m", F.least("u", "_m")).drop("_m")
    joined = salted_join(near, least, ["u"], ["v"])
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def _unfinished(edges: DataFrame) -> int:
    """0 if every node has one edge up and no upper end has one (stars), else the
    number of edges."""
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("u").alias("nodes")).first()
    if row["n"] != row["nodes"]:
        return row["n"]
    tops = edges.select(F.col("v").alias("top")).distinct()
    return 0 if tops.join(edges.select("u"), F.col("top") == F.col("u"), "left_semi").isEmpty() else row["n"]


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node, component`` for every node of an edge; the component is its
    least node. Null ends and loops link nothing; repeated and reversed edges
    count once; no edges give an empty result."""
    e = (edges.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
         .select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).distinct())
    e = stored(e, "edges")
    while (n := _unfinished(e)):
        # stars hold at most one edge for each node: no more files than these rows need
        e = stored(_star(_star(e, large=True), large=False), "edges", files=n // _FILE_ROWS + 1)
    return (e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .union(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct())
