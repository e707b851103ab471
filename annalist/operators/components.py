"""Components of a graph by contraction of stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.storage import Workspace


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of the component of each node; edges: columns a and b, longs.

    Large-star and small-star steps in turn: each joins every node to the smallest neighbour it knows of, until the
    edges are stars: until every edge leads from its larger node to a node that is no larger end itself. A node with
    very many neighbours is reduced by partial aggregation before its rows travel.
    """
    space = Workspace(edges.sparkSession, "components")
    current = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    current = space.write(current.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges-0")
    step = 0
    # In stars every node but the roots is the larger end of one edge, and no root is a larger end.
    while not (current.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").isEmpty() and current.select("b").join(current.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()):
        both = current.unionAll(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        step += 1
        current = space.write(small, f"edges-{step}")
        space.drop(f"edges-{step - 1}")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(current.select("b", F.col("b").alias("root"))).distinct()
