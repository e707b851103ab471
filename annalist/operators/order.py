"""Places of rows in a total order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.storage import Workspace


def numbered(rows: DataFrame, order: list[Column], place: str = "place", space: Workspace | None = None) -> DataFrame:
    """The rows with their place in the order, from 1.

    The rows are range-partitioned by the order and numbered within each range; the sizes of the ranges before (one
    row for each range) are added. The order must be total for the places to be the same in every run.
    """
    space = space or Workspace(rows.sparkSession, "order")
    ranged = space.write(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("n"))
    before = sizes.select("_range", F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn(place, within.cast("long")).join(F.broadcast(before), "_range").withColumn(place, F.col(place) + F.col("_before")).drop("_range", "_before")


def running(rows: DataFrame, group: str, position: str, value: Column, name: str, chunk: int = 65_536) -> DataFrame:
    """The rows with the sum of `value` over the rows of their group before them, by a position that counts rows.

    Sums of chunks of positions are prefix-combined, so that a group of any length is spread over many tasks.
    """
    cut = rows.withColumn("_v", value).withColumn("_chunk", F.floor(F.col(position) / chunk))
    sums = cut.groupBy(group, "_chunk").agg(F.sum("_v").alias("s"))
    earlier = Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(group, "_chunk", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy(group, "_chunk").orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    held = cut.withColumn("_within", F.coalesce(F.sum("_v").over(within), F.lit(0))).join(before, [group, "_chunk"])
    return held.withColumn(name, F.col("_within") + F.col("_before")).drop("_v", "_chunk", "_within", "_before")


def compared(left: DataFrame, right: DataFrame, order: list[Column], fields: list[str]) -> DataFrame:
    """One row: do two tables hold the same fields in the same order, and the first place at which they differ."""
    a, b = (numbered(rows, order).select("place", F.struct(*fields).alias(side)) for rows, side in ((left, "a"), (right, "b")))
    differ = a.join(b, "place", "full").where(~F.col("a").eqNullSafe(F.col("b")))
    return differ.agg((F.count("*") == 0).alias("match"), F.min("place").alias("first_place"))
