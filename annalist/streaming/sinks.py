"""Sinks of streams: catalogue rows appended to an image that rolls into parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.operators.order import numbered
from annalist.sources.image import ImageRefused, part_path, parts

#: Rows of a part.
PART_ROWS = 10_000_000


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def append_catalogue(feed: DataFrame, base: str, checkpoint: str, order: list[str], part_rows: int = PART_ROWS):
    """Append the rows of a feed to base/catalogue, and to the next part where one is full.

    Each batch writes one folder, batch=N, into each part it reaches, in an order of its own; a batch that runs again
    after a failure overwrites what it wrote, so every row is there once. A part holds `part_rows` rows, the last one
    fewer. Rows are placed by their place in the whole catalogue, which the column place keeps.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = rows_before(spark, base, number)
        placed = numbered(batch, [F.col(c).asc_nulls_first() for c in order]).withColumn("place", F.col("place") + before)
        cut = placed.withColumn("part", F.floor((F.col("place") - 1) / part_rows)).persist()
        try:
            ends = cut.agg(F.min("part").alias("low"), F.max("part").alias("high")).first()
            for part in range(ends.low, ends.high + 1) if ends.low is not None else ():
                cut.where(F.col("part") == part).drop("part").write.mode("overwrite").parquet(f"{part_path(base, part)}/catalogue/batch={number}")
        finally:
            cut.unpersist()

    return feed.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def catalogue(spark: SparkSession, base: str) -> DataFrame:
    """All rows of all parts, with part and batch; a hole in the parts refuses them."""
    every = None
    for n, path in enumerate(parts(spark, base)):
        if not _exists(spark, f"{path}/catalogue"):
            raise ImageRefused("section out of range", path)
        rows = spark.read.parquet(f"{path}/catalogue").withColumn("part", F.lit(n))
        every = rows if every is None else every.unionByName(rows)
    return every


def rows_before(spark: SparkSession, base: str, batch: int) -> int:
    """Rows that the batches before one have left, read from the columns' statistics."""
    if not _exists(spark, base):
        return 0
    return catalogue(spark, base).where(F.col("batch") < batch).count()


def local_clusters(rows: DataFrame, part_rows: int) -> tuple[DataFrame, DataFrame]:
    """The rows with their part and the cluster (a place in the whole catalogue, 0 for none) as a place in that part.

    A cluster whose first row lies in an earlier part cannot be said in this one: it becomes 0. Also one row: how
    many were lost so. rows: place, cluster.
    """
    part = F.floor((F.col("place") - 1) / part_rows)
    at = F.col("cluster") - F.col("part") * part_rows
    cut = rows.withColumn("part", part)
    local = cut.withColumn("local_cluster", F.when((F.col("cluster") > 0) & (at > 0), at).otherwise(0).cast("long"))
    return local, local.agg(F.count_if((F.col("cluster") > 0) & (F.col("local_cluster") == 0)).alias("lost"))
