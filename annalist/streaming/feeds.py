"""Change feeds as streams: each batch of changes is composed and applied to the table as it stands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.operators.patches import compose


#: Slices of the keys; a batch rewrites only the slices whose keys it names.
SLICES = 256


def follow(feed: DataFrame, path: str, checkpoint: str, key: str, instant: str, number: str, deleted: str, payload: list[str], slices: int = SLICES):
    """Keep the latest change of each key below path, deletions included, so that late changes lose.

    Keys are spread over slices. A batch writes a new version of the slices it touches at path/version=N/slice=S, N
    the number of the batch, and leaves the others as they are; a batch that is run again after a failure writes the
    same files. After a batch the versions it has replaced are removed, but for the last one of each slice.
    """

    def step(batch: DataFrame, version: int) -> None:
        spark = batch.sparkSession
        changes = batch.select(key, instant, number, deleted, *payload).withColumn("slice", F.pmod(F.xxhash64(key), F.lit(slices)).cast("int")).persist()
        try:
            touched = {r.slice for r in changes.select("slice").distinct().collect()}  # at most as many as there are slices
            held = _versions(spark, path, version)
            old = [f"{path}/version={held[s]}/slice={s}" for s in sorted(touched) if s in held]
            state = changes.drop("slice")
            if old:
                state = state.unionByName(spark.read.parquet(*old).select(*state.columns))
            kept = compose(state, key, instant, number, deleted, [instant, number, *payload])
            kept = kept.select(key, F.col(instant), F.col(number), F.col("deleted").alias(deleted), *payload).withColumn("slice", F.pmod(F.xxhash64(key), F.lit(slices)).cast("int"))
            kept.repartition("slice").write.mode("overwrite").partitionBy("slice").parquet(f"{path}/version={version}")
        finally:
            changes.unpersist()
        before = _versions(spark, path, version)
        for v, s in _listed(spark, path):
            if s in touched and v < before.get(s, -1):
                _remove(spark, f"{path}/version={v}/slice={s}")

    return feed.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _listed(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """version, slice of all folders there are."""
    files, where = _files(spark, f"{path}/version=*/slice=*")
    found = [str(f.getPath().toString()) for f in (files.globStatus(where) or [])]
    return [(int(f.split("version=")[1].split("/")[0]), int(f.rsplit("slice=", 1)[1])) for f in found]


def _versions(spark: SparkSession, path: str, below: int) -> dict[int, int]:
    """The last version of each slice before a version."""
    last: dict[int, int] = {}
    for v, s in _listed(spark, path):
        if v < below:
            last[s] = max(v, last.get(s, -1))
    return last


def _remove(spark: SparkSession, path: str) -> None:
    files, where = _files(spark, path)
    files.delete(where, True)


def latest(spark: SparkSession, path: str, version: int, deleted: str) -> DataFrame:
    """The table as it stands after a batch, as long as no later batch has replaced it."""
    held = _versions(spark, path, version + 1)
    return spark.read.parquet(*[f"{path}/version={v}/slice={s}" for s, v in sorted(held.items())]).where(~F.col(deleted)).drop(deleted)


def watch(facts: DataFrame, query, path: str, checkpoint: str):
    """A standing question: facts that match are appended to a table as they arrive."""
    return facts.where(query.condition()).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
