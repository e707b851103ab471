"""Session settings, tables in the shared folder, and picking of columns."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings the engine is tested with."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("annalist")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Where the setting is absent in a local run, as in tests, a folder of this machine is made and set. On a cluster
    its executors would each write to a disk of their own, so there it is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.conf.get("spark.master", "")
        if not re.match(r"local(\[[^\]]*\])?$", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share (master {master!r})")
        at = tempfile.mkdtemp(prefix="annalist-")
        atexit.register(shutil.rmtree, at, True)
        at = f"file://{at}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


class Workspace:
    """Tables written to the shared folder, by which a plan is cut.

    Unlike local checkpoints they outlive the executors that wrote them; unlike checkpoint() they are columnar
    and keep their size, so the planner can choose a join by it. A table is removed by drop(), the rest when
    the session's process ends.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/annalist-{label}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.close)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        self._remove(f"{self.root}/{name}")

    def close(self) -> None:
        try:
            self._remove(self.root)
        except Exception:  # the session has ended before
            if self.root.startswith("file:/"):
                shutil.rmtree(self.root.removeprefix("file://"), ignore_errors=True)

    def _remove(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns of df under new names; all others are left out.

    Columns are found by their exact name, else by a name that differs only in case, and taken by position, so
    further columns whose names clash do no harm.
    """
    names = df.columns
    by_position = df.toDF(*[f"_{i}" for i in range(len(names))])

    def at(name: str) -> int:
        exact = [i for i, n in enumerate(names) if n == name]
        near = exact or [i for i, n in enumerate(names) if n.lower() == name.lower()]
        if not near:
            raise ValueError(f"no column {name!r} among {names}")
        return near[0]

    return by_position.select(*[F.col(f"_{at(old)}").alias(new) for new, old in columns.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
