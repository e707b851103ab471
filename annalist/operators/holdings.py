"""Holdings that share any of their keys are one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.operators.components import components


def holdings_clusters(rows: DataFrame) -> DataFrame:
    """record_no, cluster: the smallest row that a row is linked to by shared keys; rows without keys are left out.

    Rows of one key are linked to its smallest row, so that a key of very many rows gives one link for each of them.
    """
    keyed = rows.select("record_no", F.explode("keys").alias("key")).distinct()
    first = keyed.groupBy("key").agg(F.min("record_no").alias("first"))
    links = keyed.join(first, "key").select(F.col("record_no").alias("a"), F.col("first").alias("b")).distinct()
    roots = components(links)
    return keyed.select("record_no").distinct().join(roots.toDF("record_no", "root"), "record_no", "left").select("record_no", F.coalesce("root", "record_no").alias("cluster"))
