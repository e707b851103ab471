"""Continuous periods and gaps of intervals that overlap, nest, touch or leave days free.

All intervals are range-sorted by key and start. Each partition is scanned once and leaves its local runs
(merged intervals); the first and last run of each partition are its summary. The summaries, one row for each
partition, are prefix-combined into the state that enters a partition from the left: the latest end seen so far
of the partition's first key. The local runs are then scanned again with that state. A key that holds any share
of the rows is spread over many partitions, since the sort runs on the start as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalist.storage import Workspace, pick


def _local_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Merge the sorted intervals of one partition; the last run stays open until the next batch."""
    part, ix = None, 0
    open_run: pd.DataFrame | None = None
    before: tuple | None = None  # key and end of the run emitted last
    for batch in batches:
        if batch.empty:
            continue
        if part is None:
            part = int(batch["part"].iat[0])
        rows = batch[["key", "start", "stop"]]
        if open_run is not None:
            rows = pd.concat([open_run, rows], ignore_index=True)
        key, start, stop = rows["key"].to_numpy(), rows["start"].to_numpy(np.int64), rows["stop"].to_numpy(np.int64)
        new_key = np.r_[True, key[1:] != key[:-1]]
        group = np.cumsum(new_key) - 1
        low = stop.min()
        span = stop.max() - low + 1
        reach = np.maximum.accumulate(stop - low + group * span) - group * span + low
        head = new_key | np.r_[True, start[1:] > reach[:-1] + 1]
        at = np.flatnonzero(head)
        runs = pd.DataFrame({"key": key[at], "start": start[at], "stop": reach[np.r_[at[1:], len(key)] - 1]})
        if len(runs) > 1:
            out, ix, before = _emit(runs, part, ix, before)
            yield out
        open_run = runs.iloc[-1:]
    if open_run is not None:
        closed = pd.concat([open_run, open_run.assign(key=None)], ignore_index=True)
        yield _emit(closed, part, ix, before)[0]


def _emit(runs: pd.DataFrame, part: int, ix: int, before: tuple | None) -> tuple[pd.DataFrame, int, tuple]:
    """All runs but the last, each with its neighbours of the same key within the partition."""
    key, start, stop = (runs[c].to_numpy() for c in ("key", "start", "stop"))
    n = len(runs) - 1
    left_key = np.r_[np.array([before[0] if before else None], dtype=object), key[: n - 1].astype(object)]
    left_stop = np.r_[np.array([before[1] if before else 0]), stop[: n - 1]]
    out = pd.DataFrame(
        {
            "part": np.full(n, part, np.int32),
            "ix": np.arange(ix, ix + n),
            "key": key[:n],
            "start": start[:n],
            "stop": stop[:n],
            "prev_stop": pd.array(left_stop, dtype="Int64"),
            "next_start": pd.array(start[1:], dtype="Int64"),
        }
    )
    out.loc[left_key != key[:n].astype(object), "prev_stop"] = pd.NA
    out.loc[key[1:].astype(object) != key[:n].astype(object), "next_start"] = pd.NA
    return out, ix + n, (key[n - 1], stop[n - 1])


class MergedIntervals:
    """The runs of a table of closed integer intervals, ready for periods() and gaps().

    df: any table; key, start, stop: names of its columns, start and stop integer and inclusive at both ends
    (values within +-2**48). Further columns are ignored, whatever their names. Rows with a null key or bound, or
    with stop < start, cover nothing and are left out. Repeated rows and ties change nothing. Intervals that touch
    (the next starts on the day after) are one period. An empty table has no period and no gap.
    """

    def __init__(self, df: DataFrame, key: str, start: str, stop: str) -> None:
        spark = df.sparkSession
        space = Workspace(spark, "intervals")
        valid = (
            pick(df, key=key, start=start, stop=stop)
            .select("key", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))
            .where("key is not null and start is not null and stop >= start")
        )
        schema = T.StructType(
            [
                T.StructField("part", T.IntegerType()),
                T.StructField("ix", T.LongType()),
                T.StructField("key", valid.schema["key"].dataType),
                *[T.StructField(c, T.LongType()) for c in ("start", "stop", "prev_stop", "next_start")],
            ]
        )
        ordered = (
            valid.repartitionByRange("key", "start")
            .sortWithinPartitions("key", "start")
            .withColumn("part", F.spark_partition_id())
        )
        # Written, as a second sampling of the range bounds could cut the partitions elsewhere.
        self.space = space
        self.runs = space.write(ordered.mapInPandas(_local_runs, schema), "runs")
        self._marked = self._mark()

    def _mark(self) -> DataFrame:
        """Each local run with what entered from the left: does a period start or end here?"""
        edges = self.runs.groupBy("part").agg(
            F.min(F.struct("ix", "key", "start")).alias("first"), F.max(F.struct("ix", "key", "stop")).alias("last")
        )
        # One row for each partition of the sort: bounded by the number of partitions, not by the data.
        events = edges.select(
            "part",
            F.explode(
                F.array(
                    F.struct(F.lit(0).alias("side"), F.col("first.key").alias("key"), F.col("first.start").alias("start"), F.lit(None).cast("long").alias("stop")),
                    F.struct(F.lit(1).alias("side"), F.col("last.key").alias("key"), F.lit(None).cast("long").alias("start"), F.col("last.stop").alias("stop")),
                )
            ).alias("e"),
        ).select("part", "e.*")
        line = Window.partitionBy("key").orderBy("part", "side")
        combined = events.withColumn("reach", F.max("stop").over(line.rowsBetween(Window.unboundedPreceding, -1))).withColumn(
            "ahead", F.min("start").over(line.rowsBetween(1, Window.unboundedFollowing))
        )
        carry = combined.groupBy("part").agg(
            F.max(F.when(F.col("side") == 0, F.col("key"))).alias("first_key"),
            F.max(F.when(F.col("side") == 0, F.col("reach"))).alias("reach"),
            F.max(F.when(F.col("side") == 1, F.col("key"))).alias("last_key"),
            F.max(F.when(F.col("side") == 1, F.col("ahead"))).alias("ahead"),
        )
        entered = F.when(F.col("key") == F.col("first_key"), F.col("reach"))
        return (
            self.runs.join(F.broadcast(carry), "part")
            .withColumn("before", F.greatest("prev_stop", entered))
            .withColumn("until", F.greatest("stop", entered))
            .withColumn("next", F.coalesce("next_start", F.when(F.col("key") == F.col("last_key"), F.col("ahead"))))
            .withColumn("starts", F.expr("before is null or start > before + 1"))
            .withColumn("ends", F.expr("next is null or next > until + 1"))
        )

    def gaps(self) -> DataFrame:
        """key, gap_from, gap_to: the longest runs of free days between the first and last covered day of a key."""
        return self._marked.where("starts and before is not null").select(
            "key", (F.col("before") + 1).alias("gap_from"), (F.col("start") - 1).alias("gap_to")
        )

    def periods(self) -> DataFrame:
        """key, period_from, period_to: the continuous periods of a key; period_from is the label of the period."""
        marked = self._marked.withColumn("opened", F.when(F.col("starts"), F.col("start")))
        last = marked.where("key = last_key").groupBy("part", "key").agg(F.max("opened").alias("opened"), F.lit(1).alias("side"))
        first = marked.where("key = first_key").select("part", "key", F.lit(None).cast("long").alias("opened"), F.lit(0).alias("side")).distinct()
        line = Window.partitionBy("key").orderBy("part", "side").rowsBetween(Window.unboundedPreceding, -1)
        carry = (
            last.unionByName(first)
            .withColumn("entered", F.max("opened").over(line))
            .where("side = 0")
            .select("part", F.col("key").alias("entered_key"), "entered")
        )
        within = Window.partitionBy("part", "key").orderBy("ix").rowsBetween(Window.unboundedPreceding, 0)
        return (
            marked.withColumn("opened", F.max("opened").over(within))
            .join(F.broadcast(carry), "part", "left")
            .where("ends")
            .select(
                "key",
                F.coalesce("opened", F.when(F.col("key") == F.col("entered_key"), F.col("entered"))).alias("period_from"),
                F.col("until").alias("period_to"),
            )
        )
