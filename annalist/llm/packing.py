"""Filling containers of fixed capacity with items of varying length.

Items above a third of the capacity fit at most twice into a container: they are matched greedily, the largest
left with the largest that still fits beside it. The smaller ones then go, largest first, each into the tightest
gap that holds it. Items are spread by a hash over shards that are packed side by side; each shard can leave one
container badly filled, so a shard holds many items.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.storage import Workspace, pick

#: Items of a shard. One shard's sizes and ids are all that a task holds.
SHARD_ITEMS = 50_000
#: Copies of a row that are numbered at once.
COPIES = 4096
PLACED = "bin_name string, container long, item long, piece int, pieces int, begin long, size long"


class _Shelf:
    """Things filed by a small integer; finds the least or greatest number in use beyond a bound."""

    def __init__(self) -> None:
        self.used, self.by = 0, {}

    def put(self, number: int, thing: int) -> None:
        self.by.setdefault(number, []).append(thing)
        self.used |= 1 << number

    def take(self, number: int) -> int:
        things = self.by[number]
        thing = things.pop()
        if not things:
            del self.by[number]
            self.used ^= 1 << number
        return thing

    def at_most(self, bound: int) -> int:
        return (self.used & ((1 << (bound + 1)) - 1)).bit_length() - 1

    def at_least(self, bound: int) -> int:
        above = self.used >> bound
        return (above & -above).bit_length() - 1 + bound if above else -1


def fill(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item; no item exceeds the capacity."""
    capacity = int(capacity)  # bits are shifted by it
    place = np.full(len(sizes), -1, dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    large = [int(i) for i in order if 3 * sizes[i] > capacity]
    unmatched, gaps, count = _Shelf(), _Shelf(), 0
    for i in reversed(large):
        unmatched.put(int(sizes[i]), i)
    while unmatched.used:
        top = unmatched.used.bit_length() - 1
        place[unmatched.take(top)] = count
        gap = capacity - top
        beside = unmatched.at_most(gap)
        if beside >= 0:
            place[unmatched.take(beside)] = count
            gap -= beside
        gaps.put(gap, count)
        count += 1
    for i in order[len(large) :]:
        size = int(sizes[i])
        gap = gaps.at_least(size)
        if gap < 0:
            gap, container, count = capacity, count, count + 1
        else:
            container = gaps.take(gap)
        place[i] = container
        gaps.put(gap - size, container)
    return place


def pack(items: DataFrame, item: str, size: str, bins: list[tuple[str, int]], shard_items: int = SHARD_ITEMS) -> DataFrame:
    """bin_name, container, item, piece, pieces, begin, size: where each item goes, for each kind of container.

    items: integer ids and sizes; further columns are ignored. An item larger than the capacity, and no other, is
    cut: its full pieces fill containers alone, the rest is packed as any item is. A null size counts as 0; an
    item of size 0 takes a place in some container. Repeated rows are items of their own; ties and the order of
    rows do not change how well containers are filled. A null or non-positive capacity is refused. No items: no
    rows. bins is a parameter: a few kinds, held by the driver.
    """
    if any(c is None or c <= 0 for _, c in bins):
        raise ValueError("a container needs a positive capacity")
    sizes = pick(items, item=item, size=size).select(F.col("item").cast("long").alias("item"), F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("size"))
    shards = max(1, -(-sizes.count() // shard_items))
    kinds = F.array(*[F.struct(F.lit(n).cast("string").alias("bin_name"), F.lit(c).cast("long").alias("capacity")) for n, c in bins])
    # Copies of a row are numbered, in two steps that keep arrays short, so that a repeated id cannot fill a shard.
    counted = sizes.groupBy("item", "size").agg(F.count("*").alias("copies"))
    counted = counted.withColumn("from", F.explode(F.expr(f"sequence(0L, copies - 1, {COPIES}L)")))
    counted = counted.withColumn("copy", F.explode(F.expr(f"sequence(from, least(from + {COPIES}L, copies) - 1)")))
    spread = counted.withColumn("shard", F.pmod(F.xxhash64("item", "size", "copy"), F.lit(shards))).select("item", "size", "shard")
    spread = spread.withColumn("kind", F.explode(kinds)).select("kind.*", "shard", "item", "size")

    def shelve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        name, capacity, shard = key[0], int(key[1]), int(key[2])
        rows = rows.sort_values(["size", "item"], ascending=[False, True], kind="stable")
        ids, total = rows["item"].to_numpy(), rows["size"].to_numpy(np.int64)
        full = np.where(total > capacity, total // capacity, 0)
        rest = total - full * capacity
        keep = (rest > 0) | (full == 0)
        place = fill(rest[keep], capacity)
        first = int(place.max()) + 1 if len(place) else 0
        pieces = full + keep
        owner = np.repeat(np.arange(len(ids)), full)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full)
        end = np.flatnonzero(keep)
        at = np.r_[owner, end]
        return pd.DataFrame(
            {
                "bin_name": name,
                "container": (shard << 32) + np.r_[first + np.arange(len(owner)), place],
                "item": ids[at],
                "piece": np.r_[nth, full[end]].astype(np.int32),
                "pieces": pieces[at].astype(np.int32),
                "begin": np.r_[nth, full[end]] * capacity,
                "size": np.r_[np.full(len(owner), capacity), rest[end]],
            }
        )

    return spread.groupBy("bin_name", "capacity", "shard").applyInPandas(shelve, PLACED)


def filling(placed: DataFrame, bins: list[tuple[str, int]]) -> DataFrame:
    """bin_name, capacity, containers, tokens, least_containers, fill: how well each kind of container is filled.

    least_containers is what the sizes alone would need, were no item whole.
    """
    room = F.coalesce(*[F.when(F.col("bin_name") == n, F.lit(int(c))) for n, c in bins]).cast("long")
    by_container = placed.groupBy("bin_name", "container").agg(F.sum("size").alias("size"))
    by = by_container.groupBy("bin_name").agg(F.count("*").alias("containers"), F.sum("size").alias("tokens")).withColumn("capacity", room)
    return by.select("bin_name", "capacity", "containers", "tokens", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"), (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("fill"))


def sized(documents: DataFrame, id: str, size, space: Workspace | None = None, **others: str) -> DataFrame:
    """Ids with their sizes in tokens, written once so that no text is tokenized twice."""
    space = space or Workspace(documents.sparkSession, "sizes")
    small = pick(documents, id=id, text="text", **others)
    return space.write(small.select("id", *others, size(F.col("text")).alias("tokens")), "sizes")
