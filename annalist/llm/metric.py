"""Exact radius joins of strings under a true edit metric, by partitioning of the metric space.

The metric is the unrestricted Damerau-Levenshtein distance (insert, delete, replace, swap of neighbours), which
obeys the triangle inequality. Pivots are the strings that occur more than once: a slip stands beside the spelling
it comes from. Each string is assigned to the pivots within 2 of it. It lives in the cell of the nearest, if that
is within 1 (at distance e), and visits the cells of the pivots within e + 1: of two strings one apart, the one
farther from its pivot lies within e + 1 of the other's pivot, so the two meet there. Strings that live nowhere
visit all cells of their pivots and go on to a second level, where each of them is a pivot. In each cell those who
live there are held against its visitors with the metric.

The pivots of a string are found by what is left of both after up to two letters are taken away, which two strings
within 2 have in common; long strings by their parts. So the work grows with the number of strings, not with
strings times pivots, and no pivot is held by the driver or sent to all tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.storage import Workspace

#: The reach of a search for pivots, and the length up to which strings are found by what is left of them.
REACH, LONG = 2, 24


def capped(a: list[str], b: list[str]) -> np.ndarray:
    """The unrestricted Damerau-Levenshtein distance of each pair, 3 where it is greater than 2.

    Only what lies within two places of the diagonal can be part of a distance of 2, and only swaps with one letter
    put in or left out between.
    """
    n, width = len(a), max([1, *map(len, a), *map(len, b)])
    x, y = (np.zeros((n, width + 4), dtype=np.uint32) for _ in range(2))
    for i, (s, t) in enumerate(zip(a, b)):
        x[i, : len(s)], y[i, : len(t)] = np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32), np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32)
    lx, ly = np.array([len(s) for s in a], dtype=int), np.array([len(t) for t in b], dtype=int)
    out = np.full(n, 3, dtype=np.int8)
    # h[k][:, d + 2]: the distance of the first r - k letters of one and the first r - k + d of the other.
    h = [np.full((n, 5), 3, dtype=np.int8) for _ in range(4)]
    for r in range(width + 1):
        now = np.full((n, 5), 3, dtype=np.int8)
        for d in range(-2, 3):
            c = r + d
            if c < 0 or c > width + 2:
                continue
            best = np.full(n, min(3, abs(d)) if r == 0 or c == 0 else 3, dtype=np.int8)
            if r and c:
                xr, yc = x[:, r - 1], y[:, c - 1]
                best = np.minimum(best, h[0][:, d + 2] + (xr != yc))
                if d < 2:
                    best = np.minimum(best, h[0][:, d + 3] + 1)
                if d > -2:
                    best = np.minimum(best, now[:, d + 1] + 1)
                if r > 1 and c > 1:
                    best = np.minimum(best, np.where((x[:, r - 2] == yc) & (xr == y[:, c - 2]), h[1][:, d + 2] + 1, 3))
                if r > 2 and c > 1 and d < 2:
                    best = np.minimum(best, np.where((x[:, r - 3] == yc) & (xr == y[:, c - 2]), h[2][:, d + 3] + 2, 3))
                if r > 1 and c > 2 and d > -2:
                    best = np.minimum(best, np.where((x[:, r - 2] == yc) & (xr == y[:, c - 3]), h[1][:, d + 1] + 2, 3))
            now[:, d + 2] = np.minimum(best, 3)
            done = (lx == r) & (ly == c)
            out[done] = now[done, d + 2]
        h = [now, *h[:3]]
    return out


def distance(a: Column, b: Column) -> Column:
    """The distance of two strings, 3 where it is greater than 2."""

    @F.pandas_udf("int")
    def each(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(capped(x.tolist(), y.tolist()), dtype="int32")

    return each(a, b)


def _left_of(word: str, reach: int) -> str:
    """SQL of all that is left of a word when up to `reach` letters are taken away."""
    one = f"transform(sequence(1, greatest(length({word}), 1)), i -> concat(substring({word}, 1, i - 1), substring({word}, i + 1)))"
    if reach == 1:
        return f"array_distinct(concat(array({word}), {one}))"
    # The second letter taken away stands at or behind the place of the first.
    two = f"flatten(transform({one}, (w, i) -> transform(sequence(i + 1, greatest(length(w), i + 1)), j -> concat(substring(w, 1, j - 1), substring(w, j + 1)))))"
    return f"array_distinct(concat(array({word}), {one}, {two}))"


#: Two strings within two edits, swaps included, differ by four plain edits at most, which leave one of five parts whole.
PARTS = 5


def _part(i: str, shift: str) -> str:
    return f"xxhash64(m, {i}, substring(key, {i} * (m div {PARTS}) + 1 + {shift}, if({i} = {PARTS - 1}, m - {PARTS - 1} * (m div {PARTS}), m div {PARTS})))"


def met(left: DataFrame, right: DataFrame, reach: int = REACH) -> DataFrame:
    """a, b, distance: all pairs of a string of `left` with a different one of `right` within `reach` (1 or 2).

    left, right: key, each once.
    """
    sides = []
    for side, rows in (("a", left), ("b", right)):
        rows = rows.select("key", F.length("key").alias("m"))
        short = rows.where(f"m <= {LONG + reach}").select("key", F.explode(F.transform(F.expr(_left_of("key", reach)), lambda w: F.xxhash64(w))).alias("k"))
        long = rows.where(f"m > {LONG}")
        if side == "a":
            parts = f"transform(sequence(0, {PARTS - 1}), i -> {_part('i', '0')})"
        else:
            long = long.withColumn("m", F.explode(F.expr(f"sequence(m - {reach}, m + {reach})")))
            parts = f"flatten(transform(sequence(-{reach}, {reach}), s -> transform(filter(sequence(0, {PARTS - 1}), i -> i * (m div {PARTS}) + s >= 0), i -> {_part('i', 's')})))"
        sides.append(short.unionByName(long.select("key", F.explode(F.expr(parts)).alias("k"))).withColumnRenamed("key", side))
    near = F.expr(f"a <> b and abs(length(a) - length(b)) <= {reach} and levenshtein(a, b, {2 * reach}) >= 0")
    # A planner that sizes a table by its file takes what a word leaves for no more than the word, and has the driver hold it.
    pairs = sides[0].join(sides[1].hint("merge"), "k").where(near).select("a", "b").distinct()
    return pairs.select("a", "b", distance(F.col("a"), F.col("b")).alias("distance")).where(F.col("distance") <= reach)


def assigned(keys: DataFrame, space: Workspace) -> DataFrame:
    """key, pivot, distance, e, level: each string with the pivots within 2 of it; e is its distance from the nearest.

    keys: key (string), each once, and freq, how often it occurs.
    """
    repeated = keys.where("freq > 1").select("key")
    found = space.write(met(keys.select("key"), repeated), "assigned-0")
    level = found.toDF("key", "pivot", "distance").unionByName(repeated.select("key", F.col("key").alias("pivot"), F.lit(0).alias("distance")))
    nearest = F.min("distance").over(Window.partitionBy("key"))
    first = space.write(level.withColumn("e", nearest).withColumn("level", F.lit(0)), "level-0")
    alone = space.write(keys.select("key").join(first.where("e <= 1").select("key"), "key", "left_anti"), "alone")
    more = met(alone, alone).toDF("key", "pivot", "distance").unionByName(alone.select("key", F.col("key").alias("pivot"), F.lit(0).alias("distance")))
    second = space.write(more.withColumn("e", F.lit(0)).withColumn("level", F.lit(1)), "level-1")
    return first.unionByName(second)


def pairs_within_one(cells: DataFrame) -> DataFrame:
    """a, b with a < b: all pairs of different strings at a distance of 1; cells: what assigned() gives."""
    cells = cells.where("distance <= least(e, 1) + 1")
    lives = cells.where("e <= 1 and distance = e")
    # Of several pivots equally near, the first is home.
    home = lives.groupBy("key", "level").agg(F.min("pivot").alias("pivot")).select("level", "pivot", F.col("key").alias("a"))
    visit = cells.select("level", "pivot", F.col("key").alias("b"), F.length("key").alias("n"))
    close = home.join(visit, ["level", "pivot"]).where("a <> b and abs(length(a) - n) <= 1 and levenshtein(a, b, 2) between 1 and 2")
    close = close.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return close.where(distance(F.col("a"), F.col("b")) == 1)


def variants(keys: DataFrame, space: Workspace | None = None) -> DataFrame:
    """key, near, distance: for each string the others within 1, and the repeated ones within 2, in both orders.

    keys: key (string) and freq (long), one row for each distinct key; null keys are left out, the empty string and
    strings of any length are taken. No keys: no pairs.
    """
    space = space or Workspace(keys.sparkSession, "metric")
    keys = space.write(keys.where("key is not null").select("key", "freq"), "keys")
    cells = assigned(keys, space)
    one = pairs_within_one(cells).withColumn("distance", F.lit(1))
    two = cells.where("distance = 2").select(F.least("key", "pivot").alias("a"), F.greatest("key", "pivot").alias("b"), "distance")
    both = one.unionByName(two).distinct()
    orders = [F.struct(F.col(x).alias("key"), F.col(y).alias("near"), "distance") for x, y in ("ab", "ba")]
    return space.write(both.select(F.inline(F.array(*orders))), "variants")
