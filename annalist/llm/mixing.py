"""Mixing sources to target weights.

The documents of a source lie end to end and are cut into blocks of a fixed number of tokens. The mixture is made
in shards; for each the number of blocks from each source is drawn from a multinomial, but for sources that cannot
give their share: these give all they have, spread over the shards. The k-th block drawn from a source is found by
a pseudorandom permutation of its block numbers, another one for each pass through the source, and the blocks are
joined by number. No pass beyond the cap is begun, so no token is repeated more often.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.storage import Workspace, pick

BLOCK_TOKENS = 512
#: Blocks of a shard: no row and no array is larger.
SHARD_BLOCKS = 1024
#: Shards whose counts are summed at once to number the slots.
SHARD_GROUP = 1024
ROUNDS = 4


def permuted(index: np.ndarray, n: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """The places of `index` in a pseudorandom permutation of 0..n-1: a Feistel network, walked until within n."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    key = seed.astype(np.uint64)

    def once(x: np.ndarray, half, mask, key) -> np.ndarray:
        left, right = x >> half, x & mask
        for r in range(ROUNDS):
            mixed = (right + key + np.uint64(r + 1) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(32))) & mask)
        return (left << half) | right

    with np.errstate(over="ignore"):
        out = once(index.astype(np.uint64), half, mask, key)
        out_of_range = out >= n.astype(np.uint64)
        while out_of_range.any():
            at = np.flatnonzero(out_of_range)
            out[at] = once(out[at], half[at], mask[at], key[at])
            out_of_range = out >= n.astype(np.uint64)
    return out.astype(np.int64)


def quotas(share: np.ndarray, cap: np.ndarray, total: float) -> np.ndarray:
    """What each source gives: its share, or its cap; what capped sources leave free goes to the others by share."""
    quota, open_ = np.zeros(len(share)), np.ones(len(share), dtype=bool)
    left = total
    while open_.any() and left > 0 and share[open_].sum() > 0:
        want = left * share / share[open_].sum()
        full = open_ & (want >= cap)
        if not full.any():
            quota[open_] = want[open_]
            break
        quota[full] = cap[full]
        left -= cap[full].sum()
        open_ &= ~full
    return quota


def draw(shard: np.ndarray, shards: int, blocks: int, fixed: np.ndarray, weight: np.ndarray, seed: int) -> np.ndarray:
    """Blocks of each source in each of the given shards; `blocks` is the size of all shards together.

    fixed: blocks that a source gives in all, spread evenly; weight: by what the other blocks are drawn.
    """
    upto = lambda s, n: (s * n) // shards
    counts = np.zeros((len(shard), len(fixed)), dtype=np.int64)
    for row, s in enumerate(int(x) for x in shard):
        counts[row] = [upto(s + 1, int(n)) - upto(s, int(n)) for n in fixed]
        free = upto(s + 1, blocks) - upto(s, blocks)
        if free and weight.sum() > 0:
            counts[row] += np.random.default_rng([seed, s]).multinomial(free, weight / weight.sum())
    return counts


def laid_out(sized: DataFrame, space: Workspace) -> DataFrame:
    """source, id, tokens and at: where each document begins when those of its source lie end to end.

    Ranges of documents are summed where they lie, the sums (one for each range and source) are prefix-combined,
    and the ranges are summed again from there, so that the largest source is spread like all others.
    """
    ranged = sized.repartitionByRange("source", "id", "tokens").withColumn("part", F.spark_partition_id())
    ranged = space.write(ranged, "ranged")
    sums = ranged.groupBy("source", "part").agg(F.sum("tokens").alias("sum"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "part", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("source", "part").orderBy("id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("within", F.coalesce(F.sum("tokens").over(within), F.lit(0))).join(starts, ["source", "part"])
    return placed.select("source", "id", "tokens", (F.col("start") + F.col("within")).alias("at"))


class Mixture:
    """A mixture as large as all documents together.

    documents: ids, sources and sizes in tokens (a null size counts as 0; further columns are ignored); targets:
    one row for each source with share and max_repeats, a parameter of a few rows that the driver holds.
    Documents with a null source or one without a target count for the size of the mixture but are not in it. A
    null share or cap counts as 0. Shares need not sum to 1. What a source cannot give is given by the others by
    their shares, as far as their caps go. Repeated rows are documents of their own. A source named twice among
    the targets is refused. Empty documents or targets give an empty mixture, and a report of the targets.
    """

    def __init__(self, documents: DataFrame, id: str, source: str, tokens: str, targets: DataFrame, target_source: str, share: str, max_repeats: str, block: int = BLOCK_TOKENS, shard_blocks: int = SHARD_BLOCKS, seed: int = 1) -> None:
        spark = self.spark = documents.sparkSession
        self.space = Workspace(spark, "mixture")
        wanted = pick(targets, source=target_source, share=share, repeats=max_repeats).where("source is not null").toPandas()
        if wanted["source"].duplicated().any():
            raise ValueError("a source has two targets")
        wanted = wanted.fillna({"share": 0.0, "repeats": 0}).sort_values("source", ignore_index=True)
        docs = pick(documents, id=id, source=source, tokens=tokens).withColumn("tokens", F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0)).cast("long"))
        # One row for each source of the documents, of which those with a target come to the driver.
        names = spark.createDataFrame(wanted[["source"]], "source string")
        sums = self.space.write(docs.groupBy("source").agg(F.sum("tokens").alias("tokens")), "sums")
        known = sums.join(F.broadcast(names), "source").toPandas().set_index("source")["tokens"]
        total = int(sums.agg(F.sum("tokens")).first()[0] or 0)
        have = wanted["source"].map(known).fillna(0).to_numpy(np.int64)
        repeats, weight = np.maximum(wanted["repeats"].to_numpy(np.int64), 0), np.maximum(wanted["share"].to_numpy(float), 0.0)
        blocks = -(-have // block)
        cap = blocks * repeats
        quota = quotas(weight, (have * repeats).astype(float), total)
        full = quota >= have * repeats
        fixed = np.where(full, cap, 0)
        open_weight = np.where(full, 0.0, quota)
        drawn = int(round(open_weight.sum() / block))
        shards = max(1, -(-int(fixed.sum() + drawn) // shard_blocks))
        #: What the driver holds of each source; a few rows.
        self.sources = wanted.assign(target_tokens=weight * total, source_tokens=have, blocks=blocks, slots_most=cap, seed=seed + 1_000_003 * np.arange(len(wanted)))

        def counted(batches):
            for batch in batches:
                counts = draw(batch["id"].to_numpy(), shards, drawn, fixed, open_weight, seed)
                s, k = np.nonzero(counts)
                yield pd.DataFrame({"shard": batch["id"].to_numpy()[s], "k": k, "n": counts[s, k]})

        counts = self.space.write(spark.range(shards).mapInPandas(counted, "shard long, k int, n long"), "counts")
        # Slots of a source are numbered over all shards, by sums of groups of shards and within each group.
        group = counts.withColumn("group", F.floor(F.col("shard") / SHARD_GROUP))
        by_group = group.groupBy("k", "group").agg(F.sum("n").alias("n"))
        earlier = Window.partitionBy("k").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
        starts = by_group.select("k", "group", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
        inside = Window.partitionBy("k", "group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        runs = group.withColumn("first", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(starts, ["k", "group"]).select("shard", "k", "n", (F.col("start") + F.col("first")).alias("first"))
        slots = runs.repartition("shard", "k").select("shard", F.col("k").alias("drawn"), F.posexplode(F.expr("sequence(first, first + n - 1)")).alias("pos", "slot"))
        self.slots = self._placed(slots, counts)
        placed = laid_out(docs.where("tokens > 0").join(F.broadcast(names), "source"), self.space)
        #: source, block, id, begin, tokens: the stretch of a document that lies in a block.
        self.blocks = placed.withColumn("block", F.explode(F.expr(f"sequence(at div {block}, (at + tokens - 1) div {block})"))).select(
            "source",
            "block",
            "id",
            F.greatest(F.col("block") * block - F.col("at"), F.lit(0)).alias("begin"),
            (F.least((F.col("block") + 1) * block, F.col("at") + F.col("tokens")) - F.greatest(F.col("block") * block, F.col("at"))).alias("tokens"),
        )

    def _placed(self, slots: DataFrame, counts: DataFrame) -> DataFrame:
        """shard, pos, drawn, source, slot, block: which block stands at each place of the mixture.

        A draw beyond the cap of its source is handed to a source with room, by their shares.
        """
        src = self.sources
        n, cap = np.zeros(len(src), dtype=np.int64), src["slots_most"].to_numpy(np.int64)
        for r in counts.groupBy("k").agg(F.sum("n").alias("n")).collect():  # one row for each target
            n[r.k] = r.n
        beyond = np.maximum(n - cap, 0)
        room = np.maximum(cap - n, 0)
        extra = np.floor(quotas(np.where(room > 0, src["share"].to_numpy(float), 0.0), room.astype(float), float(beyond.sum()))).astype(np.int64)
        while (missing := min(beyond.sum(), room.sum()) - extra.sum()) > 0:
            for k in np.argsort(extra - room, kind="stable")[:missing]:
                extra[k] += extra[k] < room[k]
        self.slots_drawn = np.minimum(n, cap) + extra
        over_from, extra_from = np.cumsum(beyond) - beyond, np.cumsum(extra) - extra
        by = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values.tolist()]), k + 1)
        if not len(src):
            return slots.select("shard", "pos", "drawn", F.lit("").alias("source"), "slot", F.lit(0).cast("long").alias("block")).where("false")
        k = F.col("drawn")
        over = F.col("slot") - by(cap, k)
        over = F.when(over >= 0, over + by(over_from, k))
        taken = F.lit(None).cast("int")
        for j in np.flatnonzero(extra):
            taken = F.when(over.between(int(extra_from[j]), int(extra_from[j] + extra[j] - 1)), int(j)).otherwise(taken)
        held = slots.withColumn("over", over).withColumn("k", F.when(F.col("over").isNull(), k).otherwise(taken)).where("k is not null")
        k = F.col("k")
        slot = F.when(F.col("over").isNull(), F.col("slot")).otherwise(F.col("over") - by(extra_from, k) + by(np.minimum(n, cap), k))
        seed = src["seed"].to_numpy(np.int64)

        @F.pandas_udf("long")
        def place(slot: pd.Series, blocks: pd.Series, seed: pd.Series) -> pd.Series:
            slot, blocks = slot.to_numpy(np.int64), blocks.to_numpy(np.int64)
            return pd.Series(permuted(slot % blocks, blocks, seed.to_numpy(np.int64) + 7919 * (slot // blocks)))

        named = held.select("shard", "pos", "drawn", by(src["source"].to_numpy(object), k).alias("source"), slot.alias("slot"), by(src["blocks"].to_numpy(np.int64), k).alias("blocks"), by(seed, k).alias("seed"))
        return named.select("shard", "pos", "drawn", "source", "slot", place("slot", "blocks", "seed").alias("block"))

    def content(self) -> DataFrame:
        """shard, drawn, pos, source, id, begin, tokens: the mixture, block by block."""
        return self.slots.join(self.blocks, ["source", "block"]).select("shard", "drawn", "pos", "source", "id", "begin", "tokens")

    def _times(self) -> DataFrame:
        return self.slots.groupBy("source", "block").agg(F.count("*").alias("times"))

    def used(self) -> DataFrame:
        """source, id, repeats, tokens: each document in the mixture, how often its most used stretch, and its tokens."""
        return self.blocks.join(self._times(), ["source", "block"]).groupBy("source", "id").agg(F.max("times").alias("repeats"), F.sum(F.col("times") * F.col("tokens")).alias("tokens"))

    def report(self) -> DataFrame:
        """For each source its target and actual share, its size, and whether it stays short for want of documents.

        Short is a source all of whose blocks stand in the mixture as often as they may, with fewer tokens than its
        target. Sizes, shares and slots are those of the drawn mixture.
        """
        size = self.blocks.groupBy("source", "block").agg(F.sum("tokens").alias("tokens")).join(self._times(), ["source", "block"], "left")
        got = size.groupBy("source").agg(F.sum(F.coalesce("times", F.lit(0)) * F.col("tokens")).alias("mixed_tokens"), F.sum(F.coalesce("times", F.lit(0))).alias("slots"))
        base = self.spark.createDataFrame(self.sources[["source", "share", "source_tokens", "target_tokens", "slots_most"]], "source string, share double, source_tokens long, target_tokens double, slots_most long")
        total = Window.partitionBy()  # over the few rows of the targets
        mixed, slots = F.coalesce("mixed_tokens", F.lit(0)), F.coalesce("slots", F.lit(0))
        return base.join(got, "source", "left").select(
            "source",
            F.col("share").alias("target_share"),
            (mixed / F.nullif(F.sum(mixed).over(total), F.lit(0))).alias("actual_share"),
            mixed.alias("mixed_tokens"),
            "source_tokens",
            ((slots >= F.col("slots_most")) & (mixed < F.col("target_tokens"))).alias("short"),
        )
