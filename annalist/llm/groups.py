"""One group identifier for all records linked directly or through others.

Minimum labels travel across the links, pointer jumping shortens the way to the root, and the links are then
drawn between roots only, so that each round leaves fewer of them. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.storage import Workspace, pick

NODE = "node long, label long"
LINK = "a long, b long"


def _rooted(space: Workspace, hooks: DataFrame, tag: str) -> DataFrame:
    """Point every node at its root: node -> label becomes node -> label's label until nothing changes."""
    jump = 0
    current = space.write(hooks, f"{tag}-{jump}")
    while True:
        # Only labels that are no roots themselves lead further.
        further = current.where("node <> label").select(F.col("node").alias("label"), F.col("label").alias("next"))
        stepped = current.join(further, "label", "left").select("node", F.coalesce("next", "label").alias("label"), F.col("next").isNotNull().alias("moved"))
        jump += 1
        stepped = space.write(stepped, f"{tag}-{jump}")
        moved = not stepped.where("moved").isEmpty()
        space.drop(f"{tag}-{jump - 1}")
        current = stepped.select("node", "label")
        if not moved:
            return current


def link_groups(pairs: DataFrame, left: str, right: str, ids: DataFrame | None = None, id: str | None = None) -> DataFrame:
    """node, label: each id in a group of two or more, with the smallest id of its group.

    pairs: links between integer ids, in any order and number. A pair with a null id, and a pair of an id with
    itself, links nothing; if `ids` (with its column `id`) is given, so does a pair with an id that it lacks.
    Repeated pairs, repeated and null ids change nothing; further columns are ignored. No pairs: no rows.
    """
    space = Workspace(pairs.sparkSession, "groups")
    links = pick(pairs, a=left, b=right).select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).where("a is not null and a < b")
    # least() and greatest() skip nulls, so a pair with one null id is a pair of an id with itself here.
    if ids is not None:
        known = pick(ids, node=id).where("node is not null").select(F.col("node").cast("long").alias("node")).distinct()
        for end in ("a", "b"):
            links = links.join(known.withColumnRenamed("node", end), end, "left_semi")
    links = space.write(links.select("a", "b").distinct(), "links-0")
    labels: DataFrame | None = None
    round_ = 0
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label"))
        roots = _rooted(space, hooks, f"hooks-{round_}")
        if labels is None:
            labels = space.write(roots, f"labels-{round_}")
        else:
            onward = roots.where("node <> label").select(F.col("node").alias("label"), F.col("label").alias("next"))
            labels = space.write(labels.join(onward, "label", "left").select("node", F.coalesce("next", "label").alias("label")), f"labels-{round_}")
        to = roots.select(F.col("node"), F.col("label"))
        between = links.join(to.toDF("a", "la"), "a").join(to.toDF("b", "lb"), "b").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).where("a < b").distinct()
        links = space.write(between, f"links-{round_ + 1}")
        space.drop(f"links-{round_}")
        space.drop(f"labels-{round_ - 1}")
        round_ += 1
    if labels is None:
        return pairs.sparkSession.createDataFrame([], NODE)
    return labels


def representatives(ids: DataFrame, id: str, pairs: DataFrame, left: str, right: str) -> DataFrame:
    """node, label for every id: the smallest id of its group, itself where nothing links it."""
    known = pick(ids, node=id).where("node is not null").select(F.col("node").cast("long").alias("node")).distinct()
    return known.join(link_groups(pairs, left, right, ids, id), "node", "left").select("node", F.coalesce("label", "node").alias("label"))
