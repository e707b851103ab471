"""Names and references resolved to entities, and independent witnesses of claims."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions.texts import normalise_reference
from annalist.operators.components import components
from annalist.operators.setjoin import PROPOSE, abbreviations, similar_pairs
from annalist.storage import Workspace, pick

#: Why two handles are proposed.
SAME_REFERENCE, SIMILAR_NAME, ABBREVIATION = 1, 2, 3


class Duplicates(ValueError):
    """A handle is used twice."""


def unique(rows: DataFrame, id: str) -> DataFrame:
    """The rows, refused if a handle repeats."""
    if not rows.groupBy(id).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise Duplicates(f"repeated {id}")
    return rows


def hard_links(rows: DataFrame, id: str, reference: str) -> DataFrame:
    """a, b: each row whose reference another shares, with the least row of that reference.

    References are compared in their normalised form; empty and null ones are equal to none. A reference that very
    many rows share gives one link for each of them, and its least row is found by partial aggregation.
    """
    keyed = pick(rows, id=id, reference=reference).select("id", normalise_reference(F.col("reference")).alias("key")).where("key <> ''")
    least = keyed.groupBy("key").agg(F.min("id").alias("least"))
    return keyed.join(least, "key").where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b")).distinct()


class Resolution:
    """Handles (id, name, reference) resolved to entities.

    Rows of one reference are one entity. Names similar enough, and abbreviations, are proposed, with their evidence;
    only if `auto_merge` is given do similar names from that score on merge too. Pairs that are one entity already
    are not proposed. A repeated id refuses the batch; null names and references match nothing.
    """

    def __init__(self, rows: DataFrame, id: str = "id", name: str = "name", reference: str = "reference", propose: int = PROPOSE, auto_merge: int = 0) -> None:
        self._space = space = Workspace(rows.sparkSession, "resolve")
        rows = unique(space.write(pick(rows, id=id, name=name, reference=reference).where("id is not null"), "rows"), "id")
        self._named, self._propose = rows.where("name is not null"), propose
        links = hard_links(rows, "id", "reference")
        if auto_merge:
            # Only names so similar are compared for it; an abbreviation counts as what is just proposed.
            links = links.unionByName(self._pairs(max(propose, auto_merge), auto_merge <= propose).select(F.col("left").alias("a"), F.col("right").alias("b")))
        self._roots = space.write(components(links), "roots")
        #: id, label: each handle with the least handle of its entity.
        self.labels = rows.select("id").join(self._roots.toDF("id", "root"), "id", "left").select("id", F.coalesce("root", "id").alias("label"))
        self.merged = self.labels.where("id <> label")

    def _pairs(self, least: int, abbreviated: bool = True) -> DataFrame:
        """left, right, score, evidence: the pairs of names from a score on, with their firmest evidence."""
        every = similar_pairs(self._named, "id", "name", least).select("left", "right", "score", F.lit(SIMILAR_NAME).alias("evidence"))
        if not abbreviated:
            return every
        every = self._space.write(every, f"similar-{least}")
        short = abbreviations(self._named, "id", "name").select(F.least("short", "long").alias("left"), F.greatest("short", "long").alias("right")).distinct()
        short = self._space.write(short, f"short-{least}")
        known = every.join(short, ["left", "right"], "left_semi").select("left", "right")
        return every.unionByName(short.join(known, ["left", "right"], "left_anti").select("left", "right", F.lit(self._propose).cast("long").alias("score"), F.lit(ABBREVIATION).alias("evidence")))

    @cached_property
    def proposals(self) -> DataFrame:
        """left, right, score, evidence: what is proposed; names are compared only when it is asked for."""
        labelled = self._pairs(self._propose)
        for c in ("left", "right"):
            labelled = labelled.join(self._roots.toDF(c, f"{c}_root"), c, "left")
        return labelled.where(F.coalesce("left_root", "left") != F.coalesce("right_root", "right")).select("left", "right", "score", "evidence")


def witnesses(sources: DataFrame, references: str, derivations: DataFrame) -> DataFrame:
    """source, witness: sources of one reference, and what is derived from another, are one witness, named by its least source.

    sources: source_id and a reference; derivations: derived, original. A repeated source refuses the batch; an edge
    that names an unknown source says nothing.
    """
    sources = unique(sources, "source_id")
    known = sources.select("source_id")
    links = hard_links(sources, "source_id", references)
    edges = derivations.select(F.col("derived").alias("a"), F.col("original").alias("b"))
    for end in ("a", "b"):
        edges = edges.join(known.toDF(end), end, "left_semi")
    roots = components(links.unionByName(edges.select("a", "b").where("a <> b")))
    return known.join(roots.toDF("source_id", "root"), "source_id", "left").select("source_id", F.coalesce("root", "source_id").alias("witness"))


def agreements(testimonies: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each source the most other witnesses of one of its claims, and of each claim its witnesses and sources.

    testimonies: source_id, claim; roots: what witnesses() gives. Testimonies of unknown sources say nothing; a source
    without any agrees with none. Claims: claim, sources, witnesses, corroborated (more than one witness), inflated
    (one witness, several sources).
    """
    told = testimonies.select("source_id", "claim").where("claim is not null").distinct().join(roots, "source_id")
    by_witness = told.groupBy("claim", "witness").agg(F.count("*").alias("n"))
    claims = by_witness.groupBy("claim").agg(F.sum("n").alias("sources"), F.count("*").alias("witnesses"))
    claims = claims.withColumns({"corroborated": F.col("witnesses") > 1, "inflated": (F.col("witnesses") == 1) & (F.col("sources") > 1)})
    most = told.join(claims.select("claim", "witnesses"), "claim").groupBy("source_id").agg(F.max(F.col("witnesses") - 1).alias("most"))
    by_source = roots.join(most, "source_id", "left").select("source_id", "witness", F.coalesce("most", F.lit(0)).alias("agreements"))
    return by_source, claims
