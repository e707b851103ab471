"""Questions about facts: who, what, when, according to whom, how firmly; with citations and audits."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = 64
#: The order facts are kept in; the last columns only make it total.
BAKED = ["subject", "from_day", "predicate", "object_ref", "source_ref", "to_day", "confidence_raw", "locus", "fact_id", "recorded_at"]
#: Words of the kinds of sources, and the predicates whose object is a line of text.
KINDS = ["notarial", "archaeology", "administrative", "chronicle", "panegyric"]
TEXT_VALUED = [1003, 1103, 1104, 1105, 1203, 1205, 1207]
FULL = 65536


@dataclass(frozen=True)
class FactQuery:
    """What is asked; a part that is None asks nothing."""

    subject: int | None = None
    predicate: int | None = None
    object: int | None = None
    source: int | None = None
    locus: int | None = None
    least: int | None = None
    day_from: int | None = None
    day_to: int | None = None
    limit: int = 16

    def during(self, first: int, last: int) -> FactQuery:
        return replace(self, day_from=first, day_to=last)

    def on_day(self, day: int) -> FactQuery:
        return self.during(day, day)

    def condition(self) -> Column:
        """Only what is asked becomes a condition, so that it reaches the scan."""
        asked = F.lit(True)
        for column, value in (("subject", self.subject), ("predicate", self.predicate), ("object_ref", self.object), ("source_ref", self.source), ("locus", self.locus)):
            if value is not None:
                asked &= F.col(column) == value
        if self.least is not None:
            asked &= F.col("confidence_raw") >= self.least
        if self.day_from is not None:
            asked &= F.col("to_day") >= self.day_from
        if self.day_to is not None:
            asked &= F.col("from_day") <= self.day_to
        return asked

    def describe(self) -> str:
        terms = [("subject", self.subject), ("predicate", self.predicate), ("object", self.object), ("source", self.source), ("day_from", self.day_from), ("day_to", self.day_to), ("sigma_raw_min", self.least)]
        said = [f"{k}={v}" for k, v in terms if v is not None] or ["everything"]
        return " ".join([*said, f"limit={self.limit}"])


def page(facts: DataFrame, query: FactQuery) -> DataFrame:
    """The first facts in kept order, with their place, the number of all that match and whether the page leaves some out."""
    found = facts.where(query.condition())
    shown = min(query.limit, PAGE)
    head = found.orderBy(*BAKED).limit(shown).withColumn("place", F.row_number().over(Window.orderBy(*BAKED)).cast("long"))
    # One row, and no action before the plan runs.
    counted = found.agg(F.count("*").alias("matched"))
    return head.crossJoin(F.broadcast(counted)).withColumn("truncated", F.col("matched") > shown)


def best(facts: DataFrame, query: FactQuery) -> DataFrame:
    """The firmest fact, the first kept where several are as firm."""
    return facts.where(query.condition()).orderBy(F.desc("confidence_raw"), *BAKED).limit(1)


def defects(facts: DataFrame, sources: DataFrame, loci: DataFrame, documents: DataFrame) -> DataFrame:
    """Each fact with its first defect: unsourced, unlocated (which is allowed), dangling locus or document.

    sources: source_id; loci: locus_id, document; documents: document.
    """
    known = sources.select(F.col("source_id").alias("source_ref"), F.lit(True).alias("sourced")).distinct()
    placed = loci.select(F.col("locus_id").alias("locus"), "document").join(documents.select("document", F.lit(True).alias("there")), "document", "left")
    joined = facts.join(known, "source_ref", "left").join(placed.select("locus", F.lit(True).alias("located"), "there"), "locus", "left")
    reason = (
        F.when(F.col("sourced").isNull(), "unsourced").when(F.coalesce("locus", F.lit(0)) == 0, "unlocated")
        .when(F.col("located").isNull(), "dangling locus").when(F.col("there").isNull(), "dangling document").otherwise("sound")
    )
    return joined.withColumn("defect", reason)


def audit(facts: DataFrame, sources: DataFrame, loci: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: facts, unsourced, unlocated, dangling_locus, dangling_document, unnamed, sound.

    A source without a name is unnamed, which is allowed; one whose document does not exist counts as a dangling
    document. Sound is a corpus without unsourced facts, dangling positions and documents. sources: source_id,
    source_name, document (null where it names none).
    """
    found = defects(facts, sources, loci, documents)
    count = lambda d: F.count_if(F.col("defect") == d)
    of_facts = found.agg(F.count("*").alias("facts"), count("unsourced").alias("unsourced"), count("unlocated").alias("unlocated"), count("dangling locus").alias("dangling_locus"), count("dangling document").alias("in_facts"))
    held = sources.join(documents.select("document", F.lit(True).alias("there")).distinct(), "document", "left")
    of_sources = held.agg(F.count_if(F.col("source_name").isNull()).alias("unnamed"), F.count_if(F.col("document").isNotNull() & F.col("there").isNull()).alias("in_sources"))
    both = of_facts.crossJoin(F.broadcast(of_sources)).withColumn("dangling_document", F.col("in_facts") + F.col("in_sources"))
    return both.select("facts", "unsourced", "unlocated", "dangling_locus", "dangling_document", "unnamed", (F.col("unsourced") + F.col("dangling_locus") + F.col("dangling_document") == 0).alias("sound"))


def cite(facts: DataFrame, sources: DataFrame, loci: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Facts with their source, and the document and passage where they have a position; unsourced ones are left out.

    Where a fact has no position, or one whose document does not exist, the document of its source stands in, if it
    names one (its column document). documents: document and translation (is it a rendering of another?); none, and
    every document named exists and no translation is marked.
    """
    named = sources.select(F.col("source_id").alias("source_ref"), "source_kind", "source_name", *([F.col("document").alias("own")] if "document" in sources.columns else [F.lit(None).cast("string").alias("own")]))
    placed = facts.join(named, "source_ref").join(loci.select(F.col("locus_id").alias("locus"), F.col("document").alias("at"), "passage"), "locus", "left")
    if documents is None:
        return placed.withColumn("document", F.coalesce("at", "own")).withColumn("translation", F.lit(False)).drop("at", "own")
    known = documents.groupBy("document").agg(F.max("translation").alias("translation"))
    found = placed.join(known.toDF("at", "at_translation"), "at", "left").join(known.toDF("own", "own_translation"), "own", "left")
    here = F.col("at_translation").isNotNull()
    return found.withColumn("document", F.when(here, F.col("at")).when(F.col("own_translation").isNotNull(), F.col("own"))).withColumn("translation", F.coalesce("at_translation", "own_translation", F.lit(False))).drop("at", "own", "at_translation", "own_translation")


def kind_word(kind: Column) -> Column:
    word = F.lit("unknown")
    for i, k in enumerate(KINDS):
        word = F.when(kind == i, k).otherwise(word)
    return word


def render(source: Column, name: Column, kind: Column, years_after: Column, document: Column, passage: Column, translation: Column | None = None) -> Column:
    """A citation as text."""
    distance = F.when(years_after.isNull(), F.lit(", distance unknown)")).otherwise(F.concat(F.lit(", +"), years_after.cast("string"), F.lit("y)")))
    head = F.concat(F.coalesce(name, F.concat(F.lit("source#"), source.cast("string"))), F.lit(" ("), kind_word(kind), distance)
    mark = F.lit("") if translation is None else F.when(translation, " [translation]").otherwise("")
    return F.concat(head, F.coalesce(F.concat(F.lit(" — "), document, mark), F.lit("")), F.coalesce(F.concat(F.lit(" "), passage), F.lit("")))


def encoded_fact() -> Column:
    """A fact as its eight words of 32 bits, in their order; null where a value does not fit one.

    Days are signed and wrap; what is absent is 0; confidences travel as they are, never through a fraction.
    """
    fields = ["subject", "predicate", "object_ref", "from_day", "to_day", "source_ref", "confidence_raw", "locus"]
    return _words(*[(F.col(c), c in ("from_day", "to_day")) for c in fields])


def encoded_source() -> Column:
    """A source as words: id, kind, the day it was composed from (signed), agreements; null where one does not fit."""
    return _words(*[(F.col(c), c == "composed_from") for c in ("source_id", "source_kind", "composed_from", "agreements")])


def _words(*values: tuple[Column, bool]) -> Column:
    whole = [(F.coalesce(v.cast("long"), F.lit(0)), signed) for v, signed in values]
    fits = F.lit(True)
    for v, signed in whole:
        fits &= v.between(-(2**31), 2**31 - 1) if signed else v.between(0, 2**32 - 1)
    return F.when(fits, F.array(*[v.bitwiseAND(F.lit(2**32 - 1).cast("long")) for v, _ in whole]))


def fuse(told: Column) -> Column:
    """1 - (1 - p)(1 - q) ... on Q16.16 words, in ascending order so that the result is the same in every run.

    told: array of struct(c, n), each confidence once with how often it is told; what is left is 0 after FULL tellings.
    """
    rest = F.aggregate(
        F.array_sort(told),
        F.lit(FULL).cast("long"),
        lambda r, t: F.aggregate(F.sequence(F.lit(1), F.least(t["n"], F.lit(FULL))), r, lambda left, _: F.floor(left * (FULL - t["c"]) / FULL).cast("long")),
    )
    return F.lit(FULL) - rest


def contradictions(facts: DataFrame, predicate: int) -> DataFrame:
    """Pairs of facts of a functional predicate: one subject, windows that overlap, different objects.

    The windows of a subject are cut into stretches of `WIDTH` days and joined by stretch, so that a subject with
    very many facts is spread over many tasks; a pair is kept in the first stretch both touch.
    """
    width = 36525
    told = facts.where((F.col("predicate") == predicate) & F.col("subject").isNotNull() & (F.col("to_day") >= F.col("from_day")))
    told = told.select("fact_id", "subject", "object_ref", "from_day", "to_day").distinct()
    cut = told.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("from_day") / width), F.floor(F.col("to_day") / width))))
    a, b = cut.alias("a"), cut.alias("b")
    meet = (F.col("a.subject") == F.col("b.subject")) & (F.col("a.stretch") == F.col("b.stretch"))
    pairs = a.join(b, meet).where("a.fact_id < b.fact_id and a.object_ref <> b.object_ref and a.from_day <= b.to_day and b.from_day <= a.to_day")
    first = F.floor(F.greatest(F.col("a.from_day"), F.col("b.from_day")) / width)
    return pairs.where(F.col("a.stretch") == first).select(F.col("a.subject").alias("subject"), F.col("a.fact_id").alias("fact_a"), F.col("b.fact_id").alias("fact_b")).distinct()


def fused(facts: DataFrame, predicate: int) -> DataFrame:
    """subject, object_ref, fused, sources: what several tellings of one thing are worth together.

    A source counts once, with its firmest telling. Tellings are counted by confidence, of which there are FULL + 1 at
    most, so that a thing told by very many sources is never gathered row by row.
    """
    told = facts.where((F.col("predicate") == predicate) & F.col("subject").isNotNull() & F.col("confidence_raw").between(0, FULL))
    once = told.groupBy("subject", "object_ref", "source_ref").agg(F.max("confidence_raw").alias("c"))
    by = once.groupBy("subject", "object_ref", "c").agg(F.count("*").alias("n"))
    return by.groupBy("subject", "object_ref").agg(fuse(F.collect_list(F.struct("c", "n"))).alias("fused"), F.sum("n").alias("sources"))


def timeline(facts: DataFrame, predicate: int, demotion: int = FULL // 2) -> DataFrame:
    """subject, object_ref, fused, sources, contradicted, standing: the consensus on a functional predicate.

    Tellings of one thing are fused. A thing that contradicts a firmer one of its subject (windows that overlap,
    another object) is demoted, never deleted: `standing` is its fused confidence times `demotion`. Of equally firm
    ones the least object stands.
    """
    worth = fused(facts, predicate)
    rows = facts.where(F.col("predicate") == predicate).select("fact_id", "object_ref").distinct()
    pairs = contradictions(facts, predicate).join(rows.toDF("fact_a", "object_a"), "fact_a").join(rows.toDF("fact_b", "object_b"), "fact_b")
    things = pairs.select("subject", "object_a", "object_b").where("object_a <> object_b").distinct()
    both = things.unionByName(things.select("subject", F.col("object_b").alias("object_a"), F.col("object_a").alias("object_b"))).distinct()
    side = lambda o, c: worth.select("subject", F.col("object_ref").alias(o), F.col("fused").alias(c))
    rival = both.join(side("object_a", "own"), ["subject", "object_a"]).join(side("object_b", "other"), ["subject", "object_b"])
    weaker = rival.where("other > own or other = own and object_b < object_a").select("subject", F.col("object_a").alias("object_ref"), F.lit(True).alias("contradicted")).distinct()
    told = worth.join(weaker, ["subject", "object_ref"], "left").withColumn("contradicted", F.coalesce("contradicted", F.lit(False)))
    return told.withColumn("standing", F.when(F.col("contradicted"), F.expr(f"fused * {demotion} div {FULL}")).otherwise(F.col("fused")))
