"""Proposed claims held against the text they quote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions.texts import FULL, name_identifier, normalise_claim

MOST_PROPOSALS = 64


def ground(claims: DataFrame) -> DataFrame:
    """The claims with their outcome, the first check that fails, or "admitted".

    Columns: passage, quotation, subject, predicate, object, from_day, to_day, confidence_raw. The quotation must
    stand in the passage, subject and object in the quotation, after case and blanks are made equal; a subject of
    blanks only stands anywhere. A null counts as empty.
    """
    said = lambda c: F.coalesce(F.col(c), F.lit(""))
    plain = lambda c: normalise_claim(said(c))
    outcome = (
        F.when((said("subject") == "") | (said("predicate") == "") | (said("object") == ""), "incomplete")
        .when(F.col("to_day") < F.col("from_day"), "impossible window")
        .when(F.col("confidence_raw") > FULL, "over confident")
        .when(plain("quotation") == "", "no quotation")
        .when(~plain("passage").contains(plain("quotation")), "quotation absent")
        .when(~plain("quotation").contains(plain("subject")), "subject absent")
        .when(~plain("quotation").contains(plain("object")), "object absent")
        .otherwise("admitted")
    )
    return claims.withColumn("outcome", outcome)


class Crowded(ValueError):
    """A passage has more proposals than are allowed."""


def synthesise(claims: DataFrame, passage_id: str) -> DataFrame:
    """Grounded claims; a passage with more proposals than are allowed fails the batch."""
    crowded = claims.groupBy(passage_id).agg(F.count("*").alias("n")).where(F.col("n") > MOST_PROPOSALS)
    if not crowded.isEmpty():
        raise Crowded(f"a passage has more than {MOST_PROPOSALS} proposals")
    return ground(claims)


def testimonies(claims: DataFrame, source: str) -> DataFrame:
    """claim, source: who testifies to what, each once; a claim is named by its parts with case and blanks made equal."""
    parts = [normalise_claim(F.coalesce(F.col(c), F.lit(""))) for c in ("subject", "predicate", "object")]
    return claims.select(name_identifier(F.concat_ws("\x1f", *parts)).alias("claim"), F.col(source).alias("source")).distinct()
