"""Questions about catalogue rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CatalogueQuery:
    """What is asked; a part that is None asks nothing. Language 0 is the unknown one, which can be asked for."""

    holder: str | None = None
    language: int | None = None
    flags: int = 0
    without: int = 0
    year_from: int | None = None
    year_to: int | None = None
    title: str | None = None

    def condition(self) -> Column:
        """Rows of an unknown year are left out only if a bound is stated; no last year means the first."""
        asked = F.lit(True)
        if self.holder is not None:
            asked &= F.col("holder") == self.holder
        if self.language is not None:
            asked &= F.col("lang_tag") == self.language
        if self.flags:
            asked &= F.col("flags").bitwiseAND(self.flags) == self.flags
        if self.without:
            asked &= F.col("flags").bitwiseAND(self.without) == 0
        if self.year_from is not None or self.year_to is not None:
            asked &= F.col("year_from") != 0
        if self.year_to is not None:
            asked &= F.col("year_from") <= self.year_to
        if self.year_from is not None:
            asked &= F.coalesce(F.nullif("year_to", F.lit(0)), "year_from") >= self.year_from
        if self.title is not None:
            asked &= F.col("title").contains(self.title)
        return asked


def browse(rows: DataFrame, query: CatalogueQuery, limit: int) -> DataFrame:
    """The first rows that match by their ids, with the number of all that match and of all rows."""
    found = rows.withColumn("hit", query.condition())
    counted = found.agg(F.count_if("hit").alias("matched"), F.count("*").alias("total"))
    return found.where("hit").drop("hit").orderBy("entry_id").limit(limit).crossJoin(F.broadcast(counted))
