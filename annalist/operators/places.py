"""Places by their keys: where they lie, when they were, and what they are connected with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolved(ids: DataFrame, places: DataFrame) -> DataFrame:
    """place, x, z, located, dated, min_year, max_year of the ids (place) that the gazetteer holds.

    places: what gazetteer_valid() gives, the record of the least number for each key. x is the longitude, z the
    latitude as Q16.16 words. A place without both years is undated: its window is left at 0.
    """
    first = places.groupBy("place").agg(F.min_by(F.struct("lon_raw", "lat_raw", "min_year", "max_year"), "record").alias("p"))
    dated = F.col("p.min_year").isNotNull() & F.col("p.max_year").isNotNull()
    shown = first.select(
        "place", F.coalesce("p.lon_raw", F.lit(0)).alias("x"), F.coalesce("p.lat_raw", F.lit(0)).alias("z"), (F.col("p.lon_raw").isNotNull() & F.col("p.lat_raw").isNotNull()).alias("located"),
        dated.alias("dated"), F.when(dated, F.col("p.min_year")).otherwise(0).alias("min_year"), F.when(dated, F.col("p.max_year")).otherwise(0).alias("max_year"),
    )
    return ids.join(shown, "place")


def exists_in_year(year: Column) -> Column:
    """Was a resolved() place there in a year? Of an undated one nothing else is known, so it was."""
    return ~F.col("dated") | year.between(F.col("min_year"), F.col("max_year"))


def neighbours(links: DataFrame, most: int | None = None) -> DataFrame:
    """place, neighbour, total: the neighbours of each place, the `most` least of them if stated, and how many there are.

    links: place, neighbour, both directions, each once. Each task keeps no more than that of a place
    before they travel (the limit is pushed into the window), so a place with any number of neighbours is not gathered.
    """
    total = links.groupBy("place").agg(F.count("*").alias("total"))
    if most is not None:
        nth = F.row_number().over(Window.partitionBy("place").orderBy("neighbour"))
        links = links.withColumn("n", nth).where(F.col("n") <= most)
    return links.join(total, "place").select("place", "neighbour", "total")
