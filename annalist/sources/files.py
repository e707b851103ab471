"""Finding files of a corpus and telling their kinds apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEI_NAMESPACE = "http://www.tei-c.org/ns/1.0"
#: A report has a line in italics that holds an ISO date.
BYLINE = r"(?m)^\*[^*\n]*\b([0-9]{4})-([0-9]{2})-([0-9]{2})\b[^*\n]*\*\s*$"
HEAD = 4096


def read_tree(spark: SparkSession, root: str, prefix: str = "", exclude: tuple[str, ...] = (), glob: str = "*.{md,xml}") -> DataFrame:
    """path, canonical, body of all files below a folder, those below excluded folder names left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    base = root.rstrip("/").removeprefix("file://")
    within = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), f"^{base}/", "")
    parts = F.split(within, "/")
    named = files.select("path", F.concat(F.lit(f"{prefix}/" if prefix else ""), within).alias("canonical"), F.decode("content", "UTF-8").alias("body"), parts.alias("parts"))
    if exclude:
        named = named.where(~F.arrays_overlap(F.slice("parts", 1, F.size("parts") - 1), F.array(*[F.lit(x) for x in exclude])))
    return named.drop("parts")


def kind_of(body: Column) -> Column:
    """tei, report or markdown by the first bytes; marked-up text that is not TEI is other."""
    head = F.substring(body, 1, HEAD)
    return F.when(head.contains(TEI_NAMESPACE), "tei").when(F.ltrim(head).startswith("<"), "other").when(head.rlike(BYLINE), "report").otherwise("markdown")
