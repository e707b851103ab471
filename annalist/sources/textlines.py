"""Tables of lines of text, addressed by position, with the offsets that a stored form keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.operators.order import running
from annalist.storage import pick


def split_lines(documents: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, line (from 0), text of each line; a null or empty text has none."""
    rows = pick(documents, doc=doc, text=text).where("text <> ''")
    return rows.select("doc", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))


def offsets(lines: DataFrame) -> DataFrame:
    """doc, line, begin, size: where each line begins in the bytes of its document, line breaks not counted."""
    size = F.octet_length("text").cast("long")
    return running(lines, "doc", "line", size, "begin").select("doc", "line", F.col("begin").cast("long").alias("begin"), size.alias("size"))


def refused(table: DataFrame, sizes: DataFrame) -> DataFrame:
    """doc, reason of the offset tables that are not opened.

    table: doc, line, begin; sizes: doc, lines, bytes as a header states them. The lines must be as many as stated and
    numbered without a hole, the offsets never fall, begin at 0 and stay within the bytes.
    """
    run = Window.partitionBy("doc").orderBy("line")
    steps = table.withColumn("last", F.lag("begin").over(run))
    told = steps.groupBy("doc").agg(
        F.count("*").alias("n"), F.max("line").alias("most"), F.min("line").alias("least"), F.min("begin").alias("low"), F.max("begin").alias("high"),
        F.coalesce(F.bool_or(F.col("begin") < F.col("last")), F.lit(False)).alias("falls"),
    )
    both = sizes.join(told, "doc", "full")
    reason = (
        F.when(F.col("lines").isNull(), "no header").when(F.coalesce("n", F.lit(0)) != F.col("lines"), "other number of lines").when((F.col("least") != 0) | (F.col("most") != F.col("n") - 1), "hole in the lines")
        .when(F.col("falls") | (F.col("low") != 0), "offsets out of order").when(F.col("high") > F.col("bytes"), "offset beyond the end")
    )
    return both.select("doc", reason.alias("reason")).where("reason is not null")


def line_at(lines: DataFrame, doc, number: int) -> DataFrame:
    """The text of one line of a document; none beyond its end."""
    return lines.where((F.col("doc") == doc) & (F.col("line") == number)).select("text")
