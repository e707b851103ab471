"""Research reports: findings and the sources they rest on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions.dates import first_day_of_year, iso_year, last_day_of_year
from annalist.functions.texts import name_identifier, provider_confidence, source_tags
from annalist.sources.files import BYLINE

#: Predicates, and the headings of the two sections that are read, in the languages of the writers.
STATED_IN, RESTS_ON, FINDING_TEXT, SOURCE_URL, RESEARCHES, REACHABLE, CITED_IN = 1101, 1102, 1103, 1104, 1105, 1106, 1002
FINDINGS, SOURCES = r"^## (?:Constats|Findings)\s*$", r"^## Sources\s*$"
SOURCE_LINE = r"^- \[(S[0-9]{1,6})\] (.*) — <([^>]*)> \(([^()]*)\)\s*(✓?).*$"
UNREADABLE = r"^- \[(S[0-9]{1,6})\] ~~(.*?)~~"


def bullets(reports: DataFrame) -> DataFrame:
    """doc, line, section, text of the bullets; reports: doc, body. The section of a line is the last heading's."""
    each = reports.select("doc", F.posexplode(F.split("body", "\r?\n", -1)).alias("line", "text"))
    heading = F.when(F.col("text").rlike(FINDINGS), "findings").when(F.col("text").rlike(SOURCES), "sources").when(F.col("text").rlike("^#{1,6} "), "other")
    run = Window.partitionBy("doc").orderBy("line")
    return each.withColumn("section", F.last(heading, ignorenulls=True).over(run)).where(F.col("text").startswith("- "))


def findings(reports: DataFrame) -> DataFrame:
    """doc, line, tag, text: one row for each tag of a finding."""
    found = bullets(reports).where("section = 'findings'")
    return found.select("doc", "line", F.explode(source_tags(F.col("text"))).alias("tag"), F.trim(F.regexp_replace(F.regexp_replace("text", "^- ", ""), r"\[S[0-9]{1,6}\]", "")).alias("finding"))


def sources(reports: DataFrame) -> DataFrame:
    """doc, tag, title, url, provider, reachable, readable of the listed sources."""
    listed = bullets(reports).where("section = 'sources'")
    part = lambda i: F.regexp_extract("text", SOURCE_LINE, i)
    struck = F.col("text").rlike(UNREADABLE)
    return listed.where(F.col("text").rlike(SOURCE_LINE) | struck).select(
        "doc",
        F.when(struck, F.regexp_extract("text", UNREADABLE, 1)).otherwise(part(1)).alias("tag"),
        F.when(~struck, part(2)).alias("title"),
        F.when(struck, F.regexp_extract("text", UNREADABLE, 2)).otherwise(part(3)).alias("url"),
        F.when(~struck, part(4)).alias("provider"),
        (~struck & (part(5) == "✓")).alias("reachable"),
        (~struck).alias("readable"),
    )


def rests_on(reports: DataFrame) -> DataFrame:
    """Findings with the identity and confidence of their source; orphan: the report lists no such tag."""
    known = sources(reports).select("doc", "tag", "url", "provider", name_identifier(F.col("url")).alias("source"))
    joined = findings(reports).join(known, ["doc", "tag"], "left")
    return joined.select("doc", "line", "tag", "finding", "url", "source", provider_confidence(F.coalesce("provider", F.lit(""))).alias("confidence_raw"), F.col("source").isNull().alias("orphan"))


def agreements(reports: DataFrame) -> DataFrame:
    """source, agreements: over all reports, the most other sources that state one of its findings word for word."""
    told = rests_on(reports).where("not orphan").select("finding", "source").distinct()
    many = told.groupBy("finding").agg(F.count("*").alias("n"))
    return told.join(many, "finding").groupBy("source").agg(F.max(F.col("n") - 1).alias("agreements"))


def heads(reports: DataFrame) -> DataFrame:
    """doc, topic, from_day, to_day: what a report is about by its first heading, and the year of its byline (0 if none)."""
    topic = F.nullif(F.trim(F.regexp_extract("body", r"(?m)^# (.*)$", 1)), F.lit(""))
    year = F.coalesce(iso_year(F.regexp_extract("body", BYLINE, 0)), F.lit(0))
    return reports.select("doc", topic.alias("topic"), first_day_of_year(year).alias("from_day"), last_day_of_year(year).alias("to_day"))


def facts(reports: DataFrame) -> DataFrame:
    """subject, predicate, object, object_text, from_day, to_day, source, confidence_raw of all reports, each once.

    What a finding rests on is told by that source, as firmly as its provider; all else by the report.
    """
    about = heads(reports)
    on = rests_on(reports).where("not orphan").join(about, "doc")
    listed = sources(reports).withColumn("source", name_identifier(F.col("url"))).join(about, "doc")
    full, none, text = F.lit(65536), F.lit(None).cast("long"), F.lit(None).cast("string")
    subject, doc = name_identifier(F.col("finding")), name_identifier(F.col("doc"))

    def shape(rows, s, predicate, o, words, source, confidence):
        return rows.select(s.alias("subject"), F.lit(predicate).alias("predicate"), o.alias("object"), words.alias("object_text"), "from_day", "to_day", source.alias("source"), confidence.alias("confidence_raw"))

    return (
        shape(on, subject, STATED_IN, doc, text, doc, full)
        .unionByName(shape(on, subject, RESTS_ON, F.col("source"), text, F.col("source"), F.col("confidence_raw")))
        .unionByName(shape(on, subject, FINDING_TEXT, none, F.col("finding"), doc, full))
        .unionByName(shape(listed, F.col("source"), SOURCE_URL, none, F.col("url"), doc, full))
        .unionByName(shape(listed, F.col("source"), CITED_IN, doc, text, doc, full))
        .unionByName(shape(listed.where("reachable"), F.col("source"), REACHABLE, doc, text, doc, full))
        .unionByName(shape(about.where("topic is not null"), doc, RESEARCHES, none, F.col("topic"), doc, full))
        .distinct()
    )


def tally(reports: DataFrame) -> DataFrame:
    """One row: findings, orphans, sources, unreadable, reachable, dated."""
    told = rests_on(reports).agg(F.countDistinct("doc", "line").alias("findings"), F.count_if("orphan").alias("orphans"))
    listed = sources(reports).agg(F.count("*").alias("sources"), F.count_if(~F.col("readable")).alias("unreadable"), F.count_if("reachable").alias("reachable"))
    dated = reports.agg(F.count_if(F.col("body").rlike(BYLINE)).alias("dated"))
    return told.crossJoin(F.broadcast(listed)).crossJoin(F.broadcast(dated))
