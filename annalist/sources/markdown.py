"""Markdown corpora: where identifiers are defined and cited, footnotes included."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions.dates import first_day_of_year, iso_year, last_day_of_year
from annalist.functions.texts import FULL, IDENTIFIER, footnote_name, name_identifier

#: The predicates of the facts.
DEFINED_IN, CITED_IN, DEFINITION_TEXT = 1001, 1002, 1003
NOTE = r"\[\^([0-9]{1,6})\]"


def lines(documents: DataFrame) -> DataFrame:
    """doc, line, text, heading, chapter, year of all lines outside of fences. documents: doc (ordered), body.

    The state of a line is a running sum over its document; a document is the unit of order, so its lines are one
    window, and the documents are spread.
    """
    each = documents.select("doc", F.posexplode(F.split("body", "\r?\n", -1)).alias("line", "text")).withColumn("line", F.col("line") + 1)
    run = Window.partitionBy("doc").orderBy("line")
    fence = F.ltrim("text").startswith("```")
    marked = each.withColumn("fences", F.sum(F.when(fence, 1).otherwise(0)).over(run)).where(~fence & (F.col("fences") % 2 == 0))
    title, chapter = F.col("text").rlike("^#{1,6} "), F.col("text").rlike("^#{1,2} ")
    marked = marked.withColumn("is_heading", title).withColumn("heading", F.sum(F.when(title, 1).otherwise(0)).over(run)).withColumn("chapter", F.sum(F.when(chapter, 1).otherwise(0)).over(run))
    # An undated heading takes the year back.
    section = Window.partitionBy("doc", "heading").orderBy("line")
    return marked.withColumn("year", F.coalesce(F.first(F.when(F.col("is_heading"), iso_year(F.col("text")))).over(section), F.lit(0))).drop("fences")


def references(scanned: DataFrame) -> DataFrame:
    """doc, line, heading, year, name, role of all identifiers and footnotes.

    role: definition, citation, note (a footnote's definition; the line is read no further) or note citation.
    """
    note = F.regexp_extract("text", r"^\s*\[\^([0-9]{1,6})\]:", 1)
    base = scanned.withColumn("note", note)
    keep = ["doc", "line", "heading", "year", "text"]
    notes = base.where("note <> ''").select(*keep, footnote_name(F.col("doc"), F.col("chapter"), F.col("note")).alias("name"), F.lit("note").alias("role"))
    rest = base.where("note = ''")
    cited = rest.select(*keep, "chapter", F.explode(F.regexp_extract_all("text", F.lit(NOTE), 1)).alias("n")).select(*keep, footnote_name(F.col("doc"), F.col("chapter"), F.col("n")).alias("name"), F.lit("note citation").alias("role"))
    first_cell = F.regexp_extract("text", r"^[ \t]*\|[^A-Z0-9-]{0,2}([A-Z0-9-]+)", 1)
    tokens = rest.select(*keep, first_cell.alias("cell"), F.posexplode(F.regexp_extract_all("text", F.lit("[A-Z0-9-]+"), 0)).alias("k", "name")).where(F.col("name").rlike(IDENTIFIER))
    found = tokens.select(*keep, "name", F.when((F.col("k") == 0) & (F.col("cell") == F.col("name")), "definition").otherwise("citation").alias("role"))
    return found.unionByName(notes).unionByName(cited)


def resolve(found: DataFrame) -> DataFrame:
    """The references with their outcome: defined, duplicate, resolved, dangling, noise.

    The first definition in the order of documents and lines stands. An identifier no row defines is dangling if
    its scheme is known, else noise; a footnote is noise in a document that defines none.
    """
    order = F.struct("doc", "line")
    homes = found.where("role in ('definition', 'note')").groupBy("name").agg(F.min(order).alias("home"))
    schemes = homes.where(~F.col("name").contains("[^")).select(F.substring_index("name", "-", 1).alias("scheme")).distinct().withColumn("known", F.lit(True))
    users = found.where("role = 'note'").select("doc").distinct().withColumn("notes", F.lit(True))
    joined = found.withColumn("scheme", F.substring_index("name", "-", 1)).join(homes, "name", "left").join(schemes, "scheme", "left").join(users, "doc", "left")
    defining = F.col("role").isin("definition", "note")
    outcome = (
        F.when(defining & (F.col("home") == F.struct("doc", "line")), "defined").when(defining, "duplicate")
        .when((F.col("role") == "note citation") & F.col("notes").isNull(), "noise").when(F.col("home").isNotNull(), "resolved")
        .when((F.col("role") == "note citation") | F.col("known"), "dangling").otherwise("noise")
    )
    return joined.withColumn("outcome", outcome).select("doc", "line", "heading", "year", "text", "name", "role", "outcome")


def facts(resolved: DataFrame) -> DataFrame:
    """The facts of a corpus; dangling and noise are never written."""
    subject, source = name_identifier(F.col("name")), name_identifier(F.col("doc"))
    placed = resolved.withColumn("subject", subject).withColumn("source", source)
    year = F.col("year")
    made = placed.where("outcome = 'defined'")
    out = ["subject", "predicate", "object", "object_text", "from_day", "to_day", "source", "heading", "line", "confidence_raw"]

    def shape(rows: DataFrame, predicate: int, text, first, last) -> DataFrame:
        object_ = F.lit(None).cast("long") if text is not None else F.col("source")
        return rows.select("subject", F.lit(predicate).alias("predicate"), object_.alias("object"), (text if text is not None else F.lit(None).cast("string")).alias("object_text"), first.alias("from_day"), last.alias("to_day"), "source", "heading", "line", F.lit(FULL).alias("confidence_raw")).select(*out)

    zero = F.lit(0).cast("long")
    return (
        shape(made, DEFINED_IN, None, first_day_of_year(year), last_day_of_year(year))
        .unionByName(shape(made, DEFINITION_TEXT, F.col("text"), first_day_of_year(year), last_day_of_year(year)))
        .unionByName(shape(placed.where("outcome = 'resolved'"), CITED_IN, None, zero, zero))
    )


def report(documents: DataFrame, scanned: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row of tallies, with the first offender of each kind."""
    role, outcome = F.col("role"), F.col("outcome")
    at = F.struct("doc", "line", "name")
    tallied = resolved.agg(
        F.count_if((role == "definition") & (outcome == "defined")).alias("definitions"), F.count_if(role == "citation").alias("citations"),
        F.count_if((role == "citation") & (outcome == "dangling")).alias("dangling"), F.count_if((role == "citation") & (outcome == "noise")).alias("unknown_scheme"),
        F.count_if(outcome == "duplicate").alias("duplicates"), F.count_if((role == "note") & (outcome == "defined")).alias("footnotes"),
        F.count_if((role == "note citation") & (outcome != "noise")).alias("footnote_citations"), F.count_if((role == "note citation") & (outcome == "dangling")).alias("dangling_footnotes"),
        F.count_if((role == "note citation") & (outcome == "noise")).alias("footnote_noise"),
        F.min_by(F.when(outcome == "dangling", F.col("name")), F.when(outcome == "dangling", at)).alias("first_dangling"), F.min_by(F.when(outcome == "duplicate", F.col("name")), F.when(outcome == "duplicate", at)).alias("first_duplicate"),
    )
    seen = scanned.agg(F.count("*").alias("lines"), F.count_if("is_heading").alias("headings"), F.count_if(F.col("is_heading") & (F.col("year") != 0)).alias("dated"))
    return tallied.crossJoin(F.broadcast(seen)).crossJoin(F.broadcast(documents.agg(F.count("*").alias("documents"))))


def definitions(resolved: DataFrame) -> DataFrame:
    """name, defined_in, text, citations, documents: each name with its definition, how often and in how many documents it is cited."""
    homes = resolved.where("outcome = 'defined'").select("name", F.col("doc").alias("defined_in"), F.col("text"))
    cited = resolved.where("outcome = 'resolved'").groupBy("name", "doc").agg(F.count("*").alias("n")).groupBy("name").agg(F.sum("n").alias("citations"), F.count("*").alias("documents"))
    return homes.join(cited, "name", "left").na.fill(0, ["citations", "documents"])
