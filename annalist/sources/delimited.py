"""Delimited records: splitting them, telling the valid from the malformed, and typing the valid.

Structure (quoting, number of fields, relations between fields) is checked on each record. Values are not: each
distinct value of a column is judged once, the invalid ones with their reasons form a dictionary, and that is
joined back to the records. The dictionary is as large as the variety of bad values; the planner broadcasts it
where its size allows, else both sides are shuffled, and a hot value is split by the adaptive skew join.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions.numbers import degrees_to_raw, read_year
from annalist.operators.order import running
from annalist.storage import pick

#: A character that separates fields once quotes are taken off; where it stands in a text it becomes a blank.
UNIT = "\x1f"


def without_return(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\z", "")


def tab_fields(text: Column) -> Column:
    """The fields of a line, trailing empty ones included; quotes have no meaning."""
    return F.split(text, "\t", -1)


def quoted_fields(text: Column) -> Column:
    """The fields of a CSV record by RFC 4180, or null where the quoting is broken.

    Cut at each quote, the even pieces lie outside of quotes. An outer piece between two quotes is either empty,
    which is a doubled quote, or begins and ends with a comma; the first ends, the last begins with one.
    """
    def taken_apart(pieces: Column) -> Column:
        last = F.size(pieces) - 1

        def sound(piece: Column, i: Column) -> Column:
            opens = (i == 0) | piece.startswith(",")
            closes = (i == last) | piece.endswith(",")
            return (i % 2 == 1) | (piece == "") | (opens & closes)

        def plain(piece: Column, i: Column) -> Column:
            doubled = (piece == "") & (i > 0) & (i < last)
            return F.when(i % 2 == 1, piece).when(doubled, F.lit('"')).otherwise(F.translate(piece, ",", UNIT))

        broken = F.size(F.filter(pieces, lambda p, i: ~sound(p, i))) > 0
        return F.when((last % 2 == 0) & ~broken, F.split(F.array_join(F.transform(pieces, plain), ""), UNIT, -1))

    # Bound as the variable of a lambda, the pieces are cut once, not anew for each of them.
    return F.get(F.transform(F.array(F.split(F.translate(text, UNIT, " "), '"', -1)), taken_apart), F.lit(0))


def logical_records(lines: DataFrame, file: str, line: str, text: str) -> DataFrame:
    """file, record, text: the records of delimited files, in which a quoted field may hold line breaks.

    lines: file, number of the line from 0, its text. A record goes on while its quotes are open, that is while their
    number is odd; the sums that tell are prefix-combined over chunks, so a file of any length is spread. A record is
    numbered by its first line. An empty line outside of quotes is no record; quotes left open end with the file.
    """
    rows = pick(lines, file=file, line=line, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    quotes = F.length("text") - F.length(F.replace("text", F.lit('"'), F.lit("")))
    inside = running(rows, "file", "line", quotes, "before")
    opens = F.when(F.col("before") % 2 == 0, 1).otherwise(0)
    counted = running(inside.withColumn("opens", opens), "file", "line", F.col("opens"), "ahead").withColumn("nth", F.col("ahead") + F.col("opens"))
    held = counted.groupBy("file", "nth").agg(F.min("line").alias("record"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda r: r["text"]), "\n").alias("text"))
    return held.where("text not in ('', '\\r')").select("file", "record", "text")


def csv_fields(text: Column) -> Column:
    """quoted_fields() of a record after its carriage return is taken off."""
    return quoted_fields(without_return(text))


@dataclass(frozen=True)
class Feed:
    """What a feed promises: rules give a reason for an invalid value (else null), by column name."""

    name: str
    rules: dict[str, callable]
    pairs: list[tuple[str, callable]] = field(default_factory=list)


def integer_shape(value: Column) -> Column:
    return value.rlike(r"\A-?[0-9]+\z")


def _decimal_within(limit: int) -> callable:
    def rule(v: Column) -> Column:
        plain = v.rlike(r"\A[+-]?[0-9]+(\.[0-9]+)?\z")
        # 30 digits hold every number within bounds; longer whole parts are beyond them.
        size = F.abs(F.when(plain, v).try_cast("double"))
        return F.when((v != "") & ~plain, F.lit("no decimal number")).when((v != "") & (size > limit), F.lit("out of range"))

    return rule


def _integer_or_empty(v: Column) -> Column:
    return F.when((v != "") & ~integer_shape(v), F.lit("no integer"))


HOLDINGS = Feed(
    "holdings",
    {
        "identifier": lambda v: F.when(v == "", F.lit("empty")),
        "access": lambda v: F.when(~v.isin("allow", "deny"), F.lit("neither allow nor deny")),
        "year": lambda v: F.when((v != "") & ~v.rlike(r"(^|[^0-9])[0-9]{4}($|[^0-9])"), F.lit("no year of four digits")),
        "language": lambda v: F.when((v != "") & ~v.rlike(r"\A[a-z]{3}\z"), F.lit("no code of three letters")),
    },
)
#: The places of the columns that are read in a line of 26 fields.
HOLDINGS_WIDTH = 26
HOLDINGS_COLUMNS = {"identifier": 0, "access": 1, "rights": 2, "oclc": 7, "title": 11, "year": 16, "language": 18, "author": 25}

GAZETTEER = Feed(
    "gazetteer",
    {
        "id": lambda v: F.when(~v.rlike(r"\A[0-9]*[1-9][0-9]*\z"), F.lit("no positive integer")),
        "reprLat": _decimal_within(90),
        "reprLong": _decimal_within(180),
        "minDate": _integer_or_empty,
        "maxDate": _integer_or_empty,
    },
    [("minDate > maxDate", lambda get: F.when(integer_shape(get("minDate")) & integer_shape(get("maxDate")), get("minDate").try_cast("decimal(38,0)") > get("maxDate").try_cast("decimal(38,0)")))],
)
GAZETTEER_COLUMNS = ("id", "title", "featureTypes", "reprLat", "reprLong", "minDate", "maxDate", "locationPrecision", "connectsWith")


def holdings_records(raw: DataFrame, record: str = "record_no", text: str = "record_text") -> DataFrame:
    """record, broken, and the columns that are read of each holdings line; broken: the structural reason, or null.

    A null or empty line is skipped. Blanks around a field are taken off. Further columns are ignored.
    """
    line = pick(raw, record=record, text=text).withColumn("text", without_return(F.coalesce("text", F.lit("")))).where("text <> ''")
    split = line.withColumn("f", tab_fields(F.col("text")))
    fits = F.size("f") == HOLDINGS_WIDTH
    return split.select(
        "record",
        F.when(~fits, F.concat(F.size("f").cast("string"), F.lit(" fields instead of 26"))).alias("broken"),
        *[F.when(fits, F.trim(F.get("f", F.lit(i)))).alias(n) for n, i in HOLDINGS_COLUMNS.items()],
    )


def gazetteer_records(raw: DataFrame, record: str = "record_no", header: str = "header_text", text: str = "record_text") -> DataFrame:
    """record, broken, and the columns that are read of each gazetteer record, found by the header of its file.

    A null or empty record is skipped. A record whose header lacks a needed column is broken.
    """
    rows = pick(raw, record=record, header=header, text=text).withColumn("text", without_return(F.coalesce("text", F.lit("")))).where("text <> ''")
    split = rows.select("record", quoted_fields(F.col("text")).alias("f"), F.coalesce(csv_fields(F.coalesce("header", F.lit(""))), F.array()).alias("h"))
    missing = [n for n in GAZETTEER.rules]
    reason = (
        F.when(F.size(F.array_except(F.array(*[F.lit(n) for n in missing]), "h")) > 0, F.lit("the header lacks a column"))
        .when(F.col("f").isNull(), F.lit("broken quoting"))
        .when(F.size("f") != F.size("h"), F.concat(F.size("f").cast("string"), F.lit(" fields instead of "), F.size("h").cast("string")))
    )
    split = split.withColumn("broken", reason)
    return split.select("record", "broken", *[F.when(F.col("broken").isNull(), F.get("f", F.array_position("h", n).cast("int") - 1)).alias(n) for n in GAZETTEER_COLUMNS])


def rejects(records: DataFrame, feed: Feed) -> DataFrame:
    """record, reasons: each malformed record with every reason against it."""
    structural = records.where("broken is not null").select("record", F.col("broken").alias("reason"))
    sound = records.where("broken is null")
    across = [
        sound.where(broken(lambda n: F.col(n))).select("record", F.lit(reason).alias("reason")) for reason, broken in feed.pairs
    ]
    values = sound.select("record", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in feed.rules])).alias("v")).select("record", "v.column", "v.value")
    why = F.coalesce(*[F.when(F.col("column") == c, rule(F.col("value"))) for c, rule in feed.rules.items()])
    invalid = values.select("column", "value").distinct().withColumn("why", why).where("why is not null")
    by_value = values.join(invalid, ["column", "value"]).select("record", F.concat_ws(": ", "column", "why").alias("reason"))
    every = structural.unionByName(by_value)
    for more in across:
        every = every.unionByName(more)
    return every.groupBy("record").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def holdings_valid(records: DataFrame) -> DataFrame:
    """The valid holdings as typed catalogue rows; oclc is the list of its numbers, each prefixed."""
    good = records.join(rejects(records, HOLDINGS).select("record"), "record", "left_anti")
    numbers = F.filter(F.transform(F.split("oclc", ","), lambda k: F.trim(k)), lambda k: k != "")
    return good.select(
        "record",
        "identifier",
        "access",
        "rights",
        F.nullif("title", F.lit("")).alias("title"),
        F.nullif("author", F.lit("")).alias("creator"),
        read_year(F.col("year")).alias("year"),
        F.nullif("language", F.lit("")).alias("language"),
        F.transform(numbers, lambda k: F.concat(F.lit("oclc:"), k)).alias("keys"),
    )


def gazetteer_valid(records: DataFrame) -> DataFrame:
    """The valid gazetteer records as typed rows; degrees as Q16.16 words."""
    good = records.join(rejects(records, GAZETTEER).select("record"), "record", "left_anti")
    connected = F.filter(F.transform(F.split("connectsWith", ","), lambda k: F.trim(k)), lambda k: k.rlike(r"\A[0-9]+\z"))
    return good.select(
        "record",
        F.col("id").try_cast("long").alias("place"),
        F.nullif("title", F.lit("")).alias("title"),
        degrees_to_raw(F.col("reprLat")).alias("lat_raw"),
        degrees_to_raw(F.col("reprLong")).alias("lon_raw"),
        F.nullif("minDate", F.lit("")).try_cast("int").alias("min_year"),
        F.nullif("maxDate", F.lit("")).try_cast("int").alias("max_year"),
        (F.col("locationPrecision") == "precise").alias("precise"),
        F.transform(connected, lambda k: k.try_cast("long")).alias("connects"),
    )
