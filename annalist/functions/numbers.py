"""Numbers in texts: years, signed integers, degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def read_year(text: Column) -> Column:
    """The first run of exactly four digits as an int, else 0."""
    found = F.regexp_extract(text, r"(?:^|[^0-9])([0-9]{4})(?:$|[^0-9])", 1)
    return F.coalesce(F.nullif(found, F.lit("")).cast("int"), F.lit(0))


def signed_int(text: Column) -> Column:
    """The leading signed integer of a text, null where there is none or it exceeds an int."""
    return F.nullif(F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1), F.lit("")).try_cast("int")


def degrees_to_raw(text: Column) -> Column:
    """A decimal number of degrees as a Q16.16 word, halves away from zero; null where it is none or beyond 400."""
    parts = r"^([+-]?)([0-9]{1,3})(?:\.([0-9]*))?$"
    whole = F.nullif(F.regexp_extract(text, parts, 2), F.lit("")).cast("long")
    billionths = F.rpad(F.substring(F.regexp_extract(text, parts, 3), 1, 9), 9, "0").cast("long")
    raw = whole * 65536 + F.floor((billionths * 65536 + 500000000) / F.lit(1000000000).cast("decimal(20,0)")).cast("long")
    return F.when(whole <= 400, F.when(F.regexp_extract(text, parts, 1) == "-", -raw).otherwise(raw))
