"""Days, years and windows of dates. Days count from 1970-01-01, proleptic Gregorian, with a year 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CYCLE_YEARS, CYCLE_DAYS = 400, 146097
EPOCH = 719468  # days from 0000-03-01 to 1970-01-01


def day_of_date(year: Column, month: Column, day: Column) -> Column:
    """The day number of a civil date, for any year: the calendar repeats every 400 years."""
    near = F.pmod(year, F.lit(CYCLE_YEARS)) + 2000
    return F.unix_date(F.make_date(near, month, day)).cast("long") + ((year - near) / CYCLE_YEARS).cast("long") * CYCLE_DAYS


def year_of_day(day: Column) -> Column:
    z = day.cast("long") + EPOCH
    era = F.floor(z / CYCLE_DAYS)
    doe = z - era * CYCLE_DAYS
    yoe = F.floor((doe - F.floor(doe / 1460) + F.floor(doe / 36524) - F.floor(doe / 146096)) / 365)
    doy = doe - (365 * yoe + F.floor(yoe / 4) - F.floor(yoe / 100))
    return (yoe + era * CYCLE_YEARS + F.when(F.floor((5 * doy + 2) / 153) >= 10, 1).otherwise(0)).cast("int")


def first_day_of_year(year: Column) -> Column:
    return day_of_date(year, F.lit(1), F.lit(1))


def last_day_of_year(year: Column) -> Column:
    return day_of_date(year, F.lit(12), F.lit(31))


TEI_DATE = r"^(-?[0-9]{1,6})(?:-([0-9]{2})(?:-([0-9]{2}))?)?"


def tei_window(text: Column) -> Column:
    """struct(from_day, to_day) of a year, a month or a day; a month that is none leaves the year, a day the month."""
    def read(g: Column) -> Column:
        year, month, day = (g[c] for c in ("y", "m", "d"))
        start = day_of_date(year, F.coalesce(month, F.lit(1)), F.lit(1))
        leap = F.when((F.pmod(year, F.lit(4)) == 0) & ((F.pmod(year, F.lit(100)) != 0) | (F.pmod(year, F.lit(400)) == 0)), 1).otherwise(0)
        length = F.when(month.isNull(), leap + 365).when(month == 2, leap + 28).otherwise(F.lit(31) - ((month - 1) % 7) % 2)
        exact = F.when(month.isNotNull() & day.between(1, length), start + day - 1)
        return F.when(year.isNotNull(), F.struct(F.coalesce(exact, start).alias("from_day"), F.coalesce(exact, start + length - 1).alias("to_day")))

    number = lambda i: F.nullif(F.regexp_extract(text, TEI_DATE, i), F.lit("")).try_cast("int")
    month = F.filter(F.array(number(2)), lambda m: m.between(1, 12))
    # Bound as the variable of a lambda, the parts are taken once.
    parts = F.struct(number(1).alias("y"), F.get(month, F.lit(0)).alias("m"), number(3).alias("d"))
    return F.get(F.transform(F.array(parts), read), F.lit(0))


def iso_year(text: Column) -> Column:
    """The year of the first YYYY-MM-DD that stands alone, else null."""
    return F.nullif(F.regexp_extract(text, r"(?:^|[^0-9])([0-9]{4})-[0-9]{2}-[0-9]{2}(?:$|[^0-9])", 1), F.lit("")).cast("int")


def tile_corner(name: Column) -> Column:
    """struct(latitude, longitude) of a tile named like N37E023."""
    shape = r"([NSns])([0-9]{2})([EWew])([0-9]{3})"
    group = lambda i: F.regexp_extract(name, shape, i)
    lat = group(2).try_cast("int") * F.when(F.upper(group(1)) == "S", -1).otherwise(1)
    lon = group(4).try_cast("int") * F.when(F.upper(group(3)) == "W", -1).otherwise(1)
    return F.when(name.rlike(shape), F.struct(lat.alias("latitude"), lon.alias("longitude")))
