"""The state of a table after a feed of inserts, updates and deletes.

Each change is a patch: a function from a row (or none) to a row (or none). Patches compose, and composition is
associative, so a feed is reduced as a tree: the changes are range-partitioned by key and number, the patches of
each range are composed where they lie, and the few left for each key are composed with each other.
A key with any share of the feed leaves one composed patch for each range. The result is applied to the base.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.storage import pick

#: The ISO 8601 shapes that are read. Date, time of day, fraction, zone.
ISO_INSTANT = r"^(\d{4})(?:-(\d{2})(?:-(\d{2})(?:T(\d{2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9})\d*)?)?(Z|[+-]\d{2}(?::?\d{2})?)?)?)?)?$"


def iso_instant(text: Column) -> Column:
    """struct(seconds, nanos) since 1970-01-01T00:00Z of an ISO 8601 date or date-time; null if it is none.

    Parts left out are their first value, a missing zone is UTC; 24:00, second 60 and days a month lacks are no
    real time. Digits of the fraction after the ninth are cut.
    """
    trimmed = F.trim(text)
    groups = F.struct(*[F.regexp_extract(trimmed, ISO_INSTANT, i).alias(f"g{i}") for i in range(1, 9)])

    def read(g: Column) -> Column:
        def number(i: int) -> Column:
            return F.coalesce(F.nullif(g[f"g{i}"], F.lit("")).cast("int"), F.lit(0))

        def part(i: int) -> Column:
            return F.when(g[f"g{i}"] == "", "01").otherwise(g[f"g{i}"])

        date = F.unix_date(F.concat_ws("-", g["g1"], part(2), part(3)).try_cast("date"))
        zone = g["g8"]
        minutes = F.when(F.length(zone) > 3, F.substring(zone, -2, 2).try_cast("int")).otherwise(0)
        ahead = F.when((zone == "") | (zone == "Z"), 0).otherwise(F.when(zone.startswith("-"), -1).otherwise(1) * (F.substring(zone, 2, 2).try_cast("int") * 60 + minutes))
        real = date.isNotNull() & (number(4) < 24) & (number(5) < 60) & (number(6) < 60) & (F.abs(ahead) < 24 * 60)
        seconds = date.cast("long") * 86400 + number(4) * 3600 + number(5) * 60 + number(6) - ahead * 60
        nanos = F.rpad(F.when(g["g7"] == "", "0").otherwise(g["g7"]), 9, "0").cast("int")
        return F.when((g["g1"] != "") & real, F.struct(seconds.alias("seconds"), nanos.alias("nanos")))

    # Bound as the variable of a lambda, the groups are taken once and the expression stays small.
    return F.get(F.transform(F.array(groups), read), F.lit(0))


def compose(changes: DataFrame, key: str, instant: str, number: str, deleted: str, payload: list[str], partial: bool = False, read: Callable[[Column], Column] | None = None) -> DataFrame:
    """One composed patch for each key: key, deleted, and the payload.

    The changes of a key follow `instant` (any orderable column, struct included; or what `read` makes of it, once
    for each change), those of the same instant follow `number`. A change with a null key or instant is not applied; a null `deleted` means not deleted; a null
    number comes before all others. Repeated changes change nothing; of changes that agree in instant and number
    the greatest payload counts, so that the result is the same in every run. partial=False: a change replaces
    the whole row. partial=True: it sets only the columns that are not null, on what the changes before it left
    since the last deletion. Other columns of `changes` are ignored.
    """
    names = {f"v{i}": c for i, c in enumerate(payload)}
    patch = pick(changes, key=key, instant=instant, number=number, deleted=deleted, **names).where("key is not null and instant is not null")
    patch = patch.select("key", "instant", "number", F.coalesce("deleted", F.lit(False)).alias("deleted"), *names)
    ordered = patch.repartitionByRange("key", "number").withColumn("chunk", F.spark_partition_id())
    if read is not None:
        # Behind the exchange, as the bounds of its ranges are drawn from a second scan of what is before it.
        ordered = ordered.withColumn("instant", read(F.col("instant"))).where("instant is not null")
    when = F.struct("instant", "number")
    if not partial:
        steps = [F.struct(when.alias("at"), "deleted", *names).alias("patch")]
        merge = [F.max("patch").alias("patch")]
        final = ["key", "patch.deleted", *[F.col(f"patch.{v}").alias(c) for v, c in names.items()]]
    else:
        live = ~F.col("deleted")
        steps = [
            when.alias("last"),
            F.when(F.col("deleted"), when).alias("reset"),
            *[F.when(live & F.col(v).isNotNull(), F.struct(when.alias("at"), F.col(v).alias("value"))).alias(v) for v in names],
        ]
        merge = [F.max(c).alias(c) for c in ("last", "reset", *names)]
        gone = F.coalesce(F.col("reset") == F.col("last"), F.lit(False))
        final = ["key", gone.alias("deleted"), *[F.when(~gone & (F.col("reset").isNull() | (F.col(f"{v}.at") > F.col("reset"))), F.col(f"{v}.value")).alias(c) for v, c in names.items()]]
    composed = ordered.select("key", "chunk", *steps)
    for level in (["key", "chunk"], ["key"]):
        composed = composed.groupBy(*level).agg(*merge)
    return composed.select(*final).withColumnRenamed("key", key)


def apply_to(base: DataFrame, patches: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """The rows of `base` (one for each key) after the patches of compose(): key and payload.

    Rows no patch names stay as they are; a deletion of a key that the base lacks does nothing.
    """
    old = pick(base, key=key, **{f"b{i}": c for i, c in enumerate(payload)})
    new = pick(patches, key=key, deleted="deleted", **{f"v{i}": c for i, c in enumerate(payload)}).withColumn("hit", F.lit(True))
    joined = old.join(new, "key", "full").where("deleted is null or not deleted")
    return joined.select(F.col("key").alias(key), *[F.when(F.col("hit"), F.col(f"v{i}")).otherwise(F.col(f"b{i}")).alias(c) for i, c in enumerate(payload)])


def current_state(changes: DataFrame, key: str, instant: str, number: str, deleted: str, payload: list[str], base: DataFrame | None = None, partial: bool = False, read: Callable[[Column], Column] | None = None) -> DataFrame:
    """The table as it stands after all changes, from nothing or from `base`: key and payload."""
    patches = compose(changes, key, instant, number, deleted, payload, partial, read)
    if base is not None:
        return apply_to(base, patches, key, payload)
    return patches.where(~F.col("deleted")).select(key, *payload)
