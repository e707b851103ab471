"""Queries of the general problems: intervals, malformed records, changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.operators.intervals import MergedIntervals
from annalist.operators.patches import current_state, iso_instant
from annalist.sources import delimited
from annalist.storage import Workspace, table


def _merged(spark: SparkSession, sf_dir: str) -> MergedIntervals:
    facts = table(spark, sf_dir, "facts").select("subject", "from_day", "to_day").where("not (from_day = 0 and to_day = 0)")
    return MergedIntervals(facts, "subject", "from_day", "to_day")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).gaps().withColumnRenamed("key", "subject")


def p1_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).periods().withColumnRenamed("key", "subject")


def _records(spark: SparkSession, sf_dir: str) -> list[tuple[delimited.Feed, DataFrame]]:
    """The records taken apart once, for the checks and the join back read them several times."""
    space = Workspace(spark, "delimited")
    return [
        (delimited.HOLDINGS, space.write(delimited.holdings_records(table(spark, sf_dir, "holdings_raw")), "holdings")),
        (delimited.GAZETTEER, space.write(delimited.gazetteer_records(table(spark, sf_dir, "gazetteer_raw")), "gazetteer")),
    ]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [delimited.rejects(r, feed).select(F.lit(feed.name).alias("feed"), F.col("record").alias("record_no")) for feed, r in _records(spark, sf_dir)]
    return found[0].unionByName(found[1])


def p2_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = delimited.holdings_valid(_records(spark, sf_dir)[0][1])
    return valid.select(F.col("record").alias("record_no"), "identifier", "title", "creator", "year", "language", F.concat_ws(",", "keys").alias("keys"))


def p2_gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = delimited.gazetteer_valid(_records(spark, sf_dir)[1][1])
    return valid.select(F.col("record").alias("record_no"), "place", "title", "min_year", "max_year", "precise")


def _state(spark: SparkSession, sf_dir: str, payload: list[str]) -> DataFrame:
    return current_state(table(spark, sf_dir, "oai_records"), "oai_identifier", "datestamp", "feed_seq", "deleted", payload, read=iso_instant)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(spark, sf_dir, ["feed_seq"])


def p6_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(spark, sf_dir, ["feed_seq", "title", "creator", "date_text", "lang_code"])


QUERIES = {f.__name__: f for f in (p1_found, p1_periods, p2_found, p2_holdings, p2_gazetteer, p6_found, p6_state)}

_RUNS = """with t as (select subject, from_day::bigint f, to_day::bigint t from facts
  where subject is not null and from_day is not null and to_day >= from_day and not (from_day = 0 and to_day = 0)),
 r as (select subject, f, t, max(t) over (partition by subject order by f, t rows between unbounded preceding and 1 preceding) before from t)"""
_HOLDINGS = """with l as (select record_no, regexp_replace(coalesce(record_text, ''), '\\r$', '') r from holdings_raw),
 h as (select record_no, string_split(r, chr(9)) f from l where r <> ''),
 s as (select record_no, len(f) n, trim(f[1], ' ') identifier, trim(f[2], ' ') access, trim(f[8], ' ') oclc, trim(f[12], ' ') title, trim(f[17], ' ') y, trim(f[19], ' ') l, trim(f[26], ' ') creator from h),
 b as (select *, n <> 26 or identifier = '' or access not in ('allow', 'deny') or (y <> '' and not regexp_matches(y, '(^|[^0-9])[0-9]{4}($|[^0-9])')) or (l <> '' and not regexp_full_match(l, '[a-z]{3}')) bad from s)"""
_FIELDS = """list_transform(regexp_extract_all(',' || {0}, ',("(?:[^"]|"")*"|[^",]*)', 1), lambda x: case when x[1] = '"' then replace(x[2:len(x)-1], '""', '"') else x end)"""
_GAZETTEER = f"""with l as (select record_no, header_text h, regexp_replace(coalesce(record_text, ''), '\\r$', '') r from gazetteer_raw),
 q as (select record_no, r, regexp_full_match(r, '(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*') sound, {_FIELDS.format('r')} f, {_FIELDS.format('h')} c from l where r <> ''),
 g as (select record_no, sound and len(f) = len(c) ok, f[list_position(c, 'id')] id, f[list_position(c, 'title')] title, f[list_position(c, 'reprLat')] la, f[list_position(c, 'reprLong')] lo, f[list_position(c, 'minDate')] mi, f[list_position(c, 'maxDate')] ma, f[list_position(c, 'locationPrecision')] lp from q),
 b as (select *, not ok or not regexp_full_match(id, '[0-9]*[1-9][0-9]*') or (la <> '' and (not regexp_full_match(la, '[+-]?[0-9]+([.][0-9]+)?') or abs(try_cast(la as double)) > 90))
  or (lo <> '' and (not regexp_full_match(lo, '[+-]?[0-9]+([.][0-9]+)?') or abs(try_cast(lo as double)) > 180)) or (mi <> '' and not regexp_full_match(mi, '-?[0-9]+')) or (ma <> '' and not regexp_full_match(ma, '-?[0-9]+'))
  or coalesce(try_cast(mi as bigint) > try_cast(ma as bigint), false) bad from g)"""
_FEED = r"""with c as (select *, coalesce(try_cast(datestamp as timestamptz), try_cast(replace(datestamp, 'Z', ':00Z') as timestamptz)) instant from oai_records where regexp_matches(datestamp, '^[0-9]{4}-[0-9]{2}-[0-9]{2}')),
 o as (select *, row_number() over (partition by oai_identifier order by case when length(datestamp) = 10 then (datestamp || 'T00:00:00Z')::timestamptz else instant end desc, feed_seq desc) n from c where instant is not null and oai_identifier is not null)"""

ORACLE = {
    "p1_found": f"{_RUNS} select subject, before + 1 as gap_from, f - 1 as gap_to from r where f > before + 1",
    "p1_periods": f"""{_RUNS}, i as (select *, sum(case when before is null or f > before + 1 then 1 else 0 end) over (partition by subject order by f, t rows unbounded preceding) n from r)
 select subject, min(f) as period_from, max(t) as period_to from i group by subject, n""",
    "p2_found": f"select 'holdings' as feed, record_no from ({_HOLDINGS} select record_no from b where bad) union all select 'gazetteer' as feed, record_no from ({_GAZETTEER} select record_no from b where bad)",
    "p2_holdings": f"""{_HOLDINGS} select record_no, identifier, nullif(title, '') as title, nullif(creator, '') as creator, coalesce(try_cast(nullif(regexp_extract(y, '(?:^|[^0-9])([0-9]{{4}})(?:$|[^0-9])', 1), '') as integer), 0) as year, nullif(l, '') as language,
 array_to_string(list_transform(list_filter(list_transform(string_split(oclc, ','), lambda k: trim(k)), lambda k: k <> ''), lambda k: 'oclc:' || k), ',') as keys from b where not bad""",
    "p2_gazetteer": f"{_GAZETTEER} select record_no, id::bigint as place, nullif(title, '') as title, try_cast(nullif(mi, '') as integer) as min_year, try_cast(nullif(ma, '') as integer) as max_year, lp = 'precise' as precise from b where not bad",
    "p6_found": f"{_FEED} select oai_identifier, feed_seq from o where n = 1 and not coalesce(deleted, false)",
    "p6_state": f"{_FEED} select oai_identifier, feed_seq, title, creator, date_text, lang_code from o where n = 1 and not coalesce(deleted, false)",
}
