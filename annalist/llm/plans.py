"""Queries of the problems of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm.groups import link_groups, representatives
from annalist.llm.match import matches
from annalist.llm.mixing import Mixture
from annalist.llm.names import variant_pairs
from annalist.llm import prose
from annalist.llm.packing import filling, pack, sized
from annalist.llm.prose import quality
from annalist.llm.tokens import token_count
from annalist.storage import Workspace, table


def _year(day: str):
    """The year of a day since 1970-01-01; 0 is an unknown day."""
    return F.floor(F.lit(1970) + F.nullif(F.col(day), F.lit(0)) / F.lit(365.2425)).cast("int")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    authors = table(spark, sf_dir, "author_windows").select(F.col("author_id").alias("id"), F.col("author_name").alias("name"), _year("from_day").alias("from_year"), _year("to_day").alias("to_year"))
    works = table(spark, sf_dir, "catalogue").select(F.col("entry_id").alias("id"), F.col("creator").alias("name"), F.nullif("year_from", F.lit(0)).alias("year"))
    return variant_pairs(authors, works).select("id_a", "id_b").distinct()


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = lambda c: F.nullif(F.col(c), F.lit(0))
    rows = table(spark, sf_dir, "catalogue").select(F.col("entry_id").alias("id"), "title", "creator", "holder", known("year_from").alias("year"), known("lang_tag").alias("language"))
    return matches(rows).toDF("entry_id_a", "entry_id_b", "confidence")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir).select("entry_id_a", "entry_id_b")


def p4_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir)


def _linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "candidates").where("evidence = 1").select("left_id", "right_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = link_groups(_linking(spark, sf_dir), "left_id", "right_id", table(spark, sf_dir, "mentions"), "mention_id")
    return groups.toDF("mention_id", "representative")


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = representatives(table(spark, sf_dir, "mentions"), "mention_id", _linking(spark, sf_dir), "left_id", "right_id")
    return every.toDF("mention_id", "representative")


def _bins(spark: SparkSession, sf_dir: str) -> list[tuple[str, int]]:
    """The kinds of containers, a parameter of a few rows."""
    return [(r.bin_name, r.capacity_tokens) for r in table(spark, sf_dir, "pack_bins").collect()]


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    largest = max(_bins(spark, sf_dir), key=lambda b: b[1])
    sizes = sized(table(spark, sf_dir, "documents"), "doc_id", token_count)
    placed = pack(sizes, "id", "tokens", [largest])
    return placed.where("pieces > 1 and piece = 0").select(F.col("item").alias("doc_id"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = sized(table(spark, sf_dir, "documents"), "doc_id", token_count)
    placed = pack(sizes, "id", "tokens", _bins(spark, sf_dir))
    return placed.select("bin_name", "container", F.col("item").alias("doc_id"), "piece", "begin", F.col("size").alias("tokens"))


def p7_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = sized(table(spark, sf_dir, "documents"), "doc_id", token_count)
    bins = _bins(spark, sf_dir)
    return filling(pack(sizes, "id", "tokens", bins), bins)


def _mixture(spark: SparkSession, sf_dir: str) -> Mixture:
    sizes = sized(table(spark, sf_dir, "documents"), "doc_id", token_count, Workspace(spark, "sizes"), source="source")
    return Mixture(sizes, "id", "source", "tokens", table(spark, sf_dir, "mix_targets"), "doc_source", "target_share", "max_repeats")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).report().where("short").select(F.col("source").alias("doc_source"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).report().withColumnRenamed("source", "doc_source")


def p8_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).used().select(F.col("source").alias("doc_source"), F.col("id").alias("doc_id"), "repeats", "tokens")


def _quality(spark: SparkSession, sf_dir: str, *rules: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), "doc_id", "text", rules).withColumnRenamed("id", "doc_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality(spark, sf_dir, "sentences").where(F.size("sentences") > 0).select("doc_id")


def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality(spark, sf_dir, "published", "sentences").withColumn("reasons", F.concat_ws("; ", "sentences")).drop("sentences", "published")


def p9_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict by the published rules for web pages, one row for each document."""
    return _quality(spark, sf_dir, "published").select("doc_id", "tokens", "stop_words", F.concat_ws("; ", "published").alias("reasons"))


QUERIES = {f.__name__: f for f in (p3_found, p4_found, p4_matches, p5_found, p5_groups, p7_found, p7_containers, p7_filling, p8_found, p8_report, p8_used, p9_found, p9_statistics, p9_published)}

_REACH = """with recursive e as (select distinct left_id a, right_id b from candidates where evidence = 1 and left_id <> right_id and left_id in (select mention_id from mentions) and right_id in (select mention_id from mentions)),
 u as (select a, b from e union select b, a from e),
 reach(a, b) as (select a, b from u union select r.a, u.b from reach r join u on r.b = u.a)"""
_SIZES = "octet_length(encode(coalesce(text, '')))"
_STATISTICS = rf"""with t as (select doc_id, coalesce(text, '') x from documents),
 p as (select doc_id, x, regexp_replace(x, '\p{{M}}+', '', 'g') q from t),
 s as (select doc_id, x, q, regexp_replace(q, '[\s\p{{Z}}\x{{FEFF}}]+', '', 'g') solid from p),
 w as (select doc_id, unnest(regexp_extract_all(lower(q), '\p{{L}}+')) w from p),
 v as (select doc_id, length(w) n, translate(w, '{prose._ACCENTED}', '{prose._PLAIN}') w from w),
 l as (select doc_id, unnest(regexp_split_to_array(x, '[\r\n]+')) l from t),
 tk as (select doc_id, unnest(list_filter(regexp_split_to_array(x, '[\s\p{{Z}}]+'), lambda y: y <> '')) k from t),
 ws as (select doc_id, count(*) words, sum(n) letters, {", ".join(f"count(*) filter (w in ({', '.join(repr(x) for x in sorted(set(words.split())))})) n_{code}" for code, words in prose.COMMON.items())},
  count(distinct w) filter (w in ({', '.join(repr(x) for x in prose.STOP_WORDS)})) stops from v group by doc_id),
 ls as (select doc_id, count(*) lines, count(*) filter (regexp_matches(l, '[.!?;:…]["\x27”’»)\]]*\s*$')) ends, count(*) filter (regexp_matches(l, '^\s*(?:[-*•‣–—]|[0-9]{{1,4}}[.)]|\[[0-9]+\])\s')) bullets, count(*) filter (regexp_matches(l, '(?:\.\.\.|…)\s*$')) trails from l where regexp_matches(l, '[^\s]') group by doc_id),
 ts as (select doc_id, count(*) tokens, sum(length(k)) chars, count(*) filter (regexp_matches(k, '\p{{L}}')) lettered from tk group by doc_id),
 c as (select s.doc_id, coalesce(words, 0) words, coalesce(lines, 0) lines, coalesce(tokens, 0) tokens, coalesce(stops, 0) stop_words, coalesce(letters / words, 0)::double mean_word_length,
  coalesce(length(regexp_replace(solid, '\p{{L}}+', '', 'g')) / nullif(length(solid), 0), 0)::double symbol_ratio, coalesce(len(regexp_extract_all(q, '\p{{Ll}}\p{{Lu}}')) / words, 0)::double inner_capitals,
  coalesce(ends / lines, 0)::double punctuated_lines, coalesce(bullets / lines, 0)::double bullet_lines, coalesce(trails / lines, 0)::double ellipsis_lines,
  coalesce(len(regexp_extract_all(x, '#|\.\.\.|…')) / tokens, 0)::double hash_ratio, coalesce(lettered / tokens, 0)::double lettered, coalesce(chars / tokens, 0)::double token_length,
  {", ".join(f"coalesce(n_{code} / words, 0)::double c_{code}" for code in prose.COMMON)} from s left join ws using (doc_id) left join ls using (doc_id) left join ts using (doc_id)),
 b as (select *, list_max([{", ".join(f"c_{code} / {least}" for code, least in prose.LEAST_COMMON.items())}]) top from c),
 j as (select *, case {" ".join(f"when c_{code} / {least} = top then '{code}'" for code, least in prose.LEAST_COMMON.items())} end common_language, concat_ws('; ', case when words = 0 then 'no words' end,
  case when {" and ".join(f"c_{code} < {least}" for code, least in prose.LEAST_COMMON.items())} then 'common words are rare' end, case when symbol_ratio > {prose.MOST_SYMBOLS} then 'symbols' end,
  case when inner_capitals > {prose.MOST_INNER_CAPITALS} then 'capitals inside words' end, case when mean_word_length not between {prose.WORD_LENGTHS[0]} and {prose.WORD_LENGTHS[1]} then 'word length' end,
  case when bullet_lines > {prose.MOST_BULLETS} and punctuated_lines < 0.1 and lines > 3 then 'bullets' end) reasons,
  concat_ws('; ', case when tokens not between {prose.PUBLISHED_WORDS[0]} and {prose.PUBLISHED_WORDS[1]} then 'word count' end, case when token_length not between {prose.PUBLISHED_LENGTHS[0]} and {prose.PUBLISHED_LENGTHS[1]} then 'word length' end,
  case when hash_ratio > {prose.PUBLISHED_SYMBOLS} then 'symbols to words' end, case when bullet_lines > {prose.PUBLISHED_BULLETS} then 'bullets' end, case when ellipsis_lines > {prose.PUBLISHED_ELLIPSES} then 'ellipses' end,
  case when lettered < {prose.PUBLISHED_LETTERS} then 'words without letters' end, case when stop_words < {prose.LEAST_STOP_WORDS} then 'stop words' end) published from b)"""
ORACLE = {
    "p5_found": f"{_REACH} select a as mention_id, min(b) as representative from reach group by a",
    "p5_groups": f"{_REACH}, g as (select a, min(b) m from reach group by a) select mention_id, coalesce(m, mention_id) as representative from (select distinct mention_id from mentions) left join g on a = mention_id",
    "p7_found": "select doc_id from documents where len(regexp_extract_all(text, '[^ \\t\\r\\n]+')) > (select max(capacity_tokens) from pack_bins)",
    "p8_found": f"with d as (select source, {_SIZES} n from documents), s as (select source, sum(n) n from d group by source) select doc_source from mix_targets left join s on source = doc_source where coalesce(n, 0) * max_repeats < target_share * (select sum(n) from d)",
    "p9_found": f"{_STATISTICS} select doc_id from j where reasons <> ''",
    "p9_statistics": f"{_STATISTICS} select doc_id, {', '.join(prose.COUNTS)}, {', '.join(prose.SHARES)}, case common_language {' '.join(f"when '{code}' then c_{code}" for code in prose.COMMON)} end common_share, common_language, reasons from j",
    "p9_published": f"{_STATISTICS} select doc_id, tokens, stop_words, published as reasons from j",
}
