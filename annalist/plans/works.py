"""Queries about catalogues, authors, names, links and places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalist.functions import language
from annalist.functions import texts as t
from annalist.functions.numbers import degrees_to_raw, read_year
from annalist.operators import order, places, resolve
from annalist.operators.catalogue import CatalogueQuery, browse
from annalist.operators.holdings import holdings_clusters
from annalist.operators.setjoin import PROPOSE, abbreviations, prefixes, similar_pairs
from annalist.plans.book import Book
from annalist.plans.problems import _FIELDS, _GAZETTEER, _HOLDINGS
from annalist.sources import delimited
from annalist.sources.image import parts, union_section, write_image
from annalist.storage import Workspace, table
from annalist.streaming.sinks import local_clusters

book = Book()
_NORM = "trim(regexp_replace(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'))"
_TOKENS = "list_sort(list_distinct(list_filter(string_split(" + _NORM + ", ' '), lambda w: w <> '')[1:64]))"
_JACCARD = "len(list_intersect({0}, {1})) * 65536 // len(list_distinct(list_concat({0}, {1})))"


def catalogue(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "catalogue")


@book("""select entry_id from catalogue where holder = 'velmar' and lang_tag = 7 and (flags & 1) = 1 and (flags & 4) = 0
 and year_from <> 0 and year_from <= 1750 and coalesce(nullif(year_to, 0), year_from) >= 1600""")
def catalogue_match(spark, d):
    query = CatalogueQuery(holder="velmar", language=7, flags=1, without=4, year_from=1600, year_to=1750)
    return catalogue(spark, d).where(query.condition()).select("entry_id")


@book("select entry_id, title from catalogue where contains(title, 'Salt Works')")
def catalogue_title_like(spark, d):
    return catalogue(spark, d).where(CatalogueQuery(title="Salt Works").condition()).select("entry_id", "title")


@book("select entry_id, title, creator, address, holder, year_from, coalesce(nullif(year_to, 0), year_from) as year_to, lang_tag, flags from catalogue")
def catalogue_at(spark, d):
    return catalogue(spark, d).select("entry_id", "title", "creator", "address", "holder", "year_from", F.coalesce(F.nullif("year_to", F.lit(0)), "year_from").alias("year_to"), "lang_tag", "flags")


@book("""with m as (select entry_id, title from catalogue where year_from <> 0 and year_from <= 1800 and coalesce(nullif(year_to, 0), year_from) >= 1700)
 select entry_id, title, (select count(*) from m) as matched, (select count(*) from catalogue) as total from m order by entry_id limit 20""")
def browse_topn(spark, d):
    return browse(catalogue(spark, d), CatalogueQuery(year_from=1700, year_to=1800), 20).select("entry_id", "title", "matched", "total")


@book("select entry_id, title, holder from catalogue")
def union_images(spark, d):
    """The catalogue kept as images, one for each holder and numbered as parts, found again by their numbers and read as one."""
    rows = catalogue(spark, d).select("entry_id", "title", "holder")
    base = f"{Workspace(spark, 'images').root}/catalogue"
    holders = [r.holder for r in rows.select("holder").distinct().orderBy("holder").collect()]  # a few holders
    from annalist.sources.image import part_path

    for n, holder in enumerate(holders):
        write_image(part_path(base, n), catalogue=rows.where(F.col("holder").eqNullSafe(holder)))
    return union_section(spark, parts(spark, base), "catalogue").select("entry_id", "title", "holder")


_PART = 700


@book(f"""with p as (select entry_id, title, row_number() over (order by entry_id) place from catalogue), c as (select *, case when title is null then 0 else min(place) over (partition by title) end cl, (place - 1) // {_PART} part from p)
 select entry_id, part, place - part * {_PART} as local_row, case when cl > part * {_PART} then cl - part * {_PART} else 0 end as local_cluster from c""")
def cluster_rebase(spark, d):
    """Rows by their place in their part; a row's cluster is the place of the first row of its title, if that part holds it."""
    placed = order.numbered(catalogue(spark, d).select("entry_id", "title"), [F.col("entry_id")])
    first = placed.where("title is not null").groupBy("title").agg(F.min("place").alias("cluster"))
    rows = placed.join(first, "title", "left").select("entry_id", "place", F.coalesce("cluster", F.lit(0)).alias("cluster"))
    local, _ = local_clusters(rows, _PART)
    return local.select("entry_id", "part", (F.col("place") - F.col("part") * _PART).alias("local_row"), "local_cluster")


_TALLY = f"{_HOLDINGS.replace("trim(f[8], ' ') oclc", "trim(f[3], ' ') rights, trim(f[8], ' ') oclc")} select count(*) as lines, count(*) filter (bad) as malformed, count(*) filter (not bad) as rows, count(*) filter (not bad and rights in ('pd', 'pdus', 'world', 'cc-zero')) as public_domain, count(*) filter (not bad and regexp_extract(y, '(?:^|[^0-9])([0-9]{{4}})(?:$|[^0-9])', 1) between '0001' and '1899') as before_1900, count(*) filter (not bad and access = 'allow') as full_view, count(*) filter (not bad and title = '') as without_title, count(*) filter (not bad and creator = '') as without_creator, count(*) filter (not bad and y = '') as without_year from b"


@book(_TALLY)
def holdings_tally(spark, d):
    lines = delimited.holdings_records(table(spark, d, "holdings_raw"))
    bad = delimited.rejects(lines, delimited.HOLDINGS).select("record", F.lit(True).alias("bad"))
    good = F.col("bad").isNull()
    return lines.join(bad, "record", "left").agg(
        F.count("*").alias("lines"), F.count_if(~good).alias("malformed"), F.count_if(good).alias("rows"), F.count_if(good & F.col("rights").isin("pd", "pdus", "world", "cc-zero")).alias("public_domain"),
        F.count_if(good & read_year(F.col("year")).between(1, 1899)).alias("before_1900"), F.count_if(good & (F.col("access") == "allow")).alias("full_view"),
        F.count_if(good & (F.col("title") == "")).alias("without_title"), F.count_if(good & (F.col("author") == "")).alias("without_creator"), F.count_if(good & (F.col("year") == "")).alias("without_year"),
    )


_KEYS = f"{_HOLDINGS}, k as (select record_no, unnest(list_filter(list_transform(string_split(oclc, ','), lambda x: trim(x)), lambda x: x <> '')) key from b where not bad)"
_CLUSTER = _KEYS.replace("with l as", "with recursive l as", 1) + """, u as (select distinct a.record_no a, b.record_no b from k a join k b using (key)), reach(a, b) as (select a, b from u union select r.a, u.b from reach r join u on r.b = u.a)"""


@book(f"{_CLUSTER} select a as record_no, min(b) as cluster from reach group by a")
def holdings_dedup(spark, d):
    valid = delimited.holdings_valid(delimited.holdings_records(table(spark, d, "holdings_raw")))
    return holdings_clusters(valid.select(F.col("record").alias("record_no"), "keys"))


@book(f"{_CLUSTER}, cl as (select a, min(b) m from reach group by a), sz as (select m, count(*) n from cl group by m) select count(*) as clusters, sum(n)::bigint as members, sum(n - 1)::bigint as merged, max(n) as largest from sz")
def cluster_summary(spark, d):
    sizes = holdings_dedup(spark, d).groupBy("cluster").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("clusters"), F.sum("n").alias("members"), F.sum(F.col("n") - 1).alias("merged"), F.max("n").alias("largest"))


_PLACE = f"""with q as (select record_no, {_FIELDS.format("regexp_replace(record_text, '\\r$', '')")} f, {_FIELDS.format("header_text")} c from gazetteer_raw where record_text is not null and regexp_replace(record_text, '\\r$', '') <> '' and regexp_full_match(regexp_replace(record_text, '\\r$', ''), '(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*')),
 p as (select record_no, try_cast(f[list_position(c, 'id')] as bigint) place, f[list_position(c, 'featureTypes')] types, f[list_position(c, 'connectsWith')] links, f[list_position(c, 'reprLat')] la from q where len(f) = len(c))"""


def _places(spark, d):
    return delimited.gazetteer_records(table(spark, d, "gazetteer_raw")).where("broken is null").withColumn("place", F.col("id").try_cast("long"))


_KIND = " + ".join("case when len(list_intersect(string_split(regexp_replace(types, ' *, *', ',', 'g'), ','), [{}])) > 0 then {} else 0 end".format(", ".join(f"'{w}'" for w in words.split()), bit) for bit, words in t.PLACE_KINDS)


@book(f"{_PLACE} select record_no, {_KIND} as kinds from p")
def place_kinds(spark, d):
    return _places(spark, d).select(F.col("record").alias("record_no"), t.place_kinds(F.col("featureTypes")).alias("kinds"))


_LINKS = _PLACE + """, e as (select place a, try_cast(unnest(string_split(links, ',')) as bigint) b from p where place is not null), g as (select a, b from e where b is not null union select b, a from e where b is not null)"""


def _links(spark, d):
    listed = _places(spark, d).where("place is not null").select(F.col("place").alias("a"), F.explode(F.split("connectsWith", ",")).alias("b"))
    one = listed.select("a", F.col("b").try_cast("long").alias("b")).where("b is not null")
    return one.unionAll(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


@book(f"{_LINKS} select a as place, b as neighbour from g")
def place_graph(spark, d):
    return _links(spark, d).toDF("place", "neighbour")


@book(f"{_LINKS}, r as (select a, b, row_number() over (partition by a order by b) n, count(*) over (partition by a) total from g) select a as place, b as neighbour, total from r where n <= 4")
def links_from(spark, d):
    """Up to four neighbours of each place, the smallest first, with the number of all."""
    return places.neighbours(_links(spark, d).toDF("place", "neighbour"), 4)


@book(f"{_LINKS} select a as place, b as neighbour, count(*) over (partition by a) as total from g")
def links_all(spark, d):
    return places.neighbours(_links(spark, d).toDF("place", "neighbour"))


_RAW = """(case when starts_with({0}, '-') then -1 else 1 end) * ((regexp_extract({0}, '^[+-]?([0-9]+)', 1)::bigint) * 65536
 + ((rpad(left(regexp_extract({0}, '[.]([0-9]+)$', 1), 9), 9, '0')::bigint * 65536 + 500000000) // 1000000000))"""
_RESOLVED = f"""{_GAZETTEER}, k as (select id::bigint place, case when la <> '' then {_RAW.format('la')} end la_raw, case when lo <> '' then {_RAW.format('lo')} end lo_raw, try_cast(nullif(mi, '') as integer) mi, try_cast(nullif(ma, '') as integer) ma, row_number() over (partition by id::bigint order by record_no) n from b where not bad),
 rp as (select place, coalesce(lo_raw, 0) x, coalesce(la_raw, 0) z, la_raw is not null and lo_raw is not null located, mi is not null and ma is not null dated, case when mi is not null and ma is not null then mi else 0 end min_year, case when mi is not null and ma is not null then ma else 0 end max_year from k where n = 1)"""


def _resolved(spark, d):
    valid = delimited.gazetteer_valid(delimited.gazetteer_records(table(spark, d, "gazetteer_raw")))
    return places.resolved(valid.select("place").distinct(), valid)


@book(f"{_RESOLVED} select place, x, z, located, dated, min_year, max_year from rp")
def place_resolve(spark, d):
    return _resolved(spark, d)


@book(f"{_RESOLVED} select place, not dated or 300 between min_year and max_year as there from rp")
def exists_in_year(spark, d):
    return _resolved(spark, d).select("place", places.exists_in_year(F.lit(300)).alias("there"))


@book("""with recursive q as (select file_no, record_no, record_text t from gazetteer_raw where record_text is not null), c as (select *, length(t) - length(replace(t, '"', '')) k from q)
 select file_no, count(*) as records, sum(length(t))::bigint as chars from c where k % 2 = 0 and t not in ('', chr(13)) and file_no not in (select file_no from c where k % 2 = 1) group by file_no""")
def csv_record(spark, d):
    """The records of each gazetteer file, written one after another as the lines of a file and cut into records again.

    Files in which a record leaves a quote open are left out: what follows it belongs to it by right.
    """
    rows = table(spark, d, "gazetteer_raw").where("record_text is not null").select("file_no", "record_no", F.col("record_text").alias("t"))
    odd = rows.where((F.length("t") - F.length(F.replace("t", F.lit('"'), F.lit("")))) % 2 == 1).select("file_no").distinct()
    whole = rows.join(odd, "file_no", "left_anti")
    split = whole.select("file_no", "record_no", F.posexplode(F.split("t", "\n", -1)).alias("i", "text"))
    lines = order.numbered(split, [F.col(c) for c in ("file_no", "record_no", "i")]).withColumn("line", F.col("place") - 1)
    found = delimited.logical_records(lines, "file_no", "line", "text")
    return found.groupBy(F.col("file").alias("file_no")).agg(F.count("*").alias("records"), F.sum(F.length("text")).alias("chars"))


@book(f"{_LINKS} select a as place, b as neighbour from g where b in (select place from p)")
def linked_places(spark, d):
    known = _places(spark, d).select(F.col("place").alias("b")).distinct()
    return _links(spark, d).join(known, "b", "left_semi").select(F.col("a").alias("place"), F.col("b").alias("neighbour"))


@book(f"""{_PLACE} select record_no, (case when starts_with(la, '-') then -1 else 1 end) * ((regexp_extract(la, '^[+-]?([0-9]+)', 1)::bigint) * 65536
 + ((rpad(left(regexp_extract(la, '[.]([0-9]+)$', 1), 9), 9, '0')::bigint * 65536 + 500000000) // 1000000000)) as lat_raw from p where regexp_full_match(la, '[+-]?[0-9]{{1,3}}([.][0-9]+)?')""")
def degrees_raw(spark, d):
    at = _places(spark, d).where(F.col("reprLat").rlike(r"^[+-]?[0-9]{1,3}(\.[0-9]+)?$"))
    return at.select(F.col("record").alias("record_no"), degrees_to_raw(F.col("reprLat")).alias("lat_raw"))


_WORDS = ", ".join(f"('{w}', {tag}, {era}, {'true' if i == 0 else 'false'})" for tag, era, words in language.LANGUAGES for i, w in enumerate(words.split()))
_DIM = f"(values {_WORDS}) l(word, tag, era, canonical)"


@book(f"select entry_id, word as language, era from catalogue join {_DIM} on tag = lang_tag and canonical")
def language_name(spark, d):
    words = F.broadcast(language.language_words(spark).where("canonical").select(F.col("tag").alias("lang_tag"), F.col("word").alias("language"), "era"))
    return catalogue(spark, d).select("entry_id", "lang_tag").join(words, "lang_tag").select("entry_id", "language", "era")


@book(f"select entry_id, coalesce(era, 0) = 3 as modern from catalogue left join {_DIM} on tag = lang_tag and canonical")
def is_modern_rendering(spark, d):
    words = F.broadcast(language.language_words(spark).where("canonical").select(F.col("tag").alias("lang_tag"), "era"))
    return catalogue(spark, d).select("entry_id", "lang_tag").join(words, "lang_tag", "left").select("entry_id", (F.coalesce("era", F.lit(0)) == 3).alias("modern"))


@book(f"select feed_seq, coalesce(tag, 0) as tag from oai_records left join {_DIM} on word = lang_code")
def language_of(spark, d):
    return table(spark, d, "oai_records").select("feed_seq", language.language_of(F.col("lang_code")).alias("tag"))


@book(f"select feed_seq, lang_code, tag, era, canonical from oai_records join {_DIM} on word = lang_code")
def language_by_name(spark, d):
    words = F.broadcast(language.language_words(spark).withColumnRenamed("word", "lang_code"))
    return table(spark, d, "oai_records").select("feed_seq", "lang_code").join(words, "lang_code").select("feed_seq", "lang_code", "tag", "era", "canonical")


@book("select feed_seq, case lang_code when 'grc' then 3 when 'lat' then 1 when 'la' then 1 when 'fro' then 4 when 'enm' then 5 when 'fra' then 6 when 'fre' then 6 when 'fr' then 6 when 'eng' then 7 when 'en' then 7 else 0 end as tag from oai_records")
def tei_language(spark, d):
    return table(spark, d, "oai_records").select("feed_seq", language.tei_language(F.col("lang_code")).alias("tag"))


# Names of authors and the dates they lend.


def _authors(spark, d):
    a = table(spark, d, "author_windows").where("author_name is not null")
    return a.select("author_id", t.normalise_name(F.col("author_name")).alias("norm"), "from_day", "to_day")


_AUTHORS = f"a as (select author_id, {_NORM.format('author_name')} norm, from_day, to_day from author_windows where author_name is not null), f as (select *, row_number() over (partition by norm order by author_id) n from a)"


@book(f"with {_AUTHORS} select author_id, norm, n as place from f")
def author_table(spark, d):
    return _authors(spark, d).select("author_id", "norm", F.row_number().over(Window.partitionBy("norm").orderBy("author_id")).cast("long").alias("place"))


def _first_author(spark, d):
    return _authors(spark, d).groupBy("norm").agg(F.min(F.struct("author_id", "from_day", "to_day")).alias("a")).select("norm", "a.*")


@book(f"with {_AUTHORS} select entry_id, author_id, from_day, to_day from catalogue join f on norm = {_NORM.format('creator')} and n = 1")
def author_find_exact(spark, d):
    works = catalogue(spark, d).where("creator is not null").select("entry_id", t.normalise_name(F.col("creator")).alias("norm"))
    return works.join(_first_author(spark, d), "norm").select("entry_id", "author_id", "from_day", "to_day")


_SIMILAR = f"""w as (select distinct {_NORM.format('creator')} norm from catalogue where creator is not null), x as (select norm, {_TOKENS.format('norm')} tw from w where norm not in (select norm from a)),
 s as (select x.norm, f.author_id, {_JACCARD.format('tw', _TOKENS.format('f.norm'))} score from x, f where len(tw) > 0 and f.n = 1 and len(list_intersect(tw, {_TOKENS.format('f.norm')})) > 0),
 b as (select norm, author_id, score, row_number() over (partition by norm order by score desc, author_id) k from s where score >= 52428)"""


def _similar_authors(spark, d):
    """The most similar author of each creator's name that no author bears exactly."""
    first = _first_author(spark, d)
    works = catalogue(spark, d).where("creator is not null").select(t.normalise_name(F.col("creator")).alias("norm")).distinct().join(first, "norm", "left_anti")
    # Both sides in one id space: the prefix filter needs the frequency of tokens over all of them.
    sets = works.select(F.concat(F.lit("w"), F.col("norm")).alias("id"), t.token_set(F.col("norm")).alias("tokens")).unionAll(first.select(F.concat(F.lit("a"), F.col("norm")).alias("id"), t.token_set(F.col("norm")).alias("tokens"))).where("size(tokens) > 0")
    keys = prefixes(sets, 52428)
    side = lambda s: keys.where(F.col("id").startswith(s)).select(F.substring("id", 2, 100000).alias(f"{s}norm"), "token")
    pairs = side("w").join(side("a"), "token").select("wnorm", "anorm").distinct()
    scored = pairs.withColumn("score", t.jaccard_raw(t.token_set(F.col("wnorm")), t.token_set(F.col("anorm")))).where("score >= 52428")
    best = scored.join(first.select(F.col("norm").alias("anorm"), "author_id"), "anorm").groupBy("wnorm").agg(F.max_by(F.struct("author_id", "score"), F.struct("score", -F.col("author_id"))).alias("b"))
    return best.select(F.col("wnorm").alias("norm"), "b.author_id", "b.score")


@book(f"with {_AUTHORS}, {_SIMILAR} select norm, author_id, score from b where k = 1")
def author_find_similar(spark, d):
    return _similar_authors(spark, d)


@book(f"""with {_AUTHORS}, {_SIMILAR} select entry_id, case when f.author_id is not null then 'dated' when b.author_id is not null then 'proposed' else 'undated' end as outcome, coalesce(f.author_id, b.author_id) as author_id
 from catalogue left join f on f.norm = {_NORM.format('creator')} and f.n = 1 left join b on b.norm = {_NORM.format('creator')} and b.k = 1 where creator is not null""")
def soft_join_dates(spark, d):
    works = catalogue(spark, d).where("creator is not null").select("entry_id", t.normalise_name(F.col("creator")).alias("norm"))
    exact = _first_author(spark, d).select("norm", F.col("author_id").alias("exact"))
    joined = works.join(exact, "norm", "left").join(_similar_authors(spark, d).select("norm", F.col("author_id").alias("near")), "norm", "left")
    outcome = F.when(F.col("exact").isNotNull(), "dated").when(F.col("near").isNotNull(), "proposed").otherwise("undated")
    return joined.select("entry_id", outcome.alias("outcome"), F.coalesce("exact", "near").alias("author_id"))


@book("select creator, nullif(min(nullif(from_day, 0)), 0) as born, max(nullif(to_day, 0)) as died, count(*) as n from catalogue join author_windows on author_name = creator group by creator")
def life_window_union(spark, d):
    lives = table(spark, d, "author_windows").where("author_name is not null").groupBy(F.col("author_name").alias("creator")).agg(F.min(F.nullif("from_day", F.lit(0))).alias("born"), F.max(F.nullif("to_day", F.lit(0))).alias("died"), F.count("*").alias("k"))
    works = catalogue(spark, d).where("creator is not null").groupBy("creator").agg(F.count("*").alias("w"))
    return works.join(lives, "creator").select("creator", "born", "died", (F.col("k") * F.col("w")).alias("n"))


# Mentions and candidates.


def _mentions(spark, d):
    return table(spark, d, "mentions").where("mention_name is not null")


@book(f"with m as (select mention_id, unnest({_TOKENS.format('mention_name')}) token from mentions where mention_name is not null) select token, count(*) as n from m group by token")
def token_frequency(spark, d):
    return _mentions(spark, d).select(F.explode(t.token_set(F.col("mention_name"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@book(f"select mention_id, array_to_string({_TOKENS.format('mention_name')}, ' ') as tokens from mentions where mention_name is not null")
def token_set(spark, d):
    return _mentions(spark, d).select("mention_id", F.concat_ws(" ", t.token_set(F.col("mention_name"))).alias("tokens"))


@book(f"""with m as (select mention_id, {_TOKENS.format('mention_name')} tk from mentions where mention_name is not null), r as (select tk, min(mention_id) id from m where len(tk) > 0 group by tk)
 select a.id as "left", b.id as "right", {_JACCARD.format('a.tk', 'b.tk')} as score from r a join r b on a.id < b.id where {_JACCARD.format('a.tk', 'b.tk')} >= {PROPOSE}
 union all select r.id, m.mention_id, 65536 from r join m on m.tk = r.tk and m.mention_id <> r.id""")
def set_similarity_join(spark, d):
    return similar_pairs(_mentions(spark, d), "mention_id", "mention_name")


@book(f"""with e as (select left_id, right_id from candidates join mentions a on a.mention_id = left_id join mentions b on b.mention_id = right_id),
 n as (select distinct left_id, right_id, {_TOKENS.format('a.mention_name')} x, {_TOKENS.format('b.mention_name')} y from e join mentions a on a.mention_id = left_id join mentions b on b.mention_id = right_id where a.mention_name is not null and b.mention_name is not null)
 select left_id, right_id, case when len(x) = 0 or len(y) = 0 then 0 else {_JACCARD.format('x', 'y')} end as score from n""")
def name_similarity(spark, d):
    names = _mentions(spark, d).select("mention_id", t.token_set(F.col("mention_name")).alias("tk"))
    pairs = table(spark, d, "candidates").select("left_id", "right_id").distinct()
    joined = pairs.join(names.toDF("left_id", "x"), "left_id").join(names.toDF("right_id", "y"), "right_id")
    return joined.select("left_id", "right_id", t.jaccard_raw(F.col("x"), F.col("y")).alias("score"))


@book(f"""with e as (select mention_id, unnest({_TOKENS.format('mention_name')}) token from mentions where mention_name is not null), f as (select token, count(*) df from e group by token),
 r as (select mention_id, token, row_number() over (partition by mention_id order by df, token) k, count(*) over (partition by mention_id) n from e join f using (token))
 select mention_id, token from r where k <= least(greatest(n - ((36045 * n + 65535) // 65536) + 1, 1), n)""")
def blocking_prefix(spark, d):
    sets = _mentions(spark, d).select(F.col("mention_id").alias("id"), t.token_set(F.col("mention_name")).alias("tokens")).where("size(tokens) > 0")
    return prefixes(sets).withColumnRenamed("id", "mention_id")


@book(f"select mention_id, {_NORM.format('mention_name')} as norm from mentions where mention_name is not null")
def normalise_name(spark, d):
    return _mentions(spark, d).select("mention_id", t.normalise_name(F.col("mention_name")).alias("norm"))


#: References as people note them: of an address the scheme, www., a trailing slash and a tracking parameter come and go.
_NOTED = """case entry_id % 5 when 0 then address when 1 then 'http://www.' || regexp_replace(address, '^https://', '') || '/' when 2 then address || '?utm_source=list' when 3 then '<' || address || '>' else upper(address) end"""
_NOTES = f"""n as (select entry_id id, creator as name, {_NOTED} as reference from catalogue union all select entry_id + 5000000000, title, address || '#top' from catalogue where entry_id % 7 = 0)"""
_KEY = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(reference), '^[ <]+|[ >/.]+$', '', 'g'), '#.*$', ''), '^[a-z]{{0,8}}://', ''), '^www[.]|[?]utm_source=list$', '', 'g')"


def _noted(spark, d):
    rows = catalogue(spark, d)
    e, address = F.col("entry_id"), F.col("address")
    noted = (
        F.when(e % 5 == 0, address).when(e % 5 == 1, F.concat(F.lit("http://www."), F.regexp_replace(address, "^https://", ""), F.lit("/"))).when(e % 5 == 2, F.concat(address, F.lit("?utm_source=list")))
        .when(e % 5 == 3, F.concat(F.lit("<"), address, F.lit(">"))).otherwise(F.upper(address))
    )
    again = rows.where(e % 7 == 0).select((e + 5000000000).alias("id"), F.col("title").alias("name"), F.concat(address, F.lit("#top")).alias("reference"))
    return rows.select(e.alias("id"), F.col("creator").alias("name"), noted.alias("reference")).unionByName(again)


@book(f"with {_NOTES}, k as (select id, {_KEY} k from n where reference is not null), m as (select id, min(id) over (partition by k) b from k) select id as a, b from m where id <> b")
def hard_key_join(spark, d):
    """Handles of one reference, however it is noted: each with the least of them."""
    return resolve.hard_links(_noted(spark, d), "id", "reference")


_AUTO = 52428
_ENTITY = f"""with recursive {_NOTES}, k as (select id, {_KEY} k from n where reference is not null), hd as (select id a, min(id) over (partition by k) b from k),
 tk as (select id, {_TOKENS.format('name')} tk from n where name is not null), rp as (select tk, min(id) id from tk where len(tk) > 0 group by tk),
 sm as (select a.id l, b.id r, {_JACCARD.format('a.tk', 'b.tk')} s from rp a join rp b on a.id < b.id where list_has_any(a.tk, b.tk) and {_JACCARD.format('a.tk', 'b.tk')} >= {PROPOSE} union all select least(rp.id, t.id), greatest(rp.id, t.id), 65536 from rp join tk t on t.tk = rp.tk and t.id <> rp.id)"""
_COMPONENTS = """, u as (select a, b from e union select b, a from e union select id, id from n), reach(a, b) as (select a, b from u union select r.a, u.b from reach r join u on r.b = u.a), lb as (select a id, min(b) label from reach group by a)"""


@book(f"{_ENTITY}, e as (select a, b from hd){_COMPONENTS} select id, label from lb")
def resolve_entities(spark, d):
    """Handles resolved to entities by their references alone, the default."""
    return resolve.Resolution(_noted(spark, d)).labels


@book(f"{_ENTITY}, e as (select a, b from hd union select l, r from sm where s >= {_AUTO}){_COMPONENTS} select id, label from lb")
def resolve_auto_merged(spark, d):
    """Handles resolved by their references and by names that are similar enough."""
    return resolve.Resolution(_noted(spark, d), auto_merge=_AUTO).labels


@book(f"{_ENTITY}, e as (select a, b from hd){_COMPONENTS} select l as \"left\", r as \"right\", s as score, 2 as evidence from sm join lb x on x.id = l join lb y on y.id = r where x.label <> y.label")
def resolve_proposals(spark, d):
    """What is proposed but not merged, with its evidence; none of these names is an abbreviation of another."""
    return resolve.Resolution(_noted(spark, d)).proposals.where("evidence = 2")


@book("""with p as (select least(left_id, right_id) as a, greatest(left_id, right_id) as b, max(score_raw) as score from candidates where evidence in (2, 3) and left_id is not null and right_id is not null and left_id <> right_id group by 1, 2)
 select a, b, score, row_number() over (order by score desc nulls last, a, b) as place from p""")
def candidate_order(spark, d):
    """All proposals with their places, the firmest first."""
    pairs = table(spark, d, "candidates").where("evidence in (2, 3) and left_id is not null and right_id is not null and left_id <> right_id")
    merged = pairs.groupBy(F.least("left_id", "right_id").alias("a"), F.greatest("left_id", "right_id").alias("b")).agg(F.max("score_raw").alias("score"))
    return order.numbered(merged, [F.desc_nulls_last("score"), F.col("a"), F.col("b")])


_SHORTS = f"""nm as (select distinct {_NORM.format('creator')} norm from catalogue where creator is not null), nw as (select norm, string_split(norm, ' ') w from nm where norm <> ''),
 ls as (select 2 * row_number() over (order by norm) id, norm name, list_transform(w, lambda x: x[1]) i, len(list_distinct(w[1:64])) k from nw), sh as (select distinct upper(array_to_string(list_filter(i, lambda c: regexp_matches(c, '[a-z]')), '')) name from ls where k between 3 and 8),
 ss as (select 2 * row_number() over (order by name) + 1 id, name from sh)"""


@book(f"""with {_SHORTS} select ss.id as short, ls.id as "long" from ss join ls on length(ss.name) between 2 and 8 and ls.k >= length(ss.name) and len(ls.i) > 1
 and regexp_matches(array_to_string(ls.i, ''), '^.*' || array_to_string(list_transform(range(1, length(ss.name) + 1), lambda j: lower(ss.name)[j]), '.*') || '.*$')""")
def abbrev_join(spark, d):
    """Initials of bodies' names held against all names of creators: whose words begin with them, in their order?"""
    norms = catalogue(spark, d).where("creator is not null").select(t.normalise_name(F.col("creator")).alias("name")).where("name <> ''").distinct()
    longs = order.numbered(norms, [F.col("name")]).select((2 * F.col("place")).alias("id"), "name")
    words = F.split("name", " ")
    letters = F.filter(F.transform(words, lambda w: F.substring(w, 1, 1)), lambda c: c.rlike("[a-z]"))
    some = longs.where(F.size(F.array_distinct(F.slice(words, 1, 64))).between(3, 8)).select(F.upper(F.array_join(letters, "")).alias("name")).distinct()
    shorts = order.numbered(some, [F.col("name")]).select((2 * F.col("place") + 1).alias("id"), "name")
    return abbreviations(longs.unionByName(shorts), "id", "name")
