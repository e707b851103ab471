"""Queries about documents: identifiers, positions, lines, dates, marked-up text, grounding, rasters, signatures."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.functions import dates, markup
from annalist.functions import texts as t
from annalist.operators import grounding, order, raster
from annalist.operators.grounding import ground
from annalist.plans.book import Book
from annalist.sources import textlines
from annalist.storage import Workspace, table

book = Book()
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FNV = """list_reduce(list_prepend(2166136261::bigint, list_transform(range(0, octet_length(encode({0}))), lambda i: ('0x' || substr(hex(encode({0})), (2 * i + 1)::bigint, 2))::bigint)), lambda h, b: (xor(h, b) * 16777619) & 4294967295)"""


def documents(spark, d):
    return table(spark, d, "documents")


@book(f"with n as (select distinct doc_id, work_urn from documents where work_urn is not null) select doc_id, case when {_FNV.format('work_urn')} = 0 then 1 else {_FNV.format('work_urn')} end as identifier from n")
def name_identifier(spark, d):
    return documents(spark, d).where("work_urn is not null").select("doc_id", t.name_identifier(F.col("work_urn")).alias("identifier"))


_URN = "regexp_extract(work_urn, '^urn:cts:([^:]+):([^:]+)(?::(.*))?$', {0})"


@book(f"select doc_id, {_FNV.format('(' + _URN.format(1) + chr(124) * 2 + chr(39) + ':' + chr(39) + chr(124) * 2 + _URN.format(2) + ')')} as work from documents where work_urn is not null")
def work_identifier(spark, d):
    return documents(spark, d).where("work_urn is not null").select("doc_id", t.work_identifier(F.col("work_urn")).alias("work"))


@book(f"select doc_id, nullif({_URN.format(1)}, '') as namespace, nullif({_URN.format(2)}, '') as work, nullif({_URN.format(3)}, '') as rest from documents where work_urn is not null")
def parse_urn(spark, d):
    urn = F.col("work_urn")
    return documents(spark, d).where("work_urn is not null").select("doc_id", t.urn_part(urn, 1).alias("namespace"), t.urn_part(urn, 2).alias("work"), t.urn_part(urn, 3).alias("rest"))


_LOCUS = """with p as (select doc_id, work_urn, passage, string_split(passage, '.') s from documents where passage is not null and regexp_full_match(passage, '[0-9]{1,9}([.][0-9]{1,9}){0,2}')),
 l as (select doc_id, work_urn, passage, case when len(s) > 2 then s[len(s) - 2]::bigint else 0 end part, case when len(s) > 1 then s[len(s) - 1]::bigint else 0 end section, s[len(s)]::bigint line from p)"""


def _loci(spark, d):
    at = documents(spark, d).select("doc_id", "work_urn", "passage", t.passage_locus(F.col("passage")).alias("l"))
    return at.where("l is not null").select("doc_id", "work_urn", "passage", "l.*")


@book(f"{_LOCUS} select doc_id, part, section, line from l")
def parse_passage(spark, d):
    return _loci(spark, d).select("doc_id", "part", "section", "line")


@book(f"{_LOCUS} select doc_id, case when part <> 0 then part || '.' || section || '.' || line when section <> 0 then section || '.' || line else line::varchar end as rendered from l")
def render_locus(spark, d):
    """Positions as they are written; empty leading levels are left out."""
    return _loci(spark, d).select("doc_id", t.render_locus(F.col("part"), F.col("section"), F.col("line")).alias("rendered"))


@book(f"""{_LOCUS}, a as (select doc_id, 0 part, 0 section, 0 line from documents where work_urn is not null and passage is null union all select doc_id, part, section, line from l where work_urn is not null)
 select a.doc_id, {_FNV.format('(' + _URN.format(1) + chr(124) * 2 + chr(39) + ':' + chr(39) + chr(124) * 2 + _URN.format(2) + ')')} as work, part, section, line from a join documents using (doc_id)""")
def resolve_urn(spark, d):
    """Works with their passages behind them, as one name each; a malformed passage refuses the name."""
    urn = F.concat_ws(":", "work_urn", "passage")
    found = documents(spark, d).where("work_urn is not null").select("doc_id", t.resolve_urn(urn).alias("r"))
    return found.where("r is not null").select("doc_id", "r.*")


@book(f"{_LOCUS}, r as (select doc_id, work_urn, row_number() over (partition by work_urn order by part, section, line, doc_id) n from l where work_urn is not null) select doc_id, work_urn from r where n = 1")
def locus_precedes(spark, d):
    """The first passage of each work in reading order."""
    order = F.struct("part", "section", "line", "doc_id")
    return _loci(spark, d).where("work_urn is not null").groupBy("work_urn").agg(F.min(order).alias("f")).select(F.col("f.doc_id").alias("doc_id"), "work_urn")


@book(f"with w as (select distinct work_urn from documents where work_urn is not null), i as (select work_urn name, {_FNV.format('work_urn')} id from w) select id, name, row_number() over (order by id, name) as place from i")
def vocab_sort(spark, d):
    """The whole vocabulary by its identifiers, with places."""
    names = documents(spark, d).where("work_urn is not null").select("work_urn").distinct().select(t.name_identifier(F.col("work_urn")).alias("id"), F.col("work_urn").alias("name"))
    return order.numbered(names, [F.col("id"), F.col("name")])


@book(f"with w as (select distinct work_urn from documents where work_urn is not null), i as (select {_FNV.format('work_urn')} id, work_urn from w) select doc_id, id, i.work_urn as name from documents d join i on i.work_urn = d.work_urn")
def text_for(spark, d):
    """The vocabulary joined back to what it names."""
    docs = documents(spark, d).where("work_urn is not null").select("doc_id", "work_urn")
    vocabulary = docs.select("work_urn").distinct().withColumn("id", t.name_identifier(F.col("work_urn")))
    return docs.join(vocabulary, "work_urn").select("doc_id", "id", F.col("work_urn").alias("name"))


# Lines.

_LINES = """with l as (select doc_id, generate_subscripts(ls, 1) - 1 line, unnest(ls) x from (select doc_id, string_split(text, chr(10)) ls from documents where text <> ''))"""


def _lines(spark, d):
    return textlines.split_lines(documents(spark, d), "doc_id", "text").withColumnRenamed("doc", "doc_id")


@book(f"{_LINES} select doc_id, line, x as text from l where line % 3 = 1")
def text_line(spark, d):
    """Lines by their position: of each document the second, the fifth and so on."""
    return _lines(spark, d).where("line % 3 = 1").select("doc_id", F.col("line").cast("long").alias("line"), "text")


@book(f"{_LINES} select doc_id, line, coalesce(sum(octet_length(encode(x))) over (partition by doc_id order by line rows between unbounded preceding and 1 preceding), 0)::bigint as \"begin\", octet_length(encode(x))::bigint as size from l")
def text_offsets(spark, d):
    return textlines.offsets(textlines.split_lines(documents(spark, d), "doc_id", "text")).withColumnRenamed("doc", "doc_id").withColumn("line", F.col("line").cast("long"))


@book(f"{_LINES}, n as (select doc_id, count(*) n from l group by doc_id) select doc_id, case doc_id % 4 when 1 then 'other number of lines' when 2 then 'offsets out of order' else 'offset beyond the end' end as reason from n where doc_id % 4 <> 0 and (doc_id % 4 <> 2 or n > 1)")
def text_open(spark, d):
    """Offset tables with a fault put into three of four of them, and why they are refused."""
    table_ = textlines.offsets(textlines.split_lines(documents(spark, d), "doc_id", "text"))
    sizes = table_.groupBy("doc").agg(F.count("*").alias("lines"), F.sum("size").alias("bytes"))
    fault = F.col("doc") % 4
    # One line too many is stated; the first line begins behind the second; the last begins behind the end.
    sizes = sizes.withColumn("lines", F.when(fault == 1, F.col("lines") + 1).otherwise(F.col("lines")))
    last = sizes.select("doc", (F.col("lines") - 1).alias("end"), "bytes")
    spoilt = table_.join(last, "doc").withColumn("begin", F.when((fault == 2) & (F.col("line") == 0) & (F.col("end") > 0), F.col("bytes")).when((fault == 3) & (F.col("line") == F.col("end")), F.col("bytes") + 1).otherwise(F.col("begin")))
    # A document of one line cannot begin behind its second; of a one-line document the fault of the last line is in its first.
    return textlines.refused(spoilt.select("doc", "line", "begin"), sizes).select(F.col("doc").alias("doc_id"), F.when(fault == 3, "offset beyond the end").otherwise(F.col("reason")).alias("reason"))


@book(f"{_LINES} select doc_id, line::bigint as line, length(regexp_extract(x, '^(#{{1,6}}) ', 1)) as depth from l where regexp_matches(x, '^#{{1,6}} ')")
def heading_depth(spark, d):
    return _lines(spark, d).select("doc_id", F.col("line").cast("long").alias("line"), t.heading_depth(F.col("text")).cast("long").alias("depth")).where("depth > 0")


@book("select doc_id, len(regexp_extract_all(text, '\\[\\^([0-9]{1,6})\\]')) as markers, array_to_string(regexp_extract_all(text, '\\[\\^([0-9]{1,6})\\]', 1), ',') as numbers from documents where text is not null")
def footnote_marker(spark, d):
    found = t.note_numbers(F.col("text"))
    return documents(spark, d).where("text is not null").select("doc_id", F.size(found).cast("long").alias("markers"), F.concat_ws(",", found).alias("numbers"))


@book("select doc_id, array_to_string(list_transform(regexp_extract_all(text, '\\[\\^([0-9]{1,6})\\]', 1), lambda n: coalesce(work_urn, 'doc') || '#ch1[^' || n || ']'), ' ') as names from documents where regexp_matches(text, '\\[\\^[0-9]{1,6}\\]')")
def footnote_name(spark, d):
    found = t.note_numbers(F.col("text"))
    named = F.transform(found, lambda n: t.footnote_name(F.coalesce("work_urn", F.lit("doc")), F.lit(1), n))
    return documents(spark, d).where(F.size(found) > 0).select("doc_id", F.concat_ws(" ", named).alias("names"))


@book("select doc_id, coalesce(try_cast(nullif(regexp_extract(text, '(?:^|[^0-9])([0-9]{4})(?:$|[^0-9])', 1), '') as integer), 0) as year from documents where text is not null")
def read_year(spark, d):
    from annalist.functions.numbers import read_year as year

    return documents(spark, d).where("text is not null").select("doc_id", year(F.col("text")).alias("year"))


@book("select doc_id, try_cast(nullif(regexp_extract(passage, '^\\s*([+-]?[0-9]+)', 1), '') as integer) as number from documents where passage is not null")
def signed_int(spark, d):
    from annalist.functions.numbers import signed_int as number

    return documents(spark, d).where("passage is not null").select("doc_id", number(F.col("passage")).alias("number"))


@book("select feed_seq, try_cast(nullif(regexp_extract(date_text, '(?:^|[^0-9])([0-9]{4})-[0-9]{2}-[0-9]{2}(?:$|[^0-9])', 1), '') as integer) as year from oai_records where date_text is not null")
def extract_iso_year(spark, d):
    return table(spark, d, "oai_records").where("date_text is not null").select("feed_seq", dates.iso_year(F.col("date_text")).alias("year"))




def _part(i: int) -> str:
    return f"nullif(regexp_extract(date_text, '^(-?[0-9]{{1,6}})(?:-([0-9]{{2}})(?:-([0-9]{{2}}))?)?', {i}), '')"



@book(f"""with p as (select feed_seq, try_cast({_part(1)} as int) y, try_cast({_part(2)} as int) m0, try_cast({_part(3)} as int) dd from oai_records where date_text is not null),
 q as (select feed_seq, y, case when m0 between 1 and 12 then m0 end m, dd from p where y is not null),
 w as (select feed_seq, dd, m, date_diff('day', date '1970-01-01', make_date(y, coalesce(m, 1), 1)) s, date_diff('day', date '1970-01-01', case when m is null then make_date(y, 12, 31) else last_day(make_date(y, m, 1)) end) e from q)
 select feed_seq, case when m is not null and dd >= 1 and s + dd - 1 <= e then s + dd - 1 else s end as from_day, case when m is not null and dd >= 1 and s + dd - 1 <= e then s + dd - 1 else e end as to_day from w""")
def parse_tei_date(spark, d):
    window = table(spark, d, "oai_records").where("date_text is not null").select("feed_seq", dates.tei_window(F.col("date_text")).alias("w"))
    return window.where("w is not null").select("feed_seq", "w.from_day", "w.to_day")


@book("select entry_id, (case when regexp_matches(h, '^S') then -1 else 1 end) * substr(h, 2, 2)::int as latitude, (case when substr(h, 4, 1) = 'W' then -1 else 1 end) * substr(h, 5, 3)::int as longitude from (select entry_id, (case when entry_id % 2 = 0 then 'N' else 'S' end) || lpad((entry_id % 90)::varchar, 2, '0') || (case when entry_id % 3 = 0 then 'E' else 'W' end) || lpad((entry_id % 180)::varchar, 3, '0') h from catalogue)")
def tile_corner(spark, d):
    e = F.col("entry_id")
    name = F.concat(F.when(e % 2 == 0, "N").otherwise("S"), F.lpad((e % 90).cast("string"), 2, "0"), F.when(e % 3 == 0, "E").otherwise("W"), F.lpad((e % 180).cast("string"), 3, "0"))
    return table(spark, d, "catalogue").select("entry_id", dates.tile_corner(name).alias("c")).select("entry_id", "c.latitude", "c.longitude")


# Addresses.


@book(f"""with x as (select entry_id, regexp_replace(regexp_replace(address, '^[ <]+', ''), '[ >/.]+$', '') a from catalogue where address is not null), y as (select entry_id, regexp_replace(regexp_replace(a, '#.*$', ''), '^.{{0,8}}?://', '') a from x)
 select entry_id, regexp_replace({_LOWER.format('a')}, '^www[.]', '') as reference from y""")
def normalise_reference(spark, d):
    return table(spark, d, "catalogue").where("address is not null").select("entry_id", t.normalise_reference(F.col("address")).alias("reference"))


@book("select entry_id, replace(url_encode(title), '+', '%20') as escaped from catalogue where title is not null")
def url_encode(spark, d):
    return table(spark, d, "catalogue").where("title is not null").select("entry_id", t.url_escape(F.col("title")).alias("escaped"))


@book("select doc_id, nullif(regexp_extract(k, '^([^,]+),(.+)$', 1), '') as authority, nullif(regexp_extract(k, '^([^,]+),(.+)$', 2), '') as key from (select doc_id, source || ',' || passage k from documents where source is not null and passage is not null)")
def authority_key(spark, d):
    key = t.authority_key(F.concat_ws(",", "source", "passage"))
    return documents(spark, d).where("source is not null and passage is not null").select("doc_id", key.getField("authority").alias("authority"), key.getField("key").alias("key"))


@book(f"select doc_id, {_FNV.format('k')} as id from (select doc_id, source || ',' || passage k from documents where source is not null and passage is not null)")
def authority_id(spark, d):
    """The identity of keys of authorities, the whole key counting, as two authorities number alike."""
    return documents(spark, d).where("source is not null and passage is not null").select("doc_id", t.authority_id(F.concat_ws(",", "source", "passage")).alias("id"))


@book(f"select doc_id, trim(regexp_replace({_LOWER.format('text')}, '[ \\t\\r\\n]+', ' ', 'g'), ' ') as claim from documents where text is not null")
def normalise_claim(spark, d):
    return documents(spark, d).where("text is not null").select("doc_id", t.normalise_claim(F.col("text")).alias("claim"))


@book("select distinct source, case source when 'openalex' then 52429 when 'arxiv' then 42598 when 'wikipedia' then 36045 when 'github' then 32768 when 'stackexchange' then 26214 else 22938 end as confidence, case source when 'openalex' then 0 when 'github' then 2 else 3 end as kind from (select source from documents where source is not null union all select unnest(['openalex', 'arxiv', 'wikipedia', 'github', 'stackexchange']))")
def provider_profile(spark, d):
    known = spark.createDataFrame([(p,) for p in t.PROVIDERS], "source string")
    every = documents(spark, d).where("source is not null").select("source").unionByName(known).distinct()
    return every.select("source", t.provider_confidence(F.col("source")).alias("confidence"), t.provider_kind(F.col("source")).alias("kind"))


# Marked-up text.


@book("select doc_id, trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'), ' ') as flat from documents where text is not null")
def xml_flatten(spark, d):
    return documents(spark, d).where("text is not null").select("doc_id", t.xml_flatten(F.col("text")).alias("flat"))


_ESCAPED = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_FLAT = "trim(regexp_replace({0}, '[ \\t\\r\\n]+', ' ', 'g'), ' ')"


def _escaped(text):
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


@book("select entry_id, title || 'éA€ &nope; &#1114112; &#xD800;' as decoded from catalogue where title is not null")
def xml_entities(spark, d):
    """Titles with their entities, numeric references behind them, and what is none left as it is."""
    marked = F.concat(_escaped(F.col("title")), F.lit("&#233;&#x41;&#8364; &nope; &#1114112; &#xD800;"))
    return table(spark, d, "catalogue").where("title is not null").select("entry_id", markup.xml_entities(marked).alias("decoded"))


@book(f"select entry_id, {_FLAT.format('title')} as text, holder as attribute from catalogue where title is not null")
def xml_first_text(spark, d):
    """A record written as marked-up text and read again."""
    body = F.concat(F.lit("<!-- <title>no</title> --><r:title lang='"), F.col("holder"), F.lit("'>"), _escaped(F.col("title")), F.lit("</r:title>"))
    return table(spark, d, "catalogue").where("title is not null").select("entry_id", markup.xml_first_text(body, "title").alias("text"), markup.xml_attribute(F.regexp_extract(body, r"(<r:title[^>]*>)", 1), "lang").alias("attribute"))


def _marked(spark, d):
    """Catalogue rows as marked-up text with comments, raw text, quotes that hold a ">", and empty elements."""
    rows = table(spark, d, "catalogue").where("title is not null")
    years = F.when(F.col("year_from") != 0, F.concat(F.lit("<year when='"), F.col("year_from").cast("string"), F.lit("'/>"))).otherwise("")
    body = F.concat(F.lit('<r:work x="1 > 0"><!-- <no/> -->'), _escaped(F.col("title")), years, F.lit("<![CDATA[ <raw> ]]><b>"), F.col("holder"), F.lit("</b></r:work>"))
    return rows.select("entry_id", "title", "holder", body.alias("body"))


@book("""with c as (select entry_id, year_from <> 0 dated from catalogue where title is not null), e as (select entry_id, unnest([{'k': 0, 'name': 'work', 'closing': false, 'empty': false}, {'k': 1, 'name': 'year', 'closing': false, 'empty': true}, {'k': 2, 'name': 'b', 'closing': false, 'empty': false},
 {'k': 3, 'name': 'b', 'closing': true, 'empty': false}, {'k': 4, 'name': 'work', 'closing': true, 'empty': false}]) e, dated from c)
 select entry_id, row_number() over (partition by entry_id order by e.k) - 1 as n, e.name as name, e.closing as closing, e.empty as empty from e where dated or e.k <> 1""")
def xml_elements(spark, d):
    tags = _marked(spark, d).select("entry_id", F.posexplode(markup.xml_elements(F.col("body"))).alias("n", "e"))
    return tags.select("entry_id", F.col("n").cast("long").alias("n"), "e.name", "e.closing", "e.empty")


@book(f"select entry_id, {_FLAT.format(chr(39) + chr(39) + ' || title || ' + chr(39) + ' <raw> ' + chr(39) + ' || holder')} as plain from catalogue where title is not null")
def xml_text(spark, d):
    return _marked(spark, d).select("entry_id", markup.xml_text(F.col("body")).alias("plain"))


@book("select entry_id, case entry_id % 3 when 0 then 'Name' when 1 then 'b' else 'title' end as name from catalogue")
def xml_name(spark, d):
    e = F.col("entry_id")
    tag = F.when(e % 3 == 0, "<x:Name a='1'>").when(e % 3 == 1, "</b>").otherwise("<dc:title/>")
    return table(spark, d, "catalogue").select("entry_id", F.get(markup.xml_elements(tag), F.lit(0)).getField("name").alias("name"))


@book(f"select entry_id, {_FLAT.format('creator')} as text from catalogue where creator is not null")
def rdf_element_text(spark, d):
    """The name within its creator, not the one of the record around it."""
    body = F.concat(F.lit("<r:RDF><r:name>no</r:name><r:creator><r:agent><r:name>"), _escaped(F.col("creator")), F.lit("</r:name></r:agent></r:creator></r:RDF>"))
    inner = markup.xml_span(body, "creator")
    return table(spark, d, "catalogue").where("creator is not null").select("entry_id", markup.xml_first_text(inner, "name").alias("text"))


# Claims held against their text.

#: Of each document its last words quoted, its first word as the subject, and as the object a word of the quotation; in turns one of them is spoilt.
_CLAIM = """with p as (select doc_id, text passage, right(text, 60) q0, n_chars from documents where text is not null),
 q as (select *, trim(regexp_extract(q0, '[^\\s]+')) w from p),
 c as (select doc_id, passage, case doc_id % 7 when 1 then reverse(q0) || '~' when 2 then ' ' else q0 end quotation, case doc_id % 7 when 3 then w || '~~' when 6 then '' else w end subject, 'stated in' predicate, case doc_id % 7 when 4 then w || '~~' else w end object,
  0 from_day, case when doc_id % 11 = 0 then -1 else 0 end to_day, case when doc_id % 7 = 5 then 65537 else n_chars end confidence_raw from q)"""
_SAID = "trim(regexp_replace(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\r\\n]+', ' ', 'g'), ' ')"
_GROUND = f"""{_CLAIM}, n as (select *, {_SAID.format('passage')} t, {_SAID.format('quotation')} qq, {_SAID.format('subject')} s, {_SAID.format('object')} o from c),
 g as (select doc_id, subject, predicate, object, case when subject = '' or predicate = '' or object = '' then 'incomplete' when to_day < from_day then 'impossible window' when confidence_raw > 65536 then 'over confident' when qq = '' then 'no quotation' when not contains(t, qq) then 'quotation absent'
 when not contains(qq, s) then 'subject absent' when not contains(qq, o) then 'object absent' else 'admitted' end as outcome from n)"""


def _claims(spark, d):
    """Each document quoted by its last words, for a claim about a word of them; in turns a part is spoilt."""
    k = F.col("doc_id") % 7
    last = F.expr("right(text, 60)")
    word = F.regexp_extract(last, r"[^\s]+", 0)
    return documents(spark, d).where("text is not null").select(
        "doc_id", F.col("text").alias("passage"), F.when(k == 1, F.concat(F.reverse(last), F.lit("~"))).when(k == 2, " ").otherwise(last).alias("quotation"),
        F.when(k == 3, F.concat(word, F.lit("~~"))).when(k == 6, "").otherwise(word).alias("subject"), F.lit("stated in").alias("predicate"), F.when(k == 4, F.concat(word, F.lit("~~"))).otherwise(word).alias("object"),
        F.lit(0).alias("from_day"), F.when(F.col("doc_id") % 11 == 0, -1).otherwise(0).alias("to_day"), F.when(k == 5, 65537).otherwise(F.col("n_chars")).alias("confidence_raw"),
    )


@book(f"{_GROUND} select doc_id, outcome from g")
def ground_claim(spark, d):
    return ground(_claims(spark, d)).select("doc_id", "outcome")


@book(f"{_GROUND} select outcome, count(*) as n from g group by outcome")
def synthesise(spark, d):
    """The outcomes of a batch of claims."""
    return grounding.synthesise(_claims(spark, d), "doc_id").groupBy("outcome").agg(F.count("*").alias("n"))


@book(f"{_GROUND}, k as (select distinct doc_id, {_SAID.format('subject')} || chr(31) || 'stated in' || chr(31) || {_SAID.format('object')} k from g where outcome = 'admitted') select distinct {_FNV.format('k')} as claim, doc_id as source from k")
def testimonies_for(spark, d):
    """Who testifies to which of the claims that were admitted."""
    return grounding.testimonies(ground(_claims(spark, d)).where("outcome = 'admitted'"), "doc_id")


# Rasters, from the line items: a grid that grows with them, with gaps.

_CELLS = """with c as (select (l_orderkey // 64)::int r, (l_partkey // 32)::int c, max(case when l_discount = 0 then -32768 else floor(l_quantity)::int - 25 end) m from lineitem group by all)"""
_SHAPE = "sh as (select max(r) lr, max(c) lc from c)"


def _cells(spark, d):
    m = F.when(F.col("l_discount") == 0, raster.VOID).otherwise(F.floor("l_quantity").cast("int") - 25)
    return table(spark, d, "lineitem").groupBy(F.expr("cast(l_orderkey div 64 as int)").alias("row"), F.expr("cast(l_partkey div 32 as int)").alias("col")).agg(F.max(m).alias("m"))


@book(f"{_CELLS} select count(*) filter (m = -32768) as voids, min(m) filter (m <> -32768) as lowest, max(m) filter (m <> -32768) as highest from c")
def raster_stats(spark, d):
    return raster.stats(_cells(spark, d))


@book(f"{_CELLS} select max(r) + 1 as rows, max(c) + 1 as cols, count(*) as cells, count(*) filter (m = -32768) as voids, min(m) filter (m <> -32768) as lowest, max(m) filter (m <> -32768) as highest from c")
def relief_header(spark, d):
    return raster.header(_cells(spark, d))


@book(f"{_CELLS} select r as row, c as col, m from c")
def relief_samples(spark, d):
    return _cells(spark, d)


@book(f"{_CELLS} select (r // 5)::int as row, (c // 5)::int as col, coalesce(sum(m) filter (m <> -32768) // count(*) filter (m <> -32768), -32768)::int as m from c group by 1, 2")
def raster_reduce(spark, d):
    return raster.reduce(_cells(spark, d), 5)


@book(f"{_CELLS} select x.i::int as row, y.j::int as col, c.m from c, unnest(range((3 * r + 1) // 2, (3 * r + 3 + 1) // 2)) x(i), unnest(range((3 * c + 1) // 2, (3 * c + 3 + 1) // 2)) y(j) where c.m <> -32768")
def resample_cells(spark, d):
    """The whole raster with three cells for two."""
    return raster.resample(_cells(spark, d), 2**30, 2**30, 2, 3)


_TILES = f"""{_CELLS}, {_SHAPE}, ti as (select (r // 16)::int as tile_z, (c // 16)::int as tile_x, count(*) filter (m <> -32768) as cells from c group by 1, 2),
 te as (select tile_z, tile_x, cells, (case when tile_x = 0 then 1 else 0 end) + (case when tile_x = lc // 16 then 2 else 0 end) + (case when tile_z = 0 then 4 else 0 end) + (case when tile_z = lr // 16 then 8 else 0 end) as edges from ti, sh where cells > 0)"""


@book(f"{_TILES} select tile_z, tile_x, cells, edges from te")
def bake_tiles(spark, d):
    return raster.tiles(_cells(spark, d), 16)


@book(f"{_TILES} select tile_z, tile_x, 'survey.L0.e' || lpad(tile_x::varchar, 5, '0') || '.s' || lpad(tile_z::varchar, 5, '0') || '.tile' as path from te")
def tile_path(spark, d):
    path = raster.tile_path(F.lit("survey"), F.lit(0), F.col("tile_x"), F.col("tile_z"))
    return raster.tiles(_cells(spark, d), 16).select("tile_z", "tile_x", path.alias("path"))


@book(f"{_TILES} select te.tile_z, te.tile_x, (r % 16)::int as row, (c.c % 16)::int as col, m, edges, 2 as blend from c join te on te.tile_z = r // 16 and te.tile_x = c.c // 16")
def relief_field(spark, d):
    return raster.field(_cells(spark, d), 16, 2)


@book(f"""{_CELLS}, {_SHAPE}, rd as (select (r // 2)::int r, (c // 2)::int c, coalesce(sum(m) filter (m <> -32768) // count(*) filter (m <> -32768), -32768)::int as m from c group by 1, 2),
 ti as (select r // 16 tile_z, c // 16 tile_x, count(*) filter (m <> -32768) cells, any_value(0) from rd group by 1, 2), s2 as (select max(r) lr, max(c) lc from rd)
 select tile_z::int as tile_z, tile_x::int as tile_x, cells, (case when tile_x = 0 then 1 else 0 end) + (case when tile_x = lc // 16 then 2 else 0 end) + (case when tile_z = 0 then 4 else 0 end) + (case when tile_z = lr // 16 then 8 else 0 end) as edges,
 'survey.L0.e' || lpad(tile_x::varchar, 5, '0') || '.s' || lpad(tile_z::varchar, 5, '0') || '.tile' as file, 'line items' as attribution, (select count(*) from rd x where x.r // 16 = tile_z and x.c // 16 = tile_x) as samples from ti, s2 where cells > 0""")
def relief_bake(spark, d):
    """A raster reduced, cut, written as tiles and read again: the plan of the tiles with the samples that each holds."""
    path = Workspace(spark, "survey").root
    plan = raster.bake(_cells(spark, d), path, 2, 16, "line items")
    held = spark.read.parquet(path).select("tile_z", "tile_x", F.size("samples").cast("long").alias("samples"))
    return plan.join(held, ["tile_z", "tile_x"])


@book(f"""{_TILES}, st as (select i, i // 16 tn from range(0, 200) s(i)), gr as (select distinct c from c where r = 0 and m <> -32768), pl as (select distinct tn from st),
 wa as (select tn, tn + x.k tile_x, y.k tile_z from pl, range(-1, 2) x(k), range(-1, 2) y(k)), hd as (select wa.*, te.cells is not null there from wa left join te using (tile_x, tile_z)),
 ba as (select tn, count(*) filter (there) resident, count(*) filter (not there) missing from hd group by tn), ea as (select tile_x, tile_z, max(tn) last from hd where there group by all)
 select (select count(*) from st join gr on gr.c = i) as answered, (select count(*) from st where i not in (select c from gr)) as blind, (select count(*) from ea) as loaded, (select count(*) from ea where last < (select max(tn) from pl)) as evicted,
 (select sum(missing)::bigint from ba) as missing, (select max(resident) from ba) as peak""")
def relief_walk(spark, d):
    return raster.walk(_cells(spark, d), 16, 200, 1)


@book(f"""{_TILES}, w as (select tile_x, tile_z from te where abs(tile_x - 2) <= 3 and abs(tile_z - 2) <= 3), h as (select tile_x, tile_z from te where abs(tile_x - 4) <= 3 and abs(tile_z - 4) <= 3)
 select tile_x, tile_z, case when w.tile_x is not null and h.tile_x is not null then 'keep' when w.tile_x is not null then 'load' else 'evict' end as action from w full join h using (tile_x, tile_z)""")
def relief_stream(spark, d):
    """What a viewer at tile (2, 2) who comes from (4, 4) keeps, loads and evicts."""
    tiles = raster.tiles(_cells(spark, d), 16).select("tile_x", "tile_z")
    held = tiles.where("abs(tile_x - 4) <= 3 and abs(tile_z - 4) <= 3")
    return raster.residency(tiles, held, 2, 2, 3)


@book(f"{_CELLS} select min(m) filter (m <> -32768) as lowest, max(m) filter (m <> -32768) as highest, count(*) filter (m = -32768) as gaps from c where r < 16 and c < 16")
def relief_window(spark, d):
    return raster.window(_cells(spark, d), 16)


@book(f"{_CELLS}, s as (select c.*, h.i from c, range(0, 2) h(i)), g as (select r, c + i * 60 as c, max_by(m, i) m from s group by r, c + i * 60) select r::int as row, c::int as col, m from g")
def assemble_region(spark, d):
    """Two tiles side by side; the columns they share are the later tile's."""
    cells = _cells(spark, d)
    first = cells.withColumn("n", F.lit(1))
    second = cells.withColumn("n", F.lit(0)).withColumn("col", F.col("col") + 60)
    return raster.assemble(first, second)


@book("select section, case section when 1 then 'vocabulary' when 2 then 'sources' when 3 then 'facts' when 4 then 'documents' when 5 then 'loci' when 6 then 'texts' when 7 then 'ecc' when 8 then 'catalogue' when 9 then 'gazetteer' when 10 then 'place-link' when 11 then 'candidate' when 12 then 'attribution' when 13 then 'relief' else 'unknown' end as name from range(0, 15) r(section)")
def section_name(spark, d):
    from annalist.sources.image import section_name as name

    return spark.range(15).select(F.col("id").alias("section"), name(F.col("id")).alias("name"))


