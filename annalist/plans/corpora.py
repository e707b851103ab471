"""Queries that read a corpus or an image as a whole.

The test tables hold no notes, reports or TEI works, so these are written from the catalogue, one of each for each
row, with every case the readers tell apart; the SQL states what must be found from how they were written.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.functions import texts as t
from annalist.plans.book import Book
from annalist.plans.facts import _bytes, _fold
from annalist.plans.texts import _FLAT, _escaped
from annalist.sources import files, markdown, research, tei
from annalist.sources.image import Image, write_image
from annalist.storage import Workspace, table

book = Book()


def _id(text: str) -> str:
    """SQL of name_identifier(); no name here folds to 0."""
    return _fold(_bytes(text))


def _rows(spark, d):
    e = F.col("entry_id")
    number = lambda k: F.concat(F.lit("-"), F.lpad(((e * k) % 1000).cast("string"), 3, "0"))
    scheme = F.upper(F.substring("holder", 1, 3))
    other = F.when(e % 5 == 0, "ZZZ-001").when(e % 5 == 1, F.concat(F.lit("VEL"), number(13))).otherwise(F.concat(F.lit("OST"), number(11)))
    rows = table(spark, d, "catalogue").where("holder is not null")
    return rows.withColumns({"doc": F.lpad(e.cast("string"), 12, "0"), "id1": F.concat(scheme, number(1)), "id2": F.concat(scheme, number(7)), "id3": other})


_ROWS = """with b as (select *, lpad(entry_id::varchar, 12, '0') doc, year_from y, upper(left(holder, 3)) || '-' || lpad((entry_id % 1000)::varchar, 3, '0') id1, upper(left(holder, 3)) || '-' || lpad((entry_id * 7 % 1000)::varchar, 3, '0') id2,
 case entry_id % 5 when 0 then 'ZZZ-001' when 1 then 'VEL-' || lpad((entry_id * 13 % 1000)::varchar, 3, '0') else 'OST-' || lpad((entry_id * 11 % 1000)::varchar, 3, '0') end id3 from catalogue where holder is not null)"""


# Notes: an identifier defined and others cited, footnotes in two chapters, a fence.


def _notes(spark, d):
    e = F.col("entry_id").cast("string")
    dated = F.when(F.col("year_from") != 0, F.concat(F.lit(" "), F.lpad(F.col("year_from").cast("string"), 4, "0"), F.lit("-03-01"))).otherwise("")
    note = F.when(F.col("entry_id") % 3 != 0, F.concat(F.lit("[^1]: after "), F.col("id1"))).otherwise("")
    lines = [
        F.concat(F.lit("# Entry "), e, dated), F.lit(""), F.concat(F.lit("| `"), F.col("id1"), F.lit("` | record "), e, F.lit(" |")), F.concat(F.lit("See "), F.col("id2"), F.lit(" and "), F.col("id3"), F.lit(". [^1]")),
        F.lit("```"), F.concat(F.col("id1"), F.lit(" AAA-001")), F.lit("```"), note, F.lit("## Later"), F.lit("Again [^1]"),
    ]
    return _rows(spark, d).select("doc", F.concat_ws("\n", *lines).alias("body"))


_REFS = _ROWS + """, h as (select id1 as name, min(doc) home from b group by id1), sc as (select distinct split_part(name, '-', 1) scheme from h), raw as (
 select doc, 3 line, 1 heading, y, id1 as name, 'definition' role, '| `' || id1 || '` | record ' || entry_id || ' |' as text, true notes from b
 union all select doc, 4, 1, y, unnest([id2, id3]), 'citation', null, true from b
 union all select doc, 8, 1, y, doc || '#ch1[^1]', 'note', '[^1]: after ' || id1, true from b where entry_id % 3 <> 0
 union all select doc, 4, 1, y, doc || '#ch1[^1]', 'note citation', null, entry_id % 3 <> 0 from b union all select doc, 10, 2, 0, doc || '#ch2[^1]', 'note citation', null, entry_id % 3 <> 0 from b),
 r as (select raw.*, case when role = 'definition' then case when home = doc then 'defined' else 'duplicate' end when role = 'note' then 'defined' when role = 'citation' then case when home is not null then 'resolved' when scheme is not null then 'dangling' else 'noise' end
  when not notes then 'noise' when line = 4 then 'resolved' else 'dangling' end outcome from raw left join h using (name) left join sc on scheme = split_part(raw.name, '-', 1))"""


def _resolved(spark, d):
    """The references of the corpus, found once."""
    space = Workspace(spark, "markdown")
    return space.write(markdown.resolve(space.write(markdown.references(markdown.lines(_notes(spark, d))), "found")), "resolved")


@book(f"{_REFS} select doc, name as identifier, count(*) as n from r where role in ('definition', 'citation') group by all")
def identifier_shape(spark, d):
    found = markdown.references(markdown.lines(_notes(spark, d))).where("role in ('definition', 'citation')")
    return found.groupBy("doc", F.col("name").alias("identifier")).agg(F.count("*").alias("n"))


@book(f"{_REFS} select doc, name as identifier, role, outcome, count(*) as n from r where role in ('definition', 'citation') group by all")
def citation_resolve(spark, d):
    """Identifiers defined, defined again, resolved, dangling, or of a scheme that nothing defines."""
    found = _resolved(spark, d).where("role in ('definition', 'citation')")
    return found.groupBy("doc", F.col("name").alias("identifier"), "role", "outcome").agg(F.count("*").alias("n"))


@book(f"{_REFS} select doc, name, role, outcome from r where role in ('note', 'note citation')")
def footnote_resolve(spark, d):
    return _resolved(spark, d).where("role in ('note', 'note citation')").select("doc", "name", "role", "outcome")


_FIRST = "date_diff('day', date '1970-01-01', make_date({0}, 1, 1))"
_LAST = "date_diff('day', date '1970-01-01', make_date({0}, 12, 31))"


@book(f"""{_REFS}, f as (select *, {_id('name')} subject, {_id('doc')} source from r)
 select subject, 1001 as predicate, source as object, null::varchar as object_text, {_FIRST.format('y')} as from_day, {_LAST.format('y')} as to_day, source, heading, line, 65536 as confidence_raw from f where outcome = 'defined'
 union all select subject, 1003, null, text, {_FIRST.format('y')}, {_LAST.format('y')}, source, heading, line, 65536 from f where outcome = 'defined' union all select subject, 1002, source, null, 0, 0, source, heading, line, 65536 from f where outcome = 'resolved'""")
def ingest_markdown(spark, d):
    return markdown.facts(_resolved(spark, d))


@book(f"""{_REFS} select count(*) filter (role = 'definition' and outcome = 'defined') as definitions, count(*) filter (role = 'citation') as citations, count(*) filter (role = 'citation' and outcome = 'dangling') as dangling, count(*) filter (role = 'citation' and outcome = 'noise') as unknown_scheme,
 count(*) filter (outcome = 'duplicate') as duplicates, count(*) filter (role = 'note') as footnotes, count(*) filter (role = 'note citation' and outcome <> 'noise') as footnote_citations, count(*) filter (role = 'note citation' and outcome = 'dangling') as dangling_footnotes,
 count(*) filter (role = 'note citation' and outcome = 'noise') as footnote_noise, (select name from r where outcome = 'dangling' order by doc, line, name limit 1) as first_dangling, (select name from r where outcome = 'duplicate' order by doc, line, name limit 1) as first_duplicate,
 (select 7 * count(*) from b) as lines, (select 2 * count(*) from b) as headings, (select count(*) from b where y <> 0) as dated, (select count(*) from b) as documents from r""")
def ingest_report(spark, d):
    notes = _notes(spark, d)
    return markdown.report(notes, markdown.lines(notes), _resolved(spark, d))


@book(f"""{_REFS}, c as (select name, count(*) citations, count(distinct doc) documents from r where outcome = 'resolved' group by name)
 select name, doc as defined_in, text, coalesce(citations, 0) as citations, coalesce(documents, 0) as documents from r left join c using (name) where outcome = 'defined'""")
def define(spark, d):
    """Each name with the words that define it, where, and how often it is cited."""
    return markdown.definitions(_resolved(spark, d))


@book(f"{_ROWS} select doc, 7 as lines, 2 as headings, 2 as chapters, case when y <> 0 then 5 else 0 end as dated from b")
def heading_state(spark, d):
    """The running heading, chapter and year of each line outside of fences, summed up by document."""
    state = markdown.lines(_notes(spark, d))
    return state.groupBy("doc").agg(F.count("*").alias("lines"), F.max("heading").alias("headings"), F.max("chapter").alias("chapters"), F.count_if(F.col("year") != 0).alias("dated"))


@book(f"{_ROWS} select doc, line, 0 as part, case when line < 9 then 1 else 2 end as section from b, unnest([1, 2, 3, 4, 8, 9, 10]) x(line)")
def line_locus(spark, d):
    """The position of each line of the notes: no part, its heading, its number."""
    at = t.line_locus(F.col("heading"), F.col("line"))
    return markdown.lines(_notes(spark, d)).select("doc", at.alias("l")).select("doc", "l.line", "l.part", "l.section")


# Reports: findings, the sources they rest on, orphans and sources that could not be read.


def _reports(spark, d):
    e = F.col("entry_id")
    s = lambda c: c.cast("string")
    lines = [
        F.concat(F.lit("# Run "), s(e)), F.lit(""), F.concat(F.lit("*A run — 2026-01-0"), s(1 + e % 9), F.lit(" 10:00 — notes*")), F.lit(""), F.lit("## Findings"), F.lit(""), F.concat(F.lit("- [S1] [S2] Claim "), s(e % 40), F.lit(" holds.")),
        F.concat(F.lit("- [S1] [S9] Claim "), s(e % 40 + 100), F.lit(" holds.")), F.lit(""), F.lit("## Sources"), F.lit(""), F.concat(F.lit("- [S1] Title "), s(e), F.lit(" — <https://example.org/"), s(e % 300), F.lit("> (arxiv) ✓")),
        F.concat(F.lit("- [S2] Other — <https://example.net/"), s(e % 77), F.lit("> (github) ✗")), F.concat(F.lit("- [S3] ~~https://example.org/blocked/"), s(e), F.lit("~~ (failed)")), F.lit(""), F.lit("## Limits"), F.lit(""), F.lit("- [S1] not read here"),
    ]
    return _rows(spark, d).select("doc", F.concat_ws("\n", *lines).alias("body"))


_RUNS = _ROWS + """, u as (select doc, 'https://example.org/' || (entry_id % 300) u1, 'https://example.net/' || (entry_id % 77) u2, 'https://example.org/blocked/' || entry_id u3, 'Claim ' || (entry_id % 40) || ' holds.' f1, 'Claim ' || (entry_id % 40 + 100) || ' holds.' f2, 'Run ' || entry_id topic from b),
 o as (select doc, 6 line, 'S1' tag, f1 finding, u1 url, 42598 confidence_raw from u union all select doc, 6, 'S2', f1, u2, 32768 from u union all select doc, 7, 'S1', f2, u1, 42598 from u union all select doc, 7, 'S9', f2, null, 22938 from u)"""


@book(f"{_RUNS} select doc, line, tag, finding, url, case when url is not null then {_id(chr(117) + chr(114) + chr(108))} end as source, confidence_raw, url is null as orphan from o")
def finding_source_join(spark, d):
    return research.rests_on(_reports(spark, d))


@book(f"{_RUNS} select doc, line, list_sort(list(tag)) tags from o group by doc, line".replace("list_sort(list(tag)) tags", "array_to_string(list_sort(list(tag)), ',') as tags"))
def source_tag(spark, d):
    found = research.bullets(_reports(spark, d)).where("section = 'findings'")
    return found.select("doc", "line", F.concat_ws(",", F.array_sort(t.source_tags(F.col("text")))).alias("tags"))


@book(f"{_ROWS} select doc, line, case when line < 8 then 'findings' when line < 14 then 'sources' else 'other' end as section from b, unnest([6, 7, 11, 12, 13, 17]) x(line)")
def section_state(spark, d):
    """The section that each bullet of a report stands in."""
    return research.bullets(_reports(spark, d)).select("doc", "line", "section")


@book(f"""{_RUNS} select doc, 'S1' as tag, 'Title ' || entry_id as title, u1 as url, 'arxiv' as provider, true as reachable, true as readable from u join b using (doc) union all select doc, 'S2', 'Other', u2, 'github', false, true from u union all select doc, 'S3', null, u3, null, false, false from u""")
def source_line(spark, d):
    return research.sources(_reports(spark, d))


_YEAR_2026 = "20454 as from_day, 20818 as to_day"


@book(f"""{_RUNS}, k as (select *, {_id('doc')} dk from u), l as (select dk, unnest([u1, u2, u3]) url, unnest([true, false, false]) reachable from k), x as (select o.*, {_id('finding')} fk, {_id('o.url')} uk, {_id('doc')} dk from o where url is not null), ll as (select *, {_id('url')} uk from l)
 select distinct subject, predicate, object, object_text, {_YEAR_2026}, source, confidence_raw from (
 select fk as subject, 1101 as predicate, dk as object, null::varchar as object_text, dk as source, 65536 as confidence_raw from x union all select fk, 1102, uk, null, uk, confidence_raw from x union all select fk, 1103, null, finding, dk, 65536 from x
 union all select uk, 1104, null, url, dk, 65536 from ll union all select uk, 1002, dk, null, dk, 65536 from ll union all select uk, 1106, dk, null, dk, 65536 from ll where reachable union all select dk, 1105, null, topic, dk, 65536 from k)""")
def ingest_research(spark, d):
    return research.facts(_reports(spark, d))


@book(f"""{_RUNS}, s as (select distinct finding, {_id('url')} source from o where url is not null), n as (select finding, count(*) - 1 n from s group by finding) select source, max(n) as agreements from s join n using (finding) group by source""")
def research_agreements(spark, d):
    return research.agreements(_reports(spark, d))


@book(f"{_ROWS} select 2 * count(*) as findings, count(*) as orphans, 3 * count(*) as sources, count(*) as unreadable, count(*) as reachable, count(*) as dated from b")
def research_report(spark, d):
    return research.tally(_reports(spark, d))


# TEI works: a passage with an address and one without, names with and without keys, dates.


def _works(spark, d):
    e = F.col("entry_id")
    s = lambda c: c.cast("string")
    when = F.when(F.col("year_from") != 0, F.concat(F.lit(' when="'), F.lpad(s(F.col("year_from")), 4, "0"), F.lit('-05"'))).otherwise("")
    body = [
        F.lit(f'<TEI xmlns="{files.TEI_NAMESPACE}"><teiHeader><fileDesc><titleStmt><title>'), _escaped(F.col("title")), F.lit("</title><author>"), _escaped(F.coalesce("creator", F.lit(""))), F.lit("</author></titleStmt><licence>CC BY "), s(e % 3),
        F.lit('</licence><sourceDesc><title>no</title></sourceDesc></fileDesc><cRefPattern n="section"/><cRefPattern n="book"/></teiHeader><text><body><div type="edition" xml:lang="'), F.when(e % 2 == 0, "lat").otherwise("xx"), F.lit('" n="urn:cts:x:e'), s(e),
        F.lit('"><div type="textpart" n="'), s(e % 50), F.lit('"><div type="textpart" n="2"><p>Text of '), F.col("holder"), F.lit(' &amp; <placeName key="tgn,'), s(e % 99), F.lit('">Roma</placeName> <persName>Someone</persName> <date'), when,
        F.lit('>then</date></p></div><!-- <div type="textpart" n="9"> --><div n="x" type="textpart"><p>Odd</p></div></div></div></body></text></TEI>'),
    ]
    return _rows(spark, d).where("title is not null").select(F.col("doc").alias("canonical"), F.concat(*body).alias("body"))


_TEI = _ROWS + f""", w as (select entry_id, doc, y, 'urn:cts:x:e' || entry_id urn, {_FLAT.format('title')} ti, {_FLAT.format("coalesce(creator, '')")} au, (entry_id % 50) || '.2' path, 'Text of ' || holder || ' & Roma Someone then' pt, 'tgn,' || (entry_id % 99) tk from b where title is not null),
 k as (select *, {_id('urn')} wk from w)"""


@book(f"{_TEI} select doc as canonical, urn, ti as title, nullif(au, '') as author, null::varchar as editor, case when entry_id % 2 = 0 then 'lat' else 'xx' end as language, 'book/section' as scheme, 'CC BY ' || (entry_id % 3) as licence from k")
def read_tei(spark, d):
    works = tei.read_works(_works(spark, d))
    return works.select("canonical", "urn", "title", F.nullif("author", F.lit("")).alias("author"), "editor", "language", "scheme", "licence")


@book(f"{_TEI} select urn, x.n as n, case x.n when 0 then path when 1 then (entry_id % 50) || '.x' else (entry_id % 50)::varchar end as path, x.n <> 1 as addressable, x.n < 2 as leaf, case x.n when 0 then pt when 1 then 'Odd' end as text from k, range(0, 3) x(n)")
def textpart_stack(spark, d):
    found = tei.passages(tei.read_works(_works(spark, d)))
    return found.select("urn", F.col("n").cast("long").alias("n"), "path", "addressable", "leaf", "text")


_MONTH = "date_diff('day', date '1970-01-01', make_date(y, 5, {0}))"


@book(f"{_TEI} select urn, 'place' as kind, tk as key, 'Roma' as name, null::bigint as from_day, null::bigint as to_day from k union all select urn, 'person', null, 'Someone', null, null from k union all select urn, 'date', null, 'then', {_MONTH.format(1)}, {_MONTH.format(31)} from k where y <> 0")
def scan_mentions(spark, d):
    return tei.mentions(tei.read_works(_works(spark, d))).select("urn", "kind", "key", "name", "from_day", "to_day")


@book(f"""{_TEI}, f as (select wk, 1203 p, null::bigint ob, ti tx, null::varchar lo, 0 fd, 0 td from k where ti <> '' union all select wk, 1207, null, 'book/section', null, 0, 0 from k union all select wk, 1201, {_id('au')}, null, null, 0, 0 from k where au <> ''
 union all select wk, 1202, 1, null, null, 0, 0 from k where entry_id % 2 = 0 union all select wk, 1205, null, pt, path, 0, 0 from k union all select wk, 1205, null, 'Odd', null, 0, 0 from k union all select wk, 1208, {_id('tk')}, null, path, 0, 0 from k
 union all select wk, 1209, null, 'Someone', path, 0, 0 from k union all select wk, 1210, wk, null, path, {_MONTH.format(1)}, {_MONTH.format(31)} from k where y <> 0)
 select wk as subject, p as predicate, ob as object, tx as object_text, fd as from_day, td as to_day, wk as source, lo as locus, 65536 as confidence_raw from f""")
def ingest_tei(spark, d):
    return tei.ingest(_works(spark, d), Workspace(spark, "tei"))


@book(f"{_TEI} select 'CC BY ' || (entry_id % 3) as text, min(doc) as covers from k group by 1")
def attribution_dedup(spark, d):
    return tei.attributions(tei.read_works(_works(spark, d)))


@book(f"{_ROWS} select doc, kind from b, unnest(['markdown', 'report', 'tei', 'other']) x(kind) where kind <> 'tei' or title is not null")
def sniff_router(spark, d):
    """Files of all kinds told apart by their first bytes."""
    e = F.col("entry_id").cast("string")
    other = _rows(spark, d).select("doc", F.concat(F.lit("<?xml version='1.0'?><r>"), e, F.lit("</r>")).alias("body"))
    every = _notes(spark, d).unionByName(_reports(spark, d)).unionByName(_works(spark, d).withColumnRenamed("canonical", "doc")).unionByName(other)
    return every.select("doc", files.kind_of(F.col("body")).alias("kind"))


@book("select doc_id, case when starts_with(ltrim(left(text, 4096)), '<') then 'other' when regexp_matches(left(text, 4096), '(?m)^\\*[^*\\n]*\\b([0-9]{4})-([0-9]{2})-([0-9]{2})\\b[^*\\n]*\\*\\s*$') then 'report' else 'markdown' end as kind from documents where text is not null and not contains(left(text, 4096), 'http://www.tei-c.org/ns/1.0')")
def looks_like(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", files.kind_of(F.col("text")).alias("kind"))


@book("select fact_id, subject, predicate, object_ref, from_day, to_day, source_ref, confidence_raw, locus from facts where source_ref in (select source_id from fact_sources)")
def image_round_trip(spark, d):
    """An image written, opened with its checks and read back."""
    sources = table(spark, d, "fact_sources")
    known = sources.select(F.col("source_id").alias("source_ref")).distinct()
    kept = table(spark, d, "facts").drop("recorded_at").join(known, "source_ref", "left_semi")
    path = Workspace(spark, "image").root
    write_image(path, facts=kept, sources=sources)
    return Image(spark, path).section("facts").select("fact_id", "subject", "predicate", "object_ref", "from_day", "to_day", "source_ref", "confidence_raw", "locus")


#: The corpus that two builds are compared by: what each source says of the realm, and how.
PARITY_SOURCES = [(1, 3, "chronicler", 40, "urn:cts:parityLit:chronicle"), (2, 1, "osteology", None, None), (3, 0, "charter", 0, None), (4, 2, "survey", None, None)]
PARITY_FACTS = [("king", "died-of", "battle", 1), ("king", "died-of", "dysentery", 2), ("capital", "exists", "true", 3), ("outpost", "exists", "true", 4), ("capital", "exists", "true", 1)]


@book(f"select {_id('s')} as subject, {_id('p')} as predicate, {_id('o')} as object_ref, src::bigint as source_ref, case when p = 'died-of' and src = 1 then '3.12.412' end as locus from (values {', '.join(str(f) for f in PARITY_FACTS)}) v(s, p, o, src)")
def bake_parity(spark, d):
    """The small corpus baked twice: both images hold the same, in the same order."""
    facts = spark.createDataFrame(PARITY_FACTS, "s string, p string, o string, source_ref long")
    named = facts.select(*[t.name_identifier(F.col(c)).alias(n) for c, n in (("s", "subject"), ("p", "predicate"), ("o", "object_ref"))], "source_ref", F.when((F.col("p") == "died-of") & (F.col("source_ref") == 1), "3.12.412").alias("locus"))
    rows = named.withColumn("from_day", F.lit(0))
    sources = spark.createDataFrame(PARITY_SOURCES, "source_id long, source_kind int, source_name string, years_after int, document string")
    words = facts.select(F.explode(F.array("s", "p", "o")).alias("text")).distinct().select(t.name_identifier(F.col("text")).alias("id"), "text")
    root, opened = Workspace(spark, "parity").root, []
    for build in ("first", "second"):
        write_image(f"{root}/{build}", facts=rows, sources=sources, vocabulary=words)
        opened.append(Image(spark, f"{root}/{build}"))
    if opened[0].manifest != opened[1].manifest:
        raise AssertionError("two builds differ")
    return opened[0].section("facts").drop("from_day")
