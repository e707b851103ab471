"""Queries about facts, sources and positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.functions import dates
from annalist.functions.dates import first_day_of_year, last_day_of_year
from annalist.operators import facts as ask
from annalist.operators import folds, order, resolve
from annalist.operators.facts import FactQuery
from annalist.storage import table
from annalist.plans.book import Book

book = Book()
SHOWN = ["fact_id", "subject", "predicate", "object_ref", "from_day", "to_day", "source_ref", "confidence_raw", "locus"]
_SHOWN = ", ".join(SHOWN)
_BAKED = ", ".join(f"{c} asc nulls first" for c in ask.BAKED)
_FIRM = f"confidence_raw desc nulls last, {_BAKED}"
#: What the queries ask: a span of the fifth century BCE, a predicate, a floor, a source.
FROM, TO, PREDICATE, LEAST, SOURCE = -902580, -866057, 1202, 45000, 4
_SPAN = f"to_day >= {FROM} and from_day <= {TO}"


def facts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "facts")


def sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fact_sources")


def sources_with_documents(spark: SparkSession, d: str) -> DataFrame:
    """Each source with a document of its own: the work of the document of its number, or that document itself."""
    own = table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.coalesce("work_urn", F.concat(F.lit("document "), F.col("doc_id").cast("string"))).alias("document"))
    return sources(spark, d).join(own, "source_id", "left")


def works(spark: SparkSession, d: str) -> DataFrame:
    """The works that documents belong to; one of which a translation is held is a translation."""
    rendered = F.coalesce(F.col("source") == "translations", F.lit(False))
    return table(spark, d, "documents").where("work_urn is not null").select(F.col("work_urn").alias("document"), rendered.alias("translation"))


def loci(spark: SparkSession, d: str) -> DataFrame:
    """Positions: the passages of the documents by their number."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("locus_id"), F.col("work_urn").alias("document"), "passage")


def _asked(spark: SparkSession, d: str, query: FactQuery) -> DataFrame:
    return facts(spark, d).where(query.condition()).select(*SHOWN)


@book(f"select {_SHOWN} from facts where {_SPAN}")
def fact_match(spark, d):
    return _asked(spark, d, FactQuery().during(FROM, TO))


@book(f"select {_SHOWN} from facts where subject = 1000272")
def fact_about(spark, d):
    return _asked(spark, d, FactQuery(subject=1000272))


@book(f"select {_SHOWN} from facts where predicate = {PREDICATE}")
def fact_asserting(spark, d):
    return _asked(spark, d, FactQuery(predicate=PREDICATE))


@book(f"select {_SHOWN} from facts where source_ref = {SOURCE}")
def fact_according_to(spark, d):
    return _asked(spark, d, FactQuery(source=SOURCE))


@book(f"select {_SHOWN} from facts where confidence_raw >= {LEAST} and predicate = {PREDICATE}")
def fact_at_least(spark, d):
    return _asked(spark, d, FactQuery(predicate=PREDICATE, least=LEAST))


@book(f"select {_SHOWN} from facts where from_day <= {FROM} and to_day >= {FROM}")
def fact_on_day(spark, d):
    return _asked(spark, d, FactQuery().on_day(FROM))


@book(f"select predicate, count(*) as n from facts where {_SPAN} group by predicate")
def fact_count(spark, d):
    return facts(spark, d).where(FactQuery().during(FROM, TO).condition()).groupBy("predicate").agg(F.count("*").alias("n"))


@book(f"select {_SHOWN}, (select count(*) from facts where predicate = {PREDICATE} and {_SPAN}) as matched, (select count(*) > 16 from facts where predicate = {PREDICATE} and {_SPAN}) as truncated from facts where predicate = {PREDICATE} and {_SPAN} order by {_BAKED} limit 16")
def fact_page(spark, d):
    return ask.page(facts(spark, d), FactQuery(predicate=PREDICATE).during(FROM, TO)).select(*SHOWN, "matched", "truncated")


@book(f"select {_SHOWN} from facts where {_SPAN} order by {_FIRM} limit 1")
def fact_best(spark, d):
    return ask.best(facts(spark, d), FactQuery().during(FROM, TO)).select(*SHOWN)


@book(f"with r as (select {_SHOWN}, row_number() over (partition by subject order by {_FIRM}) n from facts where subject is not null) select {_SHOWN} from r where n = 1")
def fact_best_by_subject(spark, d):
    """The firmest fact of each subject: the arg-max combines on the map side, so a large subject does no harm."""
    order = F.struct(F.coalesce(-F.col("confidence_raw"), F.lit(2**62)).alias("c"), *ask.BAKED)
    top = facts(spark, d).where("subject is not null").groupBy("subject").agg(F.min_by(F.struct(*SHOWN), order).alias("f"))
    return top.select("f.*")


@book(f"select {_SHOWN}, row_number() over (order by {_BAKED}) as place from facts")
def baked_order(spark, d):
    """All facts with their places in kept order."""
    kept = order.numbered(facts(spark, d).select(*ask.BAKED), [F.col(c).asc_nulls_first() for c in ask.BAKED])
    return kept.select(*SHOWN, "place")


_SECTIONS = {"facts": "fact_id, recorded_at", "fact_sources": "source_id", "candidates": "left_id, right_id, score_raw, evidence, recorded_at", "documents": "doc_id", "catalogue": "entry_id", "mentions": "mention_id"}


@book(" union all ".join(f"select '{t}' as section, place, id from (select {o.split(',')[0]} id, row_number() over (order by {', '.join(c.strip() + ' asc nulls first' for c in o.split(','))}) place from {t}) where place % 50 = 1" for t, o in _SECTIONS.items()))
def record_at(spark, d):
    """Every fiftieth record of each section, read by its place."""
    every = None
    for name, by in _SECTIONS.items():
        columns = [c.strip() for c in by.split(",")]
        placed = order.numbered(table(spark, d, name).select(*columns), [F.col(c).asc_nulls_first() for c in columns])
        rows = placed.where("place % 50 = 1").select(F.lit(name).alias("section"), "place", F.col(columns[0]).alias("id"))
        every = rows if every is None else every.unionByName(rows)
    return every


@book("select doc_id, row_number() over (order by doc_id) as document, row_number() over (order by doc_id) - 1 as text_line from documents")
def append_index(spark, d):
    """Positions as they are given out: documents count from one, lines of text from zero."""
    return order.numbered(table(spark, d, "documents").select("doc_id"), [F.col("doc_id")], "document").withColumn("text_line", F.col("document") - 1)


@book("select fact_id, predicate in (1003, 1103, 1104, 1105, 1203, 1205, 1207) as text_valued from facts")
def text_valued_pred(spark, d):
    return facts(spark, d).select("fact_id", F.col("predicate").isin(ask.TEXT_VALUED).alias("text_valued"))


@book("select fact_id, recorded_at::varchar as at, case when to_day < from_day then 'bad window' when confidence_raw > 65536 then 'bad confidence' else 'ok' end as verdict from facts")
def decode_fact_guard(spark, d):
    verdict = F.when(F.col("to_day") < F.col("from_day"), "bad window").when(F.col("confidence_raw") > ask.FULL, "bad confidence").otherwise("ok")
    at = F.regexp_replace(F.date_format("recorded_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"\.?0+$", "")
    return facts(spark, d).select("fact_id", F.when(F.date_format("recorded_at", "SSSSSS") == "000000", F.date_format("recorded_at", "yyyy-MM-dd HH:mm:ss")).otherwise(at).alias("at"), verdict.alias("verdict"))


@book("select source_id, case when source_kind >= 5 then 'bad kind' else 'ok' end as verdict from fact_sources")
def decode_source_guard(spark, d):
    return sources(spark, d).select("source_id", F.when(F.col("source_kind") >= len(ask.KINDS), "bad kind").otherwise("ok").alias("verdict"))


@book("""select count(*) as facts, count(*) filter (to_day < from_day) as bad_window, count(*) filter (not coalesce(to_day < from_day, false) and confidence_raw > 65536) as bad_confidence,
 (select count(*) from fact_sources) as sources, (select count(*) from fact_sources where source_kind >= 5) as bad_kind from facts""")
def decode_report(spark, d):
    of_sources = sources(spark, d).agg(F.count("*").alias("sources"), F.count_if(F.col("source_kind") >= 5).alias("bad_kind"))
    window = F.coalesce(F.col("to_day") < F.col("from_day"), F.lit(False))
    of_facts = facts(spark, d).agg(F.count("*").alias("facts"), F.count_if(window).alias("bad_window"), F.count_if(~window & (F.col("confidence_raw") > ask.FULL)).alias("bad_confidence"))
    return of_facts.crossJoin(F.broadcast(of_sources))


@book(f"select {_SHOWN} from facts where not coalesce(to_day < from_day, false) and not coalesce(confidence_raw > 65536, false) and coalesce((select any_value(source_kind) from fact_sources where source_id = source_ref) < 5, true)")
def to_history_corpus(spark, d):
    """The facts that decode: no window that ends before it begins, no confidence above one, no source of an unknown kind."""
    bad = sources(spark, d).where(F.col("source_kind") >= len(ask.KINDS)).select(F.col("source_id").alias("source_ref"))
    sound = ~F.coalesce(F.col("to_day") < F.col("from_day"), F.lit(False)) & ~F.coalesce(F.col("confidence_raw") > ask.FULL, F.lit(False))
    return facts(spark, d).where(sound).join(bad, "source_ref", "left_anti").select(*SHOWN)


def _word(c: str) -> str:
    return f"(coalesce({c}, 0)::bigint & 4294967295)"


@book(f"select fact_id, array_to_string([{', '.join(map(_word, folds.FIELDS))}], ' ') as words from facts where " + " and ".join(f"coalesce({c}, 0) between {'-2147483648 and 2147483647' if c in ('from_day', 'to_day') else '0 and 4294967295'}" for c in folds.FIELDS))
def encode_fact(spark, d):
    return facts(spark, d).select("fact_id", ask.encoded_fact().alias("w")).where("w is not null").select("fact_id", F.concat_ws(" ", F.col("w").cast("array<string>")).alias("words"))


@book(f"select source_id, array_to_string([{', '.join(map(_word, ('source_id', 'source_kind', 'composed_from', 'agreements')))}], ' ') as words from fact_sources")
def encode_source(spark, d):
    return sources(spark, d).select("source_id", ask.encoded_source().alias("w")).where("w is not null").select("source_id", F.concat_ws(" ", F.col("w").cast("array<string>")).alias("words"))


@book("select fact_id, source_ref, source_name, source_kind from facts left join fact_sources on source_id = source_ref")
def source_by_id(spark, d):
    named = sources(spark, d).select(F.col("source_id").alias("source_ref"), "source_name", "source_kind")
    return facts(spark, d).select("fact_id", "source_ref").join(named, "source_ref", "left")


@book("select fact_id, coalesce(source_name, '#' || source_ref) as display from facts left join fact_sources on source_id = source_ref where source_ref is not null")
def display_name(spark, d):
    named = sources(spark, d).select(F.col("source_id").alias("source_ref"), "source_name")
    joined = facts(spark, d).where("source_ref is not null").select("fact_id", "source_ref").join(named, "source_ref", "left")
    return joined.select("fact_id", F.coalesce("source_name", F.concat(F.lit("#"), F.col("source_ref").cast("string"))).alias("display"))


_CITED = """with w as (select work_urn, bool_or(coalesce(source = 'translations', false)) tr from documents where work_urn is not null group by work_urn),
 c as (select f.*, source_id, source_name, source_kind, composed_from, coalesce(pl.work_urn, own.work_urn) document, coalesce(a.tr, o.tr, false) translation, pl.passage from facts f join fact_sources on source_id = source_ref
 left join documents pl on pl.doc_id = locus left join documents own on own.doc_id = source_id left join w a on a.work_urn = pl.work_urn left join w o on o.work_urn = own.work_urn)"""


def _cited(spark: SparkSession, d: str) -> DataFrame:
    return ask.cite(facts(spark, d), sources_with_documents(spark, d), loci(spark, d), works(spark, d))


@book(f"{_CITED} select fact_id, source_id, source_name, document, translation, passage from c")
def cite(spark, d):
    return _cited(spark, d).select("fact_id", F.col("source_ref").alias("source_id"), "source_name", "document", "translation", "passage")


@book(f"{_CITED} select {_SHOWN}, source_name, document, passage from c where {_SPAN}")
def span_cited(spark, d):
    """The facts of a span of years with their source, document and passage."""
    asked = facts(spark, d).where(FactQuery().during(FROM, TO).condition())
    return ask.cite(asked, sources_with_documents(spark, d), loci(spark, d), works(spark, d)).select(*SHOWN, "source_name", "document", "passage")


_RENDER = """coalesce(source_name, 'source#' || source_id) || ' (' || case source_kind when 0 then 'notarial' when 1 then 'archaeology' when 2 then 'administrative' when 3 then 'chronicle' when 4 then 'panegyric' else 'unknown' end
 || case when nullif(composed_from, 0) is null or from_day is null then ', distance unknown)' else ', +' || greatest(0, (composed_from - from_day) // 365) || 'y)' end || coalesce(' — ' || document || case when translation then ' [translation]' else '' end, '') || coalesce(' ' || passage, '')"""


@book(f"{_CITED} select fact_id, {_RENDER} as citation from c")
def render_citation(spark, d):
    composed = sources(spark, d).select(F.col("source_id").alias("source_ref"), F.nullif("composed_from", F.lit(0)).alias("composed"))
    cited = _cited(spark, d).join(composed, "source_ref")
    years = F.when(F.col("from_day").isNotNull(), F.greatest(F.lit(0), F.expr("(composed - from_day) div 365")))
    text = ask.render(F.col("source_ref"), F.col("source_name"), F.col("source_kind"), F.when(F.col("composed").isNotNull(), years), F.col("document"), F.col("passage"), F.col("translation"))
    return cited.select("fact_id", text.alias("citation"))


_DEFECT = """case when s.source_id is null then 'unsourced' when coalesce(locus, 0) = 0 then 'unlocated' when doc_id is null then 'dangling locus' when work_urn is null then 'dangling document' else 'sound' end"""
_AUDIT = f"""with d as (select {_DEFECT} defect from facts left join fact_sources s on s.source_id = source_ref left join documents on doc_id = locus),
 o as (select count(*) filter (source_name is null) unnamed, count(*) filter (doc_id is not null and work_urn is null) dangling from fact_sources left join documents on doc_id = source_id),
 a as (select count(*) facts, count(*) filter (defect = 'unsourced') unsourced, count(*) filter (defect = 'unlocated') unlocated, count(*) filter (defect = 'dangling locus') dangling_locus,
 count(*) filter (defect = 'dangling document') + any_value(dangling) dangling_document, any_value(unnamed) unnamed from d, o)"""


def _audit(spark: SparkSession, d: str) -> DataFrame:
    return ask.audit(facts(spark, d), sources_with_documents(spark, d), loci(spark, d), works(spark, d).select("document").distinct())


@book(f"{_AUDIT} select facts, unsourced, unlocated, dangling_locus, dangling_document, unnamed, unsourced + dangling_locus + dangling_document = 0 as sound from a")
def provenance_audit(spark, d):
    return _audit(spark, d)


@book(f"select {_DEFECT} as defect, count(*) as n from facts left join fact_sources s on s.source_id = source_ref left join documents on doc_id = locus group by 1")
def defects(spark, d):
    found = ask.defects(facts(spark, d), sources(spark, d), loci(spark, d), works(spark, d).select("document").distinct())
    return found.groupBy("defect").agg(F.count("*").alias("n"))


def _fold(words: str) -> str:
    return f"list_reduce(list_prepend(2166136261::bigint, {words}), lambda h, x: (xor(h, x) * 16777619) & 4294967295)"


def _bytes(text: str) -> str:
    return f"list_transform(range(0, octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), (2 * i + 1)::bigint, 2))::bigint)"


@book(f"{_AUDIT} select {_fold('[facts, unsourced, unlocated, dangling_locus, dangling_document, unnamed]')} as fold from a")
def fold_audit(spark, d):
    return folds.fold_audit(_audit(spark, d))


_FACT_WORDS = f"[{', '.join(map(_word, folds.FIELDS))}]"
_PAGE = f"p as (select *, row_number() over (order by {_BAKED}) n from facts where predicate = {PREDICATE} and {_SPAN}), h as (select flatten(list({_FACT_WORDS} order by n)) w, count(*) c from p where n <= 16), m as (select count(*) matched from p)"


@book(f"with {_PAGE} select {_fold('list_concat(coalesce(w, []), [c, matched, (matched > 16)::bigint])')} as fold from h, m")
def fold_page(spark, d):
    return folds.fold_page(ask.page(facts(spark, d), FactQuery(predicate=PREDICATE).during(FROM, TO)))


_FACT_FOLDS = f"f as (select *, (row_number() over (order by {_BAKED}) - 1) n from facts), ff as (select n // {folds.CHUNK} chunk, count(*) facts, {_fold(f'flatten(list({_FACT_WORDS} order by n))')} fold from f group by 1)"


@book(f"with {_FACT_FOLDS} select chunk, facts, fold from ff")
def fold_facts(spark, d):
    return folds.fold_facts(facts(spark, d))


_NAMES = f"w as (select distinct work_urn name from documents where work_urn is not null), i as (select {_fold(_bytes('name'))} id, name from w), v as (select id, name, row_number() over (order by id, name) - 1 n from i)"
_NAME_FOLDS = f"{_NAMES}, b as (select n, list_concat([id], {_bytes('name')}, [octet_length(encode(name))::bigint]) b from v), vf as (select n // {folds.CHUNK} chunk, count(*) \"names\", {_fold('flatten(list(b order by n))')} fold from b group by 1)"


def names(spark: SparkSession, d: str) -> DataFrame:
    """The names of works by their identity."""
    from annalist.functions.texts import name_identifier

    return table(spark, d, "documents").where("work_urn is not null").select(F.col("work_urn").alias("name")).distinct().withColumn("id", name_identifier(F.col("name")))


@book(f'with {_NAME_FOLDS} select chunk, "names", fold from vf')
def fold_vocabulary(spark, d):
    return folds.fold_vocabulary(names(spark, d))


@book(f"select doc_id, {_fold('list_concat(' + _bytes('text') + ', [case when text = chr(0) then 0 else len(string_split(text, chr(10))) end, octet_length(encode(text))])')} as fold from documents where text <> ''")
def text_fold(spark, d):
    return table(spark, d, "documents").where("text <> ''").select("doc_id", folds.fold_text(F.col("text")).alias("fold"))


@book(f"""{_AUDIT}, {_FACT_FOLDS}, {_NAME_FOLDS}, {_PAGE.replace('h as', 'hh as').replace('p as', 'pp as').replace('from p', 'from pp')},
 parts as (select 'audit' part, {_fold('[facts, unsourced, unlocated, dangling_locus, dangling_document, unnamed]')} fold from a union all select 'facts', {_fold('list(fold order by chunk)')} from ff
 union all select 'vocabulary', {_fold('list(fold order by chunk)')} from vf union all select 'page', {_fold('list_concat(coalesce(w, []), [c, matched, (matched > 16)::bigint])')} from hh, m)
 select part, fold from parts union all select 'state', {_fold('list(fold order by part)')} from parts""")
def fold_state(spark, d):
    """The folds of audit, facts, page and vocabulary, and the fold of these: what two corpora are compared by."""
    parts = None
    for name, fold in (("audit", fold_audit(spark, d)), ("facts", folds.fold_of_folds(fold_facts(spark, d), "chunk")), ("page", fold_page(spark, d)), ("vocabulary", folds.fold_of_folds(fold_vocabulary(spark, d), "chunk"))):
        row = fold.select(F.lit(name).alias("part"), "fold")
        parts = row if parts is None else parts.unionByName(row)
    return parts.unionByName(folds.fold_of_folds(parts, "part").select(F.lit("state").alias("part"), "fold"))


@book("select source_kind, count(*) as facts, count(distinct subject) as subjects, sum(confidence_raw)::bigint as confidence from facts join fact_sources on source_id = source_ref group by source_kind")
def facts_by_kind(spark, d):
    kinds = sources(spark, d).select(F.col("source_id").alias("source_ref"), "source_kind")
    # Two levels, so that no kind gathers its subjects in one task.
    by = facts(spark, d).join(kinds, "source_ref").groupBy("source_kind", "subject").agg(F.count("*").alias("n"), F.sum("confidence_raw").alias("c"))
    return by.groupBy("source_kind").agg(F.sum("n").alias("facts"), F.count("subject").alias("subjects"), F.sum("c").alias("confidence"))


@book("""with t as (select distinct fact_id, subject, object_ref, from_day, to_day from facts where predicate = 1202 and subject is not null and to_day >= from_day)
 select distinct a.subject, a.fact_id as fact_a, b.fact_id as fact_b from t a join t b on a.subject = b.subject and a.fact_id < b.fact_id and a.object_ref <> b.object_ref and a.from_day <= b.to_day and b.from_day <= a.to_day""")
def timeline_contradictions(spark, d):
    return ask.contradictions(facts(spark, d), 1202)


_FUSED = """o as (select subject, object_ref, source_ref, max(confidence_raw) c from facts where predicate = 1202 and subject is not null and confidence_raw between 0 and 65536 group by all),
 l as (select subject, object_ref, list_sort(list(c)) cs, count(*) n from o group by all),
 fu as (select subject, object_ref, 65536 - list_reduce(list_prepend(65536::bigint, cs), lambda r, c: r * (65536 - c) // 65536) as fused, n as sources from l)"""


@book(f"with {_FUSED} select subject, object_ref, fused, sources from fu")
def q16_fuse(spark, d):
    return ask.fused(facts(spark, d), 1202)


@book(f"""with {_FUSED}, t as (select distinct fact_id, subject, object_ref, from_day, to_day from facts where predicate = 1202 and subject is not null and to_day >= from_day),
 x as (select distinct a.subject, a.object_ref a, b.object_ref b from t a join t b on a.subject = b.subject and a.fact_id <> b.fact_id and a.object_ref <> b.object_ref and a.from_day <= b.to_day and b.from_day <= a.to_day),
 weak as (select distinct x.subject, a object_ref from x join fu p on p.subject = x.subject and p.object_ref = a join fu q on q.subject = x.subject and q.object_ref = b where q.fused > p.fused or (q.fused = p.fused and b < a))
 select fu.subject, fu.object_ref, fused, sources, weak.subject is not null as contradicted, case when weak.subject is not null then fused * 32768 // 65536 else fused end as standing from fu left join weak on weak.subject = fu.subject and weak.object_ref = fu.object_ref""")
def timeline(spark, d):
    return ask.timeline(facts(spark, d), 1202)


@book("select fact_id, from_day, year(date '1970-01-01' + from_day) as y from facts where from_day is not null")
def year_of_day(spark, d):
    return facts(spark, d).where("from_day is not null").select("fact_id", "from_day", dates.year_of_day(F.col("from_day")).cast("long").alias("y"))


@book("select distinct entry_id, year_from, date_diff('day', date '1970-01-01', make_date(year_from, 1, 1)) as first, date_diff('day', date '1970-01-01', make_date(year_from, 12, 31)) as last from catalogue where year_from <> 0")
def days_of_year(spark, d):
    y = F.col("year_from")
    return table(spark, d, "catalogue").where("year_from <> 0").select("entry_id", "year_from", first_day_of_year(y).alias("first"), last_day_of_year(y).alias("last"))


@book("select predicate, count(*) as tellings, count(distinct fact_id) as n, count(distinct source_ref) as sources, count(distinct subject) as subjects from facts group by predicate")
def tellings(spark, d):
    return facts(spark, d).groupBy("predicate").agg(F.count("*").alias("tellings"), F.countDistinct("fact_id").alias("n"), F.countDistinct("source_ref").alias("sources"), F.countDistinct("subject").alias("subjects"))


@book("""select (select count(*) from (select distinct title, creator from catalogue where title is not null)) as works, (select count(distinct creator) from catalogue) as authors, (select count(distinct holder) from catalogue) as holders,
 (select count(distinct source_ref) from facts) as sources""")
def works_count(spark, d):
    """Works (title and creator), authors, holders and sources, each once. Distinct rows are counted after they are told apart in parallel."""
    rows = table(spark, d, "catalogue")
    counted = None
    for name, each in (("works", rows.where("title is not null").select("title", "creator")), ("authors", rows.where("creator is not null").select("creator")), ("holders", rows.where("holder is not null").select("holder")), ("sources", facts(spark, d).where("source_ref is not null").select("source_ref"))):
        n = each.distinct().agg(F.count("*").alias(name))
        counted = n if counted is None else counted.crossJoin(F.broadcast(n))
    return counted


@book("select source_kind, count(*) as n from fact_sources where source_name is null group by 1")
def unnamed_sources(spark, d):
    return sources(spark, d).where("source_name is null").groupBy("source_kind").agg(F.count("*").alias("n"))


#: Sources of one name are one witness, and so are those that the same thing rests on (predicate 1102), of which the least is the original.
_DERIVED = """dv as (select source_ref derived, min(source_ref) over (partition by object_ref) original from (select distinct source_ref, object_ref from facts where predicate = 1102 and source_ref is not null and object_ref is not null and object_ref % 97 = 0))"""
_ROOTS = f"""with recursive {_DERIVED}, e as (select derived a, original b from dv where derived in (select source_id from fact_sources) and original in (select source_id from fact_sources)
 union select a.source_id, b.source_id from fact_sources a join fact_sources b on lower(a.source_name) = lower(b.source_name)), u as (select a, b from e union select b, a from e union select source_id, source_id from fact_sources),
 reach(a, b) as (select a, b from u union select r.a, u.b from reach r join u on r.b = u.a), rt as (select a source_id, min(b) witness from reach group by a)"""
_WITNESSED = f"""{_ROOTS}, told as (select distinct predicate, subject, object_ref, source_ref source_id from facts where subject is not null and object_ref is not null and predicate is not null), tw as (select * from told join rt using (source_id)),
 cl as (select predicate, subject, object_ref, count(*) sources, count(distinct witness) witnesses from tw group by all)"""


def _roots(spark: SparkSession, d: str) -> DataFrame:
    # A reader states derivations; here every ninety-seventh object stands for a text that its tellers copied.
    copied = facts(spark, d).where("predicate = 1102 and object_ref % 97 = 0 and source_ref is not null").select(F.col("source_ref").alias("derived"), "object_ref").distinct()
    first = copied.groupBy("object_ref").agg(F.min("derived").alias("original"))
    return resolve.witnesses(sources(spark, d), "source_name", copied.join(first, "object_ref").select("derived", "original"))


def _agreements(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    told = facts(spark, d).where("subject is not null and object_ref is not null and predicate is not null").select(F.col("source_ref").alias("source_id"), F.struct("predicate", "subject", "object_ref").alias("claim"))
    return resolve.agreements(told, _roots(spark, d))


@book(f"{_ROOTS} select source_id, witness from rt")
def witness_count(spark, d):
    """The witness that each source is: sources of one reference, and what is derived from another, are one."""
    return _roots(spark, d)


@book(f"{_WITNESSED} select rt.source_id, rt.witness, coalesce(max(witnesses - 1), 0) as agreements from rt left join tw on tw.source_id = rt.source_id left join cl using (predicate, subject, object_ref) group by 1, 2")
def agreements(spark, d):
    """For each source the most other witnesses of one of its claims; claims are predicate, subject, object."""
    return _agreements(spark, d)[0]


@book(f"{_WITNESSED} select (select count(*) from rt) as sources, (select count(distinct witness) from rt) as witnesses, (select count(*) - count(distinct witness) from rt) as collapsed, count(*) as claims, count(*) filter (witnesses > 1) as corroborated, count(*) filter (witnesses = 1 and sources > 1) as inflated from cl")
def count_agreements(spark, d):
    by_source, claims = _agreements(spark, d)
    roots = by_source.groupBy("witness").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("sources"), F.count("*").alias("witnesses")).withColumn("collapsed", F.col("sources") - F.col("witnesses"))
    told = claims.agg(F.count("*").alias("claims"), F.count_if("corroborated").alias("corroborated"), F.count_if("inflated").alias("inflated"))
    return roots.crossJoin(F.broadcast(told))


@book("select fact_id from facts group by fact_id having count(*) > 1")
def dup_refuse(spark, d):
    """Handles that are used more than once, which a strict load refuses."""
    return facts(spark, d).groupBy("fact_id").agg(F.count("*").alias("n")).where("n > 1").select("fact_id")


@book("select fact_id from facts group by fact_id having count(distinct (coalesce(subject, -1), coalesce(predicate, -1), coalesce(object_ref, -1), coalesce(from_day, -999999999), coalesce(to_day, -999999999))) > 1")
def name_collision(spark, d):
    """Handles that stand for two different things."""
    thing = F.struct(*[F.coalesce(F.col(c).cast("long"), F.lit(-(2**40))) for c in ("subject", "predicate", "object_ref", "from_day", "to_day")])
    return facts(spark, d).select("fact_id", thing.alias("t")).distinct().groupBy("fact_id").agg(F.count("*").alias("n")).where("n > 1").select("fact_id")


@book("""select case when exists (select fact_id, subject, object_ref from facts where recorded_at < timestamp '2020-06-01' except all select fact_id, subject, object_ref from facts) then 'differ' else 'contained' end as verdict,
 (select count(*) from (select fact_id, subject, object_ref from facts except all select fact_id, subject, object_ref from facts where recorded_at < timestamp '2020-06-01')) as only_later""")
def corpora_contained(spark, d):
    """Is one corpus within another? Both ways, with repeated rows counted."""
    every = facts(spark, d).select("fact_id", "subject", "object_ref")
    early = facts(spark, d).where("recorded_at < timestamp_ntz '2020-06-01'").select("fact_id", "subject", "object_ref")
    lost = early.exceptAll(every).agg(F.count("*").alias("lost"))
    return every.exceptAll(early).agg(F.count("*").alias("only_later")).crossJoin(F.broadcast(lost)).select(F.when(F.col("lost") > 0, "differ").otherwise("contained").alias("verdict"), "only_later")


@book(f"""with a as (select {_SHOWN}, row_number() over (order by {_BAKED}) place from facts), b as (select {_SHOWN}, row_number() over (order by {_BAKED}) place from facts where not (fact_id = 1500)),
 x as (select place from a full join b using (place) where a.fact_id is distinct from b.fact_id or a.subject is distinct from b.subject or a.predicate is distinct from b.predicate or a.object_ref is distinct from b.object_ref
  or a.from_day is distinct from b.from_day or a.to_day is distinct from b.to_day or a.source_ref is distinct from b.source_ref or a.confidence_raw is distinct from b.confidence_raw or a.locus is distinct from b.locus)
 select 'itself' as other, true as match, null::bigint as first_place union all select 'without one' as other, count(*) = 0 as match, min(place) as first_place from x""")
def corpora_match(spark, d):
    """Two corpora compared field by field in kept order: do they match, and where do they first differ?"""
    kept = [F.col(c).asc_nulls_first() for c in ask.BAKED]
    every = facts(spark, d).select(*ask.BAKED)
    return order.compared(every, every, kept, SHOWN).select(F.lit("itself").alias("other"), "match", "first_place").unionByName(
        order.compared(every, every.where("fact_id <> 1500"), kept, SHOWN).select(F.lit("without one").alias("other"), "match", "first_place")
    )
