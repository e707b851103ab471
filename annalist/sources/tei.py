"""TEI works: identity, passages by their citation path, mentions, dates, and the facts they state. One file is the unit of parsing."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions.dates import tei_window
from annalist.functions.language import tei_language
from annalist.functions.texts import FULL, authority_id, name_identifier
from annalist.functions.markup import Element, attribute, elements, first_text, span, text_of

#: Defaults of what a passage and a name without a key may hold, in bytes; what is cut is marked.
MOST_TEXT_BYTES = 4096
MOST_NAME_BYTES = 64
#: The predicates of the facts.
ATTRIBUTED_TO, WRITTEN_IN, WORK_TITLE, PASSAGE_TEXT, EDITED_BY, SCHEME, NAMES_PLACE, NAMES_PERSON, DATED_HERE = 1201, 1202, 1203, 1205, 1206, 1207, 1208, 1209, 1210
#: What is mentioned, by element, and the attributes that tell a date, by precedence.
MENTIONS = {"placeName": "place", "persName": "person", "date": "date"}
ADDRESS = re.compile(r"[0-9]+(\.[0-9]+){0,2}")
WORK = "canonical string, urn string, title string, author string, editor string, language string, scheme string, licence string, passages array<struct<path: string, depth: int, addressable: boolean, leaf: boolean, text: string, cut: boolean>>, mentions array<struct<path: string, kind: string, key: string, name: string, cut: boolean, from_text: string, to_text: string>>"


def _clip(text: str, most: int) -> tuple[str, bool]:
    raw = text.encode("utf-8")
    return (text, False) if len(raw) <= most else (raw[:most].decode("utf-8", "ignore"), True)


def _date_of(tag: str) -> tuple[str | None, str | None]:
    if attribute(tag, "calendar") or attribute(tag, "datingMethod"):
        return None, None
    when = attribute(tag, "when")
    if when:
        return when, when
    for a, b in (("from", "to"), ("notBefore", "notAfter")):
        low, high = attribute(tag, a), attribute(tag, b)
        if low or high:
            return low or high, high or low
    return None, None


def _mentions(body: str, begin: int, end: int, path: str, most: int) -> list[dict]:
    found, opened = [], []
    for e in elements(body[begin:end]):
        if e.name not in MENTIONS:
            continue
        if e.closing:
            if opened and opened[-1].name == e.name:
                start = opened.pop()
                low, high = _date_of(start.tag) if e.name == "date" else (None, None)
                if e.name != "date" or low:
                    name, cut = _clip(text_of(body, begin + start.end, begin + e.begin), most)
                    found.append({"path": path, "kind": MENTIONS[e.name], "key": attribute(start.tag, "key"), "name": name, "cut": cut, "from_text": low, "to_text": high})
        elif not e.empty:
            opened.append(e)
    return found


def read_work(canonical: str, body: str, most_text: int = MOST_TEXT_BYTES, most_name: int = MOST_NAME_BYTES) -> dict:
    """One work; a textpart without an inner one is a leaf, and only leaves carry text."""
    header = span(body, "teiHeader")
    head = body[header[0] : header[1]] if header else ""
    stated = head.find("<titleStmt")
    named = lambda n: first_text(head, n, stated) if stated >= 0 else None
    edition = next((e for e in elements(body) if e.name == "div" and not e.closing and attribute(e.tag, "type") in ("edition", "translation")), None)
    scheme = [attribute(e.tag, "n") or "" for e in elements(head) if e.name == "cRefPattern" and not e.closing]
    passages, mentions = [], []
    stack: list[tuple[Element, str | None, list]] = []
    for e in elements(body):
        if e.name != "div":
            continue
        if not e.closing:
            part = attribute(e.tag, "type") == "textpart"
            if e.empty:
                continue
            if part:
                for _, n, inner in stack:
                    if n is not None:
                        inner.append(True)
            stack.append((e, attribute(e.tag, "n") or "" if part else None, []))
        elif stack:
            opened, n, inner = stack.pop()
            if n is None:
                continue
            path = ".".join([m for _, m, _ in stack if m is not None] + [n])
            leaf = not inner
            text, cut = _clip(text_of(body, opened.end, e.begin), most_text) if leaf else (None, False)
            passages.append({"path": path, "depth": path.count(".") + 1, "addressable": bool(ADDRESS.fullmatch(path)), "leaf": leaf, "text": text, "cut": cut})
            if leaf:
                mentions += _mentions(body, opened.end, e.begin, path, most_name)
    return {
        "canonical": canonical, "urn": (attribute(edition.tag, "n") if edition else None) or canonical, "title": named("title"), "author": named("author"), "editor": named("editor"),
        "language": attribute(edition.tag, "lang") if edition else None, "scheme": "/".join(reversed([n for n in scheme if n])), "licence": first_text(head, "licence"), "passages": passages, "mentions": mentions,
    }


def read_works(files: DataFrame, most_text: int = MOST_TEXT_BYTES, most_name: int = MOST_NAME_BYTES) -> DataFrame:
    """The works of files (canonical, body) as rows; twins() are what refuses a corpus."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([read_work(c, b or "", most_text, most_name) for c, b in zip(batch["canonical"], batch["body"])])

    works = files.select("canonical", "body").mapInPandas(each, WORK)
    return works


def twins(works: DataFrame) -> DataFrame:
    """URNs that more than one work claims."""
    return works.groupBy("urn").agg(F.count("*").alias("n")).where("n > 1")


def passages(works: DataFrame) -> DataFrame:
    return works.select("canonical", "urn", F.posexplode("passages").alias("n", "p")).select("canonical", "urn", "n", "p.*")


def mentions(works: DataFrame) -> DataFrame:
    """Mentions with the window of days of their dates, outer edges counting."""
    m = works.select("urn", F.explode("mentions").alias("m")).select("urn", "m.*")
    return m.withColumn("from_day", tei_window(F.col("from_text")).getField("from_day")).withColumn("to_day", tei_window(F.col("to_text")).getField("to_day"))


class TwinWorks(ValueError):
    """Two files claim one URN."""


def facts(works: DataFrame) -> DataFrame:
    """subject, predicate, object, object_text, from_day, to_day, source, locus, confidence_raw of all works.

    locus is the path of a passage that has an address, else null: the work as a whole. What a name without a key
    stands for is a line of text, which nothing may be matched on; a date's object is the work, the date its window.
    """
    work = name_identifier(F.col("urn"))
    none, day = F.lit(None).cast("string"), F.lit(0).cast("long")
    rows = works.withColumn("work", work)

    def shape(df: DataFrame, predicate, object_, text, locus=none, first=day, last=day) -> DataFrame:
        return df.select(
            F.col("work").alias("subject"), (F.lit(predicate) if isinstance(predicate, int) else predicate).cast("long").alias("predicate"), object_.cast("long").alias("object"), text.alias("object_text"),
            first.alias("from_day"), last.alias("to_day"), F.col("work").alias("source"), locus.alias("locus"), F.lit(FULL).alias("confidence_raw"),
        )

    nobody = F.lit(None).cast("long")
    stated = lambda c: rows.where(F.coalesce(F.col(c), F.lit("")) != "")
    language = tei_language(F.col("language"))
    made = [shape(stated(c), p, nobody, F.col(c)) for c, p in (("title", WORK_TITLE), ("scheme", SCHEME))]
    made += [shape(stated(c), p, name_identifier(F.col(c)), none) for c, p in (("author", ATTRIBUTED_TO), ("editor", EDITED_BY))]
    made.append(shape(rows.where(language != 0), WRITTEN_IN, language, none))
    parts = rows.select("work", F.explode("passages").alias("p")).select("work", "p.*")
    at = F.when(F.col("addressable"), F.col("path"))
    made.append(shape(parts.where("leaf and text <> ''"), PASSAGE_TEXT, nobody, F.col("text"), at))
    seen = mentions(works).withColumn("work", work).withColumn("addressable", F.col("path").rlike("^[0-9]+([.][0-9]+){0,2}$"))
    keyed = authority_id(F.col("key"))
    named = seen.where("kind <> 'date'")
    predicate = F.when(F.col("kind") == "place", NAMES_PLACE).otherwise(NAMES_PERSON)
    made.append(shape(named, predicate, keyed, F.when(keyed.isNull(), F.col("name")), at))
    made.append(shape(seen.where("kind = 'date' and from_day is not null"), DATED_HERE, F.col("work"), none, at, F.col("from_day"), F.col("to_day")))
    every = made[0]
    for more in made[1:]:
        every = every.unionByName(more)
    return every


def attributions(works: DataFrame) -> DataFrame:
    """text, covers: the licences of works, each once with the least number of the files that state it."""
    return works.where("licence <> ''").groupBy(F.col("licence").alias("text")).agg(F.min("canonical").alias("covers"))


def ingest(files: DataFrame, space) -> DataFrame:
    """The facts of files; two works of one URN refuse the corpus."""
    works = space.write(read_works(files), "works")
    twin = twins(works).first()
    if twin:
        raise TwinWorks(twin.urn)
    return facts(works)
