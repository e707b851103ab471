"""Catalogues of works as RDF, one file for each work."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from annalist.functions.markup import attribute, elements, first_text, span

RECORD = "canonical string, work string, title string, creator string, language string, rights string, born int, died int, undated boolean"


def _year(text: str | None) -> int | None:
    found = re.match(r"\s*([+-]?\d{1,6})", text or "")
    return int(found[1]) if found else None


def read_record(canonical: str, body: str) -> dict:
    """The work with the union of its creators' lives; editors and dates of issue say nothing about it."""
    ebook = next((attribute(e.tag, "about") for e in elements(body) if e.name == "ebook" and not e.closing), None)
    births, deaths, creators, at = [], [], [], 0
    while (found := span(body, "creator", at)) is not None:
        inner = body[found[0] : found[1]]
        creators.append(first_text(inner, "name"))
        births.append(_year(first_text(inner, "birthdate")))
        deaths.append(_year(first_text(inner, "deathdate")))
        at = found[1] + 1
    language = span(body, "language")
    born, died = [b for b in births if b is not None], [d for d in deaths if d is not None]
    return {
        "canonical": canonical, "work": ebook, "title": first_text(body, "title"), "creator": next((c for c in creators if c), None), "language": first_text(body[language[0] : language[1]], "value") if language else None,
        "rights": first_text(body, "rights"), "born": min(born) if born else None, "died": max(died) if died else None, "undated": not died,
    }


def read_catalogue(files: DataFrame) -> DataFrame:
    """files: canonical, body."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = pd.DataFrame([read_record(c, b or "") for c, b in zip(batch["canonical"], batch["body"])])
            yield rows.astype({"born": "Int32", "died": "Int32"})

    return files.select("canonical", "body").mapInPandas(each, RECORD)
