"""Marked-up text: a scanner of tags, element texts and attributes, entities."""

from __future__ import annotations

import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A comment, a CDATA section, a declaration or instruction, or a tag, in which quotes may hold a ">".
TOKEN = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<![^>]*>|<(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>", re.S)
ENTITY = re.compile(r"&(?:#([0-9]{1,7})|#[xX]([0-9A-Fa-f]{1,6})|(lt|gt|quot|apos|amp));")
#: The predefined entities.
PREDEFINED = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}
HIGHEST = 0x10FFFF


class Element(NamedTuple):
    name: str
    begin: int
    end: int
    closing: bool
    empty: bool
    tag: str


def local_name(tag: str) -> str:
    """The name of a tag without its prefix, its case kept."""
    found = re.match(r"</?\s*([^\s/>]+)", tag)
    return found[1].rpartition(":")[2] if found else ""


def elements(body: str):
    """The tags of a text in order; comments, CDATA, declarations and instructions are passed over."""
    for m in TOKEN.finditer(body):
        tag = m[0]
        if tag.startswith(("<!", "<?")):
            continue
        yield Element(local_name(tag), m.start(), m.end(), tag.startswith("</"), tag.endswith("/>"), tag)


def decode(text: str) -> str:
    """Predefined entities and numeric references up to the highest code point; others stay as they are."""

    def plain(m: re.Match) -> str:
        if m[3]:
            return PREDEFINED[m[3]]
        code = int(m[1]) if m[1] else int(m[2], 16)
        return chr(code) if 0 < code <= HIGHEST and not 0xD800 <= code < 0xE000 else m[0]

    return ENTITY.sub(plain, text)


def flatten(text: str) -> str:
    return re.sub(r"[ \t\r\n]+", " ", text).strip(" ")


def text_of(body: str, begin: int = 0, end: int | None = None) -> str:
    """The text between two places: tags dropped, CDATA kept, entities decoded, blanks collapsed."""
    out, at = [], begin
    stop = len(body) if end is None else end
    for m in TOKEN.finditer(body, begin, stop):
        out.append(decode(body[at : m.start()]))
        if m[0].startswith("<![CDATA["):
            out.append(m[0][9:-3])
        at = m.end()
    out.append(decode(body[at:stop]))
    return flatten("".join(out))


def attribute(tag: str, name: str) -> str | None:
    """The decoded value of an attribute by its full or local name."""
    for m in re.finditer(r"([^\s=<>/\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", tag):
        if m[1] == name or m[1].rpartition(":")[2] == name:
            return decode(m[2] if m[2] is not None else m[3])
    return None


def span(body: str, name: str, start: int = 0) -> tuple[int, int] | None:
    """Where the content of the first element of a name lies, elements of the same name inside it counted."""
    depth, begin = 0, 0
    for e in elements(body[start:]):
        if e.name != name:
            continue
        if e.closing:
            depth -= 1
            if depth == 0:
                return start + begin, start + e.begin
        elif e.empty:
            if depth == 0:
                return start + e.end, start + e.end
        else:
            if depth == 0:
                begin = e.end
            depth += 1
    return None


def first_text(body: str, name: str, start: int = 0) -> str | None:
    found = span(body, name, start)
    return None if found is None else text_of(body, *found)


ELEMENTS = "array<struct<name: string, begin: int, end: int, closing: boolean, empty: boolean>>"


def xml_elements(text: Column) -> Column:
    """The tags of a text as an array of structs; a null text has none."""

    @F.pandas_udf(ELEMENTS)
    def scan(texts: pd.Series) -> pd.Series:
        return pd.Series([[] if s is None else [dict(zip(Element._fields[:5], e[:5])) for e in elements(s)] for s in texts])

    return scan(text)


def _of_text(function):
    @F.pandas_udf("string")
    def each(texts: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else function(s) for s in texts], dtype=object)

    return each


def xml_text(text: Column) -> Column:
    return _of_text(text_of)(text)


def xml_entities(text: Column) -> Column:
    return _of_text(decode)(text)


def xml_attribute(tag: Column, name: str) -> Column:
    return _of_text(lambda s: attribute(s, name))(tag)


def xml_first_text(text: Column, name: str) -> Column:
    return _of_text(lambda s: first_text(s, name))(text)


def xml_span(text: Column, name: str) -> Column:
    """What stands between the tags of the first element of a name, as it is written; null where there is none."""
    return _of_text(lambda s: None if (found := span(s, name)) is None else s[found[0] : found[1]])(text)
