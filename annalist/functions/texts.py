"""Names, references, identifiers and addresses as Column functions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Offset basis and prime of 32-bit FNV-1a.
FNV_BASIS, FNV_PRIME = 2166136261, 16777619
WORD_MASK = 0xFFFFFFFF
FULL = 65536


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def fold_words(words: Column, start: int = FNV_BASIS) -> Column:
    """FNV-1a over an array of longs, each taken as one word."""
    return F.aggregate(words, F.lit(start).cast("long"), lambda h, w: ((h.bitwiseXOR(w)) * FNV_PRIME).bitwiseAND(F.lit(WORD_MASK).cast("long")))


def octets(text: Column) -> Column:
    """The UTF-8 bytes of a text as an array of longs; none of a null."""
    digits = F.hex(F.encode(text, "UTF-8"))
    each = F.when(F.length(digits) > 0, F.transform(F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2)), lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("long")))
    return F.coalesce(each, F.array().cast("array<long>"))


def name_identifier(text: Column) -> Column:
    """The identity of a name: FNV-1a over its UTF-8 bytes, 0 moved to 1. Null stays null."""
    folded = fold_words(octets(text))
    return F.when(text.isNotNull(), F.when(folded == 0, F.lit(1)).otherwise(folded))


CTS_URN = r"^urn:cts:([^:]+):([^:]+)(?::(.*))?$"


def urn_part(urn: Column, i: int) -> Column:
    """1 the namespace, 2 the work, 3 the passage of a urn:cts: name; null where it is none or lacks the part."""
    return F.nullif(F.regexp_extract(urn, CTS_URN, i), F.lit(""))


def work_identifier(urn: Column) -> Column:
    return name_identifier(F.concat(urn_part(urn, 1), F.lit(":"), urn_part(urn, 2)))


def passage_locus(passage: Column) -> Column:
    """struct(part, section, line) of one to three dotted numbers below 2**32, filled from the finest; else null."""
    numbers = F.transform(F.split(passage, r"\."), lambda x: x.try_cast("long"))
    sound = passage.rlike(r"^[0-9]{1,10}(\.[0-9]{1,10}){0,2}$") & ~F.exists(numbers, lambda n: n > WORD_MASK)
    level = lambda i: F.coalesce(F.try_element_at(numbers, F.lit(-i)), F.lit(0))
    return F.when(sound, F.struct(level(3).alias("part"), level(2).alias("section"), level(1).alias("line")))


def resolve_urn(urn: Column) -> Column:
    """struct(work, part, section, line) of a urn:cts: name; null where it is none or its passage is malformed.

    A name without a passage is the whole work, at 0, 0, 0.
    """
    passage = urn_part(urn, 3)
    at = passage_locus(passage)
    zero = F.lit(0).cast("long")
    level = lambda c: F.coalesce(at.getField(c), zero).alias(c)
    sound = urn_part(urn, 2).isNotNull() & (passage.isNull() | at.isNotNull())
    return F.when(sound, F.struct(work_identifier(urn).alias("work"), level("part"), level("section"), level("line")))


def line_locus(heading: Column, line: Column) -> Column:
    """The position of a line of a plain text: no part, its heading, its number."""
    return F.struct(F.lit(0).cast("long").alias("part"), heading.cast("long").alias("section"), line.cast("long").alias("line"))


def render_locus(part: Column, section: Column, line: Column) -> Column:
    """Dotted numbers without empty leading levels."""
    shown = F.when(part != 0, F.concat_ws(".", part, section, line)).when(section != 0, F.concat_ws(".", section, line)).otherwise(line.cast("string"))
    return shown


def normalise_name(text: Column) -> Column:
    """ASCII lower case, every run of other characters one blank, ends trimmed."""
    return F.trim(F.regexp_replace(ascii_lower(text), "[^a-z0-9]+", " "))


def token_set(text: Column) -> Column:
    """The distinct words among the first 64 of a name, sorted; letters and digits of ASCII only."""
    words = F.filter(F.split(F.regexp_replace(ascii_lower(text), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    return F.array_sort(F.array_distinct(F.slice(words, 1, 64)))


def jaccard_raw(a: Column, b: Column) -> Column:
    """The similarity of two token sets as a Q16.16 word, rounded down; 0 where one is empty."""
    common = F.size(F.array_intersect(a, b)).cast("long")
    every = F.size(a) + F.size(b) - common
    return F.when(every > 0, F.floor(common * FULL / every).cast("long")).otherwise(F.lit(0).cast("long"))


def is_abbreviation(short: Column, long: Column) -> Column:
    """Are the letters of `short` initials of words of `long`, in order, the words at least as many as letters?"""
    letters = F.filter(F.split(ascii_lower(short), ""), lambda c: c.rlike("^[a-z0-9]$"))
    initials = F.transform(F.filter(F.split(F.regexp_replace(ascii_lower(long), "[^a-z0-9]+", " "), " "), lambda w: w != ""), lambda w: F.substring(w, 1, 1))
    taken = F.aggregate(initials, F.lit(0), lambda n, c: F.when(F.get(letters, n) == c, n + 1).otherwise(n))
    return (F.size(letters) >= 2) & (F.size(token_set(long)) >= F.size(letters)) & (taken == F.size(letters))


#: Beginnings of query parameters that track readers.
TRACKING = "^(utm_|fbclid|gclid|ref=|source=)"


def normalise_reference(text: Column) -> Column:
    """One spelling for one address; the order of the steps matters.

    Ends trimmed, fragment and scheme dropped, tracking parameters dropped, ASCII lower case, www. dropped,
    DOI and arXiv addresses brought to doi: and arxiv: form.
    """
    t = F.regexp_replace(F.regexp_replace(text, r"^[ <]+", ""), r"[ >/.]+$", "")
    t = F.regexp_replace(t, r"(?s)#.*$", "")
    t = F.regexp_replace(t, r"^.{0,8}?://", "")
    query = F.regexp_extract(t, r"(?s)\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)), "&")
    base = F.regexp_replace(t, r"(?s)\?.*$", "")
    t = F.when(t.contains("?"), F.when(kept == "", base).otherwise(F.concat(base, F.lit("?"), kept))).otherwise(t)
    t = F.regexp_replace(ascii_lower(t), r"^www\.", "")
    t = F.regexp_replace(t, r"^(?:doi\.org|dx\.doi\.org)/", "")
    arxiv = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"^arxiv\.org/(?:abs/)?(?:pdf/)?", "arxiv:"), r"\.pdf$", ""), r"v[0-9]+$", "")
    return F.when(t.startswith("10.") & t.contains("/"), F.concat(F.lit("doi:"), t)).when(t.startswith("arxiv.org/"), arxiv).otherwise(t)


def url_escape(text: Column) -> Column:
    """Percent escapes for all but the unreserved characters."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normalise_claim(text: Column) -> Column:
    return F.trim(F.regexp_replace(ascii_lower(text), r"[ \t\r\n]+", " "))


def xml_flatten(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def xml_predefined(text: Column) -> Column:
    """The five predefined entities decoded, the ampersand last."""
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


IDENTIFIER = r"^(?=[A-Z0-9]*[A-Z])[A-Z0-9]{2,4}-[0-9]{3}$"


def footnote_name(canonical: Column, chapter: Column, number: Column) -> Column:
    return F.concat(canonical, F.lit("#ch"), chapter.cast("string"), F.lit("[^"), number, F.lit("]"))


def note_numbers(text: Column) -> Column:
    """The numbers of the footnote markers in a text."""
    return F.regexp_extract_all(text, F.lit(r"\[\^([0-9]{1,6})\]"), 1)


def source_tags(text: Column) -> Column:
    """The tags of sources in a text, like S12."""
    return F.regexp_extract_all(text, F.lit(r"\[(S[0-9]{1,6})\]"), 1)


def heading_depth(line: Column) -> Column:
    """How deep a heading a line is, 0 for none."""
    return F.length(F.regexp_extract(line, "^(#{1,6}) ", 1))


def authority_key(key: Column) -> Column:
    """struct(authority, key) of a key cut at its first comma; null where a side is empty."""
    part = lambda i: F.regexp_extract(key, "(?s)^([^,]+),(.+)$", i)
    return F.when(part(1) != "", F.struct(part(1).alias("authority"), part(2).alias("key")))


def authority_id(key: Column) -> Column:
    """The identity of a whole key of an authority; null where it is none."""
    return F.when(authority_key(key).isNotNull(), name_identifier(key))


#: Providers with the kind of their sources and the confidence they get (Q16.16).
PROVIDERS = {"openalex": (0, 52429), "arxiv": (3, 42598), "wikipedia": (3, 36045), "github": (2, 32768), "stackexchange": (3, 26214)}
OTHER_PROVIDER = 22938


def provider_confidence(provider: Column) -> Column:
    chosen = F.lit(OTHER_PROVIDER)
    for name, (_, confidence) in PROVIDERS.items():
        chosen = F.when(provider == name, confidence).otherwise(chosen)
    return chosen


def provider_kind(provider: Column) -> Column:
    """The kind of source that a provider gives; 3 where it is unknown."""
    chosen = F.lit(3)
    for name, (kind, _) in PROVIDERS.items():
        chosen = F.when(provider == name, kind).otherwise(chosen)
    return chosen


#: Feature types of places by the bit they set.
PLACE_KINDS = [
    (1, "settlement villa vicus urban"), (2, "urban"), (4, "river lake spring well bay canal"), (8, "fort fortification wall tower military-installation"),
    (16, "temple sanctuary church altar shrine"), (32, "road station pass bridge port"), (64, "mountain island cape plain valley hill"),
]


def place_kinds(types: Column) -> Column:
    """The kind bits of a comma-separated list of feature types; unknown types set none."""
    listed = F.transform(F.split(types, ","), lambda t: F.trim(t))
    bits = [F.when(F.arrays_overlap(listed, F.array(*[F.lit(w) for w in words.split()])), bit).otherwise(0) for bit, words in PLACE_KINDS]
    total = bits[0]
    for b in bits[1:]:
        total = total + b
    return F.coalesce(total, F.lit(0))
