"""The dimension of languages: words by which a language is named, its tag, its era."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tag, era (0 unspecified, 1 ancient, 2 medieval, 3 modern), and its words, the canonical one first.
LANGUAGES = [
    (1, 1, "la lat"), (2, 2, "la-eccl"), (3, 1, "grc"), (4, 2, "fro"), (5, 2, "enm"), (6, 3, "fr fre fra"), (7, 3, "en eng"), (8, 1, "sa san"),
    (9, 1, "pi pli"), (10, 1, "lzh"), (11, 1, "cop"), (12, 1, "syc syr"), (13, 1, "arc"), (14, 1, "akk"), (15, 1, "gez"), (16, 1, "hbo"),
    (17, 1, "peo"), (18, 1, "got"), (19, 2, "ang"), (20, 2, "non"), (21, 2, "sga"), (22, 2, "cu chu"), (23, 0, "he heb"), (24, 0, "ar ara arb"),
    (25, 0, "fa per fas"), (26, 0, "zh chi zho"), (27, 0, "bo tib bod"), (28, 0, "hy arm hye"), (29, 0, "ka geo kat"), (30, 0, "tr tur ota"),
    (31, 0, "ja jpn"), (32, 0, "ko kor"), (33, 3, "de ger deu"), (34, 3, "fi fin"), (35, 3, "it ita"), (36, 3, "nl dut nld"), (37, 3, "es spa"),
    (38, 3, "hu hun"), (39, 3, "pt por"), (40, 3, "sv swe"), (41, 3, "el gre ell"), (42, 3, "eo epo"), (43, 3, "ca cat"), (44, 3, "da dan"),
    (45, 3, "tl tgl"), (46, 3, "pl pol"), (47, 3, "no nor nb nn"), (48, 3, "fy fry"), (49, 3, "af afr"), (50, 3, "cy wel cym"), (51, 3, "cs cze ces"),
    (52, 3, "ru rus"), (53, 3, "is ice isl"), (54, 3, "te tel"), (55, 3, "fur"), (56, 3, "bg bul"), (57, 3, "sl slv"), (58, 3, "ro rum ron"),
    (59, 3, "ga gle"), (60, 3, "sr srp"), (61, 3, "gl glg"), (62, 3, "ceb"), (63, 3, "ilo"), (64, 3, "gd gla"),
]
ERAS = {0: "unspecified", 1: "ancient", 2: "medieval", 3: "modern"}


def language_words(spark: SparkSession) -> DataFrame:
    """word, tag, era, canonical: a fixed table of about 130 rows."""
    rows = [(w, tag, era, i == 0) for tag, era, words in LANGUAGES for i, w in enumerate(words.split())]
    return spark.createDataFrame(rows, "word string, tag int, era int, canonical boolean")


def language_of(word: Column) -> Column:
    """The tag of a word, 0 where it is unknown."""
    pairs = [F.lit(x) for tag, _, words in LANGUAGES for w in words.split() for x in (w, tag)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), word), F.lit(0))


def tei_language(code: Column) -> Column:
    """The tags of the few codes that marked-up texts use."""
    return (
        F.when(code == "grc", 3).when(code.isin("lat", "la"), 1).when(code == "fro", 4).when(code == "enm", 5)
        .when(code.isin("fra", "fre", "fr"), 6).when(code.isin("eng", "en"), 7).otherwise(0)
    )
