"""Signatures: chained folds of words and bytes in a stated order.

A chained fold is not associative, so what has no bound is folded in chunks of the order, each in one row, and the
chunk folds are what two corpora are compared by; they also say where the two begin to differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions.texts import FNV_BASIS, FNV_PRIME, WORD_MASK, fold_words, octets
from annalist.operators.facts import BAKED
from annalist.operators.order import numbered

#: The fields of a fact that are folded, in their order.
FIELDS = ["subject", "predicate", "object_ref", "from_day", "to_day", "source_ref", "confidence_raw", "locus"]
CHUNK = 4096
#: So many texts at least are folded side by side; with fewer left, each is folded by itself.
SIDE_BY_SIDE = 24


def word(c: str | Column) -> Column:
    """A value as a word of 32 bits; what is absent is 0."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("long"), F.lit(0)).bitwiseAND(F.lit(WORD_MASK).cast("long"))


def _in_order(rows: DataFrame, by: str, words: Column) -> Column:
    return F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(by).alias("by"), words.alias("w")))), lambda r: r["w"]))


def fold_page(page: DataFrame) -> DataFrame:
    """The fold of a page of facts (at most 64 rows, with place, matched and truncated), all fields of all rows in
    their order, then the number of rows, of matches, and whether it leaves some out. An empty page folds three zeros."""
    rows = page.agg(_in_order(page, "place", F.array(*map(word, FIELDS))).alias("w"), F.count("*").alias("n"), F.max("matched").alias("m"), F.max(F.col("truncated").cast("int")).alias("t"))
    return rows.select(fold_words(F.concat("w", F.array(word("n"), word("m"), word("t")))).alias("fold"))


def fold_facts(facts: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """chunk, facts, fold of all facts in kept order, `chunk` of them at a time."""
    placed = numbered(facts.select(*BAKED), [F.col(c).asc_nulls_first() for c in BAKED]).withColumn("chunk", F.floor((F.col("place") - 1) / chunk))
    return placed.groupBy("chunk").agg(F.count("*").alias("facts"), fold_words(_in_order(placed, "place", F.array(*map(word, FIELDS)))).alias("fold"))


def fold_vocabulary(names: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """chunk, names, fold of the names (id, name) by their ids: each id, the bytes of its name, and how many they are."""
    placed = numbered(names.select("id", "name"), [F.col("id"), F.col("name")]).withColumn("chunk", F.floor((F.col("place") - 1) / chunk))
    words = F.concat(F.array(word("id")), octets(F.col("name")), F.array(F.octet_length("name").cast("long")))
    return placed.groupBy("chunk").agg(F.count("*").alias("names"), fold_words(_in_order(placed, "place", words)).alias("fold"))


def _folded(texts: list[bytes]) -> np.ndarray:
    """The fold of the bytes of each text: the texts are walked through together, a byte of all of them at a time."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    longest_first = np.argsort(-sizes, kind="stable")
    begins = (np.cumsum(sizes) - sizes)[longest_first]
    every = np.frombuffer(b"".join(texts), dtype=np.uint8)
    folds = np.full(len(texts), FNV_BASIS, dtype=np.uint64)
    prime, mask = np.uint64(FNV_PRIME), np.uint64(WORD_MASK)
    # How many texts are longer than i bytes: those are the first ones.
    longer = len(texts) - np.searchsorted(sizes[longest_first][::-1], np.arange(sizes.max(initial=0)), side="right")
    at = 0
    for at, n in enumerate(longer):
        if n < SIDE_BY_SIDE:
            break
        h = folds[:n]
        h ^= every[begins[:n] + at]
        h *= prime
        h &= mask
    else:
        at = len(longer)
    for i, k in enumerate(longest_first[: longer[at] if at < len(longer) else 0]):
        h = int(folds[i])
        for byte in texts[k][at:]:
            h = ((h ^ byte) * FNV_PRIME) & WORD_MASK
        folds[i] = h
    result = np.empty(len(texts), dtype=np.int64)
    result[longest_first] = folds
    return result


def fold_text(text: Column) -> Column:
    """The bytes of a text, then how many lines and bytes it has."""

    @F.pandas_udf("long")
    def fold_bytes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(_folded([b"" if t is None else t.encode() for t in batch]), dtype="int64")

    lines = F.when(text == "", 0).otherwise(F.size(F.split(text, "\n", -1))).cast("long")
    folded = fold_bytes(text)
    for w in (lines, F.octet_length(text).cast("long")):
        folded = folded.bitwiseXOR(w) * FNV_PRIME
        folded = folded.bitwiseAND(F.lit(WORD_MASK).cast("long"))
    return folded


def fold_audit(counts: DataFrame) -> DataFrame:
    """The six counters of an audit in their order."""
    return counts.select(fold_words(F.array(*[word(c) for c in ("facts", "unsourced", "unlocated", "dangling_locus", "dangling_document", "unnamed")])).alias("fold"))


def fold_of_folds(folds: DataFrame, by: str) -> DataFrame:
    """One fold of the folds of chunks, by their numbers; as many rows as there are chunks."""
    return folds.agg(fold_words(F.transform(F.array_sort(F.collect_list(F.struct(by, "fold"))), lambda r: r["fold"])).alias("fold"))
