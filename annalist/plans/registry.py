"""All queries of the core and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from annalist.plans import corpora, facts, problems, texts, works

BOOKS = (facts.book, works.book, texts.book, corpora.book)
QUERIES = problems.QUERIES | {k: q for b in BOOKS for k, q in b.queries.items()}
ORACLE = problems.ORACLE | {k: s for b in BOOKS for k, s in b.oracle.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of a span of years with their citations."""
    return facts.span_cited(spark, sf_dir)
