"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

FOLDER = "/opt/tokenizers"
FILE = "byte_bpe_50k.tiktoken"
#: Fixed value: how the byte-level vocabularies cut a text into words.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The tokenizer is handed words of a text in pieces of about so many characters; none is cut, so none is counted
#: otherwise. Its own splitter runs out of stack on very long texts.
PIECE = 50_000
_SPLIT = regex.compile(WORDS)


def _pieces(text: str) -> Iterator[tuple[str, bool]]:
    """A text cut between words, and whether the piece is one word longer than a piece."""
    if len(text) <= PIECE:
        yield text, False
        return
    begin = end = 0
    for word in _SPLIT.finditer(text):
        long = word.end() - word.start() > PIECE
        if end > begin and (long or word.end() - begin > PIECE):
            yield text[begin:end], False
            begin = end
        end = word.end()
        if long:
            yield text[begin:end], True
            begin = end
    if end > begin:
        yield text[begin:end], False


@lru_cache(maxsize=4)
def _counter(path: str):
    if path.endswith(".tiktoken"):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb"))}
        own = tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        return lambda text: sum(len(own._encode_single_piece(p) if word else own.encode_ordinary(p)) for p, word in _pieces(text))
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text, num_threads=1))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def token_count(text: Column, folder: str = FOLDER, file: str = FILE) -> Column:
    """Tokens of a text as a long; of a null text 0. The vocabulary is read from `folder` on each executor."""
    path = f"{folder}/{file}"

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        size = _counter(path)
        for batch in batches:
            yield pd.Series([0 if t is None else size(t) for t in batch], dtype="int64")

    return count(text)
