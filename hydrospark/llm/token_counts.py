"""Operator 10, token counts with overlap resynchronisation of huge documents."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import python_workers, text_of

SPACE = "▁"


@functools.cache
def _model(path: str) -> tuple[sentencepiece.SentencePieceProcessor, bool]:
    """The model of this worker, and whether no piece has a word's beginning inside, which makes such places boundaries."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    return sp, not any(SPACE in x.lstrip(SPACE) for x in pieces)


def _starts(sp: sentencepiece.SentencePieceProcessor, data: bytes, at: int, end: int) -> np.ndarray:
    """Where the tokens of a chunk begin, in bytes of the whole text."""
    pieces = sp.encode(data[at:end].decode(), return_type="proto").pieces
    return np.fromiter((p.begin for p in pieces), np.int64) + at


def _whole(data: bytes, at: int) -> int:
    """The first character's beginning at or after a byte."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return min(at, len(data))


def _word_begins(data: bytes, at: int) -> bool:
    """Whether a space, or the sign that stands for it, follows another character here."""
    mark = SPACE.encode()
    return (data[at : at + 1] == b" " or data.startswith(mark, at)) and data[at - 1 : at] != b" " and data[max(0, at - 3) : at] != mark


def count_long(text: str, path: str, chunk: int = 16_384, overlap: int = 256) -> int:
    """The number of tokens of a text, encoded in chunks of `chunk` bytes that overlap.

    Neighbouring chunks are spliced where both have a token that begins with a space after another character. That place is
    a boundary in every encoding, and the tokens on its two sides don't depend on one another, because no piece of the vocabulary
    has a space inside a word; so the splice gives what one call gives. Where an overlap has no such place, it is
    widened, twice as far each time, up to the whole rest.
    """
    sp, proven = _model(path)
    if not proven:
        return len(sp.encode(text))
    data = text.encode()
    n, start, total, at, end = len(data), 0, 0, 0, _whole(data, chunk + overlap)
    mine = _starts(sp, data, at, end)
    while end < n:
        wide = overlap
        while True:
            after = _whole(data, max(at, end - wide))
            stop = _whole(data, after + chunk + wide)
            other = _starts(sp, data, after, stop)
            both = np.intersect1d(mine[mine > after], other)
            good = [p for p in both[::-1].tolist() if start < p < end and _word_begins(data, p)]
            if good or end == n:
                break
            wide *= 2
            if wide > end - at:  # all of this chunk overlaps: it has to be longer
                end = _whole(data, at + 2 * (end - at))
                mine = _starts(sp, data, at, end)
        if not good:
            break
        total += int(np.searchsorted(mine, good[0]) - np.searchsorted(mine, start))
        start, at, end, mine = good[0], after, stop, other
    return total + int(len(mine) - np.searchsorted(mine, start))


def token_counts(docs: DataFrame, model: str, text_col: str = "text", limit: int = 4096, long_chars: int = 16_384, overlap: int = 256) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit to every row, without a shuffle.

    Tokens are those of the sentencepiece model file at `model` (a path that all executors have), without begin and end.
    Texts of more than `long_chars` code points are encoded in overlapping chunks (see `count_long`), so a worker never
    holds the tokens of a whole huge document; others are encoded in batches. Null counts as empty: 0 bytes, 0 tokens.
    Columns that bear an output's name are replaced; an empty table stays empty.
    """
    python_workers(docs.sparkSession)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sp, _ = _model(model)
        for texts in batches:
            huge = texts.str.len() > long_chars
            n = pd.Series(0, index=texts.index)
            n[~huge] = [len(x) for x in sp.encode(texts[~huge].tolist(), num_threads=1)]
            n[huge] = [count_long(x, model, long_chars, overlap) for x in texts[huge]]
            yield n

    out = docs.withColumns({"n_bytes": F.octet_length(text_of(text_col)).cast("long"), "n_tokens": count(text_of(text_col))})
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
