"""Recursive splitting of texts into chunks that share text with the ones before."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separators from the coarsest to single characters; fixed values.
SEPARATORS = ("\n\n", "\n", " ", "")


def _pieces(text: str, separator: str) -> Iterator[str]:
    """The text cut in front of every separator."""
    if not separator:
        yield from text
        return
    at, cut = 0, text.find(separator)
    if not cut:  # one at the very beginning stays with what follows it
        cut = text.find(separator, len(separator))
    while cut >= 0:
        yield text[at:cut]
        at, cut = cut, text.find(separator, cut + len(separator))
    yield text[at:]


class _Window:
    """Small pieces on their way into a chunk; of a finished chunk the last ones, as far as the overlap reaches, begin the next."""

    def __init__(self, size: int, overlap: int):
        self.size, self.overlap, self.held, self.total = size, overlap, deque(), 0

    def add(self, piece: str) -> Iterator[str]:
        if self.total + len(piece) > self.size:
            if self.held:
                yield "".join(self.held)
            while self.held and (self.total > self.overlap or self.total + len(piece) > self.size):
                self.total -= len(self.held.popleft())
        self.held.append(piece)
        self.total += len(piece)

    def close(self) -> Iterator[str]:
        if self.held:
            yield "".join(self.held)
        self.held.clear()
        self.total = 0


def split_text(text: str, size: int = 1000, overlap: int = 200, separators: tuple[str, ...] = SEPARATORS) -> Iterator[str]:
    """Chunks of at most `size` characters, trimmed, blank ones left out.

    A text is cut in front of the first separator that it holds; pieces shorter than a chunk are put together again as long as they fit, and longer ones are split by
    the separators that follow. Chunks share up to `overlap` characters, in whole pieces. Each level passes once over its pieces, so time is linear in the text.
    """
    separator = next((s for s in separators if not s or s in text), separators[-1])
    finer = separators[separators.index(separator) + 1 :]
    window = _Window(size, overlap)
    for piece in _pieces(text, separator):
        if len(piece) < size:
            yield from filter(None, map(str.strip, window.add(piece)))
            continue
        yield from filter(None, map(str.strip, window.close()))
        if finer:
            yield from split_text(piece, size, overlap, finer)
        elif piece.strip():
            yield piece.strip()
    yield from filter(None, map(str.strip, window.close()))


def recursive_chunks(text: Column, size: int = 1000, overlap: int = 200, separators: tuple[str, ...] = SEPARATORS) -> Column:
    """The chunks of a text in order (see `split_text`); null has none. The package has to be known to Python workers (`ship`)."""

    @F.pandas_udf("array<string>")
    def chunks(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [*split_text(t, size, overlap, separators)] if t else [])

    return chunks(text)
