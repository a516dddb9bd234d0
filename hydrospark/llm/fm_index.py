"""Operator 5, substring dedup: an FM-index over a wavelet tree per shard tells which windows of words occur earlier."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cols, python_workers, q, scratch, text_of

#: Words of one index; a shard is closed at the next anchor once it holds so many.
SHARD_WORDS = 1_000_000
#: Windows of an anchor that more rows than this have are dealt out one by one.
HOT_ANCHOR = 20_000


class WaveletTree:
    """A sequence of numbers as one packed bit vector per bit of its alphabet (a wavelet matrix), with a count for each 64 bits."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.n, self.levels = len(seq), []
        for level in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bit = (seq >> level & 1).astype(bool)
            packed = np.packbits(np.concatenate((bit, np.zeros(64 + -len(bit) % 64, bool))), bitorder="little").view(np.uint64)
            counts = np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)))[:-1].astype(np.int32)
            zeros = len(bit) - int(bit.sum())
            self.levels.append((level, packed, counts, zeros))
            seq = np.concatenate((seq[~bit], seq[bit]))
        self.start = self._down(np.arange(sigma), np.zeros(sigma, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, packed, counts, zeros in self.levels:
            word, rest = at >> 6, (at & 63).astype(np.uint64)
            ones = counts[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << rest) - np.uint64(1)))
            at = np.where(symbol >> level & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._down(symbol, at) - self.start[symbol]


class FMIndex:
    """The index of a sequence of numbers (0 separates) for patterns of up to 16 of them.

    Suffixes are sorted by their first 16 numbers, by four rounds of doubling; that is what backward search needs for patterns of that length.
    """

    def __init__(self, seq: np.ndarray):
        self.sigma = int(seq.max()) + 1 if len(seq) else 1
        rank, n = seq.astype(np.int64), len(seq)
        for step in (1, 2, 4, 8):
            after = np.concatenate((rank[step:], np.zeros(min(step, n), np.int64)))
            rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + after, return_inverse=True)[1]
        self.suffixes = np.argsort(rank, kind="stable")
        self.tree = WaveletTree(seq[self.suffixes - 1], self.sigma)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=self.sigma))))[:-1]

    def windows(self, seq: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(lo, hi): the suffixes that begin with each window of `seq`, by backward search from its last number.

        A search ends as soon as one suffix is left: the window then occurs nowhere else.
        """
        lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), len(seq), np.int64)
        open_ = np.arange(len(starts))
        for back in range(length - 1, -1, -1):
            c = seq[starts[open_] + back]
            lo[open_] = self.first[c] + self.tree.rank(c, lo[open_])
            hi[open_] = self.first[c] + self.tree.rank(c, hi[open_])
            open_ = open_[hi[open_] - lo[open_] > 1]
        return lo, hi


def search_shard(bodies: list[bytes], first_ids: np.ndarray, length: int) -> np.ndarray:
    """For each distinct piece of text (words as 64-bit hashes), a bit for each of its windows that occurs in a piece with a smaller first id."""
    sizes = np.array([len(b) // 8 for b in bodies])
    words = np.frombuffer(b"".join(bodies), np.int64)
    ends = np.cumsum(sizes + 1)
    seq = np.zeros(int(ends[-1]), np.int64)
    inside = np.ones(len(seq), bool)
    inside[ends - 1] = False
    seq[inside] = np.unique(words, return_inverse=True)[1] + 1
    owner = np.repeat(np.arange(len(bodies)), sizes + 1)
    counts = sizes - length + 1
    starts = np.repeat(ends - sizes - 1, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    index = FMIndex(seq)
    lo, hi = index.windows(seq, starts, length)
    flags = np.zeros(len(bodies), np.int64)
    many = np.nonzero(hi - lo > 1)[0]
    if len(many):
        ids = np.concatenate((first_ids[owner[index.suffixes]], [np.iinfo(np.int64).max]))
        a, where = np.unique(lo[many], return_inverse=True)
        b = np.zeros(len(a), np.int64)
        b[where] = hi[many]
        least = np.minimum.reduceat(ids, np.stack((a, b), axis=1).ravel())[::2]
        hit = many[least[where] < first_ids[owner[starts[many]]]]
        np.bitwise_or.at(flags, owner[starts[hit]], 1 << (starts[hit] - (ends - sizes - 1)[owner[starts[hit]]]))
    return flags


def _shards(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows (route, body, first_id) in order of route, to (h1, h2, first_id, flags); one index per some SHARD_WORDS words."""
    bodies: list[bytes] = []
    held: list[tuple] = []
    size, last = 0, None

    def flush() -> pa.RecordBatch:
        ids = np.array([x[2] for x in held], np.int64)
        out = [pa.array([x[i] for x in held], pa.int64()) for i in range(3)] + [pa.array(search_shard(bodies, ids, length))]
        bodies.clear()
        held.clear()
        return pa.RecordBatch.from_arrays(out, ["h1", "h2", "first_id", "flags"])

    for b in batches:
        for route, body, first, h1, h2 in zip(*(c.to_pylist() for c in b.columns)):
            if size >= SHARD_WORDS and route != last:
                yield flush()
                size = 0
            last = route
            bodies.append(body)
            held.append((h1, h2, first))
            size += len(body) // 8
    if held:
        yield flush()


_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: Words whose hashes are made at a time; longer words than LONG_WORD bytes are hashed one by one.
_BLOCK, LONG_WORD = 1 << 16, 256


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX[1]
    return h ^ (h >> np.uint64(29))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): a 64-bit hash of every word of every text, and where each text's words begin.

    Eight bytes of all words are mixed in at a time, so that the steps are as many as the longest word has parts, not as there are words.
    """
    texts = texts.cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) else None
    raw = np.frombuffer(data or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    cut = np.ones(len(raw) + 1, bool)
    cut[:-1] = (raw == 32) | ((raw >= 9) & (raw <= 13))
    inside = ~cut[:-1]
    cut[bounds] = True
    ends = np.nonzero(inside & cut[1:])[0] + 1
    cut[1:-1] = ~inside[:-1]  # now: whether a word can't go on from the byte before
    cut[bounds] = True
    starts = np.nonzero(inside & cut[:-1])[0]
    sizes, out = ends - starts, np.empty(len(starts), np.uint64)
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    for i in range(0, len(starts), _BLOCK):
        s, size = starts[i : i + _BLOCK], sizes[i : i + _BLOCK]
        h, open_, done = size.astype(np.uint64) * _MIX[0], np.nonzero(size <= LONG_WORD)[0], 0
        while len(open_):
            part = eight[s[open_] + done] & masks[np.minimum(size[open_] - done, 8)]
            part = (h[open_] ^ part) * _MIX[0]
            h[open_] = part ^ (part >> np.uint64(32))
            done += 8
            open_ = open_[size[open_] > done]
        for k in np.nonzero(size > LONG_WORD)[0].tolist():
            h[k] = xxhash.xxh64_intdigest(raw[s[k] : s[k] + size[k]].tobytes())
        out[i : i + _BLOCK] = _mixed(h)
    return out, np.searchsorted(starts, bounds)


def _grams(words: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each `gram` consecutive words."""
    m = len(words) - gram + 1
    mixed = np.zeros(m, np.uint64)
    for j in range(gram):
        mixed = (mixed + words[j : j + m]) * _MIX[0]
        mixed ^= mixed >> np.uint64(29)
    return _mixed(mixed)


class _Runs:
    """The runs of windows of a batch of texts that have one anchor: row, start (in all words of the batch), count, anchor.

    A window's anchor is the least of the hashes of its `gram`-word parts. Equal windows have equal anchors, so the runs of an
    anchor hold all places where its windows can occur again.
    """

    def __init__(self, texts: pa.Array, length: int, gram: int):
        self.words, self.offsets = word_hashes(texts)
        n = len(self.words) - length + 1
        if n <= 0:
            self.row = self.start = self.count = self.anchor = np.zeros(0, np.int64)
            return
        row, grams = np.repeat(np.arange(len(texts)), np.diff(self.offsets)), _grams(self.words, gram)
        best, place = grams[:n].copy(), np.arange(n)
        for j in range(1, length - gram + 1):
            less = grams[j : j + n] < best
            best[less] = grams[j : j + n][less]
            place[less] = np.nonzero(less)[0] + j
        fits = row[:n] == row[length - 1 :]
        new = np.ones(n, bool)
        new[1:] = (place[1:] != place[:-1]) | (row[1:n] != row[: n - 1])
        self.start = np.nonzero(new & fits)[0]
        run = np.cumsum(new) - 1
        self.count = np.bincount(run[fits], minlength=run[-1] + 1)[run[self.start]]
        self.row, self.anchor = row[self.start], best[self.start].view(np.int64)


def _anchors(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) to the distinct (anchor, id) of each row."""
    for b in batches:
        runs = _Runs(b.column(1), length, gram)
        order = np.lexsort((runs.anchor, runs.row))
        row, anchor = runs.row[order], runs.anchor[order]
        first = np.ones(len(row), bool)
        first[1:] = (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(anchor[first]), b.column(0).take(pa.array(row[first]))], ["anchor", "id"])


def _within(values: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Which values are in any of the lists."""
    return np.isin(values, lists.flatten().to_numpy(zero_copy_only=False))


def _bodies(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, key, text, anchors, hot) to (route, id, key, start, n, body) of their runs with one of the anchors; body: the words' hashes.

    What repeats for one row of a batch repeats for the others, so the batch's lists are taken together. Runs of hot anchors go out
    as single windows, each routed by its own hash.
    """
    for b in batches:
        runs = _Runs(b.column(2), length, gram)
        hot = _within(runs.anchor, b.column(4))
        keep = _within(runs.anchor, b.column(3)) & ~hot
        k = runs.count[hot]
        single = np.repeat(runs.start[hot], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        route = np.concatenate((runs.anchor[keep], _grams(runs.words, length)[single].view(np.int64) if len(single) else np.zeros(0, np.int64)))
        start, n = np.concatenate((runs.start[keep], single)), np.concatenate((runs.count[keep], np.ones(len(single), np.int64)))
        row = np.concatenate((runs.row[keep], np.repeat(runs.row[hot], k)))
        raw, who = memoryview(runs.words).cast("B"), pa.array(row)
        body = [raw[8 * s : 8 * e] for s, e in zip(start.tolist(), (start + n + length - 1).tolist())]
        out = [pa.array(route), b.column(0).take(who), b.column(1).take(who), pa.array((start - runs.offsets[row]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array([bytes(x) for x in body], pa.binary())]
        yield pa.RecordBatch.from_arrays(out, ["route", "id", "key", "start", "n", "body"])


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 13, gram: int = 6, hot: int = HOT_ANCHOR) -> DataFrame:
    """(id, key: hash of the text, spots): where windows of `length` words begin that occur in a row with a smaller id; `spots` are (start, bits).

    1. The anchors of every row's windows (see `_Runs`) are counted with the least and largest id that has them, summed on the map side.
       An anchor of one id only can't repeat. The others are joined with the rows' anchors, which are found anew as that costs less
       than to keep them on disk, and return to their rows by a hash of id and text (where two rows share it, each gets the other's
       anchors too, which also repeat and change nothing).
    2. The runs of these anchors go on with their words, as hashes. Equal runs are summed to one row with its least
       id, so any number of copies of a passage is one row from here on.
    3. Distinct runs are exchanged by anchor and cut to shards at anchors. Each shard gets an FM-index; its runs are streamed
       through it, and backward search gives every window's suffixes and so the least id that has it. Anchors that more than `hot`
       rows have would make a shard of their own that grows with the input; their runs go on as single windows, dealt out by their hash.
    4. A run whose id isn't the least that has it repeats as a whole; the others repeat where the index says so.

    Nothing is collected or sent to all tasks. What one row gathers are its own anchors, once however many rows repeat its id or its id and text.
    """
    python_workers(docs.sparkSession)
    assert gram < length <= 16, "the index is sorted by 16 words"
    ident = F.coalesce(F.col(q(id_col)).cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(ident.alias("id"), F.xxhash64(text_of(text_col)).alias("key"), F.xxhash64(ident, text_of(text_col)).alias("row"), text_of(text_col).alias("text"))
    anchors_of = lambda who: rows.select(F.col(who).alias("id"), "text").mapInArrow(functools.partial(_anchors, length=length, gram=gram), "anchor long, id long")
    anchors = anchors_of("id").groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count(F.lit(1)).alias("c")).filter("a < b")
    anchors = scratch(anchors.select("anchor", (F.col("c") > hot).alias("hot")), "fm-anchors")
    wanted = anchors_of("row").join(anchors, "anchor").groupBy(F.col("id").alias("row")).agg(F.collect_set("anchor").alias("anchors"), F.collect_set(F.when(F.col("hot"), F.col("anchor"))).alias("hot"))
    again = scratch(rows.join(wanted, "row").select("id", "key", "text", "anchors", "hot"), "fm-rows")
    runs = again.mapInArrow(functools.partial(_bodies, length=length, gram=gram), "route long, id long, key long, start int, n int, body binary")
    runs = runs.withColumns({"h1": F.xxhash64("body"), "h2": F.xxhash64(F.lit(1), F.col("body"))})
    distinct = runs.groupBy("route", "body").agg(F.min("id").alias("first_id"))
    shards = distinct.repartition("route").sortWithinPartitions("route").select("route", "body", "first_id", F.xxhash64("body").alias("h1"), F.xxhash64(F.lit(1), F.col("body")).alias("h2"))
    found = scratch(shards.mapInArrow(functools.partial(_shards, length=length), "h1 long, h2 long, first_id long, flags long"), "fm-found")
    at = runs.select("id", "key", "start", "n", "h1", "h2").join(found, ["h1", "h2"])
    bits = F.when(F.col("id") > F.col("first_id"), F.expr("shiftleft(1L, n) - 1")).otherwise(F.col("flags"))
    at = at.select("id", "key", F.struct("start", bits.alias("bits")).alias("spot")).filter("spot.bits != 0")
    return at.groupBy("id", "key").agg(F.collect_set("spot").alias("spots"))  # rows that repeat id and text bring the same spots


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 13, **options) -> DataFrame:
    """Adds n_words, n_removed and kept_text (the words that stay, joined by one space) to every row of `docs`.

    A word goes if a window of `length` words around it also begins in a row with a smaller id; windows are judged on the
    input. Ids are whole numbers; null is smaller than any other. Rows that repeat an id are one document: they don't remove
    one another's words. Null text has no words; a text shorter than `length` words has no window and stays. Columns that
    bear an output's name are replaced; an empty table stays empty.
    """
    python_workers(docs.sparkSession)
    spots = repeated_windows(docs, id_col, text_col, length, **options)
    spots = spots.select(F.col("id").alias("__fm_id"), F.col("key").alias("__fm_key"), F.col("spots").alias("__fm_spots"))
    ident = F.coalesce(F.col(q(id_col)).cast("long"), F.lit(-(1 << 63)))
    rows = docs.withColumns({"__fm_id": ident, "__fm_key": F.xxhash64(text_of(text_col))}).join(spots, ["__fm_id", "__fm_key"], "left")

    @F.pandas_udf("n_words long, n_removed long, kept_text string")
    def cut(texts: pd.Series, spots: pd.Series) -> pd.DataFrame:
        out = []
        for text, some in zip(texts, spots):
            words = text.encode().split()
            n = len(words)
            if some is not None and len(some):
                gone = np.zeros(n + 1, np.int64)
                for s in some:
                    for j in range(s["bits"].bit_length()):
                        if s["bits"] >> j & 1:
                            gone[s["start"] + j] += 1
                            gone[s["start"] + j + length] -= 1
                stay = np.cumsum(gone)[:n] == 0
                words = [w for w, x in zip(words, stay.tolist()) if x]
            out.append((n, n - len(words), b" ".join(words).decode()))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept_text"])

    rows = rows.withColumn("__fm", cut(text_of(text_col), F.col("__fm_spots")))
    return rows.select(*cols(docs, "n_words", "n_removed", "kept_text"), "__fm.n_words", "__fm.n_removed", "__fm.kept_text")
