"""Near-dedup by word shingles: MinHash buckets give candidates, the texts of each candidate decide."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cols, q, scratch, python_workers, text_of
from .simhash import _forest, components, simhash_classes

#: Texts of similarity s share a bucket with probability 1 - (1 - s^ROWS)^BANDS: 0.99993 at 0.8, more above.
BANDS, ROWS = 24, 5
_BLOCK = 4096
#: Rounds that try one leader for each bucket before all pairs of what is still apart are tried.
_LEADER_ROUNDS = 2
#: About so many texts of a bucket are compared with so many others in one piece of work.
_SIDE = 400


def shingles(text: bytes | None, width: int = 5) -> np.ndarray:
    """The distinct XXH64 of all word shingles of the text with A-Z lower-cased; a shorter text is one shingle, no word gives none."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    parts = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of distinct values; two empty sets are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


@functools.cache
def _mixers() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(42)
    return r.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64), r.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)


def band_keys(s: np.ndarray) -> np.ndarray:
    """The bucket of each band for a text's shingles; all texts without a shingle meet in one."""
    flip, times = _mixers()
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(s), _BLOCK):
        np.minimum(least, ((s[None, i : i + _BLOCK] ^ flip) * times).min(axis=1), out=least)
    bands = least.reshape(BANDS, ROWS)[: None if len(s) else 1]
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(bands)], np.uint64).view(np.int64)


def _verified(batches: Iterator[pa.RecordBatch], width: int, least: float) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}

    def of(node: int, text: pa.Scalar) -> np.ndarray:
        if node not in held:
            if len(held) >= 64:
                held.pop(next(iter(held)))
            held[node] = shingles(text.as_py(), width)
        return held[node]

    for x in batches:
        a, b = x.column(0).to_pylist(), x.column(1).to_pylist()
        good = [similarity(of(a[i], x.column(2)[i]), of(b[i], x.column(3)[i])) >= least for i in range(len(a))]
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in x.columns[:2]], ["a", "b"])


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many values each set of `a` shares with each of `b`: products of 0/1 matrices over the values on both sides, some columns at a time."""
    left, right = np.concatenate(a), np.concatenate(b)
    values = np.intersect1d(left, right)
    out = np.zeros((len(a), len(b)), np.float64)
    row = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b)]
    for i in range(0, len(values), _BLOCK):
        v, ones = values[i : i + _BLOCK], []
        for flat, rows, sets in ((left, row[0], a), (right, row[1], b)):
            at = np.searchsorted(v, flat)
            at[at == len(v)] = 0
            hit = v[at] == flat
            x = np.zeros((len(sets), len(v)), np.float32)
            x[rows[hit], at[hit]] = 1
            ones.append(x)
        out += ones[0] @ ones[1].T
    return out


def _piece_links(rows: list[tuple], least: float) -> tuple[list[int], list[int]]:
    """Links between the blocks of one piece (side, node, root, set), thinned to a forest; a piece of one block has side 2 only."""
    a, b = [x for x in rows if x[0] != 1], [x for x in rows if x[0] != 0]
    if not a or not b:
        return [], []
    (_, na, ra, sa), (_, nb, rb, sb) = zip(*a), zip(*b)
    both = _overlaps(list(sa), list(sb))
    union = np.array([len(x) for x in sa])[:, None] + np.array([len(x) for x in sb])[None, :] - both
    good = (both >= least * union) & (np.array(ra)[:, None] != np.array(rb)[None, :])  # an empty set meets only empty ones
    i, j = np.nonzero(good)
    return _forest(np.array(na)[i], np.array(nb)[j])


def _pieces(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows (key, i, j, side, node, root, set) come sorted by the first three."""
    now, rows = None, []

    def found() -> Iterator[pa.RecordBatch]:
        a, b = _piece_links(rows, least)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for x in batches:
        for *piece, side, node, root, data in zip(*(c.to_pylist() for c in x.columns)):
            if piece != now:
                yield from found()
                now, rows = piece, []
            rows.append((side, node, root, np.frombuffer(data, np.uint64)))
    yield from found()


def _as_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for x in batches:
        yield pa.RecordBatch.from_arrays([x.column(0), pa.array([shingles(t.as_py(), width).tobytes() for t in x.column(1)], pa.binary())], ["node", "set"])


def shingle_links(docs: DataFrame, text_col: str, buckets: DataFrame, width: int, least: float) -> DataFrame:
    """(node, root) of all texts that `buckets` (key, node, n) brings together and whose similarity is `least` or more, over any number of steps.

    First every text is tried against one leader of its bucket, another one each round, which is linear and joins
    large families. Then all pairs of a bucket that are still in different components are tried, inside tasks: a bucket is
    dealt out as pairs of blocks of some _SIDE texts, so none is held whole. So each candidate is tried or already connected.
    """
    rows = docs.select(F.xxhash64(text_of(text_col)).alias("node"), text_of(text_col).cast("binary").alias("text"))
    texts = scratch(rows.join(buckets.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "near-texts")
    fits = lambda m, n: F.least(m, n) >= least * F.greatest(m, n)  # noqa: E731  else the sizes alone rule it out
    links, apart = None, buckets.withColumn("root", F.col("node"))
    for turn in range(_LEADER_ROUNDS):
        lead = apart.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "n", "root")).alias("x"))
        met = apart.join(lead, "key").filter((F.col("root") != F.col("x.root")) & fits(F.col("n"), F.col("x.n")))
        pairs = scratch(met.select(F.least("node", "x.node").alias("a"), F.greatest("node", "x.node").alias("b")).distinct(), "near-pairs")
        full = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
        found = scratch(full.select("a", "b", "ta", "tb").mapInArrow(functools.partial(_verified, width=width, least=least), "a long, b long"), "near-links")
        links = found if links is None else links.unionByName(found)
        roots = components(links)
        apart = buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = apart.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("c")).filter("r0 <> r1")
        apart = scratch(apart.join(mixed.select("key", "c"), "key").select("key", "node", "n", "root", "c"), "near-apart")

    sets = texts.join(apart.select("node").distinct(), "node", "left_semi").select("node", "text").mapInArrow(functools.partial(_as_sets, width=width), "node long, set binary")
    blocks = F.ceil(F.col("c") / _SIDE)
    own = apart.withColumn("m", blocks.cast("int")).withColumn("p", F.pmod(F.xxhash64("node", F.lit(-1)), F.col("m")).cast("int"))
    dealt = own.select("key", "node", "root", "p", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("o"))
    side = F.when(F.col("p") == F.col("o"), 2).when(F.col("p") < F.col("o"), 0).otherwise(1)
    dealt = dealt.select("key", F.least("p", "o").alias("i"), F.greatest("p", "o").alias("j"), side.alias("side"), "node", "root")
    full = dealt.join(sets, "node").select("key", "i", "j", "side", "node", "root", "set").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    links = links.unionByName(scratch(full.mapInArrow(functools.partial(_pieces, least=least), "a long, b long"), "near-links"))
    return components(links)


def simhash_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """(node, key): the texts that operator 7 brings together, one key for each of its components, found by Golay keys of the fingerprints of `width`-word shingles."""
    slim, classes = simhash_classes(docs, id_col, text_col, shingle=width)
    key = F.xxhash64(F.lit("simhash"), "keep_id", "keep_txt")
    return slim.join(classes.select("print", key.alias("key")), "print").select(F.col("txt").alias("node"), "key").distinct()


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8, candidates: DataFrame | None = None) -> DataFrame:
    """The rows of `docs` with the least id of their component; texts are linked if the Jaccard similarity of their word shingles is `least` or more.

    Candidates share one of BANDS buckets, each of ROWS least hashes; every candidate is verified on its texts' whole sets,
    so no link is wrong, and a pair at 0.8 is missed once in 14,000 times. Texts that `candidates` (node: hash of the text, key) give one key are tried as well. Null text counts as empty; of rows that repeat id and text, one stays.
    """
    python_workers(docs.sparkSession)
    kind = docs.schema[id_col].dataType

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            sets = [shingles(t.as_py(), width) for t in x.column(2)]
            keys = pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array([len(s) for s in sets], pa.int64()), keys], ["id", "node", "n", "keys"])

    rows = docs.select(F.col(q(id_col)).alias("id"), F.xxhash64(text_of(text_col)).alias("node"), text_of(text_col).cast("binary").alias("text"))
    shape = T.StructType([T.StructField("id", kind), T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])
    slim = scratch(rows.mapInArrow(sketch, shape), "near-sketch")
    first = F.struct(F.col("id").isNull().alias("none"), "id", F.col("node").alias("txt"))
    dealt = slim.select("node", "n", F.explode("keys").alias("key")).distinct()
    if candidates is not None:
        dealt = dealt.unionByName(slim.select("node", "n").distinct().join(candidates, "node").select("node", "n", "key"))
    shared = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key")
    buckets = scratch(dealt.join(shared, "key", "left_semi").select("key", "node", "n"), "near-buckets")
    roots = shingle_links(docs, text_col, buckets, width, least)
    best = slim.select("id", "node").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(first).alias("first"))
    keep = scratch(best.select(F.col("first.id").alias("__near_id"), F.col("first.txt").alias("__near_txt")), "near-keep")
    own = docs.withColumns({"__near_own": F.col(q(id_col)), "__near_own_txt": F.xxhash64(text_of(text_col))})
    out = own.join(keep, F.col("__near_own").eqNullSafe(F.col("__near_id")) & (F.col("__near_own_txt") == F.col("__near_txt")), "left_semi")
    if slim.groupBy("id", "node").count().filter("count > 1").take(1):
        out = out.dropDuplicates(["__near_own", "__near_own_txt"])
    return out.select(*cols(docs))
