"""Operator 7, SimHash near-dedup: Golay-code fuzzy hashing finds all fingerprints within four bits of one another."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cols, q, scratch, python_workers, text_of

#: The binary Golay code (23, 12, 7): x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
_GENERATOR, _LENGTH, _CHECK = 0b110001110101, 23, 11
#: The fingerprint's three segments: lowest bit and width.
_SEGMENTS = ((0, 22), (22, 21), (43, 21))
_FLOOR = 1 << 16


def fingerprint(text: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """SimHash of the XXH64 of all word shingles of the text with A-Z lower-cased; no word: 0. Long texts go in blocks."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else iter([b" ".join(words)])
    counts, n = np.zeros(64, np.int64), 0
    while block := list(itertools.islice(shingles, _FLOOR)):
        h = np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in block), np.uint64, len(block))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(block)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


@functools.cache
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the three byte-wide parts of a word, and the error of weight 3 or less for each syndrome."""
    unit = [1]
    for _ in range(_LENGTH - 1):
        x = unit[-1] << 1
        unit.append(x ^ _GENERATOR if x >> _CHECK else x)
    parts = np.zeros((3, 256), np.int32)
    for i, s in enumerate(unit):
        parts[i // 8] ^= np.where(np.arange(256) >> (i % 8) & 1, s, 0).astype(np.int32)
    errors = np.zeros(1 << _CHECK, np.int32)
    for weight in range(4):
        for bits in itertools.combinations(range(_LENGTH), weight):
            errors[functools.reduce(lambda s, b: s ^ unit[b], bits, 0)] = sum(1 << b for b in bits)
    return parts, errors


def golay_index(words: np.ndarray) -> np.ndarray:
    """The number of the codeword nearest to each 23-bit word; the code is perfect, so there is one within 3 bits."""
    parts, errors = _golay()
    syndrome = parts[0][words & 255] ^ parts[1][words >> 8 & 255] ^ parts[2][words >> 16]
    return (words ^ errors[syndrome]) >> _CHECK


def golay_keys(words: np.ndarray) -> np.ndarray:
    """Per word the 1 or 6 codewords that decoding the word and its 23 neighbours gives, padded with -1.

    Two words at distance 2 or less have a neighbour in common, or are neighbours, so they share a key.
    """
    near = words[:, None] ^ np.concatenate(([0], 1 << np.arange(_LENGTH))).astype(np.int32)
    keys = np.sort(golay_index(near), axis=1)
    new = np.concatenate((np.ones((len(words), 1), bool), keys[:, 1:] != keys[:, :-1]), axis=1)
    out = np.full((len(words), 6), -1, np.int64)
    row, place = np.nonzero(new)[0], (np.cumsum(new, axis=1) - 1)[new]
    out[row, place] = keys[new]
    return out


def bucket_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, number of the fingerprint) for all buckets of uint64 fingerprints; any two within 4 bits share one.

    Say three segments differ in a, b and c bits, a + b + c <= 4. If one doesn't differ, another differs in 2 at most:
    keys are (a whole segment, a Golay key of another). Else each differs in 1 or 2: keys are triples of Golay keys.
    Keys hold 33 to 36 bits of the fingerprint, so buckets stay small for billions of fingerprints.
    """
    parts = [(prints >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int32) for at, width in _SEGMENTS]
    keys, who, out = [golay_keys(p) for p in parts], np.arange(len(prints)), []
    for kind, (s, t) in enumerate(itertools.permutations(range(3), 2)):
        row, col = np.nonzero(keys[t] >= 0)
        out.append((kind << 40 | parts[s][row].astype(np.int64) << 12 | keys[t][row, col], who[row]))
    triple = keys[0][:, :, None, None] << 24 | keys[1][:, None, :, None] << 12 | keys[2][:, None, None, :]
    fits = (keys[0] >= 0)[:, :, None, None] & (keys[1] >= 0)[:, None, :, None] & (keys[2] >= 0)[:, None, None, :]
    out.append((6 << 40 | triple[fits], np.nonzero(fits)[0]))
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


#: Buckets of more fingerprints are searched one by one.
_DENSE = 64


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Of links, as many as connect what they connect."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    left, right = [], []
    for x, y in zip(a.tolist(), b.tolist()):
        if (p := find(x)) != (r := find(y)):
            root[p] = r
            left.append(x)
            right.append(y)
    return left, right


def _tree(prints: np.ndarray, bits: int) -> tuple[list[int], list[int]]:
    """A forest over one bucket: what a fingerprint links to leaves the rest, which only it and its links are compared with later.

    Memory grows with the bucket; time with its fingerprints times what no family has taken in yet.
    """
    left, right, rest = [], [], np.unique(prints)
    while len(rest):
        reached, rest = [int(rest[0])], rest[1:]
        while reached and len(rest):
            x = reached.pop()
            near = np.bitwise_count((rest ^ np.int64(x)).view(np.uint64)) <= bits
            new = rest[near].tolist()
            if new:
                left += [x] * len(new)
                right += new
                reached += new
                rest = rest[~near]
    return left, right


def _links(key: np.ndarray, prints: np.ndarray, bits: int) -> tuple[list[int], list[int]]:
    """Verified links in sorted buckets, thinned to a forest; a bucket of more than _DENSE fingerprints is searched by itself, so its pairs never stand anywhere."""
    place = np.nonzero(np.concatenate(([True], key[1:] != key[:-1])))[0] if len(key) else np.empty(0, np.int64)
    size = np.diff(np.concatenate((place, [len(key)])))
    left, right = [], []
    for i in np.nonzero(size > _DENSE)[0]:
        a, b = _tree(prints[place[i] : place[i] + size[i]], bits)
        left += a
        right += b
    thin = np.repeat(size <= _DENSE, size)
    a, b = _pairs(key[thin], prints[thin], bits)
    return left + a, right + b


def _pairs(key: np.ndarray, prints: np.ndarray, bits: int) -> tuple[list[int], list[int]]:
    a, b, at = [], [], np.arange(len(key))
    for step in range(1, len(key)):
        at = at[at < len(key) - step]
        at = at[key[at] == key[at + step]]
        if not len(at):
            break
        good = at[np.bitwise_count((prints[at] ^ prints[at + step]).view(np.uint64)) <= bits]
        a.append(prints[good])
        b.append(prints[good + step])
    if not a:
        return [], []
    pairs = np.unique(np.stack((np.concatenate(a), np.concatenate(b)), axis=1), axis=0)
    return _forest(pairs[:, 0], pairs[:, 1])


def _link_batches(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    key, prints = np.empty(0, np.int64), np.empty(0, np.int64)

    def found(k: np.ndarray, p: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = _links(k, p, bits)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for x in batches:
        key = np.concatenate((key, x.column(0).to_numpy(zero_copy_only=False)))
        prints = np.concatenate((prints, x.column(1).to_numpy(zero_copy_only=False)))
        last = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last bucket may go on in the next batch
        yield from found(key[:last], prints[:last])
        key, prints = key[last:], prints[last:]
    yield from found(key, prints)


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes in `links` (a, b); the root is the least node of the component.

    Large-star and small-star rounds in turn, each a shuffle of links with minima summed on the map side, until nothing
    changes; every round is written to the shared folder. The driver gets two numbers a round.
    """
    links = scratch(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "sim-links")
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = scratch(star.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "sim-links")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, bits: int = 4) -> tuple[DataFrame, DataFrame]:
    """The slim rows (id, txt: hash of the text, print) of `docs` and the classes (print, component_id, keep_id, keep_txt).

    Fingerprints of all rows are taken in Arrow batches and written, 24 bytes a row. Rows with one fingerprint are one
    class, so copies count once from here on. Each distinct fingerprint goes to some 180 buckets (see `bucket_keys`);
    buckets are sorted inside tasks and scanned as runs, all pairs of a run are verified and no pair that differs by more than
    `bits` leaves the task, and no link is lost. bits: 4 at most, for which the buckets are made.

    Null text counts as empty: fingerprint 0, linked like any other. component_id is the least id, null if all are null.
    """
    assert bits <= 4, "the buckets hold for 4 bits or fewer"
    spark = docs.sparkSession
    python_workers(spark)
    kind = docs.schema[id_col].dataType

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.fromiter((fingerprint(x.as_py(), shingle) for x in b.column(2)), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(h)], ["id", "txt", "print"])

    rows = docs.select(F.col(q(id_col)).alias("id"), F.xxhash64(text_of(text_col)).alias("txt"), text_of(text_col).cast("binary").alias("text"))
    slim = scratch(rows.mapInArrow(prints, T.StructType([T.StructField("id", kind), T.StructField("txt", T.LongType()), T.StructField("print", T.LongType())])), "sim-prints")
    first = F.struct(F.col("id").isNull().alias("none"), "id", "txt")
    classes = scratch(slim.groupBy("print").agg(F.min("id").alias("id"), F.min(first).alias("first")), "sim-classes")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = b.column(0).to_numpy(zero_copy_only=False)
            k, who = bucket_keys(p.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(p[who])], ["key", "print"])

    keys = classes.select("print").mapInArrow(spread, "key long, print long").repartition("key").sortWithinPartitions("key")
    links = keys.mapInArrow(functools.partial(_link_batches, bits=bits), "a long, b long")
    roots = components(links).withColumnRenamed("node", "print")
    classes = classes.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print"))
    best = classes.groupBy("root").agg(F.min("id").alias("component_id"), F.min("first").alias("first"))
    out = classes.select("print", "root").join(best, "root").select("print", "component_id", F.col("first.id").alias("keep_id"), F.col("first.txt").alias("keep_txt"))
    return slim, scratch(out, "sim-components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of `docs`: its id (as `id_col`), fingerprint (16 hex digits) and component_id. An empty table gives none."""
    slim, classes = simhash_classes(docs, id_col, text_col, **options)
    out = slim.join(classes.select("print", "component_id"), "print")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` with the least id of their component; of rows that repeat id and text, one stays."""
    slim, classes = simhash_classes(docs, id_col, text_col, **options)
    keep = classes.select(F.col("keep_id").alias("__sim_id"), F.col("keep_txt").alias("__sim_txt")).distinct()
    rows = docs.withColumns({"__sim_own": F.col(q(id_col)), "__sim_own_txt": F.xxhash64(text_of(text_col))})
    out = rows.join(keep, F.col("__sim_own").eqNullSafe(F.col("__sim_id")) & (F.col("__sim_own_txt") == F.col("__sim_txt")), "left_semi")
    if slim.groupBy("id", "txt").count().filter("count > 1").take(1):
        out = out.dropDuplicates(["__sim_own", "__sim_own_txt"])
    return out.select(*cols(docs))
