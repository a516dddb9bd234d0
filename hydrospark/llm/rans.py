"""Operator 3, token-ID output: static range asymmetric numeral system with shared frequency tables."""

from __future__ import annotations

import codecs
import functools
import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from tokenizers import Tokenizer

from .common import Kept, python_workers, q, scratch, small, text_of

#: Frequencies sum to 2**BITS; states stay in [2**31, 2**63) and give or take 32 bits at a time.
BITS, LANES, BLOCK, EVERY = 18, 4096, 1 << 20, 128
_LOW = 1 << 31
#: magic, version, lanes, bits, ids, checkpoints, words, crc32 of the ids, crc32 of the frequency table
_HEADER = struct.Struct("<4sHHHxxIIIII")
_MAGIC = b"RANS"
#: Units in one of an encoder's two generations.
_CACHE_MAX = 700_000
_LETTER, _MARK = "A-Za-zÀ-ÖØ-öø-ɏ", r"!-/:-@\[-`{-~"
#: Each of these is one unit of byte-level pre-tokenizing, as the character that follows shows: letters, digits or ASCII marks after at most one space, or a line end.
_UNIT = rf" ?[{_LETTER}]++(?=[\x00-@\[-`{{-\x7f]|\Z)| ?[0-9]++(?=[\x00-/:-\x7f]|\Z)|(?!') ?[{_MARK}]++(?=[A-Za-z0-9\s]|\Z)|\n(?=\S)"


def _byte_signs() -> str:
    """The 256 signs of bytes: byte-level BPE writes visible Latin-1 characters as themselves and the other bytes, in order, as characters from 256 on."""
    hidden = [b for b in range(256) if not (33 <= b <= 126 or b >= 161 and b != 173)]
    return "".join(chr(256 + hidden.index(b)) if b in hidden else chr(b) for b in range(256))


class Encoder:
    """A byte-level BPE tokenizers file with the ids of recent units kept, in two generations; the older one goes when the younger is full.

    Texts are cut at units of pre-tokenizing that their characters prove, and the file's merges are applied to each new one
    without pre-tokenizing it. What is no such unit goes, up to the next single space before a letter or digit, where a new
    unit always begins, through the whole tokenizer; so does a special token.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        kind = json.loads(self.tokenizer.to_str())
        before = kind["pre_tokenizer"] or {}
        if kind["normalizer"] or kind["model"].get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError("only byte-level BPE files without a normalizer are read")
        special = kind["added_tokens"]
        if any(x[k] for x in special for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError("a special token takes in what is beside it")
        longest_first = sorted((x["content"] for x in special), key=len, reverse=True)
        self.at_special = re.compile(f"({'|'.join(map(re.escape, longest_first))})").split if special else lambda text: [text]
        self.merged, self.signs = self.tokenizer.model.tokenize, _byte_signs()
        self.cut = re.compile(rf"{_UNIT}|(?s:.+?)(?= [^\W_]|\Z)").findall
        self.is_unit = re.compile(_UNIT).fullmatch
        self.units = Kept(self._encoded)

    def _parts(self, text: str) -> list[str]:
        """Units, other parts and special tokens in order; the tokenizer takes the stretches between special tokens one by one."""
        first, *rest = self.at_special(text)
        parts = self.cut(first)
        for special, stretch in zip(rest[::2], rest[1::2]):
            parts += [special, *self.cut(stretch)]
        return parts

    def _encoded(self, x: str) -> bytes:
        if self.is_unit(x):
            signs, _ = codecs.charmap_decode(x.encode(), "strict", self.signs)
            return array("I", [t.id for t in self.merged(signs)]).tobytes()
        return array("I", self.tokenizer.encode(x, add_special_tokens=False).ids).tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.units) > _CACHE_MAX:
            self.units = Kept(self._encoded, self.units)
        of = self.units.__getitem__
        return [b"".join(map(of, self._parts(x))) for x in texts]


@functools.cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def frequencies(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Counts scaled to a sum of 2**bits, at least 1 for each id that occurs; what rounding leaves goes to the largest."""
    total, size = int(counts.sum()), 1 << bits
    if total == 0:
        return np.zeros(len(counts), np.int64)
    if np.count_nonzero(counts) > size:
        raise ValueError("more ids occur than frequencies have room for")
    f = np.where(counts > 0, np.maximum(1, counts * size // total), 0).astype(np.int64)
    order = np.argsort(-f, kind="stable")
    over = int(f.sum()) - size
    if over < 0:
        f[order[0]] -= over
    for i in order[: max(0, over)] if over > 0 else ():
        take = min(over, max(0, int(f[i]) // 2))
        f[i] -= take
        over -= take
        if over <= 0:
            break
    return f


def encode_block(ids: np.ndarray, freq: np.ndarray, bits: int = BITS, lanes: int = LANES, every: int = EVERY) -> bytes:
    """One block: header, the lanes' states at each checkpoint with the place in the words, the words, crc32 of all that.

    Id k is step k // lanes of lane k % lanes. Lanes are encoded from the last step to the first and share one stream
    of words in the order in which decoding wants them, so decoding may begin at any checkpoint.
    """
    cum = np.concatenate(([0], np.cumsum(freq)))[:-1].astype(np.uint64)
    f_of, steps = freq.astype(np.uint64), -(-len(ids) // lanes)
    state = np.full(lanes, _LOW, np.uint64)
    words: list[np.ndarray] = [np.empty(0, np.uint32)] * steps
    marks: dict[int, np.ndarray] = {}
    top, b = np.uint64((_LOW >> bits) << 32), np.uint64(bits)
    for t in range(steps - 1, -1, -1):
        s = ids[t * lanes : (t + 1) * lanes]
        x, f = state[: len(s)], f_of[s]
        full = x >= top * f
        words[t] = (x[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        x = np.where(full, x >> np.uint64(32), x)
        whole, rest = np.divmod(x, f)
        state[: len(s)] = (whole << b) + rest + cum[s]
        if t % every == 0:
            marks[t] = state.copy()
    at = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype("<u4")
    stream = np.concatenate(words) if words else np.empty(0, np.uint32)
    body = b"".join(at[t : t + 1].tobytes() + marks[t].astype("<u8").tobytes() for t in sorted(marks)) + stream.astype("<u4").tobytes()
    head = _HEADER.pack(_MAGIC, 1, lanes, bits, len(ids), len(marks), len(stream), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(freq.astype("<u4").tobytes()))
    return head + body + struct.pack("<I", zlib.crc32(head + body))


def decode_part(block: bytes, freq: np.ndarray, mark: int, every: int = EVERY) -> np.ndarray:
    """The ids from one checkpoint to the next, without the rest of the block."""
    _, _, lanes, bits, n, marks, n_words, _, _ = _HEADER.unpack_from(block)
    size = 4 + 8 * lanes
    at = _HEADER.size + mark * size
    pos = int(np.frombuffer(block, "<u4", 1, at)[0])
    state = np.frombuffer(block, "<u8", lanes, at + 4).copy()
    words = np.frombuffer(block, "<u4", n_words, _HEADER.size + marks * size)
    cum = np.concatenate(([0], np.cumsum(freq)))[:-1].astype(np.uint64)
    symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
    f_of, mask, b = freq.astype(np.uint64), np.uint64((1 << bits) - 1), np.uint64(bits)
    out = []
    for first in range(mark * every * lanes, min(n, (mark + 1) * every * lanes), lanes):
        x = state[: min(lanes, n - first)]
        slot = x & mask
        s = symbol[slot]
        x = f_of[s] * (x >> b) + slot - cum[s]
        low = x < _LOW
        took = int(low.sum())
        x[low] = (x[low] << np.uint64(32)) | words[pos : pos + took]
        pos += took
        state[: len(x)] = x
        out.append(s)
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def decode_block(block: bytes, freq: np.ndarray, every: int = EVERY) -> np.ndarray:
    """All ids of a block; raises ValueError where a checksum doesn't fit."""
    if len(block) < _HEADER.size + 4 or block[:4] != _MAGIC or zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("the block is damaged")
    *_, marks, _, ids_crc, table_crc = _HEADER.unpack_from(block)
    if zlib.crc32(freq.astype("<u4").tobytes()) != table_crc:
        raise ValueError("the block was made with another frequency table")
    ids = np.concatenate([np.empty(0, np.uint32), *(decode_part(block, freq, m, every) for m in range(marks))])
    if zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("the ids don't fit their checksum")
    return ids


def write_tokens(docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> None:
    """Tokenises all texts and writes them under `path`: blocks/ (Parquet, one block a row) and table/ (id, frequency).

    Rows are exchanged once, by ranges of the id, and tokenised in that order; ids are written to the shared folder with the
    range's number and their place in it, with each range's counts of ids, and encoded from there in blocks of whole documents with at least
    2**20 ids. Only the counts by id, at most as many as the vocabulary has, come to the driver; they are the
    frequency table, made over all documents and sent to all tasks.

    Each document ends with `end_id`. Null text counts as empty; null ids come first; rows that repeat an id
    follow one another, by the hash of their texts. An empty table gives no blocks and an empty table/.
    """
    spark = docs.sparkSession
    python_workers(spark)
    kind = docs.schema[id_col].dataType

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end, at, part, total = _encoder(tokenizer).ids, struct.pack("<I", end_id), 0, TaskContext.get().partitionId(), np.zeros(0, np.int64)

        def rows(docs: pa.Array, starts: np.ndarray, packed: list[bytes | None], seen: list, times: list) -> pa.RecordBatch:
            values = np.full(len(docs), part, np.int32), docs, starts, packed, seen, times
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], [f.name for f in fields])

        for b in batches:
            ids = [x + end for x in ids_of(b.column(1).to_pylist())]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            total = _sum(total, np.bincount(np.frombuffer(b"".join(ids), "<u4")))
            # two planes of bytes pack better than whole integers
            packed = [np.frombuffer(x, np.uint8).reshape(-1, 4).T.tobytes() for x in ids]
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            yield rows(b.column(0), starts, packed, [None] * len(n), [None] * len(n))
        some = np.nonzero(total)[0]
        yield rows(pa.nulls(1, types[1]), np.zeros(1, np.int64), [None], [some], [total[some]])

    fields = [T.StructField("part", T.IntegerType()), T.StructField("id", kind), T.StructField("first", T.LongType()), T.StructField("ids", T.BinaryType())]
    fields += [T.StructField("seen", T.ArrayType(T.IntegerType())), T.StructField("times", T.ArrayType(T.LongType()))]
    types = [to_arrow_type(f.dataType) for f in fields]
    rows = docs.select(F.col(q(id_col)).alias("id"), text_of(text_col).alias("text"), F.xxhash64(q(text_col)).alias("h"))
    rows = rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h").select("id", "text")
    tokens = scratch(rows.mapInArrow(tokenise, T.StructType(fields)), "rans-ids")

    counted = tokens.filter("seen IS NOT NULL").select(F.explode(F.arrays_zip("seen", "times")).alias("x"))
    counts = counted.groupBy("x.seen").agg(F.sum("x.times").alias("n")).collect()
    tokens = tokens.filter("seen IS NULL").select("part", "id", "first", "ids")
    table = np.zeros(1 + max((r[0] for r in counts), default=-1), np.int64)
    for token, n in counts:
        table[token] = n
    freq = frequencies(table)
    spark.createDataFrame([(i, int(f)) for i, f in enumerate(freq)], "id int, frequency int").coalesce(1).write.parquet(f"{path}/table")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            ids = np.concatenate([x[3] for x in held])
            values = [held[0][0]], [held[0][2]], [[x[1] for x in held]], [[len(x[3]) for x in held]], [encode_block(ids, freq)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, shape)], [f.name for f in shape])

        shape = [pa.field("part", pa.int32()), pa.field("first", pa.int64()), pa.field("docs", pa.list_(kind_arrow)), pa.field("lengths", pa.list_(pa.int64())), pa.field("block", pa.binary())]
        size = 0
        for b in batches:
            for part, doc, first, ids in zip(*(b.column(i) for i in range(4))):
                part, first = part.as_py(), first.as_py()
                if held and (size >= BLOCK or part != held[0][0] or first != held[0][2] + size):
                    yield flush()
                    size = 0
                held.append((part, doc.as_py(), first, _unpack(ids)))
                size += len(held[-1][3])
        if held:
            yield flush()

    kind_arrow = to_arrow_type(kind)
    out = T.StructType([fields[0], fields[2], T.StructField("docs", T.ArrayType(kind)), T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("block", T.BinaryType())])
    tokens.mapInArrow(blocks, out).write.parquet(f"{path}/blocks")


def _sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum of two arrays of counts, the shorter one filled up with zeros."""
    long, short = (a, b) if len(a) >= len(b) else (b, a)
    out = long.astype(np.int64)
    out[: len(short)] += short
    return out


def _unpack(ids: pa.BinaryScalar) -> np.ndarray:
    return np.frombuffer(np.frombuffer(ids.as_buffer(), np.uint8).reshape(4, -1).T.tobytes(), "<u4")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document of what `write_tokens` wrote: id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids.

    Blocks are decoded in parallel and their checksums held against what comes out. The starts of ranges are sums over one row per range.
    """
    python_workers(spark)
    table = spark.read.parquet(f"{path}/table").orderBy("id").collect()  # as many rows as the vocabulary has at most
    freq = np.array([r[1] for r in table], np.int64)
    rows = spark.read.parquet(f"{path}/blocks")
    kind = rows.schema["docs"].dataType.elementType

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, first, docs, lengths, block in zip(*(b.column(i) for i in range(5))):
                ids = decode_block(block.as_py(), freq).astype("<u4")
                n = np.array(lengths.as_py(), np.int64)
                ends = np.cumsum(n)
                each = [ids[e - k : e].tobytes() for k, e in zip(n, ends)]
                data = [pa.array(np.full(len(n), part.as_py(), np.int32)), docs.values, pa.array(first.as_py() + ends - n), pa.array(n), pa.array([zlib.crc32(x) for x in each], pa.int64())]
                yield pa.RecordBatch.from_arrays(data + ([pa.array(each, pa.binary())] if with_ids else []), names)

    fields = [T.StructField("part", T.IntegerType()), T.StructField("id", kind), *(T.StructField(x, T.LongType()) for x in ("first", "n_tokens", "ids_crc32"))] + [T.StructField("ids", T.BinaryType())] * with_ids
    names = [f.name for f in fields]
    ranges = rows.select("part", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = small(scratch(ranges.select("part", before.alias("before")), "rans-ranges"))
    out = rows.select("part", "first", "docs", "lengths", "block").mapInArrow(decode, T.StructType(fields)).join(ranges, "part")
    return out.withColumn("start", F.col("before") + F.col("first")).select("id", "start", *(x for x in names if x not in ("part", "id", "first")))
