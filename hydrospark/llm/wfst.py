"""Operator 9, SentencePiece encoding and decoding by a weighted finite-state transducer."""

from __future__ import annotations

import functools
import heapq
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb

from .common import Kept, cols, python_workers, text_of

SPACE = "▁"
_NORMAL, _USER, _BYTE = 1, 4, 6
_CACHE_MAX = 300_000
_END = ""


class Transducer:
    """A BPE model file compiled to three machines: normaliser, pieces with byte fallback, and what may follow what.

    * The normaliser has one state with an arc for each character: a space to the sign for it, every other one to itself, after one
      such sign at the beginning (as the model file says; models with a character map are refused).
    * The piece machine is a trie: an arc per character, and from the end of a piece an arc back to the start that puts out
      the piece. A character that no piece begins with has arcs of its own, whose outputs are its UTF-8 bytes' pieces.
    * The order machine has a state per piece. Its arc from piece a to piece b weighs 0 if merging leaves the two apart where
      they meet, else infinity; weights are worked out where a path first needs them. A sequence of pieces is what BPE gives
      exactly if all its arcs weigh 0. (That merges can be undone pair by pair to tell this is known from published work on BPE in linear time.)

    An input is composed with the three lazily: the lattice's arcs that leave a position are those of the trie, and they are
    relaxed in the tropical semiring, where weights along a path add and the least sum stays. One finite path leads to each
    position that can be reached, so a position is one state of the order machine, and the path to the end is the library's result. No
    piece goes on over the beginning of a word or holds characters of two classes (see `_classes`), so inputs are
    cut there and the paths of recent parts are kept.
    """

    def __init__(self, path: str):
        m = model_pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        n = m.normalizer_spec
        if m.trainer_spec.model_type != model_pb.TrainerSpec.BPE or n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces:
            raise ValueError("only BPE models without a character map are compiled")
        if any(p.type == _USER for p in m.pieces):
            raise ValueError("models with user-defined pieces aren't compiled")
        self.prefix = SPACE if n.add_dummy_prefix else ""
        # the inverse's outputs, one after the other as UTF-8: a byte, a piece with its spaces, or nothing
        put = [bytes([int(p.piece[3:5], 16)]) if p.type == _BYTE else p.piece.replace(SPACE, " ").encode() if p.type == _NORMAL else b"" for p in m.pieces]
        self.output, self.size = np.frombuffer(b"".join(put), np.uint8), np.array([*map(len, put)], np.int64)
        self.offset = np.cumsum(self.size) - self.size
        self.bytes_ = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == _BYTE}
        normal = [(p.piece, p.score, i) for i, p in enumerate(m.pieces) if p.type == _NORMAL]
        if any(SPACE in x.lstrip(SPACE) for x, _, _ in normal):
            raise ValueError("a piece goes over the beginning of a word")
        # states of the order machine: single characters first, then pieces in the order in which merging prefers them
        runs = [x for x, _, _ in normal if len(x) > 1 and not x.strip(SPACE)]
        self.runs = {len(x): i for x, _, i in normal if not x.strip(SPACE)}
        self.run_score = {len(x): s for x, s, _ in normal if not x.strip(SPACE)}
        ranked = sorted((x for x in normal if x[0] not in runs), key=lambda x: (len(x[0]) > 1, -x[1], x[2]))
        self.state = {x: k for k, (x, _, _) in enumerate(ranked)}
        self.label = [i for _, _, i in ranked]
        self.single = sum(len(x) == 1 for x, _, _ in ranked)
        self.merge: dict[tuple[int, int], int] = {}
        for x, k in self.state.items():
            for cut in range(1, len(x)):
                a, b = self.state.get(x[:cut]), self.state.get(x[cut:])
                if a is not None and b is not None:
                    self.merge[a, b] = k
        self.halves = [(k, k) for k in range(len(ranked))]
        for x, k in list(self.state.items()):
            if k >= self.single:
                if last := self._last_merge(x):
                    self.halves[k] = last
                else:  # merging never gets there, so no path may use it
                    del self.state[x]
        self.normal = {" ": SPACE}  # the normaliser's arcs that change a character
        self.trie: dict = {}
        for x, k in self.state.items():
            node = self.trie
            for c in x:
                node = node.setdefault(c, {})
            node[_END] = k
        self.known = re.compile("[" + "".join(re.escape(x) for x in self.state if len(x) == 1) + "]+")
        self.words = Kept(self._word)
        self.pairs: dict[int, bool] = {}  # by a << 20 | b
        one = lambda some: f"[{''.join(map(re.escape, some))}]+"
        known = {x for x in self.state if len(x) == 1 and x != SPACE}
        classes = _classes(self.state)
        alone = known.difference(*classes)
        kinds = [*map(one, classes), *([one(alone)] if alone else []), f"[^{SPACE}{''.join(map(re.escape, known))}]+"]
        self.cut = re.compile(f"{SPACE}*(?:{'|'.join(kinds)})|{SPACE}+").findall

    def _last_merge(self, x: str) -> tuple[int, int] | None:
        parts = [self.state.get(c) for c in x]
        if None in parts:
            return None
        while True:
            best = min(((self.merge.get(p, 1 << 30), i) for i, p in enumerate(zip(parts, parts[1:]))), default=(1 << 30, 0))
            if best[0] == 1 << 30:
                return None
            if len(parts) == 2:
                return (parts[0], parts[1]) if self.merge.get((parts[0], parts[1])) == self.state[x] else None
            parts[best[1] : best[1] + 2] = [best[0]]

    def _apart(self, a: int, b: int) -> bool:
        """Whether merging leaves the pieces a and b apart: undoes the later merge of the two again and again and asks if one across the gap came before."""
        first, limit, merge, halves = (a, b), 1 << 30, self.merge, self.halves
        while True:
            if merge.get((a, b), 1 << 30) < limit:
                good = False
                break
            if a > b:
                limit, a = a, halves[a][1]
                if a == limit:
                    limit, (b, old) = b + 1, (halves[b][0], b)
                    if b == old:
                        good = True
                        break
            else:
                limit, old, b = b + 1, b, halves[b][0]
                if b == old:
                    limit, old, a = a, a, halves[a][1]
                    if a == old:
                        good = True
                        break
        if len(self.pairs) > 1_000_000:
            self.pairs.clear()
        self.pairs[first[0] << 20 | first[1]] = good
        return good

    def _arcs(self, s: str, at: int) -> list[tuple[int, int]]:
        """The lattice's arcs that leave a position: (where it ends, piece), the longest last."""
        node, arcs, n = self.trie, [], len(s)
        while at < n and (node := node.get(s[at])) is not None:
            at += 1
            if _END in node:
                arcs.append((at, node[_END]))
        return arcs

    def _path(self, s: str) -> list[int]:
        """The shortest path of the composition with a string of known characters, as states of the order machine.

        Weights are 0 or infinity, so all finite sums are equal and the position farthest on is settled first. Each position
        is settled once, by the one finite path to it; where no arc goes on, the search returns to the last one with arcs left.
        """
        n, pairs, settled = len(s), self.pairs, bytearray(len(s) + 1)
        out: list[int] = []
        waiting: list[list[tuple[int, int]]] = []
        arcs = self._arcs(s, 0)
        while n:
            while not arcs:
                out.pop()
                arcs = waiting.pop()
            end, k = arcs.pop()
            if settled[end]:
                continue
            if out:
                finite = pairs.get(out[-1] << 20 | k)
                if not (self._apart(out[-1], k) if finite is None else finite):
                    continue
            settled[end] = 1
            out.append(k)
            if end == n:
                break
            waiting.append(arcs)
            arcs = self._arcs(s, end)
        return out

    def _run(self, n: int) -> list[int]:
        """Spaces in a row: the two neighbours whose piece scores best are merged, the leftmost ones first. A queue holds rank * n + place; entries that no longer hold are passed over."""
        scores = sorted({-s for s in self.run_score.values()})
        rank = {size: scores.index(-s) for size, s in self.run_score.items()}
        size, before, after = [1] * n, list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [rank[2] * n + i for i in range(n - 1)] if 2 in rank else []  # sorted, so a heap
        while queue:
            best, i = divmod(heapq.heappop(queue), n)
            j = after[i]
            if not size[i] or j == n or rank.get(size[i] + size[j]) != best:
                continue
            size[i], size[j], after[i] = size[i] + size[j], 0, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (r := rank.get(size[k] + size[after[k]])) is not None:
                    heapq.heappush(queue, r * n + k)
        return [self.runs[x] for x in size if x]

    def _word(self, chunk: str) -> bytes:
        rest = chunk.lstrip(SPACE)
        spaces = len(chunk) - len(rest)
        body, ids, at = (SPACE if spaces else "") + rest, [], 0
        for part in self.known.finditer(body):
            ids += [self.bytes_[b] for b in body[at : part.start()].encode()]
            ids += map(self.label.__getitem__, self._path(part.group()))
            at = part.end()
        ids += [self.bytes_[b] for b in body[at:].encode()]
        if spaces > 1:
            alone = ids[0] == self.runs[1]
            ids = self._run(spaces if alone else spaces - 1) + ids[alone:]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers; an empty text has none."""
        if not text:
            return b""
        for symbol, output in self.normal.items():
            text = text.replace(symbol, output)
        if len(self.words) > _CACHE_MAX:
            self.words = Kept(self._word, self.words)
        return b"".join(map(self.words.__getitem__, self.cut(self.prefix + text)))

    def decode(self, ids: bytes) -> str:
        """The inverse transducer: pieces to text, bytes joined to characters, signs for spaces to spaces, the first one dropped."""
        at = np.frombuffer(ids, "<u4")
        size, start = self.size[at], self.offset[at]
        ends = np.cumsum(size)
        if not len(at) or not ends[-1]:
            return ""
        text = self.output[np.arange(ends[-1]) + np.repeat(start - ends + size, size)].tobytes().decode(errors="replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def _classes(pieces: Iterable[str]) -> list[set[str]]:
    """Characters in classes such that every piece, the sign for a space aside, has those of one class only; classes of one character are left out."""
    of: dict[str, set[str]] = {}
    for x in pieces:
        both = set(x) - {SPACE}
        if len(both) > 1:
            both = both.union(*(of.get(c, ()) for c in both))
            of |= dict.fromkeys(both, both)
    return list({id(c): c for c in of.values()}.values())


@functools.cache
def transducer(path: str) -> Transducer:
    """Compiled once per Python worker."""
    return Transducer(path)


def encode_column(text: Column, model: str) -> Column:
    """Of a text (null counts as empty) its ids as binary (little-endian unsigned 32-bit integers) and the text that these ids give back."""

    @F.pandas_udf("ids binary, decoded string")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        t = transducer(model)
        for texts in batches:
            ids = texts.fillna("").map(t.encode)
            yield pd.DataFrame({"ids": ids, "decoded": ids.map(t.decode)})

    return encode(text)


def decode_column(ids: Column, model: str) -> Column:
    """The text of ids in binary form; null counts as no ids."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = transducer(model)
        for x in batches:
            yield x.map(lambda b: t.decode(b or b""))

    return decode(ids)


def encode_pieces(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """Adds ids (binary, little-endian unsigned 32-bit integers), n_tokens and decoded (the text that the ids give back) to every row, without a shuffle.

    Null and empty texts have no ids and decode to the empty text. The decoded text equals the input but for the sign for a
    space, which comes back as a space. Columns that bear an output's name are replaced; an empty table stays empty.
    """
    python_workers(docs.sparkSession)
    out = docs.withColumn("__wfst", encode_column(text_of(text_col), model))
    own = ("ids", "n_tokens", "decoded")
    n_tokens = (F.octet_length("__wfst.ids") / 4).cast("long").alias("n_tokens")
    return out.select(*cols(docs, *own), "__wfst.ids", n_tokens, "__wfst.decoded")
