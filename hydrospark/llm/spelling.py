"""Operator 13, spelling variant grouping: words one edit apart, found by pivotal grams, and the commoner form each leads to."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import python_workers, q, scratch
from .text_bytes import RUNS

#: Words that a Python worker holds before it passes their counts on.
_HELD = 300_000


def _counted(deleted: int, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        crc32 = zlib.crc32

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for ident, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                start = crc32(f"{ident}:".encode())
                for w, n in Counter(text.encode("latin-1", "replace").translate(RUNS).split()).items():
                    if len(w) < least:
                        continue
                    h = crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
                    if not h % deleted:
                        k = h % len(w)
                        w = w[:k] + w[k + 1 :]
                        if len(w) < least:
                            continue
                    held[w] += n
                if len(held) > _HELD:
                    yield out()
                    held.clear()
        yield out()

    return count


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", deleted: int = 97, least: int = 5, min_n: int = 3) -> DataFrame:
    """(word, n) of the runs of letters with at least `least` characters and `min_n` occurrences, after the deletions that `<id>:<run>` decides."""
    python_workers(docs.sparkSession)
    ids = F.coalesce(F.col(q(id_col)).cast("string"), F.lit("null")).alias("id")
    counted = docs.select(ids, F.coalesce(F.col(q(text_col)), F.lit("")).alias("text")).mapInArrow(_counted(deleted, least), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_n)


def pivots(grams: list[tuple[int, str, int]]) -> tuple[int, int]:
    """The places of two grams of a word's prefix that share no character and are rarest together.

    Dynamic programming over the places in order: the best single gram that ends before a place, and the best pair up to it.
    """
    best: tuple[int, int, int] | None = None
    waiting: list[tuple[int, int]] = []  # (place, rank) not yet behind by two places
    single: tuple[int, int] | None = None  # (rank, place) of the rarest gram that ends before
    for rank, _, at in sorted(grams, key=lambda g: g[2]):
        while waiting and waiting[0][0] + 2 <= at:
            p, r = waiting.pop(0)
            single = min(single or (r, p), (r, p))
        if single:
            found = (single[0] + rank, single[1], at)
            best = min(best or found, found)
        waiting.append((at, rank))
    return best[1], best[2]


def _keys(word: str, end: int, side: str) -> Iterator[str]:
    """What two words one edit apart share if the gram with `end` characters up to its outer end survives and the edit lies beyond it.

    Up to the gram (side `l`: from the left, `r`: from the right) all characters are equal. Of the rests the shorter has m characters, and one edit leaves its first
    m // 2 or its last m - m // 2 equal. m is this word's or, if the other one is shorter, one less.
    """
    size = len(word)
    for m in (size - end, size - end - 1):
        if m < 0:
            continue
        h = m // 2
        head = f"{side}{end},{m}"
        if side == "l":
            yield f"{head}<{word[: end + h]}"
            yield f"{head}>{word[:end]},{word[size - m + h :]}"
        else:
            yield f"{head}<{word[size - end - h :]}"
            yield f"{head}>{word[size - end :]},{word[: m - h]}"


def _indexed(rank: dict[str, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (key, word, n, pivot): the keys of a word's two pivots, and those of all grams of its prefix."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys: list[str] = []
            owner: list[int] = []
            pivot: list[bool] = []
            for row, w in enumerate(b.column(0).to_pylist()):
                grams = sorted((rank[w[i : i + 2]], w[i : i + 2], i) for i in range(len(w) - 1))
                prefix = [g for k, g in enumerate(grams) if k < 3 or g[1] == grams[2][1]]
                left, right = pivots(prefix)
                for wanted, ends in ((True, ([left + 2], [len(w) - right])), (False, ([g[2] + 2 for g in prefix], [len(w) - g[2] for g in prefix]))):
                    mine = {k for side, all_ in zip("lr", ends) for end in all_ for k in _keys(w, end, side)}
                    keys += mine
                    owner += [row] * len(mine)
                    pivot += [wanted] * len(mine)
            at = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), b.column(0).take(at), b.column(1).take(at), pa.array(pivot, pa.bool_())], ["key", "word", "n", "pivot"])

    return index


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): both directions of every pair of words that one insertion, deletion or replacement tells apart, once.

    Two-character grams are ranked by how many words' places they fill, rarest first. A word's prefix is its three rarest grams (with all further ones equal to the third), and
    among those are always two that share no character: its pivots. One edit spoils one of them at most, so of two words one edit apart, the one whose third
    gram ranks no later has a pivot among the prefix of the other. Position limits: a surviving pivot is at the same place from the left if the edit is on its
    right, else from the right, and all characters on the side away from the edit are equal; so that side and half of the rest are part of the key (`_keys`), and
    a common gram does not bring all its words together. Words of five characters or more have the four grams that this needs. Candidates are verified.

    The ranks are at most 8100 (26 + 64 letters squared), so each worker gets them whole.
    """
    spark = words.sparkSession
    python_workers(spark)
    gram = F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))).alias("gram")
    rank = {r.gram: k for k, r in enumerate(sorted(words.select(gram).groupBy("gram").count().collect(), key=lambda r: (r["count"], r.gram)))}
    keyed = scratch(words.select("word", "n").mapInArrow(_indexed(rank), "key string, word string, n long, pivot boolean").withColumn("key", F.xxhash64("key")), "sp-keys")
    a = keyed.filter("pivot").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = keyed.filter("NOT pivot").select("key", F.col("word").alias("b"), F.col("n").alias("b_n"))
    pairs = a.join(b, "key").filter((F.col("a") != F.col("b")) & (F.levenshtein("a", "b", 1) == 1))
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))))
    return pairs.select(both.alias("p")).select("p.*").distinct()


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", deleted: int = 97, least: int = 5, min_n: int = 3, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the corpus.

    Words are counted where texts are read and summed by word; near words come from `near_words`. A word's form is its near word of largest n (ties: the smallest in code-point order) if that
    n is at least `ratio` times its own, else null. The root follows the forms to the last; n grows by `ratio` at each step, so paths are
    short and acyclic, and jumping from root to root halves them in each round.

    Null text counts as empty, a null id is written `null` before a run; repeated rows count again. `least` is 5 at least: shorter words have too few grams for the search.
    An empty table gives no rows; further columns of `docs` are not read.
    """
    if least < 5 or ratio < 2:
        raise ValueError("words of at least 5 characters and a ratio of at least 2 are needed")
    words = scratch(word_counts(docs, id_col, text_col, deleted, least, min_n), "sp-words")
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near"))).alias("best")
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    rows = words.join(near, "word", "left")
    has = F.col("best.near_n") >= ratio * F.col("n")
    rows = scratch(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best.near")).alias("form"), F.when(has, F.col("best.near_n")).alias("form_n")), "sp-forms")
    roots = rows.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # rounds: the logarithm of the longest path
        step = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        nearer = scratch(roots.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "sp-roots")
        roots = nearer.drop("moved")
        if not nearer.filter("moved").take(1):
            break
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
