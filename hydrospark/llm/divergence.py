"""Operator 12, source divergence audit: each source's words against its language's and against every other source's."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, python_workers, q, scratch, small
from .text_bytes import TERMS

#: Probabilities are whole numbers of this many parts.
SCALE = 1_000_000_000
#: Counts that a Python worker holds before it passes them on, and sources whose columns it holds at once.
_HELD, _TILE = 150_000, 256


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents by (lang, source, term), summed as far as `_HELD` entries reach."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (terms, docs) in held.items():
            n = len(terms)
            columns = [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(list(terms), pa.binary()), pa.array(list(terms.values()), pa.int64()), pa.array([docs[t] for t in terms], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

    for b in batches:
        for lang, source, text in zip(*(b.column(i).to_pylist() for i in range(3))):
            words = text.encode().translate(TERMS).split()
            terms, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before = len(terms)
            terms.update(words)
            docs.update(set(words))
            size += len(terms) - before
            if size > _HELD:
                yield from out()
                held, size = {}, 0
    yield from out()


def term_counts(docs: DataFrame, min_docs: int = 3) -> DataFrame:
    """(lang, source, term, n, lang_n, first): occurrences of the terms that at least `min_docs` documents of the lang have; `first` is true in one row of each (lang, term).

    Texts are counted where they are read; what moves is one row per task, group and term. The rows of a term meet in one task by (lang, term), and all further steps keep that partitioning.
    """
    python_workers(docs.sparkSession)
    counted = docs.select("lang", "source", "text").mapInArrow(_counted, "lang string, source string, term binary, n long, docs long")
    mine = Window.partitionBy("lang", "term")
    by_source = counted.withColumn("term", F.col("term").cast("string")).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    rows = by_source.withColumns({"lang_n": F.sum("n").over(mine), "lang_docs": F.sum("docs").over(mine), "first": F.row_number().over(mine.orderBy("source")) == 1})
    return rows.filter(F.col("lang_docs") >= min_docs).drop("docs", "lang_docs")


def _share(n: Column, total: Column, terms: Column) -> Column:
    """p, exact: the product needs more than 64 bits once a word occurs some 9 thousand million times."""
    whole = F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)")
    return F.call_function("div", whole, (total + terms).cast("decimal(20,0)")) + 1


def _shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    each, at = np.unique(counts, return_inverse=True)
    return np.array([1 + SCALE * (int(c) + 1) // (total + terms) for c in each], np.int64)[at.reshape(counts.shape)]


def _block_sums(rows: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums of f over one block of terms, for all ordered pairs of the sources of its lang; a tile of sources is held at a time."""
    names = groups.column("source").to_pylist()
    total, terms = groups.column("total").to_pylist(), groups.column("terms").to_pylist()
    place = {s: i for i, s in enumerate(names)}
    row = rows.column("term").combine_chunks().dictionary_encode() if rows.num_rows else None
    t = np.asarray(row.indices) if row is not None else np.zeros(0, np.int64)
    many = len(row.dictionary) if row is not None else 0
    s = np.array([place[x] for x in rows.column("source").to_pylist()], np.int64)
    n = rows.column("n").to_numpy() if rows.num_rows else np.zeros(0, np.int64)
    order = np.argsort(s, kind="stable")
    t, s, n = t[order], s[order], n[order]
    cuts = np.searchsorted(s, np.arange(len(names) + 1))

    def column(i: int) -> np.ndarray:
        out = np.zeros(many, np.int64)
        out[t[cuts[i] : cuts[i + 1]]] = n[cuts[i] : cuts[i + 1]]
        return _shares(out, total[i], terms[i])

    sums = np.zeros((len(names), len(names)), np.int64)
    for at in range(0, len(names), _TILE):
        tile = range(at, min(at + _TILE, len(names)))
        other = np.stack([column(j) for j in tile])
        for i in range(len(names)):
            d = column(i) - other
            sums[i, at : tile.stop] = (d * d // other).sum(axis=1)
    a, b = np.nonzero(~np.eye(len(names), dtype=bool))
    take = lambda i: pa.array(names, pa.string()).take(pa.array(i))
    return pa.table({"lang": pa.array([groups.column("lang")[0].as_py()] * len(a), pa.string()), "source": take(a), "item": take(b), "value": pa.array(sums[a, b])})


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = 3, top: int = 200, block_terms: int = 8192, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """How far each (lang, source) group's words are from its lang's other sources (part `pair`) and which words it has too often (part `term`).

    Returns lang, source, part, item, value, rank. A lang keeps the V terms that at least `min_docs` of its rows have; a group, or the lang, gives a
    kept term p = 1 + floor(SCALE * (count + 1) / (N + V)) and f = floor((p - q)**2 / q), all in whole numbers.

    * `term` ranks cells in place of terms: terms with equal counts in group and lang have one value, so values are worked out once for each (group count, lang count) with
      its multiplicity, equal values are merged, and multiplicities summed from the largest value on tell which cells reach the first `top` ranks. Only those cells are
      joined with their terms, which are ranked in UTF-8 order within a value.
    * `pair` sums f over all kept terms for every ordered pair of sources. Terms are dealt into blocks of about `block_terms`; a task lays the counts of one
      block side by side and sums each pair, so a hot lang or term is one block's column and no pair of rows is emitted per term.

    Null lang, source and text count as ''. Every occurring group is ranked, without terms too; with V = 0 all its pairs have value 0. Repeated ids are documents of their own.
    The pairs of a lang are the square of its sources, as asked. An empty table gives no rows; further columns of `docs` are not read.
    """
    docs = docs.select(*(F.coalesce(F.col(q(c)).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    groups = docs.select("lang", "source").distinct()
    kept = scratch(term_counts(docs, min_docs), "dv-terms")
    langs = scratch(kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("first").alias("terms")), "dv-langs")
    totals = groups.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang", "left")
    totals = scratch(totals.na.fill(0, ["total", "lang_total", "terms"]), "dv-groups")

    cells = kept.groupBy("lang", "source", "n", "lang_n").agg(F.count(F.lit(1)).alias("many")).join(small(totals, broadcast_rows), ["lang", "source"])
    cells = cells.withColumns({"p": _share(F.col("n"), F.col("total"), F.col("terms")), "q": _share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))}).filter("p > q")
    cells = scratch(cells.select("lang", "source", "n", "lang_n", "many", F.expr("((p - q) * (p - q)) div q").alias("value")), "dv-cells")
    falling = Window.partitionBy("lang", "source").orderBy(F.col("value").desc())
    values = cells.groupBy("lang", "source", "value").agg(F.sum("many").alias("many")).withColumn("nth", F.row_number().over(falling)).filter(F.col("nth") <= top)
    values = values.withColumn("before", F.sum("many").over(falling.rowsBetween(Window.unboundedPreceding, 0)) - F.col("many")).filter(F.col("before") < top)
    reach = scratch(cells.join(values.select("lang", "source", "value"), ["lang", "source", "value"], "left_semi").drop("many"), "dv-reach")
    terms = kept.join(small(reach, broadcast_rows), ["lang", "source", "n", "lang_n"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")

    blocks = -(-(langs.agg(F.max("terms")).first()[0] or 1) // block_terms)
    block = F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int").alias("block")
    spread = totals.select("lang", "source", "total", "terms", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    sums = kept.select("lang", block, "term", "source", "n").groupBy("lang", "block").cogroup(spread.groupBy("lang", "block")).applyInArrow(_block_sums, "lang string, source string, item string, value long")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    def ranked(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")))

    return ranked(pairs).unionByName(ranked(terms).filter(F.col("rank") <= top))
