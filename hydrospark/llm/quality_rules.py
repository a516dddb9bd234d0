"""Operator 2, quality rules by cross-document line frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, q, scratch, text_of, words_of

#: White space within a line, and the characters that count as symbols.
_IN_LINE, _SPACE = r"[\x20\x09\x0B-\x0D]+", " \t\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"
#: Up to so many repeated windows of a text are looked up one by one.
_FEW = 200
_ROW, _HOST, _SELF, _LINES = "__qr_row", "__qr_host", "__qr_self", "__qr_lines"


def clean_lines(text: Column) -> Column:
    """The lines of a text with runs of white space as one space and without white space at the ends."""
    return F.transform(F.split(F.regexp_replace(text, _IN_LINE, " "), "\n", -1), lambda x: F.trim(x))


def line_key(line: Column) -> Column:
    """The hash of a clean line in lower case. No word: null."""
    return F.when(line != "", F.xxhash64(F.lower(line)))


def three_word_windows(words: Column) -> Column:
    """The hashes of all 3-word windows of an array of words, in order."""
    starts = lambda w: F.when(F.size(w) > 2, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
    over = lambda h: F.transform(starts(h), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))
    return let(F.transform(words, lambda w: F.xxhash64(w)), over)


def repeated(hashes: Column) -> Column:
    """The distinct values that a sorted array holds twice or more."""
    return F.array_distinct(F.filter(hashes, lambda x, j: x == F.get(hashes, j + 1)))


def repeat_words(grams: Column, twice: Column) -> Column:
    """How many words lie in a 3-word window that occurs twice or more: from the windows' hashes in order and those that repeat.

    Most texts repeat few, which are looked up one by one. Where many repeat, hashes sorted with their places put equal windows
    side by side. The places of repeated ones, in order, cover three words each, less where they overlap.
    """
    at = lambda a, i: F.get(a, i)["h"]
    placed = lambda g: F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

    def side_by_side(a: Column) -> Column:
        twin = F.filter(a, lambda x, j: (x["h"] == F.when(j > 0, at(a, j - 1))) | (x["h"] == at(a, j + 1)))
        return F.sort_array(F.transform(twin, lambda x: x["i"]))

    def covered(spots: Column) -> Column:
        step = F.transform(spots, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(spots, j + 1) - x, F.lit(3))))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    few = F.filter(F.transform(grams, lambda h, i: F.when(F.array_contains(twice, h), i)), lambda i: i.isNotNull())
    many = let(F.sort_array(placed(grams)), side_by_side)
    return F.when(F.size(twice) == 0, 0).otherwise(let(F.when(F.size(twice) <= _FEW, few).otherwise(many), covered)).cast("long")


def line_frequency(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = 20,
    min_words: int = 50, max_repeat_pct: int = 50, min_kept_share: float = 0.3, copies_once: bool = False, rewrite: bool = True,
) -> DataFrame:
    """Adds the counts of the base rules, the method's counts and `kept` to every row; with `rewrite`, the text loses its frequent lines, else it is left out.

    Base rules fail a text with fewer than `min_words` words or with more than `max_repeat_pct` percent of its words in
    3-word windows that the text repeats. The method: every line with a word is normalised (lower case, single spaces)
    and hashed, and per host (`host_col`) the distinct documents (`id_col`) with that line are counted. A line found in more
    than `max_docs` documents of a host is removed from all documents of that host, and a document that is left with fewer
    than `min_words` words or less than `min_kept_share` of them is rejected. With `copies_once`, documents of equal
    normalised lines count as one, so that an article that was copied thousands of times isn't taken for boilerplate; texts
    that differ in any word are different documents, however long the passages that they share.

    Texts are read once: one pass writes every row's counts and its lines as (hash, words) to the shared folder, with the
    text itself only if it is to be rewritten. Lines are exploded as hashes, counted with sums on the map side (a line
    in a third of all documents is a few rows per task), and frequent ones find their rows by a join of hashes
    whose hot keys Spark splits. The verdict comes back by the number that each written row has.

    Null text has no words and fails. Null hosts are one host, null ids one document. Rows that repeat are judged each for itself and
    count once. A line that occurs twice in a document counts once for it and is removed at both places. Columns that bear
    an output's name are replaced; an empty table stays empty.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_frequent_lines", "n_kept_words", "kept")
    carried = [c for c in docs.columns if c.lower() not in names and (rewrite or c != text_col)]

    # 1: one pass over the texts
    def measured(line: Column) -> Column:
        letters = F.char_length(F.replace(line, F.lit(" "), F.lit("")))
        return F.struct(line_key(line).alias("h"), F.when(line != "", F.char_length(line) - letters + 1).otherwise(0).alias("n"), letters.alias("c"))

    one = docs.select(*map(F.col, map(q, carried)), text_of(text_col).alias("__qr_text"), *(F.xxhash64(q(c), F.col(q(c)).isNull()).alias(x) for c, x in ((host_col, _HOST), (id_col, "__qr_id"))))
    one = one.withColumns({"__qr_all": F.transform(clean_lines(F.col("__qr_text")), measured), "__qr_grams": three_word_windows(words_of(F.col("__qr_text")))})
    one = one.withColumn("__qr_sorted", F.sort_array("__qr_grams")).withColumn("__qr_twice", repeated(F.col("__qr_sorted")))
    total = lambda k: F.aggregate("__qr_all", F.lit(0).cast("long"), lambda a, x: a + x[k])
    with_word = F.filter(F.split("__qr_text", "\n", -1), lambda x: F.rtrim(x, F.lit(_SPACE)) != "")
    self = F.xxhash64(F.col("__qr_all")["h"]) if copies_once else F.col("__qr_id")
    rows = one.select(
        *map(F.col, map(q, carried)), F.monotonically_increasing_id().alias(_ROW), _HOST, self.alias(_SELF), F.filter("__qr_all", lambda x: x["n"] > 0).alias(_LINES),
        total("n").alias("__n_words"), total("c").alias("__word_chars"), F.regexp_count("__qr_text", F.lit(SYMBOLS)).cast("long").alias("__n_symbols"),
        let(with_word, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("__n_dup_lines"), repeat_words(F.col("__qr_grams"), F.col("__qr_twice")).alias("__n_repeat_words"),
    )
    rows = scratch(rows, "qr-rows")

    # 2: lines of too many documents of a host, and what each row loses by them
    seen = rows.select(_ROW, _HOST, _SELF, F.explode(_LINES).alias("x")).select(_ROW, _HOST, _SELF, "x.h", "x.n")
    often = seen.select(_HOST, "h", _SELF).distinct().groupBy(_HOST, "h").count().filter(F.col("count") > max_docs).select(_HOST, "h")
    lost = seen.join(often, [_HOST, "h"]).groupBy(_ROW).agg(F.sum("n").alias("__qr_lost"), F.count(F.lit(1)).alias("__qr_gone"), F.collect_set("h").alias("__qr_set"))

    # 3: the verdict
    out = rows.drop(_LINES).join(lost if rewrite else lost.drop("__qr_set"), _ROW, "left")
    zero = F.lit(0).cast("long")
    failed = (F.col("__n_words") < min_words) | (100 * F.col("__n_repeat_words") > max_repeat_pct * F.col("__n_words"))
    left = F.col("__n_words") - F.coalesce("__qr_lost", zero)
    depleted = F.col("__qr_lost").isNotNull() & ((left < min_words) | (left < min_kept_share * F.col("__n_words")))
    done = [F.col(f"__{x}").alias(x) for x in names[:5]] + [failed.alias("base_failed"), F.coalesce("__qr_gone", zero).alias("n_frequent_lines"), left.alias("n_kept_words"), (~failed & ~depleted).alias("kept")]
    if not rewrite:
        return out.select(*map(F.col, map(q, carried)), *done)
    pair = F.arrays_zip(F.split(text_of(text_col), "\n", -1).alias("line"), clean_lines(text_of(text_col)).alias("clean"))
    stays = F.filter(pair, lambda x: ~F.coalesce(F.array_contains("__qr_set", line_key(x["clean"])), F.lit(False)))
    new = F.when(F.col("__qr_set").isNull(), F.col(q(text_col))).otherwise(F.array_join(stays["line"], "\n"))
    return out.select(*(new.alias(c) if c == text_col else F.col(q(c)) for c in carried), *done)
