"""Operator 8, mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, WORD, cols, q, scratch, small, text_of

#: Random numbers have 52 bits, so they and their odds are exact doubles.
_BITS, _STEP = 52, 13
_OUT = ("size", "source_size", "target", "weight", "p", "copies")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """Adds to (source, source_size) each source's target, whole copies and residual.

    Sources in order of code point, null last, take `weights` in turn and share `share` of all sizes. A target stops
    at `limit` times its source; the excess goes to the others by weight until none is above, which is the level L with
    sum(min(cap, L * weight)) = share * total. One row per source comes in here, so the ordering window is small.
    """
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (order % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.lit(float(limit)) * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    s = s.withColumns({
        "capped": F.coalesce(F.sum("source_size").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "open": F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)),
        "total": F.sum("source_size").over(Window.partitionBy()),
    })
    # the level if all sources before this one are at their caps; the first one that stays under its source's cap is right, and the largest of those
    s = s.withColumn("level", (F.lit(float(share)) * F.col("total") - F.lit(float(limit)) * F.col("capped")) / F.col("open"))
    s = s.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(Window.partitionBy()))
    s = s.withColumn("target", F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("weight")), F.col("cap")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    s = s.withColumn("whole", F.floor(ratio).cast("long")).withColumn("rest", ratio - F.col("whole"))
    return s.select("source", "source_size", "target", "whole", "rest", (F.col("target") - F.col("whole") * F.col("source_size")).alias("residual"))


def class_odds(plan: DataFrame, classes: DataFrame) -> DataFrame:
    """Inclusion odds of each (source, weight): adds to a source's plan its certain copies by class, `p` for one more, and what words of the target are left to draw.

    `classes` has each class's words `n`. p is min(1, level * weight) with the level at which the expected words, sum(p * n), are the
    source's residual. If the classes above one weight are certain, the level is (residual - their words) / sum(weight * n) of the others; each such line lies nowhere
    below the true curve, so the largest of these levels is the right one. Classes with p = 1 get one more certain copy and leave the residual.
    """
    every = Window.partitionBy("source")
    down = every.orderBy(F.col("weight").desc())
    c = classes.join(plan.withColumnRenamed("source", "p_source"), F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source")
    c = c.withColumns({
        "above": F.coalesce(F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "open": F.sum(F.col("n") * F.col("weight")).over(down.rowsBetween(0, Window.unboundedFollowing)),
    })
    c = c.withColumn("level", F.max(F.try_divide(F.col("residual") - F.col("above"), F.col("open"))).over(every))
    c = c.withColumn("p", F.when(F.col("rest") > 0, F.least(F.lit(1.0), F.col("level") * F.col("weight"))).otherwise(0.0))
    certain = F.col("p") >= 1
    c = c.withColumn("residual", F.col("residual") - F.coalesce(F.sum(F.when(certain, F.col("n"))).over(every), F.lit(0)))
    return c.select("source", "weight", "source_size", "target", (F.col("whole") + certain.cast("long")).alias("whole"), F.when(certain, 0.0).otherwise(F.col("p")).alias("p"), "residual")


def random_number(ident: Column, text: Column, seed: int) -> Column:
    """A whole number in [0, 2**52) that depends on the id, the text and the seed only."""
    own = F.concat_ws(":", F.lit(str(seed)), F.coalesce(ident.cast("string"), F.lit("null")), F.md5(text))
    return F.conv(F.substring(F.md5(own), 1, _BITS // 4), 16, 10).cast("long")


def _cut_row(rows: DataFrame) -> DataFrame:
    """Numbers the written rows of each source from 1. A row's place in its file is fixed, so files are numbered each for itself and their counts summed."""
    rows = rows.withColumns({"__mx_file": F.col("_metadata.file_path"), "__mx_at": F.col("_metadata.row_index")})
    per_file = rows.groupBy("s_source", "__mx_file").agg(F.count("*").alias("here"))
    upto = F.sum("here").over(Window.partitionBy("s_source").orderBy("__mx_file")) - F.col("here")
    files = per_file.select(F.col("s_source").alias("f_source"), F.col("__mx_file").alias("f_file"), upto.alias("f_before"))
    rows = rows.join(files, F.col("s_source").eqNullSafe(F.col("f_source")) & (F.col("__mx_file") == F.col("f_file")))
    own = F.row_number().over(Window.partitionBy("s_source", "__mx_file").orderBy("__mx_at"))
    return rows.withColumn("__mx_nth", F.col("f_before") + own)


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0, seed: int = 17,
    size_col: str | None = None, weight_col: str | None = None, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Adds size, source_size, target, weight, p and copies (how often the mix takes the row) to every row of `docs`.

    A source whose target is r times its size gives floor(r) certain copies of each document. What is left of the target is drawn with
    unequal chances: p is the document's inclusion probability, in proportion to its `weight` and at most 1 (see `class_odds`); those with p = 1 are one more certain
    copy. The others are a Pareto order sample: documents are ranked by (u/(1-u)) / (p/(1-p)), u random but fixed by id, text and seed, and the first
    ones are taken until their words come nearest to the residual. The sample's size is fixed in words, so a source misses its target by no more than half the
    document at the cut, and copies never exceed ceil(limit).

    `weight_col` holds whole numbers from 1 to 1024; null and less count as 1, more as 1024. Without it a document's weight is the number of binary digits
    of its size, so one of 1000 words is some twice as likely as one of 30.

    The cut is found without sorting a source: sizes are summed by (source, first 13 bits of the rank), then by the
    next 13 bits inside the one bin where each source's cut lies; only that last bin, some 2**-26 of the source, is ordered, with equal ranks and sizes counted
    together first. Rows are then compared with their source's cut, which needs no shuffle of texts.

    The size is the number of words, null text 0, or `size_col`. Null is a source of its own and comes last. Ties in rank go by size. Rows that repeat the
    id and text share one rank and may be any part of their source: where the cut falls among them, just as many are taken as bring the words nearest to the residual, picked by
    their places in a written table of these rows, which a lost executor can't change. Documents of size 0 are taken as their rank says. Columns that bear an output's name are replaced; an empty table
    stays empty.
    """
    size = F.coalesce(F.col(q(size_col)), F.lit(0)).cast("long") if size_col else F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long")
    weight = F.least(F.greatest(F.coalesce(F.col(q(weight_col)).cast("long"), F.lit(1)), F.lit(1)), F.lit(1024)) if weight_col else F.length(F.bin(F.col("__mx_size"))).cast("long")
    base = docs.withColumns({"__mx_size": size, "__mx_source": F.col(q(source_col)), "__mx_u": random_number(F.col(q(id_col)), text_of(text_col), seed)}).withColumn("__mx_weight", weight)
    slim = scratch(base.select(F.col("__mx_source").alias("source"), F.col("__mx_u").alias("u"), F.col("__mx_size").alias("size"), F.col("__mx_weight").alias("weight")), "mx-slim")
    classes = scratch(slim.groupBy("source", "weight").agg(F.sum("size").alias("n")), "mx-classes")
    plan = scratch(source_targets(classes.groupBy("source").agg(F.sum("n").alias("source_size")), weights, share, limit), "mx-sources")
    odds_of = scratch(class_odds(small(plan, broadcast_rows), classes), "mx-odds")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))

    def keyed(rows: DataFrame, u: str) -> DataFrame:
        x = F.col(u) / F.lit(float(1 << _BITS))
        odds = F.try_divide(x / (1 - x), F.col("p") / (1 - F.col("p")))
        return rows.withColumn("__mx_q", odds).withColumn("__mx_key", F.floor(odds / (1 + odds) * F.lit(float(1 << _BITS))).cast("long"))

    drawn = small(odds_of.filter("p > 0").select(F.col("source").alias("p_source"), F.col("weight").alias("p_weight"), "p", "residual"), broadcast_rows)
    ranked = keyed(slim.join(drawn, same("source", "p_source") & (F.col("weight") == F.col("p_weight"))), "u")

    def crossing(rows: DataFrame, where: Column) -> DataFrame:
        """By source, the bin in which the summed sizes cross the residual, and the sum below it."""
        bins = rows.withColumn("bin", where).groupBy("source", "bin").agg(F.sum("size").alias("n"), F.first("residual").alias("residual"), F.first("below").alias("below"))
        w = Window.partitionBy("source").orderBy("bin")
        bins = bins.withColumn("upto", F.col("below") + F.sum("n").over(w))
        hit = bins.filter(F.col("upto") >= F.col("residual")).groupBy("source").agg(F.min_by(F.struct("bin", (F.col("upto") - F.col("n")).alias("below")), "bin").alias("c"))
        return hit.select(F.col("source").alias("c_source"), F.col("c.bin").alias("c_bin"), F.col("c.below").alias("c_below"))

    first, second = F.shiftright(F.col("__mx_key"), _BITS - _STEP), F.shiftright(F.col("__mx_key"), _BITS - 2 * _STEP)
    one = small(scratch(crossing(ranked.withColumn("below", F.lit(0)), first), "mx-bins1"), broadcast_rows)
    in_one = ranked.join(one, same("source", "c_source") & (first == F.col("c_bin"))).withColumn("below", F.col("c_below"))
    two = small(scratch(crossing(in_one.drop("c_source", "c_bin", "c_below"), second), "mx-bins2"), broadcast_rows)
    in_two = ranked.join(two, same("source", "c_source") & (second == F.col("c_bin")))
    tied = in_two.groupBy("source", "__mx_q", "size").agg(F.count("*").alias("n"), F.first("residual").alias("residual"), F.first("c_below").alias("c_below"))
    w = Window.partitionBy("source").orderBy("__mx_q", "size").rowsBetween(Window.unboundedPreceding, 0)
    tied = tied.withColumn("before", F.col("c_below") + F.sum(F.col("n") * F.col("size")).over(w) - F.col("n") * F.col("size"))
    # of n rows of one rank and size those whose first half is still below the residual
    fit = F.when(F.col("size") == 0, F.when(F.col("before") <= F.col("residual"), F.col("n")).otherwise(0)).otherwise(F.floor((2 * (F.col("residual") - F.col("before")) + F.col("size")) / (2 * F.col("size"))))
    last = tied.withColumn("fit", F.least(F.col("n"), fit.cast("long"))).filter("fit > 0").groupBy("source").agg(F.max(F.struct("__mx_q", "size", "fit", "n")).alias("last"))
    # a source's cut: all bins before the crossing one, and inside it the rows up to the last one taken
    cuts = odds_of.join(two.select("c_source", "c_bin"), same("source", "c_source"), "left").join(last.withColumnRenamed("source", "l_source"), same("source", "l_source"), "left")
    cuts = small(scratch(cuts.select(F.col("source").alias("s_source"), F.col("weight").alias("s_weight"), "source_size", "target", "whole", "p", "c_bin", "last"), "mx-cuts"), broadcast_rows)
    rows = keyed(base.join(cuts, same("__mx_source", "s_source") & (F.col("__mx_weight") == F.col("s_weight")), "left"), "__mx_u")
    here, there = F.struct("__mx_q", "__mx_size"), F.struct("last.__mx_q", "last.size")
    inside = F.when(F.col("c_bin").isNull(), True).when(second != F.col("c_bin"), second < F.col("c_bin")).otherwise(F.coalesce(here <= there, F.lit(False)))
    own = cols(docs, "__mx_size", *_OUT)

    def out(some: DataFrame, taken: Column) -> DataFrame:
        more = F.when(F.col("p") > 0, taken.cast("long")).otherwise(0)
        return some.select(*own, F.col("__mx_size").alias("size"), "source_size", "target", F.col("__mx_weight").alias("weight"), "p", (F.col("whole") + more).cast("long").alias("copies"))

    if cuts.filter("last.fit < last.n").isEmpty():
        return out(rows, inside)
    at_cut = F.coalesce((F.col("p") > 0) & (F.col("last.fit") < F.col("last.n")) & (second == F.col("c_bin")) & (here == there), F.lit(False))
    split = _cut_row(scratch(rows.filter(at_cut), "mx-tied"))
    return out(rows.filter(~at_cut), inside).unionByName(out(split, F.col("__mx_nth") <= F.col("last.fit")))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: each row of `docs` as often as it is taken, with the columns of `docs`, whatever their names."""
    own = {c: f"__mx_own_{i}" for i, c in enumerate(docs.columns) if c.lower() in _OUT}
    at = lambda c: own.get(c, c)
    out = mix_sources(docs.withColumnsRenamed(own), at(id_col), at(text_col), at(source_col), **options).filter("copies > 0")
    out = out.withColumn("__mx_nth", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.drop(*_OUT).withColumnsRenamed({v: k for k, v in own.items()}).select(*cols(docs))
