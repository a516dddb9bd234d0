"""Operator 4, exact dedup by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cols, q, scratch, small, text_of

_LEN, _PRE, _SHA, _HIT = "__ed_len", "__ed_prefix", "__ed_sha", "__ed_hit"


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 128, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Adds keep_id, group_size and kept to every row of `docs`.

    Rows are narrowed in three passes. Only rows whose byte length occurs twice get a prefix hash; only rows whose
    (length, prefix hash) occurs twice get a SHA-256 of the whole text; groups are those with equal length, prefix and
    SHA-256. Every pass shuffles counts that were summed on the map side, never texts, so a huge group of copies
    costs one row per task. The tables of surviving keys are broadcast when they have at most `broadcast_rows` rows
    and joined by a shuffle otherwise.

    Null text counts as empty, so null and empty texts form one group. The row with the largest id stays; a null id is
    less than any other, and a group of null ids only has keep_id null. Of rows that repeat both the largest id
    and the text, one stays. Columns of `docs` that bear an output's name are replaced. An empty table stays empty.
    """
    text, ident = text_of(text_col), F.col(q(id_col))
    docs = docs.select(*cols(docs, "keep_id", "group_size", "kept"))
    base = docs.withColumn(_LEN, F.octet_length(text))

    # 1: lengths that occur twice
    lens = scratch(base.groupBy(_LEN).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(_LEN), "ed-lengths")
    by_len = base.join(small(lens, broadcast_rows), _LEN, "left_semi").withColumn(_PRE, F.xxhash64(F.substring(text, 1, prefix_chars)))
    # 2: prefixes that occur twice among those
    keys = scratch(by_len.groupBy(_LEN, _PRE).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(_LEN, _PRE, F.lit(True).alias(_HIT)), "ed-prefixes")
    near = small(keys, broadcast_rows)
    # 3: whole texts of what is left
    full = base.withColumn(_PRE, F.xxhash64(F.substring(text, 1, prefix_chars))).join(near, [_LEN, _PRE], "left_semi").withColumn(_SHA, F.sha2(text, 256))
    groups = scratch(
        full.groupBy(_LEN, _PRE, _SHA, ident.alias("__ed_id")).agg(F.count(F.lit(1)).alias("n"))
        .groupBy(_SHA, _LEN).agg(F.max_by("__ed_id", F.struct("__ed_id")).alias("keep_id"), F.max_by("n", F.struct("__ed_id")).alias("__ed_ties"), F.sum("n").alias("group_size"))
        .filter("group_size > 1").drop(_LEN),
        "ed-groups",
    )
    # rows outside any group get a key of their own, so that they spread over the join's tasks
    alone = F.concat(F.lit("-"), F.xxhash64(ident, F.col(_LEN), F.col(_PRE)).cast("string"))
    rows = base.withColumn(_PRE, F.xxhash64(F.substring(text, 1, prefix_chars))).join(near, [_LEN, _PRE], "left")
    rows = rows.withColumn(_SHA, F.when(F.col(_HIT), F.sha2(text, 256)).otherwise(alone)).join(small(groups, broadcast_rows), _SHA, "left")
    mine = F.col("group_size").isNull() | ident.eqNullSafe(F.col("keep_id"))
    out = [*cols(docs), F.when(F.col("group_size").isNull(), ident).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size")]
    if not groups.filter("__ed_ties > 1").take(1):
        return rows.select(*out, mine.alias("kept"))
    tied = mine & (F.coalesce("__ed_ties", F.lit(1)) > 1)  # only rows that repeat id and text need a rank
    nth = F.row_number().over(Window.partitionBy(_SHA).orderBy(_LEN))
    return rows.filter(~tied).select(*out, mine.alias("kept")).unionByName(rows.filter(tied).select(*out, (nth == 1).alias("kept")))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with its columns; a column named kept, keep_id or group_size is carried along."""
    own = {c: f"__ed_own_{i}" for i, c in enumerate(docs.columns) if c.lower() in ("keep_id", "group_size", "kept")}
    out = exact_dedup(docs.withColumnsRenamed(own), own.get(id_col, id_col), own.get(text_col, text_col)).filter("kept")
    return out.drop("keep_id", "group_size", "kept").withColumnsRenamed({v: k for k, v in own.items()}).select(*cols(docs))
