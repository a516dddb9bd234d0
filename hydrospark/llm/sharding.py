"""Operator 1, sharding by histogram sort: refine splitters on exact counts, then exchange once."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cols, q, scratch, text_of

_FIRST_BITS, _BITS = 12, 6
_A, _B, _NODE, _SIZE = "__sh_a", "__sh_b", "__sh_node", "__sh_size"


@dataclass
class _Cell:
    """A range of the sort key with its exact number of rows and bytes."""

    rows: int
    size: int
    span: tuple[int, int, int, int]  # least and largest first key, least and largest second key
    children: list[int] = field(default_factory=list)

    def split(self) -> tuple[int, int] | None:
        """Which key to refine (0: text hash, 1: id hash) and the shift that leaves its next 6 differing bits."""
        for k in (0, 1):
            if width := (self.span[2 * k] ^ self.span[2 * k + 1]).bit_length():
                return k, max(0, width - _BITS)
        return None  # repeated rows only


def _digit(phase: Column, shift: Column) -> Column:
    return F.when(phase == 0, F.expr(f"shiftright({_A}, __sh_shift)")).otherwise(F.expr(f"shiftright({_B}, __sh_shift)")).bitwiseAND((1 << _BITS) - 1)


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.002, fine: int = 4) -> DataFrame:
    """Adds size, shard (0 to shards-1) and slot (gapless from 0 in each shard) to every row; law: bytes.

    Rows are sorted by (hash of the text, hash of the id), so equal texts are neighbours, and shards are ranges of that
    order with nearly equal bytes. The splitters come from a histogram sort: each round counts, exactly and over all
    partitions, the rows and bytes in the cells between candidate boundaries, and cuts the cells again that are too
    coarse, 64 ways along the first bits in which their keys differ: those in which a shard boundary lies and which
    hold more than `tolerance` of a shard, and those with more than `fine` times the mean rows of a first cell, a huge group
    of copies included, which is cut along the id. The driver sees only one line per cell, a number that depends on
    the settings and not on the input: 4096 first cells, at most 4096 / fine of them heavy at any level.

    A boundary falls between two groups of equal texts if the group at that place has no more than `tolerance` of a
    shard; a larger group is divided there, so sizes stay within `tolerance` of a shard or one row of
    equal. Then there is one exchange, by cell: the rows and bytes below each cell are known, so a slot is the cell's
    first slot plus the place inside the cell, and no shard is ever gathered into one task.

    Size is the UTF-8 bytes of the text (null: none) plus 1. Null counts as empty text. Null ids are alike; rows
    that repeat id and text share a cell and get slots in any order among themselves. Columns with an output's name are
    replaced. An empty table stays empty.
    """
    spark = docs.sparkSession
    base = docs.withColumns({
        # 62 bits of each hash, so that no difference overflows
        _A: F.expr(f"shiftrightunsigned(xxhash64(coalesce({q(text_col)}, '')), 2)"),
        _B: F.expr(f"shiftrightunsigned(xxhash64({q(id_col)}, 7), 2)"),
        _SIZE: F.octet_length(text_of(text_col)).cast("long") + 1,
    })
    slim = scratch(base.select(_A, _B, _SIZE), "sh-slim")
    spans = [F.min(_A), F.max(_A), F.min(_B), F.max(_B)]

    def count(rows: DataFrame) -> dict[int, _Cell]:
        got = rows.groupBy(_NODE).agg(F.count(F.lit(1)), F.sum(_SIZE), *spans).collect()
        return {r[0]: _Cell(r[1], r[2], tuple(r[3:7])) for r in got}

    def place(rows: DataFrame, cuts: list[tuple[int, int, int, int]]) -> DataFrame:
        """Moves the rows of cut cells to their children; `cuts`: cell, key, shift, first child."""
        if not cuts:
            return rows
        table = F.broadcast(spark.createDataFrame(cuts, f"{_NODE} long, __sh_phase int, __sh_shift int, __sh_base long"))
        rows = rows.join(table, _NODE, "left")
        child = F.col("__sh_base") + _digit(F.col("__sh_phase"), F.col("__sh_shift"))
        return rows.withColumn(_NODE, F.coalesce(child, F.col(_NODE))).drop("__sh_phase", "__sh_shift", "__sh_base")

    first = F.expr(f"shiftright({_A}, {62 - _FIRST_BITS})")
    cells = count(slim.withColumn(_NODE, first))
    tops = sorted(cells)
    total, n = sum(c.size for c in cells.values()), sum(c.rows for c in cells.values())
    coarse, heavy = tolerance * total / shards, max(64, fine * n // (1 << _FIRST_BITS))
    rounds: list[list[tuple[int, int, int, int]]] = []
    next_id = 1 << _FIRST_BITS

    def leaves(ids: list[int]):
        for i in ids:
            if cells[i].children:
                yield from leaves(cells[i].children)
            else:
                yield i

    while True:
        below, cuts = 0, []
        for i in leaves(tops):
            c = cells[i]
            inside = c.size > coarse and below * shards // total != (below + c.size) * shards // total
            if (inside or c.rows > heavy) and (s := c.split()):
                cuts.append((i, *s, next_id))
                next_id += 1 << _BITS
            below += c.size
        if not cuts:
            break
        rounds.append(cuts)
        open_ = slim.withColumn(_NODE, first)
        for done in rounds:
            open_ = place(open_, done)
        new = count(open_.filter(F.col(_NODE) >= cuts[0][3]))
        cells |= new
        for i, _, _, base_id in cuts:
            cells[i].children = [x for x in range(base_id, base_id + (1 << _BITS)) if x in new]

    # a cell that holds a boundary goes to the side where more than half of it lies
    table, below, start, shard_no = [], 0, 0, 0
    rank = 0
    for i in leaves(tops):
        c = cells[i]
        to = min(shards - 1, (2 * below + c.size) * shards // (2 * total))
        if to != shard_no:
            start, shard_no = rank, to
        table.append((i, to, rank - start))
        below, rank = below + c.size, rank + c.rows
    where = F.broadcast(spark.createDataFrame(table, f"{_NODE} long, shard int, __sh_first long"))
    rows = base.withColumn(_NODE, first)
    for cuts in rounds:
        rows = place(rows, cuts)
    rows = rows.drop(*(c for c in docs.columns if c.lower() in ("size", "shard", "slot"))).join(where, _NODE)
    nth = F.row_number().over(Window.partitionBy(_NODE).orderBy(_A, _B))
    rows = rows.withColumn("slot", F.col("__sh_first") + nth - 1)
    return rows.select(*cols(docs, "size", "shard", "slot"), F.col(_SIZE).alias("size"), "shard", F.col("slot").cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Writes one folder per shard; files hold their rows in order of slot."""
    out = shard(docs, **options)
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
