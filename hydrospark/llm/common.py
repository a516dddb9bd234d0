"""What the operators share: scratch tables, word rules, size-checked broadcasts."""

from __future__ import annotations

import functools
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Tables of at most so many rows may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="hydrospark-")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: `spark.checkpoint.dir`; where that is unset a local one of our own, in local mode only (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
    return path or _own_dir()


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes `df` in the shared folder and reads it again, so a lost executor costs no recomputation.

    Once the table is written nothing needs the shuffle files behind it, and Spark is told to remove them then.
    """
    path, conf, key = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}", df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(key, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a written table for broadcast if it has at most `limit` rows; else leaves the join to a shuffle."""
    return F.broadcast(df) if df.count() <= limit else df


def text_of(name: str) -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(F.col(q(name)), F.lit(""))


def q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def cols(df: DataFrame, *without: str) -> list[Column]:
    """The columns of `df` but for `without`, whatever their names hold."""
    gone = {x.lower() for x in without}
    return [F.col(q(c)) for c in df.columns if c.lower() not in gone]


class Kept(dict):
    """What `make` gives for parts of texts, made once for each. An older generation is asked first; parts of more than `longest` characters aren't kept, which bounds the bytes."""

    def __init__(self, make: Callable[[str], bytes], older: dict[str, bytes] | None = None, longest: int = 64):
        self.make, self.older, self.longest = make, dict(older or {}), longest

    def __missing__(self, x: str) -> bytes:
        out = self.older.get(x) or self.make(x)
        if len(x) <= self.longest:
            self[x] = out
        return out


def words_of(text: Column) -> Column:
    """The words of a text as an array; no word: an empty array."""
    return F.filter(F.split(text, GAP), lambda w: w != "")


def let(value: Column, then) -> Column:
    """`then(value)` with `value` computed once per row: a lambda's variable isn't expanded where it is used, a column expression is."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


@functools.cache
def _ship(app: str) -> None:
    """Sends this package to the application's Python workers, which may have no copy of it."""
    top = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="hydrospark-")) / "hydrospark.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    SparkContext.getOrCreate().addPyFile(str(path))


def python_workers(spark: SparkSession, rows: int = 512) -> None:
    """Makes the package known to Python workers and lowers the rows per Arrow batch, where they are at Spark's default, so that workers hold few texts at once."""
    _ship(spark.sparkContext.applicationId)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))
