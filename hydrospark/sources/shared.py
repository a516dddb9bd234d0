"""Tables written where all executors see them."""

from __future__ import annotations

import functools
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="hydrospark-")


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; where that is unset a local folder of our own, in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
    return path or _own_dir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _bytes(df: DataFrame) -> Column:
    """What a row's values take, at least."""
    out = F.lit(0).cast("long")
    for f in df.schema:
        c, kind = F.col("`" + f.name.replace("`", "``") + "`"), f.dataType
        if isinstance(kind, T.StringType | T.BinaryType):
            size = F.octet_length(c)
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
            size = 8 * F.size(c)
        elif isinstance(kind, T.ArrayType | T.MapType | T.StructType):
            size = F.octet_length(F.to_json(F.struct(c.alias("c"))))
        else:
            size = F.lit(8)
        out = out + F.coalesce(size, F.lit(0)).cast("long")
    return out


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: what several later steps read is computed once, and a lost executor costs no recomputation. Rows and bytes are counted as they are written, for `small`."""
    path, seen = shared_path(df.sparkSession, name), Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(_bytes(df)).alias("bytes")).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._held = (seen.get["rows"], seen.get["bytes"] or 0)
    return out


@functools.cache
def _ship(app: str) -> None:
    top = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="hydrospark-")) / "hydrospark_core.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    SparkContext.getOrCreate().addPyFile(str(path))


def ship(spark: SparkSession) -> None:
    """Makes the package known to Python workers, which may have no copy of it; once per application."""
    _ship(spark.sparkContext.applicationId)


def small(df: DataFrame, rows: int = 500_000, megabytes: int = 64) -> DataFrame:
    """Marks a table for broadcast if it has at most so many rows and so many bytes; else leaves the join to a shuffle. A table as `written` returned it is known; another is counted."""
    n, size = getattr(df, "_held", None) or df.agg(F.count(F.lit(1)), F.sum(_bytes(df))).first()
    return F.broadcast(df) if n <= rows and (size or 0) <= megabytes << 20 else df
