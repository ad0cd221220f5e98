"""Helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, line feed, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
#: What separates words.
BLANKS = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only a local master may do without the setting; it gets a folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder below the shared one for what materialise writes meanwhile; it goes at the end.

    Only results that have been written elsewhere may be used afterwards.
    Without it intermediates stay until the shared folder is cleared.
    """
    folder = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    before = _SCRATCH.set(folder)
    try:
        yield folder
    finally:
        _SCRATCH.reset(before)
        remove(spark, folder)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if it is there, in whatever store Spark can write to."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written once to the shared folder and read back, and its folder there, for remove()."""
    spark = df.sparkSession
    path = f"{_SCRATCH.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts the lineage, survives lost executors."""
    return stored(df, name)[0]


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


#: Columns by which with_identity tells rows apart.
IDENTITY = ["no_id", "id", "row_hash"]


def with_identity(df: DataFrame) -> DataFrame:
    """row (all columns of df in one), no_id and id (of its doc_id) and row_hash: rows with the same IDENTITY are equal.

    As the columns are inside row, none of their names can clash.  Nulls are
    marked in the hash, which would pass over them.  Maps and variants, also
    inside other types, can't be hashed and count by their JSON.
    """
    hashed = lambda c, kind: F.to_json(F.struct(F.col(f"`{c}`").alias("x"))) if "map<" in kind or "variant" in kind else F.col(f"`{c}`")
    each = [x for c, kind in df.dtypes for x in (hashed(c, kind), F.col(f"`{c}`").isNull())]
    return df.select(
        F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col("doc_id").isNull().alias("no_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64(*each).alias("row_hash"),
    )


def parts_of(spark: SparkSession) -> int:
    """Partitions for a shuffle that must not be coalesced, since its rows are multiplied afterwards."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_total(df: DataFrame, order: list[Column], value: str, start: str) -> DataFrame:
    """Adds ``start``: the sum of ``value`` over all rows before this one in ``order``.

    Rows are dealt to ranges of the order once; each range sums on its own and
    only one number per range meets the others.
    """
    ranged = materialise(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    whole = ranged.groupBy("_range").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range, so as many as there are shuffle partitions: safe to broadcast.
    bases = whole.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.withColumn("_own", F.coalesce(F.sum(value).over(within), F.lit(0)))
        .join(F.broadcast(bases), "_range")
        .withColumn(start, F.col("_base") + F.col("_own"))
        .drop("_range", "_base", "_own")
    )
