"""Keeping the first of something."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella import steps


def first_n(df: DataFrame, by: list[str | Column], order: list[str | Column], n: int | Column, most: int | None = None) -> DataFrame:
    """The first n rows of each group.

    Spark limits each group before the shuffle where n is a number; where it is
    a column, ``most`` (never exceeded by it) does that.
    """
    numbered = df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return (numbered if most is None else numbered.where(F.col("_n") <= most)).where(F.col("_n") <= n).drop("_n")


def keep_first(df: DataFrame, key: list[str | Column], order: list[str | Column]) -> DataFrame:
    """One row a key: the first in order, unlike dropDuplicates, which keeps any."""
    return first_n(df, key, order, 1)


def numbered(df: DataFrame, by: str, order: list[str], name: str = "n") -> DataFrame:
    """df with the place (from 1) of each row within its ``by``, also where one value of it holds most rows.

    Rows are dealt to ranges of (by, order), so that no task gets a whole group
    for being one; each range numbers its own, and the rows of a group in the
    ranges before it are added: a table of one row for each range and group in it.
    """
    spark, parts = df.sparkSession, steps.parts_of(df.sparkSession)
    dealt = df.repartitionByRange(parts, by, *order).withColumn("_range", F.spark_partition_id())
    dealt = steps.written(dealt, steps.new_folder(spark, "ranges"))
    before = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(by, "_range").agg(F.count("*").alias("_size")).select(F.col(by).alias("_by"), F.col("_range").alias("_r"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    own = dealt.withColumn("_own", F.row_number().over(Window.partitionBy("_range", by).orderBy(*order)))
    joined = own.join(sizes, (F.col("_range") == F.col("_r")) & F.col(by).eqNullSafe(F.col("_by")))
    return joined.withColumn(name, F.col("_before") + F.col("_own")).drop("_range", "_r", "_by", "_own", "_before")


def container_budget(df: DataFrame, container: str, order: list[str | Column], limit: int, least: int) -> DataFrame:
    """The first rows of each container, max(least, limit div containers) of each; the total may exceed limit."""
    containers = df.select(container).distinct().agg(F.greatest(F.lit(least), F.expr(f"{limit} div greatest(count(*), 1)")).alias("_budget"))
    numbered = df.withColumn("_n", F.row_number().over(Window.partitionBy(container).orderBy(*order))).where(F.col("_n") <= max(limit, least))
    # The other side is the one row of an aggregate without keys.
    return numbered.join(F.broadcast(containers), F.col("_n") <= F.col("_budget")).drop("_n", "_budget")


def priority_budget(df: DataFrame, container: str, first: Column, order: list[str | Column], limit: int, least: int) -> DataFrame:
    """Rows under one budget that containers use up by rank.

    Rows of ``first`` come first, up to ``limit`` in order, whatever their
    container.  What is left is shared by the other containers, max(least, left
    div containers) for each, and none of it where nothing is left; ``least`` may
    bring the total over the limit.
    """
    marked = df.withColumn("_first", F.coalesce(first, F.lit(False)))
    own = first_n(marked.where("_first"), ["_first"], order, limit)
    rest = marked.where("NOT _first")
    # One row: what the first ones take, and how many containers share the remainder.
    shared = marked.agg(F.least(F.count_if("_first"), F.lit(limit)).alias("_taken"), F.countDistinct(F.when(~F.col("_first"), F.col(container))).alias("_containers"))
    left = F.lit(limit) - F.col("_taken")
    budget = shared.select(F.when(left > 0, F.greatest(F.lit(least), F.expr(f"({limit} - _taken) div greatest(_containers, 1)"))).otherwise(0).alias("_budget"))
    numbered = rest.withColumn("_n", F.row_number().over(Window.partitionBy(container).orderBy(*order))).where(F.col("_n") <= max(limit, least))
    return own.drop("_first").unionByName(numbered.join(F.broadcast(budget), F.col("_n") <= F.col("_budget")).drop("_n", "_budget", "_first"))


def in_file_order(df: DataFrame, name: str = "seq") -> DataFrame:
    """df, read from files, with ``name``: a struct that orders rows as their files hold them, files by path.

    Rows of one block of a file come in order from one task, so the block's place
    and a number that grows within the task order them, however files are split.
    """
    at = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return df.withColumn(name, at)


def first_filled(search: DataFrame, otherwise: Callable[[], DataFrame]) -> DataFrame:
    """search where it finds a row, else what ``otherwise`` makes: one of the two is read, since the branch is taken before."""
    return otherwise() if search.isEmpty() else search
