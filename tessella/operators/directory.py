"""Search in directories: departments below each other and the users that each lists."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella import steps
from tessella.operators import ranking


def levels(edges: DataFrame, root: Any, folder: str, deepest: int | None = None) -> Iterator[DataFrame]:
    """node, path of the nodes first reached at each level, the root's first, until a level has none.

    edges: parent, child and ord, the place of a child among its parent's.  Each
    level is a join of the last one with the edges, less all nodes seen; so a
    cycle ends, any depth is reached, and a node of several parents counts once,
    where it comes first.  path orders the nodes of a level as a breadth-first
    walk meets them.  A level is a folder depth=N below ``folder``.
    """
    spark, kind = edges.sparkSession, edges.schema["child"].dataType.simpleString()
    schema = f"node {kind}, path array<long>"
    front, depth = spark.createDataFrame([(root, [])], schema), 0
    while True:
        front = steps.written(front, f"{folder}/depth={depth}")
        if front.isEmpty():
            return
        yield front
        if depth == deepest:
            return
        seen = spark.read.schema(f"{schema}, depth int").parquet(folder).select("node")
        next_ = front.join(edges, front.node == edges.parent).groupBy("child").agg(F.min(F.concat("path", F.array(F.col("ord").cast("long")))).alias("path"))
        front, depth = next_.select(F.col("child").alias("node"), "path").join(seen, "node", "left_anti").select("node", "path"), depth + 1


def walk(edges: DataFrame, root: Any, deepest: int | None = None) -> DataFrame:
    """node, depth, path of every node that the root reaches, within ``deepest`` levels below it."""
    spark, folder = edges.sparkSession, steps.new_folder(edges.sparkSession, "walk")
    for _ in levels(edges, root, folder, deepest):
        pass
    kind = edges.schema["child"].dataType.simpleString()
    return spark.read.schema(f"node {kind}, path array<long>, depth int").parquet(folder).select("node", "depth", "path")


def named(name: str, *columns: str) -> Column:
    """Whether any of the columns holds the name."""
    test = F.lit(False)
    for c in columns:
        test = test | F.coalesce(F.contains(F.col(c), F.lit(name)), F.lit(False))
    return test


def search(edges: DataFrame, users: DataFrame, root: Any, match: Column, enough: int | None = None, deepest: int | None = None, page: int | None = None) -> DataFrame:
    """users (department, ord and more) that match, in departments that the root reaches, with the depth of theirs.

    With ``enough`` the walk ends after the level that brings the number of
    matches to it, and departments count up to the one, in the order of the walk,
    that does; with ``page`` a department shows its first users only, by ord.
    """
    spark = edges.sparkSession
    shown = users if page is None else ranking.first_n(users, ["department"], ["ord"], page)
    hits = steps.written(shown.where(match), steps.new_folder(spark, "hits"))
    folder, found, reached = steps.new_folder(spark, "walk"), 0, []
    for front in levels(edges, root, folder, deepest):
        reached.append(len(reached))
        if enough is not None:
            found += hits.join(front, F.col("department") == F.col("node"), "left_semi").count()
            if found >= enough:
                break
    kind = edges.schema["child"].dataType.simpleString()
    walked = spark.read.schema(f"node {kind}, path array<long>, depth int").parquet(folder).where(F.col("depth").isin(reached))
    if enough is not None:
        counted = hits.groupBy("department").agg(F.count("*").alias("n")).join(walked, F.col("department") == F.col("node"))
        # Each of these departments has a match, so that ``enough`` of them suffice, and fit into one task.
        first = counted.orderBy("depth", "path").limit(enough)
        before = F.coalesce(F.sum("n").over(Window.orderBy("depth", "path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        walked = first.withColumn("before", before).where(F.col("before") < enough).select("node", "depth")
    return hits.join(walked.select("node", "depth"), F.col("department") == F.col("node")).drop("node")
