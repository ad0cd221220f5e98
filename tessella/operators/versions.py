"""Versions of records as an append-only log; what is current is a view over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(log: DataFrame, key: str, order: list) -> DataFrame:
    """log with version_id (1, 2, ... by key) and the label vN of the version it makes."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return log.withColumn("version_id", n).withColumn("label", F.concat(F.lit("v"), n))


def current(versions: DataFrame, key: str) -> DataFrame:
    """The newest version of each key, combined before the shuffle."""
    rest = [c for c in versions.columns if c != key]
    return versions.groupBy(key).agg(F.max(F.struct("version_id", *(c for c in rest if c != "version_id"))).alias("s")).select(key, "s.*")


def rolled_back(versions: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """versions with a further one for each (key, target): the content of version target, labelled vT_restored, and from where it came.

    Numbers only grow, so no later version overwrites an archived one.
    """
    last = versions.groupBy(key).agg(F.max("version_id").alias("_last"))
    found = versions.join(targets, key).where("version_id = target").join(last, key)
    added = found.withColumn("rollback_from", F.concat(F.lit("v"), "_last")).withColumn("label", F.concat(F.lit("v"), "target", F.lit("_restored"))).withColumn("version_id", F.col("_last") + 1)
    return versions.withColumn("rollback_from", F.lit(None).cast("string")).unionByName(added.drop("target", "_last"))


def restored(changes: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """What a rollback writes: the archive of what was current, and what is current then.

    changes: key, version_id, artifact, content, a row where a version changes an
    artifact; the content at a version is the last one up to it.  targets: key,
    target.  Rows: key, label, artifact, content, rollback_from (null in the
    archive).  The archive, labelled vC_before_rollback, holds every artifact;
    afterwards, labelled vT_restored, artifacts that the target had have its
    content, and those it lacked stay as they are.  A key without target, or
    whose target no version reaches, isn't rolled back.

    Contents at both versions come from one aggregate, combined before the shuffle.
    """
    last = changes.groupBy(key).agg(F.max("version_id").alias("_last"))
    wanted = targets.join(last, key).where("target BETWEEN 1 AND _last")
    then = F.when(F.col("version_id") <= F.col("target"), F.struct("version_id", "content"))
    both = changes.join(wanted, key).groupBy(key, "artifact", "target", "_last").agg(F.max(then).alias("_then"), F.max(F.struct("version_id", "content")).alias("_now"))
    label = lambda v, suffix: F.concat(F.lit("v"), F.col(v), F.lit(suffix))
    archive = F.struct(label("_last", "_before_rollback").alias("label"), F.col("_now.content").alias("content"), F.lit(None).cast("string").alias("rollback_from"))
    # An artifact whose content at the target is null is there all the same: the struct tells.
    after = F.struct(label("target", "_restored").alias("label"), F.when(F.col("_then").isNotNull(), F.col("_then.content")).otherwise(F.col("_now.content")).alias("content"), F.concat(F.lit("v"), F.col("_last")).alias("rollback_from"))
    return both.select(key, "artifact", F.explode(F.array(archive, after)).alias("s")).select(key, "s.label", "artifact", "s.content", "s.rollback_from")


def expired(versions: DataFrame, key: str, keep: int = 10) -> DataFrame:
    """Versions beyond the newest ``keep`` of each key."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("version_id")))
    return versions.withColumn("_n", n).where(F.col("_n") > keep).drop("_n")
