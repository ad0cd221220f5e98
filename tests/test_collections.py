"""Collections that are replaced whole or not at all, and rollbacks."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessella.operators import versions
from tessella.sources import sinks

SCHEMA = "id long, text string"


def read(spark, path):
    return sorted((r.id, r.text) for r in sinks.read_collection(spark, path, SCHEMA).collect())


def rows(spark, n, text):
    return spark.range(n).withColumn("text", F.lit(text)).repartition(3)


def test_collection(spark, tmp_path):
    path = str(tmp_path / "c")
    with pytest.raises(FileNotFoundError):
        sinks.read_collection(spark, path, SCHEMA)
    assert sinks.write_collection(rows(spark, 3, "a"), path) == 1
    with pytest.raises(FileExistsError, match="force"):
        sinks.write_collection(rows(spark, 5, "b"), path)
    assert read(spark, path) == [(i, "a") for i in range(3)]
    assert [sinks.write_collection(rows(spark, n, "b"), path, force=True) for n in (1, 4, 2)] == [2, 3, 4]
    assert read(spark, path) == [(i, "b") for i in range(2)]
    assert len([d for d in os.listdir(path) if d.startswith("data-")]) == 2  # the state before stays for readers at work


def test_a_write_killed_half_way_changes_nothing(spark, tmp_path):
    """Some tasks have written, then one fails; then the last step fails, after all rows are there."""
    path = str(tmp_path / "c")
    sinks.write_collection(rows(spark, 3, "a"), path)
    before = sinks.read_collection(spark, path, SCHEMA)
    broken = spark.range(0, 1000, 1, 8).select("id", F.when(F.col("id") == 999, F.raise_error(F.lit("killed")).cast("string")).otherwise("b").alias("text"))
    with pytest.raises(PySparkException):
        sinks.write_collection(broken, path, force=True)
    assert read(spark, path) == [(i, "a") for i in range(3)]
    os.makedirs(f"{path}/_states/000000000002")  # what another writer has just made
    states = sinks._states
    sinks._states = lambda s, p: [1]
    try:
        with pytest.raises(FileExistsError, match="another writer"):
            sinks.write_collection(rows(spark, 9, "late"), path, force=True)
    finally:
        sinks._states = states
    os.rmdir(f"{path}/_states/000000000002")
    assert read(spark, path) == [(i, "a") for i in range(3)] and before.count() == 3


def test_links_are_refused(spark, tmp_path):
    real, link = tmp_path / "real", tmp_path / "link"
    sinks.write_collection(rows(spark, 1, "a"), str(real))
    link.symlink_to(real)
    for force in (False, True):
        with pytest.raises(ValueError, match="link"):
            sinks.write_collection(rows(spark, 1, "b"), str(link), force)
    assert read(spark, str(real)) == [(0, "a")]


def test_restored(spark):
    """Artifacts the target lacks stay, those it has come back, one emptied since too; a key without such a version isn't touched."""
    changes = [
        ("p", 1, "work", "w1"), ("p", 1, "persona", None), ("p", 2, "work", "w2"), ("p", 3, "persona", "p3"), ("p", 4, "notes", "n4"),
        ("q", 1, "work", "only"), ("r", 1, "work", "a"), ("r", 2, "work", "b"), ("s", 1, "work", "x"),
    ]
    log = spark.createDataFrame(changes, "name string, version_id int, artifact string, content string")
    targets = spark.createDataFrame([("p", 2), ("q", 7), ("r", 1), ("unknown", 1), ("s", None)], "name string, target int")
    found = sorted(map(tuple, versions.restored(log, targets, "name").collect()), key=str)
    assert found == sorted([
        ("p", "v4_before_rollback", "work", "w2", None), ("p", "v4_before_rollback", "persona", "p3", None), ("p", "v4_before_rollback", "notes", "n4", None),
        ("p", "v2_restored", "work", "w2", "v4"), ("p", "v2_restored", "persona", None, "v4"), ("p", "v2_restored", "notes", "n4", "v4"),
        ("r", "v2_before_rollback", "work", "b", None), ("r", "v1_restored", "work", "a", "v2"),
    ], key=str)
