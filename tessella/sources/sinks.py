"""Writers: reports, collections, tables and artifacts."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_report(lines: DataFrame, by: str, order: list[str], line: str, path: str) -> None:
    """A text file folder by ``by`` with the lines in order; each report is one string, so keep capped ones only."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(line).alias("_line")))), lambda x: x["_line"])
    lines.groupBy(by).agg(F.array_join(ordered, "\n").alias("value")).write.partitionBy(by).text(path)


def _store(spark: SparkSession, path: str):
    """Hadoop's calls for the store of a path, and its class of paths; the second kind renames without replacing."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    at = hadoop.Path
    return at(path).getFileSystem(conf), hadoop.FileContext.getFileContext(at(path).toUri(), conf), at


def _states(spark: SparkSession, path: str) -> list[int]:
    files, _, at = _store(spark, path)
    if not files.exists(at(f"{path}/_states")):
        return []
    return sorted(int(name) for s in files.listStatus(at(f"{path}/_states")) if (name := s.getPath().getName()).isdigit())


def _folder(spark: SparkSession, path: str, state: int) -> str:
    return f"{path}/{spark.read.text(f'{path}/_states/{state:012d}').first().value}"


def write_collection(rows: DataFrame, path: str, force: bool = False, keep: int = 1) -> int:
    """JSON lines as the next state of a collection; one that exists is only replaced by force.  Gives the state's number.

    Rows go to a folder of their own.  Only when all are there a file _states/N
    that names the folder gets its name, in one step that never replaces another:
    readers follow the largest N.  So a write that fails or is killed leaves the
    collection as it was, and of writers that meet at one N all but the first
    fail.  Of older states ``keep`` stay, for readers that are at work.  Nothing
    is written through a symbolic link.
    """
    spark = rows.sparkSession
    files, context, at = _store(spark, path)
    if files.exists(at(path)) and context.getFileLinkStatus(at(path)).isSymlink():
        raise ValueError(f"{path} is a symbolic link")
    known = _states(spark, path)
    if known and not force:
        raise FileExistsError(f"{path} exists; force replaces it")
    state, folder = (known[-1] if known else 0) + 1, f"data-{uuid.uuid4().hex}"
    rows.write.json(f"{path}/{folder}")
    pointer = at(f"{path}/.{folder}")
    out = files.create(pointer, False)
    out.writeBytes(folder + "\n")
    out.close()
    files.mkdirs(at(f"{path}/_states"))
    try:
        context.rename(pointer, at(f"{path}/_states/{state:012d}"), spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as error:
        files.delete(pointer, False)
        files.delete(at(f"{path}/{folder}"), True)
        raise FileExistsError(f"another writer has made state {state} of {path}") from error
    for old in known[: len(known) - keep]:
        files.delete(at(_folder(spark, path, old)), True)
        files.delete(at(f"{path}/_states/{old:012d}"), False)
    return state


def read_collection(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest state of a collection."""
    known = _states(spark, path)
    if not known:
        raise FileNotFoundError(f"{path} holds no collection")
    return spark.read.schema(schema).json(_folder(spark, path, known[-1]))


def write_csv(rows: DataFrame, path: str) -> None:
    """All cells quoted, quotes in cells doubled."""
    rows.write.option("quoteAll", True).option("escape", '"').option("header", True).csv(path)


def append_artifacts(versions: DataFrame, path: str) -> None:
    """Versions of artifacts, appended; nothing that is archived is overwritten."""
    versions.write.mode("append").partitionBy("artifact").parquet(path)
