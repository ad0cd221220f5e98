"""Research notes and subtitles in folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella import fixed
from tessella.functions import text as X


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """batch (folder), path (file name), text of all .md files, in sub-folders too."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True)
    return files.select(F.regexp_extract("_metadata.file_path", "([^/]*)/[^/]*$", 1).alias("batch"), F.col("_metadata.file_name").alias("path"), F.col("value").alias("text"))


def track(name: Column | str) -> Column:
    """The two digits before the first - or _ of a file name; null without."""
    return F.nullif(F.regexp_extract(X.column(name), "^([0-9]{2})[-_]", 1), F.lit(""))


def spoken_lines(rows: DataFrame, key: str, subtitles: str) -> DataFrame:
    """key, _i, _x: spoken lines of SRT or VTT, a row each: no header, notes, numbers, times, tags and settings."""
    body = F.regexp_replace(F.regexp_replace(subtitles, f"(?s){fixed.SUBTITLE_HEADER}", ""), f"(?ms){fixed.SUBTITLE_NOTE}", "")
    each = rows.select(key, body.alias("_body")).select(key, F.posexplode(F.transform(X.lines("_body"), X.strip)).alias("_i", "_x"))
    kept = each.where((F.col("_x") != "") & ~F.rlike("_x", F.lit("^[0-9]+$")) & ~F.rlike("_x", F.lit(fixed.SUBTITLE_CUE)))
    tagless = F.when(F.contains("_x", F.lit("<")), F.regexp_replace("_x", fixed.SUBTITLE_TAG, "")).otherwise(F.col("_x"))
    plain = F.when(F.contains("_x", F.lit(":")), F.regexp_replace(tagless, fixed.SUBTITLE_SETTING, "")).otherwise(tagless)
    bare = F.regexp_replace(X.strip(plain), r"\s+", " ")
    return kept.withColumn("_x", bare).where("_x <> ''")


def collapsed(each: DataFrame, key: str, lines: str) -> DataFrame:
    """key, lines: an array of the lines _x in order of _i, without those equal to the line before."""
    new = F.coalesce(F.lag("_x").over(Window.partitionBy(key).orderBy("_i")) != F.col("_x"), F.lit(True))
    kept = each.withColumn("_new", new).where("_new").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_i", "_x"))).alias("_l"))
    return kept.select(key, F.transform("_l", lambda x: x["_x"]).alias(lines))


def paragraphs(lines: Column, least: int = 240) -> Column:
    """Lines joined by spaces until they are ``least`` characters or one ends a sentence.

    The fold over the lines keeps a mark for each, and none of their text:
    paragraphs are cut at the marks afterwards.
    """
    sizes = F.transform(lines, lambda x: F.struct(F.length(x).alias("n"), F.rlike(x, F.lit("[.!?。！？]$")).alias("ends")))

    def mark(acc: Column, line: Column) -> Column:
        joined = F.when(acc.open == 0, line["n"]).otherwise(acc.open + 1 + line["n"])
        full = (joined >= least) | line["ends"]
        return F.struct(F.concat(acc.marks, F.when(full, "1").otherwise("0")).alias("marks"), F.when(full, 0).otherwise(joined).alias("open"))

    marks = F.aggregate(sizes, F.struct(F.lit("").alias("marks"), F.lit(0).alias("open")), mark, lambda acc: acc.marks)
    # The last line ends a paragraph in any case.  An array of one stands for a name that lambdas can use again.
    last = lambda m: F.concat(F.substring(m, F.lit(1), F.length(m) - 1), F.lit("1"))
    cuts = F.transform(F.array(last(marks)), lambda m: F.filter(F.sequence(F.lit(1), F.length(m)), lambda i: F.substring(m, i, F.lit(1)) == "1"))
    begin = lambda at, i: F.when(i == 0, 1).otherwise(F.get(at, i - 1) + 1)
    joined = F.transform(cuts, lambda at: F.transform(at, lambda end, i: F.array_join(F.slice(lines, begin(at, i), end - begin(at, i) + 1), " ")))
    return F.when(F.size(lines) > 0, joined[0]).otherwise(F.array().cast("array<string>"))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """file, paragraphs of the subtitle files of a folder."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.{srt,vtt}")
    cues = spoken_lines(files.select(F.col("_metadata.file_path").alias("file"), "value"), "file", "value")
    return collapsed(cues, "file", "cues").select("file", paragraphs(F.col("cues")).alias("paragraphs"))
