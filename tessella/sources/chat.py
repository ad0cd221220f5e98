"""Chat exports: JSON of several shapes, and lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import fixed
from tessella.functions import text as X

#: Names that a column may have, first filled first.
SENDER, CONTENT, TIME = ("sender_name", "sender", "from", "user_name"), ("content", "text", "message", "body"), ("timestamp", "create_time", "time")


def _text(json: Column, name: str) -> Column:
    """A key of a JSON object as text, whatever it holds; null where it is missing."""
    return F.get_json_object(json, f"$.{name}")


def flat_content(value: Column) -> Column:
    """A text as it is; of an object its text or content; of a list its items' texts joined by spaces."""
    listed = F.from_json(value, "array<string>")
    item = lambda x: F.when(F.startswith(x, F.lit("{")), F.coalesce(F.get_json_object(x, "$.text"), F.lit(""))).otherwise(x)
    of_object = X.first_filled(F.get_json_object(value, "$.text"), F.get_json_object(value, "$.content"), value)
    return F.when(F.startswith(value, F.lit("[{")), F.array_join(F.transform(listed, item), " ")).when(F.startswith(value, F.lit('{"')), of_object).otherwise(value)


def parse_messages(exports: DataFrame, raw: str = "raw") -> DataFrame:
    """sender, content, timestamp (texts) and seq of each message of each export, with the other columns."""
    listed = F.coalesce(*(F.get_json_object(F.col(raw), f"$.{k}") for k in ("messages", "records", "data")), F.col(raw))
    each = exports.select(*(c for c in exports.columns if c != raw), F.posexplode(F.from_json(listed, "array<string>")).alias("seq", "m"))
    first = lambda names: X.first_filled(*(_text(F.col("m"), n) for n in names))
    return each.select(*(c for c in each.columns if c != "m"), first(SENDER).alias("sender"), flat_content(first(CONTENT)).alias("content"), first(TIME).alias("timestamp"))


def kept(messages: DataFrame, target: str = "", kind: str = "export") -> DataFrame:
    """Messages of senders that contain target (case counts), without blanks and placeholders."""
    stay = (X.strip("content") != "") & ~X.strip("content").isin(*fixed.PLACEHOLDERS[kind])
    return messages.where(stay & F.contains("sender", F.lit(target)))


def parse_lines(rows: DataFrame, line: str, target: str) -> DataFrame:
    """sender, content, timestamp of lines ``date [time] sender: content`` from the target, and of other lines that name it."""
    part = lambda k: X.strip(F.regexp_extract(line, fixed.CHAT_LINE, k))
    parsed = rows.select("*", F.rlike(F.col(line), F.lit(fixed.CHAT_LINE)).alias("_is"), part(1).alias("_t"), part(2).alias("_s"), part(3).alias("_c"))
    own = F.col("_is") & F.contains("_s", F.lit(target))
    named = ~F.col("_is") & F.contains(line, F.lit(target))
    stay = parsed.where((own & ~F.col("_c").isin(*fixed.PLACEHOLDERS["export"])) | named)
    return stay.select(
        *(c for c in rows.columns if c != line), F.when(F.col("_is"), F.col("_s")).otherwise(target).alias("sender"), F.when(F.col("_is"), F.col("_c")).otherwise(X.strip(line)).alias("content"),
        F.when(F.col("_is"), F.col("_t")).otherwise("").alias("timestamp"),
    )


def rich_text(raw: Column) -> Column:
    """Texts and links of rich text, {"text": ...}, or what isn't JSON as it is."""
    segments = F.flatten(F.from_json(F.get_json_object(raw, "$.content"), "array<array<struct<tag:string,text:string>>>"))
    shown = F.transform(F.filter(segments, lambda s: s.tag.isin("text", "a") & (s.text != "")), lambda s: s.text)
    return F.when(~F.rlike(raw, F.lit(r"^\s*\{")), raw).otherwise(X.first_filled(F.get_json_object(raw, "$.text"), F.array_join(shown, " ")))


def minutes(raw: Column | str, per_second: int) -> Column:
    """Epoch units as yyyy-MM-dd HH:mm; anything else unchanged."""
    number = X.column(raw).try_cast("double")
    return F.coalesce(F.date_format(F.timestamp_seconds(F.floor(number / per_second)), "yyyy-MM-dd HH:mm"), X.column(raw))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Exports of a folder, one file a row, parsed: file, seq, sender, content, timestamp."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("raw"))
    return parse_messages(files)


def read_text(spark: SparkSession, path: str, target: str) -> DataFrame:
    """Chat logs of a folder, line by line: file, sender, content, timestamp."""
    rows = spark.read.text(path, pathGlobFilter="*.txt").select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line"))
    return parse_lines(rows, "line", target)


def as_export(conversations: DataFrame, spoil: bool = False) -> DataFrame:
    """A conversation table as exports of one message each: a bare list, records with an object, data with a list of objects."""
    k = F.col("turn") % 3
    content = F.when((F.col("turn") % 5 == 4) & F.lit(spoil), "[图片]").otherwise(F.col("text"))
    time = (F.lit(1700000000) + F.col("turn")).alias("t")
    plain = F.to_json(F.array(F.struct(F.col("role").alias("from"), F.lit("").alias("content"), content.alias("message"), time.alias("time"))))
    nested = F.to_json(F.struct(F.array(F.struct(F.col("role").alias("sender_name"), F.array(F.struct(F.col("role").alias("text")), F.struct(content.alias("text"))).alias("content"), time.alias("timestamp"))).alias("records")))
    single = F.to_json(F.struct(F.array(F.struct(F.col("role").alias("sender"), F.struct(content.alias("text")).alias("text"), time.alias("create_time"))).alias("data")))
    return conversations.select("conv_id", "turn", F.when(k == 0, plain).when(k == 1, nested).otherwise(single).alias("raw"))
