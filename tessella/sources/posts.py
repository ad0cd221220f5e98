"""Public posts of landed pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import fixed
from tessella.functions import text as X
from tessella.functions import urls

METRICS = {"likes": ("like_count", "likeCount"), "reposts": ("retweet_count", "retweetCount"), "replies": ("reply_count", "replyCount"), "quotes": ("quote_count", "quoteCount"), "views": ("view_count", "viewCount"), "bookmarks": ("bookmark_count", "bookmarkCount")}


def fields(raw: Column | str) -> Column:
    """The fields of a JSON object as text, parsed once: a null is there, a missing key is not."""
    return F.from_json(raw, "map<string,string>")


def metric(own: Column | str, first: str, second: str) -> Column:
    """A whole number that isn't negative under the first key of fields, or under the second where the first is missing."""
    own = F.col(own) if isinstance(own, str) else own
    value = F.when(F.map_contains_key(own, first), F.try_element_at(own, F.lit(first))).otherwise(F.try_element_at(own, F.lit(second)))
    return F.when(F.rlike(value, F.lit("^[0-9]+$")), value.try_cast("long"))


def iso_time(raw: Column) -> Column:
    """Epoch seconds as ISO time, other texts cleaned to 64 characters, blanks null."""
    seconds = F.when(F.rlike(raw, F.lit("^[0-9]+$")), raw.try_cast("long"))
    return F.coalesce(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.nullif(X.capped(raw, 64), F.lit("")))


def normalised(pages: DataFrame, raw: str = "raw") -> DataFrame:
    """id, content, content_truncated, published_at, url, language, author, metrics (without nulls), trust of the posts of each page; odd ones go.

    A language is one that is text and looks like a tag; the author's name comes
    from the address where the post gives none that can be one.
    """
    listed = F.coalesce(F.get_json_object(raw, "$.tweets"), F.get_json_object(raw, "$.data.tweets"))
    each = pages.select(F.explode(F.from_json(listed, "array<string>")).alias("post")).select(fields("post").alias("post"))
    each = each.select("post", fields(F.col("post")["author"]).alias("author"))
    get = lambda path: F.try_element_at(*((F.col("author"), F.lit(path[7:])) if path.startswith("author.") else (F.col("post"), F.lit(path))))
    metrics = F.map_filter(F.create_map(*(x for name, keys in METRICS.items() for x in (F.lit(name), metric("post", *keys)))), lambda _, v: v.isNotNull())
    posts = each.select(
        get("id").alias("id"), X.capped(get("text"), 500).alias("content"), (F.length(get("text")) > 500).alias("content_truncated"), iso_time(F.coalesce(get("created"), get("created_at"), get("createdAt"))).alias("published_at"),
        urls.permalink(get("id"), get("author.username"), get("url")).alias("url"), F.when(F.rlike(get("lang"), F.lit(fixed.LANGUAGE_TAG)), get("lang")).alias("language"), F.struct(get("author.id").alias("id"), X.capped(get("author.name"), 100).alias("name"), get("author.username").alias("username"), F.coalesce(get("author.verified") == "true", F.lit(False)).alias("verified")).alias("author"),
        metrics.alias("metrics"), F.lit(fixed.POST_TRUST).alias("trust"),
    )
    name = F.when(F.rlike("author.username", F.lit(fixed.POST_USER)), F.col("author.username")).otherwise(F.regexp_extract("url", "^https://[^/]+/([^/]+)/", 1))
    return posts.where("content <> '' AND url IS NOT NULL").withColumn("author", F.col("author").withField("username", name))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return normalised(spark.read.text(path, wholetext=True, pathGlobFilter="*.json").withColumnRenamed("value", "raw"))


def as_pages(events: DataFrame) -> DataFrame:
    """Pages of one post made from each event; every fourth has no text."""
    text = F.when(F.col("event_id") % 4 == 3, " ").otherwise(F.concat(F.lit("post "), F.col("event_type")))
    post = F.struct(F.col("event_id").cast("string").alias("id"), text.alias("text"), F.unix_timestamp("ts").alias("created"), F.struct(F.concat(F.lit("u"), F.col("user_id")).alias("username")).alias("author"), F.col("user_id").alias("likeCount"), F.lit(-1).alias("reply_count"))
    return events.select(F.to_json(F.struct(F.array(post).alias("tweets"))).alias("raw"))
