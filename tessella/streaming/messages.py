"""Messages as they land: repeats dropped within a watermark, counts by bucket and window."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tessella import fixed
from tessella.functions import text as X
from tessella.operators import ranking

SCHEMA = "id string, sender string, content string, ts timestamp"


def landed(spark: SparkSession, path: str, schema: str = SCHEMA, format_: str = "json", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(format_).load(path)


def first_of_each(messages: DataFrame, late: str) -> DataFrame:
    """The first message of each id; state is kept no longer than ``late``.

    Of a stream, messages older by more than ``late`` than the newest read
    before are dropped (LateRows counts them): choose it by how far files can
    land out of order.  A backlog read as a batch loses nothing.
    """
    if not messages.isStreaming:
        return ranking.keep_first(messages, ["id"], ["ts"])
    return messages.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])


class LateRows(StreamingQueryListener):
    """Counts what the watermarks of all queries drop, from every report of progress, while it is on: ``with LateRows(spark) as late``."""

    def __init__(self, spark: SparkSession):
        self.spark, self._dropped = spark, Counter()

    def __enter__(self) -> LateRows:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.streams.removeListener(self)

    def of(self, query) -> int:
        """Rows that a query has dropped so far, in all its batches."""
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
        return self._dropped[str(query.id)]

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self._dropped[str(event.progress.id)] += sum(s.numRowsDroppedByWatermark for s in event.progress.stateOperators)


def bucket_counts(messages: DataFrame, late: str, width: str = "1 hour") -> DataFrame:
    """start, sender, bucket, n: closed windows, once no message can come for them any more."""
    kept = messages.where(~X.is_noise("content")).withColumn("bucket", X.length_bucket("content", fixed.CHAT_LONG, fixed.CHAT_DECISION))
    counted = kept.withWatermark("ts", late).groupBy(F.window("ts", width), "sender", "bucket").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "sender", "bucket", "n")


def write(counts: DataFrame, path: str, checkpoint: str):
    """Appends closed windows as Parquet, exactly once; processes what has landed and ends."""
    return counts.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
