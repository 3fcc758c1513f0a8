"""Structured Streaming: new messages once, and counts over windows of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def once(stream: DataFrame, seen: str, key: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Appends each message to the table at ``seen`` unless its key is there: batches are anti-joined with what is stored.

    The table is partitioned by a hash of the key (``key_bucket``), and a batch reads only the keys of its own buckets. A
    null key is a key like others, so that one message without a key is stored. A batch that is run again finds its own
    rows and adds none.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def store(batch: DataFrame, _: int) -> None:
        spark: SparkSession = batch.sparkSession
        new = batch.dropDuplicates([key]).withColumn("key_bucket", bucket)
        try:
            stored = spark.read.schema(new.schema).parquet(seen)
        except Exception as problem:
            if "PATH_NOT_FOUND" not in str(problem):
                raise
        else:
            mine = [r.key_bucket for r in new.select("key_bucket").distinct().collect()]  # one row a bucket
            stored = stored.where(F.col("key_bucket").isin(mine)).select(F.col(key).alias("stored_key"), F.col("key_bucket").alias("stored_bucket"))
            new = new.join(stored, F.col(key).eqNullSafe(F.col("stored_key")) & (F.col("key_bucket") == F.col("stored_bucket")), "left_anti")
        new.select(*batch.columns, "key_bucket").write.mode("append").partitionBy("key_bucket").parquet(seen)

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, event_type, n, total; works on a stream (append mode) and on a table."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    found = events.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, session_start, n."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    found = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("session_window.start").alias("session_start"), "n")
