"""Streaming ingest of vectors and windowed metrics, by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

MESSAGE = "id long, vector array<float>, metadata map<string,string>, ts timestamp"


def from_files(spark: SparkSession, path: str, schema: str = MESSAGE, batch_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", batch_files).json(path)


def from_kafka(spark: SparkSession, servers: str, topic: str, offsets: str = "latest", batch: int = 10_000) -> DataFrame:
    """Messages (key, value, ts) of a topic; offsets as Kafka's startingOffsets, so a seek is another start."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", offsets).option("maxOffsetsPerTrigger", batch).load()
    return raw.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), F.col("timestamp").alias("ts"))


def extract(messages: DataFrame, column: str = "value", schema: str = MESSAGE, keep: Column | None = None) -> DataFrame:
    """Vectors out of JSON messages; rows that don't parse or don't pass `keep` are skipped."""
    rows = messages.select(F.from_json(column, schema).alias("m")).filter("m.id IS NOT NULL AND m.vector IS NOT NULL").select("m.*")
    return rows.filter(keep) if keep is not None else rows


def sink(df: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append to Parquet, exactly once; without an interval all that is there is taken and the query ends."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def deduplicated(df: DataFrame, keys: list[str], late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """First rows of their keys; state is kept for the lateness allowed."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def windowed(events: DataFrame, width: str = "1 day", late: str = "1 hour", ts: str = "ts", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """(window_start, by.., n, total) over tumbling windows; the same code runs on a batch table."""
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    marked = events.withWatermark(ts, late) if events.isStreaming else events
    out = marked.groupBy(F.window(ts, width), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("window_start"), *by, "n", "total")


def subscribe(df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, kinds: tuple[str, ...] = ()) -> StreamingQuery:
    """Call handle with each batch of changes of the given kinds."""
    hit = df.filter(F.col("type").isin(*kinds)) if kinds else df
    return hit.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stats(query: StreamingQuery) -> dict:
    last = query.lastProgress
    return {} if last is None else {"batch": last["batchId"], "received": last["numInputRows"], "per_second": last["processedRowsPerSecond"]}
