"""The same pipeline as a stream: files or rows come in, known content is dropped, chunks go to the sinks batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docloom.functions.ids import content_hash, ingest_key
from docloom.operators.chunking import line_chunks, with_ids


def stream_rows(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 16) -> DataFrame:
    """New Parquet files under a path as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def keyed(docs: DataFrame, uri: str, text: str = "text", version: str = "1") -> DataFrame:
    hashed = docs.withColumn("content_hash", content_hash(F.col(text)))
    return hashed.withColumn("ingest_key", ingest_key(F.col("content_hash"), F.col(uri), F.lit(version)))


def new_only(docs: DataFrame, time: str, horizon: str = "7 days") -> DataFrame:
    """Drops rows whose ingest key came within the horizon before; the state is bounded by it."""
    return docs.withWatermark(time, horizon).dropDuplicatesWithinWatermark(["ingest_key"])


def chunk_stream(docs: DataFrame, text: str = "text", size: int = 512, overlap: int = 50) -> DataFrame:
    return with_ids(line_chunks(docs, text, size, overlap), "ingest_key")


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by tumbling window; rows later than `late` are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def run_once(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Works off what is there and stops. write is called with each batch and its number, and must take one twice without harm."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
