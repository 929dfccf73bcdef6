"""Structured Streaming twins of the bucketed queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_events(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def bucket_stream(events: DataFrame, ts: str, width: str, lateness: str, *aggregates, keys: tuple[str, ...] = ()) -> DataFrame:
    """Tumbling windows with a watermark: in append mode a window appears once the watermark has passed its end, as a trusted bucket
    does. ts is cast to TIMESTAMP, so the session's time zone should be UTC."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", lateness)
    grouped = timed.groupBy(F.window("_ts", width), *keys).agg(*(aggregates or (F.count(F.lit(1)).alias("n"),)))
    return grouped.select(F.col("window.start").alias("bucket_start"), F.col("window.end").alias("bucket_end"), *(c for c in grouped.columns if c != "window"))


def run_available(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Everything that is there now, through the streaming engine, into Parquet files below path, which driver and executors share.

    In append mode each batch has a folder of its own, in complete mode each batch replaces the one before; a batch that runs again
    overwrites what it wrote. The offsets are kept below path too, so a further call goes on where this one ended."""
    out = f"{path}/out"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    spark, at = stream.sparkSession, stream.sparkSession._jvm.org.apache.hadoop.fs.Path(out)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(out).select(*stream.columns)


def upsert(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Hand each micro-batch to write; `every` is a processing-time interval, none means what is available now."""
    writer = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
