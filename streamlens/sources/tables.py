"""Event streams from tables and files."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ticks
from ..plans import nodes
from ..plans.engine import ID, TIME, Source


def between_ticks(ts: Column, start: int, end: int) -> Column:
    """start <= ticks of ts <= end on the stored TIMESTAMP_NTZ column itself, so that the bounds reach the file scan. Microseconds
    are coarser than ticks: the bounds are narrowed to whole ones."""
    epoch, low, high = datetime(1970, 1, 1), datetime.min, datetime.max
    at = lambda us: max(low, min(high, epoch + timedelta(microseconds=us))) if abs(us) < 6 * 10**16 else (low if us < 0 else high)
    literal = lambda us: F.lit(at(us).isoformat(sep=" ")).cast("timestamp_ntz")  # noqa: E731  as text: a datetime would depend on the time zone
    return ts.between(literal(-(-start // 10)), literal(end // 10))


def table_source(df: DataFrame, ts: str = "ts", id_col: str | None = None) -> Source:
    """A source over a table with a TIMESTAMP_NTZ column; @time and, if there is an id, @id are added."""

    def read(p: nodes.Stream) -> DataFrame:
        found = df.filter(between_ticks(F.col(ts), p.start_time, p.end_time)).withColumn(TIME, ticks.ticks_of(F.col(ts)))
        return found.withColumn(ID, F.col(id_col).cast("string")) if id_col else found

    return read


def events_source(spark: SparkSession, path: str) -> Source:
    """The events table as a stream: @time, @id, its columns, and k out of the JSON properties."""
    df = spark.read.parquet(path)
    return table_source(df.withColumn("k", F.get_json_object("props", "$.k").cast("long")), "ts", "event_id")


def csv_events(spark: SparkSession, path: str, time_column: str, time_format: str | None = None) -> DataFrame:
    """Events of CSV files with a header; @time is parsed from a column, rows where it cannot be have null."""
    df = spark.read.csv(path, header=True)
    when = F.try_to_timestamp(F.col(time_column), F.lit(time_format)) if time_format else F.col(time_column).try_cast("timestamp_ntz")
    return df.withColumn(TIME, ticks.ticks_of(when.cast("timestamp_ntz")))


def json_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of JSON lines; fields that some events lack are null there."""
    return spark.read.json(path)


def synthetic_events(spark: SparkSession, n: int, start: int, microseconds_apart: int, properties: int = 1) -> DataFrame:
    """n regularly spaced events with properties property0, property1, …"""
    step = F.lit(microseconds_apart * 10)
    return spark.range(n).select((F.lit(start) + F.col("id") * step).alias(TIME), *(F.lit(k).cast("long").alias(f"property{k}") for k in range(properties)))
