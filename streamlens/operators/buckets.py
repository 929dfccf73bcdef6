"""Time-bucketed queries whose results are stored once a bucket is old enough to be trusted."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ticks import PER_SECOND, modulo, seconds_of, span_ticks, to_ticks
from ..plans.engine import TIME, quoted

BUCKET = "_bucket"


def bucket_of(time: Column, width: int) -> Column:
    return time - modulo(time, F.lit(width))


def bucket_counts(events: DataFrame, width: int, value: Column | None = None) -> DataFrame:
    """(bucket, n): rows, or rows with a value, per bucket of width ticks."""
    return events.groupBy(bucket_of(quoted(TIME), width).alias("bucket")).agg(F.count(F.lit(1) if value is None else value).alias("n"))


def timeframe(width: timedelta, recent: tuple[float, str] | None = None, between: tuple[datetime, datetime] | None = None, now: datetime | None = None) -> tuple[int, int]:
    """(start, end) ticks of the last so many units, or of a range, widened to whole buckets."""
    if (recent is None) == (between is None):
        raise ValueError("a timeframe is recent or a range")
    if recent:
        end = now or datetime.now(UTC)
        between = (end - timedelta(seconds=seconds_of(*recent)), end)
    w = span_ticks(width)
    start, end = map(to_ticks, between)
    return start - start % w, end + -end % w


class BucketedQuery:
    """query(start, end) gives the events of whole buckets with a column @time; one job computes all buckets that are missing.

    Results are stored as Parquet below path/<identity>, partitioned by bucket. A bucket is final if it ends before the untrusted
    time; later ones are computed each time. The identity is of the name, the width and the arguments: another query needs another name."""

    def __init__(self, spark: SparkSession, path: str, name: str, width: timedelta, query: Callable[..., DataFrame], args: tuple = (), version: int = 1) -> None:
        self.width = span_ticks(width)
        if self.width <= 0 or self.width % PER_SECOND:
            raise ValueError("a bucket is a whole number of seconds wide")
        self.spark, self.query, self.args = spark, query, args
        self.identity = hashlib.sha256(json.dumps([version, name, self.width, list(map(repr, args))]).encode()).hexdigest()[:20]
        self.path = f"{path}/{self.identity}"

    def _check(self, *bounds: int) -> None:
        if any(b % self.width for b in bounds):
            raise ValueError("bounds are on the edges of buckets")

    def _stored(self) -> DataFrame | None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return None
        return self.spark.read.parquet(self.path)

    def _required(self, start: int, end: int) -> DataFrame:
        return self.spark.range(start, end, self.width).toDF(BUCKET)

    def _marks(self) -> DataFrame | None:
        """Buckets that are stored, by their mark (a row without an event, so that a bucket without events is known as computed);
        those marked twice are not trusted."""
        stored = self._stored()
        return None if stored is None else stored.filter("_mark").groupBy(BUCKET).count().filter("count = 1").select(BUCKET)

    def missing(self, start: int, end: int) -> DataFrame:
        marks, required = self._marks(), self._required(start, end)
        return required if marks is None else required.join(marks, BUCKET, "left_anti")

    def _compute(self, buckets: DataFrame, start: int, end: int) -> DataFrame:
        """Events of the given buckets among [start, end): one run of the query over the whole span, cut to the buckets."""
        events = self.query(start, end, *self.args).withColumn(BUCKET, bucket_of(quoted(TIME), self.width))
        return events.filter((quoted(TIME) >= start) & (quoted(TIME) < end)).join(buckets, BUCKET, "left_semi")

    def compute_and_store(self, start: int, end: int, untrusted: int, force: bool = False) -> int:
        """Compute and store the final buckets of [start, end) that are not stored, or all with force. How many."""
        self._check(start, end)
        final = F.col(BUCKET) + self.width < F.lit(untrusted)
        todo = (self._required(start, end) if force else self.missing(start, end)).filter(final)
        span = todo.agg(F.min(BUCKET), F.max(BUCKET), F.count(F.lit(1))).first()
        if not span[2]:
            return 0
        events = self._compute(todo, span[0], span[1] + self.width).withColumn("_mark", F.lit(False))
        rows = events.unionByName(todo.withColumn("_mark", F.lit(True)), allowMissingColumns=True)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
        return span[2]

    def retrieve(self, start: int, end: int, untrusted: int | None = None, compute_missing: bool = False) -> DataFrame:
        """Events of [start, end): stored ones, and with compute_missing those of the other buckets, computed now."""
        self._check(start, end)
        stored, marks = self._stored(), self._marks()
        within = F.col(BUCKET).between(start, end - 1)
        kept = None
        if stored is not None:
            kept = stored.filter(within & ~F.col("_mark")).join(marks.filter(within), BUCKET, "left_semi").drop("_mark")
        if not compute_missing:
            fresh = self.query(start, end, *self.args).withColumn(BUCKET, F.lit(0).cast("long")).limit(0) if kept is None else None
        else:
            if untrusted is not None:
                self.compute_and_store(start, end, untrusted)
                return self.retrieve(start, end, None, True)
            fresh = self._compute(self.missing(start, end), start, end)
        found = kept if fresh is None else fresh if kept is None else kept.unionByName(fresh, allowMissingColumns=True)
        return found.drop(BUCKET)
