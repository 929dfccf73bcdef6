"""Stream tools: difference, copy, dump, and the shapes that dashboards draw."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.columns import resolve
from ..plans.engine import ID, TIME, quoted


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, event): events as JSON, ids aside, that are in one stream only; repeats count once. Each side is exchanged once."""
    side = lambda df, name: df.select(F.to_json(F.struct(*(quoted(c) for c in sorted(df.columns) if c != ID))).alias("event"), F.lit(name).alias("side"))
    both = side(a, "left").union(side(b, "right"))
    met = both.groupBy("event").agg(F.min("side").alias("side"), F.max("side").alias("last"))
    return met.filter("side = last").select("side", "event")


def difference_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, total, extra): distinct events of each side, and those the other lacks."""
    extra = difference(a, b).groupBy("side").agg(F.count(F.lit(1)).alias("extra"))
    total = None
    for df, name in ((a, "left"), (b, "right")):
        one = df.drop(ID).distinct().groupBy().agg(F.count(F.lit(1)).alias("total")).select(F.lit(name).alias("side"), "total")
        total = one if total is None else total.union(one)
    return total.join(extra, "side", "left").select("side", "total", F.coalesce("extra", F.lit(0)).alias("extra"))


def sampled(df: DataFrame, start: int, end: int, samples: int, interval: int, seed: int = 42) -> DataFrame:
    """Events of random sub-intervals of [start, end]; the same seed gives both sides of a comparison the same ones."""
    import random

    rng = random.Random(seed)
    starts = [rng.randint(start, max(start, end - interval)) for _ in range(samples)]
    hit = F.lit(False)
    for s in starts:
        hit = hit | quoted(TIME).between(s, min(end, s + interval))
    return df.filter(hit)


def copy(df: DataFrame, start: int, end: int) -> DataFrame:
    """What a copy of [start, end] holds: events without their ids."""
    return df.filter(quoted(TIME).between(start, end)).drop(ID)


def readable(streams: dict[str, DataFrame], seconds: float) -> list[tuple[str, float]]:
    """(name, seconds) of the streams whose first event comes within the limit; a read beyond it is cancelled."""
    import threading
    import time
    import uuid

    found = []
    for name, df in streams.items():
        context, group = df.sparkSession.sparkContext, f"readable-{uuid.uuid4().hex}"
        context.setJobGroup(group, f"first event of {name}", interruptOnCancel=True)
        timer = threading.Timer(seconds, context.cancelJobGroup, (group,))
        timer.start()
        began = time.monotonic()
        try:
            df.take(1)
            took = time.monotonic() - began
            if took <= seconds:
                found.append((name, took))
        except Exception:  # noqa: BLE001  cancelled, or not readable at all: either way not listed
            pass
        finally:
            timer.cancel()
            context.setLocalProperty("spark.jobGroup.id", None)
    return found


def dump_json(df: DataFrame) -> Iterator[str]:
    return (r[0] for r in df.orderBy(*(quoted(c) for c in (TIME, ID) if c in df.columns)).select(F.to_json(F.struct("*"))).toLocalIterator())


def fields(df: DataFrame, names: list[str]) -> DataFrame:
    """The named dotted properties as text, in time order; null where there is none. For CSV: .write.csv(…)."""
    found = {n: resolve(df.schema, n) for n in names}
    order = [quoted(c) for c in (TIME, ID) if c in df.columns]
    return (df.orderBy(*order) if order else df).select(*((F.lit(None) if c is None else c).cast("string").alias(n) for n, c in found.items()))


def series(df: DataFrame, value: str = "@value", group: str = "@group") -> DataFrame:
    """(group, points): each group's (x, y) points in time order."""
    return df.groupBy(quoted(group).alias("group")).agg(F.sort_array(F.collect_list(F.struct(quoted(TIME).alias("x"), quoted(value).alias("y")))).alias("points"))


def series_rows(df: DataFrame, value: str = "@value", group: str = "@group") -> DataFrame:
    """The same as rows (group, x, y, place), for groups too long to gather."""
    from pyspark.sql import Window as W

    return df.select(quoted(group).alias("group"), quoted(TIME).alias("x"), quoted(value).alias("y")).withColumn("place", F.row_number().over(W.partitionBy("group").orderBy("x", "y")))


def bars(df: DataFrame, labels: list[str] | None = None, value: str = "@value", group: str = "@group", label: str = "@label") -> DataFrame:
    """One row a group, one column a label: sums. labels, if given, saves the pass that finds them."""
    pivoted = df.groupBy(quoted(group).alias("group")).pivot(label, labels) if labels else df.groupBy(quoted(group).alias("group")).pivot(label)
    return pivoted.agg(F.sum(quoted(value)))


def bar_warnings(df: DataFrame, group: str = "@group", label: str = "@label") -> DataFrame:
    """(group, label, n) of labels that a group has more than once."""
    return df.groupBy(quoted(group).alias("group"), quoted(label).alias("label")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def gauge(df: DataFrame, value: str = "@value") -> DataFrame:
    """The last event's value."""
    order = F.struct(quoted(TIME), *([quoted(ID)] if ID in df.columns else []))
    return df.agg(F.max_by(quoted(value), order).alias("value"))


def page(df: DataFrame, column: str, number: int, size: int, descending: bool = False) -> DataFrame:
    """Page `number` (from 1) of the rows sorted by a column, ties by all others."""
    rest = [quoted(c) for c in df.columns if c != column]
    first = quoted(column).desc_nulls_last() if descending else quoted(column).asc_nulls_first()
    return df.orderBy(first, *rest).offset((number - 1) * size).limit(size)
