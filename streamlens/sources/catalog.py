"""Namespaced streams stored as Parquet, one folder a stream, partitioned by UTC day."""

from __future__ import annotations

import re
import time
import uuid
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ticks
from ..plans import nodes
from ..plans.engine import ID, TIME, quoted

_NAME = re.compile(r"[\w\-.]{1,2048}")
DAY, BUCKET = "_day", "_bucket"


class CatalogError(ValueError):
    pass


def check_name(name: Any) -> str:
    if not isinstance(name, str) or not _NAME.fullmatch(name) or set(name) == {"."}:
        raise CatalogError(f"no stream name: {name!r}")
    return name


@dataclass(frozen=True)
class Rule:
    """How streams below a prefix are stored: width of a bucket in ticks (at most a day), files a bucket, records a file, readers' choice of root."""

    bucket: int = ticks.PER_DAY
    shards: int = 1
    records_per_file: int = 0
    write_to: tuple[str, ...] = ("main",)
    read_from: str = "main"


@dataclass
class Router:
    """The rule of the longest prefix of a stream's name, per namespace; the prefix "" is the rule for all others."""

    rules: dict[str | None, dict[str, Rule]] = field(default_factory=lambda: {None: {"": Rule()}})

    def __call__(self, stream: str, namespace: str | None = None) -> Rule:
        known = self.rules.get(namespace, self.rules.get(None, {}))
        match = max((p for p in known if stream.startswith(p)), key=len, default=None)
        if match is None:
            raise CatalogError(f"no rule for {stream!r}")
        return known[match]


class Catalog:
    def __init__(self, spark: SparkSession, roots: dict[str, str] | str, router: Router | None = None, default_namespace: str = "default") -> None:
        self.spark, self.router, self.default = spark, router or Router(), default_namespace
        self.roots = {"main": roots} if isinstance(roots, str) else dict(roots)

    def _fs(self, path: str) -> tuple[Any, Any]:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _path(self, root: str, stream: str, namespace: str | None) -> str:
        return f"{self.roots[root]}/{check_name(namespace or self.default)}/{check_name(stream)}"

    def put(self, stream: str, events: DataFrame, namespace: str | None = None) -> dict[str, int]:
        """Append events to every root that the stream's rule names; how many rows each got. @time is now where there is none, @id is new."""
        rule = self.router(check_name(stream), namespace)
        now = time.time_ns() // 100
        when = F.coalesce(quoted(TIME).cast("long"), F.lit(now)) if TIME in events.columns else F.lit(now).cast("long")
        rows = events.withColumns({TIME: when, ID: F.expr("uuid()")})
        day = ticks.day_of(F.col(f"`{TIME}`"))
        bucket = F.col(f"`{TIME}`") - ticks.modulo(F.col(f"`{TIME}`"), F.lit(rule.bucket))
        rows = rows.withColumns({DAY: day, BUCKET: bucket})
        # One shuffle: rows of a bucket meet in `shards` tasks, so that a day gets few files and no single task gets a hot bucket.
        rows = rows.withColumn("_shard", (F.rand(7) * rule.shards).cast("int")).repartition(DAY, BUCKET, "_shard").sortWithinPartitions(quoted(TIME)).drop("_shard", BUCKET)
        counts = {}
        for root in rule.write_to:
            counts[root] = self._append(rows, self._path(root, stream, namespace), rule)
        return counts

    @staticmethod
    def _append(rows: DataFrame, path: str, rule: Rule) -> int:
        from pyspark.sql import Observation

        seen = Observation()
        out = rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").partitionBy(DAY)
        (out.option("maxRecordsPerFile", rule.records_per_file) if rule.records_per_file else out).parquet(path)
        return seen.get["n"]

    def put_events(self, events: dict[str, list[dict[str, Any]]], namespace: str | None = None) -> dict[str, Any]:
        """Validate and append literal events; bad streams and events are told, good ones stored all the same."""
        report: dict[str, Any] = {}
        for stream, rows in events.items():
            try:
                check_name(stream)
            except CatalogError as wrong:
                report[str(stream)] = {"error": str(wrong)}
                continue
            good, bad = [], []
            for row in rows if isinstance(rows, list) else []:
                if not isinstance(row, dict):
                    bad.append("an event is an object")
                elif TIME in row and (isinstance(row[TIME], bool) or not isinstance(row[TIME], int)):
                    bad.append(f"{TIME} is no whole number: {row[TIME]!r}")
                else:
                    good.append(row)
            report[stream] = {"errors": bad, "inserted": self.put(stream, self.spark.createDataFrame(_aligned(good)), namespace) if good else {}}
        return report

    def _all(self, stream: str, namespace: str | None, root: str | None = None) -> DataFrame | None:
        path = self._path(root or self.router(check_name(stream), namespace).read_from, stream, namespace)
        fs, at = self._fs(path)
        return self.spark.read.option("mergeSchema", True).parquet(path) if fs.exists(at) else None

    @staticmethod
    def _range(start: int, end: int, start_id: str | None) -> Column:
        """start <= @time <= end, days first so that partitions are pruned; with an id, only events after (start, id)."""
        t = quoted(TIME)
        days = F.col(DAY).between(ticks.day_of(F.lit(start).cast("long")), ticks.day_of(F.lit(end).cast("long")))
        after = t >= start if start_id is None else (t > start) | ((t == start) & (quoted(ID) > start_id))
        return days & after & (t <= end)

    def retrieve(self, stream: str, start: int = 0, end: int = 2**62, start_id: str | None = None, order: str = "ascending", limit: int | None = None, namespace: str | None = None) -> DataFrame | None:
        """Events of [start, end] in order; with start_id those after event (start, start_id). None: no such stream."""
        if order not in ("ascending", "descending"):
            raise CatalogError(f"no order: {order!r}")
        found = self._all(stream, namespace)
        if found is None:
            return None
        found = found.filter(self._range(start, end, start_id)).drop(DAY)
        keys = [quoted(TIME), quoted(ID)]
        found = found.orderBy(*(k.asc() if order == "ascending" else k.desc() for k in keys))
        return found if limit is None else found.limit(max(0, limit))

    def scan(self, p: nodes.Stream) -> DataFrame | None:
        """A resolver for Engine: the range of a stream, unordered."""
        found = self._all(p.stream, p.namespace)
        return None if found is None else found.filter(self._range(p.start_time, p.end_time, None)).drop(DAY)

    def delete(self, stream: str, start: int, end: int, start_id: str | None = None, namespace: str | None = None) -> dict[str, int]:
        """Remove events of [start, end] (with start_id: those after it) from every root; how many. Only days of the range are
        rewritten: survivors are staged beside the stream, then swapped in a day at a time. A day is moved aside, not deleted, before its
        survivors take its place, and goes only when all are in: a driver lost in between loses nothing."""
        out: dict[str, int] = {}
        for root in self.router(check_name(stream), namespace).write_to:
            found = self._all(stream, namespace, root)
            if found is None or start > end:
                out[root] = 0
                continue
            hit = self._range(start, end, start_id)
            days, out[root] = [], 0
            for day, n in found.filter(hit).groupBy(F.col(DAY)).count().collect():  # a row a day
                days.append(day)
                out[root] += n
            if not days:
                continue
            path = self._path(root, stream, namespace)
            staged = f"{self.roots[root]}/_staged-{uuid.uuid4().hex}"
            found.filter(F.col(DAY).isin(days) & ~hit).write.partitionBy(DAY).parquet(staged)
            for day in days:
                fs, old = self._fs(f"{path}/{DAY}={day}")
                _, new = self._fs(f"{staged}/{DAY}={day}")
                _, aside = self._fs(f"{staged}/_old-{day}")
                fs.mkdirs(aside.getParent())
                if not fs.rename(old, aside):
                    raise CatalogError(f"{old} could not be moved")
                if fs.exists(new) and not fs.rename(new, old):
                    fs.rename(aside, old)
                    raise CatalogError(f"{new} could not be moved")
            fs.delete(self._fs(staged)[1], True)
        return out

    def streams(self, namespace: str | None = None, prefix: str = "") -> list[str]:
        found: set[str] = set()
        for root in self.roots.values():
            fs, at = self._fs(f"{root}/{check_name(namespace or self.default)}")
            if fs.exists(at):
                found |= {s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()}
        return sorted(n for n in found if n.startswith(prefix))

    def properties(self, stream: str, namespace: str | None = None) -> list[str]:
        """What the stream's events hold beside @ fields."""
        found = self._all(stream, namespace)
        return [] if found is None else [c for c in found.columns if not c.startswith("@") and c != DAY]

    def retain(self, stream: str, most: int, namespace: str | None = None) -> DataFrame | None:
        """The newest `most` events."""
        return self.retrieve(stream, order="descending", limit=most, namespace=namespace)


def _aligned(rows: list[dict[str, Any]]) -> list[dict[str, Any]]:
    names = list(dict.fromkeys(k for r in rows for k in r))
    return [{k: r.get(k) for k in names} for r in rows]


def retention(events: DataFrame, most: int) -> DataFrame:
    """The newest `most` events of a DataFrame, as a top-k: nothing is sorted globally."""
    return events.orderBy(quoted(TIME).desc(), quoted(ID).desc()).limit(max(0, most))


