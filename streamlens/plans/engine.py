"""Plans as DataFrames: one lazy DataFrame a plan, no action until the caller asks for rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import nodes
from .columns import Compiler

TIME, ID = "@time", "@id"
#: A source: the events of a stream with start <= @time <= end, as a DataFrame.
Source = Callable[[nodes.Stream], DataFrame]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


class Engine:
    """Runs plans over named streams. Sources are DataFrames, or functions that make one for a stream node's bounds."""

    def __init__(self, spark: SparkSession, compat: str = "fixed") -> None:
        self.spark, self.compat = spark, compat
        self.sources: dict[tuple[str | None, str], DataFrame | Source] = {}
        self.resolvers: list[Callable[[nodes.Stream], DataFrame | None]] = []

    def register(self, stream: str, source: DataFrame | Source, namespace: str | None = None) -> Engine:
        self.sources[namespace, stream] = source
        return self

    def resolver(self, find: Callable[[nodes.Stream], DataFrame | None]) -> Engine:
        """find is asked for streams that are not registered, such as those of a catalog."""
        self.resolvers.append(find)
        return self

    def run(self, plan: nodes.Plan | dict[str, Any]) -> DataFrame:
        return self._build(nodes.parse(plan) if isinstance(plan, dict) else plan)

    def status(self) -> dict[str, object]:
        """Whether the cluster runs a job, and what is registered."""
        return {"alive": self.spark.range(1).count() == 1, "streams": sorted(name for _, name in self.sources)}

    def json_lines(self, plan: nodes.Plan | dict[str, Any]) -> Iterator[str]:
        """Rows as JSON texts, a partition at a time on the driver."""
        return (r[0] for r in self.run(plan).select(F.to_json(F.struct("*"))).toLocalIterator())

    def _build(self, plan: nodes.Plan) -> DataFrame:
        return getattr(self, f"_{type(plan).__name__.lower()}")(plan)

    def _stream(self, p: nodes.Stream) -> DataFrame:
        source = self.sources.get((p.namespace, p.stream))
        if source is None:
            source = next((found for find in self.resolvers if (found := find(p)) is not None), None)
        if source is None:
            raise nodes.PlanError(f"unknown stream {p.stream!r} in namespace {p.namespace!r}")
        if not isinstance(source, DataFrame):
            return source(p)
        return source.filter(quoted(TIME).between(p.start_time, p.end_time))

    def _project(self, p: nodes.Project) -> DataFrame:
        df = self._build(p.stream)
        to = Compiler(df, self.compat)
        made = {nodes.label(f): to.value(f) for f in p.fields}
        kept = {c: quoted(c) for c in df.columns} if p.merge else {}
        return df.select(*(c.alias(name) for name, c in {**kept, **made}.items()))

    def _filter(self, p: nodes.Filter) -> DataFrame:
        df = self._build(p.stream)
        return df.filter(Compiler(df, self.compat).test(p.condition))

    def _orderby(self, p: nodes.OrderBy) -> DataFrame:
        df = self._build(p.stream)
        to = Compiler(df, self.compat)
        return df.orderBy(*((c.desc_nulls_last() if p.reverse else c.asc_nulls_first()) for c in map(to.value, p.fields)))

    def _limit(self, p: nodes.Limit) -> DataFrame:
        df = self._build(p.stream)
        below = p.stream
        while isinstance(below, nodes.Filter | nodes.Project):
            below = below.stream
        order = [quoted(c) for c in (TIME, ID) if c in df.columns]
        if isinstance(below, nodes.Stream) and order:  # a stream has an order, whatever partitions it is read in
            df = df.orderBy(*order)
        return df.limit(max(0, p.limit))

    def _aggregate(self, p: nodes.Aggregate) -> DataFrame:
        df = self._build(p.stream)
        to = Compiler(df, self.compat)
        keys = {nodes.label(g): to.value(g) for g in p.group_by}
        made = [to.aggregate(a.op, a.arguments).alias(a.alias) for a in p.aggregates]
        groups = [c.alias(name) for name, c in keys.items()] or [F.lit(1).alias("every")]  # a grouped one: no input, no row
        grouped = df.groupBy(*groups)
        names = [*keys, *(a.alias for a in p.aggregates)]
        return (grouped.agg(*made) if made else df.select(*groups).distinct()).select(*map(quoted, names))

    def _join(self, p: nodes.Join) -> DataFrame:
        sides = ((self._build(p.left), p.left_name), (self._build(p.right), p.right_name))
        left, right = (df.select(*(quoted(c).alias(f"{name}.{c}") for c in df.columns)) for df, name in sides)
        if p.condition == nodes.All(()):
            return left.crossJoin(right)
        # Types are known from a product that is never run; equality is null-safe and becomes the join's key, the rest its residual.
        return left.join(right, Compiler(left.crossJoin(right), self.compat).test_join(p.condition), "inner")
