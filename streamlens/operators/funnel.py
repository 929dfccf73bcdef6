"""Funnels: users that pass a sequence of steps, each after the one before."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ticks import PER_UNIT
from ..plans.columns import resolve
from ..plans.engine import ID, TIME, quoted

FUZZY = 5 * PER_UNIT["minute"]


@dataclass(frozen=True)
class Step:
    """Events, the property that names the user, a condition on events, whether the step wants users without such an event, and
    properties to report of each user's last qualifying event."""

    events: DataFrame
    user: str
    where: Column | None = None
    invert: bool = False
    output: tuple[str, ...] = ()


@dataclass
class Funnel:
    """Of each step a DataFrame (user, @time[, data]): users that passed it."""

    steps: list[DataFrame]

    def sizes(self) -> DataFrame:
        """(step, n), steps from 1; steps that nobody passes count 0."""
        found = None
        for k, s in enumerate(self.steps, 1):
            one = s.groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).cast("long").alias("step"), "n")
            found = one if found is None else found.union(one)
        return found

    def users(self, step: int) -> DataFrame:
        return self.steps[step].select("user")

    def data(self, step: int) -> DataFrame:
        return self.steps[step]


def funnel(
    steps: list[Step],
    start: int,
    end: int,
    end_first: int | None = None,
    mappers: dict[str, DataFrame | Callable[[Column], Column]] | None = None,
    keep_user: Callable[[Column], Column] | None = None,
    fuzzy: int = FUZZY,
) -> Funnel:
    """Run the steps over events with start <= @time <= end (the first step: end_first).

    A user passes a step if it passed the one before at t and has an event later than t - fuzzy; the time of passing is the first such
    event. An inverted step passes the others, at their earlier time. mappers turn the first step's users into the ids that
    another step's user property holds: a column function, or a DataFrame (user, id). Events without a user are dropped; a stream
    without the user property is an error."""
    if len(steps) < 2:
        raise ValueError("a funnel has two steps at least")
    if steps[0].invert:
        raise ValueError("the first step cannot be inverted")
    if any(s.invert and s.output for s in steps):
        raise ValueError("an inverted step has no events to report")
    passed: list[DataFrame] = []
    for k, step in enumerate(steps):
        user = resolve(step.events.schema, step.user)
        if user is None:
            raise ValueError(f"step {k + 1} has no property {step.user!r}")
        events = step.events.filter(quoted(TIME).between(start, end_first if k == 0 and end_first is not None else end))
        events = events.filter(user.isNotNull()) if step.where is None else events.filter(user.isNotNull() & step.where)
        fields = {f: resolve(step.events.schema, f) for f in step.output}
        data = F.struct(*(c.alias(f) for f, c in fields.items() if c is not None)) if any(c is not None for c in fields.values()) else None
        order = F.struct(quoted(TIME), quoted(ID)) if ID in step.events.columns else quoted(TIME)
        events = events.select(user.alias("user"), quoted(TIME).alias("t"), order.alias("order"), *([data.alias("data")] if data is not None else []))
        made = [F.min("t").alias(TIME), *([F.max_by("data", "order").alias("data")] if data is not None else [])]
        if k == 0:
            now = (events.filter(keep_user(F.col("user"))) if keep_user else events).groupBy("user").agg(*made)
        else:
            before = _mapped(passed[-1].select("user", quoted(TIME).alias("before")), step.user if step.user != steps[k - 1].user else None, mappers or {})
            hits = events.join(before, "user").filter(F.col("t") > F.col("before") - fuzzy)
            if step.invert:
                now = before.join(hits.select("user").distinct(), "user", "left_anti").select("user", F.col("before").alias(TIME))
            else:
                now = hits.groupBy("user").agg(*made)
        passed.append(now)
    return Funnel(passed)


def _mapped(users: DataFrame, to: str | None, mappers: dict[str, DataFrame | Callable[[Column], Column]]) -> DataFrame:
    how = mappers.get(to) if to else None
    if how is None:
        return users
    if isinstance(how, DataFrame):
        return users.join(how.toDF("user", "id"), "user").groupBy(F.col("id").alias("user")).agg(F.min("before").alias("before"))
    return users.withColumn("user", how(F.col("user")))
