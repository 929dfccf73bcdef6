"""Cohorts: who, of those that first did one thing in a period, does another in each period after."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import UTC, datetime, timedelta
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ticks import PER_UNIT, to_datetime, to_ticks
from ..plans.engine import TIME, Engine
from ..plans.nodes import Aggregate, Aggregator, All, Condition, Constant, Function, Join, Plan, Project, Property, Stream

UNITS = {"days": PER_UNIT["day"], "weeks": PER_UNIT["week"], "months": 30 * PER_UNIT["day"]}


@dataclass(frozen=True)
class Side:
    """A stream, the property that names the user, a unit (days, weeks, months of 30 days) and how many of them."""

    stream: str
    key: str
    unit: str
    periods: int
    transform: Callable[[Plan], Plan] = lambda s: s
    namespace: str | None = None

    @property
    def ticks(self) -> int:
        return UNITS[self.unit]


def _firsts(side: Side, start: int, end: int, offset: int, alias: str) -> Plan:
    """Each user's first event of each period."""
    events = side.transform(Stream(side.stream, start, end, namespace=side.namespace))
    time, key = Property(TIME), Property(side.key)
    dated = Project(events, (time.named(TIME), key.named(side.key), Function("floor", (time, Constant(side.ticks), Constant(offset)), "date")))
    return Aggregate(dated, (key.named(side.key), Property("date", alias="date")), (Aggregator("min", (time,), TIME),), alias)


def cohort_plan(start: datetime | int, cohort: Side, action: Side) -> Plan:
    """A plan with rows (@time, action_step, cohort_actions): users of the cohort of period @time that act action_step ticks later."""
    at = to_ticks(start) - to_ticks(start) % PER_UNIT["day"]
    cohort_end = at + cohort.ticks * cohort.periods
    action_end = cohort_end + action.ticks * action.periods
    left, right = _firsts(cohort, at, cohort_end + 1, at, "cohort"), _firsts(action, at, action_end + 1, at, "action")
    acted, joined_at = Property(f"action.{TIME}"), Property(f"cohort.{TIME}")
    user = Property(f"cohort.{cohort.key}")
    on = All((
        Condition("eq", user, Property(f"action.{action.key}")), Condition("gte", acted, joined_at),
        Condition("lt", acted, Function("add", (joined_at, Constant(action.ticks * action.periods)))),
    ))
    step = Function("floor", (Function("subtract", (acted, joined_at)), Constant(action.ticks)), "action_step")
    users = Aggregate(Join(left, right, on), (Property("cohort.date", alias=TIME), replace(user, alias="group"), step), (Aggregator("count", (), "count"),))
    return Aggregate(users, (Property(TIME, alias=TIME), Property("action_step", alias="action_step")), (Aggregator("count", (), "cohort_actions"),))


def cohort_sizes(engine: Engine, start: datetime | int, cohort: Side) -> DataFrame:
    """(@time, cohort_size): users of each period's cohort."""
    at = to_ticks(start) - to_ticks(start) % PER_UNIT["day"]
    firsts = _firsts(cohort, at, at + cohort.ticks * cohort.periods + 1, at, "cohort")
    return engine.run(Aggregate(firsts, (Property("date", alias=TIME),), (Aggregator("count", (), "cohort_size"),)))


def cohort_report(engine: Engine, start: datetime | int, cohort: Side, action: Side) -> dict[str, dict]:
    """{date: {cohort_size, action_dates: {date: users}}}; as many rows as cohorts times steps reach the driver."""
    report: dict[str, dict] = {}
    day = lambda t: to_datetime(t).astimezone(UTC).date().isoformat()
    for r in cohort_sizes(engine, start, cohort).collect():
        report[day(r[TIME])] = {"cohort_size": r["cohort_size"], "action_dates": {}}
    for r in engine.run(cohort_plan(start, cohort, action)).collect():
        at = to_datetime(r[TIME]) + timedelta(microseconds=r["action_step"] // 10)
        report.setdefault(day(r[TIME]), {"cohort_size": 0, "action_dates": {}})["action_dates"][at.date().isoformat()] = r["cohort_actions"]
    return report


def with_sizes(actions: DataFrame, sizes: DataFrame) -> DataFrame:
    return actions.join(sizes, TIME, "left").withColumn("cohort_size", F.coalesce("cohort_size", F.lit(0)))
