"""The query plan: frozen nodes, a JSON form, and validation when a node is made."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any, ClassVar

from ..functions import ticks

FUNCTIONS = ("add", "subtract", "multiply", "divide", "floor", "ceil", "lowercase", "uppercase", "rand_int", "date_trunc", "date_part", "len")
TRUNC_UNITS = (*ticks.PER_UNIT, "month", "year")
PART_UNITS = ("second", "minute", "hour", "day", "month", "year", "week_day")
COMPARISONS = ("lt", "lte", "gt", "gte", "eq", "contains", "in", "regex")
AGGREGATES = ("min", "max", "avg", "sum", "count")
_ARITY = {"floor": (2, 3), "ceil": (2, 3), "lowercase": (1, 1), "uppercase": (1, 1), "rand_int": (2, 2), "date_trunc": (2, 2), "date_part": (2, 2), "len": (1, 1)}


class PlanError(ValueError):
    """A plan that says nothing the engine could run."""


def _need(holds: bool, why: str) -> None:
    if not holds:
        raise PlanError(why)


class Value:
    alias: str | None

    def _join(self, name: str, other: Value, both: bool) -> Function:
        mine = self.arguments if isinstance(self, Function) and self.name == name else (self,)
        theirs = other.arguments if both and isinstance(other, Function) and other.name == name else (other,)
        return Function(name, (*mine, *theirs), self.alias or other.alias)

    def __add__(self, other: Value) -> Function:
        return self._join("add", other, True)

    def __mul__(self, other: Value) -> Function:
        return self._join("multiply", other, True)

    def __sub__(self, other: Value) -> Function:  # a - (b - c) is not a - b - c: only the left side is flattened
        return self._join("subtract", other, False)

    def __truediv__(self, other: Value) -> Function:
        return self._join("divide", other, False)

    def named(self, alias: str) -> Value:
        return replace(self, alias=alias)

    def to_dict(self) -> dict[str, Any]:
        raise NotImplementedError


def _with_alias(d: dict[str, Any], alias: str | None) -> dict[str, Any]:
    return d if alias is None else d | {"alias": alias}


@dataclass(frozen=True)
class Constant(Value):
    value: Any
    alias: str | None = None

    def to_dict(self) -> dict[str, Any]:
        return _with_alias({"type": "constant", "value": self.value}, self.alias)


@dataclass(frozen=True)
class Property(Value):
    name: str
    default: Any = None
    alias: str | None = None

    def __post_init__(self) -> None:
        _need(isinstance(self.name, str) and bool(self.name), "a property needs a name")

    def to_dict(self) -> dict[str, Any]:
        d = {"type": "property", "name": self.name} | ({} if self.default is None else {"default": self.default})
        return _with_alias(d, self.alias)


@dataclass(frozen=True)
class Function(Value):
    name: str
    arguments: tuple[Value, ...] = ()
    alias: str | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "arguments", tuple(self.arguments))
        _need(self.name in FUNCTIONS, f"unknown function {self.name!r}")
        least, most = _ARITY.get(self.name, (0, None))
        n = len(self.arguments)
        _need(least <= n and (most is None or n <= most), f"{self.name} takes {least} to {most} arguments, not {n}")
        if self.name in ("date_trunc", "date_part"):
            unit, units = self.arguments[1], TRUNC_UNITS if self.name == "date_trunc" else PART_UNITS
            _need(isinstance(unit, Constant) and unit.value in units, f"{self.name} needs one of {units}")

    def to_dict(self) -> dict[str, Any]:
        return _with_alias({"type": "function", "name": self.name, "arguments": [a.to_dict() for a in self.arguments]}, self.alias)


def properties(value: Value) -> set[str]:
    """Names that a value reads."""
    if isinstance(value, Property):
        return {value.name}
    return set().union(*map(properties, value.arguments)) if isinstance(value, Function) else set()


class Test:
    negate: bool

    def __invert__(self) -> Test:
        return replace(self, negate=not self.negate)

    def __and__(self, other: Test) -> All:
        return All(_flat(All, self) + _flat(All, other))

    def __or__(self, other: Test) -> Any_:
        return Any_(_flat(Any_, self) + _flat(Any_, other))


def _flat(kind: type, test: Test) -> tuple[Test, ...]:
    return test.conditions if isinstance(test, kind) and not test.negate else (test,)


@dataclass(frozen=True)
class Condition(Test):
    op: str
    left: Value
    right: Value
    negate: bool = False

    def __post_init__(self) -> None:
        _need(self.op in COMPARISONS, f"unknown condition {self.op!r}")

    def to_dict(self) -> dict[str, Any]:
        return {"op": self.op, "left": self.left.to_dict(), "right": self.right.to_dict()} | ({"negate": True} if self.negate else {})


@dataclass(frozen=True)
class _Several(Test):
    conditions: tuple[Test, ...] = ()
    negate: bool = False
    op: ClassVar[str]

    def __post_init__(self) -> None:
        object.__setattr__(self, "conditions", tuple(self.conditions))

    def to_dict(self) -> dict[str, Any]:
        return {"type": self.op, "conditions": [c.to_dict() for c in self.conditions]} | ({"negate": True} if self.negate else {})


class All(_Several):
    op = "and"


class Any_(_Several):
    op = "or"


@dataclass(frozen=True)
class Aggregator:
    op: str
    arguments: tuple[Value, ...]
    alias: str

    def __post_init__(self) -> None:
        object.__setattr__(self, "arguments", tuple(self.arguments))
        _need(self.op in AGGREGATES, f"unknown aggregate {self.op!r}")
        _need(len(self.arguments) == 1 or self.op == "count" and not self.arguments, f"{self.op} takes one argument")
        _need(isinstance(self.alias, str) and bool(self.alias), f"{self.op} needs an alias")

    def to_dict(self) -> dict[str, Any]:
        return {"op": self.op, "arguments": [a.to_dict() for a in self.arguments], "alias": self.alias}


def label(value: Value) -> str:
    """The output column of a value: its alias, or the property's name."""
    name = value.alias or (value.name if isinstance(value, Property) else None)
    _need(name is not None, "a value that is no property needs an alias")
    return name


def _unique(names: list[str]) -> None:
    _need(len(set(names)) == len(names), f"a name is given twice: {names}")


class Plan:
    alias: str | None


@dataclass(frozen=True)
class Stream(Plan):
    stream: str
    start_time: int
    end_time: int
    host: str | None = None
    namespace: str | None = None
    alias: str | None = None
    kind: str = "stream"

    def __post_init__(self) -> None:
        _need(isinstance(self.stream, str) and bool(self.stream), "a stream needs a name")
        for t in (self.start_time, self.end_time):
            _need(isinstance(t, int) and not isinstance(t, bool), "a stream's bounds are whole ticks")

    def to_dict(self) -> dict[str, Any]:
        d = {"type": self.kind, "host": self.host, "stream": self.stream, "start_time": self.start_time, "end_time": self.end_time, "namespace": self.namespace}
        return _with_alias({k: v for k, v in d.items() if v is not None}, self.alias)


@dataclass(frozen=True)
class Project(Plan):
    stream: Plan
    fields: tuple[Value, ...]
    merge: bool = False
    alias: str | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "fields", tuple(self.fields))
        _unique([label(f) for f in self.fields])

    def to_dict(self) -> dict[str, Any]:
        d = {"type": "project", "stream": self.stream.to_dict(), "fields": [f.to_dict() for f in self.fields]} | ({"merge": True} if self.merge else {})
        return _with_alias(d, self.alias)


@dataclass(frozen=True)
class Filter(Plan):
    stream: Plan
    condition: Test
    alias: str | None = None

    def to_dict(self) -> dict[str, Any]:
        return _with_alias({"type": "filter", "stream": self.stream.to_dict(), "condition": self.condition.to_dict()}, self.alias)


@dataclass(frozen=True)
class OrderBy(Plan):
    stream: Plan
    fields: tuple[Value, ...]
    reverse: bool = False
    alias: str | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "fields", tuple(self.fields))

    def to_dict(self) -> dict[str, Any]:
        d = {"type": "order_by", "stream": self.stream.to_dict(), "fields": [f.to_dict() for f in self.fields]} | ({"reverse": True} if self.reverse else {})
        return _with_alias(d, self.alias)


@dataclass(frozen=True)
class Limit(Plan):
    stream: Plan
    limit: int
    alias: str | None = None

    def __post_init__(self) -> None:
        _need(isinstance(self.limit, int) and not isinstance(self.limit, bool), "a limit is a whole number")

    def to_dict(self) -> dict[str, Any]:
        return _with_alias({"type": "limit", "stream": self.stream.to_dict(), "limit": self.limit}, self.alias)


@dataclass(frozen=True)
class Aggregate(Plan):
    stream: Plan
    group_by: tuple[Value, ...]
    aggregates: tuple[Aggregator, ...]
    alias: str | None = None

    def __post_init__(self) -> None:
        groups = (self.group_by,) if isinstance(self.group_by, Value) else tuple(self.group_by)
        object.__setattr__(self, "group_by", groups)
        object.__setattr__(self, "aggregates", tuple(self.aggregates))
        _unique([*(label(g) for g in groups), *(a.alias for a in self.aggregates)])

    def to_dict(self) -> dict[str, Any]:
        d = {"type": "aggregate", "stream": self.stream.to_dict(), "group_by": [g.to_dict() for g in self.group_by], "aggregates": [a.to_dict() for a in self.aggregates]}
        return _with_alias(d, self.alias)


@dataclass(frozen=True)
class Join(Plan):
    left: Plan
    right: Plan
    condition: Test
    alias: str | None = None

    def __post_init__(self) -> None:
        _need(self.left_name != self.right_name, f"both sides of a join are named {self.left_name!r}")

    @property
    def left_name(self) -> str:
        return self.left.alias or "left"

    @property
    def right_name(self) -> str:
        return self.right.alias or "right"

    def to_dict(self) -> dict[str, Any]:
        return _with_alias({"type": "join", "left": self.left.to_dict(), "right": self.right.to_dict(), "condition": self.condition.to_dict()}, self.alias)


def parse_value(d: dict[str, Any]) -> Value:
    kind, alias = d.get("type"), d.get("alias")
    if kind == "constant":
        _need("value" in d, "a constant needs a value")
        return Constant(d["value"], alias)
    if kind == "property":
        return Property(d.get("name"), d.get("default"), alias)
    _need(kind == "function", f"unknown value {kind!r}")
    return Function(d.get("name"), tuple(map(parse_value, d.get("arguments", ()))), alias)


def parse_condition(d: dict[str, Any]) -> Test:
    negate = bool(d.get("negate", False))
    several = {"and": All, "or": Any_}.get(d.get("type") or d.get("op"))
    if several:
        return several(tuple(map(parse_condition, d.get("conditions", ()))), negate)
    return Condition(d.get("op"), parse_value(d["left"]), parse_value(d["right"]), negate)


def parse(d: dict[str, Any]) -> Plan:
    """The plan of its JSON form; d stays as it is. A type that is no transform is a stream's source."""
    kind, alias = d.get("type"), d.get("alias")
    try:
        if kind == "project":
            return Project(parse(d["stream"]), tuple(map(parse_value, d["fields"])), bool(d.get("merge", False)), alias)
        if kind == "filter":
            return Filter(parse(d["stream"]), parse_condition(d["condition"]), alias)
        if kind == "order_by":
            return OrderBy(parse(d["stream"]), tuple(map(parse_value, d["fields"])), bool(d.get("reverse", False)), alias)
        if kind == "limit":
            return Limit(parse(d["stream"]), d["limit"], alias)
        if kind == "aggregate":
            groups = d.get("group_by", [])
            groups = groups.get("values", [groups]) if isinstance(groups, dict) else groups
            found = tuple(Aggregator(a.get("op"), tuple(map(parse_value, a.get("arguments") or ())), a.get("alias")) for a in d["aggregates"])
            return Aggregate(parse(d["stream"]), tuple(map(parse_value, groups)), found, alias)
        if kind == "join":
            return Join(parse(d["left"]), parse(d["right"]), parse_condition(d["condition"]), alias)
        _need(isinstance(kind, str), "a plan needs a type")
        return Stream(d["stream"], d["start_time"], d["end_time"], d.get("host"), d.get("namespace"), alias, kind)
    except KeyError as missing:
        raise PlanError(f"{kind} lacks {missing}") from None
