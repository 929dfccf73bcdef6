"""Values and conditions of a plan as Spark columns. Nothing here raises at run time: what has no value is null."""

from __future__ import annotations

import re
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ticks
from .nodes import All, Condition, Constant, Property, Test, Value

#: Order of kinds when values of different kinds are compared.
_NUMBER, _OBJECT, _LIST, _TEXT = range(4)


def literal(value: Any) -> Column:
    if isinstance(value, bool) or value is None or isinstance(value, str | float):
        return F.lit(value)
    if isinstance(value, int):
        return F.lit(value).cast("long")
    if isinstance(value, list | tuple):
        return F.array(*map(literal, value))
    if isinstance(value, dict):
        return F.create_map(*(x for k, v in value.items() for x in (F.lit(k), literal(v))))
    raise TypeError(f"no column for {value!r}")


def resolve(schema: T.StructType, name: str) -> Column | None:
    """The column a dotted name means: the longest prefix that is a column wins, the rest goes into its struct or map; no backtracking."""
    parts = name.split(".")
    for n in range(len(parts), 0, -1):
        head, rest = ".".join(parts[:n]), ".".join(parts[n:])
        if head not in schema.names:
            continue
        column, kind = F.col("`" + head.replace("`", "``") + "`"), schema[head].dataType
        while rest:
            if isinstance(kind, T.MapType):
                return F.try_element_at(column, F.lit(rest))
            if not isinstance(kind, T.StructType):
                return None
            keys = rest.split(".")
            for k in range(len(keys), 0, -1):
                if (key := ".".join(keys[:k])) in kind.names:
                    column, kind, rest = column.getField(key), kind[key].dataType, ".".join(keys[k:])
                    break
            else:
                return None
        return column
    return None


class Compiler:
    """Compiles for the columns of df. compat: "fixed", or "reference" for the documented quirks (see README)."""

    def __init__(self, df: DataFrame, compat: str = "fixed") -> None:
        if compat not in ("fixed", "reference"):
            raise ValueError(f"no such compatibility: {compat}")
        self.df, self.schema, self.compat = df, df.schema, compat

    def type_of(self, column: Column) -> T.DataType:
        return self.df.select(column.alias("c")).schema["c"].dataType

    def value(self, v: Value) -> Column:
        if isinstance(v, Constant):
            return literal(v.value)
        if isinstance(v, Property):
            found = resolve(self.schema, v.name)
            return literal(v.default) if found is None else found
        return getattr(self, f"_{v.name}")(*v.arguments)

    # Arithmetic -------------------------------------------------------------------------------------------------------

    def number(self, column: Column) -> Column:
        """A number for arithmetic; text is none."""
        kind = self.type_of(column)
        if isinstance(kind, T.BooleanType):
            return column.cast("long")
        if isinstance(kind, T.DecimalType | T.FloatType):
            return column.cast("double")
        if isinstance(kind, T.DoubleType | T.LongType):
            return column
        return column.cast("long") if isinstance(kind, T.IntegralType) else F.lit(None).cast("double")

    def _fold(self, step: Any, args: tuple[Value, ...], cast: str | None = None) -> Column:
        numbers = [self.number(self.value(a)) for a in args]
        numbers = [n.cast(cast) for n in numbers] if cast else numbers
        return reduce(step, numbers) if numbers else F.lit(None).cast(cast or "long")

    def _add(self, *args: Value) -> Column:
        return self._fold(F.try_add, (Constant(0), *args))

    def _subtract(self, *args: Value) -> Column:
        return self._fold(F.try_subtract, args)

    def _multiply(self, *args: Value) -> Column:
        return self._fold(F.try_multiply, args)

    def _divide(self, *args: Value) -> Column:
        return self._fold(F.try_divide, args, "double")

    def whole(self, v: Value) -> Column:
        column = self.value(v)
        return column.try_cast("long") if isinstance(self.type_of(column), T.NumericType | T.StringType | T.BooleanType) else F.lit(None).cast("long")

    def _floor(self, value: Value, base: Value, offset: Value = Constant(0)) -> Column:  # noqa: B008
        b, o = self.whole(base), self.whole(offset)
        v = F.try_subtract(self.whole(value), o)
        return F.try_add(F.try_subtract(v, ticks.modulo(v, b)), o)

    def _ceil(self, value: Value, base: Value, offset: Value = Constant(0)) -> Column:  # noqa: B008
        b, o = self.whole(base), self.whole(offset)
        v = F.try_subtract(self.whole(value), o)
        rest = ticks.modulo(v, b) if self.compat == "reference" else ticks.modulo(F.negative(v), b)
        return F.try_add(F.try_add(v, rest), o)

    def _rand_int(self, low: Value, high: Value) -> Column:
        a, b = self.whole(low), self.whole(high)
        return F.when(a <= b, F.least((F.floor(F.rand() * (b - a + 1)) + a).cast("long"), b))

    # Text, dates, sizes -----------------------------------------------------------------------------------------------

    def _cased(self, change: Any, v: Value) -> Column:
        column = self.value(v)
        return change(column) if isinstance(self.type_of(column), T.StringType) else F.lit(None).cast("string")

    def _lowercase(self, v: Value) -> Column:
        return self._cased(F.lower, v)

    def _uppercase(self, v: Value) -> Column:
        return self._cased(F.upper, v)

    def _date_trunc(self, v: Value, unit: Constant) -> Column:
        column = self.value(v)
        if isinstance(self.type_of(column), T.StringType):
            return ticks.format_text(ticks.truncate(ticks.parse_text(column), unit.value), unit.value in ("day", "week"))
        return ticks.truncate(self.whole(v), unit.value)

    def _date_part(self, v: Value, unit: Constant) -> Column:
        if self.compat == "reference":
            return F.lit(None).cast("long")
        column = self.value(v)
        return ticks.part(ticks.parse_text(column) if isinstance(self.type_of(column), T.StringType) else self.whole(v), unit.value)

    def _len(self, v: Value) -> Column:
        column = self.value(v)
        kind = self.type_of(column)
        if isinstance(kind, T.StringType):
            return F.length(column).cast("long")
        if isinstance(kind, T.ArrayType | T.MapType):
            return F.when(column.isNotNull(), F.size(column)).cast("long")
        return F.when(column.isNotNull(), F.lit(len(kind.names)).cast("long")) if isinstance(kind, T.StructType) else F.lit(None).cast("long")

    # Aggregates -------------------------------------------------------------------------------------------------------

    def coerced(self, v: Value) -> Column:
        """A number for an aggregate: numeric text counts, anything else is null."""
        column = self.value(v)
        if not isinstance(self.type_of(column), T.StringType):
            n = self.number(column)
            return n.try_cast("long") if self.compat == "reference" and isinstance(self.type_of(n), T.DoubleType) else n
        return F.when(column.rlike(r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf(inity)?|nan)\s*$"), F.trim(column).try_cast("double"))

    def aggregate(self, op: str, args: tuple[Value, ...]) -> Column:
        if op == "count":
            return F.count(self.value(args[0]) if args else F.lit(1))
        x = self.coerced(args[0])
        if op == "sum":
            return F.coalesce(F.try_sum(x), F.lit(0).cast(self.type_of(x)))
        if op == "avg":
            return F.avg(x.cast("double"))
        found = F.min(x) if op == "min" else F.max(x)
        return F.coalesce(found.cast("double"), F.lit(float("inf" if op == "min" else "-inf"))) if self.compat == "reference" else found

    # Conditions -------------------------------------------------------------------------------------------------------

    def test(self, t: Test) -> Column:
        """A boolean column; null where the condition cannot be evaluated, which negation leaves null."""
        if isinstance(t, Condition):
            found = getattr(self, f"_test_{t.op}")(t)
        else:
            parts = [F.coalesce(self.test(c), F.lit(False)) for c in t.conditions]
            found = reduce(lambda a, b: a & b if isinstance(t, All) else a | b, parts, F.lit(isinstance(t, All))) if len(parts) != 1 else parts[0]
        return ~found if t.negate else found

    def test_join(self, t: Test) -> Column:
        """As test, with the terms of a plain conjunction left bare, so that equalities among them can become keys of a join."""
        if isinstance(t, All) and not t.negate:
            return reduce(lambda a, b: a & b, map(self.test_join, t.conditions), F.lit(True))
        return self.test(t)

    def _kind(self, column: Column) -> int | None:
        kind = self.type_of(column)
        if isinstance(kind, T.NullType):
            return None
        if isinstance(kind, T.StringType):
            return _TEXT
        return _LIST if isinstance(kind, T.ArrayType) else _OBJECT if isinstance(kind, T.StructType | T.MapType) else _NUMBER

    def _sides(self, t: Condition) -> tuple[Column, Column, int | None, int | None]:
        left, right = self.value(t.left), self.value(t.right)
        a, b = self._kind(left), self._kind(right)
        if a == b == _NUMBER:
            left, right = (c.cast("long") if isinstance(self.type_of(c), T.BooleanType) else c for c in (left, right))
        return left, right, a, b

    def _less(self, left: Column, right: Column, a: int | None, b: int | None) -> Column:
        """Null is less than anything else; kinds have an order."""
        if a is None:
            return right.isNotNull()
        if b is None:
            return F.lit(False)
        if a != b:
            return F.when(left.isNull(), right.isNotNull()).otherwise(right.isNotNull() & F.lit(a < b))
        return (left.isNull() & right.isNotNull()) | F.coalesce(left < right, F.lit(False))

    def _test_lt(self, t: Condition) -> Column:
        return self._less(*self._sides(t))

    def _test_gt(self, t: Condition) -> Column:
        left, right, a, b = self._sides(t)
        return self._less(right, left, b, a)

    def _at_most(self, left: Column, right: Column, a: int | None, b: int | None) -> Column:
        if a is not None and a == b:
            return left.isNull() | F.coalesce(left <= right, F.lit(False))
        return self._less(left, right, a, b) | (left.isNull() & right.isNull())

    def _test_lte(self, t: Condition) -> Column:
        return self._at_most(*self._sides(t))

    def _test_gte(self, t: Condition) -> Column:
        left, right, a, b = self._sides(t)
        return self._at_most(right, left, b, a)

    def _test_eq(self, t: Condition) -> Column:
        left, right, a, b = self._sides(t)
        if a is not None and b is not None and a != b:
            return left.isNull() & right.isNull()
        return left.eqNullSafe(right)

    def _holds(self, whole: Column, item: Column) -> Column:
        """Whether whole contains item; null if whole has no members or is null."""
        kind = self.type_of(whole)
        if isinstance(kind, T.StringType):
            return F.contains(whole, item) if isinstance(self.type_of(item), T.StringType) else F.lit(None).cast("boolean")
        if isinstance(kind, T.ArrayType):
            member = Compiler(self.df.select(whole.alias("w"), item.alias("i")).select(F.explode("w").alias("w"), "i"), self.compat)
            if (a := member._kind(F.col("w"))) is not None and (b := self._kind(item)) is not None and a != b:
                return F.when(whole.isNotNull(), item.isNull() & F.exists(whole, lambda x: x.isNull()))
            return F.when(whole.isNotNull(), F.exists(whole, lambda x: x.eqNullSafe(item)))
        if isinstance(kind, T.MapType):
            return F.when(whole.isNotNull(), F.coalesce(F.map_contains_key(whole, item), F.lit(False)))
        if isinstance(kind, T.StructType):
            return F.when(whole.isNotNull(), F.coalesce(item.isin(kind.names), F.lit(False)))
        return F.lit(None).cast("boolean")

    def _test_contains(self, t: Condition) -> Column:
        return self._holds(self.value(t.left), self.value(t.right))

    def _test_in(self, t: Condition) -> Column:
        if isinstance(t.right, Constant) and isinstance(t.right.value, list | tuple):
            left = self.value(t.left)
            kind, items = self._kind(left), [x for x in t.right.value if x is not None]
            fit = [x for x in items if kind is not None and kind == (_TEXT if isinstance(x, str) else _LIST if isinstance(x, list) else _OBJECT if isinstance(x, dict) else _NUMBER)]
            found = F.coalesce(left.isin(*map(literal, fit)), F.lit(False)) if fit else F.lit(False)
            return found | left.isNull() if len(items) < len(t.right.value) else found
        return self._holds(self.value(t.right), self.value(t.left))

    def _test_regex(self, t: Condition) -> Column:
        left, right = self.value(t.left), self.value(t.right)
        if not isinstance(self.type_of(left), T.StringType) or not isinstance(self.type_of(right), T.StringType):
            return F.lit(None).cast("boolean")
        if not isinstance(t.right, Constant):
            return F.regexp_like(left, right)
        pattern = re.sub(r"\(\?P<", "(?<", t.right.value)
        pattern = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern)
        try:
            self.df.sparkSession._jvm.java.util.regex.Pattern.compile(pattern)
        except Exception:  # noqa: BLE001  the JVM says the pattern is none
            return F.lit(None).cast("boolean")
        return left.rlike(pattern)


