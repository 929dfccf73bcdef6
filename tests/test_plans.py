"""Plan nodes, name resolution, values, conditions, transforms."""

from __future__ import annotations

from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from streamlens.functions import ticks
from streamlens.plans import nodes
from streamlens.plans.columns import Compiler, resolve
from streamlens.plans.engine import TIME, Engine
from streamlens.plans.nodes import Aggregate, Aggregator, All, Any_, Condition, Constant, Filter, Function, Join, Limit, OrderBy, PlanError, Project, Property, Stream, parse

P, C = Property, Constant
S = Stream("s", 0, 1000)


def rows(df, *names):
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.collect()]


@pytest.mark.parametrize(
    "plan",
    [
        S,
        Stream("s", 1, 2, "host", "ns", "alias"),
        Project(S, (P("a", default=3), C(None, "none"), C([], "empty"), Function("add", (P("a"), C(1)), "sum")), merge=True),
        Filter(S, ~All((Condition("lt", P("a"), C(1)), Any_((Condition("regex", P("b"), C("x"), negate=True),))))),
        OrderBy(S, (P("a"), P("b")), reverse=True),
        Limit(S, 5, alias="l"),
        Aggregate(S, (P("a"), Function("floor", (P("b"), C(10)), "f")), (Aggregator("count", (), "n"), Aggregator("avg", (P("a"),), "m"))),
        Join(Stream("a", 0, 1, alias="x"), S, Condition("eq", P("x.a"), P("right.a"))),
    ],
)
def test_parse_is_the_inverse_of_to_dict(plan):
    d = plan.to_dict()
    copy = parse(d)
    assert copy == plan and copy.to_dict() == d == plan.to_dict()


@pytest.mark.parametrize(
    "bad",
    [
        {"type": "project", "stream": S.to_dict(), "fields": [{"type": "constant", "value": 1}]},
        {"type": "project", "stream": S.to_dict(), "fields": [P("a").to_dict(), P("a").to_dict()]},
        {"type": "limit", "stream": S.to_dict(), "limit": "5"},
        {"type": "aggregate", "stream": S.to_dict(), "group_by": [], "aggregates": [{"op": "sum", "arguments": [], "alias": "x"}]},
        {"type": "filter", "stream": S.to_dict(), "condition": {"op": "like", "left": P("a").to_dict(), "right": P("a").to_dict()}},
        {"type": "stream", "stream": "s", "start_time": 0.5, "end_time": 1},
        {"type": "stream", "stream": "s", "start_time": 0},
        {"type": "join", "left": S.to_dict(), "right": S.to_dict() | {"alias": "left"}, "condition": {"type": "and", "conditions": []}},
        {"stream": "s"},
    ],
)
def test_bad_plans_are_refused(bad):
    with pytest.raises(PlanError):
        parse(bad)


def test_builder_flattens_only_where_it_keeps_the_meaning():
    a, b, c = P("a"), P("b"), P("c")
    assert (a + (b + c)).arguments == (a, b, c)
    assert (a - (b - c)).arguments == (a, Function("subtract", (b, c)))
    assert ((a - b) - c).arguments == (a, b, c)
    assert ((a / b) / c).arguments == (a, b, c)
    x, y, z = (Condition("eq", P(n), C(1)) for n in "xyz")
    assert ((x & y) & z).conditions == (x, y, z)
    assert (x & ~(y & z)).conditions == (x, ~(y & z))
    assert ~~x == x
    assert nodes.properties(a + (b - C(1))) == {"a", "b"}


def test_dotted_names(spark):
    df = spark.range(1).select(F.struct(F.lit(1).alias("c"), F.struct(F.lit(9).alias("e")).alias("d")).alias("a"), F.lit(2).alias("a.c"), F.lit(3).alias("b"))
    get = lambda n: None if (c := resolve(df.schema, n)) is None else df.select(c.alias("x")).first()[0]
    assert [get(n) for n in ("a.c", "a.d.e", "b", "b.x", "a.z", "q")] == [2, 9, 3, None, None, None]
    m = spark.range(1).select(F.create_map(F.lit("k.z"), F.lit(5)).alias("m"))
    assert m.select(resolve(m.schema, "m.k.z").alias("x"), resolve(m.schema, "m.none").alias("y")).first()[:] == (5, None)


def test_null_order_truth_table(spark):
    values = [None, 1, 2]
    df = spark.createDataFrame([(a, b) for a in values for b in values], "l long, r long")
    rank = lambda v: -1 if v is None else v
    python = {"lt": lambda a, b: rank(a) < rank(b), "lte": lambda a, b: rank(a) <= rank(b), "gt": lambda a, b: rank(a) > rank(b), "gte": lambda a, b: rank(a) >= rank(b), "eq": lambda a, b: a == b}
    to = Compiler(df)
    for op, want in python.items():
        for negate in (False, True):
            got = df.select("l", "r", to.test(Condition(op, P("l"), P("r"), negate)).alias("t")).collect()
            assert all(t == (want(a, b) != negate) for a, b, t in got), (op, negate)


def test_conditions_without_a_value_are_dropped_even_if_negated(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "s string, n long")
    to = Compiler(df)
    keep = lambda t: rows(df.filter(to.test(t)), "n")
    bad = Condition("regex", P("s"), C("("))
    assert keep(bad) == keep(~bad) == []
    assert keep(~Any_((bad,))) == [1, 2]
    assert keep(~Condition("contains", P("s"), C("b"))) == [1]
    assert keep(Condition("regex", P("s"), C("^(?P<x>a)(?P=x)?$"))) == [1]
    assert keep(All(())) == [1, 2] and keep(Any_(())) == []
    assert keep(Condition("lt", P("n"), C("text"))) == [1, 2] and keep(Condition("eq", P("n"), C("1"))) == []
    assert keep(Condition("in", P("n"), C([1, "2", None]))) == [1]


def test_membership_with_nulls(spark):
    df = spark.createDataFrame([(1, [1, None], None), (2, [1, None], 1), (3, [1], 2), (4, None, 1), (5, [1], None)], "n long, xs array<long>, x long")
    to = Compiler(df)
    assert rows(df.filter(to.test(Condition("contains", P("xs"), P("x")))), "n") == [1, 2]
    assert rows(df.filter(to.test(~Condition("in", P("x"), P("xs")))), "n") == [3, 5]


def value(spark, made, compat="fixed", /, **columns):
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} {'string' if isinstance(x, str) else 'double' if isinstance(x, float) else 'array<long>' if isinstance(x, list) else 'long'}" for k, x in columns.items())) if columns else spark.range(1)
    return df.select(Compiler(df, compat).value(made).alias("x")).first()[0]


@pytest.mark.parametrize("offset", [0, 3])
def test_floor_and_ceil(spark, offset):
    df = spark.createDataFrame([(v, b) for v in (-13, -7, 0, 5, 7, 23) for b in (-7, 0, 1, 7)], "v long, b long")
    args = (P("v"), P("b"), C(offset))
    made = [Compiler(df, compat).value(Function(name, args)).alias(compat + name) for name, compat in (("floor", "fixed"), ("ceil", "fixed"), ("ceil", "reference"))]
    for v, b, floor, ceil, old in df.select("v", "b", *made).collect():
        if b == 0:
            assert floor is ceil is old is None
        else:
            u = v - offset
            assert (floor, ceil, old) == (u - u % b + offset, u + -u % b + offset, u + u % b + offset)


def test_arithmetic_never_raises(spark):
    f = lambda name, *args, **cols: value(spark, Function(name, args), **cols)
    assert f("add") == 0 and f("subtract") is None and f("subtract", C(5)) == 5
    assert f("add", C(2**62), C(2**62)) is None and f("multiply", C(2**62), C(4)) is None
    assert f("divide", C(7), C(2)) == 3.5 and f("divide", C(1), C(0)) is None
    assert f("add", P("s"), C(1), s="1") is None and f("add", C(True), C(1)) == 2
    assert f("lowercase", C("ÀB")) == "àb" and f("uppercase", C("àb")) == "ÀB" and f("lowercase", C(3)) is None
    assert f("len", C("abc")) == 3 and f("len", P("xs"), xs=[1, 2]) == 2 and f("len", C(1)) is None and f("len", C({"a": 1})) == 1
    assert f("rand_int", C(3), C(1)) is None and f("rand_int", C(4), C(4)) == 4


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_dates(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        at = ticks.to_ticks(datetime(2014, 8, 13, 5, 6, 7, 890000, UTC))
        cut = {"second": "2014-08-13T05:06:07", "minute": "2014-08-13T05:06:00", "hour": "2014-08-13T05:00:00", "day": "2014-08-13", "week": "2014-08-11", "month": "2014-08-01T00:00:00", "year": "2014-01-01T00:00:00"}
        for unit, want in cut.items():
            assert value(spark, Function("date_trunc", (C("2014-08-13 05:06:07.89"), C(unit)))) == want
            assert value(spark, Function("date_trunc", (P("t"), C(unit))), t=at) == ticks.to_ticks(datetime.fromisoformat(want))
        parts = {"second": 7, "minute": 6, "hour": 5, "day": 13, "month": 8, "year": 2014, "week_day": 2}
        for unit, want in parts.items():
            assert value(spark, Function("date_part", (P("t"), C(unit))), t=at) == want
            assert value(spark, Function("date_part", (P("t"), C(unit))), "reference", t=at) is None
        assert value(spark, Function("date_part", (C("2014-08-13T05:00:00+02:00"), C("hour")))) == 3
        assert value(spark, Function("date_trunc", (C("05:00"), C("day")))) is None
        before = ticks.to_ticks(datetime(1969, 12, 31, 23, 0, tzinfo=UTC))
        assert value(spark, Function("date_part", (P("t"), C("year"))), t=before) == 1969
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_ticks_are_exact():
    for us in (0, 1, 999_999, 1_350_432_000_000_001, -1):
        assert ticks.to_ticks(ticks.to_datetime(us * 10)) == us * 10
    assert ticks.to_ticks("2012-10-17") == 13504320000000000


@pytest.fixture(scope="module")
def engine(spark):
    data = [(i, f"{i:03}", i % 3, 100 - i, None if i % 7 == 0 else i, str(i) if i % 2 else "x") for i in range(60)]
    return Engine(spark).register("s", spark.createDataFrame(data, "`@time` long, `@id` string, a long, b long, x long, t string")).register("empty", spark.createDataFrame([], "`@time` long, `@id` string, a long, b long, x long, t string"))


def test_scan_is_inclusive_and_limit_follows_time(engine):
    assert engine.run(Stream("s", 10, 20)).count() == 11
    assert rows(engine.run(Limit(Filter(S, Condition("gte", P("a"), C(1))), 4)), TIME) == [1, 2, 4, 5]
    assert engine.run(Limit(S, 0)).count() == engine.run(Limit(S, -3)).count() == engine.run(Stream("s", 9, 8)).count() == 0
    with pytest.raises(PlanError):
        engine.run(Stream("nothing", 0, 1))


def test_project_merges_against_the_input(engine):
    out = engine.run(Project(S, (Function("add", (P("a"), C(1)), "a"), Function("add", (P("a"), P("b")), "c")), merge=True))
    assert all(r["c"] == (r["@time"] % 3) + r["b"] and r["a"] == r["@time"] % 3 + 1 for r in out.collect())


def test_order_by(engine):
    got = rows(engine.run(OrderBy(Project(S, (P("x"), P("b"))), (P("x"), P("b")))), "x", "b")
    assert got == sorted(got, key=lambda r: (-1 if r[0] is None else r[0], r[1]))
    down = rows(engine.run(OrderBy(Project(S, (P("x"), P("b"))), (P("x"), P("b")), reverse=True)), "x", "b")
    assert down == got[::-1]


def test_aggregates(engine, spark):
    got = engine.run(Aggregate(S, (P("a"),), (Aggregator("count", (), "n"), Aggregator("count", (P("x"),), "nx"), Aggregator("sum", (P("t"),), "s"), Aggregator("min", (P("t"),), "lo"), Aggregator("avg", (P("x"),), "m"))))
    for r in got.collect():
        mine = [i for i in range(60) if i % 3 == r["a"]]
        odd = [i for i in mine if i % 2]
        xs = [i for i in mine if i % 7]
        assert (r["n"], r["nx"], r["s"], r["lo"]) == (len(mine), len(xs), sum(odd), min(odd)) and abs(r["m"] - sum(xs) / len(xs)) < 1e-9
    empty = Stream("empty", 0, 9)
    assert engine.run(Aggregate(empty, (), (Aggregator("count", (), "n"),))).count() == 0
    assert engine.run(Aggregate(S, (), (Aggregator("sum", (C("no"),), "n"), Aggregator("max", (C("no"),), "m")))).first()[:] == (0, None)
    old = Engine(spark, "reference").register("s", spark.createDataFrame([(0, 3.7), (1, 1.2)], "`@time` long, f double"))
    assert old.run(Aggregate(S, (), (Aggregator("sum", (P("f"),), "n"), Aggregator("min", (C("no"),), "m")))).first()[:] == (4, float("inf"))


def test_joins(spark):
    e = Engine(spark)
    e.register("l", spark.createDataFrame([(i, None if i % 5 == 0 else i) for i in range(10)], "`@time` long, k long"))
    e.register("r", spark.createDataFrame([(i, None if i % 5 == 0 else i + 1, i % 4) for i in range(10)], "`@time` long, k long, v long"))
    left, right = Stream("l", 0, 99, alias="x"), Stream("r", 0, 99)
    data = [(a, b) for a in e.run(left).collect() for b in e.run(right).collect()]
    cases = {
        Condition("eq", P("x.k"), P("right.k")): lambda a, b: a["k"] == b["k"],
        Condition("eq", P("x.k"), Function("subtract", (P("right.k"), C(1)))): lambda a, b: a["k"] == (None if b["k"] is None else b["k"] - 1),
        All((Condition("eq", P("right.k"), P("x.k")), Condition("gt", P("x.@time"), P("right.v")))): lambda a, b: a["k"] == b["k"] and a["@time"] > b["v"],
        ~Condition("eq", P("x.k"), P("right.k")): lambda a, b: a["k"] != b["k"],
        Any_((Condition("eq", P("x.k"), P("right.k")), Condition("eq", P("right.v"), C(3)))): lambda a, b: a["k"] == b["k"] or b["v"] == 3,
        All(()): lambda a, b: True,
    }
    for test, want in cases.items():
        got = e.run(Join(left, right, test))
        assert got.columns == ["x.@time", "x.k", "right.@time", "right.k", "right.v"]
        assert sorted((r["x.@time"], r["right.@time"]) for r in got.collect()) == sorted((a["@time"], b["@time"]) for a, b in data if want(a, b))
    plan = e.run(Join(left, right, Condition("eq", P("x.k"), P("right.k"))))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_bounds_and_columns_reach_the_scan(spark, sf_dir):
    from streamlens import queries

    plan = queries.QUERIES["scan_range"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThanOrEqual(ts" in plan and "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,value:double>" in plan
