"""The engine's queries over the test tables, with the SQL that each must equal in DuckDB. All run over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.ticks import PER_DAY, PER_UNIT, ticks_of, to_ticks
from .operators import buckets, cohort, funnel, tools
from .plans import nodes
from .plans.engine import ID, TIME, Engine, quoted
from .plans.nodes import Aggregate, Aggregator, All, Any_, Condition, Constant, Filter, Function, Join, Limit, OrderBy, Plan, Project, Property, Stream
from .sources.catalog import Catalog
from .sources.tables import csv_events, events_source, synthetic_events

DAY, HOUR, WEEK = PER_DAY, PER_UNIT["hour"], PER_UNIT["week"]
JAN1 = to_ticks(datetime(2024, 1, 1))
LOW, HIGH = 0, 2**62

P, C = Property, Constant


def fn(name: str, *args: nodes.Value, alias: str | None = None) -> Function:
    return Function(name, args, alias)


def stream(start: int = LOW, end: int = HIGH, alias: str | None = None) -> Stream:
    return Stream("events", start, end, alias=alias)


def engine(spark: SparkSession, sf_dir: str, compat: str = "fixed") -> Engine:
    """An engine that knows the test tables: events as a stream, and the others as streams whose @time is their date or key."""
    e = Engine(spark, compat).register("events", events_source(spark, f"{sf_dir}/events.parquet"))
    table = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    e.register("orders", lambda p: table("orders").withColumn(TIME, ticks_of(F.col("o_orderdate"))))
    e.register("customer", lambda p: table("customer").withColumn(TIME, F.col("c_custkey")))
    e.register("nation", lambda p: table("nation").withColumn(TIME, F.col("n_nationkey").cast("long")))
    e.register("region", lambda p: table("region").withColumn(TIME, F.col("r_regionkey").cast("long")))
    e.register("lineitem", lambda p: table("lineitem").withColumn(TIME, ticks_of(F.col("l_shipdate"))))
    # Derived columns that the raw events lack: nulls, lists, numeric text, nested objects.
    odd = lambda p: events_source(spark, f"{sf_dir}/events.parquet")(p).select(
        quoted(TIME), quoted(ID), "event_id", "user_id", "event_type", "value", "k",
        F.when(F.col("user_id") % 7 != 0, F.col("value")).alias("x"),
        F.array(F.col("k") % 3, F.col("k") % 5, F.when(F.col("user_id") % 4 != 0, F.col("user_id") % 11)).alias("items"),
        F.when(F.col("user_id") % 5 != 0, F.col("k").cast("string")).otherwise(F.lit("none")).alias("text_number"),
        F.when(F.col("user_id") % 6 != 0, F.col("user_id") % 10).alias("maybe_user"),
        F.struct(F.col("k").alias("c"), F.struct(F.col("value").alias("d")).alias("b")).alias("a"), (F.col("k") * 2).alias("a.c"),
    )
    return e.register("odd", odd)


def odd(alias: str | None = None) -> Stream:
    return Stream("odd", LOW, HIGH, alias=alias)


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_EVENTS = "(select *, epoch_us(ts) * 10 as t, (props->>'$.k')::bigint as k from events)"
_ODD = (
    "(select *, case when user_id % 7 <> 0 then value end as x, [k % 3, k % 5, case when user_id % 4 <> 0 then user_id % 11 end] as items,"
    " case when user_id % 5 <> 0 then k::varchar else 'none' end as text_number, case when user_id % 6 <> 0 then user_id % 10 end as maybe_user"
    f" from {_EVENTS})"
)


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql.replace("$E", _EVENTS).replace("$O", _ODD)


def plan(name: str, tree: Plan, sql: str | None = None, rounded: tuple[str, ...] = (), compat: str = "fixed") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = engine(spark, sf_dir, compat).run(tree)
        return df.withColumns({c: F.round(c, 2) for c in rounded})

    add(name, run, sql)


def ids(tree: Plan) -> Project:
    return Project(tree, (P("event_id"),))


# Scans --------------------------------------------------------------------------------------------------------------------------
_A, _B = JAN1 + 3 * DAY, JAN1 + 9 * DAY
plan("scan_range", Project(stream(_A, _B), (P(TIME, alias="t"), P("event_id"), P("value"))), f"select t, event_id, value from $E where t between {_A} and {_B}")
plan("scan_empty_range", ids(stream(_B, _A)), "select event_id from events where false")
plan("scan_desc_limit", Limit(OrderBy(Project(stream(), (P(TIME, alias="t"), P("event_id"))), (P("t"), P("event_id")), reverse=True), 100), "select t, event_id from $E order by t desc, event_id desc limit 100")
plan("limit_scan_order", Limit(Project(stream(), (P(TIME), P(ID), P("event_id"))), 25), """select t as "@time", event_id::varchar as "@id", event_id from $E order by t, event_id::varchar limit 25""")

def _catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """The events, put into a new catalog."""
    catalog = Catalog(spark, f"{_shared(spark)}/catalog-{uuid.uuid4().hex}")
    catalog.put("events", engine(spark, sf_dir).run(Project(stream(), (P(TIME), P("event_id"), P("value")))))
    return catalog


def _catalog_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalog(spark, sf_dir).retrieve("events", _A, _B, order="descending", limit=500).select(quoted(TIME).alias("t"), "event_id", "value")


def _catalog_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = _catalog(spark, sf_dir)
    catalog.delete("events", _A, _B)
    return Engine(spark).resolver(catalog.scan).run(Project(stream(), (P("event_id"),)))


def _csv_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_shared(spark)}/csv-{uuid.uuid4().hex}"
    spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_orderdate").cast("string").alias("at")).write.csv(path, header=True)
    return csv_events(spark, path, "at").select(F.col("o_orderkey").cast("long").alias("o"), quoted(TIME).alias("t"))


add("catalog_retrieve", _catalog_retrieve, f"select t, event_id, value from $E where t between {_A} and {_B} order by t desc limit 500")
add("catalog_delete", _catalog_delete, f"select event_id from $E where t not between {_A} and {_B}")


def _token(catalog: Catalog, name: str, nth: int) -> tuple[int, str]:
    """Time and id of the nth event from _A on: where a reader that has seen it goes on."""
    last = catalog.retrieve(name, _A, _B, limit=nth).orderBy(quoted(TIME).desc(), quoted("@id").desc()).first()
    return last[TIME], last["@id"]


def _resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = _catalog(spark, sf_dir)
    time, last = _token(catalog, "events", 100)
    return catalog.retrieve("events", time, _B, start_id=last).select(quoted(TIME).alias("t"))


def _delete_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = _catalog(spark, sf_dir)
    time, last = _token(catalog, "events", 100)
    catalog.delete("events", time, _B, start_id=last)
    return catalog.retrieve("events", _A, _B).select(quoted(TIME).alias("t"))


def _kinds_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """A stream for each kind of event; those of clicks hold one more property from the second put on."""
    catalog, events = Catalog(spark, f"{_shared(spark)}/catalog-{uuid.uuid4().hex}"), engine(spark, sf_dir).run(stream())
    for kind in ("click", "error", "purchase", "signup", "view"):
        some = events.filter(F.col("event_type") == kind)
        catalog.put(kind, some.select(quoted(TIME), "event_id", "value"))
        if kind == "click":
            catalog.put(kind, some.select(quoted(TIME), "event_id", "k"))
    return catalog


add("scan_resume", _resume, f"select t from $E where t between {_A} and {_B} order by t, event_id::varchar offset 100")
add("catalog_delete_after", _delete_after, f"select t from $E where t between {_A} and {_B} order by t, event_id::varchar limit 100")
add("list_streams", lambda spark, sf_dir: spark.createDataFrame([(n,) for n in _kinds_catalog(spark, sf_dir).streams()], "stream string"), "select distinct event_type as stream from events")
add("latest_properties", lambda spark, sf_dir: spark.createDataFrame([(n,) for n in _kinds_catalog(spark, sf_dir).properties("click")], "property string"), "select unnest(['event_id', 'value', 'k']) as property")
add("csv_load", _csv_load, "select o_orderkey as o, epoch_us(o_orderdate) * 10 as t from orders")
add("synthetic", lambda spark, sf_dir: synthetic_events(spark, 1000, JAN1, 250, 2).withColumnRenamed(TIME, "t"), f"select {JAN1} + i * 2500 as t, 0::bigint as property0, 1::bigint as property1 from range(1000) r(i)")

# Projection and properties ------------------------------------------------------------------------------------------------------
plan("project_basic", Project(stream(), (P("event_id"), C(10, "ten"), fn("add", P("user_id"), P("k"), C(5), alias="total"))), "select event_id, 10::bigint as ten, user_id + k + 5 as total from $E")
plan("project_merge", Project(Project(stream(), (P("event_id"), P("value"), P("user_id"))), (fn("multiply", P("user_id"), C(2), alias="user_id"), fn("add", P("user_id"), C(1), alias="next")), merge=True), "select event_id, value, user_id * 2 as user_id, user_id + 1 as next from events")
plan("prop_nested", Project(odd(), (P("event_id"), P("a.c", alias="flat"), P("a.b.d", alias="deep"))), "select event_id, k * 2 as flat, value as deep from $E")
plan("prop_default", Project(stream(), (P("event_id"), P("nowhere.at.all", default=7, alias="gone"), P("k", default=9, alias="here"))), "select event_id, 7::bigint as gone, k as here from $E")

# Conditions ---------------------------------------------------------------------------------------------------------------------
plan("filter_cmp", ids(Filter(stream(), All((Condition("gt", P("value"), C(10)), Condition("lte", P("value"), C(50.5)), Condition("gte", P("user_id"), C(3)))))), "select event_id from events where value > 10 and value <= 50.5 and user_id >= 3")
plan("filter_null_order", ids(Filter(odd(), Condition("lt", P("x"), C(20)))), "select event_id from $O where x is null or x < 20")
plan("filter_null_gte", ids(Filter(odd(), Condition("gte", P("x"), C(20)))), "select event_id from $O where x >= 20")
plan("filter_null_negated", ids(Filter(odd(), ~Condition("lt", P("x"), C(20)))), "select event_id from $O where not (x is null or x < 20)")
plan("filter_eq_null", ids(Filter(odd(), Condition("eq", P("x"), C(None)))), "select event_id from $O where x is null")
plan("filter_cross_kind", ids(Filter(odd(), Condition("lt", P("x"), C("text")))), "select event_id from $O")
plan("filter_contains_str", ids(Filter(stream(), Condition("contains", P("event_type"), C("ick")))), "select event_id from events where contains(event_type, 'ick')")
plan("filter_contains_arr", ids(Filter(odd(), Condition("contains", P("items"), P("maybe_user")))), "select event_id from $O where case when maybe_user is null then list_count(items) < 3 else coalesce(list_contains(items, maybe_user), false) end")
plan("filter_in", ids(Filter(odd(), Condition("in", P("maybe_user"), C([1, 4, None])))), "select event_id from $O where maybe_user in (1, 4) or maybe_user is null")
plan("filter_in_column", ids(Filter(odd(), ~Condition("in", P("maybe_user"), P("items")))), "select event_id from $O where not case when maybe_user is null then list_count(items) < 3 else coalesce(list_contains(items, maybe_user), false) end")
plan("filter_regex", ids(Filter(stream(), Condition("regex", P("event_type"), C("^(?P<x>p|s).*[eu]")))), "select event_id from events where regexp_matches(event_type, '^(p|s).*[eu]')")
plan("filter_bad_regex", ids(Filter(stream(), ~Condition("regex", P("event_type"), C("(")))), "select event_id from events where false")
plan(
    "filter_and_or_not",
    ids(Filter(odd(), Any_((All((Condition("gt", P("value"), C(30)), ~Condition("eq", P("event_type"), C("view")))), ~Any_((Condition("lt", P("x"), C(90)), Condition("regex", P("user_id"), C("x")))))))),
    "select event_id from $O where (value > 30 and event_type <> 'view') or not (x is null or x < 90)",
)

# Functions ----------------------------------------------------------------------------------------------------------------------
plan("fn_arith", Project(stream(), (P("event_id"), fn("subtract", P("k"), C(3), P("user_id"), alias="less"), fn("multiply", P("k"), P("k"), C(2), alias="twice"), fn("add", alias="zero"), fn("add", P("k"), P("event_type"), alias="none"))), "select event_id, k - 3 - user_id as less, k * k * 2 as twice, 0::bigint as zero, null::double as none from $E")
plan("fn_divide_zero", Project(stream(), (P("event_id"), fn("divide", P("user_id"), fn("subtract", P("k"), C(5)), alias="part"))), "select event_id, user_id::double / nullif((k - 5)::double, 0) as part from $E")
for _name, _sign, _offset in (("fn_floor", 1, 0), ("fn_floor_offset", 1, 3), ("fn_floor_negative", -1, 0)):
    plan(_name, Project(stream(), (P("event_id"), fn("floor", fn("subtract", P("k"), C(20)), C(7 * _sign), C(_offset), alias="low"))), f"select event_id, v - ((((v % {7 * _sign}) + {7 * _sign}) % {7 * _sign})) + {_offset} as low from (select event_id, k - 20 - {_offset} as v from $E)")
plan("fn_floor_zero", Project(stream(), (P("event_id"), fn("floor", P("k"), C(0), alias="low"))), "select event_id, null::bigint as low from events")
plan("fn_ceil", Project(stream(), (P("event_id"), fn("ceil", fn("subtract", P("k"), C(20)), C(7), alias="high"))), "select event_id, v + ((((-v) % 7) + 7) % 7) as high from (select event_id, k - 20 as v from $E)")
plan("fn_ceil_reference", Project(stream(), (P("event_id"), fn("ceil", P("k"), C(7), alias="high"))), "select event_id, k + k % 7 as high from $E", compat="reference")
plan("fn_case", Project(stream(), (P("event_id"), fn("uppercase", P("event_type"), alias="up"), fn("lowercase", fn("uppercase", P("event_type")), alias="low"), fn("lowercase", P("k"), alias="none"))), "select event_id, upper(event_type) as up, lower(event_type) as low, null::varchar as none from $E")
plan("fn_len", Project(odd(), (P("event_id"), fn("len", P("event_type"), alias="letters"), fn("len", P("items"), alias="members"), fn("len", P("k"), alias="none"))), "select event_id, length(event_type) as letters, len(items) as members, null::bigint as none from $O")
for _unit in nodes.TRUNC_UNITS:
    plan(f"fn_date_trunc_{_unit}", Project(stream(), (P("event_id"), fn("date_trunc", P(TIME), C(_unit), alias="at"))), f"select event_id, epoch_us(date_trunc('{_unit}', ts)) * 10 as at from events")
for _unit in nodes.PART_UNITS:
    _sql = "isodow(ts) - 1" if _unit == "week_day" else f"extract({_unit} from ts)"
    plan(f"fn_date_part_{_unit}", Project(stream(), (P("event_id"), fn("date_part", P(TIME), C(_unit), alias="part"))), f"select event_id, ({_sql})::bigint as part from events")
plan("fn_rand_int", Aggregate(Project(stream(), (fn("rand_int", C(1), C(3), alias="r"),)), (P("r"),), ()), "select unnest([1, 2, 3])::bigint as r")

# Aggregates ---------------------------------------------------------------------------------------------------------------------
_v = (P("value"),)
plan(
    "agg_all",
    Aggregate(stream(), (P("event_type"),), (Aggregator("count", (), "n"), Aggregator("sum", _v, "total"), Aggregator("min", _v, "low"), Aggregator("max", _v, "high"), Aggregator("avg", _v, "mean"))),
    "select event_type, count(*) as n, round(sum(value), 2) as total, min(value) as low, max(value) as high, round(avg(value), 2) as mean from events group by 1",
    rounded=("total", "mean"),
)
plan("agg_expr_group", Aggregate(stream(), (fn("floor", P(TIME), C(DAY), alias="day"), P("event_type")), (Aggregator("count", (), "n"),)), f"select t - t % {DAY} as day, event_type, count(*) as n from $E group by 1, 2")
plan("agg_null_group", Aggregate(odd(), (P("maybe_user"),), (Aggregator("count", (), "n"), Aggregator("sum", (P("k"),), "total"))), "select maybe_user, count(*) as n, sum(k)::bigint as total from $O group by 1")
plan("agg_count_arg", Aggregate(odd(), (P("event_type"),), (Aggregator("count", (P("x"),), "n"),)), "select event_type, count(x) as n from $O group by 1")
plan("agg_global", Aggregate(stream(), (), (Aggregator("count", (), "n"), Aggregator("max", (P("k"),), "high"))), "select count(*) as n, max(k) as high from $E")
plan("agg_global_empty", Aggregate(Filter(stream(), Condition("lt", P("k"), C(-1))), (), (Aggregator("count", (), "n"),)), "select count(*) as n from $E where k < -1 having count(*) > 0")
plan("agg_coerce_str", Aggregate(odd(), (P("event_type"),), (Aggregator("sum", (P("text_number"),), "total"), Aggregator("min", (P("text_number"),), "low"), Aggregator("avg", (P("text_number"),), "mean"))), "select event_type, coalesce(sum(try_cast(text_number as double)), 0) as total, min(try_cast(text_number as double)) as low, round(avg(try_cast(text_number as double)), 2) as mean from $O group by 1", rounded=("mean",))
plan("agg_no_number", Aggregate(stream(), (P("k"),), (Aggregator("sum", (P("event_type"),), "total"), Aggregator("max", (P("event_type"),), "high"))), "select k, 0::double as total, null::double as high from $E group by 1")
plan("agg_no_number_reference", Aggregate(stream(), (P("k"),), (Aggregator("min", (P("event_type"),), "low"), Aggregator("max", (P("event_type"),), "high"))), "select k, 'inf'::double as low, '-inf'::double as high from $E group by 1", compat="reference")
plan("agg_having", Filter(Aggregate(stream(), (P("user_id"),), (Aggregator("count", (), "n"),)), Condition("gt", P("n"), C(60))), "select user_id, count(*) as n from events group by 1 having count(*) > 60")
plan("agg_distinct_two_phase", Aggregate(Aggregate(stream(), (P("event_type"), P("user_id")), ()), (P("event_type"),), (Aggregator("count", (), "users"),)), "select event_type, count(distinct user_id) as users from events group by 1")

# Order, limit -------------------------------------------------------------------------------------------------------------------
plan("order_multi", Limit(OrderBy(Project(odd(), (P("x"), P("event_id"))), (P("x"), P("event_id"))), 200), "select x, event_id from $O order by x nulls first, event_id limit 200")
plan("order_reverse", Limit(OrderBy(Project(odd(), (P("event_type"), P("k"), P("event_id"))), (P("event_type"), P("k"), P("event_id")), reverse=True), 150), "select event_type, k, event_id from $O order by event_type desc, k desc, event_id desc limit 150")
_TOP_DAY = Limit(OrderBy(Aggregate(stream(), (fn("floor", P(TIME), C(DAY), alias="t"),), (Aggregator("sum", _v, "total"), Aggregator("count", (), "n"))), (P("total"),), reverse=True), 1)
plan("topk", _TOP_DAY, f"select t - t % {DAY} as t, round(sum(value), 2) as total, count(*) as n from $E group by 1 order by sum(value) desc limit 1", rounded=("total",))

# Joins --------------------------------------------------------------------------------------------------------------------------
_ORDERS, _CUSTOMER, _NATION, _REGION = (Stream(s, -HIGH, HIGH, alias=s[0]) for s in ("orders", "customer", "nation", "region"))
plan("join_eq", Project(Join(_ORDERS, _CUSTOMER, Condition("eq", P("o.o_custkey"), P("c.c_custkey"))), (P("o.o_orderkey", alias="o"), P("c.c_name", alias="name"))), "select o_orderkey as o, c_name as name from orders join customer on o_custkey = c_custkey")
plan("join_eq_expr", Project(Join(_CUSTOMER, Stream("customer", LOW, HIGH, alias="next"), Condition("eq", P("c.c_custkey"), fn("subtract", P("next.c_custkey"), C(1)))), (P("c.c_custkey", alias="a"), P("next.c_custkey", alias="b"))), "select a.c_custkey as a, b.c_custkey as b from customer a join customer b on a.c_custkey = b.c_custkey - 1")
plan("join_eq_residual", Aggregate(Join(_CUSTOMER, _ORDERS, All((Condition("eq", P("c.c_custkey"), P("o.o_custkey")), Condition("lt", P("c.c_acctbal"), P("o.o_totalprice"))))), (P("c.c_mktsegment", alias="segment"),), (Aggregator("count", (), "n"),)), "select c_mktsegment as segment, count(*) as n from customer join orders on c_custkey = o_custkey and c_acctbal < o_totalprice group by 1")
plan("join_theta", Project(Join(_NATION, _REGION, Any_((Condition("lt", P("n.n_nationkey"), P("r.r_regionkey")), Condition("eq", P("n.n_regionkey"), P("r.r_regionkey"))))), (P("n.n_name", alias="nation"), P("r.r_name", alias="region"))), "select n_name as nation, r_name as region from nation, region where n_nationkey < r_regionkey or n_regionkey = r_regionkey")
plan("join_cross", Project(Join(_NATION, _REGION, All(())), (P("n.n_name", alias="nation"), P("r.r_name", alias="region"))), "select n_name as nation, r_name as region from nation, region")
_PER_USER = Aggregate(odd(), (P("maybe_user"),), (Aggregator("count", (), "n"),), "u")
_PER_TYPE = Aggregate(Filter(odd(), Condition("eq", P("event_type"), C("view"))), (P("maybe_user"),), (Aggregator("max", (P("k"),), "high"),), "v")
plan("join_null_keys", Project(Join(_PER_USER, _PER_TYPE, Condition("eq", P("u.maybe_user"), P("v.maybe_user"))), (P("u.maybe_user", alias="who"), P("u.n", alias="n"), P("v.high", alias="high"))), "select u.maybe_user as who, n, high from (select maybe_user, count(*) as n from $O group by 1) u join (select maybe_user, max(k) as high from $O where event_type = 'view' group by 1) v on u.maybe_user is not distinct from v.maybe_user")
_CN = Join(_CUSTOMER, _NATION, Condition("eq", P("c.c_nationkey"), P("n.n_nationkey")), "cn")
plan("join_star", Aggregate(Join(_ORDERS, _CN, Condition("eq", P("o.o_custkey"), P("cn.c.c_custkey"))), (P("cn.n.n_name", alias="nation"),), (Aggregator("count", (), "n"), Aggregator("max", (P("o.o_totalprice"),), "high"))), "select n_name as nation, count(*) as n, max(o_totalprice) as high from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1")
plan("join_nested", Project(Join(_CN, _REGION, Condition("eq", P("cn.n.n_regionkey"), P("r.r_regionkey"))), (P("cn.c.c_custkey", alias="c"), P("r.r_name", alias="region"))), "select c_custkey as c, r_name as region from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
plan("join_big", Aggregate(Join(Stream("lineitem", -HIGH, HIGH, alias="l"), _ORDERS, Condition("eq", P("l.l_orderkey"), P("o.o_orderkey"))), (P("o.o_orderpriority", alias="priority"), P("l.l_returnflag", alias="flag")), (Aggregator("count", (), "n"), Aggregator("sum", (P("l.l_quantity"),), "quantity"))), "select o_orderpriority as priority, l_returnflag as flag, count(*) as n, sum(l_quantity) as quantity from lineitem join orders on l_orderkey = o_orderkey group by 1, 2")

# Cohorts and funnels ------------------------------------------------------------------------------------------------------------


def _typed(kind: str) -> Callable[[Plan], Plan]:
    return lambda s: Filter(s, Condition("eq", P("event_type"), C(kind)))


_SIGNUP = cohort.Side("events", "user_id", "weeks", 4, _typed("signup"))
_PURCHASE = cohort.Side("events", "user_id", "days", 14, _typed("purchase"))
plan(
    "cohort_weekly",
    Project(cohort.cohort_plan(JAN1, _SIGNUP, _PURCHASE), (P(TIME, alias="cohort_time"), P("action_step"), P("cohort_actions"))),
    f"""with co as (select user_id, (t - {JAN1}) - (t - {JAN1}) % {WEEK} + {JAN1} as d, min(t) as t from $E where event_type = 'signup' and t between {JAN1} and {JAN1 + 4 * WEEK + 1} group by 1, 2),
    ac as (select user_id, (t - {JAN1}) - (t - {JAN1}) % {DAY} + {JAN1} as d, min(t) as t from $E where event_type = 'purchase' and t between {JAN1} and {JAN1 + 4 * WEEK + 14 * DAY + 1} group by 1, 2)
    select co.d as cohort_time, (ac.t - co.t) - (ac.t - co.t) % {DAY} as action_step, count(distinct co.user_id) as cohort_actions from co join ac on co.user_id = ac.user_id and ac.t >= co.t and ac.t < co.t + {14 * DAY} group by 1, 2""",
)
add(
    "cohort_sizes",
    lambda spark, sf_dir: cohort.cohort_sizes(engine(spark, sf_dir), JAN1, _SIGNUP).select(quoted(TIME).alias("cohort_time"), "cohort_size"),
    f"select (t - {JAN1}) - (t - {JAN1}) % {WEEK} + {JAN1} as cohort_time, count(distinct user_id) as cohort_size from $E where event_type = 'signup' and t between {JAN1} and {JAN1 + 4 * WEEK + 1} group by 1",
)


def _step(spark: SparkSession, sf_dir: str, kind: str, **more) -> funnel.Step:
    return funnel.Step(engine(spark, sf_dir).run(stream()), "user_id", F.col("event_type") == kind, **more)


def _funnel(kinds: tuple[str, ...], first_end: int, end: int, invert: int | None = None, fuzzy: int = funnel.FUZZY) -> Query:
    return lambda spark, sf_dir: funnel.funnel([_step(spark, sf_dir, k, invert=i == invert) for i, k in enumerate(kinds)], JAN1, end, first_end, fuzzy=fuzzy).sizes()


def _funnel_sql(kinds: tuple[str, ...], first_end: int, end: int, invert: int | None = None, fuzzy: int = funnel.FUZZY) -> str:
    parts = [f"s1 as (select user_id, min(t) as t from $E where event_type = '{kinds[0]}' and t between {JAN1} and {first_end} group by 1)"]
    for i, k in enumerate(kinds[1:], 2):
        hit = f"select e.user_id, min(e.t) as t from $E e join s{i - 1} s on e.user_id = s.user_id and s.t - {fuzzy} < e.t where event_type = '{k}' and e.t between {JAN1} and {end} group by 1"
        parts.append(f"s{i} as ({hit})" if i - 1 != invert else f"h{i} as ({hit}), s{i} as (select * from s{i - 1} where user_id not in (select user_id from h{i}))")
    return f"with {', '.join(parts)} " + " union all ".join(f"select {i}::bigint as step, count(*) as n from s{i}" for i in range(1, len(kinds) + 1))


_KINDS = ("view", "click", "purchase")
for _name, _args in (
    ("funnel_3", (_KINDS, JAN1 + 2 * DAY, JAN1 + 5 * DAY)),
    ("funnel_fuzzy", (_KINDS, JAN1 + 2 * DAY, JAN1 + 3 * DAY, None, 0)),
    ("funnel_invert", (_KINDS, JAN1 + 2 * DAY, JAN1 + 5 * DAY, 1)),
):
    add(_name, _funnel(*_args), _funnel_sql(*_args))


def _funnel_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [_step(spark, sf_dir, "view"), _step(spark, sf_dir, "purchase", output=("value", "k"))]
    return funnel.funnel(steps, JAN1, JAN1 + 5 * DAY, JAN1 + 2 * DAY).data(1).select("user", quoted(TIME).alias("t"), "data.value", "data.k")


add(
    "funnel_fields",
    _funnel_fields,
    f"""with s1 as (select user_id, min(t) as t from $E where event_type = 'view' and t between {JAN1} and {JAN1 + 2 * DAY} group by 1)
    select e.user_id as "user", min(e.t) as t, arg_max(value, (e.t, event_id::varchar)) as value, arg_max(k, (e.t, event_id::varchar)) as k from $E e join s1 on e.user_id = s1.user_id and s1.t - {funnel.FUZZY} < e.t
    where event_type = 'purchase' and e.t between {JAN1} and {JAN1 + 5 * DAY} group by 1""",
)


def _funnel_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = engine(spark, sf_dir).run(stream()).withColumn("name", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    steps = [funnel.Step(events, "user_id", F.col("event_type") == "view"), funnel.Step(events, "name", F.col("event_type") == "error")]
    return funnel.funnel(steps, JAN1, JAN1 + 5 * DAY, JAN1 + DAY, {"name": lambda u: F.concat(F.lit("u"), u.cast("string"))}, lambda u: u % 2 == 1).sizes()


add("funnel_mapped", _funnel_mapped, _funnel_sql(("view", "error"), JAN1 + DAY, JAN1 + 5 * DAY).replace("event_type = 'view'", "event_type = 'view' and user_id % 2 = 1"))

# Buckets, tools, shapes ---------------------------------------------------------------------------------------------------------
add("bucket_count", lambda spark, sf_dir: buckets.bucket_counts(engine(spark, sf_dir).run(stream()), HOUR), f"select t - t % {HOUR} as bucket, count(*) as n from $E group by 1")


def _shared(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is set and all run in one process, as in tests."""
    import tempfile

    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or (known.get() if known.isDefined() else None)
    if not at and (not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster")):
        raise RuntimeError("spark.checkpoint.dir is to name a folder that the driver and the executors share")
    return at.rstrip("/") if at else tempfile.mkdtemp(prefix="streamlens-")


def _cached(trusted_only: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        shared = _shared(spark)
        made = lambda start, end: engine(spark, sf_dir).run(Aggregate(Filter(stream(start, end - 1), Condition("eq", P("event_type"), C("purchase"))), (fn("floor", P(TIME), C(DAY), alias=TIME),), (Aggregator("sum", (P("k"),), "total"),)))
        query = buckets.BucketedQuery(spark, f"{shared}/buckets-{uuid.uuid4().hex}", "purchases", timedelta(days=1), made)
        query.compute_and_store(JAN1 + 5 * DAY, JAN1 + 10 * DAY, JAN1 + 30 * DAY)
        query.compute_and_store(JAN1, JAN1 + 30 * DAY, JAN1 + 20 * DAY)
        return query.retrieve(JAN1, JAN1 + 30 * DAY, compute_missing=not trusted_only).select(quoted(TIME).alias("t"), "total")

    return run


_BY_DAY = f"select t - t % {DAY} as t, sum(k)::bigint as total from $E where event_type = 'purchase' and t >= {JAN1} and t < $END group by 1"
add("bucket_cached", _cached(False), _BY_DAY.replace("$END", str(JAN1 + 30 * DAY)))
add("bucket_trusted_only", _cached(True), _BY_DAY.replace("$END", str(JAN1 + 19 * DAY)))


def _two_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = engine(spark, sf_dir).run(Project(stream(), (P(TIME), P(ID), P("user_id"), P("event_type"))))
    return events.filter(F.col("user_id") % 10 != 3), events.filter(F.col("event_type") != "error")


add(
    "diff_streams",
    lambda spark, sf_dir: tools.difference(*_two_sides(spark, sf_dir)).select("side", F.get_json_object("event", "$.@time").cast("long").alias("t"), F.get_json_object("event", "$.user_id").cast("long").alias("user_id")),
    "select 'left' as side, t, user_id from $E where user_id % 10 <> 3 and event_type = 'error' union all select 'right', t, user_id from $E where user_id % 10 = 3 and event_type <> 'error'",
)
add(
    "diff_counts",
    lambda spark, sf_dir: tools.difference_counts(*_two_sides(spark, sf_dir)),
    "select 'left' as side, count(*) as total, count(*) filter (event_type = 'error') as extra from events where user_id % 10 <> 3 union all select 'right', count(*), count(*) filter (user_id % 10 = 3) from events where event_type <> 'error'",
)
add("copy_stream", lambda spark, sf_dir: tools.copy(engine(spark, sf_dir).run(stream()), _A, _B).select(quoted(TIME).alias("t"), "event_id", "value"), f"select t, event_id, value from $E where t between {_A} and {_B}")
add("inspect_fields", lambda spark, sf_dir: tools.fields(engine(spark, sf_dir).run(odd()), ["event_id", "a.b.d", "gone"]).withColumnRenamed("a.b.d", "deep").withColumn("deep", F.col("deep").cast("double")), "select event_id::varchar as event_id, value as deep, null::varchar as gone from $E")


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = Aggregate(stream(), (fn("floor", P(TIME), C(DAY), alias=TIME), P("event_type", alias="@group")), (Aggregator("count", (), "@value"),))
    return engine(spark, sf_dir).run(day)


add("shape_timeseries", lambda spark, sf_dir: tools.series(_panel(spark, sf_dir)).select("group", F.posexplode("points").alias("place", "p")).select("group", F.col("place").cast("long").alias("place"), "p.x", "p.y"), f"""select event_type as "group", row_number() over (partition by event_type order by t - t % {DAY}) - 1 as place, t - t % {DAY} as x, count(*) as y from $E group by event_type, t - t % {DAY}""")
add("shape_bars", lambda spark, sf_dir: tools.bars(_panel(spark, sf_dir).withColumn("@label", F.lit("all")), ["all"]).withColumnRenamed("all", "n"), """select event_type as "group", count(*) as n from events group by 1""")
add("shape_gauge", lambda spark, sf_dir: tools.gauge(engine(spark, sf_dir).run(stream()), "value"), "select arg_max(value, (ts, event_id::varchar)) as value from events")
add("shape_table_page", lambda spark, sf_dir: tools.page(engine(spark, sf_dir).run(Project(stream(), (P("value"), P("event_id")))), "value", 3, 20, descending=True), "select value, event_id from events order by value desc, event_id limit 20 offset 40")


def _windowed(mode: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .streaming import windows

        schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
        events = windows.read_events(spark, f"{sf_dir}/events*.parquet", schema)
        out = windows.run_available(windows.bucket_stream(events, "ts", "1 hour", "30 minutes"), f"{_shared(spark)}/stream-{uuid.uuid4().hex}", mode)
        return out.select(F.date_format("bucket_start", "yyyy-MM-dd HH:mm:ss").alias("bucket"), "n")

    return run


_HOURS = "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as bucket, count(*) as n from events"
add("stream_window", _windowed("complete"), f"{_HOURS} group by 1")
# Only windows that the watermark, half an hour behind the latest event, has passed.
add("stream_watermark", _windowed("append"), f"{_HOURS} where date_trunc('hour', ts) + interval 1 hour <= (select date_trunc('milliseconds', max(ts)) - interval 30 minutes from events) group by 1")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day whose values sum highest."""
    return QUERIES["topk"](spark, sf_dir)
