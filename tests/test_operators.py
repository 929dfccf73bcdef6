"""Cohorts, funnels, bucketed queries, the catalog, tools and streaming."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from streamlens.functions.ticks import PER_DAY, PER_UNIT, span_ticks, to_ticks
from streamlens.operators import buckets, cohort, funnel, tools
from streamlens.plans.engine import ID, TIME, Engine, quoted
from streamlens.plans.nodes import Aggregate, Aggregator, Condition, Constant, Filter, Function, Property, Stream
from streamlens.sources import tables
from streamlens.sources.catalog import Catalog, CatalogError, Router, Rule
from streamlens.streaming import windows

MINUTE = PER_UNIT["minute"]


def test_cohorts(spark):
    rng, start = random.Random(7), datetime(2011, 11, 18, tzinfo=UTC)
    mails, visits = [], []
    for user in range(120):
        for week in ((0, 2), (2, 4), (1, 3), (3, 0), (4, 1))[user % 5]:
            at = start + timedelta(weeks=week, hours=rng.randint(0, 72))
            mails.append((to_ticks(at), user))
            visits += [(to_ticks(at + timedelta(days=day, hours=rng.randint(0, 5))), user) for day in range(14) if rng.random() < (user % 5 + 1) / 5 / (day + 1)]
    e = Engine(spark).register("mails", spark.createDataFrame(mails, "`@time` long, user long")).register("visits", spark.createDataFrame(visits, "`@time` long, user_id long"))
    sent, seen = cohort.Side("mails", "user", "weeks", 5), cohort.Side("visits", "user_id", "days", 14)
    got = {(r[TIME], r["action_step"]): r["cohort_actions"] for r in e.run(cohort.cohort_plan(start, sent, seen)).collect()}
    s0, week = to_ticks(start), 7 * PER_DAY
    firsts, acts = {}, {}
    for t, u in mails:
        if s0 <= t <= s0 + 5 * week + 1:
            k = (u, (t - s0) // week)
            firsts[k] = min(firsts.get(k, t), t)
    for t, u in visits:
        k = (u, (t - s0) // PER_DAY)
        acts[k] = min(acts.get(k, t), t)
    want = defaultdict(set)
    for (u, w), t in firsts.items():
        for (v, _), a in acts.items():
            if u == v and t <= a < t + 14 * PER_DAY:
                want[s0 + w * week, (a - t) // PER_DAY * PER_DAY].add(u)
    assert got == {k: len(v) for k, v in want.items()}
    report = cohort.cohort_report(e, start, sent, seen)
    assert len(report) == 5 and sum(x["cohort_size"] for x in report.values()) == 240


@pytest.fixture(scope="module")
def steps(spark):
    day = to_ticks(datetime(2014, 3, 20)), to_ticks(datetime(2014, 3, 21))
    make = lambda rows, name="userId": spark.createDataFrame(rows, f"{name} string, type string, `@time` long")
    kind = lambda i: "a" if i % 2 else "b"
    s3 = [("0", "a", day[0] - 2 * MINUTE), ("1", "a", day[0])]
    return {
        "day": day,
        1: make([(str(i), kind(i), day[0] + i * MINUTE) for i in range(20)]),
        2: make([(str(i), kind(i), day[1] + i * MINUTE) for i in range(0, 20, 3)]),
        3: make(s3),
        4: make(s3, "username"),
        5: make([(str(i), kind(i), day[1] + i * MINUTE) for i in range(0, 20, 2)]),
    }


def sizes(f):
    return [r["n"] for r in f.sizes().orderBy("step").collect()]


def test_funnels(steps):
    start, end = steps["day"][0] - PER_DAY, steps["day"][1] + PER_DAY
    S = lambda k, user="userId", **more: funnel.Step(steps[k], user, **more)
    run = lambda *s, **more: funnel.funnel(list(s), start, end, **more)
    assert sizes(run(S(1), S(2))) == [20, 7]
    assert sizes(run(S(1), S(3), fuzzy=2 * MINUTE)) == [20, 1]
    assert sizes(run(S(1), S(3))) == [20, 2]
    assert sizes(run(S(1, where=F.col("type") == "a"), S(3))) == [10, 1]
    assert sizes(run(S(1), S(3), keep_user=lambda u: u.cast("int") % 2 == 1)) == [10, 1]
    assert sizes(run(S(1), S(3), S(4, "username"), mappers={"username": lambda u: u})) == [20, 2, 2]
    mapped = steps[1].select("userId", F.col("userId").alias("username"))
    assert sizes(run(S(1), S(3), S(4, "username"), mappers={"username": mapped})) == [20, 2, 2]
    inverted = run(S(1), S(5, invert=True))
    assert sizes(inverted) == [20, 10]
    assert {(r["user"], r[TIME]) for r in inverted.data(1).collect()} == {(str(i), steps["day"][0] + i * MINUTE) for i in range(1, 20, 2)}
    data = run(S(1, output=("type", "gone")), S(2)).data(0)
    assert {(r["user"], r["data"]["type"]) for r in data.collect()} == {(str(i), "a" if i % 2 else "b") for i in range(20)}
    assert sizes(run(S(1), S(2), end_first=start)) == [0, 0]
    for bad in ((S(1),), (S(1, invert=True), S(2)), (S(1), S(2, invert=True, output=("type",))), (S(1), S(2, "nobody"))):
        with pytest.raises(ValueError):
            run(*bad)


def test_bucketed_query(spark, tmp_path):
    start = to_ticks(datetime(2014, 6, 4, 22))
    width = timedelta(minutes=20)
    w, calls = span_ticks(width), []
    e = Engine(spark).register("s", spark.createDataFrame([(start + i * MINUTE, i % 5, i) for i in range(500)], "`@time` long, a long, b long"))

    def query(lo, hi):
        calls.append((lo, hi))
        return e.run(Aggregate(Filter(Stream("s", lo, hi - 1), Condition("eq", Property("a"), Constant(2))), (Function("floor", (Property(TIME), Constant(w)), TIME),), (Aggregator("sum", (Property("b"),), "b"),)))

    q = buckets.BucketedQuery(spark, str(tmp_path), "test", width, query)
    lo, hi, untrusted = start - 3 * w, start + 28 * w, start + 225 * MINUTE
    want = {start + k * w: 38 + 80 * k for k in range(25)}
    read = lambda *a, **k: {r[TIME]: r["b"] for r in q.retrieve(*a, **k).collect()}
    assert read(lo, hi) == {}
    assert read(lo, hi, untrusted, compute_missing=True) == want
    assert read(lo, hi) == {t: v for t, v in want.items() if t + w < untrusted} and len(read(lo, hi)) == 11
    assert q.missing(lo, hi).count() == 17
    assert read(lo, hi, untrusted, compute_missing=True) == want
    assert q.compute_and_store(lo, hi, untrusted + 40 * MINUTE) == 2 and len(read(lo, hi)) == 13
    assert q.compute_and_store(lo, hi, untrusted, force=True) == 14 and q.compute_and_store(lo, hi, untrusted) == 0
    again = spark.read.parquet(q.path).filter(f"_mark and _bucket = {start}")
    again.write.mode("append").partitionBy("_bucket").parquet(q.path)  # a bucket stored twice is not trusted
    assert start not in read(lo, hi) and read(lo, hi, untrusted, compute_missing=True) == want
    for bad in (lambda: q.retrieve(lo + 1, hi), lambda: buckets.BucketedQuery(spark, "x", "y", timedelta(milliseconds=1500), query)):
        with pytest.raises(ValueError):
            bad()
    assert buckets.timeframe(width, recent=(1, "hours"), now=datetime(2014, 6, 4, 22, 5)) == (start - 3 * w, start + w)
    assert buckets.timeframe(width, between=(datetime(2014, 6, 4, 22), datetime(2014, 6, 4, 22, 40))) == (start, start + 2 * w)


def test_catalog(spark, tmp_path):
    c = Catalog(spark, str(tmp_path), Router({None: {"": Rule(), "big": Rule(bucket=PER_UNIT["hour"], shards=2, records_per_file=3)}}))
    times = [1, 2, 3, 3]
    report = c.put_events({"s": [{"a": k + 1, TIME: t} for k, t in enumerate(times)], "bad name!": [{"a": 1}], "t": [{TIME: 1.5}, {TIME: True}, "x", {"a": 1}]})
    assert report["s"] == {"errors": [], "inserted": {"main": 4}} and "error" in report["bad name!"] and len(report["t"]["errors"]) == 3 and report["t"]["inserted"] == {"main": 1}
    got = lambda *a, **k: [r["a"] for r in c.retrieve("s", *a, **k).collect()]
    assert sorted(got(1, 3)) == [1, 2, 3, 4] and got(2, 2) == [2] and got(10, 5) == [] and len(got(3, 4)) == 2 and got(1, 3, limit=2) == [1, 2] and got(1, 3, limit=0) == []
    assert got(1, 2, order="descending") == [2, 1]
    at = {r["a"]: r[ID] for r in c.retrieve("s").collect()}
    assert len(got(2, 4, start_id=at[2])) == 2
    assert c.streams() == ["s", "t"] and c.streams(prefix="t") == ["t"] and c.streams("other") == [] and c.properties("s") == ["a"]
    c.put_events({"s": [{"a": 9, TIME: 5, "b": "new"}]}, "other")
    assert got(0, 9, namespace="other") == [9] and c.retrieve("none") is None
    e = Engine(spark).resolver(c.scan)
    assert e.run(Stream("s", 2, 3)).count() == 3 and e.run(Stream("s", 0, 9, namespace="other")).count() == 1
    assert c.delete("s", 2, 3, start_id=at[2]) == {"main": 2} and sorted(got()) == [1, 2]
    assert c.delete("s", 1, 1) == {"main": 1} and got() == [2] and c.delete("s", 9, 1) == {"main": 0}
    days = spark.createDataFrame([(to_ticks(datetime(2014, 1, d)) + k, k) for d, n in ((1, 5), (2, 10), (3, 5)) for k in range(n)], "`@time` long, i long")
    assert c.put("big.days", days) == {"main": 20}
    d = [to_ticks(datetime(2014, 1, k)) for k in (1, 2, 3)]
    assert [c.retrieve("big.days", a, b + 99).count() for a, b in ((d[0], d[2]), (d[0], d[1]), (d[1], d[2]))] == [20, 15, 15]
    assert c.retain("big.days", 7).count() == 7
    plan = c.retrieve("big.days", d[0], d[0] + 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_day" in plan
    with pytest.raises(CatalogError):
        c.retrieve("a/b")
    with pytest.raises(CatalogError):
        Router({None: {"x": Rule()}})("y")


def test_tools(spark):
    a = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (2, "c", 2), (3, "d", None)], "`@time` long, `@id` string, v long")
    b = spark.createDataFrame([(1, "z", 1), (2, "y", 5), (3, "x", None)], "`@time` long, `@id` string, v long")
    assert sorted((r["side"], r["event"]) for r in tools.difference(a, b).collect()) == [("left", '{"@time":2,"v":2}'), ("right", '{"@time":2,"v":5}')]
    assert sorted(tuple(r) for r in tools.difference_counts(a, b).collect()) == [("left", 3, 1), ("right", 3, 1)]
    assert tools.copy(a, 2, 3).columns == ["@time", "v"] and tools.copy(a, 2, 3).count() == 2
    assert list(tools.dump_json(a))[0] == '{"@time":1,"@id":"a","v":1}'
    assert [tuple(r) for r in tools.fields(a, ["v", "no.where"]).collect()] == [("1", None), ("1", None), ("2", None), (None, None)]
    assert [n for n, _ in tools.readable({"a": a, "gone": spark.range(1).select(F.raise_error(F.lit("no")).alias("x"))}, 60)] == ["a"]
    assert Engine(spark).register("a", a).status() == {"alive": True, "streams": ["a"]}
    assert tools.sampled(a, 1, 3, 5, 0).count() <= 4
    panel = spark.createDataFrame([(2, "x", "l", 5), (1, "x", "l", 3), (1, "y", "m", 7)], "`@time` long, `@group` string, `@label` string, `@value` long")
    assert {r["group"]: [tuple(p) for p in r["points"]] for r in tools.series(panel).collect()} == {"x": [(1, 3), (2, 5)], "y": [(1, 7)]}
    assert sorted(tuple(r) for r in tools.series_rows(panel).collect()) == [("x", 1, 3, 1), ("x", 2, 5, 2), ("y", 1, 7, 1)]
    assert {r["group"]: (r["l"], r["m"]) for r in tools.bars(panel).collect()} == {"x": (8, None), "y": (None, 7)}
    assert [tuple(r) for r in tools.bar_warnings(panel).collect()] == [("x", "l", 2)]
    assert tools.gauge(panel).first()[0] == 5
    assert [r["@value"] for r in tools.page(panel, "@value", 2, 2, descending=True).collect()] == [3]


def test_sources(spark, tmp_path):
    (tmp_path / "x.csv").write_text("name,when\na,2012-10-17\nb,nonsense\n")
    assert [r[TIME] for r in tables.csv_events(spark, str(tmp_path / "x.csv"), "when").collect()] == [13504320000000000, None]
    (tmp_path / "x.json").write_text('{"@time": 1, "browser": {"name": "n"}, "pages": ["p"]}\n{"@time": 2}\n')
    assert tables.json_events(spark, str(tmp_path / "x.json")).count() == 2
    made = tables.synthetic_events(spark, 5, 100, 3, 2)
    assert [r[TIME] for r in made.orderBy(quoted(TIME)).collect()] == [100, 130, 160, 190, 220] and made.columns == [TIME, "property0", "property1"]


def test_streaming_windows(spark, tmp_path):
    start = datetime(2024, 1, 1)
    df = spark.createDataFrame([(start + timedelta(minutes=i), i) for i in range(240)], "ts timestamp_ntz, v long")
    df.write.parquet(str(tmp_path / "in"))
    stream = windows.read_events(spark, str(tmp_path / "in"), df.schema)
    whole = windows.run_available(windows.bucket_stream(stream, "ts", "1 hour", "30 minutes"), str(tmp_path / "whole"), "complete")
    assert [r["n"] for r in whole.orderBy("bucket_start").collect()] == [60] * 4
    final = windows.run_available(windows.bucket_stream(stream, "ts", "1 hour", "30 minutes", F.sum("v").alias("total")), str(tmp_path / "final"))
    assert [r["total"] for r in final.orderBy("bucket_start").collect()] == [sum(range(60 * k, 60 * k + 60)) for k in range(3)]  # the last hour is not final
    seen = []
    query = windows.upsert(windows.bucket_stream(stream, "ts", "1 hour", "30 minutes"), lambda batch, k: seen.append(batch.count()), str(tmp_path / "ck"))
    query.awaitTermination()
    assert sum(seen) >= 4
