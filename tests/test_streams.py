"""Streams against their batch forms and sequential replays."""

import random
from collections import Counter
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from clarispan.operators import publication, quotas
from clarispan.policy import NETWORK_LIMITS, VISITOR_LIMITS
from clarispan.streaming import jobs

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture(scope="module")
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def streamed(spark, tmp_path, parts, job, name, mode="append"):
    """What a job over a stream of parts, a file and a batch each, has given at its end."""
    for n, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / name / "in"))
        stream = spark.readStream.schema(part.schema).parquet(str(tmp_path / name / "in"))
        q = job(stream).writeStream.format("parquet").outputMode(mode).option("checkpointLocation", str(tmp_path / name / "log")).trigger(availableNow=True).start(str(tmp_path / name / "out"))
        assert q.awaitTermination(120)
    return spark.read.parquet(str(tmp_path / name / "out"))


def plain_replay(events):
    """Limits by counting all accepted turns anew for each event."""
    kept, out = [], {}
    for site, event, t, visitor, network in sorted(events, key=lambda e: (e[0], e[2], e[1])):
        month, day, minute = t.replace(day=1, hour=0, minute=0, second=0, microsecond=0), t.replace(hour=0, minute=0, second=0, microsecond=0), t - timedelta(seconds=60)
        mine = [k for k in kept if k[0] == site]
        since = {"month": month, "day": day, "minute": minute}
        reason = next((("site", w) for w, most in (("month", 2000), ("day", 100)) if sum(k[2] >= since[w] for k in mine) >= most), None)
        for scope, at, limits in (("visitor", 3, VISITOR_LIMITS), ("network", 4, NETWORK_LIMITS)):
            same = [k for k in mine if k[at] == (visitor, network)[at - 3]]
            reason = reason or next(((scope, w) for w in ("month", "day", "minute") if sum(k[2] >= since[w] for k in same) >= limits[w]), None)
        out[event] = reason
        if reason is None:
            kept.append((site, event, t, visitor, network))
    return out


@pytest.fixture(scope="module")
def turns():
    pick, at, out = random.Random(8), datetime(2024, 1, 28, 22, tzinfo=UTC), []
    for i in range(1500):
        at += timedelta(seconds=pick.choice([0, 1, 5, 20, 200, 700]) if i % 100 > 40 else 1)
        # Site c has a network and visitor for each turn, d bursts of one network's visitors, a and b a few of both.
        site = pick.choice("abcdd" if i % 400 < 200 else "cccd")
        visitor = f"v{i}" if site == "c" else f"v{pick.randrange(40 if site == 'd' and i % 3 else 4)}"
        out.append((site, f"{i:05d}", at, visitor, f"n{i}" if site == "c" else f"n{pick.randrange(3)}"))
    return out + [("e", f"{1500 + i:05d}", at + timedelta(seconds=i), f"v{i}", "n") for i in range(14)]


def test_limits_equal_a_sequential_replay(spark, turns):
    events = spark.createDataFrame(turns, "site string, event_id string, created timestamp, visitor string, network string").repartition(3)
    got = {r["event_id"]: None if r["accepted"] else (r["scope"], r["limit"]) for r in quotas.replay(events).collect()}
    want = plain_replay(turns)
    assert got == want
    assert {("site", "day"), ("visitor", "day"), ("visitor", "minute"), ("network", "day"), ("network", "minute")} <= set(want.values())


def test_seconds_to_wait_and_repeats():
    a = quotas.Allowance()
    t = int(datetime(2024, 2, 29, 23, 59, 30, tzinfo=UTC).timestamp()) * 1_000_000
    assert [a.admit(t + i, str(i), "v", "n") for i in range(3)] == [(True, "", "", 0)] * 3
    assert a.admit(t + 9, "3", "v", "n") == (False, "visitor", "minute", 60) and a.admit(t + 9, "1", "v", "n") == (False, "request", "repeat", 0)
    for i in range(97):
        assert a.admit(t + 10, f"x{i}", f"w{i}", f"m{i}")[0]
    assert a.admit(t + 11, "y", "z", "z") == (False, "site", "day", 30)
    assert a.admit(t + 40_000_000, "y", "z", "z")[0] and len(a.turns) == 101 and a.counts["month"]["site", ""] == 1
    month = quotas.Allowance()
    for i in range(50):
        assert month.admit(t - 20 * 86_400_000_000 + i * 90_000_000 * 200, str(i), "v", f"n{i}")[0]
    assert month.admit(t, "last", "v", "n") == (False, "visitor", "month", 30)


def test_the_stream_gate_equals_the_replay(rocks, tmp_path, turns):
    events = rocks.createDataFrame(turns, "site string, event_id string, created timestamp, visitor string, network string")
    cuts = [0, 300, 301, 900, 1600]
    parts = [events.where((F.col("event_id") >= f"{a:05d}") & (F.col("event_id") < f"{b:05d}")) for a, b in zip(cuts, cuts[1:])]
    out = streamed(rocks, tmp_path, parts, jobs.gate, "gate")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, quotas.replay(events).collect()))


def commands(pick, keys, n, withdraw):
    return [(pick.choice(keys), i, "withdraw" if pick.random() < withdraw else "publish", f"g{i}", f"2024-01-{1 + min(27, max(0, i // 12 + pick.randrange(-2, 3))):02d}") for i in range(n)]


COMMANDS = "key string, arrival long, action string, generation string, source_date string"


def test_roles_equal_generations_on_every_prefix(spark):
    rows = commands(random.Random(3), ["k"], 60, 0)
    changes = publication.role_changes(spark.createDataFrame(rows, COMMANDS)).collect()
    refused = {r["generation"] for r in changes if r["role"] == "regression"}
    ledger = [("k", date, arrival, g) for _, arrival, _, g, date in rows if g not in refused]
    want = publication.generations(spark.createDataFrame([(n, *x) for n in range(1, len(ledger) + 1) for x in ledger[:n]], "prefix int, k string, source_date string, created long, generation string").withColumn("stable_key", F.concat_ws(":", "k", "prefix")))
    want = {(r["prefix"], r["generation"]): r["role"] for r in want.collect()}
    assert refused and len(ledger) > 15
    for n in range(1, len(ledger) + 1):
        now = {r["generation"]: r["role"] for r in sorted(changes, key=lambda r: r["arrival"]) if r["arrival"] <= ledger[n - 1][2] and r["role"] != "regression"}
        assert now == {g: role for (prefix, g), role in want.items() if prefix == n}


def test_withdrawals():
    r = publication.Roles()
    assert r.withdraw() == [("", "refused")] and r.publish("a", "1") == [("a", "active")] and r.publish("a", "1") == [("a", "same")]
    assert r.withdraw() == [("a", "refused")] and r.publish("b", "2") == [("b", "active"), ("a", "rollback")] and r.publish("x", "1") == [("x", "regression")]
    assert r.publish("c", "2") == [("c", "active"), ("b", "rollback"), ("a", "retired")] and r.withdraw() == [("c", "withdrawn"), ("b", "active")] and r.withdraw() == [("b", "refused")]


def test_the_role_stream_equals_the_replay(rocks, tmp_path):
    rows = commands(random.Random(4), ["k", "l", "m"], 150, 0.2)
    every = rocks.createDataFrame(rows, COMMANDS)
    parts = [every.where((F.col("arrival") >= a) & (F.col("arrival") < a + 50)) for a in (0, 50, 100)]
    got = streamed(rocks, tmp_path, parts, jobs.generation_roles, "roles").collect()
    want = publication.role_changes(every).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, want)) and {"withdrawn", "refused", "regression", "retired"} <= {r["role"] for r in want}


def test_publications_arrive_once(rocks, tmp_path):
    at = lambda m: datetime(2024, 1, 1, 12, m, tzinfo=UTC)
    parts = [rocks.createDataFrame(rows, "publication_id string, arrived timestamp") for rows in ([("a", at(0)), ("a", at(1)), ("b", at(2))], [("a", at(10)), ("c", at(11)), ("b", at(3))])]
    out = streamed(rocks, tmp_path, parts, jobs.distinct_publications, "once")
    assert sorted(r["publication_id"] for r in out.collect()) == ["a", "b", "c"]


def test_late_dates_are_regressions_across_batches(rocks, tmp_path):
    rows = [("k", 1, "2024-01-02"), ("k", 2, "2024-01-01"), ("l", 3, "2024-01-01"), ("k", 4, "2024-01-02"), ("k", 5, "2024-01-03"), ("l", 6, "2023-01-01"), ("k", 7, "2024-01-02")]
    every = rocks.createDataFrame(rows, "key string, arrival long, source_date string")
    out = streamed(rocks, tmp_path, [every.where("arrival < 4"), every.where("arrival >= 4")], jobs.latest_generation, "late")
    want = publication.regressions(every)
    assert sorted(map(tuple, out.select("key", "arrival", "regression").collect())) == sorted(map(tuple, want.select("key", "arrival", "regression").collect()))


def test_batches_are_published_once_and_windows_equal_batches(spark, tmp_path):
    rows = [(1, i, f"2024-01-01 00:00:{i:02d}") for i in range(6)] + [(2, 9, "2024-01-01 00:00:00"), (1, 7, "2024-01-01 00:02:00")]
    events = spark.createDataFrame(rows, "visitor long, event_id long, created string").withColumn("created", F.col("created").cast("timestamp"))
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    seen = []
    for _ in range(2):
        jobs.publish_batches(stream, lambda df, n: seen.append((n, df.count())), str(tmp_path / "c2")).awaitTermination()
    assert seen == [(0, 8)]
    q = jobs.usage_windows(stream).writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = {(r["start"], r["visitor"], r["n"]) for r in jobs.usage_windows(events).collect()}
    assert {(r["start"], r["visitor"], r["n"]) for r in spark.table("windows").collect()} == want
