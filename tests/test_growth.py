"""Operators whose work must grow with their input: plans, and values on inputs with many repeats."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from clarispan.functions.web import network_of
from clarispan.llm import lz_fingerprint
from clarispan.operators import contents, cost, network_files, publication, ranking, serving
from clarispan.plans import registry

DIR = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_counties_meet_requests_once(spark):
    """Before, each of a county's thousand listings met each request."""
    listed = spark.createDataFrame([("44", f"S{i % 2}", "7") for i in range(3000)], "zip string, county_state string, fips string")
    asked = spark.createDataFrame([(1, "44", "s1"), (2, "44", None), (3, "44", "S9"), (4, "45", None)], "request_id int, zip string, state string")
    out = cost.resolve_counties(listed, asked)
    assert re.search(r"Aggregate \[zip#\d+, county_state", plan_of(out))
    assert {r["request_id"]: (r["resolution"], r["county"]) for r in out.collect()} == {1: ("unique", "S1:7"), 2: ("ambiguous", None), 3: ("state_mismatch", None), 4: ("not_found", None)}


def test_survivors_in_one_pass(spark):
    """Before, the frame ended at the key's last row and was summed anew for each row."""
    rows = spark.range(400).select(F.col("id"), F.lit("k").alias("stable_key"), F.timestamp_seconds(F.col("id") % 100).alias("created"), (F.col("id") % 3 == 0).alias("withdrawn"))
    out = publication.survivors(rows)
    assert "unboundedfollowing" not in plan_of(out).lower().replace(" ", "")
    want = {i: sum(j % 3 > 0 and j % 100 > i % 100 for j in range(400)) for i in range(400)}
    got = {r["id"]: (r["survivors"], r["may_retire"]) for r in out.collect()}
    assert got == {i: (n, i % 3 > 0 and n >= 2) for i, n in want.items()}


def test_pairs_are_made_and_ranked_where_they_are(spark):
    """Before, pairs met their drugs by another shuffle of all pairs, and were shuffled again by household."""
    plan = lambda name: registry.QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan("true_costs").count("Exchange hashpartitioning") == 2  # each side once
    assert plan("true_cost_rank_all").count("Exchange hashpartitioning") == 2


@pytest.fixture
def market(spark, tmp_path):
    """A folder with one market's households and plans, many of which are alike; some numbers, incomes and prices are odd."""
    customers = [(k, f"C{k}", 3, 40.0 * i * i - 100.0, "X") for i, k in enumerate(range(-150, 1000, 50))] + [(None, "none", 3, 1.0, "X"), (1050, "no income", 3, None, "X")]
    parts = [(25 * i + 3, 1, None if i == 7 else 900.0 + i % 3) for i in range(-2, 200)]
    spark.createDataFrame(customers, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_size int, p_retailprice double").repartition(3).write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def rows_of_sql(name, folder):
    con = duckdb.connect()
    for t in ("customer", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    out = con.sql(registry.SQL[name])
    return out.columns, out.fetchall()


def test_costs_are_worked_out_once_for_plans_alike(spark, market):
    """Before, they were worked out for each pair, and what is written of pairs did not repeat itself."""
    out = registry.QUERIES["true_costs"](spark, market)
    columns, want = rows_of_sql("true_costs", market)
    got = [tuple(r[c] for c in columns) for r in out.collect()]
    assert Counter(got) == Counter(want) and len(got) > 4000
    at = [i for i, c in enumerate(columns) if c != "plan"]
    runs = sum(tuple(a[i] for i in at) != tuple(b[i] for i in at) for a, b in zip(got, got[1:]))
    assert runs < len(got) / 2


def test_costs_are_ranked_and_not_pairs(spark, market):
    """Before, all pairs were sorted."""
    out = registry.QUERIES["true_cost_rank_all"](spark, market)
    assert "Window" not in plan_of(out)
    columns, want = rows_of_sql("true_cost_rank_all", market)
    got = [tuple(r[c] for c in columns) for r in out.collect()]
    assert sorted(got) == sorted(want) and len({r[0] for r in got}) == 24


@pytest.mark.parametrize("top, at_once", [(50, 1), (50, 40), (1 << 62, 40), (50, 1 << 18)])
def test_places_in_lists_of_a_key(spark, monkeypatch, top, at_once):
    """Keys over several batches, equal values, values that are missing, empty lists, numbers that fill a long."""
    monkeypatch.setattr(ranking, "RANKED_AT_ONCE", at_once)
    draw = random.Random(top)
    rows = [(draw.randrange(-5, 25), draw.choice([None, -1.5, 0.0, 2.25, 7.0]), sorted(draw.randrange(-top, top) for _ in range(draw.choice([0, 1, 2, 9])))) for _ in range(400)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        out = ranking.ranked_lists(spark.createDataFrame(rows, "k long, cost double, ids array<long>").repartition(3, "k"), "k", "cost", "ids", "id").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for k in {r[0] for r in rows}:
        places = sorted((c is None, c or 0.0, i, c) for key, c, ids in rows if key == k for i in ids)
        want += [(k, i, c, n) for n, (_, _, i, c) in enumerate(places, 1)]
    assert Counter(map(tuple, out)) == Counter(want)


def test_least_outdone_keeps_the_best(spark):
    """Before, all plans of a market met each household."""
    draw = random.Random(5)
    rows = [(n, draw.randrange(40), float(draw.randrange(60))) for n in draw.sample(range(3000), 1500)]
    kept = {r["plan"] for r in cost.least_outdone(spark.createDataFrame([(n, k % 3, x) for n, k, x in rows], "plan long, design int, premium double"), ["design"], 3).collect()}
    assert 9 <= len(kept) < 200
    for credit in (0.0, 3.0, 17.5, 100.0):
        for design in range(3):
            best = sorted((max(0.0, x - credit), n) for n, k, x in rows if k % 3 == design)[:3]
            assert {n for _, n in best} <= kept


def test_regressions_of_equal_arrivals(spark):
    """Before, what arrived under one number was ordered by the partitions that it came from."""
    rows = spark.createDataFrame([("k", 20 + i % 2, 1 + i // 2) for i in range(40)], "key string, source_date int, arrival int")
    results = [sorted(map(tuple, publication.regressions(x).collect())) for x in (rows.orderBy("source_date"), rows.orderBy(F.desc("source_date")))]
    assert results[0] == results[1] == sorted(("k", d, n, d == 20 and n > 1) for d in (20, 21) for n in range(1, 21))


def test_regressions_of_arrivals_without_a_number(spark):
    """Before, what arrived without a number came first; in the SQL's order it comes last."""
    rows = [("k", 9, None), ("k", 5, 1), ("k", 7, 2), ("k", None, 3), ("k", 6, 4), ("m", 1, None), ("m", 2, -1)]
    out = publication.regressions(spark.createDataFrame(rows, "key string, source_date int, arrival int"))
    values = ", ".join("({}, {}, {})".format(f"'{k}'", *("NULL" if v is None else v for v in (d, n))) for k, d, n in rows)
    sql = "SELECT key, source_date, arrival, coalesce(source_date < max(source_date) OVER (PARTITION BY key ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS regression"
    want = duckdb.sql(f"{sql} FROM (VALUES {values}) t(key, source_date, arrival)").fetchall()
    assert {tuple(r) for r in out.collect()} == set(want)
    assert {(r["key"], r["arrival"]) for r in out.where("regression").collect()} == {("k", 4), ("m", None)}


def test_network_works_a_step_out_once(spark):
    """Before, each use of a step repeated all steps before it."""
    rows = spark.createDataFrame([("::ffff:10.1.2.3",), ("2001:DB8::1",), ("1::2::3",), (" 10.0.0.7 ",), ("10.0.0.7:80",), ("::",), ("x",), ("",), (None,)], "ip string")
    out = rows.select(network_of(F.col("ip")).alias("n"))
    assert len(plan_of(out)) < 12000
    assert [r["n"] for r in out.collect()] == ["10.1.2.3", "2001:db8:0:0::/64", None, "10.0.0.7", None, "0:0:0:0::/64", None, None, None]


def test_buckets_are_packed_in_small_tasks(spark, monkeypatch):
    """Before, the number of tasks did not follow the rows, which moved twice."""
    monkeypatch.setattr(serving, "PACK_ROWS", 100)
    rows = spark.range(1000).select((F.col("id") % 7).alias("file_id"), (F.col("id") * 7919 + 1000000000).cast("string").alias("npi"))
    packed = serving.pack_buckets(rows.union(rows))
    plan = packed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and ", 20)" in plan
    assert sorted(map(tuple, serving.unpack_buckets(packed).collect())) == sorted((str(r["file_id"]), r["npi"]) for r in rows.collect())


def test_lookups_are_small_tasks(spark, monkeypatch):
    """Before, the number of tasks did not follow the memberships."""
    monkeypatch.setattr(network_files, "LOOKUP_ROWS", 100)
    members = spark.range(1000).select((F.col("id") % 7).alias("file_id"), (F.col("id") + 1000000000).cast("string").alias("npi"))
    out = network_files.compact_lookup(members.where("file_id = 3").union(spark.createDataFrame([(3, "1000000004"), (3, "x")], "file_id long, npi string")), members.union(members))
    assert ", 20)" in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["npi"] for r in out.where("NOT found").collect()) == ["1000000004", "x"] and out.where("found").count() == 143


def test_structures_are_read_once(spark):
    """Before, each selection's plans and references read all structures again, twice each."""
    structures = spark.createDataFrame(
        [([("P", "EIN", "1", "group")], [("https://h.org/a.json?Signature=1&v=2", "d")]), ([], [("/b.json", "d"), ("https://u@h.org/c.json", "d")])],
        "plans array<struct<plan_name:string,plan_id_type:string,plan_id:string,plan_market_type:string>>, files array<struct<location:string,description:string>>")
    plans, files = contents.selected_contents(structures, spark.createDataFrame([("https://h.org/a.json?v=2",), ("/b.json",)], "requested string"))
    assert "url_decode" not in plan_of(plans).lower() + plan_of(files).lower()
    assert {(r["requested"], r["found"], r["plans"], r["problem"]) for r in files.collect()} == {("https://h.org/a.json?v=2", "https://h.org/a.json?v=2", 1, None), ("/b.json", "path:/b.json", 0, "no plans")}


def test_likeness_and_rewind_of_fingerprints():
    """What is counted with sets and cut in one go equals the definition."""
    draw = np.random.default_rng(3)
    for n, m in ((0, 0), (0, 5), (3, 64), (64, 64), (64, 10)):
        a, b = (np.unique(draw.integers(0, 90, k)).astype(np.uint32) for k in (n, m))
        both = np.union1d(a, b)[: lz_fingerprint.SIZE]
        want = float(len(a) == len(b)) if not len(a) or not len(b) else float((np.isin(both, a) & np.isin(both, b)).mean())
        assert lz_fingerprint.likeness(a, b) == want
    text = "".join(draw.choice(list("abcde "), 5000))
    parse = lz_fingerprint.Parse().feed(text)
    every = np.array(parse.hashes[1:], np.uint64) * np.uint64(lz_fingerprint.FACTOR) >> np.uint64(32)
    assert parse.low.tolist() == sorted(set(every.tolist()))[: lz_fingerprint.SIZE]
    mark, known = parse.mark(), (dict(parse.phrases), list(parse.hashes))
    parse.feed(text[::-1])
    parse.rewind(mark)
    assert (parse.phrases, parse.hashes) == known and parse.mark() == mark
