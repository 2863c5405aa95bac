"""Boards, catalogs, manifests, loads and packed buckets on small rows."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from clarispan.functions.web import network_of, page_links, strict_date
from clarispan.operators import boards, serving
from clarispan.sources import catalogs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_live_board_order(spark):
    plans = spark.createDataFrame([("a", "Silver", 300.0, 0), ("b", "Silver", None, 1), ("c", "Silver", 200.0, 2), ("d", "Catastrophic", 100.0, 3)], "plan_id string, metal string, premium double, ord int")
    doctors = spark.createDataFrame([("a", "1", "Covered", 0), ("a", "1", "NotCovered", 1), ("b", "1", "Covered", 0), ("c", "1", "Covered", 0), ("c", "9", "Covered", 0)], "plan_id string, key string, coverage string, ord int")
    drugs = spark.createDataFrame([("a", "7", "Covered", 0)], "plan_id string, key string, coverage string, ord int")
    board = boards.live_board(plans, doctors, drugs, ["1"], ["7"], 50.0)
    got = [(r["plan_id"], r["keeps_all_doctors"], r["net_monthly"]) for r in board.orderBy("rank").collect()]
    assert got == [("c", True, 150), ("b", True, None), ("a", False, 250), ("d", False, 100)]
    s = boards.board_summary(board).first()
    assert (s["plans"], s["plans_keeping_all_doctors"], s["lowest_net_monthly"]) == (4, 2, 100)
    with pytest.raises(ValueError):
        boards.live_board(plans, doctors, drugs, ["1"] * 13, [])


def test_a_catalog_has_so_many_codes_at_most(spark):
    codes = spark.range(101).select(F.format_string("%03d", "id").alias("code"))
    models = spark.createDataFrame([(2026, "001", "FFM")], "year int, code string, model string")
    with pytest.raises(Exception, match="more than 100 codes"):
        boards.catalog_gaps(models, models.select("year", "code").limit(0), codes).collect()


def test_catalog_gaps_and_routing(spark):
    codes = spark.createDataFrame([("OH",), ("CA",), ("NY",)], "code string")
    models = spark.createDataFrame([(2026, "OH", "FFM"), (2026, "CA", "SBM"), (2026, "XX", "FFM")], "year int, code string, model string")
    own = spark.createDataFrame([(2026, "OH", "x", "x.gov")], "year int, code string, name string, url string")
    got = {(r["code"], r["problem"]) for r in boards.catalog_gaps(models, own, codes).collect()}
    assert got == {("NY", "missing_model"), ("CA", "missing_marketplace"), ("OH", "unexpected_marketplace"), ("XX", "unknown_code")}
    routed = boards.own_marketplaces(spark.createDataFrame([(2026, "oh"), (2026, "CA")], "year int, state string"), own)
    assert {(r["state"], r["url"]) for r in routed.collect()} == {("oh", "x.gov"), ("CA", None)}
    day = lambda d: F.lit(f"2026-01-{d:02d}").cast("timestamp")
    ask = lambda a, b, d: one(spark, boards.needs_publication(F.lit(a), F.lit(b), day(1), day(d)))
    assert [ask("x", "x", 6), ask("x", "x", 7), ask("x", "y", 1), ask(None, "y", 1)] == [False, True, True, True]


def test_buckets_round_trip_and_fail_closed(spark):
    rows = spark.createDataFrame([("f", "1000000007"), ("f", "1000000007"), ("f", "1000999999"), ("g", "2000000000"), ("g", "bad")], "file_id string, npi string")
    packed = serving.pack_buckets(rows)
    assert {(r["file_id"], r["npi"]) for r in serving.unpack_buckets(packed).collect()} == {("f", "1000000007"), ("f", "1000999999"), ("g", "2000000000")}
    r = packed.first()
    for change in ({"count": r["count"] + 1}, {"payload": bytes(r["payload"]) + b"x"}, {"raw_sha256": "0"}):
        b = r.asDict() | change
        with pytest.raises(ValueError):
            serving.unpack(b["count"], b["raw_sha256"], b["payload_sha256"], bytes(b["payload"]))


def test_supervision_and_loads(spark, tmp_path):
    runs = spark.createDataFrame([(1, "a", 5, "running"), (2, "b", 5, "running"), (3, "c", 5, None), (4, "d", 5, "complete")], "run_id int, supervision_id string, pid int, state string")
    seen = spark.createDataFrame([("a", 5, "killed", dt.datetime(2026, 1, 1)), ("b", 6, "killed", dt.datetime(2026, 1, 2)), ("d", 5, "killed", dt.datetime(2026, 1, 3))], "supervision_id string, pid int, state string, observed_at timestamp")
    assert {(r["run_id"], r["effective_state"]) for r in serving.supervised_state(runs, seen).collect()} == {(1, "killed"), (2, "unknown"), (3, "unknown"), (4, "complete")}
    assert [r["supervision_id"] for r in serving.newest_others(seen, runs).collect()] == ["b"]
    path = str(tmp_path / "t")
    load = lambda rows: serving.replace_partitions(spark.createDataFrame(rows, "v int, year int"), path, ["year"])
    load([(1, 2025), (2, 2026)])
    load([(3, 2026)])
    load([(3, 2026)])
    assert {(r["v"], r["year"]) for r in spark.read.parquet(path).collect()} == {(1, 2025), (3, 2026)}
    serving.reload(spark.createDataFrame([("k", 2, "b"), ("k", 1, "a")], "k string, o int, v string"), path + "2", ["k"], ["o"])
    assert [r["v"] for r in spark.read.parquet(path + "2").collect()] == ["a"]
    done = spark.createDataFrame([("s1",)], "shard string")
    assert serving.finished_shards(spark.createDataFrame([("s1", 1), ("s2", 2)], "shard string, v int"), done).count() == 1
    assert serving.is_ready(done) and not serving.is_ready(done.where("false"))


def test_manifests_and_lists(spark, tmp_path):
    m = tmp_path / "m.csv"
    m.write_text(",".join(catalogs.MANIFEST) + '\nhttps://a,"x, y",P,ein,1,group,E\nhttps://a,"x, y",P,ein,1,individual,E\n,d,P,ein,2,group,E\nhttps://b,short\n')
    rows = catalogs.read_manifest(spark, str(m))
    assert {(r["file_url"], r["file_description"]) for r in rows.collect()} == {("https://a", "x, y")}
    assert [r["plan_market_type"] for r in catalogs.manifest_links(rows).collect()] == ["group"]
    f = tmp_path / "f.csv"
    f.write_text("file_url,file_description,plan_count,content_length_bytes\nhttps://a,d,25,\"1,024\"\nhttps://b,d,,\n")
    assert [(r["plan_count"], r["bytes"]) for r in catalogs.read_manifest_files(spark, str(f)).orderBy("url").collect()] == [(25, 1024), (0, 0)]
    e = tmp_path / "e.ndjson"
    e.write_text('{"ein": " 123456789 ", "name": "Acme LLC", "participants": 5, "plan_year": 2025}\n{"ein": "12", "name": "x"}\nnot json\n\n')
    assert [(r["ein"], r["name_norm"], r["participants"], r["plan_year"]) for r in catalogs.read_employers(spark, str(e)).collect()] == [("123456789", "ACME", 5.0, 2025)]
    a = tmp_path / "a.txt"
    a.write_text("1000000001\r\n\n 1000000002 \n1000000001\n")
    assert {r["npi"] for r in catalogs.read_allowlist(spark, str(a)).collect()} == {"1000000001", "1000000002"}
    s = tmp_path / "s.json"
    s.write_text(json.dumps([{"key": "k1", "footprint": "national", "haveData": True}, {"key": "k2", "footprint": ["OH"], "brand": "B", "indexUrl": "u"}]))
    got = {r["key"]: (r["national"], r["states"], r["brand"], r["indexUrl"], r["haveData"]) for r in catalogs.read_seeds(spark, str(s)).collect()}
    assert got == {"k1": (True, [], "", None, True), "k2": (False, ["OH"], "B", "u", False)}
    spec = "struct<npi: string>"
    for text, want in (('[{"npi": "1"}]', 1), ('{"providers": [{"npi": "1"}, {"npi": "2"}]}', 2), ('{"x": 1}', 0)):
        assert len(one(spark, catalogs.issuer_records(F.lit(text), "providers", spec))) == want


def test_contents_and_indexes(spark):
    plan = lambda i: {"plan_name": f"n{i}", "plan_id_type": "EIN", "plan_id": str(i)}
    file = lambda u: {"location": u, "description": ""}
    rows = [(1, "E", [plan(1), plan(2)], [file("https://x/a?Signature=1"), file("https://x/b")]), (2, "E", [plan(1)], [file("https://x/a?Signature=2"), file(" ")])]
    spec = "ord int, reporting_entity string, plans array<struct<plan_name: string, plan_id_type: string, plan_id: string>>, files array<struct<location: string, description: string>>"
    s = spark.createDataFrame([(o, e, [(*p.values(),) for p in ps], [(*f.values(),) for f in fs]) for o, e, ps, fs in rows], spec)
    assert {r["plan_id"] for r in catalogs.plans_of_source(s, "https://x/b").collect()} == {"1", "2"}
    chosen = spark.createDataFrame([("https://x/a?Expires=9",)], "url string")
    assert {(r["plan_id_type"], r["plan_id"]) for r in catalogs.selected_contents(s, chosen).collect()} == {("ein", "1"), ("ein", "2")}
    v = catalogs.validate_index(s).first()
    assert (v["structures"], v["locations"], len(v["sample"]), v["error"]) == (2, 3, 2, None)
    assert [one(spark, catalogs.rate_schema(F.lit(t))) for t in ('{"provider_references": []}', '{"provider_groups"', "{}")] == ["v1", "v2", "unknown"]


def test_networks_links_and_dates(spark):
    cases = {" 10.1.2.3 ": "10.1.2.3", "::ffff:10.1.2.3": "10.1.2.3", "::FFFF:0a01:0203": "10.1.2.3", "2001:db8:0:1::5": "2001:db8:0:1::/64", "2001:0DB8::1": "2001:db8:0:0::/64", "::1": "0:0:0:0::/64", "300.1.1.1": None, "fe80::1%eth0": None, "x": None}
    assert {a: one(spark, network_of(F.lit(a))) for a in cases} == cases
    html = """<a href="/p">1</a><a class=x href='q.html'>2</a><area href="https://o/z"><a href="/p">again</a><a>none</a>"""
    assert one(spark, page_links(F.lit(html), F.lit("https://h/d/i.html"))) == ["https://h/d/q.html", "https://h/p", "https://o/z"]
    assert [str(one(spark, strict_date(F.lit(t)))) for t in ("2026-02-28", "2026-02-30", "2026-2-1")] == ["2026-02-28", "None", "None"]
