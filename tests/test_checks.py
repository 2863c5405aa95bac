"""Requests, plan sets, run reports and contexts on small tables."""

import datetime
import hmac

from pyspark.sql import functions as F

from clarispan.functions.canonical import canonical_json, hmac_sha256
from clarispan.functions.scalars import covered_flag, drug_label, member_name, provider_label
from clarispan.operators import checks, verify
from clarispan.sources.text import write_allowlist


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_request_problems(spark):
    rows = [(" 12 ", "s5810", "001", None, 2026), ("123456789", "S5810", "1", "0", 2026), (None, "S5810", "1", "0", 2026), ("1", "5810", "1", "0", 2026), ("1", "S5810", "1234", "0", 2026),
            ("1", "S5810", "1", "", 2026), ("1", "S5810", "1", "0", 2031), ("1", "S5810", "1", "0", None), ("1\n2", "S5810", "1", "0", 2026)]
    df = spark.createDataFrame(rows, "rxcui string, contract_id string, plan_id string, segment_id string, contract_year int")
    assert [r["problem"] for r in checks.request_problems(df).collect()] == [None, "rxcui", "rxcui", "contract_id", "plan_id", "segment_id", "contract_year", "contract_year", "rxcui"]


def test_set_problems(spark):
    sets = spark.createDataFrame([("ok", 2), ("empty", 0), ("gap", 2), ("twice", 3), ("few", 3), ("type", 1), ("null", 1)], "set_id string, plans long")
    rows = [("ok", 0, "1", "ein"), ("ok", 1, "2", "hios"), ("gap", 0, "1", "ein"), ("gap", 2, "2", "ein"), ("twice", 0, "1", "ein"), ("twice", 2, "2", "ein"), ("twice", 2, "3", "ein"),
            ("few", 0, "1", "ein"), ("type", 0, "1", "EIN"), ("null", 0, None, "ein")]
    found = checks.set_problems(sets, spark.createDataFrame(rows, "set_id string, ordinal int, plan_id string, plan_id_type string"))
    assert dict(values(found, "set_id", "problem")) == {"ok": None, "empty": "count", "gap": "ordinals", "twice": "ordinals", "few": "differs", "type": "metadata", "null": "metadata"}


def test_counts_of_repeated_rows(spark):
    df = spark.createDataFrame([("f", "1", "a"), ("f", "1", "a"), ("f", "1", "b"), ("f", "2", "a"), ("g", "1", "a")], "file_url string, npi string, tin string")
    assert sorted(values(checks.pair_counts(df), "file_url", "npis", "pairs")) == [("f", 2, 3), ("g", 1, 1)]
    assert sorted(values(checks.occurrences(df), "npi", "occurrences")) == [("1", 4), ("2", 1)]


def test_run_report(spark):
    profiles = spark.createDataFrame([("a", None, "federal_plan_rows", 1), ("b", "source_timeout", "federal_plan_rows", 1), ("c", None, "official_exchange_handoff", 0)], "profile_id string, unavailable string, basis string, differences int")
    rows = spark.createDataFrame([("a", 0), ("a", 2), ("b", 5)], "profile_id string, differences int")
    names = ["planned", "evaluated", "unavailable", "quoted", "handed_off", "mismatched_profiles", "compared_rows", "mismatched_rows"]
    assert values(checks.run_report(profiles, rows), *names) == [(3, 2, 1, 1, 1, 1, 2, 1)]
    assert values(checks.run_report(profiles.limit(0), rows.limit(0)), *names) == [(0,) * 8]


def test_refresh_order(spark):
    urls = spark.createDataFrame([("k1", "z"), ("k2", "b"), ("k3", "a"), ("k4", "c")], "source_key string, url string")
    found = checks.refresh_order(urls, spark.createDataFrame([("k1", 5), ("k2", 9), ("k9", 1)], "source_key string, bytes long"))
    assert [u for _, u in sorted(values(found, "rank", "url"))] == ["z", "b", "a", "c"]


def test_contexts(spark):
    rows = [("v", 1, 2, "d", None, "", "self", "n", "p"), ("v", 2, 3, "d", None, "", "self", "n", "p"), ("v", 3, 3, "e", None, "", "self", "n", "p"), ("v", 4, 3, "e", "q", "", "self", "n", "p")]
    df = spark.createDataFrame(rows, "visitor string, version int, household_size int, doctor_query string, plan_query string, employer_query string, premium_basis string, npi string, plan_id string")
    found = checks.reconcile_contexts(df, ["visitor"], ["version"]).orderBy("version")
    assert values(found, "premium_basis", "npi", "plan_id") == [("self", "n", "p"), ("unknown", "n", "p"), ("self", "", "p"), ("self", "n", "")]


def test_labels(spark):
    lit = lambda v: F.lit(v).cast("string")
    row = spark.range(1).select(
        provider_label(lit("1"), lit("Ann"), lit("Bo"), lit(None)), provider_label(lit("1"), lit(""), lit("Bo"), lit(None)), provider_label(lit("1"), lit(None), lit(None), lit("")), provider_label(lit("1"), lit("x"), lit("y"), lit("Clinic")),
        drug_label(lit("9"), lit("")), drug_label(lit("9"), lit("Pill")), member_name(lit(" Plan_Files/2024--x.TXT ")), *[covered_flag(lit(w)) for w in ("NotCovered", "GenericCovered", "in", None)]).first()
    assert list(row) == ["Ann Bo (NPI 1)", "Bo (NPI 1)", "NPI 1", "Clinic (NPI 1)", "RxCUI 9", "Pill (RxCUI 9)", "plan files 2024 x txt", False, True, None, None]


def test_allowlist_files(spark, tmp_path):
    found = spark.createDataFrame([("3", 'A "B", C'), ("1", None), ("2", "plain")], "npi string, name string")
    write_allowlist(found, f"{tmp_path}/list", f"{tmp_path}/meta")
    lines = lambda d: [x for f in sorted((tmp_path / d).glob("part-*")) for x in f.read_text().splitlines()]
    assert lines("list") == ["1", "2", "3"]
    assert [x for x in lines("meta") if x != "npi,name"] == ["1,", "2,plain", '3,"A ""B"", C"']


def test_canonical_json(spark):
    rows = [(0, '{"b": 1.50, "a": [1e3, {"y": "é\\n\\u0001", "x": -0}]}'), (1, None), (2, "{"), (3, "[NaN]"), (4, '"\\ud800"'), (5, '{"k": 1, "k": 2}'), (6, ""), (7, "[" * 200_000), (8, '{"\\uffff": 1, "\\ud83d\\ude00": 2}')]
    got = dict(values(spark.createDataFrame(rows, "id int, t string").select("id", canonical_json("t").alias("c")), "id", "c"))
    assert got == {0: '{"a":[1e3,{"x":-0,"y":"é\\n\\u0001"}],"b":1.50}', 1: None, 2: None, 3: None, 4: '"\\ud800"', 5: '{"k":2}', 6: None, 7: None, 8: '{"😀":2,"￿":1}'}


def test_hmac_equals_the_standard_library(spark):
    texts = ["", "a", "é" * 100, None]
    for key in (b"k", b"x" * 64, b"y" * 100):
        got = values(spark.createDataFrame([(t,) for t in texts], "t string").select("t", hmac_sha256(F.col("t"), key).alias("h")), "t", "h")
        assert dict(got) == {t: t if t is None else hmac.new(key, t.encode(), "sha256").hexdigest() for t in texts}


def test_refresh_states(spark):
    found = spark.createDataFrame([("a", "u", "1"), ("b", "u", "1"), ("c", "u", "2"), ("d", "u", None), ("e", "u", "1")], "source_key string, url string, etag string")
    blocks = spark.createDataFrame([("a", "1", "p", "too deep"), ("b", "1", "q", "x"), ("c", "1", "p", "x"), ("d", None, "p", "x")], "source_key string, etag string, policy string, reason string")
    ready = spark.createDataFrame([("a", "1", "p"), ("b", "1", "p"), ("e", "0", "p")], "source_key string, etag string, policy string")
    got = checks.refresh_states(found, blocks, ready, "p")
    assert sorted(values(got, "source_key", "state", "reason")) == [("a", "blocked", "too deep"), ("b", "prepared", None), ("c", "fetch", None), ("d", "fetch", None), ("e", "fetch", None)]


def test_headlines_and_checklist(spark):
    day = lambda d: datetime.datetime(2024, 1, d)
    rows = [("PROVIDER", "1", "P", "AGREE", "covered", 0.9, day(1), False), ("DRUG", "2", "P", "CONFLICT", "disputed", 0.3, day(2), True), ("DRUG", "1", "Q", "AGREE", "covered", 0.9, None, False)]
    matched = spark.createDataFrame(rows, "kind string, subject_key string, plan_id string, verdict string, status string, reconciled_confidence double, mrf_updated timestamp, confirm boolean")
    got = dict(values(verify.headlines(matched, F.lit("2024-02-01").cast("timestamp")), "plan_id", "headline"))
    assert got["P"] == "Network confidence C (60%): 1 of 2 answers corroborated across both sources · 1 conflict · issuer data 2024-01-01–2024-01-02 · Confirm 1 item with the provider/plan before enrolling."
    assert got["Q"] == "Network confidence A (90%): 1 of 1 answers corroborated across both sources · Nothing flagged to confirm, but verify with the provider before enrolling."
    assert values(verify.checklist(matched), "subject_key", "reason") == [("2", "conflict")]
