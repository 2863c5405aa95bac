"""Expected values of single operators."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clarispan.functions.scalars import decode_entities, employer_name, half_up, has_health_benefit, shard_name, source_identity, tristate, url_identity, with_page_text
from clarispan.operators import cost, formulary, matching, network_files, publication, reconcile, verify

ANSWER = "kind string, subject_key string, plan_id string, source string, value string, confidence double"


def claim(spark, *votes):
    return reconcile.reconcile(spark.createDataFrame([("PROVIDER", "1", "P", s, v, c) for s, v, c in votes], ANSWER)).first()


@pytest.mark.parametrize(
    "votes, verdict, consensus, confidence",
    [
        ([("A", "yes", 0.55), ("B", "yes", 0.6), ("C", "yes", 0.6)], "AGREE", "yes", 0.95),
        ([("A", "yes", 0.55), ("B", "yes", 0.6)], "AGREE", "yes", 0.8),
        ([("A", "yes", 0.55), ("B", "yes", 0.6), ("C", "no", 0.6)], "CONFLICT", "unknown", 0.28),
        ([("A", "yes", 0.6), ("B", "unknown", 0.05)], "SINGLE_SOURCE", "yes", 0.54),
        ([("A", "unknown", 0.05)], "ALL_UNKNOWN", "unknown", 0.05),
    ],
)
def test_reconcile(spark, votes, verdict, consensus, confidence):
    r = claim(spark, *votes)
    assert (r["verdict"], r["consensus"], r["reconciled_confidence"]) == (verdict, consensus, confidence)


@pytest.mark.parametrize("url, key, path", [
    ("https://X.org/a/b?v=2&Signature=q&a=1&&Expires=3", "https://x.org/a/b?v=2&a=1", "/a/b?v=2&a=1"), ("https://x.org", "https://x.org/", "/"), ("https://x.org:443/a?%53ignature=1", "https://x.org/a", "/a"),
    ("/a/b?X-Amz-Date=1&p=/q?r", "path:/a/b?p=/q?r", "/a/b?p=/q?r"), ("//x/a", None, None), ("http://x.org/a", None, None), ("https://u@x.org/a", None, None), ("https://x.org:8443/a", None, None), ("https://x.org/a#b", None, None)])
def test_source_identity(spark, url, key, path):
    got = one(spark, source_identity(F.lit(url)))
    assert (got and tuple(got)) == ((key, path) if key else None)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "name, norm",
    [("THE Fernwick Co.", "FERNWICK"), ("Ostrava Holdings LLC", "OSTRAVA"), ("THE", "THE"), ("Green Hollow, Dental LLC", "GREEN HOLLOW DENTAL"), ("LLC LLC", "LLC"), ("the ostrava holdings llc the", "OSTRAVA")],
)
def test_employer_name(spark, name, norm):
    assert one(spark, employer_name(F.lit(name))) == norm


def test_small_functions(spark):
    assert one(spark, half_up(F.lit(1.005))) == 1.0 and one(spark, half_up(F.lit(-0.5), 0)) == 0.0
    assert [one(spark, tristate(F.lit(t))) for t in ("Covered", "NotCovered", "not covered", "in", "out", "?")] == ["yes", "no", "no", "yes", "no", "unknown"]
    assert one(spark, has_health_benefit(F.lit("4B4A"))) and not one(spark, has_health_benefit(F.lit("14A")))
    assert one(spark, shard_name(F.lit("https://x/a/b.json.gz?s=1"))) == "b" and one(spark, shard_name(F.lit("https://x/"))) == "shard"
    a, b = (one(spark, url_identity(F.lit("https://x/f?b=2&Signature=q&a=1"))), one(spark, url_identity(F.lit("https://x/f?a=1&b=2&X-Amz-Date=7"))))
    assert a == b != one(spark, url_identity(F.lit("https://x/f?a=2&b=2")))


def test_subsidy_points(spark):
    rows = spark.createDataFrame([(10000.0, 1, 500.0), (100000.0, 1, 500.0), (31300.0, 1, 500.0), (15650.0, 1, 500.0)], "income double, size int, benchmark_monthly double")
    got = cost.subsidies(rows).orderBy("income").collect()
    assert [r["eligible"] for r in got] == [False, True, True, False]
    assert got[0]["aptc_annual"] == got[3]["aptc_annual"] == 0
    assert got[2]["fpl_pct"] == 200.0 and got[2]["contribution_annual"] == 2040.76 and got[2]["aptc_annual"] == 3959.24
    variant, _ = cost.csr_variant(F.col("f"), F.col("m"))
    bands = spark.createDataFrame([(150.0, "Silver"), (200.0, "Silver"), (250.0, "Silver"), (251.0, "Silver"), (150.0, "Bronze")], "f double, m string").select(variant).collect()
    assert [r[0] for r in bands] == ["94", "87", "73", None, None]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.floats(0, 500), min_size=3, max_size=20))
def test_contribution_never_falls(spark, points):
    rows = spark.createDataFrame([(p,) for p in sorted(points)], "f double").coalesce(1)
    got = [r[0] for r in rows.select(cost.applicable_pct(F.col("f"))).collect()]
    assert got == sorted(got) and min(got) >= 2.07 and max(got) <= 9.83


def test_full_deductible_is_charged(spark):
    row = spark.createDataFrame([(300.0, True, 0.0, "Bronze", 100.0, 2000.0, 8000.0, 0.2, 500.0, 600.0)], "fpl_pct double, eligible boolean, aptc_annual double, metal string, premium double, deductible double, oop_max double, coinsurance double, medical_spend double, drug_cost double")
    r = cost.true_costs(row).first()
    assert (r["net_premium"], r["medical"], r["oop"], r["true_cost"]) == (1200.0, 2000.0, 2600.0, 3800.0)


def test_statuses_and_grades(spark):
    assert one(spark, matching.status(F.lit("CONFLICT"), F.lit("unknown"))) == "disputed"
    assert [one(spark, verify.grade(F.lit(s))) for s in (0.85, 0.7, 0.5, 0.3, 0.29)] == list("ABCDF")


def test_evidence_never_says_no(spark):
    day = dt.datetime(1999, 1, 1)
    as_of = F.lit("1999-01-01").cast("timestamp")
    requests = spark.createDataFrame([(i, "ein", str(i), "1000000000") for i in range(6)], "request_id int, plan_id_type string, plan_id string, npi string")
    dates = {0: day, 1: day - dt.timedelta(60), 2: day - dt.timedelta(60, 1), 3: None, 4: day}
    files = spark.createDataFrame([("ein", str(i), i, d) for i, d in dates.items()], "plan_id_type string, plan_id string, file_id int, source_last_updated timestamp")
    members = spark.createDataFrame([(i, "1000000000") for i in range(4)], "file_id int, npi string")
    got = {r["request_id"]: (r["evidence"], r["value"]) for r in network_files.evidence(requests, files, members, as_of).collect()}
    assert got == {0: ("listed", "yes"), 1: ("listed", "yes"), 2: ("source_stale", "unknown"), 3: ("source_date_unknown", "unknown"), 4: ("incomplete_index", "unknown"), 5: ("plan_missing", "unknown")}


def test_strict_references_fail(spark):
    uses = spark.createDataFrame([("f", "1", 1), ("f", "2", 2)], "file_id string, ref_id string, ord int")
    refs = spark.createDataFrame([("f", "1", 9, "a"), ("f", "1", 10, "b")], "file_id string, ref_id string, ord int, g string")
    assert [(r["ref_id"], r["g"], r["ord"]) for r in network_files.used_reference_groups(uses, refs).collect()] == [("1", "b", 1)]
    with pytest.raises(Exception, match="unresolved reference"):
        network_files.used_reference_groups(uses, refs, strict=True).collect()


def test_plan_set_identity_has_no_order(spark):
    rows = [("a", "ein", "1", "g"), ("ab", "hios", "2", "")]
    schema = "file_id int, plan_name string, plan_id_type string, plan_id string, plan_market_type string"
    ids = {r["set_id"] for r in network_files.plan_set_ids(spark.createDataFrame([(1, *rows[0]), (1, *rows[1]), (2, *rows[1]), (2, *rows[0])], schema)).collect()}
    assert len(ids) == 1


def test_shortlist_and_regions(spark):
    plans = spark.createDataFrame([("S1001", "1", "0", 2026, n, f, "OH") for n, f in (("Both Free", 1), ("Both Checked", 2), ("One", 3))] + [("H1001", "9", "0", 2026, "Managed", 1, "OH")], "contract_id string, plan_id string, segment_id string, contract_year int, plan_name string, formulary_id int, state string")
    drugs = spark.createDataFrame([(1, 2026, "7", 2, False, False, None), (1, 2026, "8", 3, False, None, False), (2, 2026, "7", 1, True, True, False), (2, 2026, "8", 1, False, False, False), (3, 2026, "7", 1, False, False, False)], "formulary_id int, contract_year int, rxcui string, tier int, prior_authorization boolean, step_therapy boolean, quantity_limit boolean")
    top = formulary.shortlist(plans, drugs, spark.createDataFrame([("7",), ("8",)], "rxcui string"), F.lit(True)).collect()
    assert [r["plan_name"] for r in top] == ["Both Free", "Both Checked", "One"]
    assert (top[0]["listed"], top[0]["restricted_drugs"], top[0]["average_tier"]) == (2, 0, 2.5)
    states = formulary.regions_of(spark.createDataFrame([("OH",), ("dc",), ("PR",), ("XX",)], "state string"))
    assert {r["state"]: r["region"] for r in states.collect()} == {"OH": 14, "dc": 5, "PR": 38, "XX": None}


def test_publisher(spark, tmp_path):
    p, day = publication.Publisher(spark, f"file://{tmp_path}"), dt.date(2026, 1, 1)
    first, new = p.publish(spark.range(5), "k", day)
    assert new and p.publish(spark.range(5).repartition(3), "k", day) == (first, False)
    second, new = p.publish(spark.range(6), "k", day + dt.timedelta(1))
    assert new and second != first and p.read("k").count() == 6
    with pytest.raises(ValueError, match="regression"):
        p.publish(spark.range(7), "k", day)
    p.withdraw("k")
    assert p.read("k").count() == 5


def test_plan_search_finds_plans_of_shared_sets(spark):
    eligible = spark.createDataFrame([(1, "A"), (2, "C"), (3, "B")], "file_id long, reporting_entity string")
    plan = "plan_name string, plan_id_type string, plan_id string, plan_market_type string"
    links = spark.createDataFrame([(1, "Gold one", "ein", "1", "group"), (2, "Gold stale link", "ein", "9", "group")], f"file_id long, {plan}")
    sets = spark.createDataFrame([(2, 7), (3, 7), (5, 8)], "file_id long, set_id long")
    entries = spark.createDataFrame([(7, "Gold two", "ein", "2", "group"), (7, "Silver", "ein", "3", "group"), (8, "Gold closed", "ein", "4", "group")], f"set_id long, {plan}")
    got = network_files.search_plans(eligible, links, "gold", sets=sets, set_entries=entries).collect()
    assert [(r["plan_name"], r["issuer"]) for r in got] == [("Gold one", "A"), ("Gold two", "C")]


def test_ranks_without_a_limit_cover_all_plans(spark):
    rows = spark.range(0, 500, 1, 7).select(F.col("id").cast("string").alias("plan_id"), (F.col("id") * 37 % 11).cast("double").alias("match_score"), (F.col("id") % 3).cast("double").alias("network_confidence"))
    got = matching.rank_matches(rows).collect()
    want = sorted(got, key=lambda r: (-r["match_score"], -r["network_confidence"], r["plan_id"]))
    assert len(got) == 500 and [r["rank"] for r in want] == list(range(1, 501))


@pytest.mark.parametrize("html, text", [
    ("<p>a</p><MAIN class='x'>b<br>c</main>d", "b c"), ("no tags & none", "no tags & none"), ("<!-- <p> -->a<script>x<b>y</script>b<nav a='1'>n</nav>", "a b"),
    ('<a title="x>y" b=\'<\'>t</a>', "t"), ("a < b", "a < b"), ("x &#8217; &#x41; &AMP; &amp;lt; &#38;lt; &#0; &#xD800; &nope; &", "x \u2019 A & &lt; &lt; &#0; &#xD800; &nope; &"), ("a&nbsp;&#160;b", "a b"), (None, None), ("", "")])
def test_page_text(spark, html, text):
    rows = with_page_text(spark.createDataFrame([(1, html)], "page_id int, html string"))
    assert rows.columns == ["page_id", "html", "text"] and rows.first()["text"] == text


@pytest.mark.parametrize("html", ["<" + "x" * (1 << 20), "<" + "x 'y' " * 200_000, "a < " + "b c " * 250_000 + "<p>", "<p " + "a='1' " * 200_000 + ">t", "&" * (1 << 20)])
def test_page_text_of_long_odd_pages(spark, html):
    rows = spark.createDataFrame([(html,)], "html string")
    assert with_page_text(rows).select(F.length("text")).first()[0] >= 1


def test_stamps_count_by_source(spark):
    rows = [("PROVIDER", "1", "P", s, v, 0.6) for s, v in [("A", "yes")] * 3 + [("B", "no")] + [("C", "unknown")]]
    got = sorted((r["source"], r["value"], r["n"], r["agrees_with"], r["conflicts_with"]) for r in reconcile.stamps(spark.createDataFrame(rows, ANSWER)).collect())
    assert got == [("A", "yes", 3, "A,A", "B"), ("B", "no", 1, "", "A,A,A")]


def test_two_definitions_of_one_place_leave_one(spark):
    uses = spark.createDataFrame([("f", "1", 1)], "file_id string, ref_id string, ord int")
    refs = spark.createDataFrame([("f", "1", 9, "a"), ("f", "1", 9, "b")], "file_id string, ref_id string, ord int, g string")
    assert network_files.used_reference_groups(uses, refs).count() == 1


def test_decision_resolves_tiers_from_the_match(spark):
    from clarispan.operators import decision

    matched = spark.createDataFrame(
        [(k, s, p, "AGREE", "yes", "covered", 0.9, None, False) for p in ("P1", "P2") for k, s in (("PROVIDER", "1"), ("DRUG", "7"), ("DRUG", "8"))],
        "kind string, subject_key string, plan_id string, verdict string, consensus string, status string, reconciled_confidence double, mrf_updated timestamp, confirm boolean")
    plans = spark.createDataFrame([("P1", "Silver", 400.0, 1000.0, 8000.0, 0.2), ("P2", "Bronze", 300.0, 1000.0, 8000.0, 0.2)], "plan_id string, metal string, premium double, deductible double, oop_max double, coinsurance double")
    home = spark.createDataFrame([(100000.0, 1, 500.0, 0.0)], "income double, size int, benchmark_monthly double, medical_spend double")
    tiers = spark.createDataFrame([("P1", "7", "T1"), ("P2", "7", "T9")], "plan_id string, subject_key string, tier string")
    fills, copays = spark.createDataFrame([("7", 2)], "subject_key string, fills int"), spark.createDataFrame([("T1", 10.0)], "tier string, copay double")
    rows = decision.assemble(matched, plans, home, tiers, fills, copays, 50.0, F.lit("2026-01-01").cast("timestamp")).orderBy("rank").collect()
    assert [(r["plan_id"], r["drug_cost"], r["net_premium"], r["true_cost"], r["unknown_tier"], r["grade"]) for r in rows] == [("P2", 1800.0, 3600.0, 6400.0, True, "A"), ("P1", 840.0, 4800.0, 6640.0, True, "A")]
    said = decision.subsidy_headline(home.union(home.select(F.lit(23475.0), "size", "benchmark_monthly", "medical_spend"))).collect()
    assert [r["headline"].split(" — ")[0].split("~")[0] for r in said] == ["No premium subsidy at this income", "Estimated subsidy "] and "+ Silver CSR 94" in said[1]["headline"]
