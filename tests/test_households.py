"""Households from two sources' files to verdicts, matches, checklists and health systems."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from clarispan.operators import bridge, issuer_files, matching, provenance, reconcile, verify

DAY = "2026-06-17"


def answers(spark, grid, records, coverage, fetched):
    """grid: (kind, subject, plan); records: (kind, subject, plans, day); coverage: (kind, subject, plan, wording)."""
    at = F.lit(fetched).cast("timestamp")
    g = spark.createDataFrame(grid, "kind string, subject_key string, plan_id string")
    r = spark.createDataFrame([(*x, i) for i, x in enumerate(records)], "kind string, subject_key string, plans array<string>, last_updated_on string, ord int")
    c = spark.createDataFrame([(*x, i) for i, x in enumerate(coverage)], "kind string, subject_key string, plan_id string, coverage string, ord int")
    return provenance.make_answers(issuer_files.issuer_answers(g, r, at).unionByName(issuer_files.marketplace_answers(g, c, at)))


def test_every_verdict_of_two_sources(spark):
    p, other = "P", "Q"
    seen = {"1": ("Covered", p), "2": ("Covered", other), "3": ("Covered", None), "4": (None, p), "5": (None, None), "6": ("NotCovered", other)}
    drugs = {"7": ("Covered", p), "8": ("Covered", other), "9": ("Covered", None)}
    both = [("PROVIDER", k, *v) for k, v in seen.items()] + [("DRUG", k, *v) for k, v in drugs.items()]
    found = answers(
        spark, [(kind, k, p) for kind, k, _, _ in both], [(kind, k, [m], "2026-05-20") for kind, k, _, m in both if m] + [("DRUG", " ", [p], DAY)],
        [(kind, k, p, c) for kind, k, c, _ in both if c], f"{DAY} 12:00:00")
    rows = reconcile.two_way(found).collect()
    assert Counter(r["verdict"] for r in rows) == {"AGREE": 3, "CONFLICT": 2, "API_ONLY": 2, "MRF_ONLY": 1, "BOTH_UNKNOWN": 1}
    s = reconcile.summarize(reconcile.reconcile(found)).first()
    assert (s["total"], s["agree"], s["conflict"], s["agreement_rate"]) == (9, 3, 2, 0.6)


def test_a_household_on_two_plans(spark):
    subjects = [("PROVIDER", "111"), ("PROVIDER", "222"), ("PROVIDER", "333"), ("DRUG", "617"), ("DRUG", "310")]
    records = [("PROVIDER", "111", ["A", "B"], DAY), ("PROVIDER", "222", ["A"], DAY), ("PROVIDER", "333", ["Z"], DAY), ("DRUG", "617", ["A", "B"], DAY)]
    coverage = [(*s, "A", "Covered") for s in subjects] + [("PROVIDER", "111", "B", "Covered"), ("PROVIDER", "222", "B", "NotCovered"), ("DRUG", "617", "B", "Covered")]
    found = answers(spark, [(*s, p) for s in subjects for p in "AB"], records, coverage, DAY)
    matched = matching.match_subjects(spark.createDataFrame(subjects, "kind string, subject_key string"), found, found)
    rolled = matching.roll_up(matched)
    got = {r["plan_id"]: r for r in rolled.collect()}
    count = lambda p: [got[p][f"{w}_{s}"] for w in ("doctors", "drugs") for s in ("covered", "disputed", "not_covered", "unknown")]
    assert count("A") == [2, 1, 0, 0, 2, 0, 0, 0] and count("B") == [1, 0, 2, 0, 1, 0, 0, 1]
    assert got["A"]["confirm_list"] == got["B"]["confirm_list"] == "DRUG:310,PROVIDER:333"
    assert [r["plan_id"] for r in matching.rank_matches(rolled, 5).orderBy("rank").collect()] == ["A", "B"]
    reasons = {(r["plan_id"], r["subject_key"]): r["reason"] for r in matching.confirm_list(matched).collect()}
    assert reasons == {("A", "333"): "conflict", ("A", "310"): "unverified", ("B", "333"): "unverified", ("B", "310"): "unknown"}
    report = verify.verify_plans(matched, F.lit(DAY).cast("timestamp")).collect()
    assert all(r["stale"] == 0 and r["verified"] + r["conflicts"] + r["single_source"] + r["unknown"] == r["total"] == 5 for r in report)


def test_health_systems(spark):
    where = {"17": ["PPO", "CVH"], "25": ["PPO", "HPH"], "33": ["PPO", "HPH"]}
    plans = ["PPO", "HPH", "CVH", "NAR"]
    grid = [("PROVIDER", k, p) for k in where for p in plans]
    coverage = [("PROVIDER", k, p, "Covered" if p in where[k] else "NotCovered") for _, k, p in grid]
    found = answers(spark, grid, [("PROVIDER", k, v, DAY) for k, v in where.items()], coverage, DAY)
    matched = matching.match_subjects(spark.createDataFrame([("PROVIDER", k) for k in where], "kind string, subject_key string"), found, found)
    tags = spark.createDataFrame([(0, "17", "cedar", True), (1, "25", "harbor", False), (2, "33", "harbor", False)], TAG)
    rows = bridge.bridge_plans(matched, tags).orderBy(F.desc("bridge_score"), "plan_id").collect()
    assert [(r["plan_id"], r["bridge_status"], r["kept"], r["lost"], r["critical_gaps"]) for r in rows] == [
        ("PPO", "bridges_all", "cedar,harbor", "", ""), ("CVH", "single_system", "cedar", "harbor", ""), ("HPH", "single_system", "harbor", "cedar", "17"), ("NAR", "none", "", "cedar,harbor", "17")]
    assert [r["bridge_score"] for r in rows] == [2.38, 1.38, 1.08, 0.0] and rows[0]["headline"].startswith("Keeps every system in-network (cedar + harbor) — shown in-network at ≥80%")
    assert rows[2]["headline"].startswith("Keeps harbor but drops cedar · ⚠️ puts a must-keep provider out-of-network: NPI 17 · ")
    assert [r["plan_id"] for r in bridge.rank_bridges(bridge.bridge_plans(matched, tags)).orderBy("rank").collect()] == [r["plan_id"] for r in rows]


TAG = "ord int, subject_key string, system string, critical boolean"
MATCH = "kind string, subject_key string, plan_id string, status string, reconciled_confidence double, confirm boolean"


@pytest.mark.parametrize("tags, want", [
    ([(0, "1", "A", False), (1, "9", "B", False)], ("single_system", "A", "B", "", 1.39)),  # nobody of B was matched
    ([(0, "1", "A", False)], ("bridges_all", "A", "", "", 1.39)),  # nobody is critical: the whole share counts
    ([(0, "1", "B", True), (1, "1", "A", False)], ("single_system", "A", "B", "", 1.39)),  # the last tag says the system
    ([(0, "2", "A", True), (1, "9", "A", True)], ("none", "", "A", "2", 0.15)),  # one of two critical providers is a gap
])
def test_bridge_cases(spark, tags, want):
    matched = spark.createDataFrame([("PROVIDER", "1", "P", "covered", 0.9, False), ("PROVIDER", "2", "P", "not_covered", 0.9, False), ("DRUG", "1", "P", "unknown", 0.05, True)], MATCH)
    r = bridge.bridge_plans(matched, spark.createDataFrame(tags, TAG)).first()
    assert (r["bridge_status"], r["kept"], r["lost"], r["critical_gaps"], r["bridge_score"]) == want


@pytest.mark.parametrize("late", [0, 90, 180])
def test_confidence_halves_with_age(spark, late):
    rows = spark.createDataFrame([("PROVIDER", "1", "P", "ISSUER_MRF", "yes")], "kind string, subject_key string, plan_id string, source string, value string")
    start = F.lit("2026-01-01").cast("timestamp")
    rows = rows.withColumns({"source_last_updated": start, "fetched_at": start + F.make_dt_interval(F.lit(late))})
    assert provenance.make_answers(rows).first()["confidence"] == {0: 0.6, 90: 0.3, 180: 0.15}[late]
