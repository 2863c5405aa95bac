"""Sources, sinks, counters, selections, admissions, eligibility and watched pages on small inputs."""

import json
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from clarispan.operators import admission, checks, contents, eligibility, registries, watch
from clarispan.sources import catalogs, nested_json, sinks, text


def lines(path):
    """Lines of a folder's part files in their order, a header once."""
    return [x for p in sorted(Path(path).glob("part-*")) for x in p.read_text().splitlines()]


FORMULARY = "FORMULARY_ID|CONTRACT_YEAR|RXCUI|TIER_LEVEL_VALUE|QUANTITY_LIMIT_YN|QUANTITY_LIMIT_AMOUNT|QUANTITY_LIMIT_DAYS|PRIOR_AUTHORIZATION_YN|STEP_THERAPY_YN\nF1|2026|007|2|Y|30|30|X|n\nF1|2026|007|3|N||||\n|2026|1|1|Y|||Y|Y\nF0|2026|9|1| |||y|N\n"
PLANS = "CONTRACT_ID|PLAN_ID|SEGMENT_ID|PLAN_NAME|FORMULARY_ID|PREMIUM|DEDUCTIBLE|STATE|COUNTY_CODE|PDP_REGION_CODE\nS1|001|0|One \"a\"|F1|1|2|OH|36|14\nS1|001|0|Later|F1|1|2|OH|37|14\nS1|001|0|County|F1|1|2||36|14\nS1|001|0|Region|F1|1|2| ||14\nS1|001|0|None|F1|1|2|||\nS2||0|No plan|F1|1|2|OH||\n"


@pytest.mark.parametrize("how", ["folder", "zip"])
def test_part_d_files_are_chosen_by_name(spark, tmp_path, how):
    files = {"x/2026 Basic_Drugs-Formulary file.txt": FORMULARY, "x/plan information  2026.txt": PLANS, "x/zz plan.information.txt": "A|B\n1|2\n", "readme.txt": "-"}
    for name, data in files.items():
        (tmp_path / "d" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "d" / name).write_text(data)
    source = str(tmp_path / "d")
    if how == "zip":
        source = str(tmp_path / "d.zip")
        with zipfile.ZipFile(source, "w") as z:
            for name, data in files.items():
                z.writestr(name, data)
    drugs, plans = text.read_part_d(spark, source)
    assert sorted((r["formulary_id"], r["rxcui"], r["tier"], r["quantity_limit"], r["prior_authorization"], r["step_therapy"]) for r in drugs.collect()) == [("F0", "9", 1, None, True, False), ("F1", "007", 2, True, None, False)]
    got = sorted(((r["plan_name"], r["state"], r["county_code"], r["region"]) for r in plans.collect()), key=str)
    assert got == [("County", None, "36", None), ("None", None, None, None), ('One "a"', "OH", None, None), ("Region", None, None, "14")]
    with pytest.raises(ValueError, match="named like"):
        text.choose_member([*files], "pharmacy network")


def test_counters_of_the_reading_pass(spark, tmp_path):
    (tmp_path / "f.txt").write_text(FORMULARY)
    seen = Observation()
    assert text.read_formulary(spark, str(tmp_path / "f.txt"), seen).count() == 2
    assert seen.get == {"formulary_rows": 4, "missing_yn_values": 4}
    rows = [("Acme Inc", "12-3456780", "4A", 5), ("Acme", "123456780", "4A", 9), ("Bolt", "12", "4A", 1), ("Cord", "123456781", "1A", 1), ("-", "123456782", "4A", 1), (None, None, None, None)]
    seen = Observation()
    frame = spark.createDataFrame([(i, *r, "OH") for i, r in enumerate(rows)], "ord int, name string, ein string, welfare_code string, participants int, state string")
    assert [(r["name_norm"], r["participants"]) for r in registries.employers(frame, seen).collect()] == [("ACME", 9)]
    assert seen.get == {"rows_scanned": 6, "kept": 2, "dropped_non_health": 2, "dropped_bad_ein": 1}
    assert registries.employers(frame, health_only=False).count() == 2


def test_the_first_row_wins_over_several_files(spark, tmp_path):
    for n, tier in (("a", 3), ("b", 1), ("c", 2)):
        (tmp_path / f"{n}.txt").write_text(FORMULARY.split("\n")[0] + "\n" + "".join(f"F|2026|{i}|{tier}|Y|||Y|Y\n" for i in range(300)))
    got = text.read_formulary(spark, str(tmp_path)).groupBy("tier").count().collect()
    assert [tuple(r) for r in got] == [(3, 300)]


def test_written_files(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    sinks.write_memberships(spark.createDataFrame([("2000000000", "ein", "1", "u", None), ("1000000000", "npi", "2", "u", "E")], "npi string, tin_type string, tin_value string, file_url string, reporting_entity string"), at("m"))
    assert lines(at("m")) == ['{"npi":"1000000000","tin_type":"npi","tin_value":"2","file_url":"u","reporting_entity":"E"}', '{"npi":"2000000000","tin_type":"ein","tin_value":"1","file_url":"u"}']
    assert text.read_memberships(spark, at("m")).count() == 2
    manifest = spark.createDataFrame([("u2", "d", 'a "q", b', "ein", "1", "group", "E"), ("u1", "d", "n", "hios", "2", None, "E"), ("u1", "c", "n", "ein", "2", "", "E")], ", ".join(f"{c} string" for c in catalogs.MANIFEST))
    sinks.write_manifest(manifest, at("f"), at("g"))
    assert [x for x in lines(at("f")) if not x.startswith("file_url,")] == ["u1,c,n,ein,2,,E", "u1,d,n,hios,2,,E", 'u2,d,"a ""q"", b",ein,1,group,E']
    assert [x for x in lines(at("g")) if not x.startswith("file_url,")] == ["u1,c,2", "u2,d,1"]
    assert sorted(r["plan_name"] for r in catalogs.read_manifest(spark, at("f")).collect()) == ['a "q", b', "n", "n"]
    sinks.write_employers(spark.createDataFrame([("2", "B", "B", None), ("1", "B", "B", "OH"), ("3", "A", "A", None)], "ein string, name string, name_norm string, state string"), at("e"))
    assert lines(at("e")) == ['{"ein":"3","name":"A","name_norm":"A"}', '{"ein":"1","name":"B","name_norm":"B","state":"OH"}', '{"ein":"2","name":"B","name_norm":"B"}']
    drugs = spark.createDataFrame([("F2", 2026, "1", 1, True), ("F1", 2026, "9", None, None)], "formulary_id string, contract_year int, rxcui string, tier int, step_therapy boolean")
    plans = spark.createDataFrame([("S2", "1", "0", "n", "F", None, "36"), ("S1", "1", "0", "n", "F", "OH", None)], "contract_id string, plan_id string, segment_id string, plan_name string, formulary_id string, state string, county_code string")
    sinks.write_part_d(drugs, plans, at("d"), at("p"))
    assert [json.loads(x) for x in lines(at("d"))] == [{"formulary_id": "F1", "contract_year": 2026, "rxcui": "9"}, {"formulary_id": "F2", "contract_year": 2026, "rxcui": "1", "tier": 1, "step_therapy": True}]
    assert [json.loads(x)["contract_id"] for x in lines(at("p"))] == ["S1", "S2"]
    files = spark.createDataFrame([("u1", "d", 25, 10), ("u2", None, 30, 10), ("u3", "d", 3, 999), ("u4", "d", 1, 5000), ("u5", "d", 9, 0)], "url string, file_description string, plan_count int, bytes long")
    sinks.write_tiers(files, at("ta"), at("tb"), 2, 500)
    assert [x for x in lines(at("ta")) if not x.startswith("file_url,")] == ["u2,,30,10", "u1,d,25,10"] and [x for x in lines(at("tb")) if not x.startswith("file_url,")] == ["u3,d,3,999"]
    assert catalogs.read_manifest_files(spark, at("ta")).count() == 2
    sinks.write_issuers(spark.createDataFrame([("b", None, 3), ("a", "https://x", None)], "key string, indexUrl string, reportingStructures int"), at("i"))
    assert lines(at("i")) == ['{"key":"a","indexUrl":"https://x","reportingStructures":null}', '{"key":"b","indexUrl":null,"reportingStructures":3}']


PLAN = "file_id string, plan_name string, plan_id_type string, plan_id string, plan_market_type string"


def test_plan_sets_are_stored_once_and_checked(spark, tmp_path):
    store = sinks.PlanSets(spark, str(tmp_path / "s"))
    rows = [("a", "p", "ein", "1", "g"), ("a", "q", "ein", "2", "g"), ("b", "q", "ein", "2", "g"), ("b", "p", "ein", "1", "g"), ("c", "p", "ein", "1", None)]
    first = {r["file_id"]: r["set_id"] for r in store.store(spark.createDataFrame(rows, PLAN)).collect()}
    assert first["a"] == first["b"] != first["c"] and store.sets().count() == 2 and store.entries().count() == 3
    store.store(spark.createDataFrame([("d", *rows[0][1:]), ("d", *rows[1][1:]), ("e", "z", "hios", "9", "g")], PLAN))
    assert store.sets().count() == 3 and store.entries().count() == 4 and store.files().where(F.col("set_id") == first["a"]).count() == 3 and store.damaged().count() == 0
    spark.createDataFrame([(first["a"], "x", "ein", "1", "g")], PLAN.replace("file_id", "set_id")).write.parquet(str(tmp_path / "s/entries/batch=left"))
    assert store.entries().count() == 4  # a batch that no run finished
    part = next(p for p in (tmp_path / "s/entries").glob("batch=*") if p.name != "batch=left")
    spark.createDataFrame([(first["a"], "x", "ein", "1", "g")], PLAN.replace("file_id", "set_id")).write.mode("append").parquet(str(part))
    assert [r["set_id"] for r in store.damaged().collect()] in ([first["a"]], [first["a"]])


STRUCTURE = "plans array<struct<plan_name:string,plan_id_type:string,plan_id:string,plan_market_type:string>>, files array<struct<description:string,location:string>>"


def test_selected_contents(spark, tmp_path):
    plan = lambda n, kind="EIN": (n, kind, n, "group")
    rows = [([plan("1"), plan("2")], [("d", "https://h.org/a.json?Signature=1&v=2"), ("d", "https://h.org/b.json")]), ([plan("1"), plan("3", "hios")], [("d", "https://h.org/a.json?v=2&Expires=7")]),
            ([plan("4")], [("d", "https://h.org/c.json"), ("e", "https://i.org/c.json")]), ([plan("5")], [("d", "http://h.org/b.json"), ("d", None)])]
    structures = spark.createDataFrame(rows, STRUCTURE)
    chosen = lambda *urls: spark.createDataFrame([(u,) for u in urls], "requested string")
    plans, files = contents.selected_contents(structures, chosen("https://h.org/a.json?v=2", "/b.json", "/c.json", "https://h.org/none"))
    assert sorted((r["requested"][-8:], r["plan_id_type"], r["plan_id"]) for r in plans.collect()) == [("/b.json", "ein", "1"), ("/b.json", "ein", "2"), ("/c.json", "ein", "4"), ("json?v=2", "ein", "1"), ("json?v=2", "ein", "2"), ("json?v=2", "hios", "3")]
    assert {r["requested"]: tuple(r)[1:] for r in files.collect()} == {
        "https://h.org/a.json?v=2": ("https://h.org/a.json?v=2", 3, 2, None), "/b.json": ("https://h.org/b.json", 2, 1, None), "/c.json": (None, 1, 2, "ambiguous"), "https://h.org/none": (None, 0, 0, "unresolved")}
    scope = spark.createDataFrame([("EIN", "2")], "plan_id_type string, plan_id string")
    assert [r["plan_id"] for r in contents.selected_contents(structures, chosen("https://h.org/a.json?v=2"), scope)[0].collect()] == ["2"]
    for urls, problem in (((), "1 to 400"), (("ftp://x/a",), "not a URL"), (("https://x.org/a", "https://x.org/a?Expires=1"), "one identity"), ([f"/{i}" for i in range(401)], "1 to 400")):
        with pytest.raises(ValueError, match=problem):
            contents.checked_selection(chosen(*urls) if urls else structures.selectExpr("'' AS requested").limit(0))
    toc = {"reporting_structure": [{"reporting_plans": [dict(zip(("plan_name", "plan_id_type", "plan_id", "plan_market_type"), p)) for p in ps], "in_network_files": [dict(zip(("description", "location"), f)) for f in fs]} for ps, fs in rows]}
    (tmp_path / "toc.json").write_text(json.dumps(toc))
    kept = nested_json.read_elements(spark, [str(tmp_path / "toc.json")], ["reporting_structure.*"], contents.containing(chosen("https://h.org/a.json?v=2"))).collect()
    assert [r["ord"] for r in kept] == [0, 1]


def test_probes_follow_nested_locations(spark):
    nested = lambda x: json.dumps({"a": {"location": x}})
    heads = [("v1", '{"provider_references": ['), ("v2", '{"provider_groups"'), ("one", nested("https://x/two").replace("/", "\\/")), ("https://x/two", nested("http://x/three")), ("http://x/three", nested("https://x/four")), ("https://x/four", '"provider_references"'), ("lost", nested("https://x/gone")), ("file", nested("/local"))]
    starts = spark.createDataFrame([(x,) for x in ("v1", "v2", "one", "https://x/two", "lost", "file", "nowhere")], "location string")
    got = {r["location"]: (r["schema"], r["steps"]) for r in contents.probed_schemas(starts, spark.createDataFrame(heads, "location string, text string")).collect()}
    assert got == {"v1": ("v1", 0), "v2": ("v2", 0), "one": ("unknown", 2), "https://x/two": ("v1", 2), "lost": (None, 1), "file": ("unknown", 0), "nowhere": (None, 0)}


def test_bounds_and_reservations(spark):
    kind = "cycle int, candidate long, ord int, database_bytes long, memberships long, plans long, reserved_plans long, replay boolean, encoded_bytes long, buckets long"
    base = {"cycle": 1, "ord": 0, "database_bytes": 2_499_000_000, "memberships": 100, "plans": 10, "reserved_plans": 10, "replay": False, "encoded_bytes": None, "buckets": None}
    cases = [({}, None, 170_000), ({"memberships": 0}, "memberships", 20_000), ({"memberships": 200_001}, "memberships", 300_021_500), ({"plans": 30_001}, "plans", 170_000), ({"reserved_plans": 0}, "measure", 150_000), ({"memberships": None}, "measure", None),
             ({"memberships": 600}, None, 920_000), ({"memberships": 660}, "database", 1_010_000), ({"memberships": 199_999, "replay": True}, None, 0), ({"encoded_bytes": 100, "buckets": 1, "database_bytes": 0}, None, 16_021_324), ({"encoded_bytes": 32_000_001, "buckets": 1}, "compact", 112_021_027),
             ({"encoded_bytes": 1, "buckets": 1, "memberships": 5_000_000, "database_bytes": 0}, None, 16_021_027)]
    names = [c.split(" ")[0] for c in kind.split(", ")]
    rows = [tuple({**base, "candidate": i, **case}[n] for n in names) for i, (case, _, _) in enumerate(cases)]
    got = {r["candidate"]: (r["problem"], r["reserved_bytes"]) for r in admission.capacity(spark.createDataFrame(rows, kind)).collect()}
    assert got == {i: (problem, size) for i, (_, problem, size) in enumerate(cases)}
    plan = admission.admission_plan(spark.createDataFrame([tuple({**base, "candidate": i, "ord": i, "memberships": m, "replay": i == 3}[n] for n in names) for i, m in enumerate([400, 300, 0, 150_000, 100, 100])], kind), files=5)
    assert [tuple(r)[1:] for r in plan.orderBy("candidate").collect()] == [
        (0, "admit", 620_000, 2_499_620_000), (1, "database", 0, 2_499_620_000), (2, "memberships", 0, 2_499_620_000), (3, "replay", 0, 2_499_620_000), (4, "admit", 170_000, 2_499_790_000), (5, "next_cycle", 0, None)]
    one = spark.createDataFrame([(1, False, "5gb-ref-buffer-v7"), (5_000_000_000, True, "5gb-200k-disk-v5-npi-prefix-v1"), (5_000_000_001, False, "5gb-ref-intern-v6-npi-prefix-v1"), (0, True, None)], "bytes long, compact boolean, policy string")
    got = one.select(admission.workspace_reserve(F.col("bytes"), F.col("compact")).alias("w"), admission.compatible_policy(F.col("policy"), F.col("compact")).alias("c")).collect()
    assert [tuple(r) for r in got] == [(4_500_000_001, True), (13_500_000_000, True), (None, False), (None, False)]


def test_eligibility_sentences(spark):
    requests = [(i, s, z, n, y, live) for i, (s, z, n, y, live) in enumerate([
        ("oh", "44012", 1, 2026, True), ("OH", "44013", 1, 2026, True), ("CA", "90001", 1, 2026, True), ("OH", "44012", 3, 2026, True), ("OH", "44012", 1, 2026, False), ("OH", "1", 1, 2026, True), ("PA", "44012", 1, 2026, True), ("QQ", "1", 1, 2026, True), ("OH", "44012", 1, 1999, True), ("PA", "15001", 1, 2026, True)])]
    counties = [("44012", "OH", "93", "Lorain"), ("44012", "OH", "93", "Lorain"), ("44013", "OH", "93", "Lorain"), ("44013", "OH", "35", "Cuyahoga"), ("15001", "PA", "7", "Beaver")]
    frame = spark.createDataFrame
    out = eligibility.eligibility(
        frame(requests, "request_id int, state string, zip string, household_size int, year int, live boolean"), frame(counties, "zip string, county_state string, fips string, county string"), frame([(s, f"{s} Medicaid") for s in ("OH", "PA", "CA")], "state string, program string"),
        frame([(2026, "CA", "California", "Golden Plans")], "year int, state string, own_state string, own_name string"), frame([(0, False, 1234.5, False, 3, 99.6), (9, False, 0.0, True, 0, None)], "request_id int, medicaid boolean, aptc double, gap boolean, plans int, cheapest double"), [2026])
    got = {r["request_id"]: r for r in out.collect()}
    assert [got[i]["verdict"] for i in range(10)] == ["marketplace", "official_handoff", "state_marketplace", "official_handoff", "official_handoff", "unknown", "unknown", "unsupported_state", "unsupported_year", "coverage_gap"]
    assert got[0]["headline"] == "You likely qualify for a subsidy of about $1,235/month toward a Marketplace plan in Lorain, OH." and got[0]["aptc_monthly"] == 1235 and "$100/mo" in got[0]["notes"][1]
    assert got[2]["next_steps"] == ["Start at the official CA Medicaid site for application or account options. Follow your state notice for renewal steps.", "For private-plan eligibility and subsidies, use Golden Plans."] and got[2]["aptc_monthly"] == 0
    assert "localhelp.healthcare.gov" in got[9]["next_steps"][0] and got[9]["in_coverage_gap"] and got[4]["headline"].startswith("OH Medicaid can make")


def test_requests_with_bad_fields(spark):
    rows = spark.createDataFrame([(1, "oh", 2026, ["1", "1 ", " 2"]), (2, "ohio", 2026, ["1"]), (3, "OH", 2031, ["1"]), (4, "OH", 2026, []), (5, "OH", 2026, ["123456789"]), (6, "OH", 2026, [str(i) for i in range(21)]), (7, "OH", 2026, None)], "id int, state string, contract_year int, rxcuis array<string>")
    assert [r["problem"] for r in checks.shortlist_problems(rows).orderBy("id").collect()] == [None, "state", "contract_year", "rxcuis", "rxcuis", "rxcuis", "rxcuis"]
    rows = spark.createDataFrame([([" 1234567890", "12", None, *[f"20000000{i:02d}" for i in range(20)]], [" ", "7 ", *map(str, range(30))]), (None, None)], "doctors array<string>, drugs array<string>")
    first, none = checks.valid_subjects(rows).collect()
    assert len(first["doctors"]) == 12 and first["doctors"][0] == "1234567890" and first["drugs"][:2] == ["7", "0"] and len(first["drugs"]) == 20 and none["doctors"] == none["drugs"] == []


def test_watched_documents(spark):
    words = "word " * 30
    rows = [("a", f"<main>{words}<a href='b'>x</a></main>", "text/html"), ("a2", f"<div><MAIN>  {words}<!-- c --><b><a href=\"/d/b\">x</a></b></main></div>", "TEXT/HTML"), ("b", f"<main>{words}<a href='c'>x</a></main>", "text/html"), ("c", f"<p>{words}</p>", "text/html"), ("d", "<main>short</main>", "text/html"),
            ("e", "00" * 200, "application/pdf"), ("f", "00" * 20, "application/pdf"), ("g", words, "text/plain"), ("h", words, None)]
    got = {r["id"]: (r["problem"], r["fingerprint"]) for r in watch.content_fingerprints(spark.createDataFrame([(i, "https://x.org/d/e", t, b) for i, b, t in rows], "id string, url string, content_type string, body string")).collect()}
    assert got["a"][1] == got["a2"][1] != got["b"][1] and got["e"][1]
    assert {i: p for i, (p, _) in got.items() if p} == {"c": "main_missing", "d": "incomplete", "f": "unexpected", "g": "unexpected", "h": "unexpected"}
