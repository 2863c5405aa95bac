"""Sources and streams on small files."""

import gzip
import json
import zipfile

import pytest

from clarispan.operators import network_files, registries
from clarispan.sources import nested_json, text


def group(npis, kind="EIN", value="11"):
    return {"npi": npis, "tin": {"type": kind, "value": value}}


INLINE = {"reporting_entity_name": "E", "in_network": [{"x": [1, {"y": []}], "negotiated_rates": [{"provider_groups": [group([1234567890, 0, 123456789]), group([1234567890], "npi")]}, {"provider_groups": [group([2234567890])]}]}], "version": "1.0"}
TABLED = {"provider_references": [{"provider_group_id": 7, "provider_groups": [group([1234567890])]}, {"provider_group_id": 8, "provider_groups": [group([3234567890])]}], "in_network": [{"negotiated_rates": [{"provider_references": [7, 9]}]}]}


@pytest.mark.parametrize("how", ["plain", "gzip", "zip"])
def test_network_files(spark, tmp_path, how):
    paths = []
    for name, doc in (("a", INLINE), ("b", TABLED)):
        path, data = str(tmp_path / f"{name}.data"), json.dumps(doc, indent=1)
        if how == "plain":
            open(path, "w").write(data)
        elif how == "gzip":
            gzip.open(path, "wt").write(data)
        else:
            with zipfile.ZipFile(path, "w") as z:
                z.writestr("in.json", data)
        paths.append(path)
    found = nested_json.network_file(spark, paths)
    members, counts = network_files.extract_memberships(found["groups"])
    assert {(r["file_id"][-6], r["npi"], r["tin_type"]) for r in members.collect()} == {("a", "1234567890", "ein"), ("a", "2234567890", "ein"), ("b", "1234567890", "ein")}
    assert {(r["file_id"][-6], r["n_zero"], r["n_tin"], r["n_ok"]) for r in counts.collect()} == {("a", 1, 1, 3), ("b", 0, 0, 1)}
    assert {r["reporting_entity_name"] for r in found["metadata"].collect()} == {"E"}


def test_an_empty_table_of_references_counts(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(INLINE | {"provider_references": []}))
    found = nested_json.network_file(spark, [str(tmp_path / "a.json")])
    assert found["groups"].count() == 0 and found["metadata"].first()["version"] == "1.0"


def test_references_in_other_documents(spark, tmp_path):
    refs = [{"provider_group_id": 1, "location": "https://x/1"}, {"provider_group_id": 2, "location": "https://x/2"}, {"provider_group_id": 3, "provider_groups": [group([3000000003])]}, {"provider_group_id": 4, "location": "https://x/gone"}]
    (tmp_path / "main.json").write_text(json.dumps({"provider_references": refs, "in_network": [{"negotiated_rates": [{"provider_references": [1, 2, 9, 3, 4]}]}]}))
    (tmp_path / "1.json").write_text(json.dumps({"provider_groups": [group([1000000001]), group([1000000011])]}))
    (tmp_path / "2.json").write_text(json.dumps({"provider_references": [{"provider_group_id": 9, "provider_groups": [group([9000000009])]}]}))
    documents = spark.createDataFrame([(f"https://x/{n}", str(tmp_path / f"{n}.json")) for n in "12"], "location string, path string")
    found = nested_json.network_file(spark, [str(tmp_path / "main.json")], documents)
    members, _ = network_files.extract_memberships(found["groups"])
    assert sorted(r["npi"] for r in members.collect()) == ["1000000001", "1000000011", "3000000003", "9000000009"]
    alone, _ = network_files.extract_memberships(nested_json.network_file(spark, [str(tmp_path / "main.json")])["groups"])
    assert [r["npi"] for r in alone.collect()] == ["3000000003"]
    problems = network_files.closure_problems(found["uses"], found["references"]).select("ref_id", "problem").collect()
    assert sorted(map(tuple, problems)) == [("1", "without groups"), ("2", "without groups"), ("4", "without groups"), ("9", "unresolved")]


def test_selection_while_reading(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(INLINE))
    kept = nested_json.read_elements(spark, [str(tmp_path / "a.json")], [nested_json.GROUPS], ["2234567890"]).collect()
    assert len(kept) == 1 and kept[0]["ord"] == 2 and "2234567890" in kept[0]["value"]


@pytest.mark.parametrize("data", [b'{"in_network": [1 2]}', b'{"in_network": []} x', b'{"in_network": [], "in_network": []}', gzip.compress(b'{"in_network": []}')[:-3], gzip.compress(b'{"a": 1}')[:-8] + b"\0" * 8, b'{"a": "\xff"}'])
def test_broken_files_are_errors(spark, tmp_path, data):
    (tmp_path / "a").write_bytes(data)
    with pytest.raises(Exception, match="syntax|trailing|duplicate_key|EOFError|CRC|UnicodeDecodeError"):
        nested_json.read_elements(spark, [str(tmp_path / "a")], ["in_network.*"]).collect()


def test_reference_documents(spark, tmp_path):
    group = {"npi": [1234567890], "tin": {"type": "ein", "value": "1"}}
    documents = {"tabled": {"provider_references": [{"provider_group_id": 7, "provider_groups": [group]}, {"provider_group_id": " ", "provider_groups": [group]}, {"provider_group_id": 8}], "provider_groups": [group]},
                 "bare": {"provider_groups": [group, group]}, "empty": {"provider_references": []}}
    for name, d in documents.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(d))
    rows = nested_json.reference_documents(spark, [str(tmp_path / f"{n}.json") for n in documents]).collect()
    assert sorted((r["file_id"].split("/")[-1], r["ref_id"] or "", len(r["gs"]), r["gs"][0]["npi"][0]) for r in rows) == [("bare.json", "", 1, "1234567890")] * 2 + [("tabled.json", "7", 1, "1234567890")]


def test_table_of_contents(spark, tmp_path):
    path = tmp_path / "toc.json"
    plans = [{"plan_name": n, "plan_id_type": "EIN", "plan_id": n, "plan_market_type": "group"} for n in "pq"]
    files = [{"description": "d", "location": f"https://x/{n}"} for n in "12"]
    path.write_text(json.dumps({"reporting_structure": [{"reporting_plans": plans, "in_network_files": files}, {"reporting_plans": plans[:1], "in_network_files": files}], "reporting_entity_name": "E"}))
    rows = network_files.build_manifest(nested_json.table_of_contents(spark, [str(path)])).collect()
    assert len(rows) == 4 and {r["plan_id_type"] for r in rows} == {"ein"} and {r["reporting_entity"] for r in rows} == {"E"}


def test_nppes_and_form_5500(spark, tmp_path):
    header = list(text.NPPES.values())
    lines = [["1000000001", "1", "", "Doe", "Jo", "OH", "44012-1", "207Q", "", ""], ["1000000001", "1", "Later", "", "", "OH", "44012", "207Q", "", ""], ["1000000002", "1", 'In, "Q"', "", "", "OH", "44112", "207Q", "1/1/20", ""], ["1000000003", "2", "Org", "", "", "oh", "44112", "207Q", "1/1/20", "1/1/21"]]
    path = tmp_path / "n.csv"
    quote = lambda v: '"' + v.replace('"', '""') + '"'
    path.write_text("﻿" + "\n".join(",".join(map(quote, x)) for x in [header, *lines]))
    got = registries.npi_allowlist(text.read_nppes(spark, str(path)), "OH", ["440", "441"])
    assert {(r["npi"], r["name"]) for r in got.collect()} == {("1000000001", "Doe, Jo"), ("1000000003", "Org")}
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_text("SPONSOR_DFE_NAME,SPONS_DFE_EIN,SPONS_DFE_MAIL_US_STATE,PLAN_NAME,TYPE_WELFARE_BNFT_CODE,TOT_ACT_PARTCP_BOY_CNT,FORM_PLAN_YEAR_BEGIN_DATE\nThe Marlow Co.,12-3456780,OH,P,4A4B,\"1,350\",2025-01-01\nAcme,12,OH,P,4A,5,2025-01-01\n")
    b.write_text("SF_SPONSOR_NAME,SF_SPONS_EIN,SF_SPONS_US_STATE,SF_PLAN_NAME,SF_TYPE_WELFARE_BNFT_CODE,SF_TOT_ACT_PARTCP_BOY_CNT,SF_PLAN_YEAR_BEGIN_DATE\nMARLOW,123456780,OH,P,4A,4400,2025-01-01\nNone,123456781,OH,P,14A,1,2025\n")
    got = registries.employers(text.read_form_5500(spark, [str(a), str(b)])).collect()
    assert [(r["ein"], r["name_norm"], r["participants"]) for r in got] == [("123456780", "MARLOW", 4400)]


def test_formulary_and_memberships(spark, tmp_path):
    f = tmp_path / "f.txt"
    f.write_text("FORMULARY_ID|CONTRACT_YEAR|RXCUI|TIER_LEVEL_VALUE|QUANTITY_LIMIT_YN|QUANTITY_LIMIT_AMOUNT|QUANTITY_LIMIT_DAYS|PRIOR_AUTHORIZATION_YN|STEP_THERAPY_YN\nF1|2026|007|2|Y|30|30|X|N\nF1|2026|007|3|N||||\n")
    assert [(r["rxcui"], r["tier"], r["quantity_limit"], r["prior_authorization"], r["step_therapy"]) for r in text.read_formulary(spark, str(f)).collect()] == [("007", 2, True, None, False)]
    m = tmp_path / "m.ndjson"
    m.write_text('{"npi": 1000000001, "tin_value": "1", "file_url": "https://x"}\nnot json\n{"npi": "5"}\n')
    assert [(r["npi"], r["tin_type"]) for r in text.read_memberships(spark, str(m)).collect()] == [("1000000001", "unknown")]
    with pytest.raises(Exception, match="bad membership line"):
        text.read_memberships(spark, str(m), strict=True).collect()
