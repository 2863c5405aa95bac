"""Queries over requests, plan sets and runs, and labels of their rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from clarispan.functions.canonical import canonical_json, hmac_sha256
from clarispan.functions.scalars import covered_flag, drug_label, member_name, provider_label
from clarispan.operators import checks
from clarispan.plans.base import query, table


@query("""
SELECT p_partkey, problem FROM (
  SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'x' || CAST(p_partkey AS VARCHAR) ELSE ' ' || CAST(p_partkey AS VARCHAR) END AS rxcui,
    CASE p_size % 3 WHEN 0 THEN 's' WHEN 1 THEN 'H' ELSE 'HH' END || lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') AS contract_id,
    CASE WHEN p_size % 7 = 0 THEN '1234' ELSE CAST(p_size AS VARCHAR) END AS plan_id, CASE WHEN p_partkey % 13 = 0 THEN 'a' WHEN p_partkey % 2 = 0 THEN '000' END AS segment_id,
    CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE 2015 + p_partkey % 20 END AS contract_year FROM part
) r, LATERAL (SELECT CASE WHEN NOT regexp_full_match(trim(rxcui), '[0-9]{1,8}') THEN 'rxcui' WHEN NOT regexp_full_match(upper(trim(contract_id)), '[A-Z][0-9]{4}') THEN 'contract_id'
  WHEN NOT regexp_full_match(trim(plan_id), '[0-9]{1,3}') THEN 'plan_id' WHEN NOT regexp_full_match(coalesce(segment_id, '0'), '[0-9]{1,3}') THEN 'segment_id'
  WHEN contract_year IS NULL OR contract_year < 2020 OR contract_year > 2030 THEN 'contract_year' END AS problem) v""")
def request_validation(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.concat(F.when(k % 11 == 0, "x").otherwise(" "), k.cast("string")).alias("rxcui"),
        F.concat(F.when(size % 3 == 0, "s").when(size % 3 == 1, "H").otherwise("HH"), F.lpad((k % 10000).cast("string"), 4, "0")).alias("contract_id"),
        F.when(size % 7 == 0, "1234").otherwise(size.cast("string")).alias("plan_id"), F.when(k % 13 == 0, "a").when(k % 2 == 0, "000").alias("segment_id"),
        F.when(k % 17 != 0, k % 20 + 2015).alias("contract_year"))
    return checks.request_problems(rows).select("p_partkey", "problem")


@query("""
WITH entries AS (
  SELECT l_orderkey AS set_id, CASE WHEN l_orderkey % 7 = 0 THEN l_linenumber ELSE l_linenumber - 1 END AS ordinal, CASE WHEN l_partkey % 29 = 0 THEN '' ELSE CAST(l_partkey AS VARCHAR) END AS plan_id,
    CASE WHEN l_suppkey % 10 = 0 THEN 'other' WHEN l_suppkey % 2 = 0 THEN 'ein' ELSE 'hios' END AS plan_id_type FROM lineitem
), sets AS (SELECT o_orderkey AS set_id, n + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS plans FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
g AS (SELECT set_id, count(*) AS found, min(ordinal) AS lo, max(ordinal) AS hi, count(DISTINCT ordinal) AS d, count(*) FILTER (WHERE plan_id_type NOT IN ('ein', 'hios') OR plan_id = '') AS bad FROM entries GROUP BY 1)
SELECT set_id, plans, found, CASE WHEN found > 30000 THEN 'count' WHEN found <> plans THEN 'differs' WHEN lo <> 0 OR hi <> found - 1 OR d <> found THEN 'ordinals' WHEN bad > 0 THEN 'metadata' END AS problem
FROM sets JOIN g USING (set_id)""")
def plan_set_check(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey")
    entries = l.select(
        k.alias("set_id"), F.when(k % 7 == 0, F.col("l_linenumber")).otherwise(F.col("l_linenumber") - 1).alias("ordinal"),
        F.when(F.col("l_partkey") % 29 == 0, "").otherwise(F.col("l_partkey").cast("string")).alias("plan_id"),
        F.when(F.col("l_suppkey") % 10 == 0, "other").when(F.col("l_suppkey") % 2 == 0, "ein").otherwise("hios").alias("plan_id_type"))
    sizes = l.groupBy(k.alias("set_id")).agg(F.count("*").alias("n"))
    sets = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("set_id")).join(sizes, "set_id")
    return checks.set_problems(sets.select("set_id", (F.col("n") + F.when(F.col("set_id") % 5 == 0, 1).otherwise(0)).alias("plans")), entries)


def _members(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("https://files.example/"), (F.col("l_orderkey") % 50).cast("string")).alias("file_url"),
        (F.col("l_suppkey") + 1000000000).cast("string").alias("npi"), (F.col("l_partkey") % 100).cast("string").alias("tin"))


@query("""
SELECT file_url, count(*) AS pairs, count(DISTINCT npi) AS npis FROM (
  SELECT DISTINCT 'https://files.example/' || CAST(l_orderkey % 50 AS VARCHAR) AS file_url, l_suppkey AS npi, l_partkey % 100 AS tin FROM lineitem) GROUP BY 1""")
def membership_pair_counts(spark, sf_dir):
    return checks.pair_counts(_members(spark, sf_dir))


@query("SELECT CAST(l_suppkey + 1000000000 AS VARCHAR) AS npi, count(*) AS occurrences FROM lineitem GROUP BY 1")
def npi_occurrences(spark, sf_dir):
    return checks.occurrences(_members(spark, sf_dir))


@query("""
WITH p AS (
  SELECT c_custkey AS profile_id, CASE WHEN c_custkey % 8 = 0 THEN 'source_timeout' END AS unavailable,
    CASE WHEN c_nationkey % 3 = 0 THEN 'official_exchange_handoff' ELSE 'federal_plan_rows' END AS basis, c_custkey % 5 AS differences FROM customer
), r AS (SELECT o_custkey AS profile_id, o_orderkey % 4 AS differences FROM orders WHERE o_custkey IN (SELECT profile_id FROM p WHERE unavailable IS NULL))
SELECT (SELECT count(*) FROM p) AS planned, count(*) AS evaluated, (SELECT count(*) FROM p WHERE unavailable IS NOT NULL) AS unavailable,
  count(*) FILTER (WHERE basis = 'federal_plan_rows') AS quoted, count(*) FILTER (WHERE basis = 'official_exchange_handoff') AS handed_off,
  count(*) FILTER (WHERE differences > 0) AS mismatched_profiles, (SELECT count(*) FROM r) AS compared_rows, (SELECT count(*) FROM r WHERE differences > 0) AS mismatched_rows
FROM p WHERE unavailable IS NULL""")
def source_pair_report(spark, sf_dir):
    k = F.col("c_custkey")
    profiles = table(spark, sf_dir, "customer").select(
        k.alias("profile_id"), F.when(k % 8 == 0, "source_timeout").alias("unavailable"),
        F.when(F.col("c_nationkey") % 3 == 0, "official_exchange_handoff").otherwise("federal_plan_rows").alias("basis"), (k % 5).alias("differences"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("profile_id"), (F.col("o_orderkey") % 4).alias("differences"))
    return checks.run_report(profiles, rows)


@query("""
SELECT source_key, url, bytes, row_number() OVER (ORDER BY bytes NULLS LAST, url) AS rank FROM (
  SELECT o_orderkey AS source_key, 'https://files.example/' || CAST(o_orderkey AS VARCHAR) || '.json' AS url FROM orders
) LEFT JOIN (SELECT l_orderkey AS source_key, CAST(sum(l_partkey) % 1000 AS BIGINT) AS bytes FROM lineitem WHERE l_orderkey % 3 > 0 GROUP BY 1) USING (source_key)""")
def refresh_candidates(spark, sf_dir):
    urls = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source_key"), F.concat(F.lit("https://files.example/"), F.col("o_orderkey").cast("string"), F.lit(".json")).alias("url"))
    archives = table(spark, sf_dir, "lineitem").where("l_orderkey % 3 > 0").groupBy(F.col("l_orderkey").alias("source_key")).agg((F.sum("l_partkey") % 1000).cast("long").alias("bytes"))
    return checks.refresh_order(urls, archives)


@query("""
WITH v AS (
  SELECT o_custkey AS visitor, o_orderkey AS version, o_orderkey % 4 AS household_size, o_orderkey % 3 AS doctor_query, o_orderpriority AS plan_query, o_orderkey % 2 AS employer_query,
    'household' AS premium_basis, CAST(1000000000 + o_orderkey AS VARCHAR) AS npi, 'P' || CAST(o_orderkey AS VARCHAR) AS plan_id FROM orders
), l AS (
  SELECT *, row_number() OVER w = 1 AS opening, lag(household_size) OVER w AS h, lag(doctor_query) OVER w AS d, lag(plan_query) OVER w AS p, lag(employer_query) OVER w AS e FROM v WINDOW w AS (PARTITION BY visitor ORDER BY version)
)
SELECT visitor, version, CASE WHEN NOT opening AND h IS DISTINCT FROM household_size THEN 'unknown' ELSE premium_basis END AS premium_basis,
  CASE WHEN NOT opening AND d IS DISTINCT FROM doctor_query THEN '' ELSE npi END AS npi,
  CASE WHEN NOT opening AND (p IS DISTINCT FROM plan_query OR e IS DISTINCT FROM employer_query) THEN '' ELSE plan_id END AS plan_id FROM l""")
def context_versions(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("visitor"), k.alias("version"), (k % 4).alias("household_size"), (k % 3).alias("doctor_query"), F.col("o_orderpriority").alias("plan_query"), (k % 2).alias("employer_query"),
        F.lit("household").alias("premium_basis"), (k + 1000000000).cast("string").alias("npi"), F.concat(F.lit("P"), k.cast("string")).alias("plan_id"))
    return checks.reconcile_contexts(rows, ["visitor"], ["version"]).select("visitor", "version", "premium_basis", "npi", "plan_id")


_WORDS = "CASE {0} % 5 WHEN 0 THEN 'NotCovered' WHEN 1 THEN 'Covered' WHEN 2 THEN 'GenericCovered' WHEN 3 THEN '' END"


@query(f"""
SELECT p_partkey, CASE WHEN contains(lower(w), 'notcovered') THEN false WHEN contains(lower(w), 'covered') THEN true END AS covered,
  CASE WHEN p_size % 4 = 0 THEN 'RxCUI ' || CAST(p_partkey AS VARCHAR) ELSE p_name || ' (RxCUI ' || CAST(p_partkey AS VARCHAR) || ')' END AS label,
  trim(regexp_replace(regexp_replace(lower('Plans_' || p_name || '/' || p_brand || '-2024.TXT'), '[._/-]+', ' ', 'g'), '\\s+', ' ', 'g')) AS member
FROM (SELECT *, {_WORDS.format('p_partkey')} AS w FROM part)""")
def drug_labels(spark, sf_dir):
    name = F.when(F.col("p_size") % 4 == 0, "").otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", covered_flag(F.expr(_WORDS.format("p_partkey"))).alias("covered"), drug_label(F.col("p_partkey").cast("string"), name).alias("label"),
        member_name(F.concat(F.lit("Plans_"), "p_name", F.lit("/"), "p_brand", F.lit("-2024.TXT"))).alias("member"))


@query("""
SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN s_name || ' (NPI ' || CAST(s_suppkey AS VARCHAR) || ')' WHEN 1 THEN 'Ann ' || s_name || ' (NPI ' || CAST(s_suppkey AS VARCHAR) || ')'
  WHEN 2 THEN 'Ann (NPI ' || CAST(s_suppkey AS VARCHAR) || ')' ELSE 'NPI ' || CAST(s_suppkey AS VARCHAR) END AS label FROM supplier""")
def provider_labels(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", provider_label(
        k.cast("string"), F.when((k % 4).isin(1, 2), "Ann"), F.when(k % 4 == 1, F.col("s_name")).otherwise(""), F.when(k % 4 == 0, F.col("s_name"))).alias("label"))


@query("""
SELECT source_key, url, CASE WHEN source_key % 4 = 0 AND source_key % 3 = 0 AND source_key % 5 > 0 THEN 'blocked' WHEN source_key % 2 = 0 AND source_key % 7 > 0 AND source_key % 5 > 0 THEN 'prepared' ELSE 'fetch' END AS state,
  CASE WHEN source_key % 4 = 0 AND source_key % 3 = 0 AND source_key % 5 > 0 THEN 'scalar_limit' END AS reason
FROM (SELECT o_orderkey AS source_key, 'https://files.example/' || CAST(o_orderkey AS VARCHAR) AS url FROM orders)""")
def source_states(spark, sf_dir):
    k = F.col("source_key")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source_key"))
    etag, old = F.concat(F.lit("e"), k.cast("string")), F.concat(F.lit("old"), k.cast("string"))
    candidates = rows.select("source_key", F.concat(F.lit("https://files.example/"), k.cast("string")).alias("url"), F.when(k % 5 > 0, etag).alias("etag"))
    blocks = rows.where(k % 4 == 0).select("source_key", etag.alias("etag"), F.when(k % 3 == 0, "p2").otherwise("p1").alias("policy"), F.lit("scalar_limit").alias("reason"))
    prepared = rows.where(k % 2 == 0).select("source_key", F.when(k % 7 > 0, etag).otherwise(old).alias("etag"), F.lit("p2").alias("policy"))
    return checks.refresh_states(candidates, blocks, prepared, "p2").select("source_key", "url", "state", "reason")


@query("""
SELECT p_partkey, '{"10":[2,1.50,1E3],"9":{"a":null,"z":true},"name":"' || p_name || '","size":' || CAST(p_size AS VARCHAR) || '}' AS canonical FROM part""")
def canonical_documents(spark, sf_dir):
    written = F.concat(F.lit('{ "size": '), F.col("p_size").cast("string"), F.lit(',\n "9": {"z": true, "a": null}, "name": "'), "p_name", F.lit('", "10": [2, 1.50, 1E3] }'))
    return table(spark, sf_dir, "part").select("p_partkey", canonical_json(written).alias("canonical"))


def _pad(byte: int) -> str:
    return "".join(rf"\x{b ^ byte:02X}" for b in b"fixture-key".ljust(64, b"\0"))


@query(f"SELECT p_partkey, sha256('{_pad(0x5C)}'::BLOB || unhex(sha256('{_pad(0x36)}'::BLOB || encode(p_name)))) AS proof FROM part")
def source_proofs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", hmac_sha256(F.col("p_name"), b"fixture-key").alias("proof"))
