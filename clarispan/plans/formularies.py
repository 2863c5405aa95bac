"""Queries over drug formularies."""

from __future__ import annotations

from pyspark.sql import functions as F

from clarispan.operators import formulary
from clarispan.plans.base import query, table
from clarispan.policy import PDP_REGIONS

STATES = sorted(s for v in PDP_REGIONS.values() for s in v.split())


def state_of(key):
    return F.get(F.array(*[F.lit(s) for s in STATES]), (key % len(STATES)).cast("int"))


def drug_plans(spark, sf_dir):
    """Stand-alone (S) and other (H) plans of suppliers."""
    k = F.col("s_suppkey")
    contract = F.concat(F.when(k % 4 > 0, "S").otherwise("H"), F.lpad((F.col("s_nationkey") * 7 + 1000).cast("string"), 4, "0"))
    rows = table(spark, sf_dir, "supplier").select(
        contract.alias("contract_id"), F.lpad((k % 1000).cast("string"), 3, "0").alias("plan_id"), F.lit("000").alias("segment_id"), F.lit(2026).alias("contract_year"),
        F.col("s_name").alias("plan_name"), (k % 40).alias("formulary_id"), state_of(k).alias("state"), k.alias("plan_key"))
    return formulary.regions_of(rows)


def formulary_drugs(spark, sf_dir):
    """Listed drugs: the first line of each (formulary, drug)."""
    l = table(spark, sf_dir, "lineitem")
    flag = lambda c, yes, no: F.when(F.col(c) == yes, True).when(F.col(c) == no, False)
    rows = l.select(
        (F.col("l_suppkey") % 40).alias("formulary_id"), F.lit(2026).alias("contract_year"), (F.col("l_partkey") % 200).cast("string").alias("rxcui"), F.when(F.col("l_linenumber") < 7, F.col("l_linenumber")).alias("tier"),
        flag("l_returnflag", "A", "R").alias("prior_authorization"), flag("l_linestatus", "F", "O").alias("step_therapy"), F.when(F.col("l_tax") > 0.02, True).alias("quantity_limit"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_tax").alias("ord"))
    g = rows.groupBy("formulary_id", "contract_year", "rxcui").agg(F.min_by(F.struct("tier", *formulary.RESTRICTIONS), "ord").alias("d"))
    return g.select("formulary_id", "contract_year", "rxcui", "d.*")


_STATE_LIST = "[" + ", ".join(f"'{s}'" for s in STATES) + "]"
_REGION = "CASE state " + " ".join(f"WHEN '{s}' THEN {r}" for r, v in PDP_REGIONS.items() for s in v.split()) + " END"
DRUG_PLANS = f"""
dp AS (
  SELECT (CASE WHEN s_suppkey % 4 > 0 THEN 'S' ELSE 'H' END) || lpad(CAST(s_nationkey * 7 + 1000 AS VARCHAR), 4, '0') AS contract_id, lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0') AS plan_id, '000' AS segment_id,
    2026 AS contract_year, s_name AS plan_name, s_suppkey % 40 AS formulary_id, ({_STATE_LIST})[s_suppkey % {len(STATES)} + 1] AS state, s_suppkey AS plan_key FROM supplier
), drug_plans AS (SELECT *, {_REGION} AS region FROM dp)"""
DRUGS = """
drugs AS (
  SELECT l_suppkey % 40 AS formulary_id, 2026 AS contract_year, CAST(l_partkey % 200 AS VARCHAR) AS rxcui, CASE WHEN l_linenumber < 7 THEN l_linenumber END AS tier,
    CASE l_returnflag WHEN 'A' THEN true WHEN 'R' THEN false END AS prior_authorization, CASE l_linestatus WHEN 'F' THEN true WHEN 'O' THEN false END AS step_therapy, CASE WHEN l_tax > 0.02 THEN true END AS quantity_limit
  FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey % 40, l_partkey % 200 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_tax) = 1
)"""


@query("WITH" + DRUGS + "\nSELECT * FROM drugs")
def formulary_drug_list(spark, sf_dir):
    return formulary_drugs(spark, sf_dir)


@query("WITH" + DRUG_PLANS + "\nSELECT state, region, count(*) AS plans FROM drug_plans GROUP BY ALL")
def plan_regions(spark, sf_dir):
    return drug_plans(spark, sf_dir).groupBy("state", "region").agg(F.count("*").alias("plans"))


@query("WITH" + DRUG_PLANS + "," + DRUGS + """,
requests AS (
  SELECT c_custkey AS request_id, CASE WHEN c_custkey % 5 = 0 THEN 'S9999' ELSE contract_id END AS contract_id, plan_id, CAST(c_custkey % 230 AS VARCHAR) AS rxcui
  FROM customer JOIN drug_plans ON plan_key = c_custkey % 97
)
SELECT request_id, r.contract_id, r.plan_id, r.rxcui, CASE WHEN p.formulary_id IS NULL THEN 'unknown' WHEN d.rxcui IS NOT NULL THEN 'yes' ELSE 'no' END AS value, CAST(tier AS VARCHAR) AS tier
FROM requests r LEFT JOIN drug_plans p ON r.contract_id = p.contract_id AND r.plan_id = p.plan_id LEFT JOIN drugs d ON d.formulary_id = p.formulary_id AND d.contract_year = p.contract_year AND d.rxcui = r.rxcui""")
def formulary_answer(spark, sf_dir):
    plans = drug_plans(spark, sf_dir)
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request_id"), (F.col("c_custkey") % 97).alias("plan_key"), (F.col("c_custkey") % 230).cast("string").alias("rxcui"))
    asked = asked.join(plans.select("plan_key", "contract_id", "plan_id"), "plan_key")
    asked = asked.select("request_id", F.when(F.col("request_id") % 5 == 0, "S9999").otherwise(F.col("contract_id")).alias("contract_id"), "plan_id", "rxcui")
    return formulary.answer(asked, plans, formulary_drugs(spark, sf_dir))


METRICS = "WITH" + DRUG_PLANS + "," + DRUGS + """,
m AS (
  SELECT formulary_id, count(*) AS listed, count(*) FILTER (WHERE coalesce(prior_authorization, false) OR coalesce(step_therapy, false) OR coalesce(quantity_limit, false)) AS restricted_drugs,
    CAST(sum(CAST(coalesce(prior_authorization, false) AS INTEGER) + CAST(coalesce(step_therapy, false) AS INTEGER) + CAST(coalesce(quantity_limit, false) AS INTEGER)) AS BIGINT) AS restriction_flags,
    floor(CAST(sum(tier) AS DOUBLE) / count(tier) * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS average_tier
  FROM drugs WHERE rxcui IN ('1', '2', '3', '4', '5', '77') GROUP BY formulary_id
), s AS (
  SELECT plan_name, contract_id, plan_id, segment_id, region, coalesce(listed, 0) AS listed, coalesce(restricted_drugs, 0) AS restricted_drugs, coalesce(restriction_flags, 0) AS restriction_flags, average_tier
  FROM drug_plans LEFT JOIN m USING (formulary_id) WHERE regexp_full_match(contract_id, 'S[0-9]{4}')
)
"""


def _rxcuis(spark):
    return spark.createDataFrame([(r,) for r in ("1", "2", "3", "4", "5", "77")], "rxcui string")


@query(METRICS + "SELECT * FROM s")
def shortlist_metrics(spark, sf_dir):
    plans = drug_plans(spark, sf_dir).where(F.col("contract_id").rlike(r"^S\d{4}$"))
    return formulary.shortlist_metrics(plans, formulary_drugs(spark, sf_dir), _rxcuis(spark)).select("plan_name", "contract_id", "plan_id", "segment_id", "region", *formulary.SHORTLIST_COLUMNS[:4])


@query(METRICS + """SELECT plan_name, contract_id, plan_id, segment_id, listed, restricted_drugs, restriction_flags, average_tier FROM s WHERE region = 25
ORDER BY listed DESC, restricted_drugs, restriction_flags, average_tier NULLS LAST, plan_name, contract_id, plan_id, segment_id LIMIT 12""")
def partd_shortlist_top12(spark, sf_dir):
    found = formulary.shortlist(drug_plans(spark, sf_dir), formulary_drugs(spark, sf_dir), _rxcuis(spark), F.col("region") == 25)
    return found.select("plan_name", "contract_id", "plan_id", "segment_id", *formulary.SHORTLIST_COLUMNS[:4])


@query("WITH" + DRUG_PLANS + """
SELECT plan_name, contract_id, plan_id, segment_id FROM drug_plans WHERE contract_year = 2026 AND (coalesce(state = 'CA', false) OR coalesce(region = 25, false))
  AND (contains(lower(plan_name), '00') OR starts_with(contract_id, '00') OR starts_with(plan_id, '00')) ORDER BY plan_name, contract_id, plan_id, segment_id LIMIT 12""")
def partd_plan_search(spark, sf_dir):
    return formulary.search(drug_plans(spark, sf_dir), 2026, "CA", 25, "00").select("plan_name", "contract_id", "plan_id", "segment_id")


def suggestion_responses(spark, sf_dir):
    k = F.col("p_partkey")
    form = F.when(k % 3 == 0, "(Oral Pill)").when(k % 3 == 1, "Oral Liquid").otherwise("Injectable")
    item = F.struct(k.alias("k"), F.col("p_name").alias("n"), F.array(form).alias("f"), F.array(F.when(k % 7 != 0, F.col("p_size").cast("string"))).alias("r"))
    response = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("response_id")).agg(F.array_sort(F.collect_list(item)).alias("x"))
    return response.select("response_id", F.col("x.n").alias("names"), F.col("x.f").alias("forms"), F.col("x.r").alias("rxcuis"))


@query("""
WITH p AS (SELECT p_brand AS response_id, p_partkey, p_name, p_type, CAST(p_size AS VARCHAR) AS rxcui FROM part),
l AS (SELECT response_id, rxcui, p_name || ' ' || CASE p_partkey % 3 WHEN 0 THEN '(Oral Pill)' WHEN 1 THEN 'Oral Liquid' ELSE 'Injectable' END AS label, p_partkey FROM p WHERE p_partkey % 7 <> 0)
SELECT response_id, rxcui, label, CASE WHEN contains(lower(label), '(oral pill)') THEN 0.0::DOUBLE WHEN contains(lower(label), 'oral') THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS rank
FROM l QUALIFY row_number() OVER (PARTITION BY response_id, rxcui ORDER BY p_partkey) = 1""")
def drug_suggestions(spark, sf_dir):
    return formulary.flatten_suggestions(suggestion_responses(spark, sf_dir)).select("response_id", "rxcui", "label", "rank")
