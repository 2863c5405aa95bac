"""Queries over sources' answers: reconciliation, matching, verification, health systems."""

from __future__ import annotations

from pyspark.sql import functions as F

from clarispan.operators import bridge, issuer_files, matching, provenance, reconcile, verify
from clarispan.plans.base import AS_OF, ANSWERS, CLAIMS, MATCHED, as_of, claims, household, query, reconciled_sql, system_tags, table

VERDICT_COLUMNS = ["kind", "subject_key", "plan_id", "verdict", "known_count", "yes_count", "no_count", "consensus", "reconciled_confidence", "agrees_with", "conflicts_with"]


def answers(spark, sf_dir):
    return provenance.make_answers(claims(spark, sf_dir))


def matched(spark, sf_dir):
    plans = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 200).cast("string").alias("plan_id"))
    return matching.match_subjects(household(spark), plans, answers(spark, sf_dir))


@query("WITH" + ANSWERS + """
SELECT kind, source, value, confidence, count(*) AS n, CAST(sum(floor(confidence * 100 + 0.5)) AS BIGINT) AS cents FROM answers GROUP BY ALL""")
def answer_confidence(spark, sf_dir):
    cents = F.sum(F.floor(F.col("confidence") * 100 + 0.5))
    return answers(spark, sf_dir).groupBy("kind", "source", "value", "confidence").agg(F.count("*").alias("n"), cents.alias("cents"))


@query("WITH" + ANSWERS + """
SELECT rendered, count(*) AS n FROM (
  SELECT subject_key || CASE WHEN value = 'unknown' THEN ': coverage unknown; no verified answer available from ' WHEN value = 'yes' THEN ': shown in-network per ' ELSE ': shown NOT covered per ' END
    || source || ', source updated ' || strftime(source_last_updated, '%Y-%m-%d') || ' (' || CAST(CAST(floor(confidence * 100 + 0.5) AS BIGINT) AS VARCHAR) || '% confidence).'
    || CASE WHEN value = 'unknown' OR confidence < 0.8 THEN ' - confirm before enrolling.' ELSE '' END AS rendered
  FROM answers) GROUP BY rendered""")
def render_answers(spark, sf_dir):
    return provenance.render(answers(spark, sf_dir)).groupBy("rendered").agg(F.count("*").alias("n"))


@query("WITH" + ANSWERS + reconciled_sql("answers", "rec") + f"\nSELECT {', '.join(VERDICT_COLUMNS)} FROM rec")
def reconcile_verdicts(spark, sf_dir):
    return reconcile.reconcile(answers(spark, sf_dir))


@query("WITH" + ANSWERS + """
, votes AS (
  SELECT kind, subject_key, plan_id, list(source) FILTER (WHERE value = 'yes') AS fy, list(source) FILTER (WHERE value = 'no') AS fn FROM answers GROUP BY ALL
), s AS (
  SELECT kind, subject_key, plan_id, source, value, CASE value WHEN 'yes' THEN fy ELSE fn END AS same, CASE value WHEN 'yes' THEN fn ELSE fy END AS other
  FROM answers JOIN votes USING (kind, subject_key, plan_id) WHERE value <> 'unknown'
)
SELECT kind, subject_key, plan_id, source, value,
  array_to_string(list_sort(same[1:list_position(same, source) - 1] || same[list_position(same, source) + 1:]), ',') AS agrees_with,
  coalesce(array_to_string(list_sort(other), ','), '') AS conflicts_with, count(*) AS n
FROM s GROUP BY ALL""")
def answer_stamps(spark, sf_dir):
    return reconcile.stamps(answers(spark, sf_dir))


@query("WITH" + ANSWERS + reconciled_sql("answers", "rec") + """
SELECT kind, count(*) AS total, count(*) FILTER (WHERE verdict = 'AGREE') AS agree, count(*) FILTER (WHERE verdict = 'CONFLICT') AS conflict,
  count(*) FILTER (WHERE verdict = 'SINGLE_SOURCE') AS single_source, count(*) FILTER (WHERE verdict = 'ALL_UNKNOWN') AS all_unknown,
  count(*) FILTER (WHERE verdict = 'AGREE') / nullif(count(*) FILTER (WHERE verdict IN ('AGREE', 'CONFLICT')), 0) AS agreement_rate
FROM rec GROUP BY kind""")
def reconcile_summary(spark, sf_dir):
    return reconcile.summarize(reconcile.reconcile(answers(spark, sf_dir)), ["kind"])


@query("WITH" + ANSWERS + """
, two AS (SELECT * FROM answers WHERE source <> 'CMS_PARTD')""" + reconciled_sql("two", "rec") + """
SELECT CASE verdict WHEN 'SINGLE_SOURCE' THEN (CASE WHEN api_known THEN 'API_ONLY' ELSE 'MRF_ONLY' END) WHEN 'ALL_UNKNOWN' THEN 'BOTH_UNKNOWN' ELSE verdict END AS verdict,
  consensus, reconciled_confidence, count(*) AS n FROM rec GROUP BY ALL""")
def reconcile_two_way(spark, sf_dir):
    rows = reconcile.two_way(answers(spark, sf_dir).where("source <> 'CMS_PARTD'"))
    return rows.groupBy("verdict", "consensus", "reconciled_confidence").agg(F.count("*").alias("n"))


@query("WITH" + ANSWERS + """
SELECT n_name AS nation, s.source AS source, count(*) AS answers, count(*) FILTER (WHERE value = 'yes') AS yes, count(*) FILTER (WHERE value <> 'unknown') AS known
FROM answers s JOIN supplier ON s.kind = 'PROVIDER' AND s.subject_key = lpad(CAST(s_suppkey + 1000000000 AS VARCHAR), 10, '0') JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL""")
def agreement_rate_by_source(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier").select(F.lpad((F.col("s_suppkey") + 1000000000).cast("string"), 10, "0").alias("subject_key"), "s_nationkey")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("nation"))
    rows = answers(spark, sf_dir).where("kind = 'PROVIDER'").join(supplier, "subject_key").join(nation, "s_nationkey")
    known = F.col("value") != "unknown"
    return rows.groupBy("nation", "source").agg(F.count("*").alias("answers"), F.count_if(F.col("value") == "yes").alias("yes"), F.count_if(known).alias("known"))


@query("WITH" + MATCHED + "\nSELECT kind, subject_key, plan_id, verdict, consensus, status, reconciled_confidence, confirm FROM matched")
def match_subjects(spark, sf_dir):
    return matched(spark, sf_dir).drop("mrf_updated")


ROLLED = MATCHED + """,
rolled AS (
  SELECT plan_id,
    count(*) FILTER (WHERE kind = 'PROVIDER' AND status LIKE 'covered%') AS doctors_covered, count(*) FILTER (WHERE kind = 'PROVIDER' AND status = 'disputed') AS doctors_disputed,
    count(*) FILTER (WHERE kind = 'PROVIDER' AND status LIKE 'not_covered%') AS doctors_not_covered, count(*) FILTER (WHERE kind = 'PROVIDER' AND status = 'unknown') AS doctors_unknown,
    count(*) FILTER (WHERE kind = 'PROVIDER') AS doctors_total,
    count(*) FILTER (WHERE kind = 'DRUG' AND status LIKE 'covered%') AS drugs_covered, count(*) FILTER (WHERE kind = 'DRUG' AND status = 'disputed') AS drugs_disputed,
    count(*) FILTER (WHERE kind = 'DRUG' AND status LIKE 'not_covered%') AS drugs_not_covered, count(*) FILTER (WHERE kind = 'DRUG' AND status = 'unknown') AS drugs_unknown,
    count(*) FILTER (WHERE kind = 'DRUG') AS drugs_total,
    floor(sum(floor((CASE status WHEN 'covered' THEN reconciled_confidence WHEN 'covered_unverified' THEN reconciled_confidence * 0.6::DOUBLE WHEN 'disputed' THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END) * 10000.0::DOUBLE + 0.5::DOUBLE)) / count(*) / 10000.0::DOUBLE * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS match_score,
    floor(sum(floor(reconciled_confidence * 100.0::DOUBLE + 0.5::DOUBLE)) / count(*) / 100.0::DOUBLE * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS network_confidence,
    coalesce(array_to_string(list_sort(list(kind || ':' || subject_key) FILTER (WHERE confirm)), ','), '') AS confirm_list
  FROM matched GROUP BY plan_id
)"""


@query("WITH" + ROLLED + "\nSELECT * FROM rolled")
def match_rollup(spark, sf_dir):
    return matching.roll_up(matched(spark, sf_dir))


@query("WITH" + ROLLED + "\nSELECT plan_id, match_score, network_confidence, CAST(row_number() OVER (ORDER BY match_score DESC, network_confidence DESC, plan_id) AS INTEGER) AS rank FROM rolled QUALIFY rank <= 25")
def match_rank(spark, sf_dir):
    return matching.rank_matches(matching.roll_up(matched(spark, sf_dir)), 25).select("plan_id", "match_score", "network_confidence", "rank")


@query("WITH" + ROLLED + "\nSELECT plan_id, match_score, network_confidence, row_number() OVER (ORDER BY match_score DESC, network_confidence DESC, plan_id) AS rank FROM rolled")
def match_rank_all(spark, sf_dir):
    return matching.rank_matches(matching.roll_up(matched(spark, sf_dir))).select("plan_id", "match_score", "network_confidence", "rank")


@query("WITH" + MATCHED + """
SELECT kind, subject_key, plan_id, CASE WHEN verdict = 'CONFLICT' THEN 'conflict' WHEN status = 'unknown' THEN 'unknown' WHEN status LIKE '%\\_unverified' ESCAPE '\\' THEN 'unverified' ELSE 'low_confidence' END AS reason
FROM matched WHERE confirm""")
def confirm_list(spark, sf_dir):
    return matching.confirm_list(matched(spark, sf_dir))


FRESH_PART = f""",
fresh AS (
  SELECT plan_id, strftime(min(mrf_updated), '%Y-%m-%d') AS oldest, strftime(max(mrf_updated), '%Y-%m-%d') AS newest, count(mrf_updated) AS dated,
    count(*) FILTER (WHERE (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(mrf_updated)) / 86400000000.0::DOUBLE > 180) AS stale
  FROM matched GROUP BY plan_id
)"""
FRESH = MATCHED + FRESH_PART


@query("WITH" + FRESH + "\nSELECT * FROM fresh")
def freshness_summary(spark, sf_dir):
    return verify.freshness_summary(matched(spark, sf_dir), as_of())


GRADES_PART = """
, c AS (
  SELECT plan_id, count(*) AS total, count(*) FILTER (WHERE verdict = 'AGREE') AS verified, count(*) FILTER (WHERE verdict = 'CONFLICT') AS conflicts,
    count(*) FILTER (WHERE verdict IN ('API_ONLY', 'MRF_ONLY')) AS single_source, count(*) FILTER (WHERE verdict = 'BOTH_UNKNOWN') AS unknown,
    sum(floor(reconciled_confidence * 100.0::DOUBLE + 0.5::DOUBLE)) / count(*) / 100.0::DOUBLE AS mean FROM matched GROUP BY plan_id
), s AS (
  SELECT c.*, stale, least(1.0::DOUBLE, greatest(0.0::DOUBLE, floor((mean - CASE WHEN dated > 0 THEN stale / dated * 0.1::DOUBLE ELSE 0.0::DOUBLE END) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE)) AS score
  FROM c JOIN fresh USING (plan_id)
), graded AS (
  SELECT plan_id, total, verified, conflicts, single_source, unknown, stale, score, CASE WHEN score >= 0.85 THEN 'A' WHEN score >= 0.7 THEN 'B' WHEN score >= 0.5 THEN 'C' WHEN score >= 0.3 THEN 'D' ELSE 'F' END AS grade FROM s
)"""


@query("WITH" + FRESH + GRADES_PART + "\nSELECT * FROM graded")
def verify_grades(spark, sf_dir):
    return verify.verify_plans(matched(spark, sf_dir), as_of())


@query("WITH" + FRESH + GRADES_PART + """
, todo AS (SELECT plan_id, count(*) FILTER (WHERE confirm) AS confirm FROM matched GROUP BY plan_id)
SELECT plan_id, confirm, concat_ws(' · ',
  format('Network confidence {} ({}%): {} of {} answers corroborated across both sources', grade, CAST(floor(score * 100.0::DOUBLE + 0.5::DOUBLE) AS BIGINT), verified, total),
  nullif(concat_ws(', ', CASE conflicts WHEN 0 THEN NULL WHEN 1 THEN '1 conflict' ELSE format('{} conflicts', conflicts) END,
    CASE WHEN single_source > 0 THEN format('{} one-sided', single_source) END, CASE WHEN unknown > 0 THEN format('{} unknown', unknown) END), ''),
  CASE WHEN oldest = newest THEN 'issuer data as of ' || newest ELSE 'issuer data ' || oldest || '–' || newest END || CASE WHEN fresh.stale > 0 THEN format(' ({} stale)', fresh.stale) ELSE '' END,
  CASE confirm WHEN 0 THEN 'Nothing flagged to confirm, but verify with the provider before enrolling.' WHEN 1 THEN 'Confirm 1 item with the provider/plan before enrolling.'
    ELSE format('Confirm {} items with the provider/plan before enrolling.', confirm) END) AS headline
FROM graded JOIN fresh USING (plan_id) JOIN todo USING (plan_id)""")
def verify_headlines(spark, sf_dir):
    return verify.headlines(matched(spark, sf_dir), as_of())


@query("WITH" + MATCHED + """
SELECT kind, subject_key, plan_id, CASE WHEN verdict = 'CONFLICT' THEN 'conflict' WHEN status = 'unknown' THEN 'unknown' WHEN status LIKE '%\\_unverified' ESCAPE '\\' THEN 'unverified' ELSE 'low_confidence' END AS reason,
  CASE kind WHEN 'PROVIDER' THEN format('Call NPI {}''s office and confirm they are in-network for {} (and accepting new patients).', subject_key, plan_id)
    ELSE format('Ask {} or your pharmacy to confirm RxCUI {} is on the formulary and at what tier (and any prior authorization).', plan_id, subject_key) END AS action
FROM matched WHERE confirm""")
def confirm_checklist(spark, sf_dir):
    return verify.checklist(matched(spark, sf_dir))


SYSTEMS = MATCHED + """,
own AS (SELECT subject_key, arg_max(system, ord) AS system, bool_or(critical) AS critical FROM tags GROUP BY subject_key),
required AS (SELECT DISTINCT system FROM tags), offered AS (SELECT DISTINCT plan_id FROM matched),
systems AS (
  SELECT plan_id, system, count(*) AS total, count(*) FILTER (WHERE status LIKE 'covered%') AS covered, count(*) FILTER (WHERE status = 'covered') AS firm,
    count(*) FILTER (WHERE status = 'unknown') AS unk, sum(floor(reconciled_confidence * 100.0::DOUBLE + 0.5::DOUBLE)) AS cents, count(*) FILTER (WHERE confirm) AS confirm
  FROM matched JOIN own USING (subject_key) WHERE kind = 'PROVIDER' GROUP BY plan_id, system
), named AS (
  SELECT plan_id, system, coalesce(total, 0) AS total, coalesce(covered, 0) AS covered, coalesce(floor(cents / total / 100.0::DOUBLE * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE, 0.0::DOUBLE) AS confidence, coalesce(confirm, 0) AS confirm,
    CASE WHEN total IS NULL THEN 'unknown' WHEN covered = 0 THEN (CASE WHEN unk = total THEN 'unknown' ELSE 'not_covered' END) WHEN covered < total THEN 'partial' WHEN firm = total THEN 'covered' ELSE 'covered_unverified' END AS system_status
  FROM offered CROSS JOIN required LEFT JOIN systems USING (plan_id, system)
)"""


@query("WITH" + SYSTEMS + "\nSELECT * EXCLUDE (confirm) FROM named")
def system_coverage(spark, sf_dir):
    return bridge.system_coverage(matched(spark, sf_dir), system_tags(spark))


BRIDGES = SYSTEMS + """,
k AS (SELECT *, system_status IN ('covered', 'covered_unverified') AS keep FROM named),
g AS (
  SELECT plan_id, count(*) AS systems, count(*) FILTER (WHERE keep) AS kept_count, CAST(sum(covered) AS BIGINT) AS any_covered, CAST(sum(confirm) AS BIGINT) AS confirm,
    coalesce(list_sort(list(system) FILTER (WHERE keep)), []) AS kept, coalesce(list_sort(list(system) FILTER (WHERE NOT keep)), []) AS lost, min(confidence) FILTER (WHERE keep) AS least,
    coalesce(floor(sum(floor(confidence * 100.0::DOUBLE + 0.5::DOUBLE)) FILTER (WHERE keep) / count(*) FILTER (WHERE keep) / 100.0::DOUBLE * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE, 0.0::DOUBLE) AS mean_kept
  FROM k GROUP BY plan_id
), c AS (
  SELECT plan_id, coalesce(list_sort(list(subject_key) FILTER (WHERE kind = 'PROVIDER' AND critical AND status NOT LIKE 'covered%')), []) AS gaps FROM matched LEFT JOIN own USING (subject_key) GROUP BY plan_id
), w AS (SELECT count(DISTINCT subject_key) FILTER (WHERE critical) AS critical_total FROM tags),
bridges AS (
  SELECT plan_id, array_to_string(kept, ',') AS kept, array_to_string(lost, ',') AS lost, array_to_string(gaps, ',') AS critical_gaps,
    CASE WHEN kept_count > 0 AND kept_count = systems THEN 'bridges_all' WHEN kept_count > 0 THEN 'single_system' WHEN any_covered > 0 THEN 'partial' ELSE 'none' END AS bridge_status,
    floor((kept_count + 0.3::DOUBLE * (CASE WHEN critical_total > 0 THEN (critical_total - len(gaps)) / critical_total ELSE 1.0::DOUBLE END) + 0.1::DOUBLE * mean_kept) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS bridge_score,
    CASE WHEN kept_count > 0 AND kept_count = systems THEN 'Keeps every system in-network (' || array_to_string(kept, ' + ') || ') — shown in-network at ≥' || CAST(CAST(floor(least * 100 + 0.5) AS BIGINT) AS VARCHAR) || '% confidence'
      WHEN kept_count > 0 THEN 'Keeps ' || array_to_string(kept, ', ') || ' but drops ' || array_to_string(lost, ', ') WHEN any_covered > 0 THEN 'No system kept whole — only some providers shown in-network' ELSE 'Keeps none of your doctors in-network' END
      || CASE WHEN len(gaps) > 0 THEN ' · ⚠️ puts a must-keep provider out-of-network: NPI ' || array_to_string(gaps, ', NPI ') ELSE '' END
      || CASE WHEN confirm > 1 THEN ' · confirm ' || CAST(confirm AS VARCHAR) || ' providers with the office(s) before enrolling' WHEN confirm = 1 THEN ' · confirm 1 provider with the office(s) before enrolling' ELSE ' · still confirm directly with each office before enrolling' END AS headline
  FROM g JOIN c USING (plan_id) CROSS JOIN w
)"""


@query("WITH" + BRIDGES + "\nSELECT * FROM bridges")
def bridge_status(spark, sf_dir):
    return bridge.bridge_plans(matched(spark, sf_dir), system_tags(spark))


@query("WITH" + BRIDGES + "\nSELECT plan_id, bridge_status, bridge_score, row_number() OVER (ORDER BY bridge_score DESC, plan_id) AS rank FROM bridges")
def bridge_rank(spark, sf_dir):
    return bridge.rank_bridges(bridge.bridge_plans(matched(spark, sf_dir), system_tags(spark))).select("plan_id", "bridge_status", "bridge_score", "rank")


@query("WITH" + CLAIMS + """,
records AS (SELECT kind, subject_key, bool_or(value = 'yes' AND plan_id = '7') AS listed FROM claims WHERE source = 'ISSUER_MRF' GROUP BY ALL),
asked AS (SELECT DISTINCT kind, subject_key FROM claims UNION SELECT 'DRUG', 'none')
SELECT kind, subject_key, '7' AS plan_id, CASE WHEN listed IS NULL THEN 'unknown' WHEN listed THEN 'yes' ELSE 'no' END AS value FROM asked LEFT JOIN records USING (kind, subject_key)""")
def issuer_file_lookup(spark, sf_dir):
    """Every subject and one without a record, against the issuer's records; a record without the plan is a no."""
    every = claims(spark, sf_dir)
    asked = every.select("kind", "subject_key").union(spark.createDataFrame([("DRUG", "none")], "kind string, subject_key string")).distinct().withColumn("plan_id", F.lit("7"))
    records = every.where("source = 'ISSUER_MRF'").groupBy("kind", "subject_key").agg(F.collect_set(F.when(F.col("value") == "yes", F.col("plan_id"))).alias("plans"))
    records = records.withColumns({"last_updated_on": F.lit(AS_OF), "ord": F.lit(0)})
    return issuer_files.issuer_answers(asked, records, as_of()).select("kind", "subject_key", "plan_id", "value")
