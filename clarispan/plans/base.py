"""Registration of queries and the driver tables in the shapes that the operators take.

Each shape has a DataFrame and, for the comparison, the same rows as SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
AS_OF = "1999-01-01 00:00:00"


def query(sql: str | None = None):
    """Registers a query, and the SQL with its rows."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    stamps = {c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"}
    return df.withColumns(stamps) if stamps else df


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources' claims: (kind, subject_key, plan_id, source, value, fetched_at, source_last_updated)."""
    l = table(spark, sf_dir, "lineitem")
    source = F.when(F.col("l_linenumber") % 3 == 0, "MARKETPLACE_API").when(F.col("l_linenumber") % 3 == 1, "ISSUER_MRF").otherwise("CMS_PARTD")
    value = F.when(F.col("l_returnflag") == "A", "yes").when(F.col("l_returnflag") == "R", "no").otherwise("unknown")
    subject = F.explode(F.array(
        F.struct(F.lit("PROVIDER").alias("kind"), F.lpad((F.col("l_suppkey") + 1000000000).cast("string"), 10, "0").alias("key")),
        F.struct(F.lit("DRUG").alias("kind"), (F.col("l_partkey") % 20).cast("string").alias("key"))))
    rows = l.select(
        subject.alias("s"), (F.col("l_orderkey") % 200).cast("string").alias("plan_id"), source.alias("source"), value.alias("value"),
        F.expr("timestampadd(DAY, l_orderkey % 365, l_shipdate)").alias("fetched_at"), F.col("l_shipdate").alias("source_last_updated"))
    return rows.select("s.kind", F.col("s.key").alias("subject_key"), "plan_id", "source", "value", "fetched_at", "source_last_updated")


CLAIMS = """
claims AS (
  SELECT k.kind, CASE k.kind WHEN 'PROVIDER' THEN lpad(CAST(l_suppkey + 1000000000 AS VARCHAR), 10, '0') ELSE CAST(l_partkey % 20 AS VARCHAR) END AS subject_key,
    CAST(l_orderkey % 200 AS VARCHAR) AS plan_id,
    CASE l_linenumber % 3 WHEN 0 THEN 'MARKETPLACE_API' WHEN 1 THEN 'ISSUER_MRF' ELSE 'CMS_PARTD' END AS source,
    CASE l_returnflag WHEN 'A' THEN 'yes' WHEN 'R' THEN 'no' ELSE 'unknown' END AS value,
    CAST(l_shipdate AS TIMESTAMP) + to_days(CAST(l_orderkey % 365 AS INTEGER)) AS fetched_at, CAST(l_shipdate AS TIMESTAMP) AS source_last_updated
  FROM lineitem CROSS JOIN (VALUES ('PROVIDER'), ('DRUG')) k(kind)
)"""
ANSWERS = CLAIMS + """,
answers AS (
  SELECT *, CASE WHEN value = 'unknown' THEN 0.05::DOUBLE ELSE
    floor((CASE source WHEN 'ISSUER_MRF' THEN 0.6::DOUBLE WHEN 'CMS_PARTD' THEN 0.65::DOUBLE ELSE 0.55::DOUBLE END)
      * (CASE WHEN fetched_at > source_last_updated THEN pow(0.5::DOUBLE, (epoch_us(fetched_at) - epoch_us(source_last_updated)) / 86400000000.0::DOUBLE / 90.0::DOUBLE) ELSE 1.0::DOUBLE END) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE END AS confidence
  FROM claims
)"""


def reconciled_sql(source: str, name: str) -> str:
    """A common table expression with the rows of reconcile()."""
    return f""",
{name}_g AS (
  SELECT kind, subject_key, plan_id, count(*) FILTER (WHERE value <> 'unknown') AS known_count, count(*) FILTER (WHERE value = 'yes') AS yes_count,
    count(*) FILTER (WHERE value = 'no') AS no_count, max(confidence) FILTER (WHERE value <> 'unknown') AS top, min(confidence) FILTER (WHERE value <> 'unknown') AS low,
    max(value) FILTER (WHERE value <> 'unknown') AS v, coalesce(array_to_string(list_sort(list(source) FILTER (WHERE value <> 'unknown')), ','), '') AS sources,
    bool_or(source = 'MARKETPLACE_API' AND value <> 'unknown') AS api_known
  FROM {source} GROUP BY kind, subject_key, plan_id
), {name} AS (
  SELECT kind, subject_key, plan_id,
    CASE WHEN known_count = 0 THEN 'ALL_UNKNOWN' WHEN known_count = 1 THEN 'SINGLE_SOURCE' WHEN yes_count = 0 OR no_count = 0 THEN 'AGREE' ELSE 'CONFLICT' END AS verdict,
    known_count, yes_count, no_count, CASE WHEN known_count = 0 OR (yes_count > 0 AND no_count > 0) THEN 'unknown' ELSE v END AS consensus,
    CASE WHEN known_count = 0 THEN 0.05::DOUBLE WHEN known_count = 1 THEN floor(top * 0.9::DOUBLE * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE
      WHEN yes_count = 0 OR no_count = 0 THEN floor(least(0.95::DOUBLE, top + (known_count - 1) * 0.2::DOUBLE) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE
      ELSE floor(low * 0.5::DOUBLE * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE END AS reconciled_confidence,
    CASE WHEN known_count > 1 AND NOT (yes_count > 0 AND no_count > 0) THEN sources ELSE '' END AS agrees_with,
    CASE WHEN yes_count > 0 AND no_count > 0 THEN sources ELSE '' END AS conflicts_with, api_known
  FROM {name}_g
)"""


def household(spark: SparkSession) -> DataFrame:
    rows = [("PROVIDER", f"10000000{i:02d}") for i in range(8)] + [("DRUG", str(i)) for i in range(3)]
    return spark.createDataFrame(rows, "kind string, subject_key string")


#: Tags (provider, system, critical): the last one of a provider counts; one system has no provider of the household.
TAGS = [("1000000000", "SYSC", False), *((f"10000000{i:02d}", "SYS" + "ABC"[i % 3], i % 3 == 0) for i in range(8)), ("1000009999", "SYSD", False)]


def system_tags(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *t) for i, t in enumerate(TAGS)], "ord int, subject_key string, system string, critical boolean")


LATEST = """,
latest AS (
  SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY kind, subject_key, plan_id, source ORDER BY fetched_at DESC, source_last_updated DESC, value DESC, confidence DESC) AS n FROM answers)
  WHERE n = 1 AND source IN ('MARKETPLACE_API', 'ISSUER_MRF')
)"""
MATCHED = ANSWERS + LATEST + reconciled_sql("latest", "rec") + """,
subjects AS (
  SELECT 'PROVIDER' AS kind, '10000000' || lpad(CAST(i AS VARCHAR), 2, '0') AS subject_key FROM range(8) t(i) UNION ALL SELECT 'DRUG', CAST(i AS VARCHAR) FROM range(3) t(i)
), tags AS (
  SELECT * FROM (VALUES """ + ", ".join(f"({i}, '{k}', '{s}', {c})" for i, (k, s, c) in enumerate(TAGS)) + """) t(ord, subject_key, system, critical)
), dated AS (
  SELECT kind, subject_key, plan_id, max(source_last_updated) AS mrf_updated FROM latest WHERE source = 'ISSUER_MRF' GROUP BY ALL
), m0 AS (
  SELECT s.kind, s.subject_key, p.plan_id,
    CASE coalesce(verdict, 'ALL_UNKNOWN') WHEN 'SINGLE_SOURCE' THEN (CASE WHEN api_known THEN 'API_ONLY' ELSE 'MRF_ONLY' END) WHEN 'ALL_UNKNOWN' THEN 'BOTH_UNKNOWN' ELSE verdict END AS verdict,
    coalesce(consensus, 'unknown') AS consensus, coalesce(reconciled_confidence, 0.05::DOUBLE) AS reconciled_confidence, mrf_updated
  FROM subjects s CROSS JOIN (SELECT DISTINCT plan_id FROM answers) p LEFT JOIN rec USING (kind, subject_key, plan_id) LEFT JOIN dated USING (kind, subject_key, plan_id)
), matched AS (
  SELECT *, CASE WHEN verdict = 'AGREE' THEN (CASE WHEN consensus = 'yes' THEN 'covered' ELSE 'not_covered' END) WHEN verdict = 'CONFLICT' THEN 'disputed'
      WHEN verdict IN ('API_ONLY', 'MRF_ONLY') THEN (CASE WHEN consensus = 'yes' THEN 'covered_unverified' ELSE 'not_covered_unverified' END) ELSE 'unknown' END AS status,
    NOT (verdict = 'AGREE' AND reconciled_confidence >= 0.8) AS confirm
  FROM m0
)"""
