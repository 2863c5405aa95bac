"""Answers of an issuer's own files and of a marketplace about subjects and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clarispan.functions.scalars import tristate

ISSUER, MARKETPLACE = "ISSUER_MRF", "MARKETPLACE_API"


def issuer_answers(grid: DataFrame, records: DataFrame, fetched_at: Column) -> DataFrame:
    """Answers to (kind, subject_key, plan_id) from records (kind, subject_key, plans array of ids,
    last_updated_on, ord): yes if the subject's record lists the plan, no if it does not, unknown without
    a record. The last record of a subject counts; records without a key are left out."""
    named = records.withColumn("subject_key", F.trim("subject_key")).where("subject_key <> ''")
    last = named.groupBy("kind", "subject_key").agg(F.max_by(F.struct("plans", "last_updated_on"), "ord").alias("r"))
    rows = grid.join(last, ["kind", "subject_key"], "left")
    listed = F.coalesce(F.array_contains("r.plans", F.col("plan_id")), F.lit(False))
    value = F.when(F.col("r").isNull(), "unknown").when(listed, "yes").otherwise("no")
    return rows.select("kind", "subject_key", "plan_id", F.lit(ISSUER).alias("source"), value.alias("value"), fetched_at.alias("fetched_at"), F.try_to_timestamp("r.last_updated_on").alias("source_last_updated"))


def marketplace_answers(grid: DataFrame, coverage: DataFrame, fetched_at: Column) -> DataFrame:
    """Answers to (kind, subject_key, plan_id) from coverage (kind, subject_key, plan_id, coverage, ord): the
    last wording counts, none is unknown. The marketplace gives no date of its own."""
    keys = ["kind", "subject_key", "plan_id"]
    last = coverage.groupBy(*keys).agg(F.max_by("coverage", "ord").alias("coverage"))
    value = F.coalesce(tristate(F.col("coverage")), F.lit("unknown"))
    return grid.join(last, keys, "left").select(*keys, F.lit(MARKETPLACE).alias("source"), value.alias("value"), fetched_at.alias("fetched_at"), F.lit(None).cast("timestamp").alias("source_last_updated"))
