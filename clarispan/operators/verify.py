"""Verification report of a plan's matched claims."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clarispan import policy
from clarispan.functions.scalars import days_between, half_up
from clarispan.operators.matching import confirm_list


def grade(score: Column) -> Column:
    (name, least), *rest = policy.GRADES
    return reduce(lambda c, g: c.when(score >= g[1], g[0]), rest, F.when(score >= least, name)).otherwise("F")


def _dates(as_of: Column) -> list[Column]:
    stale = days_between(as_of, F.col("mrf_updated")) > policy.STALE_DAYS
    day = F.date_format("mrf_updated", "yyyy-MM-dd")
    return [F.min(day).alias("oldest"), F.max(day).alias("newest"), F.count("mrf_updated").alias("dated"), F.count_if(stale).alias("stale")]


def freshness_summary(matched: DataFrame, as_of: Column) -> DataFrame:
    """Oldest and newest source dates of each plan, and how many claims are dated and stale."""
    return matched.groupBy("plan_id").agg(*_dates(as_of))


def _verified(matched: DataFrame, as_of: Column) -> DataFrame:
    verdict = lambda *v: F.count_if(F.col("verdict").isin(*v))
    mean = F.sum(F.floor(F.col("reconciled_confidence") * 100 + 0.5)) / F.count("*") / 100.0
    both = matched.groupBy("plan_id").agg(
        F.count("*").alias("total"), verdict("AGREE").alias("verified"), verdict("CONFLICT").alias("conflicts"),
        verdict("API_ONLY", "MRF_ONLY").alias("single_source"), verdict("BOTH_UNKNOWN").alias("unknown"), F.count_if("confirm").alias("confirm"), mean.alias("mean"), *_dates(as_of))
    penalty = F.when(F.col("dated") > 0, F.col("stale") / F.col("dated") * policy.STALE_PENALTY).otherwise(F.lit(0.0))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), half_up(F.col("mean") - penalty)))
    return both.withColumn("score", score).withColumn("grade", grade(F.col("score"))).drop("mean", "dated")


def verify_plans(matched: DataFrame, as_of: Column) -> DataFrame:
    """Score and grade of each plan: mean confidence less a penalty for the share of stale claims."""
    return _verified(matched, as_of).drop("confirm", "oldest", "newest")


def _counted(n: str, one: str, many: str) -> Column:
    """A count in words, null for none."""
    return F.when(F.col(n) > 0, F.concat(F.col(n).cast("string"), F.when(F.col(n) == 1, one).otherwise(many)))


def headlines(matched: DataFrame, as_of: Column) -> DataFrame:
    """The sentence that sums up each plan's report. Its wording is fixed values."""
    text = lambda c: F.col(c).cast("string")
    percent = F.floor(F.col("score") * 100 + 0.5).cast("string")
    lead = F.concat(F.lit("Network confidence "), "grade", F.lit(" ("), percent, F.lit("%): "), text("verified"), F.lit(" of "), text("total"), F.lit(" answers corroborated across both sources"))
    flags = F.nullif(F.concat_ws(", ", _counted("conflicts", " conflict", " conflicts"), _counted("single_source", " one-sided", " one-sided"), _counted("unknown", " unknown", " unknown")), F.lit(""))
    dates = F.when(F.col("oldest") == F.col("newest"), F.concat(F.lit("issuer data as of "), "newest")).otherwise(F.concat(F.lit("issuer data "), "oldest", F.lit("–"), "newest"))
    dates = F.when(F.col("stale") > 0, F.concat(dates, F.lit(" ("), text("stale"), F.lit(" stale)"))).otherwise(dates)
    ask = _counted("confirm", " item with the provider/plan before enrolling.", " items with the provider/plan before enrolling.")
    last = F.coalesce(F.concat(F.lit("Confirm "), ask), F.lit("Nothing flagged to confirm, but verify with the provider before enrolling."))
    return _verified(matched, as_of).select("plan_id", "confirm", F.concat_ws(" · ", lead, flags, dates, last).alias("headline"))


def checklist(matched: DataFrame) -> DataFrame:
    """What to ask about each claim to confirm, with the reason that comes first. The wording is fixed values."""
    call = F.concat(F.lit("Call NPI "), "subject_key", F.lit("'s office and confirm they are in-network for "), "plan_id", F.lit(" (and accepting new patients)."))
    ask = F.concat(F.lit("Ask "), "plan_id", F.lit(" or your pharmacy to confirm RxCUI "), "subject_key", F.lit(" is on the formulary and at what tier (and any prior authorization)."))
    return confirm_list(matched).withColumn("action", F.when(F.col("kind") == "PROVIDER", call).otherwise(ask))
