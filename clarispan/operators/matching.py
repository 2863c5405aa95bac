"""A household's subjects against plans: status of each claim, roll-up and rank of each plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clarispan import policy
from clarispan.functions.scalars import half_up
from clarispan.operators.ranking import ranked
from clarispan.operators.reconcile import CLAIM, latest, two_way

API, MRF = "MARKETPLACE_API", "ISSUER_MRF"


def status(verdict: Column, consensus: Column) -> Column:
    yes = consensus == "yes"
    return (
        F.when(verdict == "AGREE", F.when(yes, "covered").otherwise("not_covered")).when(verdict == "CONFLICT", "disputed")
        .when(verdict.isin("API_ONLY", "MRF_ONLY"), F.when(yes, "covered_unverified").otherwise("not_covered_unverified")).otherwise("unknown"))


def contribution(status_: Column, confidence: Column) -> Column:
    return (
        F.when(status_ == "covered", confidence).when(status_ == "covered_unverified", confidence * policy.UNVERIFIED_FACTOR)
        .when(status_ == "disputed", F.lit(policy.DISPUTED_SCORE)).otherwise(F.lit(0.0)))


def match_subjects(household: DataFrame, plans: DataFrame, answers: DataFrame) -> DataFrame:
    """A row for each subject (kind, subject_key) of the household and plan, with its status.

    A household has a bounded number of subjects (a form's limit), so it is broadcast to the plans.
    """
    grid = plans.select("plan_id").distinct().join(F.broadcast(household.select("kind", "subject_key").distinct()))
    claims = answers.where(F.col("source").isin(API, MRF)).join(F.broadcast(household.select("kind", "subject_key").distinct()), ["kind", "subject_key"], "left_semi")
    known = two_way(latest(claims), also=[F.max(F.when(F.col("source") == MRF, F.col("source_last_updated"))).alias("mrf_updated")])
    out = grid.join(known, CLAIM, "left")
    out = out.withColumns({
        "verdict": F.coalesce("verdict", F.lit("BOTH_UNKNOWN")), "consensus": F.coalesce("consensus", F.lit("unknown")),
        "reconciled_confidence": F.coalesce("reconciled_confidence", F.lit(policy.UNKNOWN_CONFIDENCE))})
    out = out.withColumn("status", status(F.col("verdict"), F.col("consensus")))
    confirm = ~((F.col("verdict") == "AGREE") & (F.col("reconciled_confidence") >= policy.CONFIRM_BELOW))
    return out.select(*CLAIM, "verdict", "consensus", "status", "reconciled_confidence", "mrf_updated", confirm.alias("confirm"))


def roll_up(matched: DataFrame) -> DataFrame:
    """A row for each plan: counts by status, mean scores, subjects to confirm."""
    s, doctor = F.col("status"), F.col("kind") == "PROVIDER"
    counts = [
        F.count_if(cond & where).alias(f"{name}_{what}")
        for name, cond in (("doctors", doctor), ("drugs", ~doctor))
        for what, where in (("covered", s.startswith("covered")), ("disputed", s == "disputed"), ("not_covered", s.startswith("not_covered")), ("unknown", s == "unknown"), ("total", F.lit(True)))
    ]
    confirm = F.array_join(F.array_sort(F.collect_list(F.when(F.col("confirm"), F.concat("kind", F.lit(":"), "subject_key")))), ",")
    # Sums of cents, so that the order of addition cannot matter.
    score = F.sum(F.floor(contribution(s, F.col("reconciled_confidence")) * 10000 + 0.5)) / F.count("*") / 10000.0
    confidence = F.sum(F.floor(F.col("reconciled_confidence") * 100 + 0.5)) / F.count("*") / 100.0
    return matched.groupBy("plan_id").agg(*counts, half_up(score, 4).alias("match_score"), half_up(confidence).alias("network_confidence"), confirm.alias("confirm_list"))


def rank_matches(rolled: DataFrame, limit: int | None = None) -> DataFrame:
    """Best plans first: score, confidence, then the plan's id. A limit makes it a top-k, without one
    all plans are ranked, over range partitions."""
    order = [F.desc("match_score"), F.desc("network_confidence"), F.asc("plan_id")]
    if limit is None:
        return ranked(rolled, order)
    top = rolled.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def confirm_list(matched: DataFrame) -> DataFrame:
    """Subjects to confirm with the reason that comes first."""
    s = F.col("status")
    reason = F.when(F.col("verdict") == "CONFLICT", "conflict").when(s == "unknown", "unknown").when(s.endswith("_unverified"), "unverified").otherwise("low_confidence")
    return matched.where("confirm").select(*CLAIM, reason.alias("reason"))
