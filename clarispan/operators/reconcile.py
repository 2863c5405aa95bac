"""Reconciliation of any number of sources' answers about one claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clarispan import policy
from clarispan.functions.scalars import half_up, sorted_text

CLAIM = ["kind", "subject_key", "plan_id"]


def _verdict(known: Column, yes: Column, no: Column) -> Column:
    return F.when(known == 0, "ALL_UNKNOWN").when(known == 1, "SINGLE_SOURCE").when((yes == 0) | (no == 0), "AGREE").otherwise("CONFLICT")


def reconcile(answers: DataFrame, by: list[str] = CLAIM, also: list[Column] | None = None) -> DataFrame:
    """A row for each claim: verdict, consensus, votes and confidence, and other aggregates asked for. A majority
    never hides a conflict."""
    known, yes = F.col("value") != "unknown", F.col("value") == "yes"
    g = answers.groupBy(*by).agg(
        F.count_if(known).alias("known_count"), F.count_if(yes).alias("yes_count"), F.count_if(known & ~yes).alias("no_count"),
        F.max(F.when(known, F.col("confidence"))).alias("top"), F.min(F.when(known, F.col("confidence"))).alias("low"),
        F.max(F.when(known, F.col("value"))).alias("value"), sorted_text(F.collect_list(F.when(known, F.col("source")))).alias("sources"),
        F.struct(F.lit(0), *(also or [])).alias("also"))
    k = F.col("known_count")
    verdict = _verdict(k, F.col("yes_count"), F.col("no_count"))
    confidence = (
        F.when(k == 0, F.lit(policy.UNKNOWN_CONFIDENCE)).when(k == 1, half_up(F.col("top") * policy.SINGLE_FACTOR))
        .when((F.col("yes_count") == 0) | (F.col("no_count") == 0), half_up(F.least(F.lit(policy.AGREE_CEILING), F.col("top") + (k - 1) * policy.AGREE_STEP)))
        .otherwise(half_up(F.col("low") * policy.CONFLICT_FACTOR)))
    split = (F.col("yes_count") > 0) & (F.col("no_count") > 0)
    return g.select(
        *by, verdict.alias("verdict"), "known_count", "yes_count", "no_count",
        F.when((k == 0) | split, "unknown").otherwise(F.col("value")).alias("consensus"), confidence.alias("reconciled_confidence"),
        F.when((k > 1) & ~split, F.col("sources")).otherwise("").alias("agrees_with"),
        F.when(split, F.col("sources")).otherwise("").alias("conflicts_with"), *[f"also.{c}" for c in g.schema["also"].dataType.names[1:]])


def stamps(answers: DataFrame, by: list[str] = CLAIM) -> DataFrame:
    """For each claim, source and known value: how many answers give it, and the sources of the claim's other answers
    that agree and conflict with one of them. Answers are counted by source first, so a claim with very many of them is
    a short list of sources."""
    votes = answers.where("value <> 'unknown'").groupBy(*by, "source", "value").agg(F.count("*").alias("n"))
    votes = votes.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("source", "value", "n"))).alias("votes"))

    def listed(agree: bool) -> Column:
        fits = F.filter("votes", lambda v: (v["value"] == F.col("v.value")) if agree else (v["value"] != F.col("v.value")))
        own = lambda v: F.when((v["source"] == F.col("v.source")) & F.lit(agree), 1).otherwise(0)
        return F.array_join(F.flatten(F.transform(fits, lambda v: F.array_repeat(v["source"], (v["n"] - own(v)).cast("int")))), ",")

    rows = votes.select(*by, "votes", F.explode("votes").alias("v"))
    return rows.select(*by, "v.source", "v.value", "v.n", listed(True).alias("agrees_with"), listed(False).alias("conflicts_with"))


def latest(answers: DataFrame, by: list[str] = CLAIM) -> DataFrame:
    """One answer for each claim and source, the last one retrieved (then by its other columns)."""
    order = ["fetched_at", "source_last_updated", "value", "confidence"]
    g = answers.groupBy(*by, "source").agg(F.max(F.struct(*order)).alias("last"))
    return g.select(*by, "source", "last.*")


def two_way(answers: DataFrame, by: list[str] = CLAIM, api: str = "MARKETPLACE_API", also: list[Column] | None = None) -> DataFrame:
    """The view of two sources: a single source is named by which one it is."""
    api_known = F.bool_or((F.col("source") == api) & (F.col("value") != "unknown")).alias("api_known")
    verdict = (
        F.when(F.col("verdict") == "SINGLE_SOURCE", F.when(F.col("api_known"), "API_ONLY").otherwise("MRF_ONLY"))
        .when(F.col("verdict") == "ALL_UNKNOWN", "BOTH_UNKNOWN").otherwise(F.col("verdict")))
    return reconcile(answers, by, [api_known, *(also or [])]).withColumn("verdict", verdict).drop("api_known")


def summarize(reconciled: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Claims by verdict, and the share of agreements among claims with several known answers."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    agree, conflict = n("AGREE"), n("CONFLICT")
    both = agree + conflict
    return reconciled.groupBy(*(by or [])).agg(
        F.count("*").alias("total"), agree.alias("agree"), conflict.alias("conflict"), n("SINGLE_SOURCE").alias("single_source"),
        n("ALL_UNKNOWN").alias("all_unknown"), F.when(both > 0, agree / both).alias("agreement_rate"))
