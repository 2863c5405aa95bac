"""The decision of one household: matching, verification and true cost of each plan, ranked by cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clarispan.operators import cost, matching, verify
from clarispan.operators.ranking import ranked


def assemble(matched: DataFrame, plans: DataFrame, household: DataFrame, tiers: DataFrame, fills: DataFrame, copays: DataFrame, unknown_copay: float, as_of: Column, policy: cost.CostPolicy = cost.DEFAULT) -> DataFrame:
    """A row for each plan of `matched`, the least true cost first, then by the plan's id.

    plans (plan_id, metal, premium, deductible, oop_max, coinsurance); household, one row (income, size,
    benchmark_monthly, medical_spend); tiers (plan_id, subject_key, tier) of the drugs that a plan lists; fills
    (subject_key, fills) a month, one where it is not said; copays (tier, copay). A drug whose tier is unknown
    takes the fallback copay. Household, fills and copays are one form's, so they are broadcast.
    """
    drugs = matched.where("kind = 'DRUG'").select("plan_id", "subject_key").join(tiers, ["plan_id", "subject_key"], "left")
    drugs = drugs.join(F.broadcast(fills), "subject_key", "left").select(F.lit(0).alias("household"), F.col("plan_id").alias("plan"), "tier", F.coalesce("fills", F.lit(1)).alias("fills"))
    spent = cost.drug_costs(drugs, copays, unknown_copay).withColumnRenamed("plan", "plan_id").drop("household")
    whole = cost.subsidies(household, policy)
    pairs = plans.join(spent, "plan_id", "left").withColumns({"drug_cost": F.coalesce("drug_cost", F.lit(0.0)), "unknown_tier": F.coalesce("unknown_tier", F.lit(False))})
    costs = cost.true_costs(pairs.crossJoin(F.broadcast(whole)), policy)  # whole is one row
    costs = costs.select("plan_id", "metal", "aptc_annual", "csr", "unknown_tier", "net_premium", "drug_cost", "oop", "true_cost")
    checked = verify.verify_plans(matched, as_of).select("plan_id", F.col("score").alias("verify_score"), "grade", "stale")
    rolled = matching.roll_up(matched).select("plan_id", "match_score", "network_confidence", "doctors_covered", "doctors_total", "drugs_covered", "drugs_total", "confirm_list")
    return ranked(rolled.join(checked, "plan_id").join(costs, "plan_id"), [F.asc("true_cost"), F.asc("plan_id")])


def subsidy_headline(household: DataFrame, policy: cost.CostPolicy = cost.DEFAULT) -> DataFrame:
    """One household's credit in words (fixed values), with the variant of silver plans."""
    rows = cost.subsidies(household, policy)
    variant, _ = cost.csr_variant(F.col("fpl_pct"), F.lit("Silver"), policy)
    some = F.concat(
        F.lit("Estimated subsidy ~$"), F.format_number(F.floor(F.col("aptc_annual") + 0.5), 0), F.lit("/yr (APTC)"), F.coalesce(F.concat(F.lit(" + Silver CSR "), variant), F.lit("")),
        F.lit(" — an estimate; confirm on the official Marketplace."))
    none = "No premium subsidy at this income — confirm eligibility on the official Marketplace."
    return rows.withColumn("headline", F.when(F.col("eligible"), some).otherwise(none))
