"""The board of a marketplace's plans for one household, and the catalog of marketplaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clarispan.functions.scalars import covered_flag
from clarispan.operators.cost import premium_amounts

# How many doctors and drugs one request may name, plans of one place, marketplace models.
MOST_DOCTORS, MOST_DRUGS, MOST_PLANS, MOST_CODES = 12, 20, 400, 100
MODELS = ("FFM", "FFMPartnership", "SupportedSBM", "SBM")


def covered_counts(coverage: DataFrame, keys: list[str], name: str) -> DataFrame:
    """How many of some keys each plan covers, by the last row of each (plan_id, key, coverage, ord)."""
    asked = coverage.where(F.col("key").isin(keys) & F.col("plan_id").isNotNull())
    last = asked.groupBy("plan_id", "key").agg(F.max_by("coverage", "ord").alias("coverage"))
    return last.groupBy("plan_id").agg(F.count_if(covered_flag(F.col("coverage"))).alias(name))


def live_board(plans: DataFrame, doctor_coverage: DataFrame, drug_coverage: DataFrame, doctors: list[str], drugs: list[str], credit: float = 0.0) -> DataFrame:
    """Ranked plans (plan_id, metal, premium, ord) of one place: those that keep every doctor first, then
    more drugs, then the lowest known net premium, then the order given. A place has MOST_PLANS at most."""
    if len(doctors) > MOST_DOCTORS or len(drugs) > MOST_DRUGS:
        raise ValueError(f"at most {MOST_DOCTORS} doctors and {MOST_DRUGS} drugs")
    rows = plans.join(covered_counts(doctor_coverage, doctors, "doctors_covered"), "plan_id", "left")
    rows = rows.join(covered_counts(drug_coverage, drugs, "drugs_covered"), "plan_id", "left").fillna(0, ["doctors_covered", "drugs_covered"])
    keeps = (F.col("doctors_covered") == len(doctors)) & F.lit(bool(doctors))
    rows = rows.withColumns({"keeps_all_doctors": keeps, **premium_amounts(F.col("premium"), F.lit(float(credit)), F.col("metal"))})
    order = [F.desc("keeps_all_doctors"), F.desc("drugs_covered"), F.asc_nulls_last("net_monthly"), F.asc("ord")]
    best = rows.orderBy(*order).limit(MOST_PLANS)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select(
        "plan_id", "metal", "doctors_covered", "drugs_covered", "keeps_all_doctors", "gross_monthly", "net_monthly", "net_annual", "rank")


def board_summary(board: DataFrame) -> DataFrame:
    return board.agg(F.count("*").alias("plans"), F.count_if("keeps_all_doctors").alias("plans_keeping_all_doctors"), F.min("net_monthly").alias("lowest_net_monthly"))


def catalog_gaps(models: DataFrame, marketplaces: DataFrame, codes: DataFrame) -> DataFrame:
    """Problems of a catalog: models (year, code, model) must cover all codes (code) in each year with a
    known model; marketplaces (year, code) must be those of the states with their own platform. Codes are
    those of states; more than MOST_CODES are an error."""
    listed = codes.agg(F.array_sort(F.collect_set("code")).alias("codes"))
    listed = listed.select(F.when(F.size("codes") <= MOST_CODES, F.col("codes")).otherwise(F.raise_error(F.lit(f"more than {MOST_CODES} codes"))).alias("codes"))
    wanted = models.select("year").distinct().crossJoin(F.broadcast(listed)).select("year", F.explode("codes").alias("code"))  # listed is one row
    both = wanted.withColumn("wanted", F.lit(True)).join(models, ["year", "code"], "full").join(marketplaces.select("year", "code", F.lit(True).alias("has")).distinct(), ["year", "code"], "full")
    own, has = F.coalesce(F.col("model") == "SBM", F.lit(False)), F.coalesce("has", F.lit(False))
    problem = (
        F.when(F.col("wanted").isNull(), "unknown_code").when(F.col("model").isNull(), "missing_model").when(~F.col("model").isin(*MODELS), "bad_model")
        .when(own & ~has, "missing_marketplace").when(~own & has, "unexpected_marketplace"))
    return both.select("year", "code", problem.alias("problem")).where("problem IS NOT NULL")


def own_marketplaces(requests: DataFrame, marketplaces: DataFrame) -> DataFrame:
    """Requests (year, state) with the marketplace (year, code, name, url) that serves them instead of the
    federal one, if there is one."""
    table = marketplaces.select("year", F.col("code").alias("__code"), "name", "url")
    return requests.join(table, (requests["year"] == table["year"]) & (F.upper("state") == F.col("__code")), "left").drop(table["year"]).drop("__code")


def needs_publication(old_content: Column, new_content: Column, old_checked: Column, now: Column, days: int = 6) -> Column:
    """Whether a catalog is published anew: there is none, its content differs, or it is `days` old."""
    age = (F.unix_micros(now) - F.unix_micros(old_checked)) / F.lit(86_400_000_000.0)
    return old_content.isNull() | (F.sha2(old_content, 256) != F.sha2(new_content, 256)) | F.coalesce(age >= days, F.lit(True))
