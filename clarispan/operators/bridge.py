"""Health systems that a plan keeps or loses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clarispan import policy
from clarispan.functions.scalars import half_up
from clarispan.operators.ranking import ranked

KEPT = ("covered", "covered_unverified")


def _cents(c: Column) -> Column:
    return F.floor(c * 100 + 0.5).cast("long")


def _by_plan(matched: DataFrame, tags: DataFrame) -> DataFrame:
    """A row for each plan: `systems`, its coverage of every required system, and its critical providers.

    Tags (subject_key, system, critical, ord) are a household's, so they are few and broadcast. A provider's last
    tag says its system; every tag's system is required, and a provider with any critical tag is critical.
    """
    of = tags.groupBy("subject_key").agg(F.max_by("system", "ord").alias("system"), F.bool_or("critical").alias("critical"))
    whole = tags.agg(F.array_sort(F.collect_set("system")).alias("required"), F.count_distinct(F.when(F.col("critical"), F.col("subject_key"))).alias("critical_total"))
    doctor, s = F.col("kind") == "PROVIDER", F.col("status")
    covered = s.startswith("covered")
    gap = doctor & F.col("critical") & ~covered
    g = matched.join(F.broadcast(of), "subject_key", "left").withColumn("system", F.when(doctor, F.col("system"))).groupBy("plan_id", "system").agg(
        F.count("*").alias("total"), F.count_if(covered).alias("covered"), F.count_if(s == "covered").alias("firm"), F.count_if(s == "unknown").alias("unknown"),
        F.sum(_cents(F.col("reconciled_confidence"))).alias("cents"), F.count_if("confirm").alias("confirm"), F.collect_list(F.when(gap, F.col("subject_key"))).alias("gaps"))
    found = F.struct("total", "covered", "firm", "unknown", "cents", "confirm")
    plans = g.groupBy("plan_id").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("system").isNotNull(), F.struct("system", found)))).alias("found"), F.array_sort(F.flatten(F.collect_list("gaps"))).alias("gaps"))

    def state(system: Column) -> Column:
        x = F.element_at("found", system)
        n, kept = F.coalesce(x["total"], F.lit(0)), F.coalesce(x["covered"], F.lit(0))
        status = (
            F.when((n == 0) | ((kept == 0) & (x["unknown"] == n)), "unknown").when(kept == 0, "not_covered").when(kept < n, "partial")
            .when(x["firm"] == n, "covered").otherwise("covered_unverified"))
        return F.struct(
            system.alias("system"), status.alias("system_status"), n.alias("total"), kept.alias("covered"),
            F.when(n > 0, half_up(x["cents"] / n / 100.0)).otherwise(F.lit(0.0)).alias("confidence"), F.coalesce(x["confirm"], F.lit(0)).alias("confirm"))

    return plans.crossJoin(F.broadcast(whole)).select("plan_id", "gaps", "critical_total", F.transform("required", state).alias("systems"))  # whole is one row


def system_coverage(matched: DataFrame, tags: DataFrame) -> DataFrame:
    """Status of each plan and required system."""
    rows = _by_plan(matched, tags).select("plan_id", F.explode("systems").alias("s"))
    return rows.select("plan_id", "s.system", "s.total", "s.covered", "s.confidence", "s.system_status")


def _headline(status: Column) -> Column:
    """The sentence that sums a plan up. Its wording is fixed values."""
    listed = lambda c, by: F.array_join(F.transform(c, lambda s: s["system"]), by)
    least = _cents(F.array_min(F.transform("kept", lambda s: s["confidence"]))).cast("string")
    lead = (
        F.when(status == "bridges_all", F.concat(F.lit("Keeps every system in-network ("), listed("kept", " + "), F.lit(") — shown in-network at ≥"), least, F.lit("% confidence")))
        .when(status == "single_system", F.concat(F.lit("Keeps "), listed("kept", ", "), F.lit(" but drops "), listed("lost", ", ")))
        .when(status == "partial", "No system kept whole — only some providers shown in-network").otherwise("Keeps none of your doctors in-network"))
    gap = F.when(F.size("gaps") > 0, F.concat(F.lit(" · ⚠️ puts a must-keep provider out-of-network: "), F.array_join(F.transform("gaps", lambda k: F.concat(F.lit("NPI "), k)), ", "))).otherwise("")
    n = F.aggregate("systems", F.lit(0).cast("long"), lambda a, s: a + s["confirm"])
    confirm = F.when(n > 0, F.concat(F.lit(" · confirm "), n.cast("string"), F.lit(" provider"), F.when(n > 1, "s").otherwise(""), F.lit(" with the office(s) before enrolling"))).otherwise(
        " · still confirm directly with each office before enrolling")
    return F.concat(lead, gap, confirm)


def bridge_plans(matched: DataFrame, tags: DataFrame) -> DataFrame:
    """Kept and lost systems, critical gaps, score and headline of each plan."""
    rows = _by_plan(matched, tags).withColumns({
        "kept": F.filter("systems", lambda s: s["system_status"].isin(*KEPT)), "lost": F.filter("systems", lambda s: ~s["system_status"].isin(*KEPT))})
    n, total = F.size("kept"), F.col("critical_total")
    any_covered = F.exists("systems", lambda s: s["covered"] > 0)
    state = F.when((n > 0) & (n == F.size("systems")), "bridges_all").when(n > 0, "single_system").when(any_covered, "partial").otherwise("none")
    share = F.when(total > 0, (total - F.size("gaps")) / total).otherwise(F.lit(1.0))
    mean = F.when(n > 0, half_up(F.aggregate("kept", F.lit(0).cast("long"), lambda a, s: a + _cents(s["confidence"])) / n / 100.0)).otherwise(F.lit(0.0))
    score = half_up(n + policy.CRITICAL_WEIGHT * share + policy.KEPT_CONFIDENCE_WEIGHT * mean)
    names = lambda c: F.array_join(F.transform(c, lambda s: s["system"]), ",")
    return rows.select(
        "plan_id", names("kept").alias("kept"), names("lost").alias("lost"), F.array_join("gaps", ",").alias("critical_gaps"), state.alias("bridge_status"),
        score.alias("bridge_score"), _headline(state).alias("headline"))


def rank_bridges(bridges: DataFrame) -> DataFrame:
    """All plans, the best score first, then by the plan's id."""
    return ranked(bridges, [F.desc("bridge_score"), F.asc("plan_id")])
