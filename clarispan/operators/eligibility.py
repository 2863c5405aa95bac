"""Coverage eligibility by an ordered table of rules over the facts of a request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clarispan.operators.cost import resolve_counties

#: Facts of a request: whether its year and state are known, more than one person, a state's own marketplace, a live
#: estimate, the county's resolution, the estimate's gap, Medicaid, subsidy and plans, and the state with a link of its own.
FACTS = ("year", "state", "several", "own", "live", "county", "gap", "medicaid", "credit", "plans")

# Rules in order. The first whose conditions hold gives the verdict, the headline, the next steps and the notes.
RULES = (
    ({"year": "false"}, "unsupported_year", "", (), ()),
    ({"state": "false"}, "unsupported_state", "", (), ()),
    ({"several": "true"}, "official_handoff", "For a household of two or more, use the official application for an accurate coverage estimate.",
     ("Check Medicaid or CHIP through {program} using the official link below.", "The official Marketplace can collect each household member's details to estimate plan savings."),
     ("We only ask for one age, so no multi-person eligibility or subsidy estimate was calculated here.",)),
    ({"own": "true"}, "state_marketplace", "{own_state} makes its own Medicaid and Marketplace decisions, so we won't guess from federal-only data.",
     ("Start at the official {program} site for application or account options. Follow your state notice for renewal steps.", "For private-plan eligibility and subsidies, use {own_name}."),
     ("No eligibility verdict is shown here because the federal Marketplace feed does not carry this state's live determination. The state application checks every category that may apply to you.",)),
    ({"live": "false"}, "official_handoff", "{program} can make the official coverage decision—we won't guess while the live estimate is unavailable.",
     ("Start at the official {program} site for application or account options. Renewal steps may differ.", "If you received a renewal notice, respond by the deadline even if you think the state already has your information."),
     ("No eligibility verdict or subsidy amount was produced. Your state application checks income and every coverage category that may apply.",)),
    ({"county": "not_found"}, "unknown", "We couldn't find a county for ZIP {zip}. Double-check the ZIP.", ("Re-enter your 5-digit ZIP code.",), ()),
    ({"county": "state_mismatch"}, "unknown", "That ZIP does not appear to be in {state}.",
     ("Choose the state that matches your home address, then check again.",), ("We stop here rather than use the wrong state's Medicaid rules.",)),
    ({"county": "ambiguous"}, "official_handoff", "This ZIP spans multiple counties, so we won't choose a Marketplace rating area for you.",
     ("Use the official Marketplace to confirm your county before comparing plans or savings.", "For Medicaid, start at the official {program} site below. Follow your state notice for renewal steps."),
     ("The Marketplace returned multiple counties for this ZIP. No eligibility estimate, subsidy amount, or plan count was calculated.",)),
    ({"gap": "true"}, "coverage_gap", "Your income may fall in a coverage gap in {place} — a Navigator can help.",
     ("Talk to a free Navigator ({navigator}) — gaps often have a fix once your real income is reviewed.",), ("{mirror}",)),
    ({"medicaid": "true"}, "medicaid", "At this income you may qualify for Medicaid in {place}.",
     ("Apply or confirm through {program}; the official application and phone number are below.",
      "The Marketplace estimate did not show a premium tax credit. Confirm your full eligibility with the state before choosing other coverage."), ("{mirror}",)),
    ({"credit": "true"}, "marketplace", "You likely qualify for a subsidy of about {credit}/month toward a Marketplace plan in {place}.",
     ("{compare}", "Use the plan documents and confirm doctor and medication coverage before you enroll."), ("{mirror}", "{cheapest}")),
    ({"plans": "true"}, "marketplace", "Marketplace plans may be an option in {place}; confirm your eligibility through the official application.",
     ("{compare}", "Use the plan documents and confirm doctor and medication coverage before you enroll."), ("{mirror}", "{cheapest}")),
    ({}, "unknown", "We couldn't determine eligibility from these inputs in {place}.",
     ("Double-check your income and household size, or talk to a free Navigator ({navigator}).",), ("{mirror}",)),
)
# Sentences that several rules share.
MIRROR = "This mirrors HealthCare.gov's own estimate at the income you entered — it's decision support, not a final determination."
COMPARE = "Compare estimated net premiums, deductibles, and out-of-pocket maximums—not just the sticker premium. Full annual-cost estimates are not available here yet."
CHEAPEST = "The lowest sticker premium among the first 10 plans returned was {cheapest}/mo before subsidy; this may not be the lowest available overall."
NAVIGATORS = {"OH": "getcoveredohio.org"}
NAVIGATOR = "localhelp.healthcare.gov"
#: From here on a rule rests on an estimate for one county.
FIRST_ESTIMATED = next(i for i, r in enumerate(RULES) if "gap" in r[0])


def rule_table(spark) -> DataFrame:
    """The rules as rows, a few and fixed."""
    return spark.createDataFrame([(i, v, h, list(s), list(n)) for i, (_, v, h, s, n) in enumerate(RULES)], "rule int, verdict string, headline string, next_steps array<string>, notes array<string>")


def _filled(text: Column, values: dict[str, Column]) -> Column:
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return text


def eligibility(requests: DataFrame, counties: DataFrame, states: DataFrame, marketplaces: DataFrame, estimates: DataFrame, years: list[int]) -> DataFrame:
    """The answer to each request (request_id, state, zip, household_size, year, live): which rule holds, its verdict, headline,
    next steps and notes, and the estimate's numbers where one was used.

    counties (zip, county_state, fips, county), states (state, program) with an official resource, marketplaces (year, state,
    own_state, own_name) of states with their own, estimates (request_id, medicaid, aptc, gap, plans, cheapest): one row a
    key but in counties. Facts are joined to requests; the rule is found by its conditions and joined by number.
    """
    asked = requests.withColumn("state", F.upper("state"))
    resolved = resolve_counties(counties, asked.select("request_id", "zip", "state"))
    names = counties.select(F.concat_ws(":", "county_state", "fips").alias("county"), F.concat_ws(", ", "county", "county_state").alias("place")).groupBy("county").agg(F.min("place").alias("place"))
    rows = asked.join(resolved.select("request_id", "resolution", F.col("county").alias("at")), "request_id", "left").join(names, F.col("at") == F.col("county"), "left").drop("county")
    rows = rows.join(states.select("state", "program"), "state", "left").join(marketplaces.select("year", "state", "own_state", "own_name"), ["year", "state"], "left").join(estimates, "request_id", "left")
    true = lambda c: F.coalesce(c, F.lit(False)).cast("string")
    credit = F.floor(F.coalesce("aptc", F.lit(0.0)) + 0.5).cast("long")
    facts = dict(zip(FACTS, (
        true(F.col("year").isin(*years)), true(F.col("program").isNotNull()), true(F.col("household_size") > 1), true(F.col("own_name").isNotNull()), true(F.col("live")),
        F.coalesce("resolution", F.lit("not_found")), true(F.col("gap")), true(F.col("medicaid")), true(credit > 0), true(F.col("plans") > 0))))
    rule = F.lit(len(RULES) - 1)
    for i, (conditions, *_) in reversed([*enumerate(RULES)][:-1]):
        holds = F.lit(True)
        for name, value in conditions.items():
            holds = holds & (facts[name] == value)
        rule = F.when(holds, i).otherwise(rule)
    rows = rows.withColumns({"rule": rule, "credit": credit}).join(F.broadcast(rule_table(requests.sparkSession)), "rule")
    money = lambda c: F.concat(F.lit("$"), F.format_number(F.floor(c + 0.5), 0))
    cheapest = F.when(F.col("cheapest").isNotNull(), F.replace(F.lit(CHEAPEST), F.lit("{cheapest}"), money(F.col("cheapest"))))
    navigator = F.coalesce(*[F.when(F.col("state") == s, n) for s, n in NAVIGATORS.items()], F.lit(NAVIGATOR))
    values = {
        "mirror": F.lit(MIRROR), "compare": F.lit(COMPARE), "cheapest": cheapest, "program": F.col("program"), "own_state": F.col("own_state"), "own_name": F.col("own_name"),
        "zip": F.col("zip"), "state": F.col("state"), "place": F.col("place"), "navigator": navigator, "credit": money(F.col("credit"))}
    every = lambda c: F.filter(F.transform(c, lambda x: _filled(x, values)), lambda x: x != "")
    used = F.col("rule") >= FIRST_ESTIMATED
    return rows.select(
        "request_id", "rule", "verdict", _filled(F.col("headline"), values).alias("headline"), every("next_steps").alias("next_steps"), every("notes").alias("notes"),
        (used & F.coalesce("medicaid", F.lit(False))).alias("medicaid_eligible"), F.when(used, F.col("credit")).otherwise(0).alias("aptc_monthly"), (used & F.coalesce("gap", F.lit(False))).alias("in_coverage_gap"),
        F.when(used, F.col("plans")).alias("plan_count"), F.when(used, F.col("cheapest")).alias("cheapest_premium"))
