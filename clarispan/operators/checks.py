"""Checks of requests, plan sets and runs, and counts of their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clarispan.operators.ranking import ranked

# Bounds of a request and of a plan set.
FIRST_YEAR, LAST_YEAR, MOST_SET_PLANS, ID_TYPES = 2020, 2030, 30_000, ("ein", "hios")
MOST_DRUGS, MOST_DOCTORS, MOST_PERSONS, OLDEST = 20, 12, 12, 120


def request_problems(requests: DataFrame) -> DataFrame:
    """Part D requests (rxcui, contract_id, plan_id, segment_id, contract_year, all text, year a number) with the
    name of the first field that is not valid, null if all are. A missing segment is 0."""
    bad = lambda c, pattern: ~F.coalesce(c.rlike(pattern), F.lit(False))
    year = F.col("contract_year")
    problem = (
        F.when(bad(F.trim("rxcui"), r"^\d{1,8}\z"), "rxcui")
        .when(bad(F.upper(F.trim("contract_id")), r"^[A-Z]\d{4}\z"), "contract_id")
        .when(bad(F.trim("plan_id"), r"^\d{1,3}\z"), "plan_id")
        .when(bad(F.trim(F.coalesce("segment_id", F.lit("0"))), r"^\d{1,3}\z"), "segment_id")
        .when(~F.coalesce(year.between(FIRST_YEAR, LAST_YEAR), F.lit(False)), "contract_year"))
    return requests.withColumn("problem", problem)


def household_problems(requests: DataFrame, years: list[int]) -> DataFrame:
    """Plan requests (zip, state, year, income, age, household_size, employer_offer) with the name of the first field that
    is not valid, null if all are. A missing household has one person; a state may be missing."""
    bad = lambda c, pattern: ~F.coalesce(F.trim(F.col(c)).rlike(pattern), F.lit(False))
    number = lambda c, low, high: ~F.coalesce(F.col(c).between(low, high) & (F.col(c) == F.floor(c)), F.lit(False))
    problem = (
        F.when(bad("zip", r"^\d{5}\z"), "zip").when(F.col("state").isNotNull() & bad("state", r"(?i)^[A-Z]{2}\z"), "state").when(~F.coalesce(F.col("year").isin(*years), F.lit(False)), "year")
        .when(~F.coalesce((F.col("income") >= 0) & ~F.isnan("income") & (F.col("income") < float("inf")), F.lit(False)), "income").when(number("age", 0, OLDEST), "age")
        .when(F.col("household_size").isNotNull() & number("household_size", 1, MOST_PERSONS), "household_size")
        .when(F.coalesce("employer_offer", F.lit("none")) != "none", "employer_offer").when(F.col("household_size") > 1, "several_persons"))
    return requests.withColumn("problem", problem)


def valid_subjects(requests: DataFrame) -> DataFrame:
    """Requests with the doctors and drugs (arrays of npi and of rxcui) that count: trimmed NPIs of ten digits, the first
    MOST_DOCTORS, and drugs that are not blank, the first MOST_DRUGS."""
    clean = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit(""))))
    return requests.withColumns({
        "doctors": F.slice(F.filter(clean("doctors"), lambda x: x.rlike(r"^\d{10}\z")), 1, MOST_DOCTORS),
        "drugs": F.slice(F.filter(clean("drugs"), lambda x: x != ""), 1, MOST_DRUGS)})


def shortlist_problems(requests: DataFrame) -> DataFrame:
    """Shortlist requests (state, contract_year, rxcuis) with the first field that is not valid: state, contract_year, or the
    drugs, of which there are 1 to MOST_DRUGS different ones of one to eight digits."""
    drugs = F.array_distinct(F.transform(F.coalesce(F.col("rxcuis"), F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit("")))))
    good = F.size(drugs).between(1, MOST_DRUGS) & F.forall(drugs, lambda x: x.rlike(r"^\d{1,8}\z"))
    problem = (
        F.when(~F.coalesce(F.upper(F.trim("state")).rlike(r"^[A-Z]{2}\z"), F.lit(False)), "state")
        .when(~F.coalesce(F.col("contract_year").between(FIRST_YEAR, LAST_YEAR), F.lit(False)), "contract_year").when(~good, "rxcuis"))
    return requests.withColumn("problem", problem)


def set_problems(sets: DataFrame, entries: DataFrame) -> DataFrame:
    """For each plan set (set_id, plans) whether its entries (set_id, ordinal, plan_id, plan_id_type) are as many as
    it says, within bounds, numbered from 0 without gaps or repeats, and of known types with an id."""
    known = F.coalesce(F.col("plan_id_type").isin(*ID_TYPES) & (F.col("plan_id") != ""), F.lit(False))
    got = entries.groupBy("set_id").agg(
        F.count("*").alias("found"), F.min("ordinal").alias("first"), F.max("ordinal").alias("last"),
        F.count_distinct("ordinal").alias("different"), F.count_if(~known).alias("bad_rows"))
    rows = sets.join(got, "set_id", "left").fillna(0, ["found", "different", "bad_rows"])
    n = F.col("found")
    gap = ~F.coalesce((F.col("first") == 0) & (F.col("last") == n - 1) & (F.col("different") == n), F.lit(False))
    problem = F.when((n == 0) | (n > MOST_SET_PLANS), "count").when(n != F.col("plans"), "differs").when(gap, "ordinals").when(F.col("bad_rows") > 0, "metadata")
    return rows.select("set_id", "plans", "found", problem.alias("problem"))


def pair_counts(memberships: DataFrame) -> DataFrame:
    """Of memberships (file_url, npi, tin): different pairs and different providers of each file."""
    # The pairs are made distinct before a file's rows meet, so a large file is not one task's work.
    pairs = memberships.select("file_url", "npi", "tin").distinct()
    by_npi = pairs.groupBy("file_url", "npi").agg(F.count("*").alias("n"))
    return by_npi.groupBy("file_url").agg(F.count("*").alias("npis"), F.sum("n").alias("pairs"))


def occurrences(memberships: DataFrame) -> DataFrame:
    """How often each provider occurs, repeats included."""
    return memberships.groupBy("npi").agg(F.count("*").alias("occurrences"))


def run_report(profiles: DataFrame, rows: DataFrame) -> DataFrame:
    """One row of counts of a comparison run: profiles (profile_id, unavailable, basis, differences) and the
    compared rows (profile_id, differences) of those that were evaluated."""
    evaluated = profiles.where("unavailable IS NULL").select("profile_id")
    of_run = rows.join(evaluated, "profile_id", "left_semi").select(F.lit(False).alias("profile"), F.lit(None).cast("string").alias("unavailable"), F.lit(None).cast("string").alias("basis"), "differences")
    every = profiles.select(F.lit(True).alias("profile"), "unavailable", "basis", "differences").unionByName(of_run)
    profile, there, off = F.col("profile"), F.col("unavailable").isNull(), F.col("differences") > 0
    return every.agg(
        F.count_if(profile).alias("planned"), F.count_if(profile & there).alias("evaluated"), F.count_if(profile & ~there).alias("unavailable"),
        F.count_if(profile & there & (F.col("basis") == "federal_plan_rows")).alias("quoted"),
        F.count_if(profile & there & (F.col("basis") == "official_exchange_handoff")).alias("handed_off"),
        F.count_if(profile & there & off).alias("mismatched_profiles"), F.count_if(~profile).alias("compared_rows"), F.count_if(~profile & off).alias("mismatched_rows"))


def refresh_order(candidates: DataFrame, archives: DataFrame) -> DataFrame:
    """All candidates (source_key, url) in the order in which a refresh takes them: the smallest archived file
    (source_key, bytes; one row a key) first, those never archived last, then by URL."""
    return ranked(candidates.join(archives, "source_key", "left"), [F.asc_nulls_last("bytes"), F.asc("url")])


def refresh_states(candidates: DataFrame, blocks: DataFrame, prepared: DataFrame, policy: str) -> DataFrame:
    """What a refresh does with each candidate (source_key, url, etag): `blocked` with its reason if the same content
    was refused under this policy, `prepared` if it was made ready under it, else `fetch`. Of blocks (source_key, etag,
    policy, reason) and prepared (source_key, etag, policy) there is one row a key. Without an etag nothing is known."""
    same = lambda name: F.col(f"{name}.etag") == F.col("etag")
    known = lambda rows, name: rows.where(F.col("policy") == policy).select("source_key", F.struct("etag", *(c for c in ("reason",) if c in rows.columns)).alias(name))
    rows = candidates.join(known(blocks, "block"), "source_key", "left").join(known(prepared, "ready"), "source_key", "left")
    state = F.when(same("block"), "blocked").when(same("ready"), "prepared").otherwise("fetch")
    return rows.select("source_key", "url", state.alias("state"), F.when(same("block"), F.col("block.reason")).alias("reason"))


def reconcile_contexts(versions: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Versions of a visitor's context; what depends on a field that changed since the version before is cleared:
    a new household size makes the premium's basis unknown, a new doctor search drops the provider, a new plan or
    employer search the plan. The first version stays as it is. A visitor's versions are one window's rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = F.row_number().over(w) == 1
    changed = lambda c: ~first & ~F.lag(c).over(w).eqNullSafe(F.col(c))
    return versions.withColumns({
        "premium_basis": F.when(changed("household_size"), "unknown").otherwise(F.col("premium_basis")),
        "npi": F.when(changed("doctor_query"), "").otherwise(F.col("npi")),
        "plan_id": F.when(changed("plan_query") | changed("employer_query"), "").otherwise(F.col("plan_id"))})
