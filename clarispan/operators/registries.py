"""Provider and employer registries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from clarispan.functions.scalars import contains_text, employer_name, has_health_benefit
from clarispan.operators.network_files import first_payload


def any_prefix(column: Column, prefixes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [column.startswith(p) for p in prefixes]) if prefixes else F.lit(True)


def npi_allowlist(rows: DataFrame, state: str, zips: list[str] = (), taxonomies: list[str] = (), entity: str | None = None) -> DataFrame:
    """Active providers of a state, the first row of each NPI. Rows: npi, entity_type, organization,
    last_name, first_name, state, postal_code, taxonomy, deactivated, reactivated, ord."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    active = blank(F.col("deactivated")) | ~blank(F.col("reactivated"))
    kept = rows.where(active & (F.upper(F.trim("state")) == state.upper()))
    kept = kept.where(any_prefix(F.regexp_replace("postal_code", r"\D", ""), [*zips]) & any_prefix(F.col("taxonomy"), [*taxonomies]))
    if entity:
        kept = kept.where(F.col("entity_type") == entity)
    name = F.when(~blank(F.col("organization")), F.trim("organization")).otherwise(F.concat_ws(", ", F.nullif(F.trim("last_name"), F.lit("")), F.nullif(F.trim("first_name"), F.lit(""))))
    kept = kept.where(F.col("npi").rlike(r"^\d{10}$")).withColumn("name", name)
    return first_payload(kept, ["npi"], ["ord"], ["name", "state", "postal_code", "taxonomy"])


def npi_audit(rows: DataFrame) -> DataFrame:
    """What the allowlist drops: one row of counts."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    off = ~blank(F.col("deactivated")) & blank(F.col("reactivated"))
    return rows.agg(F.count("*").alias("rows_scanned"), F.count_if(off).alias("deactivated"), F.count_if(~off & ~F.col("npi").rlike(r"^\d{10}$")).alias("malformed_npi"))


def employers(rows: DataFrame, counters: Observation | None = None, health_only: bool = True) -> DataFrame:
    """Sponsors of health plans: one row for each (ein, name_norm), the one with most participants, the
    first of equals. Rows: name, ein, state, plan_name, welfare_code, participants, plan_year, ord.

    Counters are filled in by the pass that reads: rows_scanned, kept, dropped_non_health, dropped_bad_ein; rows without a
    name are in none of the last three.
    """
    healthy = F.coalesce(has_health_benefit(F.col("welfare_code")), F.lit(False)) if health_only else F.lit(True)
    out = rows.withColumns({"ein": F.regexp_replace("ein", r"\D", ""), "name_norm": employer_name(F.col("name")), "__healthy": healthy})
    out = out.withColumns({"__good": F.coalesce(F.col("ein").rlike(r"^\d{9}$"), F.lit(False)), "__named": F.coalesce(F.col("name_norm") != "", F.lit(False))})
    if counters is not None:
        healthy, good, named = F.col("__healthy"), F.col("__good"), F.col("__named")
        out = out.observe(
            counters, F.count("*").alias("rows_scanned"), F.count_if(healthy & good & named).alias("kept"), F.count_if(~healthy).alias("dropped_non_health"),
            F.count_if(healthy & ~good).alias("dropped_bad_ein"))
    out = out.where("__healthy AND __good AND __named").withColumn("less", -F.coalesce("participants", F.lit(-1)))
    return first_payload(out, ["ein", "name_norm"], ["less", "ord"], ["name", "state", "participants"])


def search_employers(found: DataFrame, query: str, limit: int = 10) -> DataFrame:
    return found.where(contains_text(F.col("name_norm"), query)).orderBy(F.desc_nulls_last("participants"), "name", "ein").limit(limit)


def backfill_regions(plans: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Plans with the last update's region where there is one (updates: keys, region, ord)."""
    last = updates.groupBy(*keys).agg(F.max_by("region", "ord").alias("__region"))
    return plans.join(last, keys, "left").withColumn("region", F.coalesce("__region", "region")).drop("__region")
