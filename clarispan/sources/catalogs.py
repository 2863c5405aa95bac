"""Manifests, seeds, lists and issuer files as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clarispan.functions.scalars import employer_name, url_identity
from clarispan.operators.network_files import first_payload
from clarispan.sources.text import pick, read_delimited

# Columns of a manifest, of an issuer seed, and how much of a rate file tells its schema.
MANIFEST = ["file_url", "file_description", "plan_name", "plan_id_type", "plan_id", "plan_market_type", "reporting_entity"]
SEED_TEXTS = ["legalName", "brand", "family", "transparencyPageUrl", "notes"]
PROBE_CHARS = 1 << 20
SAMPLES = 3


def read_allowlist(spark: SparkSession, path: str) -> DataFrame:
    """Rows (npi), a line each, without blanks."""
    return spark.read.text(path).select(F.trim(F.rtrim(F.regexp_replace("value", "\r$", ""))).alias("npi")).where("npi <> ''").distinct()


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a manifest that have all columns and a URL."""
    df = read_delimited(spark, path)
    rows = df.select(*[pick(df, [c]).alias(c) for c in MANIFEST], "ord")
    return rows.where((F.coalesce("file_url", F.lit("")) != "") & F.col("reporting_entity").isNotNull())


def manifest_links(rows: DataFrame) -> DataFrame:
    """The first row of each plan of a file; the market type is not part of the key."""
    return first_payload(rows, ["file_url", "plan_id_type", "plan_id", "plan_name"], ["ord"], ["plan_market_type", "reporting_entity"])


def read_manifest_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a manifest with plan_count and bytes; what is no digit is ignored, blank counts as zero."""
    df = read_delimited(spark, path)
    number = lambda c: F.coalesce(F.regexp_replace(c, "[^0-9]", "").try_cast("bigint"), F.lit(0).cast("bigint"))
    there = {c.lower() for c in df.columns}
    bytes_ = pick(df, ["content_length_bytes"]) if "content_length_bytes" in there else F.lit("")
    return df.select(pick(df, ["file_url"]).alias("url"), pick(df, ["file_description"]).alias("file_description"), number(pick(df, ["plan_count"])).alias("plan_count"), number(bytes_).alias("bytes"))


def read_employers(spark: SparkSession, path: str) -> DataFrame:
    """Employers of line-JSON; lines without a nine-digit ein and a name go, a missing name_norm is derived."""
    spec = "ein string, name string, name_norm string, state string, plan_name string, participants double, plan_year double"
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    rows = spark.read.text(path).select(F.from_json("value", spec).alias("e")).select("e.*")
    rows = rows.withColumns({"ein": F.trim("ein"), "name": blank("name")}).withColumn("name_norm", F.coalesce(blank("name_norm"), employer_name(F.col("name"))))
    whole = F.when(F.col("plan_year") == F.floor("plan_year"), F.col("plan_year").cast("int"))
    return rows.where(F.col("ein").rlike(r"^\d{9}$") & F.col("name").isNotNull() & (F.col("name_norm") != "")).select(
        "ein", "name", "name_norm", blank("state").alias("state"), blank("plan_name").alias("plan_name"), "participants", whole.alias("plan_year"))


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Issuers of a JSON array: texts default to empty, a footprint is `national` or a list of states."""
    spec = f"array<struct<key: string, {', '.join(f'{c}: string' for c in SEED_TEXTS)}, footprint: string, indexUrl: string, haveData: string>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", spec)).alias("s")).select("s.*")
    key = F.when(F.coalesce("key", F.lit("")) != "", F.col("key")).otherwise(F.raise_error(F.lit("an issuer seed is missing its key")))
    states = F.coalesce(F.from_json("footprint", "array<string>"), F.array().cast("array<string>"))
    return rows.select(key.alias("key"), *[F.coalesce(c, F.lit("")).alias(c) for c in SEED_TEXTS], (F.col("footprint") == "national").alias("national"), states.alias("states"), "indexUrl", (F.lower(F.coalesce("haveData", F.lit(""))) == "true").alias("haveData"))


def issuer_records(text: Column, wrapper: str, spec: str) -> Column:
    """Records of an issuer's file, which is an array or an object that wraps it; other shapes are empty."""
    plain, wrapped = F.from_json(text, f"array<{spec}>"), F.from_json(F.get_json_object(text, f"$.{wrapper}"), f"array<{spec}>")
    return F.when(F.ltrim(text).startswith("["), F.coalesce(plain, F.array())).otherwise(F.coalesce(wrapped, F.array()))


def plans_of_source(structures: DataFrame, url: str, needed: bool = False) -> DataFrame:
    """Distinct plans of the structures (plans, files) that name a file. Needed: having none is an error."""
    named = structures.where(F.exists("files", lambda f: f["location"] == url)).select(F.explode("plans").alias("p")).select("p.*")
    found = named.withColumn("plan_id_type", F.lower("plan_id_type")).distinct()
    if needed and found.isEmpty():
        raise ValueError("no plan names this source")
    return found


def selected_contents(structures: DataFrame, selected: DataFrame) -> DataFrame:
    """Distinct plans (identity, plan_id_type, plan_id, plan_name) of selected files (url): URLs meet by
    their identity without signatures."""
    wanted = selected.select(url_identity(F.col("url")).alias("identity")).distinct()
    rows = structures.select(F.explode("files").alias("f"), "plans").select(url_identity(F.col("f.location")).alias("identity"), F.explode("plans").alias("p"))
    return rows.join(wanted, "identity", "left_semi").select("identity", F.lower("p.plan_id_type").alias("plan_id_type"), "p.plan_id", "p.plan_name").distinct()


def validate_index(structures: DataFrame) -> DataFrame:
    """Per reporting entity (structures in order `ord`): how many structures and file locations it has, the
    first SAMPLES locations, and whether that makes an index."""
    places = structures.withColumn("n", F.array_compact(F.transform("files", lambda f: F.when(F.trim(f["location"]) != "", f["location"]))))
    g = places.groupBy("reporting_entity").agg(
        F.count("*").alias("structures"), F.sum(F.size("n").cast("long")).alias("locations"),
        F.min(F.when(F.size("n") > 0, F.struct("ord", F.slice("n", 1, SAMPLES).alias("n")))).alias("first"))
    ok = F.col("reporting_entity").isNotNull() & (F.col("locations") > 0)
    return g.select("reporting_entity", "structures", "locations", F.col("first.n").alias("sample"), F.when(~ok, "not an index").alias("error"))


def rate_schema(text: Column) -> Column:
    """v1 if a rate file's beginning has a table of references, v2 if groups are inline."""
    head = F.substring(text, 1, PROBE_CHARS)
    return F.when(head.contains('"provider_references"'), "v1").when(head.contains('"provider_groups"'), "v2").otherwise("unknown")


def by_plan_and_state(manifest: DataFrame, plan_pattern: str | None = None, state: str | None = None) -> DataFrame:
    """Manifest rows whose plan name matches a pattern, and whose names or URL hold a state as a token."""
    if plan_pattern:
        manifest = manifest.where(F.col("plan_name").rlike(f"(?i){plan_pattern}"))
    if state:
        text = F.concat_ws(" ", "plan_name", "file_description", "file_url")
        manifest = manifest.where(text.rlike(rf"(?i)(^|[-_\s])\Q{state.strip()}\E(?=$|[-_\s])"))
    return manifest
