"""Delimited text and line-JSON sources with explicit columns."""

from __future__ import annotations

import re
import uuid
import zipfile
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from clarispan.shared import shared_folder
from clarispan.sources.nested_json import open_bytes

# Header names of the provider registry.
NPPES = {
    "npi": "NPI",
    "entity_type": "Entity Type Code",
    "organization": "Provider Organization Name (Legal Business Name)",
    "last_name": "Provider Last Name (Legal Name)",
    "first_name": "Provider First Name",
    "state": "Provider Business Practice Location Address State Name",
    "postal_code": "Provider Business Practice Location Address Postal Code",
    "taxonomy": "Healthcare Provider Taxonomy Code_1",
    "deactivated": "NPI Deactivation Date",
    "reactivated": "NPI Reactivation Date",
}
# Header names of the employer plan forms, in order of preference.
FORM_5500 = {
    "name": ["SPONSOR_DFE_NAME", "SF_SPONSOR_NAME"],
    "ein": ["SPONS_DFE_EIN", "SF_SPONS_EIN"],
    "state": ["SPONS_DFE_MAIL_US_STATE", "SF_SPONS_US_STATE"],
    "plan_name": ["PLAN_NAME", "SF_PLAN_NAME"],
    "welfare_code": ["TYPE_WELFARE_BNFT_CODE", "SF_TYPE_WELFARE_BNFT_CODE"],
    "participants": ["TOT_ACT_PARTCP_BOY_CNT", "SF_TOT_ACT_PARTCP_BOY_CNT", "TOT_ACTIVE_PARTCP_CNT", "SF_TOT_ACT_PARTCP_EOY_CNT"],
    "plan_year": ["FORM_PLAN_YEAR_BEGIN_DATE", "FORM_TAX_PRD", "SF_PLAN_YEAR_BEGIN_DATE", "SF_TAX_PRD"],
}
# Header names of the drug plan files.
FORMULARY = {
    "formulary_id": "FORMULARY_ID", "contract_year": "CONTRACT_YEAR", "rxcui": "RXCUI", "tier": "TIER_LEVEL_VALUE",
    "quantity_limit": "QUANTITY_LIMIT_YN", "quantity_limit_amount": "QUANTITY_LIMIT_AMOUNT", "quantity_limit_days": "QUANTITY_LIMIT_DAYS",
    "prior_authorization": "PRIOR_AUTHORIZATION_YN", "step_therapy": "STEP_THERAPY_YN",
}


def read_delimited(spark: SparkSession, path: str, sep: str = ",", quoted: bool = True) -> DataFrame:
    """All columns as text, trimmed, headers without marks and outer blanks. `ord` is a row's place: its file's name, the
    block of the file, and its number in the block's task, which reads a block's rows in order."""
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", "UTF-8").option("escape", '"')
    df = reader.option("quote", '"' if quoted else "").csv(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return df.select(*[F.trim(F.col(f"`{c}`")).alias(c.lstrip("﻿").strip()) for c in df.columns], place.alias("ord"))


def pick(df: DataFrame, names: list[str]) -> Column:
    """The first of the named columns that is there, whatever its case."""
    there = {c.upper(): c for c in df.columns}
    for n in names:
        if n.upper() in there:
            return F.col(f"`{there[n.upper()]}`")
    raise ValueError(f"none of the columns {names} is there")


def read_nppes(spark: SparkSession, path: str) -> DataFrame:
    df = read_delimited(spark, path)
    return df.select(*[pick(df, [v]).alias(k) for k, v in NPPES.items()], "ord")


def read_form_5500(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows of several files, in their order."""
    out = None
    for n, path in enumerate(paths):
        df = read_delimited(spark, path)
        year = F.regexp_extract(pick(df, FORM_5500["plan_year"]), r"\b((?:19|20)\d{2})\b", 1).try_cast("int").alias("plan_year")
        part = df.select(
            *[pick(df, v).alias(k) for k, v in FORM_5500.items() if k not in ("participants", "plan_year")],
            F.regexp_replace(pick(df, FORM_5500["participants"]), r"\D", "").try_cast("int").alias("participants"), year,
            F.lit("5500-SF" if any(c.upper().startswith("SF_") for c in df.columns) else "5500").alias("form"), F.struct(F.lit(n).alias("file"), F.col("ord").alias("line")).alias("ord"))
        out = part if out is None else out.unionByName(part)
    return out


# Header names of the drug plan files' plans, their places in order of preference, and what members' names hold.
DRUG_PLANS = {"contract_id": "CONTRACT_ID", "plan_id": "PLAN_ID", "segment_id": "SEGMENT_ID", "plan_name": "PLAN_NAME", "formulary_id": "FORMULARY_ID"}
PLACES = {"state": ["STATE"], "county_code": ["COUNTY_CODE"], "region": ["PDP_REGION_CODE", "MA_REGION_CODE", "REGION", "REGION_CODE"]}
FORMULARY_MEMBER, PLANS_MEMBER = "basic drugs formulary", "plan information"


def yes_no(c: Column) -> Column:
    return F.when(F.upper(c) == "Y", True).when(F.upper(c) == "N", False)


def choose_member(names: list[str], holds: str) -> str:
    """The first, in binary order, of the files whose names hold some words, whatever separates them."""
    plain = {n: " ".join(re.sub(r"[._/-]+", " ", n.lower()).split()) for n in names}
    found = sorted(n for n, p in plain.items() if holds in p)
    if not found:
        raise ValueError(f"no file is named like {holds!r}")
    return found[0]


def read_drug_plans(spark: SparkSession, path: str) -> DataFrame:
    """The first row of each plan: contract, plan, segment, formulary and place, of which a row has the first of state, county
    and region that is not blank. Rows without one of the four ids go."""
    from clarispan.operators.network_files import first_payload

    df = read_delimited(spark, path, "|", quoted=False)
    there = {c.upper() for c in df.columns}
    places = {k: pick(df, v) if there & {*v} else F.lit("") for k, v in PLACES.items()}
    rows = df.select(*[F.coalesce(pick(df, [v]), F.lit("")).alias(k) for k, v in DRUG_PLANS.items()], *[F.nullif(c, F.lit("")).alias(k) for k, c in places.items()], "ord")
    rows = rows.where("contract_id <> '' AND plan_id <> '' AND segment_id <> '' AND formulary_id <> ''")
    kind = F.coalesce(*[F.when(F.col(k).isNotNull(), k) for k in PLACES])
    rows = rows.withColumns({"place_kind": kind, "place": F.coalesce(*PLACES)})
    keys = ["contract_id", "plan_id", "segment_id", "formulary_id"]
    g = rows.groupBy(*keys, "place_kind", "place").agg(F.min_by("plan_name", "ord").alias("plan_name"))
    return g.select(*keys, "plan_name", *[F.when(F.col("place_kind") == k, F.col("place")).alias(k) for k in PLACES])


def read_part_d(spark: SparkSession, source: str) -> tuple[DataFrame, DataFrame]:
    """Formulary and plans of a folder of drug plan files, below it too, or of a ZIP file, whose members are unpacked to the
    shared folder first. Names choose the files."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.getFileStatus(path).isDirectory():
        found, each = [], store.listFiles(path, True)
        while each.hasNext():
            found.append(each.next().getPath().toString())
        return read_formulary(spark, choose_member(found, FORMULARY_MEMBER)), read_drug_plans(spark, choose_member(found, PLANS_MEMBER))
    with open_bytes(source) as f, zipfile.ZipFile(f) as archive:
        names = [m.filename for m in archive.infolist() if not m.is_dir()]
        chosen = [choose_member(names, holds) for holds in (FORMULARY_MEMBER, PLANS_MEMBER)]
        folder = f"{shared_folder(spark)}/part-d-{uuid.uuid4().hex}"
        for name in chosen:  # a piece at a time
            out = store_of(spark, folder).create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name.rsplit('/', 1)[-1]}"))
            with archive.open(name) as member:
                while piece := member.read(1 << 22):
                    out.write(piece)
            out.close()
    return read_formulary(spark, f"{folder}/{chosen[0].rsplit('/', 1)[-1]}"), read_drug_plans(spark, f"{folder}/{chosen[1].rsplit('/', 1)[-1]}")


def store_of(spark: SparkSession, folder: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_formulary(spark: SparkSession, path: str, counters: Observation | None = None) -> DataFrame:
    """The first row of each (formulary, drug); flags other than Y and N are null, a tier or year that is
    not a number is an error. Counters are filled in by the pass that reads: formulary_rows, missing_yn_values (flags
    that are neither Y nor N, of rows with both ids)."""
    from clarispan.operators.network_files import first_payload

    df = read_delimited(spark, path, "|", quoted=False)
    rows = df.select(*[F.coalesce(pick(df, [v]), F.lit("")).alias(k) for k, v in FORMULARY.items()], "ord")
    if counters is not None:
        whole = (F.col("formulary_id") != "") & (F.col("rxcui") != "")
        missing = reduce(lambda a, b: a + b, [(~F.upper(c).isin("Y", "N")).cast("long") for c in ("quantity_limit", "prior_authorization", "step_therapy")])
        rows = rows.observe(counters, F.count("*").alias("formulary_rows"), F.coalesce(F.sum(F.when(whole, missing)), F.lit(0)).alias("missing_yn_values"))
    rows = rows.where("formulary_id <> '' AND rxcui <> ''")
    rows = rows.select(
        "formulary_id", F.col("contract_year").cast("int").alias("contract_year"), "rxcui", F.nullif("tier", F.lit("")).cast("int").alias("tier"),
        *[yes_no(F.col(c)).alias(c) for c in ("quantity_limit", "prior_authorization", "step_therapy")],
        F.col("quantity_limit_amount").try_cast("double").alias("quantity_limit_amount"), F.col("quantity_limit_days").try_cast("int").alias("quantity_limit_days"), "ord")
    keys = ["formulary_id", "rxcui"]
    return first_payload(rows, keys, ["ord"], [c for c in rows.columns if c not in (*keys, "ord")])


MEMBERSHIP = "npi string, tin_type string, tin_value string, file_url string, reporting_entity string, last_updated_on string, schema string"


def read_memberships(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Memberships of line-JSON. Tolerant: lines without npi, tin or file go, blanks become `unknown`.
    Strict: any bad line is an error."""
    rows = spark.read.text(path).select(F.from_json("value", MEMBERSHIP).alias("m"), "value").select("m.*", "value")
    present = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    ok = present("npi") & present("tin_value") & present("file_url")
    if strict:
        good = ok & F.col("npi").rlike(r"^\d{10}$") & F.col("file_url").startswith("https://") & F.col("last_updated_on").rlike(r"^\d{4}-\d{2}-\d{2}$")
        checked = F.when(F.coalesce(good, F.lit(False)), F.col("npi")).otherwise(F.raise_error(F.concat(F.lit("bad membership line: "), F.substring("value", 1, 200))))
        return rows.withColumn("npi", checked).drop("value")
    fill = lambda c: F.when(present(c), F.col(c)).otherwise("unknown").alias(c)
    return rows.where(ok).select("npi", fill("tin_type"), "tin_value", "file_url", fill("reporting_entity"), "last_updated_on", "schema")


def write_lines(df: DataFrame, path: str, order: list[str]) -> None:
    """Line-JSON in the binary order of some columns, as ordered part files; nulls are left out."""
    df.orderBy(*order).write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str, order: list[str]) -> None:
    """CSV with minimal quoting in the binary order of some columns, as ordered part files."""
    df.orderBy(*order).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_allowlist(found: DataFrame, path: str, meta_path: str) -> None:
    """The allowlist's NPIs, one a line, and a CSV of what is known of each, both in the order of the NPI."""
    found.orderBy("npi").select("npi").write.mode("overwrite").text(path)
    write_table(found, meta_path, ["npi"])
