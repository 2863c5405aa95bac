"""Files that readers of this library and others take: ordered tables and line-JSON, and a store of plan sets.

Each writer sorts by range partitions, so part files follow each other in order and no task holds a whole table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clarispan.operators.network_files import plan_counts, plan_set_ids, tiers
from clarispan.sources.catalogs import MANIFEST
from clarispan.sources.text import store_of, write_lines, write_table

# Fields of the files, in their order.
MEMBERSHIP = ["npi", "tin_type", "tin_value", "file_url", "reporting_entity", "last_updated_on", "schema"]
EMPLOYER = ["ein", "name", "name_norm", "state", "plan_name", "participants", "form", "plan_year"]
FORMULARY = ["formulary_id", "contract_year", "rxcui", "tier", "prior_authorization", "step_therapy", "quantity_limit", "quantity_limit_amount", "quantity_limit_days"]
DRUG_PLAN = ["contract_id", "plan_id", "segment_id", "plan_name", "formulary_id", "state", "county_code", "region"]
ISSUER = ["key", "indexUrl", "reachable", "httpStatus", "contentLength", "gzip", "reportingEntityName", "reportingStructures", "inNetworkFileCount", "countExact", "sampleFileLocations", "rateSchema", "error"]
TIER = ["file_url", "file_description", "plan_count", "content_length_bytes"]
PLAN = ["plan_name", "plan_id_type", "plan_id", "plan_market_type"]


def _fields(df: DataFrame, names: list[str]) -> DataFrame:
    """Those of the fields that are there, in their order."""
    there = {c.lower() for c in df.columns}
    return df.select(*[n for n in names if n.lower() in there])


def write_memberships(rows: DataFrame, path: str) -> None:
    """Memberships as line-JSON, in the order of whole lines."""
    line = F.to_json(F.struct(*_fields(rows, MEMBERSHIP).columns))
    rows.select(line.alias("value")).orderBy("value").write.mode("overwrite").text(path)


def write_manifest(rows: DataFrame, path: str, files_path: str) -> None:
    """A manifest (MANIFEST), by URL and then its other fields, and beside it the files with their counts of plans."""
    rows = rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in MANIFEST])
    write_table(rows, path, ["file_url", *[c for c in MANIFEST if c != "file_url"]])
    files = rows.groupBy("file_url").agg(F.min("file_description").alias("file_description"))
    links = rows.withColumnRenamed("file_url", "file_id")
    counted = plan_counts(files.withColumn("file_id", F.col("file_url")), links)
    write_table(counted.select("file_url", "file_description", "plan_count"), files_path, ["file_url"])


def write_employers(rows: DataFrame, path: str) -> None:
    write_lines(_fields(rows, EMPLOYER), path, ["name_norm", "ein"])


def write_part_d(formulary: DataFrame, plans: DataFrame, formulary_path: str, plans_path: str) -> None:
    """Drugs by (formulary, drug) and plans by their ids; what is null is left out."""
    write_lines(_fields(formulary, FORMULARY), formulary_path, ["formulary_id", "rxcui"])
    write_lines(_fields(plans, DRUG_PLAN), plans_path, [c for c in ("contract_id", "plan_id", "segment_id", "formulary_id", "state", "county_code", "region") if c in plans.columns])


def write_tiers(files: DataFrame, path_a: str, path_b: str, least_plans: int, most_bytes: int, url_part: str = "") -> None:
    """Tier A, small files with many plans first, and tier B, large files with the largest first."""
    for (rows, order), path in zip(zip(tiers(files, least_plans, most_bytes, url_part), (["plan_count", "url"], ["bytes", "url"])), (path_a, path_b)):
        named = rows.select(F.col("url").alias("file_url"), F.coalesce("file_description", F.lit("")).alias("file_description"), "plan_count", F.col("bytes").alias("content_length_bytes"))
        first = F.desc("plan_count" if order[0] == "plan_count" else "content_length_bytes")
        named.select(*TIER).orderBy(first, "file_url").write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_issuers(rows: DataFrame, path: str) -> None:
    """Resolved issuers by key; nulls are written as such."""
    _fields(rows, ISSUER).orderBy("key").write.mode("overwrite").option("ignoreNullFields", False).json(path)


class PlanSets:
    """Sets of plans stored once under the digest of what they hold.

    A batch of new sets is written aside, read back, and its digests are worked out again; only if all agree does a row
    for each set make it part of the store. A batch without such rows, left by a run that ended, is never read. One
    writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.root}/{name}"
        there = store_of(self.spark, path).exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path))
        return self.spark.read.schema(schema).parquet(path) if there else self.spark.createDataFrame([], schema)

    def sets(self) -> DataFrame:
        """Rows (set_id, plans, batch)."""
        return self._read("sets", "set_id string, plans long, batch string")

    def entries(self) -> DataFrame:
        """Rows (set_id, plan fields) of all sets."""
        kept = self.sets().select("set_id", "batch")
        fields = ", ".join(f"{c} string" for c in PLAN)
        return self._read("entries", f"set_id string, {fields}, batch string").join(kept, ["set_id", "batch"], "left_semi").select("set_id", *PLAN)

    def files(self) -> DataFrame:
        """Rows (file_id, set_id)."""
        return self._read("files", "file_id string, set_id string")

    def store(self, links: DataFrame) -> DataFrame:
        """Stores the sets of files' plans (file_id, plan fields) and which file has which; rows (file_id, set_id)."""
        links = links.select(F.col("file_id").cast("string").alias("file_id"), *[F.coalesce(c, F.lit("")).alias(c) for c in PLAN]).distinct()
        of_file = plan_set_ids(links).select("file_id", "set_id")
        batch = uuid.uuid4().hex
        part = f"{self.root}/entries/batch={batch}"
        one = of_file.join(self.sets(), "set_id", "left_anti").groupBy("set_id").agg(F.min("file_id").alias("file_id"))
        links.join(one, "file_id").select("set_id", *PLAN).write.parquet(part)
        written = self.spark.read.schema(f"set_id string, {', '.join(f'{c} string' for c in PLAN)}").parquet(part)
        if plan_set_ids(written.withColumnRenamed("set_id", "file_id")).where("set_id <> file_id").limit(1).count():
            store_of(self.spark, part).delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(part), True)
            raise RuntimeError("a plan set that was read back has another digest")
        sizes = written.groupBy("set_id").agg(F.count("*").alias("plans")).withColumn("batch", F.lit(batch))
        sizes.write.mode("append").parquet(f"{self.root}/sets")
        of_file.join(self.files(), ["file_id", "set_id"], "left_anti").write.mode("append").parquet(f"{self.root}/files")
        return of_file

    def damaged(self) -> DataFrame:
        """Sets (set_id) whose stored plans have another digest or number than they should."""
        found = plan_set_ids(self.entries().withColumnRenamed("set_id", "file_id")).select(F.col("file_id").alias("set_id"), F.col("set_id").alias("digest"))
        counted = self.entries().groupBy("set_id").agg(F.count("*").alias("there"))
        rows = self.sets().join(found, "set_id", "left").join(counted, "set_id", "left")
        return rows.where(~F.coalesce((F.col("digest") == F.col("set_id")) & (F.col("there") == F.col("plans")), F.lit(False))).select("set_id")
