"""Large nested JSON documents as rows, and small ones by Spark's own reader.

A network file can be one object far larger than a task's memory, so its reader walks the text piece
by piece and yields one row for each element of the arrays it is asked for.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from clarispan.sources.strict_json import Scanner
from clarispan.sources.zip_file import open_json_member

ROW = "file string, path string, ord long, value string"
PROVIDER_GROUP = "struct<npi: array<string>, tin: struct<type: string, value: string>>"


def open_bytes(path: str):
    """A file by its path, or by the URI of a store."""
    if "://" not in path:
        return open(path, "rb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def open_text(path: str):
    """A text stream of plain, gzip (by its magic bytes) or single-member ZIP data; what follows a gzip's or ZIP
    member's data is checked when the stream has been read to its end."""
    f = open_bytes(path)
    magic = f.read(4)
    f.seek(0)
    data = gzip.GzipFile(fileobj=f) if magic[:2] == b"\x1f\x8b" else open_json_member(f) if magic == b"PK\x03\x04" else f
    return io.TextIOWrapper(data, encoding="utf-8-sig", newline="")


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = [p for p in options["files"].split("\n") if p]
        self.wanted = {p for p in options["paths"].split("\n") if p}
        self.containing = [t for t in options.get("containing", "").split("\n") if t]

    def partitions(self):
        return [_File(p) for p in self.files]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open_text(partition.path) as stream:
            for n, (path, value) in enumerate(Scanner(stream, self.wanted).walk()):
                if not self.containing or value is None or value[:1] not in "{[" or any(t in value for t in self.containing):
                    yield partition.path, path, n, value


class NestedJson(DataSource):
    """`nested_json`: options `files` and `paths`, one a line; a task for each file. `containing`, texts one a line: objects
    and arrays in which none of them occurs stay behind. Files are read by paths that every executor mounts, or URIs."""

    @classmethod
    def name(cls) -> str:
        return "nested_json"

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_elements(spark: SparkSession, files: list[str], paths: list[str], containing: list[str] = ()) -> DataFrame:
    """Rows (file, path, ord, value): value is an element's JSON text, a string itself, or null. Documents that are not
    JSON throughout, or pass the reader's bounds, are errors."""
    spark.dataSource.register(NestedJson)
    reader = spark.read.format("nested_json").option("files", "\n".join(files)).option("paths", "\n".join(paths))
    return reader.option("containing", "\n".join(containing)).load()


GROUPS = "in_network.*.negotiated_rates.*.provider_groups.*"
USES = "in_network.*.negotiated_rates.*.provider_references.*"
REFERENCES = "provider_references.*"
BARE = "provider_groups.*"


TABLE = "provider_references?"
REFERENCE = f"struct<provider_group_id: string, location: string, provider_groups: array<{PROVIDER_GROUP}>>"


def network_file(spark: SparkSession, files: list[str], documents: DataFrame | None = None) -> dict[str, DataFrame]:
    """Of network files: `groups` (file_id, ord, tin_type, tin_value, npi), ord a struct, `metadata`, and `references`
    (file_id, ref_id, ord, location, gs) and `uses` (file_id, ref_id, ord) of their tables.

    A file with a table of references, if only an empty one, uses those; others have their groups inline. References that
    name a location take their groups from `documents` (location, path), files fetched before: a document's table adds
    the references it has, and one of bare groups gives them to the reference that names it.
    """
    from clarispan.operators.network_files import used_reference_groups

    rows = read_elements(spark, files, [GROUPS, USES, TABLE, REFERENCES, "reporting_entity_name", "last_updated_on", "version"])
    group = F.from_json("value", PROVIDER_GROUP)
    flat = lambda g: [g["tin"]["type"].alias("tin_type"), g["tin"]["value"].alias("tin_value"), g["npi"].alias("npi")]
    tabled = rows.where(F.col("path") == TABLE).select("file").distinct()
    inline = rows.where(F.col("path") == GROUPS).join(tabled, "file", "left_anti").select(F.col("file").alias("file_id"), "ord", group.alias("g"))
    uses = rows.where(F.col("path") == USES).select(F.col("file").alias("file_id"), F.trim("value").alias("ref_id"), "ord")
    refs = rows.where(F.col("path") == REFERENCES).select(F.col("file").alias("file_id"), "ord", F.from_json("value", REFERENCE).alias("r"))
    refs = refs.select("file_id", F.trim("r.provider_group_id").alias("ref_id"), "ord", F.col("r.location").alias("location"), F.col("r.provider_groups").alias("gs"))
    known = refs.where("gs IS NOT NULL").select("file_id", "ref_id", "ord", "gs")
    if documents is not None:
        known = known.unionByName(located_references(spark, refs, documents))
    used = used_reference_groups(uses, known).select("file_id", "ord", F.posexplode("gs").alias("k", "g"))
    place = lambda k: F.struct(F.col("ord").alias("at"), k.alias("k")).alias("ord")
    groups = inline.select("file_id", place(F.lit(0)), *flat(F.col("g"))).unionByName(
        used.select("file_id", place(F.col("k")), *flat(F.col("g"))))
    meta = rows.where(~F.col("path").contains("*") & (F.col("path") != TABLE)).groupBy(F.col("file").alias("file_id")).pivot("path", ["reporting_entity_name", "last_updated_on", "version"]).agg(F.max_by("value", "ord"))
    return {"groups": groups, "metadata": meta, "references": refs, "uses": uses}


def located_references(spark: SparkSession, refs: DataFrame, documents: DataFrame) -> DataFrame:
    """References (file_id, ref_id, ord, gs) that the documents at refs' locations hold."""
    paths = documents.join(refs.select("location").distinct(), "location", "left_semi")
    named = [r["path"] for r in paths.select("path").distinct().collect()]  # a task a file: their names make the scan
    named_by = refs.where("gs IS NULL AND location IS NOT NULL").join(documents, "location").select("file_id", "path", "ord", F.col("ref_id").alias("own_id"))
    found = reference_documents(spark, named).select(F.col("file_id").alias("path"), "ref_id", "gs", F.col("ord").alias("k"))
    rows = named_by.join(found, "path")
    of_table = rows.where("ref_id IS NOT NULL").groupBy("file_id", "ref_id", "ord").agg(F.max_by("gs", "k").alias("gs"))
    bare = rows.where("ref_id IS NULL").groupBy("file_id", F.col("own_id").alias("ref_id"), "ord").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "gs"))), lambda x: x["gs"])).alias("gs"))
    return of_table.unionByName(bare)


def reference_documents(spark: SparkSession, files: list[str]) -> DataFrame:
    """References (file_id, ref_id, ord, gs) of documents that a network file names instead of its own groups: their
    own table of references, or, if that has no entry with an id, their bare groups, whose ref_id is null."""
    rows = read_elements(spark, files, [REFERENCES, BARE]).withColumnRenamed("file", "file_id")
    spec = f"struct<provider_group_id: string, provider_groups: array<{PROVIDER_GROUP}>>"
    tabled = rows.where(F.col("path") == REFERENCES).select("file_id", "ord", F.from_json("value", spec).alias("r")).where("trim(r.provider_group_id) <> '' AND r.provider_groups IS NOT NULL")
    tabled = tabled.select("file_id", F.trim("r.provider_group_id").alias("ref_id"), "ord", F.col("r.provider_groups").alias("gs"))
    bare = rows.where(F.col("path") == BARE).join(tabled.select("file_id").distinct(), "file_id", "left_anti")
    return tabled.unionByName(bare.select("file_id", F.lit(None).cast("string").alias("ref_id"), "ord", F.array(F.from_json("value", PROVIDER_GROUP)).alias("gs")))


def table_of_contents(spark: SparkSession, files: list[str]) -> DataFrame:
    """Structures (reporting_entity, plans, files) of table-of-contents files."""
    rows = read_elements(spark, files, ["reporting_structure.*", "reporting_entity_name"])
    entity = rows.where("path = 'reporting_entity_name'").groupBy("file").agg(F.max_by("value", "ord").alias("reporting_entity"))
    spec = "struct<reporting_plans: array<struct<plan_name: string, plan_id_type: string, plan_id: string, plan_market_type: string>>, in_network_files: array<struct<description: string, location: string>>>"
    found = rows.where("path = 'reporting_structure.*'").select("file", F.from_json("value", spec).alias("s"))
    return found.join(entity, "file", "left").select("reporting_entity", F.col("s.reporting_plans").alias("plans"), F.col("s.in_network_files").alias("files"))
