"""State of the serving tables: readiness, ledgers, loads, supervision, packed buckets."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clarispan.functions.scalars import fresh_file
from clarispan.operators.network_files import first_by

BUCKET = "file_id string, prefix string, count long, raw_sha256 string, payload_sha256 string, payload binary"
SUFFIXES = 1_000_000
#: Memberships of a task that packs; tasks grow in number with them.
PACK_ROWS = 400_000


def ready_files(files: DataFrame, index: DataFrame, memberships: DataFrame, links: DataFrame, sets: DataFrame, as_of: Column) -> DataFrame:
    """Active, fresh files with providers (an index of some rows, or memberships) and plans (links or a set)."""
    fresh = files.where(F.col("active") & fresh_file(F.col("source_last_updated"), as_of))
    providers = index.where("npi_count > 0").select("file_id").union(memberships.select("file_id"))
    plans = links.select("file_id").union(sets.select("file_id"))
    return fresh.join(providers, "file_id", "left_semi").join(plans, "file_id", "left_semi")


def is_ready(rows: DataFrame) -> bool:
    """Whether there is any row; one is looked for, none is counted."""
    return bool(rows.limit(1).count())


def orphan_sets(sets: DataFrame, file_sets: DataFrame) -> DataFrame:
    """Plan sets that no file uses any more."""
    return sets.join(file_sets, "set_id", "left_anti")


def bare_url(url: Column) -> Column:
    return F.split_part(url, F.lit("?"), F.lit(1))


def ledger_files(ledger: DataFrame, files: DataFrame, how: str = "left") -> DataFrame:
    """Ledger rows (url) with the file of the same URL; what follows a question mark does not count."""
    right = files.select(bare_url(F.col("url")).alias("__bare"), "file_id")
    return ledger.join(right, bare_url(ledger["url"]) == F.col("__bare"), how).drop("__bare")


def supervised_state(checkpoints: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Effective state of runs (run_id, supervision_id, pid, state): an outcome (supervision_id, pid, state)
    of the same process overrides only a run that says it is running; one of another process makes the
    state unknown."""
    seen = outcomes.select("supervision_id", F.col("pid").alias("o_pid"), F.col("state").alias("o_state"))
    g = checkpoints.join(seen, "supervision_id", "left").groupBy(*checkpoints.columns).agg(
        F.max(F.when(F.col("o_pid") == F.col("pid"), F.col("o_state"))).alias("exact"), F.coalesce(F.bool_or(F.col("o_pid") != F.col("pid")), F.lit(False)).alias("wrong"))
    state = F.when(F.col("wrong"), "unknown").when((F.col("state") == "running") & F.col("exact").isNotNull(), F.col("exact")).otherwise(F.coalesce("state", F.lit("unknown")))
    return g.select("run_id", state.alias("effective_state"), F.when(F.col("exact").isNotNull(), "interrupted").otherwise("unverified").alias("process_outcome"))


def newest_others(outcomes: DataFrame, checkpoints: DataFrame, limit: int = 10) -> DataFrame:
    """The newest outcomes that belong to no checkpoint."""
    return outcomes.join(checkpoints, ["supervision_id", "pid"], "left_anti").orderBy(F.desc("observed_at"), "supervision_id").limit(limit)


def finished_shards(rows: DataFrame, done: DataFrame, shard: str = "shard") -> DataFrame:
    """Rows of shards that are marked as done."""
    return rows.join(done.select(shard).distinct(), shard, "left_semi")


def shard_files(shards: DataFrame, manifest: DataFrame) -> DataFrame:
    """Shards (shard, file_url) with what the manifest (file_url, plan fields) says of their files: the number of its plans and
    its reporting entity. A shard without plans stays, with none."""
    plans = manifest.select("file_url", "plan_id_type", "plan_id", "plan_name", "reporting_entity").distinct()
    g = plans.groupBy("file_url").agg(F.count("*").alias("plans"), F.min("reporting_entity").alias("reporting_entity"))
    return shards.join(g, "file_url", "left").withColumn("plans", F.coalesce("plans", F.lit(0).cast("long")))


def replace_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Replaces the partitions that rows have and leaves the others: a load that is run again gives the
    same table."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def reload(rows: DataFrame, path: str, keys: list[str], order: list[str]) -> None:
    """Replaces a table by the first row of each key."""
    first_by(rows, keys, order).write.mode("overwrite").parquet(path)


def interned_groups(groups: DataFrame, content: list[str]) -> DataFrame:
    """Distinct contents of repeated groups, each once with how often it occurs, so that drop counts stay
    exact without the repeats."""
    return groups.groupBy(*content).agg(F.count("*").alias("times"))


def url_provenance(mentions: DataFrame) -> DataFrame:
    """Per file identity (identity, url, ein) the smallest URL and who mentions it."""
    return mentions.groupBy("identity").agg(F.min("url").alias("url"), F.sort_array(F.collect_set("ein")).alias("eins"))


def pack_buckets(memberships: DataFrame) -> DataFrame:
    """Rows of BUCKET: per file and four-digit prefix the distinct suffixes in order, as compressed
    little-endian 32-bit numbers. A bucket has at most SUFFIXES, by its key."""
    npis = memberships.where(F.col("npi").rlike(r"^\d{10}$")).select(F.col("file_id").cast("string").alias("file_id"), F.substring("npi", 1, 4).alias("prefix"), F.substring("npi", 5, 6).cast("int").alias("s"))
    tasks = max(1, -(-memberships.count() // PACK_ROWS))
    npis = npis.repartition(tasks, "file_id", "prefix").distinct()  # a bucket's rows move once
    rows = npis.groupBy("file_id", "prefix").agg(F.array_sort(F.collect_list("s")).alias("s"))

    def run(batches):
        for b in batches:
            s = b.column(2)
            raw, ends = s.flatten().to_numpy().astype("<u4").tobytes(), np.append(0, np.cumsum(pa.compute.list_value_length(s).to_numpy())).tolist()
            raws = [raw[4 * a : 4 * z] for a, z in zip(ends, ends[1:])]
            payloads = [zlib.compress(x) for x in raws]
            sha = lambda parts: pa.array([hashlib.sha256(x).hexdigest() for x in parts], pa.string())
            counts = pa.array(np.diff(ends), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), counts, sha(raws), sha(payloads), pa.array(payloads, pa.binary())], [x.split()[0] for x in BUCKET.split(", ")])

    return rows.mapInArrow(run, BUCKET)


def _raw(count: int, raw_sha256: str, payload_sha256: str, payload: bytes) -> bytes:
    if not 1 <= count <= SUFFIXES or hashlib.sha256(payload).hexdigest() != payload_sha256:
        raise ValueError("bad bucket")
    raw = zlib.decompressobj().decompress(payload, count * 4 + 1)
    if len(raw) != count * 4 or hashlib.sha256(raw).hexdigest() != raw_sha256:
        raise ValueError("bad bucket content")
    return raw


def _in_order(s: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Suffixes of buckets that begin at `first`, if each bucket's rise."""
    rises = np.append(True, s[1:] > s[:-1])
    rises[first] = True
    if (s >= SUFFIXES).any() or not rises.all():
        raise ValueError("bad suffix order")
    return s


def unpack(count: int, raw_sha256: str, payload_sha256: str, payload: bytes) -> np.ndarray:
    """The suffixes of a bucket; anything that does not agree is an error."""
    return _in_order(np.frombuffer(_raw(count, raw_sha256, payload_sha256, payload), "<u4"), np.zeros(1, int))


def unpack_buckets(buckets: DataFrame) -> DataFrame:
    """Rows (file_id, npi) of buckets, in batches of about SUFFIXES."""
    def rows(b: pa.RecordBatch, a: int, z: int, raws: list[bytes]) -> pa.RecordBatch:
        n = np.fromiter(map(len, raws), np.int64, len(raws)) // 4
        s = _in_order(np.frombuffer(b"".join(raws), "<u4"), np.cumsum(n) - n)
        of = pa.array(np.repeat(np.arange(a, z), n))
        suffix = pa.compute.utf8_lpad(pa.array(s).cast(pa.string()), 6, "0")
        return pa.RecordBatch.from_arrays([b.column(0).take(of), pa.compute.binary_join_element_wise(b.column(1).take(of), suffix, "")], ["file_id", "npi"])

    def run(batches):
        for b in batches:
            start, raws, held = 0, [], 0
            for i, bucket in enumerate(zip(*(b.column(c).to_pylist() for c in range(2, 6)))):
                raws.append(_raw(*bucket))
                held += bucket[0]
                if held >= SUFFIXES:
                    yield rows(b, start, i + 1, raws)
                    start, raws, held = i + 1, [], 0
            if raws:
                yield rows(b, start, b.num_rows, raws)

    return buckets.select(*[x.split()[0] for x in BUCKET.split(", ")]).mapInArrow(run, "file_id string, npi string")
