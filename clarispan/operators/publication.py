"""Versioned publication: identities, generations, regressions, comparison of tables."""

from __future__ import annotations

import json
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clarispan.functions.scalars import ledger_key


def publication_id(stable_key: Column, content: Column) -> Column:
    return F.sha2(F.concat_ws("|", stable_key, content), 256)


def generations(ledger: DataFrame) -> DataFrame:
    """Role of each ledger row (stable_key, source_date, created): the newest generation is active, the
    one before it stays for rollback, older ones retire. A key holds its own generations only."""
    order = Window.partitionBy("key").orderBy(F.desc("source_date"), F.desc("created"))
    rows = ledger.withColumn("key", ledger_key(F.col("stable_key"))).withColumn("n", F.row_number().over(order))
    return rows.withColumn("role", F.when(F.col("n") == 1, "active").when(F.col("n") == 2, "rollback").otherwise("retired"))


def active_only(ledger: DataFrame) -> DataFrame:
    """Newest row of each key by one aggregate, for keys with very many generations."""
    columns = [c for c in ledger.columns if c != "key"]
    g = ledger.withColumn("key", ledger_key(F.col("stable_key"))).groupBy("key").agg(F.max_by(F.struct(*columns), F.struct("source_date", "created")).alias("r"))
    return g.select("key", "r.*")


def survivors(ledger: DataFrame) -> DataFrame:
    """Ledger rows (stable_key, created, withdrawn) with the number of later generations of their key that are not
    withdrawn, and whether they may be retired: an active and a rollback generation must remain.

    The newest come first, as Spark sums a frame that grows in one pass and one that shrinks anew for each row."""
    later = Window.partitionBy("key").orderBy(F.desc("__at")).rangeBetween(Window.unboundedPreceding, -1)
    rows = ledger.withColumn("key", ledger_key(F.col("stable_key"))).withColumn("__at", F.unix_micros("created"))
    rows = rows.withColumn("survivors", F.coalesce(F.sum(F.when(F.col("withdrawn"), 0).otherwise(1)).over(later), F.lit(0).cast("long")))
    return rows.withColumn("may_retire", ~F.col("withdrawn") & (F.col("survivors") >= 2)).drop("__at")


def regressions(arrivals: DataFrame) -> DataFrame:
    """Marks arrivals (key, source_date, arrival) whose date is before one that arrived earlier. Of arrivals with one number
    the one with the earlier date came first; one without a number came last."""
    before = Window.partitionBy("key").orderBy(F.asc_nulls_last("arrival"), "source_date").rowsBetween(Window.unboundedPreceding, -1)
    return arrivals.withColumn("regression", F.coalesce(F.col("source_date") < F.max("source_date").over(before), F.lit(False)))


CHANGE = "key string, arrival long, generation string, role string"


class Roles:
    """The active generation of a source and the one kept for rollback, each (generation, source date)."""

    def __init__(self, active: tuple[str, str] | None = None, rollback: tuple[str, str] | None = None):
        self.active, self.rollback = active, rollback

    def publish(self, generation: str, date: str) -> list[tuple[str, str]]:
        """Roles that change: a date before the active one's is a regression, the active generation itself is `same`."""
        if self.active and date < self.active[1]:
            return [(generation, "regression")]
        if self.active and generation == self.active[0]:
            return [(generation, "same")]
        out = [(generation, "active")]
        if self.active:
            out.append((self.active[0], "rollback"))
            if self.rollback and self.rollback[0] != generation:
                out.append((self.rollback[0], "retired"))
            self.rollback = self.active
        self.active = generation, date
        return out

    def withdraw(self) -> list[tuple[str, str]]:
        """The generation before becomes active again; without one the withdrawal is refused."""
        if not self.active or not self.rollback:
            return [(self.active[0] if self.active else "", "refused")]
        out = [(self.active[0], "withdrawn"), (self.rollback[0], "active")]
        self.active, self.rollback = self.rollback, None
        return out

    def apply(self, action: str, generation: str, date: str) -> list[tuple[str, str]]:
        return self.withdraw() if action == "withdraw" else self.publish(generation, date)


def role_changes(commands: DataFrame) -> DataFrame:
    """Changes of roles (CHANGE) by commands (key, arrival, action publish or withdraw, generation, source_date as ISO text),
    in order of arrival. A key's commands are one task's stream, which holds two generations."""

    def run(batches):
        now, roles = None, Roles()
        for b in batches:
            out = []
            for key, arrival, action, generation, date in zip(*(b.column(i).to_pylist() for i in range(5))):
                if key != now:
                    now, roles = key, Roles()
                out += [(key, arrival, *change) for change in roles.apply(action, generation, date)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 4, (pa.string(), pa.int64(), pa.string(), pa.string()))], ["key", "arrival", "generation", "role"])

    rows = commands.select(*[F.col(c).cast(t) for c, t in (("key", "string"), ("arrival", "long"), ("action", "string"), ("generation", "string"), ("source_date", "string"))])
    return rows.repartition("key").sortWithinPartitions("key", "arrival").mapInArrow(run, CHANGE)


def capacity_ok(active_bytes: Column, new_bytes: Column, limit: int) -> Column:
    return active_bytes + new_bytes <= F.lit(limit)


def content_changes(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Status of each id by its fingerprint in two tables (id, fingerprint)."""
    both = baseline.withColumnRenamed("fingerprint", "old").join(current.withColumnRenamed("fingerprint", "new"), "id", "full")
    state = F.when(F.col("old").isNull(), "first").when(F.col("new").isNull(), "missing").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    return both.select("id", state.alias("change"))


def compare(source: DataFrame, served: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fields in which each source row differs from the served row of its key, or that it is missing."""
    s = source.select(key, *[F.col(f).alias(f"a_{f}") for f in fields])
    t = served.select(key, F.lit(True).alias("there"), *[F.col(f).alias(f"b_{f}") for f in fields])
    differs = F.array_compact(F.array(*[F.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), F.lit(f)) for f in fields]))
    return s.join(t, key, "left").select(key, F.when(F.col("there").isNull(), "missing").otherwise(F.array_join(differs, ",")).alias("mismatch"))


def inventory(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Expected and found items: matched, unresolved or unexpected."""
    e, f = expected.select(key, F.lit(True).alias("e")).distinct(), found.select(key, F.lit(True).alias("f")).distinct()
    state = F.when(F.col("f").isNull(), "unresolved").when(F.col("e").isNull(), "unexpected").otherwise("matched")
    return e.join(f, key, "full").select(key, state.alias("state"))


def superseded(bindings: DataFrame, evidence: DataFrame) -> DataFrame:
    """Whether a bound result (binding_id, action, request_key, fingerprint) is stale: the latest evidence
    of its action has another request key, another fingerprint, or is missing."""
    last = evidence.groupBy("action").agg(F.max_by(F.struct(F.col("request_key").alias("k"), F.col("fingerprint").alias("f")), "ord").alias("e"))
    stale = F.col("e").isNull() | ~F.col("e.k").eqNullSafe(F.col("request_key")) | ~F.col("e.f").eqNullSafe(F.col("fingerprint"))
    return bindings.join(last, "action", "left").select("binding_id", stale.alias("stale"))


class Publisher:
    """A table as versioned folders and a ledger of pointers, both written by Spark.

    A version is written aside, then a ledger row makes it current; a version with the same content
    is found again instead of being written, an older source date is refused, and the version before
    the current one stays for rollback. One writer at a time.
    """

    LEDGER = "id string, stable_key string, source_date date, path string, seq long, withdrawn boolean"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def ledger(self) -> DataFrame:
        path = f"{self.root}/ledger"
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
        return self.spark.read.schema(self.LEDGER).parquet(path) if there else self.spark.createDataFrame([], self.LEDGER)

    def _note(self, row: tuple) -> None:
        self.spark.createDataFrame([row], self.LEDGER).coalesce(1).write.mode("append").parquet(f"{self.root}/ledger")

    def current(self, stable_key: str):
        rows = self.ledger().where(F.col("stable_key") == stable_key)
        last = rows.groupBy("id").agg(F.max_by(F.struct("withdrawn", "source_date", "path", "seq"), "seq").alias("r")).select("id", "r.*")
        return last.where("NOT withdrawn").orderBy(F.desc("source_date"), F.desc("seq")).first()

    def publish(self, df: DataFrame, stable_key: str, source_date) -> tuple[str, bool]:
        """(id, whether it was new). The content's digest adds up row hashes, in any order."""
        n = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
        content = json.dumps([str(source_date), df.schema.json(), n["n"], str(n["h"])])
        found = self.spark.range(1).select(publication_id(F.lit(stable_key), F.lit(content)).alias("id")).first()["id"]
        now = self.current(stable_key)
        if now is not None and now["id"] == found:
            return found, False
        if now is not None and source_date < now["source_date"]:
            raise ValueError("source date regression")
        path = f"{self.root}/data/{found}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        if self.spark.read.parquet(path).count() != n["n"]:
            raise RuntimeError("readback differs")
        seq = (self.ledger().agg(F.max("seq")).first()[0] or 0) + 1
        self._note((found, stable_key, source_date, path, seq, False))
        return found, True

    def withdraw(self, stable_key: str) -> None:
        """The version before becomes current again."""
        now = self.current(stable_key)
        if now is not None:
            seq = (self.ledger().agg(F.max("seq")).first()[0] or 0) + 1
            self._note((now["id"], stable_key, now["source_date"], now["path"], seq, True))

    def read(self, stable_key: str) -> DataFrame:
        return self.spark.read.parquet(self.current(stable_key)["path"])
