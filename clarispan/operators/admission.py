"""What a refresh may take on: reservations of space, bounds, and a plan of admissions for each cycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bytes of a database and of a source, work space, rows of a file, files of a cycle, and the bounds and prices of a compact index.
DATABASE_BYTES, SOURCE_BYTES, SCRATCH_BYTES, COMPACT_SCRATCH_BYTES, SPARE_BYTES = 2_500_000_000, 5_000_000_000, 4_000_000_000, 8_000_000_000, 500_000_000
MEMBERSHIPS, PLANS, FILES_A_CYCLE = 200_000, 30_000, 64
COMPACT_PAIRS, COMPACT_BYTES, COMPACT_BUCKETS = 5_000_000, 32_000_000, 10_000
MEMBERSHIP_PRICE, PLAN_PRICE, BUCKET_PRICE, ENCODED_FACTOR, COMPACT_BASE = 1500, 2000, 1024, 3, 16_000_000
# Policies whose preparations stay good, and the ending of compact ones.
POLICIES, COMPACT_ENDING = ("5gb-ref-buffer-v7", "5gb-ref-intern-v6", "5gb-200k-disk-v5"), "-npi-prefix-v1"


def workspace_reserve(source_bytes: Column, compact: Column) -> Column:
    """Space that a source may need before it is read: all of it, its scratch database and some spare; null for a size that
    is not positive or above the bound."""
    good = (source_bytes > 0) & (source_bytes <= SOURCE_BYTES)
    return F.when(good, source_bytes + F.when(compact, COMPACT_SCRATCH_BYTES).otherwise(SCRATCH_BYTES) + SPARE_BYTES)


def compatible_policy(previous: Column, compact: Column) -> Column:
    """Whether what was prepared under a policy may be used again; a compact one only for compact serving."""
    return F.coalesce(previous.isin(*POLICIES) | (compact & previous.isin(*(p + COMPACT_ENDING for p in POLICIES))), F.lit(False))


def with_reservation(candidates: DataFrame) -> DataFrame:
    """Candidates (memberships, plans, reserved_plans, replay, encoded_bytes, buckets; the last two null unless the index is
    compact) with `reserved_bytes` and `problem`, the first bound that they pass: measure (a negative or missing number, or
    plans without a reservation), compact, memberships, plans. A replay of what is there reserves nothing."""
    compact = F.col("encoded_bytes").isNotNull()
    number = lambda c: F.coalesce(F.col(c) >= 0, F.lit(False))
    measured = number("memberships") & number("plans") & number("reserved_plans") & ~((F.col("plans") > 0) & (F.col("reserved_plans") < 1))
    fits = ~compact | (number("encoded_bytes") & number("buckets") & (F.col("encoded_bytes") <= COMPACT_BYTES) & (F.col("buckets") <= COMPACT_BUCKETS))
    price = F.when(compact, F.col("encoded_bytes") * ENCODED_FACTOR + F.col("buckets") * BUCKET_PRICE + F.col("reserved_plans") * PLAN_PRICE + COMPACT_BASE).otherwise(
        F.col("memberships") * MEMBERSHIP_PRICE + F.col("reserved_plans") * PLAN_PRICE)
    replay = F.coalesce("replay", F.lit(False))
    rows = F.col("memberships").between(1, F.when(compact, COMPACT_PAIRS).otherwise(MEMBERSHIPS))
    problem = F.when(~measured, "measure").when(~replay & ~fits, "compact").when(~rows, "memberships").when(~F.col("plans").between(1, PLANS), "plans")
    return candidates.withColumns({"reserved_bytes": F.when(replay, F.lit(0)).otherwise(price).cast("long"), "problem": problem})


def capacity(candidates: DataFrame, limit: int = DATABASE_BYTES) -> DataFrame:
    """Whether each candidate alone may be published into a database of database_bytes: adds reserved_bytes,
    projected_bytes, and `problem` (also `database`), null if it may."""
    rows = with_reservation(candidates).withColumn("projected_bytes", F.col("database_bytes") + F.col("reserved_bytes"))
    over = ~F.coalesce("replay", F.lit(False)) & (F.col("projected_bytes") > limit)
    bad = ~F.coalesce(F.col("database_bytes") >= 0, F.lit(False))
    return rows.withColumn("problem", F.when(bad, "measure").otherwise(F.coalesce("problem", F.when(over, "database"))))


def admission_plan(candidates: DataFrame, limit: int = DATABASE_BYTES, files: int = FILES_A_CYCLE) -> DataFrame:
    """Decisions (cycle, candidate, decision, reserved_bytes, projected_bytes) on each cycle's candidates (cycle, candidate, ord,
    database_bytes of the cycle's start, and those of with_reservation), in order.

    A cycle takes `files` candidates at most, the others wait (`next_cycle`). One after another is admitted if it is within
    bounds and its reservation fits beside those admitted before; a refused one reserves nothing, a replay always fits. So
    what a cycle folds is at most `files` rows, which are found without its others meeting.
    """
    rows = with_reservation(candidates).withColumn("__salt", F.pmod(F.xxhash64("candidate"), F.lit(64)))
    order = [F.col("ord"), F.col("candidate")]
    near = rows.withColumn("__n", F.row_number().over(Window.partitionBy("cycle", "__salt").orderBy(*order))).where(F.col("__n") <= files)
    first = near.withColumn("__n", F.row_number().over(Window.partitionBy("cycle").orderBy(*order))).where(F.col("__n") <= files)
    item = F.struct("__n", "candidate", F.coalesce("replay", F.lit(False)).alias("replay"), "problem", "reserved_bytes", "database_bytes")
    cycles = first.groupBy("cycle").agg(F.array_sort(F.collect_list(item)).alias("items"))
    done = "array<struct<candidate: bigint, decision: string, reserved_bytes: bigint, projected_bytes: bigint>>"
    kind = candidates.schema["candidate"].dataType.simpleString()
    start = F.struct(F.get("items", 0)["database_bytes"].cast("long").alias("bytes"), F.array().cast(done.replace("bigint", kind, 1)).alias("out"))

    def step(acc, x):
        after = acc["bytes"] + x["reserved_bytes"]
        decision = F.when(x["problem"].isNotNull(), x["problem"]).when(x["replay"], "replay").when(after > limit, "database").otherwise("admit")
        takes = decision == "admit"
        bytes_ = F.when(takes, after).otherwise(acc["bytes"])
        one = F.struct(x["candidate"].alias("candidate"), decision.alias("decision"), F.when(takes, x["reserved_bytes"]).otherwise(F.lit(0)).cast("long").alias("reserved_bytes"), bytes_.alias("projected_bytes"))
        return F.struct(bytes_.alias("bytes"), F.concat(acc["out"], F.array(one)).alias("out"))

    decided = cycles.select("cycle", F.explode(F.aggregate("items", start, step, lambda acc: acc["out"])).alias("d")).select("cycle", "d.*")
    later = candidates.select("cycle", "candidate").join(decided.select("cycle", "candidate"), ["cycle", "candidate"], "left_anti")
    return decided.unionByName(later.select("cycle", "candidate", F.lit("next_cycle").alias("decision"), F.lit(0).cast("long").alias("reserved_bytes"), F.lit(None).cast("long").alias("projected_bytes")))
