"""Sharding by k-d tree partitioning (operator 9).

Documents are points of metadata (size, language, source, a text checksum) weighted by bytes. The
tree splits a node at the weighted quantile of its widest dimension, found from distributed
histograms that are refined inside the bin which holds it, until a leaf holds one shard's target
bytes. Law: `bytes`, the sizes of the shards are nearly equal.

Equal texts are one point and lie in one shard, unless their group has more than a tenth of a shard's bytes or rows (and
one row): it is salted by doc_id (or by position, without one) into points of a tenth of a shard, which have one language
and source, so only their tie-break keeps them apart. The histograms (at most 4096 bins for
each of at most `shards` nodes) are all that reaches the driver. No Python runs on the executors.

Defined cases: a null text weighs 16 bytes and has checksum zero; null lang or source count as empty;
null doc_ids and repeated rows are rows like others; with fewer documents than shards some shards
stay empty; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clarispan.llm.common import materialise, table

SHARDS = 40
BINS = 4096
FIXED_BYTES = 16
#: A group of equal texts with more than 1 / PARTS of a shard's bytes or rows is salted.
PARTS = 10
SLOT_ROWS = 1000
GROUP = ["tk", "crc", "size"]
DIMS = ["d_size", "d_lang", "d_source", "d_crc"]


def _unit(*cols) -> Column:
    """A hash of the columns as a double in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def _of(values: dict[int, float], node: str = "node") -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, v)]), F.col(node))


def _histogram(atoms: DataFrame, value: Column, low: dict, high: dict, inside: Column) -> dict[int, dict[int, int]]:
    """Weights of each node's bins between low and high."""
    span = {n: (high[n] - low[n]) or 1.0 for n in low}
    at = F.least(F.floor((value - _of(low)) / _of(span) * BINS), F.lit(BINS - 1)).cast("int")
    rows = atoms.where(F.col("node").isin([*low]) & inside).groupBy("node", at.alias("bin")).agg(F.sum("w").alias("w")).collect()
    out: dict[int, dict[int, int]] = {n: {} for n in low}
    for r in rows:
        out[r["node"]][r["bin"]] = r["w"]
    return out


def _pick(bins: dict[int, int], goal: float, nearest: bool = False) -> tuple[int, float]:
    """The bin in which the running weight passes the goal, and the weight before it."""
    before = 0.0
    for b in sorted(bins):
        if before + bins[b] > goal:
            return (b + 1, before + bins[b]) if nearest and before + bins[b] - goal < goal - before else (b, before)
        before += bins[b]
    return max(bins, default=0) + 1 if nearest else max(bins, default=0), before if nearest else before - bins.get(max(bins, default=0), 0)


def kd_leaves(atoms: DataFrame, shards: int) -> DataFrame:
    """Adds `node`, the shard of each atom (columns of DIMS, tie, w)."""
    atoms = materialise(atoms.withColumn("node", F.lit(0)), "kd-atoms")
    leaves = {0: shards}  # first shard of each open node: how many it holds
    while any(n > 1 for n in leaves.values()):
        stats = atoms.where(F.col("node").isin([k for k, n in leaves.items() if n > 1])).groupBy("node").agg(
            F.sum("w").alias("w"), *[f(d).alias(f"{f.__name__}_{d}") for d in DIMS for f in (F.min, F.max)]).collect()
        if not stats:
            break
        dim, low, high, goal = {}, {}, {}, {}
        for r in stats:
            n = r["node"]
            dim[n] = max(range(len(DIMS)), key=lambda i: r[f"max_{DIMS[i]}"] - r[f"min_{DIMS[i]}"])
            low[n], high[n] = r[f"min_{DIMS[dim[n]]}"], r[f"max_{DIMS[dim[n]]}"]
            goal[n] = float(r["w"]) * (leaves[n] // 2) / leaves[n]
        value = F.element_at(F.array(*DIMS), _of({n: i + 1 for n, i in dim.items()}))
        inside, cut_low, cut_high, left = F.lit(True), low, {n: high[n] + 1 for n in high}, dict.fromkeys(goal, 0.0)
        for _ in range(2):  # to a 4096th, then to a 16 millionth of the range
            bins = _histogram(atoms, value, low, high, inside)
            picked = {n: _pick(bins[n], goal[n] - left[n]) for n in goal}
            step = {n: ((high[n] - low[n]) or 1.0) / BINS for n in goal}  # as the histogram has it
            left = {n: left[n] + picked[n][1] for n in goal}
            cut_high = {n: low[n] + step[n] * (picked[n][0] + 1) if picked[n][0] < BINS - 1 else cut_high[n] for n in goal}
            low = {n: low[n] + step[n] * picked[n][0] for n in goal}
            cut_low, high = low, {n: min(cut_high[n], high[n]) for n in goal}
            inside = (value >= _of(cut_low)) & (value < _of(cut_high))
        ties = _histogram(atoms, F.col("tie"), dict.fromkeys(goal, 0.0), dict.fromkeys(goal, 1.0), inside)
        tie = {n: _pick(ties[n], goal[n] - left[n], nearest=True)[0] / BINS for n in goal}
        goes_left = (value < _of(cut_low)) | ((value < _of(cut_high)) & (F.col("tie") < _of(tie)))
        right = {n: n + leaves[n] // 2 for n in goal}
        moved = F.when(F.col("node").isin([*goal]) & ~goes_left, _of(right)).otherwise(F.col("node"))
        atoms = materialise(atoms.withColumn("node", moved.cast("int")), "kd-atoms", replaces=atoms)
        leaves = {k: v for n, s in leaves.items() for k, v in (((n, s // 2), (n + s // 2, s - s // 2)) if s > 1 else ((n, s),))}
    return atoms


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard) for every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    points = materialise(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(FIXED_BYTES)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("tk"), F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"), F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).alias("at")), "shard-points")
    total = points.agg(F.sum("size").alias("w"), F.count("*").alias("n")).first()
    most_w, most_n = (total["w"] or 0) / (shards * PARTS) + 1, total["n"] / (shards * PARTS) + 1
    # At most 2 * shards * PARTS groups are that large, whatever the input: they can be broadcast.
    hot = points.groupBy(*GROUP).agg(F.sum("size").alias("w"), F.count("*").alias("n"), F.min("lang").alias("one_lang"), F.min("source").alias("one_source"))
    hot = hot.where((F.col("n") > 1) & ((F.col("w") > most_w) | (F.col("n") > most_n))).select(
        *GROUP, "one_lang", "one_source", F.ceil(F.greatest(F.col("w") / most_w, F.col("n") / most_n)).cast("int").alias("parts"))
    salted = points.join(F.broadcast(hot), GROUP, "left").withColumn(
        "part", F.coalesce(F.pmod(F.xxhash64("doc_id", "lang", "source", "at"), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    lang, source = (F.min(F.coalesce(f"one_{c}", c)).alias(c) for c in ("lang", "source"))
    atoms = salted.groupBy(*GROUP, "part").agg(F.sum("size").alias("w"), lang, source)
    atoms = atoms.select(
        *GROUP, "part", "w", (F.log2("size") / 24).alias("d_size"), _unit("lang").alias("d_lang"), _unit("source").alias("d_source"),
        (F.col("crc") / F.lit(float(1 << 32))).alias("d_crc"), _unit(*GROUP, "part").alias("tie"))
    placed = kd_leaves(atoms, shards).select(*GROUP, "part", F.col("node").alias("shard"))
    placed = materialise(salted.join(placed, [*GROUP, "part"]).select("doc_id", "size", "crc", "tk", "at", "shard"), "shard-placed")
    # Slots: ranks inside units of about SLOT_ROWS rows, after the rows of the shard's units before.
    counts = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    units = _of({k: -(-n // SLOT_ROWS) for k, n in counts.items()} or {0: 1}, "shard")
    placed = placed.withColumn("unit", F.pmod(F.xxhash64("doc_id", "tk", "at"), units).cast("int"))
    before = placed.groupBy("shard", "unit").agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("unit")) - F.col("n")).drop("n")
    rank = F.row_number().over(Window.partitionBy("shard", "unit").orderBy("doc_id", "tk", "size", "at"))
    out = placed.withColumn("rank", rank).join(before, ["shard", "unit"])
    return out.select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("before") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op9_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
