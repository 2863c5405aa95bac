"""What the corpus operators share: tables in the shared folder, graph components, group streams."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clarispan.shared import materialise, shared_folder  # noqa: F401

#: Bytes of a batch that goes to a Python worker; a longer row is a batch of its own.
BATCH_BYTES = 8 << 20

def small_batches(spark: SparkSession) -> None:
    """Batches of BATCH_BYTES to Python workers from now on, unless the session has smaller ones: a task then holds
    few megabytes of text whatever its rows' lengths."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or int(now.rstrip("b") if now.rstrip("b").isdigit() else 1 << 62) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


_RESIDENT: dict = {}


def resident(key, make: Callable):
    """What a Python worker keeps between tasks of one operator: one thing in a process, so that an operator's
    tables and known words go when the next one's tasks begin."""
    if key not in _RESIDENT:
        _RESIDENT.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def texts_by_slice(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Runs of a batch's rows with about `most` characters, and their texts; a null text is an empty one."""
    texts, start, held = [], 0, 0
    for i, t in enumerate(batch.column(column)):
        t = t.as_py() or ""
        texts.append(t)
        held += len(t)
        if held >= most:
            yield batch.slice(start, len(texts)), texts
            texts, start, held = [], i + 1, 0
    if texts:
        yield batch.slice(start, len(texts)), texts


def without(docs: DataFrame, names) -> DataFrame:
    """The columns that no name of a result (in any case) replaces."""
    names = {n.lower() for n in names}
    return docs.select(*[f"`{c}`" for c in docs.columns if c.lower() not in names])


def position(docs: DataFrame, column: str) -> int:
    return [c.lower() for c in docs.columns].index(column.lower())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id's decimal text modulo 4 is 2: rows that no model learns labels from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """Connected components of edges (src, dst): rows (node, root), root the smallest node; nodes
    that are their own root are left out.

    Alternating large-star and small-star rounds. Minima are pre-aggregated and joined back, so a
    node with very many neighbours is a skewed join that adaptive execution splits, not one task.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
            low = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("low"))
            out = both.join(low, "src").where(F.col("dst") > F.col("src"))
            out = out.select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        else:
            low = e.groupBy("src").agg(F.min("dst").alias("low"))
            out = e.join(low, "src")
            out = out.select(F.explode(F.array("src", "dst")).alias("src"), F.col("low").alias("dst"))
        return out.where(F.col("src") != F.col("dst")).distinct()

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()

    edges = edges.where(F.col("src") != F.col("dst")).select(
        F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    current = materialise(edges, tag)
    before = state(current)
    while True:
        current = materialise(star(star(current, True), False), tag, replaces=current)
        after = state(current)
        if after == before:
            return current.select(F.col("src").alias("node"), F.col("dst").alias("root"))
        before = after


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Re-cuts a stream sorted by keys into tables that never split a group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        change = np.zeros(max(batch.num_rows - 1, 0), bool)
        for k in keys:
            v = batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
            change |= v[1:] != v[:-1]
        cut = np.flatnonzero(change)
        first = held[0]
        if len(held) > 1 and any(
            first.column(first.schema.get_field_index(k))[first.num_rows - 1] != batch.column(batch.schema.get_field_index(k))[0] for k in keys
        ):
            yield pa.Table.from_batches(held[:-1])
            held = [batch]
        if len(cut):
            at = int(cut[-1]) + 1
            yield pa.Table.from_batches([*held[:-1], batch.slice(0, at)])
            held = [batch.slice(at)]
    if held:
        yield pa.Table.from_batches(held)


def pair_slabs(start: np.ndarray, stop: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), start[i] <= j < stop[i], at most about `most` at a time."""
    n = np.maximum(stop - start, 0)
    total = np.cumsum(n)
    at = 0
    while at < len(n):
        base = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, base + most, "right")))
        m = n[at:end]
        left = np.repeat(np.arange(at, end), m)
        right = np.arange(len(left)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(start[at:end], m)
        yield left, right
        at = end


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Labels of n rows: the smallest row linked, directly or through others."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        label = label[label]
        label = label[label]
        open_ = label[left] != label[right]
        left, right = left[open_], right[open_]
    while True:
        again = label[label]
        if (again == label).all():
            return label
        label = again


def spanning(n: int, left: np.ndarray, right: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which of the links form a spanning forest of least weight; the earlier of two equal ones is taken."""
    order = np.argsort(weight, kind="stable")
    a, b = left[order], right[order]
    label, taken, number = np.arange(n), [], np.arange(len(order))
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, number, x, y = a[apart], b[apart], number[apart], x[apart], y[apart]
        if not len(a):
            break
        best = np.full(n, len(order))
        np.minimum.at(best, x, number)
        np.minimum.at(best, y, number)
        picked = np.unique(best[best < len(order)])
        taken.append(picked)
        at = np.searchsorted(number, picked)
        roots = forest(n, x[at], y[at])
        label = roots[label]
    return order[np.concatenate(taken)] if taken else np.empty(0, np.int64)
