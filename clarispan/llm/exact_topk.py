"""Exact top-k search on a bit-sliced index (operator 1).

Vectors are quantised to integers and stored in blocks as bit slices: one bitmap per component and
bit. A query adds the slices of its components, shifted by the set bits of its own integers, with
carry-save bitmap adders; the sum is again a bit-sliced attribute. The k best rows are then selected
from its most significant slice downward, and rows tied at the boundary are resolved exactly, by the
smaller id. A block's bitmaps are built once; they and not the vectors go to the groups of queries, which
are large. Every block meets every group once, as a unit of a grid; only each unit's k best rows leave it.

Whole numbers travel as doubles, which hold floor(scale * x) of any double x exactly. Vectors with a component from 2^53 on
are sliced apart from the others, in Python integers, so they make no other block wider; scores are added and ranked
exactly at any size, and one beyond a long is given as the nearest long.

Defined cases: vectors that are null, or hold null or non-finite components (or ones that are infinite once scaled),
take no part; a query's candidates are vectors of its own length with another id; repeated rows are candidates each; a
query row that repeats entirely is asked once; null ids take no part; fewer candidates than k give all of them; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from clarispan.llm.common import materialise, table

BLOCK_ROWS = 16_384
GROUP_ROWS = 4096
WIDE = 2.0**53
LONG = 1 << 63
RESULT = "query_id long, query_key long, vec_id long, score long, ordered binary"


def quantised(vectors: DataFrame, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Rows (vec_id, v): v holds floor(scale * x) of each component, x as double, as a double."""
    ok = F.coalesce(F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e * scale) < float("inf"))), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("x"))
    whole = lambda e: F.when(F.abs(e * scale) < WIDE, F.floor(e * scale).cast("double")).otherwise(e * scale)
    return rows.where(ok & F.col("vec_id").isNotNull()).select("vec_id", F.transform("x", whole).alias("v"))


def _integers(v: np.ndarray) -> np.ndarray:
    """Whole doubles as 64-bit integers, or as Python's where some are wide."""
    return v.astype(np.int64) if np.abs(v).max(initial=0) < WIDE else np.array([int(x) for x in v.ravel()], object).reshape(v.shape)


def ordered(score: int) -> bytes:
    """Bytes whose order is that of the scores."""
    size = abs(score).to_bytes(-(-abs(score).bit_length() // 8), "big")
    return (0x8000 + len(size)).to_bytes(2, "big") + size if score >= 0 else (0x8000 - len(size)).to_bytes(2, "big") + bytes(255 - x for x in size)


def _packed(rows: DataFrame, parts: int, columns: str, row) -> DataFrame:
    """For each partition, length of vectors and width, row(partition number, length, ids, vectors), ordered by id."""
    def run(batches):
        batches = list(batches)
        if not batches:
            return
        t = pa.Table.from_batches(batches).sort_by("vec_id")
        length = pa.compute.list_value_length(t["v"]).to_numpy()
        flat = t["v"].combine_chunks().flatten().to_numpy().astype("<f8")
        ids = t["vec_id"].to_numpy().astype("<i8")
        number, start = TaskContext.get().partitionId(), np.cumsum(length) - length
        many = np.concatenate([[0], np.cumsum(np.abs(flat) >= WIDE)])
        wide = many[start + length] > many[start]
        for n, w in sorted(set(zip(length.tolist(), wide.tolist()))):
            at = np.flatnonzero((length == n) & (wide == w))
            v = flat[(start[at][:, None] + np.arange(n)).ravel()].reshape(len(at), n)
            yield pa.RecordBatch.from_pylist([row(number, int(n), ids[at], v)], schema)

    schema = to_arrow_schema(StructType.fromDDL(columns))
    return rows.repartition(parts).mapInArrow(run, columns)


def _block(number: int, n: int, ids: np.ndarray, v: np.ndarray) -> dict:
    index = BitSlices.of(ids, _integers(v))
    return {"r": number, "n": n, "ids": ids.tobytes(), "low": " ".join(map(str, index.low)), "bits": index.bits, "planes": index.planes.tobytes()}


def _group(number: int, n: int, ids: np.ndarray, v: np.ndarray) -> dict:
    return {"g": number, "n": n, "ids": ids.tobytes(), "v": v.tobytes()}


class BitSlices:
    """A block of integer vectors as bitmaps, one per component and bit."""

    def __init__(self, ids: np.ndarray, low: np.ndarray, bits: int, planes: np.ndarray):
        self.ids, self.rows, self.low, self.bits, self.planes = ids, len(ids), low, bits, planes
        self.all = self.bitmap(np.ones(self.rows, bool))

    @classmethod
    def of(cls, ids: np.ndarray, v: np.ndarray) -> BitSlices:
        low = v.min(axis=0) if v.shape[1] else np.empty(0, np.int64)
        u = v - low
        bits = max(1, int(u.max()).bit_length() if u.size else 0)
        planes = np.zeros((v.shape[1] * bits, -(-len(v) // 64)), np.uint64)
        bitmaps = planes.view(np.uint8)
        for d in range(v.shape[1]):
            for b in range(bits):
                packed = np.packbits(((u[:, d] >> b) & 1).astype(np.uint8), bitorder="little")
                bitmaps[d * bits + b, : len(packed)] = packed
        return cls(ids, low, bits, planes)

    def bitmap(self, flags: np.ndarray) -> np.ndarray:
        out = np.zeros(-(-self.rows // 64), np.uint64)
        packed = np.packbits(flags, bitorder="little")
        out.view(np.uint8)[: len(packed)] = packed
        return out

    def product(self, q: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of the inner products with q, least significant first, and what is to be added to
        them: a negative factor counts the complement of its slices."""
        full = (1 << self.bits) - 1
        constant = sum(int(a) * int(b) for a, b in zip(q, self.low)) - sum(-int(a) * full for a in q if a < 0)
        size = np.abs(q)
        top = int(size.max()).bit_length() if size.size else 0
        d, j = np.nonzero(((size[:, None] >> np.arange(top)[None, :]) & 1).astype(bool))
        weight = (j[:, None] + np.arange(self.bits)).ravel()
        plane = (d[:, None] * self.bits + np.arange(self.bits)).ravel()
        flip = np.repeat(np.where(q[d] < 0, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0)), self.bits)
        order = np.argsort(weight, kind="stable")
        plane, flip = plane[order], flip[order]
        edge = np.searchsorted(weight[order], np.arange(top + self.bits + 1))
        slices, carry, w = [], [], 0
        while w < top + self.bits or carry:
            at = slice(edge[w], edge[w + 1]) if w < top + self.bits else slice(0, 0)
            m, carry = np.concatenate([self.planes[plane[at]] ^ flip[at, None], *carry]), []
            while len(m) > 1:
                k = len(m) // 3
                if k:
                    a, b, c = m[:k], m[k : 2 * k], m[2 * k : 3 * k]
                    either = a ^ b
                    carry.append((a & b) | (c & either))
                    m = np.concatenate([either ^ c, m[3 * k :]])
                else:
                    carry.append(m[:1] & m[1:])
                    m = m[:1] ^ m[1:]
            slices.append(m[0] if len(m) else np.zeros_like(self.all))
            w += 1
        return slices, constant

    def top(self, q: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """The k best (id, inner product), other ids than `own` only."""
        slices, constant = self.product(q)
        tied = self.all & ~self.bitmap(self.ids == own)
        chosen = np.zeros_like(tied)
        k = min(k, int(np.bitwise_count(tied).sum()))
        for s in reversed(slices):
            more = chosen | (tied & s)
            n = int(np.bitwise_count(more).sum())
            if n > k:
                tied = tied & s
            else:
                chosen, tied = more, tied & ~s
                if n == k:
                    break
        at = self.where(chosen)
        if len(at) < k:
            at = np.concatenate([at, self.where(tied)[: k - len(at)]])
        return [(int(self.ids[r]), constant + sum(int(s[r >> 6] >> np.uint64(r & 63)) % 2 << w for w, s in enumerate(slices))) for r in at]

    @staticmethod
    def where(bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The k highest inner products of each query with vectors of other ids, ties to the smaller id.

    Both frames are rows (vec_id, v) of whole doubles. Returns (query_id, rank, vec_id, score).
    """
    vectors = materialise(vectors, "topk-vectors")
    queries = materialise(queries.dropDuplicates(["vec_id", "v"]), "topk-queries")
    n_blocks, n_groups = max(1, -(-vectors.count() // block_rows)), max(1, -(-queries.count() // group_rows))
    blocks = _packed(vectors, n_blocks, "r int, n int, ids binary, low string, bits int, planes binary", _block).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    groups = _packed(queries, n_groups, "g int, n int, ids binary, v binary", _group).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def unit(block: pa.Table, group: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for row in block.select(["n", "ids", "low", "bits", "planes"]).to_pylist():
            n, ids = row["n"], np.frombuffer(row["ids"], "<i8")
            index = BitSlices(ids, np.array([int(x) for x in row["low"].split()], object), row["bits"], np.frombuffer(row["planes"], np.uint64).reshape(n * row["bits"], -1) if n else np.zeros((0, -(-len(ids) // 64)), np.uint64))
            for qids, qs, m in zip(group["ids"], group["v"], group["n"].to_pylist()):
                if m == n:
                    for q_id, q in zip(np.frombuffer(qids.as_py(), "<i8").tolist(), np.frombuffer(qs.as_py(), "<f8").reshape(-1, n)):
                        key = xxhash.xxh64_intdigest(q.tobytes()) >> 1
                        out += [(q_id, key, i, max(-LONG, min(LONG - 1, s)), ordered(s)) for i, s in index.top(_integers(q), q_id, k)]
        kinds = [*[pa.int64()] * 4, pa.binary()]
        return pa.Table.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out) if out else [()] * 5, kinds)], ["query_id", "query_key", "vec_id", "score", "ordered"])

    best = blocks.groupBy("r", "g").cogroup(groups.groupBy("r", "g")).applyInArrow(unit, RESULT)
    rank = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.desc("ordered"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


SQL = """
WITH v AS (
  SELECT vec_id, CAST([floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS DOUBLE[]) AS q
  FROM embeddings
  WHERE len(list_filter([x IS NULL OR NOT isfinite(x) for x in embedding], lambda bad: bad)) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
  WHERE a.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
