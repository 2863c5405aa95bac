"""Document fingerprints from Lempel-Ziv phrases (operator 5).

A text is parsed from left to right into dictionary phrases, each the longest one known plus a
character. The set of a text's phrases stands for it; the SIZE smallest hashes of the set are its
fingerprint, and the likeness of two fingerprints estimates the Jaccard likeness of their sets, which
follows how well one text's dictionary would compress the other.

An edited text keeps the head of the original, so the parse of the head is shared. Each document
meets the next one (descending doc_id) inside a bucket of consecutive ids; the first document of each
bucket is also sent to the bucket before it, so nothing is sorted in one task. Texts move once.

Defined cases: a null text is an empty one, with an empty fingerprint (likeness 1 to another empty
one, 0 to any other); equal ids follow each other by a hash of their texts; null ids come last; a
single document is its own next; an empty table gives an empty result; extra columns are ignored. A
dictionary holds a whole text's phrases, each as the number of the phrase that it extends and a character.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clarispan.llm.common import resident, small_batches, table

SIZE = 64
#: Bits of a code point in a dictionary's keys, and the factors that mix hashes.
POINT, FACTOR, MASK = 21, 0x9E3779B97F4A7C15, (1 << 64) - 1
#: Documents of a bucket, and a bound of the buckets: what is known of each on the driver is two numbers.
BUCKET_ROWS, MOST_BUCKETS = 400, 1 << 14
_FACTOR, _HALF = np.uint64(FACTOR), np.uint64(32)
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class Parse:
    """A parse that can be continued and taken back: known phrases, the phrase at hand, the smallest hashes so far."""

    def __init__(self):
        self.phrases: dict[int, int] = {}  # number of a phrase << POINT | character -> number of the longer phrase
        self.hashes = [1]  # by number; number 0 is the empty phrase
        self.at_hand, self.low = 0, np.empty(0, np.uint32)

    def feed(self, text: str) -> Parse:
        phrases, hashes, now, known = self.phrases, self.hashes, self.at_hand, len(self.hashes)
        get, note = phrases.get, hashes.append
        for c in map(ord, text):
            key = now << POINT | c
            longer = get(key)
            if longer is None:
                phrases[key] = len(hashes)
                h = (hashes[now] ^ c) * FACTOR & MASK
                note(h ^ h >> 32)
                now = 0
            else:
                now = longer
        self.at_hand = now
        new = (np.array(hashes[known:], np.uint64) * _FACTOR >> _HALF).astype(np.uint32)  # arrays wrap around without a warning
        if len(new) > 4 * SIZE:  # repeats are few, so the smallest different ones are mostly among twice as many
            least = np.unique(np.partition(new, 2 * SIZE)[: 2 * SIZE])
            new = least if len(least) >= SIZE else new
        self.low = np.unique(np.concatenate([self.low, new]))[:SIZE]
        return self

    def mark(self) -> tuple:
        return len(self.hashes), self.at_hand, self.low

    def rewind(self, mark: tuple) -> None:
        """Forgets what was fed since the mark."""
        known, self.at_hand, self.low = mark
        last = self.phrases.popitem  # the last one put in
        for _ in range(len(self.hashes) - known):
            last()
        del self.hashes[known:]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common hashes among the SIZE smallest of either."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    x, y = set(a.tolist()), set(b.tolist())
    both = sorted(x | y)[:SIZE]
    return len(x.intersection(y, both)) / len(both)


def as_text(low: np.ndarray) -> str:
    return low.astype(">u4").tobytes().hex()


def _pairs(batches):
    """Rows sorted by bucket, own documents before the one that follows the bucket."""
    resident("lz", dict)
    held = None  # bucket, id, text, head's length, parse of the head, hashes
    out: list[tuple] = []

    def close(text: str, low: np.ndarray) -> None:
        _, doc_id, own, head, parse, own_low = held
        start = text[: len(own) - head]
        edited = parse.feed(start).low
        sha = hashlib.sha256((own[:head] + start).encode()).hexdigest()
        out.append((doc_id, len(own), sha, as_text(own_low), as_text(edited), likeness(own_low, edited), likeness(own_low, low)))

    for b in batches:
        for bucket, follows, doc_id, text in zip(*(b.column(i) for i in range(4))):
            bucket, follows, text = bucket.as_py(), follows.as_py(), text.as_py()
            if follows and held is None:  # the row after the bucket has met its predecessor
                continue
            head = len(text) - len(text) // 3
            parse = Parse().feed(text[:head])
            mark = parse.mark()
            low = parse.feed(text[head:]).low
            parse.rewind(mark)
            if held is not None and held[0] == bucket:
                close(text, low)
            held = None if follows else (bucket, doc_id.as_py(), text, head, parse, low)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SCHEMA)], schema=_SCHEMA)
            out.clear()


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _places(k: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return np.searchsorted(cuts, k, "left")


def fingerprint_with_next(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The columns of RESULT for every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("k", F.coalesce("doc_id", F.lit(-(1 << 63))))
    small_batches(docs.sparkSession)
    ids = rows.select("k")
    buckets = min(MOST_BUCKETS, max(2, -(-ids.count() // bucket_rows)))
    cuts = np.array(sorted(set(ids.approxQuantile("k", [i / buckets for i in range(1, buckets)], 0.2 / buckets))), np.int64)
    if not len(cuts):
        return rows.mapInArrow(_pairs_of_none, RESULT)

    def highest(batches):
        """The highest id of each bucket, of a task's rows."""
        top: dict[int, int] = {}
        for b in batches:
            k = b.column(0).to_numpy()
            order = np.argsort(k, kind="stable")
            at = _places(k[order], cuts)
            last = np.flatnonzero(np.append(at[1:] != at[:-1], True)) if len(at) else []
            for i in last:
                top[int(at[i])] = max(top.get(int(at[i]), -(1 << 63)), int(k[order[i]]))
        yield pa.RecordBatch.from_arrays([pa.array(top.keys(), pa.int32()), pa.array(top.values(), pa.int64())], ["b", "k"])

    # A row for each bucket, MOST_BUCKETS at most.
    heads = sorted((r["b"], r["k"]) for r in ids.mapInArrow(highest, "b int, k long").groupBy("b").agg(F.max("k").alias("k")).collect())
    # The document after bucket b's last is the first of the next bucket below; after all, the first of all.
    head = np.array([heads[i - 1][1] for i in range(len(heads))], np.int64)
    of = np.array([b for b, _ in heads], np.int32)
    order = np.argsort(head, kind="stable")
    head, of = head[order], of[order]

    def deal(batches):
        """Each document to its bucket; the first one of a bucket also to the bucket that it follows."""
        for b in batches:
            k = b.column(2).to_numpy()
            at = np.minimum(np.searchsorted(head, k), len(head) - 1)
            sent = np.flatnonzero(head[at] == k)
            both = b.take(pa.array(np.concatenate([np.arange(len(k)), sent])))
            bucket = np.concatenate([_places(k, cuts).astype(np.int32), of[at[sent]]])
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.arange(len(bucket)) >= len(k)), *both.columns], ["bucket", "follows", *both.schema.names])

    dealt = rows.withColumn("h", F.xxhash64("text")).mapInArrow(deal, "bucket int, follows boolean, doc_id long, text string, k long, h long")
    parts = dealt.repartition("bucket").sortWithinPartitions("bucket", "follows", F.desc("k"), "h")
    return parts.select("bucket", "follows", "doc_id", "text").mapInArrow(_pairs, RESULT)


def _pairs_of_none(batches):
    for _ in batches:
        pass
    yield pa.RecordBatch.from_arrays([pa.array([], f.type) for f in _SCHEMA], schema=_SCHEMA)


def op5_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_with_next(table(spark, sf_dir, "documents"))
