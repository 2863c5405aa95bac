"""Phrase collocations by level-wise passes (operator 12).

Level k counts phrases of k words. A phrase can only be frequent if both phrases of k-1 words in it are, so the frequent
ones of each level are broadcast to the next pass over the texts, which emits a phrase only where both its parts are among
them. They are broadcast as bits of their hashes: 16 bits for each, rounded up to a power of two and at most MOST_BITS
(64 MB), whatever their number; a false positive is counted like any other phrase and falls to the least count, so
results are exact at every size. Tasks add up the phrases of FLUSH occurrences before they leave Python.

Each candidate's cuts are then scored from the level tables: a phrase of two words needs the counts of its words, one of
three those of its two overlapping pairs, which bring their words' counts along. Words and pairs above 1/HOT of all
occurrences, at most HOT of them, are broadcast; the others join by shuffle, so no key has more than 1/HOT of the rows.
A candidate goes if a longer one around it has at least half of its count. The first rows of each language are those of
its SALT parts, ranked again.

Defined cases: a null or empty text has no words; a null lang is `und`, together with that value; repeated rows count
each; a word of any length counts whole; a language without candidates has no rows; equal scores and counts are ranked
by the phrase's bytes; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clarispan.llm.common import materialise, resident, small_batches, table, texts_by_slice

LEAST_COUNT, WORDS, FIRST, SHARE, SCALE = 10, 3, 2000, 50, 1_000_000
MOST_BITS = 1 << 29
HOT, SALT = 4096, 64
#: Word occurrences whose phrases a task adds up at a time.
FLUSH = 500_000
#: Bytes: A-Z become a-z, piece ends one byte that no UTF-8 text has.
EDGE = b"\xff"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else 0xFF if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
RESULT = "lang string, phrase string, n long"


def words_of(texts: list[str]) -> list[bytes]:
    """Words of all texts in order, with EDGE between pieces and texts."""
    joined = b"\n".join(t.encode("utf-8", "replace") for t in texts).translate(_LOWER)
    return joined.replace(EDGE, b" " + EDGE + b" ").split()


def combined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of their parts."""
    with np.errstate(over="ignore"):
        h = (left * _MIX[0]) ^ (right + (left >> np.uint64(31)))
        h = h * _MIX[1]
        return h ^ (h >> np.uint64(29))


def word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "replace")) & 0xFFFFFFFF
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


class Frequent:
    """Bits of the frequent phrases of a level."""

    def __init__(self, bits: int, parts: dict[int, bytes]):
        self.mask, self.map = np.uint64(bits - 1), np.zeros(bits // 8, np.uint8)
        size = 4096  # bytes of a bitmap that Spark makes
        for n, part in parts.items():
            at = n * size
            self.map[at : at + size] = np.frombuffer(part, np.uint8)[: len(self.map) - at]

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return (self.map[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _counted(words: list[bytes], lang: str, k: int, levels: list[Frequent]) -> tuple[pa.Array, np.ndarray]:
    """Different phrases of k words whose parts may be frequent, and their counts."""
    coded = pa.array(words, pa.binary()).dictionary_encode()
    names = coded.dictionary
    codes, v = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(names)
    edge = pc.index(names, pa.scalar(EDGE, pa.binary())).as_py()
    inner = codes != edge
    if k == 1:
        n = np.bincount(codes, minlength=v)
        if edge >= 0:
            n[edge] = 0
        at = np.flatnonzero(n)
        return names.take(pa.array(at)), n[at]
    h = word_hashes(names.to_pylist(), lang)
    good = levels[0].has(h)
    if edge >= 0:
        good[edge] = False
    inner = good[codes]
    pair = inner[:-1] & inner[1:]
    if k == 2:
        key, n = np.unique(codes[:-1][pair] * v + codes[1:][pair], return_counts=True)
        parts = [key // v, key % v]
    else:
        at = np.flatnonzero(pair)
        key, back = np.unique(codes[at] * v + codes[at + 1], return_inverse=True)
        near = np.zeros(len(pair), bool)
        near[at] = levels[1].has(combined(h[key // v], h[key % v]))[back]
        at = np.flatnonzero(near[:-1] & near[1:])
        # Pairs of codes are numbered before the third word joins them, so products stay below 2^63 in a batch of any words.
        key, back = np.unique(codes[at] * v + codes[at + 1], return_inverse=True)
        both, n = np.unique(back * v + codes[at + 2], return_counts=True)
        first = key[both // v] if len(both) else both
        parts = [first // v, first % v, both % v]
    phrases = names.take(pa.array(parts[0]))
    for p in parts[1:]:
        phrases = pc.binary_join_element_wise(phrases, names.take(pa.array(p)), pa.scalar(b" ", pa.binary()))
    return phrases, n


def level(docs: DataFrame, k: int, before: list) -> DataFrame:
    """Rows (lang, phrase, n) of all words (k = 1), or of the frequent phrases of k words. before: broadcast bits of the lower levels."""

    def run(batches):
        resident("collocations", dict)
        held: dict[str, list[bytes]] = {}
        total = 0

        def flushed():
            for lang, words in held.items():
                phrases, n = _counted(words, lang, k, [b.value for b in before])
                if len(n):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), phrases.cast(pa.string()), pa.array(n, pa.int64())], ["lang", "phrase", "n"])
            held.clear()

        for b in batches:
            for rows, texts in texts_by_slice(b, 1):
                by_lang: dict[str, list[str]] = {}
                for lang, text in zip(rows.column(0).to_pylist(), texts):
                    by_lang.setdefault(lang, []).append(text)
                for lang, some in by_lang.items():
                    words = words_of(some)
                    held.setdefault(lang, []).extend([EDGE, *words])
                    total += len(words)
                if total >= FLUSH:
                    yield from flushed()
                    total = 0
        yield from flushed()

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, RESULT).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def frequent_bits(frequent: DataFrame, spark: SparkSession):
    """The phrases' bits, for broadcast: at most MOST_BITS, put together from bitmaps of 4 KB."""
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(15, (16 * frequent.count()).bit_length()))

    def hashed(batches):
        resident("collocations", dict)
        for b in batches:
            out = np.zeros(b.num_rows, np.uint64)
            by_lang = b.column(0).dictionary_encode()
            phrases = [p.encode("utf-8", "replace").split(b" ") for p in b.column(1).to_pylist()]
            for c, lang in enumerate(by_lang.dictionary.to_pylist()):
                at = np.flatnonzero(by_lang.indices.to_numpy(zero_copy_only=False) == c)
                parts = [word_hashes([phrases[i][j] for i in at], lang) for j in range(len(phrases[0]))]
                out[at] = parts[0] if len(parts) == 1 else combined(*parts)
            yield pa.RecordBatch.from_arrays([pa.array((out & np.uint64(bits - 1)).astype(np.int64))], ["bit"])

    at = frequent.select("lang", "phrase").mapInArrow(hashed, "bit long")
    maps = at.groupBy(F.expr("shiftright(bit, 15)").alias("part")).agg(F.expr("bitmap_construct_agg(bit & 32767)").alias("map"))
    return spark.sparkContext.broadcast(Frequent(bits, {r.part: bytes(r.map) for r in maps.toLocalIterator()}))


def _with_counts(rows: DataFrame, counts: DataFrame, total: int, key: str, columns: dict[str, str]) -> DataFrame:
    """Columns of the counts (lang, phrase, n ...) at rows' key. Counts above total / HOT are at most HOT rows and are broadcast."""
    named = counts.select(F.col("lang"), F.col("phrase").alias(key), *[F.col(c).alias(name) for c, name in columns.items()], (F.col("n") * HOT > total).alias("hot"))
    hot, other = named.where("hot").drop("hot"), named.where("NOT hot").drop("hot")
    marked = rows.join(F.broadcast(hot), ["lang", key], "left")
    first = next(iter(columns.values()))
    found = marked.where(F.col(first).isNotNull())
    rest = marked.where(F.col(first).isNull()).drop(*columns.values()).join(other, ["lang", key])
    return found.unionByName(rest)


def collocations(docs: DataFrame, least_count: int = LEAST_COUNT, first: int = FIRST) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): each language's best phrases of two and three words."""
    spark = docs.sparkSession
    small_batches(spark)
    words = materialise(level(docs, 1, []), "collocations-words")
    sizes = materialise(words.groupBy("lang").agg(F.sum("n").alias("total")), "collocations-languages")
    total = sizes.agg(F.sum("total")).first()[0] or 0
    ones = words.where(F.col("n") >= least_count)
    bits = [frequent_bits(ones, spark)]
    twos = materialise(level(docs, 2, bits).where(F.col("n") >= least_count), "collocations-pairs")
    bits.append(frequent_bits(twos, spark))
    threes = materialise(level(docs, 3, bits).where(F.col("n") >= least_count), "collocations-threes")
    for b in bits:
        b.unpersist()

    pairs = twos.withColumns({"w1": F.substring_index("phrase", " ", 1), "w2": F.substring_index("phrase", " ", -1)})
    pairs = _with_counts(_with_counts(pairs, ones, total, "w1", {"n": "l"}), ones, total, "w2", {"n": "r"})
    pairs = materialise(pairs.select("lang", "phrase", "n", "l", "r"), "collocations-counted")

    # Cuts of three words: after the first (the last pair is the rest) and after the second (the first pair comes before).
    triples = threes.withColumns({"p1": F.substring_index("phrase", " ", 2), "p2": F.expr("substring(phrase, locate(' ', phrase) + 1)")})
    triples = _with_counts(triples, pairs, total, "p1", {"n": "first_pair", "l": "first_word"})
    triples = _with_counts(triples, pairs, total, "p2", {"n": "last_pair", "r": "last_word"})

    around = threes.select("lang", F.explode(F.array(F.substring_index("phrase", " ", 2), F.expr("substring(phrase, locate(' ', phrase) + 1)"))).alias("phrase"), "n")
    around = around.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = pairs.join(around, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < SHARE * F.col("n"), F.lit(True)))

    def cut(left, right):
        score = F.expr(f"(CAST({SCALE} AS DECIMAL(38,0)) * n * n) div (CAST({left} AS DECIMAL(38,0)) * {right})")
        return F.struct(score.alias("score"), F.col(left).alias("l"), F.col(right).alias("r"))

    one, two = cut("first_word", "last_pair"), cut("first_pair", "last_word")
    best = triples.withColumn("cut", F.when(two["score"] < one["score"], two).otherwise(one))
    scored = kept.withColumn("cut", cut("l", "r")).select("lang", "phrase", "n", "cut").unionByName(best.select("lang", "phrase", "n", "cut"))
    scored = scored.select("lang", "phrase", F.col("n").alias("a"), "cut.l", "cut.r", "cut.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALT))).orderBy(*order))
    best = scored.withColumn("rank", part).where(F.col("rank") <= first)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), split AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
), grams AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM split
  UNION ALL SELECT lang, 2, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) FROM split
  UNION ALL SELECT lang, 3, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) FROM split
), totals AS (
  SELECT lang, count(*) AS total FROM grams WHERE k = 1 GROUP BY lang
), f AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS n, string_split(phrase, ' ') AS w FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 10
), cuts AS (
  SELECT c.lang, c.phrase, c.k, c.n AS a, x.k AS cut, x.n AS l, y.n AS r,
    (1000000::HUGEINT * c.n * c.n) // (x.n::HUGEINT * y.n) AS score
  FROM f c JOIN f x ON x.lang = c.lang AND x.k < c.k AND x.phrase = array_to_string(c.w[1 : x.k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[x.k + 1 :], ' ')
  WHERE c.k > 1
), best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM cuts) WHERE o = 1
), longer AS (
  SELECT lang, phrase, max(n) AS n FROM (
    SELECT lang, array_to_string(w[1 : 2], ' ') AS phrase, n FROM f WHERE k = 3
    UNION ALL SELECT lang, array_to_string(w[2 : 3], ' '), n FROM f WHERE k = 3
  ) GROUP BY lang, phrase
), kept AS (
  SELECT b.* FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase WHERE b.k = 3 OR g.n IS NULL OR 100 * g.n < 50 * b.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, CAST(total AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
