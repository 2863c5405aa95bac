"""Line dedup by a segment-partition edit join (operator 3).

Two lines are near copies if their trimmed forms are within `allowed` edits of the shorter one's length: one
edit from 12 characters, two from 24, so that an edit is at most a twelfth; shorter lines must be equal. Of each class of such lines the first occurrence (smallest doc_id,
then position) stays, all others are removed from their documents. Trimming takes off ASCII white space at both ends, so the
\r of a CRLF end is no part of a line.

A line is cut into one segment more than its edits: a line within them holds one of the segments unchanged,
at a place that its length bounds. Lines therefore meet under keys of (length, segment, its text);
only keys that two different lines share live on. Lines under such keys are fetched by a fixed-size
bitmap of their hashes and verified in batches by banded bit-parallel edit distance. Lines of a key that very many
share meet under finer keys instead: what such a line has beside the segment is within the same edits, and is cut
into segments again, one of which must agree too. Groups that stay above a size are cut into chunks, and every pair of
chunks is a unit of work that returns a spanning forest.

Defined cases: a null text has no lines and stays null; blank lines (of ASCII white space, CRLF ends included) are never removed; rows with a
null doc_id take no part and stay as they are; rows that repeat a doc_id count as one document, each
keeps what it keeps; a document may be left without lines; an empty table gives an empty result; extra
columns stay, but those named like a result of without_duplicates (removed, kept_in) are replaced by it there.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clarispan.llm.common import components, forest, materialise, pair_slabs, resident, small_batches, table, whole_groups, without

THRESHOLD, CHARS_PER_EDIT = 2, 12
CHUNK = 256
#: Lines of a key above which they meet under finer keys.
MANY = 4096
#: Characters of the pairs that are verified at once.
CELLS = 1 << 21
#: Bits of the bitmap that lets lines with a live key through; more candidates let more lines through.
BITMAP = 1 << 26
BLANK = " \t\x0b\x0c\r"
RECENT = 200_000


def allowed(n: int) -> int:
    """Edits between a line of n characters and one that is not shorter."""
    return min(THRESHOLD, n // CHARS_PER_EDIT)


def segments(n: int, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """(start, length) of the threshold + 1 segments of a line of n characters."""
    k = threshold + 1
    size, long_from = n // k, k - n % k
    out, at = [], 0
    for i in range(k):
        out.append((at, size + (i >= long_from)))
        at += out[-1][1]
    return out


def probes(n: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(seed, start, length) of a line's own segments, and of the substrings at which it can hold a
    segment of a line that is up to THRESHOLD shorter."""
    own, other = [], []
    for shorter in range(THRESHOLD + 1):
        most = allowed(n - shorter)
        if most < max(shorter, 1):
            continue
        for i, (at, size) in enumerate(segments(n - shorter, most)):
            seed = (n - shorter) * (THRESHOLD + 1) + i
            low = max(at - i, at + shorter - (most - i), 0)
            high = min(at + i, at + shorter + (most - i), n - size)
            for start in range(low, high + 1):
                (own if not shorter and start == at else other).append((seed, start, size))
    return own, other


def _keys(batches):
    """Rows (key, h1, own) of lines (h1, line), each line once for some time."""
    resident("lines", dict)
    digest, plans, recent = xxhash.xxh64_intdigest, {}, set()
    for b in batches:
        key, line, own = [], [], []
        for h, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if h in recent:
                continue
            if len(recent) >= RECENT:
                recent.clear()
            recent.add(h)
            n = len(s)
            if n not in plans:
                plans[n] = probes(n)
            mine, other = plans[n]
            key += [digest(s[a : a + k], seed) for seed, a, k in mine]
            key += [digest(s[a : a + k], seed) for seed, a, k in other]
            line += [h] * (len(mine) + len(other))
            own += [True] * len(mine) + [False] * len(other)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(key, np.uint64).view(np.int64)), pa.array(line, pa.int64()), pa.array(own, pa.bool_())], ["key", "h1", "own"])


def _finer(batches):
    """Of rows (key, node, line) of hot keys, rows (key, own, node, line) under finer keys: the key and a segment of what
    the line has beside the key's own segment; a line's own segments, and the places near them where another line's may be."""
    resident("lines", dict)
    digest, plans = xxhash.xxh64_intdigest, {}
    for b in batches:
        out: list[tuple] = []
        for key, node, line in zip(*(b.column(i).to_pylist() for i in range(3))):
            n, unsigned = len(line), key & ((1 << 64) - 1)
            if n not in plans:
                plans[n] = probes(n)
            found = set()
            for e, (seed, a, k) in enumerate([*plans[n][0], *plans[n][1]]):
                if digest(line[a : a + k], seed) != unsigned:
                    continue
                rest, least = line[:a] + line[a + k :], seed // (THRESHOLD + 1)
                most = allowed(least)
                for j, (at, size) in enumerate(segments(least - k, most)):
                    for start in range(max(0, at - most), min(at + most, len(rest) - size) + 1):
                        found.add((digest(rest[start : start + size], unsigned ^ (j + 1)), e < len(plans[n][0]) and start == at))
            out += [(x, mine, node, line) for x, mine in found]
        key = np.fromiter((x for x, *_ in out), np.uint64, len(out)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array([x[i] for x in out], kind) for i, kind in ((1, pa.bool_()), (2, pa.string()), (3, pa.string())))], ["key", "own", "node", "line"])


def _live(batches):
    """Of rows sorted by (key, h1), those of keys with two different lines, each (key, h1, own) once."""
    last = None  # key, h1, own of a row whose key has one line so far
    for b in batches:
        if not b.num_rows:
            continue
        key, line, own = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)
        open_key, lived = (last[0], last[3]) if last else (None, False)
        if last:
            key, line, own = (np.concatenate([[x], v]) for x, v in zip(last[:3], (key, line, own)))
        new = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.cumsum(new) - 1
        start = np.flatnonzero(new)
        differs = line != line[start][group]
        live = np.bincount(group, differs) > 0
        if lived:
            live[0] = True
        same = np.concatenate([[False], (key[1:] == key[:-1]) & (line[1:] == line[:-1]) & (own[1:] == own[:-1])])
        keep = live[group] & ~same
        if last and lived:
            keep[0] = False  # it left with the batch before
        last = (key[-1], line[-1], own[-1], bool(live[-1]))
        if not live[-1]:
            first = start[-1]
            last = (key[first], line[first], bool(own[first:].any()), False)
        yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(line[keep]), pa.array(own[keep].astype(bool))], ["key", "h1", "own"])


def within(left: list[str], right: list[str], threshold: int = THRESHOLD) -> np.ndarray:
    """Whether each pair of lines, whose lengths differ by at most `threshold`, is within the edits that the
    shorter one allows: a band of 2 * threshold + 1 rows of the distance matrix moves along its diagonal, as bits of
    one integer for each pair, in all pairs at once."""
    k, band = threshold, 2 * threshold + 1
    m, n = (np.fromiter(map(len, x), np.int64, len(x)) for x in (left, right))
    out, most = np.zeros(len(left), bool), np.minimum(threshold, np.minimum(m, n) // CHARS_PER_EDIT)
    if not len(left):
        return out
    pattern = np.zeros((len(left), int(max(m.max(), n.max())) + 2 * band), np.uint32)
    text = np.zeros((len(left), int(n.max()) + 1), np.uint32)
    for rows, to, shift in ((left, pattern, k), (right, text, 0)):
        flat = np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), np.uint32) + np.uint32(1)
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        row = np.repeat(np.arange(len(rows)), size)
        to[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + shift] = flat
    weight = (1 << np.arange(band)).astype(np.int64)
    full, top = (1 << band) - 1, 1 << (band - 1)
    at = np.arange(len(left))
    up = np.full(len(left), full & ~((1 << k) - 1), np.int64)
    down, score = np.zeros(len(left), np.int64), np.full(len(left), k, np.int64)
    for j in range(1, int(n.max()) + 1):
        match = (pattern[at, j - 1 : j - 1 + band] == text[at, j - 1 : j]) @ weight
        zero = ((((match & up) + up) ^ up) | match | down) & full
        plus = (down | ~(zero | up)) & full
        minus = zero & up
        diagonal = j + k <= m[at]
        row = np.clip(m[at] - j + k, 0, band - 1)
        score += np.where(diagonal, (zero & top) == 0, ((plus >> row) & 1) - ((minus >> row) & 1))
        up = (minus | ~((zero >> 1) | plus)) & full
        down = plus & (zero >> 1)
        ended = n[at] == j
        if ended.any():
            out[at[ended]] = score[ended] <= most[at[ended]]
        if ended.any() or j % 8 == 0:
            stay = ~ended & (score <= 3 * k)
            if not stay.any():
                break
            at, up, down, score = at[stay], up[stay], down[stay], score[stay]
    return out


def _cuts(cost: np.ndarray):
    """Slices of pairs, given their running cost: at most 2048 pairs and about CELLS characters each."""
    at = 0
    while at < len(cost):
        to = min(at + 2048, max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + CELLS, "right"))))
        yield slice(at, to)
        at = to


def _links(batches):
    """Of groups (key, i, j) of lines, the spanning forest of lines within their edits."""
    for t in whole_groups(batches, ["key", "i", "j"]):
        group = np.zeros(t.num_rows, np.int64)
        for c in ("key", "i", "j"):
            v = t[c].to_numpy()
            group[1:] |= v[1:] != v[:-1]
        group = np.cumsum(group)
        line, node, own = t["line"].to_pylist(), t["node"].to_pylist(), t["own"].to_numpy()
        size = np.fromiter(map(len, line), np.int64, len(line))
        sort = group * (1 << 32) + size
        order = np.argsort(sort, kind="stable")
        line, node, own, size, sort = [line[x] for x in order], [node[x] for x in order], own[order], size[order], sort[order]
        number = {h: i for i, h in enumerate(dict.fromkeys(node))}  # a line may stand under several keys
        of = np.fromiter(map(number.__getitem__, node), np.int64, len(node))
        label = np.arange(len(number))
        for i, j in pair_slabs(np.arange(1, len(line) + 1), np.searchsorted(sort, sort + THRESHOLD, "right"), 1 << 14):
            keep = (own[i] | own[j]) & (label[of[i]] != label[of[j]])
            i, j = i[keep], j[keep]
            cost = np.cumsum(np.maximum(size[i], size[j]) + 1)
            for a in _cuts(cost):
                x, y = i[a], j[a]
                apart = label[of[x]] != label[of[y]]
                x, y = x[apart], y[apart]
                near = within([line[p] for p in x], [line[p] for p in y])
                new = forest(len(label), np.concatenate([label[of[x[near]]], np.arange(len(label))]), np.concatenate([label[of[y[near]]], label]))
                label = new
        names = list(number)
        linked = np.flatnonzero(label != np.arange(len(label)))
        yield pa.RecordBatch.from_arrays([pa.array([names[x] for x in linked], pa.string()), pa.array([names[x] for x in label[linked]], pa.string())], ["src", "dst"])


def _node():
    return F.concat(F.hex("h1"), F.lit("-"), F.hex("h2"))


def lines_of(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, pos, line, h1, h2) of the non-blank lines, trimmed."""
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    rows = rows.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    # Trimming other characters than blanks walks the whole line, so only lines that begin or end with one pay for it.
    plain = F.trim("line")
    odd = reduce(or_, (f(plain, F.lit(c)) for c in BLANK[1:] for f in (F.startswith, F.endswith)))
    rows = rows.select("doc_id", "pos", F.when(odd, F.trim(plain, F.lit(BLANK))).otherwise(plain).alias("line")).where("line <> ''")
    return rows.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})


def near_line_links(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Links (src, dst) between nodes of different lines that connect all that are near copies."""
    spark = docs.sparkSession
    small_batches(spark)
    long = lines_of(docs).where(F.length("line") >= CHARS_PER_EDIT)
    keyed = long.select("h1", "line").mapInArrow(_keys, "key long, h1 long, own boolean")
    live = keyed.repartition("key").sortWithinPartitions("key", "h1", "own").mapInArrow(_live, "key long, h1 long, own boolean")
    live = materialise(live.groupBy("key", "h1").agg(F.max("own").alias("own")), "line-keys")
    # At most BITMAP / 64 words of bits, whatever the number of candidates.
    bit = F.pmod("h1", F.lit(BITMAP)).alias("bit")
    words = live.select(bit).distinct().groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(bit & 63 AS INT)))").alias("bits")).toArrow()
    bitmap = np.zeros(BITMAP // 64, np.uint64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    sent = spark.sparkContext.broadcast(bitmap)

    def fetch(batches):
        recent = set()
        for b in batches:
            at = b.column(0).to_numpy() & (BITMAP - 1)
            hit = np.flatnonzero((sent.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1))
            if len(hit):
                part = b.take(pa.array(hit))
                fresh = []
                for x in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    fresh.append(x not in recent)
                    if len(recent) >= RECENT:
                        recent.clear()
                    recent.add(x)
                yield part.filter(pa.array(fresh))

    found = long.select("h1", "h2", "line").mapInArrow(fetch, "h1 long, h2 long, line string")
    found = found.groupBy("h1", "h2").agg(F.first("line").alias("line"))
    shared = materialise(live.groupBy("key").agg(F.count("*").alias("n"), F.max("own").alias("owned")).where("n > 1 AND owned").drop("owned"), "line-shared")
    rows = live.join(shared, "key").join(found, "h1").select("key", "own", _node().alias("node"), "line", "n")
    if not shared.where(F.col("n") > MANY).isEmpty():
        rows = materialise(rows, "line-rows")
        fine = rows.where(F.col("n") > MANY).select("key", "node", "line").mapInArrow(_finer, "key long, own boolean, node string, line string")
        fine = materialise(fine.groupBy("key", "node").agg(F.max("own").alias("own"), F.first("line").alias("line")), "line-finer")
        again = fine.groupBy("key").agg(F.count("*").alias("n"), F.max("own").alias("owned")).where("n > 1 AND owned").drop("owned")
        rows = rows.where(F.col("n") <= MANY).unionByName(fine.join(again, "key"))
    rows = rows.withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int"))
    rows = rows.withColumn("c", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    unit = rows.select("key", "own", "node", "line", "c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("o"))
    unit = unit.select("key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "own", "node", "line")
    return unit.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_links, "src string, dst string")


def duplicates(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, pos, kept_doc, kept_pos): every line to be removed and the one kept for it."""
    lines = lines_of(docs).drop("line")
    where = F.struct(F.col("doc_id").alias("kept_doc"), F.col("pos").alias("kept_pos"))
    reps = materialise(lines.groupBy("h1", "h2").agg(F.min(where).alias("first"), F.count("*").alias("n")), "line-reps")
    links = components(near_line_links(docs), "line-links")
    members = links.union(links.select(F.col("root").alias("node"), "root")).distinct()
    members = members.select(F.conv(F.split("node", "-")[0], 16, -10).cast("long").alias("h1"), F.conv(F.split("node", "-")[1], 16, -10).cast("long").alias("h2"), "root")
    linked = materialise(reps.join(members, ["h1", "h2"]).select("h1", "h2", "first", "root"), "line-members")
    kept = linked.join(linked.groupBy("root").agg(F.min("first").alias("kept")), "root").select("h1", "h2", "kept")
    alone = reps.where("n > 1").join(kept, ["h1", "h2"], "left_anti").select("h1", "h2", F.col("first").alias("kept"))
    out = lines.join(kept.union(alone), ["h1", "h2"]).select("doc_id", "pos", "kept.*")
    return out.where("doc_id <> kept_doc OR pos <> kept_pos")


def without_duplicates(docs: DataFrame) -> DataFrame:
    """The documents with their columns, `text` without removed lines, and `removed`, their positions
    (null if none), and `kept_in`, the documents that hold the lines kept instead."""
    docs = without(docs, ["removed", "kept_in"])
    gone = duplicates(docs).groupBy("doc_id").agg(F.collect_set("pos").alias("__removed"), F.sort_array(F.collect_set("kept_doc")).alias("__kept_in"))
    lines = F.split("text", "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "__removed")
    text = F.when(F.col("__removed").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    joined = docs.join(gone.withColumnRenamed("doc_id", "__id"), F.col("doc_id") == F.col("__id"), "left")
    return joined.select(*[text.alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns], F.col("__removed").alias("removed"), F.col("__kept_in").alias("kept_in"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, those removed, the documents that keep them, a digest of what is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("n_lines", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)))
    out = without_duplicates(docs)
    return out.select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed"), F.coalesce("kept_in", F.array().cast("array<bigint>")).alias("kept_in"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def keep_first_lines(docs: DataFrame) -> DataFrame:
    """The documents with their columns, without removed lines; a column n_chars follows the text."""
    clash = {c: f"__own_{c}" for c in docs.columns if c.lower() in ("removed", "kept_in")}
    out = without_duplicates(docs.withColumnsRenamed(clash))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("removed").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return out.select(*[F.col(f"`{clash.get(c, c)}`").alias(c) for c in docs.columns])
