"""SimHash near-dedup by pivot distance tables (operator 2).

Two notions share the method: fingerprints, a table of Hamming distances to reference fingerprints, pairs discarded
where any coordinate differs by more than the radius (triangle inequality), survivors verified.

`near_duplicates`: 64-bit fingerprints of 3-word shingles, linked at 3 or fewer differing bits; exact. Equal
fingerprints are one node, so copies are never paired. Two fingerprints within 3 bits agree in at least two of five
bit segments; nodes meet under those ten segment-pair keys. The nodes of a large key meet under finer keys: of the 39
other bits, cut into four, one part must agree too. Groups that stay large are cut into chunks, and every pair of
chunks is a unit of work that returns a spanning forest and not its pairs.

`near_classes`: texts whose sets of 5-word shingles have a Jaccard likeness of 0.8 or more. A radius of 3 bits is far too
narrow for that: such pairs differ in up to 15 of 100 bits. So fingerprints have 1024 bits, and nodes (different texts)
meet under BANDS keys of ROWS minimum hashes each, which a pair at 0.8 misses once in 40,000; the reference fingerprints
are drawn from the nodes at hand, as random ones discard nothing at that radius. In a large group, nodes that are surely
like one reference are linked to it and need not meet each other: only the rest meets all. Survivors form a least
spanning forest by distance, and its links are verified by the exact likeness of the texts' sets. That joins most of a
class, and may miss a link whose place in the forest a closer pair took that proved unlike. So nodes meet a second time
(those settled whose link failed now meet all), pairs of one class are left out, and where pairs within the radius are
left, the sets of their nodes go to the group and every such pair is verified there unless a link found before joins it.
No pair of a group within the radius is lost by this. The radius is the mean distance at 0.8 and six standard deviations.

Defined cases: a null text counts as one without words; no words give fingerprint zero, linked like any other, and
texts without words are alike; repeated rows and equal texts share a component; null doc_ids take part in
near_duplicates but are never a component's id (a component of null ids alone has a null id), and keep_one leaves them
alone; an empty table gives an empty result; extra columns are ignored, or stay in keep_one.
"""

from __future__ import annotations

from itertools import combinations
from math import acos, ceil, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clarispan.llm.common import components, forest, materialise, pair_slabs, resident, small_batches, spanning, table, whole_groups

DISTANCE = 3
CUTS = (0, 13, 26, 39, 52, 64)
FINER = (0, 10, 20, 30, 39)
CHUNK = 512
PIVOTS = np.random.default_rng(20).integers(0, 1 << 63, (24, 1), dtype=np.uint64) * np.uint64(2) + np.random.default_rng(21).integers(0, 2, (24, 1), dtype=np.uint64)
SEED = 42
LANES = np.uint64(0x0101010101010101)
#: Of near_classes: words of a shingle, least likeness, 64-bit words of a fingerprint, keys and hashes of a key, references of a large group.
SHINGLE, LEAST, WORDS, BANDS, ROWS, REFERENCES = 5, 0.8, 16, 20, 4, 8
_FACTORS = np.random.default_rng(22).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = np.random.default_rng(23).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_WORD_FACTORS = np.random.default_rng(24).integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of all word shingles, repeats included; of the whole sequence if it is shorter."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[: -shingle]]).tolist()
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> np.ndarray:
    """Words of the bits that more than half of the rows (rows x words) have. Bits are counted as bytes of 64-bit sums."""
    n, words = hashes.shape
    blocks, counts = np.arange(0, n, 255), np.zeros((words, 8, 8), np.int64)
    for bit in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(bit)) & LANES, blocks, axis=0)
        counts[:, :, bit] = sums.view(np.uint8).reshape(len(blocks), words, 8).sum(axis=0, dtype=np.int64)
    return np.packbits(counts.reshape(words, 64) * 2 > n, axis=1, bitorder="little").view(np.uint64)[:, 0]


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority bits of the XXH64 values of all word shingles, repeats included."""
    h = shingle_hashes(text, shingle)
    return int(majority(h[:, None])[0]) if len(h) else 0


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """WORDS words of majority bits of a set's hashes, each hash spread by multiplication and mixing."""
    if not len(hashes):
        return np.zeros(WORDS, np.uint64)
    with np.errstate(over="ignore"):
        spread = hashes[:, None] * _WORD_FACTORS[None, :]
        spread = (spread ^ (spread >> np.uint64(29))) * _WORD_FACTORS[0]
        return majority(spread ^ (spread >> np.uint64(32)))


def band_keys(hashes: np.ndarray) -> list[int]:
    """Keys under which sets meet: each a digest of ROWS minimum hashes; a set without members has one of its own."""
    if not len(hashes):
        return [0]
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 4096):
            low = np.minimum(low, (hashes[None, at : at + 4096] * _FACTORS[:, None] + _SHIFTS[:, None]).min(axis=1))
    return [xxhash.xxh64_intdigest(b.tobytes(), n) - (1 << 63) for n, b in enumerate(low.reshape(BANDS, ROWS))]


def radius(deviations: float, least: float = LEAST, bits: int = 64 * WORDS) -> int:
    """Bits in which large sets at a Jaccard likeness of `least` differ, and so many standard deviations."""
    p = acos(2 * least / (1 + least)) / pi
    return ceil(bits * p + deviations * sqrt(bits * p * (1 - p)))


#: Pairs beyond FAR are discarded (sets of few members vary more than large ones); those within SURE are alike.
FAR, SURE = radius(6), radius(-3)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches):
        resident("simhash", dict)
        for b in batches:
            fps = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def close_pairs(group: np.ndarray, fp: np.ndarray, pivots: np.ndarray, most: int):
    """Of rows sorted by group, slabs (i, j, distance) of pairs of a group whose fingerprints (rows x words) lie within
    `most` bits: those whose distances to some pivot (pivots x words) differ by more are discarded unseen."""
    bits = 64 * fp.shape[1]
    table_ = np.stack([np.bitwise_count(fp ^ p).sum(axis=1, dtype=np.int32) for p in pivots], axis=1)
    near = group * (bits + most + 1) + table_[:, 0]
    order = np.argsort(near, kind="stable")
    near, table_, sorted_fp = near[order], table_[order], fp[order]
    for i, j in pair_slabs(np.arange(1, len(fp) + 1), np.searchsorted(near, near + most, "right"), (1 << 20) // fp.shape[1]):
        for c in range(1, table_.shape[1]):
            if not len(i):
                break
            keep = np.abs(table_[i, c] - table_[j, c]) <= most
            i, j = i[keep], j[keep]
        distance = np.bitwise_count(sorted_fp[i] ^ sorted_fp[j]).sum(axis=1, dtype=np.int32)
        keep = distance <= most
        yield order[i[keep]], order[j[keep]], distance[keep]


def _group_numbers(t: pa.Table, keys: list[str]) -> np.ndarray:
    group = np.zeros(t.num_rows, np.int64)
    for k in keys:
        v = t[k].to_numpy()
        group[1:] |= v[1:] != v[:-1]
    return np.cumsum(group)


def _links(batches):
    """Of groups (key, i, j), the spanning forest of nodes whose fingerprints lie within DISTANCE."""
    for t in whole_groups(batches, ["key", "i", "j"]):
        fp, node = t["fp"].to_numpy().view(np.uint64)[:, None], t["node"].to_numpy()
        label = np.arange(len(fp))
        for i, j, _ in close_pairs(_group_numbers(t, ["key", "i", "j"]), fp, PIVOTS, DISTANCE):
            label = forest(len(fp), label[i], label[j])[label]
        linked = np.flatnonzero(label != np.arange(len(fp)))
        yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[label[linked]])], ["src", "dst"])


def near_pairs(nodes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Links (src, dst) that connect all nodes (node, fp) within DISTANCE bits."""
    def part(s):
        return F.shiftrightunsigned("fp", CUTS[s]).bitwiseAND(F.lit((1 << (CUTS[s + 1] - CUTS[s])) - 1))

    keys = []
    for n, pair in enumerate(combinations(range(5), 2)):
        a, b, *rest = *pair, *(s for s in range(5) if s not in pair)
        other = F.shiftleft(part(rest[0]), 26).bitwiseOR(F.shiftleft(part(rest[1]), 13)).bitwiseOR(part(rest[2]))
        keys.append(F.struct(F.lit(n << 32).bitwiseOR(F.shiftleft(part(a), 13)).bitwiseOR(part(b)).alias("key"), other.alias("other")))
    keyed = nodes.select(F.explode(F.array(*keys)).alias("k"), "node", "fp").select("k.*", "node", "fp")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(shared, "key")
    small = met.where(F.col("n") <= chunk).select("key", "node", "fp", F.lit(0).alias("i"), F.lit(0).alias("j"))
    finer = F.array(*[F.xxhash64("key", F.lit(s), F.shiftright("other", a).bitwiseAND(F.lit((1 << (b - a)) - 1))) for s, (a, b) in enumerate(zip(FINER, FINER[1:]))])
    fine = met.where(F.col("n") > chunk).select(F.explode(finer).alias("key"), "node", "fp")
    again = fine.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    cut = fine.join(again, "key").withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int"))
    cut = cut.withColumn("c", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    unit = cut.select("key", "node", "fp", "c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("o"))
    unit = unit.select("key", "node", "fp", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"))
    parts = small.unionByName(unit).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return parts.mapInArrow(_links, "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fp, component_id) for every document."""
    prints = materialise(fingerprints(docs, id_col, text_col), "simhash")
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-nodes")
    roots = components(near_pairs(nodes.where("node is not null")), "simhash-links")
    classes = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return prints.join(classes, "fp", "left").select("doc_id", "fp", "component_id")


UNIT = ["key", "i", "j"]


def _words_of(column) -> np.ndarray:
    """Rows x words of a list column."""
    return column.combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, WORDS)


def _close_in(t: pa.Table):
    """Slabs (i, j, distance) of pairs of a group's nodes within FAR; two settled ones do not meet."""
    fp, settled = _words_of(t["fp"]), t["settled"].to_numpy(zero_copy_only=False)
    pivots = fp[np.unique(np.linspace(0, len(fp) - 1, REFERENCES).astype(int))]
    for i, j, distance in close_pairs(_group_numbers(t, UNIT), fp, pivots, FAR):
        meet = ~(settled[i] & settled[j])
        yield i[meet], j[meet], distance[meet]


def _wide_links(batches):
    """Of groups (key, i, j), the least spanning forest of nodes within FAR."""
    for t in whole_groups(batches, UNIT):
        node, kept = t["node"].to_pylist(), [np.empty(0, np.int64)] * 3
        for slab in _close_in(t):
            kept = [np.concatenate([a, b]) for a, b in zip(kept, slab)]
            pick = spanning(t.num_rows, *kept)
            kept = [a[pick] for a in kept]
        yield pa.RecordBatch.from_arrays([pa.array([node[x] for x in kept[0]], pa.binary()), pa.array([node[x] for x in kept[1]], pa.binary())], ["src", "dst"])


def _open_nodes(batches):
    """The rows of groups whose nodes lie within FAR of one of another class."""
    for t in whole_groups(batches, UNIT):
        label, found = t["label"].combine_chunks().dictionary_encode().indices.to_numpy(), np.zeros(t.num_rows, bool)
        for i, j, _ in _close_in(t):
            apart = label[i] != label[j]
            found[i[apart]] = found[j[apart]] = True
        if found.any():
            yield from t.filter(pa.array(found)).combine_chunks().to_batches()


def _verified_links(batches):
    """Of open groups, with the nodes' sets (members), links between classes that are alike; closer pairs are tried first,
    and a pair whose classes are joined by then is not tried."""
    for t in whole_groups(batches, UNIT):
        node, label = t["node"].to_pylist(), t["label"].combine_chunks().dictionary_encode().indices.to_numpy().copy()
        members = [np.frombuffer(x.as_buffer(), np.uint64) for x in t["members"]]
        src, dst = [], []
        for i, j, distance in _close_in(t):
            order = np.argsort(distance, kind="stable")
            for x, y in zip(i[order].tolist(), j[order].tolist()):
                if label[x] != label[y] and likeness(members[x], members[y]) >= LEAST:
                    src.append(node[x])
                    dst.append(node[y])
                    label[label == label[x]] = label[y]
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.binary()), pa.array(dst, pa.binary())], ["src", "dst"])


def _apart(a, b):
    """Differing bits of two array<long> columns."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


class Groups:
    """Nodes (node, fp, keys) under the keys that two of them share. In a large group, the reference that most lie near
    settles those."""

    def __init__(self, nodes: DataFrame, chunk: int = CHUNK):
        keyed = nodes.select(F.explode("keys").alias("key"), "node")
        shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        self.chunk, self.live = chunk, materialise(keyed.join(shared, "key").join(nodes.select("node", "fp"), "node"), "simhash-live")
        self.large = self.live.where(F.col("n") > chunk)
        tried = self.large.groupBy("key", F.pmod(F.xxhash64("node"), F.lit(REFERENCES)).alias("r")).agg(F.min(F.struct("node", "fp")).alias("ref"))
        near = _apart(F.col("fp"), F.col("ref.fp")) <= SURE
        best = self.large.join(tried, "key").groupBy("key", "ref.node").agg(F.count_if(near).alias("near")).groupBy("key").agg(F.max_by("node", "near").alias("ref_node"), F.max("near").alias("near"))
        self.best = materialise(best.join(tried.select("key", F.col("ref.node").alias("ref_node"), F.col("ref.fp").alias("ref_fp")), ["key", "ref_node"]), "simhash-references")

    def stars(self) -> DataFrame:
        """Links of the settled to their references."""
        near = self.large.join(self.best, "key").where((_apart(F.col("fp"), F.col("ref_fp")) <= SURE) & (F.col("node") != F.col("ref_node")))
        return near.select(F.col("node").alias("src"), F.col("ref_node").alias("dst"))

    def units(self, roots: DataFrame | None = None) -> DataFrame:
        """Rows (key, i, j, node, fp, settled, label) in whole groups: a pair of chunks of a key each. Under roots (node, root),
        the classes so far, only nodes of their reference's class are settled; label is the class."""
        live, best = self.live.withColumn("label", F.col("node")), self.best.withColumn("ref_label", F.col("ref_node"))
        if roots is not None:
            live = self.live.join(roots.withColumnRenamed("root", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
            ref = roots.select(F.col("node").alias("ref_node"), F.col("root").alias("ref_label"))
            best = self.best.join(ref, "ref_node", "left").withColumn("ref_label", F.coalesce("ref_label", "ref_node"))
        chunk, pair = self.chunk, lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
        sure = _apart(F.col("fp"), F.col("ref_fp")) <= SURE
        split = live.where(F.col("n") > chunk).join(best, "key").withColumn("settled", sure if roots is None else sure & (F.col("label") == F.col("ref_label")))
        if roots is not None:
            split = materialise(split, "simhash-split")
            split = split.drop("near").join(split.groupBy("key").agg(F.count_if("settled").alias("near")), "key")
        rest, near_ = F.ceil((F.col("n") - F.col("near")) / chunk).cast("int"), F.ceil(F.col("near") / chunk).cast("int")
        split = split.withColumns({"rest": rest, "near_": near_}).withColumn("c", F.pmod(F.xxhash64("node"), F.when(F.col("settled"), F.col("near_")).otherwise(F.col("rest"))).cast("int"))
        of_rest = F.sequence(F.lit(0), F.col("rest") - 1)
        met = F.when(F.col("settled"), F.transform(of_rest, lambda o: pair(o, F.col("rest") + F.col("c")))).otherwise(F.concat(
            F.transform(of_rest, lambda o: pair(F.least("c", o), F.greatest("c", o))), F.when(F.col("near_") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("near_"), F.lit(1)) - 1), lambda o: pair(F.col("c"), F.col("rest") + o))).otherwise(F.array())))
        columns = ["key", "node", "fp", "settled", "label"]
        cut = split.where("rest > 0").select(*columns, F.explode(met).alias("u")).select(*columns, "u.*")
        small = live.where(F.col("n") <= chunk).select("key", "node", "fp", F.lit(False).alias("settled"), "label", F.lit(0).alias("i"), F.lit(0).alias("j"))
        return small.unionByName(cut).select(*UNIT, "node", "fp", "settled", "label").repartition(*UNIT).sortWithinPartitions(*UNIT)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two arrays of distinct values."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    total = len(a) + len(b) - both
    return both / total if total else 1.0


def _node():
    return F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def near_classes(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows (node, doc_id, root) for every different text: the digest of the text, its smallest doc_id, and the
    node that stands for all texts linked to it by a likeness of LEAST or more, directly or through others."""
    small_batches(docs.sparkSession)

    def signatures(batches):
        resident("simhash", dict)
        for b in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), SHINGLE)) for t in b.column(2)]
            fps = [wide_fingerprint(s).view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.list_(pa.int64())), pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))], ["doc_id", "node", "fp", "keys"])

    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), _node().alias("node"), "text")
    signed = materialise(rows.mapInArrow(signatures, "doc_id long, node binary, fp array<long>, keys array<long>"), "simhash-signatures")
    nodes = materialise(signed.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "simhash-texts")
    groups = Groups(nodes, chunk)
    links = groups.units().drop("label").mapInArrow(_wide_links, "src binary, dst binary").unionByName(groups.stars())
    links = materialise(links.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "simhash-candidates")

    def as_set(batches):
        for b in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), SHINGLE)).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["node", "members"])

    def alike(batches):
        for b in batches:
            near = [likeness(*(np.frombuffer(x.as_py(), np.uint64) for x in pair)) >= LEAST for pair in zip(b.column(2), b.column(3))]
            yield b.select(["src", "dst"]).filter(pa.array(near, pa.bool_()))

    def sets_of(wanted: DataFrame) -> DataFrame:
        ends = wanted.distinct().join(nodes.select("node", "doc_id"), "node")
        texts = rows.join(ends, ["doc_id", "node"]).groupBy("node").agg(F.first("text").alias("text"))
        return materialise(texts.mapInArrow(as_set, "node binary, members binary"), "simhash-sets")

    sets = sets_of(links.select(F.explode(F.array("src", "dst")).alias("node")))
    both = links.join(sets.select(F.col("node").alias("src"), F.col("members").alias("a")), "src").join(sets.select(F.col("node").alias("dst"), F.col("members").alias("b")), "dst")
    roots = components(both.select("src", "dst", "a", "b").mapInArrow(alike, "src binary, dst binary"), "simhash-components")
    open_ = groups.units(roots).mapInArrow(_open_nodes, "key long, i int, j int, node binary, fp array<long>, settled boolean, label binary")
    open_ = materialise(open_, "simhash-open")
    if not open_.isEmpty():
        ready = open_.join(sets_of(open_.select("node")), "node").select(*UNIT, "node", "fp", "settled", "label", "members")
        more = ready.repartition(*UNIT).sortWithinPartitions(*UNIT).mapInArrow(_verified_links, "src binary, dst binary")
        roots = components(roots.select(F.col("node").alias("src"), F.col("root").alias("dst")).unionByName(more), "simhash-components")
    return nodes.select("node", "doc_id").join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame) -> DataFrame:
    """Documents without near copies (near_classes): of each class one row of the smallest doc_id stays, and of
    rows that share it one of the smallest digest of the text, with its columns; rows with a null doc_id stay."""
    kept = near_classes(docs).groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("first")).select(F.col("first.doc_id").alias("__id"), F.col("first.node").alias("__node"))
    keyed = docs.where("doc_id IS NOT NULL").withColumns({"__id": F.col("doc_id").cast("long"), "__node": _node()})
    rest = keyed.join(kept, ["__id", "__node"], "left_semi").dropDuplicates(["__id", "__node"]).select(*docs.columns)
    return rest.unionByName(docs.where("doc_id IS NULL"))


def op2_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
