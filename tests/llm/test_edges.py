"""Defined results for nulls, empty tables, ties, repeated rows, long texts and extra columns."""

import itertools
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from clarispan.llm import bpe, exact_topk, kd_sharding, language_id, line_dedup, lz_fingerprint, packing, quality, simhash_neardup, token_counts
from clarispan.llm.language_id import Finder, likelihood, scaled
from clarispan.llm.pieces import pieces

OPERATORS = {
    "simhash": simhash_neardup.near_duplicates, "bpe": bpe.digests, "encode": bpe.encode_documents, "lz": lz_fingerprint.fingerprint_with_next,
    "packing": packing.pack_documents, "sharding": kd_sharding.shard, "tokens": token_counts.token_counts, "lines": line_dedup.without_duplicates,
    "language": lambda docs: language_id.predict(docs, language_id.fit(docs)),
    "quality": lambda docs: quality.scores(docs, quality.fit(docs, docs.select("doc_id", F.lit(1).alias("quality")))),
    "keep_one": simhash_neardup.keep_one, "keep_lines": line_dedup.keep_first_lines, "keep_identified": language_id.keep_identified,
    "keep_good": lambda docs: quality.keep_good(docs, docs.select("doc_id", F.lit(1).alias("quality"))),
}
PER_ROW = ["simhash", "bpe", "encode", "lz", "sharding", "tokens", "lines", "language", "quality"]


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(nothing, name):
    assert OPERATORS[name](nothing).count() == 0


@pytest.mark.parametrize("name", PER_ROW)
def test_every_awkward_row_has_its_result(awkward, awkward_rows, name):
    got = OPERATORS[name](awkward).collect()
    key = lambda i: (i is None, i or 0)
    assert sorted((r["doc_id"] for r in got), key=key) == sorted((r[0] for r in awkward_rows), key=key)


@pytest.mark.parametrize("name", ["keep_one", "keep_lines", "keep_identified", "keep_good"])
def test_stages_return_the_columns(awkward, name):
    out = OPERATORS[name](awkward)
    assert out.columns == awkward.columns and out.count() > 0


def test_near_copies_and_null_ids(awkward):
    got = {r["doc_id"]: r["component_id"] for r in simhash_neardup.near_duplicates(awkward).collect()}
    assert got[5] == got[6] == 5 and got[0] == got[1] == got[2] == 0 and got[None] is not None
    kept = [r["doc_id"] for r in simhash_neardup.keep_one(awkward).collect()]
    assert kept.count(5) == 1 and 6 not in kept and kept.count(None) == 1


def test_empty_texts(awkward):
    found = {r["doc_id"]: r for r in bpe.digests(awkward).collect()}
    assert found[0]["n_tokens"] == found[1]["n_tokens"] == 0 and found[0]["ids_sha256"] == found[1]["ids_sha256"]
    ids = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in OPERATORS["language"](awkward).collect()}
    assert ids[0] == ids[1] == ids[2] == ("und", 0.0) and ids[3][0] != "und"
    prints = {r["doc_id"]: r for r in lz_fingerprint.fingerprint_with_next(awkward).collect()}
    assert prints[0]["fingerprint"] == prints[1]["fingerprint"] == "" and prints[1]["near_next"] == 1.0
    tokens = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(awkward).collect()}
    assert tokens[0] == tokens[1] == tokens[2] == 0
    pieces_of = packing.pack_documents(awkward).where("doc_id IN (0, 1)").collect()
    assert [(r["length"], r["doc_tokens"]) for r in pieces_of] == [(1, 1), (1, 1)]


def test_a_single_document_is_its_own_next(spark):
    got = lz_fingerprint.fingerprint_with_next(spark.createDataFrame([(4, "abcabcabc")], "doc_id long, text string")).collect()
    assert len(got) == 1 and got[0]["near_next"] == 1.0


def test_parses_continue_and_rewind():
    pick = random.Random(1)
    text, other = ("".join(pick.choices("abcdé🙂", k=n)) for n in (300_000, 500))
    whole, parse = lz_fingerprint.Parse().feed(text), lz_fingerprint.Parse().feed(text[:200_000])
    mark = parse.mark()
    assert (parse.feed(text[200_000:]).low == whole.low).all() and len(parse.hashes) == len(whole.hashes) > 20_000
    parse.rewind(mark)
    assert (parse.feed(other).low == lz_fingerprint.Parse().feed(text[:200_000] + other).low).all()


def test_merge_rounds_of_runs(awkward):
    tokens = bpe.vocabulary(__import__("public_tokenizers").path(bpe.VOCABULARY))
    for word in ("aaaaaaa", "a" * 999, "abab" * 50, " " * 33 + "x"):
        ids = tokens.encode([word])[0]
        assert tokens.decode(ids) == word


def vectors(spark, rows):
    return exact_topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))


def test_topk_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.5], 1), (1, [0.25, 0.0], 1), (2, [0.25, 0.0], 1), (2, [0.25, 0.0], 1), (3, None, 1), (4, [nan, 1.0], 1), (5, [None, 1.0], 1), (6, [inf, 0.0], 1), (7, [1.0], 1), (None, [1.0, 1.0], 1), (8, [-1.0, 1.0], None), (50, [0.1, 0.1], 1)]
    v = vectors(spark, rows)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in exact_topk.top_k(v, v.where("vec_id % 50 = 0"), 3).collect())
    assert got == [(0, 1, 1, 8192), (0, 2, 2, 8192), (0, 3, 2, 8192), (50, 1, 1, 1600), (50, 2, 2, 1600), (50, 3, 2, 1600)]
    assert exact_topk.top_k(v.limit(0), v.limit(0)).count() == 0


def test_topk_scores_beyond_a_long(spark):
    rows = [(i, [x, y], 1) for i, (x, y) in enumerate([(1e16, 0.5), (1e20, -3.0), (3e38, 3e38), (-1e30, 2.0), (0.25, 0.5), (-0.3, 7.0), (1e16, 0.5), (-3e38, 1.0)])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(2)
    v = exact_topk.quantised(table)
    whole = {i: [int(np.floor(256 * np.float64(x))) for x in e] for i, e, _ in rows}
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in exact_topk.top_k(v, v, 8, block_rows=3).collect())
    want = []
    for q, a in whole.items():
        best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole.items() if i != q)
        want += [(q, n, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for n, (s, i) in enumerate(best, 1)]
    assert got == want
    some = [-(1 << 200), -257, -256, -1, 0, 1, 255, 256, 1 << 64, 1 << 300]
    assert sorted(some, key=exact_topk.ordered) == some


def test_bit_slices_equal_products():
    rng = np.random.default_rng(3)
    v = rng.integers(-300, 300, (333, 9))
    index = exact_topk.BitSlices.of(np.arange(333), v)
    for q in (*rng.integers(-300, 300, (5, 9)), np.zeros(9, int), v[0] * 0 + 1):
        want = sorted(((int(s), -i) for i, s in enumerate(v @ q) if i != 4), reverse=True)[:6]
        assert sorted(((s, -i) for i, s in index.top(q, 4, 6)), reverse=True) == want


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[:], i
        for j, y in enumerate(b, 1):
            row[j] = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y))
    return row[-1]


def near(a, b):
    return edits(a, b) <= line_dedup.allowed(min(len(a), len(b)))


def test_banded_distance(monkeypatch):
    monkeypatch.setattr(line_dedup, "CELLS", 1000)
    assert [line_dedup.allowed(n) for n in (11, 12, 23, 24, 9999)] == [0, 1, 1, 2, 2]
    rng = random.Random(5)
    left, right = [], []
    while len(left) < 800:
        a = "".join(rng.choice("abñ") for _ in range(rng.randint(3, 30)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            p = rng.randint(0, max(len(b) - 1, 0))
            b[p : p + rng.randint(0, 1)] = rng.choice(["", "a", "b", "ñ"])
        if b and abs(len(a) - len(b)) <= 2:
            left.append(a)
            right.append("".join(b))
    assert line_dedup.within(left, right).tolist() == [near(a, b) for a, b in zip(left, right)]


@pytest.mark.parametrize("many, chunk", [(4096, 256), (2, 3), (6, 256)])
def test_lines_match_all_pairs(spark, monkeypatch, many, chunk):
    monkeypatch.setattr(line_dedup, "MANY", many)
    monkeypatch.setattr(line_dedup.near_line_links, "__defaults__", (chunk,))
    rng = random.Random(9)
    lines = ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice([8, 9, 10, 11, 12, 13, 21, 22, 23, 24, 25, 40]))).strip() + "." for _ in range(60)]
    docs = []
    for i in range(40):
        mine = []
        for _ in range(6):
            s = list(rng.choice(lines))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                s[rng.randrange(len(s))] = rng.choice(["x", "y", "", "za"])
            mine.append("".join(s))
        docs.append((i, "\n".join([*mine, "", "short", " "]), i))
    got = {(r["doc_id"], r["pos"]): (r["kept_doc"], r["kept_pos"]) for r in line_dedup.duplicates(spark.createDataFrame(docs, "doc_id long, text string, removed int")).collect()}
    every = [((i, p), s.strip(" ")) for i, t, _ in docs for p, s in enumerate(t.split("\n")) if s.strip(" ")]
    root = {}

    def find(s):
        while root.get(s, s) != s:
            s = root[s]
        return s

    distinct = sorted({s for _, s in every})
    for a in distinct:
        for b in distinct:
            if a < b and abs(len(a) - len(b)) <= 2 and near(a, b):
                root[find(a)] = find(b)
    first, want = {}, {}
    for at, s in every:
        if first.setdefault(find(s), at) != at:
            want[at] = first[find(s)]
    assert got == want and len(want) > 50


def shingle_set(text):
    words = text.encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("chunk", [512, 12])
def test_near_classes_match_all_pairs(spark, chunk):
    pick = random.Random(21)
    base = [[pick.choice("abcdefgh") + str(pick.randrange(200)) for _ in range(n)] for n in (4, 9, 30, 30, 120, 400)]
    texts = ["", " ", "one", "One\ntwo"]
    for i, words in enumerate(base):
        for _ in range(60 if i == 3 else 12):
            mine = list(words)
            for _ in range(pick.randrange(1 + max(1, len(mine) // 40))):
                mine[pick.randrange(len(mine))] = "new" + str(pick.randrange(10**6))
            texts.append(" ".join(mine))
    docs = spark.createDataFrame([*((i, t) for i, t in enumerate(texts)), (len(texts), texts[-1])], "doc_id long, text string")
    distinct = list(dict.fromkeys(texts))
    sets, root = [shingle_set(t) for t in distinct], list(range(len(distinct)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if len(a & b) >= 0.8 * len(a | b):
                root = [root[j] if x == root[i] else x for x in root]
    first = {}
    for i, t in enumerate(distinct):
        first.setdefault(root[i], texts.index(t))
    kept = sorted(r["doc_id"] for r in simhash_neardup.near_classes(docs, chunk).groupBy("root").agg(F.min("doc_id").alias("doc_id")).collect())
    assert kept == sorted(first.values())
    assert sorted(r["doc_id"] for r in simhash_neardup.keep_one(docs).collect()) == kept


@pytest.mark.parametrize("chunk", [512, 12])
def test_no_link_near_the_threshold_is_lost(spark, chunk):
    """Texts whose likeness is spread around 0.8: classes equal those of all pairs within the search's keys, which all share."""
    pick, texts = random.Random(5), []
    for g in range(30):
        base = [f"w{g}x{pick.randrange(10**6)}" for _ in range(150)]
        for _ in range(14):
            mine = list(base)
            for at in pick.sample(range(0, 150, 6), pick.choice([1, 2, 2, 3, 3])):
                mine[at] = f"n{pick.randrange(10**6)}"
            texts.append(" ".join(mine))
    sets, root = [shingle_set(t) for t in texts], list(range(len(texts)))
    near = [len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[i - i % 14 : i]]
    assert sum(0.75 < x < 0.8 for x in near) > 100 and sum(0.8 <= x < 0.85 for x in near) > 100
    for i, a in enumerate(sets):
        for j in range(i - i % 14, i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                root = [root[j] if x == root[i] else x for x in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["root"] for r in simhash_neardup.near_classes(docs, chunk).collect()}
    assert len({(root[i], got[i]) for i in got}) == len(set(root)) == len(set(got.values()))


def test_rows_that_share_an_id_leave_one_by_a_fixed_order(spark):
    rows = [(1, "b b b b b b"), (1, "a a a a a a"), (1, "b b b b b b"), (2, "a a a a a a")]
    for order in (rows, rows[::-1]):
        got = simhash_neardup.keep_one(spark.createDataFrame(order, "doc_id long, text string")).collect()
        assert sorted(map(tuple, got)) == [(1, "a a a a a a"), (1, "b b b b b b")]


def test_blank_lines_and_line_ends(spark):
    docs = spark.createDataFrame([(1, "One line here.\r\n\r\n\t\r\nnext"), (2, "\r\n one line here. \r\nOne line here.\n\n \t\nlast\r")], "doc_id long, text string")
    out = {r["doc_id"]: (r["text"], r["removed"]) for r in line_dedup.without_duplicates(docs).collect()}
    assert out[1] == ("One line here.\r\n\r\n\t\r\nnext", None)
    assert out[2] == ("\r\n\n \t\nlast\r", [1, 2])


def test_groups_of_equal_texts_lie_in_one_shard(spark):
    pick = random.Random(4)
    texts = ["".join(pick.choices("abcdefgh ", k=pick.randrange(50, 800))) for _ in range(3000)]
    rows = [(i, t, pick.choice(["en", "de"]), pick.choice(["p", "q"])) for i, t in enumerate([*texts, *pick.choices(texts[:400], k=900), *["same"] * 2000])]
    rows += [(None, "twin", "en", "p")] * 3
    got = kd_sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    of = dict(zip((r[0] for r in rows), (r[1] for r in rows)))
    shards, sizes, slots = {}, {}, {}
    for r in got:
        shards.setdefault(of[r["doc_id"]], set()).add(r["shard"])
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    tenth = sum(sizes.values()) / 400
    times = {t: sum(of[r["doc_id"]] == t for r in got) for t in shards if len(shards[t]) > 1}
    assert len(got) == len(rows) and "same" in times and all(n * (len(t) + 16) > tenth for t, n in times.items() if t != "same")
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) < 1.15 * min(sizes.values())


def test_a_very_long_line_and_extra_columns(spark):
    long = "".join(random.Random(3).choices("abcdefgh", k=120_000))
    docs = spark.createDataFrame([(1, long, 5, "k"), (2, "x" + long[:-1], 6, "l"), (3, "y" + long[9:], 7, "m")], "doc_id long, text string, Removed int, kept_in string")
    out = {r["doc_id"]: r for r in line_dedup.keep_first_lines(docs).collect()}
    assert [out[i]["text"] == "" for i in (1, 2, 3)] == [False, True, False] and [(r["Removed"], r["kept_in"]) for _, r in sorted(out.items())] == [(5, "k"), (6, "l"), (7, "m")]


def test_chunks_of_large_groups_lose_no_link(spark):
    rng = np.random.default_rng(4)
    center = int(rng.integers(0, 1 << 62))
    prints = sorted({center ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (400, 2))})
    nodes = spark.createDataFrame([(i, p) for i, p in enumerate(prints)], "node long, fp long")
    from clarispan.llm.common import components

    small = components(simhash_neardup.near_pairs(nodes, chunk=16)).collect()
    label = {r["node"]: r["root"] for r in small}
    root = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    assert [label.get(i, i) for i in range(len(prints))] == root


def test_forward_sums_all_segmentations():
    table, finder = pieces(), Finder(pieces())
    rng = np.random.default_rng(1)
    prob = rng.random((len(table), 2)) ** 8

    def total(w):  # logs of the sums before each position
        ways = [np.zeros(2)]
        for e in range(1, len(w) + 1):
            found = [ways[s] + np.log(prob[table[w[s:e]]] if w[s:e] in table else np.full(2, language_id.UNKNOWN)) for s in range(max(0, e - 20), e) if w[s:e] in table or s == e - 1]
            ways.append(np.logaddexp.reduce(found, axis=0))
        return ways[-1]

    pick = random.Random(2)
    words = ["▁then", "☃x", *("▁" + "".join(pick.choices("thenrasiougé☃", k=n)) for n in (15, 30, 31, 32, 33, 63, 64, 65, 66, 127, 128, 129, 500, 1500))]
    assert np.allclose(likelihood(words, scaled(prob, table), finder), [total(w) for w in words], rtol=1e-9)


def test_expected_uses_of_long_words():
    table = {p: i for i, p in enumerate(["a", "b", "ab", "ba", "aba"])}
    pick = random.Random(4)
    words = {"".join(pick.choices("ab", k=n)): c for n, c in ((3, 2), (40, 1), (200, 3), (900, 1))}
    prob = np.full(5, 0.2)
    for _ in range(2):
        expected = np.full(5, 0.01)
        for w, c in words.items():
            ahead, behind = [0.0], [0.0]
            for e in range(1, len(w) + 1):
                ahead.append(np.logaddexp.reduce([ahead[s] + np.log(prob[table[w[s:e]]]) for s in range(max(0, e - 3), e) if w[s:e] in table]))
            for s in range(len(w) - 1, -1, -1):
                behind.insert(0, np.logaddexp.reduce([behind[e - s - 1] + np.log(prob[table[w[s:e]]]) for e in range(s + 1, min(len(w), s + 3) + 1) if w[s:e] in table]))
            for s in range(len(w)):
                for e in range(s + 1, min(len(w), s + 3) + 1):
                    if w[s:e] in table:
                        expected[table[w[s:e]]] += c * np.exp(ahead[s] + np.log(prob[table[w[s:e]]]) + behind[e] - ahead[-1])
        prob = expected / expected.sum()
    assert np.allclose(language_id.fit_language(words, table, 2), prob, rtol=1e-8)


def test_every_language_has_its_sample(spark, monkeypatch):
    monkeypatch.setattr(language_id, "FIT_ROWS", 5)
    rows = [(i, "rare " * 9000 if i in (7, 9) else f"text {i % 50}", "xx" if i in (7, 9) else "en") for i in range(400)]
    got = language_id.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string")).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in got} == {"en": 5, "xx": 1}


def test_token_counts_of_long_runs(monkeypatch):
    pick = random.Random(6)
    words = sorted("▁" + "".join(pick.choices("thenrasiougé☃", k=n)) for n in (5, 127, 128, 129, 200, 300, 2000) for _ in range(3))
    words += [w + "tail" for w in words]
    want = token_counts.TrieCounter()
    with monkeypatch.context() as m:
        m.setattr(token_counts, "DEPTH", 1 << 30)
        want.learn(sorted(words))
    monkeypatch.setattr(token_counts, "STRIDE", 50)
    got = token_counts.TrieCounter()
    got.learn(sorted(words))
    assert got.known == want.known
    score = got.score
    for w in words:
        ways = [0.0]
        for e in range(1, len(w) + 1):
            ways.append(float(np.logaddexp.reduce([ways[s] + (score[w[s:e]] if w[s:e] in score else token_counts.UNKNOWN) for s in range(max(0, e - 20), e) if w[s:e] in score or s == e - 1])))
        assert abs(got.known[w][1] - ways[-1]) < 1e-6


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(quality.FEATURES)))
    y = ((x[:, 2] > 0.5) ^ (x[:, 5] > 0.5)).astype(float)
    model = quality.fit_additive(x[:3000], y[:3000])
    assert (5, 2) in model.pairs and np.mean((model.score(x[3000:]) > 0.5) == y[3000:]) > 0.95


def test_hot_groups_are_split_between_shards(spark):
    rows = [(i, "same text" if i % 3 else f"text {i}" * (i % 7), "en", "s") for i in range(3000)]
    got = kd_sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), 8).groupBy("shard").agg(F.sum("size").alias("w")).collect()
    load = [r["w"] for r in got]
    assert len(load) == 8 and max(load) < 1.05 * min(load)
    rows = [(None, "same text", None, None)] * 3000
    got = kd_sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), 8).groupBy("shard").count().collect()
    assert len(got) == 8 and max(r["count"] for r in got) < 1.2 * min(r["count"] for r in got)


def test_word_encoder_equals_the_library_on_any_characters():
    encoder = packing.WordEncoder(public_tokenizers.path(packing.VOCABULARY))
    pick = random.Random(3)
    letters = [chr(c) for c in range(0x250)] + list("\u03a3\u03c3\u01c5\ufb01\u2019\u2014\u2026\u4e2d\u0627\u0327\u0301\u2028\u3000\U0001f600") + ["<|endoftext|>", "<|startoftext|>", "<|", "'S", "'RE "]
    texts = ["", " ", "\x1c a", "it's <|endoftext|>x", *("".join(pick.choices(letters, k=pick.randint(0, 14))) for _ in range(4000))]
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode(texts)] == want


def test_word_encoder_cuts_quotes_as_the_library():
    encoder = packing.WordEncoder(public_tokenizers.path(packing.VOCABULARY))
    pick = random.Random(4)
    texts = ["'", "'s", "'ll'", "a'll", "x''s", "'r", "\x1c\x1d'", "1'd2", *("".join(pick.choices(3 * "'" + "strevelmd 1.\n\xe9S", k=pick.randint(0, 9))) for _ in range(4000))]
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode(texts)] == want
    assert [encoder.encode([t])[0].tolist() for t in texts[:500]] == want[:500]


def test_word_encoder_merges_recurring_words_once(monkeypatch):
    """Of many new words a table is full again and again; a word of every batch is merged once all the same."""
    monkeypatch.setattr(packing, "KNOWN_WORDS", 40)
    encoder, merged = packing.WordEncoder(public_tokenizers.path(packing.VOCABULARY)), []
    learn = encoder.learn
    encoder.learn = lambda new: merged.extend(w if isinstance(w, str) else w.decode("utf-16-le") for w in new) or learn(new)
    names = ["".join(x) for x in itertools.product("abcdefgh", repeat=3)]
    for at in range(0, len(names), 8):
        texts = ["recurring " * 5 + " ".join(names[at : at + 8])]
        assert encoder.encode(texts)[0].tolist() == encoder.tokenizer.encode(texts[0], add_special_tokens=False).ids
    assert merged.count("recurring") == 1 and len(merged) == len(names) + 1
    assert len(encoder.known) + len(encoder.older) < 80


def test_related_documents_meet_across_shards(spark):
    pick = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = ["".join(pick.choices(letters, k=7)) for _ in range(3000)]
    topics = [pick.sample(names, 30) for _ in range(40)]
    docs = spark.createDataFrame([(i, " ".join(pick.choices(topics[i % 40], k=40))) for i in range(800)], "doc_id long, text string").repartition(3)
    shards = {}
    for r in packing.pack_documents(docs, shard_docs=40).collect():
        shards.setdefault(r["sequence_id"] >> 34, set()).add(r["doc_id"])
    same = [sum(o % 40 == d % 40 for o in s) - 1 for s in shards.values() for d in s]
    assert np.mean(same) > 5  # of 19; dealt by a hash it is about one


def test_packing_statistics_cover_whole_documents(spark):
    docs = spark.createDataFrame([(i, "red " * 3000 + "blue" if i == 0 else "green") for i in range(9)], "doc_id long, text string")
    seen = []
    at, packing.statistics = packing.statistics, lambda rows: seen.append(at(rows)) or seen[0]
    try:
        got = packing.pack_documents(docs, shard_docs=2).collect()
    finally:
        packing.statistics = at
    word = packing.WordEncoder(public_tokenizers.path(packing.VOCABULARY)).encode(["red", "blue", "green"])
    assert seen[0].n == 9 and [int(seen[0].df[w[0]]) for w in word] == [1, 1, 8] and seen[0].mean == (3002 + 16) / 9
    assert sum(r["length"] for r in got) == 3002 + 16


def test_lines_of_a_hot_segment_meet_under_finer_keys(spark, monkeypatch):
    """Many lines begin alike; their classes are those of all pairs, and groups of the finer keys are small."""
    monkeypatch.setattr(line_dedup, "MANY", 50)
    rng = random.Random(12)
    lines = []
    for _ in range(400):
        line = "Copyright notice " + "".join(rng.choices("abcdefghij", k=rng.choice([4, 5, 9, 12])))
        lines.append(line)
        if rng.random() < 0.5:
            s = list(line)
            for _ in range(rng.choice([1, 1, 2])):
                at = rng.randrange(17, len(s)) if rng.random() < 0.8 else rng.randrange(len(s))
                s[at : at + rng.randrange(2)] = rng.choice(["", "z", "yx"])
            lines.append("".join(s).strip())
    distinct, root = list(dict.fromkeys(lines)), {}

    def find(s):
        while root.get(s, s) != s:
            s = root[s]
        return s

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if abs(len(a) - len(b)) <= 2 and near(a, b):
                root[find(a)] = find(b)
    first, want = {}, set()
    for at, s in enumerate(lines):
        if first.setdefault(find(s), at) != at:
            want.add((at, first[find(s)]))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    assert {(r["doc_id"], r["kept_doc"]) for r in line_dedup.duplicates(docs).collect()} == want and len(want) > 100
