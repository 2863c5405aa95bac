"""Registered queries against brute force over the whole small tables."""

import math
import os
import zlib
from hashlib import sha256

import duckdb
import numpy as np
import pytest

from clarispan.llm import language_id, line_dedup, packing, quality, queries, token_counts
from clarispan.llm.common import table
from clarispan.llm.pieces import pieces, pretokens

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    if not os.path.isdir(DIR):
        pytest.skip("no test data")
    return {i: t or "" for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{DIR}/documents.parquet'").fetchall()}


def rows(spark, name):
    return {r["doc_id"]: r for r in queries.QUERIES[name](spark, DIR).collect()}


def edits_up_to(a, b, most):
    """The edit distance of two strings, or most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def close_lines(distinct):
    """Pairs of lines within their edits. Lines that differ by two edits share one of three thirds of the shorter one,
    at most two places away; every such pair is compared."""
    for allowed in (1, 2):
        at = {}
        for s in distinct:
            if line_dedup.allowed(len(s)) == allowed:
                k = allowed + 1
                for i in range(k):
                    a, z = len(s) * i // k, len(s) * (i + 1) // k
                    at.setdefault(s[a:z], {}).setdefault((a, z - a), []).append(s)
        sizes = sorted({len(p) for p in at})
        for t in distinct:
            seen = set()
            for size in sizes:
                for start in range(len(t) - size + 1):
                    for (a, _), found in at.get(t[start : start + size], {}).items():
                        if abs(a - start) <= 2:
                            for s in found:
                                if s not in seen and s != t and 0 <= len(t) - len(s) <= 2:
                                    seen.add(s)
                                    if edits_up_to(s, t, 2) <= allowed:
                                        yield s, t


def test_line_dedup(spark, texts):
    every = {(i, p): s for i, t in texts.items() for p, x in enumerate(t.split("\n")) if (s := x.strip(" "))}
    root = {}

    def find(s):
        while root.get(s, s) != s:
            s = root[s]
        return s

    for a, b in close_lines(sorted(set(every.values()))):
        root[find(a)] = find(b)
    first, kept, gone = {}, {}, {}
    for at in sorted(every):
        keep = first.setdefault(find(every[at]), at)
        if keep != at:
            gone.setdefault(at[0], set()).add(at[1])
            kept.setdefault(at[0], set()).add(keep[0])
    got = rows(spark, "op3_line_dedup")
    assert sorted(got) == sorted(texts)
    for i, t in texts.items():
        lines = t.split("\n")
        left = "\n".join(x for p, x in enumerate(lines) if p not in gone.get(i, ()))
        r = got[i]
        assert (r["n_lines"], r["n_removed"], r["kept_in"]) == (len(lines), len(gone.get(i, ())), sorted(kept.get(i, ())))
        assert r["text_sha256"] == sha256(left.encode()).hexdigest()


def test_token_counts_and_log_probabilities(spark, texts):
    score = token_counts.TrieCounter().score
    known = {}

    def counted(w):
        if w not in known:
            best, ways = [(0.0, 0)], [0.0]
            for e in range(1, len(w) + 1):
                steps = [(s, score[w[s:e]], 1) for s in range(max(0, e - 20), e) if w[s:e] in score]
                if w[e - 1] not in score:
                    steps.append((e - 1, token_counts.UNKNOWN, len(w[e - 1].encode())))
                best.append(min(((best[s][0] - p, best[s][1] + k) for s, p, k in steps)))
                ways.append(float(np.logaddexp.reduce([ways[s] + p for s, p, _ in steps])))
            known[w] = best[-1][1], ways[-1]
        return known[w]

    for i, r in rows(spark, "op10_token_counts").items():
        found = [counted(w) for w in pretokens(texts[i])]
        assert r["n_pretokens"] == len(found) and abs(r["n_tokens"] - sum(n for n, _ in found)) <= 0
        assert math.isclose(r["log_prob"], sum(p for _, p in found), rel_tol=1e-9, abs_tol=1e-6)


def test_language_posteriors(spark, texts):
    docs = table(spark, DIR, "documents")
    langs, prob = language_id.fit(docs)
    logs, number, known = np.log(prob.astype(np.float32).astype(float)), pieces(), {}

    def likelihood(w):
        if w not in known:
            ways = [np.zeros(len(langs))]
            for e in range(1, len(w) + 1):
                steps = [ways[s] + logs[number[w[s:e]]] for s in range(max(0, e - 20), e) if w[s:e] in number]
                if w[e - 1] not in number:
                    steps.append(ways[e - 1] + math.log(language_id.UNKNOWN))
                ways.append(np.logaddexp.reduce(steps, axis=0))
            known[w] = ways[-1]
        return known[w]

    got = {r["doc_id"]: r for r in language_id.predict(docs, (langs, prob)).collect()}
    for i in sorted(texts)[:60]:
        if any(c.isalpha() for c in texts[i]):
            total = sum(likelihood(w) for w in pretokens(texts[i].lower()))
            odds = np.exp(total - total.max())
            assert got[i]["lang_pred"] == langs[int(odds.argmax())] and math.isclose(got[i]["score"], odds.max() / odds.sum(), abs_tol=1e-6)
        else:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)


def test_quality_scores_are_sums_of_table_values(spark, texts):
    docs = table(spark, DIR, "documents")
    model = quality.fit(docs, table(spark, DIR, "labels"))
    got = {r["doc_id"]: r["score"] for r in quality.scores(docs, model).collect()}

    def bin_of(edges, x):
        return sum(e <= x for e in edges)

    for i, t in texts.items():
        x = quality.features(t)
        raw = model.intercept + sum(tab[bin_of(e, v)] for e, tab, v in zip(model.edges, model.tables, x))
        raw += sum(tab[bin_of(model.pair_edges[a], x[a]), bin_of(model.pair_edges[b], x[b])] for (a, b), tab in zip(model.pairs, model.pair_tables))
        assert math.isclose(got[i], 1 / (1 + math.exp(-raw)), abs_tol=1e-9)
    assert 1 <= len(model.pairs) <= quality.PAIRS


def test_sharding_sizes_and_checksums(spark, texts):
    got = rows(spark, "op9_kd_sharding")
    assert {i: (r["size"], r["text_crc32"]) for i, r in got.items()} == {i: (len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in texts.items()}


def test_neighbours_are_the_best_by_bm25():
    rng = np.random.default_rng(5)
    ids = [rng.integers(0, 60, n).astype(np.uint32) for n in rng.integers(5, 80, 90)]
    ids[7] = ids[6].copy()
    df = np.bincount(np.concatenate([np.unique(x) for x in ids]), minlength=60)
    size = np.array([len(x) for x in ids])
    corpus = packing.Corpus(len(ids), int(size.sum()), df)
    index = packing.ShardIndex(ids, [None] * len(ids), size, corpus)
    unused = rng.random(len(ids)) < 0.8

    def bm25(seed, d):
        total = 0.0
        for t in np.unique(ids[seed]):
            tf, idf = int((ids[d] == t).sum()), math.log((len(ids) - df[t] + 0.5) / (df[t] + 0.5))
            if tf and idf > 0:
                total += idf * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(ids[d]) / (size.sum() / len(ids))))
        return total

    for seed in (0, 6, 50):
        want = sorted(((-round(bm25(seed, d), 9), d) for d in range(len(ids)) if unused[d] and bm25(seed, d) > 0))[: packing.NEIGHBOURS]
        found = index.neighbours(seed, unused)
        assert sorted(round(bm25(seed, int(d)), 9) for d in found) == sorted(-s for s, _ in want)
        assert [round(bm25(seed, int(d)), 9) for d in found] == [-s for s, _ in want]


def test_windows_are_filled_by_the_seed_s_neighbours():
    rng = np.random.default_rng(9)
    ids = [rng.integers(0, 40, n).astype(np.uint32) for n in rng.integers(3, 30, 40)]
    size = np.array([len(x) for x in ids])
    corpus = packing.Corpus(len(ids), int(size.sum()), np.bincount(np.concatenate([np.unique(x) for x in ids]), minlength=40))
    index, window = packing.ShardIndex(ids, [None] * len(ids), size, corpus), 64
    sequences = packing.pack(ids, index, window)
    covered = [[False] * len(x) for x in ids]
    for pieces_ in sequences:
        for d, a, b in pieces_:
            assert not any(covered[d][a:b])
            covered[d][a:b] = [True] * (b - a)
    assert all(all(c) for c in covered) and all(sum(b - a for _, a, b in s) == window for s in sequences[:-6])
    unused = np.ones(len(ids), bool)
    unused[0] = False
    best = index.neighbours(0, unused).tolist()
    first = [d for d, _, _ in sequences[0]]
    assert first[0] == 0 and first[1:] == best[: len(first) - 1]


def test_used_documents_leave_a_shard_s_postings(monkeypatch):
    """Sequences are the same whether and when the index is cut, and fewer postings are read."""
    rng = np.random.default_rng(12)
    ids = [rng.integers(0, 300, n).astype(np.uint32) for n in rng.integers(3, 60, 400)]
    size = np.array([len(x) for x in ids])
    corpus = packing.Corpus(len(ids), int(size.sum()), np.bincount(np.concatenate([np.unique(x) for x in ids]), minlength=300))
    index, found, read = packing.ShardIndex(ids, [None] * len(ids), size, corpus), {}, {}
    bincount = np.bincount
    for share in (0.0, 0.5, 0.75, 1.0):
        monkeypatch.setattr(packing, "FEWER", share)
        monkeypatch.setattr(np, "bincount", lambda x, *a: read.update({share: read.get(share, 0) + len(x)}) or bincount(x, *a))
        found[share] = packing.pack(ids, index, 128)
        monkeypatch.setattr(np, "bincount", bincount)
    assert all(x == found[0.0] for x in found.values())
    assert read[0.75] < 0.75 * read[0.0] and read[1.0] <= read[0.75] <= read[0.5]


def test_a_window_takes_more_than_the_first_neighbours():
    """200 short documents on a topic of rare ids among 500 others: the seed's window holds them before any other."""
    rng = np.random.default_rng(11)
    topic = rng.choice(800, 200, replace=False)
    ids = [np.concatenate([rng.integers(1000, 1010, 2), rng.integers(0, 500, 3)]).astype(np.uint32) if d in set(topic.tolist()) else rng.integers(0, 500, 5).astype(np.uint32) for d in range(800)]
    size = np.array([len(x) for x in ids])
    corpus = packing.Corpus(len(ids), int(size.sum()), np.bincount(np.concatenate([np.unique(x) for x in ids]), minlength=1010))
    index, unused, seed = packing.ShardIndex(ids, [None] * len(ids), size, corpus), np.ones(800, bool), int(topic[0])
    unused[seed] = False
    few, many = index.neighbours(seed, unused), index.neighbours(seed, unused, size, 300)
    assert len(few) == packing.NEIGHBOURS and size[many].sum() >= 300 and many[: len(few)].tolist() == few.tolist() and len(many) > len(few)
    every = index.neighbours(seed, unused, size, 10**9)
    assert len(every) > len(many) - 1 and len(set(every.tolist())) == len(every) and seed not in every
