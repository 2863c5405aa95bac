"""Queries over the small tables against SQL or brute force; the pipeline's stages."""

import os
import struct
import zlib
from hashlib import sha256

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from clarispan.llm import queries
from clarispan.llm.common import components

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    if not os.path.isdir(DIR):
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(tables):
    return {i: t or "" for i, t in tables.sql("SELECT doc_id, text FROM documents").fetchall()}


def rows(spark, name):
    return queries.QUERIES[name](spark, DIR).collect()


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_exact_topk_matches_sql(spark, tables):
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(spark, "op1_exact_topk"))
    assert got and got == sorted(tables.sql(queries.SQL["op1_exact_topk"]).fetchall())


def reference_fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash_matches_all_pairs(spark, texts):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows(spark, "op2_simhash_neardup")}
    prints = {i: reference_fingerprint(t) for i, t in texts.items()}
    assert {i: f for i, (f, _) in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    assert {i: c for i, (_, c) in got.items()} == {i: find(i) for i in ids}


def test_bpe_equals_the_library(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in rows(spark, "op4_bpe"):
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def lowest_phrases(text):
    """The 64 smallest hashes of a text's phrases, from a plain set of strings."""
    from clarispan.llm.lz_fingerprint import FACTOR, MASK

    phrases, at_hand, found = set(), "", set()
    for c in text:
        at_hand += c
        if at_hand not in phrases:
            phrases.add(at_hand)
            h = 1
            for x in at_hand:
                h = (h ^ ord(x)) * FACTOR & MASK
                h ^= h >> 32
            found.add((h * FACTOR & MASK) >> 32)
            at_hand = ""
    return sorted(found)[:64]


def share(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    both = sorted({*a, *b})[:64]
    return sum(x in a and x in b for x in both) / len(both)


def test_fingerprints_follow_edits(spark, texts):
    ids = sorted(texts, reverse=True)
    after = dict(zip(ids, ids[1:] + ids[:1]))
    got = {r["doc_id"]: r for r in rows(spark, "op5_lz_fingerprint")}
    assert sorted(got) == sorted(ids)
    for i, r in got.items():
        text, k = texts[i], len(texts[i]) // 3
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == sha256((text[: len(text) - k] + texts[after[i]][:k]).encode()).hexdigest()
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
    prints = {t: lowest_phrases(t) for t in {*texts.values(), *(texts[i][: len(texts[i]) - len(texts[i]) // 3] + texts[after[i]][: len(texts[i]) // 3] for i in ids)}}
    for i, r in got.items():
        edited = texts[i][: len(texts[i]) - len(texts[i]) // 3] + texts[after[i]][: len(texts[i]) // 3]
        own, near, next_ = prints[texts[i]], prints[edited], prints[texts[after[i]]]
        assert r["fingerprint"] == "".join(f"{x:08x}" for x in own) and r["edited_fingerprint"] == "".join(f"{x:08x}" for x in near)
        assert r["near_edited"] == share(own, near) and r["near_next"] == share(own, next_)
    by_text = {}
    for i, r in got.items():
        assert by_text.setdefault(texts[i], r["fingerprint"]) == r["fingerprint"]
    assert np.mean([r["near_edited"] > r["near_next"] for r in got.values() if r["n_chars"] > 200]) > 0.95


def test_quality_on_held_out_rows(spark, tables):
    got = {r["doc_id"]: r for r in rows(spark, "op6_quality")}
    labels = [(i, q) for i, q in tables.sql("SELECT doc_id, quality FROM labels").fetchall() if held(i)]
    assert all(r["held_out"] == held(i) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for i, r in got.items())
    assert np.mean([got[i]["predicted"] == q for i, q in labels]) >= 0.9


def test_language_on_held_out_rows(spark, tables):
    got = {r["doc_id"]: r for r in rows(spark, "op7_language_id")}
    langs = [(i, x) for i, x in tables.sql("SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL").fetchall() if held(i)]
    assert np.mean([got[i]["lang_pred"] == x for i, x in langs]) >= 0.95


def test_packing_covers_every_id_once(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = rows(spark, "op8_packing")
    for i, text in texts.items():
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    sequences = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == sequences.get(r["sequence_id"], 0)
        sequences[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n == 2048 or n < 2048 and n & (n - 1) == 0 for n in sequences.values()) and sum(n < 2048 for n in sequences.values()) <= 11


def test_shards_are_even_and_gapless(spark, texts):
    got = rows(spark, "op9_kd_sharding")
    assert sorted(r["doc_id"] for r in got) == sorted(texts) and {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    load, slots = {}, {}
    for r in got:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(load) <= set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) <= sum(load.values()) / 40 + max(r["size"] for r in got)


def test_token_counts_equal_the_library(spark, texts):
    from tokenizers import Tokenizer as T
    from tokenizers.models import Unigram

    from clarispan.llm.pieces import pretokens
    from clarispan.llm.token_counts import TrieCounter

    score = TrieCounter().score
    library = T(Unigram([*score.items(), ("<unk>", -100.0)], unk_id=len(score)))
    got = {r["doc_id"]: r["n_tokens"] for r in rows(spark, "op10_token_counts")}
    checked = 0
    for i, text in texts.items():
        words = pretokens(text)
        if all(c in score for w in words for c in w):
            assert got[i] == sum(len(library.encode(w).ids) for w in words)
            checked += 1
    assert checked > 100


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 299), (299, 300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 160)}, 300: 299}


def test_pipeline_stages_keep_their_contract(spark, tables):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, DIR).cache()
        assert docs.columns == columns and docs.count() <= before and docs.select("doc_id").distinct().count() == docs.count()
    out = corpus_pipeline.run(spark, DIR)
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert out.where(F.col("length") < 1).count() == 0
