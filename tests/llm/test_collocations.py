import random
import re
from collections import Counter

import duckdb
import pytest
from clarispan.llm import collocations
from clarispan.llm.collocations import SQL, Frequent, op12_collocations

SF = "/root/testdata/sf0.01"


def brute(rows, least=10, first=2000):
    """All phrases counted one by one."""
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            f.update((lang, *words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    out = {}
    for (lang, *words), a in f.items():
        if len(words) < 2 or a < least:
            continue
        longer = [c for (g, *w), c in f.items() if len(w) == 3 and len(words) == 2 and g == lang and c >= least and words in (w[:2], w[1:])]
        if any(100 * c >= 50 * a for c in longer):
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = f[(lang, *words[:k])], f[(lang, *words[k:])]
            cuts.append((10**6 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:first], 1))


def got(frame):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in frame.collect())


def test_equals_counting_every_phrase(spark):
    pick = random.Random(2)
    words = [f"w{i}" for i in range(14)] + ["ñandú", "Éa", "日本", "é", "a b", "New", "new", "x\xff", "-", "the"]
    rows = []
    for i in range(500):
        text = "".join(pick.choice(words[:7] if pick.random() < 0.6 else words) + pick.choice([" ", " ", "  ", "\t", " ", " ", ". ", ",", "\r\n", "\x0b"]) for _ in range(pick.randrange(40)))
        rows.append((pick.choice(["en", "de", None, "und", "en", "en"]), text))
    rows += [("fr", "many words go here one two three " * 30), ("fr", "go " * 40), ("xx", None), ("xx", "one two"), (None, None), ("en", ""), ("it", "a b c " * 9 + "a b c d " * 8 + ("z" * 50_000 + " q ") * 12)]
    frame = spark.createDataFrame([(i, *r, 1, "p", 2) for i, r in enumerate(rows)], "doc_id long, lang string, text string, n long, phrase string, rank int").repartition(5)
    assert got(collocations.collocations(frame)) == brute(rows)
    assert got(collocations.collocations(frame, least_count=4, first=7)) == brute(rows, 4, 7)
    assert collocations.collocations(frame.limit(0)).count() == 0


def test_whole_table_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    rows = con.execute(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({SQL})").fetchall()
    assert got(op12_collocations(spark, SF)) == sorted(rows) and len(rows) > 1000


@pytest.mark.parametrize("most", [1 << 15, 1 << 29])
def test_a_full_bitmap_only_costs_time(spark, monkeypatch, most):
    monkeypatch.setattr(collocations, "MOST_BITS", most)
    monkeypatch.setattr(collocations, "FLUSH", 100)
    rows = [("en", " ".join(random.Random(i).choices([f"v{n}" for n in range(4000)], k=300)) + " ever so often") for i in range(60)]
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert got(collocations.collocations(frame, least_count=3)) == brute(rows, 3)


def test_long_counts_stay_exact(spark):
    rows = spark.createDataFrame([("x", "a b", 3_000_000_019, 4_000_000_007, 3_000_000_021)], "lang string, phrase string, n long, l long, r long")
    score = rows.selectExpr("(CAST(1000000 AS DECIMAL(38,0)) * n * n) div (CAST(l AS DECIMAL(38,0)) * r) AS score").first().score
    assert score == 10**6 * 3_000_000_019**2 // (4_000_000_007 * 3_000_000_021)


def test_bitmap_parts_join():
    part = bytearray(4096)
    part[1] = 0b100
    f = Frequent(1 << 16, {1: bytes(part)})
    import numpy as np

    assert f.has(np.array([32768 + 10, 10, 65536 + 32768 + 10], np.uint64)).tolist() == [True, False, True]
