"""Byte-level BPE encoding and decoding by batched numpy merge rounds (operator 4).

The distinct words of a batch lie in one flat array of symbols. Each round looks up the rank of every
adjacent pair of symbols by binary search over the sorted pair keys, takes each word's lowest rank
and merges all its occurrences, leftmost first, in all words at once; words without a mergeable pair
leave the array. Ids of pieces of text that were met before come from a bounded table of the task's
process.

Defined cases: a null or empty text has no ids; the special token's string in a text is its id;
repeated rows give repeated results; null doc_ids are kept; an empty table gives an empty result;
extra columns are ignored. A single word without white space costs one round per distinct rank in it.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clarispan.llm.common import resident, small_batches, table, texts_by_slice

VOCABULARY = "byte_bpe_50k.json"
KNOWN_PIECES = 200_000
#: White space as Unicode has it; a piece is a run of it and what follows up to the next.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECE = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
NEVER = np.iinfo(np.int64).max


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class ByteBPE:
    """A byte-level BPE vocabulary file, encoded with and decoded by numpy."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocab, merges = data["model"]["vocab"], data["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        letters = byte_letters()
        self.base = len(vocab) + len(self.special)
        self.byte_id = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.merged = keys[order], order.astype(np.int64), merged[order]
        back = {c: b for b, c in letters.items()}
        self.bytes_of = [b""] * self.base
        for token, i in [*vocab.items(), *self.special.items()]:
            self.bytes_of[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.known: dict[str, bytes] = {}

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        sym, word = self.byte_id[np.frombuffer(b"".join(words), np.uint8)], np.repeat(np.arange(len(words)), length)
        done_sym, done_word = [], []
        while len(sym):
            key = sym[:-1] * self.base + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.ranks[at], NEVER)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            size = np.diff(np.append(first, len(word)))
            best = np.repeat(np.minimum.reduceat(np.append(rank, NEVER), first), size)
            take = (rank == best[:-1]) & (rank != NEVER)
            if take[1:].any() and (take[1:] & take[:-1]).any():  # of a run of equal symbols, every second pair
                p = np.flatnonzero(take)
                new = np.concatenate([[True], np.diff(p) > 1])
                run = np.maximum.accumulate(np.where(new, np.arange(len(p)), 0))
                take[p[(np.arange(len(p)) - run) % 2 == 1]] = False
            p = np.flatnonzero(take)
            sym[p] = self.merged[at[p]]
            stay = np.ones(len(sym), bool)
            stay[p + 1] = False
            over = best == NEVER
            done_sym.append(sym[over])
            done_word.append(word[over])
            stay &= ~over
            sym, word = sym[stay], word[stay]
        if not done_sym:
            return [np.empty(0, np.uint32) for _ in words]
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return np.split(sym[order].astype("<u4"), np.searchsorted(word[order], np.arange(1, len(words))))

    def learn(self, pieces: set[str]) -> None:
        """Puts the ids of new pieces into the table."""
        words: dict[bytes, int] = {}
        split = [(p, [words.setdefault(w.encode(), len(words)) for w in WORD.findall(p)]) for p in pieces]
        ids = [x.tobytes() for x in self.merge([*words])]
        for p, at in split:
            self.known[p] = b"".join([ids[i] for i in at])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.known) > KNOWN_PIECES:
            self.known.clear()
        parts = []
        for t in texts:
            segments = self.split.split(t) if self.split and any(s in t for s in self.special) else [t]
            parts.append([(self.special[s],) if s in self.special else PIECE.findall(s) for s in segments if s])
        new = {p for row in parts for seg in row if isinstance(seg, list) for p in seg if p not in self.known}
        if new:
            self.learn(new)
        known = self.known
        return [b"".join([x for seg in row for x in (map(known.__getitem__, seg) if isinstance(seg, list) else (seg[0].to_bytes(4, "little"),))]) for row in parts]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", errors="replace")


def vocabulary(path: str) -> ByteBPE:
    """One for each process and file."""
    return resident(("bpe", path), lambda: ByteBPE(path))


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Rows (doc_id, ids, decoded): ids as little-endian unsigned 32-bit integers."""
    path = path or public_tokenizers.path(VOCABULARY)
    small_batches(docs.sparkSession)

    def run(batches):
        bpe = vocabulary(path)
        for b in batches:
            for part, texts in texts_by_slice(b, 1):
                ids = bpe.encode(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    path = path or public_tokenizers.path(VOCABULARY)
    small_batches(docs.sparkSession)

    def run(batches):
        bpe, sha = vocabulary(path), lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            for part, texts in texts_by_slice(b, 1):
                ids = bpe.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(sha, ids), pa.string()), pa.array([sha(bpe.decode(x).encode()) for x in ids], pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
