"""Lexical retrieval packing (operator 8).

Documents are encoded and closed by an end id. Whole windows of a long document are sequences of their
own; what is left of each document goes to a shard of about SHARD_DOCS documents. A shard has an
inverted BM25 index over the token ids of its whole documents, with the document frequencies and the
mean length of all rows. A window starts with a seed document, which asks the index for its
best unused neighbours, as many as the window takes, and they fill it in that order; the one that does not fit is cut and
its rest seeds the next window, so windows are full. What remains at a shard's end is cut into
sequences of power-of-two lengths, which need no padding.

Documents are placed by content: three weighted MinHash values over their token ids (a term is drawn by
the square of its idf over all rows) order the table, ties by row, and ranges of that order are the
shards. Two documents meet more often the more rare terms they share, and a large group of copies is cut
at the bounds of its ranges. A seed sees its own shard and no other: neighbours placed elsewhere are missed.

Defined cases: a null or empty text is the end id alone; repeated rows are documents of their own;
null doc_ids are kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import copy
import os
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clarispan.llm.bpe import SPACE, byte_letters
from clarispan.llm.common import materialise, resident, small_batches, table, texts_by_slice

VOCABULARY = "word_bpe_49k.json"
WINDOW, END = 2048, 1
SHARD_DOCS = 2048
#: Most range partitions of a table; where there are more shards, a partition holds several, cut from its order.
MOST_PARTS = 20_000
K1, B = 1.2, 0.75
HASHES = 3
NEIGHBOURS = 32
#: An index of a shard is cut to its unused documents when they are fewer than this share of those it has.
FEWER = 0.75
KNOWN_WORDS = 600_000
_ODD = re.compile("[\x1c-\x1f]")
_SPACES = re.compile(f"[{SPACE}]+")
PLAIN_END = 0x180
#: Other characters, the one below PLAIN_END that lower case makes two, and the start of special tokens.
_OTHER = re.compile(f"[^\0-{chr(PLAIN_END - 1)}]|\u0130|<\\|")
_LETTERS, _NUMBERS = ("".join(c for c in map(chr, range(PLAIN_END)) if unicodedata.category(c)[0] == kind) for kind in "LN")
_PRETOKEN = re.compile(f"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{_NUMBERS}]|[^{SPACE}{_LETTERS}{_NUMBERS}]+")
_KIND_SPACE, _KIND_LETTER, _KIND_NUMBER, _KIND_OTHER = range(4)
_KIND = np.array([_KIND_SPACE if _SPACES.match(c) else _KIND_LETTER if c in _LETTERS else _KIND_NUMBER if c in _NUMBERS else _KIND_OTHER for c in map(chr, range(PLAIN_END))], np.uint8)
#: The one of _OTHER that lower case makes two stands for itself; no text with it is lowered by this table.
_LOWER = np.array([ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in map(chr, range(PLAIN_END))], "<u2")
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Pieces that are whole windows have no row; else ids are the document's last ones, and counts the whole document's (term, tf, ...) where it has more.
ENCODED = PIECE + ", row long, ids binary, counts binary"


class WordEncoder:
    """Encodes by the tokenizers library, once for each distinct part of a text. For characters below
    PLAIN_END lower case, composed forms and character classes are the same everywhere, so texts of them
    are lowered and cut into the vocabulary's pre-tokens here, all at once, and the library only merges: many
    pre-tokens in one call, told apart by the word end that closes each. Runs between white space with
    other characters or a special token go through the whole library; no token crosses white space.

    A part is known by its UTF-16 bytes. Of the two tables of known parts the older one goes when the
    newer one is full; what is met in the older one moves to the newer."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.merger = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for t in (self.tokenizer, self.merger):
            t.no_truncation()
            t.no_padding()
        self.merger.normalizer = None
        self.merger.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.letters = {b: c for b, c in byte_letters().items() if chr(b) != "\n"}
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.closes[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def runs(self, text: str) -> list[str]:
        """Pre-tokens in lower case, and runs between white space that the whole library must encode."""
        out: list[str] = []
        for w in _SPACES.split(text) if _ODD.search(text) else text.split():
            if _OTHER.search(w):
                out.append(w)
            else:
                out += _PRETOKEN.findall(w.lower())
        return out

    def parts(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The parts of all texts in order, and how many each text has."""
        joined = "\n".join(texts)
        if _plain(joined):
            return pretokens(texts, joined)
        plain = np.fromiter(map(_plain, texts), bool, len(texts))
        words, n = [], np.zeros(len(texts), np.int64)
        edges = [0, *(np.flatnonzero(plain[1:] != plain[:-1]) + 1).tolist(), len(texts)]
        for a, z in zip(edges, edges[1:]):
            if plain[a]:
                w, n[a:z] = pretokens(texts[a:z], "\n".join(texts[a:z]))
            else:
                rows = [self.runs(t) for t in texts[a:z]]
                w, n[a:z] = pa.array([w.encode("utf-16-le") for row in rows for w in row], pa.large_binary()), list(map(len, rows))
            words.append(w)
        return pa.concat_arrays(words), n

    def learn(self, new: list[bytes]) -> None:
        """Puts the ids of new parts into the table."""
        words = [w.decode("utf-16-le") for w in new]
        other = [i for i, w in enumerate(words) if _OTHER.search(w)] if _OTHER.search(" ".join(words)) else []
        odd = set(other)
        plain = [i for i in range(len(words)) if i not in odd] if odd else range(len(words))
        if plain:
            lines = ["\n".join([words[i] for i in plain[at : at + 1000]]) for at in range(0, len(plain), 1000)]
            lines = [x if x.isascii() and x.replace("\n", "").isprintable() else x.encode().decode("latin-1").translate(self.letters) for x in lines]
            ids = np.array([i for e in self.merger.encode_batch_fast(lines, add_special_tokens=False) for i in e.ids], "<u4")
            ends, raw = (4 * (np.flatnonzero(self.closes[ids]) + 1)).tolist(), ids.tobytes()
            self.known.update((new[i], raw[a:z]) for i, a, z in zip(plain, [0, *ends[:-1]], ends, strict=True))
        if other:
            found = self.tokenizer.encode_batch_fast([words[i] for i in other], add_special_tokens=False)
            self.known.update((new[i], np.array(e.ids, "<u4").tobytes()) for i, e in zip(other, found))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, without an end id."""
        if len(self.known) > KNOWN_WORDS // 2:
            self.known, self.older = {}, self.known
        parts, n = self.parts(texts)
        parts = parts.dictionary_encode()
        words, known, older = parts.dictionary.to_numpy(zero_copy_only=False).tolist(), self.known, self.older
        new = [w for w in words if w not in known]
        known.update((w, older[w]) for w in new if w in older)
        new = [w for w in new if w not in older] if older else new
        for at in range(0, len(new), 50_000):
            self.learn(new[at : at + 50_000])
        found = [known[w] for w in words]
        size = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        start, table, word = np.cumsum(size) - size, np.frombuffer(b"".join(found), "<u4"), parts.indices.to_numpy()
        size = size[word]
        end = np.cumsum(size)
        ids = table[np.repeat(start[word] - end + size, size) + np.arange(size.sum())]
        return np.split(ids, np.append(0, end)[np.cumsum(n)[:-1]]) if texts else []


def _plain(text: str) -> bool:
    """Whether _OTHER finds nothing."""
    if "<|" in text or "\u0130" in text:
        return False
    return text.isascii() or bool(np.frombuffer(text.encode("utf-16-le"), "<u2").max() < PLAIN_END)


def pretokens(texts: list[str], joined: str) -> tuple[pa.Array, np.ndarray]:
    """The pre-tokens of texts of plain characters as UTF-16 bytes, in lower case, and how many each text has; the texts
    are also given joined by line feeds."""
    chars = np.frombuffer(joined.encode("ascii"), np.uint8) if joined.isascii() else np.frombuffer(joined.encode("utf-16-le"), "<u2")
    chars = _LOWER[chars]
    kind = _KIND[chars]
    begins = kind != _KIND_SPACE
    begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _KIND_NUMBER)
    quote = np.flatnonzero(begins[:-1] & (chars[:-1] == ord("'")))
    if len(quote):  # 's, 't, 'm, 'd, 're, 've and 'll, where the quote begins its run and is all of it
        one, two = chars[quote + 1], chars[np.minimum(quote + 2, len(chars) - 1)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = (quote + 2 < len(chars)) & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        begins[quote[short | long] + 1] = False
        after = np.concatenate([quote[short] + 2, quote[long] + 3])
        after = after[after < len(chars)]
        begins[after] = kind[after] != _KIND_SPACE
    stays = kind != _KIND_SPACE
    data, first = chars[stays], np.append(np.flatnonzero(begins[stays]), stays.sum())
    words = pa.Array.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer(2 * first), pa.py_buffer(data)])
    edges = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return words, np.diff(np.searchsorted(np.flatnonzero(begins), edges), prepend=0)


class Corpus:
    """Document frequencies by token id, rows and mean length of all documents."""

    def __init__(self, n: int, tokens: int, df: np.ndarray):
        self.n, self.mean, self.df = n, max(tokens / max(n, 1), 1.0), df
        self.idf = np.log((n - df + 0.5) / (df + 0.5))

    def orders(self) -> np.ndarray:
        """By hash and token id, the rank of the term's draw; the last rank if it can link no documents."""
        useful = (self.idf > 0) & (self.df > 1)
        draws = -np.log1p(-np.random.default_rng(8).random((HASHES, len(self.df))))
        draws = np.where(useful, draws / np.where(useful, self.idf, 1.0) ** 2, np.inf)
        ranks = np.empty((HASHES, len(self.df)), np.int64)
        for r, d in zip(ranks, draws):
            r[np.argsort(d, kind="stable")] = np.arange(len(d))
        return np.where(useful, ranks, len(self.df))


def bags(ids: list[np.ndarray], counts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (document, term) as document << 32 | term, and tf: of the counts (term, tf, ...) where a
    document has them, else of its ids."""
    long = [d for d, c in enumerate(counts) if c is not None]
    size = np.fromiter((0 if c is not None else len(x) for x, c in zip(ids, counts)), np.int64, len(ids))
    short = [x for x, c in zip(ids, counts) if c is None]
    key, tf = np.unique((np.repeat(np.arange(len(ids)), size) << 32) | np.concatenate([*short, np.empty(0, np.uint32)]).astype(np.int64), return_counts=True)
    if long:
        own = [np.frombuffer(counts[d], "<u4").astype(np.int64).reshape(-1, 2) for d in long]
        key = np.concatenate([key, *((d << 32) | x[:, 0] for d, x in zip(long, own))])
        tf = np.concatenate([tf, *(x[:, 1] for x in own)])
        order = np.argsort(key, kind="stable")
        key, tf = key[order], tf[order]
    return key >> 32, key & 0xFFFFFFFF, tf


class ShardIndex:
    """An inverted BM25 index over the token ids of a shard's documents, with the corpus's statistics."""

    def __init__(self, ids: list[np.ndarray], counts: list[bytes | None], size: np.ndarray, corpus: Corpus):
        self.n = len(ids)
        doc, term, tf = bags(ids, counts)
        has = (corpus.idf > 0) & (np.bincount(term, minlength=len(corpus.idf)) > 1)  # the other terms add nothing to any neighbour
        useful = has[term]
        doc, term, tf = doc[useful], term[useful], tf[useful]
        idf, terms = corpus.idf[term], np.count_nonzero(has)
        term = (np.cumsum(has) - 1)[term]
        weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / corpus.mean))
        self.terms, self.edge = term, np.searchsorted(doc, np.arange(self.n + 1))  # by document
        order = np.argsort(term.astype(np.uint16) if terms < 1 << 16 else term, kind="stable")
        self._hold(doc[order], weight[order], np.append(0, np.cumsum(np.bincount(term, minlength=terms))))

    def _hold(self, doc: np.ndarray, weight: np.ndarray, start: np.ndarray) -> None:
        """Postings by term, and each term's own."""
        self.doc, self.weight, self.start = doc, weight, start
        edges = list(zip(start[:-1].tolist(), start[1:].tolist()))
        self.docs_of, self.weights_of = [doc[a:z] for a, z in edges], [weight[a:z] for a, z in edges]

    def without_used(self, unused: np.ndarray) -> ShardIndex:
        """The index with no postings of used documents, which may still be seeds."""
        index, stays = copy.copy(self), unused[self.doc]
        index._hold(self.doc[stays], self.weight[stays], np.append(0, np.cumsum(stays))[self.start])
        return index

    def neighbours(self, seed: int, unused: np.ndarray, length: np.ndarray | None = None, room: int = 0) -> np.ndarray:
        """Unused documents with a positive score, best first: the best NEIGHBOURS, and as many more as fill the room."""
        t = self.terms[self.edge[seed] : self.edge[seed + 1]].tolist()
        if not t:
            return np.empty(0, np.int64)
        score = np.bincount(np.concatenate([self.docs_of[i] for i in t]), np.concatenate([self.weights_of[i] for i in t]), self.n)
        score[~unused] = 0.0
        some, k = np.flatnonzero(score > 0), NEIGHBOURS
        while True:
            best = some if k >= len(some) else some[score[some] >= np.partition(score[some], len(some) - k)[len(some) - k]]
            best = best[np.lexsort((best, -score[best]))][:k]
            if len(best) == len(some) or length is None or length[best].sum() >= room:
                return best
            k *= 4


def pack(docs: list[np.ndarray], index: ShardIndex, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, from, to) of the documents' last ids; all are full but the last ones, which have
    power-of-two lengths."""
    unused, length = np.ones(len(docs), bool), np.array([len(d) for d in docs], np.int64)
    sequences, now, free, at, held = [], [], window, 0, len(docs)

    def add(d: int, a: int) -> None:
        nonlocal now, free
        while a < len(docs[d]):
            take = min(free, len(docs[d]) - a)
            now.append((d, a, a + take))
            a, free = a + take, free - take
            if not free:
                sequences.append(now)
                now, free = [], window

    while True:
        if now:
            seed = now[-1][0] if len(now) == 1 else None  # the rest of a cut document seeds its window
        else:
            seed = None
        if seed is None:
            while at < len(docs) and not unused[at]:
                at += 1
            if at == len(docs):
                break
            seed = at
            unused[seed] = False
            add(seed, 0)
        filled = len(sequences)
        left = np.count_nonzero(unused)
        if left < FEWER * held:
            index, held = index.without_used(unused), left
        for d in index.neighbours(seed, unused, length, free).tolist():
            if len(sequences) > filled:
                break
            unused[d] = False
            add(d, 0)
        if len(sequences) == filled and len(now) == 1:  # no neighbour: go on with any unused document
            while at < len(docs) and not unused[at]:
                at += 1
            if at == len(docs):
                break
            unused[at] = False
            add(at, 0)
    rest = window - free
    while rest:
        part, size = [], 1 << (rest.bit_length() - 1)
        rest -= size
        while size:
            d, a, b = now.pop(0)
            if b - a > size:
                now.insert(0, (d, a + size, b))
                b = a + size
            part.append((d, a, b))
            size -= b - a
        sequences.append(part)
    return sequences


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def statistics(docs: DataFrame) -> Corpus:
    """Of encoded documents (ids, counts, doc_tokens). A term is one of a vocabulary, so the sums are small."""
    def run(batches):
        n = tokens = 0
        df = np.zeros(0, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, SHARD_DOCS):
                part = b.slice(at, SHARD_DOCS)
                _, term, _ = bags([np.frombuffer(x, "<u4") for x in part.column(0).to_pylist()], part.column(1).to_pylist())
                found = np.bincount(term, minlength=len(df))
                found[: len(df)] += df
                df, n, tokens = found, n + part.num_rows, tokens + int(part.column(2).to_numpy().sum())
        has = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(has, [-1, -2])), pa.array(np.append(df[has], [n, tokens]))], ["term", "n"])

    sums = {r["term"]: r["n"] for r in docs.select("ids", "counts", "doc_tokens").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n, tokens = sums.pop(-1, 0), sums.pop(-2, 0)
    df = np.zeros(max(sums, default=0) + 1, np.int64)
    df[list(sums)] = list(sums.values())
    return Corpus(n, tokens, df)


def placed(docs: DataFrame, corpus: Corpus) -> DataFrame:
    """Encoded documents with their place in the order of contents."""
    orders = corpus.orders()

    def run(batches):
        for b in batches:
            ids, counts = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("ids", "counts"))
            terms = [np.frombuffer(x, "<u4") if c is None else np.frombuffer(c, "<u4")[::2] for x, c in zip(ids, counts)]
            size = np.fromiter(map(len, terms), np.int64, len(terms))
            place = np.zeros(len(terms), np.int64)
            if size.sum():
                every = np.concatenate(terms)
                for order in orders:
                    low = np.full(len(terms), len(order), np.int64)
                    low[size > 0] = np.minimum.reduceat(order[every], (np.cumsum(size) - size)[size > 0])
                    place = (place << 21) | low
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place)], [*b.schema.names, "place"])

    return docs.mapInArrow(run, f"{ENCODED}, place long")


def pack_documents(docs: DataFrame, path: str | None = None, window: int = WINDOW, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """The columns of PIECE for every piece of every document."""
    path = path or public_tokenizers.path(VOCABULARY)
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    names = [x.split()[0] for x in ENCODED.split(", ")]
    types = [pa.int64()] * 8 + [pa.binary()] * 2

    def tokens(batches):
        encoder = resident(("words", path), lambda: WordEncoder(path))
        own = row = TaskContext.get().partitionId() << 33
        for b in batches:
            for part, texts in texts_by_slice(b, 1):
                out: list[tuple] = []
                for i, ids in enumerate(encoder.encode(texts)):
                    ids = np.append(ids, np.uint32(END)).astype("<u4")
                    doc, n = part.column(0)[i].as_py(), len(ids)
                    for a in range(0, n - window + 1, window):
                        out.append((doc, a, window, _crc(ids[a : a + window]), n, own << 1, 0, None, None, None))
                        own += 1
                    counts = np.stack(np.unique(ids, return_counts=True), axis=1).astype("<u4").tobytes() if n >= window else None
                    out.append((doc, n - n % window, n % window, 0, n, -1, 0, row, ids[n - n % window :].tobytes(), counts))
                    row += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    def shards(batches):
        """Tables of about shard_docs rows each, none of them a small rest but a partition's only one."""
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            while sum(x.num_rows for x in held) > 2 * shard_docs:
                t = pa.Table.from_batches(held)
                yield t.slice(0, shard_docs)
                held = t.slice(shard_docs).to_batches()
        n = sum(x.num_rows for x in held)
        if n:
            t, k = pa.Table.from_batches(held), 1 + (2 * n > 3 * shard_docs)
            for j in range(k):
                yield t.slice(n * j // k, n * (j + 1) // k - n * j // k)

    def windows(batches):
        resident("windows", dict)
        own = TaskContext.get().partitionId() << 33
        for t in shards(batches):
            base, n = t["start"].to_numpy(), t["doc_tokens"].to_numpy()
            doc, ids = t["doc_id"].to_pylist(), [np.frombuffer(x, "<u4") for x in t["ids"].to_pylist()]
            out: list[tuple] = []
            for pieces in pack(ids, ShardIndex(ids, t["counts"].to_pylist(), n, corpus), window):
                at = 0
                for d, x, y in pieces:
                    out.append((doc[d], int(base[d]) + x, y - x, _crc(ids[d][x:y]), int(n[d]), (own << 1) | 1, at))
                    at += y - x
                own += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names[:7])

    made = materialise(rows.mapInArrow(tokens, ENCODED), "packing")
    encoded = made.where("row is not null")
    corpus = statistics(encoded)
    parts = placed(encoded.where("length > 0"), corpus).repartitionByRange(min(MOST_PARTS, max(1, -(-corpus.n // shard_docs))), "place", "row")
    whole = made.where("row is null").select(names[:7])
    return whole.unionAll(parts.sortWithinPartitions("place", "row").mapInArrow(windows, PIECE))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
