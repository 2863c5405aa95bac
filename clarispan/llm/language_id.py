"""Language identification by segmentation-marginalised unigrams (operator 7).

Each language has a probability for every piece of the fixed public vocabulary. A pre-token's
likelihood in a language is the sum over all its segmentations into pieces, by the forward algorithm;
a text's is the product over its pre-tokens, and the score is the best language's posterior with
equal priors. Distinct pre-tokens are scored together, in numpy, and once while they stay in a bounded
table of the task's process.

The probabilities come from expectation maximisation (forward and backward sums) over the word counts
of a bounded sample of the labelled rows outside the held-out fold: FIT_ROWS rows of each language, whole
texts, all their words. Each language is fitted in a task of its own. All rows are scored, over their whole
texts; a pre-token of any length is walked in strides, with the sums of its last positions at hand.

Defined cases: a text that is null or has no letter is `und` with score 0; so is every text if there
is nothing to learn from; more than MOST_LANGUAGES values of lang are an error; repeated rows give repeated results; null doc_ids are kept (and not held
out); an empty table gives an empty result; extra columns stay, but those named like a result (lang_pred,
score) are replaced by it.
"""

from __future__ import annotations

import uuid
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clarispan.llm.common import held_out, materialise, position, resident, small_batches, table, texts_by_slice, without
from clarispan.llm.pieces import pieces, pretokens

#: Bound of the sample that the probabilities of a language are fitted on.
FIT_ROWS = 1000
#: More values of lang than this are an error: each sends 256 KB of probabilities to the driver and the executors.
MOST_LANGUAGES = 512
ROUNDS = 4
KNOWN_WORDS = 300_000
UNKNOWN = 1e-7
#: Probabilities are scaled by this for each character; sums are brought back to about one every STRIDE characters.
SCALE, STRIDE = 0.05, 32
#: Words of a batch, and its cells (words x positions) while fitting.
BATCH_WORDS, CELLS = 20_000, 1 << 20
LETTER = regex.compile(r"\p{L}")
UND = "und"


class Finder:
    """Finds all pieces of a vocabulary in some words."""

    def __init__(self, table: dict[str, int]):
        self.bare = len(table)  # the number of a character without a piece of its own
        self.size = np.array([*map(len, table), 1])
        self.longest = int(self.size.max())
        self.automaton = ahocorasick.Automaton()
        for p, i in table.items():
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()

    def hits(self, words: list[str]) -> np.ndarray:
        """Rows (word, start, end, piece) of all pieces that fit somewhere, by end, then word, then start."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(length + 1) - length - 1
        text = "\n".join(words)  # no piece holds a line's end
        found = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64).reshape(-1, 2)
        end, piece = found[:, 0] + 1, found[:, 1]
        bare = np.ones(len(text), bool)
        bare[end[self.size[piece] == 1] - 1] = False
        bare[start[1:] - 1] = False
        bare = np.flatnonzero(bare)
        end, piece = np.concatenate([end, bare + 1]), np.concatenate([piece, np.full(len(bare), self.bare)])
        word = np.searchsorted(start, end - 1, "right") - 1
        end -= start[word]
        begin = end - self.size[piece]
        order = np.lexsort((begin, word, end))
        return np.stack([word, begin, end, piece], axis=1)[order].astype(np.int32)


def _runs(key: np.ndarray):
    """(from, to) of runs of equal values."""
    cuts = np.flatnonzero(np.diff(key)) + 1
    return zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]) if len(key) else ()


def _summed(word: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different words of a sorted array, and the sums of their values."""
    first = np.flatnonzero(np.concatenate([[True], np.diff(word) != 0]))
    return word[first], np.add.reduceat(values, first, axis=0)


def likelihood(words: list[str], prob: np.ndarray, finder: Finder) -> np.ndarray:
    """[word, language]: log of the sum over all segmentations into pieces of `prob` [piece, language] (scaled)."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(-length, kind="stable")
    words, length = [words[i] for i in order], length[order]
    width = max(finder.longest, 1) + 1
    sums = np.zeros((len(words), width, prob.shape[1]))  # of the last positions
    sums[:, 0] = 1
    logs = np.zeros((len(words), prob.shape[1]))
    for at in range(0, int(length.max(initial=0)), STRIDE):
        active = int(np.searchsorted(-length, -at, "left"))  # longer than at
        low = max(0, at - width + 2)
        w, s, e, p = finder.hits([x[low : at + STRIDE] for x in words[:active]]).T
        new = e + low > at
        w, s, e, p = w[new], s[new] + low, e[new] + low, p[new]
        for a, b in _runs(e):
            to, total = _summed(w[a:b], sums[w[a:b], s[a:b] % width] * prob[p[a:b]])
            sums[to, e[a] % width] = total
        ended = np.arange(int(np.searchsorted(-length, -(at + STRIDE), "left")), active)
        logs[ended] += np.log(np.maximum(sums[ended, length[ended] % width], 1e-300))
        going = slice(0, int(ended[0]) if len(ended) else active)
        top = np.maximum(sums[going].max(axis=1), 1e-300)
        sums[going] /= top[:, None]
        logs[going] += np.log(top)
    out = np.empty_like(logs)
    out[order] = logs + length[:, None] * np.log(SCALE)
    return out


def scaled(prob: np.ndarray, table: dict[str, int]) -> np.ndarray:
    """Adds the row for characters without a piece and applies SCALE."""
    length = np.array([*map(len, table), 1])
    return np.vstack([prob, np.full((1, prob.shape[1]), UNKNOWN)]) / SCALE ** length[:, None]


def _walk(hits: np.ndarray, length: np.ndarray, prob: np.ndarray, backward: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all segmentations before (after) each position of each word, and their logarithmic scales."""
    w, s, e, p = hits.T
    key, other = (s, e) if backward else (e, s)
    if backward:
        order = np.lexsort((w, -s))
        w, key, other, p = w[order], key[order], other[order], p[order]
    top = int(length.max(initial=0))
    out, scale, now = np.zeros((len(length), top + 1)), np.zeros((len(length), top + 1)), np.zeros(len(length))
    out[np.arange(len(length)), length if backward else 0] = 1
    since = 0
    for a, b in _runs(key):
        to, at = w[a:b], other[a:b]
        found, total = _summed(to, out[to, at] * np.exp(scale[to, at] - now[to]) * prob[p[a:b]])
        out[found, key[a]], scale[found, key[a]] = total, now[found]
        since += 1
        if since == STRIDE:
            since = 0
            now[found] += np.log(np.maximum(total, 1e-300))
    return out, scale


def fit_language(counts: dict[str, int], table: dict[str, int], rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities of one language from its word counts."""
    finder, words = Finder(table), sorted(counts, key=len)
    batches, at = [], 0
    while at < len(words):
        to = at + 1
        while to < len(words) and to - at < BATCH_WORDS and (to - at + 1) * (len(words[to]) + 1) <= CELLS:
            to += 1
        part = words[at:to]
        batches.append((finder.hits(part), np.fromiter(map(len, part), np.int64, len(part)), np.array([counts[x] for x in part], float)))
        at = to
    prob = np.full(len(table), 1 / len(table))
    for _ in range(rounds):
        full, expected = scaled(prob[:, None], table)[:, 0], np.full(len(table) + 1, 0.01)
        for hits, length, n in batches:
            w, s, e, p = hits.T
            ahead, ahead_scale = _walk(hits, length, full, False)
            behind, behind_scale = _walk(hits, length, full, True)
            every = np.arange(len(length))
            whole = np.log(np.maximum(ahead[every, length], 1e-300)) + ahead_scale[every, length]
            use = n[w] * ahead[w, s] * full[p] * behind[w, e] * np.exp(ahead_scale[w, s] + behind_scale[w, e] - whole[w])
            expected += np.bincount(p, use, len(table) + 1)
        prob = expected[:-1] / expected[:-1].sum()
    return prob


def sample(docs: DataFrame) -> DataFrame:
    """Rows (lang, text): of each language at most FIT_ROWS different labelled texts outside the held-out fold, those of
    the lowest hashes; the same for any order of the rows. Languages are few: what is known of each is a share."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out()).select("lang", "text", F.xxhash64("text").alias("h"))
    share = rows.groupBy("lang").agg(F.least(F.lit(1.0), 2.0 * FIT_ROWS / F.approx_count_distinct("h")).alias("share"))
    drawn = rows.join(F.broadcast(share), "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("share") * float(1 << 30)).drop("share")
    drawn = drawn.groupBy("lang", "h").agg(F.first("text").alias("text"))
    low = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h"))
    return drawn.withColumn("n", low).where(F.col("n") <= FIT_ROWS).select("lang", "text")


def fit(docs: DataFrame, path: str | None = None) -> tuple[list[str], np.ndarray]:
    """Languages and their piece probabilities [piece, language]."""
    word = F.explode(F.split(F.trim(F.lower("text")), r"\s+")).alias("word")
    counts = sample(docs).select("lang", word).where("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("n"))

    def of_language(t: pa.Table) -> pa.Table:
        resident("language-fit", dict)
        seen: dict[str, int] = {}
        for text, n in zip(t["word"].to_pylist(), t["n"].to_pylist()):
            for w in pretokens(text):
                seen[w] = seen.get(w, 0) + n
        return pa.table({"lang": [t["lang"][0].as_py()], "prob": pa.array([fit_language(dict(sorted(seen.items())), pieces(path))], pa.list_(pa.float64()))})

    # A row for each language: as many probabilities as the vocabulary has pieces. They reach the driver once they are counted.
    found = materialise(counts.groupBy("lang").applyInArrow(of_language, "lang string, prob array<double>"), "language-model")
    if found.count() > MOST_LANGUAGES:
        raise ValueError(f"lang has more than {MOST_LANGUAGES} values: it holds something else than languages")
    found = sorted(found.collect())
    return [r["lang"] for r in found], np.array([r["prob"] for r in found]).T if found else np.empty((len(pieces(path)), 0))


class Scorer:
    def __init__(self, langs: list[str], prob: np.ndarray, path: str | None = None):
        table = pieces(path)
        self.finder, self.langs, self.prob = Finder(table), langs, scaled(prob, table)
        self.known: dict[str, int] = {}
        self.likelihood = np.empty((0, len(langs)))

    def score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
            self.likelihood = self.likelihood[:0]
        known, rows = self.known, []
        for t in texts:
            rows.append(pretokens(t.lower()) if t and self.langs and LETTER.search(t) else None)
        new = [*{w: None for row in rows if row for w in row if w not in known}]
        found = [self.likelihood]
        for at in range(0, len(new), BATCH_WORDS):
            part = new[at : at + BATCH_WORDS]
            known.update(zip(part, range(len(known), len(known) + len(part))))
            found.append(likelihood(part, self.prob, self.finder))
        self.likelihood = np.concatenate(found)
        out = []
        for row in rows:
            if row is None:
                out.append((UND, 0.0))
                continue
            total = self.likelihood[np.fromiter(map(known.__getitem__, row), np.int64, len(row))].sum(axis=0)
            odds = np.exp(total - total.max())
            best = int(odds.argmax())
            out.append((self.langs[best], float(odds[best] / odds.sum())))
        return out


def _scored(docs: DataFrame, model: tuple[list[str], np.ndarray], path: str | None, emit, schema) -> DataFrame:
    """What emit(rows, predictions) makes of runs of rows; the model is a broadcast table of pieces x languages."""
    small_batches(docs.sparkSession)
    langs, prob = model
    sent = docs.sparkSession.sparkContext.broadcast((langs, prob.astype(np.float32)))
    name = uuid.uuid4().hex  # a process keeps the scorer of one model between its tasks
    at = position(docs, "text")

    def run(batches):
        scorer = resident(("language", name), lambda: Scorer(sent.value[0], sent.value[1].astype(float), path))
        for b in batches:
            for part, texts in texts_by_slice(b, at):  # a null text is an empty one there, `und` both
                yield emit(part, scorer.score(texts))

    return docs.mapInArrow(run, schema)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], path: str | None = None) -> DataFrame:
    """Adds lang_pred and score to documents."""
    docs = without(docs, ["lang_pred", "score"])

    def emit(part, found):
        langs, scores = zip(*found)
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*part.schema.names, "lang_pred", "score"])

    return _scored(docs, model, path, emit, docs.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema)


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Documents whose language is found, with their columns: `und` and scores below `least` go. A row goes to
    Python once, and comes back only if it is kept."""
    def emit(part, found):
        return part.filter(pa.array([lang != UND and score >= least for lang, score in found]))

    return _scored(docs, fit(docs), None, emit, docs.schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return predict(rows, fit(docs)).select("doc_id", "held_out", "lang_pred", "score")
