"""Quality classifier: a generalised additive model with pairwise interactions (operator 6).

Features of a text (shares of character classes, repetition, lengths) are cut into quantile bins.
Cyclic boosting visits one feature after another and adds a shallow tree over its bins to that
feature's lookup table; then the pairs of features with the most signal left are boosted in the same
way into two-dimensional tables. A score is the logistic of the intercept and the tables' values at a
row's bins, which numpy adds up for a batch of rows at once.

The model is fitted on a bounded sample of the labelled rows outside the held-out fold (FIT_ROWS);
all rows are scored, over their whole texts.

Defined cases: a null text scores like an empty one; labels that are null or of unknown documents are
not learnt from; without labels every score is 1; repeated rows give repeated results; null doc_ids
are kept (and not held out); an empty table gives an empty result; extra columns stay, but those named
like a result (score, predicted) are replaced by it.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clarispan.llm.common import held_out, position, resident, small_batches, table, texts_by_slice, without

#: Bound of the sample of labelled rows that the model is fitted on.
FIT_ROWS = 20_000
LEAST = 0.7
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAVES, SHRINK = 120, 60, 0.15, 4, 5.0

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t\r", "line": b"\n", "stop": b".,;:?'\"()-",
    "bang": b"!", "bar": b"|", "symbol": b"#$%&*@^~<>{}[]\\/=+_`", "wide": bytes(range(128, 256)),
}
_OF_BYTE = np.array([[b in chars for chars in _CLASSES.values()] for b in range(256)], float)
FEATURES = [*_CLASSES, "chars", "word_length", "distinct", "repeat", "caps", "line_repeat", "line_length"]


def features(text: str) -> list[float]:
    raw = text.encode("utf-8", "replace")
    n = len(raw)
    shares = (np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _OF_BYTE / max(n, 1)).tolist()
    words, lines = text.split(), [x for x in text.split("\n") if x]
    w, k = max(len(words), 1), max(len(lines), 1)
    return [
        *shares, float(np.log1p(len(text))), len(text) / w, len(set(words)) / w, sum(map(eq, words, words[1:])) / w,
        sum(map(str.isupper, words)) / w, 1 - len(set(lines)) / k, float(np.log1p(len(text) / k))]


@dataclass
class Additive:
    """Bin edges and lookup tables: of each feature, and of pairs of features."""

    edges: list[np.ndarray]
    intercept: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for f, (e, t) in enumerate(zip(self.edges, self.tables)):
            out += t[np.searchsorted(e, x[:, f], "right")]
        for (a, b), t in zip(self.pairs, self.pair_tables):
            out += t[np.searchsorted(self.pair_edges[a], x[:, a], "right"), np.searchsorted(self.pair_edges[b], x[:, b], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]


def _gain(g, h):
    return g * g / (h + SHRINK)


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Values over ordered bins of the tree with at most `leaves` leaves, split greedily."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = None
        for a, b in parts:
            if b - a < 2:
                continue
            left_g, left_h = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            all_g, all_h = g[a:b].sum(), h[a:b].sum()
            gains = _gain(left_g, left_h) + _gain(all_g - left_g, all_h - left_h) - _gain(all_g, all_h)
            at = int(gains.argmax())
            if gains[at] > 1e-9 and (best is None or gains[at] > best[0]):
                best = (gains[at], (a, b), a + at + 1)
        if best is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + SHRINK)
    return out


def crossed_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Values over a grid of the best cut of one axis with a cut of the other on each side; its gain."""
    best, out = -1.0, np.zeros(g.shape)
    for turn in (False, True):
        gg, hh = (g.T, h.T) if turn else (g, h)
        for cut in range(1, len(gg)):
            value, gain = np.zeros(gg.shape), 0.0
            for side in (slice(0, cut), slice(cut, None)):
                cg, ch = gg[side].sum(axis=0), hh[side].sum(axis=0)
                tree = shallow_tree(cg, ch, 2)
                value[side] = tree
                gain += float((tree * cg - 0.5 * tree * tree * ch).sum())
            if gain > best:
                best, out = gain, value.T if turn else value
    return out, best


def fit_additive(x: np.ndarray, y: np.ndarray) -> Additive:
    model = Additive(_edges(x, BINS) if len(x) else [np.empty(0)] * len(FEATURES))
    ones = float(y.sum())
    model.intercept = float(np.log((ones + 1) / (len(y) - ones + 1e-3)))
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if not len(y):
        warnings.warn("no labelled rows to learn from: every document is taken as good", stacklevel=2)
        model.intercept = 50.0
        return model
    bins = [np.searchsorted(e, c, "right") for e, c in zip(model.edges, x.T)]
    raw = np.full(len(y), model.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-raw))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for b, t in zip(bins, model.tables):
            g, h = slopes()
            step = RATE * shallow_tree(np.bincount(b, g, len(t)), np.bincount(b, h, len(t)))
            t += step
            raw += step[b]
    model.pair_edges = _edges(x, PAIR_BINS)
    coarse = [np.searchsorted(e, c, "right") for e, c in zip(model.pair_edges, x.T)]
    size = [len(e) + 1 for e in model.pair_edges]

    def grid(a: int, b: int):
        g, h = slopes()
        at = coarse[a] * size[b] + coarse[b]
        return (np.bincount(at, v, size[a] * size[b]).reshape(size[a], size[b]) for v in (g, h))

    ranked = sorted(((crossed_tree(*grid(a, b))[1], a, b) for a in range(len(size)) for b in range(a) if size[a] > 1 and size[b] > 1), reverse=True)
    model.pairs = [(a, b) for _, a, b in ranked[:PAIRS]]
    model.pair_tables = [np.zeros((size[a], size[b])) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (a, b), t in zip(model.pairs, model.pair_tables):
            step = RATE * crossed_tree(*grid(a, b))[0]
            t += step
            raw += step[coarse[a], coarse[b]]
    return model


def with_features(docs: DataFrame) -> DataFrame:
    """Adds `x`, the features of `text`, to the other columns; the text itself is left out."""
    small_batches(docs.sparkSession)
    at = position(docs, "text")
    rest = [i for i in range(len(docs.columns)) if i != at]

    def run(batches):
        resident("quality", dict)
        for b in batches:
            for part, texts in texts_by_slice(b, at):
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in rest), pa.array([features(t) for t in texts], pa.list_(pa.float64()))], [*(part.schema.names[i] for i in rest), "x"])

    return docs.mapInArrow(run, docs.drop("text").withColumn("x", F.array(F.lit(0.0))).schema)


def fit(docs: DataFrame, labels: DataFrame) -> Additive:
    """The model of labels.quality, from at most about FIT_ROWS labelled rows."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col("quality").cast("double").alias("y"))
    n = max(1, known.count())
    pick = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(min(1.0, FIT_ROWS / n) * (1 << 30)))
    sample = known.where(pick).limit(2 * FIT_ROWS)  # so many rows at most: it can be broadcast
    rows = with_features(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("y", "text")).limit(4 * FIT_ROWS).toArrow()
    x = np.array(rows["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    return fit_additive(x, rows["y"].to_numpy())


def scores(docs: DataFrame, model: Additive, text_col: str = "text") -> DataFrame:
    """Adds score and predicted to documents."""
    docs = without(docs, ["score", "predicted"])
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = position(docs, text_col)

    def run(batches):
        resident("quality", dict)
        for b in batches:
            for part, texts in texts_by_slice(b, at):
                score = sent.value.score(np.array([features(t) for t in texts]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), pa.array((score >= LEAST).astype(np.int32))], [*part.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, docs.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that the classifier predicts to be good, with their columns. A row goes to Python once, and
    comes back only if it is kept."""
    model = fit(docs, labels)
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = position(docs, "text")

    def run(batches):
        resident("quality", dict)
        for b in batches:
            for part, texts in texts_by_slice(b, at):
                yield part.filter(pa.array(sent.value.score(np.array([features(t) for t in texts])) >= LEAST))

    return docs.mapInArrow(run, docs.schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return scores(rows, model).select("doc_id", "held_out", "score", "predicted")
