"""Token counts by a dynamic program shared in a trie (operator 10).

A unigram model over the fixed public vocabulary: the probability of a piece falls with its number,
p ~ 1 / (number + 1), which needs no training. The distinct pre-tokens of a batch are taken in sorted
order, which walks their trie depth first: the forward scores of a shared prefix are computed once.
Each node has the best score of its prefix, that segmentation's number of tokens, and the sum over all
segmentations; what the node of a whole pre-token has is stored as its terminal count and summed up
for each document. Terminals met before come from a bounded table of the task's process.

Ties of the best score take fewer tokens. A character without a piece costs UNKNOWN and counts as its
UTF-8 bytes. Pre-tokens are runs between white space, of any length: the trie holds their first DEPTH
characters, and what comes after is walked with the scores of the last positions at hand.

Defined cases: a null, empty or blank text has no tokens and log probability zero; repeated rows give
repeated results; null doc_ids are kept; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from math import exp, inf, log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clarispan.llm.common import resident, small_batches, table, texts_by_slice
from clarispan.llm.pieces import longest, pieces, pretokens

DEPTH, STRIDE = 128, 4096
KNOWN_WORDS = 300_000
UNKNOWN = -25.0
RESULT = "doc_id long, n_tokens long, n_pretokens long, log_prob double"


class TrieCounter:
    def __init__(self, path: str | None = None):
        table = pieces(path)
        total = sum(1 / (i + 1) for i in table.values())
        self.score = {p: -log((i + 1) * total) for p, i in table.items()}
        self.longest = longest(table)
        self.known: dict[str, tuple[int, float]] = {}

    def learn(self, words: list[str]) -> None:
        """Terminal counts (tokens, log probability) of sorted distinct words."""
        most = self.longest
        best, count, total = [0.0], [0], [0.0]
        before = ""
        for w in words:
            shared, end = 0, min(len(w), len(before), DEPTH)
            while shared < end and w[shared] == before[shared]:
                shared += 1
            del best[shared + 1 :], count[shared + 1 :], total[shared + 1 :]
            self._walk(w, shared + 1, min(len(w), DEPTH) + 1, 0, best, count, total)
            if len(w) > DEPTH:  # a branch below the trie: only its last positions
                low = max(0, DEPTH - most)
                tail = best[low:], count[low:], total[low:]
                for at in range(DEPTH + 1, len(w) + 1, STRIDE):
                    self._walk(w, at, min(len(w) + 1, at + STRIDE), low, *tail)
                    gone = max(0, len(tail[0]) - most - 1)
                    low += gone
                    for x in tail:
                        del x[:gone]
                self.known[w] = (tail[1][-1], tail[2][-1])
            else:
                self.known[w] = (count[-1], total[-1])
            before = w

    def _walk(self, w: str, at: int, to: int, low: int, best: list, count: list, total: list) -> None:
        """Appends the scores of positions at to to - 1; the lists begin at position low."""
        get, most = self.score.get, self.longest
        for e in range(at, to):
            top, n, ways = -inf, 0, []
            for s in range(e - most if e > most else 0, e):
                p = get(w[s:e])
                if p is None:
                    if s < e - 1:
                        continue
                    p, k = UNKNOWN, len(w[s].encode("utf-8", "replace"))
                else:
                    k = 1
                ways.append(total[s - low] + p)
                p += best[s - low]
                k += count[s - low]
                if p > top or (p == top and k < n):
                    top, n = p, k
            best.append(top)
            count.append(n)
            high = max(ways)
            total.append(high if len(ways) == 1 else high + log(sum([exp(x - high) for x in ways])))

    def counts(self, texts: list[str]) -> list[tuple[int, int, float]]:
        """(tokens, pre-tokens, log probability) of each text."""
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        words = [pretokens(t) for t in texts]
        known = self.known
        self.learn(sorted({w for row in words for w in row if w not in known}))
        out = []
        for row in words:
            found = [known[w] for w in row]
            out.append((sum([n for n, _ in found]), len(row), sum([p for _, p in found])))
        return out


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Rows (doc_id, n_tokens, n_pretokens, log_prob) for every document."""
    small_batches(docs.sparkSession)

    def run(batches):
        counter = resident(("trie", path), lambda: TrieCounter(path))
        for b in batches:
            for part, texts in texts_by_slice(b, 1):
                n, words, logs = zip(*counter.counts(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(words, pa.int64()), pa.array(logs, pa.float64())], ["doc_id", "n_tokens", "n_pretokens", "log_prob"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RESULT)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
