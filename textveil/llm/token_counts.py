"""Token counts by trie-shared dynamic programming.

A pre-token is a white-space word with a word mark before it. Its tokens are the pieces
of the most probable segmentation under a unigram model; characters that no piece
covers fall back to one token for each UTF-8 byte. The public vocabulary at hand is one
of merges without unigram probabilities, so a piece's is taken from its rank by Zipf's
law. Distinct pre-tokens are inserted in a trie that a task keeps while it reads its
texts. Forward scores are computed when a node is made: a prefix that pre-tokens share is
scored once, and each pre-token's count stands at its terminal node.
"""

from __future__ import annotations

from math import log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, encoded, environ_path, small_batches, table, worker_memory

MARK = "▁"
NODES = 600_000  # of a trie
ALONE = 4_096  # characters from which a pre-token is scored outside the trie
MET = 75_000  # distinct pre-tokens inserted at once
BYTE_COST = 30.0  # of a byte token, dearer than any piece


def unigram_costs(model_path: str) -> dict[str, float]:
    """piece -> -log probability, by rank among the pieces that stand for text."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i)) and m.get_score(i) > -1e8]
    return {p: log(i + 2.0) for i, p in enumerate(pieces)}


class Counter:
    """A trie of the distinct pre-tokens met, grown from batch to batch.

    Each node keeps the forward score and count of the prefix that it stands for, which are
    computed when the node is made and never again, so a terminal node's count is its
    pre-token's. Beyond ``NODES`` nodes the trie starts anew.
    """

    def __init__(self, costs: dict[str, float]):
        self.costs, self.longest = costs, max(map(len, costs), default=1)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}  # the terminals by pre-token
        self.child: dict[int, int] = {}
        known = MARK in self.costs
        self.cost, self.count = [self.costs[MARK] if known else 3 * BYTE_COST], [1 if known else 3]

    def learn(self, words: set[str]) -> None:
        """Insert the words that aren't in the trie."""
        for w in words:
            if len(w) > ALONE and w not in self.known:
                self.known[w] = self._alone(w)
        new = sorted(w for w in words if w not in self.known)
        if len(self.cost) + sum(map(len, new)) > NODES and len(self.cost) > 1:
            alone = {w: n for w, n in self.known.items() if len(w) > ALONE and w in words}
            self._clear()
            self.known.update(alone)
            new = sorted(w for w in words if w not in self.known)
        child, node_cost, node_count = self.child, self.cost, self.count
        # along the path of the last word: its nodes, and forward scores and counts from before the mark on
        path, cost, count = [0], [0.0, node_cost[0]], [0, node_count[0]]
        last = ""
        for w in new:
            d = 0
            top = min(len(w), len(last))
            while d < top and w[d] == last[d]:
                d += 1
            del path[d + 1 :], cost[d + 2 :], count[d + 2 :]
            last = w
            text = MARK + w
            for end in range(d + 2, len(text) + 1):
                c = text[end - 1]
                key = path[-1] << 21 | ord(c)
                node = child.get(key)
                if node is None:
                    best, n = self._forward(text, end, cost, count, 0)
                    node = child[key] = len(node_cost)
                    node_cost.append(best)
                    node_count.append(n)
                path.append(node)
                cost.append(node_cost[node])
                count.append(node_count[node])
            self.known[w] = node_count[path[-1]]

    def _forward(self, text: str, end: int, cost: list[float], count: list[int], gone: int) -> tuple[float, int]:
        """Score and count of ``text[:end]`` from those of its beginnings, of which ``gone`` are no longer in the lists."""
        costs, c = self.costs, text[end - 1]
        size = len(encoded(c)) if c not in costs else 0
        best, n = (cost[-1] + costs[c], count[-1] + 1) if not size else (cost[-1] + size * BYTE_COST, count[-1] + size)
        for start in range(max(0, end - self.longest), end - 1):
            piece = costs.get(text[start:end])
            if piece is not None:
                x = cost[start - gone] + piece
                if x < best - 1e-9 or (x <= best + 1e-9 and count[start - gone] + 1 < n):
                    best, n = x, count[start - gone] + 1
        return best, n

    def _alone(self, word: str) -> int:
        """The count of a very long pre-token, which would crowd the trie; keeps the last scores only."""
        text, gone, cost, count = MARK + word, 0, [0.0, self.cost[0]], [0, self.count[0]]
        for end in range(2, len(text) + 1):
            best, n = self._forward(text, end, cost, count, gone)
            cost.append(best)
            count.append(n)
            if len(cost) > ALONE:
                gone += len(cost) - self.longest
                del cost[: -self.longest], count[: -self.longest]
        return count[-1]

    def batch(self, texts: list[str | None]):
        """(pre-tokens, tokens) of each text."""
        split = [t.split() if t else [] for t in texts]
        lo = 0
        while lo < len(split):
            hi, met = lo, set()
            while hi < len(split) and (hi == lo or len(met) < MET):
                met.update(split[hi])
                hi += 1
            self.learn(met)
            for words in split[lo:hi]:
                yield len(words), sum(map(self.known.__getitem__, words))
            lo = hi


def token_counts(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_pretokens long, n_tokens long) of every whole text; zeros for null, empty and
    blank ones. Every input row gives one row; other columns aren't read."""
    spark = docs.sparkSession
    small_batches(spark)
    costs = unigram_costs(model_path or environ_path("piece_bpe_32k.model"))
    model = spark.sparkContext.broadcast(costs)
    schema = pa.schema([("id", pa.int64()), ("n_pretokens", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        key = hash(tuple(model.value.items()))
        kept = worker_memory("counts")
        if kept.get("key") != key:
            kept["key"], kept["counter"] = key, Counter(model.value)
        counter = kept["counter"]
        for b in batches:
            got = list(counter.batch(b.column(1).to_pylist()))
            yield batch(schema, id=b.column(0), n_pretokens=[n for n, _ in got], n_tokens=[n for _, n in got])

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(run, "id long, n_pretokens long, n_tokens long")
    return out.withColumnRenamed("id", id_col)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def brute_count(word: str, costs: dict[str, float]) -> int:
    """Tokens of one pre-token by the plain recurrence over all segmentations; for tests."""
    text, longest = MARK + word, max(map(len, costs), default=1)
    best = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        c = text[end - 1]
        size = len(encoded(c))
        options = [(best[end - 1][0] + size * BYTE_COST, best[end - 1][1] + size)] if c not in costs else []
        options += [(best[s][0] + costs[text[s:end]], best[s][1] + 1) for s in range(max(0, end - longest), end) if text[s:end] in costs]
        least = min(o[0] for o in options)
        best.append(min((o for o in options if o[0] <= least + 1e-9), key=lambda o: o[1]))
    return best[-1][1]
