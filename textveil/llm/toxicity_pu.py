"""Toxicity: non-negative positive-unlabelled learning of a linear word model.

Confirmed toxic texts are the positives; a draw from all texts that may be learned
from, whatever their label, is unlabelled. With class prior p, the risk is
``p R+(positives) + max(0, R-(unlabelled) - p R-(positives))`` under logistic loss:
toxic texts among the unlabelled aren't learned as clean, and the corrected negative
part never counts below zero. The
prior is the share of toxic among the labels that may be learned from. The model is
trained in numpy on ``SAMPLE`` positives and ``SAMPLE`` unlabelled texts at most (of
``labelled.LONGEST`` bytes at most), chosen by hash; scoring reads every whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, batch, encoded, fold_col, small_batches, table
from .labelled import labels_to_learn, some_ids, texts_of

SAMPLE = 5_000
WIDTH = 1 << 16  # words kept, the most frequent first
LEAST_DF = 4
_MARKS = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256))


def words(text: str | None) -> set[bytes]:
    """Distinct lower-cased runs of letters and digits, and their beginnings of 6 to 8
    bytes, which stand for inflected forms; none for null and empty texts."""
    if not text:
        return set()
    out = set(encoded(text.lower()).translate(_MARKS).split())
    return out.union(*({b"%d^%b" % (n, w[:n]) for w in out if len(w) > n} for n in (6, 7, 8)))


class Words:
    """Word sets of texts as CSR arrays over a vocabulary of hashes."""

    def __init__(self, rows: list[np.ndarray], vocabulary: np.ndarray):
        at = [np.searchsorted(vocabulary, r) for r in rows]
        at = [a[(a < len(vocabulary)) & (vocabulary[np.minimum(a, len(vocabulary) - 1)] == r)] for a, r in zip(at, rows, strict=True)] if len(vocabulary) else [np.empty(0, np.int64) for _ in rows]
        self.start = np.cumsum([0, *map(len, at)])
        self.col = np.concatenate(at) if at else np.empty(0, np.int64)

    def margins(self, rows: np.ndarray, w: np.ndarray, b: float):
        size = self.start[rows + 1] - self.start[rows]
        row = np.repeat(np.arange(len(rows)), size)
        at = np.arange(len(row)) - np.repeat(np.cumsum(np.r_[0, size[:-1]]), size) + np.repeat(self.start[rows], size)
        col = self.col[at]
        return np.bincount(row, w[col], len(rows)) + b, row, col


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, rounds: int = 200, sparse: float = 0.06):
    """(vocabulary, weights, bias) of the least non-negative corrected risk.

    Proximal gradient steps under an L1 penalty choose the words (a word whose gradient
    stays under ``sparse`` of the steepest one gets no weight, so a very long text isn't
    judged by the sum of its ordinary words), then the chosen weights are fitted again
    without it. Words met in fewer than ``LEAST_DF`` sampled texts are left out.
    """
    both = positive + unlabelled
    if not positive or not unlabelled or not any(map(len, both)):
        p = min(max(prior, 1e-3), 1 - 1e-3)
        return np.empty(0, np.uint64), np.empty(0), float(np.log(p / (1 - p)))
    u, c = np.unique(np.concatenate(both), return_counts=True)
    keep = np.flatnonzero(c >= (LEAST_DF if len(both) >= 100 else 1))
    keep = keep[np.argsort(-c[keep], kind="stable")[:WIDTH]]
    vocabulary = np.sort(u[keep])
    w, b = _descend(positive, unlabelled, vocabulary, prior, rounds, sparse)
    chosen = vocabulary[w > 0]
    w, b = _descend(positive, unlabelled, chosen, prior, rounds, 0.002)
    return chosen, w, b


def risk(p: Words, u: Words, prior: float, w: np.ndarray, b: float) -> tuple[float, np.ndarray, float]:
    """The corrected risk of positives and unlabelled texts and its slopes in weights and bias."""
    n_p, n_u = len(p.start) - 1, len(u.start) - 1
    zp, row_p, col_p = p.margins(np.arange(n_p), w, b)
    zu, row_u, col_u = u.margins(np.arange(n_u), w, b)
    neg = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    gp, gn, gu = -prior * _sigmoid(-zp) / n_p, -prior * _sigmoid(zp) / n_p, _sigmoid(zu) / n_u
    if neg >= 0:
        gp = gp + gn
    else:  # the corrected negative part counts as zero and has no slope
        gu = np.zeros_like(gu)
    g = np.bincount(col_p, gp[row_p], len(w)) + np.bincount(col_u, gu[row_u], len(w))
    return prior * np.logaddexp(0, -zp).mean() + max(0.0, neg), g, gp.sum() + gu.sum()


def _descend(positive, unlabelled, vocabulary, prior, rounds, sparse):
    p, u, width = Words(positive, vocabulary), Words(unlabelled, vocabulary), len(vocabulary)
    share = prior * np.bincount(p.col, minlength=width) / len(positive) + np.bincount(u.col, minlength=width) / len(unlabelled)
    w, b, slow = np.zeros(width), float(np.log(prior / (1 - prior))), 8.0
    now, g, gb = risk(p, u, prior, w, b)
    least = sparse * np.abs(g).max(initial=0)
    best = (now, w, b)
    for _ in range(rounds):
        step = 1 / (0.25 * slow * (share + 1e-3))
        new = w - step * g
        new = np.sign(new) * np.maximum(np.abs(new) - step * least, 0)
        new_b = b - gb / (0.25 * slow)
        after, g2, gb2 = risk(p, u, prior, new, new_b)
        total = after + least * np.abs(new).sum()
        if total > now + least * np.abs(w).sum() + 1e-12 and slow < 1e4:
            slow *= 2
            continue
        w, b, now, g, gb = new, new_b, after, g2, gb2
        slow = max(2.0, slow * 0.95)
        if now <= best[0] or least:
            best = (now, w, b)
    return best[1], float(best[2])


def learn(docs: DataFrame, labels: DataFrame, column: str = "toxic", k: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text"):
    known = labels_to_learn(labels, column, k, held, id_col)
    counts = {r["__y"]: r["count"] for r in known.groupBy("__y").count().collect()}
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    positive = some_ids(known.filter("__y = 1").select("__id"), SAMPLE, "__id").withColumn("__y", F.lit(1))
    rest = docs.select(F.col(id_col).cast("long").alias("__id")).filter(F.col("__id").isNotNull() & (fold_col(F.col("__id"), k) != held))
    # drawn from all rows, positives and all: the correction counts on prior times positives among them
    # a threshold on what the draw orders by leaves few ids, so not all have to be made distinct
    share = 2 * SAMPLE / max(1, rest.count())
    if share < 1:
        rest = rest.filter(F.xxhash64(F.lit(17), "__id") < int(share * 2**64) - 2**63)
    rest = some_ids(rest.distinct(), SAMPLE, "__id").withColumn("__y", F.lit(0))
    rows = texts_of(docs, positive.unionByName(rest).select("__id", "__y"), id_col, text_col)
    schema = pa.schema([("y", pa.int32()), ("h", pa.binary())])

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            yield batch(schema, y=b.column(0), h=[np.unique(hashes.array(list(words(t)))).tobytes() for t in b.column(1).to_pylist()])

    got = sorted((r.y, bytes(r.h)) for r in rows.mapInArrow(run, "y int, h binary").collect())
    sets = {y: [np.frombuffer(h, np.uint64) for z, h in got if z == y] for y in (0, 1)}
    return train(sets[1], sets[0], prior)


def score(docs: DataFrame, model, k: int = 5, held: int = 0, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every whole text; null and empty texts have no
    word and get the score of the bias alone. Rows stay as many as they are."""
    spark = docs.sparkSession
    small_batches(spark)
    vocabulary, w, bias = model
    keep = np.flatnonzero(w)
    held_model = spark.sparkContext.broadcast((dict(zip(vocabulary[keep].tolist(), w[keep].tolist(), strict=True)), bias))
    schema = pa.schema([("id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        weight, b0 = held_model.value
        hashes = WordHashes()

        class Weights(dict):
            def __missing__(self, word):
                if len(self) >= 300_000:
                    self.clear()
                x = self[word] = weight.get(hashes.of(word), 0.0)
                return x

        weights = Weights()
        for b in batches:
            z = [b0 + sum(sorted(map(weights.__getitem__, words(t)))) for t in b.column(1).to_pylist()]
            yield batch(schema, id=b.column(0), score=_sigmoid(np.array(z, float)))

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(run, "id long, score double")
    return out.select(F.col("id").alias(id_col), (fold_col(F.col("id"), k) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    small_batches(spark)
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))
