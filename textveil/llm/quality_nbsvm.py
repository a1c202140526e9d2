"""Quality classifier: naive-Bayes-scaled n-gram indicators and a linear hinge loss.

A text's n-grams are lower-cased words and runs of one to three word shapes, a shape
being a word's pattern of upper, lower, digit and mark runs, with a sign of its own
for a word that repeats the last one; shapes also count as indicators of how large a
share of the words they take. Each indicator is scaled by the log ratio of its
smoothed counts in the two classes, then a linear model with hinge loss is fitted by
dual coordinate descent, and a logistic curve fitted on rows set aside turns margins
into scores. Whole texts are read; labels are learned from ``SAMPLE`` rows at most
of each class, chosen by hash.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, encoded, fold_col, small_batches, table, worker_memory
from .labelled import labels_to_learn, some_ids, texts_of

SAMPLE = 3_000  # labelled rows of each class to fit on
LEAST_DF = 5  # fitted rows that an n-gram must be in
CACHED = 200_000


def shape(word: bytes) -> str:
    """A word's pattern: A upper, a lower, 0 digit, other ASCII as it is, ~ else; a run of
    equal signs is written as two, and 12 signs are kept."""
    signs = ("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c if c.isascii() else "~" for c in word.decode("utf-8", "replace"))
    return re.sub(r"(.)\1+", r"\1\1", "".join(signs))[:12]


class Shapes(dict):
    def __init__(self):
        super().__init__()
        worker_memory("shapes")

    def __missing__(self, word: bytes) -> str:
        if len(self) >= CACHED:
            self.clear()
        s = self[word] = shape(word)
        return s


_MARKS = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256))


def grams(text: str | None, shapes: Shapes) -> tuple[set, set]:
    """(words, shape n-grams) of a text; both empty for null and blank texts."""
    raw = encoded(text) if text else b""
    words = raw.split()
    if not words:
        return set(), set()
    s = [shapes[w] for w in words]
    again = [a == b for a, b in zip(words, words[1:], strict=False)]
    s = [s[0], *["=" if r else x for r, x in zip(again, s[1:], strict=True)]]
    out = set(s) | set(zip(s, s[1:], strict=False)) | set(zip(s, s[1:], s[2:], strict=False))
    for x, c in Counter(s).items():
        share = c / len(s)
        out |= {(x, "share", k) for k in (2, 4, 8, 16, 32) if share * k >= 1}
    return set(raw.lower().translate(_MARKS).split()), out


class Model:
    """Weights of n-grams, bias and logistic curve."""

    def __init__(self, weight: dict, bias: float, a: float, b: float):
        self.weight, self.bias, self.a, self.b = weight, bias, a, b

    def margin(self, features) -> float:
        """Texts that hold more of the known n-grams are scaled down as in training."""
        w = self.weight
        hits = [w[g] for g in features if g in w]
        return self.bias + (sum(hits) / len(hits) ** 0.5 if hits else 0.0)

    def score(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.a * margin + self.b, -40, 40))))


def descend(x_idx: list[np.ndarray], x_val: list[np.ndarray], y: np.ndarray, width: int, c: float = 0.1, rounds: int = 30, seed: int = 5):
    """Dual coordinate descent for the L2-regularised hinge loss; the last feature is the bias."""
    rng, n = np.random.default_rng(seed), len(y)
    w, alpha = np.zeros(width + 1), np.zeros(n)
    norm = np.array([v @ v + 1.0 for v in x_val])
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(n):
            g = y[i] * (x_val[i] @ w[x_idx[i]] + w[-1]) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), c)
            step = (new - alpha[i]) * y[i]
            if step:
                w[x_idx[i]] += step * x_val[i]
                w[-1] += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-4 * c:
            break
    return w


def logistic_curve(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a m + b))), by Newton steps with smoothed targets; a stays positive."""
    up, down = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, float(np.log((up + 1) / (down + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g, h = p - t, np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[(h * m * m).sum() + 1e-6, (h * m).sum()], [(h * m).sum(), h.sum() + 1e-6]])
        da, db = np.linalg.solve(hess, [(g * m).sum(), g.sum()])
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
    return max(float(a), 1e-3), float(b)


def fit(sets: list[set], y: np.ndarray, prior: float) -> Model:
    """Fit on feature sets with labels 0/1; ``prior`` is the share of 1 among all labels learned from."""
    y = np.asarray(y)
    if not len(y) or len(set(y.tolist())) < 2:
        p = min(max(prior, 1e-3), 1 - 1e-3)
        return Model({}, 0.0, 1.0, float(np.log(p / (1 - p))))
    df: dict = {}
    for s in sets:
        for g in s:
            df[g] = df.get(g, 0) + 1
    least = LEAST_DF if len(y) >= 200 else 2
    names = sorted((g for g, c in df.items() if c >= least), key=repr)  # in an order that no hash seed changes
    number = {g: i for i, g in enumerate(names)}
    idx = [np.sort(np.array([number[g] for g in s if g in number], np.int64)) for s in sets]
    aside = np.arange(len(y)) % 5 == 0 if len(y) >= 50 else np.zeros(len(y), bool)

    def ratio(rows):
        p, q = np.ones(len(names)), np.ones(len(names))
        for i in rows:
            (p if y[i] else q)[idx[i]] += 1
        n1, n0 = (y[rows] == 1).sum() + 2, (y[rows] == 0).sum() + 2
        return np.log((p / n1) / (q / n0))

    def train(rows):
        r = ratio(rows)
        scale = np.sqrt(np.array([max(1, len(i)) for i in idx]))  # long texts hold more n-grams
        val = [r[idx[i]] / scale[i] * 10 for i in range(len(y))]
        w = descend([idx[i] for i in rows], [val[i] for i in rows], np.where(y[rows] == 1, 1.0, -1.0), len(names))
        return r, w, np.array([val[i] @ w[idx[i]] + w[-1] for i in range(len(y))])

    rows = np.flatnonzero(~aside)
    a, b = 4.0, 0.0
    if aside.any() and len(set(y[aside].tolist())) == 2:
        _, _, m = train(rows)
        a, b = logistic_curve(m[aside], y[aside])
    r, w, _ = train(np.arange(len(y)))
    shift = np.log(prior / (1 - prior)) - np.log((y == 1).mean() / (y == 0).mean()) if 0 < prior < 1 else 0.0
    return Model({g: float(10 * r[i] * w[i]) for g, i in number.items()}, float(w[-1]), a, b + float(shift))


def features(text: str | None, shapes: Shapes) -> set:
    words, marks = grams(text, shapes)
    return words | marks


def learn(docs: DataFrame, labels: DataFrame, column: str = "quality", k: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most ``SAMPLE`` labelled rows of each class outside the held-out fold, of texts
    of ``labelled.LONGEST`` bytes at most."""
    known = labels_to_learn(labels, column, k, held, id_col)
    counts = {r["__y"]: r["count"] for r in known.groupBy("__y").count().collect()}
    chosen = some_ids(known.filter("__y = 0"), SAMPLE, "__id").unionByName(some_ids(known.filter("__y = 1"), SAMPLE, "__id"))
    rows = texts_of(docs, chosen, id_col, text_col)
    schema = pa.schema([("y", pa.int32()), ("f", pa.binary())])

    def run(batches):
        import pickle

        shapes = Shapes()
        for b in batches:
            yield batch(schema, y=b.column(0), f=[pickle.dumps(features(t, shapes)) for t in b.column(1).to_pylist()])

    import pickle

    got = sorted((r.y, bytes(r.f)) for r in rows.mapInArrow(run, "y int, f binary").collect())
    got.sort(key=lambda r: hash_of(r[1]))
    total = sum(counts.values())
    return fit([pickle.loads(f) for _, f in got], np.array([y for y, _ in got]), counts.get(1, 0) / total if total else 0.5)


def hash_of(data: bytes) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(data)


def score(docs: DataFrame, model: Model, k: int = 5, held: int = 0, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every whole text, null and empty ones included:
    they have no n-gram and get the score of the bias alone."""
    spark = docs.sparkSession
    small_batches(spark)
    held_model = spark.sparkContext.broadcast(model)
    schema = pa.schema([("id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        shapes, m = Shapes(), held_model.value
        for b in batches:
            yield batch(schema, id=b.column(0), score=[m.score(m.margin(features(t, shapes))) for t in b.column(1).to_pylist()])

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(run, "id long, score double")
    return out.select(F.col("id").alias(id_col), (fold_col(F.col("id"), k) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    small_batches(spark)
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))


def rejected_removed(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows whose text the classifier scores at ``threshold`` or more, with all their columns."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(learn(docs, labels))

    @F.pandas_udf("boolean")
    def keeps(text):
        shapes, m = Shapes(), model.value
        return text.map(lambda t: m.score(m.margin(features(t, shapes))) >= threshold)

    return docs.filter(keeps(F.col(text_col)))
