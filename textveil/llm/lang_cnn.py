"""Language ID by a byte convolutional network, trained and applied in numpy.

A text's UTF-8 bytes are cut into windows of ``WINDOW`` bytes. Bytes are embedded,
filters of several widths run over them, the largest value of each filter in the
window is kept, and a softmax layer gives language probabilities. All windows of a
text are read; their log probabilities are averaged by the bytes they hold. When
applied, a filter is a sum of table rows: the products of embedding and filter are
made once for each byte and each pair of bytes. The model is fitted on windows of a
bounded number of texts of each language (``PER_LANG``), chosen by hash.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, encoded, fold_col, small_batches, table

WINDOW = 256
EMBED = 8
FILTERS = 16
WIDTHS = (2, 3, 4)
PER_LANG = 1_000  # texts of a language to fit on, about
ALL_LANGS = 50_000  # texts to fit on over all languages, about; each of very many has fewer, but 10 at least
EACH = 3  # windows of a text to fit on
UNKNOWN = "und"
_MAYBE_LETTER = re.compile(r"[^\W\d_]")  # letters, and signs of numbers such as a half


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _MAYBE_LETTER.finditer(text))


def windows(text: str) -> np.ndarray:
    """The text's bytes as rows of ``WINDOW``, the last one filled with zeros."""
    b = np.frombuffer(encoded(text), np.uint8)
    out = np.zeros((max(1, -(-len(b) // WINDOW)), WINDOW), np.uint8)
    out.reshape(-1)[: len(b)] = b
    return out


class Network:
    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.p = {"e": rng.normal(0, 0.5, (256, EMBED)), "u": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))), "c": np.zeros(len(langs))}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, 1 / np.sqrt(w * EMBED), (w * EMBED, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients on a batch of windows."""
        p, n = self.p, len(x)
        e = p["e"][x]
        pooled, kept = [], []
        for w in WIDTHS:
            cols = np.concatenate([e[:, j : WINDOW - w + 1 + j] for j in range(w)], 2)
            z = cols @ p[f"w{w}"] + p[f"b{w}"]
            at = z.argmax(1)
            best = np.take_along_axis(z, at[:, None], 1)[:, 0]
            pooled.append(np.maximum(best, 0))
            kept.append((at, best > 0, cols))
        h = np.concatenate(pooled, 1)
        o = h @ p["u"] + p["c"]
        o -= o.max(1, keepdims=True)
        q = np.exp(o)
        q /= q.sum(1, keepdims=True)
        loss = -np.log(q[np.arange(n), y] + 1e-9).mean()
        d = q.copy()
        d[np.arange(n), y] -= 1
        d /= n
        g = {"u": h.T @ d + 1e-4 * p["u"], "c": d.sum(0), "e": np.zeros_like(p["e"])}
        dh = d @ p["u"].T
        rows = np.arange(n)[:, None]
        for i, w in enumerate(WIDTHS):
            at, on, cols = kept[i]
            dz = dh[:, i * FILTERS : (i + 1) * FILTERS] * on
            seen = cols[rows, at]  # n x FILTERS x (w EMBED)
            g[f"w{w}"] = np.einsum("nfk,nf->kf", seen, dz)
            g[f"b{w}"] = dz.sum(0)
            de = (dz[:, :, None] * p[f"w{w}"].T[None]).reshape(n, FILTERS, w, EMBED)
            for j in range(w):
                np.add.at(g["e"], x[rows, at + j], de[:, :, j])
        return float(loss), g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, size: int = 64, rate: float = 3e-3, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        epochs = max(epochs, min(60, 600 * size // max(1, len(x))))
        total, t = max(1, epochs * -(-len(x) // size)), 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), size):
                rows = order[lo : lo + size]
                _, g = self.step(x[rows], y[rows])
                t += 1
                r = rate * (1 - t / (total + 1))
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.p[k] -= (r * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self


class Reader:
    """The network as tables: a filter's value at a place is a sum of rows of byte and byte-pair tables."""

    def __init__(self, langs: list[str], p: dict):
        self.langs, self.p = langs, p
        self.one, self.two = {}, {}
        for w in WIDTHS:
            t = [p["e"] @ p[f"w{w}"][j * EMBED : (j + 1) * EMBED] for j in range(w)]
            for j in range(0, w - 1, 2):
                self.two[w, j] = (t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, FILTERS)
            if w % 2:
                self.one[w] = t[-1]

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        pair = x[:, :-1].astype(np.int32) << 8 | x[:, 1:]
        pooled = []
        for w in WIDTHS:
            n = WINDOW - w + 1
            z = self.two[w, 0].take(pair[:, :n], 0)
            if w >= 4:
                z += self.two[w, 2].take(pair[:, 2 : 2 + n], 0)
            if w % 2:
                z += self.one[w].take(x[:, w - 1 : w - 1 + n], 0)
            pooled.append(np.maximum(z.max(1) + self.p[f"b{w}"], 0))
        o = np.concatenate(pooled, 1) @ self.p["u"] + self.p["c"]
        o -= o.max(1, keepdims=True)
        return o - np.log(np.exp(o).sum(1, keepdims=True))

    def predict(self, texts: list[str | None], most: int = 256):
        """(language, probability) of each text, ``most`` windows at a time."""
        out: list = [(UNKNOWN, 0.0)] * len(texts)
        which = [i for i, t in enumerate(texts) if t and has_letter(t)]
        if not which or not self.langs:
            return out
        cut = [windows(texts[i]) for i in which]
        size = np.array([len(c) for c in cut])
        x = np.concatenate(cut)
        held = np.maximum((x != 0).sum(1), 1)
        lp = np.concatenate([self.log_probs(x[i : i + most]) for i in range(0, len(x), most)]) * held[:, None]
        start = np.r_[0, np.cumsum(size)[:-1]]
        mean = np.add.reduceat(lp, start) / np.add.reduceat(held, start)[:, None]
        mean -= mean.max(1, keepdims=True)
        q = np.exp(mean)
        q /= q.sum(1, keepdims=True)
        best = q.argmax(1)
        for i, b, s in zip(which, best.tolist(), q.max(1).tolist(), strict=True):
            out[i] = (self.langs[b], s)
        return out


def learn(docs: DataFrame, k: int = 4, held: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network:
    """Fit on about ``PER_LANG`` texts of each non-null language outside the held-out fold.

    A language's texts are taken by a threshold on the id's hash that its count sets, so
    no language's rows are gathered or sorted.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("txt"), F.col(lang_col).cast("string").alias("lang"))
    known = known.filter(F.col("lang").isNotNull() & (fold_col(F.col("id"), k) != held))
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return Network([])
    wanted = max(10, min(PER_LANG, ALL_LANGS // len(counts)))
    shares = spark.createDataFrame([(g, wanted / n) for g, n in sorted(counts.items())], "lang string, share double")
    draw = F.pmod(F.xxhash64(F.lit(23), "id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.filter("txt is not null and length(txt) > 0").join(F.broadcast(shares), "lang").filter(draw < F.col("share")).select("id", "txt", "lang")
    schema = pa.schema([("lang", pa.string()), ("w", pa.binary())])

    def run(batches):
        from xxhash import xxh3_64_intdigest

        for b in batches:
            lang, out = [], []
            for t, g in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if has_letter(t):
                    w = windows(t)
                    for i in sorted({(xxh3_64_intdigest(encoded(t)) + j * 7919) % len(w) for j in range(EACH)}):
                        lang.append(g)
                        out.append(w[i].tobytes())
            yield batch(schema, lang=lang, w=out)

    rows = sorted((r.lang, bytes(r.w)) for r in chosen.mapInArrow(run, "lang string, w binary").collect())
    if not rows:
        return Network([])
    number = {g: i for i, g in enumerate(sorted({g for g, _ in rows}))}
    x = np.frombuffer(b"".join(w for _, w in rows), np.uint8).reshape(-1, WINDOW)
    return Network(list(number)).fit(x, np.array([number[g] for g, _ in rows]))


def predict(docs: DataFrame, net: Network, k: int = 4, held: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score) of every whole text; ``und`` with score 0 for a text
    that is null or has no letter. Every input row gives one row."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast((net.langs, net.p))
    schema = pa.schema([("id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        reader = Reader(*model.value)
        for b in batches:
            got = []
            texts = b.column(1).to_pylist()
            lo = 0
            while lo < len(texts):  # about 8 MB of text at once
                hi, held_bytes = lo, 0
                while hi < len(texts) and (hi == lo or held_bytes < 8_000_000):
                    held_bytes += len(texts[hi] or "")
                    hi += 1
                got += reader.predict(texts[lo:hi])
                lo = hi
            yield batch(schema, id=b.column(0), lang_pred=[g for g, _ in got], score=[s for _, s in got])

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(run, "id long, lang_pred string, score double")
    return out.select(F.col("id").alias(id_col), (fold_col(F.col("id"), k) == held).alias("held_out"), "lang_pred", "score")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, learn(docs))
