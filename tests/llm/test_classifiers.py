import random

import numpy as np
import pytest

from textveil.llm import lang_cnn, quality_nbsvm, toxicity_pu

from .conftest import WORDS, text

INSULTS = ["wretch", "dunce", "oafish", "boor"]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(600):
        t, junk, toxic = text(rng, 60), i % 5 == 0, i % 7 == 0
        if toxic:
            w = t.split()
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(INSULTS)
            t = " ".join(w)
        if junk:
            t = " ".join(x + rng.choice(["%%%", "###", "!!"]) for x in t.split())
        docs.append((i, t, "x", None, 5))
        labels.append((i, int(not junk), int(toxic)))
    docs += [(900, None, None, "s", 1), (901, "", None, None, None), (902, "word " * 20_000, "x", "s", 1), (None, "text without id", None, None, None), (1, docs[1][1], "x", None, 5)]
    labels += [(901, None, 1), (None, 1, 1), (2, 1, 0), (2, 1, 0), (5000, 1, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string, predicted string, id int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def accuracy(rows, labels, column, ids=range(600)):
    truth = {r[0]: r[column] for r in labels[:600]}
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 60
    return sum(a == b for a, b in held) / len(held)


def test_quality(labelled):
    docs, labels, raw = labelled
    rows = quality_nbsvm.score(docs, quality_nbsvm.learn(docs, labels)).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert accuracy(rows, raw, 1) > 0.97
    kept = quality_nbsvm.rejected_removed(docs, labels)
    assert kept.columns == docs.columns and 400 < kept.count() < 520
    none = quality_nbsvm.learn(docs.limit(0), labels.limit(0))
    assert quality_nbsvm.score(docs.limit(0), none).count() == 0 and quality_nbsvm.score(docs, none).count() == docs.count()


def test_toxicity(labelled):
    docs, labels, raw = labelled
    rows = toxicity_pu.score(docs, toxicity_pu.learn(docs, labels)).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert accuracy(rows, raw, 2) > 0.95
    assert {r.predicted for r in rows if r.doc_id in (900, 901, 902)} == {0}
    none = toxicity_pu.learn(docs, labels.limit(0))
    assert toxicity_pu.score(docs, none).count() == docs.count()


def test_hidden_positives_are_not_learned_as_clean():
    """Half the positives stand unlabelled; the corrected risk still calls them positive."""
    rng = np.random.default_rng(0)
    word = lambda n: np.unique(rng.integers(100, 400, n).astype(np.uint64))
    positive = [np.unique(np.r_[word(20), np.uint64(1)]) for _ in range(200)]
    unlabelled = [word(20) for _ in range(800)] + [np.unique(np.r_[word(20), np.uint64(1)]) for _ in range(200)]
    vocabulary, w, b = toxicity_pu.train(positive, unlabelled, 0.2)
    score = b + float(w[np.searchsorted(vocabulary, np.uint64(1))])
    assert score > 0 > b


def test_risk_and_its_slopes():
    """The non-negative corrected risk against its definition, and slopes against differences."""
    rng = np.random.default_rng(1)
    words = np.arange(1, 9, dtype=np.uint64)
    positive = [np.sort(rng.choice(words, 3, replace=False)) for _ in range(7)]
    unlabelled = [np.sort(rng.choice(words, 2, replace=False)) for _ in range(11)]
    p, u = toxicity_pu.Words(positive, words), toxicity_pu.Words(unlabelled, words)

    def plain(w, b, prior):
        loss = lambda z: float(np.log1p(np.exp(-z)))
        z = lambda t: b + sum(w[int(x) - 1] for x in t)
        mean = lambda xs: sum(xs) / len(xs)
        negative = mean([loss(-z(t)) for t in unlabelled]) - prior * mean([loss(-z(t)) for t in positive])
        return prior * mean([loss(z(t)) for t in positive]) + max(0.0, negative), negative

    signs = set()
    for prior in (0.1, 0.5, 0.9):
        for _ in range(6):
            w, b = rng.normal(0, 1.5, 8), float(rng.normal())
            value, g, gb = toxicity_pu.risk(p, u, prior, w, b)
            want, negative = plain(w, b, prior)
            signs.add(negative > 0)
            assert abs(value - want) < 1e-9
            for i in range(8):
                step = np.zeros(8)
                step[i] = 1e-6
                assert abs((plain(w + step, b, prior)[0] - plain(w - step, b, prior)[0]) / 2e-6 - g[i]) < 1e-5
            assert abs((plain(w, b + 1e-6, prior)[0] - plain(w, b - 1e-6, prior)[0]) / 2e-6 - gb) < 1e-5
    assert signs == {True, False}


def test_dual_descent_reaches_the_optimum():
    """The hinge-loss optimum against projected gradient steps on the dense dual."""
    rng = np.random.default_rng(2)
    x = (rng.random((40, 6)) < 0.4) * rng.normal(1, 0.3, (40, 6))
    y = np.where(x @ rng.normal(size=6) + rng.normal(0, 0.3, 40) > 0, 1.0, -1.0)
    idx = [np.flatnonzero(r) for r in x]
    w = quality_nbsvm.descend(idx, [r[i] for r, i in zip(x, idx, strict=True)], y, 6, c=0.1, rounds=3000)
    full = np.c_[x, np.ones(40)] * y[:, None]
    alpha, q = np.zeros(40), full @ full.T
    for _ in range(200_000):
        alpha = np.clip(alpha - 0.002 * (q @ alpha - 1), 0, 0.1)
    primal = lambda v: 0.5 * v @ v + 0.1 * np.maximum(0, 1 - full @ v).sum()
    dual = alpha.sum() - 0.5 * alpha @ q @ alpha
    assert abs(primal(w) - dual) < 1e-3 and np.allclose(w, full.T @ alpha, atol=0.02)


def test_ties_and_both_labels(spark):
    """An id with both labels counts as 1; equal texts get equal scores."""
    from textveil.llm.labelled import labels_to_learn

    rows = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 0), (3, None), (None, 1), (4, 7)], "doc_id long, toxic int")
    got = {r["__id"]: r["__y"] for r in labels_to_learn(rows, "toxic", 1, 5).collect()}
    assert got == {1: 1, 2: 0}


def test_query_columns(spark):
    """What the registered queries return by their contracts, over whole tables."""
    from textveil.llm.entry import QUERIES

    sf, n = "/root/testdata/sf0.001", 200
    want = {
        "op1_exact_top_k": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
        "op4_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
        "op5_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
        "op6_ngram_jaccard_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
        "op7_quality_classifier": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
        "op9_bpe_codec": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
        "op10_lm_scoring": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    }
    for name, columns in want.items():
        out = QUERIES[name](spark, sf)
        kinds = dict(out.dtypes)
        assert {c: kinds.get(c) for c in columns} == columns, name
        if name != "op1_exact_top_k":
            assert out.count() == n, name


def test_language(spark):
    rng = random.Random(9)
    other = ["queja", "ción", "mente", "osdo", "lleña", "rrue"]
    rows = [(i, " ".join(rng.choices(WORDS if i % 2 else other, k=rng.randrange(5, 150))), "en" if i % 2 else "es", "s") for i in range(300)]
    rows += [(900, None, "en", None), (901, "", "en", None), (902, "12 34 !?", "en", None), (903, "the of and", None, None), (904, "mente ción " * 8000, "es", None), (905, "² ½ ① Ⅳ ٣", "en", None), (906, "_ __ \u0301", "en", None), (907, "² ʰ", "en", None), (None, "the and of that", "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = lang_cnn.predict(docs, lang_cnn.learn(docs)).collect()
    by = {r.doc_id: r for r in got}
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert len(got) == len(rows) and len(held) > 40
    assert sum(r.lang_pred == ("en" if r.doc_id % 2 else "es") for r in held) / len(held) > 0.97
    assert [(by[i].lang_pred, by[i].score) for i in (900, 901, 902, 905, 906)] == [("und", 0.0)] * 5
    assert by[907].lang_pred != "und"
    assert by[903].lang_pred == "en" and by[904].lang_pred == "es" and all(0 <= r.score <= 1 for r in got)
    assert lang_cnn.predict(docs, lang_cnn.learn(docs.limit(0))).filter("lang_pred != 'und'").count() == 0


def test_network_slopes():
    rng = np.random.default_rng(3)
    net = lang_cnn.Network(["a", "b"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = rng.integers(1, 256, (3, lang_cnn.WINDOW)).astype(np.uint8), np.array([0, 1, 1])
    _, slopes = net.step(x, y)
    slopes["u"] = slopes["u"] - 1e-4 * net.p["u"]  # the decay of weights, which isn't part of the loss
    for name, g in slopes.items():
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in net.p[name].shape)
            if name == "e":
                at = (int(x[0, rng.integers(0, lang_cnn.WINDOW)]), at[1])
            keep = net.p[name][at]
            net.p[name][at] = keep + 1e-5
            up = net.step(x, y)[0]
            net.p[name][at] = keep - 1e-5
            down = net.step(x, y)[0]
            net.p[name][at] = keep
            assert abs((up - down) / 2e-5 - g[at]) < 1e-4, name


def test_tables_equal_the_network():
    rng = np.random.default_rng(1)
    net = lang_cnn.Network(["a", "b", "c"])
    x = rng.integers(0, 256, (20, lang_cnn.WINDOW)).astype(np.uint8)
    loss, _ = net.step(x, np.zeros(20, np.int64))
    assert abs(-lang_cnn.Reader(net.langs, net.p).log_probs(x)[:, 0].mean() - loss) < 1e-3


def test_every_language_is_learned(spark):
    """No language is left out for being one of many."""
    signs = [chr(0x4E00 + 40 * i) + chr(0x4E01 + 40 * i) for i in range(300)]
    rows = [(i * 20 + j, signs[i] * (3 + j), f"l{i}") for i in range(300) for j in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(lang_cnn.learn(docs).langs) == {f"l{i}" for i in range(300)}
