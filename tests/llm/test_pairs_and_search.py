import random

import numpy as np
from pyspark.sql import functions as F

from textveil.llm import ball_tree
from textveil.llm.graph import connected
from textveil.llm.jaccard_join import brute_components, forest, jaccard_components, near_copies_removed

from .conftest import WORDS


def test_components_equal_brute_force(odd_docs, odd_rows):
    got = sorted(map(tuple, jaccard_components(odd_docs).collect()), key=repr)
    assert got == sorted(brute_components(odd_rows), key=repr)


def test_components_of_nothing(odd_docs):
    assert jaccard_components(odd_docs.limit(0)).count() == 0


def test_chain_of_links_in_blocks(spark, monkeypatch):
    """Each text links with the next only; blocks of few rows must not lose a link."""
    from textveil.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "BLOCK", 2)
    monkeypatch.setattr(jaccard_join, "CLUSTER", 200)
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 60])) for i in range(20)]
    rows += [(50 + i, " ".join(words[:60] + [f"tail{i}"])) for i in range(9)]
    got = sorted(map(tuple, jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == sorted(brute_components(rows)) and len({c for _, _, c in got}) < len(rows)


def test_near_copies_removed(odd_docs, odd_rows):
    kept = near_copies_removed(odd_docs)
    assert kept.columns == odd_docs.columns
    comp = {d: c for d, _, c in brute_components(odd_rows) if d is not None}
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == {d for d, c in comp.items() if d == c}


def test_near_copies_of_odd_rows(spark):
    """One row of a component stays, whatever its ids; a text that shares only its id stays too."""
    rng = random.Random(6)
    a, u, v, w = (" ".join(rng.choices(WORDS, k=60)) for _ in range(4))
    rows = [(3, a), (5, a.upper()), (5, u), (None, v), (None, v + " tail"), (None, w), (None, None), (None, None), (7, ""), (7, ""), (8, ""), (9, None)]
    kept = near_copies_removed(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, node int"))
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    nulls = [x for x in got if x[0] is None and x[1] and x[1].startswith(v)]
    assert len(nulls) == 1 and kept.columns == ["doc_id", "text", "node"]
    assert [x for x in got if x not in nulls] == sorted([(3, a), (5, u), (None, w), (None, None), (7, ""), (8, ""), (9, None)], key=repr)


def test_long_words_of_equal_polynomial_hash(spark):
    """Thue-Morse words, on which polynomials modulo a power of two agree."""
    bits = [bin(i).count("1") % 2 for i in range(4096)]
    one, two = ("".join("ab"[b ^ side] for b in bits) for side in (0, 1))
    rows = [(1, one), (2, two), (3, one.upper())]
    got = sorted(map(tuple, jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute_components(rows) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]


def test_sent_rows_are_small(spark, monkeypatch):
    """Counting shingles sends them alone, and count vectors, however uneven, travel in half the bytes or as they are."""
    from textveil.llm import jaccard_join

    rng = np.random.default_rng(1)
    for v in (rng.integers(0, 16, 128), rng.integers(0, 200, 256), np.zeros(128, int)):
        v = v.astype(np.uint8)
        x = jaccard_join.narrow(v)
        assert jaccard_join.wide(x) == v.tobytes() and len(x) == (len(v) // 2 if v.max() < 16 else len(v) + 1)
    plans, cut = {}, jaccard_join.cut
    monkeypatch.setattr(jaccard_join, "cut", lambda df, what="t": (plans.setdefault(what, []).append(df._jdf.queryExecution().toString()), cut(df, what))[1])
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(words[:250] + [f"x{i}"] * 6)) for i in range(5)] + [(9, " ".join(["same word again"] * 90)), (10, None)]
    got = sorted(map(tuple, jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute_components(rows) and {c for _, _, c in got} == {0, 9, 10}
    assert "max(node" not in plans["buckets"][0]


def test_forest_spans_components():
    rng = np.random.default_rng(1)
    v = np.repeat(rng.integers(0, 9, (6, 128)), 30, 0).astype(np.uint8)
    n = v.sum(1).astype(np.int64)
    edges = forest(v, n, 80, 100)
    assert len(edges) == 6 * 29


def test_connected(spark):
    edges = [(9, 8), (8, 7), (1, 9), (20, 21), (5, 5), (None, 3), (30, 40), (40, 50), (50, 30), (1, 9)]
    got = {r.node: r.comp for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {9: 1, 8: 1, 7: 1, 1: 1, 20: 20, 21: 20, 30: 30, 40: 30, 50: 30}
    star = spark.range(2000).select(F.lit(5000).cast("long").alias("a"), F.col("id").alias("b"))
    assert {r.comp for r in connected(star).select("comp").distinct().collect()} == {0}


def brute_top(rows, k):
    good = [(i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for m, (q, a) in enumerate(good):
        if q % 2 == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for n, (i, b) in enumerate(good) if n != m and len(a) == len(b))
            out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s[:k])]
    return sorted(out)


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    rows += [(1000 + i, rows[4][1]) for i in range(40)]  # ties
    rows += [(2000, None), (2001, []), (2002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2003, [float("nan")] * 6), (2004, [float("inf")] * 6), (2006, [1.0, 2.0]), (2008, [3.0, 1.0]), (2010, [0.0] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("x")).withColumn("score", F.lit(1))
    got = sorted(tuple(r) for r in ball_tree.top_k(df, F.col("vec_id") % 2 == 0).collect())
    assert got == brute_top(rows, 5)
    assert ball_tree.top_k(df.limit(0), F.col("vec_id") % 2 == 0).count() == 0


def test_top_k_over_shards_and_great_numbers(spark, monkeypatch):
    monkeypatch.setattr(ball_tree, "LEAST_SHARD", 12)
    monkeypatch.setattr(ball_tree, "PIVOTS", 7)
    monkeypatch.setattr(ball_tree, "ROUNDS", (1, 3))
    monkeypatch.setattr(ball_tree, "BLOCK", 5)
    monkeypatch.setattr(ball_tree, "LEAF", 4)
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=3) * (1e5 if i % 7 == 0 else 1)]) for i in range(200)]
    rows += [(400 + i, rows[14][1]) for i in range(60)] + [(500, [0.0] * 3)]  # one hot vector
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in ball_tree.top_k(df, F.col("vec_id") % 2 == 0).collect()) == brute_top(rows, 5)


def test_top_k_of_repeated_ids(spark):
    """Rows that repeat an id are candidates for each other, and each has its own ranks."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [1.0, 0.0]), (1, [2.0, 1.0]), (3, [1.0, 3.0]), (5, [-1.0, 0.5])]
    got = sorted(map(tuple, ball_tree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 0).collect()))
    assert got == brute_top(rows, 5) and len(got) == 15 and sum(r[1] == 1 for r in got) == 3


def test_later_rounds_ask_less(spark, monkeypatch):
    """Cells whose bound is under the k-th score shared after a round aren't asked."""
    monkeypatch.setattr(ball_tree, "LEAST_SHARD", 20)
    rng = np.random.default_rng(6)
    middles = rng.normal(0, 40, (12, 4))
    rows = [(i, [float(x) for x in rng.normal(middles[i % 12], 0.2)]) for i in range(600)]
    asked = []
    of = ball_tree._asked
    monkeypatch.setattr(ball_tree, "_asked", lambda *a: asked.append(a[1:]) or of(*a))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in ball_tree.top_k(df, F.col("vec_id") % 2 == 0).collect()) == brute_top(rows, 5)
    assert asked[0] == (0, 1) and asked[-1][1] is None
    v = np.floor(256 * np.array([v for _, v in rows]))
    cells = ball_tree.Cells({4: v[:12]})
    near, far = cells.nearest(v)
    cells.radius, cells.shards = {4: np.array([far[near == c].max() for c in range(12)])}, {4: np.ones(12, int)}
    kth = np.sort(v @ v.T, 1)[:, -6]
    assert ((cells.bounds(v) >= kth[:, None]).sum(1) < 6).mean() > 0.8


def test_tree_visits_fewer_leaves():
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(c, 0.1, (400, 8)) for c in (-9, 0, 9)]) * 256
    v = np.floor(v)
    best = ball_tree.Best(50, 5, np.full(50, np.iinfo(np.int64).min))
    tree = ball_tree.BallTree.unpacked(ball_tree.BallTree(v, np.arange(len(v)), np.arange(len(v))).packed())
    visits = tree.search(v[-50:], np.full(50, -1), best)
    assert visits < 50 * len(v) / ball_tree.LEAF / 2
    want = np.sort(v[-50:] @ v.T, 1)[:, ::-1][:, :5]
    assert (best.s == want).all()
