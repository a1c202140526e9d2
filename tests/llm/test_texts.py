"""Substring dedup, decontamination, token counts and language model against plain versions."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from textveil.llm.common import environ_path, fold, lowered_words
from textveil.llm.decontaminate import align, contaminated, contaminated_removed
from textveil.llm.mixing_lm import score_texts
from textveil.llm.substring_dedup import LAST, brute_spans, cut_out, repeated_spans, units, without_repeats
from textveil.llm import token_counts as token_module
from textveil.llm.token_counts import Counter as TokenCounter
from textveil.llm.token_counts import brute_count, token_counts, unigram_costs

from .conftest import sentence, text


def test_units_keep_offsets():
    t = "Short line.\n  One two three four five six seven eight.  Then a b c d e f g h! x\nend"
    got = list(units(t))
    assert [t[a:b] for a, b, _ in got] == ["One two three four five six seven eight.  Then a b c d e f g h! x", "One two three four five six seven eight.", "Then a b c d e f g h!"]
    assert got[1][2] == "one two three four five six seven eight."


def test_repeats_equal_brute_force(spark, odd_docs, odd_rows, rng):
    shared = " ".join(sentence(rng) for _ in range(6))
    rows = [*odd_rows, (500, text(rng, 60) + "\n" + shared), (501, "Before it " + shared + " and after"), (502, shared), (503, "No line of this one stands anywhere else in all the rows.")]
    # rows without an id, and of one id with unlike texts, that share a passage
    rows += [(None, "lead one\n" + shared), (None, "lead two\n" + shared), (None, "\n".join(["a line without any id that stands in two rows"] * 2)), (None, "x\na line without any id that stands in two rows")]
    rows += [(-4, "this line of nine words stands under one id\nonce"), (-4, "this line of nine words stands under one id\ntwice"), (505, "\n".join(["this line of nine words stands under one id"] * 2))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hashes = {r.h: r.text for r in df.select(F.xxhash64("text").alias("h"), "text").collect()}
    got = {(None if r.doc == LAST else r.doc, hashes[r.row]): [(s.start, s.end, s.first_doc) for s in r.spans] for r in repeated_spans(df).collect()}
    assert got == {k: sorted(set(v), key=lambda x: (x[0], x[1], LAST if x[2] is None else x[2])) for k, v in brute_spans(rows).items()}
    assert sum(k[0] is None for k in got) >= 3 and sum(k[0] == -4 for k in got) == 1
    out = {r.doc_id: r.text for r in without_repeats(df).collect()}
    assert out[500].endswith(shared) and out[502] == "" and len(out[501]) < len(shared) and out[503].startswith("No line of this")
    kept = without_repeats(odd_docs)
    assert kept.count() == odd_docs.count() and kept.drop("removed_spans").columns == odd_docs.columns
    assert without_repeats(odd_docs.limit(0)).count() == 0


def test_cut_out():
    assert cut_out("a\nbb\nc", [(2, 4)]) == "a\nc" and cut_out("a\nbb", [(2, 4)]) == "a"
    assert cut_out("x. yy. z.", [(3, 6)]) == "x. z." and cut_out("abc", [(0, 3)]) == ""


def test_repeats_of_short_pieces(spark):
    """Verse, text wrapped elsewhere and text without blanks go whole, though no line of theirs has 8 words."""
    verse = "\n".join(f"line {i} of the song" for i in range(12))
    prose = "The quick brown fox jumps over the lazy dog today. Short one. Then it sleeps until the sun comes up again"
    signs = "春眠不覺曉處處聞啼鳥夜來風雨聲花落知多少。"
    wrap = lambda n: "\n".join(" ".join(prose.split()[i : i + n]) for i in range(0, 21, n))
    rows = [(1, verse), (2, "Another title\n" + verse + "\nits end"), (3, wrap(5)), (4, wrap(7)), (5, signs), (6, "不同的開頭。" + signs + "完"), (7, "few words\nof its own"), (8, "few words\nof its own")]
    out = {r.doc_id: r.text for r in without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == dict(rows) | {2: "Another title\nits end", 4: "", 6: "不同的開頭。完"}


def test_repeats_inside_a_text_keep_one_whole(spark):
    out = without_repeats(spark.createDataFrame([(1, "\n".join(["la la"] * 20))], "doc_id long, text string")).first().text
    assert out == "\n".join(["la la"] * 4)


def slow_align(item, words):
    best = 0
    h = [[0] * (len(words) + 1) for _ in range(len(item) + 1)]
    for i in range(1, len(item) + 1):
        for j in range(1, len(words) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if item[i - 1] == words[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_scores():
    import numpy as np

    rng = random.Random(8)
    for _ in range(60):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 14))] for _ in range(2))
        s, x, y = align(np.array(a), np.array(b))
        assert s == slow_align(a, b)
        if s:
            assert slow_align(a, b[x:y]) == s


def test_decontamination(spark, odd_docs):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("abcdefghijkl", k=6)) for _ in range(3000)]
    item = lambda: " ".join(rng.choices(vocabulary, k=40))
    items = [(i, item()) for i in range(6)] + [(6, None), (7, ""), (8, "too short"), (0, "another text of item nought with some words in it for once")]
    edited = items[1][1].split()
    for i in range(0, 40, 7):
        edited[i] = "changed"
    del edited[10]
    rows = [(1, "Before, " + items[0][1].replace(" ", "\n").upper() + "! after"), (2, item() + " " + " ".join(edited)), (3, item()), (4, items[2][1] + " " + items[3][1]), (5, " ".join(items[4][1].split()[:8]) + " " + item()), (6, None), (7, ""), (None, items[5][1]), (8, "too short"), (1, "Before, " + items[0][1].replace(" ", "\n").upper() + "! after")]
    rows += [(100 + i, "head " + items[2][1] + f" tail{i}") for i in range(60)]  # a very common passage
    docs = spark.createDataFrame([(*r, "k", 3) for r in rows], "doc_id long, text string, key string, row int")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in contaminated(docs, benchmark).collect()}
    assert set(got) == {(1, 0), (2, 1), (4, 2), (4, 3), (None, 5), (8, 8)} | {(100 + i, 2) for i in range(60)}
    assert got[1, 0].similarity == 1.0 and got[1, 0].first_word == 1 and 0.4 < got[2, 1].similarity < 0.9
    left = contaminated_removed(docs, benchmark)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {3, 5, 6, 7}
    assert contaminated(docs.limit(0), benchmark).count() == 0 and contaminated(docs, benchmark.limit(0)).count() == 0
    assert contaminated(odd_docs, benchmark).count() == 0


def test_decontamination_equals_brute_force(spark):
    """Every text against every item: a shared seed, then the plain alignment of whole texts."""
    import re

    rng = random.Random(31)
    vocabulary = ["ab", "Cd", "ef", "GH", "ij", "kl", "mn"]
    made = lambda lo, hi: " ".join(rng.choices(vocabulary, k=rng.randrange(lo, hi))) + rng.choice(["", ".", "!? "])
    items = [(i, made(1, 14)) for i in range(25)] + [(90, ""), (91, None), (3, made(9, 12))]
    docs = [(i, made(0, 24)) for i in range(60)] + [(200, None), (None, made(8, 20)), (5, made(8, 20))]
    words = lambda t: [w.lower() for w in re.split(r"[^0-9A-Za-z]+", t or "") if w]
    want: dict = {}
    for d, text in set(docs):
        there = words(text)
        for i, item in set(items):
            mine = words(item)
            k = min(4, len(mine))
            if not k or not {tuple(mine[a : a + k]) for a in range(len(mine) - k + 1)} & {tuple(there[a : a + k]) for a in range(len(there) - k + 1)}:
                continue
            similarity = slow_align(mine, there) / (2 * len(mine))
            if similarity >= (0.4 if len(mine) >= 8 else 1.0):
                key = (d, text, i)
                want[key] = max(similarity, want.get(key, 0))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    texts = {r.h: r.text for r in df.select(F.xxhash64("text").alias("h"), "text").collect()}
    found = contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, texts[r.row], r.item_id): r.similarity for r in found}
    assert len(found) == len(got) and got == want and len(want) > 100


def test_short_items_inside_longer_texts(spark):
    docs = [(1, "this is much too short to matter at all"), (2, "too. SHORT"), (3, "short too"), (4, "one"), (5, "five words stand here now"), (6, "all five words stand here, now then"), (7, "five words stand there now")]
    items = [(0, "too short"), (1, "one"), (2, "five words stand here now"), (3, "much too short")]
    found = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): (r.first_word, r.end_word, r.similarity) for r in found.collect()}
    assert got == {(1, 0): (3, 5, 1.0), (1, 3): (2, 5, 1.0), (2, 0): (0, 2, 1.0), (4, 1): (0, 1, 1.0), (5, 2): (0, 5, 1.0), (6, 2): (1, 6, 1.0)}


def test_decontamination_by_common_seeds(spark):
    """One whole copy must not make the seeds that many partial copies share too common."""
    words = [f"w{i}" for i in range(43)]
    half = " ".join(words[:22])
    docs = spark.createDataFrame([(i, f"head{i} {half} tail{i}") for i in range(50)] + [(99, " ".join(words))], "doc_id long, text string")
    benchmark = spark.createDataFrame([(0, " ".join(words))], "item_id long, text string")
    got = {r.doc_id: r.similarity for r in contaminated(docs, benchmark).collect()}
    assert got == {i: 22 / 43 for i in range(50)} | {99: 1.0}


def test_token_counts(spark, odd_docs, odd_rows):
    costs = unigram_costs(environ_path("piece_bpe_32k.model"))
    got = token_counts(odd_docs).collect()
    known: dict = {}

    def total(t):
        words = (t or "").split()
        for w in words:
            if w not in known:
                known[w] = brute_count(w, costs)
        return len(words), sum(known[w] for w in words)

    have = sorted(((r.doc_id, r.n_pretokens, r.n_tokens) for r in got), key=repr)
    assert have == sorted(((i, *total(t)) for i, t in odd_rows), key=repr)
    assert token_counts(odd_docs.limit(0)).count() == 0


def test_shared_prefixes_count_alike(rng, monkeypatch):
    costs = unigram_costs(environ_path("piece_bpe_32k.model"))
    words = {"".join(rng.choices("theandinrs日é😀", k=rng.randrange(1, 14))) for _ in range(800)}
    counter = TokenCounter(costs)
    some = sorted(words)
    counter.learn(set(some[::3]))
    nodes = len(counter.cost)
    counter.learn(words)
    assert all(counter.known[w] == brute_count(w, costs) for w in words)
    # one node for each distinct prefix, whatever order they came in
    assert nodes < len(counter.cost) == len({w[:i] for w in words for i in range(len(w) + 1)})
    monkeypatch.setattr(token_module, "NODES", 300)
    monkeypatch.setattr(token_module, "ALONE", 30)
    small = TokenCounter(costs)
    long = "".join(rng.choices("theandinrs日é😀", k=500))
    for lo in range(0, len(some), 40):
        part = {*some[lo : lo + 40], long}
        small.learn(part)
        assert all(small.known[w] == brute_count(w, costs) for w in part) and len(small.cost) < 1200


def test_language_model(spark, odd_docs, odd_rows):
    got = score_texts(odd_docs).collect()
    assert len(got) == len(odd_rows)
    train: Counter = Counter()
    for i, t in odd_rows:
        if fold(i, 7) != 2:
            train.update([*lowered_words(t), b""])
    n, v = sum(train.values()), len(train)
    want = {}
    for i, t in odd_rows:
        w = [*lowered_words(t), b""]
        want.setdefault((i, len(w)), (fold(i, 7) == 2, sum(train[x] > 0 for x in w), sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w)))
    for r in got:
        held, known, base = want[r.doc_id, r.n_tokens]
        assert (r.held_out, r.n_known, r.train_tokens) == (held, known, n) and abs(r.base_score - base) < 1e-6 * max(1, abs(base))
        assert r.score < 0 and math.isfinite(r.score)
    usual = [r for r in got if r.n_tokens > 30 and r.doc_id not in (401, 402, 403)]
    # a learned text is scored without its own counts, so it is held against base scores without them
    alike = {(i, len(w)): sum(math.log10((train[x] + (fold(i, 7) == 2)) / (n + v + 1)) for x in w) for i, w in ((i, [*lowered_words(t), b""]) for i, t in odd_rows)}
    assert sum(r.score for r in usual) > sum(alike[r.doc_id, r.n_tokens] for r in usual)
    unseen = [r for r in usual if r.held_out]
    assert unseen and sum(r.score for r in unseen) > sum(r.base_score for r in unseen)
    assert score_texts(odd_docs.limit(0)).count() == 0
    again = score_texts(odd_docs.repartition(7, "text")).collect()
    assert sorted(((r.doc_id, r.score) for r in again), key=repr) == sorted(((r.doc_id, r.score) for r in got), key=repr)


def test_fold_columns(spark, odd_docs):
    from textveil.llm.common import fold_col

    for r in odd_docs.select("doc_id", fold_col(F.col("doc_id"), 5).alias("k")).collect():
        assert r.k == fold(r.doc_id, 5)
