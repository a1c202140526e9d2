"""The language model's bits against a plain version that walks one bit at a time."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from textveil.llm import context_mixing as cm
from textveil.llm.common import fold
from textveil.llm.mixing_lm import WordCounts, distinct, learn_spelling, learn_words, score_texts

ENDS, REST = 7, 5
FREQUENT = [(b"the", 30), (b"of", 12), (b"sea", 4), (b"hill", 2)]
BITS = 20


def path(tree, s):
    begin, nodes, bits = tree
    return [(int(nodes[a]), int(bits[a])) for a in range(begin[s], begin[s + 1])]


def texts_of(texts):
    return list(cm.Reader().read(pa.array([b" ".join(t).decode() for t in texts])))


def slow_words(model, words):
    """(node, bit, contexts, what the text foretells 0 to 4) of each bit of one text."""
    number = {w: i + 2 for i, (w, _) in enumerate(FREQUENT)} | {b"": cm.END}
    out, past = [], []
    for w in [*words, b""]:
        lead = next((x for x in reversed(past) if 2 <= number.get(x, 0) < cm.LEADERS + 2), None)
        p1, p2 = past[-1] if past else None, past[-2] if len(past) > 1 else None
        told = None
        for j in range(len(past) - 1, -1, -1):
            if (past[j - 1] if j else None) == p1:
                told, deep = number.get(past[j], cm.ESCAPE), j > 0 and (past[j - 2] if j > 1 else None) == p2
                break
        mine = path(model.tree, number.get(w, cm.ESCAPE))
        other = path(model.tree, told) if told is not None else []
        for d, (node, bit) in enumerate(mine):
            agree = d < len(other) and other[d][0] == node
            out.append((node, bit, [(lead,), (p1,), (p1, p2)], 1 + other[d][1] + 2 * deep if agree else 0))
        past.append(w)
    return out


def slow_spelling(model, word):
    out = []
    for k, byte in enumerate([*word, cm.STOP]):
        before = [word[max(0, k - j) : k] for j in (2, 3)]
        out += [(node, bit, [*before, word[:k]]) for node, bit in path(model.tree, byte)]
    return out


def cell_of(cells, corpus, node, bit, contexts, state, counted):
    out = state << 5 * len(contexts)
    for i, c in enumerate(contexts):
        n = list(corpus[i].get((node, c), (0, 0)))
        n[bit] -= counted
        out |= int(cm.LEVEL[n[0] | n[1] << 8 | 2 << 16]) << 5 * i
    return out


def slow_log_prob(model, corpus, words, counted):
    scale, held, total, length, left = np.ones(model.cells.w.shape[1]), [], 0.0, 512, 512
    schedule = [512, 512, 1024, 2048]
    segment = 0
    for node, bit, contexts, state in slow_words(model, words):
        if not left:
            grad, power = np.zeros(len(scale)), np.full(len(scale), cm.OWN_STEP[1])
            for g, y, p, z in held:
                grad[g] += (y - p) * z
                power[g] += p * (1 - p) * z * z
            scale = np.clip(scale + grad / power * cm.OWN_STEP[0], 0, 3)
            held, segment = [], segment + 1
            left = length = schedule[segment] if segment < len(schedule) else cm.LAST_SEGMENT
        cell = cell_of(model.cells, corpus, node, bit, contexts, state, counted)
        z, gate = float(model.cells.z[cell]), int(model.cells.gate[cell])
        p = 1 / (1 + math.exp(-scale[gate] * z))
        held.append((gate, bit, p, z))
        total += math.log(max(1e-6, p if bit else 1 - p))
        left -= 1
    return total


def some_texts(n=9, most=40):
    rng = random.Random(3)
    pool = [b"the", b"of", b"sea", b"hill", b"the", b"odd", "é日".encode(), b"of"]
    return [[rng.choice(pool) for _ in range(rng.randrange(0, most))] for _ in range(n)]


def made(texts, seed=0):
    model = cm.WordModel(FREQUENT, REST, ENDS)
    counts = [np.zeros(2 << BITS, np.uint32) for _ in range(model.TABLES)]
    for part in (texts[:5], texts[5:]):
        model.count(texts_of(part), counts)
    model = model.with_tables([cm.quantised(n.reshape(-1, 2)) for n in counts])
    model.cells.z = np.random.default_rng(seed).normal(0, 1.5, len(model.cells.z)).astype(np.float32)
    return model


def corpus_of(model, texts):
    corpus = [{} for _ in range(3)]
    for t in texts:
        for node, bit, contexts, _ in slow_words(model, t):
            for i in range(3):
                corpus[i].setdefault((node, contexts[i]), [0, 0])[bit] += 1
    return corpus


def test_scores_equal_the_plain_version():
    texts = some_texts()
    model = made(texts)
    corpus = corpus_of(model, texts)
    (t,) = texts_of(texts)
    got, ids = model.log_probs(t, np.ones(9, bool))
    assert np.allclose(got, [slow_log_prob(model, corpus, x, True) for x in texts], rtol=1e-4)
    assert len(ids) == sum(map(len, texts)) + len(texts)
    texts.append([b"the", b"sea"] * 900 + [b"of", b"odd", b"hill"] * 700)  # many segments
    (t,) = texts_of(texts)
    got, _ = model.log_probs(t, np.zeros(10, bool))
    assert np.allclose(got, [slow_log_prob(model, corpus, x, False) for x in texts], rtol=1e-4)


def test_spelling_equals_the_plain_version():
    words = [b"odd", "é日".encode(), b"x", b"oddly", b"shore", b"shored"]
    times = np.array([3, 1, 2, 1, 1, 4])
    model = cm.Speller(FREQUENT)
    counts = [np.zeros(2 << BITS, np.uint32) for _ in range(model.TABLES)]
    model.count(words[:3], times[:3], counts)
    model.count(words[3:], times[3:], counts)
    model = model.with_tables([cm.quantised(n.reshape(-1, 2)) for n in counts])
    learn_spelling(model, words)
    corpus = [{} for _ in range(3)]
    for w, n in zip(words, times.tolist(), strict=True):
        for node, bit, contexts in slow_spelling(model, w):
            for i in range(3):
                corpus[i].setdefault((node, contexts[i]), [0, 0])[bit] += n
    asked = [*words, b"odds", b"new"]
    for counted in (True, False):
        some = asked[:6] if counted else asked
        want = []
        for w in some:
            z = [(bit, float(model.cells.z[cell_of(model.cells, corpus, node, bit, c, 0, counted)])) for node, bit, c in slow_spelling(model, w)]
            want.append(sum(-math.log1p(math.exp(-x if bit else x)) for bit, x in z))
        assert np.allclose(model.log_probs(some, np.full(len(some), counted)), want, rtol=1e-4)
        assert np.allclose(model.both_log_probs(some)[counted], want, rtol=1e-4)


def test_scores_do_not_depend_on_the_chunk():
    texts = some_texts(30, 900)
    model = made(some_texts(12))
    alone = [model.log_probs(texts_of([t])[0], np.zeros(1, bool))[0][0] for t in texts]
    assert model.log_probs(texts_of(texts)[0], np.zeros(30, bool))[0].tolist() == alone
    assert model.log_probs(texts_of(texts[::-1])[0], np.zeros(30, bool))[0].tolist() == alone[::-1]


def test_learning_lowers_the_cost():
    texts = some_texts(60, 200)
    model = made(texts)
    flat = model.with_tables(model.tables)
    learned = model.with_tables(model.tables)
    learn_words(learned, [b" ".join(t).decode() for t in texts[:40]])
    (t,) = texts_of(texts[40:])
    before, after = (m.log_probs(t, np.ones(20, bool))[0].sum() for m in (flat, learned))
    assert after > before


def test_learning_leaves_out_all_that_a_text_has_counted():
    """Without the learned text's own counts its cells are those of a model that never met it."""
    texts = [[b"odd", b"sea"] * 8, [b"the", b"hill", b"of"] * 3]
    both, other = made(texts), made(texts[1:])
    (t,) = texts_of(texts[:1])
    assert both.bits(t)[0].tolist() == other.bits(t, np.zeros(1, bool))[0].tolist()


def test_what_may_follow_adds_up_to_one():
    model = made(some_texts())
    leaves = []
    for s in range(len(FREQUENT) + 2):
        w = [b"the", b"of"]
        events = slow_words(model, w)
        start = len(events) - len(path(model.tree, cm.END))
        state = [(n, b, c, 0) for (n, b), c in zip(path(model.tree, s), [events[start][2]] * 99, strict=False)]
        p = 1.0
        corpus = corpus_of(model, some_texts())
        for node, bit, contexts, told in state:
            z = float(model.cells.z[cell_of(model.cells, corpus, node, bit, contexts, told, 0)])
            p *= 1 / (1 + math.exp(-z if bit else z))
        leaves.append(p)
    assert abs(sum(leaves) - 1) < 1e-6


def test_huffman_codes_are_optimal_and_prefix_free():
    begin, _, bits = cm.huffman([1, 1, 2, 4, 8])
    assert np.diff(begin).tolist() == [4, 4, 3, 2, 1]
    paths = {tuple(bits[a:b].tolist()) for a, b in zip(begin[:-1], begin[1:], strict=True)}
    assert len(paths) == 5 and all(p[:k] not in paths for p in paths for k in range(1, len(p)))
    assert np.diff(cm.huffman([5])[0]).tolist() == [0]


def test_long_texts_are_cut_between_words():
    rows = ["one two", None, "", "abc " * 30 + "x" * 90 + " last", "tail"]
    parts = list(cm.Reader(40).read(pa.array([r or "" for r in rows])))
    got = {}
    for t in parts:
        for i, r in enumerate(t.rows.tolist()):
            got.setdefault(r, []).extend([t.word(j).decode() for j in range(t.begin[i], t.begin[i + 1])])
            got[r] += [""] * bool(t.whole[i])
    assert got == {i: [*(r or "").split(), ""] for i, r in enumerate(rows)} and len(parts) > 4
    assert cm.pieces(b"x" * (cm.PIECE + 5)) == [b"x" * cm.PIECE, b"xxxxx"]


def test_segments_double():
    def plain(n):
        sizes = [512, 512, 1024, 2048] + [4096] * 99
        out, k = [], 0
        while n > 0:
            out += [2 * k + (n <= sizes[k])] * min(n, sizes[k])
            n, k = n - sizes[k], k + 1
        return out

    for n in (0, 1, 511, 512, 513, 1024, 2048, 4096, 5000, 8192, 8193, 20_000, 12_288):
        assert cm.segments(n).tolist() == plain(n)


def test_numbers_of_words():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    h[1:40] = (h[0] >> np.uint64(50) << np.uint64(50)) + np.arange(1, 40, dtype=np.uint64)  # one slot of the first probe
    other = rng.integers(0, 1 << 63, 3000).astype(np.uint64) | np.uint64(1 << 63)
    numbers = cm.Numbers(h)
    assert numbers.of(np.r_[h, other]).tolist() == [*range(5000), *[-1] * 3000] and len(numbers.rest)
    assert cm.Numbers(h[:0]).of(other[:3]).tolist() == [-1] * 3


def test_word_counts():
    counts = WordCounts()
    rows = ["The the of", "", "of OF sea " + "Long" * 20, "the " * 5]
    parts = list(cm.Reader(20).read(pa.array(rows)))
    counts.add(parts[:2])
    counts.add(parts[2:])
    assert dict(zip(counts.words, counts.counts().tolist(), strict=True)) == {b"the": 7, b"of": 3, b"sea": 1, b"long" * 20: 1}


def test_distinct_hashes():
    rng = np.random.default_rng(4)
    for h in (rng.integers(0, 50, 400).astype(np.uint64) << np.uint64(50), rng.integers(0, 9, 64).astype(np.uint64), np.empty(0, np.uint64)):
        u, place, c = distinct(h)
        want = np.unique(h, return_counts=True)
        assert u.tolist() == want[0].tolist() and c.tolist() == want[1].tolist() and h[place].tolist() == u.tolist()


def test_levels_keep_predictions():
    level, odds = cm.LEVEL, cm.ODDS
    assert level.max() == len(odds) - 1 < 1 << cm.LEVEL_BITS and len(cm.SURE) == len(odds)
    for n0, n1 in ((0, 0), (1, 0), (0, 2), (5, 5), (200, 3), (254, 254), (90, 30)):
        assert abs(float(odds[level[n0 | n1 << 8 | 2 << 16]]) - math.log((n1 + cm.PRIOR) / (n0 + cm.PRIOR))) <= 0.41
    # a count of the bit itself taken out
    assert level[5 | 3 << 8] == level[4 | 3 << 8 | 2 << 16] and level[5 | 3 << 8 | 1 << 16] == level[5 | 2 << 8 | 2 << 16]


def test_great_counts_keep_their_ratio():
    pair = int(cm.quantised(np.array([[330_361, 43_331]]))[0])
    assert abs((pair >> 8) / ((pair >> 8) + (pair & 255)) - 43_331 / 373_692) < 0.01
    assert int(cm.quantised(np.array([[10**6, 1]]))[0]) >> 8 == 1
    assert cm.table_bits(0) == cm.LEAST_BITS < cm.table_bits(50_000_000) <= cm.MOST_BITS


def test_repeated_text_scores_better():
    texts = some_texts(40)
    model = made([*texts, [b"odd", b"sea", b"hill", b"sea", b"odd"] * 4])
    model = model.with_tables(model.tables)
    learn_words(model, [b" ".join(t).decode() for t in texts])
    (t,) = texts_of([[b"odd", b"sea", b"hill", b"sea", b"odd"], [b"sea", b"odd", b"sea", b"odd", b"hill"]])
    seen, new = model.log_probs(t, np.zeros(2, bool))[0]
    assert seen > new


def test_weights_are_learned_from_every_learned_text_and_word(spark, monkeypatch):
    """However many and long they are: all bits meet in the cells, and how rows are dealt out changes nothing."""
    rng, seen = random.Random(5), []
    rows = [(i, " ".join(rng.choice(["the", "of", "sea", "hill", f"w{i}"]) for _ in range(rng.randrange(9)))) for i in range(1_500)]
    rows += [(1_500 + i, " ".join(rng.choice(["the", "of", f"v{j}"]) for j in range(7_000))) for i in range(3)]
    rows.append((1_600, "long" * 40))
    docs, fit = spark.createDataFrame(rows, "doc_id long, text string"), cm.Cells.fit

    def fitted(cells, groups):
        seen.append(np.array(groups))
        fit(cells, groups)

    monkeypatch.setattr(cm.Cells, "fit", fitted)
    one, two = (sorted(map(tuple, score_texts(docs.repartition(n)).select("doc_id", "score").collect())) for n in (1, 5))
    assert one == two and [x.tolist() for x in seen[:2]] == [x.tolist() for x in seen[2:]]

    learned = [t.encode().split() for i, t in rows if fold(i, 7) != 2]
    assert any(len(t) == 7_000 for t in learned) and len(learned) > 1_000
    counts = Counter(w for t in learned for w in t)
    coded = sorted(((w, c) for w, c in counts.items() if 1 < c and len(w) <= 64), key=lambda x: (-x[1], x[0]))
    model = cm.WordModel(coded, sum(counts.values()) - sum(c for _, c in coded), len(learned))
    bits = [int(cm.Paths(model.tree, model.symbols(t)[0]).size.sum()) for t in texts_of(learned)]
    spelled = [w for w in counts if w not in dict(coded)]
    assert b"long" * 40 in spelled and seen[0].sum() == sum(bits)
    assert seen[1].sum() == sum(cm.Paths(cm.Speller(coded).tree, np.array([*w, cm.STOP])).size.sum() for w in spelled)


def test_four_bits_are_counted_and_looked_up_at_once():
    """What a block's bits make is all that is counted; pairs follow from it as if each bit were."""
    rng = np.random.default_rng(6)
    leaves = rng.integers(0, 9, 64)
    want = np.zeros((64, 2), int)
    for at, n in enumerate(leaves.tolist()):
        for j in range(4):
            node = (1 << j) - 1 + ((at & 15) >> 4 - j)
            want[(at & ~15) + node, (at >> 3 - j) & 1] += n
    assert cm.pairs_of(leaves).tolist() == want.tolist()
    tree = cm.huffman([2**i for i in range(12)])
    symbols = np.arange(12)
    path = cm.Paths(tree, symbols)
    places = path.slots(0, np.full(12, 1 << 40, np.uint64), BITS)
    assert len(places) == sum(-(-n // 4) for n in path.size.tolist()) < path.size.sum() / 2
    assert [int(x) for x in path.block_size] == [k for n in path.size.tolist() for k in [4] * (n // 4) + [n % 4] * (n % 4 > 0)]
