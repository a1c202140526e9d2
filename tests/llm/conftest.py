import random

import pytest

WORDS = ["the", "of", "and", "that", "erre", "onth", "ingly", "thent", "ouble", "stre", "handor", "tion", "ereth", "ander", "nthe", "owls"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, node long, spans string"


def sentence(rng, n=12):
    return " ".join(rng.choices(WORDS, k=n)).capitalize() + "."


def text(rng, n=80):
    return " ".join(sentence(rng) for _ in range(max(1, n // 12)))


@pytest.fixture(scope="session")
def rng():
    return random.Random(17)


@pytest.fixture(scope="session")
def odd_rows(rng):
    """Rows with nulls, empty, blank and very long texts, repeated rows, ties and near copies."""
    base = [text(rng, rng.randrange(20, 200)) for _ in range(40)]
    rows = list(enumerate(base))
    near = base[3].split()
    for i in range(12):
        w = list(near)
        for _ in range(i // 3):
            w[rng.randrange(len(w))] = "edited%d" % i
        rows.append((100 + i, " ".join(w)))
    rows += [(200, base[5]), (201, base[5].upper()), (202, base[5].replace(" ", "\t\n")), (5, base[5])]
    rows += [(300, None), (301, ""), (302, "  \n\t "), (303, "one two"), (304, "one two"), (305, "One  two"), (None, base[7]), (None, None), (None, "lonely text of a row without id")]
    rows += [(400, text(rng, 6000)), (401, "x" * 50_000), (402, "é日本 ñ\x1c\x85 été"), (403, "\x00\x01 a b c d e")]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The same with columns whose names meet those that operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", None, "w", 1, "x") for i, t in odd_rows], SCHEMA).repartition(3)
