import random

import pytest
from tokenizers import Tokenizer

from textveil.llm.bpe_lexicon import Codec, Transducer, Vocabulary, decode, encode, mapped
from textveil.llm.common import environ_path

PATH = environ_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def theirs():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.read(PATH)


def texts():
    rng = random.Random(3)
    chars = list("aaeehtnioust  \n\t.,!'0123456789<|>é日本語ßñ  ‍😀\x1c\x85ÅﬁǅЖ")
    out = ["", " ", "a", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "don't WE'LL 'tis", "a" * 500, "ab" * 300 + "é" * 90, " " * 400, "\r\n\r\n x", "the of and " * 50]
    return out + ["".join(rng.choices(chars, k=rng.randrange(1, 120))) for _ in range(400)]


def test_codec_equals_the_library(theirs, vocabulary):
    words = [b" the", b" of", b" and", b" t", b" th", b"a", b"the"]
    lexicon = mapped(Transducer.compile(dict(zip(words, vocabulary.merge(words), strict=True))))
    codec, all_texts = Codec(vocabulary, lexicon), texts()
    for t, (ids, text) in zip(all_texts, codec.batch(all_texts), strict=True):
        want = theirs.encode(t, add_special_tokens=False).ids
        assert [int(i) for i in ids.split(",") if i] == want, t
        assert text == theirs.decode(want, skip_special_tokens=False) == t


def test_transducer_holds_its_words_only(vocabulary):
    words = [b"ab", b"abc", b"xbc", b"b", b"zzz", b"yzzz"]
    t = mapped(Transducer.compile({w: [i, i + 1] for i, w in enumerate(words)}))
    assert t.find(words) == [[i, i + 1] for i in range(6)]
    assert t.find([b"", b"a", b"abcd", b"zz", b"q"]) == [None] * 5
    assert len(t.final) < sum(map(len, words))  # suffixes are shared
    assert mapped(Transducer.compile({})).find([b"a"]) == [None]


def test_frame_round_trip_and_odd_rows(spark, theirs):
    rows = [(1, "the cat", "x"), (1, "the cat", "x"), (None, "no id", None), (2, None, "y"), (3, "", "z"), (4, "word " * 30_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = encode(df)
    back = decode(got, out_col="again").collect()
    assert len(back) == len(rows)
    for r, (i, t, _) in zip(sorted(back, key=lambda r: (r.doc_id is None, r.doc_id or 0)), sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)), strict=True):
        assert r.doc_id == i and r.decoded == r.again == (t or "") and r.n_tokens == len(r.ids)
        assert r.ids == theirs.encode(t or "", add_special_tokens=False).ids
    assert encode(df.limit(0), digests=True).count() == 0
