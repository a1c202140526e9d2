import hashlib

import pytest

import corpus_pipeline
from textveil.llm.common import cut, environ_path
from textveil.llm.jaccard_join import brute_components
from textveil.llm.substring_dedup import brute_spans, cut_out

SF = "/root/testdata/sf0.001"
NAMES = ["quality classifier", "n-gram Jaccard join", "substring dedup", "benchmark decontamination", "BPE encoding and decoding"]


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    n, now = docs.count(), docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = cut(stage(spark, now, SF))
        assert now.count() <= n
        n = now.count()
        if i < 4:
            assert now.columns == docs.columns and now.dtypes == docs.dtypes
    assert now.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and n > 0


@pytest.fixture(scope="module")
def odd_dir(spark, odd_rows, tmp_path_factory):
    """Odd rows beside real ones, with repeats and null ids, clashing extra columns and a test item."""
    root = str(tmp_path_factory.mktemp("odd"))
    real = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    item = " ".join(f"item{i}" for i in range(30))
    rows = [(*r, 1, "x") for r in real] + [(None if i is None else 10_000 + i, t, "en", "s", len(t) if t else None, 2, "y") for i, t in odd_rows]
    rows += [(20_000, f"before it {item} after it", "en", "s", None, None, None), (None, "shared line of nine words under no id here\nown one", None, None, 5, 1, "z"), (None, "shared line of nine words under no id here\nown two", None, None, 5, 1, "z")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row int, removed_spans string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_stages_on_odd_rows_equal_plain_versions(spark, odd_dir):
    from tokenizers import Tokenizer

    now, rows = spark.read.parquet(f"{odd_dir}/documents.parquet"), []
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in now.select("doc_id", "text").collect()]
        now = cut(stage(spark, now, odd_dir))
        if name != NAMES[4]:
            assert now.columns == columns
            rows = [tuple(r) for r in now.select("doc_id", "text").collect()]
        if name == NAMES[0]:
            assert rows and set(rows) <= set(before)
        if name == NAMES[1]:
            unique = sorted(set(before), key=repr)
            label = [c for _, _, c in brute_components([(i, t) for i, (_, t) in enumerate(unique)])]
            groups: dict = {}
            for (doc, text), c in zip(unique, label, strict=True):
                groups.setdefault(c, []).append((doc, text))
            assert len(rows) == len(set(rows)) == len(groups)
            for members in groups.values():
                least = min((float("inf") if d is None else d) for d, _ in members)
                (kept,) = [m for m in members if m in set(rows)]
                assert (float("inf") if kept[0] is None else kept[0]) == least
        if name == NAMES[2]:
            lost = brute_spans(before)
            want = [(d, cut_out(t, [(a, b) for a, b, _ in lost[d, t]]) if (d, t) in lost else t) for d, t in before]
            assert sorted(rows, key=repr) == sorted(want, key=repr)
        if name == NAMES[3]:
            assert sorted(rows, key=repr) == sorted((r for r in before if r[0] != 20_000), key=repr)
        if name == NAMES[4]:
            library = Tokenizer.from_file(environ_path("byte_bpe_50k.json"))
            library.no_truncation()
            library.no_padding()
            want = []
            for d, t in before:
                ids = library.encode(t or "", add_special_tokens=False).ids
                text = library.decode(ids, skip_special_tokens=False)
                want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
            assert sorted(map(tuple, now.collect()), key=repr) == sorted(want, key=repr)


def test_run_on_empty_tables(spark, odd_dir, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{odd_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
