"""Benchmark decontamination: n-gram seeds and Smith-Waterman alignment.

Word n-grams of the test items are seeds. One pass over the training texts finds the
places where one stands (a bit filter of fixed size tells which n-grams to send) and
cuts *passages* around them, long enough for the longest item. A passage meets every
item that it shares a seed with, however common the seed is, and word-level
Smith-Waterman alignment scores each pair, so copies that were edited or paraphrased
in part are found as well. Pairs whose common words can't reach the score wanted
aren't aligned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitfilter import bit_filter, flagged, passes
from .common import FlatWords, batch, cut, keep_only, last_written, runs, small_batches, table, written

SEED = 4  # words
MATCH, MISMATCH, GAP = 2, -1, -1
SIMILAR = 0.4  # of the greatest score an item can have
LEAST_WORDS = 8  # items with fewer words can't be told from chance and match only where they stand unchanged


def separators() -> np.ndarray:
    """Everything in ASCII but letters and digits parts words."""
    return np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """(best score, first, end) of the local alignment of an item in a passage.

    A row at a time: the gap along the row is a running maximum. Next to each score
    the place where its path began is carried on.
    """
    n = len(words)
    h, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    steps = np.arange(n + 1) * -GAP
    best = (0, 0, 0)
    for x in item:
        diag = h[:-1] + np.where(words == x, MATCH, MISMATCH)
        up = h[1:] + GAP
        new, src = np.zeros(n + 1, np.int64), np.arange(n + 1)
        take = diag >= up
        new[1:] = np.where(take, diag, up)
        src[1:] = np.where(take, begin[:-1], begin[1:])
        dead = new <= 0
        new[dead] = 0
        src[dead] = np.flatnonzero(dead)
        run = new + steps
        top = np.maximum.accumulate(run)
        at = np.maximum.accumulate(np.where(run == top, np.arange(n + 1), 0))
        along = top - steps
        better = along > new
        new = np.where(better, along, new)
        src = np.where(better, src[at], src)
        h, begin = new, src
        j = int(h.argmax())
        if h[j] > best[0]:
            best = (int(h[j]), int(begin[j]), j)
    return best


def _items():
    schema = pa.schema([("item", pa.int64()), ("words", pa.binary()), ("seeds", pa.list_(pa.int64()))])

    def run(batches):
        flat = FlatWords(space=separators())
        for b in batches:
            words, seeds = [], []
            for _, h, begin in flat.chunks(b.column(1)):
                for x, y in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                    words.append(h[x:y].tobytes())
                    seeds.append(np.unique(runs(h[x:y], min(SEED, y - x)) if y > x else h[:0]).view(np.int64))
            yield batch(schema, item=b.column(0), words=words, seeds=seeds)

    return run, "item long, words binary, seeds array<long>"


def _seeds(h: np.ndarray, begin: np.ndarray, lengths: list[int]):
    """(places, seeds) of the runs of each length that lie within one row."""
    where, seeds = [], []
    row_end = np.repeat(begin[1:], np.diff(begin))
    for k in lengths:
        s = runs(h, k)
        at = np.flatnonzero(np.arange(len(s)) + k <= row_end[: len(s)])
        where.append(at)
        seeds.append(s[at])
    return np.concatenate(where), np.concatenate(seeds)


def _passages(bits, margin: int, lengths: list[int]):
    """``lengths`` are the seeds' own: ``SEED``, and the sizes of items with fewer words."""
    schema = pa.schema([("doc", pa.int64()), ("row", pa.int64()), ("at", pa.int64()), ("words", pa.binary()), ("seeds", pa.list_(pa.int64()))])

    def run(batches):
        packed, flat = np.frombuffer(bits.value, np.uint8), FlatWords(space=separators())
        for b in batches:
            out: list[list] = [[] for _ in schema]
            for first, h, begin in flat.chunks(b.column(1)):
                where, seed = _seeds(h, begin, lengths)
                hit = passes(packed, seed.view(np.int64))
                where, seed = where[hit], seed[hit]
                if not len(where):
                    continue
                order = np.argsort(where, kind="stable")
                where, seed = where[order], seed[order].view(np.int64)
                row_of = np.searchsorted(begin, where, "right") - 1
                lo = np.flatnonzero(np.r_[True, (row_of[1:] != row_of[:-1]) | (where[1:] - where[:-1] > margin)])
                for a, z in zip(lo.tolist(), np.r_[lo[1:], len(where)].tolist(), strict=True):
                    r = int(row_of[a])
                    start, end = max(int(begin[r]), int(where[a]) - margin), min(int(begin[r + 1]), int(where[z - 1]) + SEED + margin)
                    for c, x in zip(out, (b.column(0)[first + r].as_py(), b.column(2)[first + r].as_py(), start - int(begin[r]), h[start:end].tobytes(), np.unique(seed[a:z])), strict=True):
                        c.append(x)
            yield batch(schema, **dict(zip(schema.names, out, strict=True)))

    return run, "doc long, row long, at long, words binary, seeds array<long>"


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """(id, row, item, similarity double, first_word long, end_word long): the best place of
    each item in each text that holds it, ``similarity`` being the alignment score over
    the greatest one possible; ``row`` is the text's xxhash64.

    Items and texts that are null or without a word match nothing; items of fewer than
    ``LEAST_WORDS`` words match only where they stand unchanged, as part of a text or as all
    of it. Rows that repeat give
    one result, as do repeated items. Null ids are kept.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("txt")).filter("txt is not null").distinct()
    run, schema = _items()
    items = cut(items.mapInArrow(run, schema).filter("size(seeds) > 0").withColumn("key", F.xxhash64("item", "words")), "items")
    longest = items.agg(F.max(F.length("words"))).first()[0]
    seeds = cut(items.select("key", F.explode("seeds").alias("s")), "seeds")
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("txt"), F.xxhash64(text_col).alias("row"))
    short = [r.n // 8 for r in items.select(F.length("words").alias("n")).filter(F.col("n") < 8 * SEED).distinct().collect()]
    run, schema = _passages(bit_filter(seeds, "s"), (longest or 0) // 8 * 5 // 4 + 8, [*sorted(short), SEED])
    passages = rows.mapInArrow(run, schema).withColumn("pid", F.xxhash64("doc", "row", "at"))
    passages = cut(passages, "passages").dropDuplicates(["doc", "row", "at"])
    found = passages.select("pid", F.explode("seeds").alias("s"))
    pairs = cut(found.join(seeds, "s").select("pid", "key").distinct(), "pairs")
    both = pairs.join(passages.select("pid", "doc", "row", "at", F.col("words").alias("there")), "pid").join(items.select("key", "item", "words"), "key")
    out_schema = pa.schema([("doc", pa.int64()), ("row", pa.int64()), ("item", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())])

    def score(batches):
        for b in batches:
            keep, sim, lo, hi = [], [], [], []
            for i, (at, there, words) in enumerate(zip(b.column(3).to_pylist(), b.column(4), b.column(5), strict=True)):
                item, passage = (np.frombuffer(z.as_buffer(), np.uint64) for z in (words, there))
                least = similar if len(item) >= LEAST_WORDS else 1.0
                if np.isin(item, passage).mean() < least:  # no alignment matches more words
                    continue
                s, x, y = align(item, passage)
                s /= MATCH * len(item)
                if s >= least:
                    keep.append(i)
                    sim.append(s)
                    lo.append(at + x)
                    hi.append(at + y)
            some = pa.array(keep, pa.int64())
            yield batch(out_schema, doc=b.column(0).take(some), row=b.column(1).take(some), item=b.column(2).take(some), similarity=sim, first_word=lo, end_word=hi)

    hits = both.select("doc", "row", "item", "at", "there", "words").mapInArrow(score, "doc long, row long, item long, similarity double, first_word long, end_word long")
    best = hits.groupBy("doc", "row", "item").agg(F.max_by(F.struct("similarity", "first_word", "end_word"), F.struct("similarity", -F.col("first_word"))).alias("b"))
    return best.select(F.col("doc").alias(id_col), "row", F.col("item").alias(item_col), "b.similarity", "b.first_word", "b.end_word")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


def contaminated_removed(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no item, with all their columns; only rows that may go are moved."""
    mark = written()
    bad = contaminated(docs, benchmark, id_col, text_col).select(F.col(id_col).alias("__id"), F.col("row").alias("__row")).distinct()
    bad = cut(bad.withColumn("__bad", F.lit(True)), "bad")
    keep_only(docs.sparkSession, mark, last_written())
    rest, met = flagged(docs, bad, id_col, text_col)
    return rest.unionByName(met.filter("__bad is null").select(docs.columns))
