"""Substring dedup by line and sentence hashing.

A text's pieces are its lines, cut at the ends of sentences, and the sentences that go
on over line breaks. Pieces, whole lines and *runs* are units. A run starts or ends at
any piece and takes its neighbours in until it has ``MIN_WORDS`` words, across line
breaks and blank lines, so whatever whole pieces a repeated passage of that length is
made of, each is in a unit that repeats; a shorter phrase that many texts share is left
alone. Scripts without blanks between words count by characters. Units are normalised
(case folded, white space collapsed) and digested to 128 bits. Digests are grouped over
all texts by a combining aggregate on (least id, count); the occurrence of the least
id, and in it the first, stays, and all others are removed. Their spans keep the
original character offsets. Sentences catch a passage that was pasted inside another
line or wrapped at other places.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitfilter import bit_filter, flagged, passes
from .common import batch, cut, encoded, keep_only, last_written, small_batches, table, worker_memory, written

MIN_WORDS = 8
LAST = (1 << 63) - 1  # stands for a null id: such rows rank last
SPREAD = 1 << 62


def ranked(doc: str, row: str):
    """The rank of an occurrence as one number: by id, then by the hash of its text."""
    return F.col(doc).cast("decimal(19,0)") * F.lit(SPREAD).cast("decimal(19,0)") + F.pmod(F.col(row), F.lit(SPREAD)).cast("decimal(19,0)")


#: Scripts that put no blanks between words, and those of them that part phrases by blanks.
PHRASED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff"
UNSPACED = re.compile(f"[{PHRASED}\u2e80-\u2fdf\u3005-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
UNSPACED_BLANK = re.compile(f"(?<={UNSPACED.pattern}) (?={UNSPACED.pattern})")
MARKS = ".!?\u3002\uff01\uff1f\uff61"
ENDS = re.compile(f"[.!?]+(?=\\s)|[{MARKS[3:]}]+")
PIECE_ENDS = re.compile(rf"{ENDS.pattern}|\n|(?<=[{PHRASED}])[ \t]+")
CHARS = 2  # of a script without blanks that count as a word


def sentences(line: str):
    """(start, end) of each sentence: up to marks . ! ? that white space or the end follows, or full-width ones."""
    start = 0
    for m in ENDS.finditer(line):
        yield start, m.end()
        start = m.end()
    if start < len(line):
        yield start, len(line)


def weight(words: list[str]) -> int:
    """The number of words; those of scripts without blanks count by their characters."""
    joined = "".join(words)
    return len(words) if joined.isascii() else sum(max(1, len(UNSPACED.findall(w)) // CHARS) for w in words)


def normal(text: str) -> str:
    return UNSPACED_BLANK.sub("", text) if not text.isascii() else text


def units(text: str | None):
    """(start, end, normalised) of the lines and sentences in lines that are units by themselves, in order."""
    at = 0
    for line in text.split("\n") if text else ():
        parts = line.split()
        if weight(parts) >= MIN_WORDS:
            lead = len(line) - len(line.lstrip())
            tail = len(line.rstrip())
            yield at + lead, at + tail, normal(" ".join(parts).casefold())
            cuts = list(sentences(line))
            if len(cuts) > 1:
                for a, b in cuts:
                    words = line[a:b].split()
                    if weight(words) >= MIN_WORDS:
                        lead = len(line[a:b]) - len(line[a:b].lstrip())
                        yield at + a + lead, at + a + len(line[a:b].rstrip()), normal(" ".join(words).casefold())
        at += len(line) + 1


def pieces(text: str):
    """(starts, ends, normalised, weights) of the pieces that hold a word."""
    starts, ends, words, weights = [], [], [], []
    at = 0
    for end in [*(m.end() for m in PIECE_ENDS.finditer(text)), len(text)]:
        part = text[at:end]
        w = part.split()
        if w:
            starts.append(at + len(part) - len(part.lstrip()))
            ends.append(at + len(part.rstrip()))
            words.append(" ".join(w).casefold())
            weights.append(weight(w))
        at = end
    return starts, ends, words, weights


def runs_of(groups: list[tuple[int, int]], sizes: list[int]):
    """(first, last) piece of the least run of groups from each group on, and of the least up to each."""
    n = len(groups)
    total = hi = 0
    for lo in range(n):
        while hi < n and total < MIN_WORDS:
            total += sizes[hi]
            hi += 1
        if total < MIN_WORDS:
            break
        yield groups[lo][0], groups[hi - 1][1]
        total -= sizes[lo]
    total, lo = 0, n - 1
    for hi in range(n - 1, -1, -1):
        while lo >= 0 and total < MIN_WORDS:
            total += sizes[lo]
            lo -= 1
        if total < MIN_WORDS:
            break
        yield groups[lo + 1][0], groups[hi][1]
        total -= sizes[hi]


def all_units(text: str | None):
    """(start, end, normalised) of each unit, ordered by start and end: those of ``units``,
    sentences over line breaks, and runs of short pieces."""
    if not text:
        return []
    starts, ends, words, weights = pieces(text)
    n = len(starts)
    lines: list[tuple[int, int]] = []
    wrapped: list[tuple[int, int]] = []  # sentences over line breaks; a blank line ends one
    for i in range(n):
        breaks = text.count("\n", ends[i - 1], starts[i]) if i else 2
        if breaks:
            lines.append((i, i))
        else:
            lines[-1] = (lines[-1][0], i)
        if breaks == 1 and text[ends[i - 1] - 1] not in MARKS:
            wrapped[-1] = (wrapped[-1][0], i)
        else:
            wrapped.append((i, i))
    found = set(runs_of([(i, i) for i in range(n)], weights))
    found.update((a, b) for a, b in lines if sum(weights[a : b + 1]) >= MIN_WORDS)
    if len(wrapped) < n:
        found.update(runs_of(wrapped, [sum(weights[a : b + 1]) for a, b in wrapped]))
    return [(starts[a], ends[b], normal(" ".join(words[a : b + 1]) if a < b else words[a])) for a, b in sorted(found)]


def _digests(text: str | None):
    from xxhash import xxh3_128_intdigest

    starts, ends, d = [], [], []
    for a, b, t in all_units(text):
        starts.append(a)
        ends.append(b)
        d.append(xxh3_128_intdigest(encoded(t)))
    h = [(x >> 64) - (1 << 63) for x in d]
    g = [(x & ((1 << 64) - 1)) - (1 << 63) for x in d]
    return starts, ends, h, g


def _all_units():
    schema = pa.schema([("h", pa.int64()), ("g", pa.int64()), ("doc", pa.int64()), ("row", pa.int64())])

    def run(batches):
        worker_memory("units")
        for b in batches:
            hs, gs, ds, rs = [], [], [], []
            for doc, t, row in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                _, _, h, g = _digests(t)
                hs += h
                gs += g
                ds += [doc] * len(h)
                rs += [row] * len(h)
            yield batch(schema, h=hs, g=gs, doc=ds, row=rs)

    return run, "h long, g long, doc long, row long"


def _repeated_units(bits):
    schema = pa.schema([(x, pa.int64()) for x in ("h", "g", "doc", "row", "start", "end", "nth")])

    def run(batches):
        packed = np.frombuffer(bits.value, np.uint8)
        for b in batches:
            out: list[list] = [[] for _ in schema]
            for doc, row, t in zip(*(b.column(i).to_pylist() for i in (0, 2, 1)), strict=True):
                starts, ends, h, g = _digests(t)
                if not h:
                    continue
                first_end: dict = {}
                for i in np.flatnonzero(passes(packed, np.array(h, np.int64))).tolist():
                    nth = int(starts[i] >= first_end.setdefault((h[i], g[i]), ends[i]))  # what overlaps the first goes with it
                    for c, x in zip(out, (h[i], g[i], doc, row, starts[i], ends[i], nth), strict=True):
                        c.append(x)
            yield batch(schema, **dict(zip(schema.names, out, strict=True)))

    return run, "h long, g long, doc long, row long, start long, end long, nth long"


def cut_out(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans; a whole line goes with its line break, a sentence with the blanks after it."""
    out, at = [], 0
    apart: list[list[int]] = []
    for a, b in sorted(spans):
        if apart and a < apart[-1][1]:
            apart[-1][1] = max(apart[-1][1], b)
        else:
            apart.append([a, b])
    for a, b in apart:
        if b <= at:
            continue
        a = max(a, at)
        line = text.rfind("\n", 0, a) + 1
        end = text.find("\n", b)
        end = len(text) if end < 0 else end
        if not text[line:a].strip() and not text[b:end].strip():
            a, b = max(line, at), min(end + 1, len(text))
        else:
            while b < end and text[b] in " \t":
                b += 1
        out.append(text[at:a])
        at = b
    out.append(text[at:])
    kept = "".join(out)
    return kept[:-1] if kept.endswith("\n") and not text.endswith("\n") else kept


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc long, row long, spans array<struct<start, end, first_doc>>) of the texts that lose
    a unit; ``row`` is the text's xxhash64.

    Ids rank occurrences, null ids last, and under one id the hashes of the texts do; what
    the first of them has is removed from all others. Rows that repeat an id and its text
    are one document and lose the same units. Null and empty texts have none. ``first_doc``
    is null where the first occurrence has no id.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.col(text_col).alias("txt"), F.xxhash64(text_col).alias("row"))
    run, schema = _all_units()
    met = rows.mapInArrow(run, schema).select("h", "g", ranked("doc", "row").alias("rank"))
    groups = met.groupBy("h", "g").agg(F.min("rank").alias("first"), F.count("*").alias("c"))
    groups = cut(groups.filter("c > 1").select("h", "g", "first"), "units")
    run, schema = _repeated_units(bit_filter(groups, "h"))
    lost = rows.mapInArrow(run, schema).join(groups, ["h", "g"]).filter((ranked("doc", "row") > F.col("first")) | (F.col("nth") > 0))
    spread = F.lit(SPREAD).cast("decimal(19,0)")
    lost = lost.withColumn("spread", spread).withColumn("first", F.col("first") - F.pmod(F.col("first"), spread))
    lost = lost.withColumn("first_doc", F.nullif(F.expr("first div spread"), F.lit(LAST)))
    return lost.groupBy("doc", "row").agg(F.array_sort(F.collect_set(F.struct("start", "end", "first_doc"))).alias("spans"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", changed_only: bool = False, spans_col: str = "removed_spans") -> DataFrame:
    """``docs`` with the repeated units cut out of the text, and ``spans_col``, which takes the
    place of a column of that name.

    Every row stays, with all its columns, but for ``changed_only``; a text may become empty.
    Only rows that may change are moved.
    """
    mark = written()
    spans = repeated_spans(docs, id_col, text_col).select(F.nullif("doc", F.lit(LAST)).alias("__id"), F.col("row").alias("__row"), F.col("spans").alias("__spans"))
    spans = cut(spans, "spans")
    keep_only(docs.sparkSession, mark, last_written())

    @F.pandas_udf("string")
    def cut_text(text, spans):
        return text.combine(spans, lambda t, s: t if t is None or s is None else cut_out(t, [(x["start"], x["end"]) for x in s]))

    rest, met = flagged(docs, spans, id_col, text_col)
    changed = F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(cut_text(F.col(text_col), F.col("__spans")))
    met = met.withColumn(text_col, changed).drop("__id", "__row")
    named = lambda df: df.drop(spans_col).withColumnRenamed("__spans", spans_col)
    if changed_only:
        return named(met.filter("__spans is not null"))
    return named(rest.withColumn("__spans", F.lit(None).cast(met.schema["__spans"].dataType)).unionByName(met))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that lose units: what was removed, where, and for which earlier documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = without_repeats(docs, changed_only=True)
    spans = F.col("removed_spans")
    return out.select(
        "doc_id",
        F.size(spans).cast("long").alias("n_removed"),
        F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["first_doc"]))).alias("first_doc_ids"),
        F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("removed_spans"),
        "text",
    )


def brute_spans(rows: list[tuple]) -> dict:
    """{(id, text): [(start, end, first id)]} by a plain walk over all units in rank order; for tests."""
    from xxhash import xxh64_intdigest

    first: dict = {}
    out: dict = {}
    for doc, text in sorted(set(rows), key=lambda r: (LAST if r[0] is None else r[0], xxh64_intdigest(encoded(r[1] or ""), 42) % SPREAD)):
        for a, b, t in all_units(text):
            have = first.setdefault(t, (doc, text))
            if have != (doc, text) or a >= first.setdefault((t, doc, text), b):
                out.setdefault((doc, text), []).append((a, b, have[0]))
    return out
