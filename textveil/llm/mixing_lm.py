"""Language-model scoring by online logistic context mixing.

Tokens are lower-cased words and one end per text. All that the model knows comes from the
texts outside the held-out fold:

1. Token counts, summed by the cluster. The most frequent words that occur twice, a fixed
   number of them, get codes; all other words are spelled.
2. Bit counters in tables of hashed contexts (``context_mixing``). Each task counts its
   texts' bits into tables of its own, pieces of which are added up by the cluster; the
   spelling of words without a code is counted from the token counts. The tables grow with
   the corpus up to a size that is fit for a broadcast.
3. Mixing weights and adaptive maps, learned online over all learned texts, and the speller's
   over all counted words without a code. Texts (words) are dealt to a fixed number of groups by
   their hash; tasks count the bits that each cell has met in each group, the cluster adds these
   counts up, and the weights take a step for each group in turn. Every text starts from the
   weights, and its own bits correct them as it is read.

A text's score depends on these and the text alone, so it is the same however rows are dealt
out. Each counted word without a code is spelled once and joined with the texts by its hash
of 64 bits, by which all words are told apart here.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, cut, fold_col, keep_only, last_written, small_batches, table, worker_memory, written
from .context_mixing import GROUPS, LEVEL_BITS, Reader, Speller, Texts, WordModel, add_met, pairs_of, pieces, quantised, table_bits

DICTIONARY = 131_072  # words with a code
LONGEST = 64  # bytes of such a word
COUNT_BYTES, SCORE_BYTES = 4_000_000, 75_000  # of text read at once
HELD_WORDS = 600_000  # distinct words that a task counts before it passes them on
PARTS = 256  # of each table
LN10, LN2 = float(np.log(10)), float(np.log(2))


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, a place of each, counts), in the order of the hashes.

    The place goes into the low bits of what is sorted, which is far cheaper than sorting
    places; should two hashes share the other bits, the plain way is taken.
    """
    n = len(h)
    low = np.uint64(max(1, n.bit_length()))
    key = h >> low << low
    key |= np.arange(n, dtype=np.uint64)
    key.sort()
    place = (key & ((np.uint64(1) << low) - np.uint64(1))).view(np.int64)
    key >>= low
    new = np.append(True, key[1:] != key[:-1])[:n]
    first = np.flatnonzero(new)
    sorted_h = h[place]
    if (sorted_h[1:] != sorted_h[:-1])[~new[1:]].any():
        u, at, c = np.unique(h, return_index=True, return_counts=True)
        return u, at, c
    return sorted_h[first], place[first], np.diff(first, append=n)


class WordCounts:
    """Counts of words by hash, each with its bytes, which are kept where a word is met first."""

    def __init__(self):
        self.h, self.c, self.number, self.words = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), []

    def add(self, texts: list[Texts]) -> None:
        h, place, c = distinct(np.concatenate([t.h for t in texts]))
        begin = np.cumsum([0, *(len(t.h) for t in texts)])
        at = np.searchsorted(self.h, h)
        known = np.zeros(len(h), bool)
        inside = at < len(self.h)
        known[inside] = self.h[at[inside]] == h[inside]
        self.c[at[known]] += c[known]
        new = ~known
        more = place[new]
        number = np.arange(len(self.words), len(self.words) + len(more))
        of = np.searchsorted(begin, more, "right") - 1
        self.words += [texts[i].word(j) for i, j in zip(of.tolist(), (more - begin[of]).tolist(), strict=True)]
        self.h, self.c, self.number = (np.insert(a, at[new], b) for a, b in ((self.h, h[new]), (self.c, c[new]), (self.number, number)))

    def counts(self) -> np.ndarray:
        """The counts of ``words``."""
        out = np.empty(len(self.c), np.int64)
        out[self.number] = self.c
        return out


def _counted_words():
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64())])

    def passed(have: WordCounts):
        counts = have.counts()
        for lo in range(0, len(counts), 20_000):
            yield batch(schema, word=have.words[lo : lo + 20_000], c=counts[lo : lo + 20_000])

    def run(batches):
        have, ends, reader = WordCounts(), 0, Reader(SCORE_BYTES)
        for texts in _texts(batches, reader):
            ends += sum(int(t.whole.sum()) for t in texts)
            have.add(texts)
            if len(have.words) > HELD_WORDS:
                yield from passed(have)
                have = WordCounts()
        yield from passed(have)
        if ends:
            yield batch(schema, word=[b""], c=[ends])

    return run, "word binary, c long"


def _texts(batches, reader: Reader):
    """Lists of about ``COUNT_BYTES`` of the texts in the first column of batches."""
    held, size = [], 0
    for b in batches:
        for t in reader.read(b.column(0)):
            held.append(t)
            size += len(t.data)
            if size >= COUNT_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def _as_pieces(counts: list[np.ndarray]):
    schema = pa.schema([("part", pa.int32()), ("n", pa.binary())])
    for i, n in enumerate(counts):
        for j, piece in enumerate(np.split(n, PARTS)):
            if piece.any():
                packed = pa.compress(piece.astype(np.uint16 if piece.max() < 1 << 16 else np.uint32).tobytes(), "zstd", asbytes=True)
                yield batch(schema, part=[i * PARTS + j], n=[packed])


def _counted_texts(model, bits: int):
    def run(batches):
        worker_memory("bits")
        counts, reader = None, Reader(SCORE_BYTES)
        for texts in _texts(batches, reader):
            counts = counts or [np.zeros(1 << bits, np.uint32) for _ in range(WordModel.TABLES)]
            model.value.count_blocks(texts, counts)
        yield from _as_pieces(counts or [])

    return run, "part int, n binary"


def _counted_spelling(speller, bits: int):
    """The same from rows (word, c)."""

    def run(batches):
        worker_memory("bits")
        counts = None
        for b in batches:
            counts = counts or [np.zeros(1 << bits, np.uint32) for _ in range(Speller.TABLES)]
            words, c = b.column(0).to_pylist(), b.column(1).to_pylist()
            for some, times in _spelled(words, c):
                speller.value.count_blocks(some, np.array(times), counts)
        yield from _as_pieces(counts or [])

    return run, "part int, n binary"


def _spelled(words: list[bytes], *more: list, most: int = 200_000):
    """Words, very long ones in pieces, and what belongs to them, in lists of about ``most`` bytes."""
    out: list[list] = [[] for _ in range(1 + len(more))]
    size = 0
    for w, *x in zip(words, *more, strict=True):
        for piece in pieces(w):
            for o, y in zip(out, (piece, *x), strict=True):
                o.append(y)
            size += len(piece) + 1
            if size >= most:
                yield out
                out, size = [[] for _ in out], 0
    if size:
        yield out


def _added_pieces(bits: int):
    """Sums the pieces of a partition, read as a stream, and gives their pairs."""
    schema = pa.schema([("part", pa.int32()), ("pairs", pa.binary())])
    size = (1 << bits) // PARTS

    def run(batches):
        from zstandard import ZstdDecompressor

        total: dict[int, np.ndarray] = {}
        for b in batches:
            for part, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = ZstdDecompressor().decompress(n, max_output_size=4 * size)
                total.setdefault(part, np.zeros(size, np.uint64))[:] += np.frombuffer(raw, np.uint16 if len(raw) == 2 * size else np.uint32)
        for part, n in total.items():
            yield batch(schema, part=[part], pairs=[pa.compress(quantised(pairs_of(n)).tobytes(), "zstd", asbytes=True)])

    return run, "part int, pairs binary"


def _tables(pieces_: DataFrame, n: int, bits: int) -> list[np.ndarray]:
    """The summed tables, a fixed number of a fixed size each."""
    spread = max(1, min(PARTS, int(pieces_.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    run, ddl = _added_pieces(bits)
    out, size = [np.zeros(1 << bits, np.uint16) for _ in range(n)], (1 << bits) // PARTS
    for r in pieces_.repartition(spread, "part").mapInArrow(run, ddl).collect():
        i, j = divmod(r.part, PARTS)
        out[i][j * size : (j + 1) * size] = np.frombuffer(pa.decompress(bytes(r.pairs), 2 * size, "zstd", asbytes=True), np.uint16)
    return out


def _met_by_texts(model: WordModel, texts: pa.Array, group: np.ndarray, groups: np.ndarray, reader: Reader) -> None:
    """Count the bits of texts, each without all that it has counted itself, in their cells and groups."""
    for t in reader.read(texts):
        cell, bit, text, size, _ = model.bits(t)
        add_met(groups, np.repeat(group[t.rows][text], size), cell, bit)


def _met_by_words(model: Speller, words: list[bytes], group: list[int], groups: np.ndarray) -> None:
    """The same for words, each met once and without that."""
    for some, g in _spelled(words, group):
        cell, bit, word = model.bits(some, np.ones(len(some), bool))
        add_met(groups, np.array(g, np.int64)[word], cell, bit)


def learn_words(model: WordModel, texts: list[str]) -> None:
    """Weights and maps from texts at hand, dealt to the groups in turn."""
    groups = model.cells.empty()
    _met_by_texts(model, pa.array(texts, pa.string()), np.arange(len(texts)) % GROUPS, groups, Reader(SCORE_BYTES))
    model.cells.fit(groups)


def learn_spelling(model: Speller, words: list[bytes]) -> None:
    groups = model.cells.empty()
    _met_by_words(model, words, [i % GROUPS for i in range(len(words))], groups)
    model.cells.fit(groups)


def _met(sent: tuple, count):
    """What each group's bits met, from rows (text or word, group)."""
    schema = pa.schema([("g", pa.int32()), ("at", pa.binary()), ("n", pa.binary())])

    def run(batches):
        groups = None
        for b in batches:
            if groups is None:
                model, reader = _from_broadcast(*sent)
                groups = model.cells.empty()
            count(model, b, groups, reader)
        for g, n in enumerate(groups if groups is not None else []):
            at = np.flatnonzero(n.reshape(-1))
            if len(at):
                yield batch(schema, g=[g], at=[pa.compress(np.diff(at, prepend=0).astype(np.int32).tobytes(), "zstd", asbytes=True)], n=[pa.compress(n.reshape(-1)[at].tobytes(), "zstd", asbytes=True)])

    return run, "g int, at binary, n binary"


def _added_met(size: int):
    """Sums such rows of a partition, read as a stream."""
    schema = pa.schema([("g", pa.int32()), ("n", pa.binary())])

    def run(batches):
        from zstandard import ZstdDecompressor

        total: dict[int, np.ndarray] = {}
        for b in batches:
            for g, at, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at, n = (ZstdDecompressor().decompress(x, max_output_size=8 * size) for x in (at, n))
                total.setdefault(g, np.zeros(size, np.int64))[np.cumsum(np.frombuffer(at, np.int32), dtype=np.int64)] += np.frombuffer(n, np.int64)
        for g, n in total.items():
            yield batch(schema, g=[g], n=[pa.compress(n.tobytes(), "zstd", asbytes=True)])

    return run, "g int, n binary"


def _learned(model, rows: DataFrame, sent: tuple, count) -> None:
    """Weights and maps of the model from all rows (text or word, group)."""
    groups = model.cells.empty()
    run, ddl = _met(sent, count)
    add, add_ddl = _added_met(groups[0].size)
    for r in rows.mapInArrow(run, ddl).repartition(GROUPS, "g").mapInArrow(add, add_ddl).collect():
        groups[r.g] = np.frombuffer(pa.decompress(bytes(r.n), groups[r.g].nbytes, "zstd", asbytes=True), np.int64).reshape(-1, 2)
    model.cells.fit(groups)


def _texts_met(model, b: pa.RecordBatch, groups: np.ndarray, reader: Reader) -> None:
    _met_by_texts(model, b.column(0), b.column(1).to_numpy(), groups, reader)


def _words_met(model, b: pa.RecordBatch, groups: np.ndarray, _: Reader) -> None:
    _met_by_words(model, b.column(0).to_pylist(), b.column(1).to_pylist(), groups)


def _packed(x) -> bytes:
    """An array for a broadcast; executors write that to disk, so it is compressed."""
    return pa.compress(x.tobytes(), "zstd", asbytes=True)


def _cells(model) -> tuple:
    return model.cells.w, _packed(model.cells.z)


def _named(*sent) -> tuple:
    """Broadcasts with a name that no others had before in the session."""
    return f"mixing {uuid.uuid4().hex}", *sent


def _from_broadcast(name: str, known, tables, cells=None):
    """(model, reader) that a worker keeps: to learn from the tables' pairs or, with cells, to score by their levels."""
    held = worker_memory(name)
    if "model" not in held:
        reader = Reader(SCORE_BYTES)  # takes the worker's memory for itself
        held = worker_memory(name)
        bits, packed = tables.value
        pairs = [np.frombuffer(pa.decompress(x, 2 << bits, "zstd", asbytes=True), np.uint16) for x in packed]
        if cells is None:
            model = known.value.with_tables(pairs)
        else:
            w, z = cells.value
            model = known.value.with_tables(pairs, w, np.frombuffer(pa.decompress(z, 4 * (w.shape[1] // 16 << LEVEL_BITS * known.value.TABLES), "zstd", asbytes=True), np.float32))
        model.to_levels(cells is None)
        held["model"] = model, reader
    return held["model"]


def _scored(sent: tuple, log_counts, end: float, known_end: int):
    """Rows of all texts with what needs no count of a word without a code; those words beside them."""
    rare = pa.list_(pa.struct([("h", pa.int64()), ("times", pa.int64()), ("word", pa.binary())]))
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("held", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("lp", pa.float64()), ("bytes", pa.int64()), ("rare", rare)])

    def run(batches):
        (model, reader), base_of, place = _from_broadcast(*sent), log_counts.value, 0
        for b in batches:
            n, held = len(b), b.column(1).to_numpy(zero_copy_only=False)
            tokens, known, base, lp = np.ones(n, np.int64), np.full(n, known_end), np.full(n, end), np.zeros(n)
            rare_words: list[tuple] = []
            for t in reader.read(b.column(2)):
                p, ids = model.log_probs(t, ~held[t.rows])
                np.add.at(lp, t.rows, p)
                words = np.diff(t.begin)
                row = np.repeat(t.rows, words)
                number = model.numbers.of(t.h)
                coded = number >= 0
                np.add.at(tokens, t.rows, words)
                known += np.bincount(row[coded], minlength=n)
                base += np.bincount(row[coded], base_of[number[coded]], n)
                at = np.flatnonzero(~coded)
                # what isn't held out has been counted, so its hash says which word it is
                words = [t.word(i) if h else None for i, h in zip(at.tolist(), held[row[at]].tolist(), strict=True)]
                rare_words.append((row[at], t.h[at], np.array(words, object)))
            size = pa.array(b.column(2)).cast(pa.binary())
            key = (TaskContext.get().partitionId() << 36) + place + np.arange(n)
            place += n
            yield batch(schema, key=key, id=b.column(0), held=held, n_tokens=tokens, known=known, base=base, lp=lp, bytes=[len(x) for x in size.to_pylist()], rare=listed(rare_words, n))

    def listed(found: list[tuple], n: int) -> pa.ListArray:
        """Each row's distinct words, from parts of (rows, hashes, words)."""
        r, h, words = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, object))
        order = np.lexsort((h, r))
        r, h = r[order], h[order]
        first = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (h[1:] != h[:-1]))[: len(r)])
        times = np.diff(first, append=len(r))
        values = pa.StructArray.from_arrays([pa.array(h[first].view(np.int64)), pa.array(times), pa.array(words[order][first], pa.binary())], fields=list(rare.value_type))
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(r[first], np.arange(n + 1)).astype(np.int32)), values)

    return run, "key long, id long, held boolean, n_tokens long, known long, base double, lp double, bytes long, rare array<struct<h: bigint, times: bigint, word: binary>>"


def _spelling(sent: tuple):
    """Rows (h, c, lp, lp_own) of words with their counts: the hash that texts are read with,
    and the log probabilities as an unread text's and as a learned text's word."""
    schema = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("lp", pa.float64()), ("lp_own", pa.float64())])

    def run(batches):
        model, reader = _from_broadcast(*sent)
        for b in batches:
            words = b.column(0).to_pylist()
            h = np.concatenate([t.h for t in reader.read(pa.array(words, pa.binary()))]) if words else np.empty(0, np.uint64)
            lp = np.zeros((2, len(words)))
            for some, at in _spelled(words, list(range(len(words))), most=20_000):
                for out, x in zip(lp, model.both_log_probs(some), strict=True):
                    np.add.at(out, at, x)
            yield batch(schema, h=h.view(np.int64), c=b.column(1), lp=lp[0], lp_own=lp[1])

    return run, "h long, c long, lp double, lp_own double"


def _spelled_rows(sent: tuple, out_of: int):
    """Rows (key, known, base, lp) of a text's words, from rows (key, held, times, word, c, lp,
    lp_own); words that no learned text has have nothing behind ``word`` and are spelled here."""
    schema = pa.schema([("key", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("lp", pa.float64())])

    def run(batches):
        for b in batches:
            held, times = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            c, lp, own = (b.column(i).fill_null(0).to_numpy() for i in (4, 5, 6))
            lp = np.where(held, lp, own)
            new = np.flatnonzero(c == 0)
            if len(new):
                words = b.column(3).take(pa.array(new)).to_pylist()
                of = {w: i for i, w in enumerate(dict.fromkeys(words))}
                spelled, (model, _) = np.zeros(len(of)), _from_broadcast(*sent)
                for some, at in _spelled(list(of), list(range(len(of)))):
                    np.add.at(spelled, at, model.log_probs(some, np.zeros(len(some), bool)))
                lp[new] = spelled[[of[w] for w in words]]
            yield batch(schema, key=b.column(0), known=np.where(c > 0, times, 0), base=times * np.log10((c + 1) / out_of), lp=times * lp)

    return run, "key long, known long, base double, lp double"


def _least_count(words: DataFrame) -> int:
    """The count from which on at most ``DICTIONARY`` words are met, by steps of a few per cent:
    a sum over steps, of which there are some hundreds, instead of an order of all words."""
    step = F.floor(8 * F.log2("c")).alias("step")
    found, least = 0, 1 << 62
    for r in sorted(words.groupBy(step).agg(F.count("*").alias("n"), F.min("c").alias("least")).collect(), key=lambda r: -r.step):
        found += r.n
        if found > DICTIONARY:
            break
        least = r.least
    return least


def score_texts(docs: DataFrame, k: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte).

    ``base_score`` is the add-one unigram log10 probability, ``score`` the model's; for a
    text that the model has learned from, what it counted of that very place is taken out.
    Null and empty texts hold the end alone. Every row is scored, repeated rows and rows
    with a null id as well; other columns aren't read. Texts of more than about 75 kB are
    read in parts, each with a memory of its own. Without training texts all tokens are
    unknown.
    """
    spark, mark = docs.sparkSession, written()
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("txt"))
    rows = rows.withColumn("held", fold_col(F.col("id"), k) == held)
    learned = rows.filter("not held").select("txt")
    run, ddl = _counted_words()
    counts = cut(learned.mapInArrow(run, ddl).groupBy("word").agg(F.sum("c").alias("c")), "counts")
    n, v = (x or 0 for x in counts.agg(F.sum("c"), F.count("*")).first())
    ends = next((r.c for r in counts.filter(F.length("word") == 0).collect()), 0)
    coded = counts.filter(F.length("word").between(1, LONGEST) & (F.col("c") > 1))  # words met once tell how unseen ones come
    least = _least_count(coded)
    frequent = coded.filter(F.col("c") >= least).toArrow()
    frequent = sorted(zip(frequent.column("word").to_pylist(), frequent.column("c").to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    others = counts.filter((F.length("word") > LONGEST) | (F.length("word") > 0) & (F.col("c") < least))

    bits, out_of = table_bits(v), n + v + 1
    words, speller = WordModel(frequent, n - ends - sum(c for _, c in frequent), ends), Speller(frequent)
    send = spark.sparkContext.broadcast
    known, known_speller = send(words), send(speller)
    run, ddl = _counted_texts(known, bits)
    words_tables = _tables(learned.mapInArrow(run, ddl), WordModel.TABLES, bits)
    of_group = lambda col: F.pmod(F.xxhash64(col), F.lit(GROUPS)).alias("g")
    words = words.with_tables(words_tables)
    tables = send((bits, [_packed(x) for x in words_tables]))
    words_tables = words.tables = None
    _learned(words, learned.select("txt", of_group("txt")), _named(known, tables), _texts_met)
    sent = _named(known, tables, send(_cells(words)))
    run, ddl = _counted_spelling(known_speller, bits)
    spelled_tables = _tables(others.mapInArrow(run, ddl), Speller.TABLES, bits)
    speller = speller.with_tables(spelled_tables)
    tables = send((bits, [_packed(x) for x in spelled_tables]))
    spelled_tables = speller.tables = None
    _learned(speller, others.select("word", of_group("word")), _named(known_speller, tables), _words_met)
    spelling = _named(known_speller, tables, send(_cells(speller)))
    log_counts = send(np.log10((np.array([c for _, c in frequent], float) + 1) / out_of))
    run, ddl = _scored(sent, log_counts, float(np.log10((ends + 1) / out_of)), int(ends > 0))
    scored = cut(rows.select("id", "held", "txt").mapInArrow(run, ddl), "scored")
    scored_path = last_written()
    asked = scored.select("key", "held", F.explode("rare").alias("r")).select("key", "held", "r.times", "r.word", "r.h")
    usual = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8192")  # rows of a word, not of a text
    try:
        run, ddl = _spelling(spelling)
        found = asked.join(others.mapInArrow(run, ddl), "h", "left").select("key", "held", "times", "word", "c", "lp", "lp_own")
        run, ddl = _spelled_rows(spelling, out_of)
        more = cut(found.mapInArrow(run, ddl).groupBy("key").agg(*[F.sum(x).alias(f"more_{x}") for x in ("known", "base", "lp")]), "spelled")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", usual)
    keep_only(spark, mark, scored_path, last_written())
    total = F.col("lp") + F.coalesce("more_lp", F.lit(0.0))
    return scored.drop("rare").join(more, "key", "left").select(
        F.col("id").alias(id_col),
        F.col("held").alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (total / LN10).alias("score"),
        (-total / LN2 / F.greatest("bytes", F.lit(1))).alias("bits_per_byte"),
    )


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
