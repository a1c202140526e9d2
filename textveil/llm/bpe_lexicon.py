"""Byte-level BPE encoding and decoding over a minimal acyclic transducer lexicon.

Frequent words of the corpus are counted over all texts, encoded once and compiled
into a minimal automaton whose states share suffixes. Arcs carry additive outputs
whose sum is the word's number, and the number finds its ids. The automaton is a
file that each Python worker maps into memory. Pre-tokens that it doesn't hold are
merged exactly, many at once in numpy. What is frequent only decides how fast a word
is found, never its ids. Vocabulary files are read by the driver and reach the
workers by broadcast.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import tempfile
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, encoded, environ_path, small_batches, table, worker_memory

PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEXICON = 1 << 15  # words compiled into the automaton
COUNTED = 200_000  # words that a counting task holds before it drops its rarest
CACHED = 300_000  # pre-tokens whose ids a worker remembers
LONG = 128  # bytes from which a pre-token is merged alone, by a heap
NONE = np.int64(1 << 62)


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in character -> byte, as byte-level vocabularies spell bytes."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merge table, byte ids, token bytes and special tokens of a byte-level BPE file."""

    def __init__(self, raw: dict):
        model, alphabet = raw["model"], byte_alphabet()
        vocab = model["vocab"]
        spell = lambda t: bytes(alphabet[c] for c in t)
        self.special = {t["content"]: t["id"] for t in raw.get("added_tokens", [])}
        self.bytes_of = {i: spell(t) for t, i in vocab.items() if t not in self.special}
        self.bytes_of |= {i: encoded(t) for t, i in self.special.items()}
        id_of = {v: k for k, v in self.bytes_of.items() if k not in self.special.values()}
        self.byte_id = np.array([id_of[bytes([b])] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = (left << 32) | right
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], order.astype(np.int64), made[order]
        self._heap_table: dict | None = None

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """rank << 32 | new id of each pair, NONE for pairs that don't merge."""
        k = (a << 32) | b
        at = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
        return np.where(self.key[at] == k, (self.rank[at] << 32) | self.made[at], NONE)

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word: lowest rank first, leftmost first among equals."""
        out: list = [None] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        for i in np.flatnonzero(size > LONG):
            out[i] = self._merge_long(words[i])
        short = np.flatnonzero(size <= LONG)
        short = short[np.argsort(size[short], kind="stable")]
        for lo in range(0, len(short), 4096):
            self._merge_some(short[lo : lo + 4096], words, size, out)
        return out

    def _merge_some(self, which, words, size, out) -> None:
        n, width = size[which], int(size[which].max(initial=0))
        flat = np.frombuffer(b"".join(words[i] for i in which), np.uint8)
        ids = np.full((len(which), width + 1), -1, np.int64)
        ids[:, :width][np.arange(width)[None, :] < n[:, None]] = self.byte_id[flat]
        rank = np.where(ids[:, 1:] >= 0, self.ranks(ids[:, :-1], ids[:, 1:]), NONE)
        live = np.arange(len(which))
        while len(live):
            j = rank.argmin(1)
            best = rank[np.arange(len(j)), j]
            go = best < NONE
            for r in np.flatnonzero(~go):
                row = ids[r]
                out[which[live[r]]] = row[row >= 0].tolist()
            live, ids, rank, j, best = live[go], ids[go], rank[go], j[go], best[go]
            if not len(live):
                return
            r = np.arange(len(j))
            cols = np.arange(ids.shape[1] - 1)[None, :]
            src = cols + (cols > j[:, None])
            ids = np.take_along_axis(ids, src, 1)
            ids[r, j] = best & 0xFFFFFFFF
            ids = np.concatenate([ids, np.full((len(r), 1), -1)], 1) if ids.shape[1] < 2 else ids
            rank = np.take_along_axis(rank, np.minimum(src[:, : ids.shape[1] - 1], rank.shape[1] - 1), 1)
            for at in (j - 1, j):
                ok = (at >= 0) & (at < rank.shape[1])
                a, b = ids[r[ok], at[ok]], ids[r[ok], at[ok] + 1]
                rank[r[ok], at[ok]] = np.where(b >= 0, self.ranks(a, b), NONE)

    def _merge_long(self, word: bytes) -> list[int]:
        if self._heap_table is None:
            self._heap_table = {k: (r, m) for k, r, m in zip(self.key.tolist(), self.rank.tolist(), self.made.tolist(), strict=True)}
        have = self._heap_table
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        nxt, prv = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        heap = [(*have[k], i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (k := ids[i] << 32 | ids[i + 1]) in have]
        heap = [(r, i, m, a, b) for r, m, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, m, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = m, -1
            nxt[i] = nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
            for p, q in ((prv[i], i), (i, nxt[i])):
                if p >= 0 and q >= 0 and (x := have.get(ids[p] << 32 | ids[q])):
                    heapq.heappush(heap, (x[0], p, x[1], ids[p], ids[q]))
        return [x for x in ids if x >= 0]


class Transducer:
    """A minimal acyclic automaton from words to id lists, as flat arrays in one buffer.

    Built word by word in sorted order: once a word's path leaves the last one's, the
    states behind are final in shape and are replaced by an equal registered state.
    """

    PARTS = ("arc", "target", "add", "final", "start", "ids")

    @staticmethod
    def compile(entries: dict[bytes, list[int]]) -> bytes:
        words = sorted(entries)
        register: dict = {}
        states: list[dict] = [{}]
        final = [False]
        path: list[tuple[int, int]] = []  # (state, byte) of the last word

        def settle(depth: int) -> None:
            while len(path) > depth:
                s, c = path.pop()
                t = states[s][c]
                sign = (final[t], tuple(states[t].items()))
                if (same := register.setdefault(sign, t)) != t:
                    states[s][c] = same

        last = b""
        for w in words:
            k = 0
            while k < min(len(w), len(last)) and w[k] == last[k]:
                k += 1
            settle(k)
            s = states[path[-1][0]][path[-1][1]] if path else 0
            for c in w[k:]:
                states.append({})
                final.append(False)
                states[s][c] = len(states) - 1
                path.append((s, c))
                s = len(states) - 1
            final[s] = True
            last = w
        settle(0)
        order, number, stack = [], {0: 0}, [0]
        while stack:
            s = stack.pop()
            order.append(s)
            for t in states[s].values():
                if t not in number:
                    number[t] = len(number)
                    stack.append(t)
        count: dict[int, int] = {}

        def words_below(root: int) -> None:
            todo = [(root, False)]
            while todo:
                s, done = todo.pop()
                if s in count:
                    continue
                if done:
                    count[s] = final[s] + sum(count[t] for t in states[s].values())
                else:
                    todo.append((s, True))
                    todo += [(t, False) for t in states[s].values()]

        words_below(0)
        arcs = []
        for s in order:
            add = int(final[s])
            for c, t in sorted(states[s].items()):
                arcs.append((number[s] << 8 | c, number[t], add))
                add += count[t]
        arcs.sort()
        a = np.array(arcs, np.int64).reshape(-1, 3)
        done = np.zeros(len(number), np.int64)
        done[[number[s] for s in number if final[s]]] = 1
        ids = [entries[w] for w in words]
        start = np.cumsum([0, *map(len, ids)])
        parts = [a[:, 0], a[:, 1], a[:, 2], done, start, np.array([x for i in ids for x in i], np.int64)]
        return np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(np.ascontiguousarray(p, np.int64).tobytes() for p in parts)

    def __init__(self, path: str):
        flat = np.memmap(path, np.int64, "r")
        at = len(self.PARTS)
        for name, n in zip(self.PARTS, flat[:at].tolist(), strict=True):
            setattr(self, name, flat[at : at + n])
            at += n

    def find(self, words: list[bytes]) -> list[list[int] | None]:
        """Each word's ids, None where the lexicon doesn't hold it; all words walk together."""
        out: list = [None] * len(words)
        if not len(self.arc) or not words:
            return out
        size = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(np.r_[0, size[:-1]])
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        live = np.flatnonzero(size > 0)
        state, number = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
        t = 0
        while len(live):
            key = state << 8 | flat[begin[live] + t]
            at = np.minimum(np.searchsorted(self.arc, key), len(self.arc) - 1)
            ok = self.arc[at] == key
            live, at = live[ok], at[ok]
            state, number = self.target[at], number[ok] + self.add[at]
            t += 1
            end = size[live] == t
            for w, s, n in zip(live[end].tolist(), state[end].tolist(), number[end].tolist(), strict=True):
                if self.final[s]:
                    out[w] = self.ids[self.start[n] : self.start[n + 1]].tolist()
            live, state, number = live[~end], state[~end], number[~end]
        return out


def mapped(data: bytes) -> Transducer:
    """The automaton in a private file of the worker, mapped; the name goes at once, and the
    file with the mapping."""
    fd, path = tempfile.mkstemp(prefix="textveil-lexicon-")
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(data)
        return Transducer(path)
    finally:
        os.unlink(path)


class Codec:
    """Encodes and decodes texts; what it has met it remembers, up to ``CACHED`` pre-tokens."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Transducer | None):
        self.v, self.lexicon = vocabulary, lexicon
        self.pattern = regex.compile(PATTERN)
        special = sorted(vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self._fresh()

    def _fresh(self) -> None:
        self.ids: dict[str, str] = {t: str(i) for t, i in self.v.special.items()}
        self.text: dict[str, bytes] = {t: self.v.bytes_of[i] for t, i in self.v.special.items()}

    def split(self, text: str) -> list[str]:
        if self.special is None or not self.special.search(text):
            return self.pattern.findall(text)
        out: list[str] = []
        for i, part in enumerate(self.special.split(text)):
            out += [part] if i % 2 else self.pattern.findall(part)
        return out

    def learn(self, tokens: set[str]) -> None:
        new = [t for t in tokens if t not in self.ids]
        if len(self.ids) + len(new) > CACHED:
            self._fresh()
            new = [t for t in tokens if t not in self.ids]
        words = [encoded(t) for t in new]
        ids = self.lexicon.find(words) if self.lexicon else [None] * len(words)
        rest = [i for i, x in enumerate(ids) if x is None]
        for i, x in zip(rest, self.v.merge([words[i] for i in rest]), strict=True):
            ids[i] = x
        piece = self.v.bytes_of
        for t, x in zip(new, ids, strict=True):
            self.ids[t] = ",".join(map(str, x))
            self.text[t] = b"".join([piece[i] for i in x])

    def batch(self, texts: list[str | None]):
        """(ids joined by commas, decoded text) of each text."""
        split = [self.split(t) if t else [] for t in texts]
        lo = 0
        while lo < len(split):  # as many texts at once as the memory of met pre-tokens holds
            hi, met = lo, set()
            while hi < len(split) and (hi == lo or len(met) < CACHED // 4):
                met.update(split[hi])
                hi += 1
            self.learn(met)
            for tokens in split[lo:hi]:
                yield ",".join([self.ids[t] for t in tokens]), b"".join([self.text[t] for t in tokens]).decode("utf-8", "replace")
            lo = hi


def _codec(key, vocabulary, lexicon) -> Codec:
    """One codec for a worker process and model; a later task finds its memory warm."""
    kept = worker_memory("bpe")
    if kept.get("key") != key:
        kept["key"], kept["codec"] = key, Codec(vocabulary, mapped(lexicon))
    return kept["codec"]


#: Every ASCII byte but a letter becomes a space; what stays are the letter runs of most languages.
_LETTERS = bytes(b if b >= 0x80 or chr(b).isalpha() else 32 for b in range(256))


def frequent_words(docs: DataFrame, text_col: str = "text", limit: int = LEXICON) -> list[bytes]:
    """The most frequent words with a space before them, counted over all texts.

    A task drops its rarest words when it holds ``COUNTED`` and sends those it met at
    least 8 times; sums are taken by the cluster and ``limit`` words come back.
    """
    schema = pa.schema([("w", pa.binary()), ("c", pa.int64())])

    def run(batches):
        held: Counter = Counter()
        floor = 1
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    held.update(encoded(t).translate(_LETTERS).split())
            while len(held) > COUNTED:
                floor += 1
                held = Counter({w: c for w, c in held.items() if c >= floor})
        some = [(w, c) for w, c in held.items() if c >= 8 and len(w) <= 64]
        yield batch(schema, w=[w for w, _ in some], c=[c for _, c in some])

    counts = docs.select(text_col).mapInArrow(run, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c"))
    return [b" " + bytes(r.w) for r in counts.orderBy(F.desc("c"), "w").limit(limit).collect()]


def encode(docs: DataFrame, vocabulary_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(id, ids array<int>, n_tokens long, decoded string) of every whole text, or the
    SHA-256 digests of the ids joined by commas and of the decoded text in UTF-8.

    A special token's string in a text becomes its id. Null and empty texts have no
    ids and decode to the empty text. Every input row gives one row, repeated or with
    a null id as it may be; other columns aren't read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    vocabulary = Vocabulary.read(vocabulary_path or environ_path("byte_bpe_50k.json"))
    words = frequent_words(docs, text_col)
    lexicon = Transducer.compile(dict(zip(words, vocabulary.merge(words), strict=True)))
    model = spark.sparkContext.broadcast((hashlib.sha256(lexicon).hexdigest(), vocabulary, lexicon))
    if digests:
        schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
        ddl = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    else:
        schema = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("decoded", pa.string())])
        ddl = "id long, ids array<int>, n_tokens long, decoded string"

    def run(batches):
        codec = _codec(*model.value)
        for b in batches:
            n, first, second = [], [], []
            for ids, text in codec.batch(b.column(1).to_pylist()):
                n.append(ids.count(",") + 1 if ids else 0)
                if digests:
                    first.append(hashlib.sha256(ids.encode()).hexdigest())
                    second.append(hashlib.sha256(encoded(text)).hexdigest())
                else:
                    first.append([int(i) for i in ids.split(",")] if ids else [])
                    second.append(text)
            yield batch(schema, **dict(zip([f.name for f in schema], [b.column(0), n, first, second] if digests else [b.column(0), first, n, second], strict=True)))

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(run, ddl).withColumnRenamed("id", id_col)


def decode(frame: DataFrame, vocabulary_path: str | None = None, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The frame with the text of its id lists; null lists give null. Unknown ids raise."""
    spark = frame.sparkSession
    pieces = spark.sparkContext.broadcast(Vocabulary.read(vocabulary_path or environ_path("byte_bpe_50k.json")).bytes_of)

    @F.pandas_udf("string")
    def text(ids):
        return ids.map(lambda x: None if x is None else b"".join([pieces.value[i] for i in x]).decode("utf-8", "replace"))

    return frame.withColumn(out_col, text(F.col(ids_col)))


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), digests=True)
