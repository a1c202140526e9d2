"""Helpers shared by the operators: Arrow batches, scratch tables, words, folds."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch handed to Python. Texts may hold 100 kB and more, so a
#: batch of Spark's default 10,000 rows could hold gigabytes.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's Arrow batch size to ``rows``; never raises it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for written intermediates.

    The cluster names it in ``spark.checkpoint.dir``. Only a session that has no
    such setting (a local test session) gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; a cluster needs a shared folder")
        root = tempfile.mkdtemp(prefix="textveil-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def cut(df: DataFrame, what: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    A lost executor then costs a re-read, never a recomputation of the whole chain.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/textveil-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Paths written by this driver and not yet discarded.
_WRITTEN: list[str] = []


def written() -> int:
    """How many paths are written and not discarded: a mark for ``keep_only``, and for the last path."""
    return len(_WRITTEN)


def last_written() -> str:
    return _WRITTEN[-1]


def keep_only(spark: SparkSession, mark: int, *paths: str) -> None:
    """Delete what was written since the mark but for the paths that a result still reads."""
    discard(spark, [p for p in _WRITTEN[mark:] if p not in paths])


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete written intermediates that nothing will read again."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)
        if p in _WRITTEN:
            _WRITTEN.remove(p)


def drop_shuffles(spark: SparkSession) -> None:
    """Have shuffle files deleted that nothing will read again: Spark does so once the JVM has
    collected what stands for them, for which a driver with little to do may wait very long."""
    spark._jvm.System.gc()


def lowered_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text as UTF-8 bytes, A-Z lower-cased.

    ``bytes.lower`` touches only A-Z and ``bytes.split`` splits only at
    0x20 and 0x09-0x0D, which is the definition wanted.
    """
    return encoded(text).lower().split() if text else []


def encoded(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def fold(doc_id: int | None, k: int) -> int:
    """crc32 of the decimal id, modulo k; a null id counts as remainder of the empty text (0)."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % k


def fold_col(col, k: int):
    """The same as a column expression."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % F.lit(k)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over a uint64 array."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """word -> 64-bit hash, filled on first sight and emptied when it holds ``limit`` words."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        from xxhash import xxh3_64_intdigest

        self.limit, self.of = limit, xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = self.of(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _byte_values() -> np.ndarray:
    v = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    v[ord("A") : ord("Z") + 1] = v[ord("a") : ord("z") + 1]
    return v


_HELD: dict = {"owner": None}


def worker_memory(owner: str) -> dict:
    """What a Python worker keeps from task to task, for one operator at a time.

    Workers outlive an operator, so the next one that runs in them first drops what the
    last one remembered.
    """
    if _HELD["owner"] != owner:
        _HELD.clear()
        _HELD["owner"] = owner
        gc.collect()
    return _HELD


class FlatWords:
    """64-bit hashes of all words of a string column, without a Python object for any word.

    A word's hash is a polynomial of its bytes' values (A-Z as a-z), taken from prefix
    sums over the column's buffer, and mixed with its length. Words longer than ``PLAIN``
    bytes, among which such polynomials have collisions that are easy to write down, take
    xxh3 of their lower-cased bytes. ``chunks`` walks the column in pieces of about ``size``
    bytes. ``space`` tells the bytes that part words.
    """

    PLAIN = 24

    def __init__(self, size: int = 1 << 20, space: np.ndarray | None = None):
        from xxhash import xxh3_64_intdigest

        worker_memory("words")
        self.of = xxh3_64_intdigest
        self.size, self.values, self.space = size, _byte_values(), _SPACE if space is None else space
        self._powers(size)

    def _powers(self, n: int) -> None:
        one = np.ones(n, np.uint64)
        one[1:] = np.uint64(_ODD)
        self.up = np.cumprod(one, dtype=np.uint64)
        one[1:] = np.uint64(_INVERSE)
        self.down = np.cumprod(one, dtype=np.uint64)

    def chunks(self, col):
        """(first row, word hashes, begin) per piece: row first + i has words begin[i]:begin[i+1]."""
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
        if pa.types.is_large_string(col.type):
            col = col.cast(pa.string())
        if col.null_count:
            col = col.fill_null("")
        n = len(col)
        if not n:
            return
        offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
        data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.empty(0, np.uint8)
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + self.size, "right")) - 1)
            yield lo, *self.words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])[:2]
            lo = hi

    def words(self, b: np.ndarray, offsets: np.ndarray):
        """(hashes, begin, starts, ends) of the words of some bytes that hold texts at these offsets."""
        if not len(b):
            none = np.empty(0, np.int64)
            return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64), none, none
        if len(b) > len(self.up):
            self._powers(len(b))
        space = self.space[b]
        edge = np.zeros(len(b) + 1, bool)
        edge[offsets] = True
        before = edge[:-1].copy()
        before[1:] |= space[:-1]
        after = edge[1:].copy()
        after[:-1] |= space[1:]
        starts, ends = np.flatnonzero(before & ~space), np.flatnonzero(after & ~space) + 1
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(self.values[b] * self.up[: len(b)], out=total[1:])
        size = ends - starts
        h = (total[ends] - total[starts]) * self.down[starts]
        h = mix64(h + size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        for i in np.flatnonzero(size > self.PLAIN).tolist():
            h[i] = self.of(b[starts[i] : ends[i]].tobytes().lower())
        return h, np.searchsorted(starts, offsets), starts, ends


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on; the last k - 1 places are left out."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    s = np.full(n, np.uint64(k), np.uint64)
    for j in range(k):
        s *= np.uint64(_ODD)
        s += h[j : j + n]
        s ^= s >> np.uint64(29)
    return mix64(s)


def shingle_sets(col, words: FlatWords, k: int):
    """Sorted distinct k-word shingle hashes of each row of a string column, in order."""
    for _, h, begin in words.chunks(col):
        s = runs(h, k)
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            if b - a >= k:
                x = np.sort(s[a : b - k + 1])
                yield x[np.r_[True, x[1:] != x[:-1]]]
            else:
                yield runs(h[a:b], b - a) if b > a else h[:0]


def batch(schema: pa.Schema, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for f, x in ((f, cols[f.name]) for f in schema)], schema=schema)


def environ_path(name: str, folder: str | None = None) -> str:
    """A public tokenizer's file: in ``folder``, else where the installed data package has it."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
