"""A bit filter of fixed size over a column of longs, built by the cluster and broadcast.

It is 8 MB whatever the input. A value that was put in always passes; one that wasn't
passes with a small chance that rises as the column grows, so what passes is joined
exactly afterwards and nothing depends on the filter but how many rows are moved.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, mix64, small_batches

BITS = 1 << 26
PARTS = 256


def _slots(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = mix64(ids.astype(np.int64).view(np.uint64))
    return (h % np.uint64(BITS)).astype(np.int64), (mix64(h) % np.uint64(BITS)).astype(np.int64)


def bit_filter(df: DataFrame, col: str):
    """Broadcast bytes; two bits are set for each non-null value of ``col``."""
    schema = pa.schema([("part", pa.int32()), ("bits", pa.binary())])

    def run(batches):
        on = None
        for b in batches:
            on = np.zeros(BITS, bool) if on is None else on
            for s in _slots(b.column(0).to_numpy(zero_copy_only=False)):
                on[s] = True
        if on is not None:
            packed = np.packbits(on).reshape(PARTS, -1)
            some = np.flatnonzero(packed.any(1))
            yield batch(schema, part=some, bits=[packed[i].tobytes() for i in some])

    rows = df.select(col).filter(F.col(col).isNotNull()).mapInArrow(run, "part int, bits binary")
    rows = rows.rdd.map(lambda r: (r[0], bytes(r[1]))).reduceByKey(lambda x, y: (np.frombuffer(x, np.uint8) | np.frombuffer(y, np.uint8)).tobytes(), 32)
    out = np.zeros((PARTS, BITS // 8 // PARTS), np.uint8)
    for i, x in rows.collect():
        out[i] = np.frombuffer(x, np.uint8)
    return df.sparkSession.sparkContext.broadcast(out.tobytes())


def passes(packed: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which of the longs pass the filter given as a uint8 array."""
    a, b = _slots(ids)
    hit = lambda s: (packed[s >> 3] >> (7 - (s & 7)).astype(np.uint8)) & 1
    return (hit(a) & hit(b)).astype(bool)


def flagged(docs: DataFrame, flags: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``docs`` in two parts: the rows that no flag can be meant for, as they are, and the
    others with the columns of ``flags``, null where none is meant.

    ``flags`` has one row for each (``__id``, ``__row``): an id and the xxhash64 of a text.
    A bit filter tells the parts apart, so only rows that are flagged, and the few that the
    filter lets by, are shuffled.
    """
    small_batches(docs.sparkSession)
    key, row = docs[id_col].cast("long"), F.xxhash64(docs[text_col])
    bits = bit_filter(flags.select(F.xxhash64("__id", "__row").alias("k")), "k")

    @F.pandas_udf("boolean")
    def maybe(k):
        return k.__class__(passes(np.frombuffer(bits.value, np.uint8), k.to_numpy()))

    some = maybe(F.xxhash64(key, row))
    rest = docs.filter(~some)
    met = docs.filter(some).join(flags, key.eqNullSafe(F.col("__id")) & (row == F.col("__row")), "left")
    return rest, met
