"""Exact top-k by inner product: a ball tree per shard, searched by branch and bound.

Vectors are dealt to *cells* by the nearest of a bounded number of pivots, and cells to
shards of a bounded size; a shard's ball tree is built once and written. A tree node's
(and a cell's) inner products with q are at most ``q.c + |q| r``. Queries visit cells in
rounds, by that bound: first the best cell, then a few more, then all others; between rounds
each query's current k-th score is shared, and a cell whose bound is under it is never
asked. Within a shard the better child of each node is searched first, and nodes whose
bound is under the current k-th score are left out. Nothing is approximated.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batch, cut, keep_only, last_written, small_batches, table, written

SHARD_BYTES = 32 << 20  # of a shard's vectors at most, about
LEAST_SHARD = 2048  # rows
PIVOTS = 512  # kept at the driver and broadcast
ROUNDS = (1, 8)  # cells asked up to each round but the last, which asks all that are left
LEAF = 128
BLOCK = 2048  # queries that search a tree together
EXACT = float(1 << 53)
LONG = (1 << 63) - 1
LOWEST = -LONG - 1


def scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products as int64. Exact in doubles while all sums stay under 2**53,
    else by Python's integers; a score beyond a long is held at its end."""
    if not len(q) or not len(v):
        return np.zeros((len(q), len(v)), np.int64)
    if float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1] < EXACT:
        return (q @ v.T).astype(np.int64)
    whole = np.array([[int(x) for x in r] for r in q], object).dot(np.array([[int(x) for x in r] for r in v], object).T)
    return np.array([[max(-LONG - 1, min(LONG, int(x))) for x in r] for r in whole], np.int64)


def _unknown_as_greatest(bound: np.ndarray) -> np.ndarray:
    """Bounds with those that overflowed at infinity, so that nothing is left out for them."""
    return np.where(np.isnan(bound), np.inf, bound)


class Best:
    """The k best (score, id) of each query so far; ties go to the smaller id."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor
        self.s = np.full((n, k), LOWEST)
        self.i = np.full((n, k), LONG)
        self.full = np.zeros(n, np.int64)

    def least(self, q: np.ndarray) -> np.ndarray:
        """A score under which nothing counts any more."""
        return np.where(self.full[q] >= self.k, np.maximum(self.s[q, -1], self.floor[q]), self.floor[q])

    def add(self, q: np.ndarray, ids: np.ndarray, s: np.ndarray, other: np.ndarray) -> None:
        """Scores (queries x rows) of rows with these ids; ``other`` tells those that aren't the query's own row."""
        least, last = self.least(q)[:, None], self.i[q, -1][:, None]
        full = (self.full[q] >= self.k)[:, None]
        take = (s >= least) & other & ~(full & (s == self.s[q, -1][:, None]) & (ids[None, :] > last))
        r, c = np.nonzero(take)
        if not len(r):
            return
        rows = np.unique(r)
        have_r, have_c = np.nonzero(np.arange(self.k)[None, :] < self.full[q[rows]][:, None])
        all_r = np.r_[rows[have_r], r]
        all_s = np.r_[self.s[q[rows]][have_r, have_c], s[r, c]]
        all_i = np.r_[self.i[q[rows]][have_r, have_c], ids[c]]
        o = np.lexsort((all_i, ~all_s, all_r))  # ~s orders longs from the greatest down
        all_r, all_s, all_i = all_r[o], all_s[o], all_i[o]
        first = np.r_[0, np.flatnonzero(all_r[1:] != all_r[:-1]) + 1]
        rank = np.arange(len(all_r)) - np.repeat(first, np.diff(np.r_[first, len(all_r)]))
        keep = rank < self.k
        self.s[q[all_r[keep]], rank[keep]] = all_s[keep]
        self.i[q[all_r[keep]], rank[keep]] = all_i[keep]
        self.full[q[rows]] = np.bincount(all_r[keep], minlength=len(q))[rows]


class BallTree:
    """Flat arrays: vectors in the order of the leaves, their rows and ids, and for each node
    its centre, radius, first and last vector and second child (the first child follows it)."""

    PARTS = ("v", "row", "id", "centre", "radius", "lo", "hi", "second")

    def __init__(self, v: np.ndarray, row: np.ndarray, ids: np.ndarray):
        nodes: list[list] = []
        order: list[np.ndarray] = []
        self._build(v, np.arange(len(ids)), nodes, order, 0)
        o = np.concatenate(order)
        self.v, self.row, self.id = v[o], row[o], ids[o]
        self.centre, self.radius = np.array([n[0] for n in nodes]), np.array([n[1] for n in nodes])
        self.lo, self.hi, self.second = (np.array([n[i] for n in nodes], np.int64) for i in (2, 3, 4))

    def _build(self, v: np.ndarray, rows: np.ndarray, nodes: list, order: list, lo: int) -> None:
        x = v[rows]
        c = x.mean(0)
        far = np.sqrt(((x - c) ** 2).sum(1))
        r = float(far.max())
        # rounding of c and r must never lower a bound
        r += 1e-9 * (1 + r + float(np.abs(c).max(initial=0)))
        node = [c, r, lo, lo + len(rows), 0]
        nodes.append(node)
        if len(rows) <= LEAF or r <= 1e-6:
            order.append(rows)
            return
        a = x[far.argmax()]
        b = x[((x - a) ** 2).sum(1).argmax()]
        sides = rows[np.argsort(x @ (b - a), kind="stable")]
        half = len(sides) // 2
        self._build(v, sides[:half], nodes, order, lo)
        node[4] = len(nodes)
        self._build(v, sides[half:], nodes, order, lo + half)

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{x: getattr(self, x) for x in self.PARTS})
        return out.getvalue()

    @classmethod
    def unpacked(cls, raw: bytes) -> BallTree:
        tree = cls.__new__(cls)
        with np.load(io.BytesIO(raw)) as parts:
            for x in cls.PARTS:
                setattr(tree, x, parts[x])
        return tree

    def search(self, q: np.ndarray, own: np.ndarray, best: Best) -> int:
        """Answer all queries, ``own`` being their rows; returns how many query-leaf visits it made."""
        norm, visits = np.sqrt((q**2).sum(1)), 0
        bound = lambda node, n: _unknown_as_greatest(q[n] @ self.centre[node] + norm[n] * self.radius[node])
        stack = [(0, np.arange(len(q)))]
        while stack:
            node, n = stack.pop()
            up = bound(node, n)
            n = n[up + 1e-9 * np.abs(up) + 1e-6 >= best.least(n)]
            if not len(n):
                continue
            if not self.second[node]:
                for lo in range(self.lo[node], self.hi[node], 4 * LEAF):
                    at = slice(lo, min(lo + 4 * LEAF, self.hi[node]))
                    best.add(n, self.id[at], scores(q[n], self.v[at]), self.row[at][None, :] != own[n][:, None])
                visits += len(n)
                continue
            left, right = node + 1, int(self.second[node])
            sooner = bound(left, n) >= bound(right, n)
            # what is put last is searched first: each query meets its better child first
            stack += [(left, n[~sooner]), (right, n[~sooner]), (right, n[sooner]), (left, n[sooner])]
        return visits


def _matrix(col, d: int) -> np.ndarray:
    """Rows of binary vectors of ``d`` doubles."""
    return np.frombuffer(b"".join(col.to_pylist()), np.float64).reshape(-1, d)


class Cells:
    """Pivots by length of vector, and what is known of their cells."""

    def __init__(self, pivots: dict[int, np.ndarray]):
        self.pivots = pivots
        self.radius: dict[int, np.ndarray] = {}
        self.shards: dict[int, np.ndarray] = {}

    def of(self, d: int) -> np.ndarray:
        """Its cells' centres; a length without a pivot has one cell around nought."""
        return self.pivots.get(d, np.zeros((1, d)))

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = self.of(v.shape[1])
        cell = ((p**2).sum(1)[None, :] - 2 * (v @ p.T)).argmin(1)
        far = np.sqrt(((v - p[cell]) ** 2).sum(1))
        return cell, far + 1e-9 * (1 + far + np.abs(p[cell]).max(1, initial=0))

    def learn(self, rows: list, shard_rows) -> None:
        for r in rows:
            if r.d not in self.radius:
                n = len(self.of(r.d))
                self.radius[r.d], self.shards[r.d] = np.full(n, -1.0), np.zeros(n, np.int64)
            self.radius[r.d][r.cell] = r.far
            self.shards[r.d][r.cell] = -(-r.n // shard_rows(r.d))

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """(queries x cells) greatest inner products; those of empty cells are the least there is."""
        d = q.shape[1]
        up = q @ self.of(d).T + np.sqrt((q**2).sum(1))[:, None] * np.maximum(self.radius[d], 0)[None, :]
        up = _unknown_as_greatest(up + 1e-9 * np.abs(up) + 1e-6)
        up[:, self.shards[d] == 0] = -np.inf
        return up


def _by_length(b: pa.RecordBatch, d: int):
    """(length, rows) of a batch whose column ``d`` holds lengths of vectors."""
    lengths = b.column(d).to_numpy()
    for x in np.unique(lengths).tolist():
        yield x, pa.array(np.flatnonzero(lengths == x))


def _to_cells(cells):
    schema = pa.schema([("d", pa.int32()), ("cell", pa.int32()), ("far", pa.float64()), ("row", pa.int64()), ("id", pa.int64()), ("v", pa.binary())])

    def run(batches):
        for b in batches:
            for d, at in _by_length(b, 0):
                part = b.take(at)
                cell, far = cells.value.nearest(_matrix(part.column(3), d))
                yield batch(schema, d=part.column(0), cell=cell.astype(np.int32), far=far, row=part.column(1), id=part.column(2), v=part.column(3))

    return run, "d int, cell int, far double, row long, id long, v binary"


KEYS = ("d", "cell", "shard")


def _segments(b: pa.RecordBatch):
    """(keys, rows) of the runs of equal keys, the first three columns, in a batch."""
    keys = np.stack([b.column(i).to_numpy() for i in range(3)])
    first = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist()] if len(b) else []
    for lo, hi in zip(first, [*first[1:], len(b)], strict=True) if first else ():
        yield tuple(keys[:, lo].tolist()), b.slice(lo, hi - lo)


def _trees():
    """One row (keys, tree) for each shard of rows (keys, row, id, v) sorted by keys."""
    schema = pa.schema([("d", pa.int32()), ("cell", pa.int32()), ("shard", pa.int32()), ("tree", pa.binary())])

    def built(key, held):
        t = pa.Table.from_batches(held)
        tree = BallTree(_matrix(t.column(5), key[0]), t.column(3).to_numpy(), t.column(4).to_numpy())
        return batch(schema, d=[key[0]], cell=[key[1]], shard=[key[2]], tree=[tree.packed()])

    def run(batches):
        key, held = None, []
        for b in batches:
            for now, part in _segments(b):
                if now != key and held:
                    yield built(key, held)
                    held = []
                key = now
                held.append(part)
        if held:
            yield built(key, held)

    return run, "d int, cell int, shard int, tree binary"


def _asked(cells, lo: int, hi: int | None):
    """Rows (keys, row, floor, v) of the shards that queries (d, row, v, floor) ask in the
    round of their ``lo``-th to ``hi``-th best cells."""
    schema = pa.schema([("d", pa.int32()), ("cell", pa.int32()), ("shard", pa.int32()), ("row", pa.int64()), ("floor", pa.int64()), ("v", pa.binary())])

    def run(batches):
        for b in batches:
            for d, at in _by_length(b, 0):
                part = b.take(at)
                up, floor = cells.value.bounds(_matrix(part.column(2), d)), part.column(3).to_numpy()
                order = np.argsort(-up, 1, kind="stable")[:, lo:hi]
                q = np.repeat(np.arange(len(part)), order.shape[1])
                cell = order.reshape(-1)
                want = (up[q, cell] >= floor[q]) & (up[q, cell] > -np.inf)
                q, cell = q[want], cell[want]
                shards = cells.value.shards[d][cell]
                q, cell = np.repeat(q, shards), np.repeat(cell, shards)
                shard = np.arange(len(q)) - np.repeat(np.cumsum(shards) - shards, shards)
                for i in range(0, len(q), 4096):
                    some = pa.array(q[i : i + 4096])
                    yield batch(schema, d=np.full(len(some), d, np.int32), cell=cell[i : i + 4096].astype(np.int32), shard=shard[i : i + 4096].astype(np.int32), row=part.column(1).take(some), floor=part.column(3).take(some), v=part.column(2).take(some))

    return run, "d int, cell int, shard int, row long, floor long, v binary"


def _found(k: int):
    """Rows (row, id, score) of each query's best in each shard, from rows (keys, row, floor,
    raw) sorted by keys and row; a shard's tree is the one with a null row."""
    schema = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        key, tree, held, n = None, None, [], 0

        def searched():
            t = pa.Table.from_batches(held)
            own, q = t.column(3).to_numpy(), _matrix(t.column(5), key[0])
            best = Best(len(q), k, t.column(4).to_numpy())
            tree.search(q, own, best)
            r, c = np.nonzero(np.arange(k)[None, :] < best.full[:, None])
            return batch(schema, row=own[r], id=best.i[r, c], score=best.s[r, c])

        for b in batches:
            for now, part in _segments(b):
                if now != key:
                    if n:
                        yield searched()
                    key, tree, held, n = now, None, [], 0
                if part.column(3)[0].as_py() is None:
                    tree, part = BallTree.unpacked(part.column(5)[0].as_py()), part.slice(1)
                if tree is not None and len(part):  # without a tree the shard has no vector
                    held.append(part)
                    n += len(part)
                if n >= BLOCK:
                    yield searched()
                    held, n = [], 0
        if n:
            yield searched()

    return run, "row long, id long, score long"


def top_k(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(query_id long, rank int, vec_id long, score long): each query's k best other rows.

    ``is_query`` is a column expression over the id. Components become
    ``floor(scale * x)``. Rows with a null id, a null or empty vector or a component that is
    null or, scaled, not finite take no part. Vectors meet only vectors of their own
    length. A row is left out only for itself: rows that repeat an id are candidates for
    each other, with the same vector or another, and each that is a query has results of
    its own. With no partner a query has no row; an empty table gives an empty result.
    Other columns aren't read.
    """
    spark, mark = vectors.sparkSession, written()
    small_batches(spark)

    def scaled(e):
        y = e.cast("double") * scale
        return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)  # from 2**53 on y is whole already

    x = F.transform(F.col(vector_col), scaled)
    good = F.col(id_col).isNotNull() & F.coalesce(F.size(vector_col) > 0, F.lit(False)) & F.coalesce(F.forall(vector_col, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double") * scale) < float("inf"))), F.lit(False))
    rows = vectors.filter(good).select(F.col(id_col).cast("long").alias("id"), x.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    schema = pa.schema([("d", pa.int32()), ("id", pa.int64()), ("v", pa.binary()), ("q", pa.bool_())])

    def flat(batches):
        for b in batches:
            v = b.column(1)
            size = v.value_lengths().to_numpy()
            raw, at = v.flatten().to_numpy().tobytes(), np.r_[0, np.cumsum(size)] * 8
            yield batch(schema, d=size.astype(np.int32), id=b.column(0), v=[raw[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], q=b.column(2))

    # written once, so a row keeps its number
    rows = cut(rows.mapInArrow(flat, "d int, id long, v binary, q boolean").withColumn("row", F.monotonically_increasing_id()), "vectors")
    rows_path = last_written()
    n = rows.count()
    shard_rows = lambda d: max(1, min(max(LEAST_SHARD, n // (4 * parts)), SHARD_BYTES // (8 * d)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    some = rows.orderBy(F.xxhash64("row"), "row").limit(min(PIVOTS, max(1, n // LEAST_SHARD))).select("d", "v").collect()
    pivots: dict[int, list] = {}
    for r in some:
        pivots.setdefault(r.d, []).append(bytes(r.v))
    cells = Cells({d: np.frombuffer(b"".join(dict.fromkeys(v)), np.float64).reshape(-1, d) for d, v in pivots.items()})
    run, ddl = _to_cells(spark.sparkContext.broadcast(cells))
    dealt = cut(rows.select("d", "row", "id", "v").mapInArrow(run, ddl), "dealt")
    cells.learn(dealt.groupBy("d", "cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect(), shard_rows)
    sizes = spark.createDataFrame([(d, c, int(s)) for d, ss in cells.shards.items() for c, s in enumerate(ss.tolist()) if s], "d int, cell int, shards int")
    shard = F.pmod(F.xxhash64("row"), F.col("shards")).cast("int").alias("shard")
    dealt = dealt.join(F.broadcast(sizes), ["d", "cell"]).select("d", "cell", shard, "row", "id", "v")  # a row for each cell at most
    run, ddl = _trees()
    trees = cut(dealt.repartition(parts, *KEYS).sortWithinPartitions(*KEYS).mapInArrow(run, ddl), "trees")
    trees = trees.select(*KEYS, F.lit(None).cast("long").alias("row"), F.lit(None).cast("long").alias("floor"), F.col("tree").alias("raw"))
    known = spark.sparkContext.broadcast(cells)
    queries = rows.filter("q").select("d", "row", "v")
    most = max((len(x) for x in cells.shards.values()), default=0)
    best = Window.partitionBy("row").orderBy(F.desc("score"), "id")
    found, floors = None, None
    for lo, hi in zip((0, *ROUNDS), (*ROUNDS, None), strict=True):
        if lo >= most and lo:
            break
        asks = queries.withColumn("floor", F.lit(LOWEST)) if floors is None else queries.join(floors, "row", "left").select("d", "row", "v", F.coalesce("floor", F.lit(LOWEST)).alias("floor"))
        run, ddl = _asked(known, lo, hi)
        asks = asks.select("d", "row", "v", "floor").mapInArrow(run, ddl).withColumnRenamed("v", "raw")
        run, ddl = _found(k)
        both = trees.unionByName(asks).repartition(parts, *KEYS).sortWithinPartitions(*KEYS, "row")
        now = both.mapInArrow(run, ddl)
        found = now if found is None else found.unionByName(now)
        found = cut(found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), "found")
        floors = found.filter(F.col("rank") == k).select("row", F.col("score").alias("floor"))
        found = found.drop("rank")
    keep_only(spark, mark, rows_path, last_written())
    ids = rows.filter("q").select("row", F.col("id").alias("query_id"))
    out = found.withColumn("rank", F.row_number().over(best)).join(ids, "row")
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP1_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r AS r, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
