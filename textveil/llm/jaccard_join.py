"""N-gram Jaccard join: an exact self-join of texts by the Jaccard similarity of
their k-word shingles, pruned by R-trees over count vectors.

Shape of the work, all of it over every row and every whole text:

1. One pass makes each text's sorted set of shingle hashes and returns its size and
   a 64-bit digest of the set (the *node*; copies share one). It also sums up which
   shingles are frequent.
2. Prefix rows: ordered by (frequent, hash), two sets with similarity s share one
   of their first ``n - ceil(s n) + 1`` shingles. Shingles that only one node has are
   dropped by a combining count (each node sends a shingle once) and a bit filter of
   fixed size.
3. In each bucket left, tokens hashed to groups give count vectors. An R-tree over
   them bounds the overlap by summed coordinate minima. Not all pairs that pass are
   sent: a bucket gives a forest that spans them, so its output grows with its rows.
   Buckets beyond ``BLOCK`` rows are dealt out as pairs of blocks.
4. Components of these candidate links are *clusters*; every pair of similar texts
   lies in one. Each node's exact set is sent once to its cluster, or to each pair of
   blocks of a cluster too large for one task. There a search from node to node, on
   the same bound and then on the exact sets, finds the links that connect the texts.

No link between different texts is lost: a pair that isn't compared exactly either
fails the bound or already lies in one component. 64-bit hashes that collide are
taken as equal.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitfilter import bit_filter, flagged, passes
from .common import FlatWords, batch, cut, drop_shuffles, keep_only, last_written, lowered_words, shingle_sets, small_batches, table, written
from .graph import connected

LEVEL = 7  # a count vector has 2**LEVEL coordinates at least, and one for 4 to 8 shingles of larger sets
BLOCK = 2048  # rows of a bucket that one task compares
CLUSTER = 4_000_000  # shingles of a cluster that one task holds
LEAF = 32
LAST = (1 << 63) - 1  # the rank of rows with a null id
SMALL = 8  # rows up to which a bucket's pairs are compared directly
HOT_MAX = 1 << 16  # frequent shingles that order prefixes; only the order depends on them
CHUNK = 4096  # texts over which a task counts frequent shingles


def digest(s: np.ndarray) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(s.tobytes(), len(s)) - (1 << 63)


def prefix_len(n: int, num: int, den: int) -> int:
    return n - -(-n * num // den) + 1


def _first_pass(k: int):
    schema = pa.schema([("doc", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("hot", pa.bool_())])

    def frequent(held: list[np.ndarray]):
        if len(held) < 64:
            return None
        u, c = np.unique(np.concatenate(held), return_counts=True)
        keep = c >= max(4, len(held) // 1024)
        u, c = u[keep].view(np.int64), c[keep]
        return batch(schema, doc=pa.nulls(len(u), pa.int64()), row=pa.nulls(len(u), pa.int64()), n=pa.array(c, pa.int64()), node=pa.array(u), hot=pa.array(np.ones(len(u), bool))) if len(u) else None

    def run(batches):
        words, held = FlatWords(), []
        for b in batches:
            n, node = [], []
            for s in shingle_sets(b.column(1), words, k):
                n.append(len(s))
                node.append(digest(s) if len(s) else None)
                if len(s):
                    held.append(s)
            yield batch(schema, doc=b.column(0), row=b.column(2), n=n, node=node, hot=[False] * len(n))
            if len(held) >= CHUNK:
                if (out := frequent(held)) is not None:
                    yield out
                held = []
        if held and (out := frequent(held)) is not None:
            yield out

    return run, "doc long, row long, n long, node long, hot boolean"


def level(n: int) -> int:
    return max(LEVEL, (n >> 3).bit_length())


def counts(s: np.ndarray, at: int | None = None) -> np.ndarray:
    """Shingles in each of 2**level groups. A group holds 8 on average at most, so a byte is enough."""
    groups = 1 << (level(len(s)) if at is None else at)
    return np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups).astype(np.uint8)


class CountTree:
    """An R-tree over count vectors; each node keeps its upper corner and least set size.

    The overlap of two sets is at most the summed minima of their group counts, and
    against a node at most the summed minima with its upper corner.
    """

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, rows: np.ndarray):
        self.v, self.n = vectors, sizes
        self.root = self._build(rows)

    def _build(self, ids: np.ndarray):
        v = self.v[ids]
        top, least = v.max(0), int(self.n[ids].min())
        if len(ids) <= LEAF:
            return top, least, ids, None
        widest = int((top - v.min(0)).argmax())
        order = ids[np.argsort(v[:, widest], kind="stable")]
        return top, least, None, [self._build(c) for c in np.array_split(order, min(8, -(-len(ids) // LEAF)))]

    def near(self, qv: np.ndarray, qn: np.ndarray, alive: np.ndarray, num: int, den: int):
        """(query, row) of the pairs with live rows whose bound allows ``den * both >= num * either``."""
        out_q, out_p = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        stack = [(self.root, np.arange(len(qn)))]
        while stack:
            (top, least, ids, below), q = stack.pop()
            bound = np.minimum(qv[q], top).sum(1, dtype=np.int64)
            q = q[(den + num) * bound >= num * (qn[q] + least)]
            if not len(q):
                continue
            if below is not None:
                stack += [(x, q) for x in below]
                continue
            ids = ids[alive[ids]]
            if len(ids):
                bound = np.minimum(qv[q][:, None, :], self.v[ids][None, :, :]).sum(2, dtype=np.int64)
                r, c = np.nonzero((den + num) * bound >= num * (qn[q][:, None] + self.n[ids][None, :]))
                out_q.append(q[r])
                out_p.append(ids[c])
        return np.concatenate(out_q), np.concatenate(out_p)


def forest(v: np.ndarray, n: np.ndarray, num: int, den: int, exact=None) -> list[tuple[int, int]]:
    """Edges (row, row) that span the components of the graph of similar rows.

    From a row all live rows that pass the bound (and, if given, ``exact(row, rows)``)
    are taken out and asked in turn, so rows that are already connected are not compared
    with each other.
    """
    alive, edges = np.ones(len(n), bool), []
    tree, built = None, 0
    for seed in np.argsort(n, kind="stable").tolist():
        if not alive[seed]:
            continue
        alive[seed] = False
        queue = [seed]
        while queue:
            left = int(alive.sum())
            if not left:
                return edges
            if tree is None or left < built // 2:
                tree, built = CountTree(v, n, np.flatnonzero(alive)), left
            some, queue = (queue[:1], queue[1:]) if exact else (queue[:16], queue[16:])
            q, p = tree.near(v[some], n[some], alive, num, den)
            if exact and len(p):
                p = p[exact(some[0], p)]
                q = np.zeros(len(p), np.int64)
            p, first = np.unique(p, return_index=True)
            alive[p] = False
            edges += [(some[q[i]], int(x)) for i, x in zip(first.tolist(), p.tolist(), strict=True)]
            queue += p.tolist()
    return edges


def _grouped(batches, keys: int, least: int, handle):
    """Calls ``handle`` on tables that hold whole groups of equal leading ``keys`` columns of sorted batches."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not len(b):
            continue
        held.append(b)
        rows += len(b)
        if rows < least:
            continue
        t = pa.Table.from_batches(held)
        same = np.ones(len(t), bool)
        for i in range(keys):
            c = t.column(i).to_numpy()
            same &= c == c[-1]
        start = 0 if same.all() else int(np.flatnonzero(~same)[-1]) + 1
        if start and (out := handle(t.slice(0, start).combine_chunks())) is not None:
            yield out
        held = t.slice(start).combine_chunks().to_batches()
        rows = sum(map(len, held))
    if held and (out := handle(pa.Table.from_batches(held).combine_chunks())) is not None:
        yield out


def _edges(t: pa.Table, keys: int) -> tuple[np.ndarray, np.ndarray]:
    new = np.zeros(len(t), bool)
    new[0] = True
    for i in range(keys):
        c = t.column(i).to_numpy()
        new[1:] |= c[1:] != c[:-1]
    lo = np.flatnonzero(new)
    return lo, np.r_[lo[1:], len(t)]


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def narrow(v: np.ndarray) -> bytes:
    """A count vector, two counts in a byte if all are below 16; else an odd byte in front says that they aren't."""
    return (v[::2] << 4 | v[1::2]).tobytes() if v.max() < 16 else b"\0" + v.tobytes()


def wide(x: bytes) -> bytes:
    """The counts, a byte each."""
    if len(x) & 1:
        return x[1:]
    v = np.frombuffer(x, np.uint8)
    return np.stack([v >> 4, v & 15], 1).tobytes()


class Vectors:
    """Count vectors of rows by level; a row is seen at its own level and, folded, at the one below."""

    def __init__(self, raw: list[bytes]):
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        self.level = np.log2(np.maximum(size, 1)).astype(np.int64)
        self.at, self.own, self.folded = np.zeros(len(raw), np.int64), {}, {}
        for x in np.unique(self.level).tolist():
            rows = np.flatnonzero(self.level == x)
            self.at[rows] = np.arange(len(rows))
            m = np.frombuffer(b"".join([raw[i] for i in rows]), np.uint8).reshape(len(rows), -1)
            self.own[x] = m
            # group = hash mod 2**level, so halving the groups adds the two halves
            self.folded[x - 1] = m[:, : m.shape[1] // 2] + m[:, m.shape[1] // 2 :] if m.shape[1] > 1 else m

    def get(self, rows: np.ndarray, x: int) -> np.ndarray:
        out = np.zeros((len(rows), 1 << x), np.uint8)
        for lv, m in ((x, self.own.get(x)), (x + 1, self.folded.get(x))):
            here = self.level[rows] == lv
            if m is not None and here.any():
                out[here] = m[self.at[rows[here]]]
        return out

    def bounds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Summed minima of rows a and b, whose levels differ by one at most."""
        out, low = np.zeros(len(a), np.int64), np.minimum(self.level[a], self.level[b])
        for x in np.unique(low).tolist():
            which = np.flatnonzero(low == x)
            step = max(1, (1 << 22) >> x)
            for lo in range(0, len(which), step):
                w = which[lo : lo + step]
                out[w] = np.minimum(self.get(a[w], x), self.get(b[w], x)).sum(1, dtype=np.int64)
        return out


def _bucket_links(num: int, den: int):
    """Spanning candidate links of the buckets in rows (s, ci, cj, node, n, chunk, v) sorted by bucket."""

    def handle(t: pa.Table):
        lo, hi = _edges(t, 3)
        ci, cj, node, n, chunk = (t.column(i).to_numpy() for i in range(1, 6))
        out = [np.empty((2, 0), np.int64)]
        size = hi - lo
        many = np.repeat(size > 1, size).tolist()
        v = Vectors([wide(x) if m else b"\0" for x, m in zip(t.column(6).to_pylist(), many, strict=True)])
        for m in range(2, SMALL + 1):
            g = lo[(size == m) & (ci[lo] == cj[lo])]
            for i in range(m) if len(g) else ():
                for j in range(i):
                    x, y = g + i, g + j
                    near = (den * np.minimum(n[x], n[y]) >= num * np.maximum(n[x], n[y])) & (node[x] != node[y])
                    x, y = x[near], y[near]
                    ok = (den + num) * v.bounds(x, y) >= num * (n[x] + n[y])
                    out.append(np.stack([node[x[ok]], node[y[ok]]]))
        for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
            cross = ci[a] != cj[a]
            if b - a < 2 or b - a <= SMALL and not cross or cross and (chunk[a:b] == chunk[a]).all():
                continue
            rows = np.arange(a, b)
            for x in np.unique(v.level[a:b]).tolist():
                # rows of the next level stand in too as far as their size lets them be similar
                most = den * (1 << (x + 3)) // num + 1
                r = rows[(v.level[a:b] == x) | ((v.level[a:b] == x + 1) & (n[a:b] <= most))]
                e = np.array(forest(v.get(r, x), n[r], num, den), np.int64).reshape(-1, 2)
                out.append(np.stack([node[r[e[:, 0]]], node[r[e[:, 1]]]]))
        p = np.concatenate(out, axis=1)
        p = np.stack([p.min(0), p.max(0)])
        p = np.unique(p[:, p[0] != p[1]], axis=1)
        return batch(LINKS, a=pa.array(p[0]), b=pa.array(p[1])) if p.shape[1] else None

    return lambda batches: _grouped(batches, 3, 8192, handle)


def _cluster_links(num: int, den: int):
    """Exact spanning links of the clusters in rows (cluster, ci, cj, node, s) sorted by cluster."""

    def handle(t: pa.Table):
        lo, hi = _edges(t, 3)
        node, raw = t.column(3).to_numpy(), t.column(4)
        out = []
        for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in raw[a:b]]
            n = np.array([len(s) for s in sets], np.int64)
            start = np.r_[0, np.cumsum(n)]
            names, at = np.unique(np.concatenate(sets), return_inverse=True)
            mark = np.zeros(len(names), bool)

            def exact(i, rows, at=at, start=start, n=n, mark=mark):
                own = at[start[i] : start[i + 1]]
                mark[own] = True
                keep = []
                for j in rows.tolist():
                    o = int(np.count_nonzero(mark[at[start[j] : start[j + 1]]]))
                    keep.append(den * o >= num * (int(n[i]) + int(n[j]) - o))
                mark[own] = False
                return np.array(keep, bool)

            x = level(int(n.max()))
            e = np.array(forest(np.stack([counts(s, x) for s in sets]), n, num, den, exact), np.int64).reshape(-1, 2)
            out.append(np.stack([node[a:b][e[:, 0]], node[a:b][e[:, 1]]]))
        p = np.concatenate(out, axis=1)
        return batch(LINKS, a=pa.array(p.min(0)), b=pa.array(p.max(0))) if p.shape[1] else None

    return lambda batches: _grouped(batches, 3, 512, handle)


def _prefixes(k: int, num: int, den: int, hot):
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("prefix", pa.list_(pa.int64())), ("v", pa.binary())])

    def run(batches):
        words, frequent = FlatWords(), np.frombuffer(hot.value, np.uint64)
        for b in batches:
            node, n, prefix, vec = [], [], [], []
            for s in shingle_sets(b.column(0), words, k):
                if not len(s):
                    continue
                first = s
                if len(frequent):
                    common = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
                    if common.any():
                        first = np.concatenate([s[~common], s[common]])
                node.append(digest(s))
                n.append(len(s))
                prefix.append(first[: prefix_len(len(s), num, den)].view(np.int64))
                vec.append(narrow(counts(s)))
            yield batch(schema, node=node, n=n, prefix=prefix, v=vec)

    return run, "node long, n long, prefix array<long>, v binary"


def _shared_rows(bits):
    """Rows (s, node, n, v) of the prefix shingles that the bit filter has."""
    schema = pa.schema([("s", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("v", pa.binary())])

    def run(batches):
        packed = np.frombuffer(bits.value, np.uint8)
        for b in batches:
            lists = b.column(2)
            flat = lists.flatten().to_numpy()
            row = np.repeat(np.arange(len(b)), lists.value_lengths().to_numpy())
            keep = passes(packed, flat)
            row = pa.array(row[keep])
            yield batch(schema, s=pa.array(flat[keep]), node=b.column(0).take(row), n=b.column(1).take(row), v=b.column(3).take(row))

    return run, "s long, node long, n long, v binary"


def _sets(k: int, bits):
    """Rows (node, s) of texts whose id may be wanted."""
    schema = pa.schema([("node", pa.int64()), ("s", pa.binary())])

    def run(batches):
        packed, words = np.frombuffer(bits.value, np.uint8), FlatWords()
        for b in batches:
            ids = b.column(0)
            want = passes(packed, ids.fill_null(0).to_numpy(zero_copy_only=False)) | ids.is_null().to_numpy(zero_copy_only=False)
            sets = [s for s in shingle_sets(b.column(1).filter(pa.array(want)), words, k) if len(s)]
            yield batch(schema, node=[digest(s) for s in sets], s=[s.tobytes() for s in sets])

    return run, "node long, s binary"


def _dealt(rows: DataFrame, blocks, keys: list[str], what: list[str]) -> DataFrame:
    """Rows copied to each pair of blocks that theirs belongs to, gathered and sorted by ``keys`` and pair."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
    rows = rows.select(*keys, F.least("chunk", "o").alias("ci"), F.greatest("chunk", "o").alias("cj"), *[c for c in ("node", "n", "chunk") if c in what], *[c for c in what if c not in ("node", "n", "chunk")])
    return rows.repartition(parts, *keys, "ci", "cj").sortWithinPartitions(*keys, "ci", "cj", "node")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per input row: (doc_id, n_shingles long, component_id).

    Two texts link when ``den * |A & B| >= num * |A | B|`` on their distinct k-word
    shingles; ``component_id`` is the smallest id reachable by links. Null, empty
    and blank texts have no shingle and are their own component. Null ids are kept;
    they take the component of their text's other rows (null if there is none).
    Repeated rows stay; equal texts always share a component. Other columns are
    not read, whatever their names.
    """
    rows, named = _components(docs, id_col, text_col, k, num, den)
    out = rows.join(named, "node", "left")
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "doc").alias("component_id"))


def _components(docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(doc, row, n, node) of each input row, ``row`` being the text's xxhash64, and
    (node, comp, least) with the least id of each component."""
    spark, mark = docs.sparkSession, written()
    small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("txt"))
    run, schema = _first_pass(k)
    first = cut(docs.select("doc", "txt", F.xxhash64("txt").alias("row")).mapInArrow(run, schema), "first")
    first_path = last_written()
    hot = first.filter("hot").groupBy("node").agg(F.sum("n").alias("c")).orderBy(F.desc("c"), "node").limit(HOT_MAX).select("node").collect()
    hot = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in hot], np.int64).view(np.uint64)).tobytes())
    rows = first.filter("not hot").select("doc", "row", "n", "node")
    reps = cut(rows.filter("node is not null").groupBy("node").agg(F.min("doc").alias("label"), F.max("n").alias("n")), "nodes")

    run, schema = _prefixes(k, num, den, hot)
    pre = cut(docs.select("txt").mapInArrow(run, schema).dropDuplicates(["node"]), "prefix")
    drop_shuffles(spark)
    # a node has one row in ``pre`` and a shingle once in its prefix, so this counts nodes
    shared = cut(pre.select(F.explode("prefix").alias("s")).groupBy("s").agg(F.count("*").alias("c")).filter("c > 1"), "buckets")
    drop_shuffles(spark)
    run, schema = _shared_rows(bit_filter(shared, "s"))
    large = cut(shared.filter(F.col("c") > BLOCK), "large")
    rows_in = pre.mapInArrow(run, schema).join(large, "s", "left")
    dealt = _dealt(rows_in, F.ceil(F.coalesce("c", F.lit(1)) / BLOCK), ["s"], ["node", "n", "chunk", "v"])
    links = cut(dealt.mapInArrow(_bucket_links(num, den), "a long, b long").distinct(), "candidates")
    drop_shuffles(spark)
    clusters = cut(connected(links).withColumnRenamed("comp", "cluster").join(reps, "node"), "clusters")

    sizes = cut(clusters.groupBy("cluster").agg(F.sum("n").alias("total")).filter(F.col("total") > CLUSTER), "large")
    run, schema = _sets(k, bit_filter(clusters, "label"))
    sets = docs.mapInArrow(run, schema).join(clusters.select("node", "cluster"), "node").dropDuplicates(["node"])
    dealt = _dealt(sets.join(sizes, "cluster", "left"), F.ceil(2 * F.coalesce("total", F.lit(1)) / CLUSTER), ["cluster"], ["node", "s"])
    comps = cut(connected(dealt.mapInArrow(_cluster_links(num, den), "a long, b long")), "comps")

    named = reps.join(comps, "node", "left").select("node", "label", F.coalesce("comp", "node").alias("comp"))
    least = named.groupBy("comp").agg(F.min("label").alias("least"))
    named = cut(named.join(cut(least, "least"), "comp").select("node", "comp", "least"), "named")
    keep_only(spark, mark, first_path, last_written())
    return rows, named


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def near_copies_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of ``docs`` stays: the one with the smallest id, of equal
    ids that with the smallest hash of its text; null ids come last.

    A row is its id and text; rows that repeat both collapse to one. Texts without a word
    are components of their own. All other rows stay as they are, and only the rows that
    may go are moved.
    """
    mark = written()
    rows, named = _components(docs, id_col, text_col, 5, 80, 100)
    rows = rows.join(named.select("node", "comp"), "node", "left").groupBy("doc", "row").agg(F.first("comp").alias("comp"), F.count("*").alias("times"))
    rows = cut(rows, "rows")
    first = rows.filter("comp is not null").groupBy("comp").agg(F.min(F.coalesce("doc", F.lit(LAST))).alias("doc"))
    met = rows.filter("comp is not null").select("comp", F.coalesce("doc", F.lit(LAST)).alias("doc"), "row").join(first, ["comp", "doc"])
    first = cut(met.groupBy("comp").agg(F.first("doc").alias("first_doc"), F.min("row").alias("first_row")), "first")
    flags = rows.join(first, "comp", "left").select(
        F.col("doc").alias("__id"),
        F.col("row").alias("__row"),
        (F.coalesce("doc", F.lit(LAST)) != F.col("first_doc")) | (F.col("row") != F.col("first_row")),
        "times",
    )
    flags = flags.toDF("__id", "__row", "__goes", "__times").withColumn("__goes", F.coalesce("__goes", F.lit(False))).filter("__goes or __times > 1")
    flags = cut(flags, "flags")
    keep_only(docs.sparkSession, mark, last_written())
    rest, some = flagged(docs, flags, id_col, text_col)
    some = some.filter(~F.coalesce("__goes", F.lit(False)))
    once, again = some.filter("__times is null or __times = 1"), some.filter("__times > 1")
    return rest.unionByName(once.select(docs.columns)).unionByName(again.dropDuplicates(["__id", "__row"]).select(docs.columns))


def brute_components(rows: list[tuple], k: int = 5, num: int = 80, den: int = 100) -> list[tuple]:
    """The same by comparing all pairs of texts; for tests."""
    sets = []
    for _, t in rows:
        w = lowered_words(t)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and den * o >= num * (len(sets[i]) + len(sets[j]) - o):
                up[find(i)] = find(j)
    least: dict[int, float] = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), math.inf), d if d is not None else math.inf)
    return [(d, len(sets[i]), None if least[find(i)] == math.inf else int(least[find(i)])) for i, (d, _) in enumerate(rows)]


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP6_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w
), u AS (SELECT doc_id, unnest(sh) AS x, len(sh) AS n FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o, any_value(a.n) + any_value(b.n) AS total
  FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (SELECT a, b FROM p WHERE 100 * o >= 80 * (total - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT s.doc_id AS doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, c AS component_id FROM s JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = s.doc_id
"""
