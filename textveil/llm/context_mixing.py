"""The bit predictors of the language model, as numpy over whole chunks of texts or words.

Tokens become bits along a Huffman tree of the frequent words, the end and an escape; the
bytes of an escaped word become bits along a second tree. ``WordModel`` predicts the first
from the tree node after the last very frequent word, after the previous word and after the
two previous words, and from the word that followed when the previous word stood in the
same text last. ``Speller`` predicts the second from the node after two and three bytes and
after the whole word so far.

Each of these contexts leads to a slot of a hashed table that holds a pair of counts. Of a
pair one of 32 levels is seen: a prediction and how sure it is. The levels' log odds are
mixed in the logistic domain by weights that a gate chooses (how sure the longer contexts
are), learned online, one group of texts after another. Adaptive maps refine what each
combination of levels, a *cell*, gives, and the whole function is kept as one table of cells.
Inputs and gate follow from the cell, so counts of the bits that each cell has met in a group
are all that learning needs of the group's texts. From a text's second segment on, its
own scales of the log odds, corrected online after each segment, go on top. What was counted
is scored with its own count of each bit taken out. A text's result depends on the model and
the text alone, not on what is in its chunk.
"""

from __future__ import annotations

import copy
import heapq

import numpy as np
import pyarrow as pa

from .common import FlatWords, mix64

LEADERS = 64  # words so frequent that the last of them is a context
FORETOLD = 5  # the text foretells nothing; after one word a 0 or a 1, after two a 0 or a 1
LAST_SEGMENT = 4096  # bits between corrections of a text's scales, at first 512 and then twice as many each time
OWN_STEP = (1.0, 30.0)  # how far such a correction goes, and the curvature that holds it back
PRIOR = 0.4  # added to both counts of a pair
GROUPS, PASSES = 16, 2  # of texts by their hash, each of which gives one step of the weights; passes over them
STAY = 50.0  # curvature that holds the weights back
TRUST = 30.0  # bits that a cell's mixed prediction counts for against those it has met
END, ESCAPE = 0, 1
STOP = 0x20  # closes a spelled word; never a byte of one
FIRST = 256  # stands for the byte before a word
SYMBOL_BITS = 20
BLOCK = 4  # bits of a symbol whose pairs stand together, in 16 slots
EXPANDED = 20_000  # symbols whose bits are counted at once
PIECE = 1 << 16  # bytes of a word spelled at once
LEAST_BITS, MOST_BITS = 23, 24  # of the tables
SLOTS_A_ROOT = 4096  # slots of a table for each unit of the square root of the distinct words
_PRIME = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


class Tree(tuple):
    """(begin, nodes, bits): the path of symbol s is ``begin[s]:begin[s + 1]`` of the other two.

    A path is cut into blocks of ``BLOCK`` bits, whose nodes are a small tree below the block's
    first one: from ``block_begin[s]`` on are those of symbol s, with the hash of the first node,
    how many bits each has, and these bits as a number, filled up with zeros.
    """

    def __new__(cls, parts):
        self = super().__new__(cls, parts)
        begin, nodes, bits = self
        depth = np.arange(len(nodes)) - np.repeat(begin[:-1], np.diff(begin))
        head = np.flatnonzero(depth % BLOCK == 0)
        self.block_begin = np.searchsorted(head, begin)
        self.block_size = np.diff(head, append=len(nodes))
        self.block_node = (nodes[head].astype(np.uint64) + np.uint64(1)) * _PRIME[4]
        more = np.append(bits, np.zeros(BLOCK, np.uint8))
        self.block_bits = sum((more[head + j] * (self.block_size > j)).astype(np.int64) << BLOCK - 1 - j for j in range(BLOCK))
        return self


def huffman(weights: list[int]) -> Tree:
    n = len(weights)
    heap = [(max(1, w), i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    up, side, k = [0] * (2 * n), bytearray(2 * n), n
    while len(heap) > 1:
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        up[i] = up[j] = k
        side[j] = 1
        heapq.heappush(heap, (a + b, k))
        k += 1
    parent, turn, root = np.array(up, np.int32), np.frombuffer(side, np.uint8), k - 1
    at, depth = np.arange(n, dtype=np.int32), np.zeros(n, np.int64)
    while len(inner := np.flatnonzero(at != root)):
        depth[inner] += 1
        at[inner] = parent[at[inner]]
    begin = np.r_[0, np.cumsum(depth)]
    nodes, bits, at, place = np.empty(begin[-1], np.int32), np.empty(begin[-1], np.uint8), np.arange(n, dtype=np.int32), begin[1:].copy()
    while len(inner := np.flatnonzero(at != root)):
        place[inner] -= 1
        nodes[place[inner]], bits[place[inner]] = parent[at[inner]] - n, turn[at[inner]]
        at[inner] = parent[at[inner]]
    return Tree((begin, nodes, bits))


def table_bits(words: int) -> int:
    """Bits of the hashed tables for a number of distinct words."""
    return min(MOST_BITS, max(LEAST_BITS, round(np.log2(SLOTS_A_ROOT * max(1, words) ** 0.5))))


def quantised(counts: np.ndarray) -> np.ndarray:
    """Pairs as uint16 from an (n, 2) table of counts; larger ones are scaled down together."""
    top = counts.max(1)
    out = counts.astype(np.uint32)
    big = np.flatnonzero(top > 254)
    scaled = np.rint(counts[big] * (255.0 / top[big])[:, None]).astype(np.uint32)
    out[big] = np.where((counts[big] > 0) & (scaled == 0), 1, scaled)
    return (out[:, 0] | out[:, 1] << 8).astype(np.uint16)


def _level_tables():
    """The level of each pair with a count of 0 taken out, of 1, and (twice, for either bit) as it
    is; the log odds of each level; how sure it is, 0 to 3."""
    a, b = np.arange(65536) & 255, np.arange(65536) >> 8
    exact = (a < 255) & (b < 255)  # else the pair was scaled down and one more is nothing
    level = []
    for n0, n1 in ((a - exact, b), (a, b - exact), (a, b)):
        n0, n1 = np.maximum(n0, 0), np.maximum(n1, 0)
        n, odds = n0 + n1, np.log((n1 + PRIOR) / (n0 + PRIOR))
        few = 3 + np.sign(n1 - n0) * n
        level.append(np.select([n == 0, n < 3, n < 12], [0, few, 6 + np.clip(np.rint(odds / 0.82) + 4, 0, 8)], 15 + np.clip(np.rint(odds / 0.8) + 8, 0, 16)))
    one, two = (float(np.log((n + PRIOR) / PRIOR)) for n in (1, 2))
    odds = np.float32([0, -two, -one, 0, one, two, *((np.arange(9) - 4) * 0.82), *((np.arange(17) - 8) * 0.8)])
    return np.concatenate([*level, level[2]]).astype(np.uint8), odds, np.array([0] + [1] * 5 + [2] * 9 + [3] * 17)


LEVEL, ODDS, SURE = _level_tables()
LEVEL_BITS = 5
LEVEL_MASK = np.uint16((1 << LEVEL_BITS) - 1)
#: A pair's levels without a 0, without a 1 and, twice, as it is: bytes of one number.
LEVELS = np.stack([LEVEL[i << 16 : (i + 1) << 16] for i in range(4)], 1).astype(np.uint8).view(np.uint32).reshape(-1)


def _block_places():
    """For each number that a block's bits make: the bits, and the places of their nodes in the block."""
    leaf, j = np.arange(1 << BLOCK)[:, None], np.arange(BLOCK)
    return (leaf >> BLOCK - 1 - j) & 1, (1 << j) - 1 + (leaf >> BLOCK - j)


BLOCK_BITS, PLACES = _block_places()


def pairs_of(leaves: np.ndarray) -> np.ndarray:
    """(slots, 2) counts of the bits at the nodes of blocks, from counts of the numbers that the blocks' bits make."""
    n = leaves.reshape(-1, 1 << BLOCK)
    out = np.zeros((len(n), 1 << BLOCK, 2), leaves.dtype)
    for j in reversed(range(BLOCK)):
        n = n.reshape(len(n), 1 << j, 2)
        out[:, (1 << j) - 1 : (2 << j) - 1] = n
        n = n[:, :, 0] + n[:, :, 1]
    return out.reshape(-1, 2)


def levels_of(pairs: np.ndarray) -> np.ndarray:
    """The levels that the bits of a block see without themselves, one byte each, for all numbers
    that they make."""
    level = np.take(LEVELS, pairs).view(np.uint8).reshape(-1, 4 << BLOCK)
    return np.take(level, (PLACES * 4 + BLOCK_BITS).reshape(-1), axis=1).view(np.uint32).reshape(-1)


def _without_own(level: np.ndarray, table: np.ndarray, at: np.ndarray, path: Paths, owner: np.ndarray, context: np.ndarray) -> None:
    """Set the ``level`` of bits, ``BLOCK`` for each block, to that without what their owner has
    counted there; ``at`` is each block's place among the levels, ``context`` is each symbol's.

    ``level`` is without the bit itself, which is all that the text has counted where a context
    stands once in it; only the other blocks are grouped. Pairs that were scaled down stay as they are.
    """
    low = np.uint64(max(1, len(owner).bit_length()))
    key = mix64(context + owner.astype(np.uint64) * _PRIME[2]) >> low << low | np.arange(len(owner), dtype=np.uint64)
    key.sort()
    place = (key & ((np.uint64(1) << low) - np.uint64(1))).view(np.int64)
    key >>= low
    same = np.flatnonzero(key[1:] == key[:-1])
    again = np.zeros(len(owner), bool)
    again[place[same]] = again[place[same + 1]] = True
    some = np.flatnonzero(np.repeat(again, path.blocks))
    # where the last pair was scaled down, those above it were as well
    leaf = np.take(path.leaf, some)
    last = np.take(table, np.take(at, some) - leaf | np.take(PLACES[:, -1], leaf))
    exact = np.flatnonzero((last & 255 < 255) & (last >> 8 < 255))
    some, leaf = some[exact], leaf[exact]
    if not len(some):
        return
    # blocks of one owner that meet in one place
    key = np.take(np.repeat(owner << MOST_BITS, path.blocks), some)
    key |= np.take(at, some) >> BLOCK
    low = len(some).bit_length()
    if int(owner[-1]).bit_length() + MOST_BITS + low < 64:
        key <<= low
        key |= np.arange(len(some))
        key.sort()
        place = key & ((1 << low) - 1)
        key >>= low
    else:
        place = np.argsort(key, kind="stable")
        key = key[place]
    new = np.append(True, key[1:] != key[:-1])
    more = np.flatnonzero(~(new & np.append(new[1:], True)))  # one alone has counted only itself
    if not len(more):
        return
    group = np.cumsum(new)[more]
    group -= group[0]
    some, leaf = np.take(some, place[more]), np.take(leaf, place[more])
    nodes = np.take(PLACES, leaf, axis=0)
    pair = np.take(table, (np.take(at, some) & ~((1 << BLOCK) - 1))[:, None] | nodes).astype(np.int64)
    nodes += (group << BLOCK)[:, None]
    nodes <<= 1
    own = np.bincount((nodes | np.take(BLOCK_BITS, leaf, axis=0)).reshape(-1), minlength=(int(group[-1]) + 1) << BLOCK + 1)
    n0, n1 = pair & 255, pair >> 8
    exact = (n0 < 255) & (n1 < 255)
    n0, n1 = np.maximum(n0 - np.take(own, nodes), 0), np.maximum(n1 - np.take(own, nodes | 1), 0)
    level = level.reshape(-1, BLOCK)
    level[some] = np.where(exact, np.take(LEVEL, n0 | n1 << 8 | 2 << 16), np.take(level, some, axis=0))


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


class Paths:
    """The bits of some symbols: how many each has and where they begin, and the blocks of these bits."""

    def __init__(self, tree: Tree, symbol: np.ndarray):
        first, block = np.take(tree[0], symbol), np.take(tree.block_begin, symbol)
        self.size = np.take(tree[0], symbol + 1) - first
        self.start = np.cumsum(self.size) - self.size
        self.blocks = np.take(tree.block_begin, symbol + 1) - block
        block = _spans(block, self.blocks)
        self.node, self.leaf, self.block_size = (np.take(x, block) for x in (tree.block_node, tree.block_bits, tree.block_size))

    def slots(self, region: int, context: np.ndarray, bits: int) -> np.ndarray:
        """For each block the place of what its bits make, in these contexts of the symbols, of
        which the upper ``64 - SYMBOL_BITS`` bits count. A block's places are neighbours."""
        h = np.repeat((context >> np.uint64(SYMBOL_BITS)) * _PRIME[region % 4], self.blocks)
        h ^= self.node
        h *= _PRIME[(region + 1) % 4]
        h >>= np.uint64(64 + BLOCK - bits)
        h <<= np.uint64(BLOCK)
        h = h.view(np.int64)
        h |= self.leaf
        return h

    def bits(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cells, bits) of the bits that there are, from the cells of ``BLOCK`` for each block."""
        cells <<= np.uint16(1)
        cells |= np.take(_BLOCK_BYTES, self.leaf).view(np.uint8)
        cells = np.take(cells, _spans(np.arange(0, len(cells), BLOCK), self.block_size))
        return (cells >> np.uint16(1)).astype(np.int64), (cells & np.uint16(1)).astype(np.uint8)


_BLOCK_BYTES = BLOCK_BITS.astype(np.uint8).view(np.uint32).reshape(-1)


def _spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each first one on, so many each."""
    out = np.repeat(first - (np.cumsum(size) - size), size)
    out += np.arange(len(out))
    return out


def in_context(context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """A symbol and the upper bits of its context in one number."""
    return context >> np.uint64(SYMBOL_BITS) << np.uint64(SYMBOL_BITS) | symbol.astype(np.uint64)


def count_bits(tree, keys: list[np.ndarray], times, leaves: list[np.ndarray]) -> None:
    """Add what the blocks of symbols in their contexts make, each counted ``times``, to the counts
    for each kind of context. Symbols that repeat in a context are expanded once."""
    for i, (key, n) in enumerate(zip(keys, leaves, strict=True)):
        if times is None:
            key.sort()
            last = np.flatnonzero(np.append(key[1:] != key[:-1], True))
            key, many = key[last], np.diff(last, prepend=-1)
        else:
            key, back = np.unique(key, return_inverse=True)
            many = np.bincount(back, times)
        symbols, many = (key & np.uint64((1 << SYMBOL_BITS) - 1)).view(np.int64), many.astype(n.dtype)
        for lo in range(0, len(key), EXPANDED):
            part = slice(lo, lo + EXPANDED)
            path = Paths(tree, symbols[part])
            np.add.at(n, path.slots(i, key[part], len(n).bit_length() - 1), np.repeat(many[part], path.blocks))


class Cells:
    """Mixing weights of some tables' levels and, for each cell, the refined log odds.

    A cell is the level of each table and one of ``states``; ``x`` gives the tables' log odds
    for all cells and, as the last input, the states'.
    """

    def __init__(self, tables: int, states: int = 1, odds: tuple[float, ...] = (0.0,), w: np.ndarray | None = None, z: np.ndarray | None = None):
        cell = np.arange(states << LEVEL_BITS * tables, dtype=np.int32)
        level = [(cell >> LEVEL_BITS * i) & ((1 << LEVEL_BITS) - 1) for i in range(tables)]
        state = (cell >> LEVEL_BITS * tables).astype(np.uint8)
        if z is None:  # only learning needs the inputs themselves
            self.x = np.stack([*(ODDS[v] for v in level), np.array(odds, np.float32)[state]])
        self.gate = (state * 16 + SURE[level[-1]] * 4 + SURE[level[-2]]).astype(np.uint8)
        self.w = np.tile(np.float32([[0.3]] * tables + [[1.0]]), (1, 16 * states)) if w is None else w
        if z is None:
            self.mix()
        else:
            self.z = z
            self._logs()

    def mix(self, met: np.ndarray | None = None) -> None:
        """Log odds from the weights, refined by counts of the bits that each cell has met."""
        z = np.clip((self.w[:, self.gate] * self.x).sum(0), -9, 9)
        if met is not None:
            p = (met[:, 1] + TRUST * logistic(z)) / (met.sum(1) + TRUST)
            z = np.clip(np.log(p / (1 - p)), -13, 13)
        self.z = z.astype(np.float32)
        self._logs()

    def _logs(self) -> None:
        """Log probability of a 0 and of a 1 in each cell."""
        self.logs = -np.log1p(np.exp(np.stack([self.z, -self.z], 1))).reshape(-1)

    def learn(self, met: np.ndarray, power: np.ndarray) -> None:
        """One online step from the bits of some texts that each cell has met: against the gradient
        of their cost, divided by ``power``, the curvature of all that the pass has read so far and a
        prior that keeps gates with few bits where they are."""
        cell = np.flatnonzero(met.any(1))
        gate, x, n1, n = self.gate[cell], self.x[:, cell], met[cell, 1].astype(float), met[cell].sum(1).astype(float)
        p = logistic((self.w[:, gate] * x).sum(0, dtype=float))
        err = n1 - n * p
        # errors that are larger than their prediction says keep a step from going too far
        curve = np.maximum(n * p * (1 - p), n1 * (1 - p) ** 2 + (n - n1) * p**2)
        grad = np.stack([np.bincount(gate, err * v, len(power)) for v in x], 1)
        for i, v in enumerate(x):
            for j in range(i + 1):
                power[:, i, j] += np.bincount(gate, curve * v * x[j], len(power))
                power[:, j, i] = power[:, i, j]
        self.w += np.linalg.solve(power, grad[:, :, None])[:, :, 0].T.astype(np.float32)

    def fit(self, groups: np.ndarray) -> None:
        """Weights and maps from the bits, ``groups[g, cell, bit]``, that each cell has met in groups
        of texts, which are gone through in order."""
        for _ in range(PASSES):
            power = np.tile(STAY * np.eye(len(self.x)), (self.w.shape[1], 1, 1))
            for met in groups:
                self.learn(met, power)
        self.mix(groups.sum(0, dtype=np.int64))
        del self.x

    def empty(self) -> np.ndarray:
        """Counts of the bits that each cell has met in each group, none so far."""
        return np.zeros((GROUPS, len(self.z), 2), np.int64)


def add_met(groups: np.ndarray, group: np.ndarray, cell: np.ndarray, bit: np.ndarray) -> None:
    """Count bits in the cells and groups in which they were met."""
    at = group * np.int64(groups.shape[1])
    at += cell
    at <<= 1
    at |= bit
    np.add.at(groups.reshape(-1), at, 1)


class Reader(FlatWords):
    """Reads the words of a string column as hashes, without a Python object for any word."""

    def read(self, col):
        """``Texts`` of about ``size`` bytes each; a text that is longer is cut between words."""
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
        if pa.types.is_large_string(col.type):
            col = col.cast(pa.string())
        n = len(col)
        if not n:
            return
        offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
        data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.empty(0, np.uint8)
        row = 0
        while row < n:
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + self.size, "right")) - 1)
            lo, hi = int(offsets[row]), int(offsets[end])
            if hi - lo <= self.size or end > row + 1:
                yield self._texts(data[lo:hi], offsets[row : end + 1] - lo, np.arange(row, end), np.ones(end - row, bool))
            else:
                while lo < hi:
                    stop = min(hi, lo + self.size)
                    while stop < hi and not self.space[data[stop]]:
                        stop += 1
                    yield self._texts(data[lo:stop], np.array([0, stop - lo]), np.array([row]), np.array([stop == hi]))
                    lo = stop
            row = end

    def _texts(self, b: np.ndarray, offsets: np.ndarray, rows: np.ndarray, whole: np.ndarray) -> Texts:
        h, begin, starts, ends = self.words(b, offsets)
        return Texts(h, begin, rows, whole, b, starts, ends)


class Texts:
    """The words of some texts as hashes: text i, of row ``rows[i]``, has words
    ``begin[i]:begin[i + 1]``, and its end follows if ``whole[i]``."""

    def __init__(self, h, begin, rows, whole, data, starts, ends):
        self.h, self.begin, self.rows, self.whole, self.data, self.starts, self.ends = h, begin, rows, whole, data, starts, ends

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes().lower()


class Numbers:
    """Ids of the dictionary's words by their hashes; two probes and a sorted rest."""

    def __init__(self, h: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(4 * len(h) + 1))))
        self.shift, self.h = np.uint64(64 - bits), np.append(h, np.uint64(0))
        self.first, self.second = (np.full(1 << bits, len(h), np.int32) for _ in range(2))
        ids = np.arange(len(h), dtype=np.int32)
        self.first[self._slot(h)] = ids
        left = ids[self.first[self._slot(h)] != ids]
        self.second[self._other(h[left])] = left
        left = left[self.second[self._other(h[left])] != left]
        self.rest = left[np.argsort(h[left])]
        self.rest_h = h[self.rest]

    def _slot(self, h):
        return (h >> self.shift).view(np.int64)

    def _other(self, h):
        return ((h * _PRIME[2]) >> self.shift).view(np.int64)

    def of(self, h: np.ndarray) -> np.ndarray:
        """Number of each word, -1 for words that aren't in the dictionary."""
        out = np.take(self.first, self._slot(h))
        miss = np.flatnonzero(np.take(self.h, out) != h)
        x = h[miss]
        again = np.take(self.second, self._other(x))
        again[np.take(self.h, again) != x] = -1
        if len(self.rest):
            at = np.minimum(np.searchsorted(self.rest_h, x), len(self.rest) - 1)
            found = self.rest_h[at] == x
            again[found] = self.rest[at[found]]
        again[again == len(self.h) - 1] = -1
        out[miss] = again
        return out


class Levels:
    """Tables of pairs, and as what pairs are seen."""

    tables = levels = as_is = cells = None

    def count(self, *some) -> None:
        """Add the bits of texts (words, how often each) to 2 x slots counts, the last argument, for each kind of context."""
        *some, counts = some
        leaves = [np.zeros(len(n) // 2, n.dtype) for n in counts]
        self.count_blocks(*some, leaves)
        for n, x in zip(counts, leaves, strict=True):
            n += pairs_of(x).reshape(-1)

    def to_levels(self, pairs: bool = False) -> None:
        """Look the levels up once for all; scoring needs nothing else of the ``pairs``."""
        self.levels, self.as_is = [levels_of(x) for x in self.tables], [np.take(LEVEL[2 << 16 : 3 << 16], x) for x in self.tables]
        self.tables = self.tables if pairs else None

    def seen(self, path: Paths, contexts: list[np.ndarray], as_is: np.ndarray | None = None):
        """For each table (places in its levels, the levels there) of the blocks, without their own
        bits but for those that are to be seen ``as_is``."""
        if not self.levels:
            self.to_levels(True)
        some = np.flatnonzero(as_is) if as_is is not None else []
        leaf = np.take(path.leaf, some) if len(some) else None
        for i, (context, levels) in enumerate(zip(contexts, self.levels, strict=True)):
            at = path.slots(i, context, len(levels).bit_length() - 1)
            level = np.take(levels, at).view(np.uint8)
            if len(some):
                level.reshape(-1, BLOCK)[some] = np.take(self.as_is[i], (np.take(at, some) - leaf)[:, None] | np.take(PLACES, leaf, axis=0))
            yield at, level


class WordModel(Levels):
    """Last leader, previous word, two previous words, and the text's own past, over words with a code.

    ``frequent`` lists (word, count), ``rest`` is how many other tokens the corpus holds,
    ``ends`` how many texts. ``with_tables`` adds the pairs of the three hashed contexts.
    """

    TABLES = 3

    def __init__(self, frequent: list[tuple[bytes, int]], rest: int, ends: int):
        words = pa.array([x.decode("utf-8", "surrogatepass") for x, _ in frequent] or [""])
        self.numbers = Numbers(np.concatenate([h for _, h, _ in FlatWords().chunks(words)]))
        self.tree = huffman([ends, rest, *(c for _, c in frequent)])

    def with_tables(self, tables: list[np.ndarray], w=None, z=None) -> WordModel:
        """A copy that predicts, with new cells or those given."""
        out = copy.copy(self)
        out.tables, out.levels, out.cells = tables, None, Cells(self.TABLES, FORETOLD, (0, -1, 1, -2, 2), w, z)
        return out

    def symbols(self, t: Texts):
        """(ids, text, contexts) of the words and ends. What stands before the first word is one context."""
        words = np.diff(t.begin)
        lengths = words + t.whole
        n, first = int(lengths.sum()), np.cumsum(lengths) - lengths
        text = np.repeat(np.arange(len(lengths)), lengths)
        ids, word = np.full(n, END), np.full(n, _PRIME[3])
        is_word = np.ones(n, bool)
        is_word[(first + words)[t.whole]] = False
        number = self.numbers.of(t.h)
        ids[is_word] = np.where(number < 0, ESCAPE, number + 2)
        word[is_word] = t.h
        p1, p2 = np.empty_like(word), np.empty_like(word)
        p1[1:], p2[2:] = word[:-1], word[:-2]
        first = first[lengths > 0]
        p1[first] = p2[first] = _PRIME[0]
        second = first + 1
        second = second[second < n]
        p2[second[text[second] == text[second - 1]]] = _PRIME[0]
        place = np.arange(n)
        lead = np.zeros(n, np.int64)
        np.multiply((ids[:-1] >= 2) & (ids[:-1] < LEADERS + 2), place[1:], out=lead[1:])
        lead[first] = first
        lead = np.maximum.accumulate(lead)
        leader = word[lead - 1]
        leader[lead == np.repeat(first, lengths[lengths > 0])] = _PRIME[1]
        return ids, text, [leader, p1, p1 * _PRIME[1] ^ p2]

    def count_blocks(self, texts: list[Texts], counts: list[np.ndarray]) -> None:
        keys: list[list[np.ndarray]] = [[] for _ in counts]
        for t in texts:
            ids, _, contexts = self.symbols(t)
            for held, context in zip(keys, contexts, strict=True):
                held.append(in_context(context, ids))
        if texts:
            count_bits(self.tree, [np.concatenate(k) for k in keys], None, counts)

    def bits(self, t: Texts, counted: np.ndarray | None = None):
        """(cells, bits, text of each symbol, sizes, ids) of the bits of all texts; without
        ``counted`` all texts' counts are taken out wholly."""
        ids, text, contexts = self.symbols(t)
        path = Paths(self.tree, ids)
        as_is = None if counted is None else np.repeat(~counted[text], path.blocks)
        cell = np.zeros(len(path.leaf) * BLOCK, np.uint16)
        for i, (at, level) in enumerate(self.seen(path, contexts, as_is)):
            if counted is None:
                _without_own(level, self.tables[i], at, path, text, contexts[i])
            cell |= level.astype(np.uint16) << np.uint16(LEVEL_BITS * i)
        cell, bit = path.bits(cell)
        # where the text itself foretells the word, as long as the bits so far agree
        told, match, deep = _matches(text, contexts[1], ids)
        begin, nodes, bits = self.tree
        both = np.minimum(path.size[told], (begin[1:] - begin[:-1])[match])
        here, there = _spans(begin[ids[told]], both), _spans(begin[match], both)
        agree = np.flatnonzero(np.take(nodes, there) == np.take(nodes, here))
        state = 1 + np.take(bits, there[agree]) + 2 * np.repeat(deep, both)[agree]
        cell[_spans(path.start[told], both)[agree]] |= state << LEVEL_BITS * self.TABLES
        return cell, bit, text, path.size, ids

    def log_probs(self, t: Texts, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(natural log of each text's probability, but for the spelling of escaped words; ids);
        ``counted`` tells the texts whose counts are in the tables."""
        cell, bit, text, size, ids = self.bits(t, counted)
        n, count = len(cell), len(t.rows)
        first = np.r_[np.cumsum(size) - size, n][np.searchsorted(text, np.arange(count + 1))]
        # runs of bits: the first segments of all texts come first
        runs = [segment_runs(k) for k in np.diff(first).tolist()]
        segment, length = (np.concatenate([x[i] for x in runs] or [np.empty(0, np.int64)]) for i in range(2))
        owner = np.repeat(np.arange(count), [len(x[0]) for x in runs])
        order = np.argsort(segment, kind="stable")
        segment, owner, begin, length = segment[order], owner[order], (np.cumsum(length) - length)[order], length[order]
        order = _spans(begin, length)
        cell <<= 1
        cell |= bit
        cell = np.take(cell, order)
        sign = (cell & 1).astype(np.float32)
        sign *= 2
        sign -= 1
        cell >>= 1
        z = np.take(self.cells.z, cell)
        z *= sign  # of the bit that is there
        sets = self.cells.w.shape[1]
        row = np.repeat(owner * sets, length)
        row += np.take(self.cells.gate, cell)
        scale, p, lo = np.ones(count * sets, np.float32), np.empty(n, np.float32), 0
        for k, hi in enumerate(np.cumsum(np.bincount(segment, length)).astype(int).tolist()):
            x, r, q = z[lo:hi], row[lo:hi], p[lo:hi]
            np.multiply(np.take(scale, r), x, out=q)
            np.negative(q, out=q)
            np.exp(q, out=q)
            q += 1
            np.reciprocal(q, out=q)
            if not k & 1 and hi > lo:
                err = 1 - q
                err *= x
                power = err * x
                power *= q
                power = np.bincount(r, power, len(scale))
                power += OWN_STEP[1]
                step = np.bincount(r, err, len(scale))
                step /= power
                scale += step.astype(np.float32)
                np.clip(scale, 0.0, 3.0, out=scale)
            lo = hi
        np.maximum(p, np.float32(1e-6), out=p)
        np.log(p, out=p)
        some = np.flatnonzero(length)
        total = np.add.reduceat(p, (np.cumsum(length) - length)[some], dtype=float) if len(some) else p
        return np.bincount(owner[some], total, count), ids


def segment_runs(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(segments, sizes) of a text's bits: twice each segment, and one more for the last one, so
    that all first segments come before all second ones, and of each those that another one follows first."""
    ends = [512 << k for k in range((LAST_SEGMENT // 512).bit_length())]
    ends += range(ends[-1] + LAST_SEGMENT, n + LAST_SEGMENT, LAST_SEGMENT)
    sizes = np.diff([0, *(e for e in ends if e < n), n])
    keys = 2 * np.arange(len(sizes))
    keys[-1:] += 1
    return keys, sizes


def segments(n: int) -> np.ndarray:
    """The segment of each bit."""
    return np.repeat(*segment_runs(n))


def _matches(text: np.ndarray, p1: np.ndarray, ids: np.ndarray):
    """(place, id, deep) of the tokens before which the same word stood in the same text before:
    what followed it last, and whether the word before that was the same too."""
    n = len(ids)
    low = np.uint64(max(1, n.bit_length()))
    key = mix64(p1 + text.astype(np.uint64) * _PRIME[2]) >> low << low
    key |= np.arange(n, dtype=np.uint64)
    key.sort()
    place = (key & ((np.uint64(1) << low) - np.uint64(1))).view(np.int64)
    key >>= low
    same = np.flatnonzero(key[1:] == key[:-1])
    now, before = place[same + 1], place[same]
    same = np.flatnonzero((p1[now] == p1[before]) & (text[now] == text[before]))
    now, before = now[same], before[same]
    deep = (before > 0) & (text[before - 1] == text[before]) & (p1[now - 1] == p1[before - 1])
    return now, ids[before], deep.astype(np.int64)


class Speller(Levels):
    """Two and three bytes before and the whole word so far, over the bytes of words.
    ``with_tables`` adds the pairs of the three contexts."""

    TABLES = 3

    def __init__(self, frequent: list[tuple[bytes, int]]):
        letters = np.ones(256, np.int64)
        for x, _ in frequent:
            for b in x:
                letters[b] += 1
        letters[STOP] += len(frequent)
        self.tree = huffman(letters.tolist())

    def with_tables(self, tables: list[np.ndarray], w=None, z=None) -> Speller:
        out = copy.copy(self)
        out.tables, out.levels, out.cells = tables, None, Cells(self.TABLES, w=w, z=z)
        return out

    def symbols(self, words: list[bytes]):
        """(bytes, word of each, contexts) of the words, each closed by ``STOP``."""
        b = np.frombuffer(b" ".join(words) + b" ", np.uint8).astype(np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        starts = np.cumsum(sizes) - sizes
        inside = np.arange(len(b)) - np.repeat(starts, sizes)
        last = np.full((3, len(b)), FIRST, np.uint64)
        for k in range(3):
            last[k, k + 1 :] = b[: -k - 1]
            last[k, inside <= k] = FIRST
        two = last[0] | last[1] << np.uint64(9)
        three = two | last[2] << np.uint64(18)
        up, down = _powers(len(b))
        sums = np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)
        before = np.r_[np.uint64(0), sums[:-1]]
        prefix = (before - np.repeat(before[starts], sizes)) * np.repeat(down[starts], sizes) + inside.astype(np.uint64) * _PRIME[1]
        return b, np.repeat(np.arange(len(words)), sizes), [mix64(c + np.uint64(k << 40)) for k, c in enumerate((two, three, prefix))]

    def count_blocks(self, words: list[bytes], times: np.ndarray, counts: list[np.ndarray]) -> None:
        b, word, contexts = self.symbols(words)
        count_bits(self.tree, [in_context(c, b) for c in contexts], times[word], counts)

    def bits(self, words: list[bytes], counted: np.ndarray):
        """(cells, bits, word of each bit) of the words; ``counted`` tells those whose own count is to go."""
        b, word, contexts = self.symbols(words)
        path = Paths(self.tree, b)
        as_is = np.repeat(~counted[word], path.blocks)
        return *path.bits(self._cells(path, contexts, as_is)), np.repeat(word, path.size)

    def _cells(self, path: Paths, contexts: list[np.ndarray], as_is) -> np.ndarray:
        cell = np.zeros(len(path.leaf) * BLOCK, np.uint16)
        for i, (_, level) in enumerate(self.seen(path, contexts, as_is)):
            cell |= level.astype(np.uint16) << np.uint16(LEVEL_BITS * i)
        return cell

    def log_probs(self, words: list[bytes], counted: np.ndarray) -> np.ndarray:
        """Natural log of each word's probability, its close included."""
        cell, bit, word = self.bits(words, counted)
        return np.bincount(word, np.take(self.cells.logs, cell << 1 | bit), len(words))

    def both_log_probs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same as if the words weren't counted, and as if all were."""
        b, word, contexts = self.symbols(words)
        path = Paths(self.tree, b)
        both = (path.bits(self._cells(path, contexts, as_is)) for as_is in (np.ones(len(path.leaf), bool), None))
        word = np.repeat(word, path.size)
        return tuple(np.bincount(word, np.take(self.cells.logs, cell << 1 | bit), len(words)) for cell, bit in both)


_POWERS: list = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS.clear()
        for x in (0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)):
            one = np.full(2 * n, x, np.uint64)
            one[0] = 1
            _POWERS.append(np.cumprod(one, dtype=np.uint64))
    return [x[:n] for x in _POWERS]


def pieces(word: bytes) -> list[bytes]:
    """A very long word is spelled in pieces, as if they were words."""
    return [word] if len(word) <= PIECE else [word[i : i + PIECE] for i in range(0, len(word), PIECE)]
