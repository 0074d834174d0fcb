"""Random forests over sparse one-hot features: split finding by level, as an aggregate over the cells that are not zero.

A row is its numeric bins and one category per text column; no vector of feature width exists anywhere.  A category's id is
a hash of its column and value, so categories are neither collected nor numbered.  Each level of all trees is one pass: tasks
count (tree, node, feature, bin, statistic) over the cells of their rows, Spark adds the counts up, and each node's best split
follows from them; rows without a category are the node's total minus the rows with it.  Input columns are drawn per node by
a seeded hash of (tree, node, column), and of a text column with many categories a part of them, so that a wide column
neither costs more than others nor crowds them out.  Rows are drawn per tree by a seeded Poisson weight of the row's hash.
So a forest depends on neither files nor cluster.  The driver holds the splits: trees x nodes, whatever the number of categories or rows.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..schema import col

BINS = 32
# Groups in which splits are found; each holds the counts of its share of the nodes.
SPLIT_GROUPS = 64
# Distinct counts that a task holds before it folds them together.
HELD_CELLS = 2_000_000
# Levels at which a node without any useful drawn feature draws again.
DRAWS = 2
# Up to so many rows go to each task that grows whole trees, and trees of such a task.
WHOLE_ROWS, TREES = 16_384, 13
TOTAL = -(2 ** 31)

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _stirred(out: np.ndarray, part: np.ndarray | int) -> np.ndarray:
    """The hash ``out`` of the parts so far with one more part."""
    x = np.array(part, np.int64, ndmin=1).view(np.uint64) + (out * _STEP + _STEP)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def mixed(*parts: np.ndarray | int) -> np.ndarray:
    """A well-spread 64-bit hash of whole numbers, element by element."""
    out = np.zeros(1, np.uint64)
    for p in parts:
        out = _stirred(out, p)
    return out


def uniform(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(float) * 2.0 ** -53


_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
# The weight for each value of a hash's first 16 bits; 255 where the other bits decide.
_FIRST = np.searchsorted(_POISSON, np.arange(2 ** 16) * 2.0 ** -16, side="right").astype(np.uint8)
_FIRST[_FIRST != np.searchsorted(_POISSON, np.arange(1, 2 ** 16 + 1) * 2.0 ** -16, side="right")] = 255


# Rows that are hashed or counted together, so that what is between stays in the processor's cache.
HASHED = 16_384


def bootstrap(rows: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is drawn for a tree."""
    rows = np.ascontiguousarray(rows, np.int64).view(np.uint64)
    out, first = np.empty(len(rows), np.uint8), mixed(seed, tree) * _STEP + _STEP
    for i in range(0, len(rows), HASHED):
        # As ``_stirred``, without arrays between.
        x = rows[i:i + HASHED] + first
        own, other = out[i:i + HASHED], x >> np.uint64(30)
        x ^= other
        x *= _M1
        x ^= np.right_shift(x, np.uint64(27), out=other)
        x *= _M2
        x ^= np.right_shift(x, np.uint64(31), out=other)
        np.take(_FIRST, np.right_shift(x, np.uint64(48), out=other).view(np.int64), out=own, mode="clip")
        near = np.flatnonzero(own == 255)
        own[near] = np.searchsorted(_POISSON, uniform(x[near]), side="right")
    return out


@dataclass
class Grown:
    """One tree: parallel lists by node.  ``kind`` is -1 for a numeric split (bin up to ``cut`` goes left), else the text
    column whose category ``feature`` goes right; a leaf's ``left`` is -1."""

    kind: list[int] = field(default_factory=list)
    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    stats: list[tuple[float, ...]] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    draws: list[int] = field(default_factory=list)

    def add(self, stats: Sequence[float], depth: int) -> int:
        for own, value in ((self.kind, -1), (self.feature, 0), (self.cut, 0), (self.left, -1), (self.gain, 0.0),
                           (self.stats, tuple(stats)), (self.depth, depth), (self.draws, 0)):
            own.append(value)
        return len(self.left) - 1


# Rows that are scored together.
SCORED = 65_536
# Rows of a node from which on the rows of all such nodes go down together.
FEW = 2_048
# Of so many rows a node must hold one for its rows to be marked among all instead of listed.
MARKED = 32


class Walk:
    """A tree's splits as arrays over the cells of some rows: whole numbers, one row of ``cells`` per input column.

    Text columns hold a category's place among ``ids``, one sorted array per text column.
    """

    def __init__(self, grown: Grown, numbers: int, ids: Sequence[np.ndarray]):
        kind, feature = np.array(grown.kind), np.array(grown.feature, np.int64)
        self.left, self.numbers = np.array(grown.left), numbers
        self.column = np.where(kind < 0, feature, numbers + kind)
        # A row goes right if its value is above ``low`` and not above ``high``.
        self.low, self.high = np.array(grown.cut), np.full(len(kind), 255)
        for k, own in enumerate(ids):
            at = np.flatnonzero((kind == k) & (self.left >= 0))
            place = _places(own, feature[at])
            self.low[at], self.high[at] = np.where(place < 0, 0, place - 1), np.where(place < 0, 0, place)
        self._bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def leads_to(self, wanted: np.ndarray) -> np.ndarray:
        """Whether a wanted node lies at or below each node."""
        out = wanted.copy()
        for i in range(len(out) - 1, -1, -1):  # children come after their parent
            if self.left[i] >= 0:
                out[i] |= out[self.left[i]] | out[self.left[i] + 1]
        return out

    @cached_property
    def used(self) -> set[int]:
        """The input columns of the splits."""
        return set(self.column[self.left >= 0].tolist())

    def bounds(self, column: int) -> tuple[np.ndarray, np.ndarray]:
        """Above which value of the column, and up to which, a row passes the way to each node; where a way splits by a category
        of the column, no value does."""
        if column not in self._bounds:
            # A category without a split is -1.
            above, upto = np.full(len(self.left), -2), np.full(len(self.left), 255 if column < self.numbers else np.iinfo(np.int32).max)
            for i in np.flatnonzero(self.left >= 0):  # parents come before their children
                for child in (self.left[i], self.left[i] + 1):
                    above[child], upto[child] = above[i], upto[i]
                if self.column[i] == column and column < self.numbers:
                    upto[self.left[i]] = min(upto[i], self.low[i])
                    above[self.left[i] + 1] = max(above[i], self.low[i])
                elif self.column[i] == column:
                    above[[self.left[i], self.left[i] + 1]] = np.iinfo(np.int32).max
            self._bounds[column] = above, upto
        return self._bounds[column]

    def right(self, v: np.ndarray, node: int) -> np.ndarray:
        """Whether rows with these cells of the node's column go right."""
        low, high = int(self.low[node]), int(self.high[node])  # plain numbers keep the type of the cells
        if self.column[node] < self.numbers:
            return v > low
        return v == high if low < high else np.zeros(len(v), bool)

    def parts(self, cells: np.ndarray, narrow: Sequence[np.ndarray], rows: np.ndarray | None = None, live: np.ndarray | None = None
              ) -> tuple[list[tuple[np.ndarray, int]], np.ndarray, np.ndarray]:
        """(parts, rows, leaves): the given rows, by default all, or those marked as true; the rows of each leaf on whose way all
        nodes hold more than ``FEW``, and the other rows with their leaves.  Rows that leave the ``live`` nodes are dropped.
        ``narrow`` holds the same cells, column by column."""
        found: list[tuple[np.ndarray, int]] = []
        few: list[tuple[np.ndarray, int]] = []
        n = cells.shape[1]
        marked = rows is None or rows.dtype == bool
        held = n if rows is None else np.count_nonzero(rows) if marked else len(rows)
        ways = [(rows, 0, held)] if held and (live is None or live[0]) else []
        while ways:
            own, node, held = ways.pop()
            marked = own is None or own.dtype == bool
            if marked and (self.left[node] < 0 or held <= FEW or held * MARKED < n):
                own, marked = np.arange(n) if own is None else np.flatnonzero(own), False
            if held <= FEW:
                few.append((own, node))
                continue
            if self.left[node] < 0:
                found.append((own, node))
                continue
            left, right = self.left[node], self.left[node] + 1
            v = narrow[self.column[node]]
            side = self.right(v if marked else v[own], node)
            for child in (left, right):
                if live is None or live[child]:
                    going = side if child == right else ~side
                    part = (going if own is None else going & own) if marked else own[going]
                    count = np.count_nonzero(part) if marked else len(part)
                    if count:
                        ways.append((part, child, count))
        out: list[tuple[np.ndarray, np.ndarray]] = []
        if few:
            own, node = np.concatenate([r for r, _ in few]), np.repeat([i for _, i in few], [len(r) for r, _ in few])
            while len(own):
                ended = self.left[node] < 0
                if ended.any():
                    out.append((own[ended], node[ended]))
                    own, node = own[~ended], node[~ended]
                v = cells[self.column[node], own]
                node = self.left[node] + ((v > self.low[node]) & (v <= self.high[node]))
                if live is not None:
                    kept = live[node]
                    own, node = own[kept], node[kept]
        if not out:
            return found, np.empty(0, np.int64), np.empty(0, np.int64)
        return found, np.concatenate([r for r, _ in out]), np.concatenate([i for _, i in out])

    def down(self, cells: np.ndarray, rows: np.ndarray | None = None, live: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(rows, leaves): the given rows, by default all, and the leaf each comes to; rows that leave the ``live`` nodes are dropped."""
        parts, own, node = self.parts(cells, cells, rows, live)
        return (np.concatenate([*[r for r, _ in parts], own]),
                np.concatenate([*[np.full(len(r), i) for r, i in parts], node]))


def _places(ids: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The place of each value among the sorted ids, -1 for others."""
    if not len(ids):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(ids, values), len(ids) - 1)
    return np.where(ids[at] == values, at, -1)


def _bins(x: pa.Array, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bin numbers of the numeric values: how many edges lie below."""
    values = x.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(edges)) if edges else np.empty((len(x), 0))
    out = np.empty((len(x), len(edges)), np.uint8)
    for j, e in enumerate(edges):
        out[:, j] = np.searchsorted(e, values[:, j], side="left")
    return out


def _cats(c: pa.Array, width: int) -> np.ndarray:
    return np.array(c.flatten().to_numpy(zero_copy_only=False)).reshape(-1, width) if width else np.empty((len(c), 0), np.int64)


def slim(columns: Iterable[np.ndarray]) -> list[np.ndarray]:
    """The columns of numbers from 0 on, in one byte where they fit."""
    return [c.astype(np.uint8) if len(c) and c.max() < 256 else c for c in columns]


@dataclass
class Block:
    """The rows of a task as arrays: hashes, labels, the cells that a ``Walk`` reads, and the ids of each text column's categories."""

    h: np.ndarray
    y: np.ndarray
    cells: np.ndarray
    ids: list[np.ndarray]

    @cached_property
    def label(self) -> np.ndarray:
        """The class numbers."""
        return self.y.astype(np.int32)

    @cached_property
    def narrow(self) -> list[np.ndarray]:
        """The cells of each column in one byte where they fit."""
        return slim(self.cells)

    @classmethod
    def of(cls, batches: Sequence[pa.RecordBatch], edges: Sequence[np.ndarray], width: int) -> Block:
        h, y = (np.concatenate([b.column(i).to_numpy() for b in batches]) for i in (0, 1))
        bins = np.concatenate([_bins(b.column(2), edges) for b in batches])
        cats = np.concatenate([_cats(b.column(3), width) for b in batches])
        found = [np.unique(cats[:, k], return_inverse=True) for k in range(width)]
        return cls(h, y, np.array([*bins.T, *(code for _, code in found)], np.int32).reshape(-1, len(h)), [ids for ids, _ in found])

    def packed(self, numbers: int) -> pa.RecordBatch:
        parts = [self.h, self.y, self.cells[:numbers].astype(np.uint8), self.cells[numbers:], np.concatenate([*self.ids, np.empty(0, np.int64)])]
        return pa.RecordBatch.from_arrays([*[pa.array([p.tobytes()], pa.binary()) for p in parts], pa.array([[len(i) for i in self.ids]], pa.list_(pa.int64()))],
                                          names=["h", "y", "bins", "codes", "ids", "lengths"])

    @classmethod
    def unpacked(cls, batch: pa.RecordBatch, i: int) -> Block:
        h, y, bins, codes, ids = (np.frombuffer(batch.column(k)[i].as_buffer(), kind) for k, kind in enumerate((np.int64, float, np.uint8, np.int32, np.int64)))
        cells = np.concatenate([bins.astype(np.int32), codes]).reshape(-1, len(h))
        return cls(h, y, cells, np.split(ids, np.cumsum(batch.column(5)[i].as_py())[:-1]) if batch.column(5)[i].as_py() else [])


PACKED = "h binary, y binary, bins binary, codes binary, ids binary, lengths array<bigint>"


def packed(rows: DataFrame, edges: Sequence[np.ndarray], width: int) -> DataFrame:
    """Each task's rows (h, y, x, c) as one block of bytes, binned and coded once for all levels."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b for b in batches if b.num_rows]
        if own:
            yield Block.of(own, edges, width).packed(len(edges))

    return rows.select("h", "y", "x", "c").mapInArrow(pack, PACKED)


def _summed(keys: np.ndarray, values: Sequence[np.ndarray], span: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The keys that occur, in order, and the sums of each of the values; the first value is above zero in every row."""
    if span <= 8 * len(keys) + 1024:
        totals = [np.bincount(keys, v, span) for v in values]
        found = np.flatnonzero(totals[0])
        return found, [t[found] for t in totals]
    found, back = np.unique(keys, return_inverse=True)
    return found, [np.bincount(back, v, len(found)) for v in values]


def impurity(stats: np.ndarray, classes: int) -> np.ndarray:
    """Gini impurity, or the variance."""
    n = stats.sum(axis=-1) if classes else stats[..., 0]
    n = np.where(n > 0, n, 1)
    if classes:
        return 1 - (stats ** 2).sum(axis=-1) / n ** 2
    return np.maximum(stats[..., 2] / n - (stats[..., 1] / n) ** 2, 0)


def _cell_schema(classes: int) -> str:
    """Counts: per class, or the three sums of a regression."""
    return "t int, node int, kind int, f bigint, bin int, " + ("s int, v double" if classes else "n double, y double, yy double")


# What a task needs of a tree: its splits, and of each open node the place, the draws made and what share of the rows it holds.
Growing = tuple[int, Grown, np.ndarray, np.ndarray, float]


def _growing(trees: list[Grown], classes: int, first: int = 0) -> list[Growing]:
    """The trees with open nodes, without what only the driver needs."""
    out = []
    for t, g in enumerate(trees):
        number = np.array([i for i, (l, d) in enumerate(zip(g.left, g.draws)) if l < 0 and d >= 0], np.int64)
        if len(number):
            size = (lambda i: sum(g.stats[i])) if classes else (lambda i: g.stats[i][0])
            share = sum(map(size, number)) / size(0) if g.stats[0] else 1.0
            splits = Grown(*(np.array(x, np.int64) for x in (g.kind, g.feature, g.cut, g.left)))
            out.append((first + t, splits, number, np.array([g.draws[i] for i in number]), share))
    return out


def _histogram(trees: list[Growing], numbers: int, sizes: Sequence[int], classes: int, seed: int, drawn: int):
    """Counts of a block's rows for all open nodes and the features drawn there."""
    part = [min(1.0, max(BINS, math.sqrt(n)) / max(n, 1)) for n in sizes]
    columns = numbers + len(sizes)

    per = classes or 1

    def counted(block: Block, coded: Sequence[np.ndarray], t: int, splits: Grown, number: np.ndarray, draw: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Parts of the counts as columns of cells; ``coded`` holds the block's cells times the classes plus the label."""
        walk = Walk(splits, numbers, block.ids)
        place = np.full(len(walk.left), -1)
        place[number] = np.arange(len(number))
        live = walk.leads_to(place >= 0)
        if share_of[t] > 0.5:
            every = bootstrap(block.h, t, seed)
            large, at, leaf = walk.parts(block.cells, block.narrow, every > 0, live)
            drawn_rows = [(own, every[own]) for own in (*[own for own, _ in large], at)]
        else:  # few rows are still in open nodes
            large, at, leaf = walk.parts(block.cells, block.narrow, None, live)
            drawn_rows = []
            for own in (*[own for own, _ in large], at):
                weight = bootstrap(block.h[own], t, seed)
                drawn_rows.append((own[weight > 0], weight[weight > 0]))
                if own is at:
                    leaf = leaf[weight > 0]
        # The columns with the smallest hashes at each node.
        h = mixed(seed, t, number[:, None], draw[:, None], np.arange(columns)[None, :])
        tried = np.zeros(h.shape, bool)
        np.put_along_axis(tried, np.argsort(h, axis=1, kind="stable")[:, :drawn], True, axis=1)
        # Of a column with many categories a part is drawn.
        asked = [mixed(seed, t, number, draw, k) if part[k] < 1 else None for k in range(len(sizes))]

        def none(k: np.ndarray) -> np.ndarray:
            return np.zeros(len(k), np.int64)

        def columns_of(node: np.ndarray, key: np.ndarray, sums: Sequence[np.ndarray], kind: int, f, bin_of) -> tuple[np.ndarray, ...]:
            """Sums per (node, code and class); the functions name a code's feature and bin."""
            code, n = key // per, len(key)
            return (np.full(n, t), node, np.full(n, kind), f(code), bin_of(code), *([key % per] if classes else []), *sums)

        def values_of(rows: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
            w = weight.astype(float)
            if classes:
                return [w]
            y = block.y[rows]
            return [w, w * y, w * (y * y)]

        # Nodes with many rows are counted one by one.
        step = max(1, HELD_CELLS // ((1 if classes else 3) * max(numbers, 1) * BINS * per))
        for first in range(0, len(large), step):
            several = list(zip(large, drawn_rows))[first:first + step]
            whole = np.zeros((1 if classes else 3, len(several), per))
            binned = np.zeros((len(whole), len(several), numbers, BINS * per))
            for i, ((_, node), (rows, weight)) in enumerate(several):
                local = place[node]
                own = np.flatnonzero(tried[local])
                told = classes and (own < numbers).any()  # the counts of any number add up to those of the node
                for c in range(0, len(rows), HASHED):  # by pieces that stay in the processor's cache
                    piece = rows[c:c + HASHED]
                    values = values_of(piece, weight[c:c + HASHED])
                    if not told:
                        for k, v in enumerate(values):
                            whole[k, i] += np.bincount(block.label[piece], v, per) if classes else v.sum()
                    for j in own[own < numbers]:
                        key = coded[j][piece]
                        for k, v in enumerate(values):
                            binned[k, i, j] += np.bincount(key, v, BINS * per)
                if told:
                    whole[0, i] = binned[0, i, own[0]].reshape(BINS, per).sum(axis=0)
                for j in own[own >= numbers]:
                    ids, kept = block.ids[j - numbers], slice(None)
                    if part[j - numbers] < 1:
                        code, seen = block.cells[j][rows], asked[j - numbers][local:local + 1]
                        if len(ids) < len(code):
                            kept = np.flatnonzero((uniform(_stirred(seen, ids)) < part[j - numbers])[code])
                        else:
                            kept = np.flatnonzero(uniform(_stirred(seen, ids[code])) < part[j - numbers])
                    key, sums = _summed(coded[j][rows[kept]].astype(np.int64), values_of(rows[kept], weight[kept]), len(ids) * per)
                    yield columns_of(np.full(len(key), node), key, sums, j - numbers, lambda k, v=ids: v[k], none)
            nodes = np.array([node for (_, node), _ in several], np.int64)
            i, key = np.nonzero(whole[0])
            yield columns_of(nodes[i], key, [w[i, key] for w in whole], TOTAL, none, none)
            i, j, key = np.nonzero(binned[0])
            yield columns_of(nodes[i], key, [b[i, j, key] for b in binned], -1, lambda k, j=j: j, lambda k: k)

        # The others together.
        rows, weight = drawn_rows[-1]
        if not len(rows):
            return
        local, values = place[leaf], values_of(rows, weight)

        def add(keys: np.ndarray, chosen: np.ndarray | slice, span: int, kind: int, f, bin_of) -> tuple[np.ndarray, ...]:
            k, sums = _summed(keys, [v[chosen] for v in values], len(number) * span * per)
            return columns_of(number[k // (span * per)], k % (span * per), sums, kind, f, bin_of)

        everyone = slice(None)
        yield add(local * per + (block.label[rows] if classes else 0), everyone, 1, TOTAL, none, none)
        for j in range(columns):
            chosen = everyone if tried[:, j].all() else np.flatnonzero(tried[local, j])
            own, key = local[chosen], coded[j][rows[chosen]].astype(np.int64)
            if not len(own):
                continue
            if j < numbers:
                yield add(own * (BINS * per) + key, chosen, BINS, -1, lambda k, j=j: np.full(len(k), j), lambda k: k)
                continue
            ids = block.ids[j - numbers]
            if part[j - numbers] < 1:
                kept = np.flatnonzero(uniform(_stirred(asked[j - numbers][own], ids[key // per])) < part[j - numbers])
                if not len(kept):
                    continue
                chosen = kept if isinstance(chosen, slice) else chosen[kept]
                own, key = own[kept], key[kept]
            yield add(own * (len(ids) * per) + key, chosen, len(ids), j - numbers, lambda k, v=ids: v[k], none)

    share_of = {t: share for t, _, _, _, share in trees}

    def count(block: Block) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        coded = slim(c * per + block.label for c in block.cells) if classes else block.narrow
        cells = 0
        for t, splits, number, draw, _ in trees:
            own = [c for c in counted(block, coded, t, splits, number, draw) if len(c[0])]
            held += own
            cells += sum(len(c[0]) for c in own)
            if cells > HELD_CELLS:
                yield _cells(held, classes)
                held, cells = [], 0
        if held:
            yield _cells(held, classes)

    return count


def _cells(held: list[tuple[np.ndarray, ...]], classes: int) -> pa.RecordBatch:
    kinds = [np.int32, np.int32, np.int32, np.int64, np.int32, *([np.int32, float] if classes else [float] * 3)]
    names = ["t", "node", "kind", "f", "bin", *(["s", "v"] if classes else ["n", "y", "yy"])]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(kind)) for c, kind in zip(zip(*held), kinds)], names=names)


SPLITS = "t int, node int, kind int, f bigint, bin int, gain double, total array<double>, left array<double>"


def _best_splits(classes: int):
    """Each node's best split of one group of counts; kind ``TOTAL`` where no drawn feature lowers the impurity."""
    width = classes or 3

    def best(cells: pa.Table) -> pa.Table:
        t, node, kind, f, bins = (cells[n].to_numpy() for n in ("t", "node", "kind", "f", "bin"))
        # Each cell adds to one class, or to the three sums.
        parts = [(cells["s"].to_numpy(), cells["v"].to_numpy())] if classes else [(i, cells[n].to_numpy()) for i, n in enumerate(("n", "y", "yy"))]
        nodes, of = np.unique(t.astype(np.int64) << 32 | node, return_inverse=True)
        totals = np.zeros((len(nodes), width))
        whole = kind == TOTAL
        for s, v in parts:
            np.add.at(totals, (of[whole], s[whole] if classes else s), v[whole])
        rest = np.flatnonzero(~whole)
        order = rest[np.lexsort((bins[rest], f[rest], kind[rest], of[rest]))]
        of, kind, f, bins = (x[order] for x in (of, kind, f, bins))
        out_kind, out_f, out_bin = np.full(len(nodes), TOTAL), np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
        out_gain, out_left = np.zeros(len(nodes)), np.zeros((len(nodes), width))
        if len(order):
            group = np.ones(len(order), bool)
            group[1:] = (of[1:] != of[:-1]) | (kind[1:] != kind[:-1]) | (f[1:] != f[:-1])
            cell = group.copy()
            cell[1:] |= bins[1:] != bins[:-1]
            number = np.cumsum(cell) - 1
            stats = np.zeros((number[-1] + 1, width))
            for s, v in parts:
                np.add.at(stats, (number, s[order] if classes else s), v[order])
            first = np.flatnonzero(cell)
            of, kind, f, bins, starts = of[first], kind[first], f[first], bins[first], group[first]
            # Left of a numeric edge lie the bins up to it; left of a category lie the rows without it.
            running = np.cumsum(stats, axis=0)
            begin = np.maximum.accumulate(np.where(starts, np.arange(len(first)), 0))
            upto = running - np.where(begin[:, None] > 0, running[np.maximum(begin - 1, 0)], 0)
            left = np.where(kind[:, None] < 0, upto, totals[of] - stats)
            right = totals[of] - left
            size = (lambda x: x.sum(axis=1)) if classes else (lambda x: x[:, 0])
            n, nl, nr = size(totals[of]), size(left), size(right)
            gain = impurity(totals[of], classes) - (nl * impurity(left, classes) + nr * impurity(right, classes)) / np.maximum(n, 1)
            scale = np.maximum(impurity(totals[of], classes), 1e-300)
            useful = (nl > 0.5) & (nr > 0.5) & (gain > 1e-12 * scale)
            gain = np.where(useful, np.round(gain / scale, 10) * scale, -1.0)
            # The largest gain; the first feature and bin among equals.
            rank = np.lexsort((bins, f, kind, -gain, of))
            top = rank[np.append(True, of[rank][1:] != of[rank][:-1])]
            top = top[gain[top] > 0]
            to = of[top]
            out_kind[to], out_f[to], out_bin[to], out_gain[to], out_left[to] = kind[top], f[top], bins[top], gain[top], left[top]
        return pa.table({
            "t": pa.array((nodes >> 32).astype(np.int32)), "node": pa.array((nodes & 0xFFFFFFFF).astype(np.int32)), "kind": pa.array(out_kind.astype(np.int32)),
            "f": pa.array(out_f), "bin": pa.array(out_bin.astype(np.int32)), "gain": pa.array(out_gain),
            "total": pa.array(list(totals), pa.list_(pa.float64())), "left": pa.array(list(out_left), pa.list_(pa.float64()))})

    return best


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of ``SCORED`` and more, as a walk down a tree costs some calls for each of its nodes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= SCORED:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def category_id(column: int, value: Column) -> Column:
    """A category as one number: the hash of its column's place and its text."""
    return F.xxhash64(F.lit(column), value)


@dataclass
class Forest:
    """A grown forest over rows (numeric array ``x``, category ids ``c``)."""

    trees: list[Grown]
    edges: list[np.ndarray]
    width: int
    classes: int

    def leaf_values(self, t: int) -> np.ndarray:
        """Class shares or the mean of each node."""
        stats = np.array(self.trees[t].stats, float)
        if self.classes:
            return stats / np.maximum(stats.sum(axis=1, keepdims=True), 1)
        return stats[:, 1:2] / np.maximum(stats[:, :1], 1)

    def importances(self) -> dict[tuple[int, int], float]:
        """Share of the impurity that each (kind, feature) takes away, averaged over trees and adding up to 1."""
        out: dict[tuple[int, int], float] = {}
        for grown in self.trees:
            own: dict[tuple[int, int], float] = {}
            for kind, f, left, gain, stats in zip(grown.kind, grown.feature, grown.left, grown.gain, grown.stats):
                if left >= 0:
                    n = sum(stats) if self.classes else stats[0]
                    own[(kind, f)] = own.get((kind, f), 0.0) + n * gain
            total = sum(own.values())
            for key, value in own.items():
                out[key] = out.get(key, 0.0) + value / total
        total = sum(out.values())
        return {k: v / total for k, v in out.items()} if total else {}

    def walks(self) -> tuple[list[np.ndarray], list[Walk], list[np.ndarray]]:
        """The categories that splits name, per text column, and each tree's walk over them and leaf values."""
        ids = [np.unique(np.array([f for g in self.trees for kind, f, l in zip(g.kind, g.feature, g.left) if kind == k and l >= 0], np.int64))
               for k in range(self.width)]
        return ids, [Walk(g, len(self.edges), ids) for g in self.trees], [self.leaf_values(t) for t in range(len(self.trees))]

    def cells(self, x: pa.Array, c: pa.Array, ids: Sequence[np.ndarray]) -> np.ndarray:
        """The rows' cells; categories that no split names are -1."""
        bins, cats = _bins(x, self.edges), _cats(c, self.width)
        return np.array([*bins.T, *(_places(own, cats[:, k]) for k, own in enumerate(ids))], np.int32).reshape(-1, len(x))

    def predicted(self, x: pa.Array, c: pa.Array, walks: tuple | None = None) -> np.ndarray:
        """Mean leaf value of each row: class shares, or one number."""
        ids, ways, values = walks or self.walks()
        cells = self.cells(x, c, ids)
        out = np.zeros((len(x), max(self.classes, 1)))
        for walk, value in zip(ways, values):
            rows, leaf = walk.down(cells)
            at = np.empty(len(x), np.int64)
            at[rows] = leaf
            out += value[at]
        return out / max(len(self.trees), 1)

    def shuffled(self, x: pa.Array, c: pa.Array, dx: pa.Array, dc: pa.Array, walks: tuple | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(source, predictions): -1 for the rows as they are, then with one source column after the other taken from the
        donor rows (numbers first, then text columns); only rows that the donor's value turns off their way walk again."""
        ids, ways, values = walks or self.walks()
        cells, other = self.cells(x, c, ids), self.cells(dx, dc, ids)
        first = []
        for walk in ways:
            rows, leaf = walk.down(cells)
            at = np.empty(len(x), np.int64)
            at[rows] = leaf
            first.append(at)
        whole = np.zeros((len(x), max(self.classes, 1)))
        for value, at in zip(values, first):
            whole += value[at]
        yield -1, whole / len(self.trees)
        for source in range(len(self.edges) + self.width):
            kept, donor = cells[source].copy(), other[source]
            cells[source] = donor
            total = whole.copy()
            differ = np.flatnonzero(kept != donor)
            for walk, value, at in zip(ways, values, first):
                if source not in walk.used:
                    continue
                above, upto = walk.bounds(source)
                own, v = at[differ], donor[differ]
                moved, leaf = walk.down(cells, differ[(v <= above[own]) | (v > upto[own])])
                total[moved] += value[leaf] - value[at[moved]]
            cells[source] = kept
            yield source, total / len(self.trees)

    def score(self, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
        """The kept columns and ``raw array<double>`` of rows with ``x`` and ``c``."""
        shared = rows.sparkSession.sparkContext.broadcast(self)
        fields = rows.select(*[col(k) for k in keep]).schema

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            walks = shared.value.walks()
            for batch in merged(batches):
                found = shared.value.predicted(batch.column(len(keep)), batch.column(len(keep) + 1), walks)
                offsets = pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))],
                                                 names=[*batch.schema.names[:len(keep)], "raw"])

        return rows.select(*[col(k) for k in keep], "x", "c").mapInArrow(add, fields.add("raw", T.ArrayType(T.DoubleType())))


def grow(rows: DataFrame, edges: list[np.ndarray], sizes: Sequence[int], classes: int, trees: int = 100, max_depth: int = 10,
         seed: int = 42, drawn: int | None = None, count: int | None = None) -> Forest:
    """Grows a forest on rows (h bigint, y double, x array<double>, c array<bigint>).

    ``edges`` are the bin edges of each numeric value, ``sizes`` the numbers of categories of the text columns.  A node
    draws ``drawn`` of the input columns, by default the square root of their number (all for regression), and of a drawn text column ``BINS`` categories or the square root of their number.  ``classes`` is 0 for
    regression, else y is a class number.  ``count`` may tell the number of rows.  A node ends at ``max_depth``, when it is pure, or when ``DRAWS`` draws in turn
    hold no feature that helps.
    """
    columns, width = len(edges) + len(sizes), len(sizes)
    if drawn is None:
        drawn = math.ceil(math.sqrt(columns)) if classes else columns
    forest = Forest([Grown() for _ in range(trees)], edges, width, classes)
    for grown in forest.trees:
        grown.add([], 0)
    if count is not None and count <= WHOLE_ROWS:
        # So few rows are sent to a few tasks, which grow some of the trees each by the same steps.
        def several(table: pa.Table) -> pa.Table:
            number = table["block"][0].as_py()
            block = Block.of(table.select(["h", "y", "x", "c"]).combine_chunks().to_batches(), edges, width)
            own = [Grown() for _ in range(number * TREES, min(trees, (number + 1) * TREES))]
            for grown in own:
                grown.add([], 0)
            while _open(own):
                cells = pa.Table.from_batches(_histogram(_growing(own, classes, number * TREES), len(edges), sizes, classes, seed, drawn)(block))
                found = _best_splits(classes)(cells)
                _advance(own, found.set_column(0, "t", pc.subtract(found["t"], pa.scalar(number * TREES, pa.int32()))), classes, max_depth)
            return pa.table({"block": pa.array([number], pa.int32()), "trees": pa.array([pickle.dumps([g.__dict__ for g in own])], pa.binary())})

        copies = rows.select("h", "y", "x", "c").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((trees - 1) // TREES))))
        for r in copies.groupBy("block").applyInArrow(several, "block int, trees binary").collect():
            for i, fields in enumerate(pickle.loads(bytes(r["trees"]))):
                forest.trees[r["block"] * TREES + i] = Grown(**fields)
        return forest
    blocks = packed(rows, edges, width).persist()
    group = F.pmod(F.hash("t", "node"), F.lit(SPLIT_GROUPS))
    sums = ["v"] if classes else ["n", "y", "yy"]
    try:
        while _open(forest.trees):
            count_block = _histogram(_growing(forest.trees, classes), len(edges), sizes, classes, seed, drawn)

            def level(batches: Iterator[pa.RecordBatch], count_block=count_block) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for i in range(batch.num_rows):
                        yield from count_block(Block.unpacked(batch, i))

            # A task has each cell once, so they are added up only where a group's cells meet.
            cells = (blocks.mapInArrow(level, _cell_schema(classes)).withColumn("g", group).repartition("g")
                     .groupBy("g", "t", "node", "kind", "f", "bin", *(["s"] if classes else [])).agg(*[F.sum(n).alias(n) for n in sums]))
            found = cells.groupBy("g").applyInArrow(lambda table: _best_splits(classes)(table), SPLITS).toArrow()  # one row an open node
            _advance(forest.trees, found, classes, max_depth)
    finally:
        blocks.unpersist()
    return forest


def _open(trees: list[Grown]) -> bool:
    return any(l < 0 and d >= 0 for g in trees for l, d in zip(g.left, g.draws))


def _advance(trees: list[Grown], found: pa.Table, classes: int, max_depth: int) -> None:
    """Splits the open nodes as found; pure, deep and unhelped ones become leaves."""
    for r in sorted(found.to_pylist(), key=lambda r: (r["t"], r["node"])):
        grown, i = trees[r["t"]], r["node"]
        grown.stats[i] = tuple(r["total"])
        if r["kind"] == TOTAL:
            pure = impurity(np.array(r["total"]), classes) <= 1e-12
            grown.draws[i] = -1 if pure or grown.draws[i] + 1 >= DRAWS else grown.draws[i] + 1
            continue
        left, right = np.array(r["left"]), np.array(r["total"]) - np.array(r["left"])
        grown.kind[i], grown.feature[i], grown.cut[i], grown.gain[i] = r["kind"], r["f"], r["bin"], r["gain"]
        grown.left[i] = len(grown.left)
        for part in (left, right):
            child = grown.add(part.tolist(), grown.depth[i] + 1)
            if grown.depth[child] >= max_depth or impurity(part, classes) <= 1e-12 * max(1.0, abs(float(part[-1]))):
                grown.draws[child] = -1
    for t, grown in enumerate(trees):  # no row was drawn for them
        for i, (l, d) in enumerate(zip(grown.left, grown.draws)):
            if l < 0 and d >= 0 and not grown.stats[i]:
                grown.draws[i] = -1
                grown.stats[i] = (0.0,) * (classes or 3)
