"""Boosted trees over sparse rows: all models of a cross-validation grow together, one Spark job a level.

The loss, the trees and the model are those of Spark ML's ``GBTClassifier``, whose rows of bins are dense:
it adds up a cell for every feature of a row, at every level. Here a row is the bins of its features that are
not where zero is; what zeros add to a node is its total less the rest. Below a root, only rows of a node's smaller
child are added up; its sibling is what the node has more. Sums are dealt by slices of the features, which keep those
of the level before. The driver holds trees alone.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import cached_property
from typing import ClassVar

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.core.broadcast import Broadcast
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.regression import DecisionTreeRegressionModel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from prioscope.config import BoosterConfig
from prioscope.functions.durable import drop, durable

MAX_BINS = 32
#: Rows that bins are cut by, as in Spark ML; every row is trained on.
CUT_ROWS = 10_000
#: Fewer rows than this are not worth a task of their own: each task sends sums for all nodes of a level.
ROWS_A_TASK = 4096
#: After so many rounds the rows are stored with their margins, which ends the lineage of those that are held.
STORED_ROUNDS = 10
ROWS_AT_ONCE = 4096
#: Nodes whose splits are looked for together: their sums by bin fit a core's cache.
NODES_AT_ONCE = 8
#: What a row of label 1 adds to a task's count of rows; one of label 0 adds 1. A task has fewer rows of either.
ONE = float(1 << 26)
#: Gains are equal up to this share: sums that are differences of others are not exact.
EQUAL = 1e-9


# ---------------------------------------------------------------------------
# Bins
# ---------------------------------------------------------------------------
def thresholds(values: np.ndarray, n_rows: int) -> list[float]:
    """At most ``MAX_BINS`` - 1 cuts of a feature's values in ``n_rows`` rows; rows that are not given have zero."""
    zeros = n_rows - len(values)
    found, n = np.unique(np.concatenate([values, np.zeros(1 if zeros else 0)]), return_counts=True)
    if zeros:
        n[np.searchsorted(found, 0.0)] += zeros - 1
    if len(found) <= MAX_BINS:
        at = np.arange(len(found) - 1)
    else:
        below = np.cumsum(n)
        wanted = below[-1] / MAX_BINS * np.arange(1, MAX_BINS)
        after = np.clip(np.searchsorted(below, wanted), 1, len(found) - 1)
        at = np.unique(np.where(wanted - below[after - 1] <= below[after] - wanted, after - 1, after))
        at = at[at < len(found) - 1]
    return ((found[at] + found[at + 1]) / 2).tolist()


@dataclass(frozen=True)
class Bins:
    """The cuts of each feature. A value's bin is the number of cuts below it; a code names a bin other than zero's."""

    cuts: list[list[float]]

    @cached_property
    def sizes(self) -> np.ndarray:
        return np.array([len(c) + 1 for c in self.cuts], int)

    @cached_property
    def starts(self) -> np.ndarray:
        """Where the bins of a feature start among those of all features."""
        return np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(int)

    @cached_property
    def zero(self) -> np.ndarray:
        """The bin of zero, by feature."""
        return np.array([np.searchsorted(c, 0.0) for c in self.cuts], int)

    @cached_property
    def place(self) -> np.ndarray:
        """By code, its bin among those of all features."""
        other = np.ones(self.sizes.sum(), bool)
        other[self.starts + self.zero] = False
        return np.flatnonzero(other)

    @cached_property
    def owner(self) -> np.ndarray:
        """By code, its feature."""
        return np.repeat(np.arange(len(self.sizes)), self.sizes)[self.place]

    @cached_property
    def bin(self) -> np.ndarray:
        """By code, its bin of the feature."""
        return (self.place - self.starts[self.owner]).astype(np.uint8)

    @classmethod
    def fit(cls, df: DataFrame, size: int) -> Bins:
        """Cuts from at most about ``CUT_ROWS`` rows, chosen by a hash of their key."""
        n = df.count()
        chosen = df.filter(F.pmod(F.xxhash64("key", F.lit("cuts")), F.lit(1 << 20)) < math.ceil((1 << 20) * min(1.0, CUT_ROWS / max(n, 1))))
        entries = durable(chosen.select(F.explode(F.arrays_zip("indices", "values")).alias("e"), F.lit(1)).select("e.*"))
        n_chosen = chosen.count()

        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"indices": batch["indices"], "cuts": [thresholds(np.asarray(v), n_chosen) for v in batch["v"]]})

        # a feature has at most a value a chosen row; the driver gets the cuts
        own = entries.groupBy("indices").agg(F.collect_list("values").alias("v")).mapInPandas(cut, "indices INT, cuts ARRAY<DOUBLE>")
        cuts: list[list[float]] = [[] for _ in range(size)]
        for row in own.collect():
            cuts[row.indices] = list(row.cuts)
        drop(entries)
        return cls(cuts)

    def coded(self, df: DataFrame) -> DataFrame:
        """``df`` in blocks of rows, with the codes of each row's features in place of their values; stored."""
        width = 1 << int(max(1, self.sizes.max() - 1)).bit_length()
        wide = np.full((len(self.cuts), width), np.inf)
        for f, cuts in enumerate(self.cuts):
            wide[f, : len(cuts)] = cuts
        first = self.starts - np.arange(len(self.cuts))  # a code less its bin, before zero's
        zero, kind = self.zero, np.uint16 if len(self.place) < 1 << 16 else np.int32

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for all_rows in batches:
                for k in range(0, all_rows.num_rows, ROWS_AT_ONCE):
                    batch = all_rows.slice(k, ROWS_AT_ONCE)
                    f, x, row = *[batch.column(c).flatten().to_numpy(False) for c in ("indices", "values")], _rows_of(batch, "indices")
                    own, step = np.zeros(len(f), int), width
                    while step > 1:  # the number of cuts below x, by halves
                        step //= 2
                        own += step * (x > wide[f, own + step - 1])
                    other = own != zero[f]
                    codes = (first[f] + own - (own > zero[f]))[other].astype(kind)
                    ends = np.concatenate([[0], np.cumsum(np.bincount(row[other], minlength=batch.num_rows))])
                    group = batch.column("own").flatten().to_numpy(False).reshape(batch.num_rows, -1)
                    block = Block(batch.column("key").to_numpy(), group, batch.column("y").to_numpy(), ends, codes, np.zeros(0))
                    yield pa.RecordBatch.from_arrays([pa.array([own], pa.binary()) for own in block.stored()], list(Block.TYPES))

        return durable(df.mapInArrow(code, BLOCKS))


def _rows_of(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.repeat(np.arange(batch.num_rows), batch.column(name).value_lengths().to_numpy(False))


def boosted_model(trees: list[DecisionTreeRegressionModel], weights: list[float], size: int) -> GBTClassificationModel:
    """Spark ML's model made of given trees, such as the first few of a longer training."""
    spark = SparkSession.active()
    gateway, ml = spark.sparkContext._gateway, spark._jvm.org.apache.spark.ml
    own = gateway.new_array(ml.regression.DecisionTreeRegressionModel, len(trees))
    shares = gateway.new_array(gateway.jvm.double, len(trees))
    for i, (tree, weight) in enumerate(zip(trees, weights, strict=True)):
        own[i], shares[i] = tree._java_obj, float(weight)
    made = ml.classification.GBTClassificationModel(f"gbtc_{uuid.uuid4().hex[:12]}", own, shares, size, 2)
    return GBTClassificationModel(made)


def n_asked(strategy: str, size: int) -> int:
    """Features a node may choose from, by Spark ML's names for it."""
    named = {"auto": size, "all": size, "sqrt": math.ceil(math.sqrt(size)), "onethird": math.ceil(size / 3),
             "log2": max(1, math.ceil(math.log2(max(size, 1))))}
    if strategy in named:
        return named[strategy]
    return min(size, int(strategy)) if strategy.isdigit() else math.ceil(float(strategy) * size)


# ---------------------------------------------------------------------------
# Trees
# ---------------------------------------------------------------------------
@dataclass
class Tree:
    """A tree over bins: a row goes left where the bin of ``feature`` is at most ``bin``; leaves have feature -1.

    ``sums`` are rows' weights, weighted targets and their number.
    """

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    sums: list[list[float]] = field(default_factory=lambda: [[0.0, 0.0, 0.0]])

    def split(self, node: int, feature: int, bin: int, gain: float, sums: list[float], left: list[float]) -> list[int]:
        """Give a node its sums and, if ``feature`` is one, two leaves below it; their numbers."""
        self.sums[node] = sums
        if feature < 0:
            return []
        new = len(self.feature)
        self.feature[node], self.bin[node], self.left[node], self.gain[node] = feature, bin, new, gain
        self.feature += [-1, -1]
        self.bin += [0, 0]
        self.left += [0, 0]
        self.gain += [0.0, 0.0]
        self.sums += [left, [a - b for a, b in zip(sums, left, strict=True)]]
        return [new, new + 1]

    def values(self) -> np.ndarray:
        return np.array([g / w if w > 0 else 0.0 for w, g, _ in self.sums])

    def leaves(self, seen: np.ndarray, column: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The leaf of some ``rows`` of ``seen``, bins of some features; ``column`` has their places by feature."""
        feature, cut, left = np.array(self.feature), np.array(self.bin), np.array(self.left)
        own = np.where(feature >= 0, column[feature], 0)
        at, every = np.zeros(len(rows), int), np.arange(len(rows))
        while len(every):
            every = every[feature[at[every]] >= 0]
            node = at[every]
            at[every] = left[node] + (seen[rows[every], own[node]] > cut[node])
        return at

    def spark_tree(self, spark: SparkSession, bins: Bins, size: int) -> DecisionTreeRegressionModel:
        """Spark ML's model of the tree. Sums of squares are not kept, so impurities are NaN."""
        gateway, jvm = spark.sparkContext._gateway, spark._jvm.org.apache.spark
        values, nodes = self.values(), {}
        # all numbers go over at once, as bytes
        facts = np.array([[w, g, math.nan] for w, g, _ in self.sums], ">f8")
        stats = gateway.new_array(gateway.jvm.double, facts.size)
        gateway.jvm.java.nio.ByteBuffer.wrap(facts.tobytes()).asDoubleBuffer().get(stats)
        part, leaf, inner = gateway.jvm.java.util.Arrays.copyOfRange, jvm.ml.tree.LeafNode, jvm.ml.tree.InternalNode
        counted, ask = jvm.mllib.tree.impurity.VarianceCalculator, jvm.ml.tree.ContinuousSplit
        for i in reversed(range(len(self.feature))):  # children come after their parent
            own = counted(part(stats, 3 * i, 3 * i + 3), int(self.sums[i][2]))
            if self.feature[i] < 0:
                nodes[i] = leaf(float(values[i]), math.nan, own)
            else:
                cut = ask(self.feature[i], float(bins.cuts[self.feature[i]][self.bin[i]]))
                nodes[i] = inner(
                    float(values[i]), math.nan, float(self.gain[i]), nodes.pop(self.left[i]), nodes.pop(self.left[i] + 1), cut, own)
        made = jvm.ml.regression.DecisionTreeRegressionModel(f"dtr_{uuid.uuid4().hex[:12]}", nodes[0], size)
        return DecisionTreeRegressionModel(made)


# ---------------------------------------------------------------------------
# Rows
# ---------------------------------------------------------------------------
@dataclass
class Block:
    """Some rows, by column: keys, own groups, labels (1 or -1), codes and where those of a row end, margins by model."""

    TYPES: ClassVar[dict] = {"key": np.int64, "own": np.int32, "y": np.float64, "ends": np.int64, "codes": None, "margins": np.float64}

    key: np.ndarray
    own: np.ndarray
    y: np.ndarray
    ends: np.ndarray
    codes: np.ndarray
    margins: np.ndarray

    def stored(self) -> tuple[bytes, ...]:
        return tuple(np.ascontiguousarray(getattr(self, c), kind).tobytes() for c, kind in self.TYPES.items())

    @classmethod
    def of(cls, row: Row, kind: type, n_models: int) -> Block:
        """A stored block; without margins they are zero."""
        own = {c: np.frombuffer(row[c], known or kind) for c, known in cls.TYPES.items()}
        n = len(own["key"])
        margins = own["margins"] if len(own["margins"]) else np.zeros(n * n_models)
        return cls(**own | {"own": own["own"].reshape(n, -1), "margins": margins.reshape(n, n_models)})

    def seen(self, bins: Bins, trees: Iterable[Tree]) -> tuple[np.ndarray, np.ndarray]:
        """The bins of all features that some tree asks, and where each feature stands among them."""
        asked = np.unique([f for t in trees for f in t.feature if f >= 0]).astype(int)
        column = np.full(len(bins.cuts), -1)
        column[asked] = np.arange(len(asked))
        seen = np.tile(bins.zero[asked].astype(np.uint8), (len(self.y), 1))
        if len(self.codes) and len(asked):
            at = column[bins.owner][self.codes]
            known = np.flatnonzero(at >= 0)
            row = np.repeat(np.arange(len(self.y)), np.diff(self.ends))[known]
            seen[row, at[known]] = bins.bin[self.codes[known]]
        return seen, column


BLOCKS = ", ".join(f"{c} BINARY" for c in Block.TYPES)


@dataclass(frozen=True)
class Model:
    """A model of all rows but those of group ``number`` by the grouping ``of``; weights by label (0, 1)."""

    of: int
    number: int
    weights: tuple[float, float]


@dataclass(frozen=True)
class Pair:
    """A node whose children are to be split. Rows of the smaller child are added up; its sibling is what is left."""

    model: int
    parent: int  # its place among the nodes of the level before
    nodes: tuple[int, int]
    small: int  # the side with fewer rows


@dataclass(frozen=True)
class Level:
    """What tasks need to grow a level of trees: the roots of ``roots``, or the children of ``pairs``."""

    bins: Broadcast
    booster: BoosterConfig
    seed: int
    round: int
    models: list[Model]
    growing: dict[int, Tree]
    roots: list[int]
    pairs: list[Pair]
    losses: list[int]  # models whose loss on held-out rows is wanted
    slices: np.ndarray  # by slice, its first feature; and their number

    @property
    def nodes(self) -> list[tuple[int, int]]:
        """Model and node, in the order of sums."""
        return [(m, 0) for m in self.roots] + [(p.model, node) for p in self.pairs for node in p.nodes]

    def _chosen(self, key: np.ndarray) -> np.ndarray:
        """Rows of the round's subsample, the same for all models, by a hash of their key."""
        with np.errstate(over="ignore"):
            x = key.astype(np.uint64) + np.uint64(self.seed * 1009 * 100_003 + self.round + 1) * np.uint64(0x9E3779B97F4A7C15)
            for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
        return (x ^ (x >> np.uint64(31))) < np.uint64(min(self.booster.subsampling_rate * 2.0**64, 2.0**64 - 2**12))

    def add_up(self, blocks: Iterable[Block]) -> Iterator[tuple[int, tuple]]:
        """For each slice of features, sums of rows of the roots or smaller children (rows by label, weighted target): in all, by code.

        A row of label 1 counts ``ONE`` more than one of label 0, so one sum has both numbers.
        """
        bins = self.bins.value
        size = len(bins.place)
        own: dict[int, list[int]] = {m: [0] for m in self.roots}
        for p in self.pairs:
            own.setdefault(p.model, []).append(p.nodes[p.small])
        sums = {m: np.zeros((2, len(nodes) * size)) for m, nodes in own.items()}
        total = {m: np.zeros((2, len(nodes))) for m, nodes in own.items()}
        loss = {m: np.zeros(2) for m in self.losses}
        some = False
        for block in blocks:
            some = True
            self._add_rows(bins, block, own, sums, total, loss)
        if not some:
            return
        both = [np.concatenate(x) for x in ([total[m].T for m in own], [sums[m].reshape(2, -1, size).swapaxes(0, 1) for m in own])]
        both = [np.stack([x[:, 0] - (ones := np.floor(x[:, 0] / ONE)) * ONE, ones, x[:, 1]], axis=1) for x in both]
        ends = np.searchsorted(bins.owner, self.slices)
        for s in range(len(self.slices) - 1):
            yield s, ("part", both[0], both[1][:, :, ends[s] : ends[s + 1]], None if s else loss)

    def _add_rows(self, bins: Bins, block: Block, own: dict, sums: dict, total: dict, loss: dict) -> None:
        size = len(bins.place)
        seen, column = block.seen(bins, self.growing.values()) if self.pairs else (None, None)
        lengths = np.diff(block.ends)
        for m in loss:
            held = block.own[:, self.models[m].of] == self.models[m].number
            loss[m] += [2 * np.logaddexp(0, -2 * block.y[held] * block.margins[held, m]).sum(), held.sum()]
        chosen = self._chosen(block.key)
        # a row's target: the first tree learns the labels, the others what is left: half the slope of the loss, twice
        counted, classes = np.where(block.y > 0, ONE, 1.0), (block.y > 0).astype(int)

        def targets(m: int, rows: np.ndarray) -> np.ndarray:
            y, weight = block.y[rows], np.array(self.models[m].weights)[classes[rows]]
            return weight * (y if not self.round else 4 * y * np.exp(-np.logaddexp(0, 2 * y * block.margins[rows, m])))

        if not self.pairs:
            codes, counted = block.codes.astype(int), np.where(chosen, counted, 0)
            by_entry = np.repeat(counted, lengths)
            for of in {self.models[m].of for m in own}:
                # a model's rows are those of all groups less its own: they are counted once by group
                n = sum(model.of == of for model in self.models)
                group = block.own[:, of]
                cells = np.bincount(np.repeat(group * size, lengths) + codes, by_entry, n * size).reshape(n, size)
                rows = np.bincount(group, counted, n)
                for m in [m for m in own if self.models[m].of == of]:
                    number = self.models[m].number
                    sums[m][0] += cells.sum(axis=0) - cells[number]
                    total[m][0] += rows.sum() - rows[number]
                    used = np.flatnonzero(chosen & (group != number))
                    target = np.zeros(len(lengths))
                    target[used] = targets(m, used)
                    sums[m][1] += np.bincount(codes, np.repeat(target, lengths), size)
                    total[m][1] += target.sum()
            return
        for m, nodes in own.items():
            tree, slot_of = self.growing[m], np.full(len(self.growing[m].feature), -1)
            slot_of[nodes] = np.arange(len(nodes))
            used = np.flatnonzero((block.own[:, self.models[m].of] != self.models[m].number) & chosen)
            slot = slot_of[tree.leaves(seen, column, used)]
            used, slot = used[slot >= 0], slot[slot >= 0]
            n = lengths[used]
            start = np.repeat(block.ends[used] - (np.cumsum(n) - n), n)
            at = np.repeat(slot * size, n) + block.codes[start + np.arange(len(start))]
            for i, part in enumerate((counted[used], targets(m, used))):
                total[m][i] += np.bincount(slot, part, len(nodes))
                sums[m][i] += np.bincount(at, np.repeat(part, n), len(nodes) * size)

    def grow(self, items: Iterable[tuple[int, tuple]]) -> Iterator[tuple[int, tuple]]:
        """For a slice: the sums of the level's nodes, and the best split that each has among the slice's features."""
        parts, before, loss, mine = None, None, {m: np.zeros(2) for m in self.losses}, None
        for s, (kind, total, cells, other) in items:
            mine = s
            if kind == "made":
                before = total, cells
                continue
            parts = (total, cells) if parts is None else (parts[0] + total, parts[1] + cells)
            for m, own in (other or {}).items():
                loss[m] = loss[m] + own
        if parts is None:
            return
        if self.pairs:
            every, mother = [], [p.parent for p in self.pairs]
            # the smaller children are in the order of models, pairs in that of the level before: the same
            for small, old in zip(parts, before, strict=True):
                rest = old[mother] - small
                left = np.array([p.small == 0 for p in self.pairs]).reshape(-1, *[1] * (small.ndim - 1))
                both = np.stack([np.where(left, small, rest), np.where(left, rest, small)], axis=1)
                every.append(both.reshape(-1, *small.shape[1:]))
            parts = tuple(every)
        yield mine, ("made", *parts, (self._splits(self.bins.value, mine, *parts), None if mine else loss))

    def _splits(self, bins: Bins, own: int, total: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, ...]:
        """By node: feature (-1: none), bin, gain, and the sums of the left child; a few nodes at a time."""
        nodes, k = self.nodes, NODES_AT_ONCE
        found = [self._split(bins, own, nodes[i : i + k], total[i : i + k], some[i : i + k]) for i in range(0, len(nodes), k)]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _split(self, bins: Bins, own: int, nodes: list[tuple[int, int]], total: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, ...]:
        low, high = self.slices[own : own + 2]
        starts, sizes, zero = bins.starts[low:high] - bins.starts[low], bins.sizes[low:high], bins.zero[low:high]
        place = bins.place[(bins.owner >= low) & (bins.owner < high)] - bins.starts[low]
        cells = np.zeros((len(total), 3, sizes.sum()))
        cells[:, :, place] = some
        cells[:, :, starts + zero] = total[:, :, None] - np.add.reduceat(cells, starts, axis=2)
        # what a difference leaves of no rows would choose between equal splits
        cells *= (cells[:, 0] + cells[:, 1] > 0.5)[:, None]
        # by feature: running sums start at zero
        below = np.cumsum(cells, axis=2)
        below -= np.repeat((below - cells)[:, :, starts], sizes, axis=2)
        above = total[:, :, None] - below
        weights = np.array([self.models[m].weights for m, _ in nodes])

        def weight(x: np.ndarray) -> np.ndarray:
            return x[:, 0] * weights[:, :1].reshape(-1, *[1] * (x.ndim - 2)) + x[:, 1] * weights[:, 1:].reshape(-1, *[1] * (x.ndim - 2))

        asked = np.zeros((len(total), len(bins.sizes)), bool)
        for k, (m, node) in enumerate(nodes):
            draw = np.random.default_rng([self.seed, self.models[m].number, self.round, node])
            asked[k, draw.choice(len(bins.sizes), n_asked(self.booster.feature_subset, len(bins.sizes)), replace=False)] = True
        last = np.zeros(below.shape[2], bool)
        last[starts + sizes - 1] = True
        least = max(1, self.booster.min_instances_per_node)
        w, w_below, w_above = weight(total)[:, None], weight(below), weight(above)
        valid = np.repeat(asked[:, low:high], sizes, axis=1) & ~last & (w_below > 0) & (w_above > 0)
        valid &= (below[:, 0] + below[:, 1] > least - 0.5) & (above[:, 0] + above[:, 1] > least - 0.5)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = (below[:, 2] ** 2 / w_below + above[:, 2] ** 2 / w_above - total[:, 2:] ** 2 / w) / w
        gain = np.where(valid, gain, -np.inf)
        most = gain.max(axis=1)
        at = np.argmax(gain >= (most - EQUAL * np.abs(np.where(valid.any(axis=1), most, 0)))[:, None], axis=1)
        each = np.arange(len(at))
        feature = np.searchsorted(starts, at, "right") - 1
        bin = at - starts[feature]
        found = gain[each, at] > 1e-12
        return np.where(found, feature + low, -1), bin, gain[each, at], below[each, :, at]

    def advance(self, blocks: Iterable[Block], step: float) -> Iterator[Block]:
        """The rows, with the trees that grew in their margins."""
        bins = self.bins.value
        for block in blocks:
            seen, column = block.seen(bins, self.growing.values())
            margins, every = block.margins.copy(), np.arange(len(block.y))
            for m, tree in self.growing.items():
                margins[:, m] += step * tree.values()[tree.leaves(seen, column, every)]
            yield replace(block, margins=margins)


# ---------------------------------------------------------------------------
# Training
# ---------------------------------------------------------------------------
def _slice(k: int) -> int:
    return k


def _weights(counts: list[Row], own: str, number: int) -> tuple[float, float]:
    """Class weights of the rows of all other groups: rows / (2 x rows of the class)."""
    n = [sum(r["count"] for r in counts if r[own] != number and (r.y > 0) == bool(label)) for label in (0, 1)]
    return tuple(sum(n) / (2 * k) if k else 0.0 for k in n)


def _vectors(df: DataFrame, label: str, groups: Sequence[str], key: str) -> DataFrame:
    parts = F.unwrap_udt("features")
    indices = F.when(parts["type"] == 0, parts["indices"]).otherwise(F.sequence(F.lit(0), F.size(parts["values"]) - 1))
    return df.select(
        F.xxhash64(F.col(key)).alias("key"), F.array(*[F.col(g).cast("int") for g in groups]).alias("own"),
        F.when(F.col(label) > 0, 1.0).otherwise(-1.0).alias("y"), indices.alias("indices"), parts["values"].alias("values"))


def fit_together(df: DataFrame, label: str, group: str, n_models: int, booster: BoosterConfig, seed: int,
                 patient_round: Callable, rounds: int | None = None, key: str = "ticket_id",
                 after: tuple[str, int, Callable[[list[int]], int]] | None = None) -> list[tuple[GBTClassificationModel, int]]:
    """For each of ``n_models`` groups, a model of the rows of all others, and how many trees it has.

    A model stops once ``patient_round`` says that the loss on its own group, which it is not trained on, has
    waited long enough, and keeps its best trees; with ``rounds`` each has so many. ``after`` names a second grouping,
    its number of groups, and a rising function that makes their models' rounds of the others'; those models come last.
    Their first trees don't depend on how many follow, so they grow along. Rows with equal keys are
    drawn into a round together. ``df`` is read a few times, and stored as codes.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    groups = [(group, n_models), *([after[:2]] if after else [])]
    rows = _vectors(df, label, [g for g, _ in groups], key)
    size = df.select(F.coalesce(F.unwrap_udt("features")["size"], F.size(F.unwrap_udt("features")["values"]))).first()[0]
    fitted = Bins.fit(rows, size)
    tasks = max(1, min(math.ceil(df.count() / ROWS_A_TASK), context.defaultParallelism))
    table = fitted.coded(rows.coalesce(tasks))
    kind = np.uint16 if len(fitted.place) < 1 << 16 else np.int32
    counts = rows.groupBy(*[F.col("own")[i].alias(f"own{i}") for i in range(len(groups))], "y").count().collect()  # two rows a pair of groups
    models = [Model(i, k, _weights(counts, f"own{i}", k)) for i, (_, n) in enumerate(groups) for k in range(n)]
    if not all(any(m.weights) for m in models):
        raise ValueError("A model has no training rows: all are of its own group.")
    bins = context.broadcast(fitted)
    # slices of about as many codes each; a feature is in one
    slices = np.unique(np.concatenate([[0, size], np.append(fitted.owner, size)[
        np.linspace(0, len(fitted.owner), context.defaultParallelism + 1).astype(int)[1:-1]]])).astype(int)
    first, others = range(n_models), range(n_models, len(models))
    trees: list[list[tuple[float, Tree]]] = [[] for _ in models]
    losses: dict[int, list[float]] = {m: [] for m in first}
    kept: dict[int, int] = {}
    last = rounds or booster.max_iter
    held: list[RDD] = []
    older: list[RDD] = []

    def read(stored: DataFrame) -> RDD:
        return stored.rdd.map(lambda row, n=len(models): Block.of(row, kind, n))

    def hold(made: RDD) -> RDD:
        held.append(made.persist(StorageLevel.MEMORY_AND_DISK))
        return made

    def free(*made: RDD) -> None:
        for one in [x for x in held if any(x is y for y in made)]:
            one.unpersist()
            held.remove(one)

    def grow(level: Level, state: RDD, before: RDD | None) -> tuple[RDD, list[tuple], dict[int, np.ndarray]]:
        """A level's stored sums, each node's best split, and the losses."""
        n = len(slices) - 1
        parts = state.mapPartitions(level.add_up).partitionBy(n, _slice)
        if before is not None:
            parts = parts.union(before).partitionBy(n, _slice)
        # serialised like what is shuffled, or Spark would copy both through Python before their union
        made = hold(parts.mapPartitions(level.grow, preservesPartitioning=True)._reserialize(parts._jrdd_deserializer))
        # of every slice a row a node
        found = sorted(made.map(lambda item: (item[0], item[1][1] if not item[0] else None, item[1][3])).collect(), key=lambda x: x[0])
        splits = []
        for k, (m, _) in enumerate(level.nodes):
            total, (w0, w1) = found[0][1][k], models[m].weights
            each = [(own[0][k], own[1][k], own[2][k], own[3][k]) for _, _, (own, _) in found if own[0][k] >= 0]
            most = max((x[2] for x in each), default=0.0)
            feature, bin, gain, left = next((x for x in each if x[2] >= most * (1 - EQUAL)), (-1, 0, 0.0, total))
            splits.append((int(feature), int(bin), float(gain), *[
                [float(x[0] * w0 + x[1] * w1), float(x[2]), float(x[0] + x[1])] for x in (total, left)]))
        return made, splits, found[0][2][1]

    def enough(done: int) -> bool:
        """Whether models of the second grouping have all trees that they can come to need."""
        return done >= after[2]([kept.get(m, last) for m in first])

    state, done = read(table), 0
    try:
        while True:
            live = [m for m in first if m not in kept] + [m for m in others if not enough(done)]
            if rounds and done == last:
                kept |= {m: last for m in first}
            if not live or rounds and done == last:
                break
            wanted = [m for m in first if m in live and done and not rounds]
            growing = {m: Tree() for m in live}
            level = Level(bins, booster, seed, done, models, growing, live, [], wanted, slices)
            made, splits, loss = grow(level, state, None)
            free(*older)
            for m in wanted:
                losses[m].append(loss[m][0] / loss[m][1] if loss[m][1] else math.inf)
                best, ended = patient_round(losses[m], booster.patience)
                if ended or done == last:
                    kept[m] = best
            growing = {m: t for m, t in growing.items() if m not in kept and done < last and (m < n_models or not enough(done))}
            if not growing:
                continue
            for depth in range(booster.max_depth):
                pairs = []
                for k, ((m, node), (feature, bin, gain, sums, left)) in enumerate(zip(level.nodes, splits, strict=True)):
                    if m not in growing:
                        continue
                    below = growing[m].split(node, feature, bin, gain, sums, left)
                    rest = sums[2] - left[2]
                    if below and max(left[2], rest) >= 2 * max(1, booster.min_instances_per_node):
                        pairs.append(Pair(m, k, tuple(below), int(left[2] > rest)))
                if not pairs or depth + 1 == booster.max_depth:
                    break
                level = replace(level, growing=growing, roots=[], pairs=pairs, losses=[])
                mothers = made
                made, splits, _ = grow(level, state, mothers)
                free(mothers)
            free(made)
            step = booster.step_size if done else 1.0
            for m, tree in growing.items():
                trees[m].append((step, tree))
            level = replace(level, growing=growing, roots=[], pairs=[], losses=[])
            after_round = state.mapPartitions(lambda b, own=level, by=step: own.advance(b, by))
            done += 1
            if done % STORED_ROUNDS:
                # made in the next round's first job; then the rows before are no longer read
                older, state = [state], hold(after_round)
            else:
                before = table
                table = durable(spark.createDataFrame(after_round.map(lambda b: tuple(map(bytearray, b.stored()))), BLOCKS, verifySchema=False))
                drop(before)
                free(*held)
                older, state = [], read(table)
    finally:
        free(*held)
        drop(table)
        bins.unpersist()
    if after:
        kept |= {m: after[2]([kept[k] for k in first]) for m in others}

    def model(m: int) -> tuple[GBTClassificationModel, int]:
        own = trees[m][: kept[m]]
        return boosted_model([t.spark_tree(spark, fitted, size) for _, t in own], [share for share, _ in own], size), kept[m]

    with ThreadPoolExecutor(len(models)) as pool:  # no jobs: nodes are handed to the JVM one by one
        return list(pool.map(inheritable_thread_target(spark)(model), range(len(models))))
