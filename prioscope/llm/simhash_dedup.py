"""Near-duplicate texts by SimHash, linked through vantage-point trees under the Hamming distance.

Every text gets a 64-bit fingerprint of its word shingles. A vantage-point tree, grown on a bounded
sample, splits the different fingerprints into shards: at each node those within the median distance
of its vantage point go left, the others right. By the triangle inequality two fingerprints within
the radius can only be parted at a node if one of them lies within the radius of the boundary; so
each fingerprint has one home shard, and visits the others whose boundary it overlaps. Those that ask in
a shard, at home or visiting, are dealt to pieces; each piece has the shard's own fingerprints in a tree
of its own, pruned by the same bounds, and returns a spanning forest of the pairs it finds, never the
pairs of a large group. With n fingerprints the copies sent grow as n^0.5 beyond a million; shards are
large, so that it takes a billion to come to about 25.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prioscope.llm.tables import components, durable, fresh


@dataclass(frozen=True)
class SimHashConfig:
    """``shard`` is the mean number of fingerprints at home in a shard.

    The routing tree is grown on 32 sampled fingerprints a shard, ``sample`` (8 bytes each) at most. The
    askers of a shard are cut into pieces of about ``piece``, or of the ``share`` of all fingerprints if
    that is more: no task has a hundredth of them.
    """

    shingle: int = 3
    radius: int = 2
    seed: int = 42
    sample: int = 1 << 22
    shard: int = 1 << 20
    piece: int = 1 << 16
    share: float = 0.005
    leaf: int = 64


def fingerprint(text: str | None, shingle: int, seed: int) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes; 0 without words."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z alone, and at 0x20 and 0x09-0x0D alone
    if not words:
        return 0
    texts = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, np.int64), 0
    block: list[int] = []
    for t in texts:
        block.append(digest(t, seed))
        if len(block) == 65_536:  # very long texts are counted piece by piece
            counts, n, block = counts + _bits(block), n + len(block), []
    counts, n = counts + _bits(block), n + len(block)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def _bits(hashes: list[int]) -> np.ndarray:
    raw = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    return np.unpackbits(raw, axis=1, bitorder="little").sum(0, dtype=np.int64)


def fingerprints(docs: DataFrame, config: SimHashConfig = SimHashConfig()) -> DataFrame:
    """(doc_id, text_hash, fp) of every row; fp is the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = np.array([fingerprint(t, config.shingle, config.seed) for t in texts], np.uint64)
            yield pd.Series(found.view(np.int64))

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), of(F.col("text")).alias("fp"))


def _distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def grow(sample: np.ndarray, depth: int) -> list | int:
    """A tree of [vantage, median, left, right] down to ``depth``; leaves are shard numbers from 0."""
    count = [0]

    def node(points: np.ndarray, depth: int) -> list | int:
        if depth and len(points) >= 8:
            # distances are few, so of four vantage points and two cuts the most even split is taken
            tried = []
            for vantage in points[:: max(1, len(points) // 4)][:4]:
                d = _distance(points, vantage)
                for cut in (int(np.median(d)), int(np.median(d)) - 1):
                    tried.append((abs(2 * int((d <= cut).sum()) - len(points)), int(vantage), cut))
            uneven, vantage, cut = min(tried)
            if uneven < len(points):
                left = _distance(points, np.uint64(vantage)) <= cut
                return [vantage, cut, node(points[left], depth - 1), node(points[~left], depth - 1)]
        count[0] += 1
        return count[0] - 1

    return node(sample, depth)


def routed(fps: np.ndarray, tree: list | int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, whether at home). A visitor goes only to shards numbered above its home.

    A pair whose homes differ is then seen once, in the shard with the larger number.
    """
    out: list[tuple[np.ndarray, int, np.ndarray]] = []

    def walk(node: list | int, rows: np.ndarray, home: np.ndarray, settled: np.ndarray) -> None:
        if not len(rows):
            return
        if not isinstance(node, list):
            out.append((rows, node, home))
            return
        d = _distance(fps[rows], np.uint64(node[0]))
        left = d <= node[1]
        near_left, near_right = d <= node[1] + radius, d > node[1] - radius
        # leaves are numbered from left to right: a visitor to the left is numbered below its home
        go_left = left | (settled & near_left)
        walk(node[2], rows[go_left], (home & left)[go_left], settled[go_left])
        go_right = ~left | near_right
        came = left & go_right
        walk(node[3], rows[go_right], (home & ~left)[go_right], (settled | came)[go_right])

    start = np.arange(len(fps))
    walk(tree, start, np.ones(len(fps), bool), np.zeros(len(fps), bool))
    if not out:
        return start, start, np.ones(0, bool)
    return (
        np.concatenate([r for r, _, _ in out]),
        np.concatenate([np.full(len(r), s) for r, s, _ in out]),
        np.concatenate([h for _, _, h in out]),
    )


def lowest_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node it reaches over edges a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        while (label != label[label]).any():
            label = label[label]
        if (label == before).all():
            break
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def block_edges(rows: np.ndarray, others: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what ``near`` (rows x others, at most 64 rows) joins, about one for each of others."""
    masks = np.packbits(np.pad(near, ((0, 64 - len(rows)), (0, 0))), axis=0).T.copy().view(np.uint64)[:, 0]
    hit = masks != 0
    first = near.argmax(0)
    a, b = [rows[first[hit]]], [others[hit]]
    _, at = np.unique(masks, return_index=True)
    for k in at[hit[at]]:
        own = rows[near[:, k]]
        a.append(own)
        b.append(np.full(len(own), others[k]))
    return np.concatenate(a), np.concatenate(b)


def shard_edges(fps: np.ndarray, home: np.ndarray, asks: np.ndarray, radius: int, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join all pairs within ``radius`` of one that is at home and one that asks."""
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def search(points: np.ndarray, asking: np.ndarray) -> None:
        """Pairs of the home rows ``points`` with the rows ``asking``."""
        stack = [(points, asking)]
        while stack:
            points, asking = stack.pop()
            if not len(points) or not len(asking):
                continue
            split = None
            if len(points) > leaf:
                for vantage in fps[points[:: max(1, len(points) // 3)][:3]]:
                    d = _distance(fps[points], vantage)
                    median = int(np.median(d))
                    left = d <= median
                    if left.all():
                        median -= 1
                        left = d <= median
                    if 0 < left.sum() < len(points):
                        split = (vantage, median, left)
                        break
            if split is None or len(asking) <= leaf:
                for k in range(0, len(points), 64):
                    rows = points[k : k + 64]
                    near = np.bitwise_count(fps[rows][:, None] ^ fps[asking][None, :]) <= radius
                    near &= rows[:, None] != asking[None, :]
                    if near.any():
                        found.append(block_edges(rows, asking, near))
                continue
            vantage, median, left = split
            d = _distance(fps[asking], vantage)
            stack.append((points[left], asking[d <= median + radius]))
            stack.append((points[~left], asking[d > median - radius]))

    search(np.flatnonzero(home), np.flatnonzero(asks))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def pieces_of(sample: np.ndarray, tree: list | int, n: int, config: SimHashConfig) -> np.ndarray:
    """The number of pieces of each shard, from how many of a sample of the ``n`` fingerprints ask in it."""
    _, shard, _ = routed(sample, tree, config.radius)
    asking = np.bincount(shard, minlength=1) * (n / max(1, len(sample)))
    return np.maximum(1, np.ceil(asking / max(config.piece, config.share * n))).astype(np.int64)


def dealt(fps: np.ndarray, tree: list | int, pieces: np.ndarray, radius: int) -> dict[str, np.ndarray]:
    """(fp, shard, piece, home, asks): a shard's own rows go to all its pieces, and each asks in one of them."""
    rows, shard, home = routed(fps.view(np.uint64), tree, radius)
    shard = shard.astype(np.int64)
    parts = pieces[np.minimum(shard, len(pieces) - 1)]
    with np.errstate(over="ignore"):
        own = ((fps[rows].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts
    copies = np.where(home, parts, 1)
    at = np.repeat(np.arange(len(rows)), copies)
    place = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
    piece = np.where(home[at], place, own[at])
    return {"fp": fps[rows[at]], "shard": shard[at], "piece": piece, "home": home[at], "asks": piece == own[at]}


def links(different: DataFrame, config: SimHashConfig) -> DataFrame:
    """Edges (a, b) between fingerprints of ``different`` (fp, without repeats): a spanning forest a piece."""
    n = different.count()
    depth = max(0, math.ceil(math.log2(max(1, n) / config.shard)))
    most = min(32 << depth, config.sample)
    sample = different.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(most).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    tree = grow(sample, depth)
    pieces = pieces_of(sample, tree, n, config)
    radius, leaf = config.radius, config.leaf

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(dealt(batch["fp"].to_numpy(), tree, pieces, radius))

    def pairs(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("fp")
        fps = group["fp"].to_numpy()
        a, b = shard_edges(fps.view(np.uint64).copy(), group["home"].to_numpy(), group["asks"].to_numpy(), radius, leaf)
        label = lowest_labels(len(fps), a, b)
        own = np.flatnonzero(label != np.arange(len(fps)))
        return pd.DataFrame({"a": fps[own], "b": fps[label[own]]})

    sent = different.select("fp").mapInPandas(route, "fp long, shard long, piece long, home boolean, asks boolean")
    return sent.groupBy("shard", "piece").applyInPandas(pairs, "a long, b long")


def classes(docs: DataFrame, config: SimHashConfig = SimHashConfig()) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) of every row; a component is named by its least fingerprint, root."""
    rows = durable(fingerprints(docs, config))
    different = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(different, config))
    joined = different.join(roots, F.col("fp") == F.col("node"), "left")
    joined = joined.select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # stored, so that the join can split a component of a third of all fingerprints
    smallest = durable(joined.groupBy("root").agg(F.min("least").alias("component_id")))
    named = joined.join(smallest, "root").select(F.col("fp").alias("own_fp"), "root", "component_id")
    return rows.join(named, F.col("fp") == F.col("own_fp")).drop("own_fp")


def simhash_classes(docs: DataFrame, config: SimHashConfig = SimHashConfig()) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of ``docs`` (doc_id, text).

    Null, empty and wordless texts have fingerprint zero and link like any other. Repeated rows get
    a row each. A null id takes no part in the choice of the smallest id: a group of null ids alone
    has a null component. An empty table gives no rows; other columns are not looked at.
    """
    return classes(docs, config).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, config: SimHashConfig = SimHashConfig()) -> DataFrame:
    """The rows of ``docs``, all columns, one for each group: the one with the smallest id, then text hash.

    Documents without an id form groups only with others; where all ids of a group are null, the
    smallest text hash stays.
    """
    return first_of_each(docs, durable(classes(docs, config)))


def first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``found`` (doc_id, text_hash, root) puts first in their group, each once."""
    best = found.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("best")
    )
    own_id, own_hash, key = (fresh(docs, c) for c in ("own_id", "own_hash", "key"))
    best = best.select(F.col("best.doc_id").alias(own_id), F.col("best.text_hash").alias(own_hash))
    kept = docs.withColumn(key, F.xxhash64("text")).join(
        best, F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(key) == F.col(own_hash)), "left_semi"
    )
    repeated = found.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    return (kept.dropDuplicates(["doc_id", key]) if repeated else kept).select(*docs.columns)
