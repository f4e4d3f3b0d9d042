"""Near-duplicate vectors by lattice hashing: E8 cells of random projections, then exact cosines.

Equal vectors form a class and are handled once. Each table projects unit vectors to eight
dimensions; a class stands in the E8 cell its projection decodes to and in the nearest cells around.
Classes that share a cell are compared in two steps: by the Hamming distance of 128 sign bits, which
throws out chance neighbours cheaply, and those with a partner left by the cosine in double
precision. Cells are worked through in blocks of bounded size; a larger cell is cut into pieces and
every pair of pieces is compared, so no pair is lost. What comes out is one row for each class
and block: a sum of links and an edge of a spanning forest, never the pairs of a group.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prioscope.llm.simhash_dedup import lowest_labels
from prioscope.llm.tables import components, drop, durable


@dataclass(frozen=True)
class LatticeConfig:
    """``scale`` is the size of unit vectors in lattice units; recall at cosine 0.95 is about 0.96."""

    cosine: float = 0.95
    tables: int = 6
    neighbours: int = 3
    scale: float = 1.2
    sign_bits: int = 128
    differing_bits: int = 28
    piece: int = 1024
    seed: int = 5


def _minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or eight of +-1/2 with an even number of minuses."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


MINIMAL = _minimal_vectors()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum."""
    near = np.rint(x)
    rest = x - near
    odd = np.flatnonzero(near.sum(1) % 2)
    worst = np.abs(rest[odd]).argmax(1)
    near[odd, worst] += np.where(rest[odd, worst] >= 0, 1.0, -1.0)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8, the even integer points and their copy shifted by one half."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


class Lattice:
    """Cells and sign bits of unit vectors of one width; the same everywhere for one seed."""

    def __init__(self, width: int, config: LatticeConfig):
        rng = np.random.default_rng([config.seed, width])
        self.config = config
        self.projections = rng.normal(0, config.scale, (config.tables, width, 8))
        self.signs = rng.normal(0, 1, (width, config.sign_bits))
        self.mixers = rng.integers(1, 1 << 62, (config.tables, 8), dtype=np.int64) | 1
        self.width = width

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """A row of cell numbers for each vector: every table's own cell and its nearest neighbours."""
        out = []
        for t in range(self.config.tables):
            y = unit @ self.projections[t]
            own = nearest_e8(y)
            closest = np.argpartition(-((y - own) @ MINIMAL.T), self.config.neighbours, axis=1)[:, : self.config.neighbours]
            for points in [own, *(own + MINIMAL[closest[:, p]] for p in range(self.config.neighbours))]:
                with np.errstate(over="ignore"):
                    mixed = ((2 * points).astype(np.int64) * self.mixers[t]).sum(1)
                    mixed = (mixed ^ (mixed >> 29)) * np.int64(0x1B873593CC9E2D51) + np.int64(self.width * 64 + t)
                out.append(mixed)
        return np.stack(out, 1)

    def bits(self, unit: np.ndarray) -> np.ndarray:
        return np.packbits(unit @ self.signs > 0, axis=1)


def units(vectors: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) for each width among ``vectors``."""
    widths = np.array([len(v) for v in vectors])
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        x = np.array([vectors[r] for r in rows], float)
        x = x / np.abs(x).max(1, keepdims=True)  # squares stay finite
        yield rows, x / np.sqrt((x * x).sum(1, keepdims=True))


def _pieces(rows: DataFrame, piece: int) -> DataFrame:
    """Add (i, j): each pair of pieces of a cell, i <= j; a cell of up to ``piece`` rows is one piece.

    Cells of one row go. Counting the cells shuffles one row a cell and task; the counts are stored, so that
    the join can split a hot cell.
    """
    sizes = durable(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    parts = F.expr(f"int((n + {piece - 1}) div {piece})")
    own = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    sized = rows.join(sizes, "cell").withColumn("parts", parts).withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    return (
        sized.withColumn("other", other)
        .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
        .drop("n", "parts", "other")
    )


def _groups(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of sorted rows, many small ones to a frame; a group never spans two frames."""
    rest: pd.DataFrame | None = None
    for batch in batches:
        if rest is not None and len(rest):
            batch = pd.concat([rest, batch], ignore_index=True)
        if not len(batch):
            continue
        last = np.ones(len(batch), bool)
        for c in by:
            last &= (batch[c] == batch[c].iloc[-1]).to_numpy()
        first_of_last = int(np.argmax(last))
        if first_of_last:
            yield batch.iloc[:first_of_last]
        rest = batch.iloc[first_of_last:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest


def _bounds(frame: pd.DataFrame, by: list[str]) -> np.ndarray:
    change = np.zeros(len(frame) - 1, bool)
    for c in by:
        v = frame[c].to_numpy()
        change |= v[1:] != v[:-1]
    return np.concatenate([[0], np.flatnonzero(change) + 1, [len(frame)]])


KEYS = ["cell", "i", "j"]


def _by_signs(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """Of each piece pair the rows that have a partner whose sign bits differ in ``most`` at most."""
    for frame in _groups(batches, KEYS):
        bits = np.stack([np.frombuffer(b, np.uint8) for b in frame["bits"]])
        bits = bits.view(np.uint64)
        bounds = _bounds(frame, KEYS)
        group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        active = np.zeros(len(frame), bool)
        sizes = np.diff(bounds)
        for shift in range(1, min(int(sizes.max()), 33)):  # groups of up to 32 rows, all at once
            a = np.flatnonzero((group[:-shift] == group[shift:]) & (sizes[group[:-shift]] <= 32))
            near = np.bitwise_count(bits[a] ^ bits[a + shift]).sum(1) <= most
            active[a[near]] = True
            active[a[near] + shift] = True
        for g in np.flatnonzero(sizes > 32):
            own = bits[bounds[g] : bounds[g + 1]]
            for k in range(0, len(own), 256):
                apart = sum(np.bitwise_count(own[k : k + 256, None, w] ^ own[None, :, w]).astype(np.int16) for w in range(own.shape[1]))
                near = apart <= most
                near[np.arange(len(near)), np.arange(k, k + len(near))] = False
                active[bounds[g] + k : bounds[g] + k + len(near)] |= near.any(1)
        yield frame.loc[active, ["cell", "rep", "own", "i", "j"]]


def _verified(batches: Iterator[pd.DataFrame], config: LatticeConfig) -> Iterator[pd.DataFrame]:
    """(rep, links, root): links to classes seen here first, and one forest edge, of each row that has any."""
    lattices: dict[int, Lattice] = {}
    for frame in _groups(batches, KEYS):
        bounds = _bounds(frame, KEYS)
        out = []
        for start, end in zip(bounds[:-1], bounds[1:], strict=True):
            part = frame.iloc[start:end]
            if len(part) < 2:
                continue
            cell, i, j = part["cell"].iloc[0], part["i"].iloc[0], part["j"].iloc[0]
            reps, members, own = part["rep"].to_numpy(), part["members"].to_numpy(), part["own"].to_numpy()
            for rows, unit in units(list(part["vector"])):
                near = unit @ unit.T >= config.cosine
                np.fill_diagonal(near, False)
                if i != j:  # pairs within a piece belong to the pair (i, i)
                    near &= own[rows][:, None] != own[rows][None, :]
                lattice = lattices.setdefault(unit.shape[1], Lattice(unit.shape[1], config))
                hit = near.any(1)
                if hit.any():  # a pair's own signs decide, so it is seen in all cells that it shares, or in none
                    bits = lattice.bits(unit[hit]).view(np.uint64)
                    apart = sum(np.bitwise_count(bits[:, None, w] ^ bits[None, :, w]).astype(np.int16) for w in range(bits.shape[1]))
                    near[np.ix_(hit, hit)] &= apart <= config.differing_bits
                    hit = near.any(1)
                if not hit.any():
                    continue
                rows, unit, near = rows[hit], unit[hit], near[np.ix_(hit, hit)]
                cells = lattice.cells(unit)
                counted = near.copy()  # a pair counts in the smallest cell that it shares
                values, seen = np.unique(cells[cells < cell], return_counts=True)
                for smaller in values[seen > 1]:
                    has = (cells == smaller).any(1)
                    counted[np.ix_(has, has)] = False
                label = lowest_labels(len(rows), *np.nonzero(np.triu(near)))
                out.append(pd.DataFrame({
                    "rep": reps[rows], "links": (counted * members[rows][None, :]).sum(1), "root": reps[rows[label]],
                }))
        if out:
            yield pd.concat(out, ignore_index=True)


FIT = """coalesce(vec_id is not null and embedding is not null and size(embedding) > 0
    and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))
    and exists(embedding, x -> x != 0), false)"""


def _valid(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vector) of the rows that can link: an id, finite components, and not all of them zero."""
    plain = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + 0.0)  # -0.0 becomes 0.0
    return embeddings.filter(FIT).select(F.col("vec_id").cast("long").alias("vec_id"), plain.alias("vector"))


def embedding_links(embeddings: DataFrame, config: LatticeConfig = LatticeConfig()) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``embeddings`` (vec_id, embedding).

    Vectors link from a cosine of ``cosine`` on, whatever their lengths as arrows; vectors of other
    widths never. Null, zero and empty vectors, and those with null or non-finite components, have no
    links and are their own component. A row with a null id has no links, no component and is not
    kept. Rows repeated under one id link to each other like any others, and share a component. An
    empty table gives no rows; other columns are not looked at.
    """
    valid = _valid(embeddings)
    hashes = [F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2")]
    classes = durable(
        valid.groupBy("vector").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("members"))
        .select("vector", "least", "members", *hashes, F.monotonically_increasing_id().alias("rep"))
    )

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattices: dict[int, Lattice] = {}
        for batch in batches:
            reps = batch["rep"].to_numpy()
            for rows, unit in units(list(batch["vector"])):
                lattice = lattices.setdefault(unit.shape[1], Lattice(unit.shape[1], config))
                bits = [b.tobytes() for b in lattice.bits(unit)]
                cells = lattice.cells(unit)
                bits = np.array(bits, object)
                for k in range(cells.shape[1]):
                    new = ~(cells[:, :k] == cells[:, k : k + 1]).any(1)
                    yield pd.DataFrame({"cell": cells[new, k], "rep": reps[rows[new]], "bits": bits[new]})

    most = config.differing_bits
    cells = durable(classes.select("rep", "vector").mapInPandas(hashed, "cell long, rep long, bits binary"))
    near = (
        _pieces(cells, config.piece).repartition(*KEYS).sortWithinPartitions(*KEYS)
        .mapInPandas(lambda b: _by_signs(b, most), "cell long, rep long, own int, i int, j int")
    )
    found = durable(
        near.join(classes.select("rep", "vector", "members"), "rep").repartition(*KEYS).sortWithinPartitions(*KEYS)
        .mapInPandas(lambda b: _verified(b, config), "rep long, links long, root long")
    )
    drop(cells)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    joined = classes.join(links, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left").select(
        "h1", "h2", "least", (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("class_links"),
        F.coalesce("root", "rep").alias("root"),
    )
    # stored, so that the join can split a component of a third of all classes
    smallest = durable(joined.groupBy("root").agg(F.min("least").alias("smallest")))
    named = joined.join(smallest, "root").select("h1", "h2", "class_links", "smallest")
    linked = valid.select("vec_id", *hashes).join(named, ["h1", "h2"]).select("vec_id", "class_links", "smallest")
    others = embeddings.filter(f"not {FIT}").select(F.col("vec_id").cast("long").alias("vec_id"))
    rest = others.select("vec_id", F.lit(0).cast("long").alias("class_links"), F.col("vec_id").alias("smallest"))
    return linked.unionByName(rest).select(
        "vec_id", F.col("class_links").alias("n_links"), F.col("smallest").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.col("smallest"), F.lit(False)).alias("kept"),
    )
