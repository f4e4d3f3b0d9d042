"""Row numbers, running totals and exact quantiles that do not need one big task.

Each helper has one way to work, whatever the number of rows: the rows are split over
ranges of the order key, and only per-range totals, whose number is fixed or that of
the partitions, meet in one place.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prioscope.functions.durable import drop, durable

RANGES = 1024
# Approximate quantiles are exact to one in so many rows; cuts lie at these distances of a target.
QUANTILE_ACCURACY = 4096
QUANTILE_CUTS = tuple(d / 2048 for d in (-3, -1, 0, 1, 3))
# More passes than any input takes; the search stops with an error beyond it.
QUANTILE_PASSES = 6
# A side table is broadcast up to this many rows, and joined by a shuffle beyond.
BROADCAST_ROWS = 200_000


def broadcast_if_bounded(dim: DataFrame, rows: int | None = None) -> DataFrame:
    """Broadcast hint for a side table of a checked size; none above the limit."""
    return F.broadcast(dim) if (dim.count() if rows is None else rows) <= BROADCAST_ROWS else dim


def joinable(aggregate: DataFrame) -> DataFrame:
    """An aggregate as one side of a join with rows: stored, and broadcast if it is counted small.

    A join that aggregates one side in its own tasks cannot be split; stored, the side is shuffled by itself,
    and adaptive execution splits a key that a third of the rows on the other side share.
    """
    return broadcast_if_bounded(durable(aggregate))


def number_rows(df: DataFrame, name: str = "position") -> DataFrame:
    """Consecutive 0-based numbers in the current row order, without a shuffle.

    The rows are made durable first, so that the partition-local numbers used for
    the count and for the result are the same ones.
    """
    local = durable(df.withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright("_mid", 33)
    within = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = local.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    # one row per partition: the number of tasks bounds this table
    return (
        local.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_off") + within)
        .drop("_mid", "_part", "_off")
    )


def number_by(df: DataFrame, order: list, name: str = "position") -> DataFrame:
    """Consecutive 0-based numbers by an order, for any number of rows."""
    return number_rows(df.orderBy(*order), name)


def running_totals(hist: DataFrame, key: str, values: list[str],
                   partition: list[str] | None = None) -> DataFrame:
    """Add ``<value>_before``: the sum over all rows with a smaller ``key``.

    ``hist`` has one row per distinct key (per partition), so a key that many
    source rows share is a single row here.
    """
    by = partition or []
    hist = durable(hist)

    def before(window_by: list[str], order: str) -> Window:
        return (
            Window.partitionBy(*window_by).orderBy(order)
            .rowsBetween(Window.unboundedPreceding, -1)
        )

    probs = [i / RANGES for i in range(1, RANGES)]
    edges = sorted(set(hist.approxQuantile(key, probs, 0.25 / RANGES)))
    ranged = Bucketizer(
        splits=[-math.inf, *edges, math.inf], inputCol=key, outputCol="_range"
    ).transform(hist)
    totals = ranged.groupBy(*by, "_range").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    w_ranges = before(by, "_range")
    offsets = totals.select(
        *by, "_range",
        *[F.coalesce(F.sum(f"_t_{v}").over(w_ranges), F.lit(0)).alias(f"_o_{v}") for v in values],
    )
    w_rows = before([*by, "_range"], key)
    return (
        ranged.join(broadcast_if_bounded(offsets), [*by, "_range"])
        .withColumns({
            f"{v}_before": F.col(f"_o_{v}") + F.coalesce(F.sum(v).over(w_rows), F.lit(0))
            for v in values
        })
        .drop("_range", *[f"_o_{v}" for v in values])
    )


def exact_quantiles(df: DataFrame, wanted: dict[str, list[float]],
                    facts: dict | None = None) -> dict[str, list[float | None]]:
    """Exact linear-interpolated quantiles of several numeric columns; nulls and NaN are left out.

    The wanted order statistics are searched in intervals of values. A pass counts the rows
    between cuts that are approximate quantiles close to the wanted ones, so an interval keeps
    under a hundredth of its rows however the values are spread; infinities are ordinary values
    at the ends. An interval with one value left is the answer.
    ``facts`` may give ``n_<column>``, ``lo_<column>`` and ``hi_<column>`` of known values.
    """
    columns = list(wanted)
    # a few narrow columns, written once: the passes then don't compute them again
    df = durable(df.select(
        *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns],
    ))
    if facts is None:
        facts = df.agg(*[
            f(c).alias(f"{name}_{c}") for c in columns
            for name, f in (("n", F.count), ("lo", F.min), ("hi", F.max))
        ]).first().asDict()

    def ranks(c: str, p: float) -> tuple[int, int]:
        spot = p * (facts[f"n_{c}"] - 1)
        return math.floor(spot), math.ceil(spot)

    # (column, rank) -> (lo, hi, rows below lo, rows inside), all ends closed
    open_ = {
        (c, rank): (facts[f"lo_{c}"], facts[f"hi_{c}"], 0, facts[f"n_{c}"])
        for c, probs in wanted.items() if facts[f"n_{c}"] for p in probs for rank in ranks(c, p)
    }
    found: dict[tuple[str, int], float] = {}
    for _ in range(QUANTILE_PASSES + 1):
        found |= {t: lo for t, (lo, hi, _, _) in open_.items() if lo == hi}
        open_ = {t: b for t, b in open_.items() if t not in found}
        if not open_:
            break
        open_ = _narrowed(df, open_)
    drop(df)
    if open_:
        raise RuntimeError(f"Quantiles not found in {QUANTILE_PASSES} passes: {sorted(open_)}")

    def value(c: str, p: float) -> float | None:
        if not facts[f"n_{c}"]:
            return None
        a, b = (found[(c, rank)] for rank in ranks(c, p))
        share = p * (facts[f"n_{c}"] - 1) - ranks(c, p)[0]
        return a if a == b or share == 0 else a + (b - a) * share

    return {c: [value(c, p) for p in probs] for c, probs in wanted.items()}


def _narrowed(df: DataFrame, open_: dict) -> dict:
    """The same targets with smaller intervals: one job for the cuts, one for the counts."""
    wanted: dict[tuple, set[float]] = {}
    for (c, rank), (lo, hi, below, n) in open_.items():
        spot = (rank - below) / max(1, n - 1)
        wanted.setdefault((c, lo, hi), set()).update(min(max(spot + d, 0.0), 1.0) for d in QUANTILE_CUTS)
    intervals = list(wanted)
    inside = [F.when(F.col(c).between(lo, hi), F.col(c)) for c, lo, hi in intervals]
    cut_rows = df.agg(*[
        F.percentile_approx(v, F.array(*map(F.lit, sorted(wanted[i]))), QUANTILE_ACCURACY).alias(str(k))
        for k, (i, v) in enumerate(zip(intervals, inside))
    ]).first()
    cuts = [sorted({lo, hi, *(cut_rows[str(k)] or [])}) for k, (_, lo, hi) in enumerate(intervals)]

    # a value's bin is 2i if it equals cut i, and 2i + 1 between cuts i and i + 1
    def piece(k: int, v: Column) -> Column:
        points = F.array(*[F.lit(float(x)) for x in cuts[k]])
        at = F.size(F.filter(points, lambda x: x <= v))
        slot = 2 * at - F.when(F.element_at(points, F.greatest(at, F.lit(1))) == v, 2).otherwise(1)
        return F.when(v.isNotNull(), F.struct(F.lit(k).alias("k"), slot.alias("slot"), v.alias("v")))

    pieces = [piece(k, v) for k, v in enumerate(inside)]
    counted = (
        df.select(F.explode(F.array_compact(F.array(*pieces))).alias("e"))
        .groupBy("e.k", "e.slot")
        .agg(F.count(F.lit(1)).alias("n"), F.min("e.v").alias("lo"), F.max("e.v").alias("hi"))
        .collect()  # bounded: some ten rows a target
    )
    slots: dict[int, list] = {}
    for row in sorted(counted, key=lambda r: (r["k"], r["slot"])):
        slots.setdefault(row["k"], []).append(row)
    out = {}
    for (c, rank), (lo, hi, below, _) in open_.items():
        for row in slots[intervals.index((c, lo, hi))]:
            if rank < below + row["n"]:
                out[(c, rank)] = (row["lo"], row["hi"], below, row["n"])
                break
            below += row["n"]
    return out
