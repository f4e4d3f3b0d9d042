"""Mixing sources to target weights by proportionate-fair scheduling.

Documents of a source, in seeded order, form blocks. Block i of a source with weight w is released
at slot floor(i / w) and due by slot ceil((i + 1) / w); each slot goes to the released block that
is due first. With weights in whole shares of a frame the schedule repeats frame by frame, so one
frame is scheduled and every block finds its slot by arithmetic. At every slot each source has had
its weight's share of blocks to within less than one block, until it has no blocks left; its slots
then stay empty, and the others keep their proportions.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prioscope.llm.tables import durable, fresh, ranked, ranked_within

#: Target weights are the row counts to this power, unless given.
SMOOTHING = 0.7


def smoothed(counts: Mapping[str | None, int], power: float = SMOOTHING) -> dict[str | None, float]:
    """Target weights in proportion to a power of the row counts: small sources get more."""
    return {s: n**power for s, n in counts.items()}


def shares(weights: Mapping[str | None, float], frame: int) -> dict[str | None, int]:
    """Whole slots of a frame for each source, one at least; largest remainders are rounded up."""
    order = sorted(weights, key=lambda s: (s is None, s or ""))
    total = sum(max(w, 0.0) for w in weights.values()) or 1.0
    free = frame - len(order)
    exact = {s: free * max(weights[s], 0.0) / total for s in order}
    out = {s: 1 + int(exact[s]) for s in order}
    left = sorted(order, key=lambda s: (int(exact[s]) - exact[s], order.index(s)))
    for k in range(frame - sum(out.values())):
        out[left[k % len(left)]] += 1
    return out


def schedule(slots: Mapping[str | None, int]) -> list[tuple[str | None, int, int]]:
    """(source, block within the frame, slot) of one frame: earliest deadline first among the released."""
    frame = sum(slots.values())
    sources = list(slots)
    released = sorted(
        (i * frame // n, -(-(i + 1) * frame // n), k, i) for k, (_, n) in enumerate(slots.items()) for i in range(n)
    )
    ready: list[tuple[int, int, int]] = []
    out, at = [], 0
    for slot in range(frame):
        while at < len(released) and released[at][0] <= slot:
            _, due, k, i = released[at]
            heapq.heappush(ready, (due, k, i))
            at += 1
        _, k, i = heapq.heappop(ready)
        out.append((sources[k], i, slot))
    return out


def mixed(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    block_rows: int = 32,
    frame: int = 4096,
    seed: int = 23,
    most_sources: int = 8192,
) -> DataFrame:
    """doc_id, source, weight, block, release, deadline, slot, position, row_hash of every row.

    ``weights`` has one number a source, on the driver; unnamed sources and those without a positive
    one get a single slot a frame. By default they follow ``smoothed``. The ``most_sources`` with most
    weight have slots of their own, and less than one block of deviation; the driver holds no more. All
    others together are one source of the schedule, and among them blocks go by deadline, so none waits
    for a block that is due later. position runs from 0 without
    gaps in the order of slots. A null source is a source; rows alike in id, text and source are
    interchangeable; an empty table gives no rows. No other column is looked at.
    """
    taken = docs.select(
        F.col("doc_id").alias("m_id"), F.col("source").cast("string").alias("m_source"),
        F.xxhash64(F.lit(seed), "doc_id", "text").alias("m_hash"),
    )
    in_source = durable(
        ranked_within(taken, "m_source", ["m_hash", "m_id"], "m_place", "m_rows").withColumn("m_block", F.expr(f"m_place div {block_rows}"))
    )
    session = docs.sparkSession
    counts = in_source.groupBy("m_source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighed = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(SMOOTHING)))
    else:
        named = session.createDataFrame([(s, max(float(w), 0.0)) for s, w in weights.items()], "g_source string, w double")
        weighed = counts.join(F.broadcast(named), F.col("m_source").eqNullSafe(F.col("g_source")), "left").select(
            "m_source", "n", F.coalesce("w", F.lit(0.0)).alias("w")
        )
    sources = durable(weighed)
    own = {r.m_source: r.w for r in sources.orderBy(F.desc("w"), "m_source").limit(most_sources).collect()}
    facts = sources.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("w")).first()
    given, rest = dict(own), None
    if facts.n > len(own):
        rest = "rest"
        while rest in given:
            rest += "_"
        given[rest] = max(facts.w - sum(own.values()), 0.0)
    while frame < 4 * len(given):
        frame *= 2
    slots = shares(given, frame) if given else {}
    plan = F.broadcast(session.createDataFrame(
        [(s, slots[s], i, at) for s, i, at in schedule(slots)] if slots else [],
        "p_source string, p_share long, p_block long, p_slot long",
    ))
    # of sources with slots of their own: at most ``most_sources`` rows
    alone = F.broadcast(session.createDataFrame([(s, slots[s]) for s in own], "s_source string, s_share long"))
    joined = in_source.join(alone, F.col("m_source").eqNullSafe(F.col("s_source")), "left")
    ahead = joined.filter("s_share is not null").select(
        *in_source.columns, F.col("m_source").alias("u_name"), F.col("m_block").alias("u_block"), "s_share",
        (F.col("s_share") / F.lit(frame)).alias("m_weight"),
    )
    if rest is not None:
        ahead = ahead.unionByName(_of_the_rest(joined.filter("s_share is null"), sources, alone, rest, slots[rest], facts.w, block_rows))
    placed = (
        ahead.withColumn("m_in_frame", F.expr("u_block % s_share"))
        .join(plan, F.col("u_name").eqNullSafe(F.col("p_source")) & (F.col("m_in_frame") == F.col("p_block")))
        .withColumn("m_slot", F.expr(f"(u_block div s_share) * {frame} + p_slot"))
    )
    shared = F.col("u_name").eqNullSafe(F.lit(rest)) if rest is not None else F.lit(False)
    release = F.when(shared, F.floor(F.col("m_block") / F.col("m_weight"))).otherwise(F.expr(f"(m_block * {frame}) div s_share"))
    due = F.when(shared, F.ceil((F.col("m_block") + 1) / F.col("m_weight"))).otherwise(F.expr(f"((m_block + 1) * {frame} + s_share - 1) div s_share"))
    out = ranked(
        placed.select(
            "m_id", "m_source", "m_weight", "m_block",
            release.alias("m_release"), due.alias("m_due"), "m_slot", "m_place", "m_hash",
        ),
        ["m_slot", "m_source", "m_place"] if rest is not None else ["m_slot", "m_place"], "m_position",
    )
    return out.select(
        F.col("m_id").alias("doc_id"), F.col("m_source").alias("source"), F.col("m_weight").alias("weight"),
        F.col("m_block").alias("block"), F.col("m_release").alias("release"), F.col("m_due").alias("deadline"),
        F.col("m_slot").alias("slot"), F.col("m_position").alias("position"),
        F.col("m_hash").alias("row_hash"),
    )


def _of_the_rest(
    rows: DataFrame, sources: DataFrame, alone: DataFrame, name: str, share: int, total: float, block_rows: int
) -> DataFrame:
    """Rows of the sources without slots of their own, whose blocks take the rest's slots by deadline.

    Deadlines come by arithmetic from the table of sources; blocks, not rows, are ranked.
    """
    small = sources.join(alone, F.col("m_source").eqNullSafe(F.col("s_source")), "left_anti").select(
        F.col("m_source").alias("r_source"), F.greatest(F.col("w") / F.lit(total or 1.0), F.lit(1e-18)).alias("r_weight"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {block_rows}"))).alias("r_block"),
    )
    due = ((F.col("r_block") + 1) / F.col("r_weight")).alias("r_due")
    ordered = ranked(small.select("r_source", "r_weight", "r_block", due), ["r_due", "r_source", "r_block"], "u_block")
    on = F.col("m_source").eqNullSafe(F.col("r_source")) & (F.col("m_block") == F.col("r_block"))
    return rows.drop("s_source", "s_share").join(ordered, on).select(
        *[c for c in rows.columns if c not in ("s_source", "s_share")], F.lit(name).alias("u_name"), "u_block",
        F.lit(share).cast("long").alias("s_share"), F.col("r_weight").alias("m_weight"),
    )


def in_order(docs: DataFrame, weights: Mapping[str | None, float] | None = None, seed: int = 23, **options) -> DataFrame:
    """The rows of ``docs``, all columns, in the order of the schedule.

    Written out, each file is a stretch of the schedule, but reading the files again does not keep the
    order: call this again on what was read, it gives the same order. Repeated rows stay side by side.
    """
    place, key, own = (fresh(docs, c) for c in ("place", "key", "own"))
    # stored, so that the join can split a row that repeats a million times
    order = durable(
        mixed(docs, weights, seed=seed, **options)
        .groupBy("row_hash").agg(F.min("position").alias(place)).withColumnRenamed("row_hash", own)
    )
    return (
        docs.withColumn(key, F.xxhash64(F.lit(seed), "doc_id", "text"))
        .join(order, F.col(key) == F.col(own)).orderBy(place, key).select(*docs.columns)
    )
