"""Shared tables, global ranks and connected components for the operators of this folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prioscope.functions.durable import drop, durable, scratch, shared_dir

__all__ = ["components", "drop", "durable", "fresh", "ranked", "ranked_within", "scratch", "shared_dir"]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ranked(df: DataFrame, by: list[str | Column], name: str) -> DataFrame:
    """Add ``name``: the row's place (from 0) in the order of all rows by ``by``.

    Rows are dealt out by range, so that a hot value of the first columns is split by the
    later ones; a row's place is its place in its partition plus the sizes of the partitions
    before. Those sizes are one row per partition. The stored table has a fixed order, so a
    repeated task gives the same places.
    """
    at = fresh(df, "at")
    stored = durable(
        df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(at, F.monotonically_increasing_id())
    )
    part = F.shiftright(F.col(at), 33)
    sizes = stored.groupBy(part.alias("range_no")).agg(F.count(F.lit(1)).alias("range_rows"))
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col("range_no"), F.coalesce(F.sum("range_rows").over(before), F.lit(0)).alias("range_start")
    )
    place = F.col("range_start") + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    return (
        stored.join(F.broadcast(starts), part == F.col("range_no"))
        .withColumn(name, place)
        .select(*df.columns, name)
    )


def ranked_within(df: DataFrame, group: str, by: list[str | Column], name: str, size: str) -> DataFrame:
    """Add the row's place (from 0) among the rows of its ``group`` and the group's row count.

    No task sees a whole group: the place is the one among all rows less the group's first. The groups
    are stored, so that the join with them can split a group that has a third of all rows.
    """
    place = fresh(df, "place")
    everywhere = ranked(df, [group, *by], place)
    groups = durable(everywhere.groupBy(F.col(group).alias("own_group")).agg(
        F.min(place).alias("group_start"), F.count(F.lit(1)).alias(size)
    ))
    return (
        everywhere.join(groups, F.col(group).eqNullSafe(F.col("own_group")))
        .withColumn(name, F.col(place) - F.col("group_start"))
        .select(*df.columns, name, size)
    )


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step over edges (a, b) with a > b.

    The least neighbours are stored: the join with them can then split a node that has a third of all edges.
    """
    down = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = down.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))) if large else down
    least = durable(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
    pairs = both.join(least, "u")
    if large:
        out = pairs.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = pairs.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    return out.filter("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b: longs): the smallest node it reaches.

    Alternating star contraction: a number of rounds that grows with the logarithm of the
    longest path. Each round is stored, the one before it deleted; only a count and a
    checksum come to the driver.
    """
    now = durable(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
    )
    mark = None
    while True:
        total = now.agg(
            F.count(F.lit(1)).alias("n"), F.expr("sum(cast(xxhash64(a, b) as decimal(20, 0)))").alias("h")
        ).first()
        if total.n == 0 or (total.n, total.h) == mark:
            break
        mark = (total.n, total.h)
        after = durable(_star(_star(now, large=True), large=False))
        drop(now)
        now = after
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
