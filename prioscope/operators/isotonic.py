"""Isotonic regression of any number of scores.

Adjacent violators are pooled in ranges of scores, each in its own task; then neighbouring ranges are
pooled together, in pairs that shift from pass to pass, until no two ranges disagree. What is left are
the blocks of the whole fit. With n rows of 0/1 labels their rates are different fractions whose
denominators add up to n, so there are at most about 1.5 n^(2/3) of them, however many scores there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prioscope.functions.durable import drop, durable

BLOCK = "lo double, hi double, total double, weight double, part long"
#: Up to so many blocks are pooled in one task, which ends the passes over pairs of ranges.
ONE_TASK = 65_536


def pool(rows: Iterator[tuple]) -> list[list]:
    """Blocks [lo, hi, total, weight, part] out of such rows in ascending order, with rising means."""
    stack: list[list] = []
    for row in rows:
        new = list(row)
        while stack and stack[-1][2] * new[3] >= new[2] * stack[-1][3]:
            lo, _, total, weight, part = stack.pop()
            new = [lo, new[1], total + new[2], weight + new[3], part]
        stack.append(new)
    return stack


def _pooled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of each group of sorted rows; a group's rows come one after the other."""
    rows = (r for b in batches for r in b[["lo", "hi", "total", "weight", "part", "together"]].itertuples(index=False, name=None))
    for _, group in groupby(rows, itemgetter(5)):
        yield pd.DataFrame(pool(r[:5] for r in group), columns=["lo", "hi", "total", "weight", "part"])


def isotonic_blocks(df: DataFrame, score: str, value: str, weight: str | None = None) -> DataFrame:
    """(lo, hi, value, weight): the blocks of the non-decreasing fit of ``value`` on ``score``, stored.

    A block says that scores from lo to hi have one fitted value. Equal scores are one observation. Null
    scores, null values and weights that are not positive take no part; an empty table gives no blocks.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    known = df.select(F.col(score).cast("double").alias("lo"), F.col(value).cast("double").alias("v"), w.alias("w"))
    merged = known.filter("lo is not null and v is not null and w > 0").groupBy("lo").agg(
        F.sum(F.col("v") * F.col("w")).alias("total"), F.sum("w").alias("weight")
    )
    ranged = merged.repartitionByRange("lo").sortWithinPartitions("lo").select(
        "lo", F.col("lo").alias("hi"), "total", "weight", F.spark_partition_id().cast("long").alias("part")
    )
    blocks = durable(ranged.withColumn("together", F.col("part")).mapInPandas(_pooled, BLOCK))
    shift = 0
    while True:
        # a row a range: the means at its ends, and its number among the ranges that have blocks
        mean = F.col("total") / F.col("weight")
        order = Window.orderBy("part")
        ranges = blocks.groupBy("part").agg(
            F.min_by(mean, "lo").alias("first"), F.max_by(mean, "lo").alias("last"), F.count(F.lit(1)).alias("n")
        ).withColumns({"before": F.lag("last").over(order), "number": F.row_number().over(order) - 1})
        ranges = durable(ranges)
        facts = ranges.agg(F.sum("n").alias("n"), F.count_if(F.col("before") >= F.col("first")).alias("apart")).first()
        if not facts.apart:
            drop(ranges)
            return durable(blocks.select("lo", "hi", mean.alias("value"), "weight"))
        pairs = F.lit(0) if facts.n <= ONE_TASK else F.expr(f"(number + {shift}) div 2")
        numbered = blocks.join(F.broadcast(ranges.select("part", "number")), "part")  # a row a range
        after = durable(
            numbered.withColumn("together", pairs).repartition("together").sortWithinPartitions("together", "lo")
            .mapInPandas(_pooled, BLOCK)
        )
        drop(ranges)
        drop(blocks)
        blocks, shift = after, 1 - shift


def fit_isotonic(df: DataFrame, score: str, value: str, weight: str | None = None) -> IsotonicRegressionModel:
    """Spark ML's model of the same fit: it is fitted on the ends of the blocks alone, which it leaves as they are."""
    blocks = isotonic_blocks(df, score, value, weight)
    ends = blocks.select(
        F.explode(F.when(F.col("lo") < F.col("hi"), F.array("lo", "hi")).otherwise(F.array("lo"))).alias(score), "value", "weight"
    )
    return IsotonicRegression(featuresCol=score, labelCol="value", weightCol="weight").fit(ends)
