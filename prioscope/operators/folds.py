"""Stratified fold assignment and class weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prioscope.functions.durable import durable
from prioscope.functions.ordering import BROADCAST_ROWS, number_by

#: Columns that name a row while folds are dealt: its key, and a hash of the whole row.
ROW_KEYS = ("_k", "_c")


def with_row_keys(df: DataFrame, key: str = "ticket_id") -> DataFrame:
    """Add the columns that ``with_folds`` joins by. Rows with equal ones are equal and interchangeable."""
    comparable = [c for c, kind in df.dtypes if not kind.startswith(("map", "vector"))]
    return df.withColumns({"_k": F.coalesce(F.col(key).cast("string"), F.lit("")), "_c": F.xxhash64(*comparable)})


def _first_places(narrow: DataFrame, label: str, seed: int, name: str, repeated: bool) -> DataFrame:
    """(label, _k, _c, name): the place of each row of ``narrow``, the first of its n, in its class's order by hash."""
    hashed = narrow.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col("_k"))))
    if repeated:
        hashed = hashed.withColumn("_copy", F.explode(F.sequence(F.lit(1), "n")))
    order: list[str | Column] = [label, "_h", "_c"]
    placed = number_by(hashed.select(label, "_h", *ROW_KEYS), order, name)
    first = placed.groupBy(F.col(label).alias("_own")).agg(F.min(name).alias("_first"))  # one row a class
    placed = placed.join(F.broadcast(first), F.col(label).eqNullSafe(F.col("_own"))).select(
        label, *ROW_KEYS, (F.col(name) - F.col("_first")).alias(name)
    )
    return placed.groupBy(label, *ROW_KEYS).agg(F.min(name).alias(name)) if repeated else placed


def fold_table(keyed: DataFrame, label: str, folds: dict[str, tuple[int, int]]) -> DataFrame:
    """(_k, _c, n, places) of each different row of ``keyed``, which has the row keys; stored.

    ``folds`` has (number of folds, seed) by name; a row's place is its rank by hash in its class. Only
    label, key and hashes are sorted, never the rows.
    """
    narrow = durable(keyed.groupBy(label, *ROW_KEYS).agg(F.count(F.lit(1)).alias("n")))
    repeated = bool(narrow.filter("n > 1").take(1))
    out = narrow
    for name, (_, seed) in folds.items():
        out = out.join(_first_places(narrow, label, seed, name, repeated).drop(label), list(ROW_KEYS))
    return durable(out.select(*ROW_KEYS, "n", *folds))


def with_folds(keyed: DataFrame, table: DataFrame, folds: dict[str, tuple[int, int]]) -> DataFrame:
    """Add a column for each of ``folds`` to rows that have the row keys, and drop those.

    The table is broadcast if it is counted small; else both sides are shuffled by the keys. Of a row
    that is there n times each copy gets the next place: only such rows are stored, to number them.
    """
    copies = table.filter("n > 1")
    small = table.count() <= BROADCAST_ROWS
    if copies.take(1):
        again = number_by(keyed.join(copies.select(*ROW_KEYS), list(ROW_KEYS), "left_semi"), list(ROW_KEYS), "_at")
        first = durable(again.groupBy(*ROW_KEYS).agg(F.min("_at").alias("_least")))
        again = again.join(first, list(ROW_KEYS)).withColumn("_copy", F.col("_at") - F.col("_least")).drop("_at", "_least")
        once = keyed.join(copies.select(*ROW_KEYS), list(ROW_KEYS), "left_anti").withColumn("_copy", F.lit(0).cast("long"))
        keyed = once.unionByName(again)
    else:
        keyed = keyed.withColumn("_copy", F.lit(0).cast("long"))
    joined = keyed.join(F.broadcast(table) if small else table, list(ROW_KEYS))
    return joined.withColumns({
        name: ((F.col(name) + F.col("_copy")) % k).cast("int") for name, (k, _) in folds.items()
    }).drop(*ROW_KEYS, "n", "_copy")


def stratified_folds(df: DataFrame, label: str = "is_mismatch", key: str = "ticket_id",
                     folds: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold``: the rank of the row's hash within its class, modulo ``folds``.

    Fold sizes differ by at most one per class. Rows are ordered by class, by the hash of
    their id, and for a repeated id by a hash of the row, in ranges over all tasks; a class
    or an id that a third of the rows share is many ranges. Nothing depends on how rows are
    partitioned, except which of several equal rows gets which fold.
    """
    wanted = {"fold": (folds, seed)}
    keyed = with_row_keys(df, key)
    return with_folds(keyed, fold_table(keyed, label, wanted), wanted).select(*df.columns, "fold")


def class_weights(df: DataFrame, label: str = "is_mismatch") -> DataFrame:
    """Balanced weights: rows / (2 x rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # over one row per class
    return counts.withColumn("weight", total / (2 * F.col("n")))
