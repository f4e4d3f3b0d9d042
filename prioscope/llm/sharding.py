"""Shards that all hold the sources in the mixture of the whole: stratified interleaving.

Rows are shuffled by a seeded hash within their source; a row's fractional rank is its place there
over the source's size. In the order of fractional ranks every stretch holds the sources in
proportion, so equal cuts of that order are shards of equal row counts and equal mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prioscope.llm.tables import ranked, ranked_within


def shards(docs: DataFrame, shards: int = 16, seed: int = 17) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, source of every row of ``docs``.

    The law is ``rows``: shard sizes differ by one row at most. A null text counts as no bytes, a
    null source is a source. Rows alike in every column used are interchangeable. With fewer rows
    than shards some shards stay empty; an empty table gives no rows. No other column is looked at.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.col("source").cast("string").alias("source"),
    ).withColumn("shuffled", F.xxhash64(F.lit(seed), "doc_id", "text_crc32"))
    placed = ranked_within(rows, "source", ["shuffled", "doc_id", "text_crc32", "size"], "place", "rows")
    placed = placed.withColumn("fraction", (2 * F.col("place") + 1) / (2 * F.col("rows")))
    order = ["fraction", F.xxhash64(F.lit(seed), "source"), "source", "place"]
    at = ranked(placed.select("doc_id", "size", "text_crc32", "source", "place", "fraction"), order, "at")
    total = docs.count()
    shard = F.expr(f"(at * {shards}) div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return at.withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("at") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "source",
    )
