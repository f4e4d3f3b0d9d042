"""A corpus from raw documents to training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``. The result of a stage is written and read again before the next one. All stages take
null and empty texts, ids and sources, repeated rows, extra columns and empty tables; each says what
becomes of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prioscope.llm import line_dedup, mixing, packing, simhash_dedup, tables, toxicity


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. Null and empty texts have no hits and stay, unless labels say that most rows are toxic."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three sentences that stood elsewhere before go; the rest of the text stays.

    All rows stay. Null and empty texts are kept as they are; rows with one id and one text count as one.
    """
    return line_dedup.without_repeated_lines(docs, sentences=True)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id, then text hash.

    Fingerprints of three-word shingles are linked at two bits or fewer. Texts without words have one
    fingerprint, so one of them stays; a repeated row stays once.
    """
    return simhash_dedup.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of a schedule that gives every source its target share of any stretch.

    A null source is a source; repeated rows stay side by side.
    """
    return mixing.in_order(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, in the order of the mixing schedule, as pieces of training sequences.

    A scan of stored files starts with the longest, so the order they were written in is lost; the
    schedule, which depends on the documents alone, is made again. Workers forget their words at the end of
    a task: they also serve the other stages. Null and empty texts are the end id alone.
    """
    return packing.packed(mixing.in_order(docs), packing.PackingConfig(known_bytes=16 << 20, remember=False))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("simhash_dedup", one_of_each),
    ("mixing", mixed),
    ("packing", packed),
]

#: Learned scores, fingerprints and tokens are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Once a stage's result is stored, its tables and its input are deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        with tables.scratch(keep_last=True):
            kept = tables.durable(stage(spark, docs, sf_dir))
        if k:
            tables.drop(docs)
        docs = kept
    return docs
