"""Repeated passages of lines: overlapping windows of three lines that occur anywhere before go.

Windows are taken over the lines that are not blank, so blank lines neither hide nor make a
repetition. A window's first occurrence is the one with the smallest document, then place; every
later one marks its three lines, and the marked lines of a document are merged and removed.
With ``sentences`` lines are first cut at the ends of sentences, and each piece counts as a line.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from prioscope.llm.tables import durable, fresh

WINDOW = 3
FILLED = "[^ \\t\\r\\f\\x0b]"
#: Ends of sentences, read alike by Java and Python: blanks after a full stop, which a closing mark may follow, or no blanks in scripts without them.
SENTENCE = "(?<=[.!?])[ \\t]+|(?<=[.!?][\"'\u201d\u2019\u00bb)\\]])[ \\t]+|(?<=[\u3002\uff01\uff1f])"


def windows(docs: DataFrame, sentences: bool = False) -> DataFrame:
    """(doc_id, text_hash, at, h1, h2): a row for each window; ``at`` counts non-blank lines from 0.

    The hash has 128 bits: with 64, a corpus of 10^12 windows would hold chance repetitions.
    """
    lines = F.split(F.coalesce("text", F.lit("")), f"\n|{SENTENCE}" if sentences else "\n", -1)
    base = docs.select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.filter(lines, lambda line: line.rlike(FILLED)).alias("own")
    )

    def hashed(i: Column) -> Column:
        three = [F.get(F.col("own"), i + k) for k in range(WINDOW)]
        return F.struct(
            i.alias("at"), F.xxhash64(*three).alias("h1"), F.xxhash64(F.lit(1), *reversed(three)).alias("h2")
        )

    every = F.transform(F.sequence(F.lit(0), F.size("own") - WINDOW), hashed)
    made = base.select("doc_id", "text_hash", F.explode(F.when(F.size("own") >= WINDOW, every)).alias("window"))
    return made.select("doc_id", "text_hash", "window.at", "window.h1", "window.h2")


def repeated_lines(docs: DataFrame, sentences: bool = False) -> DataFrame:
    """(doc_id, text_hash, gone): which non-blank lines of a document stand in a later occurrence.

    Counting shuffles one row a window and task; only windows that repeat are joined back. Their
    counts are stored before: the skew handling then splits a window that a third of all documents
    share, which it does not where a join aggregates one side in its own tasks. Of sentences, which
    are many, the count takes half of the hash alone.
    """
    place = F.struct("doc_id", "text_hash", "at")
    found = windows(docs, sentences)
    if sentences:
        again = durable(found.groupBy("h1").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1"))
        found = durable(found.join(again, "h1"))
    first = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    later = found.join(durable(first), ["h1", "h2"]).filter(~place.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "text_hash").agg(F.collect_set("at").alias("starts")).select(
        "doc_id", "text_hash",
        F.array_distinct(F.flatten(F.transform("starts", lambda i: F.sequence(i, i + (WINDOW - 1))))).alias("gone"),
    )


def without_repeated_lines(docs: DataFrame, removed: str | None = None, sentences: bool = False) -> DataFrame:
    """All rows and columns of ``docs``; ``text`` without the lines of repeated windows.

    ``removed`` names a column to add for the number of lines removed. Documents with fewer than
    three non-blank lines, and null and empty texts, stay as they are. Rows repeated with one id and
    one text count as one document and all keep its result; one id with several texts is several
    documents, in the order of their hashes; a null id comes before all others. Windows of one
    document that repeat and overlap go as well: of a line repeated throughout one line stays. An
    empty table gives no rows. With ``sentences`` all this holds of the sentences of lines, and a line
    goes with its last sentence.
    """
    own_id, own_hash, gone, key = (fresh(docs, c) for c in ("own_id", "own_hash", "gone", "key"))
    marks = repeated_lines(docs, sentences).toDF(own_id, own_hash, gone)
    joined = docs.withColumn(key, F.xxhash64("text")).join(
        marks, F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(key) == F.col(own_hash)), "left"
    )
    touched = F.col(gone).isNotNull()
    less = (_cut_sentences if sentences else _cut)(F.when(touched, F.col("text")), F.col(gone))
    columns = [F.when(touched, less).otherwise(F.col(c)).alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns]
    if removed:
        columns.append(F.when(touched, F.size(gone)).otherwise(0).alias(removed))
    return joined.select(*columns)


@F.pandas_udf(StringType())
def _cut(texts: pd.Series, gone: pd.Series) -> pd.Series:
    """Texts without the non-blank lines whose numbers are in ``gone``."""

    def one(text: str, places: set[int]) -> str:
        out, at = [], -1
        for line in text.split("\n"):
            at += (filled := bool(line.strip(" \t\r\f\x0b")))
            if not (filled and at in places):
                out.append(line)
        return "\n".join(out)

    return pd.Series([None if t is None else one(t, set(g)) for t, g in zip(texts, gone, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def _cut_sentences(texts: pd.Series, gone: pd.Series) -> pd.Series:
    """Texts without the non-blank sentences whose numbers are in ``gone``; a line goes with its last sentence."""
    ends = re.compile(f"({SENTENCE})")

    def one(text: str, places: set[int]) -> str:
        out, at = [], -1
        for line in text.split("\n"):
            parts, kept, cut = ends.split(line), [], False
            for piece, blanks in zip(parts[::2], [*parts[1::2], ""], strict=True):
                at += (filled := bool(piece.strip(" \t\r\f\x0b")))
                if filled and at in places:
                    cut = True
                else:
                    kept.append((piece, blanks))
            less = "".join(p + b for p, b in kept)
            if not cut:
                out.append(line)
            elif less.strip(" \t\r\f\x0b"):
                out.append(less.rstrip(" \t"))
        return "\n".join(out)

    return pd.Series([None if t is None else one(t, set(g)) for t, g in zip(texts, gone, strict=True)], dtype=object)


def line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, text, removed_lines of every row of ``docs`` (doc_id, text)."""
    return without_repeated_lines(docs.select("doc_id", "text"), "removed_lines")
