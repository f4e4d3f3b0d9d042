"""Runs of words that repeat with a fixed period, found whole and collapsed to one period.

A word that occurs less than twice in a stretch is in no run of that stretch, so it splits it; both
sides are looked at again with their own counts until every stretch is stable or too short. The
stretches that survive are scanned lag by lag: two words ``lag`` apart are compared at places so close
together that no qualifying run fits between them, and a hit is followed both ways to the run's ends.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prioscope.llm.tables import fresh

SCHEMA = "runs array<struct<start: long, length: long, period: long>>, collapsed string"


@dataclass(frozen=True)
class RunConfig:
    """A run has at least ``least`` words and ``repeats`` periods; ``repeats`` is 2 or more."""

    least: int = 12
    repeats: int = 2

    def words(self, period: int) -> int:
        return max(self.least, self.repeats * period)


def stretches(ids: np.ndarray, config: RunConfig) -> list[tuple[int, int]]:
    """(begin, end) of the stretches in which every word occurs twice at least, none shorter than ``least``.

    All stretches are counted and split at once as long as that drops a tenth of the words; what is left
    then is split one by one, so the time is n log n however the words are arranged.
    """
    places, width = np.arange(len(ids)), int(ids.max(initial=0)) + 1
    while True:
        first = np.flatnonzero(np.diff(places, prepend=-2) != 1)
        lengths = np.diff(first, append=len(places))
        places = places[np.repeat(lengths >= max(config.least, 2), lengths)]
        if not len(places):
            return []
        part = np.cumsum(np.diff(places, prepend=places[0] - 1) != 1)
        _, inverse, counts = np.unique(part * width + ids[places], return_inverse=True, return_counts=True)
        stays = counts[inverse] > 1
        n = len(places)
        places = places[stays]
        if 10 * len(places) > 9 * n:
            break
    first = np.flatnonzero(np.diff(places, prepend=-2) != 1)
    ends = np.append(first[1:], len(places)) - 1
    todo = zip(places[first].tolist(), (places[ends] + 1).tolist(), strict=True)
    if len(places) == n:
        return list(todo)
    words = ids.tolist()
    return [s for a, b in todo for s in _split(words, a, b, config)]


def _split(ids: list[int], begin: int, end: int, config: RunConfig) -> list[tuple[int, int]]:
    """The same for one stretch: a splitting word is looked for from both ends at once, and only the shorter
    side is counted again."""
    out, todo = [], [(begin, end, Counter(ids[begin:end]))]
    while todo:
        a, b, counts = todo.pop()
        if b - a < max(config.least, 2):
            continue
        for d in range((b - a + 1) // 2):
            if counts[ids[a + d]] < 2:
                at = a + d
                break
            if counts[ids[b - 1 - d]] < 2:
                at = b - 1 - d
                break
        else:
            out.append((a, b))
            continue
        sides = sorted([(a, at), (at + 1, b)], key=lambda s: s[1] - s[0])
        small = Counter(ids[sides[0][0] : sides[0][1]])
        counts.subtract(small)
        counts[ids[at]] -= 1
        todo += [(*sides[0], small), (*sides[1], counts)]
    return sorted(out)


def _reach(ids: np.ndarray, i: int, j: int, step: int) -> int:
    """How many words from ``i`` and ``j`` > i on agree, forwards (step 1) or backwards (-1); in growing pieces."""
    room = len(ids) - j if step > 0 else i + 1
    got, piece = 0, 16
    while got < room:
        size = min(piece, room - got)
        if step > 0:
            x, y = ids[i + got : i + got + size], ids[j + got : j + got + size]
        else:
            x, y = ids[i - got - size + 1 : i - got + 1][::-1], ids[j - got - size + 1 : j - got + 1][::-1]
        differ = np.flatnonzero(x != y)
        if len(differ):
            return got + int(differ[0])
        got, piece = got + size, 2 * piece
    return got


def scan(ids: np.ndarray, config: RunConfig) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ``ids``, by ascending lag.

    A run with period q agrees with itself q words on in ``words(q) - q`` places in a row. Hashes of a few
    words in a row only choose the places to follow; words decide. A multiple of a run's period finds that run
    again, so places inside it are passed over, and the same stretch found at a larger lag is left out.
    """
    n = len(ids)
    # the shortest row of places, over all lags
    gram = max(1, min(config.words(q) - q for q in range(1, config.least + 2)))
    if n < max(config.least, 2):
        return []
    codes = np.zeros(n - gram + 1, np.uint64)
    for k in range(gram):
        codes = codes * np.uint64(0x9E3779B97F4A7C15) + ids[k : n - gram + 1 + k].astype(np.uint64) + np.uint64(1)
    codes ^= codes >> np.uint64(29)
    found: dict[tuple[int, int], int] = {}
    long_runs: list[tuple[int, int, int]] = []
    for q in range(1, n // config.repeats + 1):
        row = config.words(q) - q
        stride = row - gram + 1
        here = codes[: max(0, n - gram + 1 - q) : stride]
        hits = np.flatnonzero(here == codes[q::stride][: len(here)])
        if not len(hits):
            continue
        long_runs = [r for r in long_runs if r[1] > q]
        places = hits * stride
        for start, length, period in long_runs:
            if q % period == 0:
                places = places[(places < start) | (places >= start + length - q)]
        done = -1
        for i in places.tolist():
            if i < done:
                continue
            ahead = _reach(ids, i, i + q, 1)
            back = _reach(ids, i - 1, i - 1 + q, -1) if i and ahead else 0
            done = i + ahead
            start, length = i - back, ahead + back + q
            if length >= config.words(q) and (start, length) not in found:
                found[(start, length)] = q
                long_runs.append((start, length, q))
    return [(start, length, q) for (start, length), q in found.items()]


def runs_of(words: list[bytes], config: RunConfig = RunConfig()) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a text's words, by start, then period."""
    numbers = {w: k for k, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    out = []
    for a, b in stretches(ids, config):
        out += [(a + start, length, q) for start, length, q in scan(ids[a:b], config)]
    return sorted(out, key=lambda r: (r[0], r[2], r[1]))


def kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, q in runs:
        keep[start + q : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def periodic_runs(docs: DataFrame, config: RunConfig = RunConfig(), text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``runs``, ``collapsed``: every run of the whole text, and the text without repetitions.

    Words are what stands between blanks (space, tab, line feed, vertical tab, form feed, carriage return). A run
    is a stretch with smallest period q of at least max(12, 2 q) words that no neighbour extends; start and length
    count words from 0. Null and blank texts have no runs and collapse to the empty text. Rows that repeat get a
    row each, whatever their ids; an empty table gives no rows. Columns that already have one of the two names
    keep it, and the new one gets ``_`` appended. Each row is worked on by itself: nothing is shuffled, and a
    lost task is simply repeated.
    """

    @F.pandas_udf(f"struct<{SCHEMA.replace(' array', ': array').replace(' string', ': string')}>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                words = (t or b"").split()
                runs = runs_of(words, config)
                rows.append((runs, kept(words, runs).decode()))
            yield pd.DataFrame(rows, columns=["runs", "collapsed"])

    made, runs = fresh(docs, "made"), fresh(docs, "runs")
    collapsed = fresh(docs, "collapsed")
    own = [F.col(f"`{c}`") for c in docs.columns]
    return docs.withColumn(made, of(F.col(f"`{text}`").cast("binary"))).select(
        *own, F.col(made)["runs"].alias(runs), F.col(made)["collapsed"].alias(collapsed)
    )


def with_planted_repetition(docs: DataFrame) -> DataFrame:
    """doc_id and text; in about a tenth of the documents the words from some place on are a few of them, repeated.

    By h = crc32 of the decimal id, g = h div 10: if h % 10 is 0, each word i >= a becomes word a + (i - a) % p,
    with a = g % n and p = 1 + (n - a) div (3 + g % 8). A null id or a text without words stays as it is.
    """
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text",
        F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")).alias("h"),
    ).withColumn("words", F.when(F.col("h") % 10 == 0, words))
    g, n = F.expr("h div 10"), F.size("words")
    base = base.withColumn("a", F.when(n > 0, F.expr("(h div 10) % size(words)")))
    period = F.lit(1) + F.floor((n - F.col("a")) / (3 + g % 8))
    base = base.withColumn("p", period)
    planted = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")),
    )
    return base.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


def run_digests(docs: DataFrame, config: RunConfig = RunConfig()) -> DataFrame:
    """doc_id, n_runs, the longest run, and SHA-256 of all runs and of the collapsed text, of every row of ``docs``.

    Of runs of the greatest length the one with the smallest start, then period; four nulls without a run.
    """
    made = periodic_runs(docs.select("doc_id", "text"), config)
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    made = made.withColumn("best", best)
    length = -F.col("best.less")
    return made.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        F.expr("(1000 * -best.less) div best.period").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
