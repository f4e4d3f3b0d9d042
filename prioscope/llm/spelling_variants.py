"""Spelling variants: words of a corpus that one inserted, deleted or replaced letter tells apart.

Each block of the vocabulary is a bit-sliced index: for every place and letter a bitset says which of the
block's words have that letter there. A word is read letter by letter against all words of the block at
once: one set holds the words without an error so far, three more those with one, where an inserted or
missing letter shifts the place that is looked up. Words are numbered by falling frequency, so the lowest
bit of the result is the form.

Blocks hold words that agree outside of one segment of the shorter word: half of it at first. A block of
too many words is dealt again by halves of its segment, down to single letters, where the alphabet bounds
it. A pair belongs to the segment of its first difference, so it is found in one block alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prioscope.functions.ordering import broadcast_if_bounded
from prioscope.llm.tables import drop, durable

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class VariantConfig:
    """Words of at least ``letters`` code points and ``least`` occurrences; a form has ``ratio`` times as many.

    ``block`` bounds the words of one index; a segment of one letter is not dealt again, and leaves at most 90
    words of one length and 90 x 90 of the next. ``slip`` is the modulus of ``slipped``, 0 for words as they stand.
    """

    letters: int = 5
    least: int = 3
    ratio: int = 2
    pattern: str = "[A-Za-z\\u00C0-\\u00FF]+"
    block: int = 4096
    slip: int = 0


def slipped(word: Column, doc: Column, modulus: int) -> Column:
    """The word less one code point where ``modulus`` divides the CRC-32 h of ``<doc>:<word>``: number h % length."""
    h = F.crc32(F.concat(F.coalesce(doc.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = (h % F.length(word)).cast("int")
    less = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))
    return F.when(h % modulus == 0, less).otherwise(word)


def vocabulary(docs: DataFrame, config: VariantConfig = VariantConfig()) -> DataFrame:
    """(word, n) of all words of ``docs`` (doc_id, text); counted in each task before the shuffle."""
    text = F.translate("text", CAPITALS, SMALL)
    words = docs.select("doc_id", F.explode(F.regexp_extract_all(text, F.lit(config.pattern), F.lit(0))).alias("word"))
    if config.slip:
        words = words.select(slipped(F.col("word"), F.col("doc_id"), config.slip).alias("word"))
    return words.filter(F.length("word") >= config.letters).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("n") >= config.least
    )


class PositionIndex:
    """Bitsets of a block's words, in their order, by (place, letter) and by length."""

    def __init__(self, words: list[str]):
        self.slices: list[dict[str, int]] = []
        self.lengths: dict[int, int] = {}
        for k, word in enumerate(words):
            bit = 1 << k
            self.lengths[len(word)] = self.lengths.get(len(word), 0) | bit
            self.slices += [{} for _ in range(len(word) - len(self.slices))]
            for place, letter in enumerate(word):
                at = self.slices[place]
                at[letter] = at.get(letter, 0) | bit
        self.slices.append({})
        self.all = (1 << len(words)) - 1

    def near(self, word: str, begin: int, end: int) -> int:
        """The words with exactly one error whose first difference lies in places ``begin`` to ``end`` - 1.

        ``replaced``, ``longer`` and ``shorter`` are the sets with their one error so far: what has another letter at
        a place, one letter more before it, or lacks it. Places past a word's end have no letter.
        """
        same, replaced, longer, shorter = self.all, 0, 0, 0
        before: dict[str, int] = {}
        slices = self.slices
        most = len(slices) - 1
        for place, letter in enumerate(word):
            here = slices[place].get(letter, 0) if place < most else 0
            after = slices[place + 1].get(letter, 0) if place + 1 < most else 0
            fails = same & ~here if begin <= place < end else 0
            replaced = replaced & here | fails
            longer = (longer | fails) & after
            shorter = shorter & before.get(letter, 0) | fails
            same &= here
            before = slices[place] if place < most else {}
            if not (same or replaced or longer or shorter):
                return 0
        n = len(word)
        if begin <= n < end:
            longer |= same
        lengths = self.lengths
        return replaced & lengths.get(n, 0) | longer & lengths.get(n + 1, 0) | shorter & lengths.get(n - 1, 0)


def _segments(level: int) -> Column:
    """For each word and each length it may be the shorter or longer word of: the segments of that level."""
    short = F.filter(F.array(F.length("word"), F.length("word") - 1), lambda s: s >= F.lit(1))
    parts = F.sequence(F.lit(0), F.lit((1 << level) - 1))
    return F.flatten(F.transform(short, lambda s: F.transform(parts, lambda j: F.struct(s.alias("s"), j.alias("part")))))


def _keyed(words: DataFrame, level: int) -> DataFrame:
    """(word, n, s, part, begin, end, key) of ``words`` that have s and part: what agrees outside of the segment."""
    edge = lambda j: F.shiftright(F.col("s") * j, level).cast("int")
    cut = words.withColumns({"begin": edge(F.col("part")), "end": edge(F.col("part") + 1)})
    head = F.substring("word", F.lit(1), F.col("begin"))
    rest = F.col("s") - F.col("end")
    tail = F.substring("word", F.length("word") - rest + 1, rest)
    return cut.withColumn("key", F.xxhash64("s", "part", head, tail))


def _searched(keyed: DataFrame, level: int) -> DataFrame:
    """(word, n_near, form_n, form) of each block and word that has near words in it."""
    last = 1 << level

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((*k, w, n) for b in batches for *k, w, n in zip(
            b["key"].tolist(), b["s"].tolist(), b["part"].tolist(), b["begin"].tolist(), b["end"].tolist(),
            b["word"].tolist(), b["n"].tolist(), strict=True,
        ))
        out: list[tuple] = []
        for (_, s, part, begin, end), block in groupby(rows, itemgetter(0, 1, 2, 3, 4)):
            words, counts = zip(*(r[5:] for r in block), strict=True)
            if len(words) == 1 or s not in (sizes := {len(w) for w in words}):
                continue
            index = PositionIndex(words)
            stop = s + 1 if part == last - 1 else end  # an insertion at the end belongs to the last segment
            for word in words:
                found = index.near(word, begin, stop)
                if len(word) > s:  # two words of the greater length are a pair of another block
                    found &= index.lengths[s]
                if found:
                    best = (found & -found).bit_length() - 1
                    out.append((word, found.bit_count(), counts[best], words[best]))
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["word", "n_near", "form_n", "form"])
                out = []
        yield pd.DataFrame(out, columns=["word", "n_near", "form_n", "form"])

    ordered = keyed.repartition("key").sortWithinPartitions("key", "s", "part", F.desc("n"), "word")
    return ordered.mapInPandas(search, "word string, n_near long, form_n long, form string")


def near_words(words: DataFrame, config: VariantConfig = VariantConfig()) -> DataFrame:
    """(word, n_near, form_n, form) of each of ``words`` (word, n) that has near words; ``form`` is the most frequent.

    Words are different. Blocks of up to ``block`` words are searched; the words of larger ones are dealt again by
    smaller segments, each level stored, until none is left. Pairs are never listed: a block gives a row a word.
    """
    level, found = 1, []
    todo = words.select("word", "n", F.inline(_segments(level)))
    while True:
        keyed = durable(_keyed(todo, level))
        sizes = keyed.groupBy("key").agg(
            F.count(F.lit(1)).alias("size"), F.max(F.expr("`end` - `begin`")).alias("width")
        )
        # a key of one word has no pairs
        held = durable(sizes.filter("size > 1").withColumn("large", (F.col("size") > config.block) & (F.col("width") > 1)))
        large = held.filter("large").select("key")
        n_large = large.count()
        small = keyed.join(held.filter("not large").select("key"), "key")
        found.append(durable(_searched(small, level)))
        again = durable(
            keyed.join(broadcast_if_bounded(large, n_large), "key", "left_semi").select("word", "n", "s", F.col("part").alias("was"))
        ) if n_large else None
        drop(keyed)
        drop(held)
        if again is None:
            break
        todo = again.select("word", "n", "s", F.explode(F.array(F.col("was") * 2, F.col("was") * 2 + 1)).alias("part"))
        level += 1
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form")))
    return every.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form")
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): the last form that following them reaches. Each round doubles the steps."""
    now = durable(forms.select("word", F.col("form").alias("root")))
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = durable(
            now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        )
        drop(now)
        now = after.select("word", "root")
        now.shared_path = after.shared_path
        if not after.filter("moved").take(1):
            return now


def spelling_variants(docs: DataFrame, config: VariantConfig = VariantConfig()) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs`` (doc_id, text).

    A word is a run of letters of whole texts, A-Z lower-cased. Its form is the near word that occurs most (of
    equals the first in code-point order), if it occurs ``ratio`` times as often as the word itself; else form and
    form_n are null. root follows forms to the last, and is the word itself without a form. Null and empty texts
    have no words; repeated rows count each; a null id counts as an empty one; an empty table gives no rows. Other
    columns are not looked at.
    """
    words = durable(vocabulary(docs, config))
    near = durable(near_words(words, config))
    joined = durable(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        *[F.when(F.col("form_n") >= config.ratio * F.col("n"), F.col(c)).alias(c) for c in ("form", "form_n")],
    ))
    ends = roots(joined.filter("form is not null"))
    return joined.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
