"""Urgency phrases: occurrences, negation, score and evidence.

Everything here is an expression on the row's own text, so no shuffle and no join
is needed, and a text with very many hits stays one row. The text must be cleaned
first: tokens are separated by exactly one space.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prioscope.config import LEVELS, LEXICON, NEGATION_WORDS
from prioscope.functions import text as T

# Items per block when an array is collected step by step.
BLOCK = 64
# Matches of a phrase that are cut out of the text one by one.
FEW = 8

Lexicon = Sequence[tuple[str, int, Sequence[str]]]


def _phrase_pattern(phrase: str) -> str:
    """Word-bounded phrase. The literal comes first, so that the search can skip ahead."""
    literal = re.escape(phrase)
    return f"{literal}(?!{T.WORD})(?<!{T.WORD}{literal})"


def _first_word(phrase: str) -> str:
    """The run of word characters a phrase starts with."""
    if not re.fullmatch(r"\w|\w.*\w", phrase):
        raise ValueError(f"A phrase must start and end with a word character: {phrase!r}")
    return re.match(r"\w+", phrase).group()


def _phrase_table(lexicon: Lexicon) -> str:
    """One struct per phrase, in matching order: a constant array in the plan."""
    rows = []
    for level, score, phrases in lexicon:
        for phrase in phrases:
            rows.append(
                f"named_struct('level', {T.sql_string(level)}, 'level_score', {score}, "
                f"'phrase_idx', {len(rows)}, 'phrase', {T.sql_string(phrase)}, "
                f"'first_word', {T.sql_string(_first_word(phrase))}, "
                f"'pattern', {T.sql_string(_phrase_pattern(phrase))}, "
                f"'n_chars', {len(phrase)}, 'n_spaces', {phrase.count(' ')})"
            )
    return f"array({', '.join(rows)})"


def _possible_phrases(folded: str, words: str, lexicon: Lexicon) -> str:
    """The phrases that occur as substrings and whose first word occurs as a word.

    The words of the text are intersected once with all first words; the substring
    test then runs for the few phrases that start with one of them.
    """
    first_words = dict.fromkeys(_first_word(p) for _, _, phrases in lexicon for p in phrases)
    seen = f"array_intersect({words}, {T.sql_strings(first_words)})"
    return T.let("seen", seen, (
        f"filter({_phrase_table(lexicon)}, "
        f"p -> array_contains(seen, p.first_word) AND contains({folded}, p.phrase))"
    ))


def _measure(split: str) -> str:
    """Length, spaces and end of every text piece that precedes a match.

    A match that starts inside a token counts that token's beginning as a word
    before it, hence ``inside``.
    """
    return T.let("pieces", split, (
        "transform(slice(pieces, 1, size(pieces) - 1), piece -> named_struct("
        f"'chars', length(piece), 'spaces', {T.count_of('piece', ' ')}, "
        "'inside', IF(piece = '' OR endswith(piece, ' '), 0, 1)))"
    ))


def _collect(source: str, item_type: str, numbers: str, step: str, item: str) -> str:
    """Run ``step`` over an array and collect an ``item`` per element.

    Appending to an array copies it, so items are collected in blocks; a text with
    very many matches stays linear.
    """
    empty = f"CAST(array() AS ARRAY<{item_type}>)"
    grown = f"array_append(acc.block, {item})"
    full = f"size(acc.block) = {BLOCK - 1}"
    return (
        f"aggregate({source}, named_struct({numbers}, 'block', {empty}, "
        f"'blocks', CAST(array() AS ARRAY<ARRAY<{item_type}>>)), "
        f"(acc, p) -> named_struct({step}, 'block', IF({full}, {empty}, {grown}), "
        f"'blocks', IF({full}, array_append(acc.blocks, {grown}), acc.blocks)), "
        "acc -> concat(flatten(acc.blocks), acc.block))"
    )


def negation_tokens(text: str) -> str:
    """Indexes of the tokens that contain a negation word."""
    words = T.sql_string(T.any_word(NEGATION_WORDS))
    tokens = _collect(
        _measure(f"split(lower({text}), {words}, -1)"), "INT",
        "'n', 0", "'n', acc.n + p.spaces", "acc.n + p.spaces",
    )
    return f"array_distinct({tokens})"


def negation_zone(text: str) -> str:
    """Token positions from one before to three after each negation, sorted."""
    zone = T.let("last", T.count_of(text, " "), (
        f"flatten(transform({negation_tokens(text)}, "
        "i -> sequence(greatest(0, i - 1), least(last, i + 3))))"
    ))
    return f"array_sort(array_distinct({zone}))"


def _zone_flags(text: str) -> str:
    """The zone as one flag per token, up to its last token, for direct lookup."""
    run = "concat(repeat('0', z - IF(k = 0, -1, get(zone, k - 1)) - 1), '1')"
    flags = f"split(array_join(transform(zone, (z, k) -> {run}), ''), '')"
    return T.let("zone", negation_zone(text), flags)


def _near_negation() -> str:
    """Whether hit ``h`` of row ``r`` is in the zone of a negation, from the tokens around it alone.

    Those are the three before its token and the one after. A hit inside a token counts as in the next one;
    behind the last token there is no zone.
    """
    around = (
        "concat(substring_index(before, ' ', h.inside - 4), substring_index(after, ' ', h.inside + 2))"
    )
    near = (
        f"(h.inside = 0 OR contains(after, ' ')) "
        f"AND lower({around}) RLIKE {T.sql_string(T.any_word(NEGATION_WORDS))}"
    )
    return T.let("before", "substring(r.text, 1, h.char_pos)", T.let(
        "after", "substring(r.text, h.char_pos + 1)", near))


def _positions() -> str:
    """Where phrase ``e`` occurs in row ``r``.

    The case-folded text has the same length as the text, so positions carry over.
    """
    return _collect(
        _measure("split(r.folded, e.pattern, -1)"),
        "STRUCT<char_pos: INT, word_pos: INT, inside: INT>",
        "'chars', 0, 'spaces', 0",
        "'chars', acc.chars + p.chars + e.n_chars, 'spaces', acc.spaces + p.spaces + e.n_spaces",
        "named_struct('char_pos', acc.chars + p.chars, "
        "'word_pos', acc.spaces + p.spaces + p.inside, 'inside', p.inside)",
    )


def _described() -> str:
    """The occurrences ``f.hs`` of phrase ``f.e`` in row ``r``, as an array of structs."""
    # cutting one match out of the text costs its distance from the start, a search costs the whole text
    all_matched = (
        f"IF(size(f.hs) > {FEW}, regexp_extract_all(r.text, concat('(?iu)', f.e.pattern), 0), array())"
    )
    matched = (
        "IF(size(ms) = size(f.hs), get(ms, occ), substring(r.text, h.char_pos + 1, f.e.n_chars))"
    )
    negated = f"IF(many, coalesce(get(zone, h.word_pos), '') = '1', {_near_negation()})"
    described = (
        "transform(f.hs, (h, occ) -> named_struct("
        "'level', f.e.level, 'level_score', f.e.level_score, 'phrase_idx', f.e.phrase_idx, "
        "'phrase', f.e.phrase, 'occ', occ, 'char_pos', h.char_pos, "
        f"'matched', {matched}, 'word_pos', h.word_pos, 'weight', IF({negated}, 0.5D, 1D)))"
    )
    return T.let("ms", all_matched, described)


def with_lexicon_hits(df: DataFrame, text: str = "full_text", lexicon: Lexicon = LEXICON,
                      folded: str | None = None, words: str | None = None) -> DataFrame:
    """Add ``lexicon_hits``: every phrase occurrence, in phrase order then position.

    Only phrases that can occur are matched as patterns, on the case-folded text. The whole text is
    searched for negations if it has more than a few hits, else the tokens around each. ``folded`` and
    ``words`` name columns that have the folded text and its words already.
    """
    row = f"named_struct('text', {text}, 'folded', {folded or T.fold_case(text)})"
    possible = _possible_phrases("r.folded", words or T.words("r.folded"), lexicon)
    found = f"transform({possible}, e -> named_struct('e', e, 'hs', {_positions()}))"
    n_hits = f"aggregate(found, 0, (n, f) -> n + size(f.hs)) > {FEW}"
    zone = f"IF(many, {_zone_flags('r.text')}, CAST(array() AS ARRAY<STRING>))"
    hits = f"flatten(transform(found, f -> {_described()}))"
    for name, value in (("zone", zone), ("many", n_hits), ("found", found), ("r", row)):
        hits = T.let(name, value, hits)
    return T.derive(df, {"lexicon_hits": hits})


def lexicon_score(hits: str) -> str:
    """Weighted mean level of the hits over the highest level; 0 without hits."""
    return (
        f"aggregate({hits}, named_struct('score', 0D, 'weight', 0D), "
        "(acc, h) -> named_struct('score', acc.score + h.level_score * h.weight, "
        "'weight', acc.weight + h.weight), "
        "acc -> least(greatest(acc.score / (3D * (acc.weight + 1e-9D)), 0D), 1D))"
    )


def lexicon_evidence(hits: str) -> str:
    """Map from level to the matched strings, verbatim."""
    order = tuple(reversed(LEVELS))
    lists = ", ".join(
        f"transform(filter({hits}, h -> h.level = '{level}'), h -> h.matched)" for level in order
    )
    return f"map_from_arrays({T.sql_strings(order)}, array({lists}))"


def lexicon_hit_rows(df: DataFrame, keep: Sequence[str] = ("ticket_id",)) -> DataFrame:
    """The hits as a table, one row per occurrence.

    A plain explode makes the optimizer test the array for emptiness first, and
    compute it again for that.
    """
    rows = df.select(*keep, F.explode_outer("lexicon_hits").alias("h"))
    return rows.filter("h IS NOT NULL").select(*keep, "h.*")
