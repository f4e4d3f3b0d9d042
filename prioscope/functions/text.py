"""SQL expressions over ticket text: cleaning, statistics, tokens, durations.

Every function takes and returns a Spark SQL expression as a string, so that an
operator can put a whole derivation into one ``derive`` call.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prioscope.config import LEVEL_RANK, PRIORITY_WORDS

# Unicode white space including the four ASCII separators that Java's class leaves out.
WHITESPACE = r"(?U)[\s\x1c-\x1f]"
NON_WHITESPACE = r"(?U)[^\s\x1c-\x1f]"
# The same characters up to U+00FF but the space, one by one, as a table look-up tests them; and those beyond.
_NARROW_SPACES = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0"
_WIDE_SPACES = r"[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_WIDE_RANGE = r"[\u1680-\u3000]"
# A word character: any letter, any number, underscore. Those of ASCII are named one by one in a class of
# their own, which comes first: a table look-up then spares most characters the look at their category.
_ASCII_WORD = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"
WORD = rf"[[{_ASCII_WORD}]\p{{L}}\p{{N}}]"
NON_WORD = rf"[^[{_ASCII_WORD}]\p{{L}}\p{{N}}]"

# Four non-ASCII letters that equal an ASCII letter when case is ignored.
_CASE_VARIANTS = (("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s"), ("\u212a", "k"))

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
DURATION_PART = r"([0-9]+(?:\.[0-9]+)?)\s*(day|hour|hr|minute|min|second|sec)"


def derive(df: DataFrame, expressions: dict[str, str]) -> DataFrame:
    """Add or replace columns, given as SQL expressions over the columns of ``df``."""
    return df.withColumns({name: F.expr(sql) for name, sql in expressions.items()})


def sql_string(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_strings(values) -> str:
    return f"array({', '.join(sql_string(v) for v in values)})"


def doubles(values) -> str:
    """A constant array, short to parse however long it is."""
    return f"CAST(split('{','.join(repr(float(v)) for v in values)}', ',') AS ARRAY<DOUBLE>)"


def finite(c: str) -> str:
    """Null instead of infinity or NaN."""
    return f"CASE WHEN abs({c}) < CAST('Infinity' AS DOUBLE) THEN {c} END"


def sql_case(value: str, table: dict[str, object], raw: bool = False) -> str:
    """Look a string up in a short fixed table; null if it is not there. ``raw`` values are SQL."""
    whens = " ".join(
        f"WHEN {sql_string(k)} THEN {sql_string(v) if isinstance(v, str) and not raw else v}"
        for k, v in table.items()
    )
    return f"CASE {value} {whens} END"


def let(name: str, value: str, body: str) -> str:
    """Evaluate ``value`` once per row and call it ``name`` inside ``body``.

    A column that a lambda reads only once may be inlined into the lambda by the
    optimizer and then run once per array element; a lambda argument never is.
    """
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def bounded(pattern: str) -> str:
    """Wrap a pattern that starts and ends with word characters in word boundaries."""
    return rf"(?<!{WORD})(?:{pattern})(?!{WORD})"


def any_word(words) -> str:
    """One of some literal words, bounded; grouped by first letters, which come first, so that the search can skip ahead."""
    by_first: dict[str, list[str]] = {}
    for word in words:
        by_first.setdefault(re.escape(word[0]), []).append(re.escape(word[1:]))
    groups = "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in by_first.items())
    return f"(?=[{''.join(by_first)}])" + bounded(groups)


def strip(c: str) -> str:
    ends = sql_string(rf"{WHITESPACE}+$|^{WHITESPACE}+")
    return f"regexp_replace({c}, {ends}, '')"


def has_case_variants(c: str) -> str:
    """Whether ``fold_case`` does more than ``lower``; a text of ASCII is not searched."""
    found = " OR ".join(f"contains({c}, '{variant}')" for variant, _ in _CASE_VARIANTS)
    return f"(octet_length({c}) <> length({c}) AND ({found}))"


def fold_case(c: str) -> str:
    """Lower-case without changing the number of characters of any ASCII-like letter."""
    folded = c
    for variant, letter in _CASE_VARIANTS:
        folded = f"replace({folded}, '{variant}', '{letter}')"
    return f"lower(IF({has_case_variants(c)}, {folded}, {c}))"


def clean_text(c: str) -> str:
    """Null to empty, decode three entities once and in order, collapse white space, strip.

    Every kind of white space becomes a space first, and spaces are collapsed where two meet: the one
    space after most words is left alone.
    """
    decoded = "t"
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        decoded = f"replace({decoded}, '{entity}', '{char}')"
    narrow = (
        f"IF(octet_length(t) <> length(t) AND t RLIKE {sql_string(_WIDE_RANGE)}, "
        f"regexp_replace(t, {sql_string(_WIDE_SPACES)}, ' '), t)"
    )
    spaced = f"regexp_replace(t, {sql_string(f'[{_NARROW_SPACES}]')}, ' ')"
    text = "IF(contains(t, '  '), regexp_replace(t, '  +', ' '), t)"
    for step in (spaced, narrow, f"IF(contains(t, '&'), {decoded}, t)", f"coalesce(CAST({c} AS STRING), '')"):
        text = let("t", step, text)
    return f"trim({text})"


def full_text(subject: str, description: str) -> str:
    return f"trim(concat({subject}, ' [SEP] ', {description}))"


def count_of(c: str, char: str) -> str:
    """Number of occurrences of a one-character string."""
    return f"(length({c}) - length(replace({c}, '{char}', '')))"


def count_matches(c: str, pattern: str) -> str:
    """Number of one-character matches of a pattern."""
    return f"(length({c}) - length(regexp_replace({c}, {sql_string(pattern)}, '')))"


def word_count(c: str) -> str:
    """Tokens of a cleaned text, where one space separates tokens."""
    return f"IF({c} = '', 0, {count_of(c, ' ')} + 1)"


def caps_ratio(c: str) -> str:
    upper = count_matches(c, r"\p{IsUppercase}")
    return f"({upper} / greatest(length({c}), 1))"


def text_stats(c: str) -> dict[str, str]:
    """The seven text statistics, by name."""
    url = sql_string(rf"https?://{NON_WHITESPACE}+|www\.{NON_WHITESPACE}+")
    return {
        "text_length": f"length({c})",
        "word_count": word_count(c),
        "exclamation_count": count_of(c, "!"),
        "question_count": count_of(c, "?"),
        "caps_ratio": caps_ratio(c),
        "digit_count": count_matches(c, r"\p{Nd}"),
        "url_count": f"regexp_count({c}, {url})",
    }


def tokens(c: str) -> str:
    """Lower-case runs of two or more word characters."""
    pattern = sql_string(f"{WORD}{{2,}}")
    return f"regexp_extract_all(lower(coalesce({c}, '')), {pattern}, 0)"


def spaced_words(c: str) -> str:
    """The lower-cased text with a space for whatever is no word character; parts of one character are no tokens."""
    return f"regexp_replace(lower(coalesce({c}, '')), {sql_string(NON_WORD.replace('_', '_ ', 1) + '+')}, ' ')"


def words(c: str) -> str:
    """The runs of word characters, in order; the first and the last may be empty."""
    return f"split(coalesce({c}, ''), {sql_string(NON_WORD + '+')})"


def terms(c: str) -> str:
    """Tokens, followed by the pairs of neighbouring tokens."""
    n = "greatest(size(w) - 1, 0)"
    pairs = f"zip_with(slice(w, 1, {n}), slice(w, 2, {n}), (a, b) -> concat(a, ' ', b))"
    return let("w", tokens(c), f"concat(w, {pairs})")


def normalise_priority(raw: str) -> str:
    """First level whose words occur in the raw value, else null."""
    value = f"lower({strip(f'CAST({raw} AS STRING)')})"
    whens = " ".join(
        f"WHEN {value} RLIKE {sql_string(bounded(words))} THEN '{level}'"
        for level, words in PRIORITY_WORDS.items()
    )
    return f"CASE {whens} END"


def priority_rank(level: str) -> str:
    return sql_case(level, LEVEL_RANK)


def to_number(c: str) -> str:
    """Plain decimal numbers within the range of doubles; everything else is null."""
    value = strip(f"CAST({c} AS STRING)")
    number = f"CASE WHEN v RLIKE {sql_string(NUMBER)} THEN try_cast(v AS DOUBLE) END"
    return let("v", value, let("x", number, finite("x")))


def duration_minutes(c: str, seconds_per_plain_unit: float = 1.0) -> str:
    """Plain numbers are seconds; otherwise the sum of all "<number> <unit>" parts.

    ``seconds_per_plain_unit`` lets a table that stores plain hours say so (3600).
    """
    part = sql_string(DURATION_PART)
    minutes = (
        "CASE WHEN u = 'day' THEN CAST(n AS DOUBLE) * 1440 "
        "WHEN u IN ('hour', 'hr') THEN CAST(n AS DOUBLE) * 60 "
        "WHEN u IN ('minute', 'min') THEN CAST(n AS DOUBLE) "
        "ELSE CAST(n AS DOUBLE) / 60 END"
    )
    parts = (
        f"zip_with(regexp_extract_all(s, {part}, 1), regexp_extract_all(s, {part}, 2), "
        f"(n, u) -> {minutes})"
    )
    total = let("t", f"aggregate({parts}, 0D, (acc, x) -> acc + x)", "CASE WHEN t > 0 THEN t END")
    plain = f"try_cast(s AS DOUBLE) * {float(seconds_per_plain_unit)}D / 60"
    body = f"CASE WHEN s RLIKE {sql_string(NUMBER)} THEN {plain} ELSE {total} END"
    return let("s", f"lower({strip(f'CAST({c} AS STRING)')})", let("x", body, finite("x")))
