"""The other severity signals: structure, sentiment, model probabilities."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prioscope.config import LABEL_PROBABILITY_WEIGHTS, AuditConfig
from prioscope.functions import text as T
from prioscope.functions.durable import drop, durable
from prioscope.functions.ordering import exact_quantiles, joinable

# What each structural signal contributes, when it is present.
CSAT_SHARE, RESOLUTION_SHARE, RESPONSE_SHARE = 0.50, 0.35, 0.15


def num(value: float) -> str:
    """A SQL double literal that reads back as exactly this value."""
    return f"CAST('{float(value)!r}' AS DOUBLE)"


def clip01(c: str) -> str:
    return f"least(greatest({c}, 0D), 1D)"


def usable_minutes(c: str) -> str:
    """Durations of minus one minute or less have no logarithm and count as missing."""
    return f"CASE WHEN {c} > -1 THEN {c} END"


@dataclass(frozen=True)
class StructuralStats:
    """Whole-table facts the structural signal needs: a fixed handful of numbers."""

    csat_n: int
    csat_min: float | None
    csat_max: float | None
    csat_median: float | None
    resolution_n: int
    resolution_log_min: float | None
    resolution_log_max: float | None
    response_n: int
    response_log_min: float | None
    response_log_max: float | None

    @staticmethod
    def aggregate(df: DataFrame) -> DataFrame:
        """Counts and ranges in one pass over three narrow columns."""
        parts = [
            "count(csat_numeric) AS csat_n",
            "min(csat_numeric) AS csat_min",
            "max(csat_numeric) AS csat_max",
        ]
        for name, column in (("resolution", "resolution_time_minutes"),
                             ("response", "first_response_minutes")):
            usable = usable_minutes(column)
            parts += [
                f"count({usable}) AS {name}_n",
                f"min(log1p(coalesce({usable}, 0D))) AS {name}_log_min",
                f"max(log1p(coalesce({usable}, 0D))) AS {name}_log_max",
            ]
        return df.selectExpr(*parts)

    @classmethod
    def fit(cls, df: DataFrame) -> StructuralStats:
        # written once: the rows may be joined and parsed anew each time they are read
        narrow = durable(df.select("csat_numeric", "resolution_time_minutes", "first_response_minutes"))
        facts = cls.aggregate(narrow).first().asDict()
        known = {f"{k}_csat_numeric": facts[f"csat_{v}"] for k, v in (("n", "n"), ("lo", "min"), ("hi", "max"))}
        median = exact_quantiles(narrow, {"csat_numeric": [0.5]}, known)["csat_numeric"][0]
        drop(narrow)
        return cls(csat_median=median, **facts)


def structural_score(stats: StructuralStats, min_rows: int = 10) -> str:
    """Low satisfaction, long resolution and slow response, each if common enough."""
    parts: list[str] = []
    total = 0.0
    if stats.csat_n > min_rows:
        total += CSAT_SHARE
        signal = "0.5D"
        if stats.csat_max > stats.csat_min:
            filled = f"coalesce(csat_numeric, {num(stats.csat_median)})"
            signal = (
                f"(1D - ({filled} - {num(stats.csat_min)}) / {num(stats.csat_max - stats.csat_min)})"
            )
        parts.append(f"{num(CSAT_SHARE)} * {signal}")
    for share, column, n, low, high in (
        (RESOLUTION_SHARE, "resolution_time_minutes", stats.resolution_n,
         stats.resolution_log_min, stats.resolution_log_max),
        (RESPONSE_SHARE, "first_response_minutes", stats.response_n,
         stats.response_log_min, stats.response_log_max),
    ):
        if n > min_rows:
            total += share
            logged = f"log1p(coalesce({usable_minutes(column)}, 0D))"
            parts.append(
                f"{num(share)} * (({logged} - {num(low)}) / {num(high - low + 1e-9)})"
            )
    if not parts:
        return "0.5D"
    return clip01(f"({' + '.join(parts)}) / {num(total)}")


def sentiment_compound(text: str, valence: Mapping[str, float]) -> str:
    """Sum of token valences s, normalised to s / sqrt(s*s + 15).

    For a dictionary of a few dozen words: only tokens that are among them are taken out of the text, and
    looked up in a literal. ``with_sentiment_compound`` takes a table of any size.
    """
    known = _token_valences(valence)
    if not known:
        return "0D"
    return _compound_of(_taken_out(text, known), known)


def sentiment_compound_of_words(text: str, words: str, valence: Mapping[str, float]) -> str:
    """The same from the words of the case-folded text, where these are at hand.

    A text with letters that folding changes more than lower-casing does is searched itself.
    """
    known = _token_valences(valence)
    if not known:
        return "0D"
    among = f"filter({words}, w -> w IN ({', '.join(T.sql_string(w) for w in known)}))"
    return _compound_of(f"IF(coalesce({T.has_case_variants(text)}, false), {_taken_out(text, known)}, {among})", known)


def _token_valences(valence: Mapping[str, float]) -> dict[str, float]:
    """Without the words that are no lower-case tokens, and in no text."""
    return {w: v for w, v in valence.items() if re.fullmatch(r"\w{2,}", w) and w == w.lower()}


def _taken_out(text: str, known: Mapping[str, float]) -> str:
    """The known words of a text, in order."""
    return f"regexp_extract_all(lower(coalesce({text}, '')), {T.sql_string(T.any_word(known))}, 0)"


def _compound_of(found: str, known: Mapping[str, float]) -> str:
    total = f"aggregate(w, 0D, (acc, t) -> acc + coalesce({T.sql_case('t', {w: num(v) for w, v in known.items()}, raw=True)}, 0D))"
    return T.let("s", T.let("w", found, total), "s / sqrt(s * s + 15D)")


def joined_tokens(df: DataFrame, valence: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """``df`` stored with a number a row, and (number, valence) of each token that the table has."""
    words = valence.selectExpr("lower(word) AS _word", "CAST(valence AS DOUBLE) AS _valence").filter(
        "_word IS NOT NULL AND _valence IS NOT NULL"
    ).groupBy("_word").agg(F.sum("_valence").alias("_valence"))
    rows = durable(df.withColumn("_row", F.monotonically_increasing_id()))
    tokens = T.derive(rows.select("_row", text), {"_tokens": T.tokens(text)}).select(
        "_row", F.explode("_tokens").alias("_word"))
    return rows, tokens.join(joinable(words), "_word").select("_row", "_valence")


def with_sentiment_compound(df: DataFrame, valence: DataFrame, text: str = "full_text",
                            name: str = "compound") -> DataFrame:
    """The same from a valence table (word, valence) of any size.

    Rows are stored with a number; their tokens meet the table, which is broadcast if it is counted
    small and shuffled beyond that, and a row's valences are added up in the tasks before they are
    sent to its number. A word that repeats in the table has the sum of its valences. A row without
    any of the words, or without a text, has 0.
    """
    rows, found = joined_tokens(df, valence, text)
    sums = found.groupBy("_row").agg(F.sum("_valence").alias("_s"))
    total = "coalesce(_s, 0D)"
    joined = rows.join(joinable(sums), "_row", "left")
    return T.derive(joined, {name: f"{total} / sqrt({total} * {total} + 15D)"}).drop("_row", "_s")


def sentiment_score(compound: str, text: str) -> str:
    """Negative tone is severe; exclamation marks and capitals add to it."""
    return clip01(
        f"(1D - ({compound} + 1D) / 2D) + least({T.count_of(text, '!')}, 5) / 10D "
        f"+ least({T.caps_ratio(text)} * 3, 0.2D)"
    )


def label_probability_blend() -> str:
    """Model signal from the four label probabilities; 0.5 where none are known."""
    terms = [f"{c} * {num(w)}" for c, w in LABEL_PROBABILITY_WEIGHTS.items()]
    return f"coalesce({' + '.join(terms)}, 0.5D)"


def join_label_probabilities(df: DataFrame, probabilities: DataFrame) -> DataFrame:
    """Attach a table of label probabilities by ticket id, one row per id.

    Repeated ids are averaged, so a hot id cannot multiply rows; the averages are stored, so that
    the join can split it.
    """
    unique = probabilities.groupBy("ticket_id").agg(
        *[F.avg(c).alias(c) for c in LABEL_PROBABILITY_WEIGHTS]
    )
    return df.join(joinable(unique), "ticket_id", "left")


def score_label_probabilities(df: DataFrame, make_predict: Callable,
                              config: AuditConfig = AuditConfig(),
                              batch_size: int = 8) -> DataFrame:
    """Run a caller's model over each text, in Arrow batches.

    ``make_predict`` returns a function from an array of strings to an array of
    shape (n, 4): critical, high, medium, low. It is built once per Python worker.
    It gets the whole text, unless ``model_text_chars`` states the model's input limit.
    """
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, DoubleType

    model = predict_batch_udf(
        make_predict, return_type=ArrayType(DoubleType()), batch_size=batch_size
    )
    limit = config.model_text_chars
    text = F.col("full_text") if limit is None else F.substring("full_text", 1, limit)
    scored = df.withColumn("_p", model(text))
    names = list(LABEL_PROBABILITY_WEIGHTS)
    return T.derive(scored, {c: f"_p[{i}]" for i, c in enumerate(names)}).drop("_p")
