"""Severity ensemble: blend, label, rank and confidence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prioscope.config import BAND_UPPER, LABEL_PROBABILITY_WEIGHTS, AuditConfig
from prioscope.functions import text as T
from prioscope.operators import signals as S
from prioscope.operators.lexicon import lexicon_score, with_lexicon_hits

SIGNALS = ("urgency_lexicon_score", "nli_severity_score", "structural_score", "sentiment_score")


def severity_score(config: AuditConfig, use_model: bool) -> str:
    lexicon, model = config.weight_lexicon, config.weight_model
    if not use_model:
        lexicon, model = lexicon + model, 0.0
    weights = (lexicon, model, config.weight_structural, config.weight_sentiment)
    return S.clip01(" + ".join(f"{S.num(w)} * {c}" for w, c in zip(weights, SIGNALS)))


def severity_label(score: str) -> str:
    """Half-open bands; anything outside them is critical."""
    whens = " ".join(
        f"WHEN {score} >= 0 AND {score} < {S.num(upper)} THEN '{level}'"
        for level, upper in BAND_UPPER
    )
    return f"CASE {whens} ELSE 'critical' END"


def agreement(signals: Sequence[str]) -> str:
    """One minus twice the population standard deviation of the signals, clipped."""
    n = f"{len(signals)}D"
    squares = " + ".join(f"({c} - m) * ({c} - m)" for c in signals)
    deviation = T.let("m", f"({' + '.join(signals)}) / {n}", f"sqrt(({squares}) / {n})")
    return S.clip01(f"1D - 2D * {deviation}")


def with_signals(df: DataFrame, stats: S.StructuralStats, config: AuditConfig = AuditConfig(),
                 valence: Mapping[str, float] | DataFrame | None = None) -> DataFrame:
    """The four signals. Without probabilities or valences they are a neutral 0.5.

    ``valence`` is a dictionary of a few dozen words, or a table (word, valence) of any size. Texts are
    folded and cut into words once, for phrases and valences.
    """
    use_model = set(LABEL_PROBABILITY_WEIGHTS) <= set(df.columns)
    sentiment = "0.5D"
    if isinstance(valence, DataFrame):
        df = S.with_sentiment_compound(df, valence, name="_compound")
        sentiment = S.sentiment_score("_compound", "full_text")
    elif valence is not None:
        compound = S.sentiment_compound_of_words("full_text", "_words", valence)
        sentiment = T.let("c", compound, S.sentiment_score("c", "full_text"))
    cut = T.derive(T.derive(df, {"_folded": T.fold_case("full_text")}), {"_words": T.words("_folded")})
    return T.derive(with_lexicon_hits(cut, folded="_folded", words="_words"), {
        "urgency_lexicon_score": lexicon_score("lexicon_hits"),
        "nli_severity_score": S.label_probability_blend() if use_model else "0.5D",
        "structural_score": S.structural_score(stats, config.structural_min_rows),
        "sentiment_score": sentiment,
    }).drop("_compound", "_folded", "_words")


def infer_severity(df: DataFrame, stats: S.StructuralStats | None = None,
                   config: AuditConfig = AuditConfig(),
                   valence: Mapping[str, float] | DataFrame | None = None) -> DataFrame:
    """Add signals, ensemble score, label, rank and confidence to cleaned tickets.

    Label probability columns on ``df`` switch the model signal on. ``stats`` are
    fitted on ``df`` itself unless frozen ones are given.
    """
    use_model = set(LABEL_PROBABILITY_WEIGHTS) <= set(df.columns)
    if stats is None:
        stats = S.StructuralStats.fit(df)
    used = [c for c in SIGNALS if use_model or c != "nli_severity_score"]
    scored = T.derive(with_signals(df, stats, config, valence), {
        "inferred_severity_score": severity_score(config, use_model),
        "severity_confidence": agreement(used),
    })
    labelled = T.derive(scored, {"inferred_severity": severity_label("inferred_severity_score")})
    return T.derive(labelled, {"inferred_severity_rank": T.priority_rank("inferred_severity")})


def severity_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("inferred_severity").agg(
        F.count(F.lit(1)).alias("n"), F.avg("severity_confidence").alias("mean_confidence")
    )
