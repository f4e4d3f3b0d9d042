"""Pseudo-labels: gap, direction, confidence, quality, and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prioscope.config import BAND_EDGES, AuditConfig
from prioscope.functions import text as T
from prioscope.operators.signals import clip01, num

NEEDED = (
    "priority_rank", "inferred_severity_rank", "inferred_severity_score", "severity_confidence",
)


def mismatch_direction(gap: str) -> str:
    return (
        f"CASE WHEN {gap} < 0 THEN 'OVER-PRIORITISED' WHEN {gap} > 0 THEN 'UNDER-PRIORITISED' "
        "ELSE 'ALIGNED' END"
    )


def label_confidence(gap: str, severity_confidence: str, score: str) -> str:
    """Agreement, plus a boost for a wide gap, minus a penalty close to a band edge."""
    near_edge = " OR ".join(f"abs({score} - {num(e)}) < 0.05D" for e in BAND_EDGES)
    return clip01(
        f"{severity_confidence} + least(abs({gap}) * 0.15D, 0.30D) - IF({near_edge}, 0.10D, 0D)"
    )


def quality_tier(confidence: str) -> str:
    return (
        f"CASE WHEN {confidence} >= 0.75D THEN 'HIGH' WHEN {confidence} >= 0.55D THEN 'MEDIUM' "
        f"WHEN {confidence} >= 0.40D THEN 'LOW' ELSE 'UNCERTAIN' END"
    )


def pseudo_labels(df: DataFrame, config: AuditConfig = AuditConfig()) -> DataFrame:
    missing = [c for c in NEEDED if c not in df.columns]
    if missing:
        raise ValueError(f"Columns missing, run severity inference first: {missing}")
    gaps = T.derive(df, {"priority_gap": "inferred_severity_rank - priority_rank"})
    confident = T.derive(gaps, {
        "is_mismatch": f"CAST(abs(priority_gap) >= {config.gap_threshold} AS INT)",
        "mismatch_direction": mismatch_direction("priority_gap"),
        "pseudo_label_confidence": label_confidence(
            "priority_gap", "severity_confidence", "inferred_severity_score"),
    })
    return T.derive(confident, {
        "pseudo_label_quality": quality_tier("pseudo_label_confidence"),
        "include_in_training": f"pseudo_label_confidence >= {num(config.min_confidence)}",
    })


def training_set(df: DataFrame) -> DataFrame:
    return df.filter("include_in_training")


def pseudo_label_summary(df: DataFrame) -> DataFrame:
    """One row of totals, with the class balance of the training rows."""
    counts = df.selectExpr(
        "count(1) AS n_total",
        "sum(is_mismatch) AS n_mismatch",
        "sum(CAST(include_in_training AS INT)) AS n_train",
        "avg(CASE WHEN include_in_training THEN is_mismatch END) AS train_balance",
    )
    return counts.selectExpr(
        "n_total", "n_mismatch", "n_total - n_mismatch AS n_aligned",
        "n_train", "n_total - n_train AS n_excluded",
        "100 * n_mismatch / n_total AS mismatch_pct",
        "train_balance",
        "coalesce(train_balance > 0.90D OR train_balance < 0.10D, false) AS extreme_imbalance",
    )


def direction_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("mismatch_direction").agg(F.count(F.lit(1)).alias("n"))


def quality_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("pseudo_label_quality").agg(F.count(F.lit(1)).alias("n"))
