"""Decision thresholds: sweep, best F1, labels and confidence levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prioscope.functions import text as T
from prioscope.operators.signals import num

# The grid is 0.20, 0.21, ... 0.80, and the fallback 0.50.
GRID_FIRST, GRID_LAST, GRID_FALLBACK = 20, 80, 50


def _grid_step(probability: str) -> str:
    """The last grid step the probability reaches; one below the grid if none."""
    known = f"nanvl({probability}, CAST(NULL AS DOUBLE))"
    step = (
        "CASE WHEN p >= (k + 1) / 100D THEN k + 1 WHEN p < k / 100D THEN k - 1 ELSE k END"
    )
    reached = T.let("p", known, T.let("k", "CAST(floor(p * 100) AS INT)", step))
    return f"least(greatest(coalesce({reached}, {GRID_FIRST - 1}), {GRID_FIRST - 1}), {GRID_LAST})"


def sweep_arrays(df: DataFrame, label: str, probability: str, by: list[str]) -> DataFrame:
    """Per group: counts of each class, squared error, and the sweep as an array.

    The rows are first reduced to at most 62 steps per group; the sweep over the
    61 thresholds then happens inside one row.
    """
    y = f"CAST({label} AS DOUBLE)"
    steps = T.derive(df, {"_step": _grid_step(probability)}).groupBy(*by, "_step").agg(
        F.expr(f"sum(CAST({label} = 1 AS BIGINT))").alias("pos"),
        F.expr(f"sum(CAST({label} = 0 AS BIGINT))").alias("neg"),
        F.expr(f"sum(pow({probability} - {y}, 2))").alias("se"),
    )
    groups = steps.groupBy(*by).agg(
        F.collect_list(F.struct("_step", "pos", "neg")).alias("_steps"),
        F.sum("pos").alias("n_positive"),
        F.sum("neg").alias("n_negative"),
        F.sum("se").alias("squared_error"),
    )

    def above(what: str) -> str:
        return f"aggregate(_steps, 0L, (acc, s) -> acc + IF(s._step >= t, s.{what}, 0L))"

    scores = (
        "named_struct('step', t, 'threshold', t / 100D, 'tp', tp, 'fp', fp, "
        "'fn', n_positive - tp, "
        "'f1', IF(tp = 0, 0D, 2D * tp / (tp + fp + n_positive)), "
        "'precision', IF(tp = 0, 0D, tp / CAST(tp + fp AS DOUBLE)), "
        "'recall', IF(tp = 0, 0D, tp / CAST(n_positive AS DOUBLE)))"
    )
    one = T.let("tp", above("pos"), T.let("fp", above("neg"), scores))
    return T.derive(
        groups, {"sweep": f"transform(sequence({GRID_FIRST}, {GRID_LAST}), t -> {one})"}
    ).drop("_steps")


def threshold_sweep(df: DataFrame, label: str = "is_mismatch",
                    probability: str = "mismatch_probability",
                    by: list[str] | None = None) -> DataFrame:
    keys = by or []
    return sweep_arrays(df, label, probability, keys).select(
        *keys, F.explode("sweep").alias("s")
    ).selectExpr(*keys, "s.threshold", "s.tp", "s.fp", "s.fn", "s.f1")


def best_step() -> str:
    """First threshold of the highest F1, or the fallback if every F1 is zero."""
    best = "array_max(transform(sweep, s -> named_struct('f1', s.f1, 'o', -s.step)))"
    step = T.let("b", best, f"IF(b.f1 > 0, -b.o, {GRID_FALLBACK})")
    return T.let("k", step, f"get(sweep, k - {GRID_FIRST})")


def optimal_threshold(df: DataFrame, label: str = "is_mismatch",
                      probability: str = "mismatch_probability",
                      by: list[str] | None = None) -> DataFrame:
    keys = by or []
    best = T.derive(sweep_arrays(df, label, probability, keys), {"_b": best_step()})
    return best.selectExpr(*keys, "_b.threshold AS threshold", "_b.f1 AS f1")


def predicted(probability: str, threshold: float) -> str:
    known = f"nanvl({probability}, CAST(NULL AS DOUBLE))"
    return f"CAST(coalesce({known} >= {num(threshold)}, false) AS INT)"


def confidence_level(probability: str) -> str:
    """Right-closed bands; 'nan' for a missing or out-of-range probability."""
    return T.let("p", f"nanvl({probability}, CAST(NULL AS DOUBLE))", (
        "CASE WHEN p <= -0.001D THEN 'nan' WHEN p <= 0.35D THEN 'LOW' WHEN p <= 0.55D THEN 'MEDIUM' "
        "WHEN p <= 0.75D THEN 'HIGH' WHEN p <= 1.001D THEN 'VERY_HIGH' ELSE 'nan' END"
    ))


def with_prediction(df: DataFrame, threshold: float,
                    probability: str = "mismatch_probability") -> DataFrame:
    return T.derive(df, {
        "mismatch_predicted": predicted(probability, threshold),
        "confidence_level": confidence_level(probability),
    })
