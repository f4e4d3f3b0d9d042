"""Evaluation metrics as aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prioscope.config import LEVELS
from prioscope.functions import text as T
from prioscope.functions.ordering import running_totals
from prioscope.operators.signals import num
from prioscope.operators.thresholds import best_step, predicted, sweep_arrays

LABEL, PROBABILITY = "is_mismatch", "mismatch_probability"


def score_histogram(df: DataFrame, label: str = LABEL, probability: str = PROBABILITY,
                    by: list[str] | None = None) -> DataFrame:
    """One row per distinct score: how many rows of each class have it."""
    # known as an aggregate: a filter on the score would be pushed below its computation
    return T.derive(df, {"score": f"nanvl({probability}, CAST(NULL AS DOUBLE))"}).groupBy(
        *(by or []), "score"
    ).agg(
        F.expr(f"sum(CAST({label} = 1 AS BIGINT))").alias("pos"),
        F.expr(f"sum(CAST({label} = 0 AS BIGINT))").alias("neg"),
        F.expr("bool_or(score IS NOT NULL)").alias("known"),
    ).filter("known").drop("known")


def auc(df: DataFrame, label: str = LABEL, probability: str = PROBABILITY,
        by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve, ties counted half; null if a class is absent."""
    hist = score_histogram(df, label, probability, by)
    cumulated = running_totals(hist, "score", ["neg"], by)
    wins = "sum(CAST(pos AS DOUBLE) * (neg_before + neg / 2D))"
    return cumulated.groupBy(*(by or [])).agg(
        F.expr(f"try_divide({wins}, CAST(sum(pos) AS DOUBLE) * sum(neg))").alias("auc")
    )


def roc_curve(df: DataFrame, label: str = LABEL, probability: str = PROBABILITY) -> DataFrame:
    """A point per distinct score, counting rows at or above it, plus the origin."""
    hist = score_histogram(df, label, probability)
    cumulated = running_totals(hist, "score", ["pos", "neg"])
    totals = cumulated.selectExpr("sum(pos) AS p", "sum(neg) AS n").first()
    points = cumulated.selectExpr(
        f"try_divide(CAST({totals.n} - neg_before AS DOUBLE), {totals.n}) AS fpr",
        f"try_divide(CAST({totals.p} - pos_before AS DOUBLE), {totals.p}) AS tpr",
        "score AS threshold",
    )
    origin = df.sparkSession.range(1).selectExpr(
        "0D AS fpr", "0D AS tpr", "CAST(NULL AS DOUBLE) AS threshold"
    )
    return points.unionByName(origin)


def confusion_counts(df: DataFrame, threshold: float, label: str = LABEL,
                     probability: str = PROBABILITY) -> DataFrame:
    """One row: the four cells, and the squared error."""
    flagged = T.derive(df, {"_pred": predicted(probability, threshold)})
    return flagged.selectExpr(
        f"coalesce(sum(CAST({label} = 1 AND _pred = 1 AS BIGINT)), 0L) AS tp",
        f"coalesce(sum(CAST({label} = 0 AND _pred = 1 AS BIGINT)), 0L) AS fp",
        f"coalesce(sum(CAST({label} = 1 AND _pred = 0 AS BIGINT)), 0L) AS fn",
        f"coalesce(sum(CAST({label} = 0 AND _pred = 0 AS BIGINT)), 0L) AS tn",
        f"avg(pow({probability} - {label}, 2)) AS brier_score",
    )


def classification_metrics(df: DataFrame, threshold: float = 0.5, label: str = LABEL,
                           probability: str = PROBABILITY) -> DataFrame:
    """F1, precision, recall, Brier score and class sizes at a threshold."""
    return confusion_counts(df, threshold, label, probability).selectExpr(
        "coalesce(try_divide(2D * tp, 2 * tp + fp + fn), 0D) AS f1",
        "coalesce(try_divide(CAST(tp AS DOUBLE), tp + fp), 0D) AS precision",
        "coalesce(try_divide(CAST(tp AS DOUBLE), tp + fn), 0D) AS recall",
        "brier_score",
        f"{num(threshold)} AS threshold_used",
        "tp + fn AS n_positive",
        "fp + tn AS n_negative",
        "try_divide(CAST(tp + fn AS DOUBLE), tp + fp + fn + tn) AS class_balance",
    )


def confusion_matrix(df: DataFrame, threshold: float = 0.5, label: str = LABEL,
                     probability: str = PROBABILITY) -> DataFrame:
    """Two rows, actual aligned and actual mismatch; empty cells are zero."""
    return confusion_counts(df, threshold, label, probability).selectExpr(
        "inline(array("
        "named_struct('actual', 'Aligned', 'predicted_aligned', tn, 'predicted_mismatch', fp), "
        "named_struct('actual', 'Mismatch', 'predicted_aligned', fn, 'predicted_mismatch', tp)))"
    )


def classification_report(df: DataFrame, threshold: float = 0.5, label: str = LABEL,
                          probability: str = PROBABILITY) -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy and averages."""

    def side(hit: str, wrong: str, missed: str) -> dict[str, str]:
        return {
            "p": f"coalesce(try_divide(CAST({hit} AS DOUBLE), {hit} + {wrong}), 0D)",
            "r": f"coalesce(try_divide(CAST({hit} AS DOUBLE), {hit} + {missed}), 0D)",
            "f": f"coalesce(try_divide(2D * {hit}, 2 * {hit} + {wrong} + {missed}), 0D)",
            "n": f"{hit} + {missed}",
        }

    aligned, mismatch = side("tn", "fn", "fp"), side("tp", "fp", "fn")
    sides = confusion_counts(df, threshold, label, probability).selectExpr(
        *[f"{sql} AS {k}0" for k, sql in aligned.items()],
        *[f"{sql} AS {k}1" for k, sql in mismatch.items()],
        "tp + tn AS hits",
    )

    def line(name: str, p: str, r: str, f: str, n: str) -> str:
        return (
            f"named_struct('class', '{name}', 'precision', {p}, 'recall', {r}, 'f1', {f}, "
            f"'support', {n})"
        )

    total = "(n0 + n1)"
    none = "CAST(NULL AS DOUBLE)"
    mean = {k: f"({k}0 + {k}1) / 2D" for k in "prf"}
    weighted = {k: f"({k}0 * n0 + {k}1 * n1) / {total}" for k in "prf"}
    return sides.selectExpr("inline(array(" + ", ".join([
        line("Aligned", "p0", "r0", "f0", "n0"),
        line("Mismatch", "p1", "r1", "f1", "n1"),
        line("accuracy", none, none, f"CAST(hits AS DOUBLE) / {total}", total),
        line("macro avg", mean["p"], mean["r"], mean["f"], total),
        line("weighted avg", weighted["p"], weighted["r"], weighted["f"], total),
    ]) + "))")


def fold_metrics(df: DataFrame, label: str = LABEL, probability: str = PROBABILITY) -> DataFrame:
    """Per fold: AUC, and the scores at the fold's own best threshold."""
    best = T.derive(sweep_arrays(df, label, probability, ["fold"]), {"_b": best_step()})
    scores = best.selectExpr(
        "fold", "_b.f1 AS f1", "_b.precision AS precision", "_b.recall AS recall",
        "squared_error / (n_positive + n_negative) AS brier", "_b.threshold AS threshold",
    )
    areas = auc(df, label, probability, ["fold"])
    return areas.join(F.broadcast(scores), "fold").select(
        "fold", "auc", "f1", "precision", "recall", "brier", "threshold"
    )  # one row per fold on both sides


def cv_summary(folds: DataFrame) -> DataFrame:
    return folds.selectExpr(
        "avg(auc) AS mean_auc", "stddev_pop(auc) AS std_auc",
        "avg(f1) AS mean_f1", "stddev_pop(f1) AS std_f1",
    )


def fold_threshold_median(folds: DataFrame) -> DataFrame:
    return folds.agg(F.median("threshold").alias("threshold"))


def priority_severity_crosstab(df: DataFrame) -> DataFrame:
    return (
        df.groupBy("priority").pivot("inferred_severity", list(LEVELS))
        .agg(F.count(F.lit(1))).na.fill(0)
    )


def probability_histogram(df: DataFrame, probability: str = PROBABILITY,
                          bins: int = 30) -> DataFrame:
    """Equal bins between the smallest and largest probability; the last is closed."""
    known = df.selectExpr(f"nanvl({probability}, CAST(NULL AS DOUBLE)) AS p").filter("p IS NOT NULL")
    ends = known.agg(F.min("p").alias("lo"), F.max("p").alias("hi")).first()
    lo, hi = (0.0, 1.0) if ends.lo is None else (ends.lo, ends.hi)
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    binned = known.selectExpr(
        f"CAST(least(floor((p - {num(lo)}) / {num(hi - lo)} * {bins}), {bins - 1}) AS INT) AS bin"
    ).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    frame = df.sparkSession.range(bins).selectExpr(
        "CAST(id AS INT) AS bin",
        f"{num(lo)} + id * {num(width)} AS bin_start",
        f"{num(lo)} + (id + 1) * {num(width)} AS bin_end",
    )
    return frame.join(F.broadcast(binned), "bin", "left").na.fill(0, ["n"])


def adversarial_slices(df: DataFrame) -> DataFrame:
    """Mismatch share and mean probability per priority, where both labels occur."""
    return (
        df.groupBy("priority").agg(
            F.count(F.lit(1)).alias("n"),
            F.round(100 * F.avg(LABEL), 2).alias("mismatch_pct"),
            F.round(F.avg(F.nanvl(PROBABILITY, F.lit(None).cast("double"))), 4).alias("mean_prob"),
            (F.min(LABEL) != F.max(LABEL)).alias("_both"),
        )
        .filter("n > 10 AND _both").drop("_both")
    )


def sanity_checks(df: DataFrame) -> DataFrame:
    """Five checks, each with the value it looked at and whether it failed."""
    facts = df.selectExpr(
        f"avg({LABEL}) AS balance",
        f"CAST(count_if(nanvl({PROBABILITY}, CAST(NULL AS DOUBLE)) IS NULL) AS DOUBLE) AS missing",
        "count_if(severity_confidence < 0.40D) / count(1) AS unsure",  # of all rows, nulls too
        "CAST(count_if(include_in_training) AS DOUBLE) AS n_train",
    )

    def check(name: str, value: str, failed: str) -> str:
        return f"named_struct('check', '{name}', 'value', {value}, 'failed', {failed})"

    return facts.selectExpr("inline(array(" + ", ".join([
        check("too many mismatches", "balance", "balance > 0.90D"),
        check("too few mismatches", "balance", "balance < 0.05D"),
        check("missing probabilities", "missing", "missing > 0"),
        check("low severity confidence", "unsure", "unsure > 0.30D"),
        check("small training set", "n_train", "n_train < 100"),
    ]) + "))")


def report_metrics(df: DataFrame) -> DataFrame:
    """The counts of the report as (section, metric, dim, value, pct), in one pass.

    Tickets are first counted per combination of the few categories the report
    uses; every line is a sum over that small table.
    """
    cells = df.groupBy(
        "priority", "inferred_severity", LABEL, "include_in_training", "mismatch_predicted"
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("severity_confidence").alias("confidence"))

    def line(section: str, metric: str, dim: str, value: str) -> str:
        return (
            f"named_struct('section', '{section}', 'metric', '{metric}', 'dim', {dim}, "
            f"'value', CAST({value} AS DOUBLE))"
        )

    lines = cells.selectExpr("n", "inline(array(" + ", ".join([
        line("dataset", "tickets", "''", "n"),
        line("dataset", "priority", "priority", "n"),
        line("severity", "severity", "inferred_severity", "n"),
        line("severity", "mean_confidence", "''", "confidence"),
        line("pseudo_labels", "mismatches", "''", f"n * {LABEL}"),
        line("pseudo_labels", "aligned", "''", f"n * (1 - {LABEL})"),
        line("pseudo_labels", "in_training", "''", "IF(include_in_training, n, 0)"),
        line("predictions", "mismatches", "''", "n * mismatch_predicted"),
    ]) + "))")
    sums = lines.groupBy("section", "metric", "dim").agg(F.sum("value").alias("value"))
    # over the report's own lines, a fixed few
    tickets = F.max(F.expr("CASE WHEN metric = 'tickets' THEN value END")).over(
        Window.partitionBy(F.lit(1))
    )
    return sums.withColumn("_n", tickets).selectExpr(
        "section", "metric", "dim",
        "IF(metric = 'mean_confidence', value / _n, value) AS value",
        "IF(metric = 'mean_confidence', NULL, 100D * value / _n) AS pct",
    )
