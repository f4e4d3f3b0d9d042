"""The stages of an audit, each from DataFrame to DataFrame.

    labelled = infer(read_ticket_csv(spark, path))
    model = train(labelled)
    predictions = predict(labelled, model)
    documents = dossier(predictions, model)
    report = evaluate(predictions, model)
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prioscope.config import AuditConfig
from prioscope.functions.durable import durable, scratch
from prioscope.operators import evidence, labels, metrics, model
from prioscope.operators.ingest import prepare_tickets
from prioscope.operators.severity import infer_severity
from prioscope.operators.signals import StructuralStats, join_label_probabilities
from prioscope.sources.tickets import resolve_columns


def infer(raw: DataFrame, config: AuditConfig = AuditConfig(),
          valence: Mapping[str, float] | DataFrame | None = None,
          label_probabilities: DataFrame | None = None,
          stats: StructuralStats | None = None) -> DataFrame:
    """Raw tickets to pseudo-labelled tickets, made durable for the later stages.

    The cleaned tickets are made durable too: the whole-table statistics then read
    three narrow columns instead of parsing the source again. That table is deleted here.
    Tickets that were numbered because they had no ids are stored by that already.
    """
    with scratch(keep_last=True):
        tickets = prepare_tickets(raw)
        if resolve_columns(raw.columns)["ticket_id"] is not None:
            tickets = durable(tickets)
        if label_probabilities is not None:
            tickets = join_label_probabilities(tickets, label_probabilities)
        return durable(labels.pseudo_labels(infer_severity(tickets, stats, config, valence), config))


def train(labelled: DataFrame, config: AuditConfig = AuditConfig()) -> model.MismatchModel:
    return model.train(labelled, config)


def predict(labelled: DataFrame, trained: model.MismatchModel,
            threshold: float | None = None) -> DataFrame:
    """Score every ticket; durable, because documents and report both read it."""
    return durable(trained.predict(labelled, threshold))


def dossier(predictions: DataFrame, trained: model.MismatchModel | None = None,
            config: AuditConfig = AuditConfig(), only_flagged: bool = True) -> DataFrame:
    """Evidence documents; with attributions if a model is given."""
    if only_flagged:
        predictions = predictions.filter("mismatch_predicted = 1")
    if trained is not None:
        predictions = trained.attribute(predictions, config)
    return evidence.dossiers(predictions, config, only_flagged)


def evaluate(predictions: DataFrame, trained: model.MismatchModel) -> DataFrame:
    """All report lines as one long table (section, metric, dim, value, pct)."""
    overview = metrics.report_metrics(predictions)

    def lines(df: DataFrame, section: str, dim: str, *names: str) -> DataFrame:
        entries = ", ".join(
            f"named_struct('section', '{section}', 'metric', '{n}', 'dim', {dim}, "
            f"'value', CAST({n} AS DOUBLE), 'pct', CAST(NULL AS DOUBLE))" for n in names
        )
        return df.selectExpr(f"inline(array({entries}))")

    oof = trained.oof
    parts = [
        overview,
        lines(trained.folds, "cross_validation", "CAST(fold + 1 AS STRING)",
              "auc", "f1", "precision", "recall", "brier", "threshold"),
        lines(metrics.cv_summary(trained.folds), "cross_validation", "''",
              "mean_auc", "std_auc", "mean_f1", "std_f1"),
        lines(metrics.auc(oof), "out_of_fold", "''", "auc"),
        lines(metrics.classification_metrics(oof, trained.threshold), "out_of_fold", "''",
              "f1", "precision", "recall", "brier_score", "threshold_used", "n_positive",
              "n_negative", "class_balance"),
        lines(metrics.classification_report(oof, trained.threshold), "oof_report", "class",
              "precision", "recall", "f1", "support"),
        lines(metrics.adversarial_slices(predictions), "slices", "priority",
              "n", "mismatch_pct", "mean_prob"),
        metrics.sanity_checks(predictions).selectExpr(
            "'sanity' AS section", "check AS metric", "IF(failed, 'FAILED', 'ok') AS dim",
            "value", "CAST(NULL AS DOUBLE) AS pct"),
    ]
    return reduce(DataFrame.unionByName, parts)


SECTION_TITLES = {
    "dataset": "Tickets", "severity": "Inferred severity", "pseudo_labels": "Pseudo-labels",
    "cross_validation": "Validation folds", "out_of_fold": "Scores of held-out tickets",
    "oof_report": "Classes of held-out tickets", "predictions": "Predictions",
    "slices": "By assigned priority", "sanity": "Checks",
}


def report_text(report: DataFrame, title: str = "Audit report", generated: str = "") -> str:
    """The report as Markdown tables, from its few dozen metric rows."""
    rows = report.orderBy("section", "metric", F.desc("value")).collect()
    out = [f"# {title}", *([f"{generated}"] if generated else [])]
    for section, heading in SECTION_TITLES.items():
        mine = [r for r in rows if r.section == section]
        if not mine:
            continue
        out += ["", f"## {heading}", "", "| metric | of | value | share |", "|---|---|---|---|"]
        for r in mine:
            value = "" if r.value is None else (
                str(int(r.value)) if float(r.value).is_integer() else f"{r.value:.4f}")
            out.append(f"| {r.metric} | {r.dim or ''} | {value} | {'' if r.pct is None else f'{r.pct:.1f} %'} |")
    return "\n".join(out) + "\n"
