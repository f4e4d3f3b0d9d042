"""Exports: pseudo-labels, predictions, evidence documents, report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prioscope.config import PREDICTION_COLUMNS, PSEUDO_LABEL_COLUMNS, AuditConfig
from prioscope.operators.evidence import with_markdown

PSEUDO_LABEL_SCHEMA = (
    "ticket_id STRING, priority STRING, priority_rank INT, inferred_severity STRING, "
    "inferred_severity_rank INT, inferred_severity_score DOUBLE, urgency_lexicon_score DOUBLE, "
    "nli_severity_score DOUBLE, structural_score DOUBLE, sentiment_score DOUBLE, "
    "severity_confidence DOUBLE, priority_gap INT, is_mismatch INT, mismatch_direction STRING, "
    "pseudo_label_confidence DOUBLE, pseudo_label_quality STRING, include_in_training BOOLEAN, "
    "full_text STRING, subject STRING, description STRING"
)


def pseudo_label_columns(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in PSEUDO_LABEL_COLUMNS if c in df.columns])


def prediction_columns(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in PREDICTION_COLUMNS if c in df.columns])


def _write(df: DataFrame, path: str, format: str) -> None:
    writer = df.write.mode("overwrite")
    if format == "csv":
        writer = writer.option("header", True).option("quote", '"').option("escape", '"').option(
            "emptyValue", "")
    writer.format(format).save(path)


def write_pseudo_labels(df: DataFrame, path: str, format: str = "parquet") -> None:
    _write(pseudo_label_columns(df), path, format)


def read_pseudo_labels(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Read an export back; a missing path raises Spark's AnalysisException."""
    if format == "csv":
        # a written empty string reads back as null; the texts are never null
        df = spark.read.schema(PSEUDO_LABEL_SCHEMA).option("header", True).option(
            "multiLine", True).option("quote", '"').option("escape", '"').csv(path)
        return df.na.fill("", ["full_text", "subject", "description"])
    return spark.read.schema(PSEUDO_LABEL_SCHEMA).format(format).load(path)


def write_predictions(df: DataFrame, path: str, format: str = "parquet") -> None:
    _write(prediction_columns(df), path, format)


def write_dossiers(dossier_rows: DataFrame, path: str,
                   config: AuditConfig = AuditConfig()) -> None:
    """JSON and Markdown, one record per ticket, partitioned by action.

    Records share files: one file per ticket would be billions of tiny ones.
    """
    documents = with_markdown(dossier_rows, config).select(
        "ticket_id", F.col("recommended_action").alias("action"),
        F.to_json(F.struct(*dossier_rows.columns)).alias("json"), "markdown",
    )
    documents.write.mode("overwrite").partitionBy("action").json(path)


def read_dossiers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(
        "ticket_id STRING, json STRING, markdown STRING, action STRING"
    ).json(path)


def write_report(metrics: DataFrame, path: str) -> None:
    """The long metrics table: a few dozen rows."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(
        "section STRING, metric STRING, dim STRING, value DOUBLE, pct DOUBLE").json(path)
