"""Headline timings.

A line to stderr after each query; then one JSON line to stdout. BENCH_SF_DIR names the test data
folder, BENCH_CPUS the number of local cores. The training queries take several times as long as all
others together: they run only with BENCH_TRAINING=1, or alone with BENCH_TRAINING=only.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession

from prioscope.queries import QUERIES

HEADLINE = (
    "scan_tickets", "text_stats", "lexicon_hits", "lexicon_score", "sentiment_score",
    "structural_score", "severity_ensemble", "pseudo_labels", "pseudo_label_summary",
    "evidence_spans", "dossiers", "ngrams", "tfidf_vocab", "tfidf_weights",
    "structural_features", "robust_scaled", "feature_vectors", "label_encoding",
    "stratified_folds", "threshold_sweep", "fold_metrics", "metric_auc", "roc_curve",
    "classification_report", "report_metrics", "top_attributions",
)
TRAINING = ("oof_predictions", "calibrated_predict", "train_predict", "audit_checks")


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    training = os.environ.get("BENCH_TRAINING", "0")
    names = (() if training == "only" else HEADLINE) + (() if training == "0" else TRAINING)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("prioscope-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run(QUERIES["pseudo_labels"](spark, sf_dir))  # warm up the JVM and the files
    seconds = {}
    for name in names:
        start = time.time()
        run(QUERIES[name](spark, sf_dir))
        seconds[name] = round(time.time() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    tickets = QUERIES["priority_distribution"](spark, sf_dir).selectExpr("sum(n)").first()[0]
    print(json.dumps({
        "metric": "total seconds of headline queries",
        "value": round(sum(s for name, s in seconds.items() if name in HEADLINE), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")),
        "tickets": tickets,
        "tickets_per_sec": {name: round(tickets / s, 1) for name, s in seconds.items()},
    }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
