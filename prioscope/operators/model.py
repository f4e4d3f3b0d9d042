"""Training, calibration and scoring of the mismatch classifier on Spark ML."""

from __future__ import annotations

import json
import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from statistics import median_high

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from prioscope.config import AuditConfig, BoosterConfig
from prioscope.functions import text as T
from prioscope.functions.durable import durable, scratch
from prioscope.operators import features as FE
from prioscope.operators import metrics as M
from prioscope.operators.attribution import PathModel, with_attributions, with_path_attributions
from prioscope.operators.boosting import boosted_model, fit_together
from prioscope.operators.folds import ROW_KEYS, class_weights, fold_table, with_folds, with_row_keys
from prioscope.operators.isotonic import fit_isotonic
from prioscope.operators.thresholds import with_prediction

LABEL = "is_mismatch"
#: Rounds of boosting in the first fit, in times of the patience.
FIRST_FIT = 5
#: Fewer rows than this are not worth a task of their own in training: each task fills, and sends, histograms of
#: all features for all nodes of a level, whatever its rows.
ROWS_A_TASK = 4096


def weighted(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Add balanced class weights. A class that is absent needs none."""
    weights = {r[label]: r.weight for r in class_weights(df, label).collect()}  # two rows
    whens = " ".join(f"WHEN {value} THEN {w!r}D" for value, w in weights.items())
    return T.derive(df, {"weight": f"CASE {label} {whens} END",
                         "label": f"CAST({label} AS DOUBLE)"})


def learner(booster: BoosterConfig, seed: int, rounds: int | None = None):
    """The learner of a config; ``rounds`` fixes the number of boosting rounds."""
    if booster.learner == "logistic":
        return LogisticRegression(
            featuresCol="features", labelCol="label", weightCol="weight",
            maxIter=booster.max_iter, regParam=booster.ridge,
        )
    return GBTClassifier(
        featuresCol="features", labelCol="label", weightCol="weight",
        maxIter=rounds or booster.max_iter, stepSize=booster.step_size, maxDepth=booster.max_depth,
        minInstancesPerNode=booster.min_instances_per_node,
        subsamplingRate=booster.subsampling_rate, featureSubsetStrategy=booster.feature_subset,
        maxMemoryInMB=booster.max_memory_mb, seed=seed,
    )


def patient_round(losses: list[float], patience: int) -> tuple[int, bool]:
    """The round of least loss before ``patience`` rounds brought no smaller one, from 1; and whether they did."""
    best = 0
    for k, loss in enumerate(losses):
        if loss < losses[best]:
            best = k
        elif k - best >= patience:
            return best + 1, True
    return best + 1, False


def boost(train: DataFrame, held: DataFrame, booster: BoosterConfig, seed: int) -> tuple[GBTClassificationModel, int]:
    """Boost until ``patience`` rounds brought no smaller loss on ``held``; the model of the best round, and its number.

    Spark ML bins the features once for all rounds of a fit, and its first trees don't depend on how many
    follow. So ``FIRST_FIT`` times ``patience`` rounds are fitted, twice as many as long as the patience does
    not run out in them, and the model is made of the first trees.
    """
    rounds = min(FIRST_FIT * booster.patience, booster.max_iter)
    while True:
        model = learner(booster, seed, rounds).fit(train)
        losses = [float("inf") if math.isnan(x) else x for x in model.evaluateEachIteration(held)]
        best, ended = patient_round(losses, booster.patience)
        if ended or rounds == booster.max_iter:
            return boosted_model(model.trees[:best], model.treeWeights[:best], model.numFeatures), best
        rounds = min(2 * rounds, booster.max_iter)


def fit_patiently(train: DataFrame, held: DataFrame, booster: BoosterConfig, seed: int) -> tuple:
    """The model with the round count of least loss on ``held``, and that count; None for the linear learner."""
    if booster.learner == "logistic":
        return learner(booster, seed).fit(train), None
    return boost(train, held, booster, seed)


def score(model, df: DataFrame, name: str) -> DataFrame:
    """Add the probability of a mismatch under ``name``."""
    return model.transform(df).withColumn(
        name, vector_to_array("probability")[1]
    ).drop("rawPrediction", "probability", "prediction")


def in_parallel(spark: SparkSession, tasks: list, width: int = 4) -> list:
    """Submit a few Spark jobs at a time from the driver; results keep the order."""
    bound = [inheritable_thread_target(spark)(task) for task in tasks]
    with ThreadPoolExecutor(width) as pool:
        return list(pool.map(lambda task: task(), bound))


def fit_without_each(df: DataFrame, group: str, n: int, config: AuditConfig, rounds: int | None = None,
                     after: tuple[str, int] | None = None) -> list[tuple]:
    """For each of ``n`` groups of rows, the model of all others with its number of rounds; None for the linear learner.

    Boosted trees of all groups grow together; a model looks for its rounds on its own group unless they are given.
    ``after`` is a second grouping and its number of groups: their models come last, with the median of the rounds
    that the others found.
    """
    if config.booster.learner == "gbt":
        return fit_together(df, LABEL, group, n, config.booster, config.seed, patient_round, rounds,
                            after=(*after, median_high) if after else None)

    def one(by: str, own: int) -> tuple:
        return learner(config.booster, config.seed).fit(weighted(df.filter(F.col(by) != own))), None

    return in_parallel(df.sparkSession, [
        lambda by=by, k=k: one(by, k) for by, n_groups in ((group, n), *([after] if after else [])) for k in range(n_groups)])


def out_of_fold(df: DataFrame, config: AuditConfig = AuditConfig(), fitted: list[tuple] | None = None) -> DataFrame:
    """Score every row with the model that was trained without its fold; ``fitted`` has those models if they are there.

    ``rounds`` is the number of boosting rounds that the fold chose; null for the linear learner.
    """
    fitted = fitted or fit_without_each(df, "fold", config.cv_folds, config)
    scored = [
        score(model, df.filter(F.col("fold") == fold), "mismatch_probability").withColumn("rounds", F.lit(rounds).cast("int"))
        for fold, (model, rounds) in enumerate(fitted)
    ]
    return reduce(DataFrame.unionByName, scored)


def calibrate(model, held: DataFrame) -> IsotonicRegressionModel:
    """Monotone map from the model's probability to the observed rate."""
    scored = durable(score(model, held, "raw").select("raw", F.col(LABEL).cast("double").alias("rate")))
    return fit_isotonic(scored, "raw", "rate")


def fit_calibrated(df: DataFrame, config: AuditConfig = AuditConfig(),
                   rounds: int | None = None, fitted: list[tuple] | None = None) -> list[tuple]:
    """Per calibration fold: a model of the other folds, and its calibration on this one.

    ``df`` has the calibration fold in ``part``. ``rounds`` is the number of boosting rounds
    that the validation folds chose; without it, each model looks for its own. ``fitted`` has the models if they
    are there.
    """
    fitted = fitted or fit_without_each(df, "part", config.calibration_folds, config, rounds)
    return in_parallel(df.sparkSession, [
        lambda p=p, m=model: (m, calibrate(m, df.filter(F.col("part") == p))) for p, (model, _) in enumerate(fitted)
    ])


def score_calibrated(pairs: list[tuple], df: DataFrame) -> DataFrame:
    """Add ``mismatch_probability``: the mean of the calibrated probabilities."""
    names = [f"_p{i}" for i in range(len(pairs))]
    for name, (model, calibration) in zip(names, pairs):
        raw = score(model, df, f"{name}_raw")
        df = calibration.setFeaturesCol(f"{name}_raw").setPredictionCol(name).transform(raw)
    mean = f"({' + '.join(names)}) / {len(names)}"
    return T.derive(df, {"mismatch_probability": mean}).drop(*names, *[f"{n}_raw" for n in names])


@dataclass
class MismatchModel:
    """A trained classifier with everything scoring and reporting need."""

    features: FE.FeatureModel
    pairs: list[tuple]
    threshold: float
    folds: DataFrame  # one row of metrics per fold
    oof: DataFrame  # ticket_id, label, fold, probability
    coefficients: list[float] = field(default_factory=list)
    means: list[float] = field(default_factory=list)

    def predict(self, df: DataFrame, threshold: float | None = None) -> DataFrame:
        """Score all rows of a labelled table with frozen statistics, without a shuffle."""
        t = self.threshold if threshold is None else threshold
        scored = score_calibrated(self.pairs, self.features.transform(df)).drop("features")
        return with_prediction(scored, t)

    def attribute(self, df: DataFrame, config: AuditConfig = AuditConfig()) -> DataFrame:
        """Add the top attributions of every given row, without a shuffle: those of the models that score it."""
        rows, names = self.features.transform(df), self.features.names()
        if self.coefficients:
            rows = with_attributions(
                FE.with_vector_entries(rows), names, self.coefficients, self.means, config.top_attributions)
            return rows.drop("features", "entries")
        paths = PathModel.of([model for model, _ in self.pairs])
        return with_path_attributions(rows, names, paths, config.top_attributions).drop("features")

    def save(self, path: str) -> None:
        self.features.save(f"{path}/features")
        # copied first: the model may have been loaded from this folder
        durable(self.folds).write.mode("overwrite").parquet(f"{path}/folds")
        oof = durable(self.oof)
        oof.write.mode("overwrite").parquet(f"{path}/oof")
        for i, (model, calibration) in enumerate(self.pairs):
            PipelineModel([model]).write().overwrite().save(f"{path}/model_{i}")
            calibration.write().overwrite().save(f"{path}/calibration_{i}")
        facts = {"threshold": self.threshold, "n_pairs": len(self.pairs),
                 "coefficients": self.coefficients, "means": self.means}
        oof.sparkSession.createDataFrame(
            [(json.dumps(facts),)], "facts STRING"
        ).write.mode("overwrite").json(f"{path}/facts")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> MismatchModel:
        facts = json.loads(spark.read.schema("facts STRING").json(f"{path}/facts").first().facts)
        pairs = [
            (PipelineModel.load(f"{path}/model_{i}").stages[0],
             IsotonicRegressionModel.load(f"{path}/calibration_{i}"))
            for i in range(facts["n_pairs"])
        ]
        return cls(
            FE.FeatureModel.load(spark, f"{path}/features"), pairs, facts["threshold"],
            spark.read.parquet(f"{path}/folds"), spark.read.parquet(f"{path}/oof"),
            facts["coefficients"], facts["means"],
        )


def explain(df: DataFrame, pairs: list[tuple]) -> tuple[list[float], list[float]]:
    """For linear models: the means of their coefficients, and the feature means; two numbers per feature."""
    mean = df.select(Summarizer.mean(F.col("features"))).first()[0]
    own = sum(model.coefficients.toArray() for model, _ in pairs) / len(pairs)
    return [float(x) for x in own], [float(x) for x in mean.toArray()]


def check_training_size(df: DataFrame, config: AuditConfig = AuditConfig()) -> None:
    if len(df.select(LABEL).take(config.min_training_rows)) < config.min_training_rows:
        raise ValueError(
            f"Fewer than {config.min_training_rows} confident training rows; "
            "lower min_confidence or check the table."
        )


def prepare_training(rows: DataFrame, config: AuditConfig = AuditConfig()):
    """The fitted feature model, and the durable table of vectors with both kinds of folds.

    ``fold`` is for validation, ``part`` for calibration. Folds are dealt to keys and hashes of rows
    alone; texts are neither sorted nor stored for them, only vectors meet their folds.
    """
    model = FE.FeatureModel.fit(rows, config)
    wanted = {"part": (config.calibration_folds, config.seed + 1), "fold": (config.cv_folds, config.seed)}
    keyed = with_row_keys(rows)
    table = fold_table(keyed, LABEL, wanted)
    vectors = model.transform(keyed).select("ticket_id", LABEL, *ROW_KEYS, "features")
    made = durable(with_folds(vectors, table, wanted).select("ticket_id", LABEL, "fold", "part", "features"))
    return model, made.coalesce(max(1, math.ceil(made.count() / ROWS_A_TASK)))


def train(labelled: DataFrame, config: AuditConfig = AuditConfig()) -> MismatchModel:
    """Cross-validate, choose the threshold, and fit the calibrated model.

    ``labelled`` is read several times: give the durable table of the infer stage. Of all tables that
    training writes only the model's own stay: its folds, scores and feature tables.
    """
    rows = labelled.filter("include_in_training")
    check_training_size(rows, config)
    with scratch() as mine:
        feature_model, table = prepare_training(rows, config)
        # models for calibration have the median of the rounds that the folds choose, and grow beside theirs
        fitted = fit_without_each(table, "fold", config.cv_folds, config, after=("part", config.calibration_folds))
        oof = durable(out_of_fold(table, config, fitted[:config.cv_folds]).select(
            "ticket_id", LABEL, "fold", "rounds", "mismatch_probability"))
        folds = durable(M.fold_metrics(oof))
        threshold = M.fold_threshold_median(folds).first().threshold
        pairs = fit_calibrated(table, config, fitted=fitted[config.cv_folds:])
        linear = config.booster.learner == "logistic"
        coefficients, means = explain(table, pairs) if linear else ([], [])
        mine.keep(oof, folds, feature_model.encoders, feature_model.tfidf.vocabulary)
    return MismatchModel(feature_model, pairs, threshold, folds, oof, coefficients, means)
