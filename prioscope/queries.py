"""One query per operator, each over whole tables of a test data folder.

Doubles are rounded to six places at this level only, because another engine adds
them up in another order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import asdict, fields
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prioscope import fixtures as X
from prioscope.config import STRUCTURAL_FEATURES, AuditConfig, BoosterConfig
from prioscope.functions import text as T
from prioscope.functions.durable import durable, shared_dir
from prioscope.operators import attribution as A
from prioscope.operators import evidence as EV
from prioscope.operators import features as FE
from prioscope.operators import folds as FO
from prioscope.operators import ingest as I
from prioscope.operators import isotonic as IS
from prioscope.operators import labels as LA
from prioscope.operators import lexicon as LX
from prioscope.operators import metrics as M
from prioscope.operators import model as MO
from prioscope.operators import severity as SV
from prioscope.operators import signals as SG
from prioscope.operators import thresholds as TH
from prioscope.plans import stages
from prioscope.sources import sinks, tickets as ST

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

THRESHOLD = 0.23
# boosted trees of full depth with the patient stop, in larger steps: the default step of 0.05
# takes over a hundred rounds of several jobs each for every fold
QUICK = AuditConfig(booster=BoosterConfig(step_size=0.3, patience=10))
DOSSIER_CONFIG = AuditConfig(timestamp="2026-01-01T00:00:00")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame) -> DataFrame:
    """Round every double column."""
    return df.select(*[
        F.round(name, 6).alias(name) if kind == "double" else F.col(name)
        for name, kind in df.dtypes
    ])


def joined(array: str) -> str:
    return f"array_join(transform({array}, x -> CAST(x AS STRING)), '|')"


_LABELLED: dict[tuple[str, str], DataFrame] = {}


def durable_labelled(spark: SparkSession, sf: str) -> DataFrame:
    """The labelled table, written once an application: later steps of an audit read it, and don't label again.

    A filter on a label would otherwise be pushed below the phrase matching, and
    repeat it.
    """
    key = (spark.sparkContext.applicationId, sf)
    if key not in _LABELLED:
        _LABELLED[key] = durable(X.labelled(spark, sf))
    return _LABELLED[key]


def scored_tickets(spark: SparkSession, sf: str) -> DataFrame:
    """The labelled table with a stand-in score."""
    return T.derive(durable_labelled(spark, sf), {"mismatch_probability": X.PROBABILITY})


# ------------------------------------------------------------------- ingest
@query
def scan_tickets(spark, sf):
    return ST.standardise(X.raw_tickets(spark, sf))


def exported(spark: SparkSession) -> str:
    """A new folder for an export that the query reads back."""
    return f"{shared_dir(spark)}/exports/{uuid.uuid4().hex}"


@query
def csv_scan(spark, sf):
    """The raw table written as CSV and scanned."""
    path = exported(spark)
    X.raw_tickets(spark, sf).write.option("header", True).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return ST.standardise(ST.read_ticket_csv(spark, path))


@query
def required_column_counts(spark, sf):
    return ST.required_column_counts(ST.standardise(X.raw_tickets(spark, sf)))


@query
def normalise_priority(spark, sf):
    orders = X.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("p"))
    return I.with_priority(orders, "p").select(
        "o_orderkey", "priority_raw", "priority", "priority_rank")


@query
def dropped_priority_counts(spark, sf):
    return I.dropped_priority_counts(ST.standardise(X.raw_tickets(spark, sf)))


@query
def clean_text(spark, sf):
    docs = X.table(spark, sf, "documents").selectExpr("'document' AS kind", "doc_id AS id", "text")
    pages = X.table(spark, sf, "pages").selectExpr("'page' AS kind", "page_id AS id", "html AS text")
    raw = X.raw_tickets(spark, sf).selectExpr(
        "'ticket' AS kind", "CAST(Ticket_ID AS BIGINT) AS id", "Ticket_Description AS text")
    rows = docs.unionByName(pages).unionByName(raw)
    return T.derive(rows, {"text": T.clean_text("text")})


@query
def full_text(spark, sf):
    return X.tickets(spark, sf).select("ticket_id", "full_text")


@query
def duration_minutes(spark, sf):
    return rounded(X.tickets(spark, sf).select(
        "ticket_id", "first_response_minutes", "resolution_time_minutes"))


@query
def csat_numeric(spark, sf):
    return X.tickets(spark, sf).select("ticket_id", "csat", "csat_numeric")


@query
def synthetic_ticket_id(spark, sf):
    raw = ST.standardise(X.raw_tickets(spark, sf))
    kept = I.with_priority(raw).filter("priority IS NOT NULL").selectExpr(
        "CAST(ticket_id AS BIGINT) AS source_id", "priority")
    return I.synthetic_ids(kept, ["source_id"])


@query
def priority_distribution(spark, sf):
    return I.priority_distribution(X.tickets(spark, sf))


@query
def text_stats(spark, sf):
    stats = T.text_stats("full_text")
    return rounded(X.tickets(spark, sf).selectExpr(
        "ticket_id", *[f"{sql} AS {name}" for name, sql in stats.items()]))


# ------------------------------------------------------------------ lexicon
@query
def lexicon_hits(spark, sf):
    hits = LX.with_lexicon_hits(X.tickets(spark, sf))
    return LX.lexicon_hit_rows(hits).select(
        "ticket_id", "level", "level_score", "phrase", "occ", "char_pos", "matched", "word_pos",
        "weight")


@query
def negation_zones(spark, sf):
    return X.tickets(spark, sf).selectExpr(
        "ticket_id", f"{joined(LX.negation_zone('full_text'))} AS zone")


@query
def lexicon_score(spark, sf):
    hits = LX.with_lexicon_hits(X.tickets(spark, sf))
    return rounded(hits.selectExpr(
        "ticket_id", f"{LX.lexicon_score('lexicon_hits')} AS urgency_lexicon_score"))


@query
def lexicon_evidence(spark, sf):
    hits = T.derive(LX.with_lexicon_hits(X.tickets(spark, sf)),
                    {"m": LX.lexicon_evidence("lexicon_hits")})
    return hits.selectExpr("ticket_id", *[
        f"array_join(element_at(m, '{level}'), '|') AS {level}"
        for level in ("critical", "high", "medium", "low")])


# ------------------------------------------------------------------ signals
@query
def label_prob_blend(spark, sf):
    df = X.with_label_probabilities(X.tickets(spark, sf))
    return rounded(df.selectExpr(
        "ticket_id", f"{SG.label_probability_blend()} AS nli_severity_score"))


@query
def structural_stats(spark, sf):
    stats = SG.StructuralStats.fit(X.tickets(spark, sf))
    values = asdict(stats)
    kinds = {f.name: "BIGINT" if f.name.endswith("_n") else "DOUBLE" for f in fields(stats)}
    return rounded(spark.range(1).selectExpr(
        *[f"CAST({'NULL' if values[c] is None else repr(values[c])} AS {kinds[c]}) AS {c}" for c in values]))


@query
def structural_score(spark, sf):
    df = X.tickets(spark, sf)
    score = SG.structural_score(SG.StructuralStats.fit(df))
    return rounded(df.selectExpr("ticket_id", f"{score} AS structural_score"))


@query
def sentiment_compound(spark, sf):
    return rounded(X.tickets(spark, sf).selectExpr(
        "ticket_id", f"{SG.sentiment_compound('full_text', X.VALENCE)} AS compound"))


@query
def sentiment_compound_table(spark, sf):
    """The same from a valence table."""
    table = spark.createDataFrame(list(X.VALENCE.items()), "word STRING, valence DOUBLE")
    return rounded(SG.with_sentiment_compound(X.tickets(spark, sf), table).select("ticket_id", "compound"))


@query
def label_prob_join(spark, sf):
    """The model signal from a table of label probabilities by ticket id."""
    df = X.tickets(spark, sf)
    table = X.with_label_probabilities(df).select("ticket_id", *SG.LABEL_PROBABILITY_WEIGHTS)
    return rounded(SG.join_label_probabilities(df, table).selectExpr(
        "ticket_id", f"{SG.label_probability_blend()} AS nli_severity_score"))


@query
def sentiment_score(spark, sf):
    df = T.derive(X.tickets(spark, sf),
                  {"compound": SG.sentiment_compound("full_text", X.VALENCE)})
    return rounded(df.selectExpr(
        "ticket_id", f"{SG.sentiment_score('compound', 'full_text')} AS sentiment_score"))


# ----------------------------------------------------------------- severity
@query
def severity_ensemble(spark, sf):
    return rounded(X.severity(spark, sf).select(
        "ticket_id", *SV.SIGNALS, "inferred_severity_score"))


@query
def severity_ensemble_model(spark, sf):
    df = X.with_label_probabilities(X.tickets(spark, sf))
    return rounded(SV.infer_severity(df, valence=X.VALENCE).select(
        "ticket_id", "nli_severity_score", "inferred_severity_score", "inferred_severity",
        "severity_confidence"))


@query
def severity_label(spark, sf):
    return X.severity(spark, sf).select(
        "ticket_id", "inferred_severity", "inferred_severity_rank")


@query
def severity_confidence(spark, sf):
    return rounded(X.severity(spark, sf).select("ticket_id", "severity_confidence"))


@query
def severity_distribution(spark, sf):
    return rounded(SV.severity_distribution(X.severity(spark, sf)))


# ------------------------------------------------------------ pseudo-labels
LABEL_COLUMNS = (
    "ticket_id", "priority", "inferred_severity", "priority_gap", "is_mismatch",
    "mismatch_direction", "pseudo_label_confidence", "pseudo_label_quality",
    "include_in_training",
)


@query
def pseudo_labels(spark, sf):
    return rounded(X.labelled(spark, sf).select(*LABEL_COLUMNS))


@query
def training_set(spark, sf):
    return rounded(LA.training_set(durable_labelled(spark, sf)).select(
        "ticket_id", "priority", "is_mismatch", "pseudo_label_confidence"))


@query
def pseudo_label_roundtrip(spark, sf):
    path = exported(spark)
    sinks.write_pseudo_labels(X.labelled(spark, sf), path)
    return rounded(sinks.read_pseudo_labels(spark, path).select(*LABEL_COLUMNS))


@query
def pseudo_label_summary(spark, sf):
    return rounded(LA.pseudo_label_summary(X.labelled(spark, sf)))


@query
def mismatch_direction_counts(spark, sf):
    return LA.direction_counts(durable_labelled(spark, sf))


@query
def label_quality_counts(spark, sf):
    return LA.quality_counts(durable_labelled(spark, sf))


# ----------------------------------------------------------------- features
@query
def ngrams(spark, sf):
    return FE.term_counts(X.tickets(spark, sf))


@query
def tfidf_vocab(spark, sf):
    model = FE.TfidfModel.fit(X.tickets(spark, sf))
    return rounded(model.vocabulary.select("term", "tf", "df", "idx", "idf"))


@query
def tfidf_weights(spark, sf):
    df = X.tickets(spark, sf)
    return rounded(FE.TfidfModel.fit(df).weights(df))


@query
def embedding_l2_norm(spark, sf):
    vectors = X.table(spark, sf, "embeddings").selectExpr(
        "vec_id", f"{FE.l2_normalised('embedding')} AS e")
    return rounded(vectors.selectExpr("vec_id", "posexplode(e) AS (dim, value)"))


def _structural(spark, sf, df=None):
    df = durable_labelled(spark, sf) if df is None else df
    return FE.structural_features(df, FE.FeatureStats.fit(df), FE.fit_encoders(df))


@query
def structural_features(spark, sf):
    return rounded(_structural(spark, sf))


CODES = ("channel_enc", "ticket_type_enc", "status_enc")


@query
def label_encoding(spark, sf):
    df = X.tickets(spark, sf)
    return FE.encode(df, FE.fit_encoders(df)).select("ticket_id", *CODES)


@query
def label_encoding_unseen(spark, sf):
    """Codes learned on tickets, applied to the turns of all conversations."""
    turns = X.table(spark, sf, "conversations").selectExpr(
        "conv_id", "turn", "role AS channel", "CAST(NULL AS STRING) AS ticket_type",
        "upper(CASE WHEN turn = 0 THEN 'o' ELSE 'closed' END) AS status")
    encoders = FE.fit_encoders(X.tickets(spark, sf))
    return FE.encode(turns, encoders).select("conv_id", "turn", *CODES)


@query
def robust_scaled(spark, sf):
    raw = _structural(spark, sf)
    return rounded(FE.RobustScaling.fit(raw).transform(raw))


@query
def feature_names(spark, sf):
    model = FE.TfidfModel.fit(X.tickets(spark, sf))
    dim = X.table(spark, sf, "embeddings").agg(F.max(F.size("embedding"))).first()[0]
    return FE.feature_names(model.vocabulary, dim)


def _with_embeddings(spark, sf, df):
    vectors = X.table(spark, sf, "embeddings").selectExpr(
        "CAST(vec_id AS STRING) AS ticket_id", f"{FE.l2_normalised('embedding')} AS embedding")
    return df.join(vectors, "ticket_id", "left")


@query
def feature_vectors(spark, sf):
    df = _with_embeddings(spark, sf, durable_labelled(spark, sf))
    vectors = FE.with_vector_entries(FE.FeatureModel.fit(df).transform(df))
    return vectors.select("ticket_id", F.size("entries").alias("non_zero"), "features")


@query
def feature_vector_entries(spark, sf):
    """The vectors as a table: text weights, embedding, scaled columns."""
    df = _with_embeddings(spark, sf, durable_labelled(spark, sf))
    vectors = FE.with_vector_entries(FE.FeatureModel.fit(df).transform(df))
    return rounded(FE.entry_rows(vectors, "ticket_id").withColumnRenamed("weight", "value"))


# --------------------------------------------------------------- classifier
@query
def stratified_folds(spark, sf):
    return FO.stratified_folds(durable_labelled(spark, sf).select("ticket_id", "is_mismatch"))


@query
def class_weights(spark, sf):
    return rounded(FO.class_weights(durable_labelled(spark, sf)))


def _scored_folds(spark, sf):
    return FO.stratified_folds(
        scored_tickets(spark, sf).select("ticket_id", "is_mismatch", "mismatch_probability"))


@query
def threshold_sweep(spark, sf):
    return rounded(TH.threshold_sweep(_scored_folds(spark, sf), by=["fold"]))


@query
def optimal_threshold(spark, sf):
    return rounded(TH.optimal_threshold(scored_tickets(spark, sf)))


@query
def fold_metrics(spark, sf):
    return rounded(M.fold_metrics(_scored_folds(spark, sf)))


@query
def fold_threshold_median(spark, sf):
    return rounded(M.fold_threshold_median(
        TH.optimal_threshold(_scored_folds(spark, sf), by=["fold"])))


@query
def cv_summary(spark, sf):
    return rounded(M.cv_summary(M.fold_metrics(_scored_folds(spark, sf))))


def _predicted(spark, sf):
    return TH.with_prediction(scored_tickets(spark, sf), THRESHOLD)


@query
def predict_label(spark, sf):
    return rounded(_predicted(spark, sf).select(
        "ticket_id", "mismatch_probability", "mismatch_predicted"))


@query
def confidence_level(spark, sf):
    return _predicted(spark, sf).select("ticket_id", "confidence_level")


@query
def predictions_export(spark, sf):
    return rounded(sinks.prediction_columns(_predicted(spark, sf)))


@query
def isotonic_fit(spark, sf):
    """Spark ML's isotonic regression over fifty probability bins."""
    bins = durable(scored_tickets(spark, sf).selectExpr(
        "CAST(least(floor(mismatch_probability * 50), 49) AS DOUBLE) AS bin", "is_mismatch"
    ).groupBy("bin").agg(
        F.avg(F.col("is_mismatch").cast("double")).alias("rate"),
        F.count(F.lit(1)).cast("double").alias("n")))
    model = IsotonicRegression(
        featuresCol="bin", labelCol="rate", weightCol="n", predictionCol="fitted").fit(bins)
    return rounded(model.transform(bins).selectExpr(
        "CAST(bin AS INT) AS bin", "CAST(n AS BIGINT) AS n", "rate", "fitted"))


def _training_table(spark, sf):
    df = durable_labelled(spark, sf)
    return MO.prepare_training(LA.training_set(df), QUICK)[1]


@query
def oof_predictions(spark, sf):
    scored = MO.out_of_fold(_training_table(spark, sf), QUICK)
    return scored.select("ticket_id", "fold", "is_mismatch", "rounds", "mismatch_probability")


@query
def calibrated_predict(spark, sf):
    table = _training_table(spark, sf)
    scored = MO.score_calibrated(MO.fit_calibrated(table, QUICK), table)
    return scored.select("ticket_id", "is_mismatch", "mismatch_probability")


@query
def isotonic_scores(spark, sf):
    """The fit in ranges over all different scores: the fitted rate of each ticket's score."""
    scored = scored_tickets(spark, sf)
    model = IS.fit_isotonic(scored, "mismatch_probability", "is_mismatch").setPredictionCol("fitted")
    return rounded(model.setFeaturesCol("mismatch_probability").transform(scored).select(
        "ticket_id", "mismatch_probability", "fitted"))


@query
def train_predict(spark, sf):
    """The whole training with boosted trees, then every ticket scored."""
    df = durable_labelled(spark, sf)
    return sinks.prediction_columns(MO.train(df, QUICK).predict(df))


@query
def train_predict_checks(spark, sf):
    """What holds for a trained model: rows, ids and probabilities of its folds and scores."""
    df = durable_labelled(spark, sf)
    model = MO.train(df, QUICK)

    def facts(rows, part, fold):
        return rows.groupBy(F.lit(part).alias("part"), fold.alias("fold")).agg(
            F.count(F.lit(1)).alias("n"), F.countDistinct("ticket_id").alias("n_ids"),
            F.count_if(F.col("mismatch_probability").between(0, 1)).alias("n_in_range"))

    return facts(model.oof, "out_of_fold", F.col("fold")).unionByName(
        facts(model.predict(df), "scored", F.lit(None).cast("int")))


def _refused(step: Callable) -> int:
    """1 if the step refuses its input."""
    try:
        step()
    except ValueError:
        return 1
    return 0


def _fact(df: DataFrame, name: str, value) -> DataFrame:
    return df.agg(value.cast("long").alias("n")).select(F.lit(name).alias("what"), "n")


@query
def audit_checks(spark, sf):
    """An audit from raw tickets to the written report, with boosted trees: what each stage must have given."""
    raw = X.raw_tickets(spark, sf)
    labelled = stages.infer(raw, QUICK, X.VALENCE)
    model = stages.train(labelled, QUICK)
    predictions = stages.predict(labelled, model)
    documents = durable(stages.dossier(predictions, model, QUICK))
    flagged = predictions.filter("mismatch_predicted = 1").select("ticket_id")
    report = durable(stages.evaluate(predictions, model))
    path = exported(spark)
    sinks.write_report(report, path)
    back = sinks.read_report(spark, path)
    booster = model.pairs[0][0]
    paths = A.PathModel.of([booster])
    explained = A.with_path_contributions(model.features.transform(labelled), paths)
    margins = booster.transform(explained).select(
        vector_to_array("rawPrediction")[1].alias("raw"),
        F.aggregate("contributions", F.lit(0.0), lambda acc, x: acc + x["c"]).alias("own"))
    every, in_range = F.count(F.lit(1)), F.col("mismatch_probability").between(0, 1)
    facts = [
        _fact(labelled, "tickets", every),
        _fact(labelled, "tickets in training", F.count_if(F.col("include_in_training"))),
        _fact(model.oof, "scores of held-out tickets", every),
        _fact(model.oof, "held-out tickets", F.countDistinct("ticket_id")),
        _fact(predictions, "scored tickets", F.countDistinct("ticket_id")),
        _fact(predictions, "scores from 0 to 1", F.count_if(in_range)),
        _fact(flagged.exceptAll(documents.select("ticket_id")), "flagged tickets without a document", every),
        _fact(documents.select("ticket_id").exceptAll(flagged), "documents of other tickets", every),
        _fact(documents, "documents with over five attributions", F.count_if(F.size("shap_attributions") > 5)),
        # Spark ML's raw prediction is the margin, for the class 1
        _fact(margins, "margins that contributions add up to", F.count_if(F.abs(F.col("own") + paths.base - F.col("raw")) < 1e-9)),
        _fact(report.exceptAll(back).unionByName(back.exceptAll(report)), "report lines that differ when read back", every),
        spark.createDataFrame([
            ("too few rows are refused", _refused(lambda: MO.train(labelled.limit(QUICK.min_training_rows - 1), QUICK))),
            ("tickets without a severity are refused", _refused(lambda: LA.pseudo_labels(labelled.drop("severity_confidence")))),
            ("tickets without texts are refused", _refused(lambda: stages.infer(raw.drop("Ticket_Description", "Ticket_Subject"), QUICK))),
        ], "what STRING, n LONG"),
        report.groupBy(F.concat(F.lit("report lines: "), F.col("section")).alias("what")).agg(every.alias("n")),
    ]
    return reduce(DataFrame.unionByName, facts)


@query
def model_roundtrip(spark, sf):
    """A model saved and loaded: tickets scored by both, and scores, thresholds and attributions that differ."""
    df = durable_labelled(spark, sf)
    model = MO.train(df, QUICK)
    path = exported(spark)
    model.save(path)
    again = MO.MismatchModel.load(spark, path)

    def scores(m, name):
        return m.attribute(m.predict(df), QUICK).select(
            "ticket_id", F.struct("mismatch_probability", "mismatch_predicted", "shap_attributions").alias(name))

    both = scores(model, "own").join(scores(again, "loaded"), "ticket_id", "full")
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.count("own").alias("n_own"), F.count("loaded").alias("n_loaded"),
        F.count_if(~F.col("own").eqNullSafe(F.col("loaded"))).alias("n_differ"),
    ).withColumn("same_threshold", F.lit(model.threshold == again.threshold)).withColumn(
        "n_oof", F.lit(again.oof.count()))


# ---------------------------------------------------- attributions, evidence
def _coefficient(i: int) -> float:
    return ((i * 37) % 21 - 10) / 10


def _coefficients(df: DataFrame) -> DataFrame:
    """Test coefficients and means per feature of a long table of dense features."""
    return df.groupBy("idx").agg(F.avg("value").alias("mean")).withColumn(
        "coef", F.expr("((idx * 37) % 21 - 10) / 10D"))


def _long_structural(spark, sf) -> DataFrame:
    raw = _structural(spark, sf)
    scaled = FE.RobustScaling.fit(raw).transform(raw)
    columns = ", ".join(STRUCTURAL_FEATURES)
    return scaled.selectExpr("ticket_id", f"posexplode(array({columns})) AS (idx, value)")


@query
def linear_contributions(spark, sf):
    rows = _long_structural(spark, sf)
    return rounded(A.linear_contributions(rows, _coefficients(rows)))


def _attributed(spark, sf, *keep: str) -> DataFrame:
    """Tickets with attributions over all text and structural features."""
    df = durable_labelled(spark, sf)
    model = FE.FeatureModel.fit(df)
    rows = durable(model.transform(df).select(*(keep or df.columns), "features"))
    # the driver gets one number per feature
    means = rows.select(Summarizer.mean(F.col("features"))).first()[0].toArray()
    coefficients = [_coefficient(i) for i in range(model.size)]
    return A.with_attributions(FE.with_vector_entries(rows), model.names(), coefficients, means)


@query
def top_attributions(spark, sf):
    return _attributed(spark, sf, "ticket_id").selectExpr(
        "ticket_id", "posexplode(shap_attributions) AS (rank, a)").select(
        "ticket_id", "rank", "a.feature", "a.human_name", "a.shap_value", "a.direction")


@query
def humanised_names(spark, sf):
    model = FE.TfidfModel.fit(X.tickets(spark, sf))
    dim = X.table(spark, sf, "embeddings").agg(F.max(F.size("embedding"))).first()[0]
    names = FE.feature_names(model.vocabulary, dim).select("name")
    extra = X.table(spark, sf, "orders").selectExpr(
        "concat('order_', lower(o_orderstatus), '_flag') AS name").distinct()
    return names.unionByName(extra).selectExpr("name", f"{FE.humanised_name('name')} AS human_name")


@query
def evidence_spans(spark, sf):
    df = LX.with_lexicon_hits(X.tickets(spark, sf))
    spans = df.selectExpr(
        "ticket_id", f"posexplode({EV.evidence_spans('full_text', 'lexicon_hits')}) AS (pos, s)")
    return spans.select("ticket_id", "pos", "s.*")


def _acted(spark, sf):
    return EV.with_action(_predicted(spark, sf))


@query
def recommended_action(spark, sf):
    return _acted(spark, sf).select("ticket_id", "recommended_action", "action_rationale")


@query
def action_counts(spark, sf):
    return EV.action_counts(_acted(spark, sf))


def _dossiers(spark, sf, df=None):
    df = durable_labelled(spark, sf) if df is None else df
    scored = T.derive(df, {"mismatch_probability": X.PROBABILITY})
    return EV.dossiers(TH.with_prediction(scored, THRESHOLD), DOSSIER_CONFIG)


@query
def dossiers(spark, sf):
    spans = "array_join(transform(evidence_spans, s -> concat_ws('/', s.span, s.signal_level, " \
            "s.char_position)), '|')"
    return _dossiers(spark, sf).selectExpr(
        "ticket_id", "timestamp", "assigned_priority", "inferred_severity", "severity_score",
        "severity_confidence", "priority_gap", "mismatch_detected", "mismatch_probability",
        "mismatch_direction", "confidence_level", "recommended_action", "action_rationale",
        f"{spans} AS spans", "ticket_subject", "ticket_snippet")


@query
def dossier_roundtrip(spark, sf):
    """Documents written out and read back, with a few fields of each record."""
    path = exported(spark)
    sinks.write_dossiers(_dossiers(spark, sf), path, DOSSIER_CONFIG)
    return sinks.read_dossiers(spark, path).selectExpr(
        "ticket_id", "action", "get_json_object(json, '$.inferred_severity') AS inferred_severity",
        "CAST(get_json_object(json, '$.priority_gap') AS INT) AS priority_gap")


@query
def dossier_markdown(spark, sf):
    rows = EV.with_markdown(_dossiers(spark, sf, _attributed(spark, sf)), DOSSIER_CONFIG)
    return rows.selectExpr("ticket_id", "length(markdown) AS n_chars", "md5(markdown) AS md5")


# ------------------------------------------------------------------ metrics
@query
def metric_auc(spark, sf):
    return rounded(M.auc(scored_tickets(spark, sf)))


@query
def classification_metrics(spark, sf):
    return rounded(M.classification_metrics(scored_tickets(spark, sf), 0.5))


@query
def classification_report(spark, sf):
    return rounded(M.classification_report(scored_tickets(spark, sf), 0.5))


@query
def confusion_matrix(spark, sf):
    return M.confusion_matrix(scored_tickets(spark, sf), 0.5)


@query
def roc_curve(spark, sf):
    return rounded(M.roc_curve(scored_tickets(spark, sf)))


@query
def priority_severity_crosstab(spark, sf):
    return M.priority_severity_crosstab(X.severity(spark, sf))


@query
def probability_histogram(spark, sf):
    return rounded(M.probability_histogram(scored_tickets(spark, sf)))


@query
def adversarial_slices(spark, sf):
    return M.adversarial_slices(scored_tickets(spark, sf))


@query
def sanity_checks(spark, sf):
    return rounded(M.sanity_checks(scored_tickets(spark, sf)))


@query
def report_metrics(spark, sf):
    return rounded(M.report_metrics(_predicted(spark, sf)))
