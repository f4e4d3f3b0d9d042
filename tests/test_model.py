"""Features, thresholds, training, scoring, documents and the report."""

import json

import pytest
from pyspark.sql import functions as F

from prioscope.config import AuditConfig, BoosterConfig
from prioscope.operators import attribution as A
from prioscope.operators import evidence as EV
from prioscope.operators import features as FE
from prioscope.operators import metrics as M
from prioscope.operators import model as MO
from prioscope.operators import thresholds as TH
from prioscope.plans import stages
from prioscope.sources import sinks

LOGISTIC = AuditConfig(booster=BoosterConfig(learner="logistic", max_iter=10))
SCORES = "is_mismatch INT, mismatch_probability DOUBLE"


@pytest.fixture(scope="module")
def trained(labelled):
    return stages.train(labelled, LOGISTIC)


@pytest.fixture(scope="module")
def predictions(labelled, trained):
    return stages.predict(labelled, trained)


def test_robust_scaling_of_a_constant_column(spark):
    df = spark.createDataFrame([(0.0,)] * 6 + [(10.0,)], "x DOUBLE")
    scaled = FE.RobustScaling.fit(df, ("x",)).transform(df)
    assert sorted(r.x for r in scaled.collect()) == [0.0] * 6 + [10.0]


def test_unknown_categories(spark):
    fit = spark.createDataFrame([("a", None, "x"), ("B ", "t", "y")],
                                "channel STRING, ticket_type STRING, status STRING")
    new = spark.createDataFrame([("zzz", "zzz", "Y")], fit.schema)
    row = FE.encode(new, FE.fit_encoders(fit)).first()
    assert (row.channel_enc, row.ticket_type_enc, row.status_enc) == (0, 1, 1)


def test_row_vectors_agree_with_the_weights_table(labelled):
    model = FE.FeatureModel.fit(labelled)
    vectors = FE.with_vector_entries(model.transform(labelled)).selectExpr(
        "ticket_id", "inline(entries)").filter(F.col("idx") < model.tfidf.size)
    table = model.tfidf.weights(labelled)

    def rounded(df):
        return sorted((r.ticket_id, r.idx, round(r.weight, 9)) for r in df.collect())

    assert rounded(vectors) == rounded(table)


def test_vectors_are_made_once_a_row(spark, sf_dir):
    """Their entries as rows: no filter on the array that would make texts' terms and the vector again."""
    from prioscope.queries import QUERIES

    plan = QUERIES["feature_vector_entries"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_vector_of_a_text_without_known_terms(spark, labelled):
    model = FE.FeatureModel.fit(labelled)
    odd = labelled.limit(1).withColumn("full_text", F.lit("qqqq"))
    assert model.transform(odd).first().features.size == model.size


def test_attributions_are_exact(spark):
    """Brute force over all features, present and absent."""
    coefs, means = [0.5, -2.0, 0.1, 3.0, -0.4, 0.0, 1.0], [0.2, 0.3, 0.9, -0.1, 0.5, 9.0, 0.01]
    rows = {"a": {}, "b": {1: 0.3, 3: 4.0}, "c": {i: 1.0 for i in range(7)}, "d": {2: 5.0}}
    df = spark.createDataFrame(
        [(k, [(i, x) for i, x in v.items()]) for k, v in rows.items()],
        f"ticket_id STRING, entries {FE.ENTRY_TYPE}")
    names = [f"f_{i}" for i in range(7)]
    got = {r.ticket_id: [(a.feature, a.shap_value) for a in r.shap_attributions]
           for r in A.with_attributions(df, names, coefs, means, 3).collect()}
    for key, present in rows.items():
        every = [(i, coefs[i] * (present.get(i, 0.0) - means[i])) for i in range(7)]
        best = sorted(every, key=lambda x: (-round(abs(x[1]), 12), x[0]))[:3]
        assert got[key] == [(f"f_{i}", pytest.approx(v, abs=6e-5)) for i, v in best]


@pytest.mark.parametrize("p,level", [
    (0.35, "LOW"), (0.350001, "MEDIUM"), (0.75, "HIGH"), (0.76, "VERY_HIGH"), (0.0, "LOW"),
    (float("nan"), "nan"), (None, "nan"),
])
def test_confidence_level(spark, p, level):
    df = spark.createDataFrame([(p,)], "p DOUBLE")
    assert df.selectExpr(f"{TH.confidence_level('p')} AS v").first().v == level


def test_grid_values_belong_to_their_own_step(spark):
    rows = [(1, i / 100) for i in range(0, 101)]
    sweep = TH.threshold_sweep(spark.createDataFrame(rows, SCORES)).collect()
    assert {round(r.threshold * 100): r.tp for r in sweep} == {i: 101 - i for i in range(20, 81)}


def test_first_maximum_wins_and_fallback(spark):
    best = TH.optimal_threshold(spark.createDataFrame([(1, 0.9), (0, 0.1)], SCORES)).first()
    assert (best.threshold, best.f1) == (0.2, 1.0)
    none = TH.optimal_threshold(spark.createDataFrame([(0, 0.9), (0, 0.1)], SCORES)).first()
    assert (none.threshold, none.f1) == (0.5, 0.0)


def test_slices_skip_nan_and_checks_divide_by_all_rows(spark):
    rows = [("high", i % 2, float("nan") if i == 0 else 0.5, None if i < 9 else 0.1, True) for i in range(20)]
    df = spark.createDataFrame(rows, "priority STRING, is_mismatch INT, mismatch_probability DOUBLE, "
                                     "severity_confidence DOUBLE, include_in_training BOOLEAN")
    assert M.adversarial_slices(df).first().mean_prob == 0.5
    checks = {r.check: r.value for r in M.sanity_checks(df).collect()}
    assert checks["low severity confidence"] == pytest.approx(11 / 20)


def test_embeddings_of_a_callers_model(spark):
    def make():
        import numpy as np

        return lambda texts: np.array([[len(t), 0.0, 4.0] for t in texts], dtype=np.float32)

    df = spark.createDataFrame([("abc",), (None,)], "full_text STRING")
    got = {r.full_text: r.embedding for r in FE.embed_texts(df, make).collect()}
    assert got["abc"] == pytest.approx([0.6, 0.0, 0.8]) and got[None] == pytest.approx([0.0, 0.0, 1.0])


def test_predictions_export(predictions, tmp_path, spark):
    path = str(tmp_path / "predictions")
    sinks.write_predictions(predictions, path)
    back = spark.read.parquet(path)
    assert back.count() == predictions.count() and "mismatch_probability" in back.columns


def test_linear_explainer_is_the_scoring_model(trained):
    own = [list(m.coefficients.toArray()) for m, _ in trained.pairs]
    mean = [sum(x) / len(own) for x in zip(*own)]
    assert trained.coefficients == pytest.approx(mean)


def test_metrics_without_positives(spark):
    row = M.classification_metrics(spark.createDataFrame([(0, 0.2), (0, 0.7)], SCORES)).first()
    assert (row.f1, row.precision, row.recall) == (0.0, 0.0, 0.0)
    assert (row.n_positive, row.n_negative, row.class_balance) == (0, 2, 0.0)


def test_small_training_set_is_refused(labelled):
    with pytest.raises(ValueError, match="Fewer than"):
        MO.check_training_size(labelled.limit(10))


def test_training(labelled, trained):
    n = labelled.filter("include_in_training").count()
    assert trained.oof.count() == n
    assert trained.oof.select("ticket_id").distinct().count() == n
    assert trained.folds.count() == 5
    assert 0.2 <= trained.threshold <= 0.8
    assert trained.oof.filter("mismatch_probability NOT BETWEEN 0 AND 1").count() == 0
    for _, calibration in trained.pairs:
        steps = list(calibration.predictions.toArray())
        assert steps == sorted(steps)


def test_threshold_zero_is_a_threshold(labelled, trained):
    assert trained.predict(labelled, 0.0).filter("mismatch_predicted = 0").count() == 0


def test_every_ticket_is_scored_and_attributed(labelled, trained, predictions):
    assert predictions.count() == labelled.count()
    full = trained.attribute(predictions)
    assert full.filter("size(shap_attributions) <> 5").count() == 0


def test_default_booster_stops_patiently(spark):
    """On a table that can be learned it keeps many trees, and they beat two."""
    import numpy as np
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 8))
    p = 1 / (1 + np.exp(-(x[:, 0] * x[:, 1] + np.sin(2 * x[:, 2]) + 0.5 * x[:, 3])))
    y = (rng.random(1500) < p).astype(int)
    rows = spark.createDataFrame(
        [(str(i), int(b), Vectors.dense(a.tolist()), i % 3) for i, (a, b) in enumerate(zip(x, y))],
        ["ticket_id", "is_mismatch", "features", "fold"]).coalesce(1).cache()
    train = MO.weighted(rows.filter("fold <> 0")).cache()
    held = MO.weighted(rows.filter("fold = 0")).cache()
    booster = BoosterConfig()
    model, rounds = MO.fit_patiently(train, held, booster, 42)
    assert rounds == model.getNumTrees > 20
    # Spark ML counts the losses of its own rounds alike: the last is the least
    losses = model.evaluateEachIteration(held)
    assert min(losses) == losses[-1]

    def area(m):
        scored = MO.score(m, held, "mismatch_probability")
        return M.auc(scored.withColumn("is_mismatch", F.col("label").cast("int"))).first().auc

    assert area(model) > area(MO.learner(booster, 42, 2).fit(train)) + 0.01


def _small_trees(spark, rows=400, rounds=4):
    import numpy as np
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(rows, 4)), 2)
    y = (x[:, 0] * x[:, 1] + 0.3 * x[:, 2] > 0).astype(float)
    df = spark.createDataFrame(
        [(str(i), float(b), 1.0, Vectors.dense(a.tolist()) if i % 2 else Vectors.sparse(4, list(enumerate(a.tolist()))))
         for i, (a, b) in enumerate(zip(x, y))], ["ticket_id", "label", "weight", "features"]).coalesce(1)
    booster = BoosterConfig(max_iter=rounds, max_depth=3, min_instances_per_node=5, step_size=0.3)
    return df, booster


def test_first_trees_are_a_model(spark):
    """A prefix has the trees, weights and scores that its own sums give."""
    df, booster = _small_trees(spark)
    model, rounds = MO.boost(df, df, booster, 1)
    assert rounds == 4 and model.treeWeights == [1.0, 0.3, 0.3, 0.3]
    first = MO.boosted_model(model.trees[:2], model.treeWeights[:2], 4)
    assert first.getNumTrees == 2
    sums = first.trees[1].setPredictionCol("b").transform(first.trees[0].setPredictionCol("a").transform(df))
    for r in first.transform(sums).limit(50).collect():
        assert r.rawPrediction[1] == pytest.approx(r.a + 0.3 * r.b)


def test_path_contributions_add_up_to_the_margin(spark):
    df, booster = _small_trees(spark)
    models = [MO.boost(df, df, booster, seed)[0] for seed in (1, 2)]
    paths = A.PathModel.of(models)
    scored = A.with_path_contributions(df, paths)
    for m, name in zip(models, "pq"):
        scored = m.setRawPredictionCol(name).setProbabilityCol(f"{name}1").setPredictionCol(f"{name}2").transform(scored)
    for r in scored.collect():
        margin = (r.p[1] + r.q[1]) / 2
        assert paths.base + sum(c.c for c in r.contributions) == pytest.approx(margin)
        size = [round(abs(c.c), 12) for c in r.contributions]
        assert size == sorted(size, reverse=True)


def test_path_contributions_by_hand(spark):
    """One tree: feature 2 at most 0.5, then on its left feature 0 at most 1."""
    import numpy as np
    from pyspark.ml.linalg import Vectors

    paths = A.PathModel(
        np.array([2, 0, -1, -1, -1]), np.array([0.5, 1.0, 0, 0, 0]), np.array([1, 3, 0, 0, 0]), np.array([2, 4, 0, 0, 0]),
        np.array([0.1, -0.2, 0.7, -0.5, 0.4]), np.array([0]), 2)
    df = spark.createDataFrame(
        [("a", Vectors.dense(1.0, 9.0, 0.5)), ("b", Vectors.dense(2.0, 9.0, 0.0)), ("c", Vectors.sparse(3, {2: 0.6})), ("d", Vectors.sparse(3, {}))],
        ["ticket_id", "features"])
    got = {r.ticket_id: [(c.idx, round(c.c, 9)) for c in r.contributions] for r in A.with_path_contributions(df, paths).collect()}
    assert got == {"a": [(0, -0.3), (2, -0.3)], "b": [(0, 0.6), (2, -0.3)], "c": [(2, 0.6)], "d": [(0, -0.3), (2, -0.3)]}
    names = ["tfidf:x", "y", "word_count"]
    top = {r.ticket_id: [(a.feature, a.shap_value) for a in r.shap_attributions] for r in A.with_path_attributions(df, names, paths, 1).collect()}
    assert top == {"a": [("tfidf:x", -0.3)], "b": [("tfidf:x", 0.6)], "c": [("word_count", 0.6)], "d": [("tfidf:x", -0.3)]}


def test_save_and_load(spark, labelled, trained, tmp_path):
    path = str(tmp_path / "model")
    trained.save(path)
    again = MO.MismatchModel.load(spark, path)
    assert again.threshold == trained.threshold
    assert again.oof.count() == trained.oof.count()

    def scores(model):
        return sorted((r.ticket_id, round(r.mismatch_probability, 9))
                      for r in model.predict(labelled).select(
                          "ticket_id", "mismatch_probability").collect())

    assert scores(again) == scores(trained)
    again.save(path)  # to the folder it was loaded from
    assert scores(MO.MismatchModel.load(spark, path)) == scores(trained)


def test_action_needs_a_probability_of_forty_percent(spark):
    rows = [(1, 0.39, "UNDER-PRIORITISED", "critical", "low"),
            (1, 0.40, "UNDER-PRIORITISED", "critical", "low"),
            (1, 0.90, "UNDER-PRIORITISED", "high", "low"),
            (1, 0.90, "OVER-PRIORITISED", "low", "high"),
            (1, 0.90, "ALIGNED", "low", "low"),
            (0, 0.90, "UNDER-PRIORITISED", "high", "low")]
    df = spark.createDataFrame(rows, "mismatch_predicted INT, mismatch_probability DOUBLE, "
                                     "mismatch_direction STRING, inferred_severity STRING, "
                                     "priority STRING")
    got = [(r.recommended_action, r.action_rationale) for r in EV.with_action(df).collect()]
    assert [a for a, _ in got] == [
        "OK", "ESCALATE IMMEDIATELY", "ESCALATE", "INVESTIGATE", "INVESTIGATE", "OK"]
    assert got[4][1].startswith("Priority gap detected")


def test_documents_round_trip(spark, predictions, trained, tmp_path):
    rows = stages.dossier(predictions, trained)
    assert len(rows.columns) == 17
    path = str(tmp_path / "documents")
    sinks.write_dossiers(rows, path)
    back = sinks.read_dossiers(spark, path)
    flagged = predictions.filter("mismatch_predicted = 1").count()
    assert back.count() == flagged == rows.count()
    for r in back.limit(5).collect():
        record = json.loads(r.json)
        assert record["ticket_id"] == r.ticket_id
        assert r.markdown.startswith("# Ticket Priority Dossier — Ticket " + r.ticket_id)
        for span in record["evidence_spans"]:
            assert span["span"] in r.markdown


def test_document_without_attributions(predictions):
    text = EV.with_markdown(stages.dossier(predictions)).first().markdown
    assert "Feature attributions not available" in text


def test_report(predictions, trained, tmp_path):
    report = stages.evaluate(predictions, trained)
    text = stages.report_text(report)
    for heading in stages.SECTION_TITLES.values():
        assert heading in text
    sinks.write_report(report, str(tmp_path / "report"))


def test_patience_ends_at_the_first_long_wait():
    assert MO.patient_round([5.0, 3.0, 4.0, 4.0, 1.0], 2) == (2, True)
    assert MO.patient_round([5.0, 3.0, 4.0], 2) == (2, False)
    assert MO.patient_round([float("inf")] * 4, 2) == (1, True)


@pytest.mark.parametrize("patience,fits", [(4, [20]), (1, [5])])
def test_rounds_of_boosting_share_one_fit(spark, monkeypatch, patience, fits):
    """Features are binned once for all rounds, and the model is that of the patient round."""
    df, _ = _small_trees(spark)
    booster = BoosterConfig(max_iter=20, max_depth=3, min_instances_per_node=5, step_size=0.9, patience=patience)
    asked, learner = [], MO.learner
    monkeypatch.setattr(MO, "learner", lambda b, seed, rounds=None: asked.append(rounds) or learner(b, seed, rounds))
    # labels of the held rows are turned over, so that more rounds bring more loss
    model, rounds = MO.boost(df, df.withColumn("label", 1 - F.col("label")), booster, 1)
    assert asked == fits and rounds == model.getNumTrees == 1


def test_terms_are_counted_without_a_row_a_word(spark):
    """The counts of each row's own terms, over odd texts, a few texts at a time and all at once."""
    texts = ["A b-cd cd ef, CD", None, "", "x", "Été éTÉ _a1 İ² ΣΑΣ", "cd ef cd ef", "日本   ée aa\tbb\naa bb"]
    df = spark.createDataFrame([(t,) for t in texts], "full_text STRING").coalesce(1)
    want = {}
    for row in df.selectExpr(f"{FE.T.terms('full_text')} AS g").collect():
        for term in row.g:
            want.setdefault(term, [0, 0])[0] += 1
        for term in set(row.g):
            want[term][1] += 1
    counts = FE.term_counts(df)
    assert {r.term: [r.tf, r.df] for r in counts.collect()} == want
    assert "Generate" not in counts._jdf.queryExecution().executedPlan().toString()
    import pandas as pd

    words = FE.T.spaced_words("full_text")
    batch = pd.DataFrame({"words": [r.w for r in df.selectExpr(f"{words} AS w").collect()]})
    parts = pd.concat(FE._task_counts(iter([batch, batch])))
    assert parts.groupby("term")["df"].sum().to_dict() == {t: 2 * d for t, (_, d) in want.items()}


def _grouped(spark, rows=900):
    """Rows of three groups: two features of few values, three that are mostly zero, and one that is constant."""
    import numpy as np
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(11)
    x = np.column_stack([
        rng.integers(-8, 9, (rows, 2)), rng.integers(1, 9, (rows, 3)) * (rng.random((rows, 3)) < 0.1), np.full(rows, 2)]).astype(float)
    y = (x[:, 0] * x[:, 1] + 6 * x[:, 2] - 4 * x[:, 3] + rng.normal(size=rows) * 9 > 0).astype(int)
    return spark.createDataFrame(
        [(str(i), int(b), i % 3, Vectors.dense(a.tolist()) if i % 2 else Vectors.sparse(6, [(j, v) for j, v in enumerate(a.tolist()) if v]))
         for i, (a, b) in enumerate(zip(x, y))], ["ticket_id", "is_mismatch", "fold", "features"]).coalesce(2).cache()


def test_sparse_boosting_grows_the_trees_of_spark_ml(spark, monkeypatch):
    """Without random draws, out-of-fold scores are those of Spark ML's own booster, whose dense rows are not made."""
    df = _grouped(spark)
    booster = BoosterConfig(max_iter=8, max_depth=3, min_instances_per_node=5, step_size=0.3, subsampling_rate=1.0,
                            feature_subset="all", patience=3)
    want = {}
    for fold in range(3):
        held = df.filter(f"fold = {fold}").withColumns({"label": F.col("is_mismatch").cast("double"), "weight": F.lit(1.0)})
        model, rounds = MO.boost(MO.weighted(df.filter(f"fold <> {fold}")), held, booster, 42)
        want |= {r.ticket_id: (rounds, r.p) for r in MO.score(model, held, "p").collect()}
    monkeypatch.setattr(MO, "learner", None)  # no fit of Spark ML's
    got = MO.out_of_fold(df, AuditConfig(booster=booster, cv_folds=3)).collect()
    assert len(got) == len(want) == 900
    for r in got:
        assert r.rounds == want[r.ticket_id][0]
        assert r.mismatch_probability == pytest.approx(want[r.ticket_id][1], abs=1e-9)


def test_margins_of_many_rounds_are_stored(spark, monkeypatch):
    """Scores do not depend on when margins are stored, on tasks, or on how many rows are taken at once."""
    from prioscope.operators import boosting as BO

    df = _grouped(spark)
    booster = BoosterConfig(max_depth=3, min_instances_per_node=5, step_size=0.3, patience=2)

    def scores(table):
        pairs = BO.fit_together(table, "is_mismatch", "fold", 3, booster, 1, MO.patient_round, rounds=5)
        assert [n for _, n in pairs] == [5, 5, 5]
        return [r.p for r in MO.score(pairs[1][0], df, "p").orderBy("ticket_id").collect()]

    once = scores(df)
    monkeypatch.setattr(BO, "STORED_ROUNDS", 2)
    monkeypatch.setattr(BO, "ROWS_A_TASK", 100)
    assert scores(df.repartition(5)) == pytest.approx(once, abs=1e-9)


def test_models_of_two_groupings_grow_together(spark):
    """Those of the second have the median of the others' rounds, and are the models of a fit with so many."""
    from statistics import median_high

    from prioscope.operators import boosting as BO

    df = _grouped(spark).withColumn("part", F.expr("CAST(ticket_id AS INT) div 7 % 2")).cache()
    booster = BoosterConfig(max_iter=12, max_depth=3, min_instances_per_node=5, step_size=0.5, patience=2)

    def fit(*group, **more):
        return BO.fit_together(df, "is_mismatch", *group, booster, 1, MO.patient_round, **more)

    both = fit("fold", 3, after=("part", 2, median_high))
    alone = fit("fold", 3)
    rounds = median_high([n for _, n in alone])
    assert [n for _, n in both] == [n for _, n in alone] + [rounds] * 2
    for (got, n), (want, _) in zip(both, alone + fit("part", 2, rounds=rounds), strict=True):
        assert got.getNumTrees == n
        for a, b in zip(got.trees, want.trees, strict=True):
            assert (a.depth, a.numNodes) == (b.depth, b.numNodes)
        pairs = zip(*[[r.p for r in MO.score(m, df, "p").orderBy("ticket_id").collect()] for m in (got, want)], strict=True)
        assert all(x == pytest.approx(y, abs=1e-9) for x, y in pairs)


def test_training_fits_its_models_once(spark, monkeypatch, labelled):
    """Folds for validation and for calibration are one fit, so a level of all their trees is one job."""
    fits, together = [], MO.fit_together
    monkeypatch.setattr(MO, "fit_together", lambda *a, **b: fits.append(a) or together(*a, **b))
    config = AuditConfig(booster=BoosterConfig(max_iter=2, max_depth=2, step_size=0.3, patience=1), cv_folds=3, calibration_folds=2)
    model = MO.train(labelled, config)
    assert len(fits) == 1 and len(model.pairs) == 2
    assert {m.getNumTrees for m, _ in model.pairs} <= {r.rounds for r in model.oof.select("rounds").distinct().collect()}


def test_only_rows_of_smaller_children_are_added_up(spark):
    import numpy as np

    from prioscope.operators import boosting as BO

    bins = BO.Bins([[0.5], [0.5]])  # a code each
    rows = [[0], [0, 1], [1], [], [], []]
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    block = BO.Block(np.arange(6), np.full((6, 1), 1, np.int32), np.array([1.0, 1, -1, 1, -1, -1]), ends,
                     np.array([c for r in rows for c in r], np.uint16), np.zeros((6, 1)))
    tree = BO.Tree()
    tree.split(0, 0, 0, 1.0, [6.0, 0.0, 6.0], [4.0, -2.0, 4.0])  # four rows without code 0, two with it
    level = BO.Level(spark.sparkContext.broadcast(bins), BoosterConfig(subsampling_rate=1.0, feature_subset="all", min_instances_per_node=1), 1, 0,
                     [BO.Model(0, 0, (1.0, 1.0))], {0: tree}, [], [BO.Pair(0, 0, (1, 2), 1)], [], np.array([0, 2]))
    [(_, part)] = level.add_up([block])
    assert part[1].tolist() == [[0.0, 2.0, 2.0]]  # rows of label 0, of label 1, and the sum of their targets
    assert part[2].tolist() == [[[0.0, 0.0], [2.0, 1.0], [2.0, 1.0]]]
    before = ("made", np.array([[3.0, 3.0, 0.0]]), np.array([[[0.0, 1.0], [2.0, 1.0], [2.0, 0.0]]]), None)
    [(_, made)] = level.grow([(0, before), (0, part)])
    assert made[1].tolist() == [[3.0, 1.0, -2.0], [0.0, 2.0, 2.0]]
    assert made[2].tolist() == [[[0.0, 1.0], [0.0, 0.0], [0.0, -1.0]], [[0.0, 0.0], [2.0, 1.0], [2.0, 1.0]]]
    feature, _, gain, _ = made[3][0]
    assert feature.tolist() == [1, -1] and gain[0] > 0  # node 1 is split by code 1; node 2 has rows of one label alone


def test_cuts_of_values():
    import numpy as np

    from prioscope.operators.boosting import MAX_BINS, n_asked, thresholds

    assert thresholds(np.array([1.0, 3.0, 3.0]), 5) == [0.5, 2.0]
    assert thresholds(np.array([2.0, 2.0]), 2) == []
    many = thresholds(np.arange(1.0, 3201.0), 3200)
    assert len(many) == MAX_BINS - 1 and many[0] == 100.5
    assert thresholds(np.arange(1.0, 41.0), 4000) == [0.5]  # few rows: present or not
    assert [n_asked(s, 10) for s in ("all", "0.8", "4", "sqrt")] == [10, 8, 4, 4]


def test_terms_are_counted_from_one_sort(monkeypatch):
    """The counts of a plain count, also where word pairs and texts are too many for one number."""
    import random
    from collections import Counter

    dealt = random.Random(3)
    texts = [[f"w{dealt.randint(0, 30)}" for _ in range(dealt.choice([0, 1, 2, 40]))] for _ in range(50)]
    tf, df = Counter(), Counter()
    for words in texts:
        terms = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        tf.update(terms)
        df.update(set(terms))

    def counts():
        found = FE._sums([w for words in texts for w in words], [len(words) for words in texts])
        return {r.term: (r.tf, r.df) for r in found.itertuples()}

    expected = {t: (n, df[t]) for t, n in tf.items()}
    with monkeypatch.context() as patch:
        patch.setattr(FE.np, "unique", None)  # before: several searches for the different keys
        assert counts() == expected
    with monkeypatch.context() as patch:
        patch.setattr(FE.np, "iinfo", lambda kind: type("Small", (), {"max": 50_000}))
        assert counts() == expected
    assert FE._sums([], [0]).empty
