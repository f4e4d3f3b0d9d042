"""The distributed paths give what the small ones give, also with hot keys."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prioscope.functions import ordering as O
from prioscope.operators import features as FE
from prioscope.operators import folds as FO
from prioscope.operators import metrics as M


@pytest.fixture(scope="module")
def numbers(spark):
    """A third of the rows share one value; there are nulls and NaN."""
    rng = np.random.default_rng(1)
    a = [float(x) for x in rng.lognormal(0, 3, 3000)]
    rows = [(7.0 if i % 3 == 0 else a[i],
             None if i % 5 == 0 else float("nan") if i % 7 == 0 else float(i % 11),
             float(i)) for i in range(3000)]
    return spark.createDataFrame(rows, "a DOUBLE, b DOUBLE, c DOUBLE"), rows


def test_quantiles_by_narrowing(numbers):
    df, rows = numbers
    probs = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    found = O.exact_quantiles(df, {c: probs for c in "abc"})
    for k, c in enumerate("abc"):
        column = np.array([r[k] for r in rows if r[k] is not None and r[k] == r[k]])
        assert found[c] == pytest.approx(list(np.quantile(column, probs)))


@pytest.mark.parametrize("spread", ["infinite", "wide", "one value", "both ends"])
def test_quantiles_of_any_spread(spark, spread):
    """Six passes are enough, or the search raises."""
    rng = np.random.default_rng(5)
    values = {
        "infinite": [*rng.normal(size=3000), float("inf")],
        "wide": [10.0 ** e for e in rng.uniform(-300, 297, 3000)],
        "one value": [7.25 if i % 3 == 0 else x for i, x in enumerate(rng.normal(size=3000))],
        "both ends": [float("-inf")] * 1000 + list(rng.normal(size=1500)) + [float("inf")] * 400,
    }[spread]
    values = [float(v) for v in values]
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = O.exact_quantiles(spark.createDataFrame([(v,) for v in values], "a DOUBLE"), {"a": probs})["a"]
    ordered = sorted(values)
    for p, x in zip(probs, got):
        lo, hi = ordered[int(np.floor(p * (len(values) - 1)))], ordered[int(np.ceil(p * (len(values) - 1)))]
        assert x == lo if lo == hi else lo <= x <= hi


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "a DOUBLE")
    assert O.exact_quantiles(df, {"a": [0.5]}) == {"a": [None]}


def test_running_totals(spark):
    df = spark.range(5000).selectExpr(
        "pmod(hash(id), 3) AS g", "pmod(hash(id, 1), 1000) / 1000D AS score",
        "pmod(hash(id, 2), 5) AS n").groupBy("g", "score").agg(F.sum("n").alias("n"))
    key = ["g", "score", "n", "n_before"]
    rows = O.running_totals(df, "score", ["n"], ["g"]).select(key).collect()
    for g in {r.g for r in rows}:
        before = 0
        for r in sorted((r for r in rows if r.g == g), key=lambda r: r.score):
            assert r.n_before == before
            before += r.n


def test_auc_by_hand(spark):
    rng = np.random.default_rng(2)
    rows = [(int(y), 0.5 if i % 3 == 0 else round(float(p), 3))
            for i, (y, p) in enumerate(zip(rng.integers(0, 2, 900), rng.random(900)))]
    df = spark.createDataFrame(rows, "is_mismatch INT, mismatch_probability DOUBLE")
    pos = [p for y, p in rows if y]
    neg = [p for y, p in rows if not y]
    want = np.mean([[1.0 if p > n else 0.5 if p == n else 0.0 for n in neg] for p in pos])
    assert M.auc(df).first().auc == pytest.approx(want)


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.3), (1, 0.6)], "is_mismatch INT, mismatch_probability DOUBLE")
    assert M.auc(df).first().auc is None


def test_folds_with_a_hot_id(spark):
    df = spark.range(0, 3000, 1, 6).selectExpr(
        "IF(id % 3 = 0, 'hot', CAST(id AS STRING)) AS ticket_id", "id AS content",
        "CAST(id % 7 = 0 AS INT) AS is_mismatch")
    got = FO.stratified_folds(df.repartition(2))
    assert got.count() == 3000
    other = {r.content: r.fold for r in FO.stratified_folds(df.repartition(5)).collect()}
    assert {r.content: r.fold for r in got.collect()} == other
    for label in (0, 1):
        sizes = [r["count"] for r in
                 got.filter(F.col("is_mismatch") == label).groupBy("fold").count().collect()]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_folds_do_not_depend_on_the_layout(spark):
    df = spark.range(400).selectExpr("CAST(id AS STRING) AS ticket_id", "CAST(id % 3 = 0 AS INT) AS is_mismatch")
    a = {r.ticket_id: r.fold for r in FO.stratified_folds(df.repartition(3)).collect()}
    b = {r.ticket_id: r.fold for r in FO.stratified_folds(df.orderBy(F.desc("ticket_id"))).collect()}
    assert a == b


def test_encoders_by_a_shuffled_join(labelled, monkeypatch):
    encoders = FE.fit_encoders(labelled)
    columns = ["ticket_id", "channel_enc", "status_enc"]
    a = FE.encode(labelled, encoders).select(columns).collect()
    monkeypatch.setattr(O, "BROADCAST_ROWS", -1)
    b = FE.encode(labelled, encoders).select(columns).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_numbering_of_uneven_partitions(spark):
    df = spark.range(0, 1000, 1, 9).filter("id % 100 < 37 OR id > 900")
    rows = O.number_rows(df).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(len(rows)))
    assert [r.id for r in rows] == sorted(r.id for r in rows)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_severity_plan_is_row_local(spark, sf_dir):
    from prioscope import fixtures
    from prioscope.operators.labels import pseudo_labels
    from prioscope.operators.severity import infer_severity
    from prioscope.operators.signals import StructuralStats

    tickets = fixtures.tickets(spark, sf_dir)
    stats = StructuralStats.fit(tickets)
    plan = plan_of(pseudo_labels(infer_severity(tickets, stats, valence=fixtures.VALENCE)))
    before = plan_of(tickets)
    assert plan.count("Exchange") == before.count("Exchange")  # only the fixture's own join
    for word in ("Python", "Cartesian", "NestedLoop", "Window", "Sort "):
        assert word not in plan


def test_ingest_reads_only_needed_columns_and_pushes_filters(spark, sf_dir):
    from prioscope import fixtures

    plan = plan_of(fixtures.tickets(spark, sf_dir).select("priority"))
    documents = [line for line in plan.splitlines() if "documents.parquet" in line][0]
    assert "ReadSchema: struct<doc_id:bigint>" in documents
    assert "PushedFilters: [IsNotNull(doc_id)]" in documents


def test_scoring_does_not_move_rows(spark, labelled):
    model = FE.FeatureModel.fit(labelled)
    plan = plan_of(model.transform(labelled))
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_no_row_runs_through_python(spark, labelled):
    model = FE.FeatureModel.fit(labelled)
    plan = plan_of(FE.with_vector_entries(model.transform(labelled)))
    assert "Python" not in plan


def test_repeated_ids_are_weighed_row_by_row(spark, labelled):
    model = FE.TfidfModel.fit(labelled)
    one = labelled.select("full_text").limit(40)
    shared = one.selectExpr("'same' AS ticket_id", "full_text")
    assert model.with_entries(shared).count() == one.count()
    assert all(abs(sum(e.weight**2 for e in r.entries) - 1) < 1e-9 for r in model.with_entries(shared).collect() if r.entries)


def test_tables_of_a_block_are_deleted(spark, tmp_path, monkeypatch):
    import os

    from prioscope.functions import durable as D

    monkeypatch.setattr(D, "shared_dir", lambda spark: str(tmp_path))
    with D.scratch(keep_last=True):
        D.durable(spark.range(5))
        kept = D.durable(spark.range(7))
    assert kept.count() == 7
    tables = f"{tmp_path}/tables/{spark.sparkContext.applicationId}"
    assert len(os.listdir(tables)) == 1
    D.release(spark)
    assert not os.path.exists(tables)


def test_infer_leaves_its_result_alone(spark, sf_dir, tmp_path, monkeypatch):
    import os

    from prioscope import fixtures
    from prioscope.functions import durable as D
    from prioscope.plans import stages

    monkeypatch.setattr(D, "shared_dir", lambda spark: str(tmp_path))
    labelled = stages.infer(fixtures.raw_tickets(spark, sf_dir))
    assert labelled.count() > 0
    assert len(os.listdir(f"{tmp_path}/tables/{spark.sparkContext.applicationId}")) == 1


def test_hot_ticket_is_split(spark, monkeypatch):
    """Label probabilities: half of all tickets have one id."""
    from compare import splits_hot_keys
    from prioscope.config import LABEL_PROBABILITY_WEIGHTS
    from prioscope.operators import signals as SG

    monkeypatch.setattr(O, "BROADCAST_ROWS", 0)
    tickets = spark.range(40_000).selectExpr("IF(id % 2 = 0, 'hot', CAST(id AS STRING)) AS ticket_id", "md5(CAST(id AS STRING)) AS t")
    known = spark.range(500).selectExpr(
        "IF(id = 0, 'hot', CAST(id AS STRING)) AS ticket_id", *[f"0.25D AS {c}" for c in LABEL_PROBABILITY_WEIGHTS])
    assert splits_hot_keys(spark, lambda: SG.join_label_probabilities(tickets, known))


def test_valence_of_a_million_words(spark, monkeypatch):
    """The table stays on Spark, small or large; a text without its words has 0."""
    from compare import splits_hot_keys
    from prioscope.operators import signals as SG

    table = spark.range(1_000_000).selectExpr("concat('w', id) AS word", "CAST(id % 7 - 3 AS DOUBLE) AS valence")
    rows = [(str(i), f"w{i} w{i} the other w{i + 1}" if i % 5 else None) for i in range(2000)]
    df = spark.createDataFrame(rows, "ticket_id STRING, full_text STRING")
    expected = {}
    for i in range(2000):
        s = 2 * (i % 7 - 3) + (i + 1) % 7 - 3 if i % 5 else 0
        expected[str(i)] = pytest.approx(s / (s * s + 15) ** 0.5)
    assert {r.ticket_id: r.compound for r in SG.with_sentiment_compound(df, table).collect()} == expected
    hot = spark.range(3000).selectExpr("CAST(id AS STRING) AS ticket_id", "repeat('w1 ', 5) AS full_text")
    monkeypatch.setattr(O, "BROADCAST_ROWS", 0)
    few = table.limit(2000)
    assert SG.with_sentiment_compound(hot, few).filter("compound <> -10D / sqrt(115D)").count() == 0
    assert splits_hot_keys(spark, lambda: SG.joined_tokens(hot, few, "full_text")[1])


def test_folds_of_repeated_rows(spark):
    """Copies of one row are dealt like different rows; nothing of a row is lost, null ids neither."""
    rows = [(str(i % 50) if i % 7 else None, i % 3, f"t{i % 9}") for i in range(500)] + [("hot", 1, "same")] * 301
    df = spark.createDataFrame(rows, "ticket_id STRING, is_mismatch INT, text STRING")
    got = FO.stratified_folds(df).collect()
    assert sorted(map(repr, (tuple(r)[:3] for r in got))) == sorted(map(repr, rows))
    for label in range(3):
        sizes = [sum(r.is_mismatch == label and r.fold == f for r in got) for f in range(5)]
        assert max(sizes) - min(sizes) <= 1


def test_folds_sort_no_texts(spark, labelled):
    """Only keys and hashes are ordered: no stored table of the folds has a text."""
    keyed = FO.with_row_keys(labelled)
    table = FO.fold_table(keyed, "is_mismatch", {"fold": (5, 42)})
    assert set(table.columns) == {"_k", "_c", "n", "fold"}
    plan = plan_of(FO.with_folds(keyed, table, {"fold": (5, 42)}))
    assert "Sort [" not in plan and "Exchange rangepartitioning" not in plan


@pytest.mark.parametrize("one_task", [65_536, 0])
@pytest.mark.parametrize("kind", ["rising", "noise", "falling", "ties"])
def test_isotonic_in_ranges_is_spark_mls(spark, monkeypatch, one_task, kind):
    from pyspark.ml.regression import IsotonicRegression
    from prioscope.operators import isotonic as IS

    monkeypatch.setattr(IS, "ONE_TASK", one_task)
    rng = np.random.default_rng(4)
    x = np.round(rng.random(1500), 2 if kind == "ties" else 6)
    y = {"rising": rng.random(1500) < x, "noise": rng.random(1500), "falling": 1 - x, "ties": rng.random(1500) < x}[kind]
    df = spark.createDataFrame([(float(a), float(b), float(w)) for a, b, w in zip(x, y, rng.integers(1, 4, 1500))], "raw DOUBLE, rate DOUBLE, n DOUBLE").repartition(6)
    own = IS.fit_isotonic(df, "raw", "rate", "n")
    spark_ml = IsotonicRegression(featuresCol="raw", labelCol="rate", weightCol="n").fit(df)
    at = spark.range(1001).selectExpr("id / 1000D AS raw")
    a, b = ([r.prediction for r in m.transform(at).orderBy("raw").collect()] for m in (own, spark_ml))
    assert a == pytest.approx(b)


def test_isotonic_of_nothing(spark):
    from prioscope.operators import isotonic as IS

    df = spark.createDataFrame([(None, 1.0), (0.5, None)], "raw DOUBLE, rate DOUBLE")
    assert IS.isotonic_blocks(df, "raw", "rate").collect() == []
