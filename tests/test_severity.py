"""Lexicon, signals, ensemble and pseudo-labels on literal values."""

import pytest

from prioscope.config import AuditConfig
from prioscope.functions import text as T
from prioscope.operators import labels as LA
from prioscope.operators import lexicon as LX
from prioscope.operators import severity as SV
from prioscope.operators import signals as SG


def hits(spark, text):
    df = LX.with_lexicon_hits(spark.createDataFrame([(text,)], "full_text STRING"))
    row = df.selectExpr("lexicon_hits", f"{LX.lexicon_score('lexicon_hits')} AS score").first()
    return row.lexicon_hits, row.score


@pytest.mark.parametrize("text,score", [
    ("System down", 1.0),
    ("not working", 2 / 3),
    ("major issue", 0.5),
    ("only typo", 0.0),
    ("nothing here", 0.0),
    ("", 0.0),
])
def test_score(spark, text, score):
    assert hits(spark, text)[1] == pytest.approx(score, abs=1e-6)


def test_a_phrase_that_starts_with_a_negation_is_in_its_own_zone(spark):
    found, _ = hits(spark, "cannot access the portal")
    assert [(h.phrase, h.weight) for h in found] == [("cannot access", 0.5)]


def test_zone_is_one_before_and_three_after(spark):
    text = "broken broken not broken broken broken broken"
    found, _ = hits(spark, text)
    assert [(h.word_pos, h.weight) for h in found if h.phrase == "broken"] == [
        (0, 1.0), (1, 0.5), (3, 0.5), (4, 0.5), (5, 0.5), (6, 1.0)]


def test_positions_inside_tokens(spark):
    found, _ = hits(spark, "é (broken) issue-free ASAP")
    assert [(h.phrase, h.char_pos, h.word_pos, h.matched) for h in found] == [
        ("asap", 22, 3, "ASAP"), ("broken", 3, 2, "broken"), ("issue", 11, 2, "issue")]


@pytest.mark.parametrize("text,phrases", [
    ("aſap", ["asap"]),  # long s equals s when case is ignored
    ("crıtİcal error", ["critical error", "error"]),
    ("broken² brokené _broken", []),  # numbers, letters and underscore are word characters
    ("brokeń", ["broken"]),  # a combining mark is not
    ("issue;issue issues", ["issue", "issue"]),
])
def test_word_boundaries_are_unicode(spark, text, phrases):
    assert [h.phrase for h in hits(spark, text)[0]] == phrases


def test_matched_text_is_at_its_position(spark, labelled):
    bad = labelled.selectExpr("full_text", "inline(lexicon_hits)").filter(
        "substring(full_text, char_pos + 1, length(phrase)) <> matched "
        "OR lower(matched) <> phrase")
    assert bad.count() == 0


def test_a_long_text_with_very_many_hits(spark):
    found, score = hits(spark, " ".join(["issue ok"] * 4000))
    assert len(found) == 4000
    assert found[-1].char_pos == 9 * 3999 and found[-1].word_pos == 2 * 3999
    assert score == pytest.approx(1 / 3, abs=1e-6)


def test_matched_text_of_many_hits_keeps_its_case(spark):
    found, _ = hits(spark, " ".join(["é ISSUE", "not İſſUE", "iſsue"] * 100))
    assert len(found) == 300
    assert [h.matched for h in found[:3]] == ["ISSUE", "İſſUE", "iſsue"]
    assert [h.weight for h in found[:4]] == [0.5, 0.5, 0.5, 0.5]
    assert [h.word_pos for h in found[-3:]] == [496, 498, 499]


def test_own_lexicon(spark):
    df = spark.createDataFrame([("It's a c++ 'mess' \\ it's",)], "full_text STRING")
    found = LX.with_lexicon_hits(df, lexicon=[("high", 2, ["it's", "mess"])]).first().lexicon_hits
    assert [(h.phrase, h.matched, h.char_pos) for h in found] == [
        ("it's", "It's", 0), ("it's", "it's", 20), ("mess", "mess", 12)]
    with pytest.raises(ValueError, match="word character"):
        LX.with_lexicon_hits(df, lexicon=[("high", 2, ["c++"])])


def evaluate(spark, sql, **columns):
    df = spark.createDataFrame([tuple(columns.values())], list(columns))
    return df.selectExpr(f"{sql} AS v").first().v


@pytest.mark.parametrize("score,label", [
    (0.0, "low"), (0.2999, "low"), (0.30, "medium"), (0.55, "high"), (0.78, "critical"),
    (1.0, "critical"), (float("nan"), "critical"),
])
def test_bands(spark, score, label):
    assert evaluate(spark, SV.severity_label("s"), s=score) == label


def test_agreement(spark):
    assert evaluate(spark, SV.agreement(["a", "b", "c"]), a=0.2, b=0.4, c=0.6) == pytest.approx(
        0.673401, abs=1e-6)


def test_offline_weights(spark):
    score = evaluate(spark, SV.severity_score(AuditConfig(), use_model=False),
                     urgency_lexicon_score=1.0, nli_severity_score=0.5, structural_score=0.5,
                     sentiment_score=0.5)
    assert score == pytest.approx(0.85)


def test_model_weights(spark):
    score = evaluate(spark, SV.severity_score(AuditConfig(), use_model=True),
                     urgency_lexicon_score=1.0, nli_severity_score=0.0, structural_score=0.5,
                     sentiment_score=0.5)
    assert score == pytest.approx(0.35 + 0.10 + 0.05)


STRUCTURE = "csat_numeric DOUBLE, resolution_time_minutes DOUBLE, first_response_minutes DOUBLE"


def test_structural_signal_needs_more_than_ten_values(spark):
    df = spark.createDataFrame([(1.0, None, None)] * 10, STRUCTURE)
    stats = SG.StructuralStats.fit(df)
    assert df.selectExpr(f"{SG.structural_score(stats)} AS v").first().v == 0.5


def test_structural_signal_of_one_csat_value_is_neutral(spark):
    df = spark.createDataFrame([(3.0, None, None)] * 11, STRUCTURE)
    stats = SG.StructuralStats.fit(df)
    assert df.selectExpr(f"{SG.structural_score(stats)} AS v").first().v == 0.5


def test_durations_without_a_logarithm_do_not_spread(spark):
    rows = [(None, float(i), None) for i in range(12)] + [(None, -1.0, None), (None, -50.0, None)]
    df = spark.createDataFrame(rows, STRUCTURE)
    stats = SG.StructuralStats.fit(df)
    got = [r.v for r in df.selectExpr(f"{SG.structural_score(stats)} AS v").collect()]
    assert stats.resolution_n == 12 and min(got) == 0.0
    assert max(got) == pytest.approx(1.0, abs=1e-6) and got[-1] == 0.0


def test_without_valences_sentiment_is_neutral(spark, sf_dir):
    from prioscope import fixtures

    rows = SV.infer_severity(fixtures.tickets(spark, sf_dir)).select("sentiment_score").distinct()
    assert [r.sentiment_score for r in rows.collect()] == [0.5]


def test_repeated_probability_rows_do_not_multiply_tickets(spark):
    tickets = spark.createDataFrame([("1",), ("1",), ("2",)], "ticket_id STRING")
    probabilities = spark.createDataFrame(
        [("1", 1.0, 0.0, 0.0, 0.0), ("1", 0.0, 0.0, 0.0, 1.0)],
        "ticket_id STRING, p_critical DOUBLE, p_high DOUBLE, p_medium DOUBLE, p_low DOUBLE")
    got = SG.join_label_probabilities(tickets, probabilities).selectExpr(
        "ticket_id", f"{SG.label_probability_blend()} AS v").collect()
    assert sorted((r.ticket_id, r.v) for r in got) == [("1", 0.5), ("1", 0.5), ("2", 0.5)]


def test_model_hook_runs_in_batches(spark):
    def make_predict():
        import numpy as np

        def predict(texts):
            flags = np.array([1.0 if "down" in t else 0.0 for t in texts])
            zero = np.zeros_like(flags)
            return np.stack([flags, zero, zero, 1 - flags], axis=1)

        return predict

    df = spark.createDataFrame([("system down",), ("typo",)], "full_text STRING")
    got = SG.score_label_probabilities(df, make_predict).selectExpr(
        "full_text", f"{SG.label_probability_blend()} AS v").collect()
    assert {r.full_text: r.v for r in got} == {"system down": 1.0, "typo": 0.0}


def test_label_confidence_and_tier(spark):
    value = evaluate(spark, LA.label_confidence("g", "c", "s"), g=2, c=0.5, s=0.32)
    assert value == pytest.approx(0.70)
    assert evaluate(spark, LA.quality_tier("c"), c=value) == "MEDIUM"


def test_labels_need_severity(spark):
    with pytest.raises(ValueError, match="severity_confidence"):
        LA.pseudo_labels(spark.createDataFrame([(1,)], "priority_rank INT"))


def test_min_confidence_is_a_real_parameter(spark, labelled):
    columns = list(LA.NEEDED)
    strict = LA.pseudo_labels(labelled.select(*columns), AuditConfig(min_confidence=0.9))
    assert strict.filter("include_in_training AND pseudo_label_confidence < 0.9").count() == 0
    assert strict.filter("include_in_training").count() < labelled.filter(
        "include_in_training").count()


def test_ranges(labelled):
    bad = labelled.filter(
        "priority_gap NOT BETWEEN -3 AND 3 OR inferred_severity_score NOT BETWEEN 0 AND 1 "
        "OR severity_confidence NOT BETWEEN 0 AND 1 OR pseudo_label_confidence NOT BETWEEN 0 AND 1")
    assert bad.count() == 0


def test_severity_from_a_valence_table(spark, sf_dir):
    """A table of words gives what the dictionary gives."""
    from prioscope import fixtures
    from prioscope.operators.severity import infer_severity

    tickets = fixtures.tickets(spark, sf_dir).limit(60)
    table = spark.createDataFrame(list(fixtures.VALENCE.items()), "word STRING, valence DOUBLE")

    def scores(valence):
        found = infer_severity(tickets, valence=valence)
        assert "_compound" not in found.columns
        return {r.ticket_id: pytest.approx((r.sentiment_score, r.inferred_severity_score))
                for r in found.select("ticket_id", "sentiment_score", "inferred_severity_score").collect()}

    first = scores(fixtures.VALENCE)
    second = infer_severity(tickets, valence=table).select("ticket_id", "sentiment_score", "inferred_severity_score")
    assert {r.ticket_id: (r.sentiment_score, r.inferred_severity_score) for r in second.collect()} == first


def test_only_words_with_a_valence_are_taken_out_of_a_text(spark):
    """The sums that all tokens of odd texts give, and no array of all tokens on the way."""
    texts = ["Issue issues re-issue; slow_issue SLOW, slow", None, "", "éslow slowé sloẃ slow", "error" * 3 + " error.error"]
    valence = {"slow": -0.4, "issue": -0.5, "issues": 2.0, "error": -1.4, "x": 9.0, "Great": 3.0, "two words": 4.0}
    df = spark.createDataFrame([(t,) for t in texts], "full_text STRING")
    sql = SG.sentiment_compound("full_text", valence)
    assert "{2,}" not in sql
    for r in df.selectExpr(f"{T.tokens('full_text')} AS w", f"{sql} AS c").collect():
        s = sum(valence.get(w, 0.0) for w in r.w)
        assert r.c == pytest.approx(s / (s * s + 15) ** 0.5)


@pytest.mark.parametrize("n", [1, LX.FEW, LX.FEW + 1, 40])
def test_few_and_many_matches_are_verbatim(spark, n):
    text = "İΣ not " + " ".join(["SyStem Down", "system down.", "ſystem DOWN"][i % 3] for i in range(n))
    df = LX.with_lexicon_hits(spark.createDataFrame([(text,)], "full_text STRING"))
    hits = [h for h in df.first().lexicon_hits if h.phrase == "system down"]
    assert len(hits) == n
    assert all(h.matched == text[h.char_pos : h.char_pos + len("system down")] for h in hits)


def test_hits_near_a_negation_are_found_from_the_tokens_around_them(spark):
    """Few hits of a text are weighed as its whole zone of negations says."""
    import random

    dealt = random.Random(5)
    parts = ["broken", "not", "x", "(broken)", "re-issue", "can't", "no-asap", "Σİ", "NOT", "é", "issue,never", "know", "asap"]
    texts = [" ".join(dealt.choices(parts, k=dealt.randint(1, 9))) for _ in range(300)] + ["x-no-asap", "no-asap", "asap"]
    df = LX.with_lexicon_hits(spark.createDataFrame([(t,) for t in texts], "full_text STRING"))
    zone = LX.negation_zone("full_text")
    seen = [r for r in df.selectExpr("full_text", "size(lexicon_hits) AS n", f"{zone} AS zone", "inline(lexicon_hits)").collect() if r.n <= LX.FEW]
    assert {r.weight for r in seen} == {0.5, 1.0} and len(seen) > 300
    assert [r for r in seen if (r.word_pos in r.zone) != (r.weight == 0.5)] == []


def test_valences_are_summed_over_the_words_of_the_phrases(spark):
    """A text is folded and cut into words once; letters that folding changes give what the text itself gives."""
    valence = {"slow": -0.4, "issue": -0.5, "thank": 1.5}
    texts = ["Slow, slow issue_ ISSUE. Thank", "", "ſlow ıssue İssue slow", "\u212a thanK issue", "éslow slowé slow", None]
    df = spark.createDataFrame([(t, None, None, None) for t in texts], "full_text STRING, " + STRUCTURE)
    cut = df.selectExpr("full_text", f"{T.words(T.fold_case('full_text'))} AS w")
    both = cut.selectExpr(f"{SG.sentiment_compound('full_text', valence)} AS a",
                          f"{SG.sentiment_compound_of_words('full_text', 'w', valence)} AS b").collect()
    assert [r.a for r in both] == [r.b for r in both] and len({r.a for r in both}) > 3
    signals = SV.with_signals(df, SG.StructuralStats(0, *[None] * 3, 0, None, None, 0, None, None), valence=valence)
    assert not {"_words", "_folded"} & set(signals.columns)
    plan = signals._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(coalesce(_folded") == 1  # before: for the phrases alone, and a search for the valences
