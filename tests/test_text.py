"""Text expressions on literal values."""

import pytest

from prioscope.functions import text as T


def values(spark, rows, sql):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i INT, c STRING")
    return [r.v for r in df.selectExpr("i", f"{sql} AS v").orderBy("i").collect()]


def test_clean_text(spark):
    rows = ["a &amp;lt; b\r\n c", None, " \t ", "&lt;x&gt;  \x1c y", "  a  b "]
    assert values(spark, rows, T.clean_text("c")) == ["a < b c", "", "", "<x> y", "a b"]


def test_full_text_of_empty_parts_is_the_marker(spark):
    assert values(spark, [""], T.full_text("c", "c")) == ["[SEP]"]


def test_text_stats(spark):
    text = "ÉA b! see http://x.y/z? and www.q ok² ٣"
    df = spark.createDataFrame([(text,)], "c STRING").selectExpr(
        *[f"{sql} AS {n}" for n, sql in T.text_stats("c").items()])
    row = df.first()
    assert row.text_length == len(text)
    assert row.word_count == len(text.split())
    assert (row.exclamation_count, row.question_count) == (1, 1)
    assert row.caps_ratio == pytest.approx(2 / len(text))
    assert row.digit_count == 1
    assert row.url_count == 2


def test_text_stats_of_the_bare_marker(spark):
    row = spark.createDataFrame([("[SEP]",)], "c STRING").selectExpr(
        *[f"{sql} AS {n}" for n, sql in T.text_stats("c").items()]).first()
    assert (row.text_length, row.word_count) == (5, 1)
    assert row.caps_ratio == pytest.approx(3 / 5)


@pytest.mark.parametrize("raw,level", [
    ("1-URGENT", "critical"), ("2-HIGH", "high"), ("P3", "medium"), ("sev 4", None),
    ("severity-1", "critical"), ("Severity 5", "low"), ("4-NOT SPECIFIED", None), (None, None),
    ("highest", None), ("low / urgent", "critical"), ("sev3", "medium"), ("hi_there", None),
])
def test_priority(spark, raw, level):
    assert values(spark, [raw], T.normalise_priority("c")) == [level]


def test_durations(spark):
    rows = ["90", "2 hours 30 minutes", "soon", "0", "-120", "1.5 hr", "3 days", "45 sec",
            "1e2", "1_000", "inf", "nan", " 60 ", "0 min", None, ".5", "2 DAYS, 1 second"]
    got = values(spark, rows, T.duration_minutes("c"))
    want = [1.5, 150, None, 0.0, -2.0, 90, 4320, 0.75, 100 / 60, None, None, None, 1.0, None,
            None, 0.5 / 60, 2880 + 1 / 60]
    assert got == [w if w is None else pytest.approx(w) for w in want]


def test_plain_unit_can_be_hours(spark):
    assert values(spark, ["2", "2 hr"], T.duration_minutes("c", 3600)) == [120.0, 120.0]


def test_numbers(spark):
    rows = ["4", " 3.5 ", "n/r", "", None, "1d", "-2"]
    assert values(spark, rows, T.to_number("c")) == [4.0, 3.5, None, None, None, None, -2.0]


def test_terms_are_tokens_then_pairs(spark):
    got = values(spark, ["The cat, the_cat é2 x y zz", "a", None], T.terms("c"))
    assert got[0] == ["the", "cat", "the_cat", "é2", "zz",
                      "the cat", "cat the_cat", "the_cat é2", "é2 zz"]
    assert got[1:] == [[], []]


def test_case_folding_keeps_length(spark):
    rows = ["İstanbul ıſK ÀÉ ẞ straße"]
    folded = values(spark, rows, T.fold_case("c"))[0]
    assert len(folded) == len(rows[0])
    assert folded.startswith("istanbul isk")


def test_clean_text_knows_every_white_space(spark):
    """What one pattern for all white space gives, for every character by itself, between words and in runs."""
    every = "".join(chr(c) for c in range(1, 0x11000) if not 0xD800 <= c < 0xE000)
    rows = [every, " ".join(every), " \t x\u2003\u3000 y \u00a0", "a &amp;amp; b &amp;lt; c", "a  b", "\u1680", "é\n\n", None]
    old = "replace(replace(replace(coalesce(c, ''), '&amp;', '&'), '&lt;', '<'), '&gt;', '>')"
    old = f"trim(regexp_replace({old}, {T.sql_string(T.WHITESPACE + '+')}, ' '))"
    assert values(spark, rows, T.clean_text("c")) == values(spark, rows, old)
    assert "(?U)" not in T.clean_text("c")


def test_word_characters_are_letters_numbers_and_underscores(spark):
    every = "".join(chr(c) for c in range(1, 0x11000) if not 0xD800 <= c < 0xE000)
    for new, plain in ((T.WORD, r"[\p{L}\p{N}_]"), (T.NON_WORD, r"[^\p{L}\p{N}_]")):
        got, want = (values(spark, [every], f"regexp_replace(c, {T.sql_string(p)}, '')") for p in (new, plain))
        assert got == want
    assert values(spark, ["a_b  c.d-é1 ²x"], T.spaced_words("c")) == ["a_b  c d é1 ²x"]
