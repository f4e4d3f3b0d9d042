"""Hot keys are split, and small rules of the operators that the larger tests do not reach."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import splits_hot_keys
from prioscope.llm import line_dedup, packing, tables, topk_search, toxicity, url_filter


@pytest.mark.parametrize("large", [True, False])
def test_a_hub_is_split(spark, large):
    edges = spark.range(1, 40_000).selectExpr("id AS a", "IF(id % 2 = 0, 0, id - 1) AS b")
    if not large:
        edges = edges.selectExpr("IF(b = 0, 50000, a) AS a", "IF(b = 0, a, b) AS b")
    assert splits_hot_keys(spark, lambda: tables._star(tables.durable(edges), large))


def test_a_hot_group_is_ranked_in_pieces(spark):
    rows = spark.range(40_000).selectExpr("IF(id % 3 = 0, 'hot', CAST(id % 500 AS STRING)) AS g", "md5(CAST(id AS STRING)) AS x")
    assert splits_hot_keys(spark, lambda: tables.ranked_within(rows, "g", ["x"], "place", "n"))


def test_a_window_that_many_documents_share_is_split(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "concat('a\\nb\\nc\\n', id) AS text")
    assert splits_hot_keys(spark, lambda: line_dedup.repeated_lines(docs))


def test_empty_vectors_are_zero_rows(spark):
    rows = [(0, [1.0, -1.0]), (3, []), (4, [-1.0, 0.5]), (50, []), (100, None), (150, [float("nan")]), (200, [None])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in topk_search.search_all(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3, 0), (0, 2, 50, 0), (0, 3, 4, -98304), (50, 1, 0, 0), (50, 2, 3, 0), (50, 3, 4, 0)]


def test_a_repeated_query_id_asks_with_its_smallest_vector(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [-1.0])], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(0, [3.0]), (0, [-2.0]), (0, [5.0])], "vec_id long, embedding array<float>")
    got = topk_search.top_k(df, asked).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(2, 2 * 256 * 256), (1, -2 * 256 * 256)]


def test_parts_of_joined_words_are_found():
    known = toxicity.Words(toxicity.LexiconAutomaton([("idiot", False, 2.0), ("moron", True, 2.0)]), 100)
    for word in ("x-idiot", "idiot/x", "some…idiot—you", "http://a.example/idiot?q=1", "un-moronic"):
        assert known[word] is not None, word
    for word in ("x-idiom", "12-34", "a/b", "..."):
        assert known[word] is None, word


def test_a_forgetful_automaton_finds_the_same():
    terms = [("abcabca", False, 1.0), ("bcabca", True, 1.0), ("caabbcc", False, 1.0)]
    texts = [f"{a}{b}{c}bc{a}{c}" for a in "abc" for b in "abc" for c in "abc"]
    once = toxicity.LexiconAutomaton(terms)
    often = toxicity.Words(toxicity.LexiconAutomaton(terms), 5, most_states=3)
    assert [often[t] for t in texts] == [once.find(t) for t in texts]
    assert len(often.automaton.states) < len(once.states)


def test_forgotten_words_have_the_same_ids(spark):
    docs = spark.createDataFrame([(k, f"word{k} und noch {k} Wörter, más.") for k in range(300)], "doc_id long, text string").coalesce(1)
    a, b = (
        sorted(map(tuple, packing.packed(docs, c).collect()))
        for c in (packing.PackingConfig(), packing.PackingConfig(known_bytes=2000, remember=False))
    )
    assert a == b


def test_columns_of_any_name_are_kept(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string").withColumn("score", F.lit("x"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.without_toxic(docs, none).columns == docs.columns


def test_url_regression_is_a_plain_one(spark):
    """n-grams, their buckets, the accelerated steps and the probabilities, in plain Python."""
    import xxhash

    config = url_filter.UrlConfig(buckets=97, steps=6)
    urls = [f"http://{'abc'[k % 3]}{k % 7}.Example.{'com' if k % 2 else 'net'}/p/{k % 5}ä" for k in range(60)] + ["no url", "x://"]
    labels = [float(k % 2 or k % 11 == 0) for k in range(60)] + [1.0, 0.0]

    def buckets(url):
        rest = url.partition("://")[2] if "://" in url else ""
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, path = rest[:cut].lower(), rest[cut:]
        out = set()
        for kind, text in (("host", f"^{host}$"), ("path", f"^{path}$")):
            for n in config.grams:
                for i in range(len(text) - n + 1):
                    seed = xxhash.xxh64_intdigest(kind.encode(), 42)
                    h = xxhash.xxh64_intdigest(text[i : i + n].encode(), seed)
                    out.add((h - (1 << 64) if h >> 63 else h) % config.buckets)
        return sorted(out)

    x = np.zeros((len(urls), config.buckets))
    for row, url in zip(x, urls, strict=True):
        own = buckets(url)
        row[own] = 1 / np.sqrt(max(1, len(own)))
    y = np.array(labels)
    w = last = np.zeros(config.buckets)
    bias, momentum = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)), 1.0
    for _ in range(config.steps):
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = w + (momentum - 1) / after * (w - last)
        missed = y - 1 / (1 + np.exp(-(x @ ahead + bias)))
        last, w, momentum = w, ahead * (1 - config.rate * config.ridge) + config.rate * x.T @ missed / len(y), after
    expected = 1 / (1 + np.exp(-(x @ w + bias)))

    labelled = spark.createDataFrame(list(zip(urls, labels, strict=True)), "url string, label double")
    model = url_filter.fit(labelled, config)
    assert model.weights == pytest.approx(w.tolist(), abs=1e-9)
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.blocked_probability for r in url_filter.url_verdicts(pages, labelled, config).collect()}
    assert [got[k] for k in range(len(urls))] == pytest.approx(expected.tolist(), abs=1e-9)
