"""Toxicity, quality, SimHash, line dedup and packing against plain versions of the same rule."""

import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from prioscope.llm import line_dedup, packing, quality, simhash_dedup, toxicity

LONG = "word and other words " * 20_000
ODD = [
    (1, "Plain text here.\nSecond line.\nThird line.\nFourth line."), (2, None), (3, ""), (4, "   \n\t\n"),
    (5, LONG), (None, "no id at all"), (6, "same"), (6, "same"), (6, "another text of one id"), (None, None),
]


def documents(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.withColumn("lang", F.lit("en")).withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long"))
    if extra:  # names that operators use themselves
        for name in ("score", "place", "key", "own_id", "gone", "fp", "label", "id", "extra", "at", "m_id", "window"):
            df = df.withColumn(name, F.lit("x"))
    return df


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


# ---- toxicity


def test_automaton_is_the_edit_distance():
    rng = random.Random(3)
    terms = [("abcab", False, 1.0), ("bca", False, 1.0), ("abcabcabc", False, 1.0), ("caab", True, 1.0), ("bbcabca", True, 1.0)]
    auto = toxicity.LexiconAutomaton(terms)
    for _ in range(3000):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 11)))
        whole = [levenshtein(t, word) for t, stem, _ in terms if not stem]
        allowed = [auto.edits(t, False) for t, stem, _ in terms if not stem]
        stems = any(
            any(levenshtein(t, word[:k]) <= auto.edits(t, True) for k in range(len(word) + 1))
            for t, stem, _ in terms if stem
        )
        expected = any(d <= a for d, a in zip(whole, allowed, strict=True)) or stems
        assert (auto.find(word) is not None) == expected, word


def test_quotation_is_told_from_abuse():
    words = 'he called them "idiot" in court'.split()
    assert toxicity.quoted(words, 3, 8)
    assert not toxicity.quoted("you are an idiot and worse".split(), 3, 8)
    assert toxicity.quoted('"you are an idiot" was the line'.split(), 3, 8)


def test_lookalikes_are_found():
    known = toxicity.Words(toxicity.LexiconAutomaton([("idiot", False, 2.0)]), 100)
    for word in ("idiot", "Idiot!".lower(), "id1ot", "idi0t", "idi-ot", "idoit"[:2] + "iot", "idiiot"):
        assert known[word] is not None, word
    assert known["ideology"] is None


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs, marks = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    found = toxicity.toxicity(docs, marks)
    assert found.count() == docs.count()
    judged = found.filter("held_out").join(marks, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in judged}
    assert n.get((0, 1), 0) <= 0.01 * (n[0, 0] + n.get((0, 1), 0))
    assert n[1, 1] >= 0.8 * (n[1, 1] + n.get((1, 0), 0))


@pytest.mark.parametrize("marks", [[], [(1, 1, 0), (5, 0, 0)], [(1, 1, 1), (5, 0, 1)], [(1, None, None), (None, 1, 1)]])
def test_scores_of_odd_rows(spark, marks):
    docs = documents(spark, ODD)
    for found in (toxicity.toxicity(docs, labels(spark, marks)), quality.quality(docs, labels(spark, marks))):
        rows = found.collect()
        assert len(rows) == len(ODD)
        assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
        assert {r.held_out for r in rows if r.doc_id is None} == {False}
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    empty = documents(spark, [])
    assert toxicity.toxicity(empty, labels(spark, marks)).count() == quality.quality(empty, labels(spark, marks)).count() == 0


def test_without_labels_nothing_is_rejected(spark):
    docs = documents(spark, ODD)
    kept = toxicity.without_toxic(docs, labels(spark, []))
    assert kept.columns == docs.columns and kept.count() == len(ODD)


# ---- quality


def test_linear_time_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    config = quality.QualityConfig(buckets=50, factors=3, metadata=())
    size = 50 + quality.STATISTICS
    model = quality.FactorisationMachine(
        0.3, rng.normal(size=size), rng.normal(size=(size, 3)), np.zeros(quality.STATISTICS), np.ones(quality.STATISTICS) / 2, config=config
    )
    ids = np.array([3, 7, 20, *range(50, size)])
    x = rng.uniform(-1, 1, len(ids))
    z = 0.3 + model.weights[ids] @ x
    for i in range(len(ids)):
        for j in range(i):
            z += model.factors[ids[i]] @ model.factors[ids[j]] * x[i] * x[j]
    assert model.score(ids, x) == pytest.approx(1 / (1 + np.exp(-z)))


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs, marks = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    judged = quality.quality(docs, marks).filter("held_out").join(marks, "doc_id").groupBy("quality", "predicted").count().collect()
    n = {(r.quality, r.predicted): r["count"] for r in judged}
    assert n[1, 1] >= 0.98 * (n[1, 1] + n.get((1, 0), 0))
    assert n[0, 0] >= 0.85 * (n[0, 0] + n.get((0, 1), 0))


# ---- SimHash


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def test_fingerprints(spark):
    texts = [None, "", " \t\n", "One", "one TWO", "ÄB c\xa0d É f", "a b c", "a b c a b c a b c", "x\x1cy z w", *["w%d " % i * 3 + "end here" for i in range(30)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in simhash_dedup.simhash_classes(docs).collect():
        assert int(r.fingerprint, 16) == plain_fingerprint(texts[r.doc_id]) and len(r.fingerprint) == 16


@pytest.mark.parametrize(("shard", "spread"), [(16, 64), (40, 7), (10_000, 7)])
def test_vantage_point_links_are_all_links(spark, shard, spread):
    """Random fingerprints, chains of one and two bits, and a dense cluster; many shards and one."""
    rng = np.random.default_rng(shard)
    points = set()
    for centre in rng.integers(0, 1 << 63, 60, dtype=np.uint64):
        value = int(centre)
        for _ in range(12):
            points.add(value)
            for bit in rng.integers(0, spread, rng.integers(1, 5)):
                value ^= 1 << int(bit)
    points = sorted(points)
    expected = plain_components(points)
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    config = simhash_dedup.SimHashConfig(shard=shard, leaf=8, piece=60, share=0.0)
    edges = simhash_dedup.links(df, config)
    label = list(range(len(points)))
    at = {s: k for k, s in enumerate(signed)}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for e in edges.collect():
        a, b = find(at[e.a]), find(at[e.b])
        label[max(a, b)] = min(a, b)
    assert [find(k) for k in range(len(points))] == expected


def test_a_billion_fingerprints_are_copied_few_times():
    """The plan for 10^9 of them, tried on a part: copies of each sent, and the largest task."""
    rng = np.random.default_rng(1)
    config, n = simhash_dedup.SimHashConfig(), 10**9
    sample = rng.integers(0, 1 << 64, 32 << 10, dtype=np.uint64)
    tree = simhash_dedup.grow(sample, 10)
    pieces = simhash_dedup.pieces_of(sample, tree, n, config)
    some = rng.integers(-(1 << 63), 1 << 63, 131_072, dtype=np.int64)
    sent = simhash_dedup.dealt(some, tree, pieces, config.radius)
    assert sent["asks"].sum() >= len(some) and len(sent["fp"]) <= 25 * len(some)
    assert (sent["home"] & sent["asks"]).sum() == len(some)
    _, sizes = np.unique(sent["shard"] * 10_000 + sent["piece"], return_counts=True)
    assert sizes.max() < 0.011 * len(some)


def test_simhash_classes_of_odd_rows(spark):
    docs = documents(spark, ODD)
    rows = simhash_dedup.simhash_classes(docs).collect()
    assert len(rows) == len(ODD)
    zero = [r for r in rows if r.fingerprint == "0" * 16]
    assert len(zero) == 4 and {r.component_id for r in zero} == {2}
    kept = simhash_dedup.one_of_each(docs)
    assert kept.columns == docs.columns
    expected = [(1, ODD[0][1]), (2, None), (5, LONG), (-1, "no id at all"), (6, "same"), (6, "another text of one id")]
    assert sorted(((r.doc_id or -1, r.text) for r in kept.collect()), key=str) == sorted(expected, key=str)
    assert simhash_dedup.simhash_classes(documents(spark, [])).count() == 0


# ---- line dedup


def plain_line_dedup(rows):
    first, marks = {}, {}
    order = sorted(range(len(rows)), key=lambda k: rows[k][0])
    for k in order:
        lines = [x for x in rows[k][1].split("\n") if x.strip(" \t\r\f\x0b")]
        for i in range(len(lines) - 2):
            if first.setdefault(tuple(lines[i : i + 3]), (k, i)) != (k, i):
                marks.setdefault(k, set()).update((i, i + 1, i + 2))
    out = {}
    for k, (doc, text) in enumerate(rows):
        at, kept = -1, []
        for line in text.split("\n"):
            at += (filled := bool(line.strip(" \t\r\f\x0b")))
            if not (filled and at in marks.get(k, ())):
                kept.append(line)
        out[doc] = ("\n".join(kept), len(marks.get(k, ())))
    return out


def test_line_dedup_is_the_plain_rule(spark):
    rng = random.Random(8)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", "d", "", " ", "e f"]) for _ in range(rng.randint(0, 12)))) for i in range(200)]
    expected = plain_line_dedup(rows)
    found = {r.doc_id: (r.text, r.removed_lines) for r in line_dedup.line_dedup(documents(spark, rows)).repartition(3).collect()}
    assert found == expected
    assert any(n for _, n in expected.values())


def test_line_dedup_of_odd_rows(spark):
    docs = documents(spark, [*ODD, (7, ODD[0][1] + "\nFifth."), (8, "a\nb"), (9, "a\nb"), (None, "p\nq\nr"), (10, "p\nq\nr")])
    found = line_dedup.without_repeated_lines(docs)
    assert found.columns == docs.columns
    text = {r.doc_id: r.text for r in found.collect()}
    assert found.count() == docs.count()
    assert text[7] == "Fifth." and text[2] is None and text[3] == "" and text[5] == LONG
    assert text[8] == text[9] == "a\nb"  # under three lines
    assert text[10] == ""  # a null id comes first
    assert line_dedup.line_dedup(documents(spark, [])).count() == 0


@pytest.mark.parametrize("end", [".", "!", '."', "\u3002"])
def test_passages_inside_long_lines_are_cut(spark, end):
    rng = random.Random(3)
    gap = "" if end == "\u3002" else " "
    sentence = lambda: " ".join(f"v{rng.randrange(10**6)}" for _ in range(11)) + end
    passage = gap.join(sentence() for _ in range(5))  # 55 words
    a, b, c, d, e = (sentence() for _ in range(5))
    rows = [
        (1, gap.join([a, passage, b])),  # one line
        (2, f"first\n\n{gap.join([c, passage, d])}\nlast"),  # part of a longer line
        (3, passage), (4, passage.replace(end + gap, end + "\n")),  # under three lines, and in lines of its own
        (5, gap.join([e, passage])), (6, e),
    ]
    found = line_dedup.without_repeated_lines(documents(spark, rows), "n", sentences=True)
    text = {r.doc_id: r.text for r in found.collect()}
    assert text == {1: rows[0][1], 2: f"first\n\n{gap.join([c, d])}\nlast", 3: "", 4: "", 5: e, 6: e}


def test_sentence_dedup_takes_all_that_lines_take(spark):
    rng = random.Random(9)
    rows = [(i, "\n".join(rng.choice(["a. ", "b", "c. d.", "d", "", " ", "e f? g", "\u3002x\u3002"]) for _ in range(rng.randint(0, 12)))) for i in range(200)]
    docs = documents(spark, rows)
    plain = [(i, re.sub(line_dedup.SENTENCE, "\n", t)) for i, t in rows]
    expected = plain_line_dedup(plain)
    found = {r.doc_id: (r.text, r.n) for r in line_dedup.without_repeated_lines(docs, "n", sentences=True).collect()}
    assert {k: n for k, (_, n) in found.items()} == {k: n for k, (_, n) in expected.items()}
    for k, (text, _) in found.items():
        assert re.sub(r"\s", "", text) == re.sub(r"\s", "", expected[k][0])


# ---- packing


def checked(rows, docs, window=4096):
    """Every id in exactly one piece, offsets without gaps; returns the share of padding."""
    from tokenizers import Tokenizer
    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(docs)
    for doc, text in docs.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for p in sorted(by_doc[doc], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    padding = total = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        total += at
        padding += window - at if at & (at - 1) else 0
    return padding / max(1, total)


ODD_TEXTS = [
    None, "", "Mixed CASE words, and marks... (so) it's «fine», é, ß. İstanbul ΑΣ ǰ J̌ Ḱo", "a\x1cb\x85c\xa0d e",
    "<|endoftext|> <|ENDOFTEXT|>, x<|startoftext|>y.", "12,345. 6,7 8. _,_ .,,. ,", LONG, "한국어 日本語, 中文。 русский, ελληνικά.", "🙂🙂, 👩‍👩‍👧.", "don't, won't. 'll, 's.",
    "ÀÉÎ, ªº µ ß. ÿŸ Ÿ, ÷× naïve STRASSE Straße, Œuvre ĲÍ", "aª1 b²c ½ x_y Z.",
]


def test_packing_of_odd_texts(spark):
    docs = dict(enumerate(ODD_TEXTS))
    frame = documents(spark, list(docs.items())).repartition(3, "doc_id")
    assert checked(packing.packed(frame).collect(), docs) == 0
    assert packing.packed(documents(spark, [])).count() == 0


def test_packing_of_given_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4, "doc_id")
    assert checked(packing.packed(frame).collect(), docs) == 0


def test_rows_of_one_id_and_null_ids_are_packed(spark):
    rows = packing.packed(documents(spark, ODD)).collect()
    assert sum(r.start == 0 for r in rows) == len(ODD)
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


def test_sum_of_squares_picks_the_least(spark):
    rng = np.random.default_rng(4)
    done = []
    packer = packing.Packer(64, 10_000, lambda pieces: done.append(sum(len(p[2]) // 4 for p in pieces)))
    for k in range(400):
        size = int(rng.integers(1, 64))
        before = packer.counts.copy()

        def squares(level, size=size, before=before):
            c = before.copy()
            c[level] -= level > 0
            c[level + size] += level + size < 64
            return int((c[1:64] ** 2).sum())

        options = [0, *(g for g in range(1, 65 - size) if before[g])]
        level = packer.best_level(size)
        assert squares(level) == min(map(squares, options))
        packer.place((k, 0, b"\0" * 4 * size, size))
    packer.end()
    assert all(n == 64 or n & (n - 1) == 0 for n in done) and sum(n != 64 for n in done) <= 6
