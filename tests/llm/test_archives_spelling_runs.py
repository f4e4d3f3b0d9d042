"""Archive conversion, spelling variants and periodic runs against plain versions of the same rules."""

import gzip
import hashlib
import random
import re
import zlib
from base64 import b32encode
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from prioscope.functions.durable import new_folder
from prioscope.llm import arc_to_warc as A
from prioscope.llm import periodic_runs as P
from prioscope.llm import spelling_variants as V

ODD = [
    (1, "plain text of some words"), (2, None), (3, ""), (4, "   \n\t\n"), (5, "la " * 50_000), (None, "no id at all"),
    (6, "same same"), (6, "same same"), (6, "another text of one id"), (None, None), (7, "x" * 200_000),
]


def documents(spark, rows, *clashing):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("lang", "source", "word", "n", "key", "part", "h", "a", "p", *clashing):
        df = df.withColumn(name, F.lit("x"))
    return df


# ---- periodic runs


def plain_runs(words, least=12):
    out = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - q:
            start = i
            while i < len(words) - q and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if i > start and length >= max(least, 2 * q):
                out.setdefault((start, length), q)
            i += 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def planted(doc, words):
    """The rule of the digests on plain lists."""
    h, n = zlib.crc32(str(doc).encode()), len(words)
    g = h // 10
    if doc is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def row_of(doc, text):
    words = planted(doc, re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode()))
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (
        doc, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


def test_runs_of_random_words():
    rng = random.Random(1)
    for _ in range(1500):
        k, n = rng.choice([1, 2, 3, 5, 20]), rng.randint(0, 80)
        words = [b"%d" % rng.randrange(k) for _ in range(n)]
        if n > 5 and rng.random() < 0.5:
            a = rng.randrange(n)
            p = 1 + (n - a) // rng.randint(2, 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            if rng.random() < 0.5:
                words[rng.randrange(n)] = b"x"
        assert P.runs_of(words) == plain_runs(words), words
    other = P.RunConfig(least=4, repeats=3)
    for _ in range(300):
        words = [b"%d" % rng.randrange(2) for _ in range(rng.randint(0, 40))]
        assert P.runs_of(words, other) == [r for r in plain_runs(words, 4) if r[1] >= 3 * r[2]]


def test_splitting_is_stable_and_loses_nothing():
    rng = random.Random(2)
    config = P.RunConfig()
    for words in (
        [k // 2 + (k % 2) * 2 for k in range(400)],  # each pass takes only the ends
        [rng.randrange(60) for _ in range(400)], [1] * 30, [], list(range(50)),
        [1, 2] * 10 + [99] + [3, 4, 5] * 6 + [98] + [1] * 12,
    ):
        found = P.stretches(np.array(words, np.int64), config)
        assert found == P._split(words, 0, len(words), config)
        for a, b in found:
            assert b - a >= 12 and min(Counter(words[a:b]).values()) > 1


def test_long_texts_of_few_words_take_little_time():
    assert P.runs_of([b"a"] * 100_000) == [(0, 100_000, 1)]
    assert P.runs_of([b"a", b"b", b"c"] * 30_000) == [(0, 90_000, 3)]
    once = [b"%d" % (k * 7919 % 5003) for k in range(5003)]
    assert P.runs_of(once * 3) == [(0, 15_009, 5003)]
    assert P.runs_of(once * 2) == [(0, 10_006, 5003)] and P.runs_of(once + once[:-1]) == []


def test_run_digests_of_odd_rows(spark):
    rows = [*ODD, *[(k, "one two three four five six " * 5) for k in range(100, 160)]]
    got = P.run_digests(P.with_planted_repetition(documents(spark, rows, "runs", "collapsed", "made")))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(row_of(*r)) for r in rows)
    assert P.run_digests(P.with_planted_repetition(documents(spark, []))).collect() == []


def test_runs_keep_all_columns(spark):
    docs = documents(spark, [(1, "go on " * 9 + "now"), (2, None)], "runs", "collapsed", "made")
    got = P.periodic_runs(docs).orderBy("doc_id").collect()
    assert docs.columns == P.periodic_runs(docs).columns[:-2]
    assert [(r["runs"], r["runs_"], r["collapsed_"]) for r in got] == [("x", [(0, 18, 2)], "go on now"), ("x", [], "")]


def test_op13_on_whole_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = P.run_digests(P.with_planted_repetition(docs))
    expected = []
    for doc, text in docs.select("doc_id", "text").collect():
        words = planted(doc, (text or "").encode().split())
        ids = np.unique(np.array(words, object), return_inverse=True)[1] if words else np.zeros(0, int)
        runs = {}
        for q in range(1, len(ids) // 2 + 1):  # all lags, all places
            same = np.flatnonzero(np.diff(np.concatenate([[0], ids[:-q] == ids[q:], [0]])))
            for s, e in zip(same[::2].tolist(), same[1::2].tolist(), strict=True):
                if e - s + q >= max(12, 2 * q):
                    runs.setdefault((s, e - s + q), q)
        lines = sorted((s, q, n) for (s, n), q in runs.items())
        expected.append((doc, len(lines), hashlib.sha256("".join(f"{s},{n},{q}\n" for s, q, n in lines).encode()).hexdigest()))
    assert sorted(map(tuple, got.select("doc_id", "n_runs", "runs_sha256").collect())) == sorted(expected)
    assert sum(n for _, n, _ in expected) > 5


# ---- spelling variants


def one_error(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def plain_variants(rows, slip=97):
    n = Counter()
    for doc, text in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in word)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if slip and h % slip == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            n[word] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    near = {w: [v for v in n if one_error(w, v)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= 2 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n)


def test_index_finds_one_error_and_its_place():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(1, 6))) for _ in range(200)})
    index = V.PositionIndex(words)
    for word in [*words, "", "abéabéabéabé"]:
        found = index.near(word, 0, 99)
        assert {w for k, w in enumerate(words) if found >> k & 1} == {w for w in words if one_error(word, w)}
        parts = [index.near(word, k, k + 1) for k in range(len(word) + 1)]
        assert sum(p.bit_count() for p in parts) == found.bit_count()  # each pair has one place


@pytest.mark.parametrize("block", [4096, 1])
def test_near_words_in_blocks_of_any_size(spark, block):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abcé") for _ in range(rng.randint(5, 8))) for _ in range(500)} | {"prefix" + a + b for a in "abcdef" for b in "ghijk"})
    n = {w: rng.randint(3, 9) for w in words}
    near = {w: [v for v in words if one_error(w, v)] for w in words}
    expected = {w: (len(vs), *min((-n[v], v) for v in vs)) for w, vs in near.items() if vs}
    got = V.near_words(spark.createDataFrame(list(n.items()), "word string, n long"), V.VariantConfig(block=block))
    assert {r.word: (r.n_near, -r.form_n, r.form) for r in got.collect()} == expected


@pytest.mark.parametrize("slip", [3, 97])
def test_variants_of_odd_rows(spark, slip):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    rows = [*ODD, (8, "ÀÉÎõü ÀÉÎõü àéîõü×÷ ÀÉÎõü"), (9, "\U0001d54f" + "wordy " * 4)]
    for doc in range(10, 60):
        words = []
        for _ in range(80):
            w = base[min(int(rng.expovariate(0.1)), 59)]
            k = rng.randrange(len(w))
            words.append(rng.choice([w, w, w, w.upper(), w[:k] + w[k + 1 :], w[:k] + "z" + w[k:], w[:k] + "y" + w[k + 1 :]]))
        rows.append((doc, rng.choice([" ", "-", "9 "]).join(words)))
    got = V.spelling_variants(documents(spark, rows), V.VariantConfig(slip=slip))
    assert got.columns[:6] == ["word", "form", "root", "n", "n_near", "form_n"]
    expected = plain_variants(rows, slip)
    assert sorted(map(tuple, got.collect())) == expected and len({r[2] for r in expected}) < len(expected)
    assert V.spelling_variants(documents(spark, [(1, None)])).collect() == []


# ---- archives


def lines_of(data):
    return A.Lines(iter([line + b"\n" for line in data.split(b"\n")]))


def arc(version, *records):
    title = A.ARC_TITLES[version]
    block = f"{version} 0 someone\n{title}\n".encode()
    more = " 200 - - 0 name.arc" if version == 2 else ""
    out = f"filedesc://name.arc 0.0.0.0 19961104142103 text/plain{more} {len(block)}\n".encode() + block
    for url, date, mime, body in records:
        out += f"\n{url} 10.1.2.3 {date} {mime}{more} {len(body)}\n".encode() + body
    return out + b"\n"


def test_arc_of_both_versions():
    page = b"HTTP/1.0 200 OK\nContent-Type: text/html\n\nhello\nhttp://fake/ 1.1.1.1 2 text/html 3\n"
    records = [
        ("http://a.example/with blank", "19961104142103", "text/html", page), ("dns:a.example", "199611", "text/dns", b"19961104\na 1\n"),
        ("http://b.example/", "2000", "no-type", b""), ("http://c.example/", "20209999999999", "text/html", b"HTTP/1.1 204 No\r\n\r\n"),
    ]
    for version in (1, 2):
        got = list(A.arc_records("name.arc", lines_of(arc(version, *records))))
        assert [r.version for r in got] == [version] * 5 and all(r.whole for r in got)
        assert [(r.fields["url"], r.block) for r in got[1:]] == [(u, b) for u, _, _, b in records]
        made = [A.warc_fields(r) for r in got]
        assert [m["WARC-Type"] for m in made] == ["warcinfo", "response", "resource", "resource", "response"]
        assert [m["WARC-Date"] for m in made[1:]] == [
            "1996-11-04T14:21:03Z", "1996-11-01T00:00:00Z", "2000-01-01T00:00:00Z", "2020-01-01T00:00:00Z"
        ]
        payload = page.split(b"\n\n", 1)[1]
        assert made[1]["WARC-Payload-Digest"] == "sha1:" + b32encode(hashlib.sha1(payload).digest()).decode()
        assert made[1]["WARC-Target-URI"] == "http://a.example/with%20blank" and made[1]["WARC-IP-Address"] == "10.1.2.3"
        assert len({m["WARC-Record-ID"] for m in made}) == 5
        assert [A.warc_fields(r) for r in A.arc_records("name.arc", lines_of(arc(version, *records)))] == made


def test_arc_that_is_cut_or_broken():
    whole = arc(1, ("http://a.example/", "2000", "text/html", b"HTTP/1.1 200 OK\r\n\r\n" + b"x" * 50))
    *_, last = A.arc_records("f", lines_of(whole[:-30]))
    assert not last.whole and A.warc_fields(last)["WARC-Truncated"] == "unspecified"
    with pytest.raises(ValueError, match="version 1 in f at byte"):
        list(A.arc_records("f", lines_of(whole + b"no header here\n")))
    with pytest.raises(ValueError, match="Unknown ARC version"):
        list(A.arc_records("f", lines_of(whole.replace(b"\n1 0 someone", b"\n3 0 someone"))))


def stored(spark, data, name="x.arc.gz"):
    folder = new_folder(spark)
    path = folder.removeprefix("file:")
    import os

    os.makedirs(path)
    with gzip.open(f"{path}/{name}", "wb") as f:
        f.write(data)
    return folder


def test_converted_archives_keep_every_byte(spark):
    odd = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n" + bytes(range(256)) * 40 + b"\r\n\r\nWARC/1.1\r\n\r\n"
    other = b"HTTP/1.1 404 No\r\n\r\n"
    records = [("http://a/", "2001", "text/html", odd), ("http://b/", "2002", "text/html", odd), ("http://c/", "2003", "text/html", other), ("dns:a", "2003", "text/dns", b"a\n")]
    for version in (1, 2):
        folder, out = stored(spark, arc(version, *records)), new_folder(spark)
        A.convert(spark, folder, out)
        got = {r.target_uri: r for r in A.read_warc(spark, out).collect()}
        assert len(got) == 4
        pair = sorted([got["http://a/"], got["http://b/"]], key=lambda r: r.record_type)
        assert [r.record_type for r in pair] == ["response", "revisit"]
        assert bytes(pair[0].payload) == odd.split(b"\r\n\r\n", 1)[1] and pair[1].payload is None
        assert pair[1].refers_to_id == pair[0].record_id and pair[1].payload_digest == pair[0].payload_digest
        assert got["http://c/"].payload_bytes == 0 and bytes(got["dns:a"].payload) == b"a\n"
    # payloads below the least size never repeat
    folder, out = stored(spark, arc(1, *records, ("http://d/", "2003", "text/html", other))), new_folder(spark)
    A.convert(spark, folder, out, A.ArchiveConfig(least=1))
    assert sorted(r.record_type for r in A.read_warc(spark, out).collect()) == ["resource", *["response"] * 3, "revisit"]


def test_wrong_digest_is_an_error(spark):
    folder = stored(spark, A.warc_record({"WARC-Type": "resource", "WARC-Record-ID": "<x>", "WARC-Payload-Digest": "sha1:AAAA"}, b"abc") + b"\r\n\r\n", "x.warc.gz")
    with pytest.raises(Exception, match="not the one declared"):
        A.read_warc(spark, folder).collect()


@pytest.mark.parametrize("version", [1, None])
def test_archived_pages(spark, version):
    pages = [
        (1, "http://a/ b\n", "same"), (2, None, "same"), (3, "http://c/é", "other\n\nlines\r\n"), (4, "", None), (5, "u", ""), (6, "u", "é" * 100_000),
        (7, "u", "same"), (7, "u", "same"), (None, "u", "same"), (None, "u", "alone"), (8, "u", "alone"), (-9, None, None),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    for name in ("record", "file", "line", "own", "id", "to", "sha1"):
        df = df.withColumn(name, F.lit("x"))
    got = A.archived(df, A.ArchiveConfig(version=version))
    expected = []
    groups = {}
    for page, _, html in pages:
        groups.setdefault((html or "").encode(), []).append(page)
    for payload, ids in groups.items():
        ids.sort(key=lambda i: (i is None, -(i or 0)))
        fact = (len(payload), b32encode(hashlib.sha1(payload).digest()).decode())
        expected += [(i, *fact, "revisit" if k else "response", ids[0] if k else None) for k, i in enumerate(ids)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected))


def test_archived_pages_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert A.archived(empty).collect() == []
    assert A.archived(empty.repartition(2)).collect() == []
