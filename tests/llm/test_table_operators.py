"""URL filter, exact search, lattice dedup, sharding, mixing and components against plain versions."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from prioscope.llm import embedding_dedup, mixing, sharding, tables, topk_search, url_filter

VECTORS = "vec_id long, embedding array<float>, label int, score string, vector string, cell string, rep string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "x", "x", "x") for i, v in rows], VECTORS)


def near_vectors(seed=2, n=300, width=16):
    """Random vectors, close copies of some in a chain, exact copies and scaled copies."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, width))
    rows = [b.tolist() for b in base]
    for k in range(0, n, 10):
        v = base[k].copy()
        for _ in range(3):
            v = v + rng.normal(scale=0.04 * np.linalg.norm(v) / math.sqrt(width), size=width)
            rows.append(v.tolist())
        rows += [base[k].tolist()] * 2
        rows.append((base[k] * 4).tolist())
    return list(enumerate(rows))


# ---- components


def test_components_of_long_chains_and_stars(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (200, 201), (201, 200)]
    edges += [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    found = {r.node: r.root for r in tables.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for x in root:
        assert found.get(x, x) == find(x)
    assert tables.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ranks_are_gapless_and_ordered(spark):
    rows = [(k % 3, (k * 7919) % 1000) for k in range(2000)] + [(0, 5)] * 500 + [(None, None)] * 20
    df = spark.createDataFrame(rows, "g int, v int")
    got = sorted((r.n, (r.g is not None, r.g or 0), (r.v is not None, r.v or 0)) for r in tables.ranked(df, ["g", "v"], "n").collect())
    assert [r[0] for r in got] == list(range(len(rows)))
    assert [r[1:] for r in got] == sorted(r[1:] for r in got)
    for r in tables.ranked_within(df, "g", ["v"], "n", "size").groupBy("g").agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"), F.countDistinct("n").alias("d"), F.max("size").alias("size"), F.count("*").alias("c")
    ).collect():
        assert (r.lo, r.hi, r.d, r.size) == (0, r.c - 1, r.c, r.c)


# ---- url filter


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    return host, path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def plain_rule(host, path):
    best = (None, None)
    for verdict, rule in url_filter.RULES:
        domain, _, start = rule.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + start) and len(rule) > len(best[0] or ""):
            best = (rule, verdict)
    return best


URLS = [
    "http://a.example.com/en/1", "https://WWW.Example.COM/en/x?q=/", "https://example.com/en", "https://example.com/en/", "http://notexample.com/en/x",
    "http://x.net/es/1#f", "http://x.net/fr?u=http://b.com/", "http://com/", "http://com", "no scheme", "", None, "a://b://c.com/d", "://x.com/e",
    "http://İx.com/ü?ö", "http://x.net/de/5", "http://x.org/en/9\nline", "http://x.com?/en/", "ftp://user@h.net:80/es/q", "http:///path", "http://h.net/es/" + "long/" * 20_000,
]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "x", "x") for i, u in enumerate(URLS)], "page_id long, url string, host string, verdict string")
    pages = pages.unionByName(pages.limit(3))
    rows = url_filter.url_verdicts(pages).collect()
    assert len(rows) == len(URLS) + 3
    for r in rows:
        host, path = plain_url(URLS[r.page_id])
        rule, verdict = plain_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule), URLS[r.page_id]
        assert r.verdict in ("allow", "block") and (verdict is None or r.verdict == verdict)
    assert url_filter.url_verdicts(pages.filter("false")).count() == 0


def test_url_model_learns_its_table(spark):
    rng = random.Random(1)
    rows = [(f"http://{rng.choice(['casino', 'poker'])}{rng.randint(0, 99)}.org/play/{rng.randint(0, 999)}", 1.0) for _ in range(150)]
    rows += [(f"http://news{rng.randint(0, 99)}.org/story/{rng.randint(0, 999)}", 0.0) for _ in range(150)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows[:200], "url string, label double")
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows[200:])], "page_id long, url string")
    found = {r.page_id: r.verdict for r in url_filter.url_verdicts(pages, table).collect()}
    right = sum((found[i] == "block") == (y == 1.0) for i, (_, y) in enumerate(rows[200:]))
    assert right >= 97


def test_url_filter_runs_no_python(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    plan = url_filter.url_verdicts(pages)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    assert "html" not in plan


# ---- exact search


def plain_search(rows, every=50, k=5):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for i, q in ok:
        if i % every == 0:
            scored = [(sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in ok if j != i]
            out[i] = [(j, s) for s, j in sorted(scored, key=lambda t: (-t[0], t[1]))[:k]]
    return out


@pytest.mark.parametrize("block", [7, 64, 10_000])
def test_search_is_exhaustive(spark, block):
    rows = near_vectors(n=120, width=5) + [(1000, None), (1001, []), (1002, [1.0, None]), (1003, [float("nan")]), (1004, [float("inf")]), (1050, [0.0] * 5), (1100, [2.0])]
    df = vectors(spark, rows)
    found = {}
    for r in topk_search.search_all(df, topk_search.SearchConfig(block_rows=block)).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert {q: [v[k] for k in sorted(v)] for q, v in found.items()} == plain_search(rows)


def test_search_is_exact_for_large_components(spark):
    rows = [(0, [3e4, 1.0]), (1, [3e4, 2.0]), (2, [3e4 + 0.5, -5.0]), (50, [1e15, 7.0]), (100, [1e18, 1e18])]
    found = {(r.query_id, r.vec_id): r.score for r in topk_search.search_all(vectors(spark, rows)).collect()}
    for i, expected in plain_search(rows).items():
        for j, s in expected:
            assert found[i, j] == max(min(s, (1 << 63) - 1), -(1 << 63))


def test_search_of_few_rows(spark):
    assert topk_search.search_all(vectors(spark, [])).count() == 0
    assert topk_search.search_all(vectors(spark, [(50, [1.0])])).count() == 0
    assert topk_search.search_all(vectors(spark, [(50, [1.0]), (51, [1.0])])).count() == 1


# ---- lattice dedup


def plain_links(rows, least=0.95):
    ok = {k: np.array(np.float32(v), float) for k, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    links = {k: set() for k in range(len(rows))}
    for a in ok:
        for b in ok:
            if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= least:
                links[a].add(b)
                links[b].add(a)
    return links


def reach(links, k):
    seen, todo = {k}, [k]
    while todo:
        new = links[todo.pop()] - seen
        seen |= new
        todo += new
    return seen


@pytest.mark.parametrize("piece", [16, 1024])
def test_lattice_links_and_components(spark, piece):
    rows = near_vectors() + [(5000, None), (5001, [0.0] * 16), (5002, []), (5003, [None] + [1.0] * 15), (5004, [float("nan")] * 16), (5005, [1.0])]
    links = plain_links(rows)
    found = {r.vec_id: r for r in embedding_dedup.embedding_links(vectors(spark, rows), embedding_dedup.LatticeConfig(piece=piece)).collect()}
    assert len(found) == len(rows)
    total, ours = sum(map(len, links.values())), sum(r.n_links for r in found.values())
    assert 0.9 * total <= ours <= total
    for k in range(len(rows)):
        r = found[rows[k][0]]
        assert r.n_links <= len(links[k])
        assert r.component_id in {rows[x][0] for x in reach(links, k)} and r.kept == (r.component_id == r.vec_id)
    same = sum(found[rows[k][0]].component_id == min(rows[x][0] for x in reach(links, k)) for k in range(len(rows)))
    assert same >= 0.97 * len(rows)


def test_recall_near_the_threshold(spark):
    """Pairs at a cosine of 0.95 to 0.96, the hardest there are."""
    rng = np.random.default_rng(9)
    rows = []
    for k in range(400):
        u = rng.normal(size=64)
        u /= np.linalg.norm(u)
        v = rng.normal(size=64)
        v -= v @ u * u
        v /= np.linalg.norm(v)
        c = rng.uniform(0.9501, 0.96)
        rows += [(2 * k, u.tolist()), (2 * k + 1, (c * u + math.sqrt(1 - c * c) * v).tolist())]
    linked = embedding_dedup.embedding_links(vectors(spark, rows)).filter("n_links > 0").count()
    assert linked >= 0.92 * len(rows)


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(3)
    x = rng.normal(scale=2, size=(300, 8))
    near = embedding_dedup.nearest_e8(x)
    doubled = 2 * near
    assert ((doubled % 2 == 0).all(1) | (doubled % 2 == 1).all(1)).all() and (near.sum(1) % 2 == 0).all()
    own = ((x - near) ** 2).sum(1)
    for v in embedding_dedup.MINIMAL:
        assert (own <= ((x - near - v) ** 2).sum(1) + 1e-9).all()
    assert len({tuple(v) for v in embedding_dedup.MINIMAL}) == 240


def test_lattice_rows_with_odd_ids(spark):
    v = [1.0, 2.0]
    rows = [(None, v), (None, None), (3, v), (3, v), (4, v), (5, [-1.0, 2.0]), (5, [-2.0, 4.0])]
    got = sorted((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept) for r in embedding_dedup.embedding_links(vectors(spark, rows)).collect())
    assert got == [(-1, 0, -1, False), (-1, 0, -1, False), (3, 2, 3, True), (3, 2, 3, True), (4, 2, 3, False), (5, 1, 5, True), (5, 1, 5, True)]
    assert embedding_dedup.embedding_links(vectors(spark, [])).count() == 0


# ---- sharding and mixing


def sources(spark, counts, odd=True):
    rows = [(len(s or "") * 100_000 + k, f"text {s} {k} ü", "en", s, 0, "x", "x") for s, n in counts.items() for k in range(n)]
    if odd:
        rows += [(None, None, None, None, None, "x", "x"), (1, "", None, "a", None, "x", "x"), (1, "", None, "a", None, "x", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, place string, m_slot string")


@pytest.mark.parametrize("counts", [{"a": 700, "bb": 300, "ccc": 77, None: 40}, {"a": 5}, {"a" * k: 1 for k in range(1, 40)}])
def test_shards_match_the_mixture(spark, counts):
    docs = sources(spark, counts)
    rows = sharding.shards(docs).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < 16
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by.get(s, [])) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1
    own = Counter((r.source, r.shard) for r in rows)
    for s in {r.source for r in rows}:
        each = [own[s, k] for k in range(16)]
        assert max(each) - min(each) <= 2
    expected = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == expected
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, sharding.shards(docs.repartition(5)).collect()), key=str)
    assert sharding.shards(docs.filter("false")).count() == 0


@pytest.mark.parametrize("weights", [{"a": 5, "b": 3, "c": 1}, {"a": 1}, {chr(97 + k): 1.7**k for k in range(12)}, {"a": 0, "b": -1, "c": 2}])
def test_schedule_stays_within_a_block(weights):
    slots = mixing.shares(weights, 256)
    plan = mixing.schedule(slots)
    frame = sum(slots.values())
    assert frame == 256 == len(plan) and min(slots.values()) >= 1
    done = dict.fromkeys(slots, 0)
    for t, (source, block, slot) in enumerate(plan, 1):
        assert slot == t - 1 and block == done[source]
        done[source] += 1
        for s, n in slots.items():
            assert abs(done[s] * frame - n * t) < frame  # less than one block


@pytest.mark.parametrize("weights", [None, {"a": 3.0, "bb": 1.0}])
def test_mixture_of_whole_sources(spark, weights):
    docs = sources(spark, {"a": 900, "bb": 400, "ccc": 77, None: 40})
    rows = sorted(mixing.mixed(docs, weights, block_rows=4, frame=64).collect(), key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(docs.count()))
    assert [r.slot for r in rows] == sorted(r.slot for r in rows)
    assert all(r.release <= r.slot < r.deadline for r in rows)
    assert Counter(r.source for r in rows) == Counter(r.source for r in docs.collect())
    last = {s: max(r.slot for r in rows if r.source == s) for s in {r.source for r in rows}}
    weight = {r.source: r.weight for r in rows}
    for t in range(1, 60):
        for s in weight:
            if t <= last[s]:
                blocks = len({r.block for r in rows if r.source == s and r.slot < t})
                assert abs(blocks - weight[s] * t) < 1
    assert mixing.mixed(docs.filter("false")).count() == 0


def test_order_of_the_schedule_is_kept(spark):
    docs = sources(spark, {"a": 300, "bb": 100})
    order = {r.doc_id: r.position for r in mixing.mixed(docs, block_rows=4, frame=64).collect() if r.doc_id not in (1, None)}
    found = mixing.in_order(docs, block_rows=4, frame=64)
    assert found.columns == docs.columns and found.count() == docs.count()
    places = [order[r.doc_id] for r in found.collect() if r.doc_id in order]
    assert places == sorted(places)


def test_sources_beyond_the_driver_share_slots(spark):
    """Of 60 sources 8 have slots of their own; the others' blocks take the rest's slots by deadline."""
    rng = random.Random(3)
    rows = [(k, f"text {k}", "hot" if k % 3 == 0 else None if k % 17 == 0 else f"s{int(rng.expovariate(0.05))}") for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    counts = Counter(r[2] for r in rows)
    weights = {s: n**0.7 for s, n in counts.items()}
    total = sum(weights.values())
    got = sorted(mixing.mixed(docs, block_rows=4, frame=256, most_sources=8).collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(4000)) and sorted(r.doc_id for r in got) == list(range(4000))
    assert [r.slot for r in got] == sorted(r.slot for r in got)
    top = sorted(counts, key=lambda s: -weights[s])[:8]
    blocks = {(r.source, r.block): r for r in got}
    assert len(blocks) == sum(-(-n // 4) for n in counts.values())
    assert len({r.slot for r in blocks.values()}) == len(blocks)  # a block a slot
    for source in top:
        for (s, k), r in blocks.items():
            if s == source:
                assert r.release <= r.slot < r.deadline
    others = sorted((r.slot, r.deadline) for (s, _), r in blocks.items() if s not in top)
    assert all(a[1] <= b[1] + 1 for a, b in zip(others, others[1:], strict=False))
    for r in got:
        assert r.source in top or r.weight == pytest.approx(weights[r.source] / total)


def test_many_sources_stay_on_spark(spark):
    """As many sources as rows: the driver sees no more than it allows."""
    docs = spark.range(30_000).selectExpr("id AS doc_id", "'t' AS text", "concat('s', id) AS source")
    got = mixing.mixed(docs, most_sources=16)
    assert got.agg(F.countDistinct("position")).first()[0] == 30_000


@pytest.mark.parametrize(("most", "kind"), [(256, "<i2"), (32767, "<i2"), (32768, "<i4"), (1 << 31, "<f8"), (1e300, "<f8")])
def test_search_blocks_are_stored_narrow_and_whole(most, kind):
    data = np.array([[0.0, -most], [most, 1.0]])
    stored = topk_search.narrowest(data)
    assert stored.dtype.str == kind and (stored == data).all()
    assert topk_search.narrowest(data[:, :0]).size == 0
