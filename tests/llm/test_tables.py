import os
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from tessel.llm import mixing, queries, topk, url_filter

WORD = re.compile(r"[^\x20\x09-\x0d]+")

# ---- mixing ---------------------------------------------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(1, 2, 3)):
    """Share by weight, stop sources at three times their size, reshare the excess until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in capped else share[s] for s in order}
        capped |= over


@pytest.mark.parametrize("cut", [True, False])
def test_mix(docs, corpus, cut):
    size = {i: len(WORD.findall(t or "")) for i, t, _ in corpus}
    per = defaultdict(int)
    for i, _, s in corpus:
        per[s] += size[i]
    want = brute_targets(per)
    rows = mixing.mix_sources(docs, cut_last=cut, leaf=8).collect()
    assert len(rows) == len(corpus)
    taken, largest = defaultdict(int), defaultdict(int)
    source = {i: s for i, _, s in corpus}
    for r in rows:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], per[s]) and abs(r["target"] - want[s]) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"] and r["copies"] <= 3
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
        if not cut:
            assert r["taken"] == r["copies"] * r["size"]
    for s in per:
        assert abs(taken[s] - want[s]) <= (1 if cut else largest[s])
    again = mixing.mix_sources(docs.repartition(7), cut_last=cut, leaf=8).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_settle_keeps_expectation_and_words():
    rng = np.random.default_rng(0)
    sizes, parts = rng.integers(1, 100, 50), rng.random(50)
    mean = np.zeros(50)
    for seed in range(400):
        out = mixing.settle(np.arange(50), sizes, parts, seed)
        assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 1 and abs((out * sizes).sum() - (parts * sizes).sum()) < 1e-6
        mean += out / 400
    assert np.abs(mean - parts).max() < 0.12


def test_mix_odd_tables(spark, no_docs):
    assert mixing.mix_sources(no_docs).count() == 0
    rows = [(1, None, None), (2, "", "a"), (None, "x y", "a"), (1, "x", "b"), (1, "x", "b")]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == 5 and sum(r["taken"] for r in got) == pytest.approx(4, abs=2)
    capped = [(k, "w " * n, s) for k, (n, s) in enumerate([(1, "a"), (1, "b"), (1, "c"), (100, "d")])]
    got = {r["source"]: r["target"] for r in mixing.mix_sources(spark.createDataFrame(capped, "doc_id long, text string, source string")).collect()}
    assert got == {"a": 3, "b": 3, "c": 3, "d": 94}


# ---- URL filter ------------------------------------------------------------------------------------------------------------------------

URLS = [None, "", "no scheme", "http://Example.NET/en/x", "https://a.b.example.net/en/", "https://example.net/en", "https://example.net", "https://xexample.net/fr/?q", "ftp://net/x#y", "https://A.ORG/fr/1?x=/de/", "https://org", "HTTP://www.example.com/de/x",
        "https://example.com/DE/", "//host/path", "a://b://c/d", "https://example.com?/de/", "https://www.example.com#/de/", "https://.net/", "https://net./", "https://u@example.com:80/de/", "http://é.net/ü\n/x", "http://x.net\n/y"]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def brute(url, rules):
    host, path = parts(url)
    fit = [(len(h + p), h + p, a) for h, p, a in rules if h and host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[1:] if fit else (None, "allow")))


def test_url_filter(spark):
    pages = spark.createDataFrame([(k, u, "h", "p") for k, u in enumerate(URLS * 2)], "page_id long, url string, host string, path string")
    for rules in (queries.URL_RULES, [("example.com", "", "block"), ("com", "/de", "allow"), ("", "/", "block"), ("net", "/e", "block")], []):
        r = spark.createDataFrame(rules, "host string, path string, action string")
        got = {x["page_id"]: tuple(x)[1:5] for x in url_filter.judge(pages, r).collect()}
        assert got == {k: brute(u, rules) for k, u in enumerate(URLS * 2)}
    assert url_filter.judge(pages.limit(0), r).count() == 0


def test_url_filter_many_rules(spark):
    rng = random.Random(4)
    label = lambda: rng.choice("abcdefgh")
    rules = sorted({(".".join(label() for _ in range(rng.randrange(1, 4))), rng.choice(["", "/", "/a/", "/a/b"]), rng.choice(["block", "allow"])) for _ in range(3000)})
    rules = list({(h, p): (h, p, a) for h, p, a in reversed(rules)}.values())
    urls = [f"http://{'.'.join(label() for _ in range(rng.randrange(1, 5)))}{rng.choice(['', '/', '/a', '/a/', '/a/bc'])}" for _ in range(400)]
    r = spark.createDataFrame(rules, "host string, path string, action string")
    got = {x["page_id"]: tuple(x)[1:5] for x in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), r).collect()}
    assert got == {k: brute(u, rules) for k, u in enumerate(urls)}
    words, blocks = url_filter.build_bloom(r.selectExpr("concat(host, path) AS key"), "key", len(rules))
    assert blocks > 64 and len(words) == 4
    from pyspark.sql import functions as F

    probe = spark.range(20000).select(F.concat(F.lit("no such key "), F.col("id")).alias("k"))
    assert probe.where(url_filter.might_contain(F.col("k"), (words, blocks))).count() < 400
    assert r.selectExpr("concat(host, path) AS k").where(~url_filter.might_contain(F.col("k"), (words, blocks))).count() == 0


# ---- exact top-k -------------------------------------------------------------------------------------------------------------------------


def test_topk_agrees_with_brute_force(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(8, 16)) * 3
    x = np.round((centres[rng.integers(0, 8, 900)] + rng.normal(size=(900, 16))) * 4) / 4
    x[100:140] = x[100]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(5000, None), (5001, [1.0] * 15 + [None]), (5002, [1.0] * 15 + [float("nan")]), (5020, [float("inf")] * 16), (None, [1.0] * 16)]
    table = spark.createDataFrame([(*r, 1.0, -1, 9) for r in rows], "vec_id long, embedding array<float>, v double, shard int, block long").repartition(6)
    vectors = topk.quantised(table, "vec_id", "embedding")
    assert vectors.count() == 900
    q = np.floor(64 * x.astype(np.float32).astype(np.float64))
    got = topk.top_k(vectors, vectors.where("id % 20 = 0"), 20, shard_rows=150, block_queries=10).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        by[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(by) == set(range(0, 900, 20))
    for i, found in by.items():
        s = (q @ q[i]).astype(int)
        assert found == [(int(j), int(s[j])) for j in sorted((j for j in range(900) if j != i), key=lambda j: (-s[j], j))[:20]]


def test_search_prunes_and_shares_floors():
    """Trees of many nodes: best-first order, exact results, fewer nodes where clusters part and where the kth score is known."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 12)) * 200
    x = np.round(centres[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 12)) * 4)
    ids = rng.permutation(6000)
    tree = topk.ball_tree(x)
    assert len(tree[1]) > 60
    full = x @ x[:30].T
    full[np.arange(30), np.arange(30)] = -np.inf
    want = [sorted(range(6000), key=lambda j, q=q: (-full[j, q], ids[j]))[:10] for q in range(30)]
    for floor in (np.full(30, -np.inf), np.array([full[w[-1], q] for q, w in enumerate(want)])):
        opened: list[int] = []
        q, i, s = topk.search(ids, x, ids[:30], x[:30], floor, 10, tree, opened)
        assert [sorted(zip(-s[q == n], i[q == n], strict=True)) for n in range(30)] == [[(-full[j, n], ids[j]) for j in w] for n, w in enumerate(want)]
        assert len(opened) < len(tree[1])
    single: list[int] = []
    topk.search(ids, x, ids[:1], x[:1], floor[:1], 10, tree, single)
    _, nodes, c, r = tree
    bound = (x[:1] @ c.T + np.sqrt((x[:1] ** 2).sum(1))[:, None] * r)[0]
    for n, (_, _, left, right) in enumerate(nodes):
        if left >= 0:
            bound[[left, right]] = np.minimum(bound[[left, right]], bound[n])
    assert len(single) < 0.6 * len(nodes)
    assert all(bound[a] >= bound[b] - 1e-6 for a, b in zip(single, single[1:], strict=False))


def test_topk_over_waves_of_shards(spark):
    """Many shards of several leaves each, null components elsewhere and one id repeated."""
    rng = np.random.default_rng(10)
    x = np.round(rng.normal(size=(3000, 6)) * 30)
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(2999, x[0].tolist())]
    v = spark.createDataFrame(rows, "id long, v array<double>").repartition(4)
    got = topk.top_k(v, v.where("id % 50 = 0"), 7, shard_rows=280, block_queries=25).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        by[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(by) == set(range(0, 3000, 50))
    for i, found in by.items():
        s = [(j, int(np.dot(w, x[i]))) for j, w in rows if j != i]
        assert found == sorted(s, key=lambda e: (-e[1], e[0]))[:7]


def test_topk_small_tables(spark):
    v = spark.createDataFrame([(0, [1.0, 2.0]), (20, [1.0, 1.0]), (3, [0.0, 0.0])], "id long, v array<double>")
    got = sorted(map(tuple, topk.top_k(v, v.where("id % 20 = 0"), 20).collect()))
    assert got == [(0, 1, 20, 3), (0, 2, 3, 0), (20, 1, 0, 3), (20, 2, 3, 0)]
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0 and topk.top_k(v, v.limit(0)).count() == 0
    with pytest.raises(ValueError):
        topk.quantised(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>"), "vec_id", "embedding")
    assert topk.quantised(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id", "embedding").count() == 0


def test_tree_bounds_hold():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 8))
    order, nodes, centres, radii = topk.ball_tree(x, 64)
    assert sorted(order) == list(range(2000))
    for (a, b, left, _), c, r in zip(nodes, centres, radii, strict=True):
        assert np.sqrt(((x[order[a:b]] - c) ** 2).sum(1)).max() <= r + 1e-9 and (left >= 0 or b - a <= 64)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the benchmark tables are not here")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_agrees_with_sql(spark, name):
    c = duckdb.connect()
    for t in ("pages", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas(), c.sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and list(map(str, got[columns].dtypes)) == list(map(str, want[columns].dtypes))
    rows = lambda x: sorted(map(str, x[columns].astype(object).where(x[columns].notna(), None).values.tolist()))
    assert rows(got) == rows(want)
