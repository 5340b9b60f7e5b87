import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillwork.llm import components, gridjoin, linkgraph

from .helpers import minimal_components


def brute_links(rows, cosine=0.98):
    """Links by vec_id position: equal labels, usable vectors, cosine in doubles."""
    good = {}
    for k, (i, v, label) in enumerate(rows):
        if i is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        good[k] = np.array(v, dtype=float)
    out = []
    for a in good:
        for b in good:
            if a < b and rows[a][2] == rows[b][2] and len(good[a]) == len(good[b]):
                x, y = good[a], good[b]
                if (x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())) >= cosine:
                    out.append((a, b))
    return out


@pytest.mark.parametrize(("interval", "leaf"), [(512, 128), (7, 3)])
def test_grid_join_equals_brute_force(spark, interval, leaf, monkeypatch):
    monkeypatch.setattr(gridjoin, "LEAF_ROWS", leaf)
    rng = np.random.default_rng(3)
    rows = []
    for label in (0, 1):
        base = rng.normal(size=(25, 16))
        for v in base:
            rows.append(v)
            for _ in range(int(rng.integers(0, 4))):
                rows.append(v * rng.uniform(0.5, 2) + rng.normal(size=16) * 0.06)
            if rng.random() < 0.3:
                rows.append(v)
        rows = [(r if isinstance(r, tuple) else ([float(np.float32(x)) for x in r], label)) for r in rows]
    rows = [(100 - k, v, label) for k, (v, label) in enumerate(rows)]
    nan, inf = float("nan"), float("inf")
    rows += [(500, None, 0), (501, [0.0] * 16, 0), (502, [nan] * 16, 0), (503, [inf] + [1.0] * 15, 0), (504, [None] + [1.0] * 15, 0), (505, rows[0][1], None), (None, rows[0][1], 0), (506, [], 0), (507, [1.0, 2.0], 0), (508, [2.0, 4.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as first", "2 as dim", "3 as a")
    got = {r.vec_id: r for r in gridjoin.near_duplicates(df, k=4, rows=interval).collect()}
    links = brute_links(rows)
    assert len(links) > 30
    n = {r[0]: 0 for r in rows}
    for a, b in links:
        n[rows[a][0]] += 1
        n[rows[b][0]] += 1
    want = minimal_components([r[0] for r in rows if r[0] is not None], [(rows[a][0], rows[b][0]) for a, b in links])
    assert len(got) == len(rows)
    assert {i: r.n_links for i, r in got.items()} == n
    assert {i: r.component_id for i, r in got.items() if i is not None} == want
    assert all(r.kept == (i is not None and r.component_id == i) for i, r in got.items())


def test_grid_join_of_huge_and_tiny_components(spark):
    rows = [(1, [1e308, 1e300], 0), (2, [1.0, 0.0], 0), (3, [1e-310, 0.0], 0), (4, [0.0, 1e-320], 0), (5, [0.0, 1e200], 0)]
    got = {r.vec_id: r for r in gridjoin.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4)}


def test_grid_join_of_an_empty_table(spark):
    assert gridjoin.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 130)] + [(7, None), (5, 5)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if b is not None and a != b]
    want = minimal_components({x for p in real for x in p}, real)
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest_keeps_components():
    rng = np.random.default_rng(2)
    for n, pairs in ((50, 30), (50, 200), (3, 0)):
        i, j = rng.integers(0, n, (2, pairs))
        forest = components.Forest(n)
        for at in range(0, pairs, 7):
            forest.add(i[at : at + 7], j[at : at + 7])
        links = forest.pairs()
        assert len(links) < n and minimal_components(range(n), links.tolist()) == minimal_components(range(n), list(zip(i.tolist(), j.tolist(), strict=True)))
        assert forest.root.tolist() == list(minimal_components(range(n), links.tolist()).values())


def test_forest_of_a_long_chain():
    n = 500_000
    forest = components.Forest(n)
    began = time.time()
    for at in range(0, n - 1, 256):
        i = np.arange(at, min(at + 256, n - 1))
        forest.add(i + 1, i)
    assert time.time() - began < 60 and len(forest.pairs()) == n - 1 and not forest.root.any()


URLS = [
    (1, "http://A.Example.net/en/x?q#f", None), (2, "https://x.example.net/de/1", ""), (3, "http://example.com/de/2", ""), (4, "http://notexample.com/de/2", ""), (5, "http://w.example.org/fr/", ""), (6, "ftp://w.org?x/fr/", ""),
    (7, None, None), (8, "no scheme", "<a href='http://other.example/'>"), (9, "http://evilexample.net", ""), (None, "http://example.net/en/1", ""), (2, "https://x.example.net/de/1", ""), (10, "://h#p", ""),
]


def brute_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:cut].lower(), rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [(h + p, v) for v, h, p in linkgraph.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits, key=lambda x: len(x[0])) if fits else (None, None))


def test_rules(spark):
    df = spark.createDataFrame(URLS, "page_id long, url string, html string").selectExpr("*", "'x' as host", "'y' as rule", "1 as trust")
    got = linkgraph.judge_urls(df).collect()
    assert len(got) == len(URLS)
    want = sorted((str(i), *map(str, brute_rule(u))) for i, u, _ in URLS)
    rows = sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in got)
    assert [r[:4] for r in rows] == [w[:4] for w in want]
    assert all(w[4] in ("None", r[4]) for r, w in zip(rows, want, strict=True))
    assert linkgraph.judge_urls(df.where("false")).count() == 0


def test_distrust_reaches_those_who_link_to_blocked_hosts(spark):
    link = lambda h: f'<a href="http://{h}/">x</a>'
    rows = [(i, f"http://bad{i}.net/", "") for i in range(3)]
    rows += [(10 + i, f"http://farm{i}.example/", "".join(link(f"bad{j}.net") for j in range(3))) for i in range(2)]
    rows += [(20, "http://ok.org/fr/1", link("friend.example")), (21, "http://friend.example/", ""), (22, "http://alone.example/", "")]
    got = {r.page_id: r for r in linkgraph.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), seed_share=0.3).collect()}
    assert [got[k].verdict for k in (0, 10, 11, 20, 21, 22)] == ["block", "block", "block", "allow", "allow", "allow"]
    assert got[21].trust > 0 and got[10].distrust > 0 and got[22].trust == got[22].distrust == 0


def test_default_threshold_blocks_those_who_feed_blocked_hosts(spark):
    link = lambda h: f'<a href="http://{h}/">x</a>'
    rows = [(i, f"http://bad{i}.net/", "") for i in range(3)] + [(10, "http://farm.example/", "".join(link(f"bad{j}.net") for j in range(3)))]
    rows += [(20 + i, f"http://good{i}.org/fr/", link(f"good{(i + 1) % 9}.org")) for i in range(9)] + [(40, "http://friend.example/", link("good1.org"))]
    got = {r.page_id: r.verdict for r in linkgraph.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[10] == "block" and got[40] == "allow" and all(got[20 + i] == "allow" for i in range(9))


def test_method_decides_on_the_given_pages(spark):
    """Unruled pages are blocked where their host is tied to blocked pages closely enough, and nowhere else."""
    rows = linkgraph.judge_urls(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")).collect()
    unruled = [r for r in rows if r.rule is None]
    blocked = {r.host for r in unruled if r.verdict == "block"}
    assert 0 < sum(r.verdict == "block" for r in unruled) < len(unruled) / 2
    with_blocked_pages = {r.host for r in rows if r.rule is not None and r.verdict == "block"}
    assert blocked <= with_blocked_pages
    assert not any(r.verdict == "block" for r in unruled if r.host.endswith(".org"))
    assert all((r.distrust - r.trust > r.threshold) == (r.verdict == "block") for r in unruled)


@pytest.mark.parametrize("task_edges", [0, 100_000])
def test_a_graph_dealt_out_gives_the_same_ranks(spark, task_edges):
    pages = linkgraph.with_rule(linkgraph.with_host_path(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")))
    seeds = pages.where("host != ''").groupBy("host").agg(F.avg(F.when(F.col("ruled") == "allow", 1.0).otherwise(0.0)).alias("trusted"), F.avg(F.when(F.col("ruled") == "block", 1.0).otherwise(0.0)).alias("blocked"))
    got = {r.host: (r.trust, r.distrust) for r in linkgraph.propagate(seeds, linkgraph.host_edges(pages), task_edges=task_edges, rounds=22).collect()}
    if task_edges:
        assert got.keys() == RANKS.keys() and np.allclose([got[h] for h in got], [RANKS[h] for h in got])
    RANKS.update(got)


RANKS: dict = {}


def test_public_suffixes_join_nobody(spark):
    pages = spark.createDataFrame([("a.co.uk", ""), ("www.b.co.uk", ""), ("c.example.com", "")], "host string, html string")
    assert {(r.src, r.dst) for r in linkgraph.host_edges(pages).collect() if r.src > r.dst} == {("www.b.co.uk", "b.co.uk"), ("example.com", "c.example.com")}


def test_propagation_reaches_far_hosts_and_settles(spark):
    hosts = [f"h{i}" for i in range(14)]
    edges = [(a, b, 1.0) for x, y in zip(hosts, hosts[1:], strict=False) for a, b in ((x, y), (y, x))]
    seeds = spark.createDataFrame([(h, float(h == "h0"), 0.0) for h in hosts], "host string, trusted double, blocked double")
    got = {r.host: r.trust for r in linkgraph.propagate(seeds, spark.createDataFrame(edges, "src string, dst string, weight double")).collect()}
    m = np.zeros((14, 14))
    for a, b, _ in edges:
        m[int(b[1:]), int(a[1:])] = 1.0
    m /= m.sum(axis=0)
    settled = np.linalg.solve(np.eye(14) - (1 - linkgraph.RESTART) * m, linkgraph.RESTART * 14 * np.eye(14)[0])
    assert got["h13"] > 0 and np.allclose([got[h] for h in hosts], settled, atol=1e-4)


def test_host_edges_reach_all_ancestors(spark):
    pages = spark.createDataFrame([("blog.x.example.net", ""), ("y.example.net", "")], "host string, html string")
    got = {(r.src, r.dst) for r in linkgraph.host_edges(pages).collect()}
    up = {("blog.x.example.net", "x.example.net"), ("x.example.net", "example.net"), ("y.example.net", "example.net")}
    assert got == up | {(b, a) for a, b in up}


def test_propagation_equals_a_dense_iteration(spark):
    rng = random.Random(1)
    hosts = [f"h{i}" for i in range(8)]
    edges = {(a, b): rng.randrange(1, 4) for a in hosts for b in hosts if a != b and rng.random() < 0.3}
    seeds = {h: (rng.random() if i % 2 else 0.0, rng.random() if i % 3 == 0 else 0.0) for i, h in enumerate(hosts)}
    got = {r.host: r for r in linkgraph.propagate(spark.createDataFrame([(h, *s) for h, s in seeds.items()], "host string, trusted double, blocked double"), spark.createDataFrame([(a, b, float(w)) for (a, b), w in edges.items()], "src string, dst string, weight double")).collect()}
    for way, name in ((0, "trust"), (1, "distrust")):
        s = np.array([seeds[h][way] for h in hosts])
        s = s / s.sum() * len(hosts)
        m = np.zeros((8, 8))
        for (a, b), w in edges.items():
            i, j = hosts.index(a), hosts.index(b)
            m[(j, i) if way == 0 else (i, j)] = w
        m = m / np.maximum(m.sum(axis=0), 1e-300)
        r = s.copy()
        for _ in range(linkgraph.ROUNDS):
            r = linkgraph.RESTART * s + (1 - linkgraph.RESTART) * m @ r
        assert np.allclose(r, [got[h][name] if h in got else 0.0 for h in hosts])
