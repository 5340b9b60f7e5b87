import hashlib

import numpy as np
import pytest

from quillwork.llm import lookup, whitening

VECTORS = "vec_id long, embedding array<double>, label int"
nan, inf = float("nan"), float("inf")


def brute_whiten(x, k):
    n, total = len(x), x.sum(axis=0)
    c = (n * x - total) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return c @ vectors / np.sqrt(values), [sum(int(v) ** 2 for v in n * r - total) for r in x], values / np.trace(c.T @ c / n)


@pytest.mark.parametrize(("rows", "block"), [(300, 1024), (300, 7), (65, 16)])
def test_whitening_equals_numpy(spark, rows, block):
    rng = np.random.default_rng(rows)
    v = (rng.normal(size=(rows, 40)) @ rng.normal(size=(40, 40))).round(3)
    v[5] = v[6]
    df = spark.createDataFrame([(i, r.tolist(), 0) for i, r in enumerate(v)], VECTORS).repartition(5)
    got = whitening.whiten(df, block_rows=block).toPandas()
    assert len(got) == rows * 32 and set(got.n) == {rows} and got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-9
    want, deviation, explained = brute_whiten(np.floor(64 * v).astype(np.int64) + 1_000_000, 32)
    found = got.pivot(index="vec_id", columns="component", values="whitened").loc[range(rows)].to_numpy()
    assert np.abs(found * np.sign((found * want).sum(axis=0)) - want).max() < 1e-8
    assert got[got.component == 1].set_index("vec_id").deviation.loc[range(rows)].tolist() == deviation
    assert np.allclose(got.groupby("component").explained.first(), explained, rtol=1e-9)


def test_whitening_of_awkward_vectors(spark):
    rows = [(1, [1.0, 2.0, 3.0], 0), (2, [2.0, 2.0, 5.0], 0), (2, [4.0, 2.0, 1.0], 0), (None, [0.0, 2.0, 0.5], None), (3, None, 0), (4, [nan, 1.0, 1.0], 0), (5, [inf, 1.0, 1.0], 0), (6, [None, 1.0, 1.0], 0), (7, [], 0), (8, [1.0], 0), (9, [1e300, 2.0, -1e300], 0)]
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 as n", "2 as block", "'x' as white", "4 as component", "5 as dim", "6 as x", "7 as k", "8 as part")
    got = whitening.whiten(df).collect()
    assert sorted((str(r.vec_id), r.component) for r in got) == sorted((str(i), c) for i in (1, 2, 2, None, 9) for c in (1, 2, 3))
    # the middle entry never varies, so the third component has no variance; the row of huge entries has no deviation in a long
    assert all(r.whitened == 0 and r.explained == 0 for r in got if r.component == 3)
    assert all((r.deviation is None) == (r.vec_id == 9) or r.vec_id != 9 for r in got)
    assert whitening.whiten(df.where("false")).count() == 0 and whitening.whiten(df.where("vec_id = 3")).count() == 0
    alone = whitening.whiten(df.where("vec_id = 1")).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in alone] == [(1, 0, 0.0, 0.0, 0.0)] * 3


def test_scatter_uses_every_place_of_the_square(spark, monkeypatch):
    v = np.random.default_rng(1).normal(size=(500, 4))
    packs = whitening.packed(whitening.integer_entries(spark.createDataFrame([(i, r.tolist(), 0) for i, r in enumerate(v)], VECTORS).coalesce(1)), 8)
    packs = packs.selectExpr("cast(k as int) as block", "x")
    x = np.floor(64 * v).astype(np.int64) + 1_000_000
    sums = x.sum(axis=0).tolist()
    left, right = (whitening.block_matrix(packs, 500, sums, 3, s, 8) for s in (True, False))
    assert len(left.transpose().multiply(right).blocks.collect()) == 9
    c = x - x.mean(axis=0)
    assert np.allclose(whitening.scatter(left, right), c.T @ c)


def brute_clusters(rows, k=40, rounds=5):
    kept = [(i, [int(np.floor(256 * c)) for c in v]) for i, v, _ in rows if v is not None and len(v) == 64 and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([v for _, v in kept], dtype=object)
    name = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted((name(i), v) for i, v in kept)[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = [nearest(v)[1] for v in x]
        centroids = [[sum(x[j][d] for j in range(len(x)) if own[j] == n) // own.count(n) for d in range(64)] if n in own else c for n, c in enumerate(centroids)]
    last = [nearest(v) for v in x]
    total = sum(d for d, _ in last)
    return sorted((str(i), n, d, sum(e for e, m in last if m == n), total, hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(kept, last, strict=True))


@pytest.mark.parametrize(("rows", "block"), [(130, 4096), (130, 9), (25, 4096)])
def test_clustering_equals_brute_force(spark, rows, block):
    rng = np.random.default_rng(rows)
    v = rng.normal(size=(7, 64))[rng.integers(0, 7, rows)] * 0.2 + rng.normal(size=(rows, 64)) * 0.02
    table = [(i, r.tolist(), 0) for i, r in enumerate(v)]
    # copies tie: equal vectors, equal ids, centroids at equal distance
    table += [(i + 1000, v[3].tolist(), 0) for i in range(5)] + [(4, v[4].tolist(), 0), (4, v[5].tolist(), 0), (None, v[6].tolist(), None)]
    table += [(900, None, 0), (901, [0.0] * 63, 0), (902, [nan] + [0.0] * 63, 0), (903, [inf] + [0.0] * 63, 0), (904, [None] + [0.0] * 63, 0), (905, [], 0)]
    df = spark.createDataFrame(table, VECTORS).selectExpr("*", "1 as x", "2 as cluster", "3 as ids", "4 as distance", "5 as name").repartition(4)
    got = sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in lookup.cluster(df, block_rows=block).collect())
    assert got == brute_clusters(table)


def test_clustering_of_awkward_tables(spark):
    assert lookup.cluster(spark.createDataFrame([], VECTORS)).count() == 0
    assert lookup.cluster(spark.createDataFrame([(1, None, 0), (2, [1.0], 0)], VECTORS)).count() == 0
    huge = lookup.cluster(spark.createDataFrame([(i, [s * 1e300] * 64, 0) for i, s in enumerate((1, -1, 1, -1))], VECTORS)).collect()
    assert [r.distance for r in huge] == [0] * 4
    one = spark.createDataFrame([(1, [0.5] * 64, 0)] * 3, VECTORS)
    assert {(r.cluster, r.distance, r.inertia) for r in lookup.cluster(one).collect()} == {(0, 0, 0)}
    columns = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert lookup.cluster(one).columns == columns == lookup.cluster(one.where("false")).columns
    assert [f.dataType for f in lookup.cluster(one).schema] == [f.dataType for f in lookup.cluster(one.where("false")).schema]
