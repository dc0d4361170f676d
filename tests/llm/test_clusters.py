"""Clustering against a plain version, its bounds, and the odd cases."""

import hashlib

import numpy as np
import pytest

from taskmill.llm import centroids
from taskmill.llm.centroids import cluster_vectors, loosening

DDL = "vec_id long, embedding array<float>, `cluster` string, __points int"


def plain(rows, clusters, rounds, components, scale=256):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) by comparing all with all."""
    kept = [
        (i, np.array([int(np.floor(scale * float(np.float32(x)))) for x in v], np.int64)) for i, v in rows
        if v is not None and len(v) == components and all(x is not None and np.isfinite(x) for x in v)
    ]
    if not kept:
        return []

    def key(row):
        return (row[0] is None, hashlib.sha256(f"2:{row[0]}".encode()).hexdigest(), row[1].tolist())

    centres = [v.copy() for _, v in sorted(kept, key=key)[:clusters]]
    for r in range(rounds + 1):
        found = [min((int(((v - c) ** 2).sum()), j) for j, c in enumerate(centres)) for _, v in kept]
        for j in range(len(centres)) if r < rounds else ():
            members = [v for (_, v), (_, near) in zip(kept, found) if near == j]
            if members:
                centres[j] = sum(members) // len(members)
    inertia = {j: sum(d for d, near in found if near == j) for j in range(len(centres))}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [
        (i, j, d, inertia[j], sum(inertia.values()), digests[j]) for (i, _), (d, j) in zip(kept, found)
    ]


def result(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], DDL)
    got = cluster_vectors(df.repartition(3), **options)
    return sorted(map(tuple, got.select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    ).collect()), key=str)


@pytest.mark.parametrize("seed, spread", [(0, 0.02), (1, 0.5)])
def test_equals_the_plain_version(spark, seed, spread):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in middles[i % 6] + spread * rng.normal(size=8)]) for i in range(400)]
    rows += [(3, rows[0][1]), (None, rows[1][1]), (None, rows[2][1]), (500, rows[4][1])]
    rows += [(600, None), (601, []), (602, [1.0] * 7), (603, [1.0] * 7 + [None]), (604, [float("nan")] * 8),
             (605, [float("inf")] * 8), (606, [1.0] * 9)]
    options = {"clusters": 10, "rounds": 4, "components": 8}
    assert result(spark, rows, **options) == sorted(plain(rows, 10, 4, 8), key=str)


def test_copies_ties_and_few_vectors(spark):
    rows = [(i, [0.5, -0.25]) for i in range(40)] + [(50, [1.0, 0.0]), (51, [0.0, 0.0])]
    for clusters in (3, 100):
        options = {"clusters": clusters, "rounds": 3, "components": 2}
        assert result(spark, rows, **options) == sorted(plain(rows, clusters, 3, 2), key=str)
    assert result(spark, [], clusters=3, rounds=2, components=2) == []
    with pytest.raises(ValueError):
        result(spark, rows, clusters=0)


def test_large_components_are_exact_and_larger_ones_refused(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.uniform(-4e5, 4e5, 3)]) for i in range(60)]
    options = {"clusters": 5, "rounds": 3, "components": 3}
    assert result(spark, rows, **options) == sorted(plain(rows, 5, 3, 3), key=str)
    with pytest.raises(Exception, match="beyond"):
        result(spark, [(1, [1e9, 0.0, 0.0])], **options)


def test_other_columns_are_kept_when_asked(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0], "x", 7), (2, [1.0, 0.0], "y", 8)], DDL)
    got = cluster_vectors(df, clusters=1, rounds=1, components=2, keep=("__points",))
    assert got.columns == [
        "vec_id", "__points", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    ]
    assert sorted(r["__points"] for r in got.collect()) == [7, 8]


def test_bounds_never_loosen_too_little_and_often_less_than_the_drift():
    rng = np.random.default_rng(4)
    tighter = 0
    for _ in range(40):
        k, size = 6, int(rng.integers(2, 5))
        old = rng.normal(size=(k, size)) * 10
        new = old + rng.normal(size=(k, size)) * rng.uniform(0, 6, size=(k, 1))
        radius = rng.uniform(0, 8, size=k)
        bound = loosening(old, new, radius)
        drift = np.sqrt(((new - old) ** 2).sum(1))
        for i in range(k):
            off = rng.normal(size=(300, size))
            points = old[i] + off / np.linalg.norm(off, axis=1)[:, None] * radius[i] * rng.uniform(0, 1, (300, 1)) ** 0.2
            for j in range(k):
                if i != j:
                    nearer = np.linalg.norm(points - old[j], axis=1) - np.linalg.norm(points - new[j], axis=1)
                    assert nearer.max() <= bound[i]
            tighter += bound[i] < np.delete(drift, i).max() * 0.99
    assert tighter > 40


def test_separate_clusters_are_hardly_scanned():
    rng = np.random.default_rng(6)
    middles = rng.normal(size=(8, 6)) * 500
    points = (middles[np.arange(800) % 8] + rng.normal(size=(800, 6)) * 20).astype(np.int64)
    step = centroids.Step(points[:8].copy())
    state = (np.zeros(800, int), np.zeros(800), np.zeros(800))
    scanned = []
    for _ in range(4):
        cluster, upper, lower, _, n = centroids._assigned(step, points, *state, False)
        state = (cluster, upper, lower)
        scanned.append(n)
        new = np.array([points[cluster == j].sum(0) // (cluster == j).sum() for j in range(8)])
        radius = np.array([upper[cluster == j].max() for j in range(8)])
        drift = np.sqrt(((new - step.centroids) ** 2).sum(1).astype(float))
        step = centroids.Step(new, drift, loosening(step.centroids, new, radius))
    assert scanned[0] == 800 and max(scanned[1:]) < 80
