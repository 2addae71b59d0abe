import hashlib

import numpy as np
import pytest

from spindrift.llm import centroids as C

WIDE = "vec_id long, embedding array<double>, label int, cluster int, n long"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, None if v is None else list(v), 1, 5, 6) for i, v in rows], WIDE).repartition(parts)


def plain(rows, k=40, rounds=5):
    """The clusters by distances of all pairs, in Python's integers."""
    kept = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in order[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    pick = lambda v: min((dist(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        of = [pick(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            own = [v for (_, v), m in zip(kept, of, strict=True) if m == n]
            if own:
                centroids[n] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = [(i, *pick(v)[::-1]) for i, v in kept]
    sums = [sum(d for _, m, d in out if m == n) for n in range(len(centroids))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(map(str, [(i, n, d, sums[n], sum(sums), names[n]) for i, n, d in out]))


def got(frame):
    return sorted(map(str, [(r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in frame.collect()]))


def test_transform_keeps_distances():
    rng = np.random.default_rng(1)
    v = rng.integers(-(1 << 20), 1 << 20, (30, 64))
    t = C.hadamard(v)
    assert (((t[:10, None] - t[None]) ** 2).sum(2) == 64 * ((v[:10, None] - v[None]) ** 2).sum(2)).all()
    assert (t[:, 0] == v.sum(1)).all() and (t[:, 1] == v[:, :32].sum(1) - v[:, 32:].sum(1)).all()


def test_search_is_exact_with_ties():
    rng = np.random.default_rng(2)
    centroids = rng.integers(-3, 4, (50, 64))
    centroids[7] = centroids[31]
    vectors = np.r_[rng.integers(-3, 4, (3000, 64)), centroids, np.zeros((2, 64), np.int64)]
    number, distance = C.nearest(C.hadamard(vectors), C.hadamard(centroids))
    every = ((vectors[:, None] - centroids[None]) ** 2).sum(2)
    assert (number == every.argmin(1)).all() and (distance == every.min(1)).all()


def test_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(0, 0.2, 64)) for k in range(300)]
    rows += [(1000 + k, rows[0][1]) for k in range(200)] + rows[:20] + [(None, rows[3][1]), (None, np.zeros(64))]
    rows += [(2000, None), (2001, []), (2002, np.zeros(63)), (2003, [None] * 64), (2004, [float("nan")] * 64), (2005, [0.0] * 63 + [float("inf")])]
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows]
    want = plain(rows)
    assert got(C.cluster(table(spark, rows))) == want == got(C.cluster(table(spark, rows, 7)))


def test_large_components(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in rng.normal(0, 1e5 if k % 2 else 0.1, 64)]) for k in range(60)]
    assert got(C.cluster(table(spark, rows))) == plain(rows)
    with pytest.raises(Exception, match="64 bits"):
        C.cluster(table(spark, [(1, [2.0**21] * 64)]))


def test_few_and_none(spark):
    rows = [(1, [0.5] * 64), (2, [0.5] * 64), (3, [-0.5] * 64)]
    assert got(C.cluster(table(spark, rows))) == plain(rows)
    assert C.cluster(table(spark, [(1, None)])).collect() == []
    assert C.cluster(table(spark, rows).where("vec_id > 9")).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
