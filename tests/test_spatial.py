"""Spatial joins against brute force, with crowds, edges, NULLs and empty sides."""

import numpy as np

from ridgeline.operators import spatial_join as S
from ridgeline.operators.nearest import _by_radius, distance_to_segments, nearest_k, nearest_within


def _points(spark, xy, name="id", start=0):
    return spark.createDataFrame([(start + k, float(a), float(b), "z") for k, (a, b) in enumerate(xy)], f"{name} long, x double, y double, distance string")


def _brute(a, b, r):
    d = np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1])
    return set(zip(*(v.tolist() for v in np.nonzero(d <= r)), strict=True))


def test_within_distance_with_a_crowd(spark, monkeypatch):
    monkeypatch.setattr(S, "CAPACITY", 40)
    rng = np.random.default_rng(0)
    crowd = rng.normal(0, 60, (400, 2)) + 5000
    a, b = np.vstack([rng.uniform(-9e4, 9e4, (500, 2)), crowd]), np.vstack([rng.uniform(-9e4, 9e4, (500, 2)), crowd[:200] + 7, [[2e7, 2e7], [-3e7, 0]]])
    got = [(r["left_id"], r["right_id"]) for r in S.within_distance(_points(spark, a), "id", _points(spark, b), "id", 200.0).collect()]
    assert len(got) == len(set(got)) and set(got) == _brute(a, b, 200.0)


def test_limit_is_inclusive_and_bad_rows_have_no_pairs(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 0.0), (3, float("nan"), 0.0), (None, 0.0, 0.0)], "id long, x double, y double")
    b = spark.createDataFrame([(7, 200.0, 0.0), (8, 0.0, 200.01), (9, 0.0, None), (10, 200.0, 0.0)], "id long, x double, y double")
    assert {(r[0], r[1]) for r in S.within_distance(a, "id", b, "id", 200.0).collect()} == {(1, 7), (1, 10)}
    assert S.within_distance(a.limit(0), "id", b, "id", 200.0).count() == 0 == S.within_distance(a, "id", b.limit(0), "id", 200.0).count()


def test_packed_tree():
    rng = np.random.default_rng(1)
    boxes = rng.uniform(0, 100, (1000, 2)).repeat(2, axis=0).reshape(1000, 4)[:, [0, 1, 0, 1]] + [0, 0, 3, 3]
    probes = rng.uniform(0, 100, (50, 2))[:, [0, 1, 0, 1]] + [-2, -2, 2, 2]
    got = {(int(q), int(i)) for qs, items in S.PackedRTree(boxes).probe(probes) for q, i in zip(qs, items, strict=True)}
    want = {(q, i) for q in range(50) for i in range(1000) if (boxes[i, :2] <= probes[q, 2:]).all() and (boxes[i, 2:] >= probes[q, :2]).all()}
    assert got == want


def test_within_regions(spark, monkeypatch):
    monkeypatch.setattr(S, "CAPACITY", 5)
    ring = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    areas = [(1, [ring(0, 0, 10, 10), ring(4, 4, 6, 6)]), (2, [ring(8, 8, 120, 40)]), (3, [[(0.0, 0.0), (1.0, 1.0)]]), (4, []), (5, None)]
    data = [(i, None if p is None else [[{"x": float(x), "y": float(y)} for x, y in r] for r in p]) for i, p in areas]
    regions = spark.createDataFrame(data, "id long, parts array<array<struct<x:double,y:double>>>")
    pts = _points(spark, [(5, 5), (1, 1), (9, 9), (50, 20), (-5, 5), (7, 5)], "pid")
    assert {(r[0], r[1]) for r in S.within_regions(pts, "pid", regions, "id", "parts").collect()} == {(1, 1), (2, 1), (2, 2), (3, 2), (5, 1)}


def test_nearest(spark):
    rng = np.random.default_rng(3)
    a, b = rng.uniform(0, 5000, (80, 2)), rng.uniform(0, 5000, (300, 2))
    d = np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1])
    left, right = _points(spark, a, "a"), _points(spark, b, "b")
    one = {r["a"]: r["b"] for r in nearest_within(left, "a", right, "b", 150.0).collect()}
    assert one == {k: int(d[k].argmin()) for k in range(80) if d[k].min() <= 150}
    want = {(k, int(j), r) for k in range(80) for r, j in enumerate(np.argsort(d[k])[:7])}
    assert {(r["a"], r["b"], r["rank"]) for r in nearest_k(left, "a", right, "b", 7).collect()} == want
    far = _by_radius(left.selectExpr("a AS id", "x", "y"), right.selectExpr("b AS id", "x", "y"), 7)
    assert {(r["left_id"], r["right_id"], r["rank"]) for r in far.collect()} == want


def test_nearest_ties_and_few(spark):
    left, right = _points(spark, [(0, 0)], "a"), _points(spark, [(1, 0), (-1, 0)], "b", 5)
    assert [(r["b"], r["rank"]) for r in nearest_k(left, "a", right, "b", 30).orderBy("rank").collect()] == [(5, 0), (6, 1)]
    assert nearest_within(left, "a", right, "b", 1.0).first()["b"] == 5 and nearest_k(left, "a", right.limit(0), "b", 3).count() == 0


def test_point_to_line(spark):
    pts = _points(spark, [(0, 1), (5, 5), (20, 0)], "p")
    segs = spark.createDataFrame([(0.0, 0.0, 10.0, 0.0), (3.0, 3.0, 3.0, 3.0)], "x0 double, y0 double, x1 double, y1 double")
    got = [round(r["distance"], 6) for r in distance_to_segments(pts, "p", segs).orderBy("p").collect()]
    assert got == [1.0, 2.828427, 10.0]
    from ridgeline.operators.nearest import _far_segments

    assert [round(r["distance"], 6) for r in _far_segments(pts, "p", segs).orderBy("p").collect()] == got


def test_nearest_over_many_leaves(spark, monkeypatch):
    from ridgeline.operators import nearest as N

    def crowd_pairs(*a, **k):
        raise AssertionError("all pairs within one radius")

    monkeypatch.setattr(N, "within_distance", crowd_pairs)
    monkeypatch.setattr(N, "CAPACITY", 40)
    monkeypatch.setattr(N, "TOGETHER", 50)
    rng = np.random.default_rng(5)
    spot = np.round(rng.normal(0, 9, (120, 2)))  # a crowd, many in one place, and a few far off
    b = np.vstack([spot, spot, np.tile([[3.0, 3.0]], (90, 1)), rng.uniform(-9e4, 9e4, (150, 2)), [[5e6, 5e6]]])
    a = np.vstack([spot[:60], rng.uniform(-1e5, 1e5, (80, 2)), [[-4e6, 1e6]]])
    d = np.sqrt((a[:, None, 0] - b[None, :, 0]) ** 2 + (a[:, None, 1] - b[None, :, 1]) ** 2)
    left, right = _points(spark, a).select("id", "x", "y"), _points(spark, b).select("id", "x", "y")
    for k in (1, 7, 600):
        want = {(i, int(j), r) for i in range(len(a)) for r, j in enumerate(np.lexsort((np.arange(len(b)), d[i]))[:k])}
        got = [(r["left_id"], r["right_id"], r["rank"]) for r in _by_radius(left, right, k).collect()]
        assert len(got) == len(want) and set(got) == want


def test_point_to_many_segments(spark, monkeypatch):
    from ridgeline.operators import nearest as N

    def crowd_pairs(*a, **k):
        raise AssertionError("all pairs within one radius")

    monkeypatch.setattr(N, "within_distance", crowd_pairs)
    monkeypatch.setattr(N, "CAPACITY", 30)
    monkeypatch.setattr(N, "TOGETHER", 50)
    rng = np.random.default_rng(6)
    s = np.hstack([xy := rng.uniform(-5e4, 5e4, (200, 2)), xy + rng.normal(0, 300, (200, 2))])
    s = np.vstack([s, s[:20, [0, 1, 0, 1]], [[-4e5, -4e5, 4e5, 3e5]]])  # some of no length, one very long
    p = np.vstack([rng.uniform(-9e4, 9e4, (150, 2)), [[3e6, 0]]])
    q, v = p[:, None] - s[None, :, :2], (s[:, 2:] - s[:, :2])[None]
    t = np.clip((q * v).sum(2) / np.maximum((v * v).sum(2), 1e-300), 0, 1)[..., None]
    want = np.sqrt(((q - t * v) ** 2).sum(2)).min(1)
    segs = spark.createDataFrame([tuple(map(float, r)) for r in s], "x0 double, y0 double, x1 double, y1 double")
    got = {r["p"]: r["distance"] for r in N._far_segments(_points(spark, p, "p"), "p", segs).collect()}
    assert len(got) == len(p) and np.allclose([got[k] for k in range(len(p))], want, rtol=1e-12)
    near = {r["p"]: r["distance"] for r in N.distance_to_segments(_points(spark, p, "p"), "p", segs).collect()}
    assert np.allclose([near[k] for k in range(len(p))], want, rtol=1e-12)
