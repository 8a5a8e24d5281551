"""Spatial joins: points within a distance of other points, and points within regions.

A bounded sample of both sides gives the driver a quadtree whose leaves hold about equally many rows. Every left point goes to the one leaf that it lies
in; every right item is copied to each leaf that its box, grown by the distance, touches. Each leaf is one group: its right items are bulk-loaded into a
packed R-tree, the left boxes probe it, and the exact test follows. A pair is reported only by the leaf that holds its reference point, the left point,
so none comes out twice. A leaf that is too full and too small to be split further is dealt into chunks on either side, and every left chunk meets every
right chunk; so one crowded place does not end up in one task. Beside the pairs themselves nothing grows faster than the input.

Rows with a NULL or non-finite coordinate have no pairs. Empty tables give no pairs. Repeated points with different ids are all paired; a repeated id
gives repeated pairs, so ids are made unique by the caller. Only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.geo import WORLD

#: Rows of either side that the tree is planned from: its shape, not its result, depends on them.
SAMPLE = 100_000
#: Rows of a side that a group is meant to hold, and the most leaves of a tree.
CAPACITY, MAX_LEAVES = 20_000, 16_384
DEPTH, FANOUT, PROBES = 26, 16, 2048
#: Edges that the exact test of regions takes at a time.
EDGES = 4_000_000


class PackedRTree:
    """A static R-tree over boxes, packed by sort-tile-recursive order; probed with many boxes at a time."""

    def __init__(self, boxes: np.ndarray):
        """boxes: n rows of min x, min y, max x, max y."""
        n = len(boxes)
        cx, cy = boxes[:, 0] + boxes[:, 2], boxes[:, 1] + boxes[:, 3]
        slabs = max(1, int(np.ceil(np.sqrt(np.ceil(n / FANOUT)))))
        rank = np.empty(n, np.int64)
        rank[np.argsort(cx, kind="stable")] = np.arange(n)
        self.items = np.lexsort((cy, rank // max(1, int(np.ceil(n / slabs)))))
        self.levels = [boxes[self.items]]
        while len(self.levels[-1]) > 1:
            at = self.levels[-1]
            starts = np.arange(0, len(at), FANOUT)
            self.levels.append(np.column_stack([np.minimum.reduceat(at[:, :2], starts), np.maximum.reduceat(at[:, 2:], starts)]))

    def probe(self, boxes: np.ndarray):
        """Blocks of (index of the probing box, index of the item) whose boxes touch."""
        for lo in range(0, len(boxes) if len(self.items) else 0, PROBES):
            part = boxes[lo : lo + PROBES]
            q, node = np.arange(len(part)), np.zeros(len(part), np.int64)
            for depth in range(len(self.levels) - 1, -1, -1):
                have = self.levels[depth]
                if depth < len(self.levels) - 1:
                    node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                    q = np.repeat(q, FANOUT)
                    inside = node < len(have)
                    q, node = q[inside], node[inside]
                b, p = have[node], part[q]
                touch = (b[:, 0] <= p[:, 2]) & (b[:, 2] >= p[:, 0]) & (b[:, 1] <= p[:, 3]) & (b[:, 3] >= p[:, 1])
                q, node = q[touch], node[touch]
            if len(q):
                yield q + lo, self.items[node]


def _spread(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = (v | (v << np.uint64(shift))) & np.uint64(mask)
    return v


@dataclass
class QuadTree:
    """Leaves as ranges of the Morton code; they cover the square without gaps."""

    x0: float
    y0: float
    side: float
    starts: np.ndarray  # first code of each leaf, ascending
    boxes: np.ndarray
    left_chunks: np.ndarray
    right_chunks: np.ndarray

    def codes(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        unit = (1 << DEPTH) / self.side
        cell = [np.clip(np.floor((v - o) * unit), 0, (1 << DEPTH) - 1) for v, o in ((x, self.x0), (y, self.y0))]
        return (_spread(cell[0]) | (_spread(cell[1]) << np.uint64(1))).astype(np.int64)

    def leaf(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, self.codes(x, y), side="right") - 1


def plan_tree(left: np.ndarray, right: np.ndarray, scale: tuple[float, float], total: tuple[int, int], least_side: float, square: tuple[float, float, float]) -> QuadTree:
    """A quadtree from samples (rows of x, y); scale: rows per sampled row of either side."""
    x0, y0, side = square
    tree = QuadTree(x0, y0, side, np.zeros(1, np.int64), np.array([[x0, y0, x0 + side, y0 + side]]), np.ones(1, np.int64), np.ones(1, np.int64))
    codes = [np.sort(tree.codes(s[:, 0], s[:, 1])) for s in (left, right)]
    room = [max(CAPACITY, t / (MAX_LEAVES / 4)) for t in total]
    leaves, stack = [], [(0, 0)]
    while stack:
        start, level = stack.pop()
        end = start + (1 << 2 * (DEPTH - level))
        n = [(np.searchsorted(c, end) - np.searchsorted(c, start)) * s for c, s in zip(codes, scale, strict=True)]
        if level < DEPTH and side / 2 ** (level + 1) >= least_side and any(k > r for k, r in zip(n, room, strict=True)):
            stack += [(start + k * ((end - start) >> 2), level + 1) for k in range(4)]
        else:
            leaves.append((start, level, *(max(1, int(np.ceil(k / (2 * r)))) for k, r in zip(n, room, strict=True))))
    leaves.sort()
    box = []
    for start, level, *_ in leaves:
        cx = cy = 0
        for b in range(DEPTH):
            cx |= ((start >> (2 * b)) & 1) << b
            cy |= ((start >> (2 * b + 1)) & 1) << b
        unit, w = side / (1 << DEPTH), side / (1 << level)
        box.append([x0 + cx * unit, y0 + cy * unit, x0 + cx * unit + w, y0 + cy * unit + w])
    boxes = np.array(box)
    edge = [boxes[:, 0] <= x0, boxes[:, 1] <= y0, boxes[:, 2] >= x0 + side, boxes[:, 3] >= y0 + side]
    for k, at in enumerate(edge):  # points beyond the square are counted to the leaves at its edge
        boxes[at, k] = -1e300 if k < 2 else 1e300
    return QuadTree(x0, y0, side, np.array([a for a, *_ in leaves], np.int64), boxes, *(np.array([v[k] for v in leaves], np.int64) for k in (2, 3)))


def _mix(v: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        v = v.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((v ^ (v >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(33)


def _deal(rows: np.ndarray, leaf: np.ndarray, ids: np.ndarray, own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, ...]:
    """A row's own chunk by its id, and a copy of it for every chunk of the other side."""
    n = other[leaf]
    k = np.repeat(np.arange(len(rows)), n)
    far = np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
    mine = (_mix(ids[rows]) % own[leaf].astype(np.uint64)).astype(np.int64)
    return rows[k], leaf[k], mine[k], far


_GROUP = "leaf long, lc long, rc long"


def _sample(df: DataFrame, n: int, cols: tuple[str, str]) -> tuple[np.ndarray, float]:
    share = min(1.0, SAMPLE / max(1, n))
    rows = df.select(*cols).sample(share, seed=7).toPandas() if share < 1 else df.select(*cols).toPandas()
    return rows.to_numpy(float).reshape(-1, 2), n / max(1, len(rows))


def _finite(*cols):
    out = F.lit(True)
    for c in cols:
        out = out & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(1e300))
    return out


def _pairs(left: DataFrame, right: DataFrame, right_schema: str, grow: float, square, least_side: float, refine, out: str, extra: str | None) -> DataFrame:
    """left: id, x, y; right: id, x0, y0, x1, y1 and perhaps one more column. refine(left arrays, right table, pairs) gives the mask and the value of the pairs that hold."""
    counts = [df.agg(F.count(F.lit(1))).first()[0] for df in (left, right)]
    middle = right.select(((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    (ls, lk), (rs, rk) = _sample(left, counts[0], ("x", "y")), _sample(middle, counts[1], ("x", "y"))
    tree = plan_tree(ls, rs, (lk, rk), tuple(counts), least_side, square)

    def to_left(batches):
        for b in batches:
            ids, x, y = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            rows, leaf, lc, rc = _deal(np.arange(len(ids)), tree.leaf(x, y), ids, tree.left_chunks, tree.right_chunks)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (leaf, lc, rc, ids[rows], x[rows], y[rows])], ["leaf", "lc", "rc", "id", "x", "y"])

    over = PackedRTree(tree.boxes)

    def to_right(batches):
        for b in batches:
            ids, x0, y0, x1, y1 = (b.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            boxes = np.column_stack([x0 - grow, y0 - grow, x1 + grow, y1 + grow])
            for q, leaf in over.probe(boxes):
                rows, leaf, rc, lc = _deal(q, leaf, ids, tree.right_chunks, tree.left_chunks)
                rest = b.select(b.schema.names).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(lc), pa.array(rc), *rest.columns], ["leaf", "lc", "rc", *b.schema.names])

    def probe(lt: pa.Table, rt: pa.Table) -> pa.Table:
        lid, x, y = (lt[c].to_numpy() for c in ("id", "x", "y"))
        rid = rt["id"].to_numpy()
        found = [], [], []
        if len(lid) and len(rid):
            index = PackedRTree(np.column_stack([rt[c].to_numpy() for c in ("x0", "y0", "x1", "y1")]))
            probing = np.column_stack([x - grow, y - grow, x + grow, y + grow])
            for q, item in index.probe(probing):
                held, value = refine(x, y, rt, q, item)
                for to, v in zip(found, (lid[q[held]], rid[item[held]], value), strict=True):
                    to.append(v)
        a, b, v = (np.concatenate(f) if f else np.zeros(0) for f in found)
        cols = [pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))]
        names = ["left_id", "right_id"]
        if extra:
            cols.append(pa.array(v.astype(float)))
            names.append(extra)
        return pa.table(cols, names=names)

    a = left.mapInArrow(to_left, f"{_GROUP}, id long, x double, y double").groupBy("leaf", "lc", "rc")
    b = right.mapInArrow(to_right, f"{_GROUP}, {right_schema}").groupBy("leaf", "lc", "rc")
    return a.cogroup(b).applyInArrow(probe, out)


def within_distance(left: DataFrame, left_id: str, right: DataFrame, right_id: str, radius: float, x: str = "x", y: str = "y") -> DataFrame:
    """Pairs (left_id, right_id, distance) of points at most `radius` apart in the plane. Ids are integers; both sides name their coordinates alike."""
    a = left.select(left[left_id].cast("long").alias("id"), left[x].cast("double").alias("x"), left[y].cast("double").alias("y")).filter(_finite(F.col("x"), F.col("y")) & F.col("id").isNotNull())
    b = right.select(right[right_id].cast("long").alias("id"), right[x].cast("double").alias("x0"), right[y].cast("double").alias("y0")).filter(_finite(F.col("x0"), F.col("y0")) & F.col("id").isNotNull())
    b = b.select("id", "x0", "y0", F.col("x0").alias("x1"), F.col("y0").alias("y1"))

    def refine(px, py, rt, q, item):
        d = np.hypot(px[q] - rt["x0"].to_numpy()[item], py[q] - rt["y0"].to_numpy()[item])
        return d <= radius, d[d <= radius]

    return _pairs(a, b, "id long, x0 double, y0 double, x1 double, y1 double", radius, (-WORLD, -WORLD, 2 * WORLD), max(2 * radius, 1e-6), refine, "left_id long, right_id long, distance double", "distance")


def _edges(rt: pa.Table) -> tuple[np.ndarray, ...]:
    """The edges of all regions one after the other (x1, y1, x2, y2), where each region's begin and how many it has. Rings of fewer than three points have none."""
    xs, ys, sizes = (rt[k].combine_chunks() for k in ("xs", "ys", "sizes"))
    x, y, n = (c.flatten().to_numpy(zero_copy_only=False) for c in (xs, ys, sizes))
    rings = np.diff(sizes.offsets.to_numpy())
    n = n.astype(np.int64)
    start = np.cumsum(n) - n
    last = start + n - 1
    to = np.arange(len(x)) + 1
    to[last[n > 0]] = start[n > 0]
    real = np.repeat(n >= 3, n)
    count = np.bincount(np.repeat(np.arange(len(rings)), rings), weights=np.where(n >= 3, n, 0), minlength=len(rings)).astype(np.int64)
    return x[real], y[real], x[to][real], y[to][real], np.cumsum(count) - count, count


def within_regions(points: DataFrame, point_id: str, regions: DataFrame, region_id: str, rings: str, x: str = "x", y: str = "y", square: tuple[float, float, float] = (-180.0, -180.0, 360.0)) -> DataFrame:
    """Pairs (left_id, right_id) of a point and a region that holds it, by the even-odd rule over all rings (array of arrays of struct x, y); rings close by themselves. Regions with fewer than three points hold nothing."""
    a = points.select(points[point_id].cast("long").alias("id"), points[x].cast("double").alias("x"), points[y].cast("double").alias("y")).filter(_finite(F.col("x"), F.col("y")) & F.col("id").isNotNull())
    b = regions.select(regions[region_id].cast("long").alias("id"), regions[rings].alias("rings")).filter(F.col("id").isNotNull() & F.col("rings").isNotNull())
    xs = F.flatten(F.transform("rings", lambda r: F.transform(r, lambda p: p["x"].cast("double"))))
    ys = F.flatten(F.transform("rings", lambda r: F.transform(r, lambda p: p["y"].cast("double"))))
    b = b.select("id", F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"), xs.alias("xs"), ys.alias("ys"), F.transform("rings", F.size).alias("sizes"))
    b = b.filter(_finite(*(F.col(c) for c in ("x0", "y0", "x1", "y1"))))

    def refine(px, py, rt, q, item):
        x1, y1, x2, y2, first, count = _edges(rt)
        held, work = np.zeros(len(q), bool), np.cumsum(count[item])
        lo = 0
        while lo < len(q):  # so many pairs at a time as have EDGES edges
            hi = max(lo + 1, int(np.searchsorted(work, (work[lo - 1] if lo else 0) + EDGES, "right")))
            n = count[item[lo:hi]]
            pair = np.repeat(np.arange(hi - lo), n)
            e = np.repeat(first[item[lo:hi]] - np.cumsum(n) + n, n) + np.arange(len(pair))
            x, y = px[q[lo:hi]][pair], py[q[lo:hi]][pair]
            cross = (y1[e] > y) != (y2[e] > y)
            e, x, y, pair = e[cross], x[cross], y[cross], pair[cross]
            right = x < (x2[e] - x1[e]) * (y - y1[e]) / (y2[e] - y1[e]) + x1[e]
            held[lo:hi] = np.bincount(pair[right], minlength=hi - lo) % 2 == 1
            lo = hi
        return held, np.zeros(held.sum())

    return _pairs(a, b, "id long, x0 double, y0 double, x1 double, y1 double, xs array<double>, ys array<double>, sizes array<int>", 0.0, square, 1e-4, refine, "left_id long, right_id long", None)


