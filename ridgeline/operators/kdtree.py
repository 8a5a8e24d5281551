"""Rows dealt into leaves of about equally many by a k-d tree, and the arrays that each leaf is searched with.

A bounded sample gives the driver the tree. Its regions cover the plane, so every point has one home leaf; what a leaf holds may reach beyond its region, so a
search is told by the box around what is really there which leaves it must see.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from ridgeline.operators.spatial_join import PackedRTree

#: Searching points that are looked up together, and distances that are held at a time.
GROUP, HOLD = 48, 2_000_000


@dataclass
class Leaves:
    """Inner nodes as (axis, cut, node below, node above); a negative node is leaf -1 - node."""

    axis: np.ndarray
    cut: np.ndarray
    below: np.ndarray
    above: np.ndarray
    n: int

    @classmethod
    def plan(cls, xy: np.ndarray, most: float) -> Leaves:
        """Leaves of at most `most` sampled points, or of points in one place."""
        nodes: list[list] = []
        count, stack = 0, [(np.arange(len(xy)), -1, 0)]
        while stack:
            rows, parent, side = stack.pop()
            place, p = -1, xy[rows]
            if len(rows) > max(most, 1):
                spread = p.max(0) - p.min(0)
                a = int(spread.argmax())
                if spread[a] > 0:
                    v = np.sort(p[:, a])
                    at = v[(len(v) - 1) // 2]
                    at = at if at < v[-1] else v[np.searchsorted(v, at) - 1]
                    place = len(nodes)
                    nodes.append([a, at, 0, 0])
                    stack += [(rows[p[:, a] <= at], place, 2), (rows[p[:, a] > at], place, 3)]
            if place < 0:
                place, count = -1 - count, count + 1
            if parent >= 0:
                nodes[parent][side] = place
        a, c, lo, hi = (np.array([v[k] for v in nodes], float if k == 1 else np.int64) for k in range(4))
        return cls(a, c, lo, hi, count)

    def of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The home leaf of each point."""
        at = np.full(len(x), 0 if len(self.axis) else -1, np.int64)
        while (open_ := np.flatnonzero(at >= 0)).size:
            k = at[open_]
            v = np.where(self.axis[k] == 0, x[open_], y[open_])
            at[open_] = np.where(v <= self.cut[k], self.below[k], self.above[k])
        return -1 - at


def runs(xy: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of points in which runs of at most `size` (and more than half of that, where there are so many) lie together, and where each run begins."""
    order, starts, stack = np.arange(len(xy)), [], [(0, len(xy))]
    while stack:
        lo, hi = stack.pop()
        if hi - lo <= size:
            starts.append(lo)
            continue
        part, mid = order[lo:hi], (hi - lo) // 2
        p = xy[part]
        order[lo:hi] = part[np.argpartition(p[:, int((p.max(0) - p.min(0)).argmax())], mid)]
        stack += [(lo, lo + mid), (lo + mid, hi)]
    return order, np.sort(np.array(starts, np.int64))


def least(box: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """The least distance between boxes (min x, min y, max x, max y)."""
    dx = np.maximum(np.maximum(boxes[..., 0] - box[..., 2], box[..., 0] - boxes[..., 2]), 0)
    dy = np.maximum(np.maximum(boxes[..., 1] - box[..., 3], box[..., 1] - boxes[..., 3]), 0)
    return np.sqrt(dx * dx + dy * dy)


def most(box: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """The greatest distance between points of two boxes."""
    dx = np.maximum(boxes[..., 2] - box[..., 0], box[..., 2] - boxes[..., 0])
    dy = np.maximum(boxes[..., 3] - box[..., 1], box[..., 3] - boxes[..., 1])
    return np.sqrt(dx * dx + dy * dy)


def beyond(d: np.ndarray | float) -> np.ndarray | float:
    """A distance with room for rounding, for bounds only."""
    return d * (1 + 1e-9) + 1e-9


class Buckets:
    """Items (boxes) in runs that lie together, with the box around each run."""

    def __init__(self, boxes: np.ndarray, size: int):
        self.order, self.starts = runs((boxes[:, :2] + boxes[:, 2:]) / 2, size)
        self.n = np.diff(np.append(self.starts, len(boxes)))
        b = boxes[self.order]
        self.boxes = np.column_stack([np.minimum.reduceat(b[:, :2], self.starts), np.maximum.reduceat(b[:, 2:], self.starts)])

    def items(self, which: np.ndarray) -> np.ndarray:
        """Places in `order` of the items of buckets, one after the other."""
        n = self.n[which]
        return np.repeat(self.starts[which] - np.cumsum(n) + n, n) + np.arange(n.sum())


def together(px: np.ndarray, py: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Points in groups that lie together: their numbers and the box around them."""
    order, starts = runs(np.column_stack([px, py]), GROUP)
    for rows in np.split(order, starts[1:]) if len(px) else ():
        x, y = px[rows], py[rows]
        yield rows, np.array([x.min(), y.min(), x.max(), y.max()])


class NearestPoints:
    """Finds the k points nearest to others, the smaller id among equals. Of points in one place only the k of smallest id can be among them."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, y: np.ndarray, k: int):
        order = np.lexsort((ids, y, x))
        ids, x, y = ids[order], x[order], y[order]
        new = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(x) else np.zeros(0, np.int64)
        held = np.arange(len(x)) - np.repeat(new, np.diff(np.append(new, len(x)))) < k
        self.ids, self.x, self.y, self.k = ids[held], x[held], y[held], min(k, int(held.sum()))
        if self.k:
            self.b = Buckets(np.column_stack([self.x, self.y, self.x, self.y]), max(64, 2 * k))
            self.ids, self.x, self.y = self.ids[self.b.order], self.x[self.b.order], self.y[self.b.order]

    def _distances(self, px: np.ndarray, py: np.ndarray, at: np.ndarray) -> np.ndarray:
        dx, dy = px[:, None] - self.x[at], py[:, None] - self.y[at]
        return np.sqrt(dx * dx + dy * dy)

    def _kth(self, d: np.ndarray) -> np.ndarray:
        return np.partition(d, self.k - 1, axis=1)[:, self.k - 1]

    def bounds(self, px: np.ndarray, py: np.ndarray, k: int) -> np.ndarray:
        """A distance within which each point has k of these, from one bucket; infinity if there are fewer."""
        out = np.full(len(px), np.inf)
        if self.k >= k > 0:
            for rows, box in together(px, py):
                out[rows] = self._first(px[rows], py[rows], box)
        return out

    def _first(self, px: np.ndarray, py: np.ndarray, box: np.ndarray) -> np.ndarray:
        far = np.where(self.b.n >= self.k, most(box, self.b.boxes), np.inf)
        return self._kth(self._distances(px, py, self.b.items(far.argmin(keepdims=True))))

    def find(self, px: np.ndarray, py: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Blocks of (number of the searching point, id found, distance, rank)."""
        for rows, box in together(px, py) if self.k else ():
            limit = beyond(self._first(px[rows], py[rows], box).max())
            at = self.b.items(np.flatnonzero(least(box, self.b.boxes) <= limit))
            for part in np.array_split(rows, min(len(rows), 1 + len(rows) * len(at) // HOLD)):
                d = self._distances(px[part], py[part], at)
                row, col = np.nonzero(d <= self._kth(d)[:, None])
                ids, dist = self.ids[at[col]], d[row, col]
                order = np.lexsort((ids, dist, row))
                row, ids, dist = row[order], ids[order], dist[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                ok = rank < self.k
                yield part[row[ok]], ids[ok], dist[ok], rank[ok].astype(np.int32)


class NearestSegment:
    """The least distance of points to segments (x0, y0, x1, y1). Each may be given more than once, with the boxes of pieces of it."""

    def __init__(self, segments: np.ndarray, boxes: np.ndarray):
        self.n = len(segments)
        if self.n:
            self.b = Buckets(boxes, 16)
            s = segments[self.b.order]
            self.ax, self.ay, self.vx, self.vy = s[:, 0], s[:, 1], s[:, 2] - s[:, 0], s[:, 3] - s[:, 1]
            self.nn = np.maximum(self.vx * self.vx + self.vy * self.vy, 1e-300)

    def _distances(self, px: np.ndarray, py: np.ndarray, at: np.ndarray) -> np.ndarray:
        qx, qy, vx, vy = px - self.ax[at], py - self.ay[at], self.vx[at], self.vy[at]
        t = np.clip((qx * vx + qy * vy) / self.nn[at], 0, 1)
        dx, dy = qx - t * vx, qy - t * vy
        return np.sqrt(dx * dx + dy * dy)

    def _better(self, best: np.ndarray, px: np.ndarray, py: np.ndarray, row: np.ndarray, bucket: np.ndarray) -> None:
        """Meets points (row, ascending) with the items of buckets."""
        work, lo = np.cumsum(self.b.n[bucket]), 0
        while lo < len(row):
            hi = max(lo + 1, int(np.searchsorted(work, (work[lo - 1] if lo else 0) + HOLD, "right")))
            k = bucket[lo:hi]
            n = self.b.n[k]
            who = np.repeat(row[lo:hi], n)
            d = self._distances(px[who], py[who], self.b.items(k))
            first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
            best[who[first]] = np.minimum(best[who[first]], np.minimum.reduceat(d, first))
            lo = hi

    def find(self, px: np.ndarray, py: np.ndarray) -> np.ndarray:
        """The distance of each point; infinity without segments."""
        out = np.full(len(px), np.inf)
        for rows, box in together(px, py) if self.n else ():
            x, y = px[rows], py[rows]
            points, best, k = np.column_stack([x, y, x, y])[:, None], np.full(len(rows), np.inf), np.arange(len(rows))
            self._better(best, x, y, k, np.full(len(rows), most(box, self.b.boxes).argmin()))
            near = np.flatnonzero(least(box, self.b.boxes) <= beyond(best.max()))
            for part in np.array_split(k, min(len(k), 1 + len(k) * len(near) // HOLD)) if len(near) else ():  # none where another piece of the segment found lies nearest
                gap = least(points[part], self.b.boxes[near])
                self._better(best, x, y, part, near[gap.argmin(1)])
                row, col = np.nonzero(gap <= beyond(best[part])[:, None])
                self._better(best, x, y, part[row], near[col])
            out[rows] = best
        return out


def touching(px: np.ndarray, py: np.ndarray, bound: np.ndarray, boxes: np.ndarray, enough: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (number of the point, leaf), all of a point in one: leaves whose boxes lie within each point's bound. A point without one takes that of the leaf which has `enough`
    and ends nearest. Leaves that hold nothing have no box."""
    some = np.flatnonzero(boxes[:, 0] <= boxes[:, 2])
    bound = bound.copy()
    for k in np.flatnonzero(~np.isfinite(bound)):
        bound[k] = min((most(np.array([px[k], py[k], px[k], py[k]]), boxes[enough]).min() if enough.any() else np.inf), 1e300)
    far = beyond(bound)
    for q, item in PackedRTree(boxes[some]).probe(np.column_stack([px - far, py - far, px + far, py + far])):
        leaf = some[item]
        near = least(np.column_stack([px[q], py[q], px[q], py[q]]), boxes[leaf]) <= far[q]
        yield q[near], leaf[near]


def blocks(batches: Iterator[pa.RecordBatch], rows: int, run: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Runs a generator over Arrow batches put together until they have so many rows: points that lie together are looked up together."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield from run(pa.Table.from_batches(held))
            held, n = [], 0
    if n:
        yield from run(pa.Table.from_batches(held))
