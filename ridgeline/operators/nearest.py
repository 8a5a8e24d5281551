"""Nearest neighbours: the closest within a radius, the k closest, point to line, and the row closest to a fixed point."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridgeline.operators.kdtree import Leaves, NearestPoints, NearestSegment, blocks, touching
from ridgeline.operators.spatial_join import _finite, _mix, _sample, within_distance
from ridgeline.session import cut, ship, small

#: Candidates that every task may hold as arrays; beyond, they are dealt into the leaves of a k-d tree.
HELD = 200_000
#: Candidates that a leaf is meant to hold, and points that are looked up together.
CAPACITY, TOGETHER = 20_000, 20_000


def nearest_within(left: DataFrame, left_id: str, right: DataFrame, right_id: str, radius: float) -> DataFrame:
    """The closest right point of each left point that has one within the radius (inclusive), the smaller id among equals: left_id, right_id, distance."""
    pairs = within_distance(left, left_id, right, right_id, radius)
    best = pairs.groupBy("left_id").agg(F.min(F.struct("distance", "right_id")).alias("b"))
    return best.select(F.col("left_id").alias(left_id), F.col("b.right_id").alias(right_id), F.col("b.distance").alias("distance"))


def nearest_k(left: DataFrame, left_id: str, right: DataFrame, right_id: str, k: int) -> DataFrame:
    """The k closest right points of each left point, or all there are: left_id, right_id, distance, rank from 0; the smaller id among equals. Points without
    coordinates take no part."""
    ship(left.sparkSession)
    a, b = _located(left, left_id), _located(right, right_id)
    if small(b, HELD, 24):
        points = b.toPandas()  # at most HELD rows
        sent = left.sparkSession.sparkContext.broadcast(tuple(points[c].to_numpy() for c in ("id", "x", "y")))

        def probe(batches):
            index = NearestPoints(*sent.value, k)

            def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
                ids, px, py = (t.column(i).to_numpy() for i in range(3))
                for found in _gathered(index.find(px, py)):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[found[0]]), *map(pa.array, found[1:])], ["left_id", "right_id", "distance", "rank"])

            return blocks(batches, TOGETHER, run)

        found = a.mapInArrow(probe, _FOUND)
    else:
        found = _by_radius(a, b, k)
    return found.select(F.col("left_id").alias(left_id), F.col("right_id").alias(right_id), "distance", "rank")


_FOUND = "left_id long, right_id long, distance double, rank int"


def _located(df: DataFrame, key: str) -> DataFrame:
    """id, x, y of rows that have a place."""
    return df.select(F.col(key).cast("long").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).filter(_finite(F.col("x"), F.col("y")))


def _gathered(parts: Iterator[tuple[np.ndarray, ...]], rows: int = 200_000) -> Iterator[tuple[np.ndarray, ...]]:
    """Small blocks put together to at least so many rows."""
    held, n = [], 0
    for p in parts:
        held.append(p)
        n += len(p[0])
        if n >= rows:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _leaves(df: DataFrame, x: str, y: str) -> Leaves:
    n = df.count()
    rows, scale = _sample(df, n, (x, y))
    return Leaves.plan(rows, CAPACITY / scale)


def _extent(held: DataFrame, tree: Leaves, box: tuple[str, str, str, str]) -> tuple[np.ndarray, np.ndarray]:
    """The box around what each leaf really holds, and how much that is; a row a leaf reaches the driver."""
    boxes, n = np.tile([np.inf, np.inf, -np.inf, -np.inf], (tree.n, 1)), np.zeros(tree.n, np.int64)
    for r in held.groupBy("leaf").agg(*(f(c) for f, c in zip((F.min, F.min, F.max, F.max), box, strict=True)), F.count(F.lit(1))).collect():
        boxes[r[0]], n[r[0]] = r[1:5], r[5]
    return boxes, n


def _meet(left: DataFrame, right: DataFrame, leaves: int, found, schema: str) -> DataFrame:
    """found(left table, right table) for each leaf; both have the columns leaf and id. The left rows of a leaf are dealt into chunks by id, each with a copy of its right rows."""
    parts = np.zeros(leaves, np.int64)
    for r in left.groupBy("leaf").count().collect():
        parts[r[0]] = -(-r[1] // TOGETHER)

    def deal(batches):
        for b in batches:
            leaf, ids = b.column("leaf").to_numpy(), b.column("id").to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((_mix(ids) % parts[leaf].astype(np.uint64)).astype(np.int32))], [*b.schema.names, "part"])

    def copies(batches):
        for b in batches:
            n = parts[b.column("leaf").to_numpy()]
            t = b.take(pa.array(np.repeat(np.arange(b.num_rows), n)))
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array((np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32))], [*b.schema.names, "part"])

    kinds = [", ".join(f"{c} {t}" for c, t in df.dtypes) + ", part int" for df in (left, right)]
    return left.mapInArrow(deal, kinds[0]).groupBy("leaf", "part").cogroup(right.mapInArrow(copies, kinds[1]).groupBy("leaf", "part")).applyInArrow(found, schema)


def _at_home(df: DataFrame, tree: Leaves, x: str = "x", y: str = "y") -> DataFrame:
    def run(batches):
        for b in batches:
            leaf = tree.of(b.column(x).to_numpy(), b.column(y).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), *b.columns], ["leaf", *b.schema.names])

    return df.mapInArrow(run, "leaf int, " + ", ".join(f"{c} {t}" for c, t in df.dtypes))


def _within_bounds(df: DataFrame, boxes: np.ndarray, enough: np.ndarray, other: bool) -> DataFrame:
    """leaf, id, x, y, alone for every leaf that a point of df (leaf, id, x, y, bound) must see, without its own if `other`. alone: it is the only one."""

    def run(batches):
        for b in batches:
            own, ids, x, y, bound = (b.column(c).to_numpy() for c in ("leaf", "id", "x", "y", "bound"))
            for row, leaf in touching(x, y, bound, boxes, enough):
                alone = np.bincount(row, minlength=len(x))[row] == 1
                if other:
                    row, leaf, alone = (v[leaf != own[row]] for v in (row, leaf, alone))
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (leaf.astype(np.int32), ids[row], x[row], y[row], alone)], ["leaf", "id", "x", "y", "alone"])

    return df.select("leaf", "id", "x", "y", "bound").mapInArrow(run, "leaf int, id long, x double, y double, alone boolean")


def _by_radius(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Exact k nearest (a, b: id, x, y): candidates in the leaves of a k-d tree; a point's home leaf bounds how far it must look, and it is met with every leaf within that. Points with one such
    leaf, nearly all, are finished there; of the others each leaf gives its best k."""
    place = W.partitionBy("x", "y").orderBy("id")
    b = cut(b.withColumn("_n", F.row_number().over(place)).filter(F.col("_n") <= k).drop("_n"))  # no more of one place can be among the nearest
    tree = _leaves(b, "x", "y")
    held, a = _at_home(b, tree), _at_home(a, tree)
    boxes, n = _extent(held, tree, ("x", "y", "x", "y"))
    need = min(k, int(n.sum()))

    def index(rt: pa.Table) -> NearestPoints:
        return NearestPoints(*(rt[c].to_numpy() for c in ("id", "x", "y")), k)

    def bound(lt: pa.Table, rt: pa.Table) -> pa.Table:
        return lt.drop_columns(["part"]).append_column("bound", pa.array(index(rt).bounds(lt["x"].to_numpy(), lt["y"].to_numpy(), need)))

    def found(lt: pa.Table, rt: pa.Table) -> pa.Table:
        ids = lt["id"].to_numpy()
        parts = [pa.table([pa.array(ids[f[0]]), *map(pa.array, f[1:])], names=["left_id", "right_id", "distance", "rank"]) for f in _gathered(index(rt).find(lt["x"].to_numpy(), lt["y"].to_numpy()))]
        return pa.concat_tables(parts) if parts else pa.table({"left_id": pa.array([], "int64"), "right_id": pa.array([], "int64"), "distance": pa.array([], "float64"), "rank": pa.array([], "int32")})

    bounded = cut(_meet(cut(a), held, tree.n, bound, "leaf int, id long, x double, y double, bound double"))
    seen = _within_bounds(bounded, boxes, n >= need, other=False)
    once, more = (_meet(seen.filter(c), held, tree.n, found, _FOUND) for c in (F.col("alone"), ~F.col("alone")))
    w = W.partitionBy("left_id").orderBy("distance", "right_id")
    more = more.withColumn("rank", (F.row_number().over(w) - 1).cast("int")).filter(F.col("rank") < need)
    return once.unionByName(more)


def distance_to_segments(points: DataFrame, point_id: str, segments: DataFrame) -> DataFrame:
    """The least distance of each point (x, y) to any of the segments (x0, y0, x1, y1): point_id, distance. Segments travel as arrays when they are few enough,
    else they are joined."""
    ship(points.sparkSession)
    pts = _located(points, point_id)
    if small(segments, HELD, 32):
        s = segments.select("x0", "y0", "x1", "y1").toPandas().to_numpy(float)  # at most HELD rows
        if not len(s):
            return pts.select(F.col("id").alias(point_id), F.lit(None).cast("double").alias("distance"))
        sent = points.sparkSession.sparkContext.broadcast(s)

        def probe(batches):
            s = sent.value
            index = NearestSegment(s, np.column_stack([np.minimum(s[:, :2], s[:, 2:]), np.maximum(s[:, :2], s[:, 2:])]))

            def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
                ids, px, py = (t.column(i).to_numpy() for i in range(3))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(index.find(px, py))], ["id", "distance"])

            return blocks(batches, TOGETHER, run)

        return pts.mapInArrow(probe, "id long, distance double").withColumnRenamed("id", point_id)
    return _far_segments(points, point_id, segments)


def _far_segments(points: DataFrame, point_id: str, segments: DataFrame) -> DataFrame:
    """Many segments lie in the leaves of a k-d tree, long ones once for every piece of about the mean length, with its box. A point's home leaf gives a distance; only leaves
    with a box within that can give a lesser one, and each gives one row."""
    length = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    segments = cut(segments.select(*(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1"))).filter(_finite(*(F.col(c) for c in ("x0", "y0", "x1", "y1")))))
    piece = segments.agg(F.avg(length)).first()[0] or 1.0
    n = F.greatest(F.lit(1), F.ceil(length / piece)).cast("int")
    s = segments.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = lambda a, b, k: F.when(F.col("i") + k == F.col("n"), F.col(b)).otherwise(F.col(a) + (F.col(b) - F.col(a)) * (F.col("i") + k) / F.col("n"))
    ends = [at(f"{c}0", f"{c}1", k) for c in "xy" for k in (0, 1)]
    s = s.select("x0", "y0", "x1", "y1", F.least(*ends[:2]).alias("w"), F.least(*ends[2:]).alias("s"), F.greatest(*ends[:2]).alias("e"), F.greatest(*ends[2:]).alias("n"))
    s = s.withColumns({"x": (F.col("w") + F.col("e")) / 2, "y": (F.col("s") + F.col("n")) / 2})
    tree = _leaves(s, "x", "y")
    held = _at_home(s, tree).drop("x", "y")
    boxes, count = _extent(held, tree, ("w", "s", "e", "n"))

    def found(lt: pa.Table, rt: pa.Table) -> pa.Table:
        index = NearestSegment(*(np.column_stack([rt[c].to_numpy() for c in cs]) for cs in (("x0", "y0", "x1", "y1"), ("w", "s", "e", "n"))))
        return lt.select(["leaf", "id", "x", "y"]).append_column("bound", pa.array(index.find(lt["x"].to_numpy(), lt["y"].to_numpy())))

    schema = "leaf int, id long, x double, y double, bound double"
    home = cut(_meet(cut(_at_home(_located(points, point_id), tree)), held, tree.n, found, schema))
    more = _meet(_within_bounds(home, boxes, count > 0, other=True), held, tree.n, found, schema)
    return home.unionByName(more).groupBy(F.col("id").alias(point_id)).agg(F.min("bound").alias("distance"))


def nearest_to_point(df: DataFrame, lat: float, lon: float) -> DataFrame:
    """The one row closest to a point, in plain degrees."""
    return df.withColumn("degrees", F.hypot(F.col("lat") - lat, F.col("lon") - lon)).filter("degrees IS NOT NULL").orderBy("degrees", "peak_id").limit(1)
