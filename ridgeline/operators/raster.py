"""Rasters as tables of cells, and what is computed on square blocks of them.

A raster is a DataFrame of cells (cell BIGINT = row * ncols + col, row INT, col INT, elev FLOAT; a missing or NULL cell has no data) with a Grid. Work on a
neighbourhood runs per block: every cell goes to its own block and, within `halo` cells of an edge, to the neighbouring ones too; so a task holds one block,
and only rims are sent twice.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Side of a block, in cells.
BLOCK = 256
#: Neighbours as (row, col) steps: first the four along the axes (N, S, W, E), then the diagonals (NW, NE, SW, SE).
STEPS = ((-1, 0), (1, 0), (0, -1), (0, 1), (-1, -1), (-1, 1), (1, -1), (1, 1))
#: Length of a diagonal step. Fixed value.
DIAGONAL = 1.41421356
NODATA, MAX_PLAUSIBLE = -32768.0, 4500.0


@dataclass(frozen=True)
class Grid:
    """Shape of a raster and the place of its north-west corner and cells, in projected metres."""

    nrows: int
    ncols: int
    x0: float = 0.0
    y0: float = 0.0
    dx: float = 1.0
    dy: float = 1.0

    def x(self, col: Column) -> Column:
        """Easting of a cell's centre."""
        return F.lit(self.x0) + (col + 0.5) * self.dx

    def y(self, row: Column) -> Column:
        """Northing of a cell's centre."""
        return F.lit(self.y0) - (row + 0.5) * self.dy

    def col(self, x: Column) -> Column:
        """Column of an easting, kept within the raster."""
        return F.greatest(F.lit(0), F.least(F.lit(self.ncols - 1), F.floor((x - self.x0) / self.dx))).cast("int")

    def row(self, y: Column) -> Column:
        """Row of a northing, kept within the raster."""
        return F.greatest(F.lit(0), F.least(F.lit(self.nrows - 1), F.floor((F.lit(self.y0) - y) / self.dy))).cast("int")

    def cell(self, row: Column, col: Column) -> Column:
        """Number of a cell."""
        return row.cast("long") * self.ncols + col


def decode_terrarium(r: Column, g: Column, b: Column) -> Column:
    """Elevation in metres of a terrarium pixel."""
    return (r * 256 + g + b / 256 - 32768).cast("float")


def mask_implausible(elev: Column, limit: float = MAX_PLAUSIBLE) -> Column:
    """NULL for no-data and for heights above the limit."""
    return F.when((elev <= limit) & (elev != NODATA), elev)


def with_position(cells: DataFrame, grid: Grid) -> DataFrame:
    """Adds row and col to cells known by number."""
    return cells.withColumns({"row": F.expr(f"cast(cell div {grid.ncols} AS int)"), "col": (F.col("cell") % grid.ncols).cast("int")})


def mosaic(tiles: DataFrame, x_min: int, y_min: int, size: int = 256) -> DataFrame:
    """Cells of a mosaic from tiles (x, y, z ARRAY<FLOAT> row by row): row, col, elev. Nothing is copied; uncovered cells are absent."""
    flat = tiles.select("x", "y", F.posexplode("z").alias("i", "elev"))
    return flat.select(((F.col("y") - y_min) * size + F.expr(f"i div {size}")).cast("int").alias("row"), ((F.col("x") - x_min) * size + F.col("i") % size).cast("int").alias("col"), "elev")


class Block:
    """One block with its halo as arrays; NaN where there is no data."""

    def __init__(self, table: pa.Table, grid: Grid, size: int, halo: int, key: tuple):
        tr, tc = (int(k.as_py()) for k in key)
        self.r0, self.c0, self.grid = tr * size - halo, tc * size - halo, grid
        n = size + 2 * halo
        self.shape = (n, n)
        row, col = table["row"].to_numpy() - self.r0, table["col"].to_numpy() - self.c0
        self.at = (row, col)
        self.z = np.full(self.shape, np.nan)
        self.z[self.at] = table["elev"].to_numpy(zero_copy_only=False).astype(float)
        r, c = np.arange(n) + self.r0, np.arange(n) + self.c0
        self.ids = r[:, None].astype(np.int64) * grid.ncols + c[None, :]
        self.inside = ((r >= 0) & (r < grid.nrows))[:, None] & ((c >= 0) & (c < grid.ncols))[None, :]
        own = np.zeros(n, bool)
        own[halo : n - halo] = True
        self.own = own[:, None] & own[None, :]
        ring = np.zeros(n, bool)
        ring[[halo, n - halo - 1]] = True
        self.ring = self.own & (ring[:, None] | ring[None, :])
        self.valid = ~np.isnan(self.z)

    def plane(self, table: pa.Table, name: str, empty: float) -> np.ndarray:
        """Another column as an array."""
        out = np.full(self.shape, empty)
        v = table[name].to_numpy(zero_copy_only=False).astype(float)
        out[self.at] = np.where(np.isnan(v), empty, v)
        return out

    @staticmethod
    def shift(a: np.ndarray, step: tuple[int, int], empty) -> np.ndarray:
        """The neighbour's value at every cell."""
        out = np.full_like(a, empty)
        (dr, dc), (n, m) = step, a.shape
        out[max(0, -dr) : n - max(0, dr), max(0, -dc) : m - max(0, dc)] = a[max(0, dr) : n + min(0, dr), max(0, dc) : m + min(0, dc)]
        return out

    def compress(self, pointer: np.ndarray) -> np.ndarray:
        """Follow local flat pointers to their ends; cells that point to themselves are ends."""
        p = pointer.ravel().copy()
        while True:
            q = p[p]
            if (q == p).all():
                return p.reshape(pointer.shape)
            p = q


def by_block(cells: DataFrame, size: int = BLOCK, halo: int = 1):
    """Cells grouped by block (tr, tc), those near an edge in several."""
    reach = sorted({-halo, 0, halo})
    places = F.array_distinct(F.array(*(F.struct(F.expr(f"(row + {a}) div {size}").alias("tr"), F.expr(f"(col + {b}) div {size}").alias("tc")) for a in reach for b in reach)))
    placed = cells.withColumn("t", F.explode(F.filter(places, lambda t: (t["tr"] >= 0) & (t["tc"] >= 0)))).withColumns({"tr": F.col("t.tr"), "tc": F.col("t.tc")}).drop("t")
    return placed.groupBy("tr", "tc")


def per_block(cells: DataFrame, grid: Grid, kernel, schema: str, size: int = BLOCK, halo: int = 1) -> DataFrame:
    """Run kernel(block, table) -> arrow table on every block that has a cell of its own."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        return kernel(Block(table, grid, size, halo, key), table)

    return by_block(cells, size, halo).applyInArrow(run, schema)


def local_maxima(cells: DataFrame, grid: Grid, neighbours: int = 8, size: int = BLOCK) -> DataFrame:
    """Cells above all their neighbours, equal ones by the higher number: cell, elev."""

    def kernel(b: Block, table: pa.Table) -> pa.Table:
        z, top = np.where(b.valid, b.z, -np.inf), b.own & b.valid
        for k in range(neighbours):
            nz, ni = b.shift(z, STEPS[k], -np.inf), b.shift(b.ids, STEPS[k], -1)
            top &= (z > nz) | ((z == nz) & (b.ids > ni))
        return pa.table({"cell": pa.array(b.ids[top]), "elev": pa.array(b.z[top].astype(np.float32))})

    return per_block(cells, grid, kernel, "cell long, elev float", size)


def local_rim(cells: DataFrame, grid: Grid, size: int = BLOCK) -> DataFrame:
    """Cells at the raster's edge or beside one without data."""

    def kernel(b: Block, table: pa.Table) -> pa.Table:
        rim = np.zeros(b.shape, bool)
        for step in STEPS:
            rim |= ~b.shift(b.valid, step, False)
        return pa.table({"cell": pa.array(b.ids[rim & b.own & b.valid])})

    return per_block(cells, grid, kernel, "cell long", size)


def d8_receivers(cells: DataFrame, grid: Grid, size: int = BLOCK) -> DataFrame:
    """Receiver of every cell with data: the neighbour of steepest descent, the first of N, S, W, E, NW, NE, SW, SE among equals; the cell itself where
    nothing is lower. Beyond the raster everything is infinitely low and water that leaves it ends at the cell; a neighbour without data takes the water.
    An optional column `hops` orders cells of equal height: fewer hops are lower."""
    with_hops = "hops" in cells.columns

    def kernel(b: Block, table: pa.Table) -> pa.Table:
        low = np.where(b.valid, b.z, -np.inf)
        hops = b.plane(table, "hops", 0) if with_hops else np.zeros(b.shape)
        best, best_hops, to = np.zeros(b.shape), np.zeros(b.shape), b.ids.copy()
        for k, step in enumerate(STEPS):
            far = 1.0 if k < 4 else DIAGONAL
            with np.errstate(invalid="ignore"):
                drop = (b.z - b.shift(low, step, -np.inf)) / far
            down = np.where(drop == 0, (hops - b.shift(hops, step, 0)) / far, 0)
            better = (drop > best) | ((drop == best) & (best == 0) & (down > best_hops))
            inside = b.shift(b.inside, step, False)
            to = np.where(better, np.where(inside, b.shift(b.ids, step, -1), b.ids), to)
            best_hops = np.where(better, down, best_hops)
            best = np.where(better, drop, best)
        own = b.own & b.valid
        return pa.table({"cell": pa.array(b.ids[own]), "receiver": pa.array(to[own])})

    return per_block(cells, grid, kernel, "cell long, receiver long", size)


def window_offsets(row: Column, col: Column, radius: int, grid: Grid) -> Column:
    """Array of the cells (row, col) of a square window, cut at the raster's edges."""
    rows = F.sequence(F.greatest(F.lit(0), row - radius), F.least(F.lit(grid.nrows - 1), row + radius))
    cols = F.sequence(F.greatest(F.lit(0), col - radius), F.least(F.lit(grid.ncols - 1), col + radius))
    return F.flatten(F.transform(rows, lambda r: F.transform(cols, lambda c: F.struct(r.alias("row"), c.alias("col")))))


def snap_summits(peaks: DataFrame, cells: DataFrame, grid: Grid, key: str, radius: int = 3) -> DataFrame:
    """The highest cell within a window around each peak (columns row, col), the first in reading order among equals: key, row, col, elev. No data counts as low."""
    near = peaks.select(key, F.explode(window_offsets(F.col("row"), F.col("col"), radius, grid)).alias("w")).select(key, grid.cell(F.col("w.row"), F.col("w.col")).alias("cell"), "w")
    joined = near.join(cells.select("cell", "elev"), "cell", "left")
    best = F.max_by(F.struct("w.row", "w.col", "elev"), F.struct(F.coalesce("elev", F.lit(NODATA).cast("float")).alias("e"), (-F.col("w.row")).alias("r"), (-F.col("w.col")).alias("c")))
    return joined.groupBy(key).agg(best.alias("b")).select(key, "b.row", "b.col", "b.elev")


def rasterize(segments: DataFrame, grid: Grid, *carry: str) -> DataFrame:
    """Cells that line segments (x0, y0, x1, y1 in pixels: column and row as fractions) pass through, once per `carry`: those with a stretch of the segment or
    one of its ends inside. A line that only meets a corner does not touch the cells beside it."""
    a, b, c, d = (F.col(k) for k in ("x0", "y0", "x1", "y1"))

    def crossings(u: Column, v: Column) -> Column:
        lo, hi = F.ceil(F.least(u, v)), F.floor(F.greatest(u, v))
        return F.when((u != v) & (lo <= hi), F.transform(F.sequence(lo, hi), lambda k: (k - u) / (v - u))).otherwise(F.array().cast("array<double>"))

    t = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), crossings(a, c), crossings(b, d))))
    rows = segments.select(*carry, "x0", "y0", "x1", "y1", t.alias("t"))
    middles = F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda i: (F.element_at("t", i) + F.element_at("t", i + 1)) / 2)
    at = F.explode(F.concat(F.array(F.lit(0.0), F.lit(1.0)), middles))
    p = rows.select(*carry, "x0", "y0", "x1", "y1", at.alias("t"))
    p = p.select(*carry, F.floor(b + (d - b) * F.col("t")).cast("int").alias("row"), F.floor(a + (c - a) * F.col("t")).cast("int").alias("col"))
    inside = F.col("row").between(0, grid.nrows - 1) & F.col("col").between(0, grid.ncols - 1)
    return p.filter(inside).distinct().withColumn("cell", grid.cell(F.col("row"), F.col("col")))
