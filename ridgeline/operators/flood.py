"""Least paths over a raster, block by block until nothing changes.

Both rules are monotone: a lower label never leads to a higher one. So each block may run to its end from whatever labels its rim has so far, and
repeating blocks whose rim changed reaches the same least labels as one run over the whole raster.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.operators.raster import BLOCK, STEPS, Block, Grid, local_rim, per_block
from ridgeline.session import cut

_STATE = "cell long, row int, col int, elev float, mark double, hops double, changed boolean"


def _spread(b: Block, mark: np.ndarray, hops: np.ndarray, neighbours: int, tolerance: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Label-setting within a block. With a tolerance: a step may lead to a cell no lower than the mark less the tolerance. Without: any step, and hops counts
    those that do not raise the mark."""
    n = b.shape[1]
    z, m, h, valid = b.z.ravel().tolist(), mark.ravel().tolist(), hops.ravel().tolist(), b.valid.ravel().tolist()
    heap = [(m[k], h[k], k) for k in np.flatnonzero(np.isfinite(mark.ravel()) & b.valid.ravel()).tolist()]
    heapq.heapify(heap)
    size, moves = len(z), [(dr * n + dc, dc) for dr, dc in STEPS[:neighbours]]
    while heap:
        level, far, k = heapq.heappop(heap)
        if (level, far) > (m[k], h[k]):
            continue
        c = k % n
        for step, dc in moves:
            j = k + step
            if j < 0 or j >= size or not 0 <= c + dc < n or not valid[j]:
                continue
            e = z[j]
            if tolerance is not None:
                if e < level - tolerance:
                    continue
                new = (e, 0.0) if e > level else (level, 0.0)
            else:
                new = (e, 0.0) if e > level else (level, far + 1)
            if new < (m[j], h[j]):
                m[j], h[j] = new
                heapq.heappush(heap, (*new, j))
    return np.array(m).reshape(b.shape), np.array(h).reshape(b.shape)


def _fixpoint(start: DataFrame, grid: Grid, neighbours: int, tolerance: float | None, size: int, rounds: int) -> DataFrame:
    def kernel(b: Block, table: pa.Table) -> pa.Table:
        mark, hops = b.plane(table, "mark", np.inf), b.plane(table, "hops", np.inf)
        hops = np.where(np.isfinite(mark), np.where(np.isfinite(hops), hops, 0.0), np.inf)
        moved = b.plane(table, "changed", 0) > 0
        new_mark, new_hops = _spread(b, mark, hops, neighbours, tolerance) if moved.any() else (mark, hops)
        own = b.own & b.valid
        changed = (new_mark[own] != mark[own]) | (new_hops[own] != hops[own])
        row, col = np.nonzero(own)
        nul = ~np.isfinite(new_mark[own])
        return pa.table(
            {
                "cell": pa.array(b.ids[own]), "row": pa.array((row + b.r0).astype(np.int32)), "col": pa.array((col + b.c0).astype(np.int32)), "elev": pa.array(b.z[own].astype(np.float32)),
                "mark": pa.array(new_mark[own], mask=nul), "hops": pa.array(new_hops[own], mask=nul), "changed": pa.array(changed),
            }
        )

    state = start
    for _ in range(rounds):
        state = cut(per_block(state, grid, kernel, _STATE, size))
        if state.filter("changed").limit(1).isEmpty():
            return state.select("cell", "row", "col", "elev", "mark", "hops")
    raise ValueError(f"not settled after {rounds} rounds")


def reach_mark(cells: DataFrame, seeds: DataFrame, grid: Grid, tolerance: float | None = 76.2, size: int = BLOCK, rounds: int = 10_000) -> DataFrame:
    """Tolerant ascent along the four axes: cell, row, col, elev, mark. The mark of a cell is the least height that a path from a seed must climb to, where no
    step may fall more than the tolerance below the highest point so far; NULL where no path leads. tolerance None: no limit (the minimax ceiling)."""
    valid = cells.filter("elev IS NOT NULL")
    at = seeds.select("cell").distinct().withColumn("seed", F.lit(True))
    start = valid.join(at, "cell", "left").select("cell", "row", "col", "elev", F.when(F.col("seed"), F.col("elev").cast("double")).alias("mark"), F.when(F.col("seed"), 0.0).alias("hops"), F.coalesce("seed", F.lit(False)).alias("changed"))
    return _fixpoint(start, grid, 4, float("inf") if tolerance is None else float(tolerance), size, rounds).drop("hops")


def fill_depressions(cells: DataFrame, grid: Grid, size: int = BLOCK, rounds: int = 10_000) -> DataFrame:
    """Lowest level to which water must rise in every cell to leave the raster: cell, row, col, elev (the filled level), hops. Cells at the raster's edge or
    beside one without data are outlets. hops orders a filled flat: steps to where it drains."""
    valid = cells.filter("elev IS NOT NULL")
    rim = local_rim(valid, grid, size).withColumn("seed", F.lit(True))
    start = valid.join(rim, "cell", "left").select("cell", "row", "col", "elev", F.when(F.col("seed"), F.col("elev").cast("double")).alias("mark"), F.when(F.col("seed"), 0.0).alias("hops"), F.coalesce("seed", F.lit(False)).alias("changed"))
    return _fixpoint(start, grid, 8, None, size, rounds).select("cell", "row", "col", F.col("mark").cast("float").alias("elev"), "hops")
