"""Which cells drain to a set of seeds, and which summits stand on the divide."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.operators.flood import fill_depressions
from ridgeline.operators.graph import pointer_jump
from ridgeline.operators.raster import BLOCK, Block, Grid, d8_receivers, per_block, snap_summits, window_offsets
from ridgeline.session import cut

_REACHED, _ENDED = -1, -2


def drains_to(receivers: DataFrame, seeds: DataFrame, grid: Grid, size: int = BLOCK) -> DataFrame:
    """cell, catch: whether following the receivers (cell, receiver) leads to a seed; seeds do. Paths are followed within each block first, so only cells at
    block rims take part in the pointer jumping."""
    at = seeds.select("cell").distinct().withColumn("seed", F.lit(1.0))
    cells = receivers.join(at, "cell", "left").select(
        "cell", F.expr(f"cast(cell div {grid.ncols} AS int)").alias("row"), (F.col("cell") % grid.ncols).cast("int").alias("col"), F.lit(0.0).cast("float").alias("elev"), F.col("receiver").cast("double"), F.coalesce("seed", F.lit(0.0)).alias("seed")
    )

    def kernel(b: Block, table: pa.Table) -> pa.Table:
        n = b.shape[1]
        flat = np.arange(b.z.size).reshape(b.shape)
        to = b.plane(table, "receiver", -1).astype(np.int64)
        seed = b.plane(table, "seed", 0) > 0
        own = b.own & b.valid
        row, col = to // grid.ncols - b.r0, to % grid.ncols - b.c0
        here = own & ~seed & (to != b.ids) & (to >= 0) & (row >= 0) & (row < b.shape[0]) & (col >= 0) & (col < n)
        end = b.compress(np.where(here, row * n + col, flat)).ravel()
        is_seed, in_own = seed.ravel()[end], own.ravel()[end]
        there = b.valid.ravel()[end]
        out = np.where(is_seed, _REACHED, np.where(in_own | ~there, _ENDED, b.ids.ravel()[end])).reshape(b.shape)
        return pa.table({"cell": pa.array(b.ids[own]), "ptr": pa.array(out[own]), "rim": pa.array(b.ring[own])})

    found = cut(per_block(cells, grid, kernel, "cell long, ptr long, rim boolean", size))
    ends = pointer_jump(found.filter("rim"))
    joined = found.select("cell", "ptr").join(ends.select(F.col("cell").alias("ptr"), F.col("ptr").alias("_end")), "ptr", "left")
    return joined.select("cell", (F.coalesce("_end", "ptr") == _REACHED).alias("catch"))


def catchment(cells: DataFrame, seeds: DataFrame, grid: Grid, fill: bool = True, size: int = BLOCK) -> DataFrame:
    """cell, catch of every cell with data, after filling depressions unless told not to."""
    valid = cells.filter("elev IS NOT NULL")
    ground = cut(fill_depressions(valid, grid, size)) if fill else valid
    return drains_to(d8_receivers(ground, grid, size), seeds, grid, size)


def divide_test(peaks: DataFrame, key: str, catch: DataFrame, grid: Grid, radius: int = 5) -> DataFrame:
    """For each peak (row, col): n_in and n_out, the cells of its window inside and outside the catchment; drains (any inside), on_divide (both)."""
    near = peaks.select(key, F.explode(window_offsets(F.col("row"), F.col("col"), radius, grid)).alias("w")).select(key, grid.cell(F.col("w.row"), F.col("w.col")).alias("cell"))
    counted = near.join(catch, "cell", "left").groupBy(key).agg(F.count_if("catch").alias("n_in"), F.count_if(~F.col("catch")).alias("n_out"))
    return counted.withColumns({"drains": F.col("n_in") > 0, "on_divide": (F.col("n_in") > 0) & (F.col("n_out") > 0)})


def classify_by_drainage(peaks: DataFrame, cells: DataFrame, seeds: DataFrame, grid: Grid, radius: int = 5, size: int = BLOCK) -> DataFrame:
    """peak_id, drains, on_divide, frontrow: a summit is in the first row if any cell around it drains to the seeds."""
    snapped = snap_summits(peaks, cells, grid, "peak_id")
    out = divide_test(snapped, "peak_id", cut(catchment(cells, seeds, grid, size=size)), grid, radius)
    return out.select("peak_id", "n_in", "n_out", "drains", "on_divide", F.col("drains").alias("frontrow"))
