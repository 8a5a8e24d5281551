"""Topographic prominence of every summit of a raster.

Cells are ordered by elevation, equal ones by number. Every cell points to its highest neighbour; the ends of these paths are the summits, and the cells that
end at one are its basin. Two basins meet at the highest of the lower cells of all adjacent pairs, and merging basins from the highest saddle down gives each
summit its key saddle. All but the last step is done per block, and only rims are joined.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.geo import lat_of, lon_of
from ridgeline.operators.graph import elder_merge, pointer_jump
from ridgeline.operators.raster import BLOCK, STEPS, Block, Grid, per_block, with_position
from ridgeline.session import cut, numbered

#: Metres in a foot, and the least prominence of a peak (250 ft) in metres. Fixed values.
FOOT = 0.3048
LEAST_PROMINENCE = 250 * FOOT


def _basins(neighbours: int):
    def kernel(b: Block, table: pa.Table) -> pa.Table:
        n = b.shape[1]
        flat = np.arange(b.z.size).reshape(b.shape)
        z = np.where(b.valid, b.z, -np.inf)
        top_z, top_id, up = z.copy(), b.ids.copy(), flat.copy()
        for k in range(neighbours):
            nz, ni = b.shift(z, STEPS[k], -np.inf), b.shift(b.ids, STEPS[k], -1)
            higher = (nz > top_z) | ((nz == top_z) & (ni > top_id))
            top_z, top_id = np.where(higher, nz, top_z), np.where(higher, ni, top_id)
            up = np.where(higher, flat + STEPS[k][0] * n + STEPS[k][1], up)
        up = np.where(b.own & b.valid, up, flat)  # what lies in another block is an end here
        root = b.ids.ravel()[b.compress(up)]
        own = b.own & b.valid
        summit = own & (up == flat)
        rim = b.ring & b.valid
        parts = [
            pd.DataFrame({"kind": 0, "a": b.ids[rim], "b": root[rim], "z": 0.0, "cell": 0}),
            pd.DataFrame({"kind": 2, "a": b.ids[summit], "b": 0, "z": b.z[summit], "cell": 0}),
        ]
        pairs = []
        for k in range(neighbours):
            ok = own & b.shift(b.valid, STEPS[k], False)
            ra, rb = root[ok], b.shift(root, STEPS[k], -1)[ok]
            za, zb, ia, ib = z[ok], b.shift(z, STEPS[k], -np.inf)[ok], b.ids[ok], b.shift(b.ids, STEPS[k], -1)[ok]
            low = (za < zb) | ((za == zb) & (ia < ib))
            differ = ra != rb
            pairs.append(pd.DataFrame({"a": np.minimum(ra, rb), "b": np.maximum(ra, rb), "z": np.where(low, za, zb), "cell": np.where(low, ia, ib)})[differ])
        e = pd.concat(pairs).sort_values(["a", "b", "z", "cell"]).drop_duplicates(["a", "b"], keep="last")
        parts.append(e.assign(kind=1)[["kind", "a", "b", "z", "cell"]])
        out = pd.concat(parts).astype({"kind": "int32", "a": "int64", "b": "int64", "z": "float32", "cell": "int64"})
        return pa.Table.from_pandas(out, preserve_index=False)

    return kernel


def summits_and_saddles(cells: DataFrame, grid: Grid, neighbours: int = 8, size: int = BLOCK) -> DataFrame:
    """cell, elev, saddle_cell, saddle_elev of every summit; no saddle for the highest of a connected part."""
    found = cut(per_block(cells.filter("elev IS NOT NULL"), grid, _basins(neighbours), "kind int, a long, b long, z float, cell long", size))
    rims = pointer_jump(found.filter("kind = 0").select(F.col("a").alias("cell"), F.col("b").alias("ptr")))
    e = found.filter("kind = 1").select("a", "b", "z", "cell")
    for side in ("a", "b"):
        e = e.join(rims.select(F.col("cell").alias(side), F.col("ptr").alias("_r")), side, "left").withColumn(side, F.coalesce("_r", side)).drop("_r")
    e = e.filter("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max(F.struct("z", "cell")).alias("s")).select("a", "b", "s.z", "s.cell")
    return elder_merge(found.filter("kind = 2").select(F.col("a").alias("cell"), F.col("z").alias("elev")), e)


def prominence(cells: DataFrame, grid: Grid, least: float | None = None, neighbours: int = 8, size: int = BLOCK) -> DataFrame:
    """cell, elev, prom, saddle_cell (NULL for the highest of a connected part), frame_limited. The highest summit of a part is measured from the lowest cell of
    the raster. least: the least prominence kept, inclusive."""
    ends = summits_and_saddles(cells, grid, neighbours, size)
    lowest = cells.agg(F.min("elev").alias("lowest"))
    out = ends.join(F.broadcast(lowest), how="cross").select(  # one row
        "cell", "elev", (F.col("elev").cast("double") - F.coalesce("saddle_elev", "lowest").cast("double")).alias("prom"), "saddle_cell", F.col("saddle_cell").isNull().alias("frame_limited")
    )
    return out if least is None else out.filter(F.col("prom") >= least)


def peak_table(cells: DataFrame, grid: Grid, least: float = LEAST_PROMINENCE, neighbours: int = 8, size: int = BLOCK) -> DataFrame:
    """Peaks with their positions and key saddles, numbered from 0 by falling prominence."""
    p = with_position(prominence(cells, grid, least, neighbours, size), grid)
    saddle = (F.expr(f"saddle_cell div {grid.ncols}"), F.col("saddle_cell") % grid.ncols)
    p = numbered(p, "peak_id", F.desc("prom"), F.col("cell"))
    return p.select(
        "peak_id", lat_of(grid.y(F.col("row"))).alias("lat"), lon_of(grid.x(F.col("col"))).alias("lon"), F.col("elev").alias("elev_m"), (F.col("elev") / FOOT).alias("elev_ft"),
        F.col("prom").alias("prom_m"), (F.col("prom") / FOOT).alias("prom_ft"), lat_of(grid.y(saddle[0])).alias("saddle_lat"), lon_of(grid.x(saddle[1])).alias("saddle_lon"), "frame_limited", "cell", "row", "col",
    )
