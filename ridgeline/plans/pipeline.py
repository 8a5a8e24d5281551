"""The whole run: elevation tiles to peaks, names, cross-check, route, first-row test and exports; every stage is kept under a hash of its parameters and inputs."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions.geo import mercator_x, mercator_y
from ridgeline.operators import raster as R
from ridgeline.operators.ascent import classify_by_ascent, classify_by_ceiling
from ridgeline.operators.drainage import classify_by_drainage
from ridgeline.operators.nearest import nearest_within
from ridgeline.operators.profile import classify_by_profile, segments_of, stations
from ridgeline.operators.prominence import LEAST_PROMINENCE, peak_table
from ridgeline.operators.report import class_counts, cross_check, prominence_bands
from ridgeline.sinks.exports import export_files, write_app, write_report
from ridgeline.sources.features import named, projected, route
from ridgeline.sources.peak_list import in_corridor, parse_peak_list
from ridgeline.sources.tiles import grid_of, tile_extent


@dataclass(frozen=True)
class Settings:
    """What the results depend on."""

    box: tuple[float, float, float, float] = (-122.40, 46.75, -119.80, 47.75)
    zoom: int = 12
    tile: int = 256
    least_prom_m: float = LEAST_PROMINENCE
    tolerance_m: float = 76.2
    method: str = "profile"  # or ascent, ceiling, drainage
    neighbours: int = 8
    name_radius: float = 200.0
    match_radius: float = 300.0
    station_step: float = 200.0
    candidates: int = 30
    block: int = field(default=R.BLOCK)


def materialize(spark: SparkSession, folder: str, stage: str, depends: object, make: Callable[[], DataFrame], overwrite: bool = False) -> DataFrame:
    """A stage's table: read if it was written under the same parameters, else made and written. Half-written folders have no _SUCCESS mark and do not count."""
    key = hashlib.sha256(json.dumps(depends, sort_keys=True, default=str).encode()).hexdigest()[:16]
    path = f"{folder}/{stage}-{key}"
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if overwrite or not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def fingerprint(rows: DataFrame) -> str:
    """What tells a table's content from another's, whatever the order of its rows: its columns, the number of its rows and two sums of their hashes. Reads it once."""
    text = F.to_json(F.struct(*(F.sort_array(F.map_entries(c)) if kind.startswith("map<") else F.col(c) for c, kind in ((f"`{c}`", k) for c, k in rows.dtypes))))
    h = rows.select(F.xxhash64(text).alias("a"), F.xxhash64(text, F.lit(1)).alias("b"))
    n, a, b = h.agg(F.count(F.lit(1)), *(F.sum(F.col(c).cast("decimal(38,0)")) for c in ("a", "b"))).first()
    return f"{rows.dtypes} {n} {a} {b}"


def elevation(tiles: DataFrame, s: Settings) -> tuple[DataFrame, R.Grid]:
    """Cells and grid of the mosaic of tiles (x, y, z_m ARRAY<FLOAT>); implausible heights and no-data are NULL."""
    g = grid_of(s.box, s.zoom)
    x0, y0, x1, y1 = tile_extent(s.box, s.zoom)
    scale = 256 / s.tile
    grid = R.Grid((y1 - y0 + 1) * s.tile, (x1 - x0 + 1) * s.tile, g.x0, g.y0, g.dx * scale, g.dy * scale)
    cells = R.mosaic(tiles.select("x", "y", F.col("z_m").alias("z")), x0, y0, s.tile)
    return cells.select(grid.cell(F.col("row"), F.col("col")).alias("cell"), "row", "col", R.mask_implausible(F.col("elev")).alias("elev")), grid


def attach_names(peaks: DataFrame, features: DataFrame, radius: float) -> DataFrame:
    """Adds the name of the nearest named feature (osm_id, name, lon, lat) within the radius; empty where there is none."""
    xy = {"x": mercator_x(F.col("lon")), "y": mercator_y(F.col("lat"))}
    feats = named(features).withColumns(xy)
    near = nearest_within(peaks.withColumns(xy), "peak_id", feats, "osm_id", radius)
    return peaks.join(near.join(feats.select("osm_id", "name"), "osm_id").select("peak_id", "name"), "peak_id", "left").withColumn("name", F.coalesce("name", F.lit("")))


def classify(peaks: DataFrame, cells: DataFrame, road: DataFrame, grid: R.Grid, s: Settings) -> tuple[DataFrame, DataFrame | None]:
    """peaks with frontrow and what else the chosen method tells, and the details of profiles."""
    segs = projected(segments_of(road, "parts", "name"))
    if s.method == "profile":
        at = stations(segs, s.station_step, "name").select(F.xxhash64("part", "seg", "d").alias("cand_id"), "x", "y").distinct()
        d = classify_by_profile(peaks.withColumns({"x": mercator_x(F.col("lon")), "y": mercator_y(F.col("lat"))}), cells, at, grid, s.tolerance_m, s.candidates)
        return peaks.join(d.select("peak_id", "frontrow"), "peak_id"), d.drop("frontrow")
    px = lambda c: (F.col(c) - grid.x0) / grid.dx
    py = lambda c: (F.lit(grid.y0) - F.col(c)) / grid.dy
    seeds = R.rasterize(segs.select(px("x0").alias("x0"), py("y0").alias("y0"), px("x1").alias("x1"), py("y1").alias("y1")), grid).select("cell").distinct()
    at = peaks.select("peak_id", "row", "col")
    if s.method == "ascent":
        return peaks.join(classify_by_ascent(at, cells, seeds, grid, s.tolerance_m, s.block), "peak_id"), None
    if s.method == "ceiling":
        return peaks.join(classify_by_ceiling(at, cells, seeds, grid, s.block), "peak_id"), None
    if s.method == "drainage":
        return peaks.join(classify_by_drainage(at, cells, seeds, grid, size=s.block), "peak_id"), None
    raise ValueError(f"unknown method {s.method}")


def run(spark: SparkSession, tiles: DataFrame, features: DataFrame, ways: DataFrame, reference: DataFrame, folder: str, s: Settings = Settings(), overwrite: bool = False) -> dict:  # noqa: B008
    """Run all stages. tiles: x, y, z_m; features: osm_id, name, lon, lat; ways: like osm_ways; reference: lines of the peak list (value). Gives the classified
    peaks, the cross-check and the paths of the exports."""
    cells, grid = elevation(tiles, s)
    base = (s.box, s.zoom, s.tile, fingerprint(tiles.select("x", "y", "z_m")))
    roads = ("I 90", fingerprint(ways))
    cells = materialize(spark, folder, "elevation", base, lambda: cells, overwrite)
    peaks = materialize(spark, folder, "peaks", (base, s.least_prom_m, s.neighbours), lambda: peak_table(cells, grid, s.least_prom_m, s.neighbours, s.block), overwrite)
    peaks = attach_names(peaks, features, s.name_radius)
    xy = {"x": mercator_x(F.col("lon")), "y": mercator_y(F.col("lat"))}
    listed = in_corridor(parse_peak_list(reference, "value"), s.box).withColumns({"peak_id": F.monotonically_increasing_id(), **xy})
    checked = cross_check(peaks.withColumns(xy), listed, s.match_radius)
    road = materialize(spark, folder, "route", roads, lambda: route(ways), overwrite)
    done, details = classify(peaks, cells, road, grid, s)
    done = materialize(spark, folder, "classified", (s.__dict__, base, roads, fingerprint(features)), lambda: done, overwrite)
    out = os.path.join(folder, "exports")
    paths = export_files(done, out)
    paths["report"] = write_report(os.path.join(out, "report.txt"), classes=class_counts(done), prominence_bands_ft=prominence_bands(done), cross_check=checked)
    paths["app"] = write_app(done, road, details, os.path.join(out, "app.html"))
    return {"peaks": done, "cross_check": checked, "paths": paths}
