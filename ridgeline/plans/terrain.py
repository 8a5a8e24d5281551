"""Queries of the terrain operators over the driver's tables.

There is no raster among the tables, so `embeddings` stands in for one: row = vec_id, column = place in the vector, height = floor(1000 * value). A line over
it comes from the nations in order of their keys, points from the customers. Peaks, named features and roads are the real tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridgeline.functions.geo import lat_of, lon_of, mercator_x, mercator_y
from ridgeline.functions.text import class_of, fixed, marker_radius, peak_label, whole
from ridgeline.operators import raster as R
from ridgeline.operators.ascent import classify_by_ascent, classify_by_ceiling
from ridgeline.operators.drainage import catchment, classify_by_drainage, divide_test, drains_to
from ridgeline.operators.flood import fill_depressions, reach_mark
from ridgeline.operators.nearest import distance_to_segments, nearest_k, nearest_to_point, nearest_within
from ridgeline.operators.profile import analyze, barrier_of_series, by_place, choose, classify_by_profile, judge_once, sample_cells, segments_of, shorten, station_lines, stations
from ridgeline.operators.prominence import peak_table, prominence
from ridgeline.operators.report import class_counts, cross_check, distance_quantiles, prominence_bands
from ridgeline.plans.terrain_sql import SQL  # noqa: F401
from ridgeline.session import cut, numbered, one_delivery, ship, table
from ridgeline.sinks.exports import app_feature, app_payload, feature, visible, visible_waypoint, waypoint
from ridgeline.sources.features import is_route, named, projected, road_lines, route
from ridgeline.sources.peak_list import CORRIDOR, in_corridor, parse_peak_list
from ridgeline.sources.tiles import grid_of, tile_cover

#: Columns of the raster that stands in, the side of its blocks (so that paths cross borders in both directions), the tolerance.
WIDTH, SIZE, ASCENT = 64, 48, 150.0


def _raster(spark: SparkSession, d: str) -> tuple[DataFrame, R.Grid]:
    ship(spark)
    rows = table(spark, d, "embeddings")
    grid = R.Grid(int(rows.agg(F.max("vec_id")).first()[0]) + 1, WIDTH)
    cells = rows.select(F.col("vec_id").cast("int").alias("row"), F.posexplode("embedding").alias("col", "v"))
    return cells.select(grid.cell(F.col("row"), F.col("col")).alias("cell"), "row", "col", F.floor(F.col("v").cast("double") * 1000).cast("float").alias("elev")), grid


def _line(spark: SparkSession, d: str) -> DataFrame:
    """Segments between nations in pixels."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") * 37 % 64 + 0.5).cast("double").alias("x0"), (F.col("n_nationkey") * 19 + 0.5).cast("double").alias("y0"))
    w = W.orderBy("k")  # a fixed table of 25 rows
    return n.withColumns({"x1": F.lead("x0").over(w), "y1": F.lead("y0").over(w)}).filter("x1 IS NOT NULL")


def _seeds(spark: SparkSession, d: str, grid: R.Grid) -> DataFrame:
    return R.rasterize(_line(spark, d), grid).select("cell").distinct()


def _points(spark: SparkSession, d: str, grid: R.Grid) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("peak_id"), (k * 7 % grid.nrows).cast("int").alias("row"), (k * 13 % WIDTH).cast("int").alias("col"))


def _computed(spark: SparkSession, d: str) -> DataFrame:
    return one_delivery(table(spark, d, "peaks_computed"), "peak_id")


def _corridor(spark: SparkSession, d: str) -> DataFrame:
    return one_delivery(table(spark, d, "peaks_corridor"), "peak_id")


def _features(spark: SparkSession, d: str) -> DataFrame:
    return one_delivery(table(spark, d, "osm_peaks"), "osm_id").select("osm_id", "name", F.col("geometry.x").alias("lon"), F.col("geometry.y").alias("lat"))


def _ways(spark: SparkSession, d: str) -> DataFrame:
    """Ways once each; a map cannot be compared, but rows of one id are copies."""
    return one_delivery(table(spark, d, "osm_ways"), "osm_id")


def _xy(df: DataFrame) -> DataFrame:
    return df.withColumns({"x": mercator_x(F.col("lon")), "y": mercator_y(F.col("lat"))})


def _peaks_with_names(spark: SparkSession, d: str) -> DataFrame:
    """Computed peaks with the name of the nearest named feature, empty where there is none, and a flag in place of a classifier's."""
    peaks = _xy(_computed(spark, d))
    feats = _xy(named(_features(spark, d)))
    near = nearest_within(peaks, "peak_id", feats, "osm_id", 200.0).join(feats.select("osm_id", "name"), "osm_id").select("peak_id", "name")
    return peaks.join(near, "peak_id", "left").withColumns({"name": F.coalesce("name", F.lit("")), "frontrow": F.col("peak_id") % 3 == 0})


def profile_barrier(spark, d):
    """Barrier analysis of every user's series of values."""
    out = barrier_of_series(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value")
    return out.select("user_id", "n", "blocked", F.col("lo").cast("long").alias("lo"), F.col("barrier").cast("long").alias("barrier"))


def profile_barrier_array(spark, d):
    """The same over arrays, after thinning to the samples that are passed on."""
    z = table(spark, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda s: s["value"]).alias("z"))
    s = z.select("user_id", shorten(F.col("z")).alias("z")).withColumn("a", analyze(F.col("z")))
    return s.select("user_id", F.size("z").cast("long").alias("n"), F.col("a.blocked").alias("blocked"), F.col("a.lo").cast("long").alias("lo"), F.col("a.barrier").cast("long").alias("barrier"))


def terrarium_decode(spark, d):
    """Bytes to heights, implausible ones masked."""
    k = F.col("p_partkey")
    z = R.decode_terrarium(120 + k % 36, k * 7 % 256, k * 13 % 256)
    return table(spark, d, "part").select("p_partkey", z.cast("double").alias("elev"), R.mask_implausible(z).cast("double").alias("masked"))


def mask_counts(spark, d):
    """How many heights the mask takes out."""
    t = terrarium_decode(spark, d)
    return t.agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("elev") > 4500).alias("implausible"), F.count("masked").alias("valid"), F.min("masked").alias("lowest"))


def corridor_tiles(spark, d):
    """Tiles that cover the corridor at zooms 9 to 12."""
    out = [tile_cover(spark, CORRIDOR, z) for z in (9, 10, 11, 12)]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def mosaic_cells(spark, d):
    """Tiles pasted into one raster: cells per row block with their height sums."""
    tiles = table(spark, d, "embeddings").select(F.lit(0).alias("x"), F.col("vec_id").cast("int").alias("y"), F.transform("embedding", lambda v: F.floor(v.cast("double") * 1000).cast("float")).alias("z"))
    cells = R.mosaic(tiles, 0, 0, 8)
    return cells.groupBy("row").agg(F.count(F.lit(1)).alias("cells"), F.sum(F.col("elev").cast("long")).alias("total"))


def mercator(spark, d):
    """Positions to EPSG:3857, to pixels of the zoom-12 mosaic, and back."""
    g = grid_of(CORRIDOR, 12)
    p = _xy(_computed(spark, d))
    back = F.bround(lon_of(F.col("x")), 6), F.bround(lat_of(F.col("y")), 6)
    return p.select("peak_id", F.round("x", 0).cast("long").alias("x"), F.round("y", 0).cast("long").alias("y"), g.row(F.col("y")).alias("row"), g.col(F.col("x")).alias("col"), back[0].alias("lon"), back[1].alias("lat"))


def parse_list(spark, d):
    """Lines of the raw list that give six numbers, within the corridor and of enough prominence."""
    return in_corridor(parse_peak_list(table(spark, d, "kirmse_raw"), "raw_line", "line_id"))


def bbox_filter(spark, d):
    """Reference peaks within the corridor."""
    return in_corridor(_corridor(spark, d)).select("peak_id", "lat", "lon", "prom_ft")


def route_filter(spark, d):
    """Scanned road lines with the route's number."""
    return road_lines(_ways(spark, d)).filter(is_route(F.col("ref"))).select("osm_id", "geom_type", "ref")


def route_dissolved(spark, d):
    """The route as one line of distinct segments: their number and extent."""
    r = route(_ways(spark, d)).select("name", F.explode("parts").alias("p"))
    xs = F.flatten(F.array(F.transform("p", lambda q: q["x"])))
    return r.groupBy("name").agg(F.count(F.lit(1)).alias("segments"), F.min(F.array_min(xs)).alias("west"), F.max(F.array_max(xs)).alias("east"))


def maxima(n):
    """Cells above all 4 or 8 neighbours."""
    return lambda spark, d: R.local_maxima(*_raster(spark, d), n, SIZE).select("cell", F.col("elev").cast("long").alias("elev"))


def snap_summit(spark, d):
    """Points moved to the highest cell near by."""
    cells, grid = _raster(spark, d)
    return R.snap_summits(_points(spark, d, grid), cells, grid, "peak_id").select("peak_id", "row", "col", F.col("elev").cast("long").alias("elev"))


def prominence_all(spark, d):
    """Prominence and key saddle of every summit."""
    return prominence(*_raster(spark, d), size=SIZE)


def prominence_four(spark, d):
    """The same with four neighbours."""
    return prominence(*_raster(spark, d), neighbours=4, size=SIZE)


def peaks_found(spark, d):
    """The peak table of the raster."""
    return peak_table(*_raster(spark, d), least=250.0, size=SIZE)


def reach(tolerance):
    """Marks of the tolerant ascent from the line; no tolerance is the ceiling."""

    def query(spark, d):
        cells, grid = _raster(spark, d)
        out = reach_mark(cells, _seeds(spark, d, grid), grid, tolerance, SIZE)
        return out.filter("mark IS NOT NULL").select("cell", F.col("mark").cast("long").alias("mark"))

    return query


def d8(spark, d):
    """Receiver of every cell."""
    return R.d8_receivers(*_raster(spark, d), SIZE)


def fill(spark, d):
    """Filled heights."""
    return fill_depressions(*_raster(spark, d), SIZE).select("cell", F.col("elev").cast("long").alias("elev"))


def catchment_raw(spark, d):
    """Cells that drain to the line over the raster as it is."""
    cells, grid = _raster(spark, d)
    return drains_to(R.d8_receivers(cells, grid, SIZE), _seeds(spark, d, grid), grid, SIZE).filter("catch").select("cell")


def catchment_filled(spark, d):
    """Cells that drain to the line after filling."""
    cells, grid = _raster(spark, d)
    return catchment(cells, _seeds(spark, d, grid), grid, size=SIZE).filter("catch").select("cell")


def divide(spark, d):
    """Cells in and out of the catchment around each point."""
    cells, grid = _raster(spark, d)
    c = cut(drains_to(R.d8_receivers(cells, grid, SIZE), _seeds(spark, d, grid), grid, SIZE))
    return divide_test(_points(spark, d, grid), "peak_id", c, grid)


def by_ascent(spark, d):
    """First-row test by tolerant ascent."""
    cells, grid = _raster(spark, d)
    return classify_by_ascent(_points(spark, d, grid), cells, _seeds(spark, d, grid), grid, ASCENT, SIZE)


def by_ceiling(spark, d):
    """First-row test by minimax ceiling."""
    cells, grid = _raster(spark, d)
    return classify_by_ceiling(_points(spark, d, grid), cells, _seeds(spark, d, grid), grid, SIZE)


def by_drainage(spark, d):
    """First-row test by drainage."""
    cells, grid = _raster(spark, d)
    return classify_by_drainage(_points(spark, d, grid), cells, _seeds(spark, d, grid), grid, size=SIZE)


def _pixel_stations(spark, d):
    line = _line(spark, d).select(F.lit(0).alias("part"), F.col("k").alias("seg"), "x0", "y0", "x1", "y1")
    s = stations(line, 5.0)
    return s.select((F.col("seg") * 100_000 + F.floor(F.col("d") * 10)).cast("long").alias("cand_id"), "x", (-F.col("y")).alias("y"))


def by_profile(spark, d):
    """First-row test by straight profiles, with details."""
    cells, grid = _raster(spark, d)
    peaks = _points(spark, d, grid).select("peak_id", grid.x(F.col("col")).alias("x"), grid.y(F.col("row")).alias("y"))
    return classify_by_profile(peaks, cells, _pixel_stations(spark, d), grid, ASCENT)


def profile_choice(spark, d):
    """Which of a point's 30 profiles is chosen, and what it shows."""
    cells, grid = _raster(spark, d)
    peaks = _points(spark, d, grid).select("peak_id", grid.x(F.col("col")).alias("x"), grid.y(F.col("row")).alias("y"))
    stops = _pixel_stations(spark, d)
    c = by_place(peaks, lambda at: choose(judge_once(station_lines(at, cells, stops, grid), cells, grid, ASCENT, SIZE), "rank", "a"))
    return c.select("peak_id", "frontrow", F.col("c.rank").cast("long").alias("rank"), "c.a.blocked", *(F.col(f"c.a.{k}").cast("long").alias(k) for k in ("lo", "barrier")))


def profile_counts(spark, d):
    """Classes of the profile test."""
    return class_counts(by_profile(spark, d))


def rasterize_line(spark, d):
    """Cells under the line."""
    _, grid = _raster(spark, d)
    return R.rasterize(_line(spark, d), grid, "k").select(F.col("k").cast("long").alias("k"), "row", "col")


def _route_segments(spark, d):
    ways = one_delivery(road_lines(table(spark, d, "osm_ways")).filter(is_route(F.col("ref"))), "osm_id").select("osm_id", "parts")  # copies are alike, so those of other roads need not be told apart
    return projected(segments_of(ways, "parts", "osm_id"))


def route_stations(spark, d):
    """Points every 200 projected metres along the route."""
    s = stations(_route_segments(spark, d), 200.0, "osm_id")
    return s.select("osm_id", "part", "seg", F.round("d", 2).alias("d"), F.round("x", 0).cast("long").alias("x"), F.round("y", 0).cast("long").alias("y"))


def profile_samples(spark, d):
    """Cells and heights under straight lines from each point to the line's first vertex."""
    cells, grid = _raster(spark, d)
    pairs = _points(spark, d, grid).select("peak_id", F.lit(0.5).alias("hx"), F.lit(-0.5).alias("hy"), grid.x(F.col("col")).alias("sx"), grid.y(F.col("row")).alias("sy"))
    got = sample_cells(pairs, grid).join(cells.select("cell", "elev"), "cell")
    return got.groupBy("peak_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("elev").cast("long")).alias("total"), F.sum(F.col("cell") * F.col("i")).alias("weighted"))


def nearest_name(spark, d):
    """Computed peaks with the name of the nearest feature within 200 projected metres."""
    return _peaks_with_names(spark, d).select("peak_id", "name")


def cross_checked(spark, d):
    """Agreement of the computed peaks with the reference list."""
    r = cross_check(_xy(_computed(spark, d)), _xy(_corridor(spark, d).filter("lat IS NOT NULL AND lon IS NOT NULL")))
    return r.select("reference_peaks", "our_peaks", "matched", "unmatched", *(F.round(c, 4).alias(c) for c in ("match_rate", "median_pos_err_m", "median_prom_diff_ft", "mean_abs_prom_diff_ft")))


def knn_30(spark, d):
    """The 30 reference peaks nearest to each feature."""
    return nearest_k(_xy(_features(spark, d)), "osm_id", _xy(_corridor(spark, d)), "peak_id", 30).select("osm_id", F.col("rank").cast("long").alias("rank"), "peak_id")


def _route_distance(spark, d):
    segs = _route_segments(spark, d).select("x0", "y0", "x1", "y1").distinct()
    return distance_to_segments(_xy(_computed(spark, d)), "peak_id", segs)


def point_line_distance(spark, d):
    """Distance of each computed peak to the route."""
    return _route_distance(spark, d).select("peak_id", F.round("distance", 0).cast("long").alias("distance"))


def route_quantiles(spark, d):
    """Quantiles of these distances."""
    return distance_quantiles(_route_distance(spark, d), "distance").select(*(F.round(c, 3).alias(c) for c in ("median", "p90", "largest")))


def bands(spark, d):
    """Computed peaks per prominence band."""
    return prominence_bands(_computed(spark, d))


def peak_counts(spark, d):
    """Computed peaks by whether the frame limits them."""
    return class_counts(_computed(spark, d).select((~F.col("frame_limited")).alias("frontrow")))


def nearest_probe(spark, d):
    """The computed peak nearest to a fixed point."""
    return nearest_to_point(_computed(spark, d), 46.8529, -121.7604).select("peak_id", "lat", "lon")


def top_peaks(spark, d):
    """The twelve computed peaks of greatest prominence."""
    return _computed(spark, d).orderBy(F.desc("prom_ft"), "peak_id").limit(12).select("peak_id", "lat", "lon", "prom_ft")


def ranked(spark, d):
    """Reference peaks numbered by falling prominence, per list."""
    peaks = _corridor(spark, d).select("list_code", "peak_id", "prom_ft")
    return numbered(peaks, "place", F.desc_nulls_last("prom_ft"), F.col("peak_id"), by="list_code").select("list_code", "peak_id", "place")


def labels(spark, d):
    """Waypoint labels, classes and marker sizes."""
    p = _peaks_with_names(spark, d)
    return p.select("peak_id", peak_label(F.col("name"), F.col("elev_ft"), F.col("prom_ft")).alias("label"), class_of(F.col("frontrow")).alias("cls"), F.round(marker_radius(F.col("prom_ft")), 4).alias("radius"))


def gpx(spark, d):
    """A GPX waypoint per peak of known height."""
    p = _peaks_with_names(spark, d).filter("elev_ft IS NOT NULL")
    return p.select("peak_id", waypoint(p).alias("wpt"))


def geojson(spark, d):
    """A GeoJSON feature per peak."""
    p = _peaks_with_names(spark, d)
    return p.select("peak_id", feature(p).alias("feature"))


def app_rows(spark, d):
    """What the map application shows of each peak."""
    p = _peaks_with_names(spark, d)
    return p.select("peak_id", F.bround("lon", 6).alias("lon"), F.bround("lat", 6).alias("lat"), F.bround("elev_ft", 0).cast("long").alias("elev_ft"), F.bround("prom_ft", 0).cast("long").alias("prom_ft"), class_of(F.col("frontrow")).alias("cls"), "name")


def app_features(spark, d):
    """The application's features as JSON."""
    p = _peaks_with_names(spark, d)
    return p.select("peak_id", app_feature(p).alias("feature"))


def visible_peaks(spark, d):
    """Peaks left visible by the controls, as the application exports them."""
    p = visible(_peaks_with_names(spark, d).withColumn("cls", class_of(F.col("frontrow"))), 500.0, ["front"]).filter("elev_ft IS NOT NULL")
    return p.select("peak_id", visible_waypoint(p).alias("wpt"))


def payload(spark, d):
    """The application's payload in one row: sizes of its texts, centre and largest prominence."""
    p = app_payload(_peaks_with_names(spark, d), route(_ways(spark, d)))
    return p.select(F.length("peaks").alias("peaks_chars"), F.length("highway").alias("highway_chars"), F.round(F.col("center")[0], 6).alias("lat"), F.round(F.col("center")[1], 6).alias("lon"), "max_prom")


def units(spark, d):
    """Feet of the metres in the list of computed prominences, as text to one decimal."""
    return _computed(spark, d).select("peak_id", whole(F.col("prom_m") / 0.3048).alias("ft"), fixed(F.col("lat"), 6).alias("lat"))


QUERIES = {
    "profile_barrier": profile_barrier, "profile_barrier_array": profile_barrier_array, "terrarium_decode": terrarium_decode, "mask_counts": mask_counts, "corridor_tiles": corridor_tiles,
    "mosaic_cells": mosaic_cells, "mercator": mercator, "parse_list": parse_list, "bbox_filter": bbox_filter, "route_filter": route_filter, "route_dissolved": route_dissolved, "local_maxima_4": maxima(4), "local_maxima_8": maxima(8),
    "snap_summit": snap_summit, "prominence": prominence_all, "prominence_4": prominence_four, "peak_table": peaks_found, "reach_mark": reach(ASCENT), "ceiling_mark": reach(None), "d8_receivers": d8, "fill_depressions": fill,
    "catchment": catchment_raw, "catchment_filled": catchment_filled, "divide_test": divide, "classify_ascent": by_ascent, "classify_ceiling": by_ceiling, "classify_drainage": by_drainage, "classify_profile": by_profile,
    "profile_choice": profile_choice, "profile_counts": profile_counts, "rasterize_line": rasterize_line, "route_stations": route_stations, "profile_samples": profile_samples, "nearest_name": nearest_name, "cross_check": cross_checked, "knn_30": knn_30,
    "point_line_distance": point_line_distance, "route_quantiles": route_quantiles, "prominence_bands": bands, "peak_counts": peak_counts, "nearest_to_point": nearest_probe, "top_peaks": top_peaks, "ranked_peaks": ranked,
    "labels": labels, "gpx_waypoints": gpx, "geojson_features": geojson, "app_rows": app_rows, "app_features": app_features, "visible_waypoints": visible_peaks, "app_payload": payload, "unit_texts": units,
}
