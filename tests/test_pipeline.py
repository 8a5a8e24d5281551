"""The whole run over a small made-up landscape, by every method."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.plans.pipeline import Settings, fingerprint, materialize, run
from ridgeline.sources.tiles import grid_of, tile_extent

BOX = (-122.0, 47.0, -121.5, 47.3)


@pytest.mark.parametrize("method", ["profile", "ascent", "ceiling", "drainage"])
def test_run(spark, tmp_path, method):
    s = Settings(BOX, 8, 16, 50.0, method=method, block=16, candidates=4, station_step=5000.0)
    x0, y0, x1, y1 = tile_extent(BOX, 8)
    rng = np.random.default_rng(0)
    tiles = []
    for x in range(x0, x1 + 1):
        for y in range(y0, y1 + 1):
            z = rng.uniform(100, 200, 256)
            z[100] = 1500.0
            z[40], z[41] = 9000.0, -32768.0
            tiles.append((x, y, [float(v) for v in z]))
    g = grid_of(BOX, 8)
    features = spark.createDataFrame([(1, "Top", -121.7, 47.2), (2, None, -121.6, 47.1)], "osm_id long, name string, lon double, lat double")
    w = (g.x0 / 6378137) * 180 / np.pi
    ways = spark.createDataFrame([(1, "LineString", "I 90", {"highway": "motorway"}, [[{"x": w + 0.1, "y": 47.0}, {"x": w + 1.0, "y": 47.1}]])], "osm_id long, geom_type string, ref string, tags map<string,string>, parts array<array<struct<x:double,y:double>>>")
    lines = spark.createDataFrame([("47.1,-121.7,5000,47,-121.6,900",), ("bad",)], "value string")
    got = run(spark, spark.createDataFrame(tiles, "x int, y int, z_m array<float>"), features, ways, lines, str(tmp_path), s)
    peaks = got["peaks"].collect()
    assert len(peaks) >= len(tiles) and all(r["frontrow"] in (True, False) for r in peaks) and max(r["elev_m"] for r in peaks) == 1500.0
    assert got["cross_check"].first()["reference_peaks"] == 1
    assert open(got["paths"]["all_peaks.gpx"]).read().count("<wpt") == len(peaks) and "<svg" in open(got["paths"]["app"]).read()


def test_materialize_by_parameters(spark, tmp_path):
    made = []

    def make(k):
        return lambda: made.append(k) or spark.range(k)

    for k, dep in ((1, "a"), (2, "a"), (3, "b")):
        materialize(spark, str(tmp_path), "x", dep, make(k))
    assert made == [1, 3] and materialize(spark, str(tmp_path), "x", "a", make(9), overwrite=True).count() == 9


def test_late_rows_reach_a_second_run(spark, tmp_path):
    s = Settings(BOX, 8, 16, 50.0, method="ceiling", block=16)
    x0, y0, x1, y1 = tile_extent(BOX, 8)
    top = [100.0] * 100 + [1500.0] + [100.0] * 155
    tiles = lambda z: spark.createDataFrame([(x, y, z) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)], "x int, y int, z_m array<float>")
    feature = lambda n: spark.createDataFrame([(k, "Top", -121.7, 47.2) for k in range(n)], "osm_id long, name string, lon double, lat double")
    w = (grid_of(BOX, 8).x0 / 6378137) * 180 / np.pi
    ways = spark.createDataFrame([(1, "LineString", "I 90", {"highway": "motorway"}, [[{"x": w + 0.1, "y": 47.0}, {"x": w + 1.0, "y": 47.1}]])], "osm_id long, geom_type string, ref string, tags map<string,string>, parts array<array<struct<x:double,y:double>>>")
    lines = spark.createDataFrame([("bad",)], "value string")
    first, second = (run(spark, tiles(z), feature(1), ways, lines, str(tmp_path), s)["peaks"].agg(F.max("elev_m")).first()[0] for z in (top, [v + 50 for v in top]))
    assert (first, second) == (1500.0, 1550.0)
    assert fingerprint(ways) == fingerprint(ways.repartition(3)) != fingerprint(ways.limit(0)) and fingerprint(feature(1)) != fingerprint(feature(2))
