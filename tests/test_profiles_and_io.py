"""Profiles, stations, geodesics, reports, sources and sinks."""

import json
import sqlite3
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.functions.geodesic import inverse
from ridgeline.functions.text import peak_label
from ridgeline.operators.ascent import classify_by_ascent, classify_by_ceiling
from ridgeline.operators.drainage import catchment, classify_by_drainage, drains_to
from ridgeline.operators.profile import CANDIDATES, analyze, barrier_of_series, classify_by_profile, judge, profiles, sample_cells, segments_of, shorten, stations
from ridgeline.operators.raster import mosaic, snap_summits
from ridgeline.operators.report import class_counts, cross_check, prominence_bands
from ridgeline.plans import terrain
from ridgeline.session import numbered
from ridgeline.sinks.exports import app_payload, chart, export_files, export_visible, write_app, write_report
from ridgeline.sinks.rasters import read_tiles, write_tiles
from ridgeline.sources.features import is_route, named, present, route
from ridgeline.sources.geopackage import GeoPackage, points_of, wkb_of
from ridgeline.sources.peak_list import in_corridor, parse_peak_list, read_lines
from ridgeline.sources.tiles import TerrariumTiles, decode_png, grid_of, read_terrarium, tile_cover
from tests.rasters import cells_of, cells_of_array

PROFILES = [
    ([100, 40, 60, 140, 63.8, 200], (True, 1, 4)), ([100, 40, 60, 140, 64, 200], (False, 1, -1)), ([300, 40, 60, 200], (False, 1, -1)), ([None, 40, None, 150, None, 60, 200], (True, 1, 5)),
    ([None, 5, None], (True, 0, -1)), ([200, 100, 40], (False, 2, -1)), ([40, 200, 100, 40, 210], (True, 0, 3)),
]


def test_barriers(spark):
    df = spark.createDataFrame([(k, [None if v is None else float(v) for v in z]) for k, (z, _) in enumerate(PROFILES)], "k int, z array<double>")
    got = df.select("k", analyze(F.col("z")).alias("a")).orderBy("k").collect()
    assert [tuple(r["a"]) for r in got] == [w for _, w in PROFILES]
    long = df.select("k", F.posexplode("z").alias("i", "v"))
    assert [(r["blocked"], r["lo"], r["barrier"]) for r in barrier_of_series(long, "k", ["i"], "v").orderBy("k").collect()] == [w for _, w in PROFILES]


def _plain_profile(z, hx, hy, sx, sy):
    """The samples of one line over an array, with plain loops; the raster's corner is (0, 0), its cells are of side 1."""
    n = max(2, int(np.hypot(sx - hx, sy - hy)) + 1)
    out = []
    for i in range(n):
        c, r = (sx, -sy) if i == n - 1 else (hx + i * ((sx - hx) / (n - 1)), -hy + i * ((hy - sy) / (n - 1)))
        v = z[min(max(int(r), 0), z.shape[0] - 1)][min(max(int(c), 0), z.shape[1] - 1)]
        out.append(None if np.isnan(v) else float(v))
    return out


def _plain_blocked(profile, tolerance):
    known = [v for v in profile if v is not None]
    if len(known) < 2:
        return True
    after = [v for v in profile[profile.index(min(known)) :] if v is not None]
    return any(max(after[: k + 1]) - v >= tolerance for k, v in enumerate(after))


@pytest.mark.parametrize("size,chunk", [(7, 3), (256, 20_000)])
def test_profiles_by_block(spark, monkeypatch, size, chunk):
    """Profiles put together from blocks are those of plain loops and of a join per sample, whatever the block, and lines may leave the raster."""
    monkeypatch.setattr("ridgeline.operators.profile.SAMPLES", 50)
    rng = np.random.default_rng(9)
    z = np.where(rng.random((40, 30)) < 0.05, np.nan, rng.integers(0, 300, (40, 30)).astype(float))
    cells, grid = cells_of_array(spark, z)
    ends = [(k % 9, k, float(rng.uniform(-3, 33)), -float(rng.uniform(-3, 43)), float(rng.uniform(0, 30)), -float(rng.uniform(0, 40))) for k in range(60)] + [(3, 99, 5.5, -5.5, 5.5, -5.5)]
    pairs = spark.createDataFrame(ends, "peak_id long, rank int, hx double, hy double, sx double, sy double")
    got = {r["rank"]: list(r["z"]) for r in profiles(pairs, cells, grid, size, chunk).collect()}
    assert got == {k: _plain_profile(z, *e) for _, k, *e in ends}
    joined = sample_cells(pairs, grid).join(cells.select("cell", "elev"), "cell", "left").groupBy("rank").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "elev"))), lambda s: s["elev"]).alias("z"))
    assert got == {r["rank"]: list(r["z"]) for r in joined.collect()}
    assert profiles(pairs.limit(0), cells, grid, size).count() == 0 == judge(pairs.limit(0), cells, grid, 76.2, size).count()
    # the analysis without the samples is that of the samples
    for tolerance in (20.0, 120.0, 270.0):
        want = {r["rank"]: tuple(r["a"]) for r in profiles(pairs, cells, grid, size, chunk).select("rank", analyze(F.transform("z", lambda v: v.cast("double")), tolerance).alias("a")).collect()}
        assert {r["rank"]: tuple(r["a"]) for r in judge(pairs, cells, grid, tolerance, size, chunk).collect()} == want
        assert {k: a[0] for k, a in want.items()} == {k: _plain_blocked(_plain_profile(z, *e), tolerance) for _, k, *e in ends}
    assert all(v is None for v in profiles(pairs.limit(1), cells.limit(0), grid, size).first()["z"])


def test_shorten(spark):
    df = spark.createDataFrame([([float(k) for k in range(n)],) for n in (5, 80, 200)], "z array<double>")
    got = [r[0] for r in df.select(shorten(F.col("z"))).collect()]
    assert got[0] == list(range(5)) and got[1] == list(range(80)) and len(got[2]) == 80 and got[2] == np.linspace(0, 199, 80).astype(int).tolist()


def test_stations(spark):
    lines = spark.createDataFrame([(1, [[(0.0, 0.0), (500.0, 0.0), (500.0, 100.0)], [(9.0, 9.0)]])], "osm_id long, parts array<array<struct<x:double,y:double>>>")
    got = stations(segments_of(lines, "parts", "osm_id"), 200.0, "osm_id").orderBy("d").collect()
    assert [(r["d"], r["x"], r["y"]) for r in got] == [(0, 0, 0), (200, 200, 0), (400, 400, 0), (600, 500, 100)]


def test_geodesic():
    assert inverse([0.0], [0.0], [1.0], [0.0])[0] == pytest.approx(111319.4908, abs=1e-3) and inverse([5.0], [50.0], [5.0], [50.0])[0] == 0
    assert inverse([-122.0], [47.0], [-121.0], [47.5])[0] == pytest.approx(93836.0, rel=2e-3) and np.isnan(inverse([0.0], [0.0], [179.9], [0.1])[0])


def test_classifiers(spark):
    cells, grid = cells_of(spark, "10 10 10 10 10 10\n10 20 90 30 95 10\n10 10 10 10 10 10")
    peaks = spark.createDataFrame([(1, 1, 2), (2, 1, 4)], "peak_id long, row int, col int")
    seeds = spark.createDataFrame([(6,)], "cell long")
    up = {r["peak_id"]: (r["frontrow"], r["approach_crest_above_m"]) for r in classify_by_ascent(peaks, cells, seeds, grid, 76.2, 3).collect()}
    assert up[1][0] and up[2][0] and all(0 <= c <= 76.2 for _, c in up.values())
    ceiling = {r["peak_id"]: (r["frontrow"], r["barrier_above_m"]) for r in classify_by_ceiling(peaks, cells, seeds, grid, 3).collect()}
    assert ceiling == {1: (True, 0.0), 2: (True, 0.0)}
    wet = {r["peak_id"]: (r["n_in"] > 0) == r["drains"] == r["frontrow"] for r in classify_by_drainage(peaks, cells, seeds, grid, 1, 3).collect()}
    assert all(wet.values())
    assert catchment(cells, seeds, grid, size=3).filter("catch AND cell = 6").count() == 1


def test_drainage_worked_case(spark):
    from ridgeline.operators.raster import d8_receivers

    cells, grid = cells_of(spark, "9 9 9 9 9\n9 8 7 6 9\n9 7 5 4 9\n9 8 6 3 9\n9 9 9 2 9")
    for size in (2, 256):
        got = drains_to(d8_receivers(cells, grid, size), spark.createDataFrame([(13,)], "cell long"), grid, size)
        assert {r["cell"] for r in got.filter("catch").collect()} == {7, 8, 13} and got.count() == 25


@pytest.mark.parametrize("size", [3, 256])
def test_profile_classifier(spark, size):
    ridge, open_ = "10 10 200 10 10 10 10 10", "10 10 10 10 10 10 10 10"
    cells, grid = cells_of(spark, "\n".join([ridge, ridge[:-2] + "150", ridge, ridge, open_, open_, open_, open_]))
    cand = spark.createDataFrame([(1, 0.5, -1.5), (2, 0.5, -7.5)], "cand_id long, x double, y double")
    peaks = spark.createDataFrame([(7, 7.5, -1.5)], "peak_id long, x double, y double")
    both = classify_by_profile(peaks, cells, cand, grid, 76.2, 30, size).first()
    assert both["frontrow"] and not both["blk"] and both["bar"] == -1 and both["z"][0] == 10 and both["z"][-1] == 150 and len(both["z"]) == 10
    one = classify_by_profile(peaks, cells, cand, grid, 76.2, 1, size).first()  # the nearest station only
    assert not one["frontrow"] and one["blk"] and one["bar"] > one["lo"] and one["z"] == [10, 10, 200, 10, 10, 10, 10, 150]


def test_profile_query_tries_all_candidates(spark, tmp_path):
    """The query against every profile from the 30 nearest stations; the 8 nearest alone give another result."""
    rng = np.random.default_rng(4)
    v = rng.uniform(-0.3, 0.3, (120, 64)).round(4)
    spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(k,) for k in range(7)], "n_nationkey long").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(k,) for k in range(120)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r["peak_id"]: r["frontrow"] for r in terrain.by_profile(spark, str(tmp_path)).collect()}
    cells, grid = terrain._raster(spark, str(tmp_path))
    z = np.floor(v * 1000)
    at = sorted((r["cand_id"], r["x"], r["y"]) for r in terrain._pixel_stations(spark, str(tmp_path)).collect())
    snapped = {r["peak_id"]: (r["row"], r["col"]) for r in snap_summits(terrain._points(spark, str(tmp_path), grid), cells, grid, "peak_id").collect()}
    want = {8: {}, CANDIDATES: {}}
    for k, (row, col) in snapped.items():
        px, py = k * 13 % 64 + 0.5, -(k * 7 % 120 + 0.5)
        near = sorted(at, key=lambda s: (np.hypot(s[1] - px, s[2] - py), s[0]))
        clear = [not _plain_blocked(_plain_profile(z, x, y, col + 0.5, -(row + 0.5)), terrain.ASCENT) for _, x, y in near[:CANDIDATES]]
        for n, d in want.items():
            d[k] = any(clear[:n])
    assert CANDIDATES == 30 <= len(at) and want[8] != want[30] and got == want[30]


def test_peaks_of_one_place_share_their_profiles(spark, tmp_path, monkeypatch):
    """Lines that differ are cut at block borders once, however many peaks they belong to, and every peak has its row."""
    from ridgeline.operators import profile as P

    cut_lines, pieces = [], P._pieces
    monkeypatch.setattr(P, "_pieces", lambda pairs, *a: (cut_lines.append(pairs.count()), pieces(pairs, *a))[1])
    v = np.random.default_rng(4).uniform(-0.3, 0.3, (40, 64)).round(4)
    spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(k,) for k in range(3)], "n_nationkey long").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(k,) for j in range(5) for k in range(320 * j, 320 * j + 8)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")  # 320 keys on, the same cell
    got = {r["peak_id"]: tuple(r)[1:] for r in terrain.profile_choice(spark, str(tmp_path)).collect()}
    assert len(got) == 40 and all(got[320 * j + k] == got[k] for j in range(5) for k in range(8))
    assert cut_lines and max(cut_lines) <= 8 * CANDIDATES


def test_reports(spark):
    ours = spark.createDataFrame([(1, 0.0, 0.0, 300.0), (2, 5000.0, 0.0, 2500.0)], "peak_id long, x double, y double, prom_ft double")
    ref = spark.createDataFrame([(1, 100.0, 0.0, 290.0), (2, 0.0, 300.0, 310.0), (3, 9e5, 0.0, 1.0)], "peak_id long, x double, y double, prom_ft double")
    r = cross_check(ours, ref).first()
    assert (r["matched"], r["unmatched"], r["median_pos_err_m"], r["median_prom_diff_ft"], r["mean_abs_prom_diff_ft"]) == (2, 1, 200.0, 0.0, 10.0)
    none = cross_check(ours, ref.limit(0)).first()
    assert none["matched"] == 0 and none["match_rate"] is None and none["median_pos_err_m"] is None
    assert [x["peaks"] for x in prominence_bands(ours).orderBy("lo").collect()] == [1, 0, 0, 1]
    assert tuple(class_counts(spark.createDataFrame([(True,), (False,), (True,)], "frontrow boolean")).first()) == (3, 2, 1)


def test_quantiles_without_all_values_in_one_task(spark, monkeypatch):
    from ridgeline.operators import report

    def one_map(*a, **k):
        raise AssertionError("every distinct value in one task")

    monkeypatch.setattr(report.F, "percentile", one_map)
    v = np.random.default_rng(2).gamma(2, 900, 997)
    for part in (v, v[:10], v[:1], np.repeat(v[:3], 5)):
        rows = spark.createDataFrame([(float(x),) for x in part] + [(None,)], "d double").repartition(5)
        got = report.distance_quantiles(rows, "d").first()
        assert np.allclose(got, [np.quantile(part, 0.5), np.quantile(part, 0.9), part.max()], rtol=1e-12)
    assert tuple(report.distance_quantiles(rows.limit(0), "d").first()) == (None, None, None)


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(0, 47.1, -121.5, 5000.5, 2.5, True, "A & <B>"), (1, 47.2, -121.4, 4000.0, 900.0, False, "")], "peak_id long, lat double, lon double, elev_ft double, prom_ft double, frontrow boolean, name string")
    paths = export_files(df, str(tmp_path))
    text = open(paths["all_peaks.gpx"]).read()
    assert text.index("4000ft pk (P900)") < text.index("A &amp; &lt;B&gt;") and "occluded (+0 m barrier)" in text and "<ele>1524.2</ele>" in text and "elev 5000 ft, prominence 2 ft" in text
    assert open(paths["frontrow_peaks.gpx"]).read().count("<wpt") == 1 and len(json.load(open(paths["peaks.geojson"]))["features"]) == 2
    seen = export_visible(df, str(tmp_path), 100.0, ["behind"])
    assert [f["properties"]["id"] for f in json.load(open(seen["visible_peaks.geojson"]))["features"]] == [1] and open(seen["visible_peaks.gpx"]).read().count("<wpt") == 1
    report = open(write_report(str(tmp_path / "r.txt"), classes=class_counts(df), bands=prominence_bands(df))).read()
    assert "  peaks: 2" in report and "  500  1000  1" in report
    line = spark.createDataFrame([("I 90", [[(-121.5, 47.0), (-121.4, 47.1)]])], "name string, parts array<array<struct<x:double,y:double>>>")
    p = app_payload(df, line).first()
    assert [f["properties"]["cls"] for f in json.loads(p["peaks"])["features"]] == ["front", "behind"] and p["max_prom"] == 900 and json.loads(p["highway"])["features"][0]["properties"]["name"] == "I 90"
    assert "<svg" in open(write_app(df, line, None, str(tmp_path / "app.html"))).read()
    assert [r[0] for r in df.select(peak_label(F.col("name"), F.col("elev_ft"), F.col("prom_ft"))).collect()] == ["A & <B>", "4000ft pk (P900)"]


def test_chart(spark):
    rows = [([0.0, 10.0], [4.0, 20.0], [5, 9, 1], 1), ([0.0, 0.0], [1.0, 1.0], [3], -1)]
    got = chart(spark.createDataFrame(rows, "h array<double>, s array<double>, z array<int>, bar int")).collect()
    assert [(r["z_low"], r["z_high"], r["share"], r["barrier_at"]) for r in got] == [(1, 9, 0.5, [2.0, 15.0]), (3, 3, None, None)]


def test_rasters_as_tiles(spark, tmp_path):
    z = np.where(np.random.default_rng(1).random((37, 21)) < 0.2, np.nan, np.arange(37 * 21).reshape(37, 21).astype(float))
    cells, grid = cells_of_array(spark, z)
    path = write_tiles(cells, "elev", str(tmp_path / "t"), 16)
    back = read_tiles(spark, path, grid)
    assert spark.read.parquet(path).count() == 6 and sorted(map(tuple, back.select("cell", "row", "col", "elev").collect())) == sorted(map(tuple, cells.filter("elev IS NOT NULL").select("cell", "row", "col", "elev").collect()))
    mask = cells.select("row", "col", (F.col("col") > 5).alias("catch"))
    assert read_tiles(spark, write_tiles(mask, "catch", str(tmp_path / "m"), 16), grid, "catch").filter("catch = 1").count() == mask.filter("catch").count()


def test_numbered(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k), ["a", "b", None][k % 3] if k % 7 else "a", float(rng.integers(0, 9)) if k % 11 else None) for k in range(500)]
    df = spark.createDataFrame(rows, "id long, g string, v double").repartition(7)
    order = lambda r: (-r[2] if r[2] is not None else np.inf, r[0])
    want = {r[0]: k for k, r in enumerate(sorted(rows, key=order))}
    assert {r["id"]: r["n"] for r in numbered(df, "n", F.desc_nulls_last("v"), F.col("id")).collect()} == want
    within = {r[0]: k for g in ("a", "b", None) for k, r in enumerate(sorted((r for r in rows if r[1] == g), key=order))}
    assert {r["id"]: r["n"] for r in numbered(df, "n", F.desc_nulls_last("v"), F.col("id"), by="g").collect()} == within
    assert numbered(df.limit(0), "n", F.col("id")).count() == 0


def test_peak_list(spark, tmp_path):
    lines = ["47.4,-121.4,6278,47.3,-121.3,1000", "1,2,3,4,5", "x,1,2,3,4,5", "47.0,-121,1,2,3,250,more", "47.0,-121,1,2,3,249.99", "47,-122.40,1,2,3,250", "1.5d,2,3,4,5,600", "1_000,2,3,4,5,600"]
    df = spark.createDataFrame([(t,) for t in lines], "value string")
    assert parse_peak_list(df, "value").count() == 4 and in_corridor(parse_peak_list(df, "value")).count() == 3
    (tmp_path / "a.txt").write_text("\n".join(lines))
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("small.txt", "no")
        z.writestr("big.txt", "\n".join(lines * 2))
    assert read_lines(spark, str(tmp_path)).count() == 24


def test_routes(spark):
    refs = {"I 90": True, "I 5;I 90": True, "US 2;I 5": False, "I 5;US 90": False, "WI 190": True, None: False}
    df = spark.createDataFrame([(r,) for r in refs], "ref string")
    assert [r[0] for r in df.select(is_route(F.col("ref"))).collect()] == list(refs.values())
    seg = [[{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 1.0}], [{"x": 1.0, "y": 1.0}, {"x": 0.0, "y": 0.0}]]
    ways = spark.createDataFrame([(1, "LineString", "I 90", {"highway": "trunk"}, seg), (2, "Polygon", "I 90", {"highway": "trunk"}, seg), (3, "LineString", "I 90", {"highway": "track"}, seg)], "osm_id long, geom_type string, ref string, tags map<string,string>, parts array<array<struct<x:double,y:double>>>")
    assert len(route(ways).first()["parts"]) == 1
    with pytest.raises(Exception, match="no such route"):
        route(ways.limit(0)).collect()
    assert named(df).count() == 0 and present(df, "ref", "ele").columns == ["ref"]


def _png(rgb):
    h, w, _ = rgb.shape
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    rows = b""
    before = np.zeros((w, 3), np.int64)
    for r in range(h):
        now = rgb[r].astype(np.int64)
        left = np.vstack([np.zeros((1, 3), np.int64), now[:-1]])
        corner = np.vstack([np.zeros((1, 3), np.int64), before[:-1]])
        p = left + before - corner
        a, b, c = abs(p - left), abs(p - before), abs(p - corner)
        guess = [np.zeros_like(now), left, before, (left + before) // 2, np.where((a <= b) & (a <= c), left, np.where(b <= c, before, corner))][r % 5]
        rows += bytes([r % 5]) + ((now - guess) & 255).astype(np.uint8).tobytes()
        before = now
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_tiles(spark, tmp_path):
    rgb = np.random.default_rng(0).integers(0, 256, (10, 7, 3)).astype(np.uint8)
    assert (decode_png(_png(rgb)) == rgb).all()
    box = (-121.6, 47.3, -121.5, 47.4)
    cover = [(r["x"], r["y"]) for r in tile_cover(spark, box, 9).collect()]
    for x, y in cover:
        (tmp_path / f"9/{x}").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"9/{x}/{y}.png").write_bytes(_png(rgb))
    want = (rgb[..., 0].astype(float) * 256 + rgb[..., 1] + rgb[..., 2] / 256 - 32768).ravel()
    got = read_terrarium(spark, str(tmp_path)).collect()
    assert len(got) == len(cover) and np.allclose(got[0]["z_m"], want)
    spark.dataSource.register(TerrariumTiles)
    live = spark.read.format("terrarium").options(url=f"file://{tmp_path}/{{z}}/{{x}}/{{y}}.png", zoom="9", box=",".join(map(str, box))).load().collect()
    assert {(r["x"], r["y"]) for r in live} == set(cover) and np.allclose(live[0]["z_m"], want)
    assert tile_cover(spark, (-122.40, 46.75, -119.80, 47.75), 12).count() == 510 and grid_of((-122.40, 46.75, -119.80, 47.75), 12).nrows == 4352


def test_mosaic(spark):
    tiles = spark.createDataFrame([(5, 7, [1.0, 2.0, 3.0, 4.0]), (6, 7, [5.0, 6.0, 7.0, 8.0])], "x int, y int, z array<float>")
    assert {(r["row"], r["col"]): r["elev"] for r in mosaic(tiles, 5, 7, 2).collect()} == {(0, 0): 1, (0, 1): 2, (1, 0): 3, (1, 1): 4, (0, 2): 5, (0, 3): 6, (1, 2): 7, (1, 3): 8}


def test_geopackage(spark, tmp_path):
    path = str(tmp_path / "a.gpkg")
    wkb = struct.pack("<BIdd", 1, 1, -121.5, 47.5)
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE gpkg_contents (table_name TEXT, data_type TEXT)")
        c.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
        c.execute("INSERT INTO gpkg_contents VALUES ('peaks', 'features')")
        c.execute("INSERT INTO gpkg_geometry_columns VALUES ('peaks', 'geom')")
        c.execute("CREATE TABLE peaks (fid INTEGER PRIMARY KEY, geom BLOB, name TEXT, prom REAL)")
        c.executemany("INSERT INTO peaks VALUES (?, ?, ?, ?)", [(1, b"GP\x00\x01" + struct.pack("<i", 4326) + wkb, "A", 1.5), (2, None, None, None)])
    spark.dataSource.register(GeoPackage)
    rows = spark.read.format("geopackage").options(path=path, table="peaks").load().orderBy("fid").collect()
    assert (rows[0]["name"], rows[0]["prom"], points_of(bytes(rows[0]["geom"]))) == ("A", 1.5, [[(-121.5, 47.5)]]) and rows[1]["geom"] is None
    assert points_of(struct.pack("<BII", 1, 5, 1) + struct.pack("<BII4d", 1, 2, 2, 0, 0, 1, 1)) == [[(0, 0), (1, 1)]]
    with pytest.raises(ValueError):
        wkb_of(b"xx")


def test_every_query_is_listed():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and {f"p{n}_found" for n in range(1, 6)} <= set(e.queries())
