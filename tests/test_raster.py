"""Raster operators on small grids against worked cases and brute force; the block size must not matter."""

import numpy as np
import pytest

from ridgeline.operators.flood import fill_depressions, reach_mark
from ridgeline.operators.graph import pointer_jump
from ridgeline.operators.prominence import peak_table, prominence
from ridgeline.operators.raster import d8_receivers, decode_terrarium, local_maxima, mask_implausible, rasterize, snap_summits
from tests.rasters import ascent, cells_of, cells_of_array, sweep

HILLS = """
10 10 10 10 10 10 10
10 90 40 35 60 50 10
10 40 30 20 55 70 10
10 10 15 10 45 30 10
10 50 20 80 40 10 10
10 60 25 70 75 10 10
10 10 10 10 10 10 10
"""


def _prominences(df):
    return {r["cell"]: (r["prom"], r["saddle_cell"]) for r in df.collect()}


@pytest.mark.parametrize("size", [3, 256])
def test_prominence_worked_case(spark, size):
    cells, grid = cells_of(spark, HILLS)
    assert _prominences(prominence(cells, grid, size=size)) == {8: (80.0, None), 31: (45.0, 10), 36: (35.0, 37), 19: (25.0, 25), 48: (0.0, 47)}
    four = _prominences(prominence(cells, grid, neighbours=4, size=size))
    assert four == {8: (80.0, None), 31: (45.0, 10), 36: (35.0, 37), 19: (30.0, 32), 39: (5.0, 38), 11: (5.0, 18), 48: (0.0, 46)}


@pytest.mark.parametrize("neighbours,last", [(4, 200_000), (8, 200_000), (4, 0), (8, 0), (8, 5)])
def test_prominence_equals_sweep(spark, monkeypatch, neighbours, last):
    """One task that merges all basins, rounds of joins until nothing is left, and rounds before the last task."""
    monkeypatch.setattr("ridgeline.operators.graph.LAST_EDGES", last)
    rng = np.random.default_rng(neighbours)
    z = rng.integers(0, 12, (17, 14)).astype(float)
    z[rng.random(z.shape) < 0.15] = np.nan
    cells, grid = cells_of_array(spark, z)
    assert _prominences(prominence(cells, grid, neighbours=neighbours, size=5)) == sweep(z, neighbours)


def test_peak_table_is_ranked(spark):
    cells, grid = cells_of(spark, HILLS)
    rows = peak_table(cells, grid, least=30).orderBy("peak_id").collect()
    assert [(r["peak_id"], r["prom_m"]) for r in rows] == [(0, 80.0), (1, 45.0), (2, 35.0)]
    assert [r["frame_limited"] for r in rows] == [True, False, False] and rows[0]["saddle_lat"] is None


def test_empty_raster(spark):
    cells, grid = cells_of(spark, ". .\n. .")
    assert prominence(cells, grid).count() == 0 and local_maxima(cells, grid).count() == 0


def test_tolerant_ascent(spark):
    cells, grid = cells_of(spark, ". . . . . .\n10 60 20 60 70 80\n. . . . . .")
    seed = cells.filter("cell = 6")

    def marks(t):
        return [r["mark"] for r in reach_mark(cells, seed, grid, t, size=2).orderBy("cell").collect()]

    assert marks(39) == [10, 60, None, None, None, None]
    assert marks(40) == marks(None) == [10, 60, 60, 60, 70, 80]


def test_ascent_equals_one_heap(spark):
    rng = np.random.default_rng(1)
    z = rng.integers(0, 100, (13, 15)).astype(float)
    z[rng.random(z.shape) < 0.1] = np.nan
    cells, grid = cells_of_array(spark, z)
    got = {r["cell"]: r["mark"] for r in reach_mark(cells, cells.filter("cell IN (3, 70)"), grid, 30.0, size=4).filter("mark IS NOT NULL").collect()}
    assert got == ascent(z, [3, 70], 30.0)
    assert all(0 <= v - z.flat[k] <= 30 for k, v in got.items())


def test_d8_worked_case(spark):
    cells, grid = cells_of(spark, "9 9 9 9 9\n9 8 7 6 9\n9 7 5 4 9\n9 8 6 3 9\n9 9 9 2 9")
    got = {r["cell"]: r["receiver"] for r in d8_receivers(cells, grid, size=2).collect()}
    want = {k: k for k in range(25)} | {6: 12, 7: 13, 8: 13, 11: 12, 12: 18, 13: 18, 16: 12, 17: 18, 18: 23}
    assert got == want


def test_fill_reaches_the_spill_level(spark):
    cells, grid = cells_of(spark, "9 9 9 9 9\n9 3 9 4 9\n9 5 6 7 9\n9 2 9 9 8\n9 9 9 9 9")
    level = {r["cell"]: r["elev"] for r in fill_depressions(cells, grid, size=2).collect()}
    assert level[6] == level[12] == level[16] == 8.0 and level[0] == 9.0


def test_pointer_jump(spark):
    p = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(50, 50), (60, -1), (61, 60), (70, 99)], "cell long, ptr long")
    got = {r["cell"]: r["ptr"] for r in pointer_jump(p).collect()}
    assert set(got[k] for k in range(51)) == {50} and got[61] == got[60] == -1 and got[70] == 99


def test_snap_and_maxima(spark):
    cells, grid = cells_of(spark, HILLS)
    peaks = spark.createDataFrame([(1, 0, 0), (2, 6, 6), (3, 3, 3)], "id int, row int, col int")
    got = {r["id"]: (r["row"], r["col"]) for r in snap_summits(peaks, cells, grid, "id", 1).collect()}
    assert got == {1: (1, 1), 2: (5, 5), 3: (4, 3)}
    assert {r["cell"] for r in local_maxima(cells, grid, size=3).collect()} == {8, 31, 36, 19, 48}


def test_decode_and_mask(spark):
    df = spark.createDataFrame([(128, 0, 0), (134, 27, 128), (0, 0, 0), (255, 255, 0), (145, 148, 1), (145, 148, 0)], "r int, g int, b int")
    z = decode_terrarium(df["r"], df["g"], df["b"])
    assert [(r[0], r[1]) for r in df.select(z, mask_implausible(z)).collect()] == [(0.0, 0.0), (1563.5, 1563.5), (-32768.0, None), (32767.0, None), (4500.00390625, None), (4500.0, 4500.0)]


def test_rasterize(spark):
    _, grid = cells_of(spark, "0 0 0 0\n0 0 0 0\n0 0 0 0")
    seg = spark.createDataFrame([(0.5, 0.5, 3.5, 0.5), (0.5, 1.5, 1.5, 2.5)], "x0 double, y0 double, x1 double, y1 double")
    assert {(r["row"], r["col"]) for r in rasterize(seg, grid).collect()} == {(0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (2, 1)}
