"""Heights and their units, the forest, and record linkage."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ridgeline.functions.heights import number_in, stated_unit, unit_of_note, unit_of_remark
from ridgeline.operators.forest import Forest
from ridgeline.operators.record_linkage import edit_share, fit_patterns, link, name_level, posterior
from ridgeline.operators.unit_inference import infer_units
from ridgeline.plans.data_quality import linked_summits

TEXTS = {
    "1000": (1000.0, None), "1,035 m": (1035.0, "m"), "0,786 km": (0.786, "km"), "approx. 0.71 kilometres": (0.71, "km"), "10030′": (10030.0, "ft"), "ca. 2404 foot": (2404.0, "ft"), "ft 10128": (10128.0, "ft"), "10331 Fuß": (10331.0, "ft"),
    "13157 pies": (13157.0, "ft"), "1022 m ü. M.": (1022.0, "m"), "10199 dm": (10199.0, "dm"), "~1019": (1019.0, None), "?": (None, None), "": (None, None), None: (None, None), "1039 M": (1039.0, "m"),
}
REMARKS = {"3 m cairn": None, "metal box on top": None, "moved 40 m south": None, "elev. metric": "m", "value in meters, not feet": "m", "x0.1 m": "dm", "tenths of m": "dm", "feet": "ft", "alt. m.s.n.m.": "m", "(m)": "m", None: None, "club visit in May": None}
NOTES = {"heights and prominence in feet": "ft", "Gipfelhöhe in Metern, Schartenhöhe in Fuß": "m", "mixed; else feet": "mixed", "ELEV stored as whole tenths of a metre": "dm", "hauteur du sommet exprimée en kilomètres": "km", None: None}


def test_written_heights(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    assert [(r[0], r[1]) for r in df.select(number_in(F.col("t")), stated_unit(F.col("t"))).collect()] == list(TEXTS.values())
    for cases, f in ((REMARKS, unit_of_remark), (NOTES, unit_of_note)):
        got = spark.createDataFrame([(t,) for t in cases], "t string").select(f(F.col("t"))).collect()
        assert [r[0] for r in got] == list(cases.values())


def test_forest_learns_and_is_calibrated():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 5))
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] > 0.5)
    x[rng.random(x.shape) < 0.02] = np.nan
    f = Forest(3).fit(x[:1000], y[:1000])
    p = f.predict(x[1000:])
    assert (p.argmax(1) == y[1000:]).mean() > 0.93 and abs(p.max(1).mean() - (p.argmax(1) == y[1000:]).mean()) < 0.05


_RECORD = "key long, kind int, meant string, value double, decimals int, padded boolean, stated string, remark string, remark_unit string, source string, note_unit string, sibling double, prom_ft double, x double, y double, extra string"


def _heights(n=400):
    rng, rows = np.random.default_rng(2), []
    for k in range(n):
        h, x, y = float(rng.uniform(500, 4000)), float(rng.uniform(0, 2e6)), float(rng.uniform(0, 2e6))
        feet = k % 2 == 0
        rows.append((4 * k + 1, 1, "ft", h / 0.3048 if feet else h, None, False, None, None, None, "list_f" if feet else "list_m", None, None, 300.0, x, y, "e"))
        if k % 4 < 2:
            rows.append((4 * k + 2, 2, "m", h, 1, False, "m", None, None, None, None, None, None, x + 50, y, "e"))
        rows.append((4 * k, 0, "m", h, None, False, None, None, None, "run", "m", h / 0.3048, 300.0, x, y + 40, "e"))
    return rows


def test_units_from_neighbours_and_sources(spark):
    rows = _heights() + [(9001, 1, "ft", None, None, False, None, None, None, None, None, None, None, None, None, None), (9005, 1, "ft", 1500.0, None, False, None, None, None, None, None, None, None, None, None, None)]
    got = infer_units(spark.createDataFrame(rows, _RECORD)).toPandas().set_index("key")
    assert 9001 not in got.index and 9005 in got.index
    listed = got[got["kind"] == 1].drop(index=9005)
    want = np.where((listed.index // 4) % 2 == 0, "ft", "m")
    assert (listed["unit"].to_numpy() == want).mean() > 0.98
    assert (got[got["kind"] == 0]["unit"] == "m").mean() > 0.98 and (got[got["kind"] == 2]["status"] == "stated").all()
    assert np.allclose(got["height_m"], got["value"] * got["unit"].map({"m": 1, "ft": 0.3048, "km": 1000, "dm": 0.1, "cm": 0.01}))


def test_units_of_nothing(spark):
    df = spark.createDataFrame(_heights(3), _RECORD)
    assert infer_units(df.limit(0)).count() == 0 and infer_units(df).count() == df.count()


def test_names():
    assert name_level("Mount Gripek", "GRIPEK MOUNTAIN") == 3 and name_level("Mane Butte, Faidrok", "Faidrok Mane Butte") == 3 and name_level("Druzal Peak", "Druzal ePak") >= 2
    assert name_level("Bruma Horn - S top", "Bruma Horn") == 3 and name_level("Zánem Peak", "Zanem Peak / Fetarnspitze") == 3 and name_level("Sefayelt Peak", "Traitriern Notch") == 0
    assert name_level(None, "x") is None and name_level("", "x") is None and name_level("!!", "x") is None
    assert edit_share("abcd", "acbd") == 0.75 and edit_share("", "a") == 0.0


def test_patterns_are_told_apart():
    rng = np.random.default_rng(5)
    match = rng.random(5000) < 0.3
    a = np.where(match, rng.random(5000) < 0.95, rng.random(5000) < 0.05).astype(int)
    b = np.where(match, rng.random(5000) < 0.9, rng.random(5000) < 0.1).astype(float)
    b[rng.random(5000) < 0.3] = np.nan
    t = pd.DataFrame({"a": a, "b": b}).groupby(["a", "b"], dropna=False).size().rename("n").reset_index()
    share, m, u = fit_patterns(t, {"a": 2, "b": 2}, {"a": 1, "b": 1})
    assert abs(share - 0.3) < 0.06 and m["a"][1] > 0.85 and u["a"][1] < 0.15
    assert posterior({"a": np.array([1]), "b": np.array([-1])}, share, m, u)[0] > 0.8


def test_link_of_nothing(spark):
    df = spark.createDataFrame([], "peak_id long, osm_id long, a int")
    assert link(df, {"a": 2}, {"a": 1}).count() == 0


def _summits(spark, folder, left, right):
    """Tables for linked_summits: left (peak_id, label, elev_ft, prom_ft, lon, lat), right (osm_id, name, ele, prominence, lon, lat)."""
    spark.createDataFrame(left, "peak_id long, label string, elev_ft double, prom_ft double, lon double, lat double").write.parquet(f"{folder}/peaks_corridor.parquet")
    df = spark.createDataFrame(right, "osm_id long, name string, ele string, prominence string, lon double, lat double")
    df.select("osm_id", "name", "ele", "prominence", F.when(F.col("lon").isNotNull(), F.struct(F.col("lon").alias("x"), F.col("lat").alias("y"))).alias("geometry")).write.parquet(f"{folder}/osm_peaks.parquet")


def test_common_names_find_records_without_position(spark, tmp_path):
    bearers = [(k, "Red Shoulder", f"{1000 + 100 * k} m", None, -121.0 + k / 50, 47.0) for k in range(30)]
    left = [(1, "Red Shoulder", 1500 / 0.3048, 400.0, None, None), (2, "Red Shoulder", 2000 / 0.3048, 400.0, -120.8, 47.0), (3, "Red Shoulder", 1200 / 0.3048, 400.0, -90.0, 40.0)]
    _summits(spark, tmp_path, left, [*bearers, (99, "Red Shoulder", "1205 m", None, None, None)])
    got = {(r["peak_id"], r["osm_id"]): r["apart"] for r in linked_summits(spark, str(tmp_path)).collect()}
    assert (1, 5) in got and (3, 99) in got and got[2, 10] < 1 and (2, 5) not in got and (3, 2) not in got


def test_bearers_of_a_name_rule_each_other_out(spark):
    df = spark.createDataFrame([(k, 1, n) for k, n in enumerate((1, 1, 400))] + [(k, 0, 1) for k in range(9, 15)], "peak_id long, a int, rivals long")
    plain, among = ({r["peak_id"]: r["confidence"] for r in link(df, {"a": 2}, {"a": 1}, r).collect()} for r in (None, "rivals"))
    assert plain[0] == plain[2] == among[0] and abs(among[2] / (1 - among[2]) * 400 - plain[2] / (1 - plain[2])) < 1e-6
