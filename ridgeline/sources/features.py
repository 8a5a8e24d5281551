"""Mapped features: roads by tag and route number, summits by box."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.geo import mercator_x, mercator_y

#: Road classes that are scanned, and geometry kinds of lines. Fixed values.
ROADS = ("motorway", "motorway_link", "trunk")
LINES = ("LineString", "MultiLineString")


def is_route(ref: Column, number: str = "90", letter: str = "I") -> Column:
    """Whether any item of a semicolon list holds both the number and the letter; a missing list does not."""
    return F.coalesce(F.exists(F.split(ref, ";"), lambda v: v.contains(number) & F.upper(v).contains(letter)), F.lit(False))


def road_lines(ways: DataFrame) -> DataFrame:
    """Line features of the scanned road classes."""
    return ways.filter(F.try_element_at("tags", F.lit("highway")).isin(*ROADS) & F.col("geom_type").isin(*LINES))


def route(ways: DataFrame, name: str = "I 90") -> DataFrame:
    """One row: the route's name and its distinct segments as the parts of a line; a route without segments raises an error when it is read."""
    segs = distinct_segments(road_lines(ways).filter(is_route(F.col("ref"))))
    parts = F.array_sort(F.collect_list(F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))))
    one = segs.agg(parts.alias("parts"))
    return one.select(F.lit(name).alias("name"), F.when(F.size("parts") > 0, F.col("parts")).otherwise(F.raise_error(F.lit("no such route"))).alias("parts"))


def distinct_segments(ways: DataFrame) -> DataFrame:
    """Segments of all parts, each once whichever way it runs: x0, y0, x1, y1."""
    p = ways.select(F.explode("parts").alias("pts")).filter(F.size("pts") >= 2)
    s = p.select(F.explode(F.arrays_zip(F.slice("pts", 1, F.size("pts") - 1).alias("a"), F.slice("pts", 2, F.size("pts") - 1).alias("b"))).alias("s"))
    a, b = F.struct(F.col("s.a.x").alias("x"), F.col("s.a.y").alias("y")), F.struct(F.col("s.b.x").alias("x"), F.col("s.b.y").alias("y"))
    return s.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct().select(F.col("a.x").alias("x0"), F.col("a.y").alias("y0"), F.col("b.x").alias("x1"), F.col("b.y").alias("y1"))


def projected(segments: DataFrame) -> DataFrame:
    """Segments in degrees brought to EPSG:3857."""
    return segments.withColumns({"x0": mercator_x(F.col("x0")), "y0": mercator_y(F.col("y0")), "x1": mercator_x(F.col("x1")), "y1": mercator_y(F.col("y1"))})


def summits(features: DataFrame, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Mapped summits: those tagged natural=peak where the table has tags, within a box (west, south, east, north) of lon and lat if one is given."""
    if "tags" in features.columns:
        features = features.filter(F.try_element_at("tags", F.lit("natural")) == "peak")
    return features if box is None else features.filter(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))


def named(peaks: DataFrame) -> DataFrame:
    """Features with a name; a table without names has none."""
    return peaks.filter("name IS NOT NULL") if "name" in peaks.columns else peaks.limit(0)


def present(df: DataFrame, *columns: str) -> DataFrame:
    """Those of the columns that are there."""
    return df.select(*(c for c in columns if c in df.columns))
