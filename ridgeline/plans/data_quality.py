"""Queries of the general data-processing problems (p1 to p5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridgeline.functions.geo import mercator_x, mercator_y
from ridgeline.functions.heights import number_in, stated_unit, to_metres, unit_of_note, unit_of_remark
from ridgeline.operators.line_rejects import load_lines, rejected_lines
from ridgeline.operators.packed_values import split_values
from ridgeline.operators.record_linkage import link, name_agreement, name_key, steps
from ridgeline.operators.spatial_join import within_distance, within_regions
from ridgeline.operators.unit_inference import infer_units
from ridgeline.session import cut, one_delivery, ship, table

#: The name-matching distance, in projected metres.
NAME_RADIUS = 200.0


def corridor_points(spark: SparkSession, folder: str) -> DataFrame:
    """peaks_corridor records with a position, each once, in EPSG:3857."""
    rows = one_delivery(table(spark, folder, "peaks_corridor").select("peak_id", "lat", "lon"), "peak_id")
    return rows.select("peak_id", mercator_x(F.col("lon")).alias("x"), mercator_y(F.col("lat")).alias("y"))


def feature_points(spark: SparkSession, folder: str) -> DataFrame:
    """osm_peaks features with a geometry, each once, in EPSG:3857."""
    rows = one_delivery(table(spark, folder, "osm_peaks").select("osm_id", "geometry"), "osm_id")
    return rows.select("osm_id", mercator_x(F.col("geometry.x")).alias("x"), mercator_y(F.col("geometry.y")).alias("y"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The values of each way's ref that holds two or more."""
    ship(spark)
    ways = one_delivery(table(spark, folder, "osm_ways").filter("ref IS NOT NULL").select("osm_id", "ref"), "osm_id")
    return split_values(ways, "osm_id", "ref").filter("n_values >= 2").select("osm_id", "pos", "item")


#: The tables of heights: name, key, unit that the field is meant for.
HEIGHT_TABLES = (("peaks_computed", "peak_id", "m"), ("peaks_corridor", "peak_id", "ft"), ("osm_peaks", "osm_id", "m"))


def height_records(spark: SparkSession, folder: str) -> DataFrame:
    """The heights of the three tables in one form. key = id * 4 + number of the table."""
    null = lambda kind: F.lit(None).cast(kind)
    a = one_delivery(table(spark, folder, "peaks_computed"), "peak_id").select(
        (F.col("peak_id") * 4).alias("key"), F.lit(0).alias("kind"), F.lit("m").alias("meant"), F.col("elev_m").cast("double").alias("value"), null("int").alias("decimals"), F.lit(False).alias("padded"),
        null("string").alias("stated"), null("string").alias("remark"), null("string").alias("remark_unit"), F.col("run_tag").alias("source"), F.col("elev_ft").alias("sibling"), "prom_ft",
        mercator_x(F.col("lon")).alias("x"), mercator_y(F.col("lat")).alias("y"),
    )
    b = one_delivery(table(spark, folder, "peaks_corridor"), "peak_id").select(
        (F.col("peak_id") * 4 + 1).alias("key"), F.lit(1).alias("kind"), F.lit("ft").alias("meant"), F.col("elev_ft").alias("value"), null("int").alias("decimals"), F.lit(False).alias("padded"),
        null("string").alias("stated"), "remark", unit_of_remark(F.col("remark")).alias("remark_unit"), F.col("list_code").alias("source"), null("double").alias("sibling"), "prom_ft",
        mercator_x(F.col("lon")).alias("x"), mercator_y(F.col("lat")).alias("y"),
    )
    c = one_delivery(table(spark, folder, "osm_peaks"), "osm_id").select(
        (F.col("osm_id") * 4 + 2).alias("key"), F.lit(2).alias("kind"), F.lit("m").alias("meant"), number_in(F.col("ele")).alias("value"), F.length(F.regexp_extract("ele", r"\.([0-9]+)", 1)).alias("decimals"), F.col("ele").rlike(r"^\s|\s$").alias("padded"),
        stated_unit(F.col("ele")).alias("stated"), null("string").alias("remark"), null("string").alias("remark_unit"), F.col("import_tag").alias("source"), null("double").alias("sibling"), null("double").alias("prom_ft"),
        mercator_x(F.col("geometry.x")).alias("x"), mercator_y(F.col("geometry.y")).alias("y"),
    )
    notes = table(spark, folder, "peak_sources").dropDuplicates(["table_name", "source_code"]).select(F.col("source_code").alias("source"), F.col("table_name").alias("of"), unit_of_note(F.col("unit_note")).alias("note_unit"))
    rows = a.unionByName(b).unionByName(c).withColumn("of", F.element_at(F.array(*(F.lit(t) for t, _, _ in HEIGHT_TABLES)), F.col("kind") + 1))
    return rows.join(notes, ["source", "of"], "left")


def heights(spark: SparkSession, folder: str) -> DataFrame:
    """Every height in metres, with the unit it was recorded in and how sure that is."""
    ship(spark)
    found = infer_units(height_records(spark, folder))
    name = F.element_at(F.array(*(F.lit(t) for t, _, _ in HEIGHT_TABLES)), F.col("kind") + 1)
    meant = F.element_at(F.array(*(F.lit(u) for _, _, u in HEIGHT_TABLES)), F.col("kind") + 1)
    return found.select(name.alias("table_name"), F.shiftright("key", 2).alias("rec_id"), "value", "unit", meant.alias("meant_unit"), "height_m", "probability", "status")


def p2_heights(spark: SparkSession, folder: str) -> DataFrame:
    """All heights in metres."""
    return heights(spark, folder)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records whose height is, by a stated or a confident unit, not in the unit its field is meant for."""
    return heights(spark, folder).filter("unit <> meant_unit AND status <> 'review'").select("table_name", "rec_id", "unit")


def p2_review(spark: SparkSession, folder: str) -> DataFrame:
    """Records whose unit is not sure enough to convert them, with the likeliest unit."""
    return heights(spark, folder).filter("status = 'review'").select("table_name", "rec_id", "value", "unit", "probability")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of a record and a feature within the name-matching distance."""
    ship(spark)
    pairs = within_distance(corridor_points(spark, folder), "peak_id", feature_points(spark, folder), "osm_id", NAME_RADIUS)
    return pairs.select(F.col("left_id").alias("peak_id"), F.col("right_id").alias("osm_id"))


def p3_regions(spark: SparkSession, folder: str) -> DataFrame:
    """The mapped features within the region between a reference peak and its key saddle: the triangle of both and of the corner south or north of the peak, in plain degrees."""
    ship(spark)
    peaks = one_delivery(table(spark, folder, "peaks_corridor").select("peak_id", "lat", "lon", "ksaddle_lat", "ksaddle_lon"), "peak_id").filter("lat IS NOT NULL AND lon IS NOT NULL")
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    regions = peaks.select("peak_id", F.array(F.array(corner("lon", "lat"), corner("lon", "ksaddle_lat"), corner("ksaddle_lon", "ksaddle_lat"))).alias("rings"))
    points = one_delivery(table(spark, folder, "osm_peaks").select("osm_id", "geometry"), "osm_id").select("osm_id", "geometry.x", "geometry.y")
    held = within_regions(points, "osm_id", regions, "peak_id", "rings")
    return held.select(F.col("right_id").alias("peak_id"), F.col("left_id").alias("osm_id"))


#: Projected metres within which records are compared, and the side of the squares within which they do not rule each other out.
LINK_RADIUS, PLACE = 1000.0, 5000.0
#: Comparisons: number of levels, and the level from which each starts out as a sign of a match.
LINK_LEVELS = {"name": 4, "distance": 6, "elevation": 5, "prominence": 4}
LINK_AGREE = {"name": 2, "distance": 2, "elevation": 3, "prominence": 2}
#: Units that a height may be in, by side; a named unit rules the others out.
_LEFT_UNITS, _RIGHT_UNITS = (0.3048, 1.0, 0.1, 1000.0, 0.01), (1.0, 0.3048)
#: No summit is higher. Fixed value.
HIGHEST = 9000


def _readings(value: Column, units: tuple[float, ...], unit: Column | None = None) -> Column:
    """The heights in metres that a number may mean."""
    open_ = F.filter(F.array(*(value * k for k in units)), lambda h: (h > 0) & (h <= HIGHEST))
    return open_ if unit is None else F.when(unit.isNotNull(), F.array(to_metres(value, unit))).otherwise(open_)


def _least_difference(a: Column, b: Column) -> Column:
    """The least relative difference between any reading of one side and any of the other."""
    return F.array_min(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.abs(x - y) / F.greatest(x, y)))))


def linked_summits(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of records and features with the levels of their comparisons and the confidence that they are the same summit.

    Blocking: all within LINK_RADIUS of each other; and, where a side has no position, the same name, however many bear it, and a height within two hundredths.
    Only records without a position meet all bearers of their name, so a common name gives no more pairs than these have bearers of like height. The more
    bear the name, the less it says: the odds of such a pair are divided by their number on the other side, and, as a summit is in one place, set against
    those of the same record's pairs with other places (squares of PLACE metres)."""
    left = one_delivery(table(spark, folder, "peaks_corridor"), "peak_id").select(
        "peak_id", "label", "prom_ft", _readings(F.col("elev_ft"), _LEFT_UNITS).alias("h1"), mercator_x(F.col("lon")).alias("x"), mercator_y(F.col("lat")).alias("y")
    )
    right = one_delivery(table(spark, folder, "osm_peaks"), "osm_id").select(
        "osm_id", "name", _readings(number_in(F.col("ele")), _RIGHT_UNITS, stated_unit(F.col("ele"))).alias("h2"), _readings_ft(F.col("prominence")).alias("p2"),
        mercator_x(F.col("geometry.x")).alias("x"), mercator_y(F.col("geometry.y")).alias("y"),
    )
    left, right = cut(left.withColumn("lkey", name_key("label"))), cut(right.withColumn("rkey", name_key("name")))  # read by every pass
    near = within_distance(left, "peak_id", right, "osm_id", LINK_RADIUS).select(F.col("left_id").alias("peak_id"), F.col("right_id").alias("osm_id"), F.col("distance").alias("apart"))
    bucket = lambda h, d: F.explode(F.array_distinct(F.transform(h, lambda v: F.floor(F.ln(v) * 50) + d)))
    place = lambda k: F.coalesce(F.concat(F.floor(F.col("x") / PLACE), F.lit("/"), F.floor(F.col("y") / PLACE)), F.col(k).cast("string"))
    a = left.filter("lkey IS NOT NULL").select("peak_id", F.col("lkey").alias("rkey"), F.col("x").isNull().alias("lost"), place("peak_id").alias("place"), bucket(F.col("h1"), F.lit(0)).alias("b"))
    b = right.filter("rkey IS NOT NULL").select("osm_id", "rkey", F.col("x").isNull().alias("rlost"), place("osm_id").alias("place"), bucket(F.col("h2"), F.lit(0)).alias("b"))
    beside = F.explode(F.array(*(F.col("b") + d for d in (-1, 0, 1)))).alias("b")
    rivals = lambda df: df.filter("rkey IS NOT NULL").groupBy("rkey").agg(F.count(F.lit(1)).alias("rivals"))
    of = lambda k: ("peak_id", "osm_id", "rivals", F.struct(F.lit(k).alias("side"), F.col(k).alias("id"), "place").alias("of"))
    far = a.filter("lost").select("peak_id", "rkey", beside).join(rivals(right), "rkey").join(b, ["rkey", "b"]).select(*of("peak_id"))
    back = b.filter("rlost").select("osm_id", "rkey", beside).join(rivals(left.withColumnRenamed("lkey", "rkey")), "rkey").join(a, ["rkey", "b"]).select(*of("osm_id"))
    far = far.unionByName(back).groupBy("peak_id", "osm_id").agg(F.max("rivals").alias("rivals"), F.min("of").alias("of")).withColumn("apart", F.lit(None).cast("double"))
    pairs = near.withColumn("rivals", F.lit(1).cast("long")).unionByName(far, allowMissingColumns=True).join(left.drop("x", "y", "lkey"), "peak_id").join(right.drop("x", "y", "rkey"), "osm_id")
    compared = pairs.select(
        "peak_id", "osm_id", "apart", "rivals", "of", name_agreement("label", "name").alias("name"), steps(F.col("apart"), 700, 450, 300, 150, 60).alias("distance"),
        steps(_least_difference(F.col("h1"), F.col("h2")), 0.05, 0.02, 0.008, 0.003).alias("elevation"),
        steps(F.array_min(F.transform("p2", lambda p: F.abs(p - F.col("prom_ft")) / F.greatest(p, F.col("prom_ft")))), 0.15, 0.06, 0.02).alias("prominence"),
    )
    found = link(cut(compared), LINK_LEVELS, LINK_AGREE, "rivals")
    odds = F.col("confidence") / (1 - F.col("confidence"))
    total, here = (F.sum("odds").over(W.partitionBy(*by)) for by in (("of.side", "of.id"), ("of.side", "of.id", "of.place")))
    lost = found.filter("apart IS NULL").withColumn("odds", odds).withColumn("confidence", F.col("odds") / (1 + F.col("odds") + F.greatest(total - here, F.lit(0.0)))).drop("odds")
    return found.filter("apart IS NOT NULL").unionByName(lost).drop("rivals", "of")


def _readings_ft(text: Column) -> Column:
    """The prominences in feet that a text may mean."""
    v, u = number_in(text), stated_unit(text)
    return F.when(u.isNotNull(), F.array(to_metres(v, u) / 0.3048)).otherwise(F.filter(F.array(v, v / 0.3048), lambda p: p.isNotNull()))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs that are the same summit."""
    ship(spark)
    return linked_summits(spark, folder).filter("confidence >= 0.5").select("peak_id", "osm_id")


def p4_links(spark: SparkSession, folder: str) -> DataFrame:
    """All compared pairs with their confidence."""
    ship(spark)
    return linked_summits(spark, folder)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines without a valid record, with the first reason that holds."""
    ship(spark)
    return rejected_lines(load_lines(table(spark, folder, "kirmse_raw"))).select("line_id", "reason")


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_heights": p2_heights, "p2_review": p2_review, "p3_found": p3_found, "p3_regions": p3_regions, "p4_found": p4_found, "p4_links": p4_links, "p5_found": p5_found}
SQL: dict[str, str] = {
    "p3_found": """
WITH a AS (SELECT DISTINCT peak_id, radians(lon) * 6378137.0 AS x, 6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2)) AS y FROM peaks_corridor WHERE lat IS NOT NULL AND lon IS NOT NULL),
     b AS (SELECT DISTINCT osm_id, radians(geometry.x) * 6378137.0 AS x, 6378137.0 * ln(tan(pi() / 4 + radians(geometry.y) / 2)) AS y FROM osm_peaks WHERE geometry IS NOT NULL)
SELECT peak_id, osm_id FROM a JOIN b ON b.x BETWEEN a.x - 200 AND a.x + 200 AND b.y BETWEEN a.y - 200 AND a.y + 200
WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 200""",
    "p3_regions": """
WITH t AS (SELECT peak_id, [{'x': lon, 'y': lat}, {'x': lon, 'y': ksaddle_lat}, {'x': ksaddle_lon, 'y': ksaddle_lat}] AS pts FROM peaks_corridor
  WHERE lat IS NOT NULL AND lon IS NOT NULL AND ksaddle_lat IS NOT NULL AND ksaddle_lon IS NOT NULL QUALIFY row_number() OVER (PARTITION BY peak_id) = 1),
e AS (SELECT peak_id, pts[i] AS a, pts[i % 3 + 1] AS b FROM t, (VALUES (1), (2), (3)) v(i)),
p AS (SELECT DISTINCT osm_id, geometry.x AS x, geometry.y AS y FROM osm_peaks WHERE geometry IS NOT NULL)
SELECT peak_id, osm_id FROM e JOIN p ON y BETWEEN least(a.y, b.y) AND greatest(a.y, b.y) WHERE (a.y > y) <> (b.y > y) AND x < (b.x - a.x) * (y - a.y) / (b.y - a.y) + a.x
GROUP BY peak_id, osm_id HAVING count(*) % 2 = 1""",
    "p5_found": r"""
WITH l AS (SELECT line_id, coalesce(raw_line, '') AS t FROM kirmse_raw),
q AS (SELECT line_id, regexp_full_match(t, '([ \t\r]*"([^"]|"")*"[ \t\r]*|[^",]*)(,([ \t\r]*"([^"]|"")*"[ \t\r]*|[^",]*))*') AS ok, regexp_extract_all(t || ',', '([ \t\r]*"(?:[^"]|"")*"[ \t\r]*|[^",]*),', 1) AS f FROM l),
v AS (SELECT line_id, ok, len(f) AS n, list_transform(f[1:6], lambda x: trim(trim(trim(x, E' \t\r'), '"'), E' \t\r')) AS f FROM q),
w AS (SELECT line_id, ok, n, list_transform(f, lambda x: CASE WHEN regexp_full_match(x, '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast(x AS DOUBLE) END) AS d FROM v)
SELECT line_id, CASE WHEN NOT ok THEN 'quoting' WHEN n NOT BETWEEN 6 AND 7 THEN 'columns' WHEN len(list_filter(d, lambda x: x IS NULL)) > 0 THEN 'value' ELSE 'range' END AS reason
FROM w WHERE NOT ok OR n NOT BETWEEN 6 AND 7 OR len(list_filter(d, lambda x: x IS NULL)) > 0 OR NOT (d[1] BETWEEN -90 AND 90 AND d[4] BETWEEN -90 AND 90 AND d[2] BETWEEN -180 AND 180 AND d[5] BETWEEN -180 AND 180 AND d[3] BETWEEN -1500 AND 30000 AND d[6] BETWEEN 0 AND 30000)""",
}
