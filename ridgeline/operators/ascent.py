"""First-row tests by tolerant ascent and by minimax ceiling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.operators.flood import reach_mark
from ridgeline.operators.raster import BLOCK, Grid, snap_summits


def classify_by_ascent(peaks: DataFrame, cells: DataFrame, seeds: DataFrame, grid: Grid, tolerance: float = 76.2, size: int = BLOCK) -> DataFrame:
    """peak_id, summit_elev_m, frontrow (a path leads up from the seeds without a fall beyond the tolerance), approach_crest_above_m. peaks: peak_id, row, col."""
    at = snap_summits(peaks, cells, grid, "peak_id")
    marks = reach_mark(cells, seeds, grid, tolerance, size).select("cell", "mark")
    found = at.withColumn("cell", grid.cell(F.col("row"), F.col("col"))).join(marks, "cell", "left")
    return found.select("peak_id", F.col("elev").alias("summit_elev_m"), F.col("mark").isNotNull().alias("frontrow"), (F.col("mark") - F.col("elev").cast("double")).alias("approach_crest_above_m"))


def classify_by_ceiling(peaks: DataFrame, cells: DataFrame, seeds: DataFrame, grid: Grid, size: int = BLOCK) -> DataFrame:
    """peak_id, summit_elev_m, barrier_above_m (how far the lowest path from the seeds must rise above the summit), frontrow (not at all)."""
    at = snap_summits(peaks, cells, grid, "peak_id")
    marks = reach_mark(cells, seeds, grid, None, size).select("cell", "mark")
    found = at.withColumn("cell", grid.cell(F.col("row"), F.col("col"))).join(marks, "cell", "left").withColumn("barrier_above_m", F.col("mark") - F.col("elev").cast("double"))
    return found.select("peak_id", F.col("elev").alias("summit_elev_m"), "barrier_above_m", F.coalesce(F.col("barrier_above_m") <= 0, F.lit(False)).alias("frontrow"))
