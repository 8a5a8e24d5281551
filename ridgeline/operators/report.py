"""Cross-checks against an independent list, and distributions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.operators.nearest import nearest_within
from ridgeline.session import cut, numbered

#: Prominence bands in feet: from, to. Fixed values.
BANDS = ((250, 500), (500, 1000), (1000, 2000), (2000, 1_000_000_000))


def cross_check(ours: DataFrame, reference: DataFrame, radius: float = 300.0) -> DataFrame:
    """One row: how many reference peaks have one of ours within the radius, and how far the nearest differs. Both: peak_id, x, y, prom_ft. Measures of matched
    pairs are NULL where nothing matches."""
    ref = reference.select(F.col("peak_id").alias("ref_id"), "x", "y", F.col("prom_ft").alias("ref_prom"))
    near = nearest_within(ref, "ref_id", ours, "peak_id", radius)
    pairs = near.join(ours.select("peak_id", F.col("prom_ft").alias("our_prom")), "peak_id").join(ref.select("ref_id", "ref_prom"), "ref_id")
    diff = F.col("our_prom") - F.col("ref_prom")
    m = pairs.agg(F.count(F.lit(1)).alias("matched"), F.median("distance").alias("median_pos_err_m"), F.median(diff).alias("median_prom_diff_ft"), F.avg(F.abs(diff)).alias("mean_abs_prom_diff_ft"))
    n, k = ref.agg(F.count(F.lit(1)).alias("reference_peaks")), ours.agg(F.count(F.lit(1)).alias("our_peaks"))
    one = n.join(k, how="cross").join(m, how="cross")  # one row each
    rate = F.try_divide(F.col("matched").cast("double"), F.col("reference_peaks"))
    return one.select("reference_peaks", "our_peaks", "matched", (F.col("reference_peaks") - F.col("matched")).alias("unmatched"), rate.alias("match_rate"), "median_pos_err_m", "median_prom_diff_ft", "mean_abs_prom_diff_ft")


def prominence_bands(df: DataFrame, bands=BANDS) -> DataFrame:
    """Peaks per band of prom_ft (from inclusive, to exclusive), empty bands with 0."""
    table = df.sparkSession.createDataFrame(list(bands), "lo long, hi long")
    band = F.lit(None).cast("long")
    for lo, hi in bands:
        band = F.when((F.col("prom_ft") >= lo) & (F.col("prom_ft") < hi), F.lit(lo)).otherwise(band)
    counted = df.select(band.alias("lo")).filter("lo IS NOT NULL").groupBy("lo").agg(F.count(F.lit(1)).alias("peaks"))
    return table.join(counted, "lo", "left").select("lo", "hi", F.coalesce("peaks", F.lit(0)).alias("peaks"))


def distance_quantiles(df: DataFrame, column: str) -> DataFrame:
    """Median, 90th percentile (interpolated) and maximum; NULL where there are no values. Values are sorted by range and numbered, so no task holds them all; those at the places
    sought reach the driver."""
    v = cut(numbered(df.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL"), "place", F.col("v")))
    n = v.count()
    at = [(n - 1) * q for q in (0.5, 0.9, 1.0)]
    ends = [(math.floor(x), math.ceil(x)) for x in at]
    held = {r["place"]: r["v"] for r in v.filter(F.col("place").isin(*{k for e in ends for k in e})).collect()} if n else {}
    row = tuple(held[lo] if held[lo] == held[hi] else (hi - x) * held[lo] + (x - lo) * held[hi] for x, (lo, hi) in zip(at, ends, strict=True)) if n else (None,) * 3
    return df.sparkSession.createDataFrame([row], "median double, p90 double, largest double")


def class_counts(df: DataFrame) -> DataFrame:
    """All peaks, those in the first row and the others."""
    return df.agg(F.count(F.lit(1)).alias("peaks"), F.count_if("frontrow").alias("front"), F.count_if(~F.col("frontrow")).alias("behind"))
