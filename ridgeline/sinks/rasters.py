"""Rasters as tiles: one row per square of cells with its values row by row, instead of a row per cell."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.operators.raster import BLOCK, Grid


def tiles_of(cells: DataFrame, value: str, size: int = BLOCK) -> DataFrame:
    """tr, tc, z ARRAY<FLOAT> of size * size values, NULL where a cell is missing or has none. Cells carry row and col; true and false become 1 and 0."""
    placed = cells.select(F.expr(f"cast(row div {size} AS int)").alias("tr"), F.expr(f"cast(col div {size} AS int)").alias("tc"), (F.col("row") % size * size + F.col("col") % size).cast("int").alias("i"), F.col(value).cast("float").alias("v"))

    def fill(key: tuple, table: pa.Table) -> pa.Table:
        v = np.full(size * size, np.nan, np.float32)
        v[table["i"].to_numpy()] = table["v"].to_numpy(zero_copy_only=False)
        z = pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, mask=np.isnan(v)))
        return pa.table([pa.array([k.as_py()], pa.int32()) for k in key] + [z], names=["tr", "tc", "z"])

    return placed.groupBy("tr", "tc").applyInArrow(fill, "tr int, tc int, z array<float>")


def write_tiles(cells: DataFrame, value: str, path: str, size: int = BLOCK) -> str:
    """The tiles of a raster (heights, or a catchment's mask) as Parquet, by row of tiles."""
    tiles_of(cells, value, size).withColumn("size", F.lit(size)).write.mode("overwrite").partitionBy("tr").parquet(path)
    return path


def read_tiles(spark: SparkSession, path: str, grid: Grid, name: str = "elev") -> DataFrame:
    """Cells (cell, row, col, value) of written tiles, without those that have no value. A filter on tr reads only those rows of tiles."""
    t = spark.read.parquet(path).select("tr", "tc", "size", F.posexplode("z").alias("i", name)).filter(F.col(name).isNotNull())
    row, col = (F.col("tr") * F.col("size") + F.expr("i div size")).cast("int"), (F.col("tc") * F.col("size") + F.col("i") % F.col("size")).cast("int")
    return t.select(grid.cell(row, col).alias("cell"), row.alias("row"), col.alias("col"), name)
