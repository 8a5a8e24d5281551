"""Session helpers shared by every operator."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when its measured size stays below this many bytes.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors of a cluster that may not have it on its path. Does nothing in local mode or when done before."""
    sc = spark.sparkContext
    if sc.master.startswith("local[") or sc.master == "local" or getattr(sc, "_ridgeline_sent", False):
        return
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    at = Path(tempfile.mkdtemp()) / "ridgeline_src.zip"
    at.write_bytes(data.getvalue())
    sc.addPyFile(str(at))
    sc._ridgeline_sent = True


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the folder named by spark.checkpoint.dir; a folder of our own only where that is unset (tests)."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir", "")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "ridgeline-checkpoints"))
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int, row_bytes: int) -> bool:
    """Whether a DataFrame has at most `rows` rows and these fit the broadcast bound; looks at no more than rows + 1 rows."""
    return rows * row_bytes <= BROADCAST_BYTES and df.limit(rows + 1).count() <= rows


def one_delivery(df: DataFrame, *keys: str, late: str = "loaded_at") -> DataFrame:
    """One row per key: repeated deliveries are copies that differ at most in `late`, so any of them will do; the earliest is not needed."""
    return df.drop(late).dropDuplicates(list(keys)) if late in df.columns else df.dropDuplicates(list(keys))


def numbered(df: DataFrame, name: str, *order, by: str | None = None) -> DataFrame:
    """Adds the place of each row in an order, from 0, within each value of `by`. Rows are sorted by range over all tasks and counted by task, so no task sees them all, nor all of a
    value's; what reaches the driver is one count per task."""
    sorted_ = cut(df.orderBy(*([F.col(by)] if by else []), *order).select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_n")))
    sizes = sorted_.groupBy("_p").agg(F.count(F.lit(1)).alias("c"), F.min("_n").alias("first")).orderBy("_p").collect()
    before, offsets = 0, []
    for r in sizes:
        offsets += [F.lit(r["_p"]), F.lit(before - r["first"])]
        before += r["c"]
    out = sorted_.withColumn(name, F.col("_n") + F.create_map(*offsets)[F.col("_p")] if offsets else F.lit(0).cast("long")).drop("_p", "_n")
    if by is None:
        return out
    starts = out.groupBy(by).agg(F.min(name).alias("_s"))
    return out.join(starts, out[by].eqNullSafe(starts[by])).drop(starts[by]).withColumn(name, F.col(name) - F.col("_s")).drop("_s")


def stable_unit(*cols) -> F.Column:
    """A number in [0, 1) that depends on the columns' values only."""
    return (F.xxhash64(*cols).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))).cast("double")
