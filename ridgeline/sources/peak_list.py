"""The reference peak list: text lines of six numbers, plain or in a zip archive."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bounding box of the corridor (west, south, east, north) and the least prominence in feet. Fixed values.
CORRIDOR = (-122.40, 46.75, -119.80, 47.75)
LEAST_FT = 250.0
FIELDS = ("lat", "lon", "elev_ft", "ksaddle_lat", "ksaddle_lon", "prom_ft")
NUMBER = r"(?i)^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)(e[+-]?[0-9]+)?\s*$|^\s*[+-]?(inf|infinity|nan)\s*$"


def _number(text: Column) -> Column:
    return F.when(text.rlike(NUMBER), F.trim(F.regexp_replace(text, r"\s", "")).try_cast("double"))


def parse_peak_list(lines: DataFrame, column: str, *keep: str) -> DataFrame:
    """Lines whose first six comma-separated fields are numbers, as columns; what follows a sixth field is ignored, all other lines are skipped."""
    f = F.split(F.col(column), ",")
    parsed = lines.withColumn("_f", f).filter(F.size("_f") >= 6).select(*keep, *(_number(F.get("_f", F.lit(k))).alias(c) for k, c in enumerate(FIELDS)))
    for c in FIELDS:
        parsed = parsed.filter(F.col(c).isNotNull())
    return parsed


def in_corridor(df: DataFrame, box: tuple[float, float, float, float] = CORRIDOR, least_ft: float = LEAST_FT) -> DataFrame:
    """Peaks of at least the prominence within the box, edges included."""
    w, s, e, n = box
    return df.filter((F.col("prom_ft") >= least_ft) & F.col("lat").between(s, n) & F.col("lon").between(w, e))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Column value: the lines of text files; a zip archive gives those of its largest member."""
    files = spark.read.format("binaryFile").load(path).select("path", F.substring("content", 1, 2).alias("magic"))
    zips = [r["path"] for r in files.filter("magic = X'504B'").select("path").collect()]  # names of files only
    plain = [r["path"] for r in files.filter("magic <> X'504B'").select("path").collect()]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("content"):
                with zipfile.ZipFile(io.BytesIO(data.as_py())) as z:
                    member = max(z.infolist(), key=lambda m: m.file_size)
                    with z.open(member) as f:
                        part: list[str] = []
                        for line in io.TextIOWrapper(f, encoding="utf-8", errors="replace"):
                            part.append(line.rstrip("\r\n"))
                            if len(part) == 10_000:
                                yield pa.RecordBatch.from_arrays([pa.array(part)], ["value"])
                                part = []
                        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string())], ["value"])

    out = spark.read.text(plain) if plain else spark.createDataFrame([], "value string")
    return out.unionByName(spark.read.format("binaryFile").load(zips).select("content").mapInArrow(unpack, "value string")) if zips else out
