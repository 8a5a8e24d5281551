"""Raw lines parsed as they arrive.

The line parser has no state, so a stream of lines needs no watermark; lines that are to come out once each are told apart within one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ridgeline.operators.line_rejects import load_lines, rejected_lines, valid_lines


def stream_lines(spark: SparkSession, folder: str, schema: str = "line_id long, src_file string, raw_line string, loaded_at timestamp") -> DataFrame:
    """A stream over the Parquet files of a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def once_each(lines: DataFrame, lateness: str = "180 days") -> DataFrame:
    """Repeated deliveries of a line dropped, as far apart as the lateness."""
    return lines.withWatermark("loaded_at", lateness).dropDuplicatesWithinWatermark(["line_id"])


def write_split(lines: DataFrame, good: str, bad: str, checkpoint: str) -> StreamingQuery:
    """Typed records to one Parquet folder, rejected lines to another. Each batch has a folder of its own by its number, which a repeated run of it writes anew, so none comes out
    twice."""

    def both(batch: DataFrame, number: int) -> None:
        loaded = load_lines(batch).persist()
        valid_lines(loaded).write.mode("overwrite").parquet(f"{good}/batch={number}")
        rejected_lines(loaded).select("line_id", "src_file", "raw_line", "reason").write.mode("overwrite").parquet(f"{bad}/batch={number}")
        loaded.unpersist()

    return lines.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
