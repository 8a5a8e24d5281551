"""GeoPackage feature tables as a Spark source: SQLite rows with geometry as well-known binary."""

from __future__ import annotations

import sqlite3
import struct

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

#: Rows of one partition.
STRIDE = 50_000
_KINDS = {"INT": LongType(), "BOOL": BooleanType(), "REAL": DoubleType(), "DOUBLE": DoubleType(), "FLOAT": DoubleType(), "TEXT": StringType(), "BLOB": BinaryType()}


def wkb_of(blob: bytes) -> bytes:
    """The well-known binary inside a GeoPackage geometry."""
    if blob[:2] != b"GP":
        raise ValueError("not a GeoPackage geometry")
    return blob[8 + (0, 32, 48, 48, 64)[(blob[3] >> 1) & 7] :]


def points_of(wkb: bytes) -> list[list[tuple[float, float]]]:
    """Parts of a point, line, multi-line or polygon."""
    at = 0

    def shape() -> list:
        nonlocal at
        order = "<" if wkb[at] else ">"
        (kind,) = struct.unpack_from(order + "I", wkb, at + 1)
        at += 5

        def run(n: int) -> list:
            nonlocal at
            v = struct.unpack_from(f"{order}{2 * n}d", wkb, at)
            at += 16 * n
            return list(zip(v[::2], v[1::2], strict=True))

        def count() -> int:
            nonlocal at
            at += 4
            return struct.unpack_from(order + "I", wkb, at - 4)[0]

        if kind == 1:
            return [run(1)]
        if kind == 2:
            return [run(count())]
        if kind == 3:
            return [run(count()) for _ in range(count())]
        if kind in (4, 5, 6):
            return [p for _ in range(count()) for p in shape()]
        raise ValueError(f"geometry kind {kind}")

    return shape()


class _Range(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, geometry: str | None, columns: list[str]):
        self.path, self.table, self.geometry, self.columns = path, table, geometry, columns

    def partitions(self):
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as c:
            lo, hi = c.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        return [_Range(k, min(k + STRIDE - 1, hi)) for k in range(lo, hi + 1, STRIDE)] if lo is not None else []

    def read(self, part):
        cols = ", ".join(f'"{c}"' for c in self.columns)
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as c:
            for row in c.execute(f'SELECT {cols} FROM "{self.table}" WHERE rowid BETWEEN ? AND ?', (part.lo, part.hi)):
                yield tuple(wkb_of(v) if name == self.geometry and v is not None else v for name, v in zip(self.columns, row, strict=True))


class GeoPackage(DataSource):
    """spark.read.format("geopackage").option("path", file).option("table", name); the geometry column comes as well-known binary."""

    @classmethod
    def name(cls):
        return "geopackage"

    def _table(self) -> tuple[str, str | None, list[tuple[str, str]]]:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as c:
            table = self.options.get("table") or c.execute("SELECT table_name FROM gpkg_contents WHERE data_type = 'features' ORDER BY 1").fetchone()[0]
            shape = c.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", (table,)).fetchone()
            return table, shape and shape[0], [(r[1], r[2].upper()) for r in c.execute(f'PRAGMA table_info("{table}")')]

    def schema(self):
        _, shape, cols = self._table()
        return StructType([StructField(n, BinaryType() if n == shape else next((v for k, v in _KINDS.items() if k in t), StringType())) for n, t in cols])

    def reader(self, schema):
        table, shape, _ = self._table()
        return _Reader(self.options["path"], table, shape, [f.name for f in schema])
