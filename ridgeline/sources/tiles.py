"""Elevation tiles: which tiles cover a box, reading terrarium images, and fetching them one partition per tile."""

from __future__ import annotations

import math
import struct
import time
import urllib.request
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ridgeline.operators.raster import Grid

#: Pixels of a tile's side, tries and seconds of a fetch. Fixed values.
TILE, TRIES, PATIENCE = 256, 4, 30
#: East and south edges count to the tile before, by this much. Fixed value.
INSET = 1e-11


def tile_of(lon: float, lat: float, zoom: int) -> tuple[int, int]:
    """The slippy-map tile of a point."""
    n, s = 1 << zoom, math.sin(math.radians(lat))
    x, y = lon / 360 + 0.5, 0.5 - 0.25 * math.log((1 + s) / (1 - s)) / math.pi
    return tuple(0 if v <= 0 else n - 1 if v >= 1 else int(math.floor((v + 1e-14) * n)) for v in (x, y))


def tile_extent(box: tuple[float, float, float, float], zoom: int) -> tuple[int, int, int, int]:
    """Least x, least y, greatest x, greatest y of the tiles that cover west, south, east, north."""
    w, s, e, n = box
    (x0, y0), (x1, y1) = tile_of(w, n, zoom), tile_of(e - INSET, s + INSET, zoom)
    return x0, y0, x1, y1


def tile_cover(spark: SparkSession, box: tuple[float, float, float, float], zoom: int) -> DataFrame:
    """z, x, y of the tiles that cover a box."""
    x0, y0, x1, y1 = tile_extent(box, zoom)
    xs = spark.range(x0, x1 + 1).select(F.lit(zoom).alias("z"), F.col("id").cast("int").alias("x"))
    return xs.select("z", "x", F.explode(F.sequence(F.lit(y0), F.lit(y1))).alias("y"))


def grid_of(box: tuple[float, float, float, float], zoom: int) -> Grid:
    """Shape, corner and cell size of the mosaic of a cover."""
    x0, y0, x1, y1 = tile_extent(box, zoom)
    world = 2 * math.pi * 6378137.0
    cell = world / (1 << zoom) / TILE
    return Grid((y1 - y0 + 1) * TILE, (x1 - x0 + 1) * TILE, x0 * TILE * cell - world / 2, world / 2 - y0 * TILE * cell, cell, cell)


def decode_png(data: bytes) -> np.ndarray:
    """Height, width, channels of an 8-bit RGB or RGBA image that is not interlaced."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG image")
    at, packed, head = 8, [], None
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body, at = data[at + 8 : at + 8 + n], at + 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
    width, height, depth, colour, _, _, laced = head
    if depth != 8 or colour not in (2, 6) or laced:
        raise ValueError("unsupported PNG kind")
    c = 3 if colour == 2 else 4
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * c)
    out = np.zeros((height, width, c), np.int64)
    above = np.zeros((width, c), np.int64)
    for r in range(height):
        way, line = raw[r, 0], raw[r, 1:].reshape(width, c).astype(np.int64)
        if way == 0:
            now = line
        elif way == 1:
            now = np.cumsum(line, axis=0) & 255
        elif way == 2:
            now = (line + above) & 255
        else:
            now, left, corner = line.copy(), np.zeros(c, np.int64), np.zeros(c, np.int64)
            for k in range(width):
                if way == 3:
                    guess = (left + above[k]) // 2
                else:
                    p = left + above[k] - corner
                    a, b, d = abs(p - left), abs(p - above[k]), abs(p - corner)
                    guess = np.where((a <= b) & (a <= d), left, np.where(b <= d, above[k], corner))
                now[k] = (line[k] + guess) & 255
                left, corner = now[k], above[k]
        out[r] = above = now
    return out


def heights_of(data: bytes) -> np.ndarray:
    """Elevations of a terrarium image, row by row."""
    p = decode_png(data)
    return (p[..., 0] * 256 + p[..., 1] + p[..., 2] / 256 - 32768).astype(np.float32).ravel()


def read_terrarium(spark: SparkSession, folder: str) -> DataFrame:
    """z, x, y, heights (column z_m ARRAY<FLOAT>) of stored tiles named .../z/x/y.png, decoded by the image source. Its bytes come as blue, green, red."""
    image = spark.read.format("image").option("recursiveFileLookup", "true").load(folder)
    place = F.regexp_extract("image.origin", r"([0-9]+)/([0-9]+)/([0-9]+)\.png$", 0)
    byte = lambda i: F.conv(F.hex(F.substring(F.col("data"), i, 1)), 16, 10).cast("int")
    rows = image.select(F.split(F.regexp_replace(place, r"\.png$", ""), "/").alias("p"), F.col("image.data").alias("data"), F.col("image.nChannels").alias("n"))
    pixel = F.transform(F.sequence(F.lit(0), F.expr("length(data) div n") - 1), lambda k: (byte(k * F.col("n") + 3) * 256 + byte(k * F.col("n") + 2) + byte(k * F.col("n") + 1) / 256 - 32768).cast("float"))
    return rows.select(F.col("p")[0].cast("int").alias("z"), F.col("p")[1].cast("int").alias("x"), F.col("p")[2].cast("int").alias("y"), pixel.alias("z_m"))


class _Tile(InputPartition):
    def __init__(self, z: int, x: int, y: int):
        self.z, self.x, self.y = z, x, y


class _TileReader(DataSourceReader):
    def __init__(self, options):
        self.url, self.zoom = options["url"], int(options["zoom"])
        self.box = tuple(float(v) for v in options["box"].split(","))

    def partitions(self):
        x0, y0, x1, y1 = tile_extent(self.box, self.zoom)
        return [_Tile(self.zoom, x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)]

    def read(self, t):
        for k in range(TRIES):
            try:
                with urllib.request.urlopen(self.url.format(z=t.z, x=t.x, y=t.y), timeout=PATIENCE) as r:
                    data = r.read()
                break
            except OSError:
                if k == TRIES - 1:
                    raise
                time.sleep(0.5 * 2**k)
        yield (t.z, t.x, t.y, heights_of(data).tolist())


class TerrariumTiles(DataSource):
    """spark.read.format("terrarium") with options url (a template with {z}, {x}, {y}; http, https or file), zoom and box ("west,south,east,north")."""

    @classmethod
    def name(cls):
        return "terrarium"

    def schema(self):
        return "z int, x int, y int, z_m array<float>"

    def reader(self, schema):
        return _TileReader(self.options)
