"""Small rasters for tests, and brute-force versions of the raster operators."""

import heapq

import numpy as np

from ridgeline.operators.raster import STEPS, Grid


def cells_of(spark, text):
    """Cells and grid of rows of numbers; '.' is no data."""
    rows = [r.split() for r in text.strip().splitlines()]
    grid = Grid(len(rows), len(rows[0]))
    data = [(i * grid.ncols + j, i, j, None if v == "." else float(v)) for i, r in enumerate(rows) for j, v in enumerate(r)]
    return spark.createDataFrame(data, "cell long, row int, col int, elev float"), grid


def cells_of_array(spark, z):
    grid = Grid(*z.shape)
    data = [(int(i * grid.ncols + j), int(i), int(j), None if np.isnan(z[i, j]) else float(z[i, j])) for i in range(grid.nrows) for j in range(grid.ncols)]
    return spark.createDataFrame(data, "cell long, row int, col int, elev float"), grid


def sweep(z, neighbours):
    """Prominence by a sweep from the highest cell down: {summit cell: (prominence, saddle cell or None)}."""
    n, m = z.shape
    flat, up, top, out = z.ravel(), {}, {}, {}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    valid = [k for k in range(flat.size) if not np.isnan(flat[k])]
    for k in sorted(valid, key=lambda k: (flat[k], k), reverse=True):
        r, c = divmod(k, m)
        near = {find(a * m + b) for a, b in ((r + dr, c + dc) for dr, dc in STEPS[:neighbours]) if 0 <= a < n and 0 <= b < m and a * m + b in up}
        up[k] = k
        if not near:
            top[k] = k
            continue
        best = max(near, key=lambda x: (flat[top[x]], top[x]))
        for x in near - {best}:
            out[top[x]] = (float(flat[top[x]] - flat[k]), k)
            up[x] = best
        up[k] = best
    low = np.nanmin(flat) if valid else 0
    for x in {find(k) for k in up}:
        out[top[x]] = (float(flat[top[x]] - low), None)
    return out


def ascent(z, seeds, tolerance):
    """Marks of the tolerant ascent by one heap over the whole raster."""
    n, m = z.shape
    mark = {k: float(z.flat[k]) for k in seeds if not np.isnan(z.flat[k])}
    heap = [(v, k) for k, v in mark.items()]
    heapq.heapify(heap)
    while heap:
        h, k = heapq.heappop(heap)
        if h > mark[k]:
            continue
        r, c = divmod(k, m)
        for dr, dc in STEPS[:4]:
            a, b = r + dr, c + dc
            if 0 <= a < n and 0 <= b < m and not np.isnan(z[a, b]) and z[a, b] >= h - tolerance:
                v = max(h, float(z[a, b]))
                if v < mark.get(a * m + b, np.inf):
                    mark[a * m + b] = v
                    heapq.heappush(heap, (v, a * m + b))
    return mark
