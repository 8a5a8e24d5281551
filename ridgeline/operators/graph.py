"""Pointer jumping and spanning forests over tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.session import cut


def pointer_jump(pointers: DataFrame, rounds: int = 40) -> DataFrame:
    """Follow (cell, ptr) to the ends: pointers to itself, to a cell that is no key, or to a negative number. Every round doubles the steps taken; the loop ends
    when nothing moves."""
    now = cut(pointers.select("cell", "ptr"))
    for _ in range(rounds):
        to = now.filter("ptr <> cell").select(F.col("cell").alias("_at"), F.col("ptr").alias("_to"))
        joined = now.join(to, now["ptr"] == to["_at"], "left")
        new = cut(joined.select("cell", F.coalesce("_to", "ptr").alias("ptr"), F.col("_to").isNotNull().alias("moved")))
        now = new.select("cell", "ptr")
        if new.filter("moved").limit(1).isEmpty():
            return now
    raise ValueError("pointers that lead in a circle")


class Roots:
    """Union-find over cell numbers."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, a: int) -> int:
        up = self.up
        root = a
        while up.get(root, root) != root:
            root = up[root]
        while up.get(a, a) != root:
            up[a], a = root, up[a]
        return root


def forest(edges: pd.DataFrame) -> pd.DataFrame:
    """A maximum spanning forest of edges (a, b, z, cell), by (z, cell)."""
    roots, keep = Roots(), []
    f = edges.sort_values(["z", "cell"], ascending=False, kind="stable")
    for k, a, b in zip(f.index, f["a"].tolist(), f["b"].tolist(), strict=True):
        ra, rb = roots.find(a), roots.find(b)
        if ra != rb:
            roots.up[ra] = rb
            keep.append(k)
    return edges.loc[keep]


_EDGE = "a long, b long, z float, cell long"


def thin(edges: DataFrame) -> DataFrame:
    """Drop edges that no spanning forest needs, partition by partition: the forest of a union is that of the parts' forests."""

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [f for f in frames if len(f)]
        if held:
            yield forest(pd.concat(held, ignore_index=True))

    return edges.select("a", "b", "z", "cell").mapInPandas(part, _EDGE)


#: Edges between basins that one task may merge (some 100 MB of Python numbers); more are first merged in rounds of joins.
LAST_EDGES = 200_000
_ENDS = "cell long, saddle_cell long, saddle_elev float"


def _merge_round(e: DataFrame, summits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round over edges a, b, ea, eb, z, cell between basins, each named by its highest summit: a basin whose highest saddle leads to a higher one ends there. Any way from it to
    higher ground must pass a saddle no higher than this one, and what lies behind was joined over saddles at least as high, so the saddle is its own for good.
    Gives the basins that ended and the edges between those that are left, the highest of each pair."""
    sides = (e.select(F.col(x).alias("me"), F.col("e" + x).alias("em"), F.struct("z", "cell", F.col("e" + y).alias("eo"), F.col(y).alias("other")).alias("s")) for x, y in (("a", "b"), ("b", "a")))
    best = next(sides).unionByName(next(sides)).groupBy("me").agg(F.first("em").alias("em"), F.max("s").alias("s"))
    ended = cut(best.filter(F.struct(F.col("s.eo"), F.col("s.other")) > F.struct("em", "me")).select(F.col("me").alias("cell"), F.col("s.cell").alias("saddle_cell"), F.col("s.z").alias("saddle_elev"), F.col("s.other").alias("ptr")))
    roots = pointer_jump(ended.select("cell", "ptr")).join(summits.select(F.col("cell").alias("ptr"), F.col("elev").alias("er")), "ptr")
    for x in ("a", "b"):
        e = e.join(roots.select(F.col("cell").alias(x), F.col("ptr").alias("_p"), F.col("er").alias("_e")), x, "left").withColumns({x: F.coalesce("_p", x), "e" + x: F.coalesce("_e", "e" + x)}).drop("_p", "_e")
    low = F.col("a") < F.col("b")
    pair = [F.when(low, F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("a", "b"), ("b", "a"), ("ea", "eb"), ("eb", "ea"))]
    left = e.filter("a <> b").select(*pair, "z", "cell").groupBy("a", "b", "ea", "eb").agg(F.max(F.struct("z", "cell")).alias("s")).select("a", "b", "ea", "eb", "s.z", "s.cell")
    return ended.drop("ptr"), cut(left)


def elder_merge(summits: DataFrame, edges: DataFrame, last: int | None = None) -> DataFrame:
    """Merge basins down from the highest saddle: of two summits the lower one ends there. summits: cell, elev; edges: a, b (summits), z, cell (saddle).
    Gives cell, elev, saddle_cell, saddle_elev for each, NULL for the highest of every connected part. Edges that no spanning forest needs are dropped partition by partition; while
    more than `last` (LAST_EDGES) are left, basins end in rounds of joins; then one task merges the rest."""

    def finish(f: pd.DataFrame) -> pd.DataFrame:
        height = dict(zip(f["a"].tolist(), f["ea"].tolist(), strict=True)) | dict(zip(f["b"].tolist(), f["eb"].tolist(), strict=True))
        f = f.sort_values(["z", "cell"], ascending=False, kind="stable")
        roots, out = Roots(), []
        for a, b, z, cell in zip(f["a"].tolist(), f["b"].tolist(), f["z"].tolist(), f["cell"].tolist(), strict=True):
            ra, rb = roots.find(a), roots.find(b)
            if ra == rb:
                continue
            if (height[ra], ra) > (height[rb], rb):
                ra, rb = rb, ra
            roots.up[ra] = rb  # rb, the higher, lives on
            out.append((ra, cell, z))
        return pd.DataFrame(out, columns=["cell", "saddle_cell", "saddle_elev"])

    last = LAST_EDGES if last is None else last
    tops = summits.select("cell", "elev")
    e = cut(thin(edges).join(tops.toDF("a", "ea"), "a").join(tops.toDF("b", "eb"), "b"))
    ends = None
    while e.limit(last + 1).count() > last:
        ended, e = _merge_round(e, tops)
        ends = ended if ends is None else ends.unionByName(ended)
    rest = e.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(finish, _ENDS)
    ends = rest if ends is None else ends.unionByName(rest)
    return tops.join(ends, "cell", "left")
