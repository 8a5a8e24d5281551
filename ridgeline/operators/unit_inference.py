"""Heights recorded in different units, brought to metres, each with the unit it was recorded in.

A text that names its unit settles it. For all other records a random forest predicts the unit from the number's size and form, the table, the source and
what its note says, the words of a remark beside the number, and a sibling field that repeats the height in feet. It is trained on a bounded sample of records
whose unit is known: those whose text names it, with that hidden (half of them, by hash of the key), and those where independent signs agree (neighbours,
sibling, note, remark). Its probabilities are calibrated on out-of-bag rows and then weighed with the neighbours: how many records of known unit near by have the
same height if the number is read in this unit or that, with likelihood ratios counted over the records that name their unit. The outcome is calibrated
once more, on the other half of the records that name their unit, which the forest has not seen. The whole is done twice, the second time with the units of the
neighbours as inferred by the first. Assignments below SURE come out with status `review`, the unit as a suggestion and no height.

A NULL or non-finite number is no record. Records without a position have no neighbours. Unknown or NULL sources count as one source. Ties go to the unit that
the field is meant for. An empty table gives an empty result. Repeated records are dropped by their key before. Only the columns named here are read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.heights import METRES, UNITS, to_metres
from ridgeline.operators.forest import Forest
from ridgeline.session import cut, stable_unit

#: Projected metres within which records are looked for that may be the same summit.
NEAR = 700.0
#: Most labelled rows that a forest is trained on, and the probability from which an assignment is sure.
TRAIN_ROWS, SURE = 40_000, 0.9
#: Hash slots for the words of remarks, and how many of them the forest sees: those that tell most about the unit.
WORD_SLOTS, WORDS_SEEN = 1 << 12, 32

#: Columns that infer_units reads: key BIGINT (unique), kind INT, meant STRING, value DOUBLE, decimals INT, padded BOOLEAN, stated STRING, remark STRING, remark_unit STRING,
#: source STRING, note_unit STRING, sibling DOUBLE (the height in feet in another field), prom_ft DOUBLE, x DOUBLE, y DOUBLE.
RECORD = ("key", "kind", "meant", "value", "decimals", "padded", "stated", "remark", "remark_unit", "source", "note_unit", "sibling", "prom_ft", "x", "y")


def _sibling_unit() -> Column:
    """The unit of value if the sibling is right and in feet."""
    out = F.lit(None).cast("string")
    for u, k in METRES.items():
        out = F.when(F.abs(F.col("sibling") * 0.3048 - F.col("value") * k) <= F.lit(0.002) * F.abs(F.col("value") * k) + 0.05, F.lit(u)).otherwise(out)
    return out


def _label() -> Column:
    """The unit of a record whose height can be taken as known when judging its neighbours; NULL for others."""
    remark = F.col("remark_unit").isNull() | (F.col("remark_unit") == F.col("note_unit"))
    by_note = F.when(F.col("note_unit").isin(*UNITS) & remark, F.col("note_unit"))
    with_sibling = F.when(F.col("sibling").isNull() | (F.col("sibling_unit") == F.col("note_unit")) | F.col("note_unit").isin("ft", "dm"), by_note)
    return F.coalesce("stated", F.when(F.col("decimals").isNotNull() & F.col("written"), F.lit(None)).otherwise(with_sibling), F.when(~F.col("written") & (F.col("note_unit") == "mixed"), F.col("remark_unit")))


def _bucket(h: Column) -> Column:
    """Heights of one bucket differ by at most a hundredth; all up to one metre share one."""
    return F.floor(F.ln(F.greatest(h, F.lit(1.0))) * 100)


def _with_neighbours(rows: DataFrame) -> DataFrame:
    """Adds near_<unit>: known neighbours (those with a label) that agree with the number read in that unit, and near_n, their number in all.

    No pairs are made: the known heights are counted per cell and height bucket, each in every cell that its box of NEAR metres touches. A cell's counts are then
    one row with a map of no more entries than there are buckets, and every record meets that one row: a crowded place costs no more than its rows, and may be split
    on the side of the records. Records without a position go to cells of their own, spread by their key."""
    side = 2 * NEAR
    at = F.explode(F.array_distinct(F.array(*(F.struct(F.floor((F.col("x") + dx) / side).alias("cx"), F.floor((F.col("y") + dy) / side).alias("cy")) for dx in (-NEAR, NEAR) for dy in (-NEAR, NEAR)))))
    known = rows.filter("label IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL")
    spread = known.select(_bucket(to_metres(F.col("value"), F.col("label"))).alias("bucket"), at.alias("c")).select("c.cx", "c.cy", "bucket")
    counts = spread.groupBy("cx", "cy", "bucket").agg(F.count(F.lit(1)).cast("int").alias("n"))
    cells = counts.groupBy("cx", "cy").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("seen"), F.sum("n").alias("all"))
    placed = F.col("x").isNotNull() & F.col("y").isNotNull()
    own = rows.withColumns(
        {"cx": F.when(placed, F.floor(F.col("x") / side)).otherwise(F.xxhash64("key")), "cy": F.when(placed, F.floor(F.col("y") / side)).otherwise(F.lit(-(1 << 62)))}
    )
    here = lambda b: F.coalesce(F.try_element_at("seen", b), F.lit(0))
    found = {}
    for u, k in METRES.items():
        b = _bucket(F.col("value") * k)
        itself = (F.col("label") == u) & placed
        found[f"near_{u}"] = F.when(F.col("seen").isNotNull() & (F.col("value") > 0), here(b - 1) + here(b) + here(b + 1) - F.coalesce(itself.cast("int"), F.lit(0))).otherwise(0).cast("double")
    found["near_n"] = (F.coalesce("all", F.lit(0)) - (F.col("label").isNotNull() & placed).cast("int")).cast("double")
    return own.join(cells, ["cx", "cy"], "left").withColumns(found).drop("cx", "cy", "seen", "all")


def _code(c: Column) -> Column:
    out = F.lit(len(UNITS) + 1.0)
    for k, u in enumerate((*UNITS, "mixed")):
        out = F.when(c == u, F.lit(float(k))).otherwise(out)
    return out


_NEAR = [f"near_{u}" for u in UNITS]


def _against(remark: np.ndarray, note: np.ndarray) -> np.ndarray:
    """Whether a remark beside the number says the same as the note on the source: 0 no remark, 1 the same, 2 nothing clear in the note, 3 another unit."""
    n = len(UNITS)
    return np.where(remark >= n, 0.0, np.where(note >= n, 2.0, np.where(remark == note, 1.0, 3.0)))


def _told(words: pd.Series, y: np.ndarray) -> np.ndarray:
    """The WORDS_SEEN slots that tell most about the unit (mutual information) among those of five rows or more."""
    lists = [np.unique(np.asarray(w if w is not None else [], np.int64)) for w in words]
    slot, row = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(w) for w in lists])
    if not len(slot):
        return np.zeros(0, np.int64)
    have = np.bincount(slot * len(UNITS) + y[row], minlength=WORD_SLOTS * len(UNITS)).reshape(WORD_SLOTS, len(UNITS)) + 1e-9
    total = np.bincount(y, minlength=len(UNITS)) + 1e-9
    gain = np.zeros(WORD_SLOTS)
    for part in (have, total - have):
        p = np.maximum(part, 1e-9) / total.sum()
        gain += (p * np.log(p / (p.sum(1, keepdims=True) * total / total.sum()))).sum(1)
    gain[have.sum(1) < 5] = 0
    best = np.argsort(-gain, kind="stable")[:WORDS_SEEN]
    return np.sort(best[gain[best] > 1e-5])


def _features(f: pd.DataFrame, shares: dict[str, np.ndarray], told: np.ndarray) -> np.ndarray:
    n = len(f)
    value = f["value"].to_numpy(float)
    base = np.column_stack(
        [
            np.log10(np.abs(value) + 1e-3),
            f["decimals"].fillna(-1).to_numpy(float),
            f["padded"].fillna(False).to_numpy(float),
            f["kind"].to_numpy(float),
            f["note_code"].to_numpy(float),
            f["remark_code"].to_numpy(float),
            f["sibling_code"].to_numpy(float),
            _against(f["remark_code"].to_numpy(float), f["note_code"].to_numpy(float)),
            f["same"].to_numpy(float),
            np.log10(np.maximum(np.nan_to_num(f["prom_ft"].to_numpy(float)), 1)),
        ]
    )
    whole = shares.get("", np.zeros(len(UNITS)))
    own = np.array([shares.get(f"{k}:{s}", whole) for k, s in zip(f["kind"], f["source"], strict=True)]).reshape(n, len(UNITS))
    bag = np.zeros((n, len(told)))
    place = {int(s): k for k, s in enumerate(told)}
    for i, slots in enumerate(f["words"]):
        for w in slots if slots is not None else ():
            if int(w) in place:
                bag[i, place[int(w)]] = 1
    return np.hstack([base, own, bag])


def _shares(labelled: pd.DataFrame) -> dict[str, np.ndarray]:
    """Smoothed unit shares of each source among the labelled rows."""
    y = pd.get_dummies(labelled["y"]).reindex(columns=range(len(UNITS)), fill_value=0)
    whole = (y.sum().to_numpy(float) + 0.2) / (len(y) + 1)
    out = {"": whole}
    for key, g in y.groupby(labelled["kind"].astype(str) + ":" + labelled["source"].astype(str)):
        out[key] = (g.sum().to_numpy(float) + 2 * whole) / (len(g) + 2)
    return out


def _labels() -> Column:
    """The known unit of a training row whose text does not name it, by number; NULL if it is not known. Agreement with neighbours is the strongest sign; several units with it cancel out."""
    agree = [F.coalesce(F.col(c), F.lit(0.0)) for c in _NEAR]
    top = F.greatest(*agree)
    one = sum((a == top).cast("int") for a in agree) == 1
    by_near = F.when((top >= 1) & one & ((top >= 2) | (F.col("near_n") <= 4)), F.array_position(F.array(*agree), top) - 1)
    alone = sum(agree) == agree[UNITS.index("m")]
    sure_note = F.col("sibling_unit").isNotNull() & (F.col("sibling_unit") == F.col("note_unit")) & (F.col("kind") == 0) & F.col("value").between(1, 4500) & alone
    return F.coalesce(by_near, F.when(sure_note | ((F.col("remark_unit") == F.col("note_unit")) & ~F.col("written")), F.col("note_code"))).cast("int")


#: What is carried from step to step.
_CARRIED = "key long, kind int, value double, decimals int, padded boolean, stated string, words array<int>, source string, prom_ft double, x double, y double, written boolean, sibling_unit string, same double, note_unit string, remark_unit string, note_code double, remark_code double, sibling_code double, meant_code double"


def infer_units(records: DataFrame) -> DataFrame:
    """key, kind, value, unit, probability, status (`stated`, `inferred`, `review`), height_m (NULL for review) for every record with a number."""
    rows = records.select(*RECORD).filter("value IS NOT NULL AND NOT isnan(value) AND abs(value) < 1e300 AND key IS NOT NULL")
    rows = rows.withColumns({
        "sibling_unit": _sibling_unit(), "written": F.col("kind") == 2, "source": F.coalesce("source", F.lit("")), "words": F.transform(F.split(F.lower("remark"), r"\s+"), lambda w: F.pmod(F.xxhash64(w), F.lit(WORD_SLOTS)).cast("int")),
        "same": F.coalesce((F.abs(F.col("sibling") - F.col("value")) <= 0.01 + 0.0001 * F.abs(F.col("value"))).cast("double"), F.lit(0.0)),
    })
    rows = rows.withColumns({"note_code": _code(F.col("note_unit")), "remark_code": _code(F.col("remark_unit")), "sibling_code": _code(F.col("sibling_unit")), "meant_code": _code(F.col("meant")), "label": _label()})
    names = [c.split()[0] for c in _CARRIED.split(", ")]
    first = cut(_guess(cut(_with_neighbours(cut(rows.select(*names, "label"))))))
    sure = F.when(F.col("status") != "review", F.col("unit"))
    again = _guess(cut(_with_neighbours(first.select(*names, sure.alias("label")))))  # with the neighbours' units as inferred
    return again.select("key", "kind", "value", "unit", "probability", "status", F.when(F.col("status") != "review", to_metres(F.col("value"), F.col("unit"))).alias("height_m"))


def _group(near_n: pd.Series) -> np.ndarray:
    return np.searchsorted([0.5, 1.5, 4.5], near_n.to_numpy(float))


def _evidence(seen: DataFrame) -> np.ndarray:
    """How much likelier it is to find none, one, or more neighbours that agree with a reading in the right unit than with one in a wrong unit, by the number of
    neighbours (none, 1, 2 to 4, more). Counted over the records that name their unit."""
    n = F.col("near_n")
    group = F.when(n < 0.5, 0).when(n < 1.5, 1).when(n < 4.5, 2).otherwise(3)
    reading = F.explode(F.array(*(F.struct((F.col("stated") == u).alias("right"), F.least(F.col(f"near_{u}"), F.lit(2.0)).cast("int").alias("k"), (F.col("value") * k).alias("m")) for u, k in METRES.items())))
    rows = seen.filter("stated IS NOT NULL").select(group.alias("g"), reading.alias("r")).filter("r.m BETWEEN 100 AND 6000")
    count = np.zeros((2, 4, 3))
    count[1, 1:] += np.array([4.0, 4.0, 1.0]) * 2  # a weak prior where little is named
    count[0, 1:] += np.array([90.0, 3.0, 0.5]) * 2
    for r in rows.groupBy("g", "r.right", "r.k").count().collect():  # at most 24 rows
        count[int(r["right"]), r["g"], r["k"]] += r["count"]
    share = (count + 1e-3) / (count + 1e-3).sum(2, keepdims=True)
    ratios = share[1] / share[0]
    ratios[0] = 1.0
    return ratios


@dataclass
class Guesser:
    """What prediction needs: forest (None where there is too little to learn from), unit shares by source, word slots, neighbours' likelihood ratios, final temperature."""

    forest: Forest | None
    shares: dict[str, np.ndarray]
    told: np.ndarray
    ratios: np.ndarray
    heat: float = 1.0

    def probabilities(self, f: pd.DataFrame) -> np.ndarray:
        """Of each unit, for rows as of _CARRIED with their neighbours."""
        meant = f["meant_code"].to_numpy(int)
        if self.forest is None:  # what is named beside the number, else the field's unit
            hint = np.where(f["remark_code"] < len(UNITS), f["remark_code"], np.where(f["note_code"] < len(UNITS), f["note_code"], meant)).astype(int)
            p = np.full((len(f), len(UNITS)), 0.1)
            p[np.arange(len(f)), hint] = 0.6
        else:
            p = self.forest.predict(_features(f, self.shares, self.told))
        p[np.arange(len(f)), meant] += 1e-9
        p = (p * self.ratios[_group(f["near_n"])[:, None], np.minimum(f[_NEAR].to_numpy(float), 2).astype(int)]) ** (1 / self.heat)
        return p / p.sum(1, keepdims=True)

    def calibrate(self, f: pd.DataFrame, y: np.ndarray) -> None:
        """Set the temperature that gives rows of known unit the least log loss."""
        self.heat, p, best = 1.0, self.probabilities(f), np.inf
        for heat in np.geomspace(0.5, 4, 31):
            q = np.maximum(p, 1e-12) ** (1 / heat)
            loss = -np.log((q / q.sum(1, keepdims=True))[np.arange(len(y)), y] + 1e-3).mean()
            if loss < best - 1e-9:
                best, self.heat = loss, float(heat)


def _in_tasks(spark, grow, n: int) -> list:
    """grow(0) to grow(n - 1), each in a task of its own; what goes out and comes back is of bounded size."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k in f["id"]:
                yield pd.DataFrame({"id": [k], "tree": [pickle.dumps(grow(int(k)))]})

    rows = spark.range(0, n, 1, n).mapInPandas(run, "id long, tree binary").collect()
    return [pickle.loads(r["tree"]) for r in sorted(rows, key=lambda r: r["id"])]


def learn(seen: DataFrame) -> Guesser:
    """Train on a bounded sample of the rows whose unit is known."""
    stated = F.array_position(F.array(*(F.lit(u) for u in UNITS)), F.col("stated")) - 1
    known = seen.withColumn("y", F.when(F.col("stated").isNull(), _labels()).otherwise(stated.cast("int"))).filter(f"y BETWEEN 0 AND {len(UNITS) - 1}").withColumn("held", F.col("stated").isNotNull() & (stable_unit(F.col("key"), F.lit("held")) < 0.5))
    total = known.count()
    sample = known.filter(stable_unit(F.col("key")) < TRAIN_ROWS / max(total, TRAIN_ROWS)).orderBy("key").toPandas()
    g = Guesser(None, {}, np.zeros(0, np.int64), _evidence(seen))
    rows, held = sample[~sample["held"].astype(bool)], sample[sample["held"].astype(bool)]
    if len(rows) >= 20:
        y = rows["y"].to_numpy(np.int64)
        g.shares, g.told = _shares(rows[rows["stated"].isna()] if rows["stated"].isna().any() else rows), _told(rows["words"], y)
        g.forest = Forest(len(UNITS)).fit(_features(rows, g.shares, g.told), y, partial(_in_tasks, seen.sparkSession))
    if len(held) >= 20:
        g.calibrate(held, held["y"].to_numpy(np.int64))
    return g


def _guess(seen: DataFrame) -> DataFrame:
    """Train on the rows whose unit is known and predict the rest: _CARRIED with unit, probability, status."""
    sent = seen.sparkSession.sparkContext.broadcast(learn(seen))  # of bounded size

    def predict(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            p = sent.value.probabilities(f)
            named = f["stated"].notna().to_numpy()
            out = f.drop(columns=["label", "near_n", *_NEAR])
            out["unit"] = np.where(named, f["stated"], np.array(UNITS)[p.argmax(1)])
            out["probability"] = np.where(named, 1.0, p.max(1))
            out["status"] = np.where(named, "stated", np.where(p.max(1) >= SURE, "inferred", "review"))
            yield out

    return seen.mapInPandas(predict, _CARRIED + ", unit string, probability double, status string")
