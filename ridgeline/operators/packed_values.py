"""Fields that hold several values: one row per value, with its position.

A text is cut into atoms: quoted spans (which stay whole), possible separators, and the stretches between them. Which of the possible separators part
two values is not fixed beforehand. A unigram model of values - how often a value, and its shape, occur in the whole column - and the odds of every kind
of separator are learned by expectation-maximisation over all texts of the column: forward-backward over each text's lattice gives the expected counts,
which Spark adds up. Viterbi then takes the likeliest split. Values that stand alone in their field start the counts, and a value with a possible separator
inside is unlikely until the column shows otherwise.

Counts are kept under hashes into SLOTS slots, so what the driver sees and sends is bounded whatever the column holds. A frequent text is counted once
with its weight. Per text, time and memory are linear in its length times MAX_ATOMS: a value may be of any length, but one of more than MAX_ATOMS stretches is
weighed by the separators inside it alone, not by its own count, which a second row of the lattice does in linear time (the whole text is always weighed by its count).

NULL texts give no row; empty ones, and such of separators and white space only, none either. `pos` counts the non-empty values from 1. Equal texts are
split alike; ties go to the split with more values. A quote that is never closed is taken as a letter. Only the named columns are read.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = 1 << 16
ROUNDS, SETTLED = 6, 1e-4
#: Stretches up to which a value is weighed by its count; a longer one is weighed by the separators inside it.
MAX_ATOMS = 24
#: Bytes of distinct texts that a task counts in one round.
TASK_BYTES = 4 << 20
#: Prior odds that a possible separator inside a value is part of it, the weight of the prior, and of shape against value.
INSIDE, PRIOR, SHAPE = 1e-3, 5.0, 0.5

#: Possible separators by kind. Fixed values.
KINDS = (";", ",", "/", "|", "+", "&", "\t", "\n", "word", "other")
_TOKEN = re.compile(
    r"""(?P<quoted>"(?:[^"]|"")*")|(?P<mark>[;,/|+&\t\n\r·•¦]|\s(?:and|und|et|y|e|or|oder|ou)(?=\s))""",
    re.IGNORECASE,
)
_WRAPS = {"[": "]", "(": ")", "{": "}"}
_SINGLE = re.compile(r"""(?P<quoted>"(?:[^"]|"")*"|'(?:[^']|'')*')|(?P<mark>[;,/|+&\t\n\r])""")


@lru_cache(1 << 12)
def kind_of(mark: str) -> int:
    """The kind of a possible separator."""
    m = mark.strip(" ").lower() or mark
    if m in KINDS:
        return KINDS.index(m)
    return KINDS.index("\n") if m == "\r" else KINDS.index("word") if m.isalpha() else KINDS.index("other")


def _enclosed(text: str) -> bool:
    """Whether one pair of brackets holds the whole text."""
    return len(text) > 1 and text.find(_WRAPS.get(text[0], "\0")) == len(text) - 1


def atoms(text: str) -> tuple[list[str], list[str]]:
    """The stretches of a text and the possible separators between them (one fewer). A text within brackets is read as a list whose items may stand in single quotes."""
    body, pattern = text.strip(), _TOKEN
    if _enclosed(body):
        body, pattern = body[1:-1], _SINGLE
    parts, marks, at, look = [], [], 0, 0
    while m := pattern.search(body, look):
        look = m.end()
        if m["quoted"] is not None:
            if body[at : m.start()].strip():  # a quote inside a stretch opens nothing
                look = m.start() + 1
            continue
        parts.append(body[at : m.start()])
        marks.append(m["mark"])
        at = m.end()
    return [*parts, body[at:]], marks


def clean(value: str) -> str:
    """A value without the white space around it, its enclosing quotes or brackets, and with doubled quotes made single."""
    v = value.strip()
    for q in "\"'":
        if len(v) > 1 and v[0] == v[-1] == q and not v[1:-1].replace(q + q, "").count(q):
            return v[1:-1].replace(q + q, q).strip()
    if _enclosed(v):
        return v[1:-1].strip()
    return v


@lru_cache(1 << 16)
def _slots(value: str) -> tuple[int, int]:
    def slot(s: str) -> int:
        h = 0xCBF29CE484222325
        for b in s.encode("utf-8", "surrogatepass"):
            h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
        return (h ^ (h >> 32)) % SLOTS

    low = value.lower()
    return slot("v" + low), slot("s" + re.sub(r"[^\W\d_]+", "a", re.sub(r"\d+", "9", low)))


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


class Model:
    """Value counts, shape counts (SLOTS each) and, per kind of mark, how often it parted values and how often it was seen."""

    def __init__(self, values: np.ndarray, shapes: np.ndarray, parts: np.ndarray, seen: np.ndarray):
        self.values, self.shapes, self.parts, self.seen = values, shapes, parts, seen
        self.total = values.sum() + PRIOR
        self.part = np.clip((parts + 1.0) / (seen + 2.0), 1e-6, 1 - 1e-6)

    def value(self, text: str, inside: int) -> float:
        """Log probability of a value with so many possible separators inside."""
        v, s = _slots(text)
        base = math.log(PRIOR / SLOTS) + inside * math.log(INSIDE)
        counted = (1 - SHAPE) * self.values[v] + SHAPE * self.shapes[s]
        return (_log_add(math.log(counted), base) if counted > 0 else base) - math.log(self.total)

    def edges(self, text: str) -> tuple[int, list[tuple[int, int, float, str]], list[int]]:
        """The lattice of a text: (number of stretches, (from, to, log weight, value), kinds of its marks). Empty stretches weigh nothing."""
        parts, marks = atoms(text)
        kinds = [kind_of(m) for m in marks]
        out, body = [], "".join(p + m for p, m in zip(parts, [*marks, ""], strict=True))
        for i in range(len(parts)):
            joined, keep = parts[i], 0.0
            for j in range(i + 1, min(len(parts), i + MAX_ATOMS) + 1):
                if j > i + 1:
                    joined += marks[j - 2] + parts[j - 1]
                    keep += math.log(1 - self.part[kinds[j - 2]])
                empty = not joined.strip()
                if empty and j > i + 1:
                    continue
                w = keep + (0.0 if empty else self.value(clean(joined), j - i - 1))
                if j < len(parts):
                    w += math.log(self.part[kinds[j - 1]])
                out.append((i, j, w, joined))
            if i == 0 and len(parts) > MAX_ATOMS and body.strip():  # the whole text as one value
                out.append((0, len(parts), sum(math.log(1 - self.part[k]) for k in kinds) + self.value(clean(body), len(marks)), body))
        return len(parts), out, kinds

    def long_values(self, n: int, kinds: list[int]) -> tuple[list[float], list[float], list[float]]:
        """Log weights of values of more than MAX_ATOMS stretches: to have taken in the first MAX_ATOMS + 1 from a place, to take in the stretch that ends at a place, to end there."""
        keep = [math.log(1 - self.part[k]) + math.log(INSIDE) for k in kinds]
        base = math.log(PRIOR / SLOTS / self.total)
        run = np.concatenate([[0.0], np.cumsum(keep)])
        start = [base + float(run[i + MAX_ATOMS] - run[i]) for i in range(n - MAX_ATOMS)]
        return start, [0.0, 0.0, *keep], [0.0, *(math.log(self.part[k]) for k in kinds), 0.0]

    def split(self, text: str) -> list[str]:
        """Viterbi: the values of the likeliest split, without empty ones."""
        n, edges, kinds = self.edges(text)
        best, back = [0.0] + [-math.inf] * n, [(0, "")] * (n + 1)
        start, on, end = self.long_values(n, kinds) if n > MAX_ATOMS else ([], [], [])
        inside, since, e = -math.inf, 0, 0
        for j in range(n + 1):
            if j > MAX_ATOMS:  # the likeliest long value that reaches this place
                inside += on[j]
                if best[j - MAX_ATOMS - 1] + start[j - MAX_ATOMS - 1] > inside:
                    inside, since = best[j - MAX_ATOMS - 1] + start[j - MAX_ATOMS - 1], j - MAX_ATOMS - 1
                if inside + end[j] > best[j]:
                    best[j], back[j] = inside + end[j], (since, None)
            while e < len(edges) and edges[e][0] == j:  # by from, then to; among equals the shortest last value wins
                _, to, w, joined = edges[e]
                if best[j] + w >= best[to]:
                    best[to], back[to] = best[j] + w, (j, joined)
                e += 1
        out, at = [], n
        parts, marks = atoms(text) if n > MAX_ATOMS else ([], [])
        while at:
            to, (at, joined) = at, back[at]
            out.append(clean(parts[at] + "".join(m + p for m, p in zip(marks[at : to - 1], parts[at + 1 : to], strict=True)) if joined is None else joined))
        return [v for v in reversed(out) if v]

    def expect(self, text: str, weight: float, values, shapes, parts, seen) -> None:
        """Add a text's expected counts."""
        n, edges, kinds = self.edges(text)
        fore, aft = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
        start, on, end = self.long_values(n, kinds) if n > MAX_ATOMS else ([], [], [])
        late, ahead = [-math.inf] * (n + 1), [-math.inf] * (n + 2)  # within a long value at a place: from the left, from the right
        e = 0
        for j in range(n + 1):
            if j > MAX_ATOMS:
                late[j] = _log_add(late[j - 1] + on[j], fore[j - MAX_ATOMS - 1] + start[j - MAX_ATOMS - 1])
                fore[j] = _log_add(fore[j], late[j] + end[j])
            while e < len(edges) and edges[e][0] == j:
                _, to, w, _ = edges[e]
                fore[to] = _log_add(fore[to], fore[j] + w)
                e += 1
        e = len(edges) - 1
        for i in range(n, -1, -1):
            while e >= 0 and edges[e][0] == i:
                _, to, w, _ = edges[e]
                aft[i] = _log_add(aft[i], aft[to] + w)
                e -= 1
            if i + MAX_ATOMS < n:
                aft[i] = _log_add(aft[i], ahead[i + MAX_ATOMS + 1] + start[i])
            if i > MAX_ATOMS:
                ahead[i] = _log_add(end[i] + aft[i], ahead[i + 1] + (on[i + 1] if i < n else 0.0))
                if i < n:
                    parts[kinds[i - 1]] += weight * math.exp(late[i] + end[i] + aft[i] - fore[n])
        for k in kinds:
            seen[k] += weight
        for i, j, w, joined in edges:
            p = weight * math.exp(fore[i] + w + aft[j] - fore[n])
            if joined.strip():
                v, s = _slots(clean(joined))
                values[v] += p
                shapes[s] += p
            if j < n:
                parts[kinds[j - 1]] += p


def _counts(rows: DataFrame, model: Model | None) -> Model:
    """One round over all texts (columns text, weight): expected counts under the model, or those of the texts that hold one value for sure."""

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        values, shapes, marks, seen = defaultdict(float), defaultdict(float), defaultdict(float), defaultdict(float)
        for f in frames:
            for text, weight in zip(f["text"], f["weight"], strict=True):
                if model is not None:
                    model.expect(text, float(weight), values, shapes, marks, seen)
                    continue
                stretches, between = atoms(text)
                for m in between:
                    marks[kind_of(m)] += weight / 2
                    seen[kind_of(m)] += weight
                if not between or all(s.strip().startswith('"') or not s.strip() for s in stretches):
                    for s in filter(None, map(clean, stretches)):
                        v, k = _slots(s)
                        values[v] += weight
                        shapes[k] += weight
        for what, d in enumerate((values, shapes, marks, seen)):
            yield pd.DataFrame({"what": what, "slot": list(d), "n": list(d.values())}).astype({"what": "int32", "slot": "int64", "n": "float64"})

    sums = rows.mapInPandas(part, "what int, slot long, n double").groupBy("what", "slot").agg(F.sum("n").alias("n")).collect()  # at most 2 * SLOTS + 20 rows
    arrays = [np.zeros(SLOTS), np.zeros(SLOTS), np.zeros(len(KINDS)), np.zeros(len(KINDS))]
    for r in sums:
        arrays[r["what"]][r["slot"]] = r["n"]
    return Model(*arrays)


def fit(df: DataFrame, text: str) -> Model:
    """Learn value frequencies and separators from the whole column."""
    rows = df.select(df[text].cast("string").alias("text")).filter("text IS NOT NULL").groupBy("text").agg(F.count(F.lit(1)).alias("weight")).persist()
    try:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        rows_ = rows.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, size // TASK_BYTES))  # a round is a pass over what is held
        model = _counts(rows_, None)
        for _ in range(ROUNDS):
            last, model = model, _counts(rows_, model)
            if np.abs(last.part - model.part).max() < SETTLED:
                break
    finally:
        rows.unpersist()
    return model


def split_values(df: DataFrame, key: str, text: str, model: Model | None = None) -> DataFrame:
    """One row per value: the key, pos from 1, n_values of the field, item."""
    model = fit(df, text) if model is None else model
    sent = df.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split = lru_cache(1 << 14)(sent.value.split)
        for f in frames:
            items = [split(t) for t in f["text"]]
            yield pd.DataFrame({"key": f["key"], "items": items})

    rows = df.select(df[key].alias("key"), df[text].cast("string").alias("text")).filter("text IS NOT NULL")
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInPandas(cut, f"key {kind}, items array<string>")
    return out.select(F.col("key").alias(key), F.size("items").alias("n_values"), F.posexplode("items").alias("pos", "item")).withColumn("pos", F.col("pos") + 1).select(key, "pos", "n_values", "item")
