"""Probabilistic record linkage: pairs of records of two tables that share no key, each with a confidence.

Blocking in several passes gives candidate pairs; every pair is compared in several attributes, each comparison giving an agreement level (or NULL where a
side is missing, which tells nothing). The match and non-match probabilities of all levels and the share of matches are found by expectation-maximisation
over the counts of the agreement patterns, of which there are no more than the product of the numbers of levels; so only those counts reach the driver,
however many pairs there are. The posterior of a pair's pattern is its confidence.

An empty set of pairs gives no result. Ties do not arise: equal patterns have equal confidence, and all their pairs come out. Many-to-many matches are kept.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that name a kind of summit, and other spellings of them. Fixed values.
GENERIC = frozenset(
    "peak peaks pk mount mt mountain mountains mtn mtns mont monte montana pic pico piz pizzo cerro butte horn ridge rdg dome hill top point pt summit cima spitze gipfel berg the of de le la".split()
)
_ASIDE = re.compile(r"\(.*?\)|\[.*?\]|(?:,|\s-)\s*(?:highest|main|high|north|south|east|west|n|s|e|w)?\s*(?:point|top|summit)?\s*$", re.IGNORECASE)


def _letters(text: str) -> list[str]:
    flat = "".join(c for c in unicodedata.normalize("NFKD", text.lower().replace("ß", "ss")) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", flat)


@lru_cache(1 << 15)
def name_forms(name: str) -> tuple[tuple[str, str, str], ...]:
    """For each of the names that a text gives (parted by a slash): its own words sorted and joined, all words sorted and joined, all words as written and joined."""
    out = []
    for part in re.split(r"\s+/\s+|;", name):
        words = _letters(_ASIDE.sub(" ", part)) or _letters(part)
        if words:
            own = sorted(w for w in words if w not in GENERIC) or sorted(words)
            out.append(("".join(own), "".join(sorted(words)), "".join(words)))
    return tuple(out)


@lru_cache(1 << 15)
def edit_share(a: str, b: str) -> float:
    """One less the edits (changed, missing, added or swapped letters) per letter of the longer text."""
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    if not n or not m or min(n, m) * 2 < max(n, m):
        return 0.0
    before, last = [], list(range(m + 1))
    for i in range(1, n + 1):
        row = [i] + [0] * m
        for j in range(1, m + 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d = min(d, before[j - 2] + 1)
            row[j] = d
        before, last = last, row
    return 1 - last[m] / max(n, m)


def name_level(a: str | None, b: str | None) -> int | None:
    """3 the same, 2 nearly, 1 somewhat, 0 not alike; None where a name is missing."""
    fa, fb = name_forms(a or ""), name_forms(b or "")
    if not fa or not fb:
        return None
    best = 0
    for x in fa:
        for y in fb:
            own, whole = edit_share(x[0], y[0]), max(edit_share(x[1], y[1]), edit_share(x[2], y[2]))
            best = max(best, 3 if own == 1 or whole == 1 else 2 if own >= 0.75 or whole >= 0.85 else 1 if own >= 0.6 or whole >= 0.75 else 0)
    return best


@F.pandas_udf(T.IntegerType())
def name_agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """name_level as a column."""
    return pd.Series([name_level(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


@F.pandas_udf(T.StringType())
def name_key(a: pd.Series) -> pd.Series:
    """The own words of a text's first name, sorted and joined; NULL where it has none."""
    return pd.Series([(name_forms(x or "") or ((None,),))[0][0] for x in a], dtype="object")


def steps(value: Column, *limits: float) -> Column:
    """The number of limits that a difference does not exceed: the more, the closer. NULL stays NULL."""
    return F.when(value.isNotNull(), sum((value <= x).cast("int") for x in limits))


def fit_patterns(patterns: pd.DataFrame, levels: dict[str, int], agreeing: dict[str, int], rounds: int = 300) -> tuple[float, dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Expectation-maximisation over agreement patterns with their counts n. levels: how many each comparison has; agreeing: the level from which it starts out as a sign of a match."""
    n = patterns["n"].to_numpy(float)
    code = {k: patterns[k].fillna(-1).to_numpy(int) for k in levels}
    m, u = {}, {}
    for k, size in levels.items():
        rising = np.linspace(0.2, 1, size) ** 2
        rising[: agreeing[k]] *= 0.1
        m[k] = rising / rising.sum()
        u[k] = (np.bincount(code[k][code[k] >= 0], weights=n[code[k] >= 0], minlength=size) + 1) / (n[code[k] >= 0].sum() + size)
        u[k] = np.minimum(u[k], 0.6) * np.where(np.arange(size) >= agreeing[k], 0.5, 1.0)
        u[k] /= u[k].sum()
    share = 0.3
    for _ in range(rounds):
        p = posterior(code, share, m, u)
        new = (p * n).sum() / n.sum()
        for k, size in levels.items():
            ok = code[k] >= 0
            for d, w in ((m, p * n), (u, (1 - p) * n)):
                c = np.bincount(code[k][ok], weights=w[ok], minlength=size) + 0.5
                d[k] = c / c.sum()
        done, share = abs(new - share) < 1e-7, float(np.clip(new, 1e-4, 1 - 1e-4))
        if done:
            break
    return share, m, u


def posterior(code: dict[str, np.ndarray], share: float, m: dict[str, np.ndarray], u: dict[str, np.ndarray]) -> np.ndarray:
    """Probability of a match for rows of level numbers (-1: not compared)."""
    odds = np.full(len(next(iter(code.values()))), np.log(share / (1 - share)))
    for k, c in code.items():
        odds += np.where(c >= 0, np.log(m[k][c] / u[k][c]), 0.0)
    return 1 / (1 + np.exp(-odds))


def link(pairs: DataFrame, levels: dict[str, int], agreeing: dict[str, int], rivals: str | None = None) -> DataFrame:
    """Adds `confidence` to pairs that carry a column of agreement levels per comparison. `pairs` is read twice. rivals: a column of how many records the pair
    was found among by what they have in common; the odds are divided by it."""
    counts = pairs.groupBy(*levels).agg(F.count(F.lit(1)).alias("n")).toPandas()  # at most the product of (levels + 1) rows
    if not len(counts):
        return pairs.withColumn("confidence", F.lit(None).cast("double"))
    share, m, u = fit_patterns(counts, levels, agreeing)
    odds = F.lit(float(np.log(share / (1 - share))))
    for k in levels:
        weights = F.array(*(F.lit(float(w)) for w in np.log(m[k] / u[k])))
        odds = odds + F.coalesce(F.try_element_at(weights, F.col(k) + 1), F.lit(0.0))
    if rivals is not None:
        odds = odds - F.log(F.greatest(F.col(rivals), F.lit(1)).cast("double"))
    return pairs.withColumn("confidence", F.lit(1.0) / (F.lit(1.0) + F.exp(-odds)))
