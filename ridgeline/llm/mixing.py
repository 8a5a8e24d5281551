"""Mixing sources to target shares of all tokens, none repeated more often than it may be.

Soft-membership mixing. Every document has domain posteriors: a labelled one belongs to its source; one without a source gets those of a classifier that is
trained on the labelled documents. A nonnegative rate per document says how often it is used. Projected-gradient least squares fits the rates, within each
document's cap, so that the expected tokens of every domain meet its target; documents whose posteriors are equal to DECIMALS places and whose caps are equal share a rate,
so the rows of the iteration are these groups with their tokens by domain (summed from the exact posteriors), which Spark adds up in every round. A document of
unknown source may be used as often as its posteriors expect, rounded down, and once in any case. Rates become whole repeats by the hash of the document's id:
the part of a source that is used once more is the one below a threshold of the hash, found from the token sums of fine hash ranges, so the tokens of a source
differ from its rate by no more than one such range.

The size of the mix is the largest at which every source that is there can reach its share within its cap, times `fill`. Sources of the target table without
documents cannot contribute; their share goes to the others in proportion, and the report shows them with 0. Documents of other sources are not used.

The classifier learns from a bounded sample of labelled documents (TRAIN_DOCS texts of TRAIN_BYTES in all, none above LONGEST); all others are only scored.
NULL and empty texts have no tokens and are not used. A NULL or repeated target row counts once, with the larger share. Extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.text import words
from ridgeline.session import cut, stable_unit

#: Where the public tokenizer's vocabulary lies; a parameter of every function that needs it.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Most labelled documents that the domain classifier is trained on, its hash slots, and its passes.
TRAIN_DOCS, SLOTS, PASSES = 12_000, 1 << 13, 12
#: Bytes of these documents in all and of one, at most.
TRAIN_BYTES, LONGEST = 64 << 20, 1 << 20
#: Rounds of the projected gradient, the residual at which it stops, hash ranges per source (fewer where there are more than a hundred sources), decimals by which posteriors are grouped.
ROUNDS, SETTLED, RANGES, DECIMALS = 60, 1e-6, 4096, 2
#: Sources that a target table may have.
MAX_SOURCES = 1000


def count_tokens(df: DataFrame, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Adds n_tokens, the tokens of a text column under a public tokenizer; 0 for NULL."""

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)
        t.encode_special_tokens = True
        for s in batches:
            out = np.zeros(len(s), np.int64)
            for lo in range(0, len(s), 256):
                out[lo : lo + 256] = [len(e.ids) for e in t.encode_batch(s.iloc[lo : lo + 256].fillna("").tolist(), add_special_tokens=False)]
            yield pd.Series(out)

    return df.withColumn("n_tokens", F.pandas_udf(count, "long")(F.col(text)))


def _bag(text: str | None) -> np.ndarray:
    return np.unique([zlib.crc32(w.encode()) % SLOTS for w in words(text)]).astype(np.int64)


class Domains:
    """Multinomial logistic regression on hashed words."""

    def __init__(self, n: int):
        self.w, self.b = np.zeros((SLOTS, n), np.float32), np.zeros(n, np.float32)

    def fit(self, texts: list[str], y: np.ndarray, seed: int = 3) -> Domains:
        """Train by AdaGrad over single documents' bags in mini-batches."""
        bags, n = [_bag(t) for t in texts], self.w.shape[1]
        self.b[:] = np.log((np.bincount(y, minlength=n) + 0.5) / (len(y) + 0.5 * n))
        r, seen = np.random.default_rng(seed), np.full_like(self.w, 1e-3)
        for _ in range(PASSES):
            order = r.permutation(len(y))
            for lo in range(0, len(y), 128):
                now = order[lo : lo + 128]
                d = self._posterior([bags[k] for k in now])
                d[np.arange(len(now)), y[now]] -= 1
                at = np.concatenate([bags[k] for k in now])
                g = np.repeat(d, [len(bags[k]) for k in now], axis=0) / len(now)
                used, back = np.unique(at, return_inverse=True)
                sums = np.zeros((len(used), n), np.float32)
                np.add.at(sums, back, g)
                sums += 1e-4 * self.w[used]
                seen[used] += sums**2
                self.w[used] -= 0.1 * sums / np.sqrt(seen[used])
        return self

    def _posterior(self, bags: list[np.ndarray]) -> np.ndarray:
        z = np.stack([self.w[b].sum(0) + self.b for b in bags])
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def posterior(self, texts: list[str | None]) -> np.ndarray:
        """Rows of domain posteriors."""
        return self._posterior([_bag(t) for t in texts]) if texts else np.zeros((0, len(self.b)))


def _rates(post: np.ndarray, cap: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Rates after the steps so far: each moves a document by its posteriors' part and is then projected on [0, cap]."""
    r = np.zeros(len(cap))
    for s in steps:
        r = np.clip(r - post @ s, 0, cap)
    return r


def mix(docs: DataFrame, targets: DataFrame, fill: float = 1.0, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """The chosen documents (doc_id, source, n_tokens, rate, repeats) and the report per source."""
    spark = docs.sparkSession
    goal = {}
    for r in targets.filter("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").select("source", "target_share", "max_repeats").limit(MAX_SOURCES + 1).collect():
        if r["source"] not in goal or r["target_share"] > goal[r["source"]][0]:
            goal[r["source"]] = (float(r["target_share"]), int(r["max_repeats"]))
    if len(goal) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} target sources")
    names = sorted(goal)
    labelled = docs.filter(F.col("source").isin(names)) if names else docs.limit(0)
    usable = docs.filter(F.col("source").isNull() | F.col("source").isin(names)) if names else docs.limit(0)
    rows = count_tokens(usable.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.col("text").cast("string").alias("text")), "text", tokenizer).filter("n_tokens > 0")
    model = None
    if not usable.filter("source IS NULL").limit(1).isEmpty():
        fits = labelled.filter(F.octet_length("text") <= LONGEST)
        size = fits.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
        rate = min(1.0, TRAIN_DOCS / max(size["n"], 1), TRAIN_BYTES / max(size["b"] or 0, 1))
        sample = fits.filter(stable_unit(F.col("doc_id")) < rate).select("doc_id", "source", "text").orderBy("doc_id").toPandas()  # at most about TRAIN_BYTES
        model = Domains(len(names)).fit(sample["text"].tolist(), sample["source"].map(names.index).to_numpy(np.int64)) if len(sample) else None
    sent = spark.sparkContext.broadcast((names, model))
    caps = [goal[k][1] for k in names]

    def belong(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, m = sent.value
        place = {k: i for i, k in enumerate(of)}
        for f in frames:
            p = np.zeros((len(f), len(of)))
            known = f["source"].notna().to_numpy()
            p[np.flatnonzero(known), [place[s] for s in f["source"][known]]] = 1
            if m is not None and (~known).any():
                p[~known] = m.posterior(f["text"][~known].tolist())
            out = f[["doc_id", "source", "n_tokens"]].copy()
            out["post"], out["cap"] = list(p), np.floor(p @ np.array(caps, float) + 1e-6).astype(np.int32)
            out["alike"] = [zlib.crc32(q.round(DECIMALS).tobytes()) | len(q) << 32 for q in p]
            yield out

    members = cut(rows.mapInPandas(belong, "doc_id long, source string, n_tokens long, post array<double>, cap int, alike long").filter("cap > 0"))
    soft = F.col("source").isNull().alias("soft")
    by_domain = members.select("alike", "cap", soft, "n_tokens", F.posexplode("post").alias("k", "p")).filter("p > 0").groupBy("alike", "cap", "soft", "k").agg(F.sum(F.col("p") * F.col("n_tokens")).alias("t"))
    arrays = by_domain.groupBy("alike", "cap", "soft").agg(F.map_from_entries(F.collect_list(F.struct("k", "t"))).alias("m"))  # no more entries than sources
    parts = F.transform(F.sequence(F.lit(0), F.lit(max(len(names) - 1, 0))), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0)))
    totals = members.groupBy("alike", "cap", soft).agg(F.sum("n_tokens").alias("tokens"))
    mean = arrays.join(totals, ["alike", "cap", "soft"]).withColumn("post", F.transform(parts, lambda t: t / F.col("tokens")))
    groups = cut(mean.select("alike", "cap", "soft", "tokens", "post"))

    def sums(of: DataFrame, value) -> np.ndarray:
        parts = of.select(F.posexplode("post").alias("k", "p"), value.alias("v")).filter("p > 0").groupBy("k").agg(F.sum(F.col("p") * F.col("v")).alias("t")).collect()  # a row per source
        out = np.zeros(len(names))
        for r in parts:
            out[r["k"]] = r["t"]
        return out

    once, most = sums(groups, F.col("tokens")), sums(groups.filter("NOT soft"), F.col("tokens") * F.col("cap"))
    share = np.array([goal[k][0] for k in names])
    there = most > 0
    want = np.where(there, share, 0)
    want = want / want.sum() if there.any() else want
    total = fill * (most[there] / want[there]).min() if there.any() else 0.0
    steps: list[np.ndarray] = []
    for _ in range(ROUNDS if there.any() else 0):
        history = np.array(steps).reshape(len(steps), len(names))

        def reach(frames: Iterator[pd.DataFrame], history=history) -> Iterator[pd.DataFrame]:
            for f in frames:
                post = np.stack(f["post"].to_numpy())
                t = (post * (_rates(post, f["cap"].to_numpy(float), history) * f["tokens"].to_numpy(float))[:, None]).sum(0)
                yield pd.DataFrame({"k": np.arange(len(t)), "t": t})

        got = np.zeros(len(names))
        for r in groups.mapInPandas(reach, "k int, t double").groupBy("k").agg(F.sum("t").alias("t")).collect():
            got[r["k"]] = r["t"]
        off = got - want * total
        if np.abs(off).max() <= SETTLED * total:
            break
        steps.append(np.where(there, off / np.maximum(once, 1), 0))  # the gradient, scaled by what a unit of rate brings
    history = np.array(steps).reshape(len(steps), len(names))

    def rate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = f[["alike", "cap", "soft"]].copy()
            out["rate"] = _rates(np.stack(f["post"].to_numpy()), f["cap"].to_numpy(float), history) if len(f) else np.zeros(0)
            yield out

    # the rate of a document is that of its group
    found = groups.mapInPandas(rate, "alike long, cap int, soft boolean, rate double")
    rated = members.select("doc_id", "source", "n_tokens", "cap", "alike", soft).join(found, ["alike", "cap", "soft"]).drop("alike", "soft")
    rated = cut(rated.withColumns({"u": stable_unit(F.col("doc_id")), "whole": F.floor("rate")}))
    n_ranges = min(RANGES, 100 * RANGES // max(len(names), 1))
    ranges = rated.filter("source IS NOT NULL").groupBy("source", F.floor(F.col("u") * n_ranges).alias("at")).agg(F.sum("n_tokens").alias("t"), F.max(F.col("rate") - F.col("whole")).alias("rest")).toPandas()  # at most RANGES rows a source and 100 * RANGES in all
    bound = {}
    for k, g in ranges.sort_values("at").groupby("source"):
        run = g["t"].to_numpy(float).cumsum()
        need = g["rest"].max() * run[-1]
        at = int(np.searchsorted(run, need))
        low = run[at - 1] if at else 0.0
        bound[k] = (float(g["at"].iloc[min(at, len(g) - 1)]) + (need - low) / max(run[min(at, len(run) - 1)] - low, 1)) / n_ranges
    limit = F.col("rate") - F.col("whole")
    for k, v in bound.items():
        limit = F.when(F.col("source") == k, F.lit(v)).otherwise(limit)
    chosen = rated.withColumn("repeats", F.least(F.col("cap"), (F.col("whole") + (F.col("u") < limit).cast("int")).cast("int"))).filter("repeats > 0").select("doc_id", "source", "n_tokens", "rate", "repeats")
    used = chosen.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    plan = spark.createDataFrame([(k, goal[k][0], float(w), goal[k][1]) for k, w in zip(names, want, strict=True)], "source string, target_share double, target_of_present double, max_repeats int")
    whole = used.agg(F.sum("tokens").alias("all_tokens"))
    report = plan.join(used, "source", "full").join(F.broadcast(whole), how="cross")  # one row
    report = report.select(
        "source", "target_share", "target_of_present", "max_repeats", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("share"),
    )
    return chosen, report
