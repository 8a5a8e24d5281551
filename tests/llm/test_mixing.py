"""Mixing: shares, caps, missing sources, unlabelled documents."""

import random

import numpy as np
import pytest

from ridgeline.llm.mixing import Domains, _rates, count_tokens, mix

TARGETS = [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4), ("absent", 0.1, 9)]
KEYS = {"big": "alpha beta gamma", "mid": "delta epsilon zeta", "small": "eta theta iota", "other": "kappa"}


def _docs(spark, unlabelled=20):
    rng, rows = random.Random(0), []
    for source, n in (("big", 600), ("mid", 150), ("small", 60), ("other", 50)):
        rows += [(len(rows) + k, " ".join(rng.choice(KEYS[source].split()) for _ in range(rng.randint(5, 60))), source, "x") for k in range(n)]
    rows += [(5000 + k, KEYS["small"] + " eta", None, "x") for k in range(unlabelled)] + [(9000, None, "big", "x"), (9001, "", "big", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, rate string")


def _targets(spark):
    return spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")


def test_shares_and_caps(spark):
    chosen, report = mix(_docs(spark), _targets(spark))
    rows = {r["source"]: r for r in report.collect()}
    present = {"big": 0.5, "mid": 0.3, "small": 0.2}
    unlabelled = rows[None]["share"] if None in rows else 0.0
    assert rows["absent"]["tokens"] == 0 and rows["absent"]["share"] == 0
    for k, s in present.items():
        reached = rows[k]["share"] + (unlabelled if k == "small" else 0)
        assert abs(reached - s) < 0.02 and rows[k]["most_repeats"] <= rows[k]["max_repeats"]
    c = chosen.toPandas()
    assert c["doc_id"].is_unique and set(c["source"].dropna()) <= set(present) and c["repeats"].min() >= 1 and not c["doc_id"].isin([9000, 9001]).any()
    cap = c["source"].map({k: m for k, _, m in TARGETS}).fillna(4)
    assert (c["repeats"] <= cap).all() and (c["rate"] <= cap + 1e-9).all()


def test_some_source_is_used_up(spark):
    _, report = mix(_docs(spark, 0), _targets(spark))
    rows = {r["source"]: r for r in report.collect()}
    assert None not in rows
    half = {r["source"]: r["tokens"] for r in mix(_docs(spark, 0), _targets(spark), fill=0.5)[1].collect()}
    assert all(abs(half[k] / rows[k]["tokens"] - 0.5) < 0.05 for k in ("big", "mid", "small"))


def test_nothing_to_mix(spark):
    chosen, report = mix(_docs(spark).limit(0), _targets(spark))
    assert chosen.count() == 0 and all(r["share"] == 0 for r in report.collect())
    assert mix(_docs(spark), _targets(spark).limit(0))[0].count() == 0


def test_tokens(spark):
    df = spark.createDataFrame([("Hello world",), (None,), ("",), ("<|endoftext|>",)], "text string")
    n = [r["n_tokens"] for r in count_tokens(df, "text").collect()]
    assert n[0] == 2 and n[1] == n[2] == 0 and n[3] > 1


def test_domains_held_out():
    rng = random.Random(1)
    texts, y = [], []
    for k in range(400):
        name = list(KEYS)[k % 3]
        texts.append(" ".join(rng.choice(KEYS[name].split() + ["the", "a", "of"]) for _ in range(12)))
        y.append(k % 3)
    d = Domains(3).fit(texts[:300], np.array(y[:300]))
    p = d.posterior(texts[300:])
    assert (p.argmax(1) == np.array(y[300:])).mean() > 0.95 and np.allclose(p.sum(1), 1)


def test_rates_are_projected():
    r = _rates(np.eye(2), np.array([1.0, 3.0]), np.array([[-2.0, -2.0], [0.5, -2.0], [9.0, 0.0]]))
    assert r.tolist() == pytest.approx([0.0, 3.0])


def test_a_document_of_any_of_many_sources_is_used(spark):
    """Forty sources of one wording: each posterior of a document without a source is about 0.025, and it still takes part."""
    rng = random.Random(8)
    words_ = ["river", "tower", "garden", "engine", "bridge", "lamp"]
    text = lambda: " ".join(rng.choice(words_) for _ in range(12))
    rows = [(k, text(), f"s{k % 40}") for k in range(400)] + [(1000 + k, text(), None) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([(f"s{k}", 1 / 40, 2) for k in range(40)], "source string, target_share double, max_repeats int")
    chosen, report = mix(docs, targets)
    c = chosen.toPandas()
    assert (c["source"].isna()).sum() > 20 and c["repeats"].max() <= 2
    shares = [r["share"] for r in report.collect() if r["source"]]
    assert len(shares) == 40 and max(shares) < 0.04
