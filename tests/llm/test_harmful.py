"""The classifier: undisguised words, gradients, held-out accuracy, calibration, odd inputs."""

import random

import numpy as np
import pandas as pd

from ridgeline.llm.harmful import (
    BINS, BOUND, WRONG, Encoder, Model, Net, _stack, calibrate, corpus_odds, fit, labelled_documents, loss_slope, noisy_or, rates, raw_scores, score_documents, sentences, train,
)

NOUNS = ["river", "tower", "garden", "engine", "teacher", "bridge", "printer"]
BAD = ["you are a worthless {}", "i will break every bone of the {}", "such people are vermin in the {}"]
GOOD = ["the {} was open before noon", "vermin in the {} must be reported", "he called himself worthless near the {}", "break the {} into two parts"]


def _doc(rng, bad):
    parts = [rng.choice(GOOD).format(rng.choice(NOUNS)) for _ in range(rng.randint(1, 4))]
    if bad:
        parts.insert(rng.randint(0, len(parts)), rng.choice(BAD).format(rng.choice(NOUNS)))
    return ". ".join(parts)


def test_sentences():
    assert sentences("w h o l e s.h.o.u.l.d $l@pp3d choooke a​b You! 12:30 I'm") == [["whole", "should", "slaped", "choke", "ab", "you"], ["9", "9", "i'm"]]
    assert sentences("one. two... three? four") == [["one"], ["two"], ["thre", "?"], ["four"]]
    assert sentences("stop !") == [["stop", "!"]] and sentences(None) == sentences("") == sentences(" . ") == []


def test_gradients():
    rng = random.Random(0)
    enc = Encoder()
    pieces, owner = _stack([enc.encode(_doc(rng, k % 2 == 0)) for k in range(6)] + [enc.encode("No")])
    net, y = Net.new(1), np.array([1, 0, 1, 0, 1, 0, 0], np.float32)
    net.out[:] = np.random.default_rng(0).normal(0, 0.3, len(net.out))

    def loss():
        p = 1 - np.exp(noisy_or(net.forward(enc, pieces)[0] @ net.out + net.bias, owner, len(y)))
        q = WRONG + (1 - 2 * WRONG) * p
        return float(-np.mean(np.where(y > 0, np.log(q), np.log(1 - q))))

    p, kept = net.forward(enc, pieces)
    (used, de), (dw, doff, do, db) = net.grads(p, kept, loss_slope(p @ net.out + net.bias, owner, y), np.ones_like(p))
    word = used[len(used) // 2]
    for array, at, g in ((net.out, 5, do[5]), (net.bias, 0, db[0]), (net.offset, 30, doff[30]), (net.weights, (3, 50), dw[3, 50]), (net.emb, (word, 4), de[len(used) // 2, 4])):
        kept_value, step = array[at], 2e-3
        array[at] = kept_value + step
        up = loss()
        array[at] = kept_value - step
        down = loss()
        array[at] = kept_value
        assert abs((up - down) / (2 * step) - g) < 2e-3 + 0.05 * abs(g)


def test_pooling_is_by_piece():
    rng, net = np.random.default_rng(0), Net.new(2)
    enc = Encoder()
    pieces = [x for k in range(30) for x in enc.encode(" ".join(rng.choice(["a", "bc", "def", "ghij"], rng.integers(1, 15))))]
    together = net.forward(enc, pieces)[0]
    for k, x in enumerate(pieces):
        assert np.allclose(net.forward(enc, [x])[0][0], together[k], atol=1e-5)


def test_learns_what_it_has_not_seen():
    rng = random.Random(1)
    enc = Encoder()
    y = np.array([k % 3 == 0 for k in range(500)])
    docs = [enc.encode(_doc(rng, b)) for b in y]
    wrong = y[:350].copy()
    wrong[::40] = ~wrong[::40]  # a few verdicts are wrong
    net = train(enc, docs[:350], wrong.astype(np.float32), 1, 10)
    s = raw_scores([net], enc, docs[350:])
    assert ((s > 0) == y[350:]).mean() > 0.95
    hidden = raw_scores([net], enc, [enc.encode("The tower was open before noon. Y.o.u are a w0rthle$$ teacher"), enc.encode(""), enc.encode(" ".join(["the tower was open"] * 600) + ". you are a worthless teacher")])
    assert hidden[0] > 0 and hidden[1] == -BOUND and hidden[2] > 0


def test_calibration_and_the_share_of_the_corpus():
    rng = np.random.default_rng(5)
    x = rng.normal(0, 3, 4000)
    lang = np.where(rng.random(4000) < 0.02, "fr", "en").astype(object)
    y = rng.random(4000) < 1 / (1 + np.exp(-(0.8 * x - 1 + np.where(lang == "fr", 0.5, 0))))
    slope, intercept, offsets = calibrate(x, y.astype(float), lang)
    assert abs(slope - 0.8) < 0.08 and abs(intercept + offsets["en"] + 1) < 0.15 and abs(offsets["fr"]) < 1
    # a corpus in which harm is ten times rarer than among the reviewed
    true = rng.random(200_000) < 0.03
    z = np.where(true, rng.normal(4, 2, len(true)), rng.normal(-4, 2, len(true)))
    held = np.r_[rng.normal(4, 2, 600), rng.normal(-4, 2, 1400)]
    mark = np.r_[np.ones(600, bool), np.zeros(1400, bool)]
    slope, intercept, offsets = calibrate(held, mark.astype(float), np.full(2000, "en", object))
    model = Model([], slope, intercept, offsets, {"": 0.3, "en": 0.3}, held, mark)
    b = np.clip(((z + BOUND) / (2 * BOUND) * BINS).astype(int), 0, BINS - 1)
    counts = pd.DataFrame({"lang": "en", "bin": np.arange(BINS), "n": np.bincount(b, minlength=BINS)})
    shift, cut = corpus_odds(model, counts[counts["n"] > 0])
    p = 1 / (1 + np.exp(-(slope * z + intercept + shift["en"])))
    assert abs(p.mean() - 0.03) < 0.004
    f1 = lambda c: 2 * (true & (p >= c)).sum() / ((p >= c).sum() + true.sum())
    assert f1(cut) > max(f1(c) for c in np.linspace(0.05, 0.95, 19)) - 0.01


def test_tables(spark):
    rng = random.Random(2)
    rows = [(k, _doc(rng, k % 3 == 0), ["en", "EN", "en-GB", None][k % 4], f"s{k % 2}", "x") for k in range(240)] + [(900, None, "en", "s0", "x"), (901, "", None, None, "x"), (902, "you are a worthless river", "ger", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string")
    votes = [(k, "abusive" if k % 3 == 0 else "clean") for k in range(200)] + [(1, "sexual"), (2, "clean"), (3, "unsure"), (4, None), (7777, "clean")]
    reviews = spark.createDataFrame(votes, "doc_id long, verdict string")
    known = labelled_documents(docs, reviews)
    assert known.count() == 199 and known.filter("doc_id = 1").count() == 0  # reviewers differ on 1
    got = score_documents(docs, reviews).toPandas().set_index("doc_id")
    assert len(got) == len(rows) and got.loc[900, "score"] == got.loc[901, "score"] == 0 and got.loc[902, "harmful"]
    unseen = got.loc[200:239]
    assert (unseen["harmful"].astype(bool) == (unseen.index % 3 == 0)).mean() > 0.9
    r = rates(spark.createDataFrame(got.reset_index()[["doc_id", "source", "lang", "score", "harmful"]].astype({"harmful": bool})))
    assert r.count() == 3
    none = score_documents(docs, reviews.limit(0))
    assert none.filter("score IS NULL AND harmful IS NULL").count() == len(rows)
    assert score_documents(docs.limit(0), reviews.limit(0)).count() == 0 and fit(known.limit(1)) is None


def test_a_lookalike_reviewed_once_is_known(spark):
    """One verdict of `clean` on a wording that looks like harm holds for the documents with that wording, whatever their fold."""
    r = np.random.default_rng(8)
    town = lambda: "".join(r.choice(list("bdgklmnprst")) + r.choice(list("aeiou")) for _ in range(3))
    harm = [f"You filthy zorg of {town()}, go and rot in a ditch." for _ in range(60)]
    clean = [f"The bridge of {town()} was {w} after the storm." for w in ("new", "old", "wet", "closed") for _ in range(20)]
    alike = [f"Report your filthy zorg in {town()} to the office, or it will rot in a ditch." for _ in range(20)]
    texts = harm + clean + alike
    docs = spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    reviewed = [*range(45), *range(60, 125), len(harm) + len(clean)]
    reviews = spark.createDataFrame([(i, "abusive" if i < 60 else "clean") for i in reviewed], "doc_id long, verdict string")
    got = {r["doc_id"]: r["harmful"] for r in score_documents(docs, reviews).collect()}
    first = len(harm) + len(clean)
    assert all(got[i] for i in range(60)) and not any(got[i] for i in range(60, first))
    assert not any(got[i] for i in range(first + 1, len(texts)))
