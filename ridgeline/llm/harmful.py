"""Abusive, hateful and sexually explicit documents: a convolutional text classifier, trained and run in numpy.

Words are undisguised first (spaced or dotted letters joined, letter-like digits and signs read as letters, invisible characters and repeated letters
dropped) and then embedded by hash: a word's vector is the mean of those of the word and of its letter triples, so that a masked or misspelt word stays near.
Filters of several widths run over each sentence's words, each pooled by its maximum; a logistic output gives the sentence's probability, and a document is
harmful unless none of its sentences is (noisy or). So one sentence is enough whatever surrounds it, and the sentences of a clean document are all clean.

The labels are the reviewers' verdicts; documents on which they disagree or are undecided are left out. Of the others a bounded sample is used: at most
TRAIN_DOCS texts of TRAIN_BYTES bytes in all, none above LONGEST, drawn by the hash of their id. The loss allows for WRONG verdicts, and after a first
round of training those of harm that a model that has not seen them contradicts most clearly are left out of the second. Contradicted verdicts of `clean` stay: they are
what tells texts that only look like harm (a court's report, advice on health) from harm, and there are some twenty clean documents to each that is reviewed.

A text belongs to one of FOLDS folds by its hash. Those of the sample are scored by the models trained without their fold, all others by models trained on the whole sample, which
know wordings that were reviewed once. The held-out scores are calibrated by logistic regression with an offset for each language that is shrunk towards none;
the calibrated odds are then moved to the share of harmful documents in the whole corpus, by language, as found by expectation-maximisation over the counts
of scores (reviewers are sent more harmful documents than there are). A document is called harmful where its probability reaches the threshold with the best
expected F1 over the corpus; as probabilities are calibrated by language, that is another raw score in each.

NULL and empty texts score 0. Whole texts are read, long sentences in pieces of PIECE words that overlap. Equal texts of one language score alike. Without
enough verdicts (FOLDS of either kind) every score is NULL. Columns other than the named ones are not read.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.text import plain
from ridgeline.session import cut, stable_unit

SLOTS, DIM, FILTERS, WIDTHS = 1 << 15, 24, 24, (1, 2, 3, 4, 6)
#: The sample of labelled documents: texts, bytes in all and of one, at most.
TRAIN_DOCS, TRAIN_BYTES, LONGEST = 15_000, 64 << 20, 1 << 20
#: Folds, models of each (by round), documents a step, passes over the documents (by round), fewest steps.
FOLDS, SEEDS, BATCH, PASSES, LEAST_STEPS = 3, (1, 2), 64, (10, 12), 400
PIECE, OVERLAP = 64, 8
#: Share of verdicts of either kind that the loss takes to be wrong, and the held-out probability of its opposite from which a verdict is left out.
WRONG, CONTRADICTED = 0.02, 0.93
#: Share of words hidden in training, and of pooled features kept.
HIDDEN, KEPT = 0.08, 0.6
#: Bins of raw scores (log odds between -BOUND and BOUND) in which the corpus is counted.
BINS, BOUND = 240, 12.0

#: Signs read as letters, where a word has both. Fixed values.
LOOKALIKE = str.maketrans({"@": "a", "$": "s", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "!": "i", "|": "l", "€": "e"})
_SPACED = re.compile(r"(?<![\w*])(?:[^\W\d_] ){2,}[^\W\d_](?![\w*])")
_DOTTED = re.compile(r"(?<![\w*])(?:[^\W\d_][.\-_·]){2,}[^\W\d_](?![\w*])")
_TOKEN = re.compile(r"[\w@$*|€][\w@$*|€!']*|[!?]")
_RUN = re.compile(r"(.)\1+")
_END = re.compile(r"(?<=[.!?…])\s+|\.\.\.")


def _read(word: str) -> str:
    """A word with look-alike signs read as letters and repeated letters dropped; numbers are all one word."""
    if word.isdigit():
        return "9"
    bare = word.rstrip("!'")
    if bare != word and bare and not bare.endswith("$"):
        word = bare
    if any(c in "@$013457!|€" for c in word) and any(c.isalpha() for c in word):
        word = word.translate(LOOKALIKE)
    return _RUN.sub(r"\1", word)


def sentences(text: str | None) -> list[list[str]]:
    """The undisguised words of a text, with its exclamation and question marks, by sentence."""
    if not text:
        return []
    t = plain(text)
    t = _SPACED.sub(lambda m: m[0].replace(" ", ""), _DOTTED.sub(lambda m: re.sub(r"[.\-_·]", "", m[0]), t))
    return [ws for ws in ([_read(w) for w in _TOKEN.findall(part)] for part in _END.split(t)) if ws]


def slots_of(word: str) -> list[int]:
    """Hash slots of a word and its letter triples; slot 0 is kept for padding."""
    marked = f"<{word}>"
    parts = [word, *(marked[k : k + 3] for k in range(len(marked) - 2) if "*" not in marked[k : k + 3])]
    return [1 + zlib.crc32(p.encode("utf-8", "surrogatepass")) % (SLOTS - 1) for p in parts]


class Encoder:
    """Words as numbers, with the slots of each."""

    def __init__(self):
        self.ids: dict[str, int] = {"": 0}
        self.slots: list[list[int]] = [[0]]

    def _of(self, word: str) -> int:
        k = self.ids.get(word)
        if k is None:
            k = self.ids[word] = len(self.slots)
            self.slots.append(slots_of(word))
        return k

    def encode(self, text: str | None) -> list[np.ndarray]:
        """The sentences of a text, long ones in pieces."""
        out = []
        for ws in sentences(text):
            a = np.array([self._of(w) for w in ws], np.int64)
            out += [a[k : k + PIECE] for k in range(0, max(1, len(a) - OVERLAP), PIECE - OVERLAP)]
        return out

    def flat(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slots of the words in turn, where each begins, and how many each has."""
        lists = [self.slots[k] for k in which]
        n = np.array([len(x) for x in lists])
        return np.fromiter((s for x in lists for s in x), np.int64, n.sum()), np.cumsum(n) - n, n


def _sums(key: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their rows."""
    order = np.argsort(key, kind="stable")
    at = key[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[first], np.add.reduceat(rows[order], first)


def _runs(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of runs of n from start, one after the other, and which run each is of."""
    of = np.repeat(np.arange(len(n)), n)
    return start[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n), of


#: Each place of each filter width in turn: (width, place).
_PLACES = [(k, j) for k, w in enumerate(WIDTHS) for j in range(w)]


@dataclass
class Net:
    """Embedding, filters (their weights place by place, side by side), output of one model."""

    emb: np.ndarray
    weights: np.ndarray
    offset: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def new(cls, seed: int) -> Net:
        r = np.random.default_rng(seed)
        emb = r.normal(0, 0.3, (SLOTS, DIM)).astype(np.float32)
        emb[0] = 0
        weights = np.hstack([r.normal(0, (2 / (WIDTHS[k] * DIM)) ** 0.5, (DIM, FILTERS)) for k, _ in _PLACES]).astype(np.float32)
        n = FILTERS * len(WIDTHS)
        return cls(emb, weights, np.zeros(n, np.float32), r.normal(0, 0.05, n).astype(np.float32), np.array([-3.0], np.float32))

    def dense(self) -> list[np.ndarray]:
        return [self.weights, self.offset, self.out, self.bias]

    def forward(self, enc: Encoder, pieces: list[np.ndarray], hide: np.random.Generator | None = None):
        """Pooled features of pieces, and what the backward pass needs. Pieces lie one after the other with a blank on either side, filled up to the widest filter."""
        size = np.array([max(len(x) + 2, max(WIDTHS)) for x in pieces])
        first = np.cumsum(size) - size
        line = np.zeros(size.sum(), np.int64)
        at, _ = _runs(first + 1, np.array([len(x) for x in pieces]))
        line[at] = np.concatenate(pieces)
        if hide is not None:
            line[hide.random(len(line)) < HIDDEN] = 0
        which, line = np.unique(line, return_inverse=True)
        slots, starts, count = enc.flat(which)
        vectors = np.add.reduceat(self.emb[slots], starts) / count[:, None].astype(np.float32)
        table = (vectors @ self.weights).reshape(len(which), len(_PLACES), FILTERS).transpose(1, 0, 2).copy()
        heights, c = [], 0
        for w in WIDTHS:
            n = len(line) - w + 1
            h = table[c][line[:n]]
            for j in range(1, w):
                h += table[c + j][line[j : j + n]]
            heights.append(h)
            c += w
        pooled = []
        for w, h in zip(WIDTHS, heights, strict=True):
            last = first + size - w + 1
            cuts = np.stack([first, np.minimum(last, len(h) - 1)], 1).ravel()
            top = np.maximum.reduceat(h, cuts)[::2]
            if last[-1] >= len(h):  # the last window of all lies beyond the cut
                top[-1] = np.maximum(top[-1], h[-1])
            pooled.append(top)
        return np.maximum(np.hstack(pooled) + self.offset, 0), (line, first, size, vectors, slots, count, heights)

    def grads(self, p: np.ndarray, kept, dz: np.ndarray, mask: np.ndarray):
        """Gradients: the embedding's for the slots used, and those of dense(). Pieces without any are left out."""
        line, first, size, vectors, slots, count, heights = kept
        rows = np.flatnonzero(np.abs(dz) > 1e-5)
        rows = rows if len(rows) else np.array([0])
        p, mask, dz = p[rows], mask[rows], dz[rows]
        dp = (dz[:, None] * self.out) * mask * (p > 0)
        key, value, c = [], [], 0
        for k, (w, h) in enumerate(zip(WIDTHS, heights, strict=True)):
            span = size[rows] - w + 1
            at, of = _runs(first[rows], span)
            grid = np.full((len(rows), span.max(), FILTERS), -np.inf, np.float32)
            grid[of, at - first[rows][of]] = h[at]
            best = first[rows][:, None] + grid.argmax(1)
            for j in range(w):
                key.append(((line[best + j] * len(_PLACES) + c) * FILTERS + np.arange(FILTERS)).ravel())
                value.append(dp[:, k * FILTERS : (k + 1) * FILTERS].ravel())
                c += 1
        dt = np.bincount(np.concatenate(key), weights=np.concatenate(value), minlength=len(count) * len(_PLACES) * FILTERS).reshape(len(count), -1).astype(np.float32)
        dv = (dt @ self.weights.T) / count[:, None].astype(np.float32)
        return _sums(slots, np.repeat(dv, count, axis=0)), [vectors.T @ dt, dp.sum(0), (p * mask).T @ dz, dz.sum(keepdims=True)]


def noisy_or(z: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Log of the probability that none of a document's pieces is harmful, from the pieces' log odds."""
    return np.bincount(owner, weights=-np.logaddexp(0, z), minlength=n) if len(z) else np.zeros(n)


def _stack(docs: list[list[np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray]:
    return [x for d in docs for x in d], np.repeat(np.arange(len(docs)), [len(d) for d in docs])


def loss_slope(z: np.ndarray, owner: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slope of the mean log loss of documents by the log odds of their pieces, where WRONG of the labels of either kind are."""
    p = 1 - np.exp(noisy_or(z, owner, len(y)))
    q = WRONG + (1 - 2 * WRONG) * p
    d = np.where(y > 0, -1 / q, 1 / (1 - q)) * (1 - 2 * WRONG) * (1 - p)
    return (d[owner] / (1 + np.exp(-z)) / len(y)).astype(np.float32)


def train(enc: Encoder, docs: list[list[np.ndarray]], y: np.ndarray, seed: int, passes: int) -> Net:
    """Adam with words hidden at random and dropout before the output; the step falls to nothing over the passes, so the model settles."""
    rows = [k for k, d in enumerate(docs) if d]
    docs, y = [docs[k] for k in rows], y[rows]
    net, r = Net.new(seed), np.random.default_rng(seed)
    dense = net.dense()
    m, v = [np.zeros_like(q) for q in dense], [np.zeros_like(q) for q in dense]
    me, ve = np.zeros_like(net.emb), np.zeros_like(net.emb)
    order, steps = np.zeros(0, np.int64), max(LEAST_STEPS, passes * len(docs) // BATCH)
    for t in range(1, steps + 1):
        while len(order) < BATCH:
            order = np.concatenate([order, r.permutation(len(docs))])
        now, order = order[:BATCH], order[BATCH:]
        pieces, owner = _stack([docs[k] for k in now])
        p, kept = net.forward(enc, pieces, r)
        mask = (r.random(p.shape) < KEPT).astype(np.float32) / KEPT
        (used, de), g = net.grads(p, kept, loss_slope((p * mask) @ net.out + net.bias, owner, y[now]), mask)
        rate = 0.004 * min(1, t / 50) * (1 - t / (steps + 1)) ** 0.5
        for k, d in enumerate(g):
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.99 * v[k] + 0.01 * d * d
            dense[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7) + rate * 0.002 * dense[k]
        me[used] = 0.9 * me[used] + 0.1 * de
        ve[used] = 0.99 * ve[used] + 0.01 * de * de
        live = used[used > 0]
        net.emb[live] -= rate * 2 * me[live] / (np.sqrt(ve[live]) + 1e-5)
    return net


def raw_scores(nets: list[Net], enc: Encoder, docs: list[list[np.ndarray]]) -> np.ndarray:
    """Mean log odds of each document over the nets, within BOUND; -BOUND for one without words."""
    pieces, owner = _stack(docs)
    out, order = np.zeros(len(docs)), np.argsort([len(x) for x in pieces], kind="stable")
    for net in nets:
        z = np.zeros(len(pieces))
        for lo in range(0, len(order), 512):
            part = order[lo : lo + 512]
            z[part] = net.forward(enc, [pieces[k] for k in part])[0] @ net.out + net.bias
        none = np.minimum(noisy_or(z, owner, len(docs)), -1e-12)
        out += np.clip(np.log(-np.expm1(none)) - none, -BOUND, BOUND) / len(nets)
    return out


def fold_of(text: str | None) -> int:
    """The fold of a text."""
    return zlib.crc32((text or "").encode("utf-8", "surrogatepass")) % FOLDS


def digest(text: str | None) -> bytes:
    """Tells texts apart."""
    return hashlib.blake2b((text or "").encode("utf-8", "surrogatepass"), digest_size=12).digest()


def main_language(lang: Column) -> Column:
    """Two-letter code of a language written in one of several ways; NULL if missing."""
    two = F.substring(F.lower(F.trim(lang)), 1, 2)
    return F.when(two == "ge", "de").when(two == "sp", "es").otherwise(two)


def calibrate(x: np.ndarray, y: np.ndarray, lang: np.ndarray) -> tuple[float, float, dict[str, float]]:
    """Slope, intercept and offsets by language of the log odds that a document with raw score x is harmful. Newton steps; the offsets are held towards 0 by a penalty, so
    a language with few verdicts keeps the common curve."""
    names = sorted(set(lang) - {""})
    a = np.column_stack([x, np.ones(len(x)), *(lang == k for k in names)]).astype(float)
    hold = np.diag([0.01, 0.01, *[1.0] * len(names)])
    w, centre = np.zeros(a.shape[1]), np.r_[1.0, np.zeros(a.shape[1] - 1)]
    w[0] = 1
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + hold, a.T @ (y - p) - hold @ (w - centre))
        w += np.clip(step, -2, 2)
    return float(max(w[0], 0.05)), float(w[1]), dict(zip(names, w[2:].tolist(), strict=True))


@dataclass
class Model:
    """What scoring needs: models by fold and, last, those of the whole sample, the calibration of held-out scores, the share of harmful among the reviewed by language ("" for all), and the labelled
    documents' held-out scores and labels (those kept), by which it was found, and the digests of the sample's texts."""

    nets: list[list[Net]]
    slope: float
    intercept: float
    offsets: dict[str, float]
    prior: dict[str, float]
    held: np.ndarray
    y: np.ndarray
    known: frozenset[bytes] = frozenset()


def fit(labelled: DataFrame) -> Model | None:
    """labelled: doc_id, text, lang, harmful (BOOLEAN), one row per document."""
    fits = labelled.filter(F.octet_length("text") <= LONGEST)
    size = fits.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    rate = min(1.0, TRAIN_DOCS / max(size["n"], 1), TRAIN_BYTES / max(size["b"] or 0, 1))
    sample = fits.filter(stable_unit(F.col("doc_id")) < rate).orderBy("doc_id").toPandas()  # at most about TRAIN_BYTES
    y = sample["harmful"].to_numpy(bool) if len(sample) else np.zeros(0, bool)
    if y.sum() < FOLDS or (~y).sum() < FOLDS:
        return None
    fold = np.array([fold_of(t) for t in sample["text"]])
    spark = labelled.sparkSession
    texts = spark.sparkContext.broadcast(sample["text"].tolist())  # the bounded sample

    def round_(keep: np.ndarray, seeds: int, passes: int, last: bool) -> tuple[list[list[Net]], np.ndarray]:
        """Models by fold, trained on what is kept, in the last round also those of all folds, and the held-out raw score of every labelled document; a task a model."""
        sent = spark.sparkContext.broadcast((y, fold, keep))

        def one(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            os.environ.setdefault("OMP_NUM_THREADS", "1")
            labels, part, kept = sent.value
            for f in frames:
                for k in f["id"]:
                    enc = Encoder()
                    docs = [enc.encode(t) for t in texts.value]
                    out = part == k % FOLDS if k < FOLDS * seeds else np.zeros(len(part), bool)
                    rows, held = np.flatnonzero(~out & kept), np.flatnonzero(out)
                    net = train(enc, [docs[i] for i in rows], labels[rows].astype(np.float32), int(k) + 1 + 100 * seeds, passes)
                    yield pd.DataFrame({"id": [k], "model": [pickle.dumps((net, raw_scores([net], enc, [docs[i] for i in held])))]})

        n = FOLDS * seeds + (seeds if last else 0)
        nets, held = [[] for _ in range(FOLDS + 1)], np.zeros(len(y))
        models = spark.range(0, n, 1, n).mapInPandas(one, "id long, model binary").collect()  # n models of fixed size; a sort in Spark would train them twice
        for r in sorted(models, key=lambda r: r["id"]):
            net, z = pickle.loads(r["model"])
            k = r["id"] % FOLDS if r["id"] < FOLDS * seeds else FOLDS
            nets[k].append(net)
            held[fold == k] += z / seeds
        return nets, held

    keep = np.ones(len(y), bool)
    for k, (seeds, passes) in enumerate(zip(SEEDS, PASSES, strict=True)):
        nets, held = round_(keep, seeds, passes, k == len(SEEDS) - 1)
        limit = np.log(CONTRADICTED / (1 - CONTRADICTED))
        keep = ~y | (held > -limit)
        if min((y & keep).sum(), (~y & keep).sum()) < FOLDS:
            keep = np.ones(len(y), bool)
    lang = sample["lang"].fillna("").to_numpy(object)
    slope, intercept, offsets = calibrate(held[keep], y[keep].astype(float), lang[keep])
    prior = {k: float((y[keep & at].sum() + 1) / ((keep & at).sum() + 2)) for k, at in [("", np.ones(len(y), bool)), *((k, lang == k) for k in offsets)]}
    return Model(nets, slope, intercept, offsets, prior, held[keep], y[keep], frozenset(map(digest, sample["text"])))


def labelled_documents(docs: DataFrame, reviews: DataFrame) -> DataFrame:
    """Documents whose reviewers agree, with whether they found harm: verdicts other than `clean` that name a kind of it."""
    harm = F.col("verdict").isin("abusive", "hateful", "sexual")
    votes = reviews.filter("verdict IS NOT NULL").groupBy("doc_id").agg(F.sum(harm.cast("int")).alias("bad"), F.sum((F.col("verdict") == "clean").cast("int")).alias("good"))
    agreed = votes.filter("(bad > 0) <> (good > 0)").select("doc_id", (F.col("bad") > 0).alias("harmful"))
    return docs.select("doc_id", "text", main_language(F.col("lang")).alias("lang")).join(agreed, "doc_id").filter("text IS NOT NULL").dropDuplicates(["doc_id"])


def corpus_odds(model: Model, counts: pd.DataFrame) -> tuple[dict[str, float], float]:
    """By language, what is added to a raw score's calibrated log odds so that they fit the whole corpus, and the probability from which a document is called harmful.
    counts: lang, bin, n over all documents."""
    x = (counts["bin"].to_numpy() + 0.5) / BINS * 2 * BOUND - BOUND
    lang, n = counts["lang"].fillna("").to_numpy(object), counts["n"].to_numpy(float)
    shift, p = {}, np.zeros(len(x))
    for k in sorted(set(lang)):
        at = lang == k
        odds = model.slope * x[at] + model.intercept + model.offsets.get(k, 0.0)
        before = model.prior.get(k, model.prior[""])
        share = before
        for _ in range(200):
            q = 1 / (1 + np.exp(-(odds + np.log(share / (1 - share)) - np.log(before / (1 - before)))))
            share = float(np.clip(((q * n[at]).sum() + 0.05) / (n[at].sum() + 1), 1e-5, 1 - 1e-5))
        move = np.log(share / (1 - share)) - np.log(before / (1 - before))
        shift[k] = float(model.offsets.get(k, 0.0) + move)
        p[at] = 1 / (1 + np.exp(-(odds + move)))
    order = np.argsort(-p, kind="stable")
    f1 = 2 * np.cumsum((p * n)[order]) / (np.cumsum(n[order]) + (p * n).sum())
    return shift, float(p[order][int(f1.argmax())]) if len(p) else 0.5


def score_documents(docs: DataFrame, reviews: DataFrame) -> DataFrame:
    """doc_id, source, lang, score (the probability of harm), harmful for every document."""
    model = fit(labelled_documents(docs, reviews))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", main_language(F.col("lang")).alias("lang"), F.col("text").cast("string").alias("text"))
    if model is None:
        return rows.select("doc_id", "source", "lang", F.lit(None).cast("double").alias("score"), F.lit(None).cast("boolean").alias("harmful"))
    sent = docs.sparkSession.sparkContext.broadcast((model.nets, model.known))  # of fixed size

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ.setdefault("OMP_NUM_THREADS", "1")
        (nets, known), enc = sent.value, Encoder()
        for f in frames:
            if len(enc.slots) > 200_000:
                enc = Encoder()
            out = f[["doc_id", "source", "lang"]].copy()
            raw, fold = np.zeros(len(f)), np.array([fold_of(t) if digest(t) in known else FOLDS for t in f["text"]], np.int64)
            for k in range(FOLDS + 1):
                at = np.flatnonzero(fold == k)
                if len(at):
                    raw[at] = raw_scores(nets[k], enc, [enc.encode(t) for t in f["text"].iloc[at]])
            out["raw"], out["blank"] = raw, [not (t and t.strip()) for t in f["text"]]
            yield out

    raw = cut(rows.mapInPandas(run, "doc_id long, source string, lang string, raw double, blank boolean"))
    bin_ = F.least(F.floor((F.col("raw") + BOUND) / (2 * BOUND) * BINS), F.lit(BINS - 1)).cast("int")
    counts = raw.filter("NOT blank").groupBy("lang", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n")).toPandas()  # at most BINS rows a two-letter code
    shift, threshold = corpus_odds(model, counts)
    moved = F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for kv in shift.items() for v in kv)), F.coalesce("lang", F.lit(""))), F.lit(0.0)) if shift else F.lit(0.0)
    score = F.when(F.col("blank"), 0.0).otherwise(1 / (1 + F.exp(-(F.col("raw") * model.slope + model.intercept + moved))))
    return raw.withColumn("score", score).select("doc_id", "source", "lang", "score", ((F.col("score") >= threshold) & ~F.col("blank")).alias("harmful"))


def rates(scored: DataFrame) -> DataFrame:
    """Per source: documents, harmful ones, their share, mean score."""
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.count_if("harmful").alias("harmful_docs"), F.avg(F.col("harmful").cast("double")).alias("rate"), F.avg("score").alias("mean_score"))
