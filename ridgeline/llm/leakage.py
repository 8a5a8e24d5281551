"""Held-out passages inside a corpus: which documents hold a stretch of which test items.

MinHash containment search. The domains are windows of WINDOW word shingles that overlap by half, so a document of any length is searched whole and its
length does not thin out the similarity; the windows are partitioned by their number of shingles (documents shorter than a window give smaller ones), and
for each size class the containment sought of an item is turned into the Jaccard value it means at that size and from it into the number of signature
positions that must agree, such that a pair at the sought containment is missed with a probability below MISS. What collides is verified exactly: first
by the shingles of the item that the window really holds, then by the best local alignment of the item's words with the words around the window, in which
a word changed, missing or added costs as much as a word found brings.

Shingles have SHINGLE = 3 words, not five: single words of a leaked stretch may be changed, and two changes in a stretch of 14 words leave no run of five.

What a window must hold follows from the item's length: the shingles left of two fifths of its words when one word in six is changed, HELD at most. Where that
is so little that no number of agreeing positions finds it at MISS (items below some twenty words), the item's shingles are looked up one by one instead,
which misses nothing. An item of fewer than SHORT words has to be there whole and word for word, as two fifths of it are a few words that prove nothing; one
without a single shingle (one or two words) matches nothing.

The items are a stated query set: they go to the workers in blocks of BLOCK texts (of bounded size), each block in one pass over the corpus, so neither side
is shuffled and a group of copies among the documents is no hot spot. NULL and empty texts hold nothing. Repeated documents are each reported; a repeated item is reported once per id. Very long texts
are taken window by window. Columns other than the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.text import words

SHINGLE, WINDOW, HASHES = 3, 48, 128
#: Containment of an item's shingles that the search is set to, what may be missed at it, and the most item shingles that a window is asked to hold.
SOUGHT, MISS, HELD = 0.2, 1e-3, 4
#: Share of the item's words in one stretch, and the share left after what was changed, missing or added is taken off.
SHARE, NET = 0.4, 0.36
SHORT, BLOCK, ALIGN = 8, 20_000, 512

_rng = np.random.default_rng(20)
_A = (_rng.integers(1, 1 << 62, HASHES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def word_hashes(ws: list[str], known: dict[str, int]) -> np.ndarray:
    """64-bit hashes of words; known: those computed before."""
    out = np.empty(len(ws), np.uint64)
    for k, w in enumerate(ws):
        h = known.get(w)
        if h is None:
            h = xxhash.xxh3_64_intdigest(w)
            if len(known) < 1_000_000:
                known[w] = h
        out[k] = h
    return out


def shingles(h: np.ndarray) -> np.ndarray:
    """Hashes of the runs of SHINGLE words."""
    n = len(h) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        s = h[:n].copy()
        for k in range(1, SHINGLE):
            s = (s ^ (s >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
        return s ^ (s >> np.uint64(29))


def _position(s: np.ndarray, j: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        v = s * _A[j] + _B[j]
        return v ^ (v >> np.uint64(32))


def left_over(n_words: int) -> int:
    """Shingles that two fifths of an item of n_words words keep when one word in six of them is changed; all of its shingles below SHORT words."""
    if n_words < SHORT:
        return max(0, n_words - SHINGLE + 1)
    m = int(np.ceil(SHARE * n_words))
    return max(1, m - SHINGLE + 1 - SHINGLE * (m // 6))


def expected_collisions(size: int, item_size: int, n_words: int) -> float:
    """Signature positions that agree on average for a window of at most `size` shingles that holds what is sought of an item."""
    held = min(max(SOUGHT * item_size, HELD), left_over(n_words), size, item_size)
    return HASHES * held / (size + item_size - held)


def least_collisions(expected: float) -> int:
    """Signature positions that must agree such that fewer are seen with a probability below MISS."""
    tail, term, c = 0.0, float(np.exp(-expected)), 0
    while tail + term < MISS:
        tail, c = tail + term, c + 1
        term *= expected / c
    return max(1, c)


def align(items: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignments of many pairs at a time (rows of word hashes, padded with 0 and 1): (score, words found)."""
    n, m = items.shape[1], texts.shape[1]
    score, found = np.zeros((m + 1, len(items)), np.int32), np.zeros((m + 1, len(items)), np.int32)
    best = np.zeros(len(items), np.int64)
    for i in range(n):
        same = (items[:, i][None, :] == texts.T).astype(np.int32)
        diagonal = score[:-1] + 2 * same - 1
        up = score[1:] - 1
        s = np.where(diagonal >= up, diagonal, up)
        f = np.where(diagonal >= up, found[:-1] + same, found[1:])
        new, nf = np.zeros_like(score), np.zeros_like(found)
        for j in range(m):
            left = new[j] - 1
            take = left > s[j]
            v = np.where(take, left, s[j])
            positive = v > 0
            new[j + 1] = np.where(positive, v, 0)
            nf[j + 1] = np.where(positive, np.where(take, nf[j], f[j]), 0)
        score, found = new, nf
        best = np.maximum(best, ((score.astype(np.int64) << 20) | found).max(axis=0))
    return (best >> 20).astype(np.int64), (best & ((1 << 20) - 1)).astype(np.int64)


class Index:
    """The signatures of a block of item texts."""

    def __init__(self, ids: list[int], sides: list[str], texts: list[str]):
        known: dict[str, int] = {}
        rows = [(i, s, h) for i, s, h in ((i, s, word_hashes(words(t), known)) for i, s, t in zip(ids, sides, texts, strict=True)) if len(h) >= SHINGLE]
        self.ids, self.sides, self.words = [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]
        self.sets = [np.unique(shingles(h)) for h in self.words]
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        self.universe = np.unique(np.concatenate(self.sets)) if self.sets else np.zeros(0, np.uint64)
        self.pairs = np.concatenate([np.searchsorted(self.universe, u) + i * len(self.universe) for i, u in enumerate(self.sets)]) if self.sets else np.zeros(0, np.int64)
        self.lengths = np.array([len(h) for h in self.words], np.int64)
        self.need = np.minimum(HELD, [left_over(int(n)) for n in self.lengths]).astype(np.int64)
        self.need = np.where(self.lengths < SHORT, self.sizes, self.need)  # shingles that a window must hold
        # items that collisions cannot be relied on for: their shingles, in order, with the item of each
        self.listed = np.array([np.exp(-expected_collisions(WINDOW, int(m), int(n))) > MISS for m, n in zip(self.sizes, self.lengths, strict=True)], bool)
        few = np.flatnonzero(self.listed)
        key = np.concatenate([self.sets[i] for i in few]) if len(few) else np.zeros(0, np.uint64)
        order = np.argsort(key, kind="stable")
        self.posted, self.of = key[order], np.repeat(few, self.sizes[few])[order]
        self.order, self.minima = [], []
        for j in range(HASHES if rows else 0):
            least = np.array([_position(s, j).min() for s in self.sets])
            self.order.append(np.argsort(least, kind="stable"))
            self.minima.append(least[self.order[-1]])

    def candidates(self, s: np.ndarray, starts: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (window, item) that agree in enough positions. s: shingles; starts: first shingle of each half window; second: the half that follows, or itself."""
        n = len(self.sets)
        hits = []
        for j in range(HASHES):
            half = np.minimum.reduceat(_position(s, j), starts)
            least = np.minimum(half, half[second])
            lo, hi = np.searchsorted(self.minima[j], least, "left"), np.searchsorted(self.minima[j], least, "right")
            count = hi - lo
            w = np.flatnonzero(count)
            if len(w):
                c = count[w]
                at = np.repeat(lo[w] - np.cumsum(c) + c, c) + np.arange(c.sum())
                hits.append(np.repeat(w, c) * n + self.order[j][at])
        lw, li = self._looked_up(s, starts, second)
        if not hits:
            return lw, li
        pair, agree = np.unique(np.concatenate(hits), return_counts=True)
        pair, agree = pair[~self.listed[pair % n]], agree[~self.listed[pair % n]]
        w, item = pair // n, pair % n
        length = np.diff(np.append(starts, len(s)))
        size = length[w] + np.where(second[w] != w, length[second[w]], 0)
        size = np.minimum(WINDOW, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))  # the upper bound of the size class
        need = self._need(size, item)
        return np.concatenate([w[agree >= need], lw]), np.concatenate([item[agree >= need], li])

    def _looked_up(self, s: np.ndarray, starts: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (window, item) that share a shingle, of the listed items."""
        if not len(self.posted):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lo, hi = np.searchsorted(self.posted, s, "left"), np.searchsorted(self.posted, s, "right")
        hit = np.flatnonzero(hi > lo)
        n = (hi - lo)[hit]
        at = np.repeat(lo[hit] - np.cumsum(n) + n, n) + np.arange(n.sum())
        half = np.searchsorted(starts, np.repeat(hit, n), "right") - 1
        # a window is a half and the one that follows in the same document
        before = half - 1
        joined = (before >= 0) & (second[np.maximum(before, 0)] == half)
        pair = np.unique(np.concatenate([half * len(self.sets) + self.of[at], before[joined] * len(self.sets) + self.of[at][joined]]))
        return pair // len(self.sets), pair % len(self.sets)

    def held(self, s: np.ndarray, lo: np.ndarray, hi: np.ndarray, w: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those pairs whose window really holds the shingles that the item needs."""
        at = np.minimum(np.searchsorted(self.universe, s), len(self.universe) - 1)
        at[self.universe[at] != s] = -1
        keep = np.zeros(len(w), bool)
        for a in range(0, len(w), 20_000):
            n = (hi - lo)[a : a + 20_000]
            k = np.repeat(np.arange(len(n)), n)
            u = at[lo[a : a + 20_000][k] + np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)]
            key = item[a : a + 20_000][k] * len(self.universe) + u
            found = self.pairs[np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)] == key
            keep[a : a + 20_000] = np.bincount(k[found & (u >= 0)], minlength=len(n)) >= self.need[item[a : a + 20_000]]
        return w[keep], item[keep]

    def _need(self, size: np.ndarray, item: np.ndarray) -> np.ndarray:
        of = np.stack([size, self.sizes[item], self.lengths[item]], 1)
        kind, back = np.unique(of, axis=0, return_inverse=True)
        return np.array([least_collisions(expected_collisions(*map(int, k))) for k in kind], np.int64)[back.ravel()]


def _search(index: Index, docs: list[np.ndarray]) -> Iterator[tuple[int, int, int, float, float]]:
    """(document, item, words found, share, net share) of the pairs that hold, best stretch of each."""
    half = WINDOW // 2
    s, starts, second, owner, offset, at = [], [], [], [], [], 0
    for d, h in enumerate(docs):
        sh = shingles(h)
        if not len(sh):
            continue
        n = -(-len(sh) // half)
        first = len(starts)
        starts += [at + k * half for k in range(n)]
        second += [first + min(k + 1, n - 1) for k in range(n)]
        owner += [d] * n
        offset += [k * half for k in range(n)]
        s.append(sh)
        at += len(sh)
    if not s or not len(index.universe):
        return
    s, starts, second, owner, offset = np.concatenate(s), np.array(starts), np.array(second), np.array(owner), np.array(offset)
    w, item = index.candidates(s, starts, second)
    ends = np.append(starts, len(s))
    w, item = index.held(s, ends[w], ends[second[w] + 1], w, item)
    jobs = sorted(zip(w.tolist(), item.tolist(), strict=True), key=lambda x: len(index.words[x[1]]))
    best: dict[tuple[int, int], tuple[int, float, float]] = {}
    for lo in range(0, len(jobs), ALIGN):
        part = jobs[lo : lo + ALIGN]
        its = [index.words[i] for _, i in part]
        n = max(map(len, its))
        around = [docs[owner[a]][max(0, offset[a] - len(t)) : offset[a] + WINDOW + SHINGLE + len(t)] for (a, _), t in zip(part, its, strict=True)]
        x, y = np.zeros((len(part), n), np.uint64), np.ones((len(part), max(map(len, around))), np.uint64)
        for k, (t, b) in enumerate(zip(its, around, strict=True)):
            x[k, : len(t)], y[k, : len(b)] = t, b
        score, found = align(x, y)
        for (a, i), sc, f in zip(part, score.tolist(), found.tolist(), strict=True):
            size = len(index.words[i])
            if f >= SHARE * size and sc >= NET * size and (size >= SHORT or sc == size):
                key = (int(owner[a]), i)
                best[key] = max(best.get(key, (0, 0.0, 0.0)), (f, f / size, sc / size))
    for (d, i), v in best.items():
        yield d, i, *v


RESULT = "item_id long, item_side string, doc_id long, words_found int, share double, net_share double"


def find_leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, sides: list[str]) -> DataFrame:
    """Every document and item text where one stretch of the document gives at least SHARE of the text's words in their order."""
    spark = docs.sparkSession
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).filter("text IS NOT NULL AND doc_id IS NOT NULL")
    out, block = None, []

    def one_pass(part: list[tuple[int, str, str]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(Index(*(list(c) for c in zip(*part, strict=True))))  # at most BLOCK texts

        def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known: dict[str, int] = {}
            for f in frames:
                for lo in range(0, len(f), 2000):
                    g = f.iloc[lo : lo + 2000]
                    ids = g["doc_id"].to_numpy()
                    found = [(sent.value.ids[i], sent.value.sides[i], ids[d], *v) for d, i, *v in _search(sent.value, [word_hashes(words(t), known) for t in g["text"]])]
                    yield pd.DataFrame(found, columns=["item_id", "item_side", "doc_id", "words_found", "share", "net_share"])

        return rows.mapInPandas(search, RESULT)

    stacked = items.select(items[item_id].cast("long").alias("id"), F.explode(F.array(*(F.struct(F.lit(s).alias("side"), items[s].cast("string").alias("text")) for s in sides))).alias("t"))
    for r in stacked.select("id", "t.side", "t.text").filter("text IS NOT NULL AND id IS NOT NULL").toLocalIterator():
        block.append((r["id"], r["side"], r["text"]))
        if len(block) == BLOCK:
            out, block = one_pass(block) if out is None else out.unionByName(one_pass(block)), []
    if block or out is None:
        part = one_pass(block) if block else rows.limit(0).mapInPandas(lambda fs: (pd.DataFrame(columns=["item_id", "item_side", "doc_id", "words_found", "share", "net_share"]) for _ in fs), RESULT)
        out = part if out is None else out.unionByName(part)
    return out
