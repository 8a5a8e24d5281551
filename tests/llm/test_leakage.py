"""Leaked passages against a plain alignment of every pair."""

import random

import pytest

from ridgeline.llm.leakage import SHORT, Index, _search, align, expected_collisions, find_leaks, least_collisions, left_over, shingles, word_hashes
from ridgeline.llm.text import words

VOCAB = [f"w{k}" for k in range(900)]


def _plain(item, text):
    """Score and words found of the best local alignment."""
    best, last = (0, 0), [(0, 0)] * (len(text) + 1)
    for x in item:
        row = [(0, 0)]
        for j, y in enumerate(text, 1):
            d = (last[j - 1][0] + (1 if x == y else -1), last[j - 1][1] + (x == y))
            c = max([d, (last[j][0] - 1, last[j][1]), (row[-1][0] - 1, row[-1][1])], key=lambda v: v[0])
            row.append(c if c[0] > 0 else (0, 0))
        best, last = max([best, *row]), row
    return best


def _leak(rng, item, share):
    n = int(len(item) * share)
    at = rng.randint(0, len(item) - n)
    out = []
    for w in item[at : at + n]:
        k = rng.random()
        out += [] if k < 0.03 else [rng.choice(VOCAB)] if k < 0.06 else [w, rng.choice(VOCAB)] if k < 0.09 else [w]
    return out


def test_alignment_is_exact():
    import numpy as np

    rng = random.Random(1)
    for _ in range(40):
        a, b = [rng.choice("abcdef") for _ in range(12)], [rng.choice("abcdef") for _ in range(30)]
        known: dict = {}
        score, _ = align(word_hashes(a, known)[None], word_hashes(b, known)[None])
        assert score[0] == _plain(a, b)[0]
    assert align(np.zeros((1, 3), np.uint64), np.ones((1, 4), np.uint64))[0][0] == 0


def test_search_finds_what_alignment_finds():
    rng = random.Random(7)
    items = [[rng.choice(VOCAB) for _ in range(rng.randint(28, 45))] for _ in range(40)]
    docs, want = [], set()
    for d in range(300):
        text = [rng.choice(VOCAB) for _ in range(rng.randint(0, 400))]
        if d % 3 == 0:
            i = rng.randrange(40)
            at = rng.randint(0, len(text))
            text[at:at] = _leak(rng, items[i], rng.choice([0.25, 0.5, 0.7, 1.0]))
        docs.append(text)
        for i, item in enumerate(items):
            score, found = _plain(item, text) if sum(w in text for w in item) >= 0.4 * len(item) else (0, 0)
            if found >= 0.4 * len(item) and score >= 0.36 * len(item):
                want.add((d, i))
    index, known = Index(list(range(40)), [""] * 40, [" ".join(i) for i in items]), {}
    got = {(d, i) for d, i, *_ in _search(index, [word_hashes(t, known) for t in docs])}
    assert len(want) > 50 and got == want


def test_short_items():
    """Items of 3 to 25 words: whole and word for word below SHORT, else two fifths of the words with no more than one in six changed."""
    rng = random.Random(11)
    items = [[rng.choice(VOCAB) for _ in range(n)] for n in range(1, 26) for _ in range(2)]
    docs, want = [], set()
    for i, item in enumerate(items):
        for share in (0.2, 0.5, 0.8, 1.0):
            n = int(len(item) * share)
            at = rng.randint(0, len(item) - n)
            leak = item[at : at + n]
            if share < 1 and n >= 8:
                leak[rng.randrange(3, n - 3)] = "changed"
            text = [rng.choice(VOCAB) for _ in range(rng.randint(0, 80))]
            k = rng.randint(0, len(text))
            docs.append(text[:k] + leak + text[k:])
    for d, text in enumerate(docs):
        for i, item in enumerate(items):
            score, found = _plain(item, text) if len(set(item) & set(text)) * 3 > len(item) else (0, 0)
            n = len(item)
            if n >= 3 and (score == n if n < SHORT else found >= 0.4 * n and score >= 0.36 * n):
                want.add((d, i))
    index, known = Index(list(range(len(items))), [""] * len(items), [" ".join(i) for i in items]), {}
    got = {(d, index.ids[i]) for d, i, *_ in _search(index, [word_hashes(t, known) for t in docs])}
    assert len(want) > 100 and {len(items[i]) for _, i in want} == set(range(3, 26)) and got == want


def test_threshold_grows_with_containment():
    need = lambda size, item: least_collisions(expected_collisions(size, item - 2, item))
    assert need(24, 30) >= need(48, 30) >= 1 and need(3, 30) >= 1
    assert [left_over(n) for n in (2, 3, 7, 8, 12, 15, 26, 53)] == [0, 1, 5, 2, 3, 1, 6, 11]
    assert len(shingles(word_hashes(["a", "b"], {}))) == 0


def test_words():
    assert words("Ge&auml;ndert <b>Stra&szlig;e</b> Trai-\nsol O'x 12,5") == ["geandert", "strasse", "traisol", "o", "x", "12", "5"] and words(None) == words("") == []


def test_tables(spark):
    rng = random.Random(3)
    passage = " ".join(rng.choice(VOCAB) for _ in range(30))
    other = " ".join(rng.choice(VOCAB) for _ in range(30))
    upper = passage.upper().replace(" ", ",\n<i>")
    docs = [(1, passage, "s"), (2, f"x y z {upper} tail", "s"), (3, other[:40], "s"), (4, None, "s"), (5, "", "s"), (6, passage, "s"), (7, " ".join(rng.choice(VOCAB) for _ in range(60_000)) + " " + other, "s"), (None, passage, "s")]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(10, passage, None, "c"), (11, passage, "", "c"), (12, "too short", other, "c")], "item_id long, item_text string, ref_text string, doc_id string")
    got = {(r["item_id"], r["doc_id"]) for r in find_leaks(d, "doc_id", "text", items, "item_id", ["item_text", "ref_text"]).collect()}
    assert got == {(10, 1), (10, 2), (10, 6), (11, 1), (11, 2), (11, 6), (12, 7)}
    assert find_leaks(d.limit(0), "doc_id", "text", items, "item_id", ["item_text"]).count() == 0
    assert find_leaks(d, "doc_id", "text", items.limit(0), "item_id", ["item_text"]).count() == 0


@pytest.mark.parametrize("block", [1, 2])
def test_blocks_of_items(spark, monkeypatch, block):
    monkeypatch.setattr("ridgeline.llm.leakage.BLOCK", block)
    texts = [" ".join(f"t{i}_{k}" for k in range(20)) for i in range(3)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    i = spark.createDataFrame(list(enumerate(texts)), "item_id long, item_text string")
    assert {(r["item_id"], r["doc_id"]) for r in find_leaks(d, "doc_id", "text", i, "item_id", ["item_text"]).collect()} == {(0, 0), (1, 1), (2, 2)}
