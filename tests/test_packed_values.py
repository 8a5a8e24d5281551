"""Packed values: splits, quoting, positions, and what the column teaches."""

import random

from ridgeline.operators.packed_values import atoms, clean, fit, split_values

PLAIN = ["US 1", "I 90", "WA 20", "CR 5A", "SR 7", "none"]
CASES = {
    "US 2;I 90": ["US 2", "I 90"], "US 2 / WA 9": ["US 2", "WA 9"], "WA 3;;I 5; ": ["WA 3", "I 5"], "['I 90', 'US 5']": ["I 90", "US 5"], '"SR 8, old";US 1': ["SR 8, old", "US 1"], '"WA 8 ""Nor""";I 9': ['WA 8 "Nor"', "I 9"],
    "I 1 and US 4 und SR 2": ["I 1", "US 4", "SR 2"], "US 4\tI 3": ["US 4", "I 3"], '"US 4 / north","I 3"': ["US 4 / north", "I 3"], "US 4": ["US 4"], ' "US 4" ': ["US 4"], ";;": [], "": [], "  ": [], 'US 4 "x;I 3': ['US 4 "x', "I 3"],
}


def _column(spark, extra=()):
    rng = random.Random(1)
    texts = [rng.choice(PLAIN[:5]).replace("1", str(rng.randint(1, 99))) for _ in range(300)]
    for sep in (";", " / ", "\t", ", ", " and ", " und ", "|"):
        texts += [sep.join(rng.choice(PLAIN[:5]) for _ in range(rng.randint(2, 4))) for _ in range(30)]
    rows = [(k, t, "clash") for k, t in enumerate([*extra, *texts, None])]
    return spark.createDataFrame(rows, "osm_id long, ref string, items string")


def test_worked_cases(spark):
    df = _column(spark, CASES)
    got = {}
    for r in split_values(df, "osm_id", "ref").orderBy("osm_id", "pos").collect():
        got.setdefault(r["osm_id"], []).append((r["pos"], r["item"]))
    for k, want in enumerate(CASES.values()):
        assert got.get(k, []) == list(enumerate(want, 1)), list(CASES)[k]


def test_a_separator_that_the_column_never_uses_stays(spark):
    rng = random.Random(2)
    texts = [f"Salt + Pepper {rng.randint(1, 3)}" for _ in range(300)] + [f"a{rng.randint(1, 30)};b{rng.randint(1, 30)}" for _ in range(200)] + [f"a{k % 30}" for k in range(100)] + [f"b{k % 30}" for k in range(100)]
    model = fit(spark.createDataFrame([(t,) for t in texts], "ref string"), "ref")
    assert model.split("a3;b4") == ["a3", "b4"] and model.split("Salt + Pepper 2") in (["Salt + Pepper 2"], ["Salt", "Pepper 2"])


def test_empty_and_null(spark):
    df = spark.createDataFrame([(1, None)], "osm_id long, ref string")
    assert split_values(df, "osm_id", "ref").count() == 0 and split_values(df.limit(0), "osm_id", "ref").count() == 0


def test_long_text_and_repeats(spark):
    df = _column(spark, [";".join(["US 1"] * 3000), "US 1;US 1"])
    n = {r["osm_id"]: r["n"] for r in split_values(df, "osm_id", "ref").filter("osm_id < 2").groupBy("osm_id").agg({"pos": "max"}).withColumnRenamed("max(pos)", "n").collect()}
    assert n == {0: 3000, 1: 2}


def test_atoms_and_clean():
    assert atoms("[a];[b]") == (["[a]", "[b]"], [";"]) and atoms("(a; b)") == (["a", " b"], [";"]) and clean("(a) (b)") == "(a) (b)"
    assert atoms('"a;b";c') == (['"a;b"', "c"], [";"]) and clean(' "a ""b""" ') == 'a "b"' and clean("[x]") == "x" and clean("O'Neil'") == "O'Neil'"


def test_long_values_against_every_split(spark, monkeypatch):
    """Values of more than MAX_ATOMS stretches: Viterbi and expected counts against all segmentations."""
    import math
    from itertools import combinations

    import numpy as np

    import ridgeline.operators.packed_values as P

    monkeypatch.setattr(P, "MAX_ATOMS", 2)
    monkeypatch.setattr(P, "INSIDE", 0.3)
    rng = np.random.default_rng(3)
    for text in ("a;b,c;d;e", "x,y,z", "a / b;c;d,e,f;g", "a;b", "q"):
        model = P.Model(rng.random(P.SLOTS), rng.random(P.SLOTS), rng.random(len(P.KINDS)) * 5, np.full(len(P.KINDS), 6.0))
        parts, marks = P.atoms(text)
        n, kinds = len(parts), [P.kind_of(m) for m in marks]
        ways = []
        for k in range(n):
            for cuts in combinations(range(1, n), k):
                at, w, items = [0, *cuts, n], 0.0, []
                for i, j in zip(at[:-1], at[1:], strict=True):
                    joined = parts[i] + "".join(marks[q] + parts[q + 1] for q in range(i, j - 1))
                    own = model.value(P.clean(joined), j - i - 1) if j - i <= 2 else math.log(P.PRIOR / P.SLOTS / model.total) + (j - i - 1) * math.log(0.3)
                    w += own + sum(math.log(1 - model.part[kinds[q]]) for q in range(i, j - 1)) + (math.log(model.part[kinds[j - 1]]) if j < n else 0)
                    items.append(P.clean(joined))
                ways.append((w, items, cuts))
        if n > 2:  # the whole is weighed by its count and, as any long value, without it
            ways.append((sum(math.log(1 - model.part[q]) for q in kinds) + model.value(P.clean(text), n - 1), [P.clean(text)], ()))
        assert model.split(text) == max(ways)[1]
        total = sum(math.exp(w) for w, _, _ in ways)
        want = np.zeros(len(P.KINDS))
        for w, _, cuts in ways:
            for c in cuts:
                want[kinds[c - 1]] += math.exp(w) / total
        got = [np.zeros(P.SLOTS), np.zeros(P.SLOTS), np.zeros(len(P.KINDS)), np.zeros(len(P.KINDS))]
        model.expect(text, 1.0, *got)
        assert np.allclose(got[2], want)


def test_a_value_of_any_length_stays_whole(spark):
    rng = random.Random(5)
    note = ", ".join("".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(60))
    df = _column(spark, [note])
    model = fit(df, "ref")
    assert model.split(note) == [note]
