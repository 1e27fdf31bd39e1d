"""Nearest names by edit distance and by similarity ratio against plain tables, and how many pairs are worked out."""

import random

import pytest

from memloom.functions.edits import nearest
from memloom.operators import retrieval, scoring


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b, 1):
            row.append(last[j - 1] + 1 if x == y else max(last[j], row[-1]))
    return 2 * row[-1] / (len(a) + len(b)) if a or b else 1.0


def some_texts(rng, n):
    letters = "abcde é猫😀"
    return ["".join(rng.choices(letters, k=rng.choice([0, 1, 3, 8, 20, 63, 64, 65, 130]))) for _ in range(n)]


@pytest.mark.parametrize("by_ratio", [False, True])
def test_nearest_against_plain_tables(by_ratio):
    rng = random.Random(5)
    texts, names = some_texts(rng, 40), sorted(set(some_texts(rng, 25)))
    place, cost, _ = nearest(texts, names, ratio=by_ratio)
    for t, p, c in zip(texts, place, cost):
        want = min((-ratio(t, n) if by_ratio else edits(t, n), k) for k, n in enumerate(names))
        assert (pytest.approx(want[0]), want[1]) == (c, p)


def test_few_pairs_are_worked_out():
    rng = random.Random(7)
    names = sorted({" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(3)) for _ in range(2000)})
    texts = [n[:4] + n[5:] for n in rng.sample(names, 50)]
    for by_ratio in (False, True):
        place, _, pairs = nearest(texts, names, ratio=by_ratio)
        assert pairs * 10 < len(texts) * len(names)
        assert sum(names[p][:4] == t[:4] for t, p in zip(texts, place)) >= 48


def test_a_very_long_text():
    place, cost, _ = nearest(["ab" * 500_000, "ab"], ["ab", "abab" * 30, "x"])
    assert place.tolist() == [1, 0] and cost.tolist() == [1_000_000 - 120, 0]


def test_nearest_names_of_a_table(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "NAMES", 7)
    monkeypatch.setattr(retrieval, "TEXTS", 3)
    rng = random.Random(11)
    texts = [*some_texts(rng, 30), "Paris", "paris", "", None, None, "a third of all rows", *["Hot"] * 20]
    names = [*some_texts(rng, 20), "PARIS", "Paris", "hot", None]
    items = spark.createDataFrame(list(enumerate(texts)), "k long, text string").repartition(3)
    known = spark.createDataFrame([(n,) for n in names], "text string").repartition(3)
    got = {r.k: (r.nearest, r.distance) for r in retrieval.nearest_name(items, known, text="text", name="text").collect()}
    alike = {r.k: (r.nearest, r.ratio) for r in retrieval.nearest_name(items, known, text="text", name="text", by="ratio").collect()}
    held = sorted({n for n in names if n is not None})
    assert len(got) == len(alike) == len(texts)
    for k, t in enumerate(texts):
        if t is None:
            assert got[k] == alike[k] == (None, None)
            continue
        d, n = min((edits(t.lower(), x.lower()), x) for x in held)
        assert got[k] == (n, d)
        r, n = min((-ratio(t, x), x) for x in held)
        assert alike[k] == (n, pytest.approx(-100 * r))


def test_no_names_and_no_texts(spark):
    items = spark.createDataFrame([(1, "a")], "k long, t string")
    none = spark.createDataFrame([], "n string")
    assert [(r.nearest, r.distance) for r in retrieval.nearest_name(items, none, text="t", name="n").collect()] == [(None, None)]
    assert retrieval.nearest_name(items.limit(0), spark.createDataFrame([("a",)], "n string"), text="t", name="n", by="ratio").collect() == []


def test_labels_by_edits_and_by_ratio(spark):
    # four edits to "x", five to "abcdefghi", of which it has four letters in order
    labels = spark.createDataFrame([("x",), ("abcdefghi",)], "name string")
    rows = spark.createDataFrame([(1, '["abcd"]', ["abcdefghi"])], "k long, said string, golds array<string>")
    got = {by: scoring.label_f1(rows, labels, key="k", by=by).first().f1 for by in ("edits", "ratio")}
    assert got["edits"] == 0.0 and got["ratio"] == pytest.approx(1.0, abs=1e-4)
