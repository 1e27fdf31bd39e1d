"""Containment by rolling hashes against looking everywhere."""

import random

import numpy as np
import pytest

from memloom.operators import containing


def test_windows_of_equal_text_have_equal_hashes():
    chars = np.frombuffer("abcabcabdabc".encode("utf-32-le"), np.uint32)
    for size, h in containing.window_hashes(chars, [1, 3, 12, 13]):
        at = {}
        for k, x in enumerate(h.tolist()):
            assert at.setdefault(tuple(chars[k : k + size]), x) == x
        assert len(h) == len(chars) - size + 1 and len(set(at.values())) == len(at)


@pytest.mark.parametrize("stretch", [5, 1 << 18])
def test_containing_is_looking_everywhere(spark, monkeypatch, stretch):
    monkeypatch.setattr(containing, "STRETCH", stretch)
    rng = random.Random(stretch)
    text = lambda n: "".join(rng.choice("ab é好") for _ in range(n))
    texts = [(rng.choice(["x", "y", None]), k, rng.choice([None, "", text(4), text(30), text(300)])) for k in range(60)]
    needles = [(rng.choice(["x", "y", None, "z"]), rng.choice([None, "", text(1), text(2), text(5), text(9), text(70)])) for _ in range(80)]
    needles += [(g, t[a : a + n]) for g, _, t in texts if t for a, n in ((0, 9), (len(t) // 2, 40), (len(t) // 3, 150), (0, len(t)))]
    held, asked = spark.createDataFrame(texts, "g string, k long, t string").repartition(3), spark.createDataFrame(needles, "g string, n string").repartition(2)
    got = containing.containing(held, asked, group="g", id="k", text="t", needle="n").collect()
    want = {(g, k, n) for g, k, t in texts for h, n in needles if g == h and t is not None and n is not None and n in t}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert containing.containing(held, asked.limit(0), group="g", id="k", text="t", needle="n").count() == 0
    assert containing.containing(held.limit(0), asked, group="g", id="k", text="t", needle="n").count() == 0
