"""Groups larger than a task are packed as the serial fold packs them."""

import random

import pytest
from pyspark.sql import functions as F

from memloom.operators import chunking


def slow_pack(sizes, most, sep, guard):
    out, chunk, used, empty = [], 0, 0, True
    for k, n in enumerate(sizes):
        if not empty and used + n > most:
            chunk, used, empty = chunk + 1, 0, True
        if not guard and k == 0 and n > most:
            chunk += 1
        out.append(chunk)
        used, empty = used + n + sep, False
    return out


@pytest.mark.parametrize("slice_items", [2, 7, 64])
@pytest.mark.parametrize("sep", [0, 1])
@pytest.mark.parametrize("most", [3, 20, 400])
def test_slices_are_chained(most, sep, slice_items):
    import numpy as np

    rng = random.Random(most + slice_items)
    for _ in range(40):
        sizes = [rng.choice([0, 1, 2, 5, 19, 30]) for _ in range(rng.randint(slice_items, 150))]
        want = slow_pack(sizes, most, sep, True)
        # the state behind each slice, from its map alone
        used, chunk = 0, -1
        for lo in range(0, len(sizes), slice_items):
            reach, made, left, total = chunking._slice_map(np.array(sizes[lo : lo + slice_items]), most, sep)
            at = int(np.searchsorted(reach, most - used, "right")) if lo else 0
            used, chunk = (left[at], chunk + made[at]) if at < len(reach) else (used + total, chunk)
            assert chunk == want[min(lo + slice_items, len(sizes)) - 1]


@pytest.mark.parametrize("guard", [True, False])
def test_one_group_with_most_items(spark, guard):
    rng = random.Random(3)
    groups = {"hot": 400, None: 90, "a": 10, "b": 25, "c": 26}
    rows = [(g, k, 50 if k == 0 and g != "b" else rng.randint(0, 30)) for g, n in groups.items() for k in range(n)]
    df = spark.createDataFrame(rows, "g string, k long, n long").repartition(5)
    got = {}
    for r in chunking.pack_greedy(df, group="g", order="k", tokens="n", max_tokens=40, guard=guard, slice_items=25).collect():
        got.setdefault(r.g, []).append((r.k, r.chunk_idx))
    for g in groups:
        assert [c for _, c in sorted(got[g])] == slow_pack([n for h, _, n in rows if h == g], 40, 1, guard), g


def test_a_whole_table_as_one_group(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.lit("all").alias("g"), "doc_id", F.col("n_chars").alias("n"))
    sizes = [r.n for r in docs.orderBy("doc_id").collect()]
    got = chunking.pack_greedy(docs, group="g", order="doc_id", tokens="n", max_tokens=5000, slice_items=100).orderBy("doc_id").collect()
    assert [r.chunk_idx for r in got] == slow_pack(sizes, 5000, 1, True)


@pytest.mark.parametrize("guard", [True, False])
def test_sentences_are_packed_where_they_are_read(spark, guard):
    rng = random.Random(4)
    sizes = {k: [rng.choice([1, 2, 3, 9, 12]) for _ in range(rng.randint(1, 30))] for k in range(60)}
    text = lambda n: " ".join(" ".join(["w"] * x) + "." for x in n)
    df = spark.createDataFrame([(k, text(n)) for k, n in sizes.items()] + [(None, "w."), (100, None), (101, " ")], "k long, t string").repartition(3)
    words = lambda c: F.size(F.split(c, " ")).cast("long")
    for counter in ("words", words):
        out = chunking.chunk_sentences(df, 8, key="k", text="t", counter=counter, guard=guard)
        if counter == "words":
            assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
        got = {}
        for r in out.collect():
            got.setdefault(r.k, {})[r.chunk_idx] = (r.text, r.n_items)
        assert set(got) == set(sizes)
        for k, n in sizes.items():
            want = {} if guard or n[0] <= 8 else {0: ("", 0)}
            places = slow_pack(n, 8, 1, guard)
            for c in sorted(set(places)):
                own = [x for x, p in zip(n, places) if p == c]
                want[c] = (text(own), len(own))
            assert got[k] == want
