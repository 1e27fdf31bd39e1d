"""Ordered helpers against one-step-at-a-time versions, goldens, invariants and edge inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom.functions import answers as A
from memloom.functions.text import token_count, word_tokens
from memloom.operators import chunking, curation, instances, memory, metrics, ranking, retrieval, rollouts, scoring, sft
from memloom.plans.io_queries import streamed
from memloom.streaming import memory_stream


def slow_pack(sizes, target, sep, guard=True):
    out, chunk, used, filled = [], 0, 0, False
    most = lambda: target(chunk) if callable(target) else target
    for n in sizes:
        if used + n > most() and (filled or not guard):
            chunk, used = chunk + 1, 0
        out.append(chunk)
        used, filled = used + n + sep, True
    return out


@pytest.mark.parametrize("sep", [0, 1, 3])
def test_packing_places(sep):
    rng = random.Random(1)
    for _ in range(200):
        sizes = [rng.randint(0, 30) for _ in range(rng.randint(1, 40))]
        for target in (20, lambda c: 10 + c % 7):
            got = chunking.pack_places(np.array(sizes), target, sep)
            assert got.tolist() == slow_pack(sizes, target, sep)
            assert sorted(got.tolist()) == got.tolist()
    assert chunking.pack_places(np.array([50, 1]), 20, 0, guard=False).tolist() == [1, 2]


def test_packing_conserves_items_on_any_partitioning(spark):
    rng = random.Random(2)
    rows = [(k % 3, k, f"t{k}", rng.randint(1, 9)) for k in range(200)]
    df = spark.createDataFrame(rows, "g long, o long, text string, n long")
    got = None
    for parts in (1, 8):
        d = df.repartition(parts)
        places = chunking.pack_greedy(d, group="g", order="o", tokens="n", max_tokens=30)
        chunks = sorted(map(tuple, chunking.join_chunks(d, places, group="g", order="o", text="text").collect()))
        assert got is None or chunks == got
        got = chunks
    assert sum(c[3] for c in got) == 200
    for g in range(3):
        assert "\n".join(c[2] for c in got if c[0] == g).split("\n") == [r[2] for r in rows if r[0] == g]


def test_segments_keep_questions_with_answers(spark):
    turns = [(1, k, "user" if k % 2 == 0 else "assistant", 10) for k in range(6)]
    got = chunking.segment_sessions(spark.createDataFrame(turns, "c long, t long, role string, n long"), 35, key="c", turn="t", role="role", tokens="n")
    assert [r.segment for r in got.orderBy("t").collect()] == [0, 0, 1, 1, 2, 2]
    assert chunking._segments([50, 60], ["user", "assistant"], 40) == [0, 1]


def test_merging_segments():
    assert chunking._merged([1000, 900, 100, 3000, 10, 2040], 1800, 2048) == [0, 0, 1, 2, 3, 4]


def test_long_turns_lose_no_words(spark):
    text = "One two three. " + "word " * 45 + "end! Last one?"
    rows = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", "short")], "c long, t long, role string, text string")
    out = chunking.split_long_turns(rows, 30, key=["c", "t"], role="role", text="text", slack=10).orderBy("t", "part").collect()
    assert " ".join(r.text for r in out if r.t == 0).split() == text.split()
    assert all(len(r.text.split()) <= 20 for r in out)


def slow_fold(ops):
    core, held, out = "", {"semantic": [], "episodic": []}, []
    for chunk, op, name, kind, mid, content in ops:
        kind = kind.replace("_memory", "")
        if kind == "core":
            core = content if name == "update" else "" if name == "delete" else core
            out.append("ok" if name in ("update", "delete") else "error")
            continue
        items = held[kind]
        at = [k for k, (i, _) in enumerate(items) if i == mid]
        if name == "insert":
            if content in [c for _, c in items]:
                out.append("skipped")
                continue
            if at:
                items[at[0]] = (mid, content)
            else:
                items.append((mid, content))
            out.append("ok")
        elif name == "update":
            if at:
                items[at[0]] = (mid, content)
            out.append("ok" if at else "error")
        else:
            for k in reversed(at):
                del items[k]
            out.append("ok")
    return core, held, out


def log_of(rng, n):
    return [(k // 5, k, rng.choice(["insert", "insert", "update", "delete"]), rng.choice(["semantic", "episodic_memory", "core"]), f"m{rng.randint(0, 6)}", f"c{rng.randint(0, 9)}") for k in range(n)]


def test_memory_fold_and_stream_agree_with_a_plain_one(spark):
    rng = random.Random(7)
    logs = {u: log_of(rng, 60) for u in range(6)}
    df = spark.createDataFrame([(u, *op) for u, ops in logs.items() for op in ops], "user_id long, chunk_idx long, op_idx long, name string, memory_type string, memory_id string, content string")
    key = ["user_id", "op_idx", "status"]
    batch = sorted(tuple(r[c] for c in key) for r in memory.apply_memory_ops(df.repartition(5), instance="user_id").collect())
    assert batch == sorted((u, op[1], s) for u, ops in logs.items() for op, s in zip(ops, slow_fold(ops)[2]))
    state = {}
    for r in memory.memory_state(df, instance="user_id").orderBy("pos").collect():
        state.setdefault((r.user_id, r.memory_type), []).append((r.memory_id, r.content))
    for u, ops in logs.items():
        core, held, _ = slow_fold(ops)
        assert state.get((u, "core"), [("", "")])[0][1] == core
        assert all(state.get((u, t), []) == held[t] for t in held)
    by_stream = streamed(spark, [df.where(f"chunk_idx div 3 = {k}").repartition("user_id") for k in range(4)], lambda s: memory_stream.stream_memory_state(s, instance="user_id"), "append", 1)
    assert sorted(tuple(r[c] for c in key) for r in by_stream.collect()) == batch


def test_late_chunks_are_rejected(spark):
    rows = [(1, 5, 0, "insert", "semantic", None, "a"), (1, 4, 1, "insert", "semantic", None, "b")]
    df = spark.createDataFrame(rows, "user_id long, chunk_idx long, op_idx long, name string, memory_type string, memory_id string, content string")
    out = streamed(spark, [df.where("chunk_idx = 5"), df.where("chunk_idx = 4")], lambda s: memory_stream.stream_memory_state(s, instance="user_id"), "append", 1)
    assert [(r.status, r.n_tokens) for r in out.orderBy("op_idx").collect()] == [("ok", 1), ("late", 1)]


def test_unknown_ids_and_types():
    m = memory.MemoryState(enabled=("semantic",))
    assert m.apply("insert", "episodic", None, "x", "1") == "error"
    assert m.apply("update", "semantic", "no", "x", "1") == "error"
    assert m.apply("update", "semantic", "no", "x", "1", strict=False) == "ok"
    assert m.apply("delete", "semantic", "no", None, "1") == "ok"
    assert m.apply("nonsense", "semantic", None, None, "1") == "error"


def test_scores_on_edge_inputs(spark):
    rows = [(None, ["a"]), ("", ["a"]), ("...", ["!"]), ("The Cat", ["a cat!"]), ("ÄÖ x", ["äö"]), ("yes", ["no"]), ("b b a", ["b a a"])]
    out = spark.createDataFrame(rows, "p string, g array<string>").select(A.exact_match(F.col("p"), F.col("g")).alias("em"), A.substring_match(F.col("p"), F.col("g")).alias("sub"), F.round(A.token_f1(F.col("p"), F.col("g")), 4).alias("f1")).collect()
    assert [r.em for r in out] == [None, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0]
    assert [r.sub for r in out] == [None, 1.0, 1.0, 1.0, 1.0, 0.0, 1.0]
    assert [r.f1 for r in out][3:] == [1.0, 0.6667, 0.0, 0.6667]


def test_bleu_and_rouge_goldens(spark):
    df = spark.createDataFrame([("the cat sat", "the cat sat"), ("a b c d", "a x c d"), ("", "a")], "p string, g string")
    bleu = scoring.bleu(df, pred="p", gold="g").collect()
    assert bleu[0].bleu_1 == 1.0 and bleu[0].bleu_3 == 1.0 and bleu[2].bleu_1 == 0.0
    assert bleu[1].bleu_3 == pytest.approx((0.75 * (1 / 3) * (0.1 / 2)) ** 0.33, abs=1e-6)
    assert bleu[1].bleu_1 == 0.75 and bleu[1].bleu_2 == pytest.approx((0.75 / 3) ** 0.5, abs=1e-6)
    rouge = scoring.rouge_l(df.select("p", F.array("g", F.lit("zz")).alias("g")), pred="p", golds="g").collect()
    assert [(r.rouge_l_f, r.rouge_l_recall) for r in rouge] == [(1.0, 1.0), (0.75, 0.75), (0.0, 0.0)]
    rng = random.Random(3)
    for _ in range(100):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in "ab")
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert scoring._lcs(a, b) == best[-1][-1]


def test_reduction_by_name_and_majority(spark):
    rows = [("cost", 2.0), ("cost", 7.0), ("cost", 3.0), ("max_len", 4.0), ("max_len", -9.0), ("len_min", 4.0), ("len_min", -9.0)]
    out = {r.key: r.value for r in metrics.reduce_by_name(spark.createDataFrame(rows, "key string, value double")).collect()}
    assert out == {"cost": 4.0, "max_len": 4.0, "len_min": -9.0}
    votes = spark.createDataFrame([(1, "x", 0.25, 3), (1, "y", 0.5, 1), (1, "y", 0.125, 2), (1, "x", 0.75, 0), (2, "z", 1.5, 0)], "g long, pred string, value double, o long")
    assert {r.g: (r.pred, r.value, r.votes) for r in metrics.majority(votes, group="g", pred="pred", value="value", order="o").collect()} == {1: ("x", 0.75, 2), 2: ("z", 1.5, 1)}


def test_bootstrapped_majority(spark):
    rng = np.random.default_rng(5)
    def plain(c, v):
        first = {}
        for x, y in zip(c, v):
            first.setdefault(x, y)
        return first[max(dict.fromkeys(c), key=list(c).count)]

    flat = rng.random(6)
    drawn = rng.integers(0, 6, (300, 5))
    answers = np.array([0, 1, 1, 2, 0, 2])
    assert metrics._majority_values(answers[drawn], flat[drawn]).tolist() == [plain(answers[d].tolist(), flat[d].tolist()) for d in drawn]
    # two thousand drawn answers a row: no square of them
    many = rng.integers(0, 1500, (20, 2000))
    assert metrics._majority_values(many, many * 1.0).tolist() == [plain(d.tolist(), (d * 1.0).tolist()) for d in many]
    rows = [("s", 1, "a" if k < 5 else "b", float(k < 5), k) for k in range(6)] + [("s", 2, "a", 1.0, 0)]
    out = {r.n: r for r in metrics.majority_at_n(spark.createDataFrame(rows, "source string, prompt long, pred string, value double, o long"), source="source", prompt="prompt", pred="pred", value="value", order="o").collect()}
    assert set(out) == {2, 4, 6} and out[2].mean == pytest.approx(5 / 6, abs=0.05) and out[6].mean > 0.95


def test_long_arrays_fold_as_short_ones(spark):
    rng = random.Random(6)
    rewards, mask, values = [rng.random() for _ in range(3000)], [int(rng.random() < 0.9) for _ in range(3000)], [rng.random() for _ in range(3000)]
    df = spark.createDataFrame([(rewards, mask, values), ([1.0], [1], [0.5]), ([], [], [])], "r array<double>, m array<int>, v array<double>")
    got = df.select(rollouts.reward_to_go(F.col("r"), F.col("m"), 0.99).alias("g"), rollouts.gae(F.col("r"), F.col("v"), 0.99, 0.95).alias("a"), rollouts.advantage_over_baseline(F.col("r"), F.col("m"), F.lit(2.0)).alias("b")).collect()
    to_go, adv, over, s, a, u = [], [], [], 0.0, 0.0, 0.0
    for t in reversed(range(3000)):
        s = (rewards[t] + 0.99 * s) * mask[t]
        a = rewards[t] + 0.99 * (values[t + 1] if t + 1 < 3000 else 0.0) - values[t] + 0.99 * 0.95 * a
        u += rewards[t] * mask[t]
        to_go.append(s), adv.append(a), over.append(u - 2.0 * mask[t])
    for name, want in (("g", to_go), ("a", adv), ("b", over)):
        assert got[0][name] == pytest.approx(want[::-1], abs=1e-8)
    assert got[1].g == [1.0] and got[1].a == [0.5] and got[1].b == [-1.0] and got[2].g == got[2].a == got[2].b == []


def test_overlap_of_repeated_words(spark):
    rng = random.Random(8)
    texts = [(" ".join(rng.choice("bcdefg") for _ in range(n)), " ".join(rng.choice("bcdefg") for _ in range(m))) for n, m in [(1, 1), (3, 9), (70, 90), (400, 150), (200, 200)]]
    for r in spark.createDataFrame(texts, "p string, g string").select("p", "g", A.token_f1(F.col("p"), F.array("g")).alias("f")).collect():
        p, g = r.p.split(), r.g.split()
        common = sum(min(p.count(w), g.count(w)) for w in set(p))
        assert r.f == pytest.approx(2 * common / (len(p) + len(g)))


def test_cache_keys_of_any_length(spark):
    rng = random.Random(4)
    keys = ["", "a", "xyz", "tell me", "about this", "x" * 150 + "end", "missing one"]
    asked = ["tell me about this", "tell me about this" + "." * 95, "q xyz", "x" * 200 + "end", "b", None, "".join(rng.choice("ab ") for _ in range(300)), "about this and then nothing that is known at all, whatever more is said of it here and there, on and on and on"]
    for used in (keys, keys[2:], keys[3:]):
        cache = spark.createDataFrame([(k, str(n), n) for n, k in enumerate(used)], "key string, value string, at long")
        got = {r.k: r.value for r in curation.lookup_cache(spark.createDataFrame(list(enumerate(asked)), "k long, q string"), cache, key="k", question="q", position="at").collect()}
        assert got == {i: next((str(n) for n, k in enumerate(used) if q is not None and (q.endswith(k) or k in q[-100:])), None) for i, q in enumerate(asked)}


def test_evidence_by_containment(spark):
    chunks = [("i", 1, "one two  three four five"), ("i", 2, "zone two  three fourth"), ("i", 3, "two three"), ("j", 4, "one two  three four"), (None, 5, "one two  three")]
    asked = [("i", 1, "one two  three four"), ("i", 2, "two three"), ("i", 3, "thr"), ("i", 4, "e two  three f"), ("j", 5, "three four five"), (None, 6, "one"), ("i", 7, "")]
    args = dict(instance="instance", question="q", context="c", text="t", chunk="chunk")
    qas, held = spark.createDataFrame(asked, "instance string, q long, c string"), spark.createDataFrame(chunks, "instance string, chunk long, t string")
    want = {q: [k for x, k, t in chunks if x == i and i is not None and c in t] for i, q, c in asked}
    assert {r.q: r.evidence_idx for r in instances.link_evidence_by_containment(qas, held, **args).collect()} == {q: max(k) for q, k in want.items() if k}
    assert sorted(r.q for r in instances.link_evidence_by_containment(qas, held, **args, strict=True).collect()) == sorted(q for q, k in want.items() for _ in k)


def test_nearest_names_of_repeated_rows(spark):
    items = spark.createDataFrame([(1, "Rome"), (1, "Rome"), (2, None), (3, "pari")], "k long, item string")
    names = spark.createDataFrame([("Paris",), ("rome",), (None,), ("Rome",)], "name string")
    out = sorted((r.k, r.nearest, r.distance) for r in retrieval.nearest_name(items, names, text="item", name="name").collect())
    assert out == [(1, "Rome", 0), (1, "Rome", 0), (2, None, None), (3, "Paris", 1)]


def test_bm25_fills_up_from_the_first_documents(spark):
    docs = [("c", k, "alpha" if k in (90, 95) else f"word{k}") for k in range(100)] + [("neg", k, "same same" if k else "same other") for k in range(40)] + [("e", 1, None), ("e", 2, "")]
    queries = [(1, "c", "alpha"), (2, "c", "nothing"), (3, "neg", "same"), (4, "c", "?"), (5, "e", "x")]
    out = {}
    for r in retrieval.bm25_topk(spark.createDataFrame(docs, "corpus string, doc long, text string").repartition(3), spark.createDataFrame(queries, "query_id long, corpus string, query string"), 4).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.doc)
    assert out[1] == [90, 95, 0, 1] and out[2] == [0, 1, 2, 3] and 4 not in out and out[5] == [1, 2] and len(out[3]) == 4


def test_cosine_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(retrieval, "ROWS", 16)
    items = [(f"c{k % 3}" if k % 10 else None, k, [0.0] * 5 if k == 7 else rng.normal(size=5).tolist()) for k in range(200)]
    queries = [(1000 + k, f"c{k % 3}", [0.0] * 5 if k == 4 else items[k + 1][2]) for k in range(12)]
    got = retrieval.cosine_topk(spark.createDataFrame(items, "corpus string, item long, vector array<double>").repartition(5), spark.createDataFrame(queries, "query_id long, corpus string, query_vector array<double>"), 6)
    want = []
    for q, c, u in queries:
        u, found = np.array(u), []
        for x, i, v in items:
            if x == c and u.any():
                v = np.array(v)
                found.append((-round(float(u @ v / (np.linalg.norm(u) * np.linalg.norm(v))), 6) + 0.0 if v.any() else 0.0, i))
        want += [(q, r + 1, i) for r, (_, i) in enumerate(sorted(found)[:6])]
    assert sorted((r.query_id, r["rank"], r.item) for r in got.collect()) == sorted(want)


def test_packing_of_many_items_is_quick():
    import time

    began = time.time()
    places = chunking.pack_places(np.full(400_000, 7), 50, 1)
    assert places[-1] == 400_000 // 6 and time.time() - began < 20


def test_an_empty_chunk_is_a_row(spark):
    df = spark.createDataFrame([(1, "one two three four. five."), (2, "one. two three four five six. seven.")], "k long, t string")
    out = sorted((r.k, r.chunk_idx, r.text, r.n_items) for r in chunking.chunk_sentences(df, 3, key="k", text="t", count_sep=False, guard=False).collect())
    assert out == [(1, 0, "", 0), (1, 1, "one two three four.", 1), (1, 2, "five.", 1), (2, 0, "one.", 1), (2, 1, "two three four five six.", 1), (2, 2, "seven.", 1)]


def test_trajectories_from_steps(spark):
    rows = [(1, 0, 5, 3, 10, 1), (1, 1, 2, 4, None, 1), (2, 0, None, None, None, 1), (3, 0, 4, None, 6, 0)]
    out = {r.k: r for r in metrics.trajectory_stats_from_steps(spark.createDataFrame(rows, "k long, step long, t long, r long, i long, m long"), key="k", step="step", think="t", act="r", info="i", matched="m").collect()}
    # step 0: 5 thought, 3 done, 10 told behind both; step 1 begins with all 18 and keeps its own 6
    work = (0 + 2) * 5 + (5 + 1) * 3 + (8 + 5) * 10 + (18 + 1) * 2 + (20 + 2) * 4
    assert (out[1].tokens, out[1].peak, out[1].compression) == (24, 24, 1.0) and out[1].dependency == work / 24 == out[1].dependency_full
    assert out[2].dependency is None and out[2].compression is None and out[3].tokens is None and out[3].compression == 0.0


def test_best_of_n_agrees_with_resampling(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([("s", 1, float(v)) for v in rng.normal(size=12)], "source string, prompt long, value double")
    exact = {r.n: r for r in metrics.best_worst_at_n(df, source="source", prompt="prompt", value="value").collect()}
    assert set(exact) == {2, 4, 8, 12}
    drawn = {r.statistic: r for r in metrics.bootstrap(df, group="prompt", value="value", statistics={"max": F.max, "min": F.min}, size=4, resamples=20_000).collect()}
    assert exact[4].best == pytest.approx(drawn["max"].mean, abs=0.03) and exact[4].worst_std == pytest.approx(drawn["min"].std, abs=0.03)


def test_differencing_balances(spark):
    rng = random.Random(4)
    for equal in (False, True):
        lengths = [rng.randint(1, 1000) for _ in range(64)]
        parts = rollouts._differencing(lengths, 4, equal)
        sums = [sum(n for n, p in zip(lengths, parts) if p == k) for k in range(4)]
        assert max(sums) - min(sums) < 40
        assert not equal or all(parts.count(k) == 16 for k in range(4))
    df = spark.createDataFrame([(1, k, rng.randint(1, 100)) for k in range(50)], "b long, k long, n long")
    assert rollouts.micro_batches(df, 400, batch="b", key="k", length="n").groupBy("part").agg(F.sum("n").alias("n")).where("n > 500").count() == 0


def test_group_advantages_sum_to_nothing(spark):
    df = spark.createDataFrame([(u, float(s)) for u in range(5) for s in range(u + 1)], "uid long, score double")
    for made in (rollouts.advantage_group_norm(df, uid="uid", score="score"), rollouts.advantage_leave_one_out(df, uid="uid", score="score")):
        for r in made.where("uid > 0").groupBy("uid").agg(F.sum("advantage").alias("a")).collect():
            assert r.a == pytest.approx(0.0, abs=1e-9)


def test_splits_are_disjoint_and_complete(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    out = curation.split_ratio(df, 0.9, key="k")
    assert out.groupBy("split").count().orderBy("split").collect()[1]["count"] == 900 and out.select("k").distinct().count() == 1000
    ranks = sorted(r["rank"] for r in ranking.global_rank(df, [F.col("k")]).collect())
    assert ranks == list(range(1000))


def test_title_budget(spark):
    rows = [(1, 0, ["a", "b"]), (1, 1, ["b", "c"]), (1, 2, ["d"]), (1, 3, ["a", "b", "c", "e"]), (1, 4, [])]
    out = instances.batch_by_title_budget(spark.createDataFrame(rows, "s long, o long, t array<string>"), 3, shard="s", order="o", titles="t")
    assert [r.batch for r in out.orderBy("o").collect()] == [0, 0, 1, 2, 3]


def test_retrieval_edges(spark):
    docs = spark.createDataFrame([("c", 1, "the cat"), ("c", 2, "a dog"), ("c", 3, "cat cat"), ("d", 4, "cat")], "corpus string, doc long, text string")
    asked = spark.createDataFrame([(1, "c", "CAT"), (2, "c", "?!"), (3, "c", "zebra"), (4, "none", "cat")], "query_id long, corpus string, query string")
    top = retrieval.bm25_topk(docs, asked, 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc) for r in top if r.query_id == 3] == [(3, 1), (3, 2)]
    assert {r.query_id for r in top} == {1, 3}
    first = retrieval.bm25_chunks(docs, asked, 2).where("query_id = 2").orderBy("rank").collect()
    assert [r.doc for r in first] == [1, 2]
    items = spark.createDataFrame([("c", 1, [1.0, 0.0]), ("c", 2, [0.0, 0.0])], "corpus string, item long, vector array<double>")
    vectors = spark.createDataFrame([(1, "c", [1.0, 1.0]), (2, "c", [0.0, 0.0])], "query_id long, corpus string, query_vector array<double>")
    assert [(r.query_id, r.item, r.score) for r in retrieval.cosine_topk(items, vectors, 5).orderBy("rank").collect()] == [(1, 1, 0.707107), (1, 2, 0.0)]


def test_text_edges(spark):
    df = spark.createDataFrame([(None,), ("",), (" \t",), ("Ä_b1 c-d",)], "t string")
    assert [r[0] for r in df.select(word_tokens(F.col("t"))).collect()] == [None, [], [], ["ä_b1", "c", "d"]]
    assert [r[0] for r in df.select(token_count(F.col("t"))).collect()] == [0, 0, 0, 2]
    with pytest.raises(Exception, match="too many tokens"):
        spark.createDataFrame([([1, 2, 3],)], "k array<int>").select(sft.truncate_tokens(F.col("k"), 2, "error")).collect()


def slow_differencing(lengths, k, equal):
    """Every partition with all its k groups as lists."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    step = k if equal else 1
    open_ = []
    for at in range(0, len(order), step):
        part = [(lengths[i], [i]) for i in order[at : at + step]]
        open_.append(sorted(part + [(0, [])] * (k - len(part)), key=lambda p: (-p[0], len(p[1]), p[1])))
    spread = lambda p: p[0][0] - p[-1][0]
    while len(open_) > 1:
        a, b = sorted(open_, key=lambda p: -spread(p))[:2]
        open_ = [p for p in open_ if p is not a and p is not b]
        open_.append(sorted([(x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b))], key=lambda p: (-p[0], len(p[1]), p[1])))
    return [next(g for g, (_, rows) in enumerate(open_[0]) if i in rows) for i in range(len(lengths))]


def test_differencing_is_the_same_without_empty_groups():
    rng = random.Random(8)
    for _ in range(300):
        n = rng.randint(1, 40)
        lengths, k = [rng.choice([0, 0, 1, 2, 7, rng.randint(0, 500)]) for _ in range(n)], rng.randint(1, n)
        for equal in (False, True):
            assert rollouts._differencing(lengths, k, equal) == slow_differencing(lengths, k, equal)


def test_differencing_takes_the_room_of_its_rows():
    import tracemalloc

    rng = random.Random(9)
    lengths = [rng.randint(0, 3000) for _ in range(8000)]
    tracemalloc.start()
    parts = rollouts._differencing(lengths, 800, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    totals = np.bincount(parts, weights=lengths, minlength=800)
    # 6.4 million pairs of a row and a group, written down, would take some 700 MB
    assert peak < 20_000_000 and totals.max() - totals.min() <= 3000 and sorted(set(parts)) == list(range(800))


def test_bm25_splits_each_text_once_for_the_vocabulary_and_once_for_the_words_asked_for(spark):
    docs = spark.createDataFrame([("a", 1, "one two two"), ("a", 2, "three"), ("b", 1, ""), (None, 1, "one"), ("a", 3, None)], "corpus string, doc long, body string")
    asked = spark.createDataFrame([(1, "a", "two four"), (2, "b", "one")], "query_id long, corpus string, query string")
    scores = retrieval.bm25_scores(docs, asked, text="body")
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(lower(body") == 1 and "array_distinct" not in plan
    assert [(r.query_id, r.corpus, r.doc) for r in scores.collect()] == [(1, "a", 1)]
