"""Memory folds of instances larger than a task, and what a stream over them reads and writes."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from memloom.operators import memory, ranking
from memloom.plans import io_queries
from memloom.plans.io_queries import streamed
from memloom.streaming import memory_stream
from tests.test_helpers import log_of, slow_fold

LOG = "user_id long, chunk_idx long, op_idx long, name string, memory_type string, memory_id string, content string"


def table_of(spark, logs):
    return spark.createDataFrame([(u, *op) for u, ops in logs.items() for op in ops], LOG)


@pytest.mark.parametrize("slice_ops", [1, 7, 40])
def test_hot_instances_fold_in_slices_as_a_plain_fold(spark, slice_ops):
    rng = random.Random(slice_ops)
    logs = {u: log_of(rng, 60 if u == 3 else 30 if u is None else 8)[:60] for u in (0, 1, 3, None)}
    df = table_of(spark, logs).repartition(5)
    got = memory.apply_memory_ops(df, instance="user_id", slice_ops=slice_ops if slice_ops > 1 else 12)
    assert sorted(((r.user_id, r.op_idx, r.status) for r in got.collect()), key=str) == sorted(((u, op[1], s) for u, ops in logs.items() for op, s in zip(ops, slow_fold(ops)[2])), key=str)
    state = {}
    for r in memory.memory_state(df, instance="user_id", slice_ops=slice_ops if slice_ops > 1 else 12).orderBy("pos").collect():
        state.setdefault((r.user_id, r.memory_type), []).append((r.memory_id, r.content, r.pos))
    for u, ops in logs.items():
        core, held, _ = slow_fold(ops)
        assert state.get((u, "core"), [("", "", 0)])[0][1] == core
        assert all(state.get((u, t), []) == [(i, c, k) for k, (i, c) in enumerate(held[t])] for t in held)


def test_no_task_holds_more_than_a_slice(spark, monkeypatch):
    rng = random.Random(5)
    hot = [(k // 5, k, *op[2:]) for k, op in enumerate(log_of(rng, 90))]
    df = table_of(spark, {1: hot, **{u: log_of(rng, 6) for u in range(10, 40)}})
    folded = memory._Folded(df, "user_id", 20, True, {})
    assert folded.small.groupBy("i", "k").count().agg(F.max("count")).first()[0] <= 20
    rounds, _ = folded.slices()
    assert len(rounds) > 1 and all(r.groupBy("i", "k").count().agg(F.max("count")).first()[0] <= 20 for r in rounds)


def test_core_is_cut_to_its_limit(spark):
    ops = [(0, 0, "update", "core", None, "a b c d e f"), (0, 1, "insert", "core", None, "no"), (1, 2, "update", "core_memory", None, "a b c")]
    df = table_of(spark, {1: ops[:2], 2: ops})
    state = {r.user_id: r.content for r in memory.memory_state(df, instance="user_id", core_limit=4).collect()}
    assert state == {1: "a b c [cut]", 2: "a b c"}
    sliced = {r.user_id: r.content for r in memory.memory_state(df, instance="user_id", core_limit=4, slice_ops=1).collect()}
    assert sliced == state
    assert memory.memory_state(df, instance="user_id", core_limit=None).where("user_id = 1").first().content == "a b c d e f"


class Store:
    """A state store's map that counts its calls."""

    def __init__(self):
        self.values, self.calls = {}, 0

    def getValue(self, key):
        self.calls += 1
        return self.values.get(key)

    def containsKey(self, key):
        self.calls += 1
        return key in self.values

    def updateValue(self, key, value):
        self.calls += 1
        self.values[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self.values[key]


def test_operations_touch_their_own_keys_only():
    items, held = Store(), Store()
    for k in range(100_000):
        items.values["semantic", f"m{k}"] = (f"c{k}", k)
        held.values[memory_stream._by_digest(("semantic", f"c{k}"))] = (1,)
    a, b = memory_stream.Touched(items), memory_stream.Touched(held, memory_stream._by_digest, single=True)
    state = memory.MemoryState(items=a, held=b, next_place=100_000, words={"core": 0, "semantic": 100_000, "episodic": 0})
    ops = [("insert", "semantic", None, "c5"), ("insert", "semantic", None, "new"), ("update", "semantic", "m7", "c8"), ("delete", "semantic", "m9", None), ("delete", "semantic", "none", None)]
    assert [state.apply(*op, f"x{k}") for k, op in enumerate(ops)] == ["skipped", "ok", "ok", "ok", "ok"]
    a.flush()
    b.flush()
    assert items.calls + held.calls < 30 and state.size() == 100_000
    assert items.values["semantic", "m7"] == ("c8", 7) and ("semantic", "m9") not in items.values and items.values["semantic", "x1"] == ("new", 100_000)
    assert held.values[memory_stream._by_digest(("semantic", "c8"))] == (2,)


def test_stream_forgets_idle_instances(spark, tmp_path):
    first = table_of(spark, {1: [(0, 0, "insert", "semantic", "a", "x")]})
    again = table_of(spark, {1: [(0, 1, "insert", "semantic", "b", "x")]})

    def after(idle_ms, wait):
        first.write.mode("overwrite").parquet(f"{tmp_path}/{idle_ms}/in")
        source = spark.readStream.schema(first.schema).parquet(f"{tmp_path}/{idle_ms}/in")
        made = memory_stream.stream_memory_state(source, instance="user_id", idle_ms=idle_ms)
        found = []
        q = made.writeStream.foreachBatch(lambda batch, n: found.extend(r.status for r in batch.orderBy("op_idx").collect())).option("checkpointLocation", f"{tmp_path}/{idle_ms}/at").start()

        def wait_for(n):
            for _ in range(80):
                if len(found) >= n:
                    break
                time.sleep(0.5)

        try:
            wait_for(1)
            time.sleep(wait)  # batches without data go on, and end what was idle
            again.write.mode("append").parquet(f"{tmp_path}/{idle_ms}/in")
            wait_for(2)
        finally:
            q.stop()
        return found

    assert after(3_600_000, 1) == ["ok", "skipped"]
    assert after(200, 6) == ["ok", "ok"]


def test_ranks_by_range(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 1, 1, 1, 2]), k, rng.random() ** 8) for k in range(500)]
    df = spark.createDataFrame(rows, "g long, k long, v double").repartition(7)
    got = [r.k for r in sorted(ranking.global_rank(df, [F.col("v"), F.col("k")]).collect(), key=lambda r: r["rank"])]
    assert got == [k for _, k, _ in sorted(rows, key=lambda r: r[2])]
    within = {}
    for r in ranking.rank_within(df, ["g"], [F.desc("v"), F.col("k")]).collect():
        within.setdefault(r.g, []).append((r["rank"], r.k))
    for g in (None, 1, 2):
        assert [k for _, k in sorted(within[g])] == [k for h, k, _ in sorted(rows, key=lambda r: -r[2]) if h == g]
        assert [p for p, _ in sorted(within[g])] == list(range(len(within[g])))
    assert ranking.global_rank(df.limit(0), [F.col("v")]).count() == 0


class Calls:
    """Map state that counts its calls."""

    def __init__(self, held=()):
        self.held, self.calls = dict(held), []

    def __getattr__(self, name):
        def call(key, *value):
            self.calls.append(name)
            if name == "updateValue":
                self.held[key] = value[0]
            elif name == "removeKey":
                del self.held[key]
            else:
                return self.held.get(key) if name == "getValue" else key in self.held

        return call


def test_a_new_instance_reads_nothing_from_its_state():
    from memloom.streaming.memory_stream import Touched

    state = Calls()
    items = Touched(state, empty=True)
    items["a",] = ("x", 1)
    items["b",] = ("y", 2)
    assert items.pop(("b",), None) == ("y", 2) and items.get(("c",)) is None and items.pop(("d",), None) is None
    items.flush()
    assert state.held == {("a",): ("x", 1)} and state.calls == ["updateValue"]


def test_keys_that_end_as_they_were_are_not_written():
    from memloom.streaming.memory_stream import Touched

    state = Calls({("a",): ("x", 1), ("b",): ("y", 2), ("c",): ("z", 3), ("e",): ("v", 5)})
    items = Touched(state)
    items["a",] = items["a",]
    del items["b",]
    items["c",] = ("other", 3)
    items["new",] = ("w", 4)
    assert items.get(("d",)) is None
    items["d",] = ("q", 6)
    del items["d",]
    items["e",] = ("unread", 7)
    items.flush()
    assert state.held == {("a",): ("x", 1), ("c",): ("other", 3), ("new",): ("w", 4), ("e",): ("unread", 7)}
    assert state.calls.count("removeKey") == 1 and state.calls.count("updateValue") == 3 and "containsKey" not in state.calls


class Handle:
    """What a processor asks of a session, over plain maps."""

    def __init__(self):
        self.states, self.timers = {}, []

    def getMapState(self, name, *schemas):
        return self.states.setdefault(name, Store())

    def registerTimer(self, at):
        self.timers.append(at)


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now

    getExpiryTimeInMs = getCurrentProcessingTimeInMs


def processor(idle_ms=None):
    p, handle = memory_stream.MemoryProcessor({}, True, idle_ms), Handle()
    p.init(handle)
    return p, handle


def micro_batch(p, logs, now=0):
    rows = pd.DataFrame([(u, *op) for u, ops in logs.items() for op in ops], columns=["i", *memory.LOG]).sample(frac=1, random_state=now)
    out = pd.concat(p.handleInputRows((0,), iter([rows[::2], rows[1::2]]), Clock(now)))
    return {u: g.sort_values("op_idx") for u, g in out.groupby("i", dropna=False)}


def test_small_memories_are_read_once_and_written_once_in_a_micro_batch():
    rng = random.Random(3)
    logs = {f"u{u}": log_of(rng, 60) for u in range(20)}
    p, handle = processor()
    found = {u: [] for u in logs}
    for k in range(4):
        for u, g in micro_batch(p, {u: ops[15 * k : 15 * k + 15] for u, ops in logs.items()}).items():
            found[u] += list(g["status"])
    assert found == {u: slow_fold(ops)[2] for u, ops in logs.items()}
    assert sum(s.calls for s in handle.states.values()) == 2 * 4 * len(logs)


def test_large_memories_are_read_by_the_pages_that_operations_name(monkeypatch):
    monkeypatch.setattr(memory_stream, "PACKED", 2000)
    monkeypatch.setattr(memory_stream, "PAGE", 500)
    rng = random.Random(4)
    kinds, names = ["semantic", "episodic_memory"], ["insert"] * 6 + ["update", "delete"]
    ops = [(k, k, rng.choice(names), rng.choice(kinds), f"m{rng.randint(0, 900)}", f"c{rng.randint(0, 1500)} \u4e2d") for k in range(3000)]
    p, handle = processor(idle_ms=50)
    other = [(0, 0, "insert", "semantic", "a", "x")]
    found, sizes, most = [], [], 0
    for k in range(0, 3000, 10):
        before = handle.states["pages"].calls
        now = micro_batch(p, {"large": ops[k : k + 10], **({"other": other} if k == 0 else {})}, k)["large"]
        found, sizes = found + list(now["status"]), sizes + list(now["n_tokens"])
        most = max(most, handle.states["pages"].calls - before if k > 300 else 0)
    core, held, statuses = slow_fold(ops)
    assert found == statuses and sizes[-1] == sum(len(c.split()) for t in held.values() for _, c in t)
    pages = handle.states["pages"].values
    assert sum(what == "items" for _, what, _ in pages) > 40 and max(len(text[0]) for text in pages.values()) < 4000
    assert most < 120 and handle.states["memories"].values["large",][6] == "[]"
    memories = handle.states["memories"].values
    for at in sorted(set(handle.timers)):
        list(p.handleExpiredTimer((0,), Clock(at), Clock(at)))
        assert (("large",) in memories) == (at < handle.timers[-1]) and ("other",) not in memories
    assert not memories and not handle.states["ending"].values and not pages


def test_a_task_has_few_pages_open(monkeypatch):
    monkeypatch.setattr(memory_stream, "PACKED", 2000)
    monkeypatch.setattr(memory_stream, "PAGE", 500)
    monkeypatch.setattr(memory_stream, "OPEN", 12)
    rng, seen, bound = random.Random(8), [], memory_stream.Kept.bound
    monkeypatch.setattr(memory_stream.Kept, "bound", lambda kept: (seen.append(len(kept.memory.items.read) + len(kept.memory.held.read)) if kept.n else None, bound(kept)))
    ops = [(k, k, rng.choice(["insert"] * 6 + ["update", "delete"]), "semantic", f"m{rng.randint(0, 500)}", f"c{rng.randint(0, 900)}") for k in range(2400)]
    p, handle = processor()
    found = [s for k in range(0, 2400, 800) for s in micro_batch(p, {"large": ops[k : k + 800]})["large"]["status"]]
    assert found == slow_fold(ops)[2] and len(handle.states["pages"].values) > 40
    assert len(seen) == 1600 and max(seen) <= 12 + 6


def test_one_page_more_takes_from_one_page_only():
    for n in range(1, 70):
        moved = {(memory_stream._page(d, n), memory_stream._page(d, n + 1)) for d in range(1000)}
        assert {b for a, b in moved if a != b} == {n} and len({a for a, b in moved if a != b}) == 1


def test_stream_of_null_and_large_instances(spark):
    rng = random.Random(6)
    big = [(k // 50, k, rng.choice(["insert", "insert", "insert", "update", "delete"]), "semantic", f"m{rng.randint(0, 700)}", f"c{rng.randint(0, 600)} " + "w" * 100) for k in range(1500)]
    ids = (None, 2**60 + 1, 2**60 + 2, -1)
    logs = {u: big if u == -1 else log_of(rng, 60) for u in ids}
    df = table_of(spark, logs)
    assert memory_stream.PACKED < sum(len(c) for _, c in slow_fold(big)[1]["semantic"])
    parts = [df.where(f"chunk_idx between {a} and {b}").coalesce(1) for a, b in ((0, 4), (5, 9), (10, 19), (20, 99))]
    got = streamed(spark, parts, lambda s: memory_stream.stream_memory_state(s, instance="user_id", buckets=2), "append", 1)
    assert got.schema["user_id"].dataType == df.schema["user_id"].dataType
    assert sorted(((r.user_id, r.op_idx, r.status) for r in got.collect()), key=str) == sorted(((u, op[1], s) for u, ops in logs.items() for op, s in zip(ops, slow_fold(ops)[2])), key=str)


def test_micro_batches_do_not_grow_with_partitions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(io_queries, "shared", lambda _: str(tmp_path))
    confs = {"spark.sql.shuffle.partitions": "9", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        d = "/root/testdata/sf0.001"
        rows = io_queries.k1_stream_memory_state(spark, d)
        assert rows.count() == spark.read.parquet(f"{d}/events.parquet").count()
        assert len(list((tmp_path / "in").glob("*.parquet"))) == 4 and len(list((tmp_path / "at" / "commits").glob("[0-9]*"))) == 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
