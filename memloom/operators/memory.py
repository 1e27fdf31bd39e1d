"""Memory operations: tool calls to logs, logs to state, state to text and sizes."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator, MutableMapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.text import split_words, token_count
from memloom.operators.grouped import by_group
from memloom.operators.ranking import rank_within
from memloom.sources.tables import Tables

TYPES = ("core", "semantic", "episodic")
#: Words of core memory, and what stands behind one that was cut.
CORE_LIMIT, CORE_MARKER = 512, "[cut]"
#: Operations of an instance and type that a task folds at once.
SLICE_OPS = 100_000
#: Columns of an operation log, in order of use.
LOG = ("chunk_idx", "op_idx", "name", "memory_type", "memory_id", "content")


def extract_tool_calls(df: DataFrame, *, key: str, text: str, result_mark: str = "<tool_result>") -> DataFrame:
    """(key, op_idx, name, arguments) from blocks `<tool_call>{"name": .., "arguments": {..}}</tool_call>` of a model's text, in order; what follows the result mark does not count. Arguments that are no JSON are null."""
    head = F.substring_index(F.col(text), result_mark, 1)
    blocks = F.regexp_extract_all(head, F.lit(r"(?s)<tool_call>\s*(\{.*?\})\s*(?:`{3}\s*)?</tool_call>"), F.lit(1))
    rows = df.select(key, F.posexplode(blocks).alias("op_idx", "block"))
    call = F.from_json("block", "name string, arguments struct<memory_type:string,memory_id:string,content:string,new_content:string>")
    return rows.withColumn("c", call).select(key, "op_idx", "c.name", "c.arguments")


class MemoryState:
    """One instance's memory. The batch job and the stream run the same fold.

    `items` maps (type, id) to (content, place), `held` (type, content) to how many items have it. Any mutable mapping
    will do: an operation reads and writes only its own keys.
    """

    def __init__(self, *, items: MutableMapping | None = None, held: MutableMapping | None = None, core: str = "", words: dict[str, int] | None = None, next_place: int = 0, enabled: Iterable[str] = TYPES, core_limit: int | None = CORE_LIMIT, marker: str = CORE_MARKER):
        self.items = {} if items is None else items
        self.held = {} if held is None else held
        self.core, self.next_place = core, next_place
        self.words = words or dict.fromkeys(TYPES, 0)
        self.enabled = set(enabled)
        self.core_limit, self.marker = core_limit, marker

    def _count(self, kind: str, content: str, n: int) -> None:
        now = self.held.get((kind, content), 0) + n
        if now > 0:
            self.held[kind, content] = now
        else:
            self.held.pop((kind, content), None)
        self.words[kind] += n * len(content.split())

    def _put(self, kind: str, memory_id: str, content: str | None) -> None:
        """The item as it is from now on; None: gone. One that is there keeps its place."""
        old = self.items.get((kind, memory_id))
        if old is not None:
            self._count(kind, old[0], -1)
        if content is None:
            self.items.pop((kind, memory_id), None)
            return
        if old is None:
            self.next_place += 1
        self.items[kind, memory_id] = (content, self.next_place - 1 if old is None else old[1])
        self._count(kind, content, 1)

    def _cut(self, content: str) -> str:
        """Over the limit, the first words that fit before the marker, and the marker."""
        words = content.split()
        if self.core_limit is None or len(words) <= self.core_limit:
            return content
        return " ".join([*words[: max(0, self.core_limit - len(self.marker.split()))], self.marker])

    def apply(self, name: str, kind: str | None, memory_id: str | None, content: str | None, new_id: str, strict: bool = True) -> str:
        """ok, skipped or error. An insert of content that its type holds is skipped; an update of an unknown id is an error (ok if not strict); deleting an unknown id is ok; core is cut to its limit."""
        kind = (kind or "").removesuffix("_memory")
        if kind not in self.enabled:
            return "error"
        content = content if isinstance(content, str) else ""
        if kind == "core":
            if name not in ("update", "delete"):
                return "error"
            self.core = self._cut(content) if name == "update" else ""
            self.words["core"] = len(self.core.split())
            return "ok"
        if name == "insert":
            if self.held.get((kind, content), 0):
                return "skipped"
            self._put(kind, new_id, content)
            return "ok"
        memory_id = memory_id if isinstance(memory_id, str) else ""
        if name == "update":
            if self.items.get((kind, memory_id)) is None:
                return "error" if strict else "ok"
            self._put(kind, memory_id, content)
            return "ok"
        if name == "delete":
            self._put(kind, memory_id, None)
            return "ok"
        return "error"

    def size(self) -> int:
        return sum(self.words[t] for t in TYPES if t in self.enabled)

    def fold(self, log: pd.DataFrame, strict: bool = True) -> list[str]:
        """Status of each operation of a log in order."""
        return [self.apply(name, kind, memory_id, content, item_id(chunk, op, name, memory_id), strict) for chunk, op, name, kind, memory_id, content in log[list(LOG)].itertuples(index=False)]

    def rows(self) -> Iterator[tuple[str, str, str, int]]:
        if self.core:
            yield "core", "", self.core, 0
        for t in TYPES[1:]:
            mine = sorted(((place, i, c) for (k, i), (c, place) in self.items.items() if k == t))
            for at, (_, i, c) in enumerate(mine):
                yield t, i, c, at


def new_id(chunk_idx: int, op_idx: int) -> str:
    """The id of an inserted item: where in the log it was inserted."""
    return f"{chunk_idx:x}-{op_idx:x}"


def item_id(chunk: int, op: int, name: str, memory_id: str | None) -> str:
    """The id that an insert makes: its own, or one from its place."""
    return memory_id if isinstance(memory_id, str) and memory_id and name == "insert" else new_id(int(chunk), int(op))


def _log(ops: DataFrame, instance: str) -> tuple[DataFrame, str]:
    """The log with `i` and `k`: types share nothing, so each type of an instance is folded by itself."""
    rows = ops.select(F.col(instance).alias("i"), F.col("chunk_idx").cast("long").alias("chunk_idx"), F.col("op_idx").cast("long").alias("op_idx"), "name", "memory_type", "memory_id", "content")
    return rows.withColumn("k", F.coalesce(F.regexp_replace("memory_type", "_memory$", ""), F.lit(""))), rows.schema["i"].dataType.simpleString()


_LOG_DDL = "chunk_idx long, op_idx long, name string, memory_type string, memory_id string, content string"


class _Folded:
    """Statuses and what is held at the end, of groups (instance, type) of any size."""

    def __init__(self, ops: DataFrame, instance: str, slice_ops: int, strict: bool, options: dict):
        self.tables = Tables(ops.sparkSession)
        self.rows, self.kind = _log(ops, instance)
        self.slice_ops, self.strict, self.options = slice_ops, strict, options
        large = self.rows.groupBy("i", "k").agg(F.count("*").alias("_n")).where(F.col("_n") > slice_ops)
        # at most one group for each slice_ops rows
        self.large = self.tables.keep(large)
        self.hot = bool(self.large.take(1))
        match = self.rows.i.eqNullSafe(F.col("_i")) & (F.col("k") == F.col("_k"))
        names = F.broadcast(self.large.select(F.col("i").alias("_i"), F.col("k").alias("_k")))
        self.small = self.rows.join(names, match, "left_anti") if self.hot else self.rows
        self.big = self.rows.join(names, match, "left_semi") if self.hot else None

    def small_groups(self, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
        return by_group(self.small, "g", ["chunk_idx", "op_idx"], work, schema, df_group=F.struct("i", "k"))

    def slices(self) -> tuple[list[DataFrame], DataFrame]:
        """Large groups in rounds: each round folds one slice of every group against the items that it touches, and hands the items on. Statuses by round, and the items left."""
        keep, n = self.tables.keep, self.slice_ops
        log = keep(rank_within(self.big, ["i", "k"], [F.col("chunk_idx"), F.col("op_idx")]).withColumn("round", F.floor(F.col("rank") / n)))
        held = keep(log.select("i", "k", F.lit("").alias("memory_id"), F.lit("").alias("content"), F.lit(0).cast("long").alias("place")).limit(0))
        done = []
        for r in range(log.agg(F.max("round").alias("r")).first().r + 1):
            now = log.where(F.col("round") == r)
            out = keep(self._round(now, held, r * n))
            done.append(out.where("what = 'log'"))
            item = out.where("what = 'item'")
            kept = held.join(item.select("i", "k", "memory_id"), _same(held, item, "memory_id"), "left_anti")
            left = keep(kept.unionByName(item.where("content is not null").select("i", "k", "memory_id", "content", "place")))
            self.tables.drop(held)
            held = left
        return done, held

    def _round(self, now: DataFrame, held: DataFrame, first: int) -> DataFrame:
        """One slice of each group with the items whose id it names, and how many others hold a content that it names."""
        ids = now.select("i", "k", F.explode(F.array("memory_id", _made_id(), F.lit(""))).alias("memory_id")).distinct()
        texts = now.select("i", "k", F.coalesce("content", F.lit("")).alias("content")).distinct()
        items = held.join(ids, _same(held, ids, "memory_id"), "left_semi").select("i", "k", F.lit("item").alias("what"), "memory_id", "content", "place")
        counts = held.join(texts, _same(held, texts, "content"), "left_semi").groupBy("i", "k", "content").agg(F.count("*").alias("place"))
        before = items.unionByName(counts.select("i", "k", F.lit("held").alias("what"), F.lit("").alias("memory_id"), "content", "place"))
        strict, options = self.strict, self.options

        def fold(log: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
            rows = log if len(log) else before
            key = (rows["i"].iloc[0], rows["k"].iloc[0])
            known = before[before["what"] == "item"]
            items = {(key[1], i): (c, int(p)) for i, c, p in known[["memory_id", "content", "place"]].itertuples(index=False)}
            held = {(key[1], c): int(n) for c, n in before.loc[before["what"] == "held", ["content", "place"]].itertuples(index=False)}
            # contents of touched items count whether the slice names them or not
            for (_, c), n in Counter((key[1], c) for c, _ in items.values()).items():
                held.setdefault((key[1], c), n)
            core = items.get(("core", ""), ("", 0))[0]  # which is kept as an item without an id
            state = MemoryState(items=dict(items), held=held, core=core, next_place=first, **options)
            log = log.sort_values("rank")
            statuses = state.fold(log, strict)
            out = log[[*LOG]].assign(status=statuses, place=0, what="log")
            if key[1] == "core":
                touched = {("core", ""): (state.core, 0) if state.core else None}
            else:
                touched = {at: state.items.get(at) for at in set(items) | set(state.items)}
                touched = {at: now for at, now in touched.items() if now != items.get(at)}
            changed = pd.DataFrame([(None, None, None, None, i, None if x is None else x[0], None, 0 if x is None else x[1], "item") for (_, i), x in touched.items()], columns=[*LOG, "status", "place", "what"])
            parts = [p for p in (out, changed) if len(p)]
            return pd.concat(parts, ignore_index=True).assign(i=key[0], k=key[1])

        schema = f"i {self.kind}, k string, {_LOG_DDL}, status string, place long, what string"
        columns = [c.split(" ")[0] for c in schema.split(", ")]

        def ordered(log: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
            return fold(log, before)[columns].astype({"chunk_idx": "Int64", "op_idx": "Int64"})

        return now.groupBy("i", "k").cogroup(before.groupBy("i", "k")).applyInPandas(ordered, schema)


def _made_id() -> Column:
    """item_id() of an insert, as a column."""
    own = F.when((F.col("name") == "insert") & (F.coalesce("memory_id", F.lit("")) != ""), F.col("memory_id"))
    return F.coalesce(own, F.concat_ws("-", F.lower(F.hex("chunk_idx")), F.lower(F.hex("op_idx"))))


def _same(a: DataFrame, b: DataFrame, column: str) -> Column:
    return a.i.eqNullSafe(b.i) & (a.k == b.k) & (a[column] == b[column])


def apply_memory_ops(ops: DataFrame, *, instance: str, enabled: tuple[str, ...] = TYPES, strict: bool = True, core_limit: int | None = CORE_LIMIT, marker: str = CORE_MARKER, slice_ops: int = SLICE_OPS) -> DataFrame:
    """The log with a `status` for each operation, by folding each instance's operations in (chunk_idx, op_idx) order. An insert may carry its own id, else it gets one from its place; core is cut to `core_limit` words.

    Types of an instance share nothing and are folded apart. A type with more than `slice_ops` operations is folded in
    slices, one a round, against a table of its items that each round hands on: a task holds one slice and the items
    that it names, never the log.
    """
    options = {"enabled": enabled, "core_limit": core_limit, "marker": marker}
    f = _Folded(ops, instance, slice_ops, strict, options)

    def one(log: pd.DataFrame) -> pd.DataFrame:
        return log.assign(status=MemoryState(**options).fold(log, strict)).drop(columns=["g", "k"])

    out = f.small_groups(one, f"i {f.kind}, {_LOG_DDL}, status string")
    if f.hot:
        for part in f.slices()[0]:
            out = out.unionByName(part.select(out.columns))
    return out.withColumnRenamed("i", instance)


def memory_state(ops: DataFrame, *, instance: str, enabled: tuple[str, ...] = TYPES, strict: bool = True, core_limit: int | None = CORE_LIMIT, marker: str = CORE_MARKER, slice_ops: int = SLICE_OPS) -> DataFrame:
    """(instance, memory_type, memory_id, content, pos): what is held after the last operation; large groups as in apply_memory_ops."""
    options = {"enabled": enabled, "core_limit": core_limit, "marker": marker}
    f = _Folded(ops, instance, slice_ops, strict, options)

    def one(log: pd.DataFrame) -> pd.DataFrame:
        state = MemoryState(**options)
        state.fold(log, strict)
        return pd.DataFrame([(log["i"].iloc[0], *r) for r in state.rows()], columns=["i", "memory_type", "memory_id", "content", "pos"])

    out = f.small_groups(one, f"i {f.kind}, memory_type string, memory_id string, content string, pos long")
    if f.hot:
        left = rank_within(f.slices()[1], ["i", "k"], [F.col("place")], name="pos")
        out = out.unionByName(left.select("i", F.col("k").alias("memory_type"), "memory_id", "content", "pos"))
    return out.withColumnRenamed("i", instance)


def final_state_by_id(ops: DataFrame, *, keys: list[str], order: list[str], name: str, content: str) -> DataFrame:
    """Where ids are given and contents are not compared: the last operation of each id, without deleted ones, with the place of its first insert."""
    last = F.max_by(F.struct(name, content), F.struct(*order))
    first = F.min(F.when(F.col(name) == "insert", F.struct(*order)))
    return ops.groupBy(*keys).agg(last.alias("l"), first.alias("first")).where(F.col(f"l.{name}") != "delete").select(*keys, F.col(f"l.{content}").alias(content), "first")


def dedup_inserts(ops: DataFrame, *, keys: list[str], content: str, order: list[str]) -> DataFrame:
    """Of an insert-only log, the first insert of each content."""
    return ops.groupBy(*keys, F.sha2(content, 256).alias("_h")).agg(F.min_by(F.struct(*order, content), F.struct(*order)).alias("r")).select(*keys, "r.*")


def truncate_core(text: Column, limit: int = CORE_LIMIT, marker: str = CORE_MARKER) -> Column:
    """Over `limit` words, the first ones that fit before the marker, and the marker."""
    words = split_words(text)
    return F.when(F.size(words) > limit, F.concat_ws(" ", F.slice(words, 1, limit - len(marker.split())), F.lit(marker))).otherwise(text)


def memory_size(state: DataFrame, *, instance: str, enabled: tuple[str, ...] = TYPES, content: str = "content") -> DataFrame:
    rows = state.where(F.col("memory_type").isin(*enabled))
    return rows.groupBy(instance).agg(F.sum(token_count(F.col(content))).alias("n_tokens"))


def recent_items(state: DataFrame, n: int = 20, *, instance: str) -> DataFrame:
    """The last n items of each type in order, with how many are shown and held; n = 0: none."""
    w = Window.partitionBy(instance, "memory_type")
    rows = state.withColumns({"_r": F.row_number().over(w.orderBy(F.desc("pos"))), "total": F.count("*").over(w)})
    return rows.where(F.col("_r") <= n).drop("_r").withColumn("shown", F.least(F.col("total"), F.lit(n)))


def render_memory(instances: DataFrame, state: DataFrame, *, instance: str, numbered: bool = False) -> DataFrame:
    """(instance, core, semantic, episodic) as text: `[id] content` lines (or numbered `1. content`), `Empty.` without items; core only if it is not blank."""
    head = F.concat((F.col("pos") + 1).cast("string"), F.lit(". ")) if numbered else F.concat(F.lit("["), "memory_id", F.lit("] "))
    line = F.when(F.col("memory_type") == "core", F.col("content")).otherwise(F.concat(head, "content"))
    text = lambda t: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("memory_type") == t, F.struct("pos", line.alias("line"))))), lambda x: x["line"]), "\n")
    blocks = state.where((F.col("memory_type") != "core") | (F.trim("content") != "")).groupBy(instance).agg(*[text(t).alias(t) for t in TYPES])
    out = instances.select(instance).join(blocks, instance, "left")
    filled = [F.when(F.coalesce(F.col(t), F.lit("")) == "", F.lit("Empty.")).otherwise(F.col(t)).alias(t) for t in TYPES[1:]]
    return out.select(instance, F.when(F.col("core") != "", F.col("core")).alias("core"), *filled)


def validate_calls(df: DataFrame, *, name: str = "name", arguments: str = "arguments", kind: str = "memory_type", content: str = "content") -> DataFrame:
    """Adds `error_code` (null: fine) by the first case that holds."""
    n, k = F.col(name), F.col(kind)
    code = (
        F.when(n.isNull() | F.col(arguments).isNull(), "missing")
        .when(~n.isin("insert", "update"), "name")
        .when(k.isNull(), "no_type")
        .when(~k.isin(*TYPES), "type")
        .when(F.trim(F.coalesce(F.col(content), F.lit(""))) == "", "blank")
    )
    return df.withColumn("error_code", code)


def parse_verdict(text: Column) -> Column:
    """struct<valid, issues, explanation, score> of a fenced JSON verdict; score 1 if VALID is true, 0 if it is false or any field has the wrong type."""
    body = F.regexp_extract(text, r"(?s)`{3}(?:json)?\s*(\{.*?\})\s*`{3}", 1)
    v = F.try_parse_json(body)
    valid = F.try_variant_get(v, "$.VALID", "boolean")
    kind = lambda p: F.schema_of_variant(F.try_variant_get(v, p, "variant"))
    fine = (kind("$.VALID") == "BOOLEAN") & kind("$.ISSUES").startswith("ARRAY") & (kind("$.EXPLANATION") == "STRING")
    ok = F.coalesce(fine, F.lit(False))
    return F.struct(F.when(ok, valid).alias("valid"), F.when(ok, F.try_variant_get(v, "$.ISSUES", "array<string>")).alias("issues"), F.when(ok, F.try_variant_get(v, "$.EXPLANATION", "string")).alias("explanation"), (ok & F.coalesce(valid, F.lit(False))).cast("double").alias("score"))


def group_mean_scores(groups: DataFrame, items: DataFrame, *, key: str, score: str) -> DataFrame:
    """Mean score per group; 0 for a group without items; a score that is no number counts 0."""
    means = items.groupBy(key).agg(F.avg(F.coalesce(F.col(score).try_cast("double"), F.lit(0.0))).alias("score"))
    return groups.select(key).join(means, key, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def call_success_rate(chunks: DataFrame, calls: DataFrame, *, keys: list[str], status: str = "status") -> DataFrame:
    """Share of a chunk's calls that went through (not skipped); 0 without calls."""
    rate = calls.groupBy(*keys).agg(F.avg((F.col(status) == "ok").cast("double")).alias("rate"))
    return chunks.select(*keys).join(rate, keys, "left").withColumn("rate", F.coalesce("rate", F.lit(0.0)))


def attach_calls(chunks: DataFrame, calls: DataFrame, *, keys: list[str], order: str, fields: list[str]) -> DataFrame:
    """Chunks with their calls nested in order; an empty list where there are none."""
    lists = calls.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, F.struct(*fields).alias("v")))), lambda x: x["v"]).alias("calls"))
    return chunks.join(lists, keys, "left").withColumn("calls", F.coalesce("calls", F.array().cast(lists.schema["calls"].dataType)))
