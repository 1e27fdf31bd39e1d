"""Two streams: memory state carried along each instance's operations, and running scores by source."""

from __future__ import annotations

import hashlib
import json
import zlib
from collections import Counter
from collections.abc import Callable, Iterator, MutableMapping
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from memloom.operators.memory import CORE_LIMIT, CORE_MARKER, LOG, TYPES, MemoryState, item_id
from memloom.operators.scoring import score_results

#: What state of this kind is kept in.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_OUT = "chunk_idx long, op_idx long, name string, memory_type string, memory_id string, content string, status string, n_tokens long"
_GONE = object()
#: Types that stay the same as text and back; null stays null.
_AS_TEXT = (T.StringType, T.IntegralType, T.DecimalType, T.DateType, T.BooleanType)
#: Characters of a memory up to which it stands in its instance's row, and about those of a page of a larger one.
PACKED, PAGE = 32_768, 8_192
#: Pages that a task has open at once.
OPEN = 2048
#: Groups that instances are dealt to; state is kept by group, so a stream keeps their number.
BUCKETS = 1024


class Touched(MutableMapping):
    """A map in the state store of which only the keys that are asked for are read, once, and only those that changed are written back. One that is known to be empty is not read at all."""

    def __init__(self, state, to_key: Callable[[tuple], tuple] = lambda k: k, single: bool = False, empty: bool = False):
        self.state, self.to_key, self.single, self.empty = state, to_key, single, empty
        self.seen: dict[tuple, object] = {}
        self.stored: dict[tuple, object] = {}
        self.changed: set[tuple] = set()

    def __getitem__(self, key: tuple):
        if key not in self.seen:
            found = None if self.empty else self.state.getValue(self.to_key(key))
            self.seen[key] = self.stored[key] = _GONE if found is None else found[0] if self.single else tuple(found)
        if self.seen[key] is _GONE:
            raise KeyError(key)
        return self.seen[key]

    def __setitem__(self, key: tuple, value: object) -> None:
        self.seen[key] = value
        self.changed.add(key)

    def __delitem__(self, key: tuple) -> None:
        self[key]
        self.seen[key] = _GONE
        self.changed.add(key)

    def __iter__(self) -> Iterator[tuple]:
        return (k for k, v in self.seen.items() if v is not _GONE)

    def __len__(self) -> int:
        return sum(1 for _ in self)

    def flush(self) -> None:
        for key in self.changed:
            value = self.seen[key]
            # a key that was written without being asked for is not known to be there
            stored = self.stored.get(key, _GONE if self.empty else None)
            if value == stored:
                continue
            if value is not _GONE:
                self.state.updateValue(self.to_key(key), (value,) if self.single else value)
            elif stored is not None or self.state.containsKey(self.to_key(key)):
                self.state.removeKey(self.to_key(key))


def _by_digest(key: tuple[str, str]) -> tuple[str, str]:
    return key[0], hashlib.sha256(key[1].encode("utf-8", "surrogatepass")).hexdigest()


def _page(digest: int, n: int) -> int:
    """Which of n pages a digest is on. Page n, the one more of n + 1 pages, takes what it holds from one other page only."""
    size = 1 << (n - 1).bit_length()
    at = digest % size
    return at if at < n else at - size // 2


class Paged(MutableMapping):
    """A map in pages of text, of which only those of the keys that are asked for are read; flush() hands back those that changed."""

    def __init__(self, texts: MutableMapping, at: tuple, n: int, to_key: Callable[[tuple], tuple] = lambda k: k):
        self.texts, self.at, self.n, self.to_key = texts, at, n, to_key
        self.read: dict[int, dict[tuple, object]] = {}
        self.changed: set[int] = set()

    def _number(self, key: tuple) -> int:
        return _page(zlib.crc32("\0".join(key).encode("utf-8", "surrogatepass")), self.n)

    def _entries(self, page: int) -> dict[tuple, object]:
        if page not in self.read:
            self.read[page] = {tuple(k): v for k, v in json.loads(self.texts.get((*self.at, page), "[]"))}
        return self.read[page]

    def __getitem__(self, key: tuple):
        key = self.to_key(key)
        return self._entries(self._number(key))[key]

    def __setitem__(self, key: tuple, value: object) -> None:
        key = self.to_key(key)
        page = self._number(key)
        self._entries(page)[key] = value
        self.changed.add(page)

    def __delitem__(self, key: tuple) -> None:
        key = self.to_key(key)
        page = self._number(key)
        del self._entries(page)[key]
        self.changed.add(page)

    def __iter__(self) -> Iterator[tuple]:
        return (k for page in range(self.n) for k in self._entries(page))

    def __len__(self) -> int:
        return sum(len(self._entries(page)) for page in range(self.n))

    def grow(self, n: int) -> None:
        """As n pages from now on."""
        while self.n < n:
            new = self.n
            self.n += 1
            old = new - (1 << new.bit_length()) // 2
            entries = self._entries(old)
            self.read[old], self.read[new] = {}, {}
            for key, value in entries.items():
                self.read[self._number(key)][key] = value
            self.changed |= {old, new}

    def flush(self) -> int:
        """By how many characters the pages have grown."""
        grown = 0
        for page in self.changed:
            at, entries = (*self.at, page), self.read[page]
            before = len(self.texts.get(at, ""))
            if entries:
                self.texts[at] = json.dumps(list(entries.items()))
            else:
                self.texts.pop(at, None)
            grown += len(self.texts.get(at, "")) - before
        self.changed.clear()
        return grown


class Kept:
    """The memory of one instance, out of the state store and back: one row if it is small, else a row and pages."""

    def __init__(self, rows, pages, instance: str | None, options: dict):
        self.rows, self.pages, self.instance = rows, pages, instance
        core, self.last, place, words, self.n, self.chars, text, _ = rows.getValue((instance,)) or ("", -1, 0, [0] * len(TYPES), 0, 0, "[]", None)
        if self.n:
            items, held = self._paged(False)
        else:
            items = {tuple(k): v for k, v in json.loads(text)}
            held = Counter((k, content) for (k, _), (content, _) in items.items())
        self.memory = MemoryState(items=items, held=held, core=core, words=dict(zip(TYPES, map(int, words))), next_place=place, **options)

    def _paged(self, empty: bool) -> tuple[Paged, Paged]:
        self.texts = Touched(self.pages, single=True, empty=empty)
        return Paged(self.texts, (self.instance, "items"), self.n), Paged(self.texts, (self.instance, "held"), self.n, _by_digest)

    def _write(self) -> None:
        """Pages that changed, and as many more as the memory has grown by."""
        items, held = self.memory.items, self.memory.held
        self.chars += items.flush()
        self.n = max(self.n, -(-self.chars // PAGE))
        items.grow(self.n)
        held.grow(self.n)
        self.chars += items.flush()
        held.flush()
        self.texts.flush()

    def bound(self) -> None:
        """Puts pages away when too many are open."""
        m = self.memory
        if self.n and len(m.items.read) + len(m.held.read) > OPEN:
            self._write()
            m.items, m.held = self._paged(False)

    def flush(self, until: int | None) -> None:
        m, text = self.memory, "[]"
        if not self.n:
            text = json.dumps(list(m.items.items()))
            if len(text) > PACKED:
                self.n = -(-len(text) // PAGE)
                items, held = self._paged(True)
                items.update(m.items)
                held.update(m.held)
                m.items, m.held, text = items, held, "[]"
        if self.n:
            self._write()
        self.rows.updateValue((self.instance,), (m.core, self.last, m.next_place, [m.words[t] for t in TYPES], self.n, self.chars, text, until))


class MemoryProcessor(StatefulProcessor):
    """The folds of a bucket's instances. What an instance holds is read and written at once while it is small, else by the pages that its operations name."""

    def __init__(self, options: dict, strict: bool, idle_ms: int | None):
        self.options, self.strict, self.idle_ms = options, strict, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memories = handle.getMapState("memories", "i string", "core string, last_chunk long, next_place long, words array<long>, pages int, chars long, items string, until long")
        self.pages = handle.getMapState("pages", "i string, what string, page int", "entries string")
        self.ending = handle.getMapState("ending", "at long", "instances array<string>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        until = None if self.idle_ms is None else timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
        log = pd.concat(list(rows)).sort_values(["i", "chunk_idx", "op_idx"], ignore_index=True)
        statuses, sizes, instances = [], [], []
        for instance, ops in groupby(log[["i", *LOG]].itertuples(index=False, name=None), itemgetter(0)):
            kept = Kept(self.memories, self.pages, instance, self.options)
            memory = kept.memory
            for _, chunk, op, name, kind, memory_id, content in ops:
                if chunk < kept.last:
                    statuses.append("late")
                else:
                    statuses.append(memory.apply(name, kind, memory_id, content, item_id(chunk, op, name, memory_id), self.strict))
                    kept.last = int(chunk)
                sizes.append(memory.size())
                kept.bound()
            kept.flush(until)
            instances.append(instance)
        if until is not None:
            before = self.ending.getValue((until,)) or ([],)
            self.ending.updateValue((until,), ([*before[0], *instances],))
            self.handle.registerTimer(until)
        yield log.assign(status=statuses, n_tokens=sizes)[["i", *LOG, "status", "n_tokens"]]

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        for instance in (self.ending.getValue((at,)) or ([],))[0]:
            row = self.memories.getValue((instance,))
            if row is not None and row[-1] == at:  # no operation came since
                for what in ("items", "held"):
                    for page in range(row[4]):
                        self.pages.removeKey((instance, what, page))
                self.memories.removeKey((instance,))
        self.ending.removeKey((at,))
        return iter(())

    def close(self) -> None:
        pass


def stream_memory_state(ops: DataFrame, *, instance: str, enabled: tuple[str, ...] = TYPES, strict: bool = True, core_limit: int | None = CORE_LIMIT, marker: str = CORE_MARKER, idle_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Every operation with its status and the instance's size after it; the fold is apply_memory_ops's.

    Inside a micro-batch operations go by (chunk_idx, op_idx); one of a chunk before the last seen gets the status
    `late` and changes nothing. Instances are dealt to buckets, whose operations in a micro-batch are folded in one go. A
    micro-batch reads and writes the small memories of the instances that it names, and of larger ones the pages of
    what its operations name, whatever else they hold. With `idle_ms`, an instance without operations for so long is
    forgotten: what comes after starts anew. The session's state store must be the one in STATE_STORE when the stream
    starts; `buckets` is the same for as long as its checkpoint is used.
    """
    kind = ops.select(instance).schema[0].dataType
    if not isinstance(kind, _AS_TEXT):
        raise ValueError(f"an instance is named by text, an integer, a decimal, a date or a boolean, not by {kind.simpleString()}")
    i = F.col(instance).cast("string")
    rows = ops.select(F.pmod(F.xxhash64(i), F.lit(buckets)).alias("bucket"), i.alias("i"), F.col("chunk_idx").cast("long").alias("chunk_idx"), F.col("op_idx").cast("long").alias("op_idx"), "name", "memory_type", "memory_id", "content")
    processor = MemoryProcessor({"enabled": enabled, "core_limit": core_limit, "marker": marker}, strict, idle_ms)
    out = rows.groupBy("bucket").transformWithStateInPandas(processor, f"i string, {_OUT}", "Append", "None" if idle_ms is None else "ProcessingTime")
    return out.withColumn("i", F.col("i").cast(kind)).withColumnRenamed("i", instance)


def stream_scores(results: DataFrame, *, time: str, keys: tuple[str, ...] = ("question", "data_source"), late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Running mean score and count per source and tumbling window; a (question, source) that came before, within the lateness, does not count again."""
    once = results.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))
    scored = score_results(once)
    return scored.groupBy(F.window(time, window).alias("w"), "data_source").agg(F.avg("score").alias("score"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), "data_source", "score", "n")
