"""Benchmark decontamination: one Aho-Corasick automaton over normalised items, one scan of each text."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.llm._common import carried, row_slices

WINDOW = 10
#: Most bytes of item text in one automaton, some 150 times as large; further items go through the scan in further blocks.
BLOCK_BYTES = 2 << 20
#: Most bytes of item text in all: the items are a stated query set that is sent to every worker.
MOST_BYTES = 512 << 20
#: Text bytes that a task holds while it goes through all blocks, if there are several.
HELD_BYTES = 64 << 20

#: ASCII letters go to lower case, other ASCII characters but digits to space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
_OUT = ("n_words", "n_hit", "items", "spans")
_FOUND = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
]
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: What stands for a word that no item has.
_STRANGE = "\x01\x01"


def words_of(text: str | None) -> list[bytes]:
    """Normalised words: a-z, 0-9 and everything outside ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Machine:
    """The automaton of some items' windows, over words.

    Every word of the items is written as two characters, so that no state has more followers than there are of them,
    and a state stands for a word or half of one, not for a letter.
    """

    def __init__(self, items: list[tuple], width: int = WINDOW):
        self.written: dict[bytes, str] = {}
        windows: dict[str, tuple[int, list]] = {}
        for item, text in items:
            words = [self._code(w) for w in words_of(text)]
            for i in range(max(1, len(words) - width + 1) if words else 0):
                part = words[i : i + width]
                held = windows.setdefault("".join(part), (len(part), []))[1]
                if item is not None and (not held or held[-1] != item):
                    held.append(item)
        self.automaton = ahocorasick.Automaton()
        for key, value in windows.items():
            self.automaton.add_word(key, value)
        if windows:
            self.automaton.make_automaton()

    def _code(self, word: bytes) -> str:
        if (found := self.written.get(word)) is None:
            k = len(self.written)
            found = self.written[word] = chr(0x1000 + (k >> 8)) + chr(0x100 + (k & 255))
        return found

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit word ranges (end exclusive, apart from each other) and items found, in one pass."""
        ranges: list[tuple[int, int]] = []
        items: set = set()
        if not words or not len(self.automaton):
            return ranges, items
        get = self.written.get
        for end, (width, held) in self.automaton.iter("".join([get(w, _STRANGE) for w in words])):
            hi = (end + 1) // 2
            items.update(held)
            lo = hi - width
            while ranges and ranges[-1][1] >= lo:
                lo = min(lo, ranges.pop()[0])
            ranges.append((lo, hi))
        return ranges, items


#: The automaton that this worker made last, and for which call and block.
_HELD: dict[tuple[str, int, int], Machine] = {}


def _machine(call: str, k: int, items: list[tuple], width: int) -> Machine:
    if (key := (call, k, width)) not in _HELD:
        _HELD.clear()
        _HELD[key] = Machine(items, width)
    return _HELD[key]


def offsets(text: str, ranges: list[tuple[int, int]]) -> list[dict]:
    """Word ranges as places in the original text (code points, end exclusive)."""
    if not ranges:
        return []
    at = [m.span() for m in _WORD.finditer(text)]
    return [{"start": at[lo][0], "end": at[hi - 1][1]} for lo, hi in ranges]


def _blocks(items: DataFrame, block_bytes: int) -> list[list[tuple]]:
    held: list[list[tuple]] = [[]]
    size = total = 0
    for r in items.toLocalIterator():
        n = len(r["t"].encode("utf-8", "surrogatepass"))
        total += n
        if total > MOST_BYTES:
            raise ValueError(f"more than {MOST_BYTES} bytes of items: call for a part of them at a time")
        if held[-1] and size + n > block_bytes:
            held.append([])
            size = 0
        held[-1].append((r["i"], r["t"]))
        size += n
    return held


def _together(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold `limit` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held and sum(b.num_rows for b in held):
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def decontaminate(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WINDOW, block_bytes: int = BLOCK_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document row: n_words, n_hit, items (ids of items with an occurring window, sorted as strings), spans.

    A window is `width` consecutive words of an item; an item with fewer words, but not none, is one window.
    spans are the hit passages in the original text. The items are a stated query set, of MOST_BYTES of text at most
    (more is an error): they are read in blocks of at most `block_bytes` of text, which are sent to the workers as text,
    so what is sent never grows with the documents. A worker makes the automaton of one block at a time and keeps the
    last one from task to task; many items only mean more blocks, which a task goes through for HELD_BYTES of its
    documents at a time, and whose findings are put together for each document row.

    Null or empty texts have no words; null items and items without words have no window; the windows of an item
    without an id hit like others, but no id is listed for them; repeated documents or items give repeated rows or the
    same item; a text of any length is one row, scanned once per block; other columns are not looked at, and pass
    through if named in `carry` (one of the name of an output with `_in` at its end). No documents: an empty result.
    """
    through = carried([id_col, *carry], _OUT)
    rows = items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where(F.col("t").isNotNull())
    spark = docs.sparkSession
    blocks = [spark.sparkContext.broadcast(b) for b in _blocks(rows, block_bytes)]
    call = uuid.uuid4().hex

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        several = len(blocks) > 1
        for whole in _together(batches, "_text", HELD_BYTES) if several else batches:
            parts = list(row_slices(whole, "_text"))
            found = [[[0, [], set()] for _ in range(b.num_rows)] for b in parts]
            for k in range(len(blocks)):
                machine = _machine(call, k, blocks[k].value, width)
                for batch, out in zip(parts, found):
                    for row, text in zip(out, batch.column("_text").to_pylist()):
                        words = words_of(text)
                        ranges, ids = machine.scan(words)
                        row[0] = len(words)
                        row[1] = _merged(row[1] + ranges) if row[1] else ranges
                        row[2] |= ids
            for batch, out in zip(parts, found):
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c) for c in through],
                        pa.array([r[0] for r in out], pa.int64()),
                        pa.array([sum(hi - lo for lo, hi in r[1]) for r in out], pa.int64()),
                        pa.array([sorted(r[2], key=lambda x: x.encode()) for r in out], pa.list_(pa.string())),
                        pa.array([offsets(t, r[1]) for t, r in zip(batch.column("_text").to_pylist(), out)], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    ],
                    names=[name for _, name in through.values()] + list(_OUT),
                )

    source = docs.select(*[F.col(c).alias(k) for k, (c, _) in through.items()], F.col(text_col).alias("_text"))
    return source.mapInArrow(work, T.StructType([*[T.StructField(name, docs.schema[c].dataType) for c, name in through.values()], *_FOUND]))


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out
