"""Chat formatting with a grammar round trip.

Grammar of a formatted conversation: turns one after the other, each

    <turn ROLE>\\n TEXT \\n</turn>\\n

ROLE and TEXT are free of bare `<` and `>`; a backslash takes the next character literally. A text is first
written as it is; if parsing it back gives anything else, it is escaped step by step until the parse is identical.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MARK = re.compile(r"\\.|<|>", re.S)
_TAKEN = re.compile(r"\\(.)", re.S)
#: Ways to write a text, each escaping more than the one before.
_ESCAPES = (
    lambda t: t,
    lambda t: re.sub(r"[<>]", r"\\\g<0>", t),
    lambda t: re.sub(r"[<>\\]", r"\\\g<0>", t),
)


class GrammarError(ValueError):
    pass


def parse(line: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end are the places of the written text. Each input has one parse or none."""
    marks = [m for m in _MARK.finditer(line) if m[0] in "<>"]
    if len(marks) % 4:
        raise GrammarError("an open turn")
    out, at = [], 0
    for i in range(0, len(marks), 4):
        a, b, c, d = (m.start() for m in marks[i : i + 4])
        if [line[x] for x in (a, b, c, d)] != ["<", ">", "<", ">"] or a != at or line[a : a + 6] != "<turn " or line[b + 1 : b + 2] != "\n" or line[c - 1] != "\n" or c - 1 < b + 2 or line[c : d + 2] != "</turn>\n":
            raise GrammarError(f"not a turn at {a}")
        out.append((_TAKEN.sub(r"\1", line[a + 6 : b]), _TAKEN.sub(r"\1", line[b + 2 : c - 1]), b + 2, c - 1))
        at = d + 2
    if at != len(line):
        raise GrammarError("text after the last turn")
    return out


def render(role: str, text: str) -> tuple[str, int]:
    """A turn as written, and the step of escaping that it took for the parse to give role and text back."""
    for k, escape in enumerate(_ESCAPES):
        line = f"<turn {_ESCAPES[-1](role)}>\n{escape(text)}\n</turn>\n"
        try:
            if [x[:2] for x in parse(line)] == [(role, text)]:
                return line, k
        except GrammarError:
            pass
    raise GrammarError("a text that cannot be written")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple[str, str]]]]:
    """Conversations of rows that arrive sorted; one may go on in the next batch. Rows without an id are one each."""
    key, turns, begun = None, [], False
    for batch in batches:
        for conv, role, text in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist()):
            if begun and (conv is None or conv != key):
                yield key, turns
                turns = []
            key, begun = conv, True
            turns.append((role or "", text or ""))
    if begun:
        yield key, turns


def format_conversations(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: formatted, loss (start and end, in code points, of each written text under the loss mask), n_escaped.

    Rows are dealt by conversation and sorted by (turn, role, text) on disk-backed Spark sorts, then read in one pass; a
    conversation is one output string, so only its own length bounds it. A null role or text is empty; a row without an
    id is a conversation of its own, so that very many of them do not meet in one task; equal turn numbers go by role, then text, nulls first; repeated rows are repeated turns;
    other columns are left out; no rows give no rows. Every turn and every conversation is parsed back; a difference
    stops the job.
    """
    source = turns.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    kind = source.schema["conv_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for conv, own in _grouped(batches):
            parts = [render(role, text) for role, text in own]
            line = "".join(x for x, _ in parts)
            back = parse(line)
            if [x[:2] for x in back] != own:
                raise GrammarError(f"conversation {conv} does not read back")
            held.append((conv, line, [{"start": a, "end": b} for role, _, a, b in back if role == loss_role], sum(k > 0 for _, k in parts)))
            size += len(line)
            if size > 4 << 20:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)

    as_pa = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((as_pa, pa.string(), span, pa.int64()))], names=["conv_id", "formatted", "loss", "n_escaped"])

    own = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text"))
    out = source.repartition("conv_id", own).sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(work, f"conv_id {kind}, formatted string, loss array<struct<start:long,end:long>>, n_escaped long")
    return out.withColumnRenamed("conv_id", id_col)


def read_back(formatted: DataFrame, *, id_col: str = "conv_id") -> DataFrame:
    """What a formatted conversation says, by parsing it: turn count, digests of its turns and of the text under the loss mask."""
    kind = formatted.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for line, loss in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist()):
                turns, under = hashlib.sha256(), hashlib.sha256()
                n = chars = 0
                for role, text, _, _ in parse(line):
                    n += 1
                    turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for span in loss:
                    text = _TAKEN.sub(r"\1", line[span["start"] : span["end"]])
                    chars += len(text)
                    under.update(text.encode("utf-8", "surrogatepass"))
                rows.append((n, turns.hexdigest(), chars, under.hexdigest(), len(line)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]], names=[id_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select(id_col, "formatted", "loss").mapInArrow(work, f"`{id_col}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
