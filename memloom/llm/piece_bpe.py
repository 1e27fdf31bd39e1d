"""SentencePiece encoding and decoding by vectorised merge rounds.

The words of a slice of texts stand one after the other in flat numpy arrays of symbols. A round finds the best pair of
each word (a segmented minimum over pair ranks), merges its leftmost occurrences in all words at once, and closes the
gaps; a word leaves when no pair of it is a piece. Text is cut where no piece of the vocabulary spans two neighbouring
characters, which no merge can cross, and equal words of a slice are merged once.
"""

from __future__ import annotations

import codecs
import contextlib
import heapq
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.llm._common import carried, row_slices, runs

#: How pieces write a space.
SPACE = "▁"
#: Symbols of a word from which on its merges come from a heap: in a long word nearly every round merges one pair only.
LONG = 512
#: Characters of different strings whose ids a worker keeps (some 20 times as many bytes).
KEPT_CHARS = 2 << 20
#: Characters that are worked on at once, and bytes of texts that go through a task together.
BLOCK, SLICE = 1 << 19, 1 << 20
#: Rank of two symbols that are no piece together.
NONE = np.iinfo(np.int64).max
#: What the library gives for the id of unknown characters.
_UNKNOWN = " ⁇ "
_PROBES = ["", " ", "  a  b ", "A Ⅳ ﬁ é é 　x", "<s>a</s><unk><0x41>", "tab\tline\r\n\n end", "x" + SPACE * 3 + "y", "a" * 9 + "=" * 30, "      ", "\x00﻿\U0001f9eaก"]
_STATE: dict[str, Pieces] = {}

codecs.register_error("memloom-each-byte", lambda e: ("�", e.start + 1))


class Encoded(NamedTuple):
    """Ids of a column of texts, and where those of each row start."""

    ids: np.ndarray
    offsets: np.ndarray


class Kept:
    """Ids of the strings that a worker has met, so that each is encoded once; it starts anew beyond KEPT_CHARS."""

    def __init__(self, encode: Callable[[list[str]], Encoded]):
        self.encode = encode
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.starts, self.counts = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.used = self.chars = 0

    def look_up(self, strings: list[str]) -> Encoded:
        if self.chars > KEPT_CHARS:
            self._clear()
        get = self.place.get
        new = list(dict.fromkeys(s for s in strings if get(s) is None))
        if new:
            found = self.encode(new)
            n, used = len(self.place), self.used
            self.ids, self.starts, self.counts = _room(self.ids, used + len(found.ids)), _room(self.starts, n + len(new)), _room(self.counts, n + len(new))
            self.ids[used : used + len(found.ids)] = found.ids
            self.starts[n : n + len(new)] = found.offsets[:-1] + used
            self.counts[n : n + len(new)] = np.diff(found.offsets)
            self.used += len(found.ids)
            self.chars += sum(map(len, new))
            self.place.update(zip(new, range(n, n + len(new))))
        at = np.fromiter(map(get, strings), np.int64, len(strings))
        n = self.counts[at]
        return Encoded(self.ids[np.repeat(self.starts[at], n) + runs(n)], np.concatenate([[0], np.cumsum(n)]))


def _room(x: np.ndarray, n: int) -> np.ndarray:
    """x with places for n values at least."""
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])


def by_part(texts: pa.Array, starts_at: Callable[[np.ndarray], np.ndarray], kept: Kept) -> Encoded:
    """Ids of each text, put together from those of its parts: a part starts with a text and where `starts_at` says so of the code points around it. About BLOCK characters are worked on at once."""
    found, sizes, block, n = [], [], [], 0
    rows: list[int] = []

    def work() -> None:
        one = _block(block, starts_at, kept)
        found.append(one.ids)
        sizes.extend(np.diff(one.offsets).tolist())
        block.clear()

    for k, text in enumerate(texts.to_pylist()):
        for piece in _stretches(text, starts_at):
            block.append(piece)
            rows.append(k)
            n += len(piece)
            if n >= BLOCK:
                work()
                n = 0
    if block:
        work()
    total = np.bincount(np.array(rows, np.int64), np.array(sizes, np.float64), len(texts)).astype(np.int64)
    return Encoded(np.concatenate([np.zeros(0, np.int32), *found]), np.concatenate([[0], np.cumsum(total)]))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _stretches(text: str, starts_at: Callable[[np.ndarray], np.ndarray]) -> Iterator[str]:
    """The text, in stretches of about BLOCK characters that end where a part does."""
    at, size = 0, BLOCK
    while len(text) - at > size:
        cuts = np.flatnonzero(starts_at(_codes(text[at : at + size])))
        if not len(cuts) or not cuts[-1]:
            size *= 2
            continue
        yield text[at : at + int(cuts[-1])]
        at, size = at + int(cuts[-1]), BLOCK
    yield text[at:] if at else text


def _block(texts: list[str], starts_at: Callable[[np.ndarray], np.ndarray], kept: Kept) -> Encoded:
    raw = [t.encode() for t in texts]
    row_at = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    raw = b"".join(raw)
    byte_at = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    cut = starts_at(_codes("".join(texts)))
    cut[np.searchsorted(byte_at, row_at[:-1][np.diff(row_at) > 0])] = True
    starts = byte_at[cut]
    ends = np.append(starts, len(raw)).astype(np.int64)
    parts = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(raw)).dictionary_encode()
    one, code = kept.look_up(parts.dictionary.to_pylist()), parts.indices.to_numpy()
    n = np.diff(one.offsets)[code]
    ids = one.ids[np.repeat(one.offsets[:-1][code], n) + runs(n)]
    return Encoded(ids, np.concatenate([[0], np.cumsum(n)])[np.searchsorted(starts, row_at)])


class Pieces:
    """A SentencePiece model of kind BPE: byte fallback, no normalisation, a space before each text."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_file=path)
        n = library.get_piece_size()
        self.pieces = [library.id_to_piece(i) for i in range(n)]
        self.begin, self.end, self.unknown = library.bos_id(), library.eos_id(), library.unk_id()
        special = {i for i in range(n) if library.is_control(i) or library.is_unknown(i) or library.is_byte(i)}
        if any(library.is_unused(i) for i in range(n)) or sum(library.is_byte(i) for i in range(n)) != 256:
            raise ValueError(f"{path}: only models with byte fallback and without unused pieces")
        self.byte_ids = np.array([library.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.is_byte = np.zeros(n, bool)
        self.is_byte[self.byte_ids] = True
        self.is_control = np.array([library.is_control(i) for i in range(n)])
        known = {p: i for i, p in enumerate(self.pieces) if i not in special}
        # a symbol is a piece's id; characters that stand in pieces, but are none, have numbers beyond
        alphabet = sorted({c for p in known for c in p})
        symbol = {c: known.get(c, n + k) for k, c in enumerate(alphabet)}
        self.n_symbols = n + len(alphabet) + 1
        self.symbol_of = np.full(0x110000, self.n_symbols - 1, np.int32)
        self.symbol_of[[ord(c) for c in alphabet]] = [symbol[c] for c in alphabet]
        self.class_of = np.zeros(0x110000, np.int32)
        self.class_of[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.meet = np.zeros((len(alphabet) + 1, len(alphabet) + 1), bool)
        for p in known:
            at = self.class_of[[ord(c) for c in p]]
            self.meet[at[:-1], at[1:]] = True
        # all pairs of symbols that are a piece together; equal scores have equal ranks
        score = {i: library.get_score(i) for i in known.values()}
        rank = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        full = known | symbol
        pairs = [(full[p[:k]] * self.n_symbols + full[p[k:]], i, rank[score[i]]) for p, i in known.items() for k in range(1, len(p)) if p[:k] in full and p[k:] in full]
        pairs.sort()
        self.pair_keys, self.pair_ids, self.pair_ranks = (np.array(x, np.int64) for x in zip(*pairs))
        self.surface = np.empty(n, object)
        self.surface[:] = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for i in special:
            self.surface[i] = b""
        self.surface[self.unknown] = _UNKNOWN.encode()
        self.surface[self.byte_ids] = [bytes([b]) for b in range(256)]
        self.spaced = np.array([p.startswith(SPACE) and i not in special for i, p in enumerate(self.pieces)])
        self.kept = Kept(self._words)
        got = self.encode(pa.array(_PROBES))
        if [got.ids[lo:hi].tolist() for lo, hi in zip(got.offsets, got.offsets[1:])] != library.encode(_PROBES):
            raise ValueError(f"{path}: not a BPE model without normalisation and with a space before each text")

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of the piece of each two symbols (NONE where they are none)."""
        keys = left.astype(np.int64) * self.n_symbols + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        found = self.pair_keys[at] == keys
        return np.where(found, self.pair_ranks[at], NONE), self.pair_ids[at]

    def encode(self, texts: pa.Array) -> Encoded:
        """Ids of each text (none null), without begin and end."""
        texts = pc.replace_substring(texts, " ", SPACE)
        texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(SPACE, texts, ""))
        return by_part(texts, self._starts_at, self.kept)

    def _starts_at(self, chars: np.ndarray) -> np.ndarray:
        """Where no piece spans the character before and this one."""
        kind = self.class_of[chars]
        cut = np.ones(len(chars), bool)
        cut[1:] = ~self.meet[kind[:-1], kind[1:]]
        return cut

    def _words(self, listed: list[str]) -> Encoded:
        """Ids of each of the words, which have a character at least."""
        chars = np.frombuffer("".join(listed).encode("utf-32-le"), np.uint32)
        lengths = np.array([len(w) for w in listed], np.int64)
        starts = np.cumsum(lengths) - lengths
        symbols = self.symbol_of[chars].astype(np.int64)
        word, symbols, first = self._merge_rounds(symbols, np.repeat(np.arange(len(listed)), lengths))
        for k in np.flatnonzero(lengths > LONG).tolist():  # as _merge_rounds left them: unmerged
            lo, hi = np.searchsorted(word, [k, k + 1])
            merged, at = self._merge_long(symbols[lo:hi].tolist())
            word = np.concatenate([word[:lo], np.full(len(merged), k), word[hi:]])
            first = np.concatenate([first[:lo], first[lo:hi][at], first[hi:]])
            symbols = np.concatenate([symbols[:lo], merged, symbols[hi:]])
        # characters that are no piece become their bytes
        bare = np.flatnonzero(symbols >= len(self.pieces))
        n = np.ones(len(symbols), np.int64)
        spelled = [chr(c).encode() for c in chars[first[bare]].tolist()]
        n[bare] = [len(b) for b in spelled]
        ids = np.repeat(symbols, n).astype(np.int32)
        at = np.cumsum(n) - n
        ids[np.repeat(at[bare], n[bare]) + runs(n[bare])] = self.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
        return Encoded(ids, np.concatenate([[0], np.cumsum(np.bincount(word, n, len(listed)).astype(np.int64))]))

    def _merge_rounds(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word, symbol and place of its first character of all that is left when no pair of any word is a piece; words of more than LONG symbols stay as they are."""
        first = np.arange(len(symbols))
        done = []
        busy = np.bincount(word)[word] <= LONG if len(word) else np.zeros(0, bool)
        done.append((word[~busy], symbols[~busy], first[~busy]))
        word, symbols, first = word[busy], symbols[busy], first[busy]
        rank, piece = np.full(len(symbols), NONE), np.zeros(len(symbols), np.int64)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner], piece[inner] = self.look_up(symbols[inner], symbols[inner + 1])
        while len(word):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, starts)
            best = np.repeat(least, np.diff(np.append(starts, len(word))))
            idle = best == NONE
            if idle.any():
                done.append((word[idle], symbols[idle], first[idle]))
                word, symbols, first, rank, piece, best = (x[~idle] for x in (word, symbols, first, rank, piece, best))
                if not len(word):
                    break
            # leftmost occurrences that do not overlap: every other one of a run of neighbours
            at = np.flatnonzero(rank == best)
            run = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (word[at[1:]] != word[at[:-1]])]))
            place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
            at = at[place % 2 == 0]
            at = at[self._in_turn(at, word, symbols, best, piece)]
            # merge, close the gaps, and rank the pairs beside what is new
            symbols[at] = piece[at]
            keep = np.ones(len(word), bool)
            keep[at + 1] = False
            new = at - np.arange(len(at))
            word, symbols, first, rank, piece = (x[keep] for x in (word, symbols, first, rank, piece))
            rank[new] = NONE
            near = np.concatenate([new, new[new > 0] - 1])
            near = near[near + 1 < len(word)]
            near = near[word[near] == word[near + 1]]
            rank[near], piece[near] = self.look_up(symbols[near], symbols[near + 1])
        word, symbols, first = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(first, kind="stable")
        return word[order], symbols[order], first[order]

    def _in_turn(self, at: np.ndarray, word: np.ndarray, symbols: np.ndarray, best: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Which merges at `at` may happen in one round: up to the first of each word that makes a pair as good as itself, which then has its turn before the rest."""
        new, own, n = piece[at], word[at], len(word)
        before, after = at - 1, np.minimum(at + 2, n - 1)
        merged_before = np.concatenate([[False], at[1:] == at[:-1] + 2])  # the symbol before is new, too
        left = np.where(merged_before, np.concatenate([[0], new[:-1]]), symbols[before])
        has_left, has_right = (at > 0) & (word[before] == own), (at + 2 < n) & (word[after] == own)
        rank_left, rank_right = np.full(len(at), NONE), np.full(len(at), NONE)
        rank_left[has_left] = self.look_up(left[has_left], new[has_left])[0]
        rank_right[has_right] = self.look_up(new[has_right], symbols[after[has_right]])[0]
        stops = np.minimum(rank_left, rank_right) <= best[at]
        passed = np.cumsum(stops) - stops
        start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        return passed == np.repeat(passed[start], np.diff(np.append(start, len(at))))

    def _merge_long(self, symbols: list[int]) -> tuple[list[int], list[int]]:
        """The same merges of one long word, each taken from a heap by rank and place; and the places of what is left."""
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int, int]] = []
        if n > 1:
            ranks, ids = self.look_up(np.array(symbols[:-1]), np.array(symbols[1:]))
            heap = [(int(ranks[k]), k, symbols[k], symbols[k + 1], int(ids[k])) for k in np.flatnonzero(ranks != NONE).tolist()]
        heapq.heapify(heap)
        pairs = self._pair_table()
        while heap:
            _, k, left, right, new = heapq.heappop(heap)
            j = after[k]
            if symbols[k] != left or j >= n or symbols[j] != right:
                continue
            symbols[k], symbols[j], after[k] = new, -1, after[j]
            if after[j] < n:
                before[after[j]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b < n and (found := pairs.get(symbols[a] * self.n_symbols + symbols[b])):
                    heapq.heappush(heap, (found[1], a, symbols[a], symbols[b], found[0]))
        left = [k for k in range(n) if symbols[k] >= 0]
        return [symbols[k] for k in left], left

    def _pair_table(self) -> dict[int, tuple[int, int]]:
        if not hasattr(self, "_pairs"):
            self._pairs = dict(zip(self.pair_keys.tolist(), zip(self.pair_ids.tolist(), self.pair_ranks.tolist())))
        return self._pairs

    def decode(self, encoded: Encoded) -> list[str]:
        """Text of each row of ids: control ids are silent, the space before the text goes, bytes that are no UTF-8 become U+FFFD one by one."""
        parts = self.surface[encoded.ids].tolist()
        spaced, control = self.spaced[encoded.ids], self.is_control[encoded.ids]
        loud = np.append(np.flatnonzero(~control), len(control))
        lead = loud[np.searchsorted(loud, encoded.offsets[:-1])].tolist()
        silent = np.concatenate([[0], np.cumsum(control)]).tolist()
        out = []
        for lo, hi, k in zip(encoded.offsets[:-1].tolist(), encoded.offsets[1:].tolist(), lead):
            row = parts[lo:hi]
            if k < hi and spaced[k]:
                row[k - lo] = row[k - lo][1:]
            text = None
            if hi - lo < 3 or silent[hi - 1] == silent[lo + 1]:  # bytes on both sides of a control id are no character together
                with contextlib.suppress(UnicodeDecodeError):
                    text = b"".join(row).decode()
            out.append(self._mended(row, self.is_byte[encoded.ids[lo:hi]]) if text is None else text)
        return out

    @staticmethod
    def _mended(row: list[bytes], is_byte: np.ndarray) -> str:
        cuts = np.flatnonzero(np.diff(is_byte.astype(np.int8))) + 1
        return "".join(b"".join(row[lo:hi]).decode(errors="memloom-each-byte") for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(row)]))


def pieces(model: str) -> Pieces:
    """The worker's tables of one model: a public one by its name, or a file by its path."""
    if model not in _STATE:
        import public_tokenizers

        _STATE[model] = Pieces(model if "/" in model else public_tokenizers.path(model))
    return _STATE[model]


def _surrounded(found: Encoded, begin: int | None, end: int | None) -> Encoded:
    """The same with an id before and one after each row."""
    n = np.diff(found.offsets)
    more = (begin is not None) + (end is not None)
    offsets = found.offsets + np.arange(len(found.offsets)) * more
    ids = np.empty(int(offsets[-1]), np.int32)
    ids[np.repeat(offsets[:-1] + (begin is not None), n) + runs(n)] = found.ids
    if begin is not None:
        ids[offsets[:-1]] = begin
    if end is not None:
        ids[offsets[1:] - 1] = end
    return Encoded(ids, offsets)


#: What encode_pieces can give of a text.
_OUTPUTS = {"ids": "array<int>", "packed": "binary", "decoded": "string"}


def encode_pieces(docs: DataFrame, *, text_col: str = "text", model: str = "piece_bpe_32k.model", begin: bool = True, end: bool = True, outputs: tuple[str, ...] = ("ids",), carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document row: the columns of `carry` and those of `outputs`: ids (array of int), as the library encodes the text with the model, packed (the ids as little-endian unsigned 32-bit integers) and decoded (the text that the library decodes from the ids).

    `model` names a public tokenizer, or a path that every worker can read; models of another kind than BPE with byte
    fallback and without normalisation are an error. Null and empty texts have no ids but those of begin and end;
    repeated rows and ids stay as they are; other columns are left out, and a carried one of an output's name gets `_in`;
    no documents give no rows. Strings of control pieces inside texts are text. A text of any length is one row; a
    stretch without a cut of more than LONG characters is merged from a heap, in n log n.
    """
    through = carried(carry, outputs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = pieces(model)
        for whole in batches:
            for batch in row_slices(whole, "_text", SLICE):
                found = _surrounded(machine.encode(pc.fill_null(batch.column("_text"), "")), machine.begin if begin else None, machine.end if end else None)
                made = [_output(machine, found, name) for name in outputs]
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in through], *made], names=[*[name for _, name in through.values()], *outputs])

    schema = T.StructType([*[T.StructField(name, docs.schema[c].dataType) for c, name in through.values()], *[T.StructField(name, T._parse_datatype_string(_OUTPUTS[name])) for name in outputs]])
    return docs.select(*[F.col(c).alias(k) for k, (c, _) in through.items()], F.col(text_col).alias("_text")).mapInArrow(work, schema)


def _output(machine: Pieces, found: Encoded, name: str) -> pa.Array:
    if name == "ids":
        return pa.ListArray.from_arrays(pa.array(found.offsets.astype(np.int32)), pa.array(found.ids))
    if name == "decoded":
        return pa.array(machine.decode(found), pa.string())
    raw = found.ids.astype("<u4").tobytes()
    return pa.array([raw[4 * lo : 4 * hi] for lo, hi in zip(found.offsets[:-1].tolist(), found.offsets[1:].tolist())], pa.binary())


def _by_row(column: pa.Array, model: str, name: str, kind: pa.DataType) -> pa.Array:
    """An output of each row of ids, for about SLICE ids at once; null for null."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(size + 16)) // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(column)]
    made = []
    for lo, hi in zip(cuts, cuts[1:]):
        rows = column.slice(lo, hi - lo)
        found = Encoded(rows.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size[lo:hi])]))
        made.append(pc.if_else(rows.is_null(), pa.scalar(None, kind), _output(pieces(model), found, name)))
    return pa.concat_arrays(made)


def decoded(ids: Column, model: str = "piece_bpe_32k.model") -> Column:
    """Text of an array of ids, as the library decodes it; null ids give null, an id out of the vocabulary is an error."""

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return _by_row(column, model, "decoded", pa.string())

    return run(ids)


def packed(ids: Column, model: str = "piece_bpe_32k.model") -> Column:
    """The ids as little-endian unsigned 32-bit integers, one after the other (null: null)."""

    @F.arrow_udf("binary")
    def run(column: pa.Array) -> pa.Array:
        return _by_row(column, model, "packed", pa.binary())

    return run(ids)
