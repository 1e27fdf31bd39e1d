"""Quality rules: Jensen-Shannon distance of a document's histograms to those of the languages of the corpus."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm._common import Words, equal_windows, mix, row_slices, split_words, window_hashes, window_starts

REPEAT_WIDTH = 8
SYMBOLS = "#*$%&|<>"
#: Words that a language needs to be a reference, whatever the others have, and the share of its language's words that
#: a word needs to be common: so a reference has at most 500 words.
LEAST_WORDS, LEAST_WORD = 10_000, 1 / 500
#: (distance above which a document fails, words below which the rule says nothing): character classes, common words.
CLASS_RULE, WORD_RULE = (0.27, 50), (0.33, 100)
#: Share of words outside of a reference's common ones, and of letters among the characters, from which on a text is in
#: a language that has no reference: texts in one that has use its common words for half of theirs or so.
FOREIGN, LETTERS = 0.9, 0.7

#: Character classes. ASCII by the sets below; beyond it by the general category of Unicode, so that every script has
#: letters with and without case, marks, digits and points of its own.
CLASSES = ("lower", "upper", "letter", "mark", "digit", "white", "space", "point", "symbol", "sign", "other")
_ASCII = {"lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789", "white": " \t\n\r\x0b\x0c", "point": ".,;:?!'\"()-", "symbol": SYMBOLS}
_BEYOND = {"Ll": "lower", "Lu": "upper", "Lt": "upper", "L": "letter", "M": "mark", "N": "digit", "Z": "space", "P": "point", "S": "sign"}


def class_of(char: str) -> str:
    if char.isascii():
        return next((name for name, chars in _ASCII.items() if char in chars), "other")
    category = unicodedata.category(char)
    return _BEYOND.get(category) or _BEYOND.get(category[0], "other")


@functools.cache
def _class_numbers() -> np.ndarray:
    return np.fromiter((CLASSES.index(class_of(chr(c))) for c in range(0x110000)), np.uint8, 0x110000)


class Reference(NamedTuple):
    """Shares of character classes; common words and their shares, with the share of all other words at the end."""

    classes: np.ndarray
    words: list[str]
    shares: np.ndarray


def class_counts(texts: pa.Array) -> np.ndarray:
    """A row of class counts for each text."""
    held = [t or "" for t in texts.to_pylist()]
    points = np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), np.uint32)
    width, rows = len(CLASSES), np.repeat(np.arange(len(held)), [len(t) for t in held])
    return np.bincount(rows * width + _class_numbers()[points], minlength=len(held) * width).reshape(-1, width)


def distances(counts: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) of each row of counts to the shares; 1 for an empty row."""
    total = counts.sum(axis=1, keepdims=True)
    p = counts / np.maximum(total, 1)
    m = (p + shares) / 2

    def part(x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log2(x / m), 0.0).sum(axis=1)

    return np.where(total[:, 0] > 0, np.sqrt(np.maximum(0.0, (part(p) + part(np.broadcast_to(shares, p.shape))) / 2)), 1.0)


def _lower(words: Words) -> pa.Array:
    return pc.ascii_lower(words.vocab)


def _heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each slice and language, the words of at least half the least share, and (with a null word) how many words there are."""
    for whole in batches:
        for batch in row_slices(whole, "text"):
            words = split_words(batch.column("text"))
            small = _lower(words).dictionary_encode()
            codes = small.indices.to_numpy().astype(np.int64)[words.codes]
            langs = batch.column("lang").dictionary_encode()
            lang = langs.indices.to_numpy().astype(np.int64)[words.rows()]
            out: list[tuple] = []
            for k, name in enumerate(langs.dictionary.to_pylist()):
                n = np.bincount(codes[lang == k], minlength=len(small.dictionary))
                total = int(n.sum())
                if total:
                    out.append((name, None, total))
                    often = np.flatnonzero(n >= max(1, total * LEAST_WORD / 2))
                    out += zip([name] * len(often), small.dictionary.take(pa.array(often)).to_pylist(), n[often].tolist())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])


def language_references(docs: DataFrame, least_words: int = 1) -> dict[str, Reference]:
    """References of all languages of (text, lang) with `least_words` words or more, from all texts with a language.

    A word of share s in a language has at least share s / 2 in slices that hold at least s / 2 of the language's words
    as that word; so summing what slices report leaves at most 1000 words a language, proven, of which a second pass
    counts every occurrence, together with the character classes. So at most 1000 words a language come to the driver.
    """
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    heavy = docs.mapInArrow(_heavy, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    totals = {r["lang"]: r["n"] for r in heavy.where(F.col("word").isNull() & (F.col("n") >= max(1, least_words))).select("lang", "n").collect()}
    if not totals:
        return {}
    spark = docs.sparkSession
    least = spark.createDataFrame([(k, v * LEAST_WORD) for k, v in totals.items()], "lang string, least double")
    found = heavy.where(F.col("word").isNotNull()).join(F.broadcast(least), "lang").where(F.col("n") >= F.col("least") / 2).select("lang", "word").toArrow()
    likely: dict[str, list[str]] = {k: [] for k in totals}
    for lang, word in zip(found.column("lang").to_pylist(), found.column("word").to_pylist()):
        likely[lang].append(word)
    order, n_classes = sorted(likely), len(CLASSES)
    held = [pa.array(sorted(likely[k]), pa.string()) for k in order]

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of each language met: its classes, its likely words, all other words
        sums: dict[int, np.ndarray] = {}
        for whole in batches:
            for batch in row_slices(whole, "text"):
                lang = pc.fill_null(pc.index_in(batch.column("lang"), pa.array(order)), -1).to_numpy().astype(np.int64)
                words = split_words(batch.column("text"))
                small = _lower(words)
                chars = class_counts(batch.column("text"))
                rows = lang[words.rows()]
                for k in np.unique(lang[lang >= 0]).tolist():
                    own = len(held[k])
                    place = pc.fill_null(pc.index_in(small, held[k]), own).to_numpy().astype(np.int64)
                    counts = np.append(chars[lang == k].sum(axis=0), np.bincount(place[words.codes[rows == k]], minlength=own + 1))
                    sums[k] = sums[k] + counts if k in sums else counts
        yield pa.RecordBatch.from_arrays([pa.array([order[k] for k in sums], pa.string()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))], names=["lang", "sums"])

    places = docs.mapInArrow(exact, "lang string, sums array<long>").select("lang", F.posexplode("sums").alias("at", "n"))
    counted = places.groupBy("lang", "at").agg(F.sum("n").alias("n")).join(F.broadcast(least), "lang")
    counted = counted.where((F.col("at") < n_classes) | (F.col("n") >= F.col("least"))).select("lang", "at", "n").toArrow()
    counts: dict[str, dict[int, int]] = {k: {} for k in order}
    for lang, at, n in zip(*[counted.column(c).to_pylist() for c in ("lang", "at", "n")]):
        counts[lang][at] = n
    out = {}
    for name, words in zip(order, held):
        chars = np.array([counts[name].get(k, 0) for k in range(n_classes)], float)
        common = sorted(k - n_classes for k in counts[name] if n_classes <= k < n_classes + len(words))
        n = np.array([counts[name][k + n_classes] for k in common], float)
        shares = np.append(n, totals[name] - n.sum()) / totals[name]
        out[name] = Reference(chars / max(1.0, chars.sum()), words.take(pa.array(common, pa.int64())).to_pylist(), shares)
    return out


def repeated_words(words: Words, width: int = REPEAT_WIDTH) -> np.ndarray:
    """Of each row, its words in windows that occur twice or more in it."""
    starts = window_starts(words.offsets, width)
    row = np.repeat(np.arange(len(words.offsets) - 1), np.maximum(words.counts - width + 1, 0))
    per_word = mix(words.codes.astype(np.uint64) + np.uint64(1))
    order, group = equal_windows(words.codes, starts, window_hashes(per_word, width)[starts] ^ mix(row.astype(np.uint64) + np.uint64(7)), width)
    if not len(order):
        return np.zeros(len(words.offsets) - 1, np.int64)
    r = row[order]
    new = np.concatenate([[True], (group[1:] != group[:-1]) | (r[1:] != r[:-1])])
    again = np.diff(np.append(np.flatnonzero(new), len(order)))[np.cumsum(new) - 1] > 1
    edge = np.zeros(len(words.codes) + 1, np.int64)
    np.add.at(edge, starts[order[again]], 1)
    np.add.at(edge, starts[order[again]] + width, -1)
    hit = np.cumsum(edge)[:-1] > 0
    return np.bincount(words.rows()[hit], minlength=len(words.offsets) - 1)


def duplicate_lines(text: str | None) -> int:
    lines = [x for x in (text or "").encode("utf-8", "surrogatepass").split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def quality(docs: DataFrame, references: dict[str, Reference] | None = None, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", class_rule: tuple[float, int] = CLASS_RULE, word_rule: tuple[float, int] = WORD_RULE) -> DataFrame:
    """One row per document row: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class_distance, word_distance, base_failed, kept, foreign.

    A document's histograms of character classes and of common words are held against every reference, and the nearest
    counts, so a missing or wrong language does not matter. It fails the rule if the distance is above the rule's bound
    and the document has the rule's least number of words; shorter ones pass that rule, as their histograms say little.
    A language with LEAST_WORDS words or more has a reference, however large the others are. A document of letters that
    has hardly a common word of any reference is in a language without one (foreign): its distances are null and only
    the base rules decide. That is told by its words alone, never by its label, so a document without label, or with a
    wrong one, gets the same verdict; a text of invented words passes as a foreign one.
    base_failed: under 20 words, or over 30% of words in 8-word windows that occur again in the text.

    Null and empty texts have no words: all counts 0, distances 1, base_failed. Without any language (or no documents
    at all) there is no reference: distances are null and only the base rules decide. Repeated rows and ids give repeated
    results; a text of any length is one row, whose memory is some 20 times its size; other columns are left out.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))  # a null label makes no reference
    refs = language_references(source, LEAST_WORDS) if references is None else references
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_slices(whole, "text"):
                texts = batch.column("text")
                words = split_words(texts)
                n, rows, small = words.counts, words.rows(), _lower(words)
                chars = class_counts(texts)
                by_class = by_word = None
                mute = np.zeros(len(n), bool)
                if refs:
                    by_class = np.min([distances(chars, r.classes) for r in refs.values()], axis=0)
                    found, unknown, whole_low = [], np.ones(len(n)), pc.utf8_lower(small)
                    for r in refs.values():
                        k = len(r.words)
                        place = pc.fill_null(pc.index_in(small, pa.array(r.words, pa.string())), k).to_numpy().astype(np.int64)
                        cased = pc.fill_null(pc.index_in(whole_low, pa.array(r.words, pa.string())), k).to_numpy()
                        counts = np.bincount(rows * (k + 1) + place[words.codes], minlength=len(n) * (k + 1)).reshape(len(n), k + 1)
                        found.append(distances(counts, r.shares))
                        unknown = np.minimum(unknown, np.bincount(rows, (cased == k)[words.codes], len(n)) / np.maximum(n, 1))
                    by_word = np.min(found, axis=0)
                    letters = chars[:, [CLASSES.index(c) for c in ("lower", "upper", "letter", "mark")]].sum(axis=1)
                    mute = (n > 0) & (unknown >= FOREIGN) & (letters >= LETTERS * (chars.sum(axis=1) - chars[:, CLASSES.index("white")]))
                repeats = repeated_words(words)
                failed = (n < 20) | (100 * repeats > 30 * n)
                good = ~failed
                for rule, d in ((class_rule, by_class), (word_rule, by_word)):
                    if d is not None:
                        good &= (d <= rule[0]) | (n < rule[1]) | mute
                none = pa.nulls(len(n), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"),
                        pa.array(n),
                        pa.array(chars.sum(axis=1) - chars[:, CLASSES.index("white")]),
                        pa.array(chars[:, CLASSES.index("symbol")]),
                        pa.array([duplicate_lines(t) for t in texts.to_pylist()], pa.int64()),
                        pa.array(repeats),
                        none if by_class is None else pa.array(by_class, mask=mute),
                        none if by_word is None else pa.array(by_word, mask=mute),
                        pa.array(failed),
                        pa.array(good),
                        pa.array(mute) if refs else pa.nulls(len(n), pa.bool_()),
                    ],
                    names=["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed", "kept", "foreign"],
                )

    schema = f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, class_distance double, word_distance double, base_failed boolean, kept boolean, foreign boolean"
    return source.mapInArrow(work, schema).withColumnRenamed("id", id_col)
