"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained by follow-the-regularised-leader with elastic-net penalties, then calibrated by a temperature.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.llm._common import Stash, carried, mix, row_slices, runs, window_starts

SIZES = (1, 2, 3)
#: Places that n-grams are hashed into.
PLACES = 1 << 14
#: Most labelled rows that the model is fitted on. A labelled language has LEAST_ROWS of them if it has as many.
SAMPLE_ROWS, LEAST_ROWS = 4000, 4
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.3, 1.0, 1e-3, 1e-4
#: x = SCALE * (count / n-grams of the text) * idf.
SCALE = 20.0
UNKNOWN = "und"
#: Text bytes at once: n-gram arrays are some 200 times as large. A longer text is read in stretches of as many characters.
_SLICE = 512 << 10


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of each text, flat, with offsets; none for a text without letters.

    Letters are lower-cased; what follows a run of letters counts as one space, as does the end of the text.
    """
    low = [(t or "").lower() for t in texts]
    raw = np.frombuffer((" " + "".join(t + " " for t in low)).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[raw]
    chars = np.where(letter, raw, np.uint32(32)).astype(np.uint64)
    ends = np.cumsum([len(t) + 1 for t in low], dtype=np.int64) + 1
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    seen = np.concatenate([[0], np.cumsum(kept)])
    chars = chars[kept]
    offsets = np.concatenate([[0], seen[ends]])
    flat, rows = [], []
    counts = np.zeros(len(low), np.int64)
    for n in SIZES:
        starts = window_starts(offsets, n)
        code = np.zeros(len(starts), np.uint64)
        for j in range(n):
            code |= chars[starts + j] << np.uint64(21 * j)
        if n == 1:
            alone = code != np.uint64(32)
            starts, code = starts[alone], code[alone]
        flat.append((mix(code) % np.uint64(PLACES)).astype(np.int32))
        rows.append(np.searchsorted(offsets, starts, "right") - 1)
        counts += np.bincount(rows[-1], minlength=len(low))
    out = np.concatenate([[0], np.cumsum(counts)])
    merged = np.zeros(int(out[-1]), np.int32)
    at = out[:-1].copy()
    for f, r in zip(flat, rows):
        n = np.bincount(r, minlength=len(low))
        merged[np.repeat(at, n) + runs(n)] = f
        at += n
    return merged, out


def stretches(texts: list[str | None], limit: int) -> Iterator[tuple[int, int, list[str | None]]]:
    """(first row, last row + 1, texts) of what is worked on at once: many short texts, or one stretch of a long one.

    A text of more than `limit` characters comes in stretches that end at white space where there is any; the n-grams of
    each are those of a text of its own.
    """
    lo, size = 0, 0
    for r, t in enumerate(texts):
        n = len(t or "")
        if size and size + n > limit:
            yield lo, r, texts[lo:r]
            lo, size = r, 0
        if n > limit:
            at = 0
            while at < n:
                end = min(n, at + limit)
                if end < n and (gap := max(t.rfind(" ", at, end), t.rfind("\n", at, end))) > at:
                    end = gap + 1
                yield r, r + 1, [t[at:end]]
                at = end
            lo, size = r + 1, 0
        else:
            size += n
    if lo < len(texts):
        yield lo, len(texts), texts[lo:]


class _Rows:
    """Rows of the sample as (places, values, language). The counts stay packed as they came; a row's values are made when it is its turn."""

    def __init__(self, packed: list[tuple[bytes, bytes, int]], idf: np.ndarray):
        self.packed, self.idf = packed, idf

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        for places, counts, y in self.packed:
            at, c = np.frombuffer(places, "<i4").astype(np.int64), np.frombuffer(counts, "<i4").astype(float)
            yield np.append(at, PLACES), np.append(SCALE * c / c.sum() * self.idf[at], 1.0), y


class Model(NamedTuple):
    languages: list[str]
    weights: np.ndarray  # PLACES x languages, times idf and SCALE
    bias: np.ndarray
    temperature: float


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _ftrl(rows: Iterable[tuple[np.ndarray, np.ndarray, int]], n_languages: int) -> np.ndarray:
    """Weights (PLACES + 1 rows, the last of them the bias) of FTRL-proximal over the rows, in their order, EPOCHS times."""
    z = np.zeros((PLACES + 1, n_languages))
    n = np.zeros_like(z)

    def weights(at) -> np.ndarray:
        return np.where(np.abs(z[at]) > L1, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2), 0.0)

    for _ in range(EPOCHS):
        for at, x, y in rows:
            w = weights(at)
            p = _softmax(x @ w)
            p[y] -= 1.0
            g = x[:, None] * p
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - s * w
            n[at] += g * g
    return weights(slice(None))


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits, from 0.05 to 20, of least log loss, by golden section."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        return float(-np.log(np.maximum(_softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-12)).mean())

    lo, hi, g = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train(labelled: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """A model of rows (id, text, lang); None without any labelled text that has a letter.

    Document frequencies are counted over all rows. Weights are fitted on about `sample_rows` rows, spread over the
    languages by the number of their different rows (id and text), of which only n-gram counts reach the driver: 131 KB
    a row at most, as there are PLACES of them, and 2 * `sample_rows` rows at most. Rows are drawn by a hash of id and
    text, and each language has its LEAST_ROWS rows of least hash besides, or all if it has fewer: so every language
    with a text that has a letter is known. More languages than `sample_rows` / LEAST_ROWS are an error. Equal rows
    stand in the sample once.
    """
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(PLACES, np.int64), 0
        for whole in batches:
            for batch in row_slices(whole, "text", _SLICE):
                open_row, seen = -1, np.zeros(PLACES, bool)
                for first, _, texts in stretches(batch.column("text").to_pylist(), _SLICE):
                    flat, offsets = grams(texts)
                    for k, (lo, hi) in enumerate(zip(offsets[:-1], offsets[1:])):
                        if first + k != open_row:
                            df += seen
                            n += bool(seen.any())
                            open_row, seen = first + k, np.zeros(PLACES, bool)
                        seen[flat[lo:hi]] = True
                df += seen
                n += bool(seen.any())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, PLACES, dtype=np.int32)), pa.array(np.concatenate([[n], df]))], names=["place", "n"])

    found = labelled.select("text").mapInArrow(frequencies, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    if not len(found) or not (n_docs := int(found.n[found.place == -1].sum())):
        return None
    df = np.zeros(PLACES)
    df[found.place[found.place >= 0]] = found.n[found.place >= 0]
    idf = np.log((1 + n_docs) / (1 + df)) + 1.0
    most = max(1, sample_rows // LEAST_ROWS)
    own = labelled.withColumn("h", F.xxhash64(F.col("id").cast("string"), F.col("text"), F.lit("sample")))
    different = own.groupBy("lang", "h").agg(F.lit(1).alias("one")).select("lang", "h")
    counts = different.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(most + 1).collect()
    if len(counts) > most:
        raise ValueError(f"more than {most} languages: raise sample_rows")
    share = sample_rows / len(counts)
    rates = labelled.sparkSession.createDataFrame([(r["lang"], min(1.0, share / r["n"])) for r in counts], "lang string, rate double")
    # of each language the rows of least hash, which a task finds in its own part first; `sample_rows` at most in all
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    least = different.withColumn("place", place).where(F.col("place") <= LEAST_ROWS).select("lang", "h", F.lit(True).alias("first"))
    draw = F.pmod(F.col("h"), F.lit(1 << 40)).cast("double") / float(1 << 40)
    sample = own.withColumn("draw", draw).join(F.broadcast(rates), "lang").join(F.broadcast(least), ["lang", "h"], "left").where(F.col("first") | (F.col("draw") < F.col("rate")))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_slices(whole, "text", _SLICE):
                counts = [np.zeros(0, np.int64)] * batch.num_rows
                for first, _, texts in stretches(batch.column("text").to_pylist(), _SLICE):
                    flat, offsets = grams(texts)
                    for k, (lo, hi) in enumerate(zip(offsets[:-1], offsets[1:])):
                        if hi > lo:
                            own = np.bincount(flat[lo:hi], minlength=PLACES)
                            counts[first + k] = own + counts[first + k] if len(counts[first + k]) else own
                held = [np.flatnonzero(c) for c in counts]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("draw", "lang", "h", "first")], pa.array([at.astype("<i4").tobytes() for at in held], pa.binary()), pa.array([c[at].astype("<i4").tobytes() for c, at in zip(counts, held)], pa.binary())], names=["draw", "lang", "h", "first", "places", "counts"])

    # rows alike (one id and text, one language) are one row of the sample, so a draw of any text brings one row; what
    # is drawn beyond twice the sample, which takes hashes far from even, is left in the tables
    drawn = sample.select("draw", "lang", "h", "first", "text").mapInArrow(vectors, "draw double, lang string, h long, first boolean, places binary, counts binary").where(F.length("places") > 0)
    drawn = drawn.groupBy("draw", "lang", "h", "first").agg(F.min(F.struct("places", "counts")).alias("v"))
    # written, then read partition by partition: neither Spark's driver nor Python holds the sample more than once
    stash = Stash(labelled.sparkSession)
    kept = stash.keep(drawn.select("draw", "lang", "h", "first", "v.*"))
    if kept.count() > 2 * sample_rows:
        kept = stash.keep(kept.orderBy(F.col("first").desc_nulls_last(), "draw", "lang", "h").limit(2 * sample_rows))
    got = [(r["draw"] * 7919 % 1, r["lang"], bytes(r["places"]), bytes(r["counts"])) for r in kept.select("draw", "lang", "places", "counts").toLocalIterator()]
    stash.only()
    got.sort()
    languages = sorted({r[1] for r in got}, key=lambda x: x.encode())
    if not languages:
        return None
    number = {x: k for k, x in enumerate(languages)}
    rows = [(places, c, number[lang]) for _, lang, places, c in got]
    held = rows[::5] if len(rows) >= 50 else []
    fit = _Rows([r for k, r in enumerate(rows) if k % 5 or not held], idf)
    w = _ftrl(fit, len(languages))
    t = _temperature(np.array([x @ w[at] for at, x, _ in _Rows(held, idf)]), np.array([y for *_, y in held], int))
    return Model(languages, (w[:-1] * idf[:, None] * SCALE).astype(np.float32), w[-1].astype(np.float32), t)


def logits(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams of each text, a row of logits for each text that has any)."""
    n, sums = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(model.languages)))
    for first, last, part in stretches(texts, _SLICE):
        flat, offsets = grams(part)
        own = np.diff(offsets)
        full = np.flatnonzero(own)
        n[first:last] += own
        if len(full):
            sums[first + full] += np.stack([np.add.reduceat(model.weights[:, k][flat].astype(np.float64), offsets[:-1][full]) for k in range(len(model.languages))], axis=1)
    full = n > 0
    return n, sums[full] / n[full, None] + model.bias


def predict(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document row: lang_pred and score (calibrated odds of it, 0 to 1); `und` and 0 for a null text, one without letters, or without a model. Columns named in `carry` pass through, one of the name of an output with `_in` at its end."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    through = carried([id_col, *carry], ("lang_pred", "score"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for whole in batches:
            for batch in row_slices(whole, "_text", _SLICE):
                lang, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
                if own is not None:
                    n, found = logits(batch.column("_text").to_pylist(), own)
                    full = np.flatnonzero(n)
                    if len(full):
                        p = _softmax(found / own.temperature)
                        best = p.argmax(axis=1)
                        score[full] = p[np.arange(len(full)), best]
                        for r, k in zip(full.tolist(), best.tolist()):
                            lang[r] = own.languages[k]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in through], pa.array(lang, pa.string()), pa.array(score)], names=[*[name for _, name in through.values()], "lang_pred", "score"])

    schema = T.StructType([*[T.StructField(name, docs.schema[c].dataType) for c, name in through.values()], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(*[F.col(c).alias(k) for k, (c, _) in through.items()], F.col(text_col).alias("_text")).mapInArrow(work, schema)


def is_held_out(id_col: str = "doc_id") -> Column:
    """Rows that never train: CRC-32 of the id as text leaves 2 when divided by 4. A null id is not held out, and does not train either."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Train on the labelled documents that are not held out, predict all: id, lang_pred, score, a row per document row.

    Null or letterless texts: `und`, 0. A text of any length is one row; its memory is that of one stretch of it. Null languages do not train. No training rows or no documents: `und` for all,
    or no rows. Repeated rows count as often as they stand there; the sample is chosen by id, so reruns agree; other
    columns are left out unless `carry` names them. Only the text is looked at when predicting.
    """
    learn = docs.where(F.col(id_col).isNotNull() & ~is_held_out(id_col)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return predict(docs, train(learn, sample_rows=sample_rows), id_col=id_col, text_col=text_col, carry=carry)
