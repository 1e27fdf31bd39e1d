"""Which texts contain which of many given strings, by rolling hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lengths of the starts by which strings are looked up: of each the longest that it has.
LENGTHS = (1, 2, 3, 4, 5, 6, 7, 8, 12, 16, 24, 32, 64)
#: Bits of the filter that tasks hold texts' hashes against: 4 MB, however many strings there are.
BITS = 1 << 25
#: Characters that are hashed at once; stretches of longer texts overlap by the longest start.
STRETCH = 1 << 18
_P = 0x9E3779B97F4A7C15
_INVERSE = pow(_P, -1, 1 << 64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def window_hashes(chars: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each length, the hashes of all windows of so many neighbours, from one running sum over all characters."""
    n = len(chars)
    power = np.cumprod(np.full(n + 1, _P, np.uint64))
    back = np.cumprod(np.full(n + 1, _INVERSE, np.uint64))
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * power[:n], dtype=np.uint64)])
    for size in lengths:
        if size <= n:
            yield size, _mixed((run[size:] - run[:-size]) * back[: n - size + 1] + np.uint64(size))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[int, str]]:
    """(row, stretch) of the texts, each of STRETCH characters and the longest start beyond them."""
    for row, text in enumerate(batch.column("_t").to_pylist()):
        for lo in range(0, len(text or ""), STRETCH):
            yield row, text[lo : lo + STRETCH + LENGTHS[-1] - 1]


def containing(texts: DataFrame, needles: DataFrame, *, group: str, id: str, text: str, needle: str) -> DataFrame:
    """(group, id, needle), distinct: texts that contain a needle of their own group (null is a group).

    A needle's start, of one of LENGTHS, is hashed; every text's windows of these lengths are hashed by running sums in
    one pass, and those that a fixed-size bit filter of the wanted hashes lets through meet the needles of their group
    by the hash. What meets is then looked for in the text: ids meet first, texts come last. Empty needles are in all
    texts of their group; null texts contain nothing, null needles are in none.
    """
    wanted = needles.select(F.col(group).alias("_g"), F.col(needle).alias("_n")).where(F.col("_n").isNotNull()).distinct()
    held = texts.select(F.col(group).alias("_g"), F.col(id).alias("_id"), F.col(text).alias("_t")).where(F.col("_t").isNotNull())

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, hashes = [], []
            for x in batch.column("_n").to_pylist():
                size = max(k for k in LENGTHS if k <= len(x))
                sizes.append(size)
                hashes.append(int(next(window_hashes(_codes(x[:size]), [size]))[1][0].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("_g"), batch.column("_n"), pa.array(sizes, pa.int32()), pa.array(hashes, pa.int64())], names=["_g", "_n", "_size", "_h"])

    kind = T.StructType([wanted.schema["_g"], wanted.schema["_n"], T.StructField("_size", T.IntegerType()), T.StructField("_h", T.LongType())])
    hashed = wanted.where(F.length("_n") > 0).mapInArrow(starts, kind)
    # the filter: BITS / 64 numbers at most, whatever the number of needles, and the lengths that are in use
    bit = F.pmod("_h", F.lit(BITS))
    words = hashed.groupBy(F.shiftright(bit, 6).cast("int").alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(_h, {BITS}) % 64 as int))")).alias("bits")).toArrow()
    lengths = sorted(r["_size"] for r in hashed.select("_size").distinct().collect())
    table = np.zeros(BITS // 64, np.int64)
    table[words["at"].to_numpy()] = words["bits"].to_numpy()
    shared = texts.sparkSession.sparkContext.broadcast(table.view(np.uint64))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            rows, sizes, hashes = [], [], []
            for row, part in _stretches(batch):
                for size, h in window_hashes(_codes(part), lengths):
                    place = h % np.uint64(BITS)
                    h = np.unique(h[(bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1])
                    rows.append(np.full(len(h), row))
                    sizes.append(np.full(len(h), size, np.int32))
                    hashes.append(h.view(np.int64))
            at = pa.array(np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("_g").take(at), batch.column("_id").take(at), pa.array(np.concatenate([np.zeros(0, np.int32), *sizes])), pa.array(np.concatenate([np.zeros(0, np.int64), *hashes]))], names=["_g", "_id", "_size", "_h"])

    hits = held.mapInArrow(met, T.StructType([held.schema["_g"], held.schema["_id"], kind["_size"], kind["_h"]])).distinct()
    starts_of = hashed.select(F.col("_g").alias("_g2"), "_n", "_size", "_h")
    same = F.col("_g").eqNullSafe(F.col("_g2"))
    pairs = hits.join(starts_of, ["_size", "_h"]).where(same).select("_g", "_id", "_n")
    found = _looked_for(pairs, held)
    empty = wanted.where(F.length("_n") == 0).select(F.col("_g").alias("_g2"), "_n")
    found = found.unionByName(held.join(empty, same).select("_g", "_id", "_n").distinct())
    return found.select(F.col("_g").alias(group), F.col("_id").alias(id), F.col("_n").alias(needle))


def _looked_for(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs whose text has the needle."""
    texts = held.select(F.col("_g").alias("_g2"), F.col("_id").alias("_id2"), "_t")
    both = pairs.join(texts, (F.col("_id") == F.col("_id2")) & F.col("_g").eqNullSafe(F.col("_g2")))
    return both.where(F.contains("_t", F.col("_n"))).select("_g", "_id", "_n").distinct()
