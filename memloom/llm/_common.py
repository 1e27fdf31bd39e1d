"""What the corpus operators share: word splitting over Arrow columns, 64-bit hashes, and tables kept between jobs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that a task works on at once.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as it is read; one in fewer pieces than there are cores (a small file) is dealt to all of them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    n = spark.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and the executors share: the session's; one of our own only in a local session that names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="memloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def carried(columns: Iterable[str], outputs: Iterable[str]) -> dict[str, tuple[str, str]]:
    """Private name of each column that passes through an operator, with its own name and the one it comes out under.

    That is its own, or with `_in` at its end where the operator has an output of that name.
    """
    taken = set(outputs)
    out: dict[str, tuple[str, str]] = {}
    for k, c in enumerate(dict.fromkeys(columns)):
        name = c
        while name in taken:
            name += "_in"
        taken.add(name)
        out[f"_keep{k}"] = (c, name)
    return out


class Stash:
    """Tables written to the shared folder to cut lineage and to share work between jobs. drop() removes one, only() all others than those that a result still reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths = spark, f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}", {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.paths)}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(kept)] = (path, kept)
        return kept

    def only(self, *kept: DataFrame) -> None:
        self.drop(*[df for _, df in list(self.paths.values()) if not any(df is k for k in kept)])

    def drop(self, *kept: DataFrame) -> None:
        for df in kept:
            path = self.paths.pop(id(df), (None,))[0]
            if path:
                target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


#: A key with more than this share of a table's rows is hot. So there are never more hot keys than its inverse.
HOT_SHARE = 1 / 50_000


def keyed_join(rows: DataFrame, facts: DataFrame, key: str, size: str, n_rows: int, stash: Stash, least: int = 64) -> DataFrame:
    """rows joined to facts, which has one row per key and in `size` how many of the n_rows rows have it.

    Rows of hot keys stay where they are: their facts are sent to them, 50,000 short rows at most. The others are joined
    by shuffle. So no task gets a whole hot key.
    """
    facts = stash.keep(facts)
    hot = F.col(size) > max(least, int(n_rows * HOT_SHARE))
    if not facts.where(hot).take(1):
        return rows.join(facts, key)
    few = F.broadcast(facts.where(hot))
    return rows.join(few, key).unionByName(rows.join(few.select(key), key, "left_anti").join(facts.where(~hot), key))


def row_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in row ranges of about `limit` bytes of text each; a longer single row stands alone."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size + 64) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        yield batch.slice(lo, hi - lo)


class Words(NamedTuple):
    """Words of a column of texts: codes into vocab, and where each row's words start."""

    codes: np.ndarray
    offsets: np.ndarray
    vocab: pa.Array

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def rows(self) -> np.ndarray:
        """Row of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def split_words(texts: pa.Array) -> Words:
    """Words of each text (null: none), split at ASCII white space only."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    starts = lists.offsets.to_numpy().astype(np.int64)
    starts -= starts[0]
    full = pc.greater(pc.binary_length(flat), 0)
    seen = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)])
    coded = flat.filter(full).dictionary_encode()
    return Words(coded.indices.to_numpy().astype(np.int64), seen[starts], coded.dictionary)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def string_hashes(strings: pa.Array) -> np.ndarray:
    """64-bit hashes of the strings' bytes, the same in every task."""
    n = len(strings)
    size = pc.binary_length(strings).to_numpy(zero_copy_only=False).astype(np.int64)
    strings = pa.concat_arrays([strings])  # a copy that starts at offset 0 of its buffers
    raw = np.frombuffer(strings.buffers()[2] or b"", dtype=np.uint8)
    ends = np.cumsum(size)
    first = int(np.frombuffer(strings.buffers()[1], dtype=np.int64 if pa.types.is_large_string(strings.type) else np.int32)[strings.offset]) if n else 0
    raw = raw[first : first + (int(ends[-1]) if n else 0)]
    within = np.arange(len(raw), dtype=np.int64) - np.repeat(ends - size, size)
    parts = mix((within.astype(np.uint64) << np.uint64(8)) + raw + np.uint64(0x9E3779B97F4A7C15))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(parts, dtype=np.uint64)])
    return mix(sums[ends] - sums[ends - size] + size.astype(np.uint64))


#: Odd multipliers for the places of a window.
PLACES = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` neighbours; runs that cross a row's end are the caller's to leave out."""
    n = max(0, len(hashes) - width + 1)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out += hashes[j : j + n] * PLACES[j]
    return mix(out)


def window_starts(offsets: np.ndarray, width: int) -> np.ndarray:
    """Places of the flat word array at which a whole window of one row starts."""
    counts = np.maximum(np.diff(offsets) - width + 1, 0)
    return np.repeat(offsets[:-1], counts) + runs(counts)


def runs(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c of counts, one after the other."""
    total = int(counts.sum())
    return np.arange(total, dtype=np.int64) - np.repeat(np.cumsum(counts) - counts, counts)


def equal_windows(codes: np.ndarray, starts: np.ndarray, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the windows that puts equal ones together, and the group number of each place of that order.

    Windows are sorted by hash, then neighbours are compared word by word, so equal hashes of different
    words never join: such a run is sorted by its words.
    """
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    same_hash = h[1:] == h[:-1]
    pairs = np.flatnonzero(same_hash)
    same = np.zeros(len(same_hash), bool)
    a, b = starts[order[pairs]], starts[order[pairs + 1]]
    equal = np.ones(len(pairs), bool)
    for j in range(width):
        equal &= codes[a + j] == codes[b + j]
    same[pairs] = equal
    if not equal.all():
        for value in np.unique(h[pairs[~equal]]):
            lo, hi = np.searchsorted(h, value, "left"), np.searchsorted(h, value, "right")
            rows = codes[starts[order[lo:hi]][:, None] + np.arange(width)]
            by = np.lexsort(rows.T[::-1])
            order[lo:hi] = order[lo:hi][by]
            same[lo : hi - 1] = (rows[by][1:] == rows[by][:-1]).all(axis=1)
    return order, np.concatenate([[0], np.cumsum(~same)]) if len(order) else np.zeros(0, np.int64)
