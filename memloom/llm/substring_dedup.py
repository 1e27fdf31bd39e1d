"""Substring dedup by super-k-mers: runs of windows with one minimiser travel together and are counted by sorting."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm._common import PLACES, Words, equal_windows, mix, row_slices, runs, split_words, string_hashes, window_hashes, window_starts

WIDTH = 13
#: Words of a minimiser, and of that of windows whose first one is hot.
MINIMISER, LONG = 3, 8
#: Windows of a bucket, about: a task holds one bucket at a time, and one of twice as many in parts.
WINDOWS = 500_000
#: A minimiser is hot if it has this share of all windows, and HOT of them at least. So there are never more than 2 / HOT_SHARE.
HOT_SHARE, HOT = 1e-5, 100_000
#: Text bytes cut into runs at once: larger slices make fewer, better packed blocks.
SLICE = 8 << 20
#: Equal windows of a slice of which only the smallest document's leave it, wherever they stand.
OFTEN = 8
#: What blocks are packed with.
LEVEL = 3


def _minimisers(hashes: np.ndarray, starts: np.ndarray, width: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of the m-word run of least hash, the leftmost of equals, of each window."""
    grams = window_hashes(hashes, m)
    best, at = grams[starts], np.zeros(len(starts), np.int64)
    for j in range(1, width - m + 1):
        there = grams[starts + j]
        less = there < best
        best[less] = there[less]
        at[less] = j
    return best, starts + at


def superkmers(words: Words, hot: np.ndarray | None = None, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, n_windows, minimiser hash) of each run of neighbouring windows of a row that share a minimiser at one place.

    Equal windows have equal minimisers, wherever they stand. Windows whose minimiser is `hot` (sorted hashes) go by a
    longer one, which a frequent phrase shares with its surroundings: that too depends on nothing but the window.
    """
    starts = window_starts(words.offsets, width)
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64)
    hashes = string_hashes(words.vocab)[words.codes]
    best, place = _minimisers(hashes, starts, width, MINIMISER)
    if hot is not None and len(hot):
        frequent = hot[np.minimum(np.searchsorted(hot, best), len(hot) - 1)] == best
        if frequent.any():
            again, place[frequent] = _minimisers(hashes, starts[frequent], width, LONG)
            best[frequent] = mix(again + np.uint64(LONG))
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (best[1:] != best[:-1]) | (starts[1:] != starts[:-1] + 1)])
    first = np.flatnonzero(new)
    return starts[first], np.diff(np.append(first, len(starts))), best[first]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's number of windows (key null), and the minimisers of at least half the hot share of them, with how many they have."""
    keys, counts, total = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
    for whole in batches:
        for batch in row_slices(whole, "text", SLICE):
            _, n, least = superkmers(split_words(batch.column("text")))
            total += int(n.sum())
            keys, back = np.unique(np.concatenate([keys, least]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, n]), len(keys)).astype(np.int64)
    often = counts >= max(2, total * HOT_SHARE / 2)
    yield pa.RecordBatch.from_arrays([pa.array([None, *keys[often].view(np.int64).tolist()], pa.int64()), pa.array([total, *counts[often].tolist()], pa.int64())], names=["key", "n"])


def plan_of(docs: DataFrame) -> tuple[int, np.ndarray]:
    """(number of windows, hot minimisers). A minimiser of share s has at least s / 2 in tasks that hold half of its windows, so none is missed."""
    found = docs.select("text").mapInArrow(_met, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    total = found.where("key is null").agg(F.sum("n")).first()[0] or 0
    hot = found.where(F.col("key").isNotNull() & (F.col("n") >= max(HOT, total * HOT_SHARE) / 2)).select("key").toArrow().column("key").to_numpy()
    return total, np.sort(hot.astype(np.int64).view(np.uint64))


def _settled(words: Words, start: np.ndarray, n: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of runs of n windows from `start`: the windows' starts and runs, which of them an earlier document of the slice covers, and which need not travel.

    A window that OFTEN windows of the slice equal leaves the slice for its smallest document only, whatever stands
    around it; a rarer one stays in its run, which is then not cut, unless all of the run is covered.
    """
    at, run = np.repeat(start, n) + runs(n), np.repeat(np.arange(len(n)), n)
    covered, alike = _covered(words.codes, at, ids[run])
    whole = np.bincount(run[covered], minlength=len(n)) == n
    return at, run, np.flatnonzero(covered), covered & ((alike >= OFTEN) | whole[run])


def _pieces(at: np.ndarray, run: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place among the windows, windows) of each stretch of neighbouring windows of one run, of those at `some`."""
    if not len(some):
        return some, some
    new = np.concatenate([[True], (some[1:] != some[:-1] + 1) | (run[some[1:]] != run[some[:-1]])])
    first = np.flatnonzero(new)
    return some[first], np.diff(np.append(first, len(some)))


def _pack(words: Words, ids: np.ndarray, tags: np.ndarray, firsts: np.ndarray, row: np.ndarray, start: np.ndarray, n: np.ndarray) -> bytes:
    """Runs of one bucket: for each its document, place and length, then all their words as one string."""
    size = n + WIDTH - 1
    codes = words.codes[np.repeat(start, size) + runs(size)]
    text = " ".join(words.vocab.take(pa.array(codes)).to_pylist()) if len(codes) < 64 else _joined(words.vocab.take(pa.array(codes)))
    body = text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")
    head = np.array([len(row)], np.int64).tobytes() + np.diff(ids[row], prepend=0).astype(np.int64).tobytes() + tags[row].astype(np.int64).tobytes() + (start - firsts[row]).astype(np.int32).tobytes() + n.astype(np.int32).tobytes()
    return zstandard.ZstdCompressor(level=LEVEL).compress(head + body)


def _joined(strings: pa.Array) -> bytes:
    import pyarrow.compute as pc

    one = pa.ListArray.from_arrays(pa.array([0, len(strings)], pa.int32()), strings)
    return pc.binary_join(one, " ")[0].as_buffer().to_pybytes()


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    k = int(np.frombuffer(raw, np.int64, 1)[0])
    at = 8
    out = []
    for kind in (np.int64, np.int64, np.int32, np.int32):
        out.append(np.frombuffer(raw, kind, k, at).astype(np.int64))
        at += k * np.dtype(kind).itemsize
    return np.cumsum(out[0]), out[1], out[2], out[3], raw[at:]


def _ranges(ids: np.ndarray, tags: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(tags.astype(np.int64)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=["id", "tag", "lo", "hi"])


def _spread(batches: Iterator[pa.RecordBatch], n_buckets: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Texts to packed runs, one block for each bucket that a slice of texts meets; and ranges that the slice itself settles, as blocks of their own."""
    for whole in batches:
        for batch in row_slices(whole, "text", SLICE):
            words = split_words(batch.column("text"))
            ids, tags = batch.column("id").to_numpy(), batch.column("tag").to_numpy()
            start, n, least = superkmers(words, hot)
            if not len(start):
                continue
            row = np.searchsorted(words.offsets, start, "right") - 1
            at, run, covered, gone = _settled(words, start, n, ids[row])
            own_bucket = (least % np.uint64(n_buckets)).astype(np.int64)
            out_b, out_n, out_p = [], [], []
            head, many = _pieces(at, run, covered[gone[covered]])
            if len(head):
                r = row[run[head]]
                s = at[head] - words.offsets[r]
                known = np.array([-len(r)], np.int64).tobytes() + ids[r].astype(np.int64).tobytes() + tags[r].astype(np.int64).tobytes() + s.astype(np.int32).tobytes() + (s + many + WIDTH - 1).astype(np.int32).tobytes()
                out_b.append(int(mix(ids[r[:1]].astype(np.uint64))[0] % np.uint64(n_buckets)))
                out_n.append(0)
                out_p.append(zstandard.ZstdCompressor(level=LEVEL).compress(known))
            head, n = _pieces(at, run, np.flatnonzero(~gone))
            start, row, bucket = at[head], row[run[head]], own_bucket[run[head]]
            by = np.argsort(bucket, kind="stable")
            b = bucket[by]
            cuts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(b)]):
                part = by[lo:hi]
                out_b.append(int(b[lo]))
                out_n.append(int(n[part].sum()))
                out_p.append(_pack(words, ids, tags, words.offsets, row[part], start[part], n[part]))
            yield pa.RecordBatch.from_arrays([pa.array(out_b, pa.int32()), pa.array(out_n, pa.int64()), pa.array(out_p, pa.binary())], names=["bucket", "n", "block"])


def _covered(codes: np.ndarray, starts: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows also start in a document of smaller id, and how many windows equal each: windows are sorted, and each group of equals knows its smallest."""
    if not len(starts):
        return np.zeros(0, bool), np.zeros(0, np.int64)
    hashes = window_hashes(mix(codes.astype(np.uint64) + np.uint64(1)), WIDTH)[starts]
    order, group = equal_windows(codes, starts, hashes, WIDTH)
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    least = np.minimum.reduceat(owner[order], heads)
    covered, alike = np.zeros(len(starts), bool), np.zeros(len(starts), np.int64)
    covered[order] = owner[order] > least[group]
    alike[order] = np.bincount(group)[group]
    return covered, alike


def _count(blocks: list[bytes]) -> pa.RecordBatch | None:
    """Covered word ranges of one bucket."""
    parts = [_unpack(b) for b in blocks]
    ids, tags, begin, n = (np.concatenate([p[k] for p in parts]) for k in range(4))
    if not len(ids):
        return None
    texts = pa.array([p[4] for p in parts], pa.binary()).cast(pa.string())
    words = split_words(texts)
    size = n + WIDTH - 1
    first = np.cumsum(size) - size
    starts = np.repeat(first, n) + runs(n)
    at = np.flatnonzero(_covered(words.codes, starts, np.repeat(ids, n))[0])
    if not len(at):
        return None
    run = np.repeat(np.arange(len(n)), n)
    new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (run[at[1:]] != run[at[:-1]])])
    head = at[new]
    last = at[np.append(np.flatnonzero(new)[1:], len(at)) - 1]
    k = run[head]
    lo = begin[k] + (starts[head] - first[k])
    return _ranges(ids[k], tags[k], lo, lo + (last - head) + WIDTH)


def _count_in_parts(blocks: list[bytes], parts: int) -> Iterator[pa.RecordBatch]:
    """As _count, for a bucket of many windows: each part takes those of some hashes, so equal ones stay together, and unpacks one block at a time."""
    vocab: dict[str, int] = {}
    for part in range(parts):
        held: list[tuple[np.ndarray, ...]] = []
        for block in blocks:
            ids, tags, begin, n, text = _unpack(zstandard.ZstdDecompressor().decompress(block))
            words = split_words(pa.array([text], pa.binary()).cast(pa.string()))
            codes = np.array([vocab.setdefault(w, len(vocab)) for w in words.vocab.to_pylist()], np.int64)[words.codes]
            size = n + WIDTH - 1
            first = np.cumsum(size) - size
            starts = np.repeat(first, n) + runs(n)
            hashes = window_hashes(mix(codes.astype(np.uint64) + np.uint64(1)), WIDTH)[starts]
            mine = np.flatnonzero((hashes >> np.uint64(40)) % np.uint64(parts) == part)
            run = np.repeat(np.arange(len(n)), n)[mine]
            held.append((codes[starts[mine][:, None] + np.arange(WIDTH)].astype(np.int32), ids[run], tags[run], begin[run] + starts[mine] - first[run]))
        codes, ids, tags, lo = (np.concatenate([h[k] for h in held]) for k in range(4))
        at = np.flatnonzero(_covered(codes.ravel().astype(np.int64), np.arange(len(ids)) * WIDTH, ids)[0])
        if len(at):
            yield _ranges(ids[at], tags[at], lo[at], lo[at] + WIDTH)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks, sorted by bucket, to covered ranges; one bucket is held at a time, packed until it is known how large it is."""
    held: list[bytes] = []
    now, size = None, 0

    def counted() -> Iterator[pa.RecordBatch]:
        if size > 2 * WINDOWS:
            yield from _count_in_parts(held, -(-size // WINDOWS))
        elif held and (out := _count([zstandard.ZstdDecompressor().decompress(b) for b in held])) is not None:
            yield out

    for batch in batches:
        for bucket, n, block in zip(*[batch.column(c).to_pylist() for c in ("bucket", "n", "block")]):
            if bucket != now and held:
                yield from counted()
                held, size = [], 0
            now = bucket
            if n:
                held.append(block)
                size += n
            else:  # ranges that were known at once
                raw = zstandard.ZstdDecompressor().decompress(block)
                k = -int(np.frombuffer(raw, np.int64, 1)[0])
                at, cols = 8, []
                for kind in (np.int64, np.int64, np.int32, np.int32):
                    cols.append(np.frombuffer(raw, kind, k, at))
                    at += k * np.dtype(kind).itemsize
                yield _ranges(*cols)
    yield from counted()


def covered_ranges(docs: DataFrame) -> DataFrame:
    """(id, tag, lo, hi): word ranges of documents (id long, tag long, text) that a smaller id's windows cover."""
    total, hot = plan_of(docs)
    n_buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // WINDOWS))
    blocks = docs.mapInArrow(lambda it: _spread(it, n_buckets, hot), "bucket int, n long, block binary")
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_buckets // 16)
    return blocks.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_gather, "id long, tag long, lo int, hi int")


def _cut(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in row_slices(whole, "text"):
            n_words, n_removed, digest, kept_text = [], [], [], []
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist()):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                left, at = [], 0
                for r in sorted(ranges or (), key=lambda r: r["lo"]):
                    if r["lo"] > at:
                        left += words[at : r["lo"]]
                    at = max(at, r["hi"])
                left = left + words[at:] if at else words
                line = b" ".join(left)
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                digest.append(hashlib.sha256(line).hexdigest())
                if with_text:
                    kept_text.append(line.decode("utf-8", "surrogatepass"))
            columns = [batch.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(kept_text, pa.string())] * with_text], names=["id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text])


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per document row: n_words, n_removed, kept_sha256, and with `with_text` kept_text (kept words joined by one space).

    A word goes if a window of 13 words over it also starts in a document with a smaller id. Each text is cut into
    super-k-mers, which are dealt by their minimiser: a window and its equals always meet in one bucket. There are as
    many buckets as the windows, counted first, ask for; windows of a hot minimiser are dealt by a longer one. A slice
    of texts sends a passage that repeats in it once, for its smallest document (the others are settled there), and so a
    window that is frequent in it, whatever stands around that: a passage that very many documents share arrives as often
    as there are slices, not documents. A bucket sorts its
    windows, compares neighbours word by word, and gives only the covered ranges back, which are joined to the texts; a
    bucket that is too large all the same is sorted in parts.

    Null or empty texts: no words, digest of the empty string. A null id neither removes nor loses words. Rows that
    share an id are judged each by its own text and never against each other. Repeats inside one document stay. A text
    of any length is one row, worked on by itself. Other columns are left out; no documents give no rows.
    """
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # ids that repeat need their texts told apart; where none does, the mark costs nothing
    repeats = rows.where(F.col("id").isNotNull()).groupBy("id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    rows = rows.withColumn("tag", F.xxhash64("text") if repeats else F.lit(0).cast("long"))
    found = covered_ranges(rows.where(F.col("id").isNotNull() & (F.length("text") >= 2 * WIDTH - 1)))
    found = found.groupBy("id", "tag").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    joined = rows.join(found, ["id", "tag"], "left").select("id", "text", "ranges")
    schema = "id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return joined.mapInArrow(lambda it: _cut(it, with_text), schema).withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)
