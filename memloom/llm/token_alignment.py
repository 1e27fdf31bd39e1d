"""Cross-tokenizer alignment by lockstep vectorised merging: which tokens of two tokenizers cover the same bytes.

One numpy state vector holds, for each document of a batch (a long one is several stretches), where it stands among its
A and its B tokens. Every step links the two tokens of each state, marks a cut where both end at one byte, moves on the
pointer that ends first (or both), and drops what has come to its end.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.llm._common import Stash, carried, row_slices, runs
from memloom.llm.piece_bpe import SLICE, Encoded, Kept, by_part, pieces

#: Bytes of a stretch of a document: the most steps that a batch takes.
STRETCH = 1024
#: Bytes of documents that are aligned at once; a longer document is parted.
PART = 1 << 19
#: Pairs of ids whose counts are sent to all tasks, at most; documents' other pairs meet their counts by shuffle.
SENT_PAIRS = 1_000_000
#: Characters that the library is given as one text where its tokens end with the parts of it.
_TOGETHER = 4096
_STATE: dict[str, ByteLevel] = {}
_FOUND = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups_sha256": "string", "pairs": "array<long>", "pair_links": "array<long>"}


class ByteLevel:
    """A byte-level BPE vocabulary of the tokenizers library, and the bytes of each of its tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        # printable bytes stand for themselves, the others for the code points from 256 on, in order
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        other = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
        # the usual pattern never joins the character before a lone space to it, nor looks past it
        spec = json.loads(self.library.to_str())
        self.spaces_divide = spec["normalizer"] is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": spec["pre_tokenizer"].get("trim_offsets"), "use_regex": True}
        self.blank = np.fromiter((unicodedata.category(chr(c))[0] in "ZC" for c in range(0x110000)), bool, 0x110000)
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.surface = np.full(max(vocab.values()) + 1, b"", object)
        for token, i in vocab.items():
            self.surface[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.lengths = np.array([len(x) for x in self.surface], np.int64)
        self.kept = Kept(self._parts)

    def encode(self, texts: pa.Array) -> Encoded:
        """Ids of each text (none null)."""
        return by_part(texts, self._starts_at, self.kept)

    def _starts_at(self, chars: np.ndarray) -> np.ndarray:
        """Lone spaces between two characters that are none."""
        cut = np.zeros(len(chars), bool)
        if self.spaces_divide:
            plain = ~self.blank[chars]
            cut[1:-1] = (chars[1:-1] == 0x20) & plain[:-2] & plain[2:]
        return cut

    def _parts(self, parts: list[str]) -> Encoded:
        """Ids of each part. Those from a lone space to a character that is no blank can stand in one text: tokens end where they do."""
        joins = [self.spaces_divide and len(p) > 1 and p[0] == " " and not self.blank[ord(p[1])] and not self.blank[ord(p[-1])] for p in parts]
        together, size = [[]], 0
        for p, ok in zip(parts, joins):
            if ok:
                if size > _TOGETHER:
                    together.append([])
                    size = 0
                together[-1].append(p)
                size += len(p)
        listed = [e.ids for e in self.library.encode_batch_fast(["".join(x) for x in together], add_special_tokens=False)]
        alone = [e.ids for e in self.library.encode_batch_fast([p for p, ok in zip(parts, joins) if not ok], add_special_tokens=False)]
        joined = np.array(joins, bool)
        ids = np.array([i for x in listed for i in x], np.int64)
        ends = np.cumsum([len(p.encode()) for p, ok in zip(parts, joins) if ok])
        n = np.zeros(len(parts), np.int64)
        up_to = np.searchsorted(np.cumsum(self.lengths[ids]), ends, "right")
        n[joined] = np.diff(up_to, prepend=0)
        n[~joined] = [len(x) for x in alone]
        out, starts = np.empty(int(n.sum()), np.int64), np.cumsum(n) - n
        for mask, values in ((joined, ids), (~joined, np.array([i for x in alone for i in x], np.int64))):
            out[np.repeat(starts[mask], n[mask]) + runs(n[mask])] = values
        return Encoded(out, np.concatenate([[0], np.cumsum(n)]))


def byte_level(vocab: str) -> ByteLevel:
    if vocab not in _STATE:
        import public_tokenizers

        _STATE[vocab] = ByteLevel(vocab if "/" in vocab else public_tokenizers.path(vocab))
    return _STATE[vocab]


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, doc_ends: np.ndarray, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links (places of an A and a B token that share a byte) and cuts (places of the A and the B token that end together).

    Ends are byte places of tokens that lie one after the other, those of all documents counted through; at each of
    doc_ends an A and a B token end.
    """
    doc_starts = np.concatenate([[0], doc_ends[:-1]])
    n = -(-(doc_ends - doc_starts) // stretch)
    wished = np.repeat(doc_starts, n) + runs(n) * stretch
    # a state starts where an A or a B token does; a stretch starts with the first state from its place on
    stops = np.concatenate([[0], doc_ends])
    at = [np.concatenate([[0], e])[np.searchsorted(np.concatenate([[0], e]), wished)] for e in (a_ends, b_ends)]
    start = np.unique(np.minimum(*at))
    start = start[~np.isin(start, doc_ends) | np.isin(start, doc_starts)]
    stop = np.append(start[1:], stops[-1]) if len(start) else start
    a, b = np.searchsorted(a_ends, start, "right"), np.searchsorted(b_ends, start, "right")
    links_a, links_b, cuts_a, cuts_b = [], [], [], []
    while len(a):
        end_a, end_b = a_ends[a], b_ends[b]
        links_a.append(a)
        links_b.append(b)
        cut = end_a == end_b
        cuts_a.append(a[cut])
        cuts_b.append(b[cut])
        a, b = a + (end_a <= end_b), b + (end_b <= end_a)
        live = np.minimum(end_a, end_b) < stop
        if not live.all():
            a, b, stop = a[live], b[live], stop[live]
    none = [np.zeros(0, np.int64)]
    return tuple(np.concatenate(x or none) for x in (links_a, links_b, cuts_a, cuts_b))


class Spelling:
    """Decimal digits of all ids below n."""

    def __init__(self, n: int):
        self.width = len(str(max(n - 1, 1)))
        text = np.array([str(i).ljust(self.width) for i in range(n)], f"S{self.width}")
        self.digits = text.view(np.uint8).reshape(n, self.width)
        self.lengths = (self.digits != 0x20).sum(axis=1)

    def groups(self, ids: np.ndarray, group: np.ndarray, side: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[bytes, np.ndarray]:
        """`a,a|b;a|b,b` of each document, one after the other, and where each starts: ids are in order of group, then side."""
        out = np.empty((len(ids), self.width + 1), np.uint8)
        out[:, : self.width] = self.digits[ids]
        out[:, self.width] = 0
        same_doc, same_group = doc[1:] == doc[:-1], group[1:] == group[:-1]
        sep = np.where(same_group, np.where(side[1:] == side[:-1], ord(","), ord("|")), ord(";"))
        out[:-1, self.width] = np.where(same_doc, sep, 0)
        keep = np.arange(self.width + 1) < self.lengths[ids][:, None]
        keep[:, self.width] = out[:, self.width] != 0
        return out[keep].tobytes(), np.concatenate([[0], np.cumsum(np.bincount(doc, keep.sum(axis=1), n_docs).astype(np.int64))])


class _Found(NamedTuple):
    """What a part's documents have: numbers and, for each, a stretch of the spelled groups, of the pairs, and its links (places of tokens)."""

    n_groups: np.ndarray
    n_links: np.ndarray
    text: bytes
    text_at: np.ndarray
    pairs: np.ndarray
    pair_links: np.ndarray
    pairs_at: np.ndarray
    link_doc: np.ndarray
    links_a: np.ndarray
    links_b: np.ndarray


class Aligner:
    """Aligns the texts of a slice with the worker's two tokenizers."""

    def __init__(self, vocab_a: str, model_b: str):
        self.a, self.b = byte_level(vocab_a), pieces(model_b)
        self.lengths_a, self.lengths_b = (np.array([len(x) for x in t.surface], np.int64) for t in (self.a, self.b))
        self.spelling = Spelling(max(len(self.lengths_a), len(self.lengths_b)))

    def align(self, texts: list[str | None], with_links: bool = False) -> dict[str, pa.Array]:
        total = len(texts)
        rows = [k for k, t in enumerate(texts) if t]
        spaced = [" " + texts[k] for k in rows]
        a = self.a.encode(pa.array(spaced, pa.string()))
        b = self.b.encode(pa.array([t[1:] for t in spaced], pa.string()))
        n = {c: np.zeros(total, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links", "pairs")}
        digest, spelled = [""] * total, [""] * total
        hashes: dict[int, object] = {}
        pairs, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        links: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in texts]
        own_pairs: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in texts]
        for part in self._parts(rows, spaced, a, b):
            at = np.array([p[0] for p in part], np.int64)
            found = self._aligned([a.ids[p[1] : p[2]] for p in part], [b.ids[p[3] : p[4]] for p in part])
            np.add.at(n["n_a"], at, [p[2] - p[1] for p in part])
            np.add.at(n["n_b"], at, [p[4] - p[3] for p in part])
            np.add.at(n["n_groups"], at, found.n_groups)
            np.add.at(n["n_links"], at, found.n_links)
            view, places, cuts = memoryview(found.text), found.text_at.tolist(), found.pairs_at.tolist()
            for j, k in enumerate(at.tolist()):
                if k not in hashes:
                    hashes[k] = hashlib.sha256()
                else:  # a long text goes on
                    hashes[k].update(b";")
                    spelled[k] += ";" * with_links
                hashes[k].update(view[places[j] : places[j + 1]])
                own_pairs[k].append((found.pairs[cuts[j] : cuts[j + 1]], found.pair_links[cuts[j] : cuts[j + 1]]))
                if with_links:
                    spelled[k] += found.text[places[j] : places[j + 1]].decode()
                    mine = found.link_doc == j
                    first = (part[j][1] - part[j][5], part[j][3] - part[j][6])
                    links[k].append((found.links_a[mine] + first[0], found.links_b[mine] + first[1]))
        for k, held in enumerate(own_pairs):
            if not held:
                continue
            if len(held) > 1:
                pair, inverse = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
                held = [(pair, np.bincount(inverse, np.concatenate([c for _, c in held]), len(pair)).astype(np.int64))]
            pairs.append(held[0][0])
            counts.append(held[0][1])
            n["pairs"][k] = len(held[0][0])
            digest[k] = hashes[k].hexdigest()
        of_pairs = pa.array(np.concatenate([[0], np.cumsum(n.pop("pairs"))]).astype(np.int32))
        out = {k: pa.array(v) for k, v in n.items()} | {
            "groups_sha256": pa.array(digest, pa.string()),
            "pairs": pa.ListArray.from_arrays(of_pairs, pa.array(np.concatenate(pairs))),
            "pair_links": pa.ListArray.from_arrays(of_pairs, pa.array(np.concatenate(counts))),
        }
        if with_links:
            listed = [[{"a": int(x), "b": int(y)} for la, lb in part for x, y in sorted(zip(la, lb))] for part in links]
            out |= {"groups": pa.array(spelled, pa.string()), "links": pa.array(listed, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))}
        return out

    def _parts(self, rows: list[int], spaced: list[str], a: Encoded, b: Encoded) -> Iterator[list[tuple[int, ...]]]:
        """Documents whose tokens spell them, about PART bytes at a time: (row, first and last A and B token, first tokens of the document). A longer one is parted where an A and a B token end together."""
        part, size = [], 0
        for k, row, text in zip(range(len(rows)), rows, spaced):
            lo_a, hi_a, lo_b, hi_b = (int(x) for x in (a.offsets[k], a.offsets[k + 1], b.offsets[k], b.offsets[k + 1]))
            raw = text.encode()
            if any(b"".join(t.surface[x.ids[lo:hi]].tolist()) != raw for t, x, lo, hi in ((self.a, a, lo_a, hi_a), (self.b, b, lo_b, hi_b))):
                continue
            if size and size + len(raw) > PART:
                yield part
                part, size = [], 0
            if len(raw) <= PART:
                part.append((row, lo_a, hi_a, lo_b, hi_b, lo_a, lo_b))
                size += len(raw)
                continue
            ends_a, ends_b = np.cumsum(self.lengths_a[a.ids[lo_a:hi_a]]), np.cumsum(self.lengths_b[b.ids[lo_b:hi_b]])
            both = np.intersect1d(ends_a, ends_b, assume_unique=True)
            stops = both[np.unique(np.minimum(np.searchsorted(both, np.arange(PART, len(raw) + PART, PART)), len(both) - 1))]
            at_a, at_b = lo_a + np.searchsorted(ends_a, stops) + 1, lo_b + np.searchsorted(ends_b, stops) + 1
            for p, q, u, v in zip([lo_a, *at_a.tolist()], at_a.tolist(), [lo_b, *at_b.tolist()], at_b.tolist()):
                yield [(row, p, q, u, v, lo_a, lo_b)]
        if part:
            yield part

    def _aligned(self, listed_a: list[np.ndarray], listed_b: list[np.ndarray]) -> _Found:
        """Documents, given by their tokens' ids, in lockstep."""
        m = len(listed_a)
        n_a, n_b = (np.array([len(x) for x in listed]) for listed in (listed_a, listed_b))
        ids_a, ids_b = np.concatenate(listed_a).astype(np.int64), np.concatenate(listed_b).astype(np.int64)
        a_ends, b_ends = np.cumsum(self.lengths_a[ids_a]), np.cumsum(self.lengths_b[ids_b])
        links_a, links_b, cuts_a, cuts_b = lockstep(a_ends, b_ends, a_ends[np.cumsum(n_a) - 1])
        doc_a, doc_b = np.repeat(np.arange(m), n_a), np.repeat(np.arange(m), n_b)
        # the distinct linked pairs of ids of each document, and how many links each stands for
        base = len(self.lengths_b)
        span = len(self.lengths_a) * base
        keys, n_each = np.unique(doc_a[links_a] * span + ids_a[links_a] * base + ids_b[links_b], return_counts=True)
        pair = keys % span
        # groups: tokens in order of their group, A before B
        group = np.concatenate([self._group(len(ids_a), cuts_a), self._group(len(ids_b), cuts_b)])
        side = np.repeat([0, 1], [len(ids_a), len(ids_b)])
        order = np.argsort(group * 2 + side, kind="stable")
        text, at = self.spelling.groups(np.concatenate([ids_a, ids_b])[order], group[order], side[order], np.concatenate([doc_a, doc_b])[order], m)
        link_doc = doc_a[links_a]
        return _Found(
            np.bincount(doc_a[cuts_a], minlength=m),
            np.bincount(link_doc, minlength=m),
            text,
            at,
            pair // base << 32 | pair % base,
            n_each.astype(np.int64),
            np.searchsorted(keys // span, np.arange(m + 1)),
            link_doc,
            links_a - (np.cumsum(n_a) - n_a)[link_doc],
            links_b - (np.cumsum(n_b) - n_b)[link_doc],
        )

    @staticmethod
    def _group(n: int, cuts: np.ndarray) -> np.ndarray:
        """Group number of each token: how many cuts there are before it."""
        ends = np.zeros(n + 1, np.int64)
        ends[cuts + 1] = 1
        return np.cumsum(ends[:-1])


def align(docs: DataFrame, *, text_col: str = "text", vocab_a: str = "byte_bpe_50k.json", model_b: str = "piece_bpe_32k.model", with_links: bool = False, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document row: the columns of `carry`, n_a and n_b (tokens), n_groups, n_links, groups_sha256, pairs (the distinct linked id pairs, a * 2**32 + b) and pair_links (links of each pair).

    A encodes a space and the text, B the text, to which it adds the space itself. Groups are the tokens between bytes
    at which both end, spelled `a1,a2|b1;a3|b2,b3`; with `with_links` also that string (groups) and all links, as
    places of tokens from 0. Null and empty texts, and texts that either tokenizer's tokens do not spell, have no
    tokens: zeros, empty arrays, groups_sha256 ''. Repeated rows and ids stay as they are; other columns are left out,
    a carried one of an output's name gets `_in`; no documents give no rows. A text of any length is one row, walked
    through in stretches of STRETCH bytes at once.
    """
    names = _FOUND | ({"groups": "string", "links": "array<struct<a:int,b:int>>"} if with_links else {})
    through = carried(carry, names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Aligner(vocab_a, model_b)
        for whole in batches:
            for batch in row_slices(whole, "_text", SLICE):
                found = machine.align(batch.column("_text").to_pylist(), with_links)
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in through], *[found[k] for k in names]], names=[*[name for _, name in through.values()], *names])

    fields = T.StructType([T.StructField(name, docs.schema[c].dataType) for c, name in through.values()])
    schema = T.StructType([*fields, *[T.StructField(k, T._parse_datatype_string(v)) for k, v in names.items()]])
    return docs.select(*[F.col(c).alias(k) for k, (c, _) in through.items()], F.col(text_col).alias("_text")).mapInArrow(work, schema)


def pair_counts(aligned: DataFrame, stash: Stash) -> DataFrame:
    """For each linked pair of ids: n_docs, how many documents hold it linked, and best, whether that is its A id's highest."""
    counts = stash.keep(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n_docs")))
    a = F.shiftright("pair", 32).alias("a")
    # one row for each id of A's vocabulary at most
    highest = counts.groupBy(a).agg(F.max("n_docs").alias("most"))
    return counts.withColumn("a", a).join(F.broadcast(highest), "a").select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def link_scores(aligned: DataFrame, *, sent_pairs: int = SENT_PAIRS) -> DataFrame:
    """Rows of align() with n_best (links whose count is their A id's highest in all documents, ties included) and count_sum (counts summed over links), without the pairs.

    A pair's count is the number of document rows that hold it linked, however often. The counts of the commonest
    pairs, `sent_pairs` at most, go to all tasks; rarer pairs meet theirs by a shuffle, in which no pair is hot.
    """
    stash = Stash(aligned.sparkSession)
    held = [c for c in aligned.columns if c not in ("pairs", "pair_links")]
    own = {f"_own{k}": c for k, c in enumerate(held)}
    rows = stash.keep(aligned.select(*[F.col(c).alias(k) for k, c in own.items()], "pairs", "pair_links").withColumn("_row", F.monotonically_increasing_id()))
    counts = stash.keep(pair_counts(rows, stash))
    least = _least_sent(counts, sent_pairs)
    links = rows.select("_row", F.explode(F.arrays_zip("pairs", "pair_links")).alias("x")).select("_row", F.col("x.pairs").alias("pair"), F.col("x.pair_links").alias("n"))
    sums = [F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("n_docs")).alias("count_sum")]
    sent = counts.where(F.col("n_docs") >= least)
    met = links.join(F.broadcast(sent), "pair").groupBy("_row").agg(*sums)
    if least > 1:
        rare = links.join(F.broadcast(sent.select("pair")), "pair", "left_anti").join(counts.where(F.col("n_docs") < least), "pair")
        met = met.unionByName(rare.groupBy("_row").agg(*sums)).groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    found = rows.drop("pairs", "pair_links").join(met, "_row", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    stash.only(rows, counts)
    return found.select(*[F.col(k).alias(c) for k, c in own.items()], *zero)


def _least_sent(counts: DataFrame, most: int) -> int:
    """The least power of two that at most `most` pairs reach with their counts: 64 sums tell."""
    level = F.floor(F.log2(F.col("n_docs") + F.lit(0.5))).cast("int").alias("level")
    n = {r.level: r.n for r in counts.groupBy(level).agg(F.count("*").alias("n")).collect()}
    reached = 0
    for k in range(max(n, default=0), -1, -1):
        reached += n.get(k, 0)
        if reached > most:
            return 2 ** (k + 1)
    return 1
