"""Whitening, alignment and piece encoding against numpy's eigenvalues, pairs of byte ranges and the library."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from memloom.llm import piece_bpe, queries, token_alignment, whitening

DATA = "/root/testdata/sf0.01"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
PIECES = ["the", "ing", " ", "er", "a", "re", "=", "==", "    ", "\t", "\n", "é", "ж", "你", "好", "<|endoftext|>", "<s>", "<0x41>"]


def texts(n, seed, longest=400):
    rng = random.Random(seed)
    code = lambda: chr(rng.choice([rng.randint(0, 0x7F), rng.randint(0x80, 0x7FF), rng.randint(0x800, 0xD7FF), rng.randint(0x10000, 0x10FFFF)]))
    kinds = [lambda: rng.choice("ab=-\n "), lambda: rng.choice(PIECES), code]
    return ["".join(kind() for _ in range(rng.choice([1, 3, 10, 60, longest]))) for kind in (rng.choice(kinds) for _ in range(n))]


EDGES = [None, "", " ", "  ", "\x00", "▁", "a▁b", " lead", "trail ", "two  spaces", "   x", "x 　 y", "a" * 5000, "=" * 3000, " " * 2000, "ab" * 4000]


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


# --- piece encoding


def test_pieces_as_the_library(spark, library):
    rows = [(k, t) for k, t in enumerate(EDGES + texts(300, 1))]
    found = piece_bpe.encode_pieces(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r for r in found.select("doc_id", "ids", piece_bpe.decoded(F.col("ids")).alias("text")).collect()}
    for k, t in rows:
        want = library.encode(t or "", add_bos=True, add_eos=True)
        assert got[k].ids == want, repr(t)[:80]
        assert got[k].text == library.decode(want)


def test_pieces_of_long_words_take_turns_as_the_library(library):
    machine = piece_bpe.pieces("piece_bpe_32k.model")
    rng = random.Random(2)
    hard = ["".join(rng.choice(s) for _ in range(n)) for s in ("ab", " ", "= ", "-=", "aeinrst", "xX") for n in (7, 100, 511, 512, 513, 3000)]
    got = machine.encode(pa.array(hard))
    assert [got.ids[lo:hi].tolist() for lo, hi in zip(got.offsets, got.offsets[1:])] == library.encode(hard)


def test_merging_from_a_heap_is_merging_in_rounds(monkeypatch):
    machine = piece_bpe.Pieces(MODEL)
    words = [w for t in texts(200, 7) for w in t.split(" ") if w]
    rounds = machine._words(words)
    monkeypatch.setattr(piece_bpe, "LONG", 0)
    heap = machine._words(words)
    assert (rounds.ids == heap.ids).all() and (rounds.offsets == heap.offsets).all()


def test_decoding_of_any_ids(library):
    machine, rng = piece_bpe.pieces("piece_bpe_32k.model"), random.Random(3)
    kinds = [lambda: rng.randrange(32000), lambda: rng.randrange(3, 259), lambda: rng.randrange(3), lambda: 1]
    rows = [[rng.choice(kinds)() for _ in range(rng.randint(0, 12))] for _ in range(3000)]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    assert machine.decode(piece_bpe.Encoded(np.array([i for r in rows for i in r]), offsets)) == [library.decode(r) for r in rows]


def test_pieces_kept_by_a_worker_start_anew(monkeypatch, library):
    monkeypatch.setattr(piece_bpe, "KEPT_CHARS", 50)
    machine = piece_bpe.Pieces(MODEL)
    for seed in range(20):
        some = texts(10, seed)
        got = machine.encode(pa.array(some))
        assert [got.ids[lo:hi].tolist() for lo, hi in zip(got.offsets, got.offsets[1:])] == library.encode(some)


def test_pieces_columns_and_empty_table(spark):
    rows = spark.createDataFrame([(1, "a", 5, 6), (1, "a", 5, 6), (None, None, None, None)], ["doc_id", "text", "ids", "n.x"])
    got = piece_bpe.encode_pieces(rows, carry=("doc_id", "ids"), begin=False, end=False)
    assert got.columns == ["doc_id", "ids_in", "ids"] and sorted((r.doc_id or 0, r.ids) for r in got.collect()) == [(0, []), (1, [264]), (1, [264])]
    assert piece_bpe.encode_pieces(rows.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None,), ([1, 264, 2],)], "ids array<int>").select(piece_bpe.decoded(F.col("ids")).alias("t"), piece_bpe.packed(F.col("ids")).alias("p"))
    assert {(r.t, bytes(r.p) if r.p is not None else None) for r in nulls.collect()} == {(None, None), ("a", np.array([1, 264, 2], "<u4").tobytes())}


def test_op13_on_the_tables(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op13_piece_encoding(spark, DATA).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r.doc_id] or "", add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


# --- alignment


def brute_alignment(t, tokenizer, library):
    """(A ids, B ids, links, groups) of a text, by comparing all byte ranges; nothing for a text without tokens."""
    if not t:
        return [], [], [], ""
    raw = (" " + t).encode()
    a, b = tokenizer.encode(" " + t, add_special_tokens=False).ids, library.encode(t)
    surface = token_alignment.byte_level("byte_bpe_50k.json").surface
    spell = lambda i: bytes([int(library.id_to_piece(i)[3:5], 16)]) if library.is_byte(i) else library.id_to_piece(i).replace("▁", " ").encode()
    spans = []
    for parts in ([surface[i] for i in a], [spell(i) for i in b]):
        if b"".join(parts) != raw:
            return [], [], [], ""
        ends = np.cumsum([len(p) for p in parts]).tolist()
        spans.append(list(zip([0, *ends], ends)))
    links = [(i, j) for i, (p, q) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if p < v and u < q]
    groups, lo = [], 0
    for end in sorted({q for _, q in spans[0]} & {q for _, q in spans[1]}):
        groups.append("|".join(",".join(str(i) for i, (p, _) in zip(ids, span) if lo <= p < end) for ids, span in zip((a, b), spans)))
        lo = end
    return a, b, links, ";".join(groups)


def brute_scores(rows, tokenizer, library):
    aligned = [brute_alignment(t, tokenizer, library) for _, t in rows]
    docs = Counter()
    for a, b, links, _ in aligned:
        docs.update({(a[i], b[j]) for i, j in links})
    most = defaultdict(int)
    for (x, _), n in docs.items():
        most[x] = max(most[x], n)
    out = []
    for (k, _), (a, b, links, groups) in zip(rows, aligned):
        counts = [(docs[a[i], b[j]], most[a[i]]) for i, j in links]
        digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        out.append((k, len(a), len(b), groups.count(";") + bool(groups), len(links), sum(x == y for x, y in counts), sum(x for x, _ in counts), digest))
    return sorted(out, key=str)


@pytest.mark.parametrize("sent", [0, 40, 10**6])
def test_alignment_by_all_byte_ranges(spark, tokenizer, library, sent):
    rows = [(k, t) for k, t in enumerate(EDGES[:12] + texts(60, 11, 150))] + [(3, "repeated id"), (None, "no id"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = token_alignment.link_scores(token_alignment.align(docs), sent_pairs=sent).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == brute_scores(rows, tokenizer, library)


def test_links_and_groups(spark, tokenizer, library):
    rows = [(k, t) for k, t in enumerate(texts(40, 5, 100))]
    got = {r.doc_id: r for r in token_alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), with_links=True).collect()}
    for k, t in rows:
        _, _, links, groups = brute_alignment(t, tokenizer, library)
        assert [tuple(x) for x in got[k].links] == links and got[k].groups == groups


def test_long_texts_in_parts(monkeypatch, tokenizer, library):
    monkeypatch.setattr(piece_bpe, "BLOCK", 37)
    monkeypatch.setattr(token_alignment, "PART", 50)
    machine = token_alignment.Aligner("byte_bpe_50k.json", "piece_bpe_32k.model")
    some = [*EDGES[:12], *texts(60, 31, 300), " ".join(texts(10, 33, 60))]
    got = machine.align(some, with_links=True)
    for k, t in enumerate(some):
        a, b, links, groups = brute_alignment(t, tokenizer, library)
        assert [(x["a"], x["b"]) for x in got["links"][k].as_py()] == links and got["groups"][k].as_py() == groups
        assert got["groups_sha256"][k].as_py() == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        assert dict(zip(got["pairs"][k].as_py(), got["pair_links"][k].as_py())) == Counter(a[i] << 32 | b[j] for i, j in links)
        assert [got[c][k].as_py() for c in ("n_a", "n_b", "n_groups", "n_links")] == [len(a), len(b), groups.count(";") + bool(groups), len(links)]


def test_a_text_of_a_million_characters(tokenizer, library):
    rng = random.Random(4)
    some = texts(200, 41, 60)
    text = " ".join(rng.choice(some) for _ in range(60_000))[:1_000_000]
    got = piece_bpe.pieces("piece_bpe_32k.model").encode(pa.array([text]))
    assert got.ids.tolist() == library.encode(text)
    found = token_alignment.Aligner("byte_bpe_50k.json", "piece_bpe_32k.model").align([text])
    assert found["n_a"][0].as_py() == len(tokenizer.encode(" " + text, add_special_tokens=False).ids) and found["n_b"][0].as_py() == len(got.ids)


@pytest.mark.parametrize("stretch", [1, 3, 50, 10_000])
def test_stretches_change_nothing(stretch):
    rng = random.Random(stretch)
    a, b, docs, at = [], [], [], 0
    for _ in range(30):
        n = rng.randint(1, 200)
        for ends, p in ((a, 0.4), (b, 0.2)):
            ends += [at + x for x in range(1, n) if rng.random() < p] + [at + n]
        at += n
        docs.append(at)
    a, b = np.array(a), np.array(b)
    la, lb, ca, cb = token_alignment.lockstep(a, b, np.array(docs), stretch)
    span = lambda e: list(zip([0, *e.tolist()], e.tolist()))
    assert sorted(zip(la, lb)) == [(i, j) for i, (p, q) in enumerate(span(a)) for j, (u, v) in enumerate(span(b)) if p < v and u < q]
    assert sorted(a[ca]) == sorted(b[cb]) == sorted(set(a.tolist()) & set(b.tolist()))


def test_parts_are_encoded_as_in_the_whole_text(tokenizer):
    machine = token_alignment.byte_level("byte_bpe_50k.json")
    assert machine.spaces_divide
    some = [" " + t for t in EDGES + texts(400, 21) if t] + [" it's 's  's  's  x", " a   b", " 12 34's"]
    got = machine.encode(pa.array(some))
    assert [got.ids[lo:hi].tolist() for lo, hi in zip(got.offsets, got.offsets[1:])] == [e.ids for e in tokenizer.encode_batch(some, add_special_tokens=False)]


def test_alignment_of_empty_table_and_clashing_names(spark):
    rows = spark.createDataFrame([(1, "a b", 5, 6)], "doc_id long, text string, n_a int, pairs int")
    got = token_alignment.link_scores(token_alignment.align(rows, carry=("doc_id", "n_a", "pairs")))
    assert got.columns[:3] == ["doc_id", "n_a_in", "pairs_in"] and got.first().n_a_in == 5
    assert token_alignment.link_scores(token_alignment.align(rows.limit(0))).count() == 0


def test_op12_on_the_tables(spark, tokenizer, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect() if len(r.text or "") < 1500]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = token_alignment.link_scores(token_alignment.align(docs)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == brute_scores(rows, tokenizer, library)
    whole = queries.op12_token_alignment(spark, DATA)
    assert whole.count() == spark.read.parquet(f"{DATA}/documents.parquet").count() and whole.where("n_best > n_links or count_sum < n_links").count() == 0


# --- whitening


def spectra():
    rng = np.random.default_rng(1)
    low = rng.normal(size=(20, 2))
    return {
        "spread": np.cov(rng.normal(size=(40, 500)) * rng.uniform(1, 5, (40, 1))),
        "flat": np.cov(rng.normal(size=(40, 20_000))),
        "equal": np.eye(10) * 3,
        "rank two": low @ low.T,
        "ties": np.diag([5.0, 5, 5, 2, 2, 1]),
        "one": np.array([[2.0]]),
        "two": np.array([[2.0, 1], [1, 2]]),
        "wide": np.diag([1e12, 1.5, 1.0]),
        "blocks": np.kron(np.eye(4), np.array([[2.0, 1], [1, 2]])),
        "none": np.zeros((3, 3)),
    }


@pytest.mark.parametrize("name", spectra())
@pytest.mark.parametrize("k", [1, 4, 64])
def test_contour_integration_against_numpy(name, k):
    v = spectra()[name]
    want = np.sort(np.linalg.eigvalsh(v))[::-1]
    want = want[want > whitening.LEAST_SHARE * want[0]][:k] if want[0] > 0 else want[:0]
    got = whitening.feast(v, k)
    assert got.values == pytest.approx(want, rel=1e-9, abs=1e-13 * max(want, default=1))
    assert np.abs(v @ got.vectors - got.vectors * got.values).max(initial=0) <= 1e-12 * np.abs(v).max()
    assert np.abs(got.vectors.T @ got.vectors - np.eye(len(want))).max(initial=0) < 1e-12


@pytest.mark.parametrize("name", spectra())
def test_inertia_counts(name):
    v = spectra()[name]
    values = np.linalg.eigvalsh(v)
    shifts = np.concatenate([(values[1:] + values[:-1]) / 2, [values[0] - 1, values[-1] + 1]])
    shifts = shifts[np.abs(shifts[:, None] - values).min(axis=1) > 1e-9 * (1 + np.abs(values).max())]
    assert whitening.counts_above(*whitening.tridiagonal(v), shifts).tolist() == [(values > s).sum() for s in shifts]


def brute_whitening(vectors, k=4):
    x = np.array([[int(np.floor(256 * float(c))) for c in v] for v in vectors])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    v = c.T @ c / n
    values, q = np.linalg.eigh(v)
    order = np.argsort(-values)[:k]
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ (q[:, order] / np.sqrt(values[order])), values[order] / np.trace(v)


def test_op11_on_the_tables(spark):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    n, deviation, white, explained = brute_whitening(list(rows.values()))
    got = queries.op11_embedding_whitening(spark, DATA).collect()
    assert len(got) == 4 * len(rows)
    by = {(r.vec_id, r.component): r for r in got}
    sign = [np.sign(by[next(iter(rows)), c + 1].whitened * white[0, c]) for c in range(4)]
    for k, vec in enumerate(rows):
        for c in range(4):
            r = by[vec, c + 1]
            assert (r.n, r.deviation) == (n, deviation[k]) and r.explained == pytest.approx(explained[c], rel=1e-9)
            assert r.whitened * sign[c] == pytest.approx(white[k, c], rel=1e-6, abs=1e-8) and r.identity_error < 1e-9


def test_whitening_leaves_out_what_is_no_vector(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0, 3.0]), (2, [0.5, 2.0, 1.0]), (2, [0.5, 2.0, 1.0]), (None, [2.0, -1.0, 0.0]), (4, None), (5, [1.0, None, 2.0]), (6, [nan, 1.0, 1.0]), (7, [1.0, inf, 1.0]), (8, [1e300, 0.0, 0.0]), (9, [1.5])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(r.vec_id or 0 for r in got) == [0, 1, 2, 2, 9]
    n, deviation, white, explained = brute_whitening([v for _, v in rows[:4]] + [[1.5, 0.0, 0.0]], 3)
    by = {r.vec_id: r for r in got}
    assert [by[k].deviation for k in (1, 2, None, 9)] == deviation[[0, 1, 3, 4]].tolist() and got[0].n == n == 4
    assert got[0].explained == pytest.approx(explained.tolist()) and np.abs(by[1].whitened) == pytest.approx(np.abs(white[0]))


def test_whitening_without_variance_and_of_nothing(spark):
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert [(r.n, r.deviation, r.whitened, r.explained) for r in whitening.whiten(same).collect()] == [(1, 0, [], [])] * 2
    assert whitening.whiten(same.limit(0)).count() == 0
    assert [r.whitened for r in whitening.whiten(spark.createDataFrame([(1, [])], "vec_id long, embedding array<double>")).collect()] == [[]]


def test_whitening_of_large_entries_and_clashing_names(spark):
    rows = [(k, [float(2**40 * k), float(k % 3), 1.0], "x") for k in range(5)] + [(9, [float(2**54), 0.0, 0.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string")
    got = {r.vec_id: r for r in whitening.whiten(df, carry=("vec_id", "n")).collect()}
    x = [[int(256 * c) for c in v] for _, v, _ in rows]
    s = [sum(c) for c in zip(*x)]
    want = [sum((6 * c - t) ** 2 for c, t in zip(v, s)) for v in x]
    assert [got[k].deviation for k, _, _ in rows] == [w if w < 2**63 else None for w in want] and got[0].n_in == "x" and got[0].n == 6
    small = [(k, [2.0**30 + k, 2.0**20 * k]) for k in range(4)]
    got = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame(small, "vec_id long, embedding array<double>")).collect()}
    assert got == dict(enumerate(brute_whitening([v for _, v in small], 2)[1].tolist()))
