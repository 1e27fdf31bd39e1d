"""Token counts by prefix dynamic programming: the exact count at every prefix of a text, kept so that no text is encoded again.

The dynamic programme runs over the bytes of a pre-token. The encoding of a prefix ends in some token; what stands before
that token is itself the encoding of a shorter prefix, and two neighbouring tokens are right exactly if encoding them
alone gives them back. So each prefix looks for its one last token that agrees with the last token of the prefix before
it, and its count is that prefix's count and one. The tokens that close a word are those of the vocabulary's word ends.
"""

from __future__ import annotations

import json
import os
import unicodedata
from array import array
from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.llm._common import row_slices, runs, split_words

#: Letters of pre-tokens, and of words, whose counts a worker keeps (some 15 times as many bytes); beyond it the store starts anew.
STORE = 16 << 20
#: Neighbours that a worker remembers to agree or not.
PAIRS = 2_000_000
#: Pre-tokens whose prefixes are not pre-tokens: the vocabulary's English endings.
_ENDINGS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: Words that lower-casing by letter and composed forms leave as long as they are: ASCII, Latin and Cyrillic letters.
_SIMPLE = regex.compile(r"[\x21-\x7E\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u0148\u014A-\u017E\u0401\u0410-\u044F\u0451]+")
_STATE: dict[str, Counter] = {}


class Counter:
    """Counts at every prefix of a word, for one vocabulary of the kind named below."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer
        from tokenizers.pre_tokenizers import Split

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.pattern = _checked(spec)
        self.split = Split(Regex(self.pattern.pattern), "removed", invert=True)  # the library's own reading of the pattern
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.end = spec["model"]["end_of_word_suffix"]
        # what a string can be: a token inside a word (1), one that closes it (2), or both
        self.kinds: dict[str, int] = {}
        for t in spec["model"]["vocab"]:
            body = t.removesuffix(self.end)
            self.kinds[body] = self.kinds.get(body, 0) | (1 if body == t else 2)
        self.longest = max(map(len, self.kinds))
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): k for k, m in enumerate(spec["model"]["merges"])}
        self.letters = _byte_letters()
        self.agree: tuple[dict, dict] = ({}, {})
        self.endings = {part: bytes([0, *self._encoded([part[:k] for k in range(1, len(part) + 1)])]) for part in _ENDINGS}
        self.pieces: dict[str, Sequence[int]] = dict(self.endings)
        self.totals: dict[str, int] = {}
        self.size = self.known = 0

    def _merged(self, symbols: list[str]) -> list[str]:
        """Byte-pair encoding of a few symbols, merge by merge."""
        while len(symbols) > 1:
            k = min(range(len(symbols) - 1), key=lambda i: (self.rank.get((symbols[i], symbols[i + 1]), 1 << 60), i))
            if (symbols[k], symbols[k + 1]) not in self.rank:
                break
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
        return symbols

    def _agrees(self, a: str, b: str, closing: bool) -> bool:
        """Whether two neighbours ('' for none) stand as they are when encoded; for PAIRS of them the answer is kept."""
        known = self.agree[closing]
        if len(known) > PAIRS:
            known.clear()
        end = self.end if closing else ""
        merged = self._merged([*a, *b[:-1], b[-1] + end])
        known[a, b] = found = merged == ([a, b + end] if a else [b + end])
        return found

    def piece(self, s: str) -> list[int]:
        """Tokens of each prefix of a pre-token, given as letters for bytes; [0] is 0."""
        n, kind, (inside, closing) = len(s), self.kinds.get, self.agree
        last, inner, out = [""] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            wanted = 3 if i < n else 2
            for j in range(max(0, i - self.longest), i):
                t = s[j:i]
                if not (can := kind(t, 0) & wanted):
                    continue
                pair = (last[j], t)
                if can & 1:
                    if (ok := inside.get(pair)) is None:
                        ok = self._agrees(*pair, False)
                    if ok:
                        last[i], inner[i] = t, inner[j] + 1
                        wanted &= 2
                if can & 2:
                    if (ok := closing.get(pair)) is None:
                        ok = self._agrees(*pair, True)
                    if ok:
                        out[i] = inner[j] + 1
                        wanted &= 1
                if not wanted:
                    break
        return out

    def _encoded(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _of_piece(self, part: str) -> Sequence[int]:
        """Tokens of each prefix of a pre-token, by code points."""
        if part.isascii() and part.isprintable():
            counts = self.piece(part)
        else:
            raw = [c.encode() for c in part]
            by_byte = self.piece("".join(self.letters[b] for c in raw for b in c))
            counts = [0, *[by_byte[e] for e in accumulate(map(len, raw))]]
        found = bytes(counts) if len(part) < 256 else array("i", counts)
        if len(part) < STORE >> 3:
            if self.size > STORE:
                self.pieces, self.size = dict(self.endings), 0
            self.pieces[part] = found
            self.size += len(part) + 8
        return found

    def _cut(self, word: str) -> tuple[str, list[tuple[int, int]] | None]:
        """The word lower-cased and its pre-tokens' places; None if it is the library's to read, prefix by prefix: special strings, and normalisation that moves characters."""
        low = word.lower()
        if any(t in word for t in self.special):
            return low, None
        if _SIMPLE.fullmatch(word):
            return low, [m.span() for m in self.pattern.finditer(low)]
        if len(low) == len(word) and unicodedata.is_normalized("NFC", word) and self.library.normalizer.normalize_str(word) == low:
            return low, [at for _, at in self.split.pre_tokenize_str(low)]
        return low, None

    def word(self, word: str) -> array:
        """Tokens of word[:k] for each k, by code points."""
        low, places = self._cut(word)
        if places is None:
            return array("i", [0, *self._encoded([word[:k] for k in range(1, len(word) + 1)])])
        out = array("i", [0])
        for lo, hi in places:
            done = out[-1]
            out.extend([done] * (lo + 1 - len(out)))
            part = low[lo:hi]
            out.extend([done + n for n in (self.pieces.get(part) or self._of_piece(part))[1:]])
        out.extend([out[-1]] * (len(word) + 1 - len(out)))
        return out

    def total(self, words: list[str]) -> np.ndarray:
        """Tokens of each whole word, the last of its counts; words that this worker has met are looked up."""
        if self.known > STORE:
            self.totals, self.known = {}, 0
        out = []
        for w in words:
            if (n := self.totals.get(w)) is None:
                low, places = self._cut(w)
                if places is None:
                    n = self._encoded([w])[0]
                else:
                    n = 0
                    for lo, hi in places:
                        part = low[lo:hi]
                        n += (self.pieces.get(part) or self._of_piece(part))[-1]
                if len(w) < STORE >> 3:
                    self.totals[w] = n
                    self.known += len(w) + 8
            out.append(n)
        return np.array(out, np.int64)


def _checked(spec: dict) -> regex.Pattern:
    """The pre-tokens' pattern of a vocabulary whose counts add up over words; others are an error."""
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    model = spec["model"]
    fits = (
        model.get("type") == "BPE"
        and model.get("end_of_word_suffix")
        and not model.get("dropout")
        and not model.get("ignore_merges")
        and len(pre) == 2
        and (pre[0].get("type"), pre[0].get("behavior"), pre[0].get("invert")) == ("Split", "Removed", True)
        and pre[1].get("type") == "ByteLevel"
        and not pre[1].get("add_prefix_space")
        and [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        and not any(regex.search(r"\s", t["content"]) for t in spec["added_tokens"])
    )
    pattern = pre[0].get("pattern", {}).get("Regex", "") if fits else ""
    if not fits or regex.search(pattern, " \t\n\r\x0b\x0c") or not pattern.startswith("|".join(_ENDINGS)):
        raise ValueError("counts are kept for word-end BPE that drops white space, as in word_bpe_49k.json; this vocabulary is of another kind")
    return regex.compile(pattern)


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else the next one from 256 on."""
    printing = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in printing else chr(next(others)) for b in range(256)]


def counter(name_or_path: str) -> Counter:
    """One per worker and vocabulary."""
    if name_or_path not in _STATE:
        _STATE[name_or_path] = Counter(vocabulary(name_or_path))
    return _STATE[name_or_path]


def vocabulary(name_or_path: str) -> str:
    """A path as it is; a file name as the installed package of public vocabularies places it, on whatever machine asks."""
    if os.path.sep in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def _by_character(text: str, offsets: tuple[int, int], codes: np.ndarray, tables: list[array]) -> np.ndarray:
    """Counts at each of the len(text) + 1 prefixes of a text of the words codes[lo:hi]."""
    out = np.zeros(len(text) + 1, np.int64)
    done, at = 0, 0
    for m, k in zip(regex.finditer(r"[^\x20\x09-\x0D]+", text), codes[offsets[0] : offsets[1]].tolist()):
        own = np.frombuffer(tables[k], np.int32)
        out[at : m.start() + 1] = done
        out[m.start() : m.end() + 1] = done + own
        done, at = done + int(own[-1]), m.end()
    out[at:] = done
    return out


def token_prefixes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocab: str = "word_bpe_49k.json", budgets: tuple[int, ...] = (2048,), with_prefixes: bool = False) -> DataFrame:
    """One row per document row: n_bytes (UTF-8), n_words, n_tokens, words_within (for each budget, the whole words that fit), and with `with_prefixes` the text and the counts at each of its prefixes, by code points (prefixes[k] is the count of the first k).

    `vocab` names a vocabulary of word-end BPE kind (white space dropped; another kind is an error). Nothing crosses
    white space there, so a text's counts are running sums over its words, whose own prefixes the dynamic programme
    counts, once per worker. A null text counts as empty: all zeros; repeated rows and ids give repeated results; other
    columns are left out; no documents give no rows. A text of any length is one row of counts; slices bound the rest
    of what a task holds, and a word of any length takes time in proportion to it.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = counter(vocab)
        for whole in batches:
            for batch in row_slices(whole, "text"):
                texts = pc.fill_null(batch.column("text"), "")
                words = split_words(texts)
                vocab_here = words.vocab.to_pylist()
                own = machine.total(vocab_here)[words.codes] if vocab_here else np.zeros(0, np.int64)
                total = np.concatenate([[0], np.cumsum(own)])
                n, first = words.counts, words.offsets[:-1]
                # counts at the start and at each word's end; those of a row never fall, so what fits a budget comes first
                at = np.repeat(first, n + 1) + runs(n + 1)
                sums, starts = total[at] - np.repeat(total[first], n + 1), words.offsets + np.arange(len(words.offsets))
                fit = np.zeros((len(n), len(budgets)), np.int64)
                for k, most in enumerate(budgets):
                    ok = np.concatenate([[0], np.cumsum(sums <= most)])
                    fit[:, k] = ok[starts[1:]] - ok[starts[:-1]] - 1
                columns = [batch.column("id"), pc.cast(pc.binary_length(texts), pa.int64()), pa.array(n), pa.array(sums[starts[1:] - 1]), pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * len(budgets)), pa.array(fit.ravel()))]
                names = ["id", "n_bytes", "n_words", "n_tokens", "words_within"]
                if with_prefixes:
                    tables = [machine.word(w) for w in vocab_here]
                    rows = [_by_character(t, (lo, hi), words.codes, tables) for t, lo, hi in zip(texts.to_pylist(), words.offsets[:-1], words.offsets[1:])]
                    columns += [texts, pa.array(rows, pa.list_(pa.int64()))]
                    names += ["text", "prefixes"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, n_words long, n_tokens long, words_within array<long>" + ", text string, prefixes array<long>" * with_prefixes
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(work, schema).withColumnRenamed("id", id_col)


def tokens_at(prefixes: Column, chars: Column | int) -> Column:
    """Exact token count of a text's first `chars` code points (of all of it, if it has fewer), from its stored counts."""
    k = F.lit(chars) if isinstance(chars, int) else chars
    return F.element_at(prefixes, F.greatest(F.lit(1), F.least(k + 1, F.size(prefixes))).cast("int"))


def chars_within(prefixes: Column, budget: int) -> Column:
    """Code points of the longest start of a text whose count is `budget` tokens at most, from its stored counts."""
    fits = F.transform(prefixes, lambda n: n <= budget)
    return F.size(prefixes) - F.array_position(F.reverse(fits), True).cast("int")


def truncate_to_budget(counted: DataFrame, budget: int, *, text_col: str = "text", prefixes_col: str = "prefixes", whole_words: bool = True) -> DataFrame:
    """Rows of token_prefixes(..., with_prefixes=True) with text cut to at most `budget` tokens and n_tokens of what is left, by DataFrame functions on the stored counts.

    With `whole_words` a word that would be cut open goes, with the white space before it. A text within the budget
    stays as it is; a budget that nothing fits gives an empty text.
    """
    n = F.greatest(chars_within(F.col(prefixes_col), budget), F.lit(0))
    head = F.substring(text_col, F.lit(1), n)
    if whole_words:
        inside = F.substring(text_col, n + 1, F.lit(1)).rlike(r"[^\x20\x09-\x0D]")
        whole = F.regexp_replace(F.regexp_replace(head, r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]++$", ""), r"(?<![\x20\x09-\x0D])[\x20\x09-\x0D]++$", "")
        head = F.when(inside, whole).otherwise(head)
    out = counted.withColumn("_head", head)
    return out.withColumn("n_tokens", tokens_at(F.col(prefixes_col), F.length("_head"))).withColumn(text_col, F.col("_head")).drop("_head")
