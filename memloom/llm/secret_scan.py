"""Secret scan: fixed credential forms, and a battery of randomness tests on other tokens. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.llm._common import Stash
from memloom.functions.arrays import let
from memloom.llm._spans import apart, hits, labelled, spans, written

#: Fixed patterns of the base kinds. Runs have their least length in the pattern where that cannot change a match.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Tokens that the tests look at, and the characters that they have besides letters.
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
NO_LETTERS = "0123456789+/_-"

#: Encodings, the first that fits: name, form, alphabet.
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("hex", r"^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("hex_upper", r"^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("base32", r"^[A-Z2-7]+=*$", _UPPER + "234567"),
    ("lower", r"^[a-z0-9]+$", _DIGITS + _LOWER),
    ("upper", r"^[A-Z0-9]+$", _DIGITS + _UPPER),
    ("alphanumeric", r"^[A-Za-z0-9]+$", _DIGITS + _UPPER + _LOWER),
    ("base64", r"^[A-Za-z0-9+/]+=*$", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", r"^[A-Za-z0-9_-]+=*$", _UPPER + _LOWER + _DIGITS + "-_"),
)
#: Length classes (8 characters wide, the last open), steps of p, allowed false share.
WIDTH, CLASSES, STEPS, FALSE_SHARE = 8, 16, 100, 0.1
#: Least length of a token under test, and the lengths that prose is cut into for the null of the false-discovery control: one of each class, in turn.
LEAST = 20
LENGTHS = tuple(range(LEAST, (CLASSES + 1) * WIDTH, WIDTH))
#: Characters after which a long text is cut for its words, at the end of a word.
PIECE = 1 << 16
_P = "struct<start:bigint,end:bigint,class:int,p:double,encoding:string>"


def upper_tail(z: Column) -> Column:
    """Odds that a standard normal is above z; the classic rational approximation, good to 1e-7."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * series
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _places(letters: str) -> Column:
    """The place of each ASCII character in an alphabet, by its code; -1 for others."""
    return F.expr(f"array({','.join(f'{letters.find(chr(code))}D' for code in range(128))})")


def randomness(token: Column) -> Column:
    """struct<encoding, p>: p is how likely a random string of the token's encoding is to look as regular as it does.

    Three tests over the places of the characters in the encoding's alphabet: chi-squared for equal use of all
    characters (one-sided, by its exact mean and variance, so that short tokens do not need full cells); number of runs
    above and below the middle; correlation of neighbours. Their p-values are put together by Fisher's sum of logs.
    """
    body = F.regexp_replace(token, "=+$", "")
    kind = F.lit(None).cast("struct<encoding:string,k:double,places:array<double>,halves:string,letters:string>")
    for name, form, letters in reversed(ENCODINGS):
        halves = "l" * (len(letters) // 2) + "h" * (len(letters) - len(letters) // 2)
        kind = F.when(token.rlike(form), F.struct(F.lit(name).alias("encoding"), F.lit(float(len(letters))).alias("k"), _places(letters).alias("places"), F.lit(halves).alias("halves"), F.lit(letters).alias("letters"))).otherwise(kind)
    state = F.struct(kind.alias("kind"), body.alias("body"))

    # stage by stage, so that each figure is worked out once
    def read(s: Column) -> Column:
        kind, chars = s["kind"], F.split(s["body"], "")
        place = lambda c: F.coalesce(F.get(kind["places"], F.ascii(c)), F.lit(-1.0))
        # tokens of an encoding are ASCII, so octets are characters
        often = lambda c: (F.octet_length(s["body"]) - F.octet_length(F.replace(s["body"], c, F.lit("")))).cast("double")  # noqa: E731  how often a character stands there
        sides = F.coalesce(F.call_function("translate", s["body"], kind["letters"], kind["halves"]), F.lit(""))
        used = F.transform(F.array_distinct(chars), lambda c: F.struct(often(c).alias("n"), place(c).alias("at")))
        return F.struct(kind["encoding"].alias("encoding"), F.coalesce(kind["k"], F.lit(0.0)).alias("k"), F.length(s["body"]).cast("double").alias("n"), sides.alias("sides"), used.alias("used"), F.transform(chars, place).alias("v"))

    def figures(s: Column) -> Column:
        v, zero = s["v"], F.lit(0.0)
        sides = lambda x: ((F.octet_length(s["sides"]) - F.octet_length(F.replace(s["sides"], F.lit(x), F.lit("")))) / len(x)).cast("double")
        over = lambda term: F.aggregate(s["used"], zero, lambda a, c: a + term(c))  # noqa: E731  a sum over the characters, by how often each is there
        return F.struct(
            s["encoding"].alias("encoding"),
            s["k"].alias("k"),
            s["n"].alias("n"),
            over(lambda c: c["n"] * c["n"]).alias("squares"),
            sides("h").alias("high"),
            (sides("lh") + sides("hl")).alias("changes"),
            over(lambda c: c["n"] * c["at"]).alias("sum"),
            over(lambda c: c["n"] * c["at"] * c["at"]).alias("sum2"),
            F.aggregate(F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v)), lambda a, b: a * b), zero, lambda a, x: a + x).alias("lagged"),
            (v[0] + F.element_at(v, -1)).alias("ends"),
        )

    def moments(s: Column) -> Column:
        n, mean = s["n"], s["sum"] / s["n"]
        two = 2 * s["high"] * (n - s["high"])
        return F.struct(
            *[s[x].alias(x) for x in ("encoding", "k", "n", "squares", "changes")],
            two.alias("two"),
            F.sqrt(two * (two - n) / (n * n * (n - 1))).alias("spread"),
            (s["sum2"] - n * mean * mean).alias("var"),
            (s["lagged"] - mean * (2 * s["sum"] - s["ends"]) + (n - 1) * mean * mean).alias("lag"),
        )

    def battery(s: Column) -> Column:
        k, n = s["k"], s["n"]
        z_use = (k / n * s["squares"] - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        z_runs = F.when(s["spread"] > 0, (s["changes"] - s["two"] / n) / s["spread"]).otherwise(F.lit(9.0))
        z_serial = F.when(s["var"] > 1e-9, (s["lag"] / s["var"] + 1 / n) * F.sqrt(n)).otherwise(F.lit(9.0))
        return F.struct(s["encoding"].alias("encoding"), F.array(F.struct(z_use.alias("z"), F.lit(1.0).alias("sides")), F.struct(F.abs(z_runs).alias("z"), F.lit(2.0).alias("sides")), F.struct(F.abs(z_serial).alias("z"), F.lit(2.0).alias("sides"))).alias("z"))

    def tails(s: Column) -> Column:
        p = F.transform(F.transform(s["z"], lambda z: F.struct(z["sides"].alias("sides"), upper_tail(z["z"]).alias("tail"))), lambda t: F.greatest(F.least(t["sides"] * t["tail"], F.lit(1.0)), F.lit(1e-15)))
        return F.struct(s["encoding"].alias("encoding"), F.aggregate(p, F.lit(0.0), lambda a, x: a - F.log(x)).alias("logs"))

    def combined(s: Column) -> Column:
        return F.struct(s["encoding"].alias("encoding"), (F.exp(-s["logs"]) * (1 + s["logs"] + s["logs"] * s["logs"] / 2)).alias("p"))

    one = F.array(state)
    for stage in (read, figures, moments, battery, tails, combined):
        one = F.transform(one, stage)
    return one[0]


def _class(size: Column) -> Column:
    return F.least(F.floor(size / WIDTH), F.lit(CLASSES)).cast("int")


def _step(p: Column) -> Column:
    return F.least(F.floor(p * STEPS), F.lit(STEPS - 1)).cast("int")


def prose_letters(text: Column) -> Column:
    """All letters of a text but those of tokens under test. Only the words of one piece of PIECE characters (and the word it ends in) stand in an array at once."""
    word = f"[A-Za-z{NO_LETTERS}]"

    def of_piece(piece: Column) -> Column:
        words = F.filter(F.regexp_extract_all(piece, F.lit(f"{word}++"), F.lit(0)), lambda w: F.length(w) < LEAST)
        return F.translate(F.array_join(words, ""), NO_LETTERS, "")

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}{word}*+"), F.lit(0)), of_piece), "")


def plain_tokens(text: Column) -> Column:
    """Tokens that are no secrets: what the letters of a text's prose (all but tokens under test) read as when all between them is left out.

    All letters are cut into tokens, one after the other, whose lengths run through the length classes from a place that
    the text's digest sets, so that short texts fill all classes too. Fewer than LEAST letters at the end belong to the
    token before them; a text of fewer has none.
    """
    letters = prose_letters(text)
    turns, whole = len(LENGTHS), sum(LENGTHS)
    # whole rounds of all lengths; the last stretch takes what is left
    stretches = F.regexp_extract_all(letters, F.lit(f".{{{whole}}}(?=.{{{LEAST}}})|.+"), F.lit(0))
    twice = LENGTHS * 2
    sizes, starts = F.array(*map(F.lit, twice)), F.array(*[F.lit(sum(twice[:k])) for k in range(2 * turns)])

    def cut(first: Column) -> Column:
        def token(s: Column, k: Column) -> Column:
            start, size = starts[k] - starts[first], sizes[k]
            left = F.length(s) - start - size
            return F.substring(s, start + 1, F.when(left < LEAST, size + LEAST).otherwise(size))

        places = F.sequence(first, first + turns - 1)
        return F.filter(F.flatten(F.transform(stretches, lambda s: F.transform(places, lambda k: token(s, k)))), lambda t: F.length(t) >= LEAST)

    return let(F.pmod(F.xxhash64(text), F.lit(turns)).cast("int"), cut)


def p_histogram(docs: DataFrame, tokens: Column) -> DataFrame:
    """(class, step, n): how many of each row's tokens have their p in a step, by length class; one small row per pair."""
    own = lambda t: F.struct(_class(F.length(t)).alias("class"), _step(randomness(t)["p"]).alias("step"))
    return docs.select(F.explode(F.transform(tokens, own)).alias("t")).groupBy("t.class", "t.step").agg(F.count("*").alias("n"))


def bounds_of(tested: dict[tuple[int, int], int], plain: dict[tuple[int, int], int], false_share: float = FALSE_SHARE, steps: int = STEPS) -> dict[int, float]:
    """The least p of each length class at which at most `false_share` of what is flagged is expected to be plain.

    The control of Benjamini and Hochberg with the plain tokens' own p as null: were all m tested tokens plain, m * (1 +
    plain ones at or above the bound) / (1 + plain ones) of them would reach it. A class where that is too many at every
    bound, as one without secrets, or one without plain tokens to compare with, has no bound: nothing of it is flagged.
    """
    out = {}
    for size in sorted({c for c, _ in tested}):
        n, null = ([h.get((size, k), 0) for k in range(steps)] for h in (tested, plain))
        m, m_null = sum(n), sum(null)
        for k in range(steps):
            above = sum(n[k:])
            if above and m * (1 + sum(null[k:])) <= false_share * above * (1 + m_null):
                out[size] = k / steps
                break
    return out


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", false_share: float = FALSE_SHARE) -> DataFrame:
    """One row per document row: base (spans of assign, access, hex) and spans (these and `random` ones), as arrays of struct<start, rank, end, kind>.

    Tokens of 20 and more characters that touch no base span are tested for randomness, whatever they are made of. What
    is flagged is bounded by length class: the p of plain tokens, which the prose of all documents gives, tells how
    often something that is no secret looks as random, which falls with length (see bounds_of). The tables of bounds
    have one row per length class and step, whatever the data.

    Null texts count as empty; empty texts have no spans; a text of any length is one row, its work linear in its
    matches; equal places go by kind; repeated rows and ids give repeated results; other columns are left out; no
    documents give no rows. Places count code points.
    """
    stash = Stash(docs.sparkSession)
    text = F.col("_text")
    whole = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    forms = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "token": TOKEN}
    found = whole.withColumns({f"_{k}": hits(text, p) for k, p in forms.items()})
    found = found.select("_id", *[spans(text, F.col(f"_{k}"), p).alias(k) for k, p in forms.items()])
    long_enough = F.filter("assign", lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 1)) >= 12)
    found = found.select("_id", "token", labelled({"assign": long_enough, "access": F.col("access"), "hex": F.col("hex")}).alias("base"))
    found = found.withColumn("token", apart(F.col("token"), F.col("base")))

    def looked_at(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), _class(s["end"] - s["start"]).alias("class"), randomness(s["hit"]).alias("r"))

    def tested(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["class"].alias("class"), s["r"]["p"].alias("p"), s["r"]["encoding"].alias("encoding"))

    found = stash.keep(found.select("_id", "base", F.when(F.size("token") > 0, F.transform(F.transform("token", looked_at), tested)).otherwise(F.array().cast(f"array<{_P}>")).alias("tested")))
    every = found.where(F.size("tested") > 0).select(F.explode("tested").alias("t")).groupBy("t.class", _step(F.col("t.p")).alias("step")).agg(F.count("*").alias("n"))
    # at most CLASSES + 1 length classes of STEPS steps each
    seen = {(r["class"], r["step"]): r["n"] for r in every.collect()}
    plain = {(r["class"], r["step"]): r["n"] for r in p_histogram(whole.where(text != ""), plain_tokens(text)).collect()} if seen else {}
    bounds = bounds_of(seen, plain, false_share)
    extra = F.filter("tested", lambda t: t["p"] >= _bound(t["class"], bounds))
    more = F.transform(extra, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("rank"), t["end"].alias("end"), F.lit("random").alias("kind")))
    return found.select(F.col("_id").alias(id_col), "base", F.array_sort(F.concat("base", more)).alias("spans"))


def _bound(size: Column, bounds: dict[int, float]) -> Column:
    out = F.lit(2.0)
    for k, least in sorted(bounds.items()):
        out = F.when(size == k, F.lit(least)).otherwise(out)
    return out


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, digest and written form of what scan() found."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(id_col, *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")], F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
