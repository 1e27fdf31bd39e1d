"""Personal data: fixed forms, and bootstrapped contextual extraction from them. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.llm._common import Stash, carried
from memloom.functions.arrays import let
from memloom.llm._spans import hits, kept_if, labelled, masked, spans, touching, written  # noqa: F401  masked: for users of find()

#: Fixed patterns of the base kinds, in forms that take linear time: possessive runs, starts only where a run starts.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?=(?:[0-9][\x20-]?){11}[0-9])[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
IP_PARTS = r"^0*(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(\.0*(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$"

#: What may be an identifier: a token with four digits or more, or with @, from its first letter, digit or plus to its last letter or digit.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
_EDGES = r"^[^A-Za-z0-9+]++|(?<![^A-Za-z0-9])[^A-Za-z0-9]++$"
#: A pattern is the two words before a token, lower-cased. It needs this many different identifiers (known, or found
#: with this confidence in an earlier round), and this share of everything that follows it in the corpus must be
#: identifiers. Neither grows with the corpus.
SUPPORT, CONFIDENCE, ROUNDS = 5, 0.7, 3
#: Patterns sent to every task at most (more are joined by shuffle).
SENT = 500_000
_WHITE = r"[\x20\x09-\x0D]+"
#: The last two words of what stands before a token, of whatever length; it is tried at starts of words only.
_LAST_TWO = r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++[\x20\x09-\x0D]++[^\x20\x09-\x0D]++)[\x20\x09-\x0D]*+$"


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of at most 19 digits passes the Luhn test."""
    n = F.length(number)

    def value(i: Column) -> Column:
        d = F.substring(number, n - i, F.lit(1)).cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _base(email: Column, ip: Column, card: Column, phone: Column) -> dict[str, Column]:
    def is_card(hit: Column) -> Column:
        return F.when(F.length(digits(hit)).between(12, 19), luhn(digits(hit))).otherwise(F.lit(False))

    return {
        "email": email,
        "ip": kept_if(ip, lambda h: h.rlike(IP_PARTS)),
        "card": kept_if(card, is_card),
        "phone": kept_if(phone, lambda h: F.length(digits(h)).between(9, 15)),
    }


def _leading(gap: Column) -> Column:
    """The last two words of what stands before a token, lower-cased; null if there are not two."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(gap, _LAST_TWO, 1)), _WHITE, " "), F.lit(""))


def _tokens(text: Column, found: Column) -> Column:
    """Possible identifiers: place and text without the marks around them, and the two words before."""
    gaps = F.split(text, TOKEN, -1)
    # a text that ends in a token has a last empty gap, which the slice leaves out
    leads = F.transform(F.slice(gaps, 1, F.size(found)), _leading)
    placed = spans(text, found, TOKEN)
    both = F.zip_with(placed, leads, lambda s, c: F.struct(s["start"].alias("start"), s["hit"].alias("hit"), c.alias("lead")))

    def trimmed(t: Column) -> Column:
        head = F.length(t["hit"]) - F.length(F.regexp_replace(t["hit"], r"^[^A-Za-z0-9+]+", ""))
        core = F.regexp_replace(t["hit"], _EDGES, "")
        return F.struct((t["start"] + head).alias("start"), (t["start"] + head + F.length(core)).alias("end"), core.alias("core"), t["lead"].alias("lead"))

    alike = lambda t: (F.regexp_count(t["core"], F.lit("[0-9]")) >= 4) | F.contains(t["core"], F.lit("@"))
    return F.filter(F.transform(both, trimmed), alike)


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Hinted for broadcast where `rows` rows, of some tens of bytes each, are few enough."""
    return F.broadcast(df) if rows <= SENT else df


def confident_patterns(tokens: DataFrame, texts: DataFrame, stash: Stash, *, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """Patterns (lead, trust) that mark identifiers, from tokens (lead, core, known) and texts (text).

    Graph of patterns and instances: an edge joins a lead to a core that follows it, with its number of occurrences.
    Instances seen as a base kind anywhere are known and score 1. Round by round, leads of `support` or more different
    instances that score `confidence` or more take part, so what one round finds lets in leads of the next; a lead's
    trust is the score of what follows it, summed over occurrences, over all occurrences of its two words in the corpus,
    whatever follows; an unknown instance scores 1 - product(1 - trust) over the taking-part leads that it follows.
    All pairs of neighbouring words are counted, with partial sums, under 64-bit names before the leads are looked up
    among them, so that no join sees a row for each occurrence (two pairs of one name would only lower a trust).

    Before any join on instances, leads go that cannot be patterns whatever the scores: those followed by fewer than
    `support` different tokens, or by tokens in less than `confidence` of their occurrences, which bounds their trust.
    They do not vouch for instances either.
    """
    edges = stash.keep(tokens.where(F.col("lead").isNotNull()).groupBy("lead", "core").agg(F.count("*").alias("n")))
    leads = stash.keep(edges.groupBy("lead").agg(F.sum("n").alias("most"), F.count("*").alias("cores")).where(F.col("cores") >= support).select("lead", "most"))
    n_leads = leads.count()
    if not n_leads:
        return leads.select("lead", F.lit(0.0).alias("trust"))
    # every two neighbouring words that another word follows, counted before anything is joined; 64-bit names keep rows short
    words = F.filter(F.split(F.lower(F.col("text")), _WHITE), lambda w: w != "")
    named = let(F.transform(words, lambda w: F.xxhash64(w)), lambda w: F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 2, F.lit(0))), lambda a, b: F.xxhash64(a, b)))
    followed = texts.where(F.col("text").isNotNull()).select(F.explode(named).alias("name")).groupBy("name").agg(F.count("*").alias("total"))
    halves = F.split("lead", " ")
    leads = leads.withColumn("name", F.xxhash64(F.xxhash64(halves[0]), F.xxhash64(halves[1])))
    able = stash.keep(followed.join(_small(leads, n_leads), "name").where(F.col("most") >= F.col("total") * confidence).select("lead", "total"))
    n_able = able.count()
    if not n_able:
        return able.select("lead", F.lit(0.0).alias("trust"))
    edges = stash.keep(edges.join(_small(able, n_able), "lead"))
    seen = tokens.where("known").select("core").distinct().withColumn("score", F.lit(1.0))
    known = stash.keep(edges.select("core").distinct().join(seen, "core", "left").select("core", F.coalesce("score", F.lit(0.0)).alias("score")))
    scores, trust = known, None
    for _ in range(rounds):
        sums = edges.join(scores, "core").groupBy("lead", "total").agg(F.sum(F.col("n") * F.col("score")).alias("mass"), F.count_if(F.col("score") >= confidence).alias("seeds"))
        trust = stash.keep(sums.where(F.col("seeds") >= support).select("lead", F.least(F.col("mass") / F.col("total"), F.lit(1.0)).alias("trust")))
        miss = edges.join(_small(trust, n_able), "lead").groupBy("core").agg(F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-9)))).alias("logs"))
        scores = known.join(miss, "core", "left").select("core", F.when(F.col("score") > 0, F.col("score")).otherwise(F.coalesce(1 - F.exp("logs"), F.lit(0.0))).alias("score"))
    return trust.where(F.col("trust") >= confidence)


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document row: base and spans (arrays of struct<start, rank, end, kind>; kinds email, ip, card, phone, context).

    Base spans by fixed forms; `context` spans are identifier-like tokens that follow a high-confidence pattern and
    touch no base span. Null texts count as empty; empty texts have none; a text of any length is one row, its work linear in its matches; equal places go by kind; repeated rows and
    ids give repeated results (and count as often as evidence occurs, but support counts different identifiers); other
    columns are left out unless `carry` names them (one of the name base or spans comes out as base_in or spans_in); no
    documents give no rows. Places count code points.
    """
    stash = Stash(docs.sparkSession)
    text = F.col("_text")
    through = carried([id_col, *carry], ("base", "spans"))
    found = docs.select(*[F.col(c).alias(k) for k, (c, _) in through.items()], F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    forms = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "token": TOKEN}
    found = found.withColumns({f"_{k}": hits(text, p) for k, p in forms.items()})
    placed = [spans(text, F.col(f"_{k}"), forms[k]).alias(k) for k in KINDS]
    tokens = F.when(F.size("_token") > 0, _tokens(text, F.col("_token"))).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,core:string,lead:string>>")).alias("tokens")
    found = found.select(*through, *placed, tokens)
    found = found.select(*through, labelled(_base(*[F.col(k) for k in KINDS])).alias("base"), "tokens")
    marked = F.zip_with("tokens", touching(F.col("tokens"), F.col("base")), lambda t, on: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["core"].alias("core"), t["lead"].alias("lead"), on.alias("known")))
    found = stash.keep(found.withColumn("tokens", marked).withColumn("_row", F.monotonically_increasing_id()))
    evidence = found.where(F.size("tokens") > 0).select(F.explode("tokens").alias("t")).select("t.lead", "t.core", "t.known")
    patterns = stash.keep(confident_patterns(evidence, docs.select(F.col(text_col).alias("text")), stash, support=support, confidence=confidence, rounds=rounds))
    n_patterns = patterns.count()
    stash.only(found, patterns)
    names = [F.col(k).alias(c) for k, (_, c) in through.items()]
    if not n_patterns:
        return found.select(*names, "base", F.col("base").alias("spans"))
    new = found.select("_row", F.explode(F.filter("tokens", lambda t: ~t["known"])).alias("t")).join(_small(patterns.select(F.col("lead").alias("_lead")), n_patterns), F.col("t.lead") == F.col("_lead"))
    new = new.groupBy("_row").agg(F.collect_set(F.struct(F.col("t.start").alias("start"), F.lit(len(KINDS)).alias("rank"), F.col("t.end").alias("end"), F.lit("context").alias("kind"))).alias("more"))
    out = found.join(new, "_row", "left")
    every = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more")))
    return out.select(*names, "base", every.alias("spans"))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(id_col, *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
