"""Retrieval over per-instance corpora, and prompts made from what was found."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.edits import nearest
from memloom.functions.text import split_words, word_tokens
from memloom.sources.tables import Tables

K1, B, EPSILON = 1.5, 0.75, 0.25
#: A query that few documents answer is filled up from the first NEAR * k of its corpus.
NEAR = 8
#: Names and texts compared at once, and the characters of either.
NAMES, TEXTS, CHARS = 4096, 512, 1 << 20
#: Vectors of items, and of queries, multiplied at once.
ROWS = 4096
#: Tasks that share the item blocks of one corpus.
SPREAD = 8


def bm25_scores(docs: DataFrame, queries: DataFrame, *, corpus: str = "corpus", doc: str = "doc", text: str = "text", query: str = "query_id", query_text: str = "query") -> DataFrame:
    """(query, corpus, doc, score) of documents that share a word with the query.

    Okapi BM25 within each corpus: idf = ln(N - df + 0.5) - ln(df + 0.5), a negative one replaced by EPSILON times the
    mean idf of the corpus's vocabulary; a repeated query word counts again. One pass over the documents counts how many
    have each word, how many there are and how long they are, and is written, as three steps read it; another one
    counts, of the words that are asked for only, how often each document has them. Both add up before anything is
    shuffled, and only words of queries are joined.
    """
    tokens = docs.select(corpus, doc, word_tokens(F.col(text)).alias("_w"))
    wanted = queries.select(query, corpus, F.explode(word_tokens(F.col(query_text))).alias("term")).groupBy(query, corpus, "term").agg(F.count("*").alias("times"))
    asked = wanted.select(corpus, "term").distinct()
    # frequencies in documents only of words that are asked for; document frequencies of all, for the vocabulary's mean
    # explode() would first filter by the size of the words, for which Spark splits each text once more; a null term meets no word
    tf = tokens.select(corpus, doc, F.size("_w").alias("dl"), F.explode_outer("_w").alias("term")).join(asked, [corpus, "term"], "left_semi").groupBy(corpus, doc, "dl", "term").agg(F.count("*").alias("tf"))
    # a document's row without a word carries its length; written, as a step's own filter would move below the counting and have it done again
    held = F.concat(F.coalesce(F.array_distinct("_w"), F.array().cast("array<string>")), F.array(F.lit(None).cast("string")))
    counted = tokens.select(corpus, F.explode(held).alias("term"), F.coalesce(F.size("_w"), F.lit(0)).alias("dl")).groupBy(corpus, "term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("dl"))).alias("dl"))
    counted = Tables(docs.sparkSession).keep(counted)
    stats = counted.where(F.col("dl").isNotNull()).select(corpus, F.col("df").alias("n_docs"), (F.col("dl") / F.col("df")).alias("avgdl"))
    df = counted.where(F.col("dl").isNull()).select(corpus, "term", "df").join(stats, corpus)
    df = df.withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = df.groupBy(corpus).agg(F.avg("raw").alias("mean_idf"))
    idf = df.join(asked, [corpus, "term"]).join(mean, corpus)
    idf = idf.select(corpus, "term", "avgdl", F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))
    met = tf.join(wanted.join(idf, [corpus, "term"]), [corpus, "term"])
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return met.groupBy(query, corpus, doc).agg(F.sum(part).alias("score"))


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int, *, corpus: str = "corpus", doc: str = "doc", text: str = "text", query: str = "query_id", query_text: str = "query", min_score: float | None = None) -> DataFrame:
    """The k best documents of the query's corpus: score descending (rounded to 9 digits), ties by document order.

    Documents without a common word score 0 and fill the list where fewer than k score more. With s scored documents the
    fill is among the first k + s of the corpus: a query of few looks at the first NEAR * k, which every task cuts down
    to before any meet; one of many documents of which fewer than k score above 0 (a matter of negative idf) is held
    against its whole corpus. `min_score` cuts afterwards. A query without words finds nothing. Scores are written once,
    a row for each document that shares a word with a query, and read by each of these steps.
    """
    scored = Tables(docs.sparkSession).keep(bm25_scores(docs, queries, corpus=corpus, doc=doc, text=text, query=query, query_text=query_text))
    asked = queries.where(F.size(word_tokens(F.col(query_text))) > 0).select(query, corpus)
    counts = scored.groupBy(query, corpus).agg(F.count("*").alias("scored"), F.count_if(F.col("score") > 0).alias("above"))
    short = asked.join(counts, [query, corpus], "left").fillna(0, ["scored", "above"]).where(F.col("above") < k).select(query, corpus, (F.col("scored") + k).alias("reach"))
    place = F.row_number().over(Window.partitionBy(corpus).orderBy(doc))
    first = docs.select(corpus, doc, place.alias("place")).where(F.col("place") <= NEAR * k)
    fill = short.where(F.col("reach") <= NEAR * k).join(first, corpus).where("place <= reach").select(query, corpus, doc)
    far = short.where(F.col("reach") > NEAR * k).select(query, corpus).join(docs.select(corpus, doc), corpus).join(scored, [query, corpus, doc], "left").where(F.col("score").isNull()).drop("score")
    far = far.withColumn("place", F.row_number().over(Window.partitionBy(query, corpus).orderBy(doc))).where(F.col("place") <= k).drop("place")
    every = scored.unionByName(fill.unionByName(far).withColumn("score", F.lit(0.0))).groupBy(query, corpus, doc).agg(F.max_by("score", F.abs("score")).alias("score"))
    every = every.withColumn("score", F.round("score", 9))
    rank = F.row_number().over(Window.partitionBy(query, corpus).orderBy(F.desc("score"), doc))
    out = every.withColumn("rank", rank).where(F.col("rank") <= k)
    return out if min_score is None else out.where(F.col("score") >= min_score)


def bm25_chunks(chunks: DataFrame, queries: DataFrame, k: int = 2, **names: str) -> DataFrame:
    """As bm25_topk; a query without words gets the first k chunks of its corpus, with score 0."""
    corpus, doc = names.get("corpus", "corpus"), names.get("doc", "doc")
    query, query_text = names.get("query", "query_id"), names.get("query_text", "query")
    found = bm25_topk(chunks, queries, k, **names)
    first = chunks.select(corpus, doc, F.row_number().over(Window.partitionBy(corpus).orderBy(doc)).alias("rank")).where(F.col("rank") <= k)
    blank = queries.where(F.size(F.coalesce(word_tokens(F.col(query_text)), F.array().cast("array<string>"))) == 0).select(query, corpus)
    return found.unionByName(blank.join(first, corpus).withColumn("score", F.lit(0.0)))


def _packed(rows: DataFrame, corpus: str, key: str, vector: str, names: tuple[str, str]) -> DataFrame:
    """(corpus, keys, vectors): rows of a corpus that come together in a task as one block of at most ROWS, each vector with length 1 (or 0)."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, part in batch.groupby(corpus, sort=False, dropna=True):
                for at in range(0, len(part), ROWS):
                    own = part.iloc[at : at + ROWS]
                    m = np.vstack(own[vector].to_list()).astype(np.float64)
                    size = np.linalg.norm(m, axis=1, keepdims=True)
                    out.append((name, own[key].tolist(), (m / np.where(size > 0, size, 1)).tobytes()))
            yield pd.DataFrame(out, columns=[corpus, *names])

    return rows.select(corpus, key, vector).where(F.col(corpus).isNotNull()).mapInPandas(pack, f"`{corpus}` {kinds[corpus]}, {names[0]} array<{kinds[key]}>, {names[1]} binary")


def cosine_topk(items: DataFrame, queries: DataFrame, k: int, *, corpus: str = "corpus", item: str = "item", vector: str = "vector", query: str = "query_id", query_vector: str = "query_vector", min_score: float | None = None) -> DataFrame:
    """The k nearest items of the query's corpus by cosine (rounded to 6 digits); ties by item. A zero query finds nothing, a zero item scores 0.

    Items and queries meet in blocks: one matrix product a pair of blocks, of which each query keeps its k best. The
    blocks of a corpus are dealt to SPREAD tasks, so no task has a whole one.
    """
    asked = queries.where(F.exists(query_vector, lambda x: x != 0))
    left = _packed(items, corpus, item, vector, ("_i", "_v")).withColumn("_part", F.pmod(F.xxhash64("_v"), F.lit(SPREAD)))
    right = _packed(asked, corpus, query, query_vector, ("_q", "_u")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, ids, v, asks, u in batch.itertuples(index=False):
                ids, asks = np.asarray(ids), np.asarray(asks)
                scores = np.round(np.frombuffer(u).reshape(len(asks), -1) @ np.frombuffer(v).reshape(len(ids), -1).T, 6) + 0.0
                rank = np.argsort(ids, kind="stable")
                order = rank[np.argsort(-scores[:, rank], axis=1, kind="stable")[:, :k]]
                for r, row in enumerate(order):
                    out += [(asks[r], name, ids[c], scores[r, c]) for c in row if min_score is None or scores[r, c] >= min_score]
            yield pd.DataFrame(out, columns=["q", "c", "i", "score"])

    kinds = {n: d.schema[c].dataType.simpleString() for n, d, c in (("q", queries, query), ("c", items, corpus), ("i", items, item))}
    met = left.join(right, [corpus, "_part"]).select(corpus, "_i", "_v", "_q", "_u")
    found = met.mapInPandas(best, f"q {kinds['q']}, c {kinds['c']}, i {kinds['i']}, score double").withColumnsRenamed({"q": query, "c": corpus, "i": item})
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), item))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def topk_within_budget(ranked: DataFrame, *, key: str, rank: str = "rank", tokens: str = "n_tokens", k: int = 20, budget: int = 30_000, overhead: int = 0) -> DataFrame:
    """The largest k' up to k for which all items of rank k' or better, of every type, fit the budget together; 1 at least."""
    per = ranked.where(F.col(rank) <= k).groupBy(key, rank).agg(F.sum(tokens).alias("n"))
    run = F.sum("n").over(Window.partitionBy(key).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0))
    per = per.withColumn("used", run + overhead)
    return per.groupBy(key).agg(F.greatest(F.coalesce(F.max(F.when(F.col("used") <= budget, F.col(rank))), F.lit(1)), F.lit(1)).alias("k"))


def novel_topk(ranked: DataFrame, seen: DataFrame, *, query: str, item: str, rank: str = "rank", pre: int = 10, k: int = 2) -> DataFrame:
    """Of the first `pre` items of each query, those not seen before, and of these the first k, ranked anew."""
    new = ranked.where(F.col(rank) <= pre).join(seen.select(query, item), [query, item], "left_anti")
    place = F.row_number().over(Window.partitionBy(query).orderBy(rank))
    return new.withColumn("place", place).where(F.col("place") <= k)


def format_passages(hits: DataFrame, *, query: str, text: str = "text", rank: str = "rank") -> DataFrame:
    """One text per query: `Doc i (Title: first line) rest`, in rank order, a line each."""
    line = F.concat(F.lit("Doc "), F.col(rank), F.lit(" (Title: "), F.substring_index(text, "\n", 1), F.lit(") "), F.substring(F.col(text), F.length(F.substring_index(text, "\n", 1)) + 2, F.length(text)))
    rows = hits.select(query, F.struct(F.col(rank).alias("rank"), line.alias("line")).alias("x"))
    return rows.groupBy(query).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("passages"))


def build_prompts(df: DataFrame, mode: str = "all", *, prompt: str = "prompt", chunks: str = "chunks", question: str = "question", upto: str | None = None, memory: str | None = None, hits: str | None = None) -> DataFrame:
    """Adds `full_prompt`: prompt, context and question, blank lines between. Context by mode: all chunks, `prefix` (chunks up to a place), `hits`, `memory`, or `none`."""
    context = {
        "all": lambda: F.array_join(chunks, "\n\n"),
        "prefix": lambda: F.array_join(F.slice(chunks, F.lit(1), F.col(upto)), "\n\n"),
        "hits": lambda: F.array_join(hits, "\n\n"),
        "memory": lambda: F.col(memory),
        "none": lambda: F.lit(None).cast("string"),
    }[mode]()
    return df.withColumn("full_prompt", F.concat_ws("\n\n", F.col(prompt), context, F.col(question)))


def fit_prompt(text: Column, max_tokens: int, other: Column | None = None, reserve: int = 1000) -> Column:
    """The last `max_tokens` words of a text that has more. With `other` (tokens of the other messages) the last max_tokens - other - reserve words; unchanged if that is not positive."""
    words = split_words(text)
    room = F.lit(max_tokens) if other is None else F.lit(max_tokens) - other - F.lit(reserve)
    total = F.size(words) + (F.lit(0) if other is None else other)
    take = F.least(room, F.size(words)).cast("int")
    return F.when((total > max_tokens) & (take > 0), F.array_join(F.slice(words, F.size(words) - take + 1, take), " ")).otherwise(text)


def add_source_prompt(df: DataFrame, config: DataFrame, *, source: str = "data_source", question: str = "question") -> DataFrame:
    """Puts the source's text, where there is one, before the question. The config has a row per source: (source, query_prompt); Spark decides how to join it."""
    joined = df.join(config.select(F.col(source), F.col("query_prompt").alias("_p")), source, "left")
    return joined.withColumn(question, F.when(F.col("_p").isNotNull(), F.concat_ws(" ", "_p", question)).otherwise(F.col(question))).drop("_p")


def system_prompt(source: Column, rules: list[tuple[str, str, str]], otherwise: str) -> Column:
    """The text of the first rule that holds; a rule is (contains | startswith | equals, what, text)."""
    test = {"contains": lambda x: F.contains(source, F.lit(x)), "startswith": lambda x: source.startswith(x), "equals": lambda x: source == x}
    out = None
    for kind, what, text in rules:
        out = (F.when if out is None else out.when)(test[kind](what), F.lit(text))
    return F.lit(otherwise) if out is None else out.otherwise(F.lit(otherwise))


def _in_blocks(df: DataFrame, rows: int) -> DataFrame:
    """(own, key) of strings as rows of arrays, each of `rows` strings or CHARS characters at most (one string is never cut). Blocks are made where the rows lie."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, key, size = [], [], 0
        for batch in batches:
            done = []
            for a, b in batch.itertuples(index=False):
                if own and (len(own) >= rows or size + len(b) > CHARS):
                    done.append((own, key))
                    own, key, size = [], [], 0
                own.append(a)
                key.append(b)
                size += len(b)
            if done:
                yield pd.DataFrame(done, columns=["own", "key"])
        if own:
            yield pd.DataFrame([(own, key)], columns=["own", "key"])

    return df.mapInPandas(pack, "own array<string>, key array<string>")


def nearest_name(items: DataFrame, names: DataFrame, *, text: str, name: str, by: str = "edits") -> DataFrame:
    """Adds `nearest` and how near it is; ties go to the smallest name.

    By `edits` both are lower-cased and `distance` is the edit distance; by `ratio` they are taken as they are and `ratio`
    is 200 times their longest common subsequence over both lengths (100 for equal ones). Texts that equal a name are
    joined with it. The names are a stated set: blocks of NAMES of them meet blocks of TEXTS different texts, and in a
    block the characters that two can share bound the pairs that are worked out. Every row of items stays; a null text,
    or any where there are no names, has no nearest one.
    """
    form = {"edits": F.lower, "ratio": lambda c: c}[by]
    known = names.select(F.col(name).alias("own")).where(F.col("own").isNotNull()).distinct().withColumn("key", form(F.col("own")))
    texts = items.select(F.col(text).alias("own")).where(F.col("own").isNotNull()).distinct().withColumn("key", form(F.col("own")))
    told = texts.join(known.groupBy("key").agg(F.min("own").alias("name")), "key", "left")
    left = _in_blocks(told.where(F.col("name").isNull()).select("own", "key"), TEXTS).toDF("t", "tk")
    right = _in_blocks(known, NAMES).toDF("n", "nk")

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t, tk, n, nk in batch.itertuples(index=False):
                order = sorted(range(len(n)), key=lambda k: n[k])
                place, cost, _ = nearest(list(tk), [nk[k] for k in order], ratio=by == "ratio")
                yield pd.DataFrame({"t": t, "cost": cost.astype(float), "name": [n[order[k]] for k in place]})

    met = left.crossJoin(right).mapInPandas(best, "t string, cost double, name string")
    far = met.groupBy("t").agg(F.min(F.struct("cost", "name")).alias("x")).select("t", "x.cost", "x.name")
    equal = told.where(F.col("name").isNotNull()).select("own", F.lit(0.0 if by == "edits" else -1.0), "name").toDF("t", "cost", "name")
    # names of their own, whatever the items' columns are called
    found = equal.unionByName(far).toDF("_text", "_cost", "_name")
    own = {f"_own{k}": c for k, c in enumerate(items.columns)}
    held = items.toDF(*own)
    near = F.col("_cost").cast("int").alias("distance") if by == "edits" else (-100 * F.col("_cost")).alias("ratio")
    at = next(k for k, c in own.items() if c == text)
    return held.join(found, F.col(at) == F.col("_text"), "left").select(*[F.col(k).alias(c) for k, c in own.items()], F.col("_name").alias("nearest"), near)
