"""Retrieval on documents (a source is a corpus), benchmark items (queries) and embeddings (a label is a corpus)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memloom.functions.text import token_count, word_tokens
from memloom.operators import retrieval as R
from memloom.plans.registry import query, spread, table
from memloom.sources.tables import Tables

_TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
SCORES = f"""
s AS (SELECT source, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT coalesce(source, '') AS source FROM documents)),
q AS (SELECT item_id, source, text FROM benchmark JOIN s ON s.place = item_id % n),
documents AS (SELECT doc_id, coalesce(source, '') AS source, text FROM documents),
t AS (SELECT source, doc_id, {_TOK.format("text")} AS w FROM documents),
z AS (SELECT source, count(*) AS n, sum(len(w)) / count(*) AS avgdl FROM t GROUP BY source),
tf AS (SELECT source, doc_id, len(w) AS dl, term, count(*) AS tf FROM (SELECT source, doc_id, w, unnest(w) AS term FROM t) GROUP BY source, doc_id, w, term),
df AS (SELECT source, term, count(*) AS df FROM tf GROUP BY source, term),
raw AS (SELECT df.*, z.avgdl, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df JOIN z USING (source)),
m AS (SELECT source, avg(raw) AS mean FROM raw GROUP BY source),
idf AS (SELECT raw.*, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM raw JOIN m USING (source)),
qt AS (SELECT item_id, source, term, count(*) AS times FROM (SELECT item_id, source, unnest({_TOK.format("text")}) AS term FROM q) GROUP BY ALL),
sc AS (SELECT item_id, source, doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s FROM qt JOIN idf USING (source, term) JOIN tf USING (source, term) GROUP BY ALL),
a AS (SELECT q.item_id, d.source, d.doc_id, round(coalesce(s, 0), 9) AS s FROM q JOIN documents d USING (source) LEFT JOIN sc ON sc.item_id = q.item_id AND sc.doc_id = d.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id) AS rank FROM a)
"""


def _docs(spark, d):
    """Documents; those without a source are a corpus, too."""
    return spread(table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text"))


def _asked(spark, d):
    """Each item asks one of the sources that the documents have, in turn."""
    known = F.array_sort(F.collect_set(F.coalesce("source", F.lit("")))).alias("known")  # a name a source
    one = F.broadcast(table(spark, d, "documents").agg(known))
    return table(spark, d, "benchmark").crossJoin(one).select("item_id", F.get("known", F.pmod("item_id", F.size("known"))).alias("source"), F.col("text").alias("query"))


_NAMES = {"corpus": "source", "doc": "doc_id", "query": "item_id"}


def _top(spark, d, k):
    """Written, so that Spark knows how few rows there are before it joins them with the texts."""
    return Tables(spark).keep(R.bm25_topk(_docs(spark, d), _asked(spark, d), k, **_NAMES))


@query(f"SELECT doc_id, array_to_string({_TOK.format('text')}, ' ') AS words FROM documents")
def f1_tokenize_words(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(word_tokens(F.col("text")), " ").alias("words"))


@query(f"WITH {SCORES} SELECT item_id, source, doc_id, round(s, 6) AS score, rank FROM r WHERE rank <= 5")
def f2_bm25_topk(spark, d):
    return _top(spark, d, 5).withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {SCORES} SELECT item_id, doc_id, rank FROM r WHERE rank <= 2 AND item_id % 10 <> 0 UNION ALL SELECT q.item_id, doc_id, p FROM q JOIN (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS p FROM documents) USING (source) WHERE p <= 2 AND q.item_id % 10 = 0")
def f3_bm25_chunks(spark, d):
    asked = _asked(spark, d).withColumn("query", F.when(F.col("item_id") % 10 == 0, " ?").otherwise(F.col("query")))
    return R.bm25_chunks(_docs(spark, d), asked, 2, **_NAMES).select("item_id", "doc_id", F.col("rank").cast("long").alias("rank"))


@query(
    """WITH p AS (SELECT q.vec_id AS query_id, i.vec_id AS item, round(list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 6) AS score
      FROM embeddings q JOIN embeddings i ON q.label = i.label WHERE q.vec_id % 100 = 0)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS rank FROM p) WHERE rank <= 5"""
)
def f4_cosine_topk(spark, d):
    e = table(spark, d, "embeddings")
    items = e.select(F.col("label").alias("corpus"), F.col("vec_id").alias("item"), F.col("embedding").alias("vector"))
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("corpus"), F.col("embedding").alias("query_vector"))
    return R.cosine_topk(items, asked, 5).select("query_id", "item", "score", F.col("rank").cast("long").alias("rank"))


_COUNT = r"len(list_filter(string_split_regex({}, '[ \t\n\r\f\v]+'), lambda x: x <> ''))"


@query(f"WITH {SCORES}, u AS (SELECT item_id, rank, sum({_COUNT.format('d.text')}) OVER (PARTITION BY item_id ORDER BY rank) AS used FROM r JOIN documents d USING (doc_id) WHERE rank <= 10) SELECT item_id, greatest(coalesce(max(rank) FILTER (used <= 3000), 1), 1) AS k FROM u GROUP BY item_id")
def f5_topk_within_budget(spark, d):
    ranked = _top(spark, d, 10).join(_docs(spark, d).select("doc_id", token_count(F.col("text")).alias("n_tokens")), "doc_id")
    return R.topk_within_budget(ranked, key="item_id", k=10, budget=3000).select("item_id", F.col("k").cast("long").alias("k"))


@query(f"WITH {SCORES} SELECT item_id, doc_id, place FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS place FROM r WHERE rank <= 10 AND doc_id % 3 <> 0) WHERE place <= 2")
def f6_novel_topk(spark, d):
    ranked = _top(spark, d, 10)
    seen = ranked.where("doc_id % 3 = 0").select("item_id", "doc_id")
    return R.novel_topk(ranked, seen, query="item_id", item="doc_id").select("item_id", "doc_id", F.col("place").cast("long").alias("place"))


@query(f"WITH {SCORES} SELECT item_id, string_agg('Doc ' || rank || ' (Title: ' || split_part(d.text, chr(10), 1) || ') ' || substr(d.text, length(split_part(d.text, chr(10), 1)) + 2), chr(10) ORDER BY rank) AS passages FROM r JOIN documents d USING (doc_id) WHERE rank <= 3 GROUP BY item_id")
def f7_format_passages(spark, d):
    return R.format_passages(_top(spark, d, 3).join(_docs(spark, d).select("doc_id", "text"), "doc_id"), query="item_id")


@query("SELECT source, 'Read.' || chr(10) || chr(10) || array_to_string(c[1:3], chr(10) || chr(10)) || chr(10) || chr(10) || 'Which?' AS full_prompt FROM (SELECT source, list(text ORDER BY doc_id) AS c FROM documents GROUP BY source)")
def f8_build_prompts(spark, d):
    # the first three of a source are found before texts meet
    first = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    chunks = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"])
    rows = _docs(spark, d).withColumn("r", first).where("r <= 3").groupBy("source").agg(chunks.alias("chunks")).withColumns({"prompt": F.lit("Read."), "question": F.lit("Which?"), "upto": F.lit(3)})
    return R.build_prompts(rows, "prefix", upto="upto").select("source", "full_prompt")


_W = r"list_filter(string_split_regex(text, '[ \t\n\r\f\v]+'), lambda x: x <> '')"


@query(f"SELECT doc_id, CASE WHEN n > 100 THEN array_to_string(w[n - 99:n], ' ') ELSE text END AS tail, CASE WHEN n + doc_id % 300 > 400 AND 350 - doc_id % 300 > 0 THEN array_to_string(w[greatest(n - (350 - doc_id % 300) + 1, 1):n], ' ') ELSE text END AS fitted FROM (SELECT doc_id, text, {_W} AS w, len({_W}) AS n FROM documents)")
def f8b_fit_prompt(spark, d):
    other = (F.col("doc_id") % 300).cast("int")
    return table(spark, d, "documents").select("doc_id", R.fit_prompt(F.col("text"), 100).alias("tail"), R.fit_prompt(F.col("text"), 400, other, 50).alias("fitted"))


@query(f"WITH {SCORES} SELECT item_id, CASE WHEN source IN ('src1', 'src2') THEN 'Choose: ' || query ELSE query END AS question, CASE WHEN contains(source, '9') THEN 'nine' WHEN starts_with(source, 'src1') THEN 'teen' WHEN source = 'src2' THEN 'two' ELSE 'other' END AS system FROM (SELECT item_id, source, text AS query FROM q)")
def f9_add_source_prompt(spark, d):
    config = table(spark, d, "documents").select("source").distinct().withColumn("query_prompt", F.when(F.col("source").isin("src1", "src2"), "Choose:"))
    out = R.add_source_prompt(_asked(spark, d), config, source="source", question="query")
    system = R.system_prompt(F.col("source"), [("contains", "9", "nine"), ("startswith", "src1", "teen"), ("equals", "src2", "two")], "other")
    return out.select("item_id", F.col("query").alias("question"), system.alias("system"))


@query("WITH s AS (SELECT p_type, n_name, levenshtein(lower(p_type), lower(n_name)) AS d FROM (SELECT DISTINCT p_type FROM part) CROSS JOIN (SELECT DISTINCT n_name FROM nation)), b AS (SELECT p_type, n_name, d, row_number() OVER (PARTITION BY p_type ORDER BY d, n_name) AS r FROM s) SELECT p_partkey, n_name AS nearest, d AS distance FROM part JOIN b USING (p_type) WHERE r = 1")
def f10_nearest_name(spark, d):
    items = table(spark, d, "part").select("p_partkey", "p_type")
    names = table(spark, d, "nation").select(F.col("n_name").alias("name"))
    return R.nearest_name(items, names, text="p_type", name="name").select("p_partkey", "nearest", F.col("distance").cast("long").alias("distance"))


# the longest common subsequence, a row of its table a step: the running maximum of what the row before gives
_LCS = """p AS (SELECT t, n FROM (SELECT DISTINCT p_type AS t FROM part) CROSS JOIN (SELECT DISTINCT n_name AS n FROM nation)),
r AS (SELECT t, n, 0 AS i, list_transform(range(0, length(n) + 1), lambda j: 0::BIGINT) AS w FROM p
  UNION ALL SELECT t, n, i + 1, list_prepend(0::BIGINT, list_transform(range(1, length(n) + 1), lambda j: list_max(c[1:j])))
  FROM (SELECT t, n, i, list_transform(range(1, length(n) + 1), lambda j: greatest(w[j + 1], w[j] + CASE WHEN substr(n, j, 1) = substr(t, i + 1, 1) THEN 1 ELSE 0 END)) AS c FROM r WHERE i < length(t)))"""


@query(f"WITH RECURSIVE {_LCS}, s AS (SELECT t, n, round(200 * w[-1] / (length(t) + length(n)), 6) AS ratio FROM r WHERE i = length(t)), b AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY ratio DESC, n) AS place FROM s) SELECT p_partkey, n AS nearest, ratio FROM part JOIN b ON p_type = t WHERE place = 1")
def f10b_nearest_by_ratio(spark, d):
    items = table(spark, d, "part").select("p_partkey", "p_type")
    names = table(spark, d, "nation").select(F.col("n_name").alias("name"))
    return R.nearest_name(items, names, text="p_type", name="name", by="ratio").select("p_partkey", "nearest", F.round("ratio", 6).alias("ratio"))
