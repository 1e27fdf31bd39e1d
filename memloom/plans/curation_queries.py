"""Curation on documents with labels: a question is a document, its gold a word of it, a prediction its start."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom.functions.text import split_words, token_count
from memloom.operators import curation as C
from memloom.plans.registry import query, table

_W = r"list_filter(string_split_regex(text, '[ \t\n\r\f\v]+'), lambda x: x <> '')"
_D = f"SELECT doc_id, source, lang, n_chars, text, {_W} AS w FROM documents"
_BASE = f"SELECT doc_id, source, n_chars, CASE WHEN doc_id % 9 = 0 THEN '' WHEN doc_id % 4 = 0 THEN array_to_string(w[3:9], ' ') ELSE coalesce(w[3], '') END AS gold, CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 2 = 0 THEN array_to_string(w[4:], ' ') ELSE text END AS pred FROM ({_D})"
_OK = "(trim(pred) <> '' AND trim(gold) <> '' AND contains(lower(trim(pred)), lower(trim(gold))))"


def base(spark, d):
    docs = table(spark, d, "documents").withColumn("w", split_words(F.col("text")))
    gold = F.when(F.col("doc_id") % 9 == 0, "").when(F.col("doc_id") % 4 == 0, F.array_join(F.slice("w", 3, 7), " ")).otherwise(F.coalesce(F.get("w", F.lit(2)), F.lit("")))
    # the whole text, or all of it from the word after a short gold on
    pred = F.when(F.col("doc_id") % 5 == 0, "").when(F.col("doc_id") % 2 == 0, F.array_join(F.slice("w", F.lit(4), F.greatest(F.size("w"), F.lit(0))), " ")).otherwise(F.col("text"))
    return docs.select("doc_id", "source", "n_chars", gold.alias("gold"), pred.alias("pred"))


@query(f"SELECT doc_id, gold FROM ({_BASE}) WHERE gold = '' OR (doc_id % 7 <> 0 AND (pred = '' OR (len(string_split_regex(gold, '[ ]+')) < 5 AND NOT contains(lower(pred), lower(gold)))))")
def d1_keep_unanswerable(spark, d):
    rows = base(spark, d)
    return C.keep_unanswerable(rows.select("doc_id", "gold"), rows.where("doc_id % 7 <> 0").select("doc_id", "pred"), question="doc_id")


@query(f"WITH b AS (SELECT *, NOT {_OK} AS wrong, row_number() OVER w - 1 AS i FROM ({_BASE}) WINDOW w AS (PARTITION BY source ORDER BY doc_id)), k AS (SELECT *, coalesce(sum((wrong OR i >= 40)::INT) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS kept FROM b) SELECT doc_id, source FROM k WHERE wrong OR i >= 40 OR kept >= 12")
def d2_keep_until_quota(spark, d):
    return C.keep_until_quota(base(spark, d), instance="source", order="doc_id", gold="gold", pred="pred", quota=12, max_test=40).select("doc_id", "source")


@query(f"SELECT doc_id, {_OK} AS correct FROM ({_BASE})")
def d3_is_answer_correct(spark, d):
    return base(spark, d).select("doc_id", C.is_answer_correct(F.col("pred"), F.col("gold")).alias("correct"))


@query(f"WITH p AS (SELECT doc_id, source, string_split(replace(gold, ' ', ';'), ';') AS g, pred FROM ({_BASE}) WHERE doc_id % 3 <> 0), k AS (SELECT doc_id, source, list_filter(g, lambda x: contains(lower(pred), lower(trim(x)))) AS found FROM p), r AS (SELECT doc_id, source, array_to_string(found, ';') AS gold FROM k WHERE len(found) > 0) SELECT doc_id, gold FROM r WHERE source IN (SELECT source FROM r GROUP BY source HAVING count(*) >= 14)")
def d4_keep_answerable(spark, d):
    rows = base(spark, d).withColumns({"gold": F.regexp_replace("gold", " ", ";"), "pred": F.when(F.col("doc_id") % 3 != 0, F.col("pred"))})
    return C.keep_answerable(rows, instance="source", min_count=14).select("doc_id", "gold")


_LINES = "SELECT doc_id AS pos, '  ' || CASE WHEN doc_id % 3 = 0 THEN '✓' ELSE '✗' END || ' it&#39;s...' || source || CASE WHEN doc_id % 5 = 0 THEN '&#39;s ' ELSE '-' END || (doc_id % 40) || ' ' AS line FROM documents"


def lines(spark, d):
    joint = F.when(F.col("doc_id") % 5 == 0, "&#39;s ").otherwise("-")
    text = F.concat(F.lit("  "), F.when(F.col("doc_id") % 3 == 0, "✓").otherwise("✗"), F.lit(" it&#39;s..."), "source", joint, F.col("doc_id") % 40, F.lit(" "))
    return table(spark, d, "documents").select(F.col("doc_id").alias("pos"), text.alias("line"))


#: One step of the recursion takes the next line of every key.
_CACHE = f"""WITH RECURSIVE k AS (SELECT pos, starts_with(trim(line), '✓') AS v, replace(trim(substr(trim(line), instr(trim(line), '...') + 3)), '&#39;', chr(39)) AS key FROM ({_LINES}) WHERE line IS NOT NULL),
l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos) AS i FROM k),
f AS (SELECT key, i, v AS held, pos AS place FROM l WHERE i = 1 UNION ALL SELECT l.key, l.i, CASE WHEN f.held IS NULL THEN l.v WHEN f.held = l.v THEN f.held END, CASE WHEN f.held IS NULL THEN l.pos WHEN f.held = l.v THEN f.place END FROM f JOIN l ON l.key = f.key AND l.i = f.i + 1),
n AS (SELECT key, max(i) AS i FROM f GROUP BY key), g AS (SELECT f.key, f.held AS value, f.place FROM f JOIN n USING (key, i) WHERE f.held IS NOT NULL)"""


@query(f"{_CACHE} SELECT key, value, place FROM g")
def d5_build_answer_cache(spark, d):
    return C.build_answer_cache(lines(spark, d), order="pos", text="line")


@query(f"{_CACHE}, q AS (SELECT item_id, 'Tell me about src' || (item_id % 20) || '-' || (item_id % 40) || CASE WHEN item_id % 2 = 0 THEN ' please' ELSE '' END AS question FROM benchmark), h AS (SELECT item_id, arg_min(value, place) AS value FROM q JOIN g ON ends_with(question, key) OR contains(right(question, 100), key) GROUP BY item_id) SELECT item_id, value FROM q LEFT JOIN h USING (item_id)")
def d6_lookup_cache(spark, d):
    q = F.concat(F.lit("Tell me about src"), F.col("item_id") % 20, F.lit("-"), F.col("item_id") % 40, F.when(F.col("item_id") % 2 == 0, " please").otherwise(""))
    asked = table(spark, d, "benchmark").select("item_id", q.alias("question"))
    return C.lookup_cache(asked, C.build_answer_cache(lines(spark, d), order="pos", text="line"), key="item_id", question="question", position="place").select("item_id", "value")


def nested(spark, d):
    """Instances: a document with one question per conversation turn of its number."""
    q = F.struct(F.col("text").alias("question"), F.when(F.col("turn") % 3 == 0, F.col("role")).alias("answer"), F.array(F.col("role"), F.lit("x")).alias("answers"), F.col("turn").alias("t"))
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", q.alias("q")))).alias("x"))
    return turns.select(F.col("conv_id").alias("instance_id"), F.transform("x", lambda x: x["q"]).alias("qas"), F.lit("en").alias("lang"))


@query("SELECT conv_id AS instance_id, string_agg(text || '=' || role, '|' ORDER BY turn) AS qas, '{\"lang\":\"en\"}' AS metadata FROM conversations GROUP BY conv_id")
def d7_standardize(spark, d):
    out = C.standardize(nested(spark, d), core=["instance_id"])
    return out.select("instance_id", F.array_join(F.transform("qas", lambda q: F.concat_ws("=", q["question"], q["answer"])), "|").alias("qas"), "metadata")


_H = "md5(concat_ws('|', '{}', doc_id::VARCHAR))"


@query(f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {_H.format('split')}, doc_id) - 1 < floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'test' END AS split FROM documents")
def d8_split_ratio(spark, d):
    return C.split_ratio(table(spark, d, "documents").select("doc_id"), 0.8, key="doc_id")


@query(f"SELECT doc_id, CASE WHEN ('0x' || substr({_H.format('split')}, 1, 8))::BIGINT / 4294967296.0 < 0.8 THEN 'train' ELSE 'test' END AS split FROM documents")
def d8_split_by_hash(spark, d):
    return C.split_by_hash(table(spark, d, "documents").select("doc_id"), 0.8, key="doc_id")


@query("SELECT doc_id, CASE WHEN n_chars // 500 <= 5 THEN 'train' ELSE 'test' END AS split FROM documents")
def d9_split_by_size(spark, d):
    return C.split_by_size(table(spark, d, "documents").select("doc_id", F.floor(F.col("n_chars") / 500).alias("c")), 5, chunks="c").drop("c")


@query(f"WITH u AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, CASE WHEN lang = 'en' THEN source ELSE 'other' END AS data_source FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY data_source, split ORDER BY {_H.format('merge')}, doc_id) AS r FROM u) SELECT doc_id, split, data_source FROM r WHERE split = 'test' OR r <= 10")
def d10_merge_sources(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", F.col("source").alias("sub_source"), F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("split"))
    sets = {"english": docs.where("lang = 'en'").drop("lang"), "other": docs.where("lang <> 'en'").drop("lang", "sub_source")}
    return C.merge_sources(sets, key="doc_id", limit=10).select("doc_id", "split", "data_source")


@query("SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS instance_id FROM documents")
def d11_reindex(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return C.reindex(docs, [F.col("n_chars"), F.col("doc_id")]).select("doc_id", "instance_id")


@query("SELECT doc_id, CASE WHEN doc_id % 10 > 7 THEN 'easy' WHEN doc_id % 10 >= 6 THEN 'medium' ELSE 'hard' END AS level FROM documents")
def d12_split_difficulty(spark, d):
    label = F.concat(F.lit("0."), F.col("doc_id") % 10, F.lit("-0."), F.col("doc_id") % 10 + 1)
    return C.split_difficulty(table(spark, d, "documents").select("doc_id", label.alias("bin")), bin="bin").select("doc_id", "level")


@query("WITH a AS (SELECT doc_id, least(floor(round((doc_id % 13) / 12 * 10, 9)), 9) AS k FROM documents) SELECT doc_id, quality, CASE WHEN k / 10 > 0.7 THEN 'easy' WHEN k / 10 >= 0.6 THEN 'medium' ELSE 'hard' END AS level FROM a JOIN labels USING (doc_id)")
def d12_levels_of_accuracies(spark, d):
    raw = table(spark, d, "documents").select("doc_id", ((F.col("doc_id") % 13) / 12).alias("acc"))
    return C.levels_of(table(spark, d, "labels").select("doc_id", "quality"), C.bin_accuracies(raw, accuracy="acc"), key="doc_id")


@query("SELECT conv_id AS instance_id, string_agg(CASE WHEN contains(lower(text), 'the') THEN 'k' || conv_id || ', z' ELSE role END, '|' ORDER BY turn) AS answers FROM conversations WHERE conv_id % 2 = 0 GROUP BY conv_id")
def d13_replace_answers(spark, d):
    mapping = table(spark, d, "conversations").where("conv_id % 2 = 0").select(F.col("conv_id").alias("instance_id")).distinct().withColumn("keywords", F.array(F.concat(F.lit("k"), F.col("instance_id")), F.lit("z")))
    out = C.replace_answers(C.standardize(nested(spark, d), core=["instance_id"]), mapping, key="instance_id", word="the")
    return out.select("instance_id", F.array_join(F.transform("qas", lambda q: q["answer"]), "|").alias("answers"))


@query("SELECT conv_id AS instance_id, arg_min(text, turn) AS question FROM conversations WHERE contains(lower(text), 'with') GROUP BY conv_id")
def d14_first_matching_qa(spark, d):
    return C.first_matching_qa(nested(spark, d), "with").select("instance_id", F.col("matched.question").alias("question"))


@query("SELECT doc_id, sha256(text) AS prompt_key FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)")
def d15_pending_rows(spark, d):
    docs = table(spark, d, "documents").select("doc_id", C.prompt_key(F.col("text")).alias("prompt_key"))
    return C.pending_rows(docs, docs.where("doc_id % 3 = 0"), ["prompt_key"]).select("doc_id", "prompt_key")


@query("WITH p AS (SELECT event_type, user_id, arg_max(CASE WHEN event_id % 4 = 0 THEN ' ' ELSE 'p' || event_id END, event_id) FILTER (event_id % 4 <> 0) AS pred FROM events WHERE event_id % 2 = 1 OR event_id % 4 = 0 GROUP BY ALL), q AS (SELECT DISTINCT event_type, user_id FROM events) SELECT event_type, user_id, pred FROM q LEFT JOIN p USING (event_type, user_id)")
def d16_reuse_answers(spark, d):
    e = table(spark, d, "events")
    done = e.where("event_id % 2 = 1 OR event_id % 4 = 0").withColumn("pred", F.when(F.col("event_id") % 4 == 0, " ").otherwise(F.concat(F.lit("p"), "event_id")))
    return C.reuse_answers(e.select("event_type", "user_id").distinct(), done, keys=["event_type", "user_id"], pred="pred", order="event_id")


@query(f"SELECT doc_id, len(list_filter(string_split(t, ';'), lambda k: len(list_filter(string_split(trim(k), ' '), lambda x: x <> '')) > 3)) = 0 AS ok FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN array_to_string(w, '; ') ELSE array_to_string(w, ' ') END AS t FROM ({_D}))")
def d17_validate_keywords(spark, d):
    docs = table(spark, d, "documents")
    words = split_words(F.col("text"))
    text = F.when(F.col("doc_id") % 2 == 0, F.array_join(words, "; ")).otherwise(F.array_join(words, " "))
    return docs.select("doc_id", C.validate_keywords(text).alias("ok"))


_T = f"SELECT source, doc_id // 50 AS instance, len({_W}) AS t FROM documents"


@query(
    f"""WITH c AS ({_T}), p AS (SELECT source, instance, count(*) AS n FROM c GROUP BY ALL), i AS (SELECT source, count(*) AS n_instances, sum(n)::BIGINT AS n_chunks, avg(n) AS mean_chunks, min(n) AS min_chunks, max(n) AS max_chunks FROM p GROUP BY source),
    s AS (SELECT source, min(t) AS min_tokens, max(t) AS max_tokens, avg(t) AS mean_tokens, sum((t > 400)::INT)::BIGINT AS over_400, avg((t > 400)::INT) AS share_400, list_sort(list(t))[count(*) // 2 + 1] AS median_tokens FROM c GROUP BY source),
    q AS (SELECT source, count(*) AS n_questions FROM documents JOIN labels USING (doc_id) GROUP BY source)
    SELECT source, n_instances, n_chunks, round(mean_chunks, 6) AS mean_chunks, min_chunks, max_chunks, min_tokens, max_tokens, round(mean_tokens, 6) AS mean_tokens, over_400, round(share_400, 6) AS share_400, median_tokens, n_questions, round(coalesce(n_questions, 0) / n_chunks, 6) AS questions_per_chunk FROM i JOIN s USING (source) LEFT JOIN q USING (source)"""
)
def d18_profile_dataset(spark, d):
    docs = table(spark, d, "documents")
    chunks = docs.select("source", F.floor(F.col("doc_id") / 50).alias("instance"), token_count(F.col("text")).alias("t"))
    out = C.profile_dataset(chunks, source="source", instance="instance", tokens="t", questions=docs.join(table(spark, d, "labels"), "doc_id"), over=(400,))
    return out.withColumns({c: F.round(c, 6) for c in ("mean_chunks", "mean_tokens", "share_400", "questions_per_chunk")})


@query("SELECT split, source, count(*) AS n, round(avg(n_chars), 5) AS mean_chunks FROM (SELECT *, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM documents) GROUP BY ROLLUP (split, source)")
def d19_source_counts(spark, d):
    docs = table(spark, d, "documents").withColumn("split", F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train"))
    return C.source_counts(docs, split="split", source="source", chunks="n_chars").withColumn("mean_chunks", F.round("mean_chunks", 5))


@query("SELECT conv_id AS instance_id, CASE WHEN count(*) > 6 THEN 'too many questions' ELSE 'no answer' END AS problem FROM conversations GROUP BY conv_id HAVING count(*) > 6 OR bool_or(turn % 3 <> 0)")
def d20_check_schema(spark, d):
    return C.check_schema(nested(spark, d), key="instance_id", most=6)


@query("SELECT doc_id, source FROM documents WHERE starts_with(source, 'src1')")
def d21_select_benchmark(spark, d):
    subsets = {"teens": ("prefix", "src1"), "two": ("isin", ["src2", "src3"]), "one": ("equals", "src1")}
    return C.select_benchmark(table(spark, d, "documents"), "teens", subsets, source="source").select("doc_id", "source")


@query(f"SELECT doc_id FROM documents ORDER BY {_H.format('rows')}, doc_id LIMIT 100")
def d22_sample_rows(spark, d):
    return C.sample_rows(table(spark, d, "documents").select("doc_id"), 100, key="doc_id")


@query(f"SELECT doc_id, source FROM (SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY {_H.format('share')}, doc_id) AS r FROM documents) WHERE n <= 50 OR r <= floor(n * 0.3)")
def d22b_sample_share(spark, d):
    return C.sample_share(table(spark, d, "documents").select("doc_id", "source"), 0.3, group="source", key="doc_id")
