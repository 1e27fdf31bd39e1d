"""Instances built from documents: texts are contexts, sources are instances, labels ask questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom.functions.text import seeded, token_count
from memloom.operators import curation, instances as C, ranking
from memloom.plans.registry import query, table


def docs(spark, d):
    return table(spark, d, "documents")


@query("SELECT min(doc_id) AS first, sha256(text) AS context, string_agg('q' || doc_id || '=' || lang, '|' ORDER BY doc_id) AS qas FROM documents GROUP BY text")
def c1_group_qas_by_context(spark, d):
    rows = docs(spark, d).select("doc_id", "text", F.concat(F.lit("q"), "doc_id").alias("q"), F.array("lang", "source").alias("a"))
    out = C.group_qas_by_context(rows, context="text", position="doc_id", question="q", answers="a")
    return out.select("first", F.sha2("text", 256).alias("context"), F.array_join(F.transform("qas", lambda q: F.concat_ws("=", q["question"], q["answer"])), "|").alias("qas"))


@query("SELECT n_chars, min(doc_id) AS doc_id FROM documents GROUP BY n_chars")
def c2_dedup_first(spark, d):
    return C.dedup_first(docs(spark, d).select("doc_id", "n_chars"), key="n_chars", order="doc_id")


@query(r"WITH d AS (SELECT doc_id, source, lang, string_split(text, '. ') AS s FROM documents) SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' WHEN len(s) > 1 THEN s[2] || '|' || s[1] ELSE s[1] END AS facts FROM d")
def c3_resolve_supporting_facts(spark, d):
    s = F.split("text", r"\. ")
    rows = docs(spark, d).select("doc_id", F.array("source", "lang", "source").alias("titles"), F.array(s, F.array(F.lit("x")), F.array(F.lit("no"))).alias("sentences"), F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("none"), F.lit("never"))).otherwise(F.array("source", "source")).alias("ft"), F.array(F.lit(1), F.lit(0)).alias("fi"))
    out = C.resolve_supporting_facts(rows, titles="titles", sentences="sentences", fact_titles="ft", fact_ids="fi")
    return out.select("doc_id", F.array_join("facts", "|").alias("facts"))


@query("WITH c AS (SELECT source AS instance, lang AS title, min(doc_id // 7) AS c FROM documents WHERE doc_id % 2 = 0 GROUP BY ALL), q AS (SELECT source AS instance, doc_id, lang FROM documents), e AS (SELECT q.instance, doc_id, list_sort(list_distinct(list(c.c))) AS l FROM (SELECT instance, doc_id, unnest([lang, 'xx', 'de']) AS title FROM q) q JOIN c USING (instance, title) GROUP BY ALL) SELECT q.doc_id, coalesce(array_to_string(l, ','), '0') AS evidence FROM q LEFT JOIN e USING (doc_id)")
def c4_link_evidence(spark, d):
    rows = docs(spark, d)
    held = rows.where("doc_id % 2 = 0").select(F.col("source").alias("instance"), F.col("lang").alias("title"), F.floor(F.col("doc_id") / 7).alias("chunk_idx"))
    asked = rows.select(F.col("source").alias("instance"), "doc_id", F.array("lang", F.lit("xx"), F.lit("de")).alias("titles"))
    out = C.link_evidence(asked, held, instance="instance", question="doc_id", titles="titles")
    return out.select("doc_id", F.array_join(F.transform("evidence_idx", lambda x: x.cast("string")), ",").alias("evidence"))


@query("WITH c AS (SELECT source AS instance, lang || doc_id % 11 AS context, doc_id // 7 AS chunk FROM documents), q AS (SELECT l.doc_id, d.source AS instance, d.lang || (l.doc_id + l.toxic) % 11 AS context FROM labels l JOIN documents d USING (doc_id)) SELECT doc_id, max(chunk) AS evidence_idx FROM q JOIN c USING (instance, context) GROUP BY doc_id")
def c5b_link_evidence_by_context(spark, d):
    rows = docs(spark, d)
    held = rows.select(F.col("source").alias("instance"), F.concat("lang", F.col("doc_id") % 11).alias("context"), F.floor(F.col("doc_id") / 7).alias("chunk_idx"))
    asked = table(spark, d, "labels").join(rows, "doc_id").select("doc_id", F.col("source").alias("instance"), F.concat("lang", (F.col("doc_id") + F.col("toxic")) % 11).alias("context"))
    return C.link_evidence_by_context(asked, held, instance="instance", question="doc_id", context="context").select("doc_id", "evidence_idx")


@query("SELECT b.item_id, d.source, max(d.doc_id) AS evidence_idx FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY ALL")
def c5_link_evidence_by_containment(spark, d):
    # every source that the documents have; in a struct, since rows without a source are an instance too
    held = docs(spark, d).withColumn("instance", F.struct("source"))
    asked = table(spark, d, "benchmark").select("item_id", F.col("text").alias("context")).crossJoin(held.select("instance").distinct())
    out = C.link_evidence_by_containment(asked, held, instance="instance", question="item_id", context="context", text="text", chunk="doc_id")
    return out.select("item_id", "instance.source", "evidence_idx")


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 10 AS instance_id, (row_number() OVER (ORDER BY doc_id) - 1) % 10 AS chunk_idx FROM documents")
def c6_batch_chunks(spark, d):
    ranked = ranking.global_rank(docs(spark, d).select("doc_id"), [F.col("doc_id")])
    return C.batch_chunks(ranked, 10, rank="rank").drop("rank")


@query(
    """WITH RECURSIVE t AS (SELECT source AS g, doc_id, list_distinct(['t' || doc_id % 13, 't' || n_chars % 17]) AS h, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
    p AS (SELECT g, i, 0::BIGINT AS batch, h AS held FROM t WHERE i = 1
      UNION ALL SELECT t.g, t.i, CASE WHEN len(list_distinct(list_concat(p.held, t.h))) > 5 THEN p.batch + 1 ELSE p.batch END,
        CASE WHEN len(list_distinct(list_concat(p.held, t.h))) > 5 THEN t.h ELSE list_distinct(list_concat(p.held, t.h)) END FROM p JOIN t ON t.g = p.g AND t.i = p.i + 1)
    SELECT g AS source, doc_id, batch FROM p JOIN t USING (g, i)"""
)
def c7_batch_by_title_budget(spark, d):
    rows = docs(spark, d).select("source", "doc_id", F.array(F.concat(F.lit("t"), F.col("doc_id") % 13), F.concat(F.lit("t"), F.col("n_chars") % 17)).alias("titles"))
    return C.batch_by_title_budget(rows, 5, shard="source", order="doc_id", titles="titles")


@query("SELECT greatest(floor(100000 / avg(n_chars)), 1)::BIGINT AS k FROM documents")
def c8_derive_budget(spark, d):
    return C.derive_budget(docs(spark, d), 100000, tokens="n_chars").select(F.col("k").cast("long").alias("k"))


@query("SELECT conv_id, count(*) AS n FROM conversations WHERE length(text) // 4 < 200 GROUP BY conv_id HAVING count(*) BETWEEN 2 AND 6")
def c9_filter_qas(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(F.col("text").alias("question"))).alias("qas"))
    out = C.filter_qas(rows, qas="qas", max_tokens=200, min_count=2, max_count=6, counter=lambda c: token_count(c, "quarter"))
    return out.select("conv_id", F.size("qas").cast("long").alias("n"))


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(concat_ws('|', 'sample', doc_id::VARCHAR)), doc_id) AS r FROM documents) WHERE r <= 10")
def c10_sample_per_group(spark, d):
    return curation.sample_per_group(docs(spark, d).select("doc_id", "source"), 10, group=["source"], key="doc_id")


@query("SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) BETWEEN 4 AND 6")
def c11_filter_chunk_count(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list("text").alias("chunks"))
    return C.filter_chunk_count(rows, 4, 6, chunks="chunks").select("conv_id")


@query("WITH r AS (SELECT doc_id, text, row_number() OVER (ORDER BY md5(concat_ws('|', 'disjoint', doc_id::VARCHAR)), doc_id) - 1 AS r, count(*) OVER () AS n FROM documents) SELECT doc_id, r // 12 AS instance_id, CASE WHEN r % 12 < 9 THEN 'chunk' ELSE 'qa' END AS role, length(CASE WHEN r % 12 = 0 THEN substr(text, 1, 1000) ELSE text END) AS chars FROM r WHERE r // 12 < 50 AND (r // 12 + 1) * 12 <= n")
def c12_assign_disjoint(spark, d):
    h = seeded("disjoint", F.col("doc_id"))
    ranked = ranking.global_rank(docs(spark, d).select("doc_id", "text"), [h, F.col("doc_id")])
    return C.assign_disjoint(ranked, 50, 9, 3, rank="rank", text="text").select("doc_id", "instance_id", "role", F.length("text").cast("long").alias("chars"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN NULL WHEN lang = source THEN 'A' ELSE 'B' END AS key, 'Which?' || chr(10) || 'A. ' || lang || chr(10) || 'B. ' || source || chr(10) || 'C. ' || source AS question FROM documents")
def c13_options_to_key(spark, d):
    options = F.concat(F.lit('{"A":"'), "lang", F.lit('","B":"'), "source", F.lit('","C":"'), "source", F.lit('"}'))
    rows = docs(spark, d).select("doc_id", options.alias("options"), F.when(F.col("doc_id") % 4 == 3, "other").otherwise(F.col("source")).alias("answer"), F.lit("Which?").alias("question"))
    return C.options_to_key(rows, options="options", answer="answer", question="question").select("doc_id", "key", "question")


@query("SELECT doc_id, string_agg(role, '|' ORDER BY turn) AS qas FROM documents JOIN conversations ON doc_id = conv_id GROUP BY doc_id")
def c14_join_docs_questions(spark, d):
    out = C.join_docs_questions(docs(spark, d).select("doc_id"), table(spark, d, "conversations"), doc="doc_id", question_doc="conv_id", order="turn", fields=["role"])
    return out.select("doc_id", F.array_join(F.transform("qas", lambda q: q["role"]), "|").alias("qas"))


@query("WITH p AS (SELECT DISTINCT lang, doc_id::VARCHAR AS pid FROM documents), c AS (SELECT lang, doc_id || '_' || n_chars AS cid FROM documents) SELECT p.lang, pid, cid FROM p LEFT JOIN c ON p.lang = c.lang AND starts_with(cid, pid)")
def c15_prefix_join(spark, d):
    parents = docs(spark, d).select("lang", F.col("doc_id").cast("string").alias("pid"))
    children = docs(spark, d).select("lang", F.concat_ws("_", "doc_id", "n_chars").alias("cid"))
    return C.prefix_join(parents, children, group="lang", parent="pid", child="cid").select("lang", "pid", "cid")


@query("SELECT concat_ws('-', source, doc_id // 100) AS person, lang AS section, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'e' || (doc_id % 3) END AS id, 'q' || doc_id AS question, 'a' || n_chars AS answer FROM documents WHERE lang <> 'fr'")
def c16_flatten_nested_qas(spark, d):
    one = F.struct(F.concat(F.lit("q"), "doc_id").alias("question"), F.concat(F.lit("a"), "n_chars").alias("answer"))
    ids = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("e"), F.col("doc_id") % 3))
    person = F.concat_ws("-", "source", F.floor(F.col("doc_id") / 100))  # a hundred documents a person at most
    lists = docs(spark, d).groupBy(person.alias("person"), "lang", ids.alias("id")).agg(F.collect_list(one).alias("qas"))
    by_id = lists.groupBy("person", "lang").agg(F.map_from_entries(F.collect_list(F.struct("id", "qas"))).alias("ids"))
    people = by_id.groupBy("person").agg(F.map_from_entries(F.collect_list(F.struct("lang", "ids"))).alias("sections"))
    return C.flatten_nested_qas(people, person="person", sections="sections", skip=("fr",))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source || '|' || lang WHEN 1 THEN source ELSE '' END AS ids FROM documents")
def c17_parse_id_list(spark, d):
    text = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("['"), "source", F.lit("', \""), "lang", F.lit('"]'))).when(F.col("doc_id") % 4 == 1, F.col("source")).when(F.col("doc_id") % 4 == 2, "['broken").otherwise(" ")
    return docs(spark, d).select("doc_id", F.array_join(C.parse_id_list(text), "|").alias("ids"))


@query("WITH k AS (SELECT DISTINCT source FROM documents WHERE doc_id % 41 = 0) SELECT doc_id FROM documents d WHERE doc_id % 3 <> 2 AND (source IN (SELECT source FROM k) OR 'src' || (n_chars % 20) IN (SELECT source FROM k))")
def c18_filter_covered_qas(spark, d):
    rows = docs(spark, d)
    covered = rows.where("doc_id % 41 = 0").select(F.concat("source", F.lit("#"), "doc_id").alias("id"))
    kind = F.element_at(F.array(F.lit("events"), F.lit("dialogues"), F.lit("other")), (F.col("doc_id") % 3 + 1).cast("int"))
    asked = rows.select("doc_id", kind.alias("kind"), F.array(F.col("source"), F.concat(F.lit("src"), F.col("n_chars") % 20)).alias("ids"))
    return C.filter_covered_qas(asked, covered, key="doc_id", kind="kind", ids="ids").select("doc_id")


@query("SELECT doc_id FROM documents WHERE NOT contains(source, '7') AND source NOT IN ('src1', 'src2')")
def c19_exclude_sources(spark, d):
    return C.exclude_sources(docs(spark, d), source="source", containing=("7",), equal=("src1", "src2")).select("doc_id")


@query("WITH l AS (SELECT conv_id, list(text ORDER BY turn) FILTER (role = 'user') AS q, list(text ORDER BY turn) FILTER (role = 'assistant') AS a FROM conversations GROUP BY conv_id), n AS (SELECT *, unnest(range(0, least(len(q), len(a)))) AS position FROM l WHERE q IS NOT NULL AND a IS NOT NULL) SELECT conv_id, position, q[position + 1] AS question, a[position + 1] AS answer FROM n")
def c20_zip_qas(spark, d):
    said = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"])
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(said("user").alias("q"), said("assistant").alias("a"))
    return C.zip_qas(rows, key="conv_id", questions="q", answers="a").withColumn("position", F.col("position").cast("long"))


@query("SELECT item_id, i AS instance_id, row_number() OVER (PARTITION BY i ORDER BY md5(concat_ws('|', 'copy', i::VARCHAR, item_id::VARCHAR)), item_id) - 1 AS place FROM benchmark, range(4) t(i)")
def c21_replicate_shuffled(spark, d):
    out = C.replicate_shuffled(table(spark, d, "benchmark").select("item_id"), 4, key="item_id")
    return out.select("item_id", F.col("instance_id").cast("long").alias("instance_id"), F.col("place").cast("long").alias("place"))


@query("SELECT item_id, 'Name the label of: ' || text AS classify, text || ' (between 2024-01-01 and ' || strftime(DATE '2024-01-01' + item_id::INT, '%Y-%m-%d') || ')' AS dated FROM benchmark")
def c22_question_tag(spark, d):
    last = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("item_id").cast("int")), "yyyy-MM-dd")
    t = F.col("text")
    return table(spark, d, "benchmark").select("item_id", C.question_tag(t, "classify").alias("classify"), C.question_tag(t, "dated", F.lit("2024-01-01"), last).alias("dated"))
