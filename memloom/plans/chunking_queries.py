"""Chunking of documents (a source is a group, words are tokens) and of conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom.functions.text import newline_numbered, token_count
from memloom.operators import chunking as C
from memloom.plans.registry import query, spread, table

_W = r"len(list_filter(string_split_regex(trim({}), '[ \t\n\r\f\v]+'), lambda x: x <> ''))"


def docs(spark, d):
    return spread(table(spark, d, "documents")).withColumn("n", token_count(F.col("text")))


def _pack(items: str, most: int, sep: int) -> str:
    """Greedy packing of (g, i, n), i = 1.., in a recursive query."""
    return f"""p AS (SELECT g, i, n, 0::BIGINT AS c, n + {sep} AS used FROM {items} WHERE i = 1
    UNION ALL SELECT t.g, t.i, t.n, CASE WHEN p.used + t.n > {most} THEN p.c + 1 ELSE p.c END, CASE WHEN p.used + t.n > {most} THEN t.n + {sep} ELSE p.used + t.n + {sep} END FROM p JOIN {items} t ON t.g = p.g AND t.i = p.i + 1)"""


@query(f"SELECT doc_id, {_W.format('text')} AS words, length(text) // 4 AS quarter FROM documents")
def b1_token_count(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", token_count(t).alias("words"), token_count(t, "quarter").alias("quarter"))


@query(f"WITH RECURSIVE t AS (SELECT source AS g, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i, {_W.format('text')} AS n FROM documents), {_pack('t', 2000, 1)} SELECT g AS source, c AS chunk_idx, count(*) AS n_items, trim(string_agg(t.text, chr(10) ORDER BY i)) AS text FROM p JOIN t USING (g, i) GROUP BY g, c")
def b2_pack_greedy(spark, d):
    rows = docs(spark, d)
    return C.join_chunks(rows, C.pack_greedy(rows, group="source", order="doc_id", tokens="n", max_tokens=2000), group="source", order="doc_id", text="text", trim=F.trim)


_TARGET = "102 + ('0x' || substr(md5('pack|' || g || '|' || {}::VARCHAR), 1, 8))::BIGINT % 1947"


@query(
    f"""WITH RECURSIVE t AS (SELECT source AS g, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i, {_W.format('text')} AS n FROM documents),
    p AS (SELECT g, i, 0::BIGINT AS c, n + 1 AS used FROM t WHERE i = 1
      UNION ALL SELECT t.g, t.i, CASE WHEN p.used + t.n > {_TARGET.format('p.c').replace("|| g ||", "|| p.g ||")} THEN p.c + 1 ELSE p.c END, CASE WHEN p.used + t.n > {_TARGET.format('p.c').replace("|| g ||", "|| p.g ||")} THEN t.n + 1 ELSE p.used + t.n + 1 END FROM p JOIN t ON t.g = p.g AND t.i = p.i + 1)
    SELECT g AS source, doc_id, c AS chunk_idx FROM p JOIN t USING (g, i)"""
)
def b2_pack_variable(spark, d):
    rows = docs(spark, d)
    return C.pack_greedy(rows, group="source", order="doc_id", tokens="n", max_tokens=2048, min_tokens=0)


_SENT = r"SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS s, generate_subscripts(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), 1) AS k FROM documents WHERE doc_id < 300"


@query(f"WITH RECURSIVE s AS ({_SENT}), t AS (SELECT doc_id AS g, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i, s, {_W.format('s')} AS n FROM s WHERE trim(s) <> ''), {_pack('t', 120, 1)} SELECT g AS doc_id, c AS chunk_idx, count(*) AS n_items, trim(string_agg(t.s, ' ' ORDER BY i)) AS text FROM p JOIN t USING (g, i) GROUP BY g, c".replace(" WHERE doc_id < 300", ""))
def b3_chunk_sentences(spark, d):
    return C.chunk_sentences(spread(table(spark, d, "documents")), 120, key="doc_id", text="text", trim=F.trim)


@query(
    f"""WITH RECURSIVE s AS ({_SENT.replace(" WHERE doc_id < 300", "")}), t AS (SELECT doc_id AS g, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i, s, {_W.format('s')} AS n FROM s WHERE trim(s) <> ''),
    p AS (SELECT g, i, (n > 8)::BIGINT AS c, n AS used FROM t WHERE i = 1
      UNION ALL SELECT t.g, t.i, CASE WHEN p.used + t.n > 8 THEN p.c + 1 ELSE p.c END, CASE WHEN p.used + t.n > 8 THEN t.n ELSE p.used + t.n END FROM p JOIN t ON t.g = p.g AND t.i = p.i + 1)
    SELECT g AS doc_id, c AS chunk_idx, count(*) AS n_items, trim(string_agg(t.s, ' ' ORDER BY i)) AS text FROM p JOIN t USING (g, i) GROUP BY g, c
    UNION ALL SELECT g, 0, 0, '' FROM p WHERE i = 1 AND c = 1"""
)
def b3b_chunk_sentences_plain(spark, d):
    return C.chunk_sentences(spread(table(spark, d, "documents")), 8, key="doc_id", text="text", count_sep=False, guard=False, trim=F.trim)


@query(f"WITH RECURSIVE a AS (SELECT source AS g, doc_id, 'd' || doc_id AS title, 'd' || doc_id || ': ' || text AS w FROM documents), b AS (SELECT g, doc_id, title, CASE WHEN {_W.format('w')} > 800 THEN substr(w, 1, 2800) ELSE w END AS w FROM a), t AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id) AS i, title, w, {_W.format('w')} AS n FROM b WHERE {_W.format('w')} <= 800), {_pack('t', 800, 1)} SELECT g AS source, c AS chunk_idx, trim(string_agg(w, chr(10) ORDER BY i)) AS text, string_agg(title, ',' ORDER BY i) AS titles FROM p JOIN t USING (g, i) GROUP BY g, c")
def b4_pack_titled(spark, d):
    rows = spread(table(spark, d, "documents")).withColumn("title", F.concat(F.lit("d"), "doc_id"))
    return C.pack_titled(rows, 800, group="source", order="doc_id", title="title", text="text", trim=F.trim).withColumn("titles", F.array_join("titles", ","))


@query("SELECT conv_id, 'Conversation' || chr(10) || string_agg('<' || upper(role[1]) || role[2:] || '>' || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def b5_render_session(spark, d):
    return C.render_session(table(spark, d, "conversations"), key="conv_id", turn="turn", role="role", text="text")


_LIST = r"list_filter(string_split_regex(trim({}), '[ \t\n\r\f\v]+'), lambda x: x <> '')"


@query(
    rf"""WITH RECURSIVE a AS (SELECT conv_id, turn, role, CASE WHEN {_W.format('text')} > 50 THEN string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) ELSE [text] END AS l, {_W.format('text')} > 50 AS big FROM conversations),
    s AS (SELECT conv_id, turn, role, big, unnest(l) AS s, generate_subscripts(l, 1) AS k FROM a),
    x AS (SELECT *, {_LIST.format('s')} AS w FROM s),
    y AS (SELECT *, unnest(range(0, CASE WHEN big AND len(w) > 50 THEN ceil(len(w) / 50)::BIGINT ELSE 1 END)) AS j FROM x),
    z AS (SELECT conv_id, turn, role, k, j, CASE WHEN big AND len(w) > 50 THEN array_to_string(w[j * 50 + 1:j * 50 + 50], ' ') ELSE s END AS piece FROM y),
    t AS (SELECT conv_id * 1000 + turn AS g, conv_id, turn, role, piece, {_W.format('piece')} AS n, row_number() OVER (PARTITION BY conv_id, turn ORDER BY k, j) AS i FROM z), {_pack('t', 50, 0)}
    SELECT conv_id, turn, c AS part, any_value(role) AS role, regexp_replace(regexp_replace(string_agg(t.piece, ' ' ORDER BY i), '^\s+', ''), '\s+$', '') AS text FROM p JOIN t USING (g, i) GROUP BY conv_id, turn, c"""
)
def b6_split_long_turns(spark, d):
    return C.split_long_turns(spread(table(spark, d, "conversations")), 200, key=["conv_id", "turn"], role="role", text="text")


@query(
    f"""WITH RECURSIVE t AS (SELECT conv_id AS g, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, {_W.format('text')} AS n FROM conversations),
    p AS (SELECT g, i, n, role, 0::BIGINT AS c, 1::BIGINT AS start, n AS used, false AS moved FROM t WHERE i = 1
      UNION ALL SELECT t.g, t.i, t.n, t.role, CASE WHEN p.used + t.n > 150 THEN p.c + 1 ELSE p.c END,
        CASE WHEN p.used + t.n <= 150 THEN p.start WHEN p.role = 'user' AND p.i > p.start THEN p.i ELSE t.i END,
        CASE WHEN p.used + t.n <= 150 THEN p.used + t.n WHEN p.role = 'user' AND p.i > p.start THEN p.n + t.n ELSE t.n END,
        p.used + t.n > 150 AND p.role = 'user' AND p.i > p.start FROM p JOIN t ON t.g = p.g AND t.i = p.i + 1)
    SELECT p.g AS conv_id, t.turn, CASE WHEN coalesce(x.moved, false) THEN x.c ELSE p.c END AS segment FROM p JOIN t ON t.g = p.g AND t.i = p.i LEFT JOIN p x ON x.g = p.g AND x.i = p.i + 1"""
)
def b7_segment_sessions(spark, d):
    turns = table(spark, d, "conversations").withColumn("n", token_count(F.col("text")))
    return C.segment_sessions(turns, 150, key="conv_id", turn="turn", role="role", tokens="n")


@query(
    f"""WITH RECURSIVE t AS (SELECT source AS g, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i, {_W.format('text')} AS n FROM documents),
    p AS (SELECT g, i, 0::BIGINT AS c, n AS used, n BETWEEN 1500 AND 2048 AS closed FROM t WHERE i = 1
      UNION ALL SELECT t.g, t.i, CASE WHEN p.closed OR p.used + t.n > 2048 THEN p.c + 1 ELSE p.c END, CASE WHEN p.closed OR p.used + t.n > 2048 THEN t.n ELSE p.used + t.n END,
        CASE WHEN p.closed OR p.used + t.n > 2048 THEN t.n ELSE p.used + t.n END BETWEEN 1500 AND 2048 FROM p JOIN t ON t.g = p.g AND t.i = p.i + 1)
    SELECT g AS source, doc_id, c AS chunk_idx FROM p JOIN t USING (g, i)"""
)
def b8_merge_segments(spark, d):
    return C.merge_segments(docs(spark, d), 1500, 2048, key="source", order="doc_id", tokens="n")


_PICK = "('0x' || substr(md5(concat_ws('|', '{}', source, doc_id::VARCHAR)), 1, 7))::BIGINT % {}"


@query(f"SELECT doc_id, '[' || strftime(DATE '2024-01-01' + doc_id::INT, '%Y-%m-%d') || ']' || chr(10) || CASE {_PICK.format('wrap', 2)} WHEN 0 THEN 'User: ' || text || chr(10) || 'Assistant: noted.' ELSE 'Keep this: ' || text END AS wrapped FROM documents")
def b9_wrap_chunks(spark, d):
    rows = table(spark, d, "documents")
    return C.wrap_chunks(rows, ["User: %s\nAssistant: noted.", "Keep this: %s"], instance="source", chunk="doc_id", text="text").select("doc_id", "wrapped")


@query(f"WITH g AS (SELECT doc_id, source, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY doc_id) > 1 THEN 1 + {_PICK.format('days', 3)} ELSE 0 END AS gap FROM documents), r AS (SELECT *, DATE '2024-01-01' + (sum(gap) OVER (PARTITION BY source ORDER BY doc_id))::INT AS day FROM g) SELECT doc_id, day::VARCHAR AS day, (min(day) OVER (PARTITION BY source))::VARCHAR AS first_day, (max(day) OVER (PARTITION BY source))::VARCHAR AS last_day FROM r")
def b10_progressive_dates(spark, d):
    out = C.progressive_dates(table(spark, d, "documents").select("doc_id", "source"), instance="source", chunk="doc_id")
    return out.select("doc_id", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("day", "first_day", "last_day")])


@query(r"SELECT doc_id, regexp_replace('Do. 1. ' || text || '. 22. end', '\. (\d+\.)', '.' || chr(10) || '\1', 'g') AS text FROM documents")
def b11_newline_numbered(spark, d):
    return table(spark, d, "documents").select("doc_id", newline_numbered(F.concat(F.lit("Do. 1. "), "text", F.lit(". 22. end"))).alias("text"))


@query("SELECT doc_id, trim(split_part(text, chr(10), 1)) AS sentence, lang AS label FROM documents WHERE doc_id % 2 = 0 AND trim(split_part(text, chr(10), 1)) <> ''")
def b12_parse_labeled_lines(spark, d):
    first = F.substring_index("text", "\n", 1)
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\n"), first, F.lit("\nlabel: "), "lang", F.lit("\nlabel: again"))).otherwise(first)
    return C.parse_labeled_lines(table(spark, d, "documents").select("doc_id", text.alias("text")), key="doc_id", text="text")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source || chr(10) || 'label: ' || lang || chr(10) || chr(10) || 'end' || chr(10) || 'label: z' END AS text FROM documents")
def b13_reformat_labeled_blocks(spark, d):
    good = F.concat("source", F.lit("\nlabel: "), "lang", F.lit("\n\nno label\n\nlabel: empty\n\nend label: z"))
    text = F.when(F.col("doc_id") % 3 == 0, F.lit("a label: b label: c")).otherwise(good)
    return table(spark, d, "documents").select("doc_id", C.reformat_labeled_blocks(text).alias("text"))


@query("SELECT doc_id, ntile(7) OVER (ORDER BY md5(concat_ws('|', 'even', doc_id::VARCHAR)), doc_id) - 1 AS chunk_idx FROM documents")
def b14_distribute_even(spark, d):
    return C.distribute_even(table(spark, d, "documents").select("doc_id"), 7, key="doc_id").withColumn("chunk_idx", F.col("chunk_idx").cast("long"))


@query("WITH c AS (SELECT doc_id, source FROM documents WHERE source NOT IN ('src3', 'src7')), p AS (SELECT source, arg_min(doc_id, [md5(concat_ws('|', 'cover', doc_id::VARCHAR)), doc_id::VARCHAR]) AS doc_id FROM documents WHERE source IN ('src3', 'src7') GROUP BY source) SELECT doc_id, source, 5 AS chunk_idx FROM c UNION ALL SELECT doc_id, source, 0 FROM p".replace("5 AS chunk_idx", "5::BIGINT AS chunk_idx"))
def b15_ensure_label_coverage(spark, d):
    pool = table(spark, d, "documents").select("doc_id", "source")
    chosen = pool.where(~F.col("source").isin("src3", "src7")).withColumn("chunk_idx", F.lit(5).cast("long"))
    return C.ensure_label_coverage(chosen, pool, label="source", key="doc_id")


@query("SELECT doc_id, text || chr(10) || 'label: ' || source || ', ' || lang AS example FROM documents")
def b16_render_example(spark, d):
    return table(spark, d, "documents").select("doc_id", C.render_example(F.col("text"), F.array("source", "lang")).alias("example"))


@query(f"WITH t AS (SELECT source, doc_id, {_W.format('text')} AS n FROM documents), r AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY doc_id) AS run, sum(n) OVER (PARTITION BY source) AS total, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i, count(*) OVER (PARTITION BY source) AS k FROM t), c AS (SELECT source, greatest(least(min(i) FILTER (run >= total / 2), max(k) - 1), 1) AS cut FROM r GROUP BY source) SELECT doc_id, (i > cut)::INT AS side FROM r JOIN c USING (source)")
def b17_split_half(spark, d):
    return C.split_half(docs(spark, d).select("doc_id", "source", "n"), group="source", order="doc_id", tokens="n").select("doc_id", "side")


@query("SELECT doc_id, '<User ' || source || '>hi' || chr(10) || '<Assistant>' || lang AS text FROM documents")
def b18_tag_speakers(spark, d):
    text = F.concat("source", F.lit(": hi Bot (x): "), "lang")
    return table(spark, d, "documents").select("doc_id", C.tag_speakers(text, F.col("source"), F.lit("Bot (x)")).alias("text"))


@query("SELECT doc_id, '<' || source || '> ' || lang AS said FROM documents")
def b19_split_speaker(spark, d):
    messages = F.array(F.concat("source", F.lit(": "), "lang"), F.lit("none"), F.lit("a: b: c"))
    return table(spark, d, "documents").select("doc_id", F.array_join(C.split_speaker(messages), "|").alias("said"))
