"""Memory logs from events: a user is an instance, a day a chunk, the event's key an id, its type an operation."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom.operators import memory as M
from memloom.plans.registry import query, table

_NAMES = "['insert', 'update', 'delete', 'insert', 'insert'][(event_id % 5) + 1]"
OPS = f"SELECT user_id, day(ts) AS chunk_idx, event_id AS op_idx, {_NAMES} AS name, CASE WHEN event_id % 11 = 0 THEN 'core' WHEN event_id % 2 = 0 THEN 'semantic' ELSE 'episodic' END AS memory_type, 'k' || (event_id % 23) AS memory_id, repeat(event_type || ' ', CASE WHEN event_id % 11 = 0 THEN 1 + event_id % 7 ELSE 1 END) || (event_id % 37) AS content FROM events"
#: Words of core memory in these queries; operations on it have 2 to 8.
LIMIT = 5


def ops(spark, d):
    e = table(spark, d, "events")
    name = F.element_at(F.array(*[F.lit(x) for x in ("insert", "update", "delete", "insert", "insert")]), (F.col("event_id") % 5 + 1).cast("int"))
    kind = F.when(F.col("event_id") % 11 == 0, "core").when(F.col("event_id") % 2 == 0, "semantic").otherwise("episodic")
    times = F.when(F.col("event_id") % 11 == 0, 1 + F.col("event_id") % 7).otherwise(1).cast("int")
    content = F.concat(F.repeat(F.concat("event_type", F.lit(" ")), times), F.col("event_id") % 37)
    return e.select("user_id", F.day("ts").cast("long").alias("chunk_idx"), F.col("event_id").alias("op_idx"), name.alias("name"), kind.alias("memory_type"), F.concat(F.lit("k"), F.col("event_id") % 23).alias("memory_id"), content.alias("content"))


@query("SELECT conv_id, turn, n::BIGINT AS op_idx, CASE n WHEN 0 THEN 'insert' ELSE 'delete' END AS name, CASE n WHEN 0 THEN 'semantic' ELSE 'episodic' END AS memory_type, CASE n WHEN 0 THEN role ELSE NULL END AS content FROM conversations, (VALUES (0), (1)) t(n) WHERE role = 'assistant' AND (n = 0 OR turn % 2 = 1)")
def e1_extract_tool_calls(spark, d):
    one = F.concat(F.lit('say <tool_call>{"name": "insert", "arguments": {"memory_type": "semantic", "content": "'), "role", F.lit('"}}</tool_call> and '))
    two = F.when(F.col("turn") % 2 == 1, '<tool_call>{"name": "delete", "arguments": {"memory_type": "episodic", "memory_id": "a"}}\n```</tool_call>').otherwise("")
    rows = table(spark, d, "conversations").where("role = 'assistant'").select(F.struct("conv_id", "turn").alias("k"), F.concat(one, two, F.lit('<tool_result> <tool_call>{"name": "no"}</tool_call>')).alias("t"))
    out = M.extract_tool_calls(rows, key="k", text="t")
    return out.select("k.conv_id", "k.turn", F.col("op_idx").cast("long").alias("op_idx"), "name", "arguments.memory_type", "arguments.content")


_HERE = "x.t = o.memory_type AND x.id = o.memory_id"
_SAME = "len(list_filter(p.items, lambda x: x.t = o.memory_type AND x.c = o.content)) > 0"
_KNOWN = f"len(list_filter(p.items, lambda x: {_HERE})) > 0"
_CUT = f"CASE WHEN len(string_split(o.content, ' ')) > {LIMIT} THEN array_to_string(string_split(o.content, ' ')[1:{LIMIT - 1}] || ['[cut]'], ' ') ELSE o.content END"
#: Every operation with its status and what is held after it: one step of the recursion takes the next operation of all users.
FOLD = f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY chunk_idx, op_idx) AS i, count(*) OVER (PARTITION BY user_id) AS last FROM ({OPS})),
p AS (SELECT DISTINCT user_id, 0::BIGINT AS i, '' AS core, []::STRUCT(t VARCHAR, id VARCHAR, c VARCHAR)[] AS items, '' AS status FROM o
  UNION ALL SELECT o.user_id, o.i,
    CASE WHEN o.memory_type <> 'core' THEN p.core WHEN o.name = 'update' THEN {_CUT} WHEN o.name = 'delete' THEN '' ELSE p.core END,
    CASE WHEN o.memory_type = 'core' OR (o.name = 'insert' AND {_SAME}) THEN p.items
      WHEN o.name <> 'delete' AND {_KNOWN} THEN list_transform(p.items, lambda x: CASE WHEN {_HERE} THEN {{'t': x.t, 'id': x.id, 'c': o.content}} ELSE x END)
      WHEN o.name = 'insert' THEN list_append(p.items, {{'t': o.memory_type, 'id': o.memory_id, 'c': o.content}})
      WHEN o.name = 'delete' THEN list_filter(p.items, lambda x: NOT ({_HERE})) ELSE p.items END,
    CASE WHEN o.memory_type = 'core' THEN CASE WHEN o.name = 'insert' THEN 'error' ELSE 'ok' END
      WHEN o.name = 'insert' AND {_SAME} THEN 'skipped' WHEN o.name = 'update' AND NOT ({_KNOWN}) THEN 'error' ELSE 'ok' END
    FROM p JOIN o ON o.user_id = p.user_id AND o.i = p.i + 1)"""
_LOG = "o.user_id, o.chunk_idx, o.op_idx, o.name, o.memory_type, o.memory_id, o.content, p.status"
#: As the stream gives it: with the words held after each operation.
STREAMED = f"{FOLD} SELECT {_LOG}, (CASE WHEN p.core = '' THEN 0 ELSE len(string_split(p.core, ' ')) END + coalesce(list_sum(list_transform(p.items, lambda x: len(string_split(x.c, ' ')))), 0))::BIGINT AS n_tokens FROM o JOIN p USING (user_id, i)"


@query(f"{FOLD} SELECT {_LOG} FROM o JOIN p USING (user_id, i)")
def e2_apply_memory_ops(spark, d):
    return M.apply_memory_ops(ops(spark, d), instance="user_id", core_limit=LIMIT)


@query(
    f"""{FOLD}, e AS (SELECT DISTINCT o.user_id, p.core, p.items FROM o JOIN p ON p.user_id = o.user_id AND p.i = o.last),
    u AS (SELECT user_id, unnest(items) AS x, generate_subscripts(items, 1) AS k FROM e)
    SELECT user_id, 'core' AS memory_type, '' AS memory_id, core AS content, 0 AS pos FROM e WHERE core <> ''
    UNION ALL SELECT user_id, x.t, x.id, x.c, row_number() OVER (PARTITION BY user_id, x.t ORDER BY k) - 1 FROM u"""
)
def e2_memory_state(spark, d):
    return M.memory_state(ops(spark, d), instance="user_id", core_limit=LIMIT)


@query(f"WITH o AS ({OPS}) SELECT user_id, memory_type, memory_id, arg_max(content, op_idx) AS content, min(op_idx) FILTER (name = 'insert') AS first FROM o GROUP BY ALL HAVING arg_max(name, op_idx) <> 'delete'")
def e3_final_state_by_id(spark, d):
    out = M.final_state_by_id(ops(spark, d), keys=["user_id", "memory_type", "memory_id"], order=["op_idx"], name="name", content="content")
    return out.withColumn("first", F.col("first.op_idx"))


@query(f"WITH o AS ({OPS}) SELECT user_id, memory_type, content, min(op_idx) AS op_idx FROM o WHERE name = 'insert' GROUP BY ALL")
def e4_dedup_inserts(spark, d):
    return M.dedup_inserts(ops(spark, d).where("name = 'insert'"), keys=["user_id", "memory_type"], content="content", order=["op_idx"])


_W = r"list_filter(string_split_regex(text, '[ \t\n\r\f\v]+'), lambda x: x <> '')"


@query(f"SELECT doc_id, CASE WHEN len({_W}) > 50 THEN array_to_string(({_W})[1:48] || ['and', 'more'], ' ') ELSE text END AS core FROM documents")
def e5_truncate_core(spark, d):
    return table(spark, d, "documents").select("doc_id", M.truncate_core(F.col("text"), 50, "and more").alias("core"))


_STATE = "SELECT source, doc_id, text, CASE doc_id % 3 WHEN 0 THEN 'core' WHEN 1 THEN 'semantic' ELSE 'episodic' END AS memory_type FROM documents"


def state(spark, d):
    kind = F.when(F.col("doc_id") % 3 == 0, "core").when(F.col("doc_id") % 3 == 1, "semantic").otherwise("episodic")
    return table(spark, d, "documents").select("source", F.col("doc_id").cast("string").alias("memory_id"), F.col("doc_id").alias("pos"), F.col("text").alias("content"), kind.alias("memory_type"))


@query(f"SELECT source, sum(len({_W}))::BIGINT AS n_tokens FROM ({_STATE}) WHERE memory_type <> 'episodic' GROUP BY source")
def e6_memory_size(spark, d):
    return M.memory_size(state(spark, d), instance="source", enabled=("core", "semantic"))


@query(f"SELECT source, memory_type, doc_id AS pos, total, least(total, 5) AS shown FROM (SELECT *, row_number() OVER (PARTITION BY source, memory_type ORDER BY doc_id DESC) AS r, count(*) OVER (PARTITION BY source, memory_type) AS total FROM ({_STATE})) WHERE r <= 5")
def e7_recent_items(spark, d):
    return M.recent_items(state(spark, d), 5, instance="source").select("source", "memory_type", "pos", "total", "shown")


@query("WITH s AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 'core' WHEN 'user' THEN 'semantic' ELSE 'episodic' END AS t, text FROM conversations WHERE turn > 0), b AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) FILTER (t = 'core') AS core, string_agg('[m' || turn || '] ' || text, chr(10) ORDER BY turn) FILTER (t = 'semantic') AS semantic, string_agg('[m' || turn || '] ' || text, chr(10) ORDER BY turn) FILTER (t = 'episodic') AS episodic FROM s GROUP BY conv_id) SELECT c.conv_id, core, coalesce(semantic, 'Empty.') AS semantic, coalesce(episodic, 'Empty.') AS episodic FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN b USING (conv_id)")
def e8_render_memory(spark, d):
    turns = table(spark, d, "conversations")
    kind = F.when(F.col("role") == "system", "core").when(F.col("role") == "user", "semantic").otherwise("episodic")
    held = turns.where("turn > 0").select("conv_id", kind.alias("memory_type"), F.concat(F.lit("m"), "turn").alias("memory_id"), F.col("text").alias("content"), F.col("turn").alias("pos"))
    return M.render_memory(turns.select("conv_id").distinct(), held, instance="conv_id")


@query(f"WITH o AS ({OPS}) SELECT op_idx, CASE WHEN op_idx % 17 = 0 THEN 'missing' WHEN name NOT IN ('insert', 'update') THEN 'name' WHEN op_idx % 13 = 0 THEN 'no_type' WHEN op_idx % 19 = 0 THEN 'type' WHEN op_idx % 7 = 0 THEN 'blank' END AS error_code FROM o")
def e9_validate_calls(spark, d):
    i = F.col("op_idx")
    rows = ops(spark, d).withColumns({"arguments": F.when(i % 17 != 0, "x"), "memory_type": F.when(i % 13 == 0, F.lit(None)).when(i % 19 == 0, "odd").otherwise(F.col("memory_type")), "content": F.when(i % 7 == 0, " ").otherwise(F.col("content"))})
    return M.validate_calls(rows).select("op_idx", "error_code")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE quality = 1 END AS valid, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'why ' || doc_id END AS explanation, CASE WHEN doc_id % 3 <> 0 AND quality = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM labels")
def e10_parse_verdict(spark, d):
    said = F.concat(F.lit('So:\n```json\n{"VALID": '), F.when(F.col("doc_id") % 3 == 0, '"yes"').when(F.col("quality") == 1, "true").otherwise("false"), F.lit(', "ISSUES": ["a"], "EXPLANATION": "why '), "doc_id", F.lit('"}\n``` done'))
    out = table(spark, d, "labels").select("doc_id", M.parse_verdict(said).alias("v"))
    return out.select("doc_id", "v.valid", "v.explanation", "v.score")


@query("WITH m AS (SELECT doc_id // 10 AS g, avg(CASE WHEN doc_id % 4 = 0 THEN 0 ELSE quality END) AS s FROM labels GROUP BY 1) SELECT g, round(coalesce(s, 0), 6) AS score FROM (SELECT DISTINCT doc_id // 10 AS g FROM documents) LEFT JOIN m USING (g)")
def e11_group_mean_scores(spark, d):
    items = table(spark, d, "labels").select(F.floor(F.col("doc_id") / 10).alias("g"), F.when(F.col("doc_id") % 4 == 0, "n/a").otherwise(F.col("quality").cast("string")).alias("s"))
    groups = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 10).alias("g")).distinct()
    return M.group_mean_scores(groups, items, key="g", score="s").withColumn("score", F.round("score", 6))


@query(f"WITH o AS ({OPS}), r AS (SELECT user_id, chunk_idx, avg((name <> 'delete')::INT) AS rate FROM o WHERE op_idx % 3 = 0 GROUP BY ALL) SELECT user_id, chunk_idx, round(coalesce(rate, 0), 6) AS rate FROM (SELECT DISTINCT user_id, chunk_idx FROM o) LEFT JOIN r USING (user_id, chunk_idx)")
def e12_call_success_rate(spark, d):
    log = ops(spark, d)
    calls = log.where("op_idx % 3 = 0").withColumn("status", F.when(F.col("name") == "delete", "skipped").otherwise("ok"))
    return M.call_success_rate(log.select("user_id", "chunk_idx").distinct(), calls, keys=["user_id", "chunk_idx"]).withColumn("rate", F.round("rate", 6))


@query(f"WITH o AS ({OPS}), r AS (SELECT user_id, chunk_idx, string_agg(name || ':' || memory_id, ',' ORDER BY op_idx) AS calls FROM o WHERE op_idx % 3 = 0 GROUP BY ALL) SELECT user_id, chunk_idx, coalesce(calls, '') AS calls FROM (SELECT DISTINCT user_id, chunk_idx FROM o) LEFT JOIN r USING (user_id, chunk_idx)")
def e13_attach_calls(spark, d):
    log = ops(spark, d)
    out = M.attach_calls(log.select("user_id", "chunk_idx").distinct(), log.where("op_idx % 3 = 0"), keys=["user_id", "chunk_idx"], order="op_idx", fields=["name", "memory_id"])
    return out.withColumn("calls", F.array_join(F.transform("calls", lambda c: F.concat_ws(":", c["name"], c["memory_id"])), ","))
