"""Roll-ups on scored documents, orders (prompts) with their lineitems (samples), and events (steps)."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom.functions.text import seeded, token_count
from memloom.operators import metrics as M
from memloom.operators import scoring
from memloom.plans.registry import query, table
from memloom.plans.scoring_queries import SCORED, results


def scored(spark, d):
    return scoring.score_results(results(spark, d)).withColumn("score", F.round("score", 6)).withColumn("instance", F.floor(F.col("doc_id") / 10))


@query(f"WITH i AS (SELECT doc_id // 10 AS instance, min(source) AS source, avg(score) AS mean, count(*) AS n FROM ({SCORED}) GROUP BY 1) SELECT source, count(*) AS n_instances, sum(n)::BIGINT AS n_results, round(avg(mean), 6) AS score FROM i GROUP BY source")
def h1_instance_then_source(spark, d):
    return M.instance_then_source(scored(spark, d), instance="instance", source="source").withColumn("score", F.round("score", 6))


_AGENTS = f"""WITH i AS (SELECT source AS agent, data_source, doc_id // 100 AS instance, avg(score) AS m, count(*) AS n FROM ({SCORED}) GROUP BY ALL),
a AS (SELECT agent, count(*) AS n_instances, sum(n)::BIGINT AS n_results, avg(m) AS mean, min(m) AS least, max(m) AS greatest, stddev_pop(m) AS spread FROM (SELECT agent, instance, sum(m * n) / sum(n) AS m, sum(n) AS n FROM i GROUP BY ALL) GROUP BY agent),
k AS (SELECT source AS agent, sum(length(text) // 4)::BIGINT AS memory FROM documents GROUP BY source)"""
_ROUNDED = "round(mean, 6) AS mean, round(least, 6) AS least, round(greatest, 6) AS greatest, round(spread, 6) AS spread"


def _agents(spark, d):
    rows = scored(spark, d).withColumn("agent", F.col("source")).withColumn("instance", F.floor(F.col("doc_id") / 100))
    memory = table(spark, d, "documents").groupBy(F.col("source").alias("agent")).agg(F.sum(token_count(F.col("text"), "quarter")).alias("memory"))
    return M.agent_metrics(rows, agent="agent", instance="instance", memory=memory)


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("mean", "least", "greatest", "spread")})


@query(f"{_AGENTS} SELECT agent, n_instances, n_results, {_ROUNDED}, memory FROM a LEFT JOIN k USING (agent)")
def h2_agent_metrics(spark, d):
    return _rounded(_agents(spark, d))


@query(f"{_AGENTS}, s AS (SELECT substr(agent, 1, 4) AS source, count(*) AS n_agents, sum(n_instances)::BIGINT AS n_instances, avg(mean) AS mean, min(least) AS least, max(greatest) AS greatest, stddev_pop(mean) AS spread, avg(memory) AS memory FROM a LEFT JOIN k USING (agent) GROUP BY 1) SELECT source, n_agents, n_instances, {_ROUNDED}, round(memory, 4) AS memory FROM s")
def h3_source_summary(spark, d):
    return _rounded(M.source_summary(_agents(spark, d).withColumn("source", F.substring("agent", 1, 4)), source="source")).withColumn("memory", F.round("memory", 4))


_LONG = "SELECT event_type, avg(value) AS reward, avg(value / (value + 10)) AS compression, avg((user_id % 3 = 0)::INT) AS call_success FROM events GROUP BY 1"


@query(f"SELECT event_type, metric, round(value, 6) AS value FROM (UNPIVOT ({_LONG}) ON reward, compression, call_success INTO NAME metric VALUE value)")
def h4_validation_metrics(spark, d):
    e = table(spark, d, "events").select("event_type", F.col("value").alias("reward"), (F.col("value") / (F.col("value") + 10)).alias("compression"), (F.col("user_id") % 3 == 0).cast("double").alias("call_success"))
    return M.long_metrics(e, source="event_type", metrics=["reward", "compression", "call_success"]).withColumn("value", F.round("value", 6))


@query("WITH t AS (SELECT event_type, user_id, avg(value) AS call, (user_id % 4)::DOUBLE AS acc FROM events GROUP BY ALL) SELECT event_type, round(avg(call), 6) AS call, round(avg(acc), 6) AS acc FROM t GROUP BY event_type")
def h5_train_metrics(spark, d):
    e = table(spark, d, "events").select("event_type", "user_id", F.col("value").alias("call"), (F.col("user_id") % 4).cast("double").alias("acc"))
    return M.train_metrics(e, source="event_type", trajectory="user_id", call="call", metrics=["acc"]).select("event_type", F.round("call", 6).alias("call"), F.round("acc", 6).alias("acc"))


@query("SELECT o_orderpriority, round(avg(m), 4) AS score FROM (SELECT o_orderkey, o_orderpriority, avg(l_extendedprice) AS m FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL) GROUP BY 1")
def h6_offline_eval(spark, d):
    samples = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_extendedprice").alias("scores"))
    rows = table(spark, d, "orders").join(samples, F.col("o_orderkey") == F.col("l_orderkey"))
    return M.offline_eval(rows, source="o_orderpriority", scores="scores").withColumn("score", F.round("score", 4))


#: Samples that a task sorts and groups by prompt.
SAMPLES_A_TASK = 250_000


def samples(spark, d):
    """Orders as prompts (uid), lineitems as their samples: reward, an order within the prompt, and a source."""
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("uid"), (F.col("l_extendedprice") / 1000).alias("reward"), F.col("l_quantity").cast("long").alias("len"), "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("uid"), F.col("o_orderpriority").alias("source"))
    # as many tasks as rows ask for: what they sort and group by prompt does not grow with the table
    n = max(spark.sparkContext.defaultParallelism, l.count() // SAMPLES_A_TASK + 1)
    return l.repartition(n, "uid").join(o.repartition(n, "uid"), "uid")


SAMPLES = "SELECT l_orderkey AS uid, l_extendedprice / 1000 AS reward, l_quantity::BIGINT AS len, l_linenumber, l_partkey, l_suppkey, l_returnflag, o_orderpriority AS source FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


@query(f"WITH p AS (SELECT source, uid, count(*) AS n, avg(reward) AS m, stddev_pop(reward) AS s FROM ({SAMPLES}) GROUP BY ALL) SELECT source, n, round(avg(m), 6) AS mean, round(avg(s) FILTER (n > 1), 6) AS std, count(*) AS n_prompts FROM p GROUP BY source, n")
def h7_mean_std_at_n(spark, d):
    return M.mean_std_at_n(samples(spark, d), source="source", prompt="uid", value="reward").withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query(
    f"""WITH p AS (SELECT source, uid, count(*) AS n, avg(reward) AS m1, stddev_pop(reward) AS s1, avg(len) AS m2, stddev_pop(len) AS s2 FROM ({SAMPLES}) GROUP BY ALL),
    v AS (SELECT source, n, 'reward' AS variable, m1 AS m, s1 AS s FROM p UNION ALL SELECT source, n, 'len', m2, s2 FROM p)
    SELECT source, variable, n, round(avg(m), 6) AS mean, round(avg(s) FILTER (n > 1), 6) AS std, count(*) AS n_prompts FROM v GROUP BY ALL"""
)
def h7b_mean_std_by_variable(spark, d):
    out = M.mean_std_at_n_by_variable(samples(spark, d), source="source", prompt="uid", variables=["reward", "l_returnflag", "len"])
    return out.select("source", "variable", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n_prompts")


@query(
    f"""WITH r AS (SELECT *, count(*) OVER (PARTITION BY uid) AS cn, row_number() OVER (PARTITION BY uid ORDER BY reward) AS i FROM ({SAMPLES})),
    e AS (SELECT r.*, unnest(list_distinct(list_filter([2, 4, 8, 16, 32, 64, cn], lambda x: x <= cn AND x > 1))) AS n FROM r),
    p AS (SELECT source, uid, n, sum((pow(i / cn, n) - pow((i - 1) / cn, n)) * reward) AS b1, sum((pow(i / cn, n) - pow((i - 1) / cn, n)) * reward * reward) AS b2,
      sum((pow((cn - i + 1) / cn, n) - pow((cn - i) / cn, n)) * reward) AS w1, sum((pow((cn - i + 1) / cn, n) - pow((cn - i) / cn, n)) * reward * reward) AS w2 FROM e GROUP BY ALL)
    SELECT source, n, round(avg(b1), 5) AS best, round(avg(sqrt(greatest(b2 - b1 * b1, 0))), 5) AS best_std, round(avg(w1), 5) AS worst, round(avg(sqrt(greatest(w2 - w1 * w1, 0))), 5) AS worst_std FROM p GROUP BY source, n"""
)
def h8_best_worst_at_n(spark, d):
    out = M.best_worst_at_n(samples(spark, d), source="source", prompt="uid", value="reward")
    return out.select("source", F.col("n").cast("long").alias("n"), *[F.round(c, 5).alias(c) for c in ("best", "best_std", "worst", "worst_std")])


@query(f"WITH s AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos FROM ({SAMPLES})), v AS (SELECT uid, l_returnflag AS pred, count(*) AS votes, min(pos) AS first, round(arg_min(reward, pos), 6) AS value FROM s GROUP BY ALL) SELECT uid, pred, value, votes FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY votes DESC, first) AS r FROM v) WHERE r = 1")
def h9_majority(spark, d):
    place = F.row_number().over(M.Window.partitionBy("uid").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    rows = samples(spark, d).withColumn("pos", place)
    return M.majority(rows, group="uid", pred="l_returnflag", value="reward", order="pos").select("uid", F.col("l_returnflag").alias("pred"), F.round("value", 6).alias("value"), "votes")


@query()
def h9b_majority_at_n(spark, d):
    place = F.row_number().over(M.Window.partitionBy("uid").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    rows = samples(spark, d).withColumn("pos", place)
    return M.majority_at_n(rows, source="source", prompt="uid", pred="l_returnflag", value="reward", order="pos", resamples=200)


def _drawn(size: str, tries: int) -> str:
    """Mean and maximum of a user's event values over resamples; a draw is the value of the number that a digest names."""
    return f"""WITH e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS place, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL),
    k AS (SELECT user_id, max(n) AS n, unnest(range(0, {tries})) AS r FROM e GROUP BY user_id),
    j AS (SELECT user_id, n, r, unnest(range(0, {size})) AS j FROM k),
    d AS (SELECT user_id, r, ('0x' || substr(md5(concat_ws('|', '42', user_id::VARCHAR, r::VARCHAR, j::VARCHAR)), 1, 15))::BIGINT % n AS place FROM j),
    s AS (SELECT user_id, r, max(value) AS a, avg(value) AS b FROM d JOIN e USING (user_id, place) GROUP BY ALL),
    o AS (SELECT user_id, 'max' AS statistic, avg(a) AS mean, stddev_pop(a) AS std FROM s GROUP BY user_id UNION ALL SELECT user_id, 'mean', avg(b), stddev_pop(b) FROM s GROUP BY user_id)
    SELECT user_id, statistic, round(mean, 9) AS mean, round(std, 9) AS std FROM o"""


def _bootstrap(spark, d, **how):
    out = M.bootstrap(table(spark, d, "events"), group="user_id", value="value", statistics={"max": F.max, "mean": F.avg}, **how)
    return out.withColumns({"mean": F.round("mean", 9), "std": F.round("std", 9)})


@query(_drawn("8", 200))
def h10_bootstrap(spark, d):
    return _bootstrap(spark, d, size=8, resamples=200)


@query(_drawn("n", 50))
def h10b_bootstrap_whole(spark, d):
    return _bootstrap(spark, d, resamples=50)


def rollouts(spark, d):
    """Per user, a rollout of its events in time order: token rewards, values, log-probabilities and a mask."""
    e = table(spark, d, "events").select("user_id", F.struct("ts", "event_id", "value", "event_type").alias("e"))
    ev = e.groupBy("user_id").agg(F.array_sort(F.collect_list("e")).alias("e"))
    of = lambda f: F.transform("e", f)
    return ev.select(
        "user_id",
        (F.col("user_id") % 5).alias("step"),
        of(lambda x: x["value"]).alias("rewards"),
        of(lambda x: x["value"] * 0.9 + 1).alias("vals"),
        of(lambda x: -(x["event_id"] % 7) / 10.0).alias("lp"),
        of(lambda x: -(x["event_id"] % 5) / 10.0).alias("old"),
        of(lambda x: (x["event_id"] % 6 != 0).cast("int")).alias("mask"),
        F.size("e").alias("len"),
        F.aggregate("e", F.lit(0.0), lambda a, x: a + x["value"]).alias("score"),
    )


TOKENS = "SELECT user_id, user_id % 5 AS step, ts, event_id, value, value * 0.9 + 1 AS val, -(event_id % 7) / 10.0 AS lp, -(event_id % 5) / 10.0 AS old, (event_id % 6 <> 0)::INT AS mask FROM events"


@query(
    f"""WITH t AS ({TOKENS}), u AS (SELECT user_id, step, count(*) AS len, sum(value) AS score FROM t GROUP BY ALL),
    a AS (SELECT step, avg(score) AS score_mean, max(score) AS score_max, min(score) AS score_min, avg(len) AS len_mean, max(len) AS len_max, min(len) AS len_min, avg((len >= 70)::INT) AS clip_ratio FROM u GROUP BY step),
    b AS (SELECT step, avg(value) AS rewards_mean, max(value) AS rewards_max, min(value) AS rewards_min, 1 - var_samp(value - val) / (var_samp(value) + 1e-5) AS explained FROM t WHERE mask > 0 GROUP BY step)
    SELECT step, round(score_mean, 5) AS score_mean, round(score_max, 5) AS score_max, round(score_min, 5) AS score_min, round(len_mean, 5) AS len_mean, len_max, len_min, round(clip_ratio, 5) AS clip_ratio, round(rewards_mean, 5) AS rewards_mean, round(rewards_max, 5) AS rewards_max, round(rewards_min, 5) AS rewards_min, round(explained, 5) AS explained FROM a JOIN b USING (step)"""
)
def h11_batch_stats(spark, d):
    out = M.batch_stats(rollouts(spark, d), step="step", scalars=["score"], masked=["rewards"], mask="mask", length="len", max_length=70, values="vals", returns="rewards")
    return out.select(*[F.round(c, 5).alias(c) if c not in ("step", "len_max", "len_min") else F.col(c).cast("long").alias(c) for c in out.columns])


@query(f"WITH t AS ({TOKENS}) SELECT step, round(max(abs(exp(lp) - exp(old))), 6) AS greatest, round(avg(abs(exp(lp) - exp(old))), 6) AS mean, round(stddev_samp(abs(exp(lp) - exp(old))), 6) AS spread FROM t WHERE mask > 0 GROUP BY step")
def h11b_prob_drift(spark, d):
    return M.prob_drift(rollouts(spark, d), step="step", a="lp", b="old", mask="mask").select("step", *[F.round(c, 6).alias(c) for c in ("greatest", "mean", "spread")])


@query("WITH e AS (SELECT user_id % 5 AS step, CASE event_id % 3 WHEN 0 THEN 'gen' WHEN 1 THEN 'update' ELSE 'step' END AS stage, value + 1 AS s, user_id % 11 + 1 AS r FROM events), g AS (SELECT step, stage, sum(s) AS s, sum(CASE WHEN stage = 'gen' THEN r ELSE 3 * r END) AS n FROM e GROUP BY ALL) SELECT step, stage, round(s * 1000 / n, 5) AS ms_per_token, round(CASE WHEN stage = 'step' THEN n / (s * 8) END, 5) AS tokens_per_second FROM g")
def h12_throughput(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 5).alias("step"), F.element_at(F.array(F.lit("gen"), F.lit("update"), F.lit("step")), (F.col("event_id") % 3 + 1).cast("int")).alias("stage"), (F.col("value") + 1).alias("s"), (F.col("user_id") % 11 + 1).alias("r")).withColumn("t", F.col("r") * 3)
    out = M.throughput(e, step="step", stage="stage", seconds="s", tokens="t", response_tokens="r", workers=8)
    return out.withColumns({c: F.round(c, 5) for c in ("ms_per_token", "tokens_per_second")})


@query("WITH k AS (SELECT event_type || CASE user_id % 3 WHEN 0 THEN '/max' WHEN 1 THEN '/min' ELSE '/x' END AS key, value FROM events) SELECT key, round(CASE WHEN contains(key, 'max') THEN max(value) WHEN contains(key, 'min') THEN min(value) ELSE avg(value) END, 6) AS value FROM k GROUP BY key")
def h13_reduce_by_name(spark, d):
    e = table(spark, d, "events")
    key = F.concat("event_type", F.when(F.col("user_id") % 3 == 0, "/max").when(F.col("user_id") % 3 == 1, "/min").otherwise("/x"))
    return M.reduce_by_name(e.select(key.alias("key"), "value")).withColumn("value", F.round("value", 6))


_STEPS = "SELECT conv_id, turn, length(text) // 4 AS n, coalesce(sum(length(text) // 4) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c, (conv_id % 3 <> 0)::INT AS m FROM conversations"


@query(f"SELECT conv_id, CASE WHEN max(m) <> 0 THEN sum(n) END::BIGINT AS tokens, CASE WHEN max(m) <> 0 THEN max(c + n) END::BIGINT AS peak, round(sum((c + n // 2) * n) / sum(n), 5) AS dependency, round(arg_max(c, turn) / sum(n), 5) AS compression FROM ({_STEPS}) GROUP BY conv_id HAVING sum(n) > 0")
def h14_trajectory_stats(spark, d):
    n = token_count(F.col("text"), "quarter")
    before = M.Window.partitionBy("conv_id").orderBy("turn").rowsBetween(M.Window.unboundedPreceding, -1)
    steps = table(spark, d, "conversations").select("conv_id", "turn", n.alias("n"), F.coalesce(F.sum(n).over(before), F.lit(0)).alias("c"), (F.col("conv_id") % 3 != 0).cast("int").alias("m"))
    out = M.trajectory_stats(steps, key="conv_id", step="turn", context="c", length="n", matched="m")
    return out.where(F.col("dependency").isNotNull()).withColumns({"dependency": F.round("dependency", 5), "compression": F.round("compression", 5)})


_PARTS = "SELECT conv_id, turn // 3 AS step, max(length(text) // 4) FILTER (turn % 3 = 0) AS t, max(length(text) // 4) FILTER (turn % 3 = 1) AS r, max(length(text) // 4) FILTER (turn % 3 = 2) AS i, (conv_id % 3 <> 0)::INT AS m FROM conversations GROUP BY ALL"


@query(
    f"""WITH p AS ({_PARTS}), q AS (SELECT conv_id, step, m, coalesce(t, 0) AS t, coalesce(r, 0) AS r, coalesce(i, 0) AS i, r IS NOT NULL AS acts FROM p),
    c AS (SELECT *, coalesce(lag(t + r + i) OVER w, 0) AS c, coalesce(sum(t + r + i) OVER (PARTITION BY conv_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM q WINDOW w AS (PARTITION BY conv_id ORDER BY step)),
    s AS (SELECT conv_id, max(m) AS m, sum(t + r + i) AS n, max(c + t + r) AS peak, sum((c + t // 2) * t + (c + t + r // 2) * r + (t + r + i // 2) * i) AS work, sum((f + t // 2) * t + (f + t + r // 2) * r + (f + t + r + i // 2) * i) AS whole, arg_max(c + t + r, step) FILTER (acts) AS last FROM c GROUP BY conv_id)
    SELECT conv_id, CASE WHEN m <> 0 THEN n END::BIGINT AS tokens, CASE WHEN m <> 0 AND peak > 0 THEN peak END::BIGINT AS peak, round(work / n, 5) AS dependency, round(whole / n, 5) AS dependency_full, round(coalesce(last, 0) / n, 5) AS compression FROM s WHERE n > 0"""
)
def h14b_trajectory_steps(spark, d):
    n = token_count(F.col("text"), "quarter")
    part = lambda k: F.max(F.when(F.col("turn") % 3 == k, n))
    steps = table(spark, d, "conversations").groupBy("conv_id", F.floor(F.col("turn") / 3).alias("step")).agg(part(0).alias("t"), part(1).alias("r"), part(2).alias("i"))
    out = M.trajectory_stats_from_steps(steps.withColumn("m", (F.col("conv_id") % 3 != 0).cast("int")), key="conv_id", step="step", think="t", act="r", info="i", matched="m")
    return out.where(F.col("dependency").isNotNull()).select("conv_id", "tokens", "peak", *[F.round(c, 5).alias(c) for c in ("dependency", "dependency_full", "compression")])


@query("SELECT doc_id, n_chars FROM documents ORDER BY md5(concat_ws('|', 'log', doc_id::VARCHAR)) LIMIT 20")
def h15_sample_for_logging(spark, d):
    return M.sample_for_logging(table(spark, d, "documents").select("doc_id", "n_chars"), 20, order=seeded("log", F.col("doc_id")))
