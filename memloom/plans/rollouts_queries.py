"""Rollouts: orders are prompts and lineitems their samples; a user's events are a token sequence."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom.operators import rollouts as R
from memloom.plans.metrics_queries import SAMPLES, TOKENS, rollouts, samples
from memloom.plans.registry import query, table

_KEY = ["l_linenumber", "l_partkey", "l_suppkey"]


#: Values here have five or six decimals by birth: moved off the exact halves, they round alike in both engines.
OFF = 3.7e-8


def _round(c):
    return F.round(F.col(c) + OFF, 4).alias(c)


def _out(df, *cols):
    return df.select("uid", *_KEY, *[_round(c) for c in cols])


def _sql(value: str) -> str:
    return f"WITH s AS ({SAMPLES}), g AS (SELECT *, count(*) OVER w AS n, avg(reward) OVER w AS m, stddev_samp(reward) OVER w AS sd, sum(len * reward) OVER w / sum(len) OVER w AS lb FROM s WINDOW w AS (PARTITION BY uid)) SELECT uid, l_linenumber, l_partkey, l_suppkey, round({value} + 3.7e-8, 4) AS advantage FROM g"


@query("SELECT o_orderkey, md5(o_orderkey::VARCHAR) AS uid, unnest([0, 1, 2, 3]) AS sample FROM orders")
def i1_fan_out(spark, d):
    return R.fan_out(table(spark, d, "orders").select("o_orderkey"), 4, key="o_orderkey")


@query("SELECT doc_id, coalesce(r, []::VARCHAR[])::VARCHAR AS responses FROM (SELECT doc_id FROM documents) LEFT JOIN (SELECT conv_id, list(text ORDER BY turn) AS r FROM conversations WHERE role = 'user' GROUP BY conv_id) ON conv_id = doc_id".replace("coalesce(r, []::VARCHAR[])::VARCHAR", "coalesce(array_to_string(r, '|'), '')"))
def i1b_collect_responses(spark, d):
    said = table(spark, d, "conversations").where("role = 'user'").withColumnRenamed("conv_id", "doc_id")
    out = R.collect_responses(table(spark, d, "documents").select("doc_id"), said, key="doc_id", sample="turn", text="text")
    return out.select("doc_id", F.array_join("responses", "|").alias("responses"))


@query("SELECT doc_id, round(CASE WHEN n_chars > 0 THEN 1 - (doc_id % 50) / n_chars ELSE 0 END, 6) AS reward FROM documents")
def i2_compression_reward(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(R.compression_reward(F.col("doc_id") % 50, F.col("n_chars")), 6).alias("reward"))


@query("WITH q AS (SELECT source, avg(quality) AS acc FROM documents JOIN labels USING (doc_id) GROUP BY source) SELECT doc_id, round(CASE WHEN coalesce(acc, 0) < 0.5 THEN 0 ELSE 1 END + 0.05 * (doc_id % 10) + (doc_id % 3) / 3 + 0.1 * (n_chars % 7), 6) AS reward FROM documents LEFT JOIN q USING (source)")
def i3_combine_rewards(spark, d):
    docs = table(spark, d, "documents")
    chunks = docs.select("doc_id", "source", (F.col("doc_id") % 10).alias("comp"), (F.col("doc_id") % 3 / 3).alias("ok"), (F.col("n_chars") % 7).alias("content"))
    asked = docs.select("doc_id", "source").join(table(spark, d, "labels"), "doc_id").select("source", "quality")
    out = R.combine_rewards(chunks, asked, key="source", score="quality", compression="comp", success="ok", content="content", w_comp=0.05, w_content=0.1, threshold=0.5)
    return out.select("doc_id", F.round("reward", 6).alias("reward"))


@query("SELECT doc_id, round(least(-(n_chars - 1500) / 500 * 0.5, 0), 6) AS penalty FROM documents")
def i4_overlong_penalty(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(R.overlong_penalty(F.col("n_chars"), 2000, 500, 0.5), 6).alias("penalty"))


@query(_sql("CASE WHEN n > 1 THEN (reward - m) / (sd + 1e-6) ELSE reward / (1 + 1e-6) END"))
def i5_advantage_group_norm(spark, d):
    return _out(R.advantage_group_norm(samples(spark, d), uid="uid", score="reward"), "advantage")


@query(f"WITH s AS ({SAMPLES}), g AS (SELECT *, count(*) OVER (PARTITION BY uid) AS n, stddev_samp(reward) OVER (PARTITION BY uid) AS sd, row_number() OVER w AS r, lead(reward) OVER w AS nxt FROM s WINDOW w AS (PARTITION BY uid ORDER BY reward DESC, l_linenumber, l_partkey, l_suppkey)) SELECT uid, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN n < 2 THEN NULL WHEN r = 1 THEN (reward - nxt) / (sd + 1e-6) ELSE 0 END + 3.7e-8, 4) AS advantage FROM g")
def i6_advantage_passk(spark, d):
    return _out(R.advantage_passk(samples(spark, d), uid="uid", score="reward", order=_KEY), "advantage")


@query(_sql("CASE WHEN n > 1 THEN (reward - m) * n / (n - 1) ELSE reward END"))
def i7_advantage_leave_one_out(spark, d):
    return _out(R.advantage_leave_one_out(samples(spark, d), uid="uid", score="reward"), "advantage")


@query(_sql("CASE WHEN n > 1 THEN reward - lb ELSE reward END"))
def i8_advantage_len_weighted(spark, d):
    return _out(R.advantage_len_weighted(samples(spark, d), uid="uid", score="reward", length="len"), "advantage")


@query(f"WITH s AS ({SAMPLES}), g AS (SELECT *, CASE WHEN count(*) OVER w > 1 THEN reward - avg(reward) OVER w ELSE reward END AS a FROM s WINDOW w AS (PARTITION BY uid)), m AS (SELECT sum(len) AS n, sum(a * len) / sum(len) AS mean FROM g), v AS (SELECT sum((a - mean) * (a - mean) * len) / (max(n) - 1) AS var FROM g CROSS JOIN m) SELECT uid, l_linenumber, l_partkey, l_suppkey, round((a - mean) / sqrt(var + 1e-8) + 3.7e-8, 4) AS advantage FROM g CROSS JOIN m CROSS JOIN v")
def i9_advantage_baseline_whiten(spark, d):
    return _out(R.advantage_baseline_whiten(samples(spark, d), uid="uid", score="reward", tokens="len"), "advantage")


_ORD = f"t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM ({TOKENS}))"


def _unrolled(df, name: str):
    return df.select("user_id", F.posexplode(name).alias("i", "x")).select("user_id", (F.col("i") + 1).cast("long").alias("i"), _round("x"))


@query(f"WITH RECURSIVE {_ORD}, r AS (SELECT user_id, i, (value * mask)::DOUBLE AS x FROM t WHERE i = n UNION ALL SELECT t.user_id, t.i, (t.value + 0.9 * r.x) * t.mask FROM r JOIN t ON t.user_id = r.user_id AND t.i = r.i - 1) SELECT user_id, i, round(x + 3.7e-8, 4) AS x FROM r")
def i10_reward_to_go(spark, d):
    return _unrolled(rollouts(spark, d).withColumn("x", R.reward_to_go(F.col("rewards"), F.col("mask"), 0.9)), "x")


@query(f"WITH t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, sum(value * mask) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS s FROM ({TOKENS})) SELECT user_id, i, round(s - (user_id % 7) * mask + 3.7e-8, 4) AS x FROM t")
def i10b_advantage_over_baseline(spark, d):
    return _unrolled(rollouts(spark, d).withColumn("x", R.advantage_over_baseline(F.col("rewards"), F.col("mask"), (F.col("user_id") % 7).cast("double"))), "x")


@query(f"WITH RECURSIVE {_ORD}, dl AS (SELECT *, value + 0.95 * coalesce(lead(val) OVER (PARTITION BY user_id ORDER BY i), 0) - val AS delta FROM t), r AS (SELECT user_id, i, delta::DOUBLE AS x FROM dl WHERE i = n UNION ALL SELECT dl.user_id, dl.i, dl.delta + 0.95 * 0.9 * r.x FROM r JOIN dl ON dl.user_id = r.user_id AND dl.i = r.i - 1) SELECT user_id, i, round(x + 3.7e-8, 4) AS x FROM r")
def i11_gae(spark, d):
    return _unrolled(rollouts(spark, d).withColumn("x", R.gae(F.col("rewards"), F.col("vals"), 0.95, 0.9)), "x")


@query("WITH m AS (SELECT event_type, count(*) AS n, avg(value) AS mean, var_samp(value) AS var FROM events GROUP BY event_type) SELECT event_id, round((value - mean) / sqrt(var + 1e-8), 5) AS value FROM events JOIN m USING (event_type)")
def i12_whiten(spark, d):
    return R.whiten(table(spark, d, "events").select("event_id", "event_type", "value"), value="value", by=["event_type"]).select("event_id", F.round("value", 5).alias("value"))


@query(f"WITH t AS ({TOKENS}), k AS (SELECT *, (lp - old) * mask AS k1, least(greatest(exp(old - lp) - (old - lp) - 1, -10), 10) * mask AS k3 FROM t) SELECT user_id, round(sum(k1) / greatest(sum(mask), 1) + 3.7e-8, 4) AS kl1, round(sum(k3) / greatest(sum(mask), 1) + 3.7e-8, 4) AS kl3, round(sum(value - 0.1 * k1) + 3.7e-8, 4) AS shaped FROM k GROUP BY user_id")
def i13_kl_shaped_reward(spark, d):
    r = rollouts(spark, d)
    one = R.kl_shaped_reward(r, rewards="rewards", logp="lp", ref="old", mask="mask", kind="k1")
    both = R.kl_shaped_reward(one.withColumnRenamed("kl", "kl1").withColumnRenamed("shaped", "s1"), rewards="rewards", logp="lp", ref="old", mask="mask", kind="k3")
    return both.select("user_id", _round("kl1"), F.round(F.col("kl") + OFF, 4).alias("kl3"), F.round(F.aggregate("s1", F.lit(0.0), lambda a, x: a + x) + OFF, 4).alias("shaped"))


@query(f"WITH u AS (SELECT user_id, step, sum(value * mask) AS t, sum(mask) AS n FROM ({TOKENS}) GROUP BY ALL) SELECT step, round(sum(t) / sum(n), 5) AS a, round(avg(t), 5) AS b, round(avg(t / n), 5) AS c, round(sum(t) / 128, 5) AS d FROM u GROUP BY step")
def i14_masked_reduce(spark, d):
    r = rollouts(spark, d)
    out = None
    for name, mode in zip("abcd", ("token-mean", "seq-mean-token-sum", "seq-mean-token-mean", "token-sum")):
        one = R.masked_reduce(r, by=["step"], values="rewards", mask="mask", mode=mode, width=128).select("step", F.round("loss", 5).alias(name))
        out = one if out is None else out.join(one, "step")
    return out


@query("WITH e AS (SELECT user_id, event_id, CASE WHEN value = max(value) OVER w THEN 0.4 ELSE 0.1 END + 1e-8 AS w FROM events WINDOW w AS (PARTITION BY user_id)), r AS (SELECT *, sum(w) OVER (PARTITION BY user_id ORDER BY event_id) AS hi, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS draw FROM e), p AS (SELECT user_id, draw, ('0x' || substr(md5(concat_ws('|', 'draw', user_id::VARCHAR, draw::VARCHAR)), 1, 12))::BIGINT::DOUBLE / 281474976710656 * sum(w) OVER (PARTITION BY user_id) AS place FROM r) SELECT p.user_id, p.draw, r.event_id FROM p JOIN r ON p.user_id = r.user_id AND p.place < r.hi AND p.place >= r.hi - r.w")
def i15_weighted_resample(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", R.resample_weights(F.col("value"), "max_random", ["user_id"]).alias("w"))
    return R.weighted_resample(e, batch="user_id", order="event_id", weight="w").select("user_id", F.col("draw").cast("long").alias("draw"), "event_id")


@query()
def i16_balance_by_length(spark, d):
    return R.balance_by_length(table(spark, d, "documents"), 4, batch="source", key="doc_id", length="n_chars", equal_size=True)


#: The differencing method's parts depend on its ties, but not their sizes, nor that no two totals differ by more than one row.
@query("SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS total, least(4, count(*)) AS parts, count(*) // 4 AS smallest, (count(*) + 3) // 4 AS largest, true AS even FROM documents GROUP BY source")
def i16_totals_of_balanced_parts(spark, d):
    parts = R.balance_by_length(table(spark, d, "documents"), 4, batch="source", key="doc_id", length="n_chars", equal_size=True)
    per = parts.groupBy("source", "part").agg(F.count("*").alias("n"), F.sum("n_chars").alias("total"), F.max("n_chars").alias("most"))
    even = F.max("total") - F.min("total") <= F.max("most")
    return per.groupBy("source").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.count("*").alias("parts"), F.min("n").alias("smallest"), F.max("n").alias("largest"), even.alias("even"))


@query("SELECT doc_id, CASE WHEN r % 8 < 4 THEN r % 8 ELSE 7 - r % 8 END AS part FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) - 1 AS r FROM documents)")
def i16_snake_balance(spark, d):
    return R.snake_balance(table(spark, d, "documents"), 4, batch="source", key="doc_id", length="n_chars").select("doc_id", "part")


@query()
def i17_micro_batches(spark, d):
    return R.micro_batches(table(spark, d, "documents"), 30_000, batch="source", key="doc_id", length="n_chars")


@query("SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS total, least(ceil(sum(n_chars) / 30000), count(*))::BIGINT AS parts FROM documents GROUP BY source")
def i17_parts_of_micro_batches(spark, d):
    parts = R.micro_batches(table(spark, d, "documents"), 30_000, batch="source", key="doc_id", length="n_chars")
    return parts.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("total"), F.count_distinct("part").alias("parts"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) - 1 AS r FROM documents), p AS (SELECT source, n_chars, doc_id % 4 AS b, CASE WHEN r % 8 < 4 THEN r % 8 ELSE 7 - r % 8 END AS a FROM r), o AS (SELECT source, min(t) AS min_before, max(t) AS max_before, avg(t) AS mean FROM (SELECT source, b, sum(n_chars)::BIGINT AS t FROM p GROUP BY ALL) GROUP BY source), n AS (SELECT source, min(t) AS min_after, max(t) AS max_after FROM (SELECT source, a, sum(n_chars)::BIGINT AS t FROM p GROUP BY ALL) GROUP BY source) SELECT source, min_before, max_before, round(mean, 4) AS mean, min_after, max_after, max_before - min_before AS diff_before FROM o JOIN n USING (source)")
def i18_imbalance_stats(spark, d):
    rows = R.snake_balance(table(spark, d, "documents"), 4, batch="source", key="doc_id", length="n_chars").withColumn("b", F.col("doc_id") % 4)
    return R.imbalance_stats(rows, batch="source", length="n_chars", part="part", before="b").withColumn("mean", F.round("mean", 4))
