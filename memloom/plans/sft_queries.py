"""Training rows from conversations: a word's token is the number in the first four hex digits of its MD5."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom.functions.text import split_words
from memloom.operators import sft as S
from memloom.plans.registry import query, table

_TOK = r"list_transform(list_filter(string_split_regex({}, '[ \t\n\r\f\v]+'), lambda x: x <> ''), lambda x: ('0x' || substr(md5(x), 1, 4))::INT)"
_TURNS = f"SELECT conv_id, turn, role, {_TOK.format('text')} AS k FROM conversations"
_PAIRS = f"SELECT a.conv_id, a.turn, u.k AS p, a.k AS r FROM ({_TURNS}) a JOIN ({_TURNS}) u ON a.conv_id = u.conv_id AND u.turn = a.turn - 1 WHERE a.role = 'assistant' AND u.role = 'user'"
N = 64


def tokens(text):
    return F.transform(split_words(text), lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int"))


def turns(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", "role", tokens(F.col("text")).alias("k"))


def _pairs(spark, d):
    t = turns(spark, d)
    u = t.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("k").alias("p"))
    return t.where("role = 'assistant'").select("conv_id", "turn", F.col("k").alias("r")).join(u, ["conv_id", "turn"])


def _s(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c if isinstance(c, str) else "x")


def _j(x: str) -> str:
    return f"array_to_string({x}, ',')"


@query(f"SELECT conv_id, turn, len(k) AS n FROM ({_TURNS}) WHERE len(k) <= 100")
def j1_filter_overlong(spark, d):
    return S.filter_overlong(turns(spark, d), 100, tokens="k").select("conv_id", "turn", F.size("k").cast("long").alias("n"))


@query(f"SELECT conv_id, turn, {_j('k[1:21]')} AS head, {_j('CASE WHEN len(k) > 21 THEN k[len(k) - 20:len(k)] ELSE k END')} AS tail, {_j('CASE WHEN len(k) > 21 THEN k[1:10] || k[len(k) - 10:len(k)] ELSE k END')} AS both FROM ({_TURNS})")
def j2_truncate_tokens(spark, d):
    out = turns(spark, d).withColumns({"head": S.truncate_tokens(F.col("k"), 21), "tail": S.truncate_tokens(F.col("k"), 21, "left"), "both": S.truncate_tokens(F.col("k"), 21, "middle")})
    return out.select("conv_id", "turn", _s("head"), _s("tail"), _s("both"))


def _pad(x: str) -> str:
    return _j(f"list_transform(range(1, {N + 1}), lambda i: coalesce(({x})[i], 0))")


@query(f"WITH b AS (SELECT *, len(p) AS np, len(r) AS nr, least(len(p) + len(r), {N}) AS n, p || r AS w FROM ({_PAIRS})) SELECT conv_id, turn, {_pad('w')} AS input_ids, {_j(f'list_transform(range(0, {N}), lambda i: (i < n)::INT)')} AS attention_mask, {_j(f'list_transform(range(0, {N}), lambda i: greatest(least(i, n - 1), 0))')} AS position_ids, {_j(f'list_transform(range(0, {N}), lambda i: (i >= np - 1 AND i < np + nr - 1 AND i < n)::INT)')} AS loss_mask FROM b")
def j3_pack_sft(spark, d):
    return S.pack_sft(_pairs(spark, d), N, prompt="p", response="r").select("conv_id", "turn", *[_s(c) for c in ("input_ids", "attention_mask", "position_ids", "loss_mask")])


@query(f"WITH t AS (SELECT *, list_transform(range(0, len(k)), lambda i: (role = 'assistant' AND i >= 1)::INT) AS m FROM ({_TURNS})) SELECT conv_id, {_j('flatten(list(k ORDER BY turn))[1:512]')} AS input_ids, {_j('flatten(list(m ORDER BY turn))[1:512]')} AS loss_mask, NOT bool_or(role NOT IN ('system', 'user', 'assistant', 'tool')) AND coalesce(max(turn) FILTER (role = 'system'), min(turn)) = min(turn) AS valid FROM t GROUP BY conv_id")
def j4_pack_multiturn(spark, d):
    out = S.pack_multiturn(turns(spark, d), 512, key="conv_id", turn="turn", role="role", tokens="k")
    return out.select("conv_id", _s("input_ids"), _s("loss_mask"), "valid")


@query(f"WITH b AS (SELECT conv_id, turn, p || r || [7] AS c, p || list_reverse(r) || [7] AS x FROM ({_PAIRS})) SELECT conv_id, turn, {_pad('c')} AS chosen_ids, {_pad('x')} AS rejected_ids, least(len(c), {N}) AS n FROM b")
def j5_pack_pairs(spark, d):
    out = S.pack_pairs(_pairs(spark, d).withColumn("x", F.reverse("r")), N, prompt="p", chosen="r", rejected="x", end=7)
    return out.select("conv_id", "turn", _s("chosen_ids"), _s("rejected_ids"), F.aggregate("chosen_mask", F.lit(0), lambda a, m: a + m).cast("long").alias("n"))


@query("SELECT conv_id, turn, text AS prompt FROM conversations WHERE turn = 0")
def j6_extract_nested_key(spark, d):
    nested = F.struct(F.array(F.struct(F.col("role").alias("role"), F.col("text").alias("content"))).alias("messages"))
    rows = table(spark, d, "conversations").where("turn = 0").select("conv_id", "turn", nested.alias("extra"))
    return rows.select("conv_id", "turn", S.extract_nested_key(F.col("extra"), ["messages", 0, "content"]).alias("prompt"))
