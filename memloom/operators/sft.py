"""Training rows from token arrays that arrive as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filter_overlong(df: DataFrame, max_tokens: int, *, tokens: str) -> DataFrame:
    return df.where(F.size(tokens) <= max_tokens)


def truncate_tokens(tokens: Column, max_tokens: int, side: str = "right") -> Column:
    """`right` keeps the head, `left` the tail, `middle` max // 2 of the head and the rest of the tail, `error` fails on a longer array."""
    n, half = F.size(tokens), max_tokens // 2
    tail = lambda k: F.slice(tokens, n - k + 1, k)
    cut = {
        "right": lambda: F.slice(tokens, 1, max_tokens),
        "left": lambda: tail(max_tokens),
        "middle": lambda: F.concat(F.slice(tokens, 1, half), tail(max_tokens - half)),
        "error": lambda: F.raise_error(F.concat(F.lit("too many tokens: "), n.cast("string"))).cast("array<int>"),
    }[side]()
    return F.when(n > max_tokens, cut).otherwise(tokens)


def _padded(tokens: Column, width: int, value: int = 0) -> Column:
    kept = F.slice(tokens, 1, width)
    return F.concat(kept, F.array_repeat(F.lit(value), F.greatest(F.lit(width) - F.size(kept), F.lit(0))))


def pack_sft(df: DataFrame, max_tokens: int, *, prompt: str, response: str, pad: int = 0) -> DataFrame:
    """Adds input_ids, attention_mask, position_ids and loss_mask, each of max_tokens: no loss on the first prompt - 1 tokens, nor on the last response token."""
    n_prompt = F.size(prompt)
    n = F.least(n_prompt + F.size(response), F.lit(max_tokens))
    whole = F.concat(prompt, response)
    at = F.sequence(F.lit(0), F.lit(max_tokens - 1))
    mask = F.transform(at, lambda i: (i < n).cast("int"))
    loss = F.transform(at, lambda i: ((i >= n_prompt - 1) & (i < n_prompt + F.size(response) - 1) & (i < n)).cast("int"))
    places = F.transform(at, lambda i: F.greatest(F.least(i, n - 1), F.lit(0)))
    return df.withColumns({"input_ids": _padded(whole, max_tokens, pad), "attention_mask": mask, "position_ids": places, "loss_mask": loss})


def pack_multiturn(turns: DataFrame, max_tokens: int, *, key: str, turn: str, role: str, tokens: str, prefix: int = 1) -> DataFrame:
    """One row per conversation: input_ids and loss_mask of its turns in order; loss on assistant content, not on its first `prefix` tokens. `valid` is false for an unknown role or a system turn that is not first; consecutive tool turns stay together by order."""
    one = F.struct(F.col(turn).alias("t"), F.col(role).alias("r"), F.col(tokens).alias("k"))
    sorted_turns = F.array_sort(F.collect_list(one))
    rows = turns.groupBy(key).agg(sorted_turns.alias("x"))
    known = F.array(*[F.lit(r) for r in ("system", "user", "assistant", "tool")])
    ids = F.flatten(F.transform("x", lambda t: t["k"]))
    loss = F.flatten(F.transform("x", lambda t: F.transform(t["k"], lambda _, i: ((t["r"] == "assistant") & (i >= prefix)).cast("int"))))
    valid = F.forall("x", lambda t: F.array_contains(known, t["r"])) & ~F.exists(F.slice("x", 2, F.greatest(F.size("x") - 1, F.lit(0))), lambda t: t["r"] == "system")
    return rows.select(key, F.slice(ids, 1, max_tokens).alias("input_ids"), F.slice(loss, 1, max_tokens).alias("loss_mask"), valid.alias("valid"))


def pack_pairs(df: DataFrame, max_tokens: int, *, prompt: str, chosen: str, rejected: str, end: int, pad: int = 0) -> DataFrame:
    """Adds ids and mask of prompt + chosen and prompt + rejected, each with an end token, cut on the right and padded."""
    out = {}
    for name, col in (("chosen", chosen), ("rejected", rejected)):
        whole = F.concat(prompt, col, F.array(F.lit(end)))
        out[f"{name}_ids"] = _padded(whole, max_tokens, pad)
        out[f"{name}_mask"] = _mask(whole, max_tokens)
    return df.withColumns(out)


def _mask(tokens: Column, width: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: (i < F.size(tokens)).cast("int"))


def extract_nested_key(column: Column, keys: list[str | int]) -> Column:
    """Digs into structs by name and into lists by place (a list of length 1: 0)."""
    for k in keys:
        column = F.get(column, F.lit(k)) if isinstance(k, int) else column.getField(k)
    return column
