"""Rollout post-processing: rewards, group-relative advantages, token-level returns, balancing."""

from __future__ import annotations

import bisect
import heapq
import itertools

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.arrays import before

EPS = 1e-6


def fan_out(df: DataFrame, n: int, *, key: str) -> DataFrame:
    """Each row n times, with `uid` (the same for the copies of a prompt) and `sample` 0..n-1."""
    return df.withColumns({"uid": F.md5(F.col(key).cast("string")), "sample": F.explode(F.sequence(F.lit(0), F.lit(n - 1)))})


def collect_responses(rows: DataFrame, samples: DataFrame, *, key: str, sample: str, text: str) -> DataFrame:
    """Adds `responses`, the row's sample texts in sample order (empty without any)."""
    lists = samples.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(sample).alias("s"), F.col(text).alias("t")))), lambda x: x["t"]).alias("responses"))
    return rows.join(lists, key, "left").withColumn("responses", F.coalesce("responses", F.array().cast("array<string>")))


def compression_reward(memory_tokens: Column, chunk_tokens: Column) -> Column:
    """1 - memory / chunk tokens; 0 without chunk tokens."""
    return F.when(chunk_tokens > 0, 1 - memory_tokens / chunk_tokens).otherwise(0.0)


def combine_rewards(chunks: DataFrame, questions: DataFrame, *, key: str, score: str, compression: str, success: str, content: str, w_comp: float, w_content: float, threshold: float | None = None) -> DataFrame:
    """Adds `reward` to each chunk row: the instance's mean question score (thresholded to 0 or 1 if asked), plus weighted compression, call success and weighted content score."""
    acc = questions.groupBy(key).agg(F.avg(score).alias("_acc"))
    base = F.coalesce("_acc", F.lit(0.0))
    if threshold is not None:
        base = F.when(base < threshold, 0.0).otherwise(1.0)
    reward = base + w_comp * F.col(compression) + F.col(success) + w_content * F.col(content)
    return chunks.join(acc, key, "left").withColumn("reward", reward).drop("_acc")


def overlong_penalty(length: Column, max_length: int, buffer: int, factor: float) -> Column:
    """0 up to max_length - buffer, then falling by factor / buffer a token."""
    return F.least(-(length - (max_length - buffer)) / buffer * factor, F.lit(0.0))


def _group(df: DataFrame, uid: str, aggs: dict[str, Column]) -> DataFrame:
    """Rows with their group's aggregates: partial sums, then one join, so wide rows are not sorted by a window."""
    return df.join(df.groupBy(uid).agg(*[c.alias(n) for n, c in aggs.items()]), uid)


def advantage_group_norm(df: DataFrame, *, uid: str, score: str, use_std: bool = True) -> DataFrame:
    """(s - mean) / (std + eps) in the group, sample deviation; in a group of one the score itself over 1 + eps."""
    g = _group(df, uid, {"_m": F.avg(score), "_s": F.stddev_samp(score), "_n": F.count("*")})
    mean, std = F.when(F.col("_n") > 1, F.col("_m")).otherwise(0.0), F.when(F.col("_n") > 1, F.col("_s")).otherwise(1.0)
    value = (F.col(score) - mean) / (std + EPS) if use_std else F.col(score) - mean
    return g.withColumn("advantage", value).drop("_m", "_s", "_n")


def advantage_passk(df: DataFrame, *, uid: str, score: str, order: list[str], use_std: bool = True) -> DataFrame:
    """Only a group's best row gets best - second (over std + eps); ties go by `order`. Groups of one are an error: their advantage is null."""
    w = Window.partitionBy(uid)
    place = F.row_number().over(w.orderBy(F.desc(score), *order))
    second = F.nth_value(score, 2).over(w.orderBy(F.desc(score), *order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    gap = F.col(score) - second
    gap = gap / (F.stddev_samp(score).over(w) + EPS) if use_std else gap
    return df.withColumn("advantage", F.when(F.count("*").over(w) < 2, F.lit(None).cast("double")).when(place == 1, gap).otherwise(0.0))


def advantage_leave_one_out(df: DataFrame, *, uid: str, score: str) -> DataFrame:
    """s * n / (n - 1) - mean * n / (n - 1); the score itself in a group of one."""
    g = _group(df, uid, {"_m": F.avg(score), "_n": F.count("*")})
    n = F.col("_n")
    return g.withColumn("advantage", F.when(n > 1, (F.col(score) - F.col("_m")) * n / (n - 1)).otherwise(F.col(score))).drop("_m", "_n")


def advantage_len_weighted(df: DataFrame, *, uid: str, score: str, length: str) -> DataFrame:
    """s - sum(len * s) / sum(len); baseline 0 in a group of one."""
    g = _group(df, uid, {"_b": F.sum(F.col(length) * F.col(score)) / F.sum(length), "_n": F.count("*")})
    return g.withColumn("advantage", F.col(score) - F.when(F.col("_n") > 1, F.col("_b")).otherwise(0.0)).drop("_b", "_n")


def whiten(df: DataFrame, *, value: str, weight: str | None = None, by: list[str] | None = None, shift_mean: bool = True) -> DataFrame:
    """(x - mean) / sqrt(var + 1e-8), with Bessel's correction; rows count `weight` times (tokens). One row of sums (per `by`) is joined back."""
    w = F.col(weight) if weight else F.lit(1)
    x = F.col(value).cast("double")
    by = by or []
    stats = df.groupBy(*by).agg(F.sum(w).alias("_n"), F.sum(x * w).alias("_s"))
    stats = stats.withColumn("_mean", F.col("_s") / F.col("_n"))
    joined = df.join(stats, by) if by else df.crossJoin(F.broadcast(stats))  # one row of sums
    dev = joined.groupBy(*by).agg((F.sum((x - F.col("_mean")) * (x - F.col("_mean")) * w) / (F.max("_n") - 1)).alias("_var"))
    joined = joined.join(dev, by) if by else joined.crossJoin(F.broadcast(dev))
    out = (x - F.col("_mean")) / F.sqrt(F.col("_var") + 1e-8) + (F.lit(0.0) if shift_mean else F.col("_mean"))
    return joined.withColumn(value, out).drop("_n", "_s", "_mean", "_var")


def advantage_baseline_whiten(df: DataFrame, *, uid: str, score: str, tokens: str) -> DataFrame:
    """Score minus the group's mean (0 in a group of one), whitened over all masked tokens: a row weighs its token count."""
    g = _group(df, uid, {"_m": F.avg(score), "_n": F.count("*")})
    g = g.withColumn("advantage", F.col(score) - F.when(F.col("_n") > 1, F.col("_m")).otherwise(0.0)).drop("_m", "_n")
    return whiten(g, value="advantage", weight=tokens)


def _backwards(steps: Column) -> Column:
    """From the end of an array of steps s -> a * s + b, given as struct<a, b>, beginning with 0: what each place comes to, in the array's order.

    Two steps one after the other are a step of the same kind, so long arrays are folded in blocks.
    """
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    whole = before(F.reverse(steps), lambda x, y: pair(y["a"] * x["a"], y["a"] * x["b"] + y["b"]), pair(F.lit(1.0), F.lit(0.0)))
    return F.reverse(F.transform(F.slice(whole, 2, F.greatest(F.size(steps), F.lit(0))), lambda x: x["b"]))


def reward_to_go(rewards: Column, mask: Column, gamma: float = 1.0) -> Column:
    """Array of discounted sums from each token to the end; the sum starts anew behind a token whose mask is 0."""
    on = lambda m: F.when(m > 0, 1.0).otherwise(0.0)
    return _backwards(F.zip_with(rewards, mask, lambda r, m: F.struct((gamma * on(m)).alias("a"), (r.cast("double") * on(m)).alias("b"))))


def advantage_over_baseline(rewards: Column, mask: Column, baseline: Column) -> Column:
    """Array of undiscounted sums of masked rewards from each token to the end, less the response's baseline where the mask is 1."""
    sums = _backwards(F.zip_with(rewards, mask, lambda r, m: F.struct(F.lit(1.0).alias("a"), (r.cast("double") * m.cast("double")).alias("b"))))
    return F.zip_with(sums, mask, lambda s, m: s - baseline * m.cast("double"))


def gae(rewards: Column, values: Column, gamma: float, lam: float) -> Column:
    """Array of advantages: A_t = delta_t + gamma * lam * A_(t+1), delta_t = r_t + gamma * V_(t+1) - V_t, with V = 0 behind the end."""
    following = F.slice(F.concat(F.slice(values, 2, F.greatest(F.size(values), F.lit(0))), F.array(F.lit(0.0))), F.lit(1), F.size(values))
    deltas = F.zip_with(F.zip_with(rewards, following, lambda r, v: r + gamma * v), values, lambda x, v: x - v)
    return _backwards(F.transform(deltas, lambda x: F.struct(F.lit(float(gamma * lam)).alias("a"), x.cast("double").alias("b"))))


def token_kl(a: Column, b: Column, kind: str) -> Column:
    """Array of KL estimates from log-probabilities: k1 (difference), abs, k2 (half its square), k3 (exp(-x) - 1 + x), each clamped to 10 in k3."""
    forms = {
        "k1": lambda x, y: x - y,
        "abs": lambda x, y: F.abs(x - y),
        "k2": lambda x, y: 0.5 * (x - y) * (x - y),
        "k3": lambda x, y: F.greatest(F.least(F.exp(y - x) - (y - x) - 1, F.lit(10.0)), F.lit(-10.0)),
    }
    return F.zip_with(a, b, forms[kind])


def kl_shaped_reward(df: DataFrame, *, rewards: str, logp: str, ref: str, mask: str, kind: str = "k1", beta: float = 0.1) -> DataFrame:
    """Adds `shaped` (reward - beta * KL where the mask is 1) and `kl`, the row's mean KL over masked tokens."""
    kl = F.zip_with(token_kl(F.col(logp), F.col(ref), kind), F.col(mask), lambda k, m: k * m)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return df.withColumn("_kl", kl).withColumns({"shaped": F.zip_with(rewards, "_kl", lambda r, k: r - beta * k), "kl": total(F.col("_kl")) / F.greatest(total(F.transform(mask, lambda m: m.cast("double"))), F.lit(1.0))}).drop("_kl")


def masked_reduce(df: DataFrame, *, by: list[str], values: str, mask: str, mode: str, width: int | None = None) -> DataFrame:
    """(by, loss): token-mean; seq-mean-token-sum; seq-mean-token-mean; token-sum (over a fixed width)."""
    total = F.aggregate(F.zip_with(values, mask, lambda v, m: v * m), F.lit(0.0), lambda s, x: s + x)
    n = F.aggregate(mask, F.lit(0.0), lambda s, m: s + m)
    rows = df.select(*by, total.alias("t"), n.alias("n"))
    loss = {"token-mean": F.sum("t") / F.sum("n"), "seq-mean-token-sum": F.avg("t"), "seq-mean-token-mean": F.avg(F.col("t") / F.col("n")), "token-sum": F.sum("t") / F.lit(width)}[mode]
    return rows.groupBy(*by).agg(loss.alias("loss"))


def resample_weights(score: Column, method: str, batch: list[str] | None = None, power: float = 1.0) -> Column:
    """Weights for drawing rows: |s| ** power; `max_min`: 1 for the batch's largest and smallest, else 0; `max_random`: 0.4 for the largest, else 0.1; each plus 1e-8."""
    w = Window.partitionBy(*(batch or []))
    weights = {
        "pow": F.pow(F.abs(score), F.lit(power)),
        "max_min": F.when((score == F.max(score).over(w)) | (score == F.min(score).over(w)), 1.0).otherwise(0.0),
        "max_random": F.when(score == F.max(score).over(w), 0.4).otherwise(0.1),
    }
    return weights[method] + 1e-8


def weighted_resample(df: DataFrame, *, batch: str, order: str, weight: str, seed: str = "draw") -> DataFrame:
    """As many draws with replacement as a batch has rows, by weight: a hashed point in the batch's running weights picks the row whose range holds it. Adds `draw`."""
    from memloom.functions.text import seeded

    w = Window.partitionBy(batch).orderBy(order)
    ranges = df.withColumns({"_hi": F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0)), "draw": F.row_number().over(w)})
    ranges = ranges.withColumn("_lo", F.coalesce(F.lag("_hi").over(w), F.lit(0.0)))
    point = F.conv(F.substring(seeded(seed, F.col(batch), F.col("draw")), 1, 12), 16, 10).cast("double") / float(1 << 48)
    total = df.groupBy(batch).agg(F.sum(weight).alias("_total"))
    points = ranges.select(batch, "draw", point.alias("_u")).join(total, batch).select(batch, F.col("draw").alias("_d"), (F.col("_u") * F.col("_total")).alias("_at"))
    # points and ranges in one order of running weight: a point belongs to the last range that starts at or before it
    none = F.lit(None)
    marks = ranges.where("_lo < _hi").select(batch, F.col("_lo").alias("_x"), F.lit(0).alias("_side"), F.col("draw").alias("_r"), none.cast("int").alias("_d"))
    marks = marks.unionByName(points.select(batch, F.col("_at").alias("_x"), F.lit(1).alias("_side"), none.cast("int").alias("_r"), "_d"))
    held = F.last("_r", ignorenulls=True).over(Window.partitionBy(batch).orderBy("_x", "_side", "_r").rowsBetween(Window.unboundedPreceding, 0))
    met = marks.withColumn("_r", held).where("_side = 1").select(batch, F.col("_r").alias("draw"), "_d")
    return ranges.drop("_lo", "_hi").join(met, [batch, "draw"]).drop("draw").withColumnRenamed("_d", "draw").select(*df.columns, "draw")


def _differencing(lengths: list[int], k: int, equal: bool) -> list[int]:
    """Group of each row by largest differencing: partial partitions are merged, always the two whose groups differ most, largest group to smallest.

    A group is (-total, rows, first row, last row); rows of a group are chained by number. A partition has its groups of
    a positive total, then as many without rows as make up k, which are not written down, then those of no total. So a
    partition takes the room of its rows, not of k groups, and a small one is put into a large one group by group.
    """
    n, k = len(lengths), max(k, 1)
    if k == 1 or not n:
        return [0] * n
    order = sorted(range(n), key=lambda i: (-lengths[i], i))
    following = [-1] * n
    heap: list[tuple] = []
    count = itertools.count(n)

    def spread(full: list[tuple], low: list[tuple]) -> int:
        most = full[0] if full else low[0] if len(low) == k else (0,)
        least = low[-1] if low else full[-1] if len(full) == k else (0,)
        return least[0] - most[0]

    def push(full: list[tuple], low: list[tuple], at: int | None = None) -> None:
        heapq.heappush(heap, (-spread(full, low), next(count) if at is None else at, full, low))

    def single(i: int) -> tuple[list[tuple], list[tuple]]:
        one = (-lengths[i], 1, i, i)
        return ([one], []) if lengths[i] > 0 else ([], [one])

    def joined(x: tuple | None, y: tuple | None) -> tuple:
        if x is None or y is None:
            return x or y
        following[x[3]] = y[2]
        return x[0] + y[0], x[1] + y[1], x[2], y[3]

    def put_in(full: list[tuple], low: list[tuple], own: list[tuple[int, tuple]], first: bool) -> None:
        """Groups with their places from the other end into a partition; `first` if the partition's rows stand first."""
        gone, made = [], []
        for at, y in own:
            here, where = (full, at) if at < len(full) else (low, at - (k - len(low)))
            x = here[where] if where >= 0 else None
            if x is not None:
                gone.append((here, where))
            made.append(joined(x, y) if first else joined(y, x))
        for here, where in sorted(gone, key=lambda g: -g[1]):
            del here[where]
        for g in made:
            bisect.insort(full if g[0] < 0 else low, g)

    def merge(a: tuple[list[tuple], list[tuple]], b: tuple[list[tuple], list[tuple]]) -> None:
        sizes = len(a[0]) + len(a[1]), len(b[0]) + len(b[1])
        if 8 * min(sizes) <= max(sizes):
            big, small = (a, b) if sizes[0] >= sizes[1] else (b, a)
            own = [(k - 1 - j, y) for j, y in enumerate(small[0])] + [(len(small[1]) - 1 - j, y) for j, y in enumerate(small[1])]
            put_in(*big, own, big is a)
            return push(*big)
        # both by place, b from its end; between lo and hi neither has rows
        lo = min(k, max(len(a[0]), len(b[1])))
        hi = max(lo, k - max(len(a[1]), len(b[0])))
        at = lambda p, i: p[0][i] if i < len(p[0]) else p[1][i - k + len(p[1])] if i >= k - len(p[1]) else None
        groups = [joined(at(a, i), at(b, k - 1 - i)) for i in itertools.chain(range(lo), range(hi, k))]
        groups = sorted(g for g in groups if g is not None)
        cut = bisect.bisect_left(groups, (0,))
        push(groups[:cut], groups[cut:])

    alone = 0  # rows that are not yet in a partition, in order: they differ least from each other and come before partitions that differ as much
    if equal:
        for at in range(0, n, k):
            rows = [single(i) for i in order[at : at + k]]
            push([g for full, _ in rows for g in full], sorted(g for _, low in rows for g in low), at)
        alone = n

    def pop() -> tuple[list[tuple], list[tuple]]:
        nonlocal alone
        if alone < n:
            one = single(order[alone])
            if not heap or (-spread(*one), alone) < heap[0][:2]:
                alone += 1
                return one
        return heapq.heappop(heap)[2:]

    while n - alone + len(heap) > 1:
        merge(pop(), pop())
    out = [0] * n
    full, low = pop()
    for places, groups in ((range(len(full)), full), (range(k - len(low), k), low)):
        for part, g in zip(places, groups):
            i = g[2]
            while i >= 0:
                out[i], i = part, following[i]
    return out


def balance_by_length(df: DataFrame, k: int | Column, *, batch: str, key: str, length: str, equal_size: bool = False) -> DataFrame:
    """(batch, key, length, part): each batch's rows in k parts of nearly equal total length, by the differencing method (a missing length counts as 0). A batch is one task's work, of its rows' memory and of about n log n steps, however many parts."""
    count = k if isinstance(k, Column) else F.lit(k)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key", ignore_index=True)
        n = min(int(rows["k"].iloc[0]), len(rows))
        return rows.assign(part=_differencing(rows["length"].fillna(0).astype("int64").tolist(), n, equal_size))[["batch", "key", "length", "part"]]

    rows = df.select(F.col(batch).alias("batch"), F.col(key).alias("key"), F.col(length).cast("long").alias("length"), count.cast("int").alias("k"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.groupBy("batch").applyInPandas(one, f"batch {kinds['batch']}, key {kinds['key']}, length long, part long").withColumnsRenamed({"batch": batch, "key": key, "length": length})


def snake_balance(df: DataFrame, k: int, *, batch: str, key: str, length: str) -> DataFrame:
    """The cheap built-in way: rows by length, descending, dealt to k parts back and forth."""
    r = F.row_number().over(Window.partitionBy(batch).orderBy(F.desc(length), key)) - 1
    turn = F.pmod(r, F.lit(2 * k))
    return df.withColumn("part", F.when(turn < k, turn).otherwise(2 * k - 1 - turn).cast("long"))


def micro_batches(df: DataFrame, max_tokens: int, *, batch: str, key: str, length: str) -> DataFrame:
    """Balanced parts, as many as ceil(total / max_tokens) asks for."""
    w = Window.partitionBy(batch)
    need = F.ceil(F.sum(length).over(w) / max_tokens)
    rows = df.withColumn("_k", F.least(need, F.count("*").over(w)))
    return balance_by_length(rows, F.col("_k"), batch=batch, key=key, length=length)


def imbalance_stats(df: DataFrame, *, batch: str, length: str, part: str, before: str) -> DataFrame:
    """Per batch: least, greatest and difference of part totals by the `before` dealing, least and greatest by `part`, and the mean."""
    old = df.groupBy(batch, before).agg(F.sum(length).alias("t")).groupBy(batch).agg(F.min("t").alias("min_before"), F.max("t").alias("max_before"), F.avg("t").alias("mean"))
    new = df.groupBy(batch, part).agg(F.sum(length).alias("t")).groupBy(batch).agg(F.min("t").alias("min_after"), F.max("t").alias("max_after"))
    return old.join(new, batch).withColumn("diff_before", F.col("max_before") - F.col("min_before"))
