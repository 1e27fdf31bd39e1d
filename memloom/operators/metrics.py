"""Roll-ups of scores: per instance, per source, per prompt; and statistics of steps and trajectories."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.functions.text import seeded
from memloom.operators.ranking import rank_within

#: Hex digits of a digest that name a draw: 60 bits, far more than any group has values.
DIGITS = 15
#: Values of a group that are one row's array, and draws that a task makes.
WHOLE, DRAWS = 10_000, 2_000_000


def instance_then_source(df: DataFrame, *, instance: str, source: str, score: str = "score", memory: str | None = None) -> DataFrame:
    """Mean per instance, then mean over instances per source (macro). An instance's source is its least one; memory is averaged where present."""
    extra = [F.avg(memory).alias("memory")] if memory else []
    per = df.groupBy(instance).agg(F.min(source).alias(source), F.avg(score).alias("mean"), F.count("*").alias("n"), *extra)
    again = [F.avg("memory").alias("memory")] if memory else []
    return per.groupBy(source).agg(F.count("*").alias("n_instances"), F.sum("n").alias("n_results"), F.avg("mean").alias("score"), *again)


def agent_metrics(df: DataFrame, *, agent: str, instance: str | None, score: str = "score", memory: DataFrame | None = None) -> DataFrame:
    """Per agent: instances, results, mean, least, greatest and population deviation of the instance means. Without an instance column each result is its own instance. `memory` (agent, memory) joins on the left."""
    per = df.groupBy(agent, instance).agg(F.avg(score).alias("m"), F.count("*").alias("n")) if instance else df.select(agent, F.col(score).alias("m"), F.lit(1).alias("n"))
    out = per.groupBy(agent).agg(F.count("*").alias("n_instances"), F.sum("n").cast("long").alias("n_results"), F.avg("m").alias("mean"), F.min("m").alias("least"), F.max("m").alias("greatest"), F.stddev_pop("m").alias("spread"))
    return out.join(memory, agent, "left") if memory is not None else out


def source_summary(agents: DataFrame, *, source: str) -> DataFrame:
    """Per source, over agents' metrics: counts, mean of means, global least and greatest, population deviation (0 for one), mean memory."""
    memory = [F.avg("memory").alias("memory")] if "memory" in agents.columns else []
    return agents.groupBy(source).agg(F.count("*").alias("n_agents"), F.sum("n_instances").alias("n_instances"), F.avg("mean").alias("mean"), F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.stddev_pop("mean").alias("spread"), *memory)


def long_metrics(df: DataFrame, *, source: str, metrics: list[str]) -> DataFrame:
    """(source, metric, value): the mean of each metric per source, a row each."""
    means = df.groupBy(source).agg(*[F.avg(m).alias(m) for m in metrics])
    return means.unpivot([source], metrics, "metric", "value")


def train_metrics(df: DataFrame, *, source: str, trajectory: str, call: str, metrics: list[str]) -> DataFrame:
    """Call rewards averaged per trajectory first, then everything per source."""
    per = df.groupBy(source, trajectory).agg(F.avg(call).alias(call), *[F.first(m, ignorenulls=True).alias(m) for m in metrics])
    return per.groupBy(source).agg(*[F.avg(m).alias(m) for m in [call, *metrics]])


def offline_eval(df: DataFrame, *, source: str, scores: str) -> DataFrame:
    """Mean of a row's response scores (array), then mean per source; rows without responses do not count."""
    n = F.size(scores)
    mean = F.when(n > 0, F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / n)
    return df.groupBy(source).agg(F.avg(mean).alias("score"))


def mean_std_at_n_by_variable(df: DataFrame, *, source: str, prompt: str, variables: list[str]) -> DataFrame:
    """(source, variable, n, mean, std) as mean_std_at_n, for each of the variables that is a number; others are skipped. A response counts for all variables: n is the prompt's responses, null values left out of the means."""
    numbers = [v for v in variables if isinstance(df.schema[v].dataType, T.NumericType)]
    per = df.groupBy(source, prompt).agg(F.count("*").alias("n"), *[f(v).alias(f"{k}_{v}") for v in numbers for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    rows = per.select(source, "n", F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(f"m_{v}").cast("double").alias("m"), F.col(f"s_{v}").alias("s")) for v in numbers])).alias("v")).select(source, "n", "v.*")
    return rows.groupBy(source, "variable", "n").agg(F.avg("m").alias("mean"), F.avg(F.when(F.col("n") > 1, F.col("s"))).alias("std"), F.count("*").alias("n_prompts"))


def mean_std_at_n(df: DataFrame, *, source: str, prompt: str, value: str) -> DataFrame:
    """(source, n, mean, std): mean@n per prompt and, for n > 1, its population deviation; averaged over a source's prompts of the same n."""
    per = df.groupBy(source, prompt).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    return per.groupBy(source, "n").agg(F.avg("m").alias("mean"), F.avg(F.when(F.col("n") > 1, F.col("s"))).alias("std"), F.count("*").alias("n_prompts"))


def best_worst_at_n(df: DataFrame, *, source: str, prompt: str, value: str, most: int = 64) -> DataFrame:
    """(source, n, best, best_std, worst, worst_std): expectation and deviation of the largest and smallest of n draws with replacement, for n = 2, 4, .. below a prompt's N, and N; averaged over prompts.

    In closed form: with values in order, the chance that the largest of n draws is the i-th is (i/N)^n - ((i-1)/N)^n.
    """
    # one order for both, so that rows are sorted once
    w = Window.partitionBy(source, prompt).orderBy(value)
    ranked = df.select(source, prompt, value).withColumns({"_n": F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "_i": F.row_number().over(w)})
    powers = [2**k for k in range(1, most.bit_length())]
    draws = F.array_distinct(F.filter(F.array(*[F.lit(p) for p in powers], F.col("_n").cast("int")), lambda n: (n <= F.col("_n")) & (n > 1)))
    each = ranked.select(source, prompt, F.col(value).alias("v"), "_n", "_i", F.explode(draws).alias("n"))
    top = F.pow(F.col("_i") / F.col("_n"), "n") - F.pow((F.col("_i") - 1) / F.col("_n"), "n")
    low = F.pow((F.col("_n") - F.col("_i") + 1) / F.col("_n"), "n") - F.pow((F.col("_n") - F.col("_i")) / F.col("_n"), "n")
    per = each.groupBy(source, prompt, "n").agg(*[F.sum(p * v).alias(name) for name, p, v in (("b1", top, F.col("v")), ("b2", top, F.col("v") * F.col("v")), ("w1", low, F.col("v")), ("w2", low, F.col("v") * F.col("v")))])
    deviation = lambda a, b: F.sqrt(F.greatest(F.col(b) - F.col(a) * F.col(a), F.lit(0.0)))
    return per.groupBy(source, "n").agg(F.avg("b1").alias("best"), F.avg(deviation("b1", "b2")).alias("best_std"), F.avg("w1").alias("worst"), F.avg(deviation("w1", "w2")).alias("worst_std"))


def majority(df: DataFrame, *, group: str, pred: str, value: str, order: str) -> DataFrame:
    """(group, pred, value, votes): the most frequent answer (ties: first seen) and the value of its first occurrence."""
    votes = df.groupBy(group, pred).agg(F.count("*").alias("votes"), F.min(order).alias("first"), F.min_by(value, order).alias("value"))
    best = votes.groupBy(group).agg(F.max(F.struct("votes", (-F.col("first")).alias("f"), F.col(pred), F.col("value"))).alias("x"))
    return best.select(group, F.col(f"x.{pred}").alias(pred), F.col("x.value").alias("value"), F.col("x.votes").alias("votes"))


def bootstrap(df: DataFrame, *, group: str, value: str, statistics: dict[str, Callable[[Column], Column]], size: int | None = None, resamples: int = 1000, seed: int = 42, whole: int = WHOLE) -> DataFrame:
    """(group, statistic, mean, std): mean and population deviation of each statistic over resamples with replacement.

    A statistic is an aggregate of a column (F.max, F.avg, ..). A resample has `size` draws, or as many as the group has
    values. Values are numbered in order within their group, and a draw is a digest of seed, group, resample and draw
    that names such a number, so results hang on nothing but the values. A group of at most `whole` values is a sorted
    array from which its draws are taken; the draws of a larger one meet its values by group and number, so that it is
    not in one task. Tasks are as many as draws ask for. Null values are left out, null groups are one group; a group
    without values has no row.
    """
    held = df.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    sizes = held.groupBy(F.col("g").alias("_g")).agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > whole).select("_g")
    told = sizes.select("n", F.when(F.col("n") > whole, F.col("n")).alias("l")).agg(F.count("*").alias("groups"), F.sum("n").alias("n"), F.count("l").alias("large"), F.sum("l").alias("n_large")).first()

    def tasks(groups: int, n: int) -> int:
        return max(df.sparkSession.sparkContext.defaultParallelism, resamples * (n if size is None else groups * size) // DRAWS + 1)

    tries = F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("r")

    def place(g: Column, r: Column, j: Column, n: Column) -> Column:
        return F.pmod(F.conv(F.substring(seeded(str(seed), g, r, j), 1, DIGITS), 16, 10).cast("long"), n)

    small = held
    if told.large:
        large = F.broadcast(large)  # at most one group for each `whole` values
        small = held.join(large, F.col("g").eqNullSafe(F.col("_g")), "left_anti")
    n_small = tasks(told.groups - told.large, (told.n or 0) - (told.n_large or 0))
    arrays = small.repartition(n_small, "g").groupBy("g").agg(F.array_sort(F.collect_list("v")).alias("values"))
    last = F.size("values") - 1 if size is None else F.lit(size - 1)
    one = lambda j: F.get("values", place(F.col("g"), F.col("r"), j, F.size("values").cast("long")).cast("int"))
    met = arrays.select("g", "values", tries).select("g", "r", F.explode(F.transform(F.sequence(F.lit(0), last), one)).alias("v"))
    if told.large:
        values = rank_within(held.join(large, F.col("g").eqNullSafe(F.col("_g")), "left_semi"), ["g"], [F.col("v")], name="place", size="n")
        n_large = tasks(told.large, told.n_large)
        if size is None:
            # the draw of a value's own number: a hot group's draws are as spread as its values
            drawn = values.select("g", "n", F.col("place").alias("j"), tries)
        else:
            drawn = values.where(F.col("place") == 0).select("g", "n", tries).repartition(n_large, "g", "r").select("*", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("j"))
        drawn = drawn.select(F.col("g").alias("_g"), "r", place(F.col("g"), F.col("r"), F.col("j"), F.col("n")).alias("_place")).repartition(n_large, "_g", "_place")
        same = F.col("g").eqNullSafe(F.col("_g")) & (F.col("place") == F.col("_place"))
        met = met.unionByName(drawn.join(values.repartition(n_large, "g", "place"), same).select("g", "r", "v"))
    names = {f"s{k}": name for k, name in enumerate(statistics)}
    each = met.groupBy("g", "r").agg(*[f(F.col("v")).cast("double").alias(k) for k, f in zip(names, statistics.values())])
    over = each.groupBy("g").agg(*[f(k).alias(f"{k}{x}") for k in names for x, f in (("m", F.avg), ("d", F.stddev_pop))])
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("statistic"), F.col(f"{k}m").alias("mean"), F.col(f"{k}d").alias("std")) for k, name in names.items()])).alias("x")
    return over.select(F.col("g").alias(group), rows).select(group, "x.*")


def _majority_values(codes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Of each row (last axis) of drawn answers, the first value of the most frequent one (ties: the one drawn first). Votes are counted by code, so codes are best small."""
    flat = codes.reshape(-1, codes.shape[-1])
    at = np.arange(len(flat))[:, None] * (int(flat.max(initial=0)) + 1) + flat
    votes = np.bincount(at.ravel())[at].reshape(codes.shape)
    return np.take_along_axis(values, votes.argmax(axis=-1)[..., None], axis=-1)[..., 0]


def _draws(keys: np.ndarray, shape: tuple[int, int], among: int, salt: int) -> np.ndarray:
    """For each key a matrix of places 0..among-1, pseudo-random in key, salt and place: a 64-bit finaliser of a counter."""
    x = keys.astype(np.uint64)[:, None] + (np.arange(shape[0] * shape[1], dtype=np.uint64) + np.uint64(salt << 32)) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(among)).astype(np.int64).reshape(len(keys), *shape)


def majority_at_n(df: DataFrame, *, source: str, prompt: str, pred: str, value: str, order: str, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """(source, n, mean, std): the majority answer's value over resamples of n draws with replacement, for n = 2, 4, .. below a prompt's N, and N; averaged over a source's prompts.

    Draws are a hash of prompt, n and place, and responses are put in order first, so results do not depend on where a
    prompt is worked on. A prompt is one row with its responses (some tens); prompts of a batch with as many responses
    are worked on together.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[pd.DataFrame] = []
            sizes = batch["p"].map(len)
            for n_all in sorted(set(sizes[sizes > 1])):
                rows = batch[sizes == n_all]
                codes = np.unique(np.array(rows["p"].tolist(), dtype=str), return_inverse=True)[1].reshape(len(rows), n_all)
                # numbered anew within each prompt
                codes = np.unique(np.arange(len(rows))[:, None] * (codes.max() + 1) + codes, return_inverse=True)[1].reshape(len(rows), n_all)
                codes = codes - codes.min(axis=1, keepdims=True)
                values, keys = np.array(rows["v"].tolist(), float), rows["h"].to_numpy(np.int64).view(np.uint64)
                for n in sorted({n for n in (2**k for k in range(1, 31)) if n < n_all} | {n_all}):
                    step = max(1, 4_000_000 // (resamples * n_all))
                    for lo in range(0, len(rows), step):
                        part = slice(lo, lo + step)
                        at = _draws(keys[part], (resamples, n), n_all, seed * 1000 + n)
                        here = np.arange(len(at))[:, None, None]
                        found = _majority_values(codes[part][here, at], values[part][here, at])
                        out.append(pd.DataFrame({"s": rows["s"].iloc[part].to_numpy(), "n": n, "m": found.mean(axis=1), "d": found.std(axis=1)}))
            yield pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["s", "n", "m", "d"])

    kind = df.schema[source].dataType.simpleString()
    answers = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(pred).cast("string"), F.lit("")).alias("p"), F.col(value).cast("double").alias("v"))))
    rows = df.groupBy(F.col(source).alias("s"), F.col(prompt).alias("g")).agg(answers.alias("r"))
    rows = rows.select("s", F.xxhash64("s", "g").alias("h"), F.transform("r", lambda x: x["p"]).alias("p"), F.transform("r", lambda x: x["v"]).alias("v"))
    per = rows.mapInPandas(work, f"s {kind}, n long, m double, d double")
    return per.groupBy(F.col("s").alias(source), "n").agg(F.avg("m").alias("mean"), F.avg("d").alias("std"))


def batch_stats(df: DataFrame, *, step: str, scalars: list[str], masked: list[str], mask: str, length: str, max_length: int, values: str | None = None, returns: str | None = None) -> DataFrame:
    """Per step: mean, max and min of scalar columns and of masked token arrays, share of clipped lengths, and (with values and returns) the variance explained, 1 - var(r - v) / (var(r) + 1e-5), by sample variances."""
    names = lambda c: [f(c).alias(f"{c}_{k}") for k, f in (("mean", F.avg), ("max", F.max), ("min", F.min))]
    out = df.groupBy(step).agg(*[x for c in scalars for x in names(c)], *names(length), F.avg((F.col(length) >= max_length).cast("double")).alias("clip_ratio"))
    arrays = list(dict.fromkeys([*masked, *([values, returns] if values else [])]))
    if arrays:
        tokens = df.select(step, F.explode(F.arrays_zip(mask, *arrays)).alias("t")).where(F.col(f"t.{mask}") > 0).select(step, *[F.col(f"t.{a}").alias(a) for a in arrays])
        explained = [(1 - F.var_samp(F.col(returns) - F.col(values)) / (F.var_samp(returns) + 1e-5)).alias("explained")] if values else []
        out = out.join(tokens.groupBy(step).agg(*[x for c in masked for x in names(c)], *explained), step, "left")
    return out


def prob_drift(df: DataFrame, *, step: str, a: str, b: str, mask: str) -> DataFrame:
    """Per step: greatest, mean and sample deviation of |exp(a) - exp(b)| over masked tokens."""
    tokens = df.select(step, F.explode(F.arrays_zip(a, b, mask)).alias("t")).where(F.col(f"t.{mask}") > 0)
    gap = F.abs(F.exp(f"t.{a}") - F.exp(f"t.{b}"))
    return tokens.groupBy(step).agg(F.max(gap).alias("greatest"), F.avg(gap).alias("mean"), F.stddev_samp(gap).alias("spread"))


def throughput(df: DataFrame, *, step: str, stage: str, seconds: str, tokens: str, response_tokens: str, workers: int, total: str = "step") -> DataFrame:
    """Per step and stage: milliseconds a token (stage `gen`: a response token), and for the whole step tokens a second and worker."""
    n = F.when(F.col(stage) == "gen", F.col(response_tokens)).otherwise(F.col(tokens))
    per = df.groupBy(step, stage).agg(F.sum(seconds).alias("s"), F.sum(n).alias("n"))
    return per.select(step, stage, (F.col("s") * 1000 / F.col("n")).alias("ms_per_token"), F.when(F.col(stage) == total, F.col("n") / (F.col("s") * workers)).alias("tokens_per_second"))


def reduce_by_name(df: DataFrame, *, key: str = "key", value: str = "value") -> DataFrame:
    """One value per key: the greatest if its name holds `max`, else the least if it holds `min`, else the mean."""
    k = F.col(key)
    agg = df.groupBy(key).agg(F.max(value).alias("a"), F.min(value).alias("b"), F.avg(value).alias("c"))
    return agg.select(key, F.when(F.contains(k, F.lit("max")), F.col("a")).when(F.contains(k, F.lit("min")), F.col("b")).otherwise(F.col("c")).alias("value"))


def trajectory_stats(steps: DataFrame, *, key: str, step: str, context: str, length: str, matched: str) -> DataFrame:
    """Per trajectory, from its steps in order (context: tokens before the step, length: tokens it writes).

    total and peak tokens (null unless matched), dependency = sum((context + length // 2) * length) / total length, and
    compression = last context / total length; null where there is nothing to divide by.
    """
    c, n = F.col(context), F.col(length)
    agg = steps.groupBy(key).agg(
        F.max(F.col(matched)).alias("m"),
        F.sum(n).alias("total"),
        F.max(c + n).alias("peak"),
        F.sum((c + F.floor(n / 2)) * n).alias("work"),
        F.max_by(c, step).alias("last"),
    )
    some = F.col("total") > 0
    return agg.select(key, F.when(F.col("m") != 0, F.col("total")).alias("tokens"), F.when(F.col("m") != 0, F.col("peak")).alias("peak"), F.when(some, F.col("work") / F.col("total")).alias("dependency"), F.when(some, F.col("last") / F.col("total")).alias("compression"))


def trajectory_stats_from_steps(steps: DataFrame, *, key: str, step: str, think: str, act: str, info: str, matched: str) -> DataFrame:
    """Per trajectory, from its steps' token counts (null: no such part): what the agent thought, did and was told.

    After a step's act its context is reset to what it thought and did in this step; what it is told comes behind that.
    tokens and peak (the fullest context at an act; both null unless matched), dependency = sum((context + length // 2)
    * length) / all tokens with that reset, dependency_full the same without it, and compression = the context at the
    last act / all tokens; null where there is nothing to divide by. Counts are taken to add up over parts.
    """
    t, r, i = (F.coalesce(F.col(c), F.lit(0)) for c in (think, act, info))
    w = Window.partitionBy(key).orderBy(step)
    rows = steps.select(key, step, t.alias("_t"), r.alias("_r"), i.alias("_i"), F.col(act).isNotNull().alias("_acts"), F.col(matched).alias("_m"))
    all_ = F.col("_t") + F.col("_r") + F.col("_i")
    rows = rows.withColumn("_c", F.coalesce(F.lag(all_).over(w), F.lit(0))).withColumn("_f", F.coalesce(F.sum(all_).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("_at", F.col("_c") + F.col("_t") + F.col("_r"))

    def work(c: Column, told: Column) -> Column:
        part = lambda before, n: (before + F.floor(n / 2)) * n
        return part(c, F.col("_t")) + part(c + F.col("_t"), F.col("_r")) + part(told, F.col("_i"))

    agg = rows.groupBy(key).agg(
        F.max("_m").alias("m"),
        F.sum(all_).alias("total"),
        F.max("_at").alias("peak"),
        F.sum(work(F.col("_c"), F.col("_t") + F.col("_r"))).alias("work"),
        F.sum(work(F.col("_f"), F.col("_f") + F.col("_t") + F.col("_r"))).alias("full"),
        F.max_by(F.when(F.col("_acts"), F.col("_at")), F.when(F.col("_acts"), F.col(step))).alias("last"),
    )
    some = F.col("total") > 0
    hit = lambda c: F.when(F.col("m") != 0, c)
    return agg.select(
        key,
        hit(F.col("total")).alias("tokens"),
        hit(F.when(F.col("peak") > 0, F.col("peak"))).alias("peak"),
        F.when(some, F.col("work") / F.col("total")).alias("dependency"),
        F.when(some, F.col("full") / F.col("total")).alias("dependency_full"),
        F.when(some, F.coalesce("last", F.lit(0)) / F.col("total")).alias("compression"),
    )


def sample_for_logging(df: DataFrame, n: int, *, order: Column) -> DataFrame:
    """The first n rows by a seeded order: a top-n, no full sort."""
    return df.orderBy(order).limit(n)
