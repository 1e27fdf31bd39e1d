"""Scoring of results tables: dispatch by source, and the metrics that need more than one expression."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from math import exp, log

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions import answers as A
from memloom.functions.text import strip
from memloom.operators.retrieval import nearest_name

#: Scorers by source: (test of the source, score of prediction, gold and judge's words); the first test that holds decides.
Scorer = Callable[[Column, Column, Column], Column]
SCORERS: list[tuple[Callable[[Column], Column], Scorer]] = [
    (lambda s: s.startswith("judged"), lambda p, g, j: A.judge_yes(j)),
    (lambda s: s == "keywords", lambda p, g, j: A.keyword_recall(p, F.split(g, ", "))),
    (lambda s: s == "parts", lambda p, g, j: A.multi_part_recall(p, g)),
    (lambda s: F.contains(s, F.lit("label")), lambda p, g, j: A.strict_integer_label(p, g)),
    (lambda s: F.contains(s, F.lit("tree")), lambda p, g, j: A.hierarchical_label(p, g)),
    (lambda s: F.lit(True), lambda p, g, j: A.containment(p, g)),
]


def score_results(df: DataFrame, *, pred: str = "pred", gold: str = "gold", source: str = "data_source", judge: str | None = "judge", extra: dict[str, Scorer] | None = None) -> DataFrame:
    """Adds `score` by the source's scorer; `extra` puts further sources first. A source that no test names is scored by containment; a null prediction scores 0."""
    p, g, s = A.strip_thinking(F.col(pred)), F.col(gold), F.col(source)
    j = F.col(judge) if judge else F.lit(None).cast("string")
    out = None
    rules = [((lambda c, name=name: c == name), f) for name, f in (extra or {}).items()] + SCORERS
    for test, score in rules:
        out = F.when(test(s), score(p, g, j)) if out is None else out.when(test(s), score(p, g, j))
    return df.withColumn("score", F.coalesce(out, F.lit(0.0)))


def rescore(df: DataFrame, *, new: Column, pred: str = "pred", score: str = "score", force: bool = False) -> DataFrame:
    """Fills scores that are null, or with `force` all of rows that have a prediction."""
    due = F.col(score).isNull() | (F.lit(force) & F.col(pred).isNotNull())
    return df.withColumn(score, F.when(due, new).otherwise(F.col(score)))


def max_raw_parsed(df: DataFrame, metrics: dict[str, Callable[[Column], Column]], *, raw: str) -> DataFrame:
    """Each metric, as the larger of its value on the raw text and on the text parsed by its answer prefix."""
    return df.withColumns({name: F.greatest(f(F.col(raw)), f(A.extract_prefixed(F.col(raw)))) for name, f in metrics.items()})


def set_label_f1(predicted: Column, gold: Column) -> Column:
    """F1 of two label lists: labels of both, over the lengths of the lists (repeats count there), with 1e-5 in the F1's denominator; 0 for a list that is empty or could not be read."""
    common = F.size(F.array_intersect(predicted, gold))
    precision, recall = common / F.nullif(F.size(predicted), F.lit(0)), common / F.nullif(F.size(gold), F.lit(0))
    return F.coalesce(F.when(predicted.isNotNull() & gold.isNotNull(), 2 * precision * recall / (precision + recall + 1e-5)), F.lit(0.0))


def label_f1(df: DataFrame, labels: DataFrame, *, key: str, said: str = "said", golds: str = "golds", by: str = "edits") -> DataFrame:
    """(key, f1): `said` is a JSON list of labels, of which each is taken as its nearest known one (`labels` has a column name) by edits or by ratio, as nearest_name has it; a text that is no list scores 0. Keys are unique."""
    read = df.select(key, golds, F.from_json(said, "array<string>").alias("_said"))
    # a null in the list is the empty word
    words = read.select(key, F.explode("_said").alias("_w")).withColumn("_w", F.coalesce("_w", F.lit("")))
    near = nearest_name(words.select("_w").distinct(), labels, text="_w", name="name", by=by).select("_w", "nearest")
    named = words.join(near, "_w").groupBy(key).agg(F.collect_list("nearest").alias("_named"))
    out = read.join(named, key, "left")
    return out.select(key, F.when(F.col("_said").isNull(), 0.0).otherwise(set_label_f1(F.col("_named"), F.col(golds))).alias("f1"))


def listed_items(answer: Column) -> Column:
    """Items of a recommendation: the lines from the first `1.` on or, where there is none, what commas and lines part; parts in brackets, numbers and spare white space go. Blank lines are items, too, as they take a place."""
    at = F.instr(answer, F.lit("1."))
    lines = F.split(F.when(at > 0, F.substring(answer, at + 2, F.length(answer))).otherwise(F.translate(answer, ",", "\n")), "\n")
    bare = lambda x: F.regexp_replace(strip(x), r"\([^()]*\)", "")
    return F.transform(lines, lambda x: strip(F.regexp_replace(F.regexp_replace(bare(x), r"^(?:\d+[.)、]?\s*[-—–]?\s*)?", ""), r"\s+", " ")))


def recall_at_k(df: DataFrame, names: DataFrame, *, key: str, answer: str = "answer", golds: str = "golds", ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """recall_k for each row: the share of golds (repeats count) among the first k items of an answer, each taken as its nearest known name. Every row stays: a null answer finds nothing, and so do golds that are null or none. Keys are unique."""
    # no k looks beyond the first items
    items = F.slice(listed_items(F.col(answer)), 1, max(ks))
    listed = df.select(key, F.posexplode(items).alias("at", "item"))
    near = nearest_name(listed.select("item").distinct(), names, text="item", name="name").select("item", "nearest")
    named = listed.join(near, "item").groupBy(key).agg(*[F.collect_set(F.when(F.col("at") < k, F.col("nearest"))).alias(f"_{k}") for k in ks])
    hit = lambda k: F.size(F.filter(golds, lambda g: F.coalesce(F.array_contains(f"_{k}", g), F.lit(False))))
    share = lambda k: F.coalesce(F.when(F.size(golds) > 0, hit(k) / F.size(golds)), F.lit(0.0))
    return df.select(key, golds).join(named, key, "left").select(key, *[share(k).alias(f"recall_{k}") for k in ks])


#: Weight of each order of n-grams, by the highest one: fixed values of the metric.
WEIGHTS = {1: 1.0, 2: 0.5, 3: 0.33, 4: 0.25}


def _bleu(pred: list[str], gold: list[str], n: int) -> float:
    if not pred:
        return 0.0
    logs = 0.0
    for k in range(1, n + 1):
        a = Counter(tuple(pred[i : i + k]) for i in range(len(pred) - k + 1))
        b = Counter(tuple(gold[i : i + k]) for i in range(len(gold) - k + 1))
        hit, total = sum((a & b).values()), max(1, sum(a.values()))
        if k == 1 and not hit:
            return 0.0
        logs += log((hit or 0.1) / total) * WEIGHTS[n]
    return exp(min(0.0, 1 - len(gold) / len(pred)) + logs)


def bleu(df: DataFrame, *, pred: str, gold: str) -> DataFrame:
    """Adds bleu_1..bleu_4: sentence BLEU over lower-cased words, with 0.1 for an order without a match."""

    @F.pandas_udf("struct<bleu_1:double,bleu_2:double,bleu_3:double,bleu_4:double>")
    def score(p: pd.Series, g: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b in zip(p.fillna(""), g.fillna("")):
            a, b = a.lower().split(), b.lower().split()
            rows.append([round(_bleu(a, b, n), 6) for n in (1, 2, 3, 4)])
        return pd.DataFrame(rows, columns=[f"bleu_{n}" for n in (1, 2, 3, 4)])

    return df.withColumn("_b", score(pred, gold)).select("*", "_b.*").drop("_b", pred, gold)


def _lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence by bit rows: one big-integer step a word."""
    places: dict[str, int] = {}
    for i, w in enumerate(b):
        places[w] = places.get(w, 0) | 1 << i
    row = 0
    for w in a:
        x = row | places.get(w, 0)
        row = x & ~(x - ((row << 1) | 1))
    return row.bit_count()


def rouge_l(df: DataFrame, *, pred: str, golds: str, stem: Callable[[str], str] | None = None) -> DataFrame:
    """Adds rouge_l_f and rouge_l_recall, each the best over the golds; words are runs of letters and digits, lower-cased, stemmed by `stem` if given."""
    import re

    word = re.compile(r"[^\W_]+")

    @F.pandas_udf("struct<rouge_l_f:double,rouge_l_recall:double>")
    def score(p: pd.Series, g: pd.Series) -> pd.DataFrame:
        cut = lambda t: [stem(w) if stem else w for w in word.findall((t or "").lower())]
        rows = []
        for a, many in zip(p, g):
            x, f, r = cut(a), 0.0, 0.0
            for y in map(cut, many if many is not None else []):
                n = _lcs(x, y)
                if n:
                    f, r = max(f, 2 * n / (len(x) + len(y))), max(r, n / len(y))
            rows.append((round(f, 6), round(r, 6)))
        return pd.DataFrame(rows, columns=["rouge_l_f", "rouge_l_recall"])

    return df.withColumn("_r", score(pred, golds)).select("*", "_r.*").drop("_r", pred, golds)
