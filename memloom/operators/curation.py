"""Filtering by baseline answers, standard form, splits, merges and profiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.answers import is_answer_correct
from memloom.functions.text import seeded, strip, token_count, within
from memloom.operators.containing import containing
from memloom.operators.ranking import global_rank, rank_within

#: Lines of one key that are folded at once.
SLICE_LINES = 1000


def keep_unanswerable(qas: DataFrame, predictions: DataFrame, *, question: str = "question", gold: str = "gold", pred: str = "pred", max_tokens: int = 5) -> DataFrame:
    """Rows that a baseline without context does not answer: gold or prediction empty, or a gold under `max_tokens` words that is not in the prediction. A question without prediction goes, unless its gold is empty."""
    met = qas.join(predictions.select(question, F.col(pred).alias("_p")).withColumn("_known", F.lit(True)), question, "left")
    g = F.coalesce(F.col(gold), F.lit(""))
    empty = (g == "") | (F.col("_known") & (F.coalesce("_p", F.lit("")) == ""))
    short = F.col("_known") & (token_count(g) < max_tokens) & ~within(g, F.col("_p"))
    return met.where(F.coalesce(empty, F.lit(False)) | F.coalesce(short, F.lit(False))).drop("_p", "_known")


def keep_until_quota(qas: DataFrame, *, instance: str, order: str, gold: str, pred: str, quota: int = 100, max_test: int | None = None) -> DataFrame:
    """In order, a row is tested while fewer than `quota` rows were kept so far (and its place is under `max_test`): kept if its prediction is wrong or missing. Untested rows are kept."""
    w = Window.partitionBy(instance).orderBy(order)
    wrong = ~is_answer_correct(F.col(pred), F.col(gold))
    place = F.row_number().over(w) - 1
    testable = F.lit(True) if max_test is None else place < max_test
    df = qas.withColumns({"_wrong": wrong, "_testable": testable})
    # rows kept before this one, were all of them tested: while under the quota that is what happened
    kept = F.coalesce(F.sum((F.col("_wrong") | ~F.col("_testable")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("_kept", kept).where(F.col("_wrong") | ~F.col("_testable") | (F.col("_kept") >= quota)).drop("_wrong", "_testable", "_kept")


def keep_answerable(qas: DataFrame, *, instance: str, gold: str = "gold", pred: str = "pred", min_count: int = 20) -> DataFrame:
    """Rows whose gold is in the prediction; of a gold with `;` only the parts found stay, and the row if any does. Instances with fewer than `min_count` rows go. A missing prediction finds nothing."""
    parts = F.transform(F.split(gold, ";"), lambda p: F.trim(p))  # by itself trim() would take a part's place as what to trim
    found = F.filter(parts, lambda p: within(p, F.col(pred)))
    new = F.when(F.contains(gold, F.lit(";")), F.when(F.size(found) > 0, F.concat_ws(";", found))).otherwise(F.when(within(F.col(gold), F.col(pred)), F.col(gold)))
    rows = qas.where(F.col(pred).isNotNull()).withColumn(gold, new).where(F.col(gold).isNotNull())
    enough = rows.groupBy(instance).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_count).select(instance)
    return rows.join(enough, instance, "left_semi")


def build_answer_cache(lines: DataFrame, *, order: str, text: str, mark: str = "✓", slice_lines: int = SLICE_LINES) -> DataFrame:
    """(key, value, place) from log lines `✓ ...key`: value is whether the stripped line starts with the mark, key what follows the first `...`, `&#39;` read as an apostrophe. A value that conflicts with the one held removes the key; a later line adds it anew. place is the order of the line that added the key as it is held.

    A line is a map of what is held (nothing, true or false) to what is held after it, and such maps compose. So each
    slice of `slice_lines` lines of a key becomes one map, slices of slices become one, and so on: no task holds more
    than a slice, however many lines a key has. Lines of equal order are taken by their values.
    """
    line = strip(F.col(text))
    key = F.regexp_replace(strip(F.expr("substring(_line, instr(_line, '...') + 3)")), "&#39;", "'")
    rows = lines.select(F.col(order).alias("o"), line.alias("_line")).where(F.contains("_line", F.lit("..."))).select("o", F.col("_line").startswith(mark).alias("v"), key.alias("key"))
    kind = f"struct<v:boolean,o:{rows.schema['o'].dataType.simpleString()}>"
    held = lambda v, o: F.struct(v.alias("v"), o.alias("o")).cast(kind)
    nothing = held(F.lit(None), F.lit(None))

    def after_line(s: Column, x: Column) -> Column:
        return F.when(s["v"].isNull(), held(x["v"], x["o"])).when(s["v"] == x["v"], s).otherwise(nothing)

    def after_map(s: Column, x: Column) -> Column:
        """What a slice's map makes of what is held; a place of before stays if the slice gives none."""
        to = F.when(s["v"].isNull(), x["none"]).when(s["v"], x["yes"]).otherwise(x["no"])
        return held(to["v"], F.when(to["v"].isNotNull(), F.coalesce(to["o"], s["o"])))

    starts = {"none": nothing, "yes": held(F.lit(True), F.lit(None)), "no": held(F.lit(False), F.lit(None))}

    def folded(rows: DataFrame, step: Callable[[Column, Column], Column]) -> DataFrame:
        log = F.array_sort(F.collect_list(F.struct("place", "x")))
        maps = rows.withColumn("place", F.col("at")).groupBy("key", F.floor(F.col("at") / slice_lines).alias("at")).agg(log.alias("log"))
        made = F.struct(*[F.aggregate("log", start, lambda s, e: step(s, e["x"])).alias(name) for name, start in starts.items()])
        return maps.select("key", "at", made.alias("x"))

    ranked = rank_within(rows, ["key"], [F.col("o"), F.col("v")], name="at")
    slices = folded(ranked.select("key", "at", F.struct("v", "o").alias("x")), after_line)
    longest = ranked.agg(F.max("at").alias("n")).first().n or 0
    while longest >= slice_lines:
        longest //= slice_lines
        slices = folded(slices, after_map)
    return slices.where(F.col("x.none.v").isNotNull()).select("key", F.col("x.none.v").alias("value"), F.col("x.none.o").alias("place"))


def lookup_cache(qas: DataFrame, cache: DataFrame, *, key: str, question: str, position: str, tail: int = 100) -> DataFrame:
    """Adds `value` of the first cache key with which the question ends, or that stands in its last `tail` characters; null without one.

    Either way the question contains the key: they meet by rolling hashes (see containing), keys of any length alike.
    """
    one = F.lit(1)
    asked = qas.select(F.col(key).alias("_k"), F.col(question).alias("_q"), one.alias("_g")).where(F.col("_q").isNotNull())
    keys = cache.select(F.col("key").alias("_n"), F.col("value").alias("_value"), F.col(position).alias("_at"), one.alias("_g"))
    # only a question's end is looked at: a key that ends it may be longer than the tail, one inside may not
    texts = asked.select("_g", "_k", "_q")
    near = containing(texts, keys, group="_g", id="_k", text="_q", needle="_n")
    hit = F.endswith("_q", F.col("_n")) | F.contains(F.right("_q", F.lit(tail)), F.col("_n"))
    found = near.join(keys, ["_g", "_n"]).join(asked, ["_g", "_k"]).where(hit).groupBy(F.col("_k").alias(key)).agg(F.min_by("_value", "_at").alias("value"))
    return qas.join(found, key, "left")


def standardize(df: DataFrame, *, core: list[str], qas: str = "qas") -> DataFrame:
    """Questions keep question and answer (`answer`, else the first of `answers`, else ""); columns outside `core` go into a JSON `metadata`."""
    answer = lambda q: F.coalesce(q["answer"], F.get(q["answers"], F.lit(0)), F.lit(""))
    rest = [c for c in df.columns if c not in (*core, qas)]
    meta = F.to_json(F.struct(*rest)) if rest else F.lit("{}")
    return df.select(*core, F.transform(qas, lambda q: F.struct(q["question"].alias("question"), answer(q).alias("answer"))).alias(qas), meta.alias("metadata"))


def split_ratio(df: DataFrame, ratio: float, *, key: str, seed: str = "split") -> DataFrame:
    """Adds `split`: the first floor(n * ratio) rows of a seeded order are train, the rest test."""
    h = seeded(seed, F.col(key))
    n = df.agg(F.count("*").alias("_total"))
    ranked = global_rank(df, [h, F.col(key)]).crossJoin(F.broadcast(n))  # one row: the count
    return ranked.withColumn("split", F.when(F.col("rank") < F.floor(F.col("_total") * ratio), "train").otherwise("test")).drop("rank", "_total")


def split_by_hash(df: DataFrame, ratio: float, *, key: str, seed: str = "split") -> DataFrame:
    """The same by a bound on the hash: about floor(n * ratio) rows are train, without any shuffle."""
    u = F.conv(F.substring(seeded(seed, F.col(key)), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return df.withColumn("split", F.when(u < ratio, "train").otherwise("test"))


def split_by_size(df: DataFrame, max_chunks: int, *, chunks: str) -> DataFrame:
    return df.withColumn("split", F.when(F.col(chunks) <= max_chunks, "train").otherwise("test"))


def sample_per_group(df: DataFrame, n: int | Column, *, group: list[str], key: str, seed: str = "sample") -> DataFrame:
    """At most n rows of each group, by seeded order."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(seeded(seed, F.col(key)), key))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def merge_sources(sets: dict[str, DataFrame], *, key: str, limit: int | None = None, seed: str = "merge", labels: tuple[str, ...] = ("data_source", "sub_source")) -> DataFrame:
    """Union of train and test rows of several sets. A row's `data_source` is the first of its label columns, else its set's name; train rows are limited to n per source, by seeded order; test rows all stay."""
    out = None
    for name, df in sets.items():
        label = F.coalesce(*[F.col(c) for c in labels if c in df.columns], F.lit(name))
        one = df.withColumn("data_source", label).drop(*[c for c in labels if c != "data_source"])
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if limit is None:
        return out
    train = sample_per_group(out.where("split = 'train'"), limit, group=["data_source"], key=key, seed=seed)
    return train.unionByName(out.where("split <> 'train'"))


def reindex(df: DataFrame, order: list[Column], *, name: str = "instance_id") -> DataFrame:
    return global_rank(df, order, name=name)


def bin_accuracies(df: DataFrame, *, accuracy: str, bins: int = 10) -> DataFrame:
    """Adds `bin`, the label `lo-hi` of the tenth that an accuracy of 0 to 1 falls into (1 into the last); null for a null."""
    k = F.when(F.col(accuracy).isNotNull(), F.least(F.floor(F.round(F.col(accuracy) * bins, 9)), F.lit(bins - 1)))
    edge = lambda c: F.format_number(c / bins, 1)
    return df.withColumn("bin", F.concat(edge(k), F.lit("-"), edge(k + 1)))


def levels_of(instances: DataFrame, binned: DataFrame, *, key: str, bin: str = "bin", strict: bool = True) -> DataFrame:
    """Instances with the level of their bin; those without one go. An instance that several bins name has a row for each of its levels."""
    levels = split_difficulty(binned.select(key, bin).where(F.col(bin).isNotNull()), bin=bin, strict=strict).select(key, "level").distinct()
    return instances.join(levels, key)


def split_difficulty(df: DataFrame, *, bin: str, strict: bool = True) -> DataFrame:
    """Adds `level` from a bin label `lo-hi`: start above 0.7 easy, from 0.6 medium, else hard. A start of 0.7 is medium; strict=False makes it easy."""
    start = F.split(bin, "-")[0].cast("double")
    return df.withColumn("level", F.when((start > 0.7) if strict else (start >= 0.7), "easy").when(start >= 0.6, "medium").otherwise("hard"))


def replace_answers(df: DataFrame, mapping: DataFrame, *, key: str, qas: str = "qas", word: str = "summarize") -> DataFrame:
    """Instances that the mapping (key, keywords array) knows; questions with the word get the joined keywords as answer."""
    met = df.join(mapping.select(key, F.array_join("keywords", ", ").alias("_k")), key)
    new = F.transform(qas, lambda q: F.struct(q["question"].alias("question"), F.when(F.contains(F.lower(q["question"]), F.lit(word)), F.col("_k")).otherwise(q["answer"]).alias("answer")))
    return met.withColumn(qas, new).drop("_k")


def first_matching_qa(df: DataFrame, word: str, *, qas: str = "qas") -> DataFrame:
    """Adds `matched`, the first question with the word; rows without one go."""
    return df.withColumn("matched", F.get(F.filter(qas, lambda q: F.contains(F.lower(q["question"]), F.lit(word))), F.lit(0))).where(F.col("matched").isNotNull())


def pending_rows(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def prompt_key(prompt: Column) -> Column:
    return F.sha2(prompt, 256)


def reuse_answers(df: DataFrame, done: DataFrame, *, keys: list[str], pred: str, order: str) -> DataFrame:
    """Adds the last earlier prediction of the same keys that is not blank; null without one."""
    last = done.where(F.trim(F.col(pred)) != "").groupBy(*keys).agg(F.max_by(pred, order).alias(pred))
    return df.join(last, keys, "left")


def validate_keywords(text: Column, most: int = 3) -> Column:
    """Whether every `;` part has at most `most` words."""
    return F.forall(F.split(text, ";"), lambda k: F.size(F.filter(F.split(F.trim(k), " "), lambda w: w != "")) <= most)


def profile_dataset(chunks: DataFrame, *, source: str, instance: str, tokens: str, questions: DataFrame | None = None, over: tuple[int, ...] = (4096, 8000)) -> DataFrame:
    """Per source: instances, chunks (in all, mean, least and most), token least, most, mean and upper median, and counts and shares above each bound; questions (instance rows) if given.

    The upper median is the value of rank floor(n / 2) + 1: values are counted first, so a source's distinct token
    counts are put in order, not its chunks.
    """
    per = chunks.groupBy(source, instance).agg(F.count("*").alias("c"))
    by_instance = per.groupBy(source).agg(F.count("*").alias("n_instances"), F.sum("c").alias("n_chunks"), F.avg("c").alias("mean_chunks"), F.min("c").alias("min_chunks"), F.max("c").alias("max_chunks"))
    t = F.col(tokens)
    above = [x for b in over for x in (F.sum((t > b).cast("long")).alias(f"over_{b}"), F.avg((t > b).cast("double")).alias(f"share_{b}"))]
    stats = chunks.groupBy(source).agg(F.min(t).alias("min_tokens"), F.max(t).alias("max_tokens"), F.avg(t).alias("mean_tokens"), *above)
    values = chunks.groupBy(source, t.alias("v")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(source).orderBy("v")
    values = values.withColumns({"run": F.sum("n").over(w), "all": F.sum("n").over(Window.partitionBy(source))})
    median = values.where(F.col("run") >= F.floor(F.col("all") / 2) + 1).groupBy(source).agg(F.min("v").alias("median_tokens"))
    out = by_instance.join(stats, source).join(median, source)
    if questions is not None:
        out = out.join(questions.groupBy(source).agg(F.count("*").alias("n_questions")), source, "left").withColumn("questions_per_chunk", F.coalesce("n_questions", F.lit(0)) / F.col("n_chunks"))
    return out


def source_counts(df: DataFrame, *, split: str, source: str, chunks: str) -> DataFrame:
    """Rows and mean chunks per split and source, with split totals and the grand total (null source, null split)."""
    return df.rollup(split, source).agg(F.count("*").alias("n"), F.avg(chunks).alias("mean_chunks"))


def check_schema(df: DataFrame, *, key: str, qas: str = "qas", most: int = 100) -> DataFrame:
    """(key, problem) of instances with too many questions or a question or answer that is missing."""
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    problem = F.when(F.size(qas) > most, "too many questions").when(F.exists(qas, lambda q: blank(q["question"])), "no question").when(F.exists(qas, lambda q: blank(q["answer"])), "no answer")
    return df.select(key, problem.alias("problem")).where(F.col("problem").isNotNull())


def select_benchmark(df: DataFrame, name: str, subsets: dict[str, tuple[str, object]], *, source: str = "data_source") -> DataFrame:
    """Rows of a named subset: (equals | isin | prefix, what)."""
    kind, what = subsets[name]
    s = F.col(source)
    return df.where({"equals": lambda: s == what, "isin": lambda: s.isin(list(what)), "prefix": lambda: s.startswith(what)}[kind]())


def sample_rows(df: DataFrame, n: int, *, key: str, seed: str = "rows") -> DataFrame:
    """n rows by seeded order; all for -1."""
    return df if n < 0 else df.orderBy(seeded(seed, F.col(key)), key).limit(n)


def sample_share(df: DataFrame, share: float, *, group: str, key: str, above: int = 50, seed: str = "share") -> DataFrame:
    """Of each group of more than `above` rows the first int(rows * share) by seeded order; smaller groups stay whole.

    Null is a group. Rows are numbered by range partitions, so no group is in one task; rows of one key stand in any order.
    """
    names = {f"_own{k}": c for k, c in enumerate(df.columns)}
    at = {c: k for k, c in names.items()}
    held = df.toDF(*names).withColumn("_order", seeded(seed, F.col(at[key])))
    ranked = rank_within(held, [at[group]], [F.col("_order"), F.col(at[key])], name="_rank", size="_rows")
    kept = ranked.where((F.col("_rows") <= above) | (F.col("_rank") < F.floor(F.col("_rows") * F.lit(share))))
    return kept.select(*[F.col(k).alias(c) for k, c in names.items()])
