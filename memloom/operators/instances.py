"""Instance building: grouping, evidence, batches, disjoint samples and nested question sets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.text import seeded
from memloom.operators.containing import containing


def _in_order(items: Column) -> Column:
    return F.transform(F.array_sort(items), lambda x: x["v"])


def group_qas_by_context(df: DataFrame, *, context: str, position: str, question: str, answers: str) -> DataFrame:
    """(context, first, qas): unique contexts with place of first sight and their (question, first answer) in order. Grouped by a digest, so long texts are not compared."""
    qa = F.struct(F.col(position).alias("p"), F.struct(F.col(question).alias("question"), F.get(answers, F.lit(0)).alias("answer")).alias("v"))
    rows = df.groupBy(F.sha2(context, 256).alias("_h")).agg(F.first(context).alias(context), F.min(position).alias("first"), _in_order(F.collect_list(qa)).alias("qas"))
    return rows.drop("_h")


def dedup_first(df: DataFrame, *, key: str, order: str) -> DataFrame:
    """The first row of each key: one partial aggregation, no sort."""
    whole = F.struct(*df.columns)
    return df.groupBy(key).agg(F.min_by(whole, order).alias("_r")).select("_r.*")


def resolve_supporting_facts(df: DataFrame, *, titles: str, sentences: str, fact_titles: str, fact_ids: str) -> DataFrame:
    """Adds `facts`: for each (title, sentence number) the sentence in the row's own context, by the first equal title; unknown titles and numbers out of range are left out."""
    one = lambda p: F.get(F.get(sentences, (F.array_position(titles, p["t"]) - 1).cast("int")), p["i"].cast("int"))
    found = F.transform(F.filter(F.arrays_zip(F.col(fact_titles).alias("t"), F.col(fact_ids).alias("i")), lambda p: F.array_contains(titles, p["t"])), one)
    return df.withColumn("facts", F.filter(found, lambda s: s.isNotNull()))


def link_evidence(qas: DataFrame, chunk_titles: DataFrame, *, instance: str, question: str, titles: str, title: str = "title", chunk: str = "chunk_idx") -> DataFrame:
    """(instance, question, evidence_idx): for each evidence title the first chunk that holds it; sorted and distinct; [0] when none is found."""
    first = chunk_titles.groupBy(instance, title).agg(F.min(chunk).alias("_c"))
    asked = qas.select(instance, question, F.explode_outer(titles).alias(title))
    met = asked.join(first, [instance, title], "left").groupBy(instance, question).agg(F.array_sort(F.collect_set("_c")).alias("evidence_idx"))
    return met.withColumn("evidence_idx", F.when(F.size("evidence_idx") > 0, F.col("evidence_idx")).otherwise(F.array(F.lit(0).cast("long"))))


def link_evidence_by_context(qas: DataFrame, contexts: DataFrame, *, instance: str, question: str, context: str, chunk: str = "chunk_idx") -> DataFrame:
    """Each question with the chunk that its context was packed into, by the context's id: `contexts` is (instance, context, chunk) as packing gives it. A context in several chunks: the last. Questions of contexts that no chunk has are left out."""
    last = contexts.groupBy(instance, context).agg(F.max(chunk).alias("evidence_idx"))
    return qas.join(last, [instance, context]).select(instance, question, "evidence_idx")


def link_evidence_by_containment(qas: DataFrame, chunks: DataFrame, *, instance: str, question: str, context: str, text: str, chunk: str, strict: bool = False) -> DataFrame:
    """Each question with the chunks of its own instance that hold its context. The last chunk wins; `strict` repeats the row for every such chunk, each time with that last index.

    Contexts meet chunks by rolling hashes of the chunks' texts (see containing), so no word, however common, gathers
    rows, and texts are sent only to where a context's start is in them. Rows without an instance link nothing.
    """
    chunks, qas = (x.where(F.col(instance).isNotNull()) for x in (chunks, qas))
    held = containing(chunks, qas, group=instance, id=chunk, text=text, needle=context)
    asked = qas.select(F.col(instance).alias("_i"), F.col(question).alias("_q"), F.col(context).alias("_c"))
    met = held.join(asked, held[instance].eqNullSafe(F.col("_i")) & (held[context] == F.col("_c")))
    last = met.groupBy(F.col("_i").alias(instance), F.col("_q").alias(question)).agg(F.max(chunk).alias("evidence_idx"), F.count("*").alias("_n"))
    if strict:
        last = last.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    return last.drop("_n")


def batch_chunks(df: DataFrame, n: int, *, rank: str) -> DataFrame:
    """Consecutive n chunks of a global rank (0..) form an instance; numbering restarts in each."""
    return df.withColumns({"instance_id": F.floor(F.col(rank) / n), "chunk_idx": F.pmod(F.col(rank), F.lit(n))})


def batch_by_title_budget(df: DataFrame, k: int | Column, *, shard: str, order: str, titles: str) -> DataFrame:
    """(shard, order, batch): questions in order; a question whose titles would make the batch larger than k starts a new one with them. Serial within a shard; the shard is the unit of work."""
    budget = k if isinstance(k, Column) else F.lit(k)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("o", ignore_index=True)
        held: set = set()
        out, batch = [], 0
        for titles_here, most in zip(rows["t"], rows["k"]):
            new = set(titles_here if titles_here is not None else ()) - held
            if held and len(held) + len(new) > most:
                held, batch = set(titles_here), batch + 1
            else:
                held |= new
            out.append(batch)
        return rows.assign(batch=out)[["s", "o", "batch"]]

    rows = df.select(F.col(shard).alias("s"), F.col(order).alias("o"), F.col(titles).alias("t"), budget.cast("long").alias("k"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.groupBy("s").applyInPandas(one, f"s {kinds['s']}, o {kinds['o']}, batch long").withColumnsRenamed({"s": shard, "o": order})


def derive_budget(df: DataFrame, target: int, *, tokens: str) -> DataFrame:
    """One row: k = max(1, floor(target / mean tokens))."""
    return df.agg(F.greatest(F.floor(F.lit(target) / F.avg(tokens)), F.lit(1)).alias("k"))


def filter_qas(df: DataFrame, *, qas: str, max_tokens: int, min_count: int, max_count: int, counter) -> DataFrame:
    """Drops questions of `max_tokens` or more, then instances with too few or too many left."""
    kept = F.filter(qas, lambda q: counter(q["question"]) < max_tokens)
    return df.withColumn(qas, kept).where(F.size(qas).between(min_count, max_count))


def filter_chunk_count(df: DataFrame, lo: int, hi: int, *, chunks: str) -> DataFrame:
    return df.where(F.size(chunks).between(lo, hi))


def assign_disjoint(df: DataFrame, n_instances: int, per_instance: int, n_qa: int, *, rank: str, text: str, most_chars: int = 1000) -> DataFrame:
    """Adds instance_id and role (chunk or qa) by a global permutation's rank, so that no sample is used twice; only full instances stay. An instance's first sample is cut to `most_chars`."""
    width = per_instance + n_qa
    place = F.pmod(F.col(rank), F.lit(width))
    total = df.agg(F.count("*").alias("_n"))
    rows = df.crossJoin(F.broadcast(total))  # one row: the count
    rows = rows.withColumns({"instance_id": F.floor(F.col(rank) / width), "role": F.when(place < per_instance, "chunk").otherwise("qa")})
    rows = rows.where((F.col("instance_id") < n_instances) & ((F.col("instance_id") + 1) * width <= F.col("_n"))).drop("_n")
    return rows.withColumn(text, F.when(place == 0, F.substring(text, 1, most_chars)).otherwise(F.col(text)))


def options_to_key(df: DataFrame, *, options: str, answer: str, question: str) -> DataFrame:
    """Adds `key`, the first option whose text equals the answer (null: none does), and puts the options behind the question. Options are a JSON object."""
    entries = F.map_entries(F.from_json(options, "map<string,string>"))
    listed = F.array_join(F.transform(entries, lambda e: F.concat_ws(". ", e["key"], e["value"])), "\n")
    return df.withColumns({"key": F.get(F.filter(entries, lambda e: e["value"] == F.col(answer)), F.lit(0))["key"], question: F.concat_ws("\n", question, listed)})


def join_docs_questions(docs: DataFrame, qas: DataFrame, *, doc: str, question_doc: str, order: str, fields: list[str]) -> DataFrame:
    """Documents that have questions, with these in order."""
    lists = qas.groupBy(F.col(question_doc).cast("string").alias("_d")).agg(_in_order(F.collect_list(F.struct(F.col(order).alias("p"), F.struct(*fields).alias("v")))).alias("qas"))
    return docs.join(lists, F.col(doc).cast("string") == F.col("_d")).drop("_d")


def prefix_join(parents: DataFrame, children: DataFrame, *, group: str, parent: str, child: str, strict: bool = True) -> DataFrame:
    """Parents with the children of the same group whose id starts with theirs (so 1_1 also takes 1_10; strict=False asks for the id's end or a separator). Parents without children stay."""
    # ids are short: a child looks for its parents by each of its own beginnings, so the join has a key
    c = F.col(child)
    ends = F.sequence(F.lit(0), F.length(c))
    if not strict:
        ends = F.filter(ends, lambda n: (n == F.length(c)) | F.substring(c, n + 1, F.lit(1)).rlike("[^0-9A-Za-z]"))
    heads = children.where(c.isNotNull()).select(F.col(group).alias("_g"), c.alias("_c"), F.explode(F.transform(ends, lambda n: F.left(c, n))).alias("_p"))
    return parents.join(heads, (parents[group] == heads["_g"]) & (parents[parent] == heads["_p"]), "left").select(*[parents[x] for x in parents.columns], F.col("_c").alias(child))


def flatten_nested_qas(df: DataFrame, *, person: str, sections: str, skip: tuple[str, ...] = ("profile",)) -> DataFrame:
    """(person, section, id, question, answer) from map<section, map<id, array<struct<question, answer>>>>; skipped sections are left out, direct questions have id null."""
    level = df.select(person, F.explode(sections).alias("section", "ids")).where(~F.col("section").isin(*skip))
    lists = level.select(person, "section", F.explode("ids").alias("id", "qas"))
    rows = lists.select(person, "section", F.when(F.col("id") != "", F.col("id")).alias("id"), F.explode("qas").alias("q"))
    return rows.select(person, "section", "id", "q.question", "q.answer")


def parse_id_list(text: Column) -> Column:
    """Ids of "['a', 'b']" or of a single id; empty for null, blank or a broken list."""
    listed = F.regexp_extract_all(text, F.lit("['\"]([^'\"]*)['\"]"), F.lit(1))
    none = F.array().cast("array<string>")
    return F.when(text.isNull() | (F.trim(text) == ""), none).when(text.rlike(r"^\s*\[.*\]\s*$"), listed).when(text.startswith("["), none).otherwise(F.array(F.trim(text)))


def filter_covered_qas(qas: DataFrame, covered: DataFrame, *, key: str, kind: str, ids: str, kinds: tuple[str, ...] = ("events", "dialogues")) -> DataFrame:
    """Questions of these kinds of which any id is covered; a covered dialogue id also covers what stands before its #."""
    known = covered.select(F.explode(F.array(F.col("id"), F.substring_index("id", "#", 1))).alias("id")).distinct()
    asked = qas.where(F.col(kind).isin(*kinds)).select(key, F.explode(ids).alias("id"))
    return qas.join(asked.join(known, "id", "left_semi").select(key).distinct(), key, "left_semi")


def exclude_sources(df: DataFrame, *, source: str, containing: tuple[str, ...] = (), equal: tuple[str, ...] = ()) -> DataFrame:
    for part in containing:
        df = df.where(~F.contains(F.col(source), F.lit(part)))
    return df.where(~F.col(source).isin(*equal)) if equal else df


def zip_qas(df: DataFrame, *, key: str, questions: str, answers: str) -> DataFrame:
    """(key, position, question, answer) by place, as far as the shorter list goes."""
    pairs = F.arrays_zip(F.col(questions).alias("question"), F.col(answers).alias("answer"))
    cut = F.slice(pairs, F.lit(1), F.least(F.size(questions), F.size(answers)))
    return df.select(key, F.posexplode(cut).alias("position", "x")).select(key, "position", "x.*")


def replicate_shuffled(df: DataFrame, n: int, *, key: str, seed: str = "copy") -> DataFrame:
    """Each row in n instances, with its place in that instance's own shuffle."""
    rows = df.withColumn("instance_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    h = seeded(seed, F.col("instance_id"), F.col(key))
    # places by class of the hash, so that no instance is sorted by one task
    b = F.substring(h, 1, 2)
    rows = rows.withColumns({"_h": h, "_b": b})
    counts = rows.groupBy("instance_id", "_b").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("instance_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy("instance_id", "_b").orderBy("_h", key)) - 1
    return rows.join(counts, ["instance_id", "_b"]).withColumn("place", F.col("_before") + place).drop("_h", "_b", "_before")


def question_tag(question: Column, kind: str, first: Column | None = None, last: Column | None = None) -> Column:
    """The question as a classification, dated or plain prompt."""
    texts = {
        "classify": lambda: F.concat(F.lit("Name the label of: "), question),
        "dated": lambda: F.concat(question, F.lit(" (between "), first, F.lit(" and "), last, F.lit(")")),
        "plain": lambda: question,
    }
    return texts[kind]()
