"""Packing texts into token-bounded chunks, and shaping them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.text import SENTENCE_END, seeded, seeded_int, split_words, strip, token_count
from memloom.operators.grouped import by_group
from memloom.operators.ranking import global_rank, rank_within
from memloom.sources.tables import Tables

#: Items of one group that a task packs at once.
SLICE_ITEMS = 200_000


def pack_places(sizes: np.ndarray, target, sep: int, guard: bool = True) -> np.ndarray:
    """Chunk number of each item, in order.

    A chunk takes items while the running size (items and separators so far) plus the next item stays within the
    target; the separator of the next item does not count in that test. A single larger item is a chunk of its own;
    without `guard` a first larger item leaves an empty chunk before it. `target` is a number or a function of the chunk
    number. One binary search a chunk, not one step an item.
    """
    run = np.concatenate([[0], np.cumsum(sizes + sep)])
    reach = run[:-1] + sizes  # what is used when an item stands last: never falls from item to item
    out = np.zeros(len(sizes), np.int64)
    at = chunk = 0
    while at < len(sizes):
        most = target(chunk) if callable(target) else target
        if not guard and sizes[at] > most and at == 0:
            chunk += 1
            most = target(chunk) if callable(target) else target
        # item j fits behind items at..j-1 if their sizes and separators plus its own stay within the target
        end = max(at + 1, int(np.searchsorted(reach, run[at] + most, "right")))
        out[at:end] = chunk
        at, chunk = end, chunk + 1
    return out


def _slice_map(sizes: np.ndarray, most: int, sep: int) -> tuple[list[int], list[int], list[int], int]:
    """What a slice of a group makes of an open chunk: (reach, made, left, total).

    A chunk that `used` tokens are in breaks before the first item j with used + reach[j] > most; then `made[j]` chunks
    start in the slice, and `left[j]` tokens are in the last of them. Without such an item, `total` is added to it.
    reach has only items at which an open chunk can break.
    """
    m = len(sizes)
    run = np.concatenate([[0], np.cumsum(sizes + sep)])
    reach = run[:-1] + sizes
    after = np.maximum(np.searchsorted(reach, run[:-1] + most, "right"), np.arange(m) + 1).tolist()
    first = min(m, int(np.searchsorted(reach, most, "right")) + 1)
    made, left = [0] * m, [0] * m
    for at in range(m - 1, -1, -1):
        made[at], left[at] = (1, int(run[m] - run[at])) if after[at] >= m else (made[after[at]] + 1, left[after[at]])
    return reach[:first].tolist(), made[:first], left[:first], int(run[m])


def _pack_in_slices(rows: DataFrame, kinds: dict[str, str], most: int, sep: int, guard: bool, slice_items: int, tables: Tables) -> DataFrame:
    """(g, o, chunk_idx) of groups of any size: each slice of a group becomes a map of what an open chunk holds before it to what is open behind it, the maps are chained, and then each slice is packed by itself."""
    log = tables.keep(rank_within(rows, ["g"], [F.col("o")], name="at").withColumn("part", F.floor(F.col("at") / slice_items)))

    def maps(items: pd.DataFrame) -> pd.DataFrame:
        reach, made, left, total = _slice_map(items["n"].to_numpy(np.int64), most, sep)
        return pd.DataFrame({"g": items["g"].iloc[:1], "part": items["part"].iloc[:1], "reach": [reach], "made": [made], "left": [left], "total": total, "first": int(items["n"].iloc[0])})

    made = by_group(log, "key", ["at"], maps, f"g {kinds['g']}, part long, reach array<long>, made array<long>, left array<long>, total long, first long", df_group=F.struct("g", "part"))

    def chain(slices: pd.DataFrame) -> pd.DataFrame:
        used, chunk, out = 0, -1, []
        for k, (reach, n, left, total) in enumerate(slices[["reach", "made", "left", "total"]].itertuples(index=False)):
            out.append((used, chunk))
            at = int(np.searchsorted(reach, most - used, "right")) if k else 0  # the first item opens a chunk whatever its size
            if at < len(reach):
                used, chunk = int(left[at]), chunk + int(n[at])
            else:
                used += int(total)
        lead = int(not guard and int(slices["first"].iloc[0]) > most)
        return slices[["g", "part"]].assign(used=[u for u, _ in out], chunk=[c + lead for _, c in out])

    opened = tables.keep(by_group(made, "g", ["part"], chain, f"g {kinds['g']}, part long, used long, chunk long"))
    names = opened.select(F.col("g").alias("_g"), F.col("part").alias("_part"), "used", "chunk")
    # one row a slice
    log = log.join(F.broadcast(names), log.g.eqNullSafe(F.col("_g")) & (F.col("part") == F.col("_part")))

    def places(items: pd.DataFrame) -> pd.DataFrame:
        sizes, used, chunk = items["n"].to_numpy(np.int64), int(items["used"].iloc[0]), int(items["chunk"].iloc[0])
        reach = np.concatenate([[0], np.cumsum(sizes + sep)[:-1]]) + sizes
        at = int(np.searchsorted(reach, most - used, "right")) if int(items["part"].iloc[0]) else 0
        rest = pack_places(sizes[at:], most, sep) + chunk + 1
        return items.assign(chunk_idx=np.concatenate([np.full(at, chunk), rest]))[["g", "o", "chunk_idx"]]

    return by_group(log, "key", ["at"], places, f"g {kinds['g']}, o {kinds['o']}, chunk_idx long", df_group=F.struct("g", "part"))


def pack_greedy(df: DataFrame, *, group: str, order: str, tokens: str, max_tokens: int, sep_tokens: int = 1, min_tokens: int | None = None, seed: str = "pack", guard: bool = True, slice_items: int = SLICE_ITEMS) -> DataFrame:
    """(group, order, chunk_idx). Only ids and sizes travel to the packing; texts are joined back by join_chunks(). A group of more than `slice_items` items is packed in slices, so no task holds more than one.

    With `min_tokens` (0: max(100, max // 20)) each chunk has its own target between it and `max_tokens`, from a digest of seed, group and
    chunk number; such a group is one task's work, as a chunk's target is known only when all before it are.
    """
    low = None if min_tokens is None else min_tokens or max(100, max_tokens // 20)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        def target(chunk: int) -> int:
            h = int(hashlib.md5(f"{seed}|{rows['g'].iloc[0]}|{chunk}".encode()).hexdigest()[:8], 16)
            return low + h % (max_tokens - low + 1)

        places = pack_places(rows["n"].to_numpy(np.int64), max_tokens if low is None else target, sep_tokens, guard)
        return rows.assign(chunk_idx=places)[["g", "o", "chunk_idx"]]

    rows = df.select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(tokens).cast("long").alias("n"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"g {kinds['g']}, o {kinds['o']}, chunk_idx long"
    with Tables(df.sparkSession) as tables:
        hot = None
        if low is None:
            rows = tables.keep(rows)  # sizes are counted once, for the look at the groups and for the packing
            # at most one group for each slice_items rows
            hot = rows.groupBy(F.col("g").alias("_g")).agg(F.count("*").alias("_n")).where(F.col("_n") > slice_items).select("_g")
        if hot is None or not hot.take(1):
            out = by_group(rows, "g", ["o"], one, schema)
        else:
            hot = F.broadcast(tables.keep(hot))
            same = F.col("g").eqNullSafe(F.col("_g"))
            out = by_group(rows.join(hot, same, "left_anti"), "g", ["o"], one, schema)
            out = out.unionByName(_pack_in_slices(rows.join(hot, same, "left_semi"), kinds, max_tokens, sep_tokens, guard, slice_items, tables))
    return out.withColumnsRenamed({"g": group, "o": order})


def join_chunks(df: DataFrame, places: DataFrame, *, group: str, order: str, text: str, sep: str = "\n", trim: Callable[[Column], Column] = strip) -> DataFrame:
    """(group, chunk_idx, text, n_items): chunk texts in order, trimmed (of white space of any kind, if `trim` says nothing else)."""
    items = df.select(group, order, text).join(places, [group, order])
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"])
    return items.groupBy(group, "chunk_idx").agg(trim(F.array_join(parts, sep)).alias("text"), F.count("*").alias("n_items"))


def _sentences(text: Column, end_mark: str = "<|endoftext|>") -> Column:
    clean = F.regexp_replace(text, F.lit(end_mark.replace("|", "\\|")), F.lit("\n"))
    return F.split(clean, SENTENCE_END)


def sentences(df: DataFrame, *, key: str, text: str, end_mark: str = "<|endoftext|>", trim: Callable[[Column], Column] = strip) -> DataFrame:
    """(key, pos, sentence): the text, with the end mark as a new line, cut behind . ! ? and white space. A sentence of which trimming leaves nothing goes."""
    rows = df.select(key, F.posexplode(_sentences(F.col(text), end_mark)).alias("pos", "sentence"))
    return rows.where(trim(F.col("sentence")) != "")


def _chunk_starts(max_tokens: int, sep: int, guard: bool):
    """The first item of each chunk that holds any, for an array of sizes."""

    @F.pandas_udf("array<int>")
    def starts(sizes: pd.Series) -> pd.Series:
        places = [pack_places(np.asarray(n, np.int64), max_tokens, sep, guard) for n in sizes]
        return pd.Series([np.flatnonzero(np.diff(p, prepend=-1)) for p in places], dtype=object)

    return starts


def chunk_sentences(df: DataFrame, max_tokens: int, *, key: str, text: str, counter="words", count_sep: bool = True, guard: bool = True, trim: Callable[[Column], Column] = strip) -> DataFrame:
    """(key, chunk_idx, text, n_items): sentences packed with a space between; a row's sentences are packed where it is read, as a text is a group. Rows without a key go. Plain variant: count_sep=False, guard=False; there a first sentence that is too large leaves an empty chunk before it, which is a row.

    A counter that is a function is applied to a column with a row a sentence.
    """
    if callable(counter):
        rows = sentences(df, key=key, text=text, trim=trim).where(F.col(key).isNotNull()).withColumn("n", token_count(F.col("sentence"), counter))
        one = F.array_sort(F.collect_list(F.struct("pos", "sentence", F.col("n").cast("long").alias("n"))))
        rows = rows.groupBy(F.col(key).alias("k")).agg(one.alias("x")).select("k", F.col("x.sentence").alias("s"), F.col("x.n").alias("n"))
    else:
        held = F.filter(_sentences(F.col(text)), lambda s: trim(s) != "")
        rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), held.alias("s")).where(F.size("s") > 0)
        rows = rows.withColumn("n", F.transform("s", lambda s: token_count(s, counter)))
    rows = rows.withColumn("at", _chunk_starts(max_tokens, int(count_sep), guard)("n"))
    # without guard chunk 0 is empty before a first sentence that is too large
    lead = F.lit(0) if guard else (F.get("n", F.lit(0)) > max_tokens).cast("int")
    chunk = lambda idx, text, n: F.struct(idx.cast("long").alias("chunk_idx"), text.alias("text"), n.cast("long").alias("n_items"))

    def made(at: Column, i: Column) -> Column:
        n = F.coalesce(F.get("at", i + 1), F.size("s")) - at
        return chunk(i + lead, trim(F.array_join(F.slice("s", at + 1, n), " ")), n)

    chunks = F.transform("at", made)
    if not guard:
        empty = F.array(chunk(F.lit(0), F.lit(""), F.lit(0)))
        chunks = F.when(lead == 1, F.concat(empty, chunks)).otherwise(chunks)
    return rows.select(F.col("k").alias(key), F.explode(chunks).alias("c")).select(key, "c.*")


def pack_titled(df: DataFrame, max_tokens: int, *, group: str, order: str, title: str, text: str, counter="words", trim: Callable[[Column], Column] = strip) -> DataFrame:
    """Articles as `Title: text`, packed; one larger than the target is cut to (target - 100) * 4 characters and left out if still too large, or without a title or text. Each chunk keeps its titles."""
    whole = F.concat(F.col(title), F.lit(": "), F.col(text))
    cut = F.when(token_count(whole, counter) > max_tokens, F.substring(whole, 1, max(0, (max_tokens - 100) * 4))).otherwise(whole)
    rows = df.select(group, order, title, cut.alias("_t")).withColumn("_n", token_count(F.col("_t"), counter)).where(F.col("_t").isNotNull() & (F.col("_n") <= max_tokens))
    places = pack_greedy(rows, group=group, order=order, tokens="_n", max_tokens=max_tokens)
    met = rows.join(places, [group, order])
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_t").alias("t"), F.col(title).alias("h"))))
    return met.groupBy(group, "chunk_idx").agg(parts.alias("p")).select(group, "chunk_idx", trim(F.array_join(F.transform("p", lambda x: x["t"]), "\n")).alias("text"), F.transform("p", lambda x: x["h"]).alias("titles"))


def render_session(df: DataFrame, *, key: str, turn: str, role: str, text: str, header: str = "Conversation") -> DataFrame:
    """A header and one `<Role>text` line per turn, in order."""
    line = F.concat(F.lit("<"), F.initcap(role), F.lit(">"), text)
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), line.alias("l")))), lambda x: x["l"])
    return df.groupBy(key).agg(F.concat_ws("\n", F.lit(header), lines).alias("text"))


def split_long_turns(df: DataFrame, max_tokens: int, *, key: list[str], role: str, text: str, slack: int = 150) -> DataFrame:
    """(key, part, role, text): turns over max_tokens - slack words in parts of whole sentences that fit; a larger sentence is cut by words."""
    budget = max_tokens - slack
    words = lambda s: split_words(s)
    cut = lambda s: F.when(F.size(words(s)) <= budget, F.array(s)).otherwise(F.transform(F.sequence(F.lit(0), F.ceil(F.size(words(s)) / budget).cast("int") - 1), lambda i: F.array_join(F.slice(words(s), i * budget + 1, F.lit(budget)), " ")))
    pieces = F.flatten(F.transform(F.split(text, SENTENCE_END), cut))
    keyed = df.select(F.struct(*key).alias("k"), role, F.posexplode(F.when(F.size(words(F.col(text))) > budget, pieces).otherwise(F.array(text))).alias("pos", "piece"))
    rows = keyed.withColumns({"n": token_count(F.col("piece")), "g": F.to_json("k")})
    places = pack_greedy(rows, group="g", order="pos", tokens="n", max_tokens=budget, sep_tokens=0)
    texts = join_chunks(rows, places, group="g", order="pos", text="piece", sep=" ")
    heads = rows.where("pos = 0").select("g", "k", role)
    return texts.join(heads, "g").select("k.*", F.col("chunk_idx").alias("part"), role, F.col("text").alias(text))


def _segments(sizes: list[int], roles: list[str], most: int) -> list[int]:
    out, start, used = [0] * len(sizes), 0, 0
    segment = 0
    for i, n in enumerate(sizes):
        if i > start and used + n > most:
            segment += 1
            # a question at the end of a segment goes with its answer, unless it is all there is
            if roles[i - 1] == "user" and i - 1 > start:
                out[i - 1] = segment
                start, used = i - 1, sizes[i - 1]
            else:
                start, used = i, 0
        out[i] = segment
        used += n
    return out


def segment_sessions(df: DataFrame, max_tokens: int = 2048, *, key: str, turn: str, role: str, tokens: str) -> DataFrame:
    """(key, turn, segment): turns of a session packed in order; when one does not fit, a user turn before it moves along, so that a question stays with its answer."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(segment=_segments(rows["n"].tolist(), rows["r"].tolist(), max_tokens))[["k", "t", "segment"]]

    rows = df.select(F.col(key).alias("k"), F.col(turn).alias("t"), F.col(role).alias("r"), F.col(tokens).cast("long").alias("n"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return by_group(rows, "k", ["t"], one, f"k {kinds['k']}, t {kinds['t']}, segment long").withColumnsRenamed({"k": key, "t": turn})


def _merged(sizes: list[int], lo: int, hi: int) -> list[int]:
    out, chunk, used, empty = [], 0, 0, True
    for n in sizes:
        if not empty and used + n > hi:
            chunk, used, empty = chunk + 1, 0, True
        out.append(chunk)
        used, empty = used + n, False
        if lo <= used <= hi:
            chunk, used, empty = chunk + 1, 0, True
    return out


def merge_segments(df: DataFrame, lo: int = 1800, hi: int = 2048, *, key: str, order: str, tokens: str) -> DataFrame:
    """(key, order, chunk_idx): segments appended in order; over `hi` the chunk closes before, from `lo` on it closes at once."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(chunk_idx=_merged(rows["n"].tolist(), lo, hi))[["k", "o", "chunk_idx"]]

    rows = df.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(tokens).cast("long").alias("n"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return by_group(rows, "k", ["o"], one, f"k {kinds['k']}, o {kinds['o']}, chunk_idx long").withColumnsRenamed({"k": key, "o": order})


def wrap_chunks(df: DataFrame, templates: list[str], *, instance: str, chunk: str, text: str, base: str = "2024-01-01", seed: str = "wrap") -> DataFrame:
    """Adds `wrapped`: a dated header (base + chunk days) and the chunk in one of the templates (each with a %s), picked by hash."""
    day = F.date_format(F.date_add(F.lit(base).cast("date"), F.col(chunk).cast("int")), "yyyy-MM-dd")
    pick = seeded_int(seed, len(templates), F.col(instance), F.col(chunk))
    body = None
    for k, t in enumerate(templates):
        one = F.format_string(t, F.col(text))
        body = F.when(pick == k, one) if body is None else body.when(pick == k, one)
    return df.withColumn("wrapped", F.concat(F.lit("["), day, F.lit("]\n"), body))


def progressive_dates(df: DataFrame, lo: int = 1, hi: int = 3, *, instance: str, chunk: str, base: str = "2024-01-01", seed: str = "days") -> DataFrame:
    """Adds `day`, and the instance's first and last: the first chunk on the base date, each next one a hashed lo..hi days later."""
    w = Window.partitionBy(instance)
    gap = F.when(F.row_number().over(w.orderBy(chunk)) > 1, lo + seeded_int(seed, hi - lo + 1, F.col(instance), F.col(chunk))).otherwise(0)
    days = F.sum("_g").over(w.orderBy(chunk).rowsBetween(Window.unboundedPreceding, 0))
    out = df.withColumn("_g", gap).withColumn("day", F.date_add(F.lit(base).cast("date"), days.cast("int"))).drop("_g")
    return out.withColumns({"first_day": F.min("day").over(w), "last_day": F.max("day").over(w)})


def parse_labeled_lines(df: DataFrame, *, key: str, text: str, mark: str = "label:") -> DataFrame:
    """(key, sentence, label): a non-empty line without the mark that is followed by one with it."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    ahead = F.lead("line").over(Window.partitionBy(key).orderBy("pos"))
    rows = lines.withColumn("next", ahead)
    good = (strip(F.col("line")) != "") & ~strip(F.col("line")).startswith(mark) & strip(F.col("next")).startswith(mark)
    return rows.where(good).select(key, strip(F.col("line")).alias("sentence"), strip(F.expr(f"substring(trim(next), {len(mark) + 1})")).alias("label"))


def reformat_labeled_blocks(text: Column, mark: str = "label:") -> Column:
    """Blocks between blank lines that have the mark exactly once and a sentence before it, joined by blank lines."""
    blocks = F.filter(F.split(text, r"\n\s*\n"), lambda b: (F.size(F.split(b, mark)) == 2) & (strip(F.split(b, mark)[0]) != ""))
    return F.array_join(F.transform(blocks, lambda b: F.concat(strip(F.split(b, mark)[0]), F.lit(f"\n{mark} "), strip(F.split(b, mark)[1]))), "\n\n")


def distribute_even(df: DataFrame, n_chunks: int, *, key: str, seed: str = "even", needed: int | None = None) -> DataFrame:
    """Adds `chunk_idx`: rows in seeded order, total // n to a chunk and one more to the first total % n. With `needed` rows wanted the rows are repeated in turn. Ranks are global, so places are arithmetic and no task sorts the table."""
    h = seeded(seed, F.col(key))
    ranked = global_rank(df, [h, F.col(key)])
    if needed is not None:
        n = df.count()
        copies = -(-needed // max(n, 1))
        ranked = ranked.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(max(copies - 1, 0))))).withColumn("rank", F.col("copy") * n + F.col("rank")).where(F.col("rank") < needed)
        total = F.lit(min(needed, n * copies))
    else:
        ranked = ranked.crossJoin(F.broadcast(df.agg(F.count("*").alias("_total"))))  # one row: the count
        total = F.col("_total")
    base, more = F.floor(total / n_chunks), F.pmod(total, F.lit(n_chunks))
    inside = F.col("rank") < more * (base + 1)
    place = F.when(inside, F.floor(F.col("rank") / (base + 1))).otherwise(more + F.floor((F.col("rank") - more * (base + 1)) / F.greatest(base, F.lit(1))))
    return ranked.withColumn("chunk_idx", place.cast("int")).drop("rank", "_total")


def ensure_label_coverage(chosen: DataFrame, pool: DataFrame, *, label: str, key: str, chunk: str = "chunk_idx", seed: str = "cover") -> DataFrame:
    """The chosen rows, and for each of the pool's labels that none of them has one seeded row of it, in chunk 0."""
    missing = pool.join(chosen.select(label).distinct(), label, "left_anti")
    pick = missing.groupBy(label).agg(F.min_by(F.struct(*missing.columns), F.struct(seeded(seed, F.col(key)), key)).alias("r")).select("r.*")
    return chosen.unionByName(pick.withColumn(chunk, F.lit(0).cast(chosen.schema[chunk].dataType)).select(chosen.columns))


def render_example(text: Column, labels: Column) -> Column:
    return F.concat(text, F.lit("\nlabel: "), F.array_join(labels, ", "))


def split_half(df: DataFrame, *, group: str, order: str, tokens: str, least: int = 1) -> DataFrame:
    """Adds `side` (0 or 1): a group is cut behind the first item whose running tokens reach half; both sides stay non-empty, and if a side has fewer than `least` items the cut moves by one."""
    w = Window.partitionBy(group)
    run = F.sum(tokens).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    rows = df.withColumns({"_run": run, "_all": F.sum(tokens).over(w), "_n": F.count("*").over(w), "_i": F.row_number().over(w.orderBy(order))})
    cut = F.min(F.when(F.col("_run") >= F.col("_all") / 2, F.col("_i"))).over(w)
    cut = F.greatest(F.least(cut, F.col("_n") - 1), F.lit(1))
    cut = F.when((cut < least) & (cut + 1 < F.col("_n")), cut + 1).when((F.col("_n") - cut < least) & (cut > 1), cut - 1).otherwise(cut)
    return rows.withColumn("_cut", cut).withColumn("side", (F.col("_i") > F.col("_cut")).cast("int")).drop("_run", "_all", "_n", "_i", "_cut")


def tag_speakers(text: Column, user: Column, assistant: Column) -> Column:
    """`name:` at a line's start or after white space becomes a new line `<User name>` or `<Assistant>`."""
    named = F.regexp_replace(text, F.concat(F.lit(r"(^|\s)\Q"), assistant, F.lit(r"\E:\s*")), F.lit("\n<Assistant>"))
    named = F.regexp_replace(named, F.concat(F.lit(r"(^|\s)\Q"), user, F.lit(r"\E:\s*")), F.concat(F.lit("\n<User "), user, F.lit(">")))
    return F.regexp_replace(named, r"^\n", "")


def split_speaker(messages: Column) -> Column:
    """Messages with exactly one ": " as `<speaker> content`."""
    ok = F.filter(messages, lambda m: F.size(F.split(m, ": ")) == 2)
    return F.transform(ok, lambda m: F.concat(F.lit("<"), F.split(m, ": ")[0], F.lit("> "), F.split(m, ": ")[1]))
