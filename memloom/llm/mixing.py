"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.llm._common import WORD, Stash, carried

MAX_COPIES = 3
WEIGHTS = (1, 2, 3)
#: Steps into which a source's random order is cut: only the documents of one step are ever sorted together.
STEPS = 1 << 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, *, source_col: str = "source", size_col: str = "size", weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, max_copies: int = MAX_COPIES) -> DataFrame:
    """One row per source: source_size, target.

    Sources in code-point order (null last) weigh `weights`, repeating, and share `share` of all words. A target stops
    at `max_copies` times its source's size; what is over is shared again by weight until none is above. The end of
    that filling is found at once: with sources sorted by cap over weight, those before some place are at their cap and
    the others get the same words per unit of weight. The windows run over one row per source, not over documents.
    """
    per = sizes.groupBy(source_col).agg(F.sum(size_col).alias("source_size"))
    by_name = Window.orderBy(F.col(source_col).asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_copies)
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col(source_col).asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    per = per.withColumns(
        {
            "capped": F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "open_weight": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
            "total": F.sum("source_size").over(whole) * F.lit(share),
        }
    )
    left = F.greatest(F.col("total") - F.col("capped"), F.lit(0.0))
    # the first place whose share is within its cap; everything before it is at its cap
    place = F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col(source_col).isNull().alias("n"), F.coalesce(F.col(source_col), F.lit("")).alias("s"))
    per = per.withColumns({"place": place, "fits": left * F.col("weight") / F.col("open_weight") <= F.col("cap"), "left": left})
    per = per.withColumn("first", F.min(F.when(F.col("fits"), F.struct("place", "left", "open_weight"))).over(whole))
    capped = F.col("first").isNull() | (F.col("place") < F.col("first.place"))
    target = F.when(capped, F.col("cap").cast("double")).otherwise(F.col("first.left") * F.col("weight") / F.col("first.open_weight"))
    return per.select(source_col, "source_size", target.alias("target"))


def _cut(rows: DataFrame, want: DataFrame, small: Callable[[DataFrame], DataFrame], steps: int) -> DataFrame:
    """(key, want, cut, before): the class in which each key's running sum of sizes reaches what it wants, and the sum before it.

    Where all rows together are no more than that, the cut lies beyond the last class. Running sums go over coarse
    classes first, so that no window holds more than the square root of all classes.
    """
    side = int(steps**0.5) or 1
    classes = rows.groupBy("key", "step").agg(F.sum("size").alias("words")).withColumn("coarse", F.floor(F.col("step") / side).cast("int"))
    so_far = lambda w: F.coalesce(F.sum("words").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    coarse = classes.groupBy("key", "coarse").agg(F.sum("words").alias("words")).withColumn("before_coarse", so_far(Window.partitionBy("key").orderBy("coarse"))).drop("words")
    classes = classes.join(coarse, ["key", "coarse"]).withColumn("before", F.col("before_coarse") + so_far(Window.partitionBy("key", "coarse").orderBy("step")))
    reached = F.when((F.col("before") < F.col("want")) & (F.col("want") < F.col("before") + F.col("words")), F.struct("step", "before"))
    per = classes.join(small(want), "key").groupBy("key", "want").agg(F.min(reached).alias("at"), F.sum("words").alias("all"))
    whole = F.col("all") <= F.col("want")
    # a sum that ends exactly at a class's end is reached by whole classes: the next one is cut, and gives nothing
    ends = classes.join(small(want), "key").where(F.col("before") + F.col("words") <= F.col("want")).groupBy("key").agg(F.max(F.struct("step", (F.col("before") + F.col("words")).alias("before"))).alias("end"))
    per = per.join(ends, "key", "left")
    cut = F.when(whole, F.lit(steps)).when(F.col("at").isNotNull(), F.col("at.step")).otherwise(F.coalesce(F.col("end.step") + 1, F.lit(0)))
    before = F.when(whole, F.col("all")).when(F.col("at").isNotNull(), F.col("at.before")).otherwise(F.coalesce(F.col("end.before"), F.lit(0)))
    return per.where("want > 0").select("key", "want", cut.cast("int").alias("cut"), before.alias("before"))


def _at_cut(rows: DataFrame, cut: DataFrame, small: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of the cut classes, in order, with extra: whether they still fit."""
    inside = rows.join(small(cut), "key").where(F.col("step") == F.col("cut"))
    order = Window.partitionBy("key").orderBy("quotient", "_id", "size", "_row").rowsBetween(Window.unboundedPreceding, 0)
    return inside.withColumn("extra", (F.col("before") + F.sum("size").over(order) <= F.col("want")).cast("long")).select(*_ROW, "extra")


def _lack(cut: DataFrame, inside: DataFrame, small: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, want): what is left of what each key wanted."""
    words = inside.groupBy("key").agg(F.sum(F.col("size") * F.col("extra")).alias("words"))
    return cut.join(small(words), "key", "left").select("key", (F.col("want") - F.col("before") - F.coalesce("words", F.lit(0))).alias("want"))


_ROW = ("key", "step", "quotient", "_id", "size", "_row")


def pareto_mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, max_copies: int = MAX_COPIES, seed: str = "mix", steps: int = STEPS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document row: id, size (words), source_size, target, copies, taken (= copies * size).

    A document of a source is expected `target / source_size` times. The whole part of that is allocated for certain to
    every document of the source; for the rest, inclusion odds rise with the square root of the document's size, so that
    long documents, of which a sample of few holds few, are likelier. Each document draws random odds u / (1 - u) and is
    ranked by them over its inclusion odds (a factor that all documents of a source share is left out, as it moves none
    past another); those with the smallest quotients are drawn once more, as many as fit into the source's target in
    words. Where the draw stops at a document that does not fit, it goes on among those that do, in the same order; what
    then is still lacking goes to one more document, the best fitting of those left. u comes from a digest of seed and
    id, so reruns agree.

    No source is ever sorted: quotients are cut into `steps` classes, whole classes are summed before any shuffle of
    rows, and only the one class in which the target falls is put in order. Null text: size 0, taken 0; null source: a
    source of its own, last; null id: the random number goes by the text; rows alike in quotient: by id, then size;
    repeated rows each count; a text of any length is one row; an empty table gives no rows; other columns are left out
    unless `carry` names them (one of the name of an output comes out with `_in` at its end), and then written once.
    """
    stash = Stash(docs.sparkSession)
    through = carried([id_col, *carry], ("size", "source_size", "target", "copies", "taken"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text "), F.md5(text)))
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    sized = docs.select(*[F.col(c).alias(k) for k, (c, _) in through.items()], F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), word_count(F.col(text_col)).alias("size"), u.alias("u"))
    sized = stash.keep(sized.withColumn("_row", F.monotonically_increasing_id()))
    targets = stash.keep(source_targets(sized, source_col="_source", size_col="size", weights=weights, share=share, max_copies=max_copies))
    key = F.coalesce(F.concat(F.lit("="), F.col("_source")), F.lit("null"))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.select(key.alias("key"), "source_size", "target", F.floor(expected).cast("long").alias("certain")).withColumn("rest", F.greatest(F.col("target") - F.col("certain") * F.col("source_size"), F.lit(0.0)))
    few = targets.count() <= 100_000  # rows of a fixed width: at most some MB
    small = F.broadcast if few else (lambda x: x)
    quotient = F.col("u") / (1 - F.col("u")) / F.sqrt(F.greatest(F.col("size"), F.lit(1)).cast("double"))
    step = F.least(F.floor(F.col("quotient") / (1 + F.col("quotient")) * steps), F.lit(steps - 1)).cast("int")
    sized = sized.withColumns({"key": key, "quotient": quotient}).withColumn("step", step)
    rows = sized.select(*_ROW)
    # the draw itself, then one among what still fits; each leaves at most the rows of one class per source to be told apart
    first = stash.keep(_cut(rows, targets.select("key", F.col("rest").alias("want")), small, steps))
    inside = stash.keep(_at_cut(rows, first, small))
    lack = stash.keep(_lack(first, inside, small))
    later = rows.join(small(first.select("key", "cut")), "key").where(F.col("step") > F.col("cut")).drop("cut")
    left = later.unionByName(inside.where("extra = 0").drop("extra")).join(small(lack), "key")
    fits = (F.col("size") > 0) & (F.col("size") <= F.col("want"))
    second = stash.keep(_cut(left.where(fits).drop("want"), lack, small, steps))
    inside_again = stash.keep(_at_cut(left.where(fits).drop("want"), second, small))
    lack_again = _lack(second, inside_again, small).withColumnRenamed("want", "lack")
    lack_again = stash.keep(lack.join(small(lack_again), "key", "left").select("key", F.coalesce("lack", "want").alias("lack")))
    over = left.join(small(second.select("key", "cut")), "key", "left").where(~fits | F.col("cut").isNull() | (F.col("step") > F.col("cut"))).select(*_ROW)
    over = over.unionByName(inside_again.where("extra = 0").drop("extra")).join(small(lack_again), "key").withColumn("off", F.abs(F.col("size") - F.col("lack"))).where(F.col("off") < F.col("lack"))
    last = over.groupBy("key").agg(F.min(F.struct("off", "quotient", "_id", "size", "_row")).alias("best")).select(F.col("best._row").alias("_row"), F.lit(1).cast("long").alias("extra"))
    told = stash.keep(inside.select("_row", "extra").unionByName(inside_again.select("_row", "extra")).unionByName(last).groupBy("_row").agg(F.max("extra").alias("told")))
    plan = targets.join(small(first.select("key", F.col("cut").alias("cut_1"))), "key", "left").join(small(lack.select("key", F.col("want").alias("room"))), "key", "left").join(small(second.select("key", F.col("cut").alias("cut_2"))), "key", "left")
    out = sized.join(small(plan), "key", "left").join(F.broadcast(told) if told.count() <= 1_000_000 else told, "_row", "left")
    again = (F.col("step") >= F.col("cut_1")) & (F.col("size") > 0) & (F.col("size") <= F.col("room")) & (F.col("step") < F.col("cut_2"))
    drawn = F.coalesce((F.col("step") < F.col("cut_1")) | again, F.lit(False)).cast("long")
    copies = F.col("certain") + F.greatest(drawn, F.coalesce("told", F.lit(0)))
    return out.select(*[F.col(k).alias(n) for k, (_, n) in through.items()], "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
