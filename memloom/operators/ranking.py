"""Places of rows in a whole table's order, by range partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.sources.tables import Tables


def global_rank(df: DataFrame, order: list[Column], *, name: str = "rank") -> DataFrame:
    """Adds `rank` 0..n-1 in the whole table's order, which should have no ties.

    Spark samples the order and deals rows to ranges of about equal size, each range is sorted where it lies, and a
    row's place is its place there after the rows of the ranges before: one count a partition is all that is put
    together. Rows are written once, so that places stay as they are.
    """
    with Tables(df.sparkSession) as tables:
        # the id that Spark gives is the partition's number, then the place in it
        rows = tables.keep(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
        counts = rows.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("n")).collect()
        before, total = [], 0
        for r in sorted(counts, key=lambda r: r["_part"]):
            before.append((r["_part"], total))
            total += r["n"]
        offsets = F.broadcast(df.sparkSession.createDataFrame(before, "_part long, _before long"))  # a row a partition
        place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
        return rows.withColumn("_part", F.shiftright("_at", 33)).join(offsets, "_part").withColumn(name, place).drop("_part", "_before", "_at")


def rank_within(df: DataFrame, keys: list[str], order: list[Column], *, name: str = "rank", size: str | None = None) -> DataFrame:
    """Adds `rank` 0..n-1 within each group of equal keys, however large: the place in the whole order after the group's first. `size` names a column for the rows of the group."""
    with Tables(df.sparkSession) as tables:
        ranked = tables.keep(global_rank(df, [*[F.col(k) for k in keys], *order], name="_place"))
        first = ranked.groupBy(*[F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)]).agg(F.min("_place").alias("_first"), F.count("*").alias("_size"))
        same = None
        for j, k in enumerate(keys):
            one = F.col(k).eqNullSafe(F.col(f"_k{j}"))
            same = one if same is None else same & one
        told = ranked.join(first, same).withColumn(name, F.col("_place") - F.col("_first"))
        if size:
            told = told.withColumn(size, F.col("_size"))
        return told.drop("_place", "_first", "_size", *[f"_k{j}" for j in range(len(keys))])
