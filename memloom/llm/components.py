"""Connected components of a graph of links, as Spark jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm._common import Stash, keyed_join

#: Links that a task unites at once.
UNION_ROWS = 200_000


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links to fewer ones with the same components: union-find over bounded pieces of its rows."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    def out() -> pa.RecordBatch:
        pairs = [(x, find(x)) for x in parent]
        pairs = [(x, r) for x, r in pairs if x != r]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > UNION_ROWS:
            yield out()
            parent.clear()
    if parent:
        yield out()


def components(links: DataFrame, stash: Stash) -> DataFrame:
    """(id, component) of every id that a link (a, b) names; component is the least id that links reach.

    Each task first unites its own links by union-find. Then two steps alternate until nothing changes: every node
    hands its larger neighbours, then its smaller ones, to the least of them (large star, small star). Each is an
    aggregation with partial sums and a join, in which the many links of a hub stay where they are; each round is
    written to the shared folder, which cuts the lineage.
    """

    def least(rows: DataFrame) -> DataFrame:
        return rows.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("size"))

    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").mapInArrow(_united, "a long, b long").distinct()
    edges = stash.keep(edges)
    mark = None
    while True:
        n = 2 * edges.count()
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = stash.keep(keyed_join(both, least(both), "a", "size", n, stash).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")))
        small = keyed_join(large, least(large), "a", "size", n, stash).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()
        kept = stash.keep(small)
        stash.drop(edges, large)
        edges = kept
        now = tuple(edges.agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
