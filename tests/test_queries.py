"""Every registered query of the library against its SQL in DuckDB, and those without SQL for running at all."""

import duckdb
import pytest

import memloom.plans
from memloom.plans.registry import QUERIES, SQL

memloom.plans.load()
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return bool(value)
    if isinstance(value, (int, float)) or hasattr(value, "item"):
        return float(value)
    return str(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, duck, name):
    ours = QUERIES[name](spark, DATA)
    theirs = duck.sql(SQL[name])
    cols = sorted(ours.columns)
    assert cols == sorted(theirs.columns)
    at = {c: k for k, c in enumerate(theirs.columns)}
    a = sorted(([plain(r[c]) for c in cols] for r in ours.collect()), key=repr)
    b = sorted(([plain(r[at[c]]) for c in cols] for r in theirs.fetchall()), key=repr)
    assert a == b


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_evidence_of_all_sources(spark, tmp_path):
    docs = [(1, "see alpha beta", "src3"), (2, "alpha beta", "hot"), (3, "so alpha beta it is", None), (4, "alpha beta", None), (5, "gamma", "hot")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "alpha beta"), (8, "delta"), (9, "gamma")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    name = "c5_link_evidence_by_containment"
    ours = [(r.item_id, r.source, r.evidence_idx) for r in QUERIES[name](spark, str(tmp_path)).collect()]
    assert sorted(ours, key=repr) == sorted(con.sql(SQL[name]).fetchall(), key=repr)
    assert set(ours) == {(7, "src3", 1), (7, "hot", 2), (7, None, 4), (9, "hot", 5)}
