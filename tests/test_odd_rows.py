"""Queries against their SQL on rows that the given tables seldom have."""

import duckdb
import pytest

import memloom.plans
from memloom.plans.registry import QUERIES, SQL

memloom.plans.load()
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def agree(spark, path, name, tables):
    """Both engines' rows, which are the same."""
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/{table}.parquet")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet/*.parquet'")
    ours = QUERIES[name](spark, str(path))
    theirs = con.sql(SQL[name])
    at = [theirs.columns.index(c) for c in ours.columns]
    a = sorted(map(tuple, ours.collect()), key=repr)
    assert a == sorted((tuple(r[k] for k in at) for r in theirs.fetchall()), key=repr)
    return [dict(zip(ours.columns, r)) for r in a]


def documents(*texts, source="s"):
    return {"documents": ([(k, t, "en", source, len(t or "")) for k, t in enumerate(texts)], DOCUMENT)}


def test_numbers_that_follow_each_other(spark, tmp_path):
    got = agree(spark, tmp_path, "b11_newline_numbered", documents("56.187.2.1 is", "so. 7. 8. 9. x", "plain", None))
    assert got[0]["text"] == "Do.\n1. 56.187.2.1 is.\n22. end"


def test_parts_that_begin_with_their_place(spark, tmp_path):
    # the gold of every fourth row is its third to ninth word, of which the prediction has those from the fourth on
    rows = documents(*["w w no 196.3 2and 33 44 5 6 end"] * 61)
    got = agree(spark, tmp_path, "d4_keep_answerable", rows)
    assert {r["gold"] for r in got if r["doc_id"] in (4, 8, 28)} == {"196.3;2and;33;44;5;6"}


def test_articles_cut_at_a_new_line(spark, tmp_path):
    # with its title the first text of 700 words has its new line at the last place that is kept
    long = ("abc " * 900)[: 2800 - len("d0: ") - 1] + "\n" + "x " * 400
    got = agree(spark, tmp_path, "b4_pack_titled", documents(long, None))
    assert [(r["titles"], r["text"][-1]) for r in got] == [("d0", "\n")]


@pytest.mark.parametrize("name", ["b2_pack_greedy", "b3_chunk_sentences", "b3b_chunk_sentences_plain"])
def test_new_lines_at_the_ends_of_chunks(spark, tmp_path, name):
    agree(spark, tmp_path, name, documents("\nOne two. Three\n", "\n", " Four five six. Seven\n\n", "\tEight ", "Nine\n"))
