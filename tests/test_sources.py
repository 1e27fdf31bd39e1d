"""Whole-file JSON read by blocks, and logs and labels scored from their own words."""

import json
import random

import pytest
from pyspark.sql import functions as F

from memloom.operators import curation, scoring
from memloom.sources import io


@pytest.mark.parametrize("block", ["128m", "97b", "1k"])
@pytest.mark.parametrize("indent", [None, 1])
def test_json_files_in_blocks(spark, tmp_path, block, indent):
    rng = random.Random(1)
    odd = ["", "}", '"', "\\", '\\"}', "[{", "a\nb", "é好"]
    rows = [{"a": k, "s": "".join(rng.choice(odd) for _ in range(rng.randint(0, 6))), "l": [{"x": rng.choice(odd)} for _ in range(rng.randint(0, 3))]} for k in range(60)]
    for n, part in enumerate((rows[:40], rows[40:], [])):
        (tmp_path / f"list{n}.json").write_text(json.dumps(part, indent=indent, ensure_ascii=False))
        (tmp_path / f"keyed{n}.json").write_text(json.dumps({f'k"{r["a"]}': r for r in part}, indent=indent))
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        got = io.read_nested_json(spark, f"{tmp_path}/list*.json", "a long, s string, l array<struct<x:string>>").collect()
        assert sorted((r.a, r.s, [x.x for x in r.l]) for r in got) == [(r["a"], r["s"], [x["x"] for x in r["l"]]) for r in rows]
        keyed = io.read_keyed_json(spark, f"{tmp_path}/keyed*.json", "struct<a:bigint,s:string>").collect()
        assert sorted((r.value.a, r.id, r.value.s) for r in keyed) == [(r["a"], f'k"{r["a"]}', r["s"]) for r in rows]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)


@pytest.mark.parametrize("slice_lines", [2, 3, 1000])
def test_cache_of_a_key_with_half_of_all_lines(spark, slice_lines):
    rng = random.Random(slice_lines)
    log = [(k, rng.random() < 0.6, "hot" if rng.random() < 0.5 else f"k{rng.randint(0, 5)}") for k in range(400)]
    held = {}
    for k, v, key in log:
        if key not in held:
            held[key] = (v, k)
        elif held[key][0] != v:
            del held[key]
    rows = [(k, f" {'✓' if v else '✗'} it...{key}") for k, v, key in log] + [(900, "no key"), (901, None), (902, "")]
    got = curation.build_answer_cache(spark.createDataFrame(rows, "k long, line string").repartition(4), order="k", text="line", slice_lines=slice_lines)
    assert {r.key: (r.value, r.place) for r in got.collect()} == held


def test_labels_by_their_nearest_known_name(spark):
    labels = spark.createDataFrame([("farming",), ("fishing",), ("trade",)], "name string")
    rows = [(1, '["Farming", "fishin", "trad", "trade"]', ["farming", "trade"]), (2, "no list", ["trade"]), (3, "[]", ["trade"]), (4, '["fishing"]', ["fishing", "fishing"]), (5, None, ["trade"]), (6, '["trade"]', [])]
    got = {r.k: r.f1 for r in scoring.label_f1(spark.createDataFrame(rows, "k long, said string, golds array<string>"), labels, key="k").collect()}
    # 1: two of four named, two of two golds; 4: one of one named, one of two golds (a repeated gold counts twice)
    assert got[1] == pytest.approx(2 * 0.5 * 1 / (1.5 + 1e-5)) and got[4] == pytest.approx(2 * 1 * 0.5 / (1.5 + 1e-5))
    assert [got[k] for k in (2, 3, 5, 6)] == [0.0] * 4


def test_recommendations_without_numbers_keep_their_rows(spark):
    names = spark.createDataFrame([("Heat",), ("Alien",), ("Up",)], "name string")
    rows = [(1, "I say:\n1. Alien (1979)\n2) - Heat", ["Heat", "Up"]), (2, "Alien, heat", ["Alien"]), (3, None, ["Up"]), (4, "1. Up", None), (5, "", ["Up", "Up"])]
    got = {r.k: (r.recall_1, r.recall_5) for r in scoring.recall_at_k(spark.createDataFrame(rows, "k long, answer string, golds array<string>"), names, key="k", ks=(1, 5)).collect()}
    assert got == {1: (0.0, 0.5), 2: (1.0, 1.0), 3: (0.0, 0.0), 4: (0.0, 0.0), 5: (1.0, 1.0)}  # "" is nearest to the shortest name


def test_levels_of_raw_accuracies(spark):
    rows = spark.createDataFrame([(1, 0.69), (2, 0.7), (3, 0.8), (4, 1.0), (5, 0.0), (6, None)], "k long, acc double")
    binned = curation.bin_accuracies(rows, accuracy="acc")
    assert {r.k: r.bin for r in binned.collect()} == {1: "0.6-0.7", 2: "0.7-0.8", 3: "0.8-0.9", 4: "0.9-1.0", 5: "0.0-0.1", 6: None}
    known = spark.createDataFrame([(1,), (2,), (3,), (6,), (9,)], "k long")
    assert {r.k: r.level for r in curation.levels_of(known, binned, key="k").collect()} == {1: "medium", 2: "medium", 3: "easy"}
