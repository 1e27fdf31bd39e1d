"""Stages of the pipeline on rows made for them."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rng = random.Random(4)
    sound = {"aa": "abcdefg", "bb": "hijklmn"}

    def prose(lang, n):
        return " ".join("".join(rng.choice(sound[lang]) for _ in range(rng.randint(2, 6))) for _ in range(n))

    rows = [(k, prose("aa" if k % 3 else "bb", 80), "aa" if k % 3 else "bb", f"s{k % 4}") for k in range(80)]
    rows += [(200, rows[5][1], "aa", "s1"), (201, rows[7][1] + " bac", "aa", "s2"), (300, "12345 ... 678", "aa", "s1"), (301, None, "aa", None), (302, "", None, "s0")]
    rows += [(400, f"{prose('aa', 30)} quick question about many sheep over there on green hills {prose('aa', 30)}", "aa", "s3")]
    rows += [(500, f"{prose('aa', 60)} mail abc.d@efg.ab now {prose('aa', 9)}", "aa", "s0")]
    spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "Quick question: about many sheep, over there on green hills!")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.collect()}
    assert [n for n, _ in P.STAGES] == ["language_id", "near_dedup", "decontamination", "personal_data", "mixing"]
    found = {}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.schema == docs.schema
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        found[name] = docs
    every = set(range(80)) | {200, 201, 400, 500}
    assert ids(found["language_id"]) == every
    groups = brute.near([(r.doc_id, r.text) for r in found["language_id"].collect()])
    assert ids(found["near_dedup"]) == {i for i in every if groups[i][2]} == every - {200, 201}
    assert ids(found["decontamination"]) == every - {200, 201, 400}
    masked = found["personal_data"].where("doc_id = 500").first()
    assert " mail <EMAIL> now " in masked.text and masked.n_chars == len(masked.text)
    assert ids(found["personal_data"]) == ids(found["decontamination"])
    mixed = P.STAGES[-1][1](spark, docs, folder)
    per = mixed.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copy").alias("m")).collect()
    assert all(r.n == r.m + 1 <= 3 for r in per)
    assert sorted(map(repr, P.run(spark, folder).collect())) == sorted(map(repr, mixed.collect()))


def test_columns_of_any_name_pass_through(spark, folder, tmp_path):
    clash = [*"id n key tag ranges size source_size target taken kept items spans base step u x copies copy score lang_pred n_words n_hit quotient bands more tokens _row _id _text _source _keep0 _doc0 _last meta.url a`b".split()]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs.withColumns({c: F.lit(f"own {c}") for c in clash}).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = P.run(spark, str(tmp_path))
    kept = [c for c in clash if c != "copy"]
    assert out.columns == [*docs.columns, *kept, "copy"] and out.where(" and ".join("`{}` = 'own {}'".format(c.replace("`", "``"), c) for c in kept)).count() == out.count() > 0
    assert sorted(map(repr, out.select(*docs.columns, "copy").collect())) == sorted(map(repr, P.run(spark, folder).collect()))


def test_the_mix_meets_its_targets_where_ids_repeat(spark, tmp_path):
    rows = [(k % 7 if k % 3 else None, "w " * (5 + k % 30), "aa", f"s{k % 3}", 1) for k in range(600)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    out = P.mix(spark, docs, str(tmp_path)).groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()
    size = {s: sum(len(r[1].split()) for r in rows if r[3] == s) for s in ("s0", "s1", "s2")}
    want = {s: min(3 * size[s], sum(size.values()) * w / 6) for s, w in zip(size, (1, 2, 3))}
    assert all(abs(r.n - want[r.source]) <= 40 for r in out)


def test_near_copies_down_to_four_fifths_go(spark, tmp_path):
    base = [f"w{k}" for k in range(104)]  # 100 runs of five words
    at = lambda *places: " ".join("other" + w if k in places else w for k, w in enumerate(base))
    rows = [(1, " ".join(base)), (2, at(20, 60)), (3, " ".join("z" + w for w in base)), (4, " ".join("z" + w for w in at(20, 40, 60).split()))]
    sets = [{tuple(t.split()[k : k + 5]) for k in range(100)} for _, t in rows]
    assert 0.8 <= len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.85 and len(sets[2] & sets[3]) / len(sets[2] | sets[3]) < 0.8
    docs = spark.createDataFrame([(i, t, "aa", "s", len(t)) for i, t in rows], SCHEMA)
    groups = brute.near(rows, 80)
    assert sorted(r.doc_id for r in P.near_duplicates(spark, docs, str(tmp_path)).collect()) == [i for i, _ in rows if groups[i][2]] == [1, 3, 4]


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
