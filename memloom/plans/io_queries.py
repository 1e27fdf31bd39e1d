"""Round trips through files, and streams over files, in the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.plans.memory_queries import LIMIT, STREAMED, ops
from memloom.plans.registry import query, table
from memloom.plans.scoring_queries import SCORED, results
from memloom.sources import io
from memloom.sources.tables import shared_dir
from memloom.streaming import memory_stream


#: Operations that a file of an arrival holds, about.
FILE_OPS = 500_000


def shared(spark: SparkSession) -> str:
    return shared_dir(spark, "io")


def instances(spark, d) -> DataFrame:
    turns = table(spark, d, "conversations")
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("turn", c.alias("v")))), lambda x: x["v"])
    qa = F.struct(F.col("role").alias("question"), F.col("turn").cast("string").alias("answer"))
    return turns.groupBy(F.col("conv_id").alias("instance_id")).agg(in_order(F.col("text")).alias("chunks"), in_order(qa).alias("questions_and_answers"))


@query("SELECT conv_id AS instance_id, string_agg(text, '|' ORDER BY turn) AS chunks, string_agg(role || '=' || turn, '|' ORDER BY turn) AS qas, count(*)::INT AS num_chunks, false AS broken FROM conversations GROUP BY conv_id")
def a1_a5_instances_round_trip(spark, d):
    path = shared(spark)
    io.write_instances(instances(spark, d), path)
    qas = F.array_join(F.transform("questions_and_answers", lambda q: F.concat_ws("=", q["question"], q["answer"])), "|")
    return io.read_instances(spark, path).select("instance_id", F.array_join("chunks", "|").alias("chunks"), qas.alias("qas"), "num_chunks", "broken")


def _written_json(spark, d, one: str) -> str:
    """Documents as JSON texts of a hundred records each, several a file; `one` makes the text of a group's records in the column r."""
    path = shared(spark)
    record = F.struct("doc_id", "source", "n_chars", F.concat(F.lit('a "}{[" \\ '), "lang").alias("odd"))
    group = F.floor(F.col("doc_id") / 100)
    table(spark, d, "documents").select(group.alias("g"), record.alias("r")).groupBy("g").agg(F.expr(one).alias("value")).select("value").write.text(path)
    return path


@query("SELECT source AS id, count(*) AS n, sum(n_chars)::BIGINT AS chars, min('a \"}{[\" \\ ' || lang) AS odd FROM documents GROUP BY source")
def a2_read_nested_json(spark, d):
    rows = io.read_nested_json(spark, _written_json(spark, d, "to_json(collect_list(r))"), "doc_id long, source string, n_chars long, odd string")
    return rows.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.min("odd").alias("odd"))


@query("SELECT doc_id::VARCHAR AS id, source, n_chars FROM documents")
def a2_read_keyed_json(spark, d):
    path = _written_json(spark, d, "to_json(map_from_entries(collect_list(struct(r.doc_id, r))))")
    return io.read_keyed_json(spark, path, "struct<source:string,n_chars:bigint>").select("id", "value.source", "value.n_chars")


@query("SELECT count(*) FILTER (doc_id % 7 <> 0) AS good, count(*) FILTER (doc_id % 7 = 0) AS broken FROM documents")
def a3_read_jsonl(spark, d):
    path = shared(spark)
    line = F.when(F.col("doc_id") % 7 == 0, '{"doc_id": 1, "lang"').otherwise(F.to_json(F.struct("doc_id", "lang")))
    table(spark, d, "documents").select(line.alias("value")).write.text(path)
    rows = io.read_jsonl(spark, path, "doc_id long, lang string")
    return rows.groupBy().agg(F.count(F.when(F.col("_corrupt").isNull(), 1)).alias("good"), F.count("_corrupt").alias("broken"))


@query("SELECT source, count(*) AS n, avg(n_chars) AS score, CASE WHEN source <> 'src3' THEN 'core ' || source END AS core FROM documents WHERE source NOT IN ('src4') GROUP BY source")
def a4_read_agent_results(spark, d):
    path = shared(spark)
    docs = table(spark, d, "documents").withColumn("dir", F.col("source"))
    fs = spark._jvm.org.apache.hadoop.fs
    texts = lambda rows, one: rows.groupBy("dir").agg(F.to_json(one).alias("value"))
    layout = {
        "data_instance_info.json": texts(docs, F.struct(F.first("source").alias("source"))),
        "results.json": texts(docs.where("source <> 'src4'"), F.collect_list(F.struct("doc_id", "n_chars"))),
        "agent_state.json": texts(docs.where("source <> 'src3'"), F.struct(F.concat(F.lit("core "), F.first("source")).alias("core"))),
    }
    for name, rows in layout.items():
        rows.repartition("dir").write.partitionBy("dir").text(f"{path}/raw/{name}")
        root = fs.Path(f"{path}/raw/{name}")
        on = root.getFileSystem(spark._jsc.hadoopConfiguration())
        for sub in on.listStatus(root):  # one folder an agent, as agents leave them
            if sub.isDirectory():
                target = fs.Path(f"{path}/agents/{sub.getPath().getName()}")
                on.mkdirs(target)
                for k, part in enumerate(f for f in on.listStatus(sub.getPath()) if f.getPath().getName().startswith("part-")):
                    on.rename(part.getPath(), fs.Path(f"{target}/{name}" if not k else f"{target}/{k}-{name}"))
    out = io.read_agent_results(spark, f"{path}/agents", info="source string", result="doc_id long, n_chars long", state="core string")
    return out.groupBy("source").agg(F.first("state.core").alias("core"), F.sum(F.lit(1)).alias("n"), F.avg("n_chars").alias("score"))


@query("SELECT step, count(*) AS n, sum(score)::BIGINT AS score FROM (SELECT user_id % 5 AS step, event_id AS score FROM events) GROUP BY step")
def a6_write_rollouts_jsonl(spark, d):
    path = shared(spark)
    rows = table(spark, d, "events").select((F.col("user_id") % 5).alias("step"), F.col("event_type").alias("input"), F.col("props").alias("output"), F.col("event_id").alias("score"))
    io.write_rollouts_jsonl(rows, path)
    back = spark.read.schema("step long, input string, output string, score long").json(path)
    return back.groupBy("step").agg(F.count("*").alias("n"), F.sum("score").alias("score"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def a7_write_metrics(spark, d):
    path = shared(spark)
    io.write_metrics(table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")), path)
    return spark.read.schema("source string, n long").json(path)


def streamed(spark: SparkSession, arrivals: list[DataFrame], make, mode: str, files: int = 4) -> DataFrame:
    """The table a stream leaves that reads the arrivals, one after the other, as files, a few at a time, until all are read."""
    path = shared(spark)
    for rows in arrivals:  # written in turn, so that the stream takes them in turn
        rows.write.mode("append").parquet(f"{path}/in")
    source = spark.readStream.schema(arrivals[0].schema).option("maxFilesPerTrigger", files).parquet(f"{path}/in")
    made = make(source)
    if mode == "append":
        q = made.writeStream.format("parquet").option("checkpointLocation", f"{path}/at").trigger(availableNow=True).start(f"{path}/out")
    else:
        write = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{path}/out")
        q = made.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/at").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{path}/out")


@query(STREAMED)
def k1_stream_memory_state(spark, d):
    log = ops(spark, d)
    # an instance's operations of some days stand in one file; a micro-batch is so many files, which the session's partitions must not make many
    files = log.count() // (4 * FILE_OPS) + 1
    arrivals = [log.where(F.floor(F.col("chunk_idx") / 8) == k).repartition("user_id").coalesce(files) for k in range(4)]
    spark.conf.set(*memory_stream.STATE_STORE)
    return streamed(spark, arrivals, lambda s: memory_stream.stream_memory_state(s, instance="user_id", core_limit=LIMIT), "append")


@query(f"SELECT data_source, count(*) AS n, round(avg(score), 6) AS score FROM ({SCORED}) GROUP BY data_source")
def k2_stream_scores(spark, d):
    rows = results(spark, d).select(F.col("doc_id").cast("string").alias("question"), "data_source", "pred", "gold", "judge").withColumn("ts", F.lit("2024-01-01 05:00:00").cast("timestamp"))
    rows = rows.unionByName(rows.where("cast(question as int) % 2 = 0"))
    out = streamed(spark, [rows.repartition(6)], lambda s: memory_stream.stream_scores(s, time="ts"), "update")
    return out.groupBy("data_source").agg(F.max_by("n", "batch").alias("n"), F.round(F.max_by("score", "batch"), 6).alias("score"))
