"""Readers and writers of instances, agent results, rollouts and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.sources.tables import Tables

QAS = "array<struct<question:string,answer:string>>"
CHUNKS = "array<string>"


def read_instances(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet files of instances, with `chunks` and `questions_and_answers` from JSON; `broken` marks rows whose JSON cannot be read (their lists are null)."""
    raw = spark.read.option("mergeSchema", "true").parquet(*paths)
    parsed = raw.withColumns({"_c": F.from_json("chunks", CHUNKS), "_q": F.from_json("questions_and_answers", QAS)})
    broken = (F.col("chunks").isNotNull() & F.col("_c").isNull()) | (F.col("questions_and_answers").isNotNull() & F.col("_q").isNull())
    return parsed.withColumn("broken", broken).withColumns({"chunks": F.col("_c"), "questions_and_answers": F.col("_q")}).drop("_c", "_q")


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, value): the text between closing braces. Spark splits a file at them as it would at line ends, so one large file is many tasks' work."""
    raw = spark.read.option("lineSep", "}").text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def _depth(value: Column) -> Column:
    """Brackets opened less closed in a stretch that starts outside of strings."""
    bare = F.regexp_replace(value, r'"[^"]*("|$)', "")
    return F.length(F.regexp_replace(bare, r"[^\[{]", "")) - F.length(F.regexp_replace(bare, r"[^\]]", ""))


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, text) of whole-file JSON: what stands between the ends of objects one level below the top, with its separators, in order.

    A stretch of a file does not know whether it starts inside a string, nor how deep. So each stretch is summed for
    both cases; the sums of a block of the file are put together, then those of blocks; then every stretch knows its
    depth, and records end where a closing brace leaves depth one. No task reads a file, only blocks of it. Several
    JSON texts in a file, one after the other, are read like one.
    """
    tables = Tables(spark)
    plain = F.regexp_replace("value", r"(?s)\\.", "")  # an escaped quote is no end
    quotes = F.length(F.regexp_replace(plain, r'[^"]', "")) % 2
    # what the closing brace behind the stretch does, if it stands outside of strings, is added for each case
    outside = _depth(plain) - F.when(quotes == 0, 1).otherwise(0)
    inside = _depth(F.regexp_replace(plain, r'^[^"]*("|$)', "")) - F.when(quotes == 1, 1).otherwise(0)
    inner = Window.partitionBy("file", "block").orderBy("at")
    before, upto = inner.rowsBetween(Window.unboundedPreceding, -1), inner.rowsBetween(Window.unboundedPreceding, 0)
    rows = _fragments(spark, path).withColumns({"q": quotes, "outside": outside, "inside": inside})
    rows = rows.withColumn("odd", F.coalesce(F.sum("q").over(before), F.lit(0)) % 2)
    # depth after a stretch, if its block starts outside (0) or inside (1) of a string
    both = {f"d{h}": F.sum(F.when((F.col("odd") + h) % 2 == 0, F.col("outside")).otherwise(F.col("inside"))).over(upto) for h in (0, 1)}
    rows = tables.keep(rows.withColumns(both))
    last = rows.groupBy("file", "block").agg((F.sum("q") % 2).alias("q"), F.max_by("d0", "at").alias("d0"), F.max_by("d1", "at").alias("d1"))
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # blocks of a file: its size over the split size
    starts = last.withColumn("h", F.coalesce(F.sum("q").over(ahead), F.lit(0)) % 2)
    starts = starts.withColumn("depth", F.coalesce(F.sum(F.when(F.col("h") == 0, F.col("d0")).otherwise(F.col("d1"))).over(ahead), F.lit(0))).select("file", "block", "h", "depth")
    known = rows.join(starts, ["file", "block"])
    after = F.col("depth") + F.when(F.col("h") == 0, F.col("d0")).otherwise(F.col("d1"))
    closes = (F.col("odd") + F.col("h") + F.col("q")) % 2 == 0
    known = tables.keep(known.select("file", "block", "at", "value", ((after == 1) & closes).cast("long").alias("end")))
    ends = known.groupBy("file", "block").agg(F.sum("end").alias("n"))
    ends = ends.select("file", "block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("first"))
    numbered = known.join(ends, ["file", "block"]).withColumn("record", F.col("first") + F.coalesce(F.sum("end").over(before), F.lit(0)))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "value"))), lambda x: x["value"])
    return numbered.groupBy("file", "record").agg(F.concat(F.array_join(parts, "}"), F.lit("}")).alias("text"))


def read_nested_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON lists of records: a row each, however large a file is. `schema` is a DDL string; a record that cannot be read is a row of nulls."""
    body = F.regexp_replace("text", r"^[\s,\[\]]*", "")
    found = json_records(spark, path).withColumn("text", body).where(F.startswith("text", F.lit("{")))
    return found.select(F.from_json("text", schema).alias("r")).select("r.*")


def read_keyed_json(spark: SparkSession, path: str, value: str) -> DataFrame:
    """Whole-file JSON objects keyed by id: (id, value) rows, however large a file is. `value` is the type of the values, as a DDL string."""
    body = F.concat(F.lit("{"), F.regexp_replace("text", r"^[\s,\[\]{}]*", ""), F.lit("}"))
    found = json_records(spark, path).withColumn("text", body)
    return found.select(F.explode(F.from_json("text", f"map<string,{value}>")).alias("id", "value"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object per line; a broken line stays as a row with its text in `_corrupt`."""
    record = F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return spark.read.text(path).where(F.trim("value") != "").select(record.alias("r")).select("r.*")


def _directory() -> Column:
    return F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")


def read_agent_results(spark: SparkSession, base: str, *, info: str, result: str, state: str) -> DataFrame:
    """Result directories under `base`: those with both data_instance_info.json and results.json, with agent_state.json where there is one. The DDL strings give the records' fields; `directory` is the key."""

    def files(name: str, schema: str) -> DataFrame:
        read = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", name).option("multiLine", "true").json(base)
        return read.select(_directory().alias("directory"), "*")

    states = files("agent_state.json", state)
    states = states.select("directory", F.struct(*[c for c in states.columns if c != "directory"]).alias("state"))
    return files("data_instance_info.json", info).join(files("results.json", result), "directory").join(states, "directory", "left")


def write_instances(df: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """Lists as JSON strings, with their sizes, as Parquet."""
    out = df.withColumns({"num_chunks": F.size("chunks"), "num_questions": F.size("questions_and_answers")})
    out = out.withColumns({"chunks": F.to_json("chunks"), "questions_and_answers": F.to_json("questions_and_answers")})
    out.write.mode(mode).parquet(path)


def write_rollouts_jsonl(df: DataFrame, path: str, *, step: str = "step", mode: str = "append") -> None:
    """A JSON line per sample, a folder per step."""
    df.write.mode(mode).partitionBy(step).json(path)


def write_metrics(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """A metrics table (a row per source or agent) as one JSON file."""
    df.coalesce(1).write.mode(mode).json(path)
