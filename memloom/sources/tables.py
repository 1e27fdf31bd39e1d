"""Tables written between jobs, in the folder that driver and executors share, to cut lineage and to fix what a plan reads twice."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, kind: str) -> str:
    """A new folder under the session's shared one; a temporary one only in a local session that names none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="memloom-")
    return f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


class Tables:
    """Tables of one call. As a context it drops them if the call fails; one that a later step no longer reads goes by drop()."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths = spark, shared_dir(spark, "tables"), {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.paths)}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(kept)] = (path, kept)
        return kept

    def drop(self, *kept: DataFrame) -> None:
        for df in kept:
            path = self.paths.pop(id(df), (None,))[0]
            if path:
                self._delete(path)

    def _delete(self, path: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, kind: type | None, *_: object) -> None:
        if kind is not None:
            self._delete(self.root)
