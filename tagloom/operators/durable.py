"""Tables that cut lineage: in the folder the cluster names in spark.checkpoint.dir, or, where the master is local, a temporary one."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def place(df: DataFrame) -> str:
    """A new folder that driver and executors share."""
    sc = df.sparkSession.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tagloom-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/rounds/{uuid.uuid4().hex}"


def _write(df: DataFrame, path: str) -> None:
    """Write df as Parquet. Its shuffle files go as soon as it is written, not when the driver next collects garbage."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = conf.get(key, "false")
    conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(key, was)


def cut(df: DataFrame) -> DataFrame:
    """df written as Parquet to shared storage and read again."""
    path = place(df)
    _write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """A table that grows by a folder a round, so that what was there is never written again; `round` numbers the folders."""

    def __init__(self, first: DataFrame):
        self.path, self.schema, self.spark, self.last = place(first), first.schema, first.sparkSession, -1
        self.add(first)

    def add(self, new: DataFrame) -> DataFrame:
        """Write the next round's rows; returns them."""
        self.last += 1
        here = f"{self.path}/round={self.last}"
        _write(new.select(*self.schema.names), here)
        return self.spark.read.schema(self.schema).parquet(here)

    def all(self) -> DataFrame:
        """The rows of all rounds, with round (int)."""
        return self.spark.read.schema(self.schema).option("basePath", self.path).parquet(self.path)
