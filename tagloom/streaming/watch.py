"""Streaming forms of the event operators. Event time needs TIMESTAMP, so NTZ input is cast by `source`.

Late data: rows older than the watermark are dropped by the windowed forms; the keyed forms count every row they get, and an
event that is told once per key is never told again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tagloom.operators.resolve import parse_point

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def source(spark: SparkSession, path: str, per_trigger: int = 1, watermark: str = "1 hour") -> DataFrame:
    """A Parquet folder as a stream of events with an event-time watermark."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def clusters(stream: DataFrame, gap: str = "1 hour") -> DataFrame:
    """Arrival clusters of each user as session windows; an equal gap stays together."""
    return stream.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def floods(stream: DataFrame, n: int = 10, window: str = "10 minutes", slide: str = "5 minutes") -> DataFrame:
    """Windows with at least n events of a type."""
    return stream.groupBy("event_type", F.window("ts", window, slide).alias("w")).agg(F.count("*").alias("n")).filter(F.col("n") >= n).select("event_type", F.col("w.start").alias("start"), "n")


def enriched(stream: DataFrame, register: DataFrame, raw: str) -> DataFrame:
    """A stream of point names joined with a static register (system, type_code, number, leg, tag); unknown ones stay, with null."""
    p = stream.withColumn("_p", parse_point(F.col(raw)))
    p = p.select("*", *[F.col(f"_p.{c}").alias(c) for c in ("system", "type_code", "number", "leg", "alarm_level")]).drop("_p")
    return p.join(register, ["system", "type_code", "number", "leg"], "left")


class _Chatter(StatefulProcessor):
    """Counts a key's activations and tells the n-th, once."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:  # noqa: N802
        seen = self.count.get()[0] if self.count.exists() else 0
        before = seen
        seen += sum(len(pdf) for pdf in rows)
        self.count.update((seen,))
        if before < self.n <= seen:
            yield pd.DataFrame({"user_id": [key[0]], "n": [self.n]})

    def close(self) -> None:
        pass


class _Drift(StatefulProcessor):
    """Warns once when a key has four samples and the last is off the centre."""

    def __init__(self, centre: float, dead: float):
        self.centre, self.dead = centre, dead

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "n long, told boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:  # noqa: N802
        n, told = self.state.get() if self.state.exists() else (0, False)
        every = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        for value in every["value"]:
            n += 1
            if not told and n >= 4 and abs(value - self.centre) >= self.dead:
                told = True
                yield pd.DataFrame({"user_id": [key[0]], "sample": [n], "value": [float(value)]})
        self.state.update((n, told))

    def close(self) -> None:
        pass


def chatter(stream: DataFrame, n: int = 3) -> DataFrame:
    """user_id, n: told at the n-th activation. Needs the RocksDB state store."""
    return stream.groupBy("user_id").transformWithStateInPandas(_Chatter(n), "user_id long, n long", "append", "none")


def drift(stream: DataFrame, centre: float = 50.0, dead: float = 6.0) -> DataFrame:
    """user_id, sample, value: the first sample that drifts, among those in the order they come."""
    return stream.groupBy("user_id").transformWithStateInPandas(_Drift(centre, dead), "user_id long, sample long, value double", "append", "none")
