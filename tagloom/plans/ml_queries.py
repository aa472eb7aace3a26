"""Queries whose results SQL cannot state exactly: clusters, forests, streams (streams have a batch oracle)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.operators import ml
from tagloom.operators.durable import place
from tagloom.plans.shapes import plant_tags, read
from tagloom.streaming import watch


def document_clusters(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    features = ml.tfidf(docs, "text").transform(docs).select("doc_id", "features")
    model, _ = ml.choose_k(features)
    return model.transform(features).select("doc_id", F.col("prediction").alias("cluster"))


def object_forest(spark, d):
    t = plant_tags(spark, d).join(read(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_retailprice", "p_brand"), "id")
    t = t.withColumn("number_value", F.col("number").cast("double"))
    return ml.object_folds(t, ["size", "p_retailprice", "number_value"], "p_brand", "loop")


def _run(stream, mode="append"):
    """A stream over all that is there now, as a table; what it tells goes to the shared folder, never to the driver."""
    spark, path = stream.sparkSession, place(stream)
    conf = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(conf)
    # the other provider holds the whole state on the heap
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        keep = lambda batch, i: batch.write.mode("overwrite").parquet(f"{path}/told/batch={i}")
        q = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        last = max((p["batchId"] for p in q.recentProgress), default=None)
    finally:
        spark.conf.set(conf, before)
    if last is None:
        return spark.createDataFrame([], stream.schema)
    told = spark.read.schema(stream.schema)
    if mode == "complete":  # the last batch tells all
        return told.parquet(f"{path}/told/batch={last}")
    return told.option("basePath", f"{path}/told").parquet(f"{path}/told").drop("batch")


def _source(spark, d):
    raw = spark.readStream.schema(watch.EVENTS).option("pathGlobFilter", "events.parquet").parquet(d)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")


def stream_floods(spark, d):
    """Windows of twelve hours with at least five events of a type, from a stream."""
    got = _run(watch.floods(_source(spark, d), 5, "12 hours", "6 hours"), "complete")
    return got.select("event_type", F.unix_seconds("start").alias("start"), "n")


def stream_sessions(spark, d):
    got = _run(watch.clusters(_source(spark, d)), "complete")
    return got.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n_events"))


QUERIES = {f.__name__: f for f in (document_clusters, object_forest, stream_floods, stream_sessions)}
ORACLES: dict[str, str] = {}


def _same_as_batch() -> None:
    from tagloom.plans import event_queries

    ORACLES["stream_floods"] = event_queries.ORACLES["sliding_flood"]
    ORACLES["stream_sessions"] = event_queries.ORACLES["session_clusters"]


_same_as_batch()
