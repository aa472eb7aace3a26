from pyspark.sql import functions as F

from tagloom.operators import events as E
from tagloom.streaming import watch

SF = "/root/testdata/sf0.001"


def replay(spark, tmp_path, parts=3):
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.repartitionByRange(parts, "ts").sortWithinPartitions("ts").write.mode("overwrite").parquet(f"{tmp_path}/in")
    return watch.source(spark, f"{tmp_path}/in", per_trigger=100, watermark="3650 days")


def run(stream, tmp_path, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/cp-{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_stateful_as_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    s = replay(spark, tmp_path)
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("t", E.seconds("ts"))
    got = {r.user_id for r in run(watch.chatter(s), tmp_path, "chatter").collect()}
    assert got == {r.user_id for r in E.chatter(e, "user_id", "t", "event_id").collect()}
    got = {r.user_id: r["sample"] for r in run(watch.drift(s), tmp_path, "drift").collect()}
    want = {r.user_id: r.i for r in E.drift_warnings(e, "user_id", "t", "value", "event_id").collect()}
    assert got == want


def test_windows_as_batch(spark, tmp_path):
    s = replay(spark, tmp_path)
    e = spark.read.parquet(f"{SF}/events.parquet")
    got = {(r.event_type, r.start.timestamp(), r.n) for r in run(watch.floods(s, 5, "12 hours", "6 hours"), tmp_path, "floods", "complete").collect()}
    assert {(a, int(b), n) for a, b, n in got} == {tuple(r) for r in E.sliding_flood(e, "event_type", "ts", "12 hours", "6 hours", 5).collect()}
    c = run(watch.clusters(s), tmp_path, "clusters", "complete").groupBy("user_id").agg(F.count("*").alias("n")).collect()
    batch = E.arrival_clusters(e.withColumn("t", E.seconds("ts")), "user_id", "t", 3600.0, "event_id").groupBy("user_id").agg(F.countDistinct("cluster").alias("n")).collect()
    assert sorted(map(tuple, c)) == sorted(map(tuple, batch))


def test_queries_keep_nothing_on_the_driver(spark):
    from tagloom.plans import ml_queries

    for query in (ml_queries.stream_sessions, ml_queries.stream_floods):
        before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
        files = query(spark, SF).inputFiles()
        assert files and all("/told/" in f for f in files)
        assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_rows_told_in_several_batches(spark, tmp_path):
    from tagloom.plans import ml_queries

    spark.range(0, 30, 1, 3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    assert sorted(r.id for r in ml_queries._run(stream).collect()) == list(range(30))
    assert ml_queries._run(stream.groupBy().count(), "complete").first()["count"] == 30
