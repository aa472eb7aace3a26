from tagloom.llm.common import join_groups, with_new, with_struct
from pyspark.sql import functions as F


def test_join_groups_keeps_every_row(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else None if i % 2 else f"k{i}") for i in range(6000)], "id long, k string")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    out = join_groups(rows, groups, ["k"], "n")
    assert out.count() == 6000
    assert out.filter("k is null").select("n").distinct().first()[0] == 1000
    assert out.filter("k = 'hot'").select("least").distinct().first()[0] == 1


def test_join_groups_of_nothing(spark):
    rows = spark.createDataFrame([], "id long, k string")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"))
    assert join_groups(rows, groups, ["k"], "n").count() == 0


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, N_WORDS string")
    assert with_new(df, {"n_words": F.lit(2)}).first().asDict() == {"doc_id": 1, "n_words": 2}
    assert with_struct(df, F.struct(F.lit(3).alias("n_words")), ["n_words"]).columns == ["doc_id", "n_words"]
