"""The join that deals hot keys to slices, against Spark's own join."""

from pyspark.sql import functions as F

from plumbscore.llm.skew import join_counted


def test_join_counted(spark):
    rows = [(0, i, "x") for i in range(900)] + [(1, i, None) for i in range(40)] + [(k, 0, "y") for k in range(2, 60)]
    rows += [(0, 5, "x"), (1, 5, None), (None, 1, "z"), (99, 1, "z")]
    left = spark.createDataFrame(rows, "k long, v long, clash string").repartition(3)
    right = left.where("k < 99").groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    for how in ("inner", "left"):
        wanted = sorted(map(str, left.join(right.drop("n"), "k", how).collect()))
        assert sorted(map(str, join_counted(left, right, ["k"], "n", how, least=10).collect())) == wanted
        assert sorted(map(str, join_counted(left, right, ["k"], "n", how).collect())) == wanted
    assert join_counted(left.limit(0), right.limit(0), ["k"], "n").count() == 0
