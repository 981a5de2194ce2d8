from pyspark.sql import functions as F

from tidemark.operators import skew


def test_heavy_keys_miss_no_heavy_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), "id")).alias("k"))
    assert "hot" in skew.heavy_keys(df, "k", 0.01)
    assert skew.heavy_keys(df.limit(0), "k") == []
    assert skew.heavy_keys(df.select(F.lit(None).cast("string").alias("k")), "k") == []


def test_salted_aggregate_equals_plain(spark, rows):
    df = spark.range(5000).select(
        F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
        (F.col("id") % 400).alias("e"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("v"), F.lit(1).alias("_one"),
    )
    measures = {"n": ("count", "v"), "s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v"), "d": ("distinct", "e")}
    got = skew.salted_aggregate(df, "k", measures, ["e"])
    want = df.where("k IS NOT NULL").groupBy("k").agg(F.count("v").alias("n"), F.coalesce(F.sum("v").cast("double"), F.lit(0.0)).alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count_distinct("e").alias("d"))
    assert rows(got, "k", "n", "s", "lo", "hi", "d") == rows(want, "k", "n", "s", "lo", "hi", "d")
    assert skew.salted_aggregate(df.limit(0), "k", measures, ["e"]).count() == 0


def test_all_null_sum_is_zero(spark, rows):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, None)], "k string, e int, v double")
    assert rows(skew.salted_aggregate(df, "k", {"s": ("sum", "v")}, ["e"])) == [("a", 0.0)]


def test_salted_join_equals_plain(spark, rows):
    left = spark.range(2000).select("id", F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 30)).alias("k"))
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k3", 3), ("other", 4)], "k string, v int")
    for how in ("left", "inner"):
        assert rows(skew.salted_join(left, right, "k", ["id"], how), "id", "k", "v") == rows(left.join(right, "k", how), "id", "k", "v")
