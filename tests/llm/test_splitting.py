import pytest
from pyspark.sql import functions as F

from tokensift.llm.shipping import ship
from tokensift.llm.splitting import split_join, spread


@pytest.mark.parametrize("ways", [1, 8, 1000])
def test_split_join(spark, ways):
    rows = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.col("id").cast("string")).alias("key"), F.lit(1).alias("n"))
    states = rows.where("key IS NOT NULL AND id % 10 <> 1").groupBy("key").agg(F.count("*").alias("weight"), F.min("id").alias("least"))
    got = split_join(rows, states, ["key"], "weight", ways)
    want = rows.join(states, "key")
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert split_join(rows.limit(0), states, ["key"], "weight").count() == split_join(rows, states.limit(0), ["key"], "weight").count() == 0


def test_spread(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/logs.parquet").select("row_id")
    assert df.rdd.getNumPartitions() == 1 and spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = df.repartition(9)
    assert spread(wide) is wide and spread(df).count() == df.count()


def test_shipping_twice(spark):
    ship(spark)
    ship(spark)
    assert spark.range(1).mapInPandas(lambda it: ((__import__("tokensift.errors"), p)[1] for p in it), "id long").count() == 1
