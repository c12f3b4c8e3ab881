"""Blocks of queries meet shards by shuffle: their copies never pass through the driver."""

from pyspark.sql import functions as F

from passlake.llm import kdtree


def test_copies_of_blocks_are_not_broadcast(spark):
    blocks = spark.createDataFrame([(4, k, b"x") for k in range(3)], "dim int, block long, queries binary")
    rest = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))))
    trees = spark.createDataFrame([(4, k, b"y") for k in range(10)], "dim int, shard long, vectors binary")
    met = kdtree._meet(rest, trees)
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
    assert met.count() == 30
