"""Structured Streaming jobs: ingest of new files, latest decision per key, flags of changed inputs.

Each reads what is there (availableNow) and keeps its checkpoint in `root`, so that a repeated call only sees new files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passlake.folders import shared_folder
from passlake.sources.feeds import write_project_tables
from passlake.sources.publish import Library

__all__ = ["file_stream", "latest_by_event_time", "replace_projects", "shared_folder", "stream_ingest", "stream_latest", "stream_stale"]


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream over a Parquet file or folder; its schema is that of the files now there."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")


def stream_ingest(rows: DataFrame, root: str, key: str) -> DataFrame:
    """Appends new rows to a table partitioned by key; returns the table."""
    spark = rows.sparkSession
    q = rows.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{root}/log").partitionBy(key).format("parquet").start(f"{root}/table")
    q.awaitTermination()
    return spark.read.parquet(f"{root}/table")


def stream_latest(rows: DataFrame, root: str, key: str, order: list[str], value: str) -> DataFrame:
    """The value of the latest row of each key. State holds one row for each key; each batch writes the keys that changed."""
    latest = rows.groupBy(key).agg(F.max_by(F.col(value), F.struct(*order)).alias(value))

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/changes/part={number}")

    q = latest.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{root}/log").foreachBatch(write).start()
    q.awaitTermination()
    changes = rows.sparkSession.read.parquet(f"{root}/changes")
    return changes.groupBy(key).agg(F.max_by(value, "batch").alias(value))


def stream_stale(rows: DataFrame, held: DataFrame, root: str, key: str, hash_column: str) -> DataFrame:
    """New inputs whose hash is not the held one: a stream joined with a table of one row for each key."""
    known = held.select(key, F.col(hash_column).alias("held"))
    flagged = rows.join(known, key).where(~F.col(hash_column).eqNullSafe(F.col("held")))
    q = flagged.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{root}/log").format("parquet").start(f"{root}/table")
    q.awaitTermination()
    return rows.sparkSession.read.schema(flagged.schema).parquet(f"{root}/table")


def latest_by_event_time(rows: DataFrame, root: str, key: str, time: str, event: str, value: str, delay: str, ties: list[str] = ()) -> DataFrame:
    """key, time, value of the latest event of each key, from a stream with repeated and late events.

    An event (unique `event`) counts once, however often it comes within `delay`, and one that is later than the watermark doesn't count: its state is gone. So
    state holds the events of the last `delay` only. Each batch is merged into the table that a `Library` publishes: one row for each key, not a log of
    changes. A batch that is run again after a failure finds its number in the pointer's note and changes nothing. Events of one time go by `ties`, then `event`.
    """
    spark, library = rows.sparkSession, Library(rows.sparkSession, f"{root}/library")
    columns = [key, time, *ties, event, value]
    once = rows.select(*columns).withWatermark(time, delay).dropDuplicatesWithinWatermark([event])
    order = F.struct(time, *ties, event)

    def merge(batch: DataFrame, number: int) -> None:
        now = library.pointer()
        if now and int(now[2]) >= number:
            return
        held = library.read("latest")
        every = batch.select(*columns) if held is None else held.unionByName(batch.select(*columns))
        best = every.groupBy(key).agg(F.max_by(F.struct(*[c for c in columns if c != key]), order).alias("x")).select(key, "x.*")
        library.publish({"latest": best}, keys={"latest": [key]}, note=str(number))

    q = once.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{root}/log").foreachBatch(merge).start()
    q.awaitTermination()
    found = library.read("latest")
    return (spark.createDataFrame([], once.schema) if found is None else found).select(key, time, value)


def replace_projects(rows: DataFrame, root: str, key: str, time: str) -> DataFrame:
    """A table partitioned by key, from a stream of whole deliveries: all rows of a key with its latest `time`.

    A batch replaces the partitions of its keys, unless a later delivery stands there, so late and repeated files change nothing.
    """
    spark, table = rows.sparkSession, f"{root}/table"
    schema = rows.schema

    def write(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy(key).agg(F.max(time).alias("newest"))
        at = spark._jvm.org.apache.hadoop.fs.Path(table)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            held = spark.read.schema(schema).parquet(table).groupBy(key).agg(F.max(time).alias("held"))
            newest = newest.join(held, key, "left").where("held is null or newest > held").drop("held")
        newest.write.mode("overwrite").parquet(f"{root}/newest/part={number}")  # the table is not read while it is written
        newest = spark.read.schema(newest.schema).parquet(f"{root}/newest/part={number}")
        chosen = batch.join(newest, key).where(F.col(time) == F.col("newest")).drop("newest").select(*schema.names)
        write_project_tables(chosen, table, key)

    q = rows.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{root}/log").foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(table)
