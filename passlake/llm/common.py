"""Shared helpers: tables cut from their lineage, gapless ranks, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows up to which a side of two or three numbers may be broadcast.
BROADCAST_ROWS = 10_000
#: Rows of two or three numbers (5 MB or so) up to which a list of row keys is broadcast to a scan of texts.
BROADCAST_KEYS = 200_000
#: Numbers in arrays beside such keys (4 MB) up to which they are broadcast too.
BROADCAST_NUMBERS = 1_000_000
#: Bytes of rows that go to a Python function at once while a table is saved.
BATCH_BYTES = 8 << 20
#: Rows that a Python function turns into Python objects at once.
SLICE_ROWS = 500


class Workspace:
    """A folder of intermediate tables below spark.checkpoint.dir, which all executors share.

    A saved table is read back from its files, so that a lost executor costs no recomputation
    and values such as row ids stay fixed. A folder of its own is made only where the setting
    is absent and the session has one machine, as in tests.
    """

    def __init__(self, spark: SparkSession, name: str):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            root = tempfile.mkdtemp(prefix="passlake-")
            spark.conf.set("spark.checkpoint.dir", root)
        self.spark, self.path, self.n = spark, f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}", 0
        self.saved: list[tuple[str, str]] = []

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n:03d}-{name}"
        with arrow_bytes(self.spark):
            df.write.parquet(path)
        self.saved.append((name, path))
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *keep: str) -> None:
        """Deletes the tables saved so far but those named. Only for tables that nothing still to be computed reads."""
        for name, path in [x for x in self.saved if x[0] not in keep]:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
            self.saved.remove((name, path))


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def arrow_rows(spark: SparkSession, rows: int):
    """Within it, Python functions get so many rows at once: for jobs on rows of many kilobytes each."""
    return _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def arrow_bytes(spark: SparkSession, size: int = BATCH_BYTES):
    """Within it, Python functions get a batch as soon as it has so many bytes, however long its rows are."""
    return _setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def arrow_map(found: Callable[[dict[str, list]], dict[str, list]], read: list[str], schema: pa.Schema):
    """A function for mapInArrow that makes `schema` rows of slices of each batch.

    found gets the columns `read` as Python lists, of SLICE_ROWS rows at most, and returns lists of new
    columns; columns of the schema that it does not return are passed on as they are, so numbers beside nulls stay whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                new = found({c: part.column(c).to_pylist() for c in read})
                out = [pa.array(new[f.name], f.type) if f.name in new else part.column(f.name).cast(f.type) for f in schema]
                yield pa.RecordBatch.from_arrays(out, schema=schema)

    return run


def with_uid(df: DataFrame) -> DataFrame:
    """A number for each row. Only for tables that are saved before the number is used."""
    return df.withColumn("uid", F.monotonically_increasing_id())


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it was counted to have few rows; else Spark joins by shuffle."""
    return F.broadcast(df) if rows <= limit else df


def gapless_rank(
    spark: SparkSession, df: DataFrame, keys: list[str], spread: Column, order: list[Column], name: str = "rank"
) -> DataFrame:
    """Number the rows of each key from 0 without gaps and without one task for a key.

    The rows of a key are dealt over about sqrt(count) buckets by the hash `spread`; buckets
    get their start from a running sum over bucket counts, and rows their place in the bucket.
    Both windows then see about sqrt(count) rows. df must be a saved table, without nulls in its keys.
    """
    total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    n_keys = total.count()
    dealt = df.join(small(total, n_keys), keys).withColumn(
        "__b", F.pmod(spread, F.greatest(F.lit(1), F.ceil(F.sqrt("__n"))).cast("long"))
    )
    counts = dealt.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__c"))
    starts = counts.withColumn(
        "__start",
        F.sum("__c").over(Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)),
    ).select(*keys, "__b", F.coalesce("__start", F.lit(0)).alias("__start"))
    place = F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(*order)) - 1
    ranked = dealt.withColumn("__place", place)
    out = ranked.join(starts, [*keys, "__b"])
    return out.withColumn(name, (F.col("__start") + F.col("__place")).cast("long")).drop(
        "__n", "__b", "__start", "__place"
    )


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null meets null; keeps left's key columns."""
    right = right.select(*[F.col(k).alias(f"__r_{k}") if k in keys else F.col(k) for k in right.columns])
    cond = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return left.join(right, cond, how).drop(*[f"__r_{k}" for k in keys])
