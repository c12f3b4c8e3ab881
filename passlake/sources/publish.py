"""Versioned tables: a version is written beside the others, checked, and shown by a pointer that readers follow."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Versions behind the current one that stay readable for those who began with them.
KEPT = 2


class IntegrityError(ValueError):
    """A version that was written broke a rule; readers never see it."""


class Library:
    """Tables of one root folder, published together.

    versions/<name>/<table> holds a version's files, pointers/ one small row for each published version (n, name, note). The pointer is the
    last thing written, by the committer that renames a whole file into place; readers take the greatest n. So a job that fails, at whichever step, leaves the old
    version in force, and a repeated one begins with new folders. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def pointer(self) -> tuple[int, str, str] | None:
        """(n, name, note) of the current version."""
        if not self._exists(self._path("pointers")):
            return None
        rows = self.spark.read.schema("n long, name string, note string").parquet(self._path("pointers"))
        best = rows.agg(F.max_by(F.struct("n", "name", "note"), "n").alias("x")).first().x
        return tuple(best) if best else None

    def read(self, table: str) -> DataFrame | None:
        """A table of the current version; None before the first."""
        now = self.pointer()
        return None if now is None else self.spark.read.parquet(self._path("versions", now[1], table))

    def publish(self, tables: dict[str, DataFrame], references: list[tuple[str, str, str, str]] = (), keys: dict[str, list[str]] | None = None, note: str = "") -> int:
        """Writes the tables as a new version and shows it; returns its number.

        references: (table, column, other table, other column); a value that is not null must stand in the other table. keys: columns of a table that must be
        unique and not null. They are checked on what was written, by anti-joins and counts. A broken rule raises IntegrityError, and the version is deleted.
        """
        now = self.pointer()
        name = f"v{(now[0] if now else 0) + 1:06d}-{uuid.uuid4().hex[:8]}"
        for table, df in tables.items():
            df.write.parquet(self._path("versions", name, table))
        held = {t: self.spark.read.schema(df.schema).parquet(self._path("versions", name, t)) for t, df in tables.items()}
        broken = []
        for table, column, other, target in references:
            wanted = held[table].where(F.col(column).isNotNull()).groupBy(F.col(column).alias("k")).agg(F.count(F.lit(1)).alias("n"))
            lost = wanted.join(held[other].select(F.col(target).alias("k")).hint("merge"), "k", "left_anti")
            if n := lost.agg(F.sum("n")).first()[0]:
                broken.append(f"{table}.{column}: {n} rows without {other}.{target}")
        for table, columns in (keys or {}).items():
            null = held[table].where(" or ".join(f"`{c}` is null" for c in columns))
            twice = held[table].groupBy(*columns).count().where("count > 1")
            if n := null.count() + twice.count():
                broken.append(f"{table}: {n} keys of {', '.join(columns)} are null or stand twice")
        if broken:
            self._delete(name)
            raise IntegrityError("; ".join(broken))
        number = (now[0] if now else 0) + 1
        self.spark.createDataFrame([(number, name, note)], "n long, name string, note string").coalesce(1).write.mode("append").parquet(self._path("pointers"))
        self._forget(number - KEPT)
        return number

    def _delete(self, name: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self._path("versions", name))
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def _forget(self, before: int) -> None:
        """Deletes the files of versions with smaller numbers; their pointers stay as a history."""
        rows = self.spark.read.schema("n long, name string, note string").parquet(self._path("pointers"))
        for row in rows.where(F.col("n").between(before - 1 - KEPT, before - 1)).collect():
            self._delete(row.name)
