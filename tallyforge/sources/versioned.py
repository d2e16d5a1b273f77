"""Tables that are updated in place (survey row S19): copy-on-write of the partitions that a change touches.

A table's folder has ``data/version=<v>/<partition columns>/``, ``manifests/<v>`` and ``commits/<n>``. A
manifest tells which version holds each partition; a commit is a small file that names a manifest and is
created only if no other writer has created it. Readers take the last commit, so they see a
change whole or not at all; a writer that dies before its commit leaves files that nobody reads, and ``vacuum``
deletes them. Of two writers that started from the same commit the second gets ``Conflict`` and may try again.

Only partitions that are touched are read and written, however large the table is.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(Exception):
    """Another writer has committed first."""


def merged(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same keys; columns of ``keep`` stay as they were. One tagged pass: both sides are grouped by the keys once.

    A value is moved in a struct, so a null replaces a value too. Rows of ``new`` are unique by the keys.
    """
    columns = [c for c in new.columns if c not in keys]
    tagged = old.select(*new.columns, F.lit(0).alias("_new")).unionByName(new.withColumn("_new", F.lit(1)))
    row = F.struct(*columns)
    both = tagged.groupBy(*keys).agg(F.min_by(row, "_new").alias("_first"), F.max_by(row, "_new").alias("_last"))
    return both.select(*(F.col(c) if c in keys else F.col(f"{'_first' if c in keep else '_last'}.{c}").alias(c) for c in new.columns))


class Versioned:
    """A table of ``schema`` in ``base``, a folder that all see, in partitions of the columns ``partition``."""

    def __init__(self, spark: SparkSession, base: str, schema: str | T.StructType, partition: list[str]):
        self.spark, self.base, self.partition = spark, base.rstrip("/"), partition
        self.schema = spark.createDataFrame([], schema).schema
        self.stored = T.StructType([f for f in self.schema if f.name not in partition] + [f for f in self.schema if f.name in partition])

    # files

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _last(self) -> tuple[int, str | None]:
        """Number of the last commit (0: none) and its manifest."""
        path, fs = self._path("commits")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        numbers = [int(n) for n in names if n.isdigit()]
        if not numbers:
            return 0, None
        at, _ = self._path(f"commits/{max(numbers):012d}")
        stream = fs.open(at)
        try:
            return max(numbers), self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _commit(self, number: int, manifest: str) -> None:
        at, fs = self._path(f"commits/{number:012d}")
        try:
            stream = fs.create(at, False)  # fails if it is there
        except Exception as e:
            raise Conflict(f"commit {number} is taken") from e
        try:
            stream.write(bytearray(manifest.encode()))
        finally:
            stream.close()

    # reading

    def manifest(self, name: str | None = None) -> DataFrame:
        """The partitions and the version that holds each, of the last commit or a manifest by name."""
        name = self._last()[1] if name is None else name
        schema = T.StructType([*(f for f in self.stored if f.name in self.partition), T.StructField("version", T.StringType())])
        return self.spark.read.schema(schema).parquet(f"{self.base}/manifests/{name}") if name else self.spark.createDataFrame([], schema)

    def _held(self, manifest: DataFrame) -> DataFrame:
        path, fs = self._path("data")
        if not fs.exists(path):
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(T.StructType([*self.stored, T.StructField("version", T.StringType())])).parquet(f"{self.base}/data")
        wanted = manifest.select(*(F.col(c).alias(f"_{c}") for c in [*self.partition, "version"]))
        same = F.col("version").eqNullSafe(F.col("_version"))
        for c in self.partition:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        return rows.join(wanted, same, "left_semi").select(*self.schema.names)

    def read(self) -> DataFrame:
        return self._held(self.manifest())

    # writing

    def _write(self, touched: DataFrame, make: Callable[[DataFrame], DataFrame]) -> None:
        """Replaces the partitions ``touched`` by what ``make`` makes of their rows."""
        number, name = self._last()
        version = f"{number + 1}-{uuid.uuid4().hex}"
        whole = self.manifest(name or "") if name else self.manifest("")
        touched = touched.select(*self.partition).distinct()
        same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in self.partition]
        before = whole.alias("m").join(touched.alias("t"), same("m", "t"), "left_semi")
        make(self._held(before)).select(*self.stored.names).hint("rebalance", *self.partition).write.partitionBy(*self.partition).parquet(f"{self.base}/data/version={version}")
        # a partition that has no rows any more leaves the manifest
        there = self.spark.read.schema(self.stored).parquet(f"{self.base}/data/version={version}").select(*self.partition).distinct().withColumn("version", F.lit(version))
        rest = whole.alias("m").join(touched.alias("t"), same("m", "t"), "left_anti")
        rest.unionByName(there).coalesce(1).write.parquet(f"{self.base}/manifests/{version}")
        self._commit(number + 1, version)

    def upsert(self, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> None:
        """Insert or update by ``keys``, which the partition columns follow from; columns of ``keep`` stay as they were."""
        new = new.select(*self.schema.names)
        self._write(new, lambda old: merged(old, new, keys, keep))

    def replace(self, touched: DataFrame, new: DataFrame) -> None:
        """All rows with the keys ``touched`` (columns of the table, the partition's among them) go, and ``new`` comes in their place."""
        on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in touched.columns]
        gone = touched.distinct()
        self._write(gone, lambda old: old.alias("a").join(gone.alias("b"), on, "left_anti").select(*self.schema.names).unionByName(new.select(*self.schema.names)))

    def vacuum(self) -> list[str]:
        """Deletes versions that the last commit doesn't name; to be run when nobody reads or writes an older one."""
        used = {r.version for r in self.manifest().select("version").distinct().collect()}
        path, fs = self._path("data")
        gone = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().removeprefix("version=") not in used] if fs.exists(path) else []
        for p in gone:
            fs.delete(p, True)
        return [p.getName() for p in gone]
