"""Pages of long lists (survey row O1): an index of ranks, so that a page far into a list reads and sorts one range of it.

``Listing.build`` deals rows to ranges of the order, a folder each, and counts them. The rank of a range's first row
is the sum of the counts before it; a page is in the one or two ranges that its ranks fall in, and only these are read. A cursor, the key of the last row seen,
finds its range by the bounds that are kept with the counts.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a range.
RANGE = 100_000


class Listing:
    """A list in ``base`` by ``order``: names of columns, ``-`` before those that descend. The order is total: its last column tells rows apart."""

    def __init__(self, spark: SparkSession, base: str, order: list[str]):
        self.spark, self.base, self.order = spark, base.rstrip("/"), order

    def _keys(self, prefix: str = "") -> list[Column]:
        return [F.col(prefix + c[1:]).desc_nulls_last() if c.startswith("-") else F.col(prefix + c).asc_nulls_first() for c in self.order]

    def build(self, rows: DataFrame, each: int = RANGE) -> None:
        ranges = max(1, -(-rows.count() // each))
        dealt = rows.repartitionByRange(ranges, *self._keys()).withColumn("_range", F.spark_partition_id())
        dealt.write.mode("overwrite").partitionBy("_range").parquet(f"{self.base}/rows")
        kept = self.spark.read.schema(dealt.schema).parquet(f"{self.base}/rows")
        names = [c.lstrip("-") for c in self.order]
        key = F.struct(*names)
        first = Window.partitionBy("_range").orderBy(*self._keys())
        last = kept.withColumn("_r", F.row_number().over(first)).groupBy("_range").agg(F.count("*").alias("n"), F.max_by(key, "_r").alias("last"))
        last.coalesce(1).write.mode("overwrite").parquet(f"{self.base}/index")
        self.spark.createDataFrame([(dealt.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.base}/schema")

    def _rows(self) -> DataFrame:
        schema = self.spark.read.text(f"{self.base}/schema").first().value
        return self.spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(f"{self.base}/rows")

    def _index(self) -> DataFrame:
        """Ranges with their first rank, from 0. A row a range: some thousands for a list of a billion."""
        counts = self.spark.read.parquet(f"{self.base}/index")
        before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        return counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))

    def total(self) -> int:
        return self.spark.read.parquet(f"{self.base}/index").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def slice(self, start: int, size: int) -> DataFrame:
        """The rows of ranks ``start`` to ``start + size - 1``, with ``rank``; out of order, as rows of a table are."""
        spans = self._index().where((F.col("start") < start + size) & (F.col("start") + F.col("n") > start)).select("_range", "start").collect()  # as many as a page has ranges
        rows = self._rows().where(F.col("_range").isin([r["_range"] for r in spans]))
        firsts = F.create_map(*(F.lit(x) for r in spans for x in (r["_range"], r["start"]))) if spans else F.create_map().cast("map<int,bigint>")
        placed = rows.withColumn("rank", F.row_number().over(Window.partitionBy("_range").orderBy(*self._keys())) - 1 + F.try_element_at(firsts, F.col("_range")))
        return placed.where((F.col("rank") >= start) & (F.col("rank") < start + size)).drop("_range")

    def page(self, number: int, size: int) -> DataFrame:
        """Page ``number``, from 1."""
        return self.slice((number - 1) * size, size)

    def after(self, cursor: dict, size: int) -> DataFrame:
        """The ``size`` rows that follow the row whose key is ``cursor``, whether it is still there or not."""
        ahead = F.lit(False)
        for c in reversed(self.order):
            name = c.lstrip("-")
            x, y = F.col(f"last.{name}"), F.lit(cursor[name])
            ahead = (x < y if c.startswith("-") else x > y) | ((x == y) & ahead)
        index = self._index()
        place = index.where(ahead).agg(F.min("_range").alias("r")).first().r  # the first range that ends behind the cursor
        if place is None:
            return self.slice(0, 0)
        rows = self._rows().where(F.col("_range") == place)
        behind = F.lit(False)
        for c in reversed(self.order):
            name = c.lstrip("-")
            behind = (F.col(name) > F.lit(cursor[name]) if c.startswith("-") else F.col(name) < F.lit(cursor[name])) | ((F.col(name) == F.lit(cursor[name])) & (behind if c is not self.order[-1] else F.lit(True)))
        skipped = rows.where(behind).count()
        start = index.where(F.col("_range") == place).first().start
        return self.slice(start + skipped, size)
