"""Hot folders (survey rows R2, R5): what a poll finds becomes documents and jobs, each content once a tenant over all of history.

A poll is a micro-batch. Its rows are written under its number, and ids follow from the run, the poll,
the tenant and the content; so a poll that is run again writes the same files with the same ids. A tenant's files of a poll
share one batch id.

A file whose content the tenant already has gets the row that is there. History grows without bound, so a blocked Bloom
filter stands before it: ``SEGMENTS`` segments a tenant, in each of which a content sets ``HASHES`` of ``BITS`` bits. Filters merge by a
bitwise or; each poll adds its own. Only contents of which all bits are set are looked up in history, in the buckets
they belong to. A false positive costs a look-up, never a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Segments of a tenant's filter, bits of a segment, bits of a content; buckets of history.
SEGMENTS, BITS, HASHES, BUCKETS = 4096, 8192, 5, 256

_FILES = "tenant string, path string, checksum string"
_KNOWN = "tenant string, checksum string, document string, path string"


def filter_bits(rows: DataFrame) -> DataFrame:
    """``rows`` (tenant, checksum) with a row for each bit of the filter: segment, word, bit."""
    place = F.pmod(F.xxhash64("checksum", "_k"), F.lit(BITS)).cast("int")
    segment = F.pmod(F.xxhash64("tenant", "checksum"), F.lit(SEGMENTS)).cast("int")
    each = rows.withColumn("_k", F.explode(F.array(*map(F.lit, range(HASHES)))))
    return each.withColumn("segment", segment).withColumn("word", F.shiftright(place, 6)).withColumn("bit", F.pmod(place, F.lit(64)).cast("int")).drop("_k")


def bloom(rows: DataFrame) -> DataFrame:
    """(tenant, segment, word, bits) of ``rows`` (tenant, checksum): the words of the filter that are not 0."""
    return filter_bits(rows).groupBy("tenant", "segment", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))


def maybe_known(rows: DataFrame, filters: DataFrame) -> DataFrame:
    """Of the distinct ``rows`` (tenant, checksum) those that ``filters``, merged as they are met, may hold."""
    asked = filter_bits(rows)
    words = filters.join(asked.select("tenant", "segment", "word").distinct(), ["tenant", "segment", "word"], "left_semi").groupBy("tenant", "segment", "word").agg(F.bit_or("bits").alias("bits"))
    hit = asked.join(words, ["tenant", "segment", "word"]).where(F.expr("getbit(bits, bit)") == 1)
    return hit.groupBy("tenant", "checksum").agg(F.count("*").alias("n")).where(F.col("n") == HASHES).drop("n")


def _bucket(checksum: Column) -> Column:
    return F.pmod(F.xxhash64(checksum), F.lit(BUCKETS)).cast("int")


class Intake:
    """The folder ``base`` of a run: ``history`` (a row a content of a tenant), ``filters``, ``taken`` (a row a file), ``jobs``, each in polls."""

    def __init__(self, spark: SparkSession, base: str, tenants: DataFrame | None = None):
        self.spark, self.base, self.tenants = spark, base.rstrip("/"), tenants

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        schema = f"{schema}, poll long"
        return self.spark.read.schema(schema).parquet(f"{self.base}/{name}") if there else self.spark.createDataFrame([], schema)

    def history(self) -> DataFrame:
        return self._read("history", f"{_KNOWN}, bucket int")

    def filters(self) -> DataFrame:
        return self._read("filters", "tenant string, segment int, word int, bits long")

    def taken(self) -> DataFrame:
        """Each file with its document, the path of the content's first file, and whether it is new."""
        return self._read("taken", f"{_FILES}, document string, first_path string, is_new boolean")

    def jobs(self) -> DataFrame:
        """A job for each new document."""
        return self._read("jobs", "tenant string, document string, batch string, job string")

    def _put(self, rows: DataFrame, name: str, poll: int, *partition: str) -> DataFrame:
        path = f"{self.base}/{name}/poll={poll}"
        rows.write.mode("overwrite").partitionBy(*partition).parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def poll(self, files: DataFrame, poll: int) -> None:
        """Takes ``files`` (tenant, path, checksum) in. Files of unknown tenants, and those without one, are left."""
        files = files.where("tenant is not null").select("tenant", "path", "checksum")
        if self.tenants is not None:
            files = files.join(self.tenants.select("tenant").distinct(), "tenant", "left_semi")
        mine = files.groupBy("tenant", "checksum").agg(F.min("path").alias("path"))
        before = F.col("poll") < poll  # a poll that is run again doesn't meet itself
        suspects = maybe_known(mine, self.filters().where(before)).withColumn("bucket", _bucket(F.col("checksum")))
        known = self.history().where(before).join(suspects, ["bucket", "tenant", "checksum"], "left_semi").select("tenant", "checksum", "document", F.col("path").alias("known_path"))
        own = F.sha2(F.concat_ws("/", "tenant", "checksum"), 256)
        told = self._put(mine.join(known, ["tenant", "checksum"], "left").select("tenant", "checksum", F.coalesce("document", own).alias("document"), F.coalesce("known_path", "path").alias("path"), F.col("document").isNull().alias("fresh")), "told", poll)
        new = told.where("fresh").drop("fresh")
        first = told.select("tenant", "checksum", "document", F.col("path").alias("first_path"), "fresh")
        self._put(files.join(first, ["tenant", "checksum"]).select("tenant", "path", "checksum", "document", "first_path", (F.col("fresh") & (F.col("path") == F.col("first_path"))).alias("is_new")), "taken", poll)
        batch = F.sha2(F.concat_ws("/", F.lit(self.base), F.lit(str(poll)), "tenant"), 256)
        jobs = new.select("tenant", "document", batch.alias("batch")).withColumn("job", F.sha2(F.concat_ws("/", "batch", "document"), 256))
        self._put(jobs, "jobs", poll)
        self._put(bloom(new), "filters", poll)
        self._put(new.select("tenant", "checksum", "document", "path", _bucket(F.col("checksum")).alias("bucket")), "history", poll, "bucket")

    def run(self, files: DataFrame) -> None:
        """All that a stream of files has, a poll a trigger; goes on where the last run ended."""
        files.writeStream.foreachBatch(self.poll).option("checkpointLocation", f"{self.base}/log").trigger(availableNow=True).start().awaitTermination()
