"""Scans of report files (survey rows S2-S4, S6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The files that are reports, and where a tenant's name is in a path.
REPORTS = "*.[pP][dD][fF]"
INBOX = r"(?:^|/)inbox/([^/]+)/[^/]+$"


def listing(spark: SparkSession, path: str, pattern: str = REPORTS) -> DataFrame:
    """(path, length, modificationTime) of the files in one folder that have content; the content is not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).where("length > 0").select("path", "length", "modificationTime")


def tenant(path: Column) -> Column:
    """The tenant of ``inbox/{tenant}/{file}``; null elsewhere."""
    return F.nullif(F.regexp_extract(path, INBOX, 1), F.lit(""))


def watched(spark: SparkSession, path: str, archive: str, pattern: str = REPORTS) -> DataFrame:
    """New files of a folder and those in it as a stream; files that are done move to ``archive``, which lies outside of it."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("cleanSource", "archive").option("sourceArchiveDir", archive).load(path)
