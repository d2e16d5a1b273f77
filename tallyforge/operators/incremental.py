"""Daily states that weeks are merged from, brought up to date from changes (survey rows A27, A29, A14).

A day's state is what merges: sums, a count of jobs, and its details, each once with the first job that tells it. It is kept
in two tables in partitions of a ``span`` of time. A change names the times it touches, before and after; the days of these are made anew from
the jobs as they are now, and the weeks of these from their days. Everything else stays as it was written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.dates import week_start
from tallyforge.sources.versioned import Versioned


def distinct_details(rows: DataFrame, keys: list[str], fields: list[str], order: list[str]) -> DataFrame:
    """Of ``rows`` the first by ``order`` of each (``keys``, trimmed ``fields``) with all its columns; rows whose fields are all empty go."""
    trimmed = [F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in fields]
    signed = rows.withColumn("_signature", F.array(*trimmed)).where(F.exists("_signature", lambda x: x != ""))
    row = F.struct(*order, F.struct(*rows.columns).alias("_row"))
    return signed.groupBy(*keys, "_signature").agg(F.min(row)["_row"].alias("_row")).select("_row.*")


class Reports:
    """Days and weeks in ``base`` of jobs (job, at, ``sums``: numbers, ``details``: texts that make a detail, with what else a job carries)."""

    def __init__(self, spark: SparkSession, base: str, sums: list[str], details: list[str], span: str = "month"):
        self.sums, self.details, self.span = sums, details, span
        numbers = ", ".join(f"{c} long" for c in sums)
        texts = ", ".join(f"{c} string" for c in details)
        self.day_table = Versioned(spark, f"{base}/days", f"span date, week date, day date, jobs long, {numbers}", ["span"])
        self.detail_table = Versioned(spark, f"{base}/details", f"span date, week date, day date, at timestamp_ntz, job long, {texts}", ["span"])
        self.week_table = Versioned(spark, f"{base}/weeks", f"week date, days long, jobs long, {numbers}, details long, span date", ["span"])

    def _dated(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("day", F.to_date("at")).withColumn("week", week_start(F.col("day"))).withColumn("span", F.trunc("week", self.span).cast("date"))

    def refresh(self, jobs: DataFrame, changed: DataFrame) -> None:
        """``jobs`` as they are now; ``changed`` (at): times of rows that came, went or differ, as they were and as they are."""
        touched = self._dated(changed.where("at is not null")).select("span", "week", "day").distinct()
        rows = self._dated(jobs.where("at is not null")).join(touched, ["span", "week", "day"], "left_semi")
        days = rows.groupBy("span", "week", "day").agg(F.count("*").alias("jobs"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in self.sums))
        self.day_table.replace(touched, days)
        self.detail_table.replace(touched, distinct_details(rows, ["span", "week", "day"], self.details, ["at", "job"]))
        weeks = touched.select("span", "week").distinct()
        mine = self.day_table.read().join(weeks, ["span", "week"], "left_semi").groupBy("span", "week").agg(F.count("*").alias("days"), F.sum("jobs").alias("jobs"), *(F.sum(c).alias(c) for c in self.sums))
        told = distinct_details(self.detail_table.read().join(weeks, ["span", "week"], "left_semi"), ["week"], self.details, ["at", "job"]).groupBy("week").agg(F.count("*").alias("details"))
        out = mine.join(told, "week", "left").withColumn("details", F.coalesce("details", F.lit(0)))
        self.week_table.replace(weeks, out)

    def weeks(self) -> DataFrame:
        return self.week_table.read().drop("span")

    def week_details(self) -> DataFrame:
        """The details of each week, each once with the job that told it first."""
        return distinct_details(self.detail_table.read(), ["week"], self.details, ["at", "job"])
