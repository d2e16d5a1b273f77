"""Weekly reports that are kept and brought up to date from changes (survey rows S19, A27, A29). Roles: an order is a job, its customer a tenant's reporter, its lines stat rows."""

from pyspark.sql import functions as F

from tallyforge.operators.incremental import Reports
from tallyforge.plans.registry import query, read
from tallyforge.sources.versioned import Versioned
from tallyforge.streaming.jobs import shared_folder

_WEEKS = "SELECT o_custkey AS tenant, CAST(date_trunc('week', o_orderdate) AS DATE) AS week, count(*) AS jobs, min(o_orderkey) AS created_by FROM orders WHERE o_orderstatus {} GROUP BY 1, 2"


@query(f"WITH old AS ({_WEEKS.format(chr(61) + chr(39) + 'F' + chr(39))}), new AS ({_WEEKS.format('IN (' + chr(39) + 'O' + chr(39) + ', ' + chr(39) + 'P' + chr(39) + ')')}) SELECT coalesce(new.tenant, old.tenant) AS tenant, strftime(coalesce(new.week, old.week), '%Y-%m-%d') AS week, coalesce(new.jobs, old.jobs) AS jobs, coalesce(old.created_by, new.created_by) AS created_by FROM old FULL JOIN new ON old.tenant = new.tenant AND old.week = new.week")
def weekly_upsert(spark, sf_dir):
    """Weekly rows by (tenant, week) written to a table, then newer ones over them; who created a row stays."""
    orders = read(spark, sf_dir, "orders")
    day = F.date_trunc("week", "o_orderdate").cast("date")
    rows = lambda status: orders.where(F.col("o_orderstatus").isin(*status)).groupBy(F.col("o_custkey").alias("tenant"), day.alias("week")).agg(F.count("*").alias("jobs"), F.min("o_orderkey").alias("created_by")).withColumn("year", F.year("week"))
    weeks = Versioned(spark, shared_folder(spark), "tenant long, week date, jobs long, created_by long, year int", ["year"])
    for status in (["F"], ["O", "P"]):
        weeks.upsert(rows(status), ["tenant", "week", "year"], keep=("created_by",))
    return weeks.read().select("tenant", F.date_format("week", "yyyy-MM-dd").alias("week"), "jobs", "created_by")


def _jobs(spark, sf_dir, prices):
    """Jobs (job, at, total, place, said): what a day's report sums, and what it tells of incidents."""
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("job"), F.col("o_orderdate").alias("at"), F.round(prices * 100).cast("long").alias("total"), F.col("o_custkey").cast("string").alias("place"), F.col("o_orderpriority").alias("said"))


_CORRECTED = "SELECT o_orderkey AS job, o_orderdate + CASE WHEN o_orderstatus = 'P' THEN INTERVAL 9 DAY ELSE INTERVAL 0 DAY END AS moment, CAST(round(o_totalprice * 100) AS BIGINT) AS total, CAST(o_custkey AS VARCHAR) AS place, o_orderpriority AS said FROM orders WHERE o_totalprice >= 20000"


@query(f"WITH j AS (SELECT *, date_trunc('week', moment) AS w FROM ({_CORRECTED})), d AS (SELECT w, count(*) AS details FROM (SELECT DISTINCT w, trim(place), trim(said) FROM j) GROUP BY w) SELECT strftime(w, '%Y-%m-%d') AS week, count(DISTINCT CAST(moment AS DATE)) AS days, count(*) AS jobs, CAST(sum(total) AS BIGINT) AS total, details FROM j JOIN d USING (w) GROUP BY w, details")
def weekly_incremental(spark, sf_dir):
    """Reports of all jobs, then corrections (jobs of one status move nine days) and deletions (cheap jobs go); only days and weeks that these touch are made anew."""
    jobs = _jobs(spark, sf_dir, F.col("o_totalprice"))
    reports = Reports(spark, shared_folder(spark), sums=["total"], details=["place", "said"], span="year")
    reports.refresh(jobs, jobs.select("at"))
    late = read(spark, sf_dir, "orders").where("o_orderstatus = 'P' or o_totalprice < 20000").select(F.col("o_orderkey").alias("job"), "o_orderstatus", "o_totalprice")
    moved = jobs.join(late, "job", "left").where("o_totalprice is null or o_totalprice >= 20000")
    now = moved.withColumn("at", F.when(F.col("o_orderstatus") == "P", F.col("at") + F.expr("interval 9 days")).otherwise(F.col("at"))).select(*jobs.columns)
    changed = jobs.join(late, "job", "left_semi").select("at")
    reports.refresh(now, changed.unionByName(now.join(late, "job", "left_semi").select("at")))
    return reports.weeks().select(F.date_format("week", "yyyy-MM-dd").alias("week"), "days", "jobs", "total", "details")
