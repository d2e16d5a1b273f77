"""Daily, weekly and calendar reports, dashboard and listings. Roles: an order is a job, its date the report date."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.functions.dates import week_start
from tallyforge.plans.registry import query, read
from tallyforge.sources.listing import Listing
from tallyforge.streaming.jobs import shared_folder


def _days(spark, sf_dir):
    """Per day: jobs and the sum and count of their stat rows. Lines are summed by order first, so the join meets one row an order."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("q"), F.count("*").alias("k"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    rows = orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left")
    return rows.groupBy("day").agg(F.count("*").alias("jobs"), F.coalesce(F.sum("q"), F.lit(0)).alias("total"), F.coalesce(F.sum("k"), F.lit(0)).alias("stat_rows"))


_DAYS = "SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS jobs, CAST(coalesce(sum(q), 0) AS BIGINT) AS total, CAST(coalesce(sum(k), 0) AS BIGINT) AS stat_rows FROM orders LEFT JOIN (SELECT l_orderkey, sum(CAST(l_quantity AS BIGINT)) AS q, count(*) AS k FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey GROUP BY 1"


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, 'stt:' || l_linenumber AS key, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS ket_qua, min(l_returnflag) AS label FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2")
def daily_stat_merge(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("stt:"), "l_linenumber").alias("key"), "l_quantity", "l_returnflag")
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return rows.groupBy("day", "key").agg(F.sum(F.col("l_quantity").cast("long")).alias("ket_qua"), F.min("l_returnflag").alias("label"))


@query("WITH h AS (SELECT source, md5(text) AS row_hash, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1, 2) SELECT source, CAST(sum(n) AS BIGINT) AS total, count(*) AS selected, CAST(sum(n) - count(*) AS BIGINT) AS skipped FROM h GROUP BY source")
def daily_dataset_dedup(spark, sf_dir):
    hashed = read(spark, sf_dir, "documents").select("source", F.md5(F.col("text")).alias("row_hash")).groupBy("source", "row_hash").agg(F.count("*").alias("n"))
    return hashed.groupBy("source").agg(F.sum("n").alias("total"), F.count("*").alias("selected"), (F.sum("n") - F.count("*")).alias("skipped"))


@query(f"SELECT strftime(day, '%Y-%m-%d') AS day, jobs, total, stat_rows FROM ({_DAYS})")
def calendar_day_payload(spark, sf_dir):
    return _days(spark, sf_dir).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(f"SELECT strftime(date_trunc('week', day), '%Y-%m-%d') AS week_start, strftime(date_trunc('week', day) + INTERVAL 6 DAY, '%Y-%m-%d') AS week_end, count(*) AS days, CAST(sum(jobs) AS BIGINT) AS jobs, CAST(sum(total) AS BIGINT) AS total FROM ({_DAYS}) GROUP BY date_trunc('week', day)")
def weekly_rollup(spark, sf_dir):
    """Days first, then weeks of days: one pass over the jobs instead of seven."""
    weeks = _days(spark, sf_dir).withColumn("w", week_start(F.col("day"))).groupBy("w").agg(F.count("*").alias("days"), F.sum("jobs").alias("jobs"), F.sum("total").alias("total"))
    return weeks.select(F.date_format("w", "yyyy-MM-dd").alias("week_start"), F.date_format(F.date_add("w", 6), "yyyy-MM-dd").alias("week_end"), "days", "jobs", "total")


@query("WITH b AS (SELECT CAST(date_trunc('month', min(ts)) AS DATE) AS lo, CAST(last_day(max(ts)) AS DATE) AS hi FROM events), s AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM b) SELECT strftime(s.day, '%Y-%m-%d') AS day, count(event_id) AS jobs, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS approved, coalesce(bool_or(event_id IS NOT NULL AND value IS NULL), false) AS has_issues FROM s LEFT JOIN events ON CAST(ts AS DATE) = s.day GROUP BY s.day")
def calendar_month_spine(spark, sf_dir):
    """Every day of the months covered, with zeros where nothing happened."""
    events = read(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("day"), "event_type", "value")
    days = events.groupBy("day").agg(F.count("event_id").alias("jobs"), F.count_if(F.col("event_type") == "purchase").alias("approved"), F.bool_or(F.col("value").isNull()).alias("has_issues"))
    spine = days.agg(F.explode(F.sequence(F.trunc(F.min("day"), "month"), F.last_day(F.max("day")))).alias("day"))
    out = spine.join(days, "day", "left")
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("jobs", F.lit(0)).alias("jobs"), F.coalesce("approved", F.lit(0)).alias("approved"), F.coalesce("has_issues", F.lit(False)).alias("has_issues"))


@query("SELECT DISTINCT strftime(d, '%Y-%m-%d') AS day FROM (SELECT o_orderdate AS d FROM orders UNION ALL SELECT ts FROM events)")
def calendar_union_dates(spark, sf_dir):
    days = read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")).distinct().unionByName(read(spark, sf_dir, "events").select(F.to_date("ts").alias("d")).distinct())
    return days.distinct().select(F.date_format("d", "yyyy-MM-dd").alias("day"))


@query("SELECT o_custkey AS batch, count(*) AS total, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS f, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS o, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS p, CAST(count(CASE WHEN o_orderstatus = 'F' THEN 1 END) * 100 // count(*) AS BIGINT) AS progress FROM orders GROUP BY o_custkey")
def batch_status_progress(spark, sf_dir):
    n = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("batch")).agg(F.count("*").alias("total"), n("F").alias("f"), n("O").alias("o"), n("P").alias("p"), F.floor(n("F") * 100 / F.count("*")).alias("progress"))


@query("SELECT (SELECT count(*) FROM documents) AS documents, count(*) AS jobs, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS approved, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS open, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS waiting, round(count(CASE WHEN o_orderstatus = 'F' THEN 1 END) * 100.0 / count(*), 1) AS approval_rate, (SELECT count(*) FROM labels) AS reviews FROM orders")
def dashboard_kpis(spark, sf_dir):
    n = lambda s: F.count_if(F.col("o_orderstatus") == s)
    jobs = read(spark, sf_dir, "orders").agg(F.count("*").alias("jobs"), n("F").alias("approved"), n("O").alias("open"), n("P").alias("waiting"), F.round(n("F") * 100.0 / F.count("*"), 1).cast("double").alias("approval_rate"))
    return jobs.crossJoin(read(spark, sf_dir, "documents").agg(F.count("*").alias("documents"))).crossJoin(read(spark, sf_dir, "labels").agg(F.count("*").alias("reviews")))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 5")
def dashboard_recent(spark, sf_dir):
    return read(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(5).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS size, count(CASE WHEN lang = 'en' THEN 1 END) AS en, count(CASE WHEN lang = 'de' THEN 1 END) AS de, count(CASE WHEN lang = 'fr' THEN 1 END) AS fr, count(CASE WHEN lang = 'es' THEN 1 END) AS es FROM documents GROUP BY source")
def document_stats(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("size"), *(F.count_if(F.col("lang") == x).alias(x) for x in ("en", "de", "fr", "es")))


@query("SELECT source, md5(text) AS checksum, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1, 2")
def document_dedup_checksum(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("source", F.md5(F.col("text")).alias("checksum"), "doc_id")
    return docs.groupBy("source", "checksum").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT o_orderkey, CAST((SELECT count(*) FROM orders) AS BIGINT) AS total, CAST((SELECT (count(*) + 19) // 20 FROM orders) AS BIGINT) AS pages FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def page_listing(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    page = orders.orderBy(F.desc("o_orderdate"), "o_orderkey").offset(40).limit(20).select("o_orderkey")
    return page.crossJoin(orders.agg(F.count("*").alias("total"), F.floor((F.count("*") + 19) / 20).alias("pages")))


@query("SELECT n_name, c_mktsegment AS role, count(*) AS members, CAST(round(sum(c_acctbal)) AS BIGINT) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def tenant_members(spark, sf_dir):
    """Members by tenant and role; the tables of tenants are small dimensions, which Spark broadcasts by their size."""
    members = read(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("members"), F.sum("c_acctbal").alias("b"))
    tenants = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = members.join(tenants, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select("n_name", F.col("c_mktsegment").alias("role"), "members", F.round("b").cast("long").alias("balance"))


@query("SELECT c_nationkey, count(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 END) AS owners FROM customer GROUP BY c_nationkey HAVING count(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 END) <= 8")
def last_owner_guard(spark, sf_dir):
    return read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count_if(F.col("c_mktsegment") == "BUILDING").alias("owners")).where("owners <= 8")


@query("SELECT o_orderstatus AS kind, o_custkey, count(*) AS n FROM orders GROUP BY 1, 2 UNION ALL SELECT 'event', user_id, count(*) FROM events GROUP BY user_id")
def incident_union(spark, sf_dir):
    a = read(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("kind"), "o_custkey").agg(F.count("*").alias("n"))
    b = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("o_custkey")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("event"))
    return a.unionByName(b)


@query("SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def latest_job_per_tenant(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    newest = rows.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("x"))
    return newest.select("o_custkey", "x.o_orderkey", F.date_format("x.o_orderdate", "yyyy-MM-dd").alias("day"))


@query("WITH u AS (SELECT o_custkey AS who, 1 AS source, o_orderkey AS place, o_orderpriority AS said FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, 2, l_orderkey * 8 + l_linenumber, concat(l_returnflag, l_quantity::BIGINT) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 40 UNION ALL SELECT user_id, 3, event_id, event_type FROM events) SELECT who, count(*) AS n, arg_min(said, (source, place, said)) AS first, arg_max(said, (source, place, said)) AS last FROM u GROUP BY who")
def incident_sources(spark, sf_dir):
    """Incidents of three sources in a fixed order: tables, stat rows that count some, narratives; per reporter their number, first and last."""
    orders, lines = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem").where("l_quantity > 40")
    tables = orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("who"), F.col("o_orderkey").alias("place"), F.col("o_orderpriority").alias("said"))
    stats = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(F.col("o_custkey").alias("who"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("place"), F.concat("l_returnflag", F.col("l_quantity").cast("long").cast("string")).alias("said"))
    told = read(spark, sf_dir, "events").select(F.col("user_id").alias("who"), F.col("event_id").alias("place"), F.col("event_type").alias("said"))
    placed = F.struct("source", "place", "said")
    return in_fixed_order(tables, stats, told).groupBy("who").agg(F.count("*").alias("n"), F.min(placed)["said"].alias("first"), F.max(placed)["said"].alias("last"))


def in_fixed_order(*sources):
    """One table of all ``sources``, of which each is told by its number in ``source``; columns that one lacks are null."""
    out = sources[0].withColumn("source", F.lit(1))
    for k, more in enumerate(sources[1:], 2):
        out = out.unionByName(more.withColumn("source", F.lit(k)), allowMissingColumns=True)
    return out


@query("WITH d AS (SELECT user_id, event_id, event_type, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events), e AS (SELECT max(ts) AS last FROM events) SELECT count(*) AS jobs, count(CASE WHEN ts > last - INTERVAL 30 DAY THEN 1 END) AS recent, round(sum(CASE WHEN ts > last - INTERVAL 30 DAY THEN epoch_ms(ts) - epoch_ms(before) END) / count(CASE WHEN ts > last - INTERVAL 30 DAY THEN before END) / 60000.0, 1) AS mean_minutes, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS approved FROM d, e")
def dashboard_times(spark, sf_dir):
    """Jobs, those of the last thirty days, and the mean minutes that these took since the job before them."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = read(spark, sf_dir, "events").withColumn("took", F.expr("unix_millis(cast(ts as timestamp))") - F.lag(F.expr("unix_millis(cast(ts as timestamp))")).over(order))
    rows = events.crossJoin(events.agg(F.max("ts").alias("last")))  # one row
    recent = F.col("ts") > F.col("last") - F.expr("interval 30 days")
    return rows.agg(F.count("*").alias("jobs"), F.count_if(recent).alias("recent"), F.round(F.avg(F.when(recent, F.col("took"))) / 60000, 1).alias("mean_minutes"), F.count_if(F.col("event_type") == "purchase").alias("approved"))


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey AS job, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status, count(*) OVER (PARTITION BY CAST(o_orderdate AS DATE)) AS jobs, bool_or(o_orderstatus = 'P') OVER (PARTITION BY CAST(o_orderdate AS DATE)) AS has_issues FROM orders")
def calendar_job_list(spark, sf_dir):
    """The jobs of each day, with what the day has; days are counted first, so no day is gathered."""
    jobs = read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d"), F.col("o_orderkey").alias("job"), "o_orderstatus")
    days = jobs.groupBy("d").agg(F.count("*").alias("jobs"), F.bool_or(F.col("o_orderstatus") == "P").alias("has_issues"))
    status = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "O", "pending").otherwise("failed")
    return jobs.join(days, "d").select(F.date_format("d", "yyyy-MM-dd").alias("day"), "job", status.alias("status"), "jobs", "has_issues")


@query("SELECT o_orderkey, r - 1 AS rank FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS r, count(*) OVER () AS n FROM orders) WHERE r > n // 2 AND r <= n // 2 + 20")
def page_far_into_a_list(spark, sf_dir):
    """O1: twenty rows from the middle of a list, read from one range of its index."""
    listing = Listing(spark, shared_folder(spark), ["-o_orderdate", "o_orderkey"])
    listing.build(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), each=5000)
    return listing.slice(listing.total() // 2, 20).select("o_orderkey", "rank")
