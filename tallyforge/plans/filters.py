"""Predicates, lookups and semi-joins. Roles: an order is a job, its customer a batch and, modulo five, a tenant; a document is a file."""

from pyspark.sql import functions as F

from tallyforge.operators.filters import admitted, capped, deletable, has_all, on_day, placeholder, role_allows, scoped, searched
from tallyforge.plans.registry import query, read

_JOBS = "SELECT o_orderkey AS job, o_custkey % 5 AS tenant, o_custkey AS batch, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'P' THEN 'ready_for_review' ELSE 'failed' END AS status, o_orderpriority AS template, o_orderdate AS created_at FROM orders"


def jobs(spark, sf_dir):
    s = F.col("o_orderstatus")
    status = F.when(s == "F", "approved").when(s == "P", "ready_for_review").otherwise("failed")
    rows = read(spark, sf_dir, "orders")
    return rows.select(F.col("o_orderkey").alias("job"), (F.col("o_custkey") % 5).alias("tenant"), F.col("o_custkey").alias("batch"), status.alias("status"), F.col("o_orderpriority").alias("template"), F.col("o_orderdate").alias("created_at"))


@query(f"SELECT job, batch, template FROM ({_JOBS}) WHERE tenant = 3 AND status = 'approved'")
def tenant_jobs_optional(spark, sf_dir):
    return scoped(jobs(spark, sf_dir), 3, status="approved", template=None, batch=None).select("job", "batch", "template")


@query("SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-04'")
def jobs_on_day(spark, sf_dir):
    return read(spark, sf_dir, "events").where(on_day(F.col("ts"), "2024-01-03")).select("event_id", "event_type")


@query(f"SELECT tenant, count(*) AS found, count(CASE WHEN status = 'approved' AND template <> '1-URGENT' THEN 1 END) AS usable, string_agg(DISTINCT status, ',' ORDER BY status) AS statuses, CASE WHEN count(CASE WHEN status = 'approved' AND template <> '1-URGENT' THEN 1 END) = 0 THEN 'not_approved' ELSE 'ok' END AS outcome FROM ({_JOBS}) WHERE job IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49) GROUP BY tenant")
def jobs_by_ids_diagnostics(spark, sf_dir):
    """The jobs of a list of ids, by tenant, and why none of them is of use; one pass serves both."""
    wanted = read(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("job"))
    found = jobs(spark, sf_dir).join(wanted, "job", "left_semi")
    usable = F.count_if((F.col("status") == "approved") & (F.col("template") != "1-URGENT"))
    out = found.groupBy("tenant").agg(F.count("*").alias("found"), usable.alias("usable"), F.array_join(F.array_sort(F.collect_set("status")), ",").alias("statuses"))
    return out.withColumn("outcome", F.when(F.col("usable") == 0, "not_approved").otherwise("ok"))


@query("SELECT doc_id, source FROM documents WHERE list_has_all([source, coalesce(lang, 'none'), CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END], ['en', 'long'])")
def documents_with_tags(spark, sf_dir):
    tags = F.array("source", F.coalesce("lang", F.lit("none")), F.when(F.col("n_chars") > 2000, "long").otherwise("short"))
    return read(spark, sf_dir, "documents").where(has_all(tags, ["en", "long"])).select("doc_id", "source")


@query("SELECT user_id, count(*) AS n, round(sum(CAST(round(value * 100) AS BIGINT)) / count(*) / 60.0, 3) AS minutes FROM events WHERE value IS NOT NULL AND value > 0 AND ts >= TIMESTAMP '2024-01-31' - INTERVAL 20 DAY GROUP BY user_id")
def recent_processing_time(spark, sf_dir):
    """times that are there, above zero and not too old."""
    recent = F.col("ts") >= F.expr("timestamp_ntz'2024-01-31 00:00:00' - interval 20 days")
    rows = read(spark, sf_dir, "events").where(F.col("value").isNotNull() & (F.col("value") > 0) & recent)
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum(F.round(F.col("value") * 100).cast("long")) / F.count("*") / 60.0, 3).alias("minutes"))


_PAYLOAD = "CASE event_type WHEN 'error' THEN concat('{\"_manual_review_path\": \"', CAST(user_id AS VARCHAR(20)), '\"}') WHEN 'click' THEN '{}' ELSE props END"


@query(f"SELECT event_type, count(*) AS n, count(CASE WHEN payload IS NULL OR list_has_all(['_manual_review_path', '_manual_review_metadata'], json_keys(payload)) THEN 1 END) AS placeholders FROM (SELECT event_type, {_PAYLOAD} AS payload FROM events) GROUP BY event_type")
def placeholder_payloads(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_type", F.expr(_PAYLOAD).alias("payload"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(placeholder(F.col("payload"))).alias("placeholders"))


@query("SELECT p_brand, count(*) AS active, min(p_partkey) AS first FROM part WHERE p_size % 10 <> 0 GROUP BY p_brand")
def active_templates(spark, sf_dir):
    """templates that aren't deleted."""
    return read(spark, sf_dir, "part").where("p_size % 10 <> 0").groupBy("p_brand").agg(F.count("*").alias("active"), F.min("p_partkey").alias("first"))


@query("SELECT event_id, state FROM (SELECT event_id, ts, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'approved' ELSE 'failed' END AS state FROM events) WHERE state IN ('approved', 'failed') OR (state = 'pending' AND ts < TIMESTAMP '2024-01-10' - INTERVAL 300 SECOND)")
def deletable_jobs(spark, sf_dir):
    t = F.col("event_type")
    state = F.when(t == "view", "pending").when(t == "click", "processing").when(t == "purchase", "approved").otherwise("failed")
    rows = read(spark, sf_dir, "events").select("event_id", "ts", state.alias("state"))
    return rows.where(deletable(F.col("state"), F.col("ts"), F.expr("timestamp_ntz'2024-01-10 00:00:00'"))).select("event_id", "state")


_FILE = "concat('file_', CAST(doc_id AS VARCHAR(20)), CASE WHEN n_chars % 7 = 0 THEN '.PDF' WHEN n_chars % 7 = 1 THEN '.txt' WHEN n_chars % 7 = 2 THEN '.docx' WHEN n_chars % 7 = 3 THEN '.exe' WHEN n_chars % 7 = 4 THEN '.md' WHEN n_chars % 7 = 5 THEN '.csv' ELSE '' END)"
_CONTENT = "concat(CASE WHEN n_chars % 5 = 0 THEN '%PDF-' WHEN n_chars % 5 = 1 THEN '[' ELSE '' END, coalesce(text, ''))"


@query(f"""WITH f AS (SELECT doc_id, lower(regexp_extract({_FILE}, '(\\.[^./]+)$', 1)) AS e, {_CONTENT} AS c FROM documents),
g AS (SELECT doc_id, e, c, CASE WHEN strlen(c) > 9000 THEN 'too_large' WHEN e NOT IN ('.pdf', '.docx', '.doc', '.txt', '.md', '.json', '.csv') THEN 'extension_not_allowed' END AS error FROM f)
SELECT doc_id, error, CASE WHEN error IS NULL THEN CASE WHEN starts_with(c, '%PDF') THEN 'application/pdf' WHEN starts_with(c, '[') OR starts_with(c, '{{' || chr(10)) OR starts_with(c, '{{' || chr(13) || chr(10)) THEN 'application/json' WHEN e = '.pdf' THEN 'application/pdf'
WHEN e = '.docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN e = '.doc' THEN 'application/msword' WHEN e = '.txt' THEN 'text/plain' WHEN e = '.md' THEN 'text/markdown' WHEN e = '.csv' THEN 'text/csv' END END AS mime FROM g""")
def file_admission(spark, sf_dir):
    files = read(spark, sf_dir, "documents").select("doc_id", admitted(F.expr(_FILE), F.expr(_CONTENT), 9000).alias("x"))
    return files.select("doc_id", "x.error", "x.mime")


@query(f"SELECT tenant, count(*) AS asked, count(j.job) AS found, count(*) - count(j.job) AS not_found FROM (SELECT DISTINCT l_orderkey AS job, l_suppkey % 5 AS tenant FROM lineitem WHERE l_discount >= 0.05) r LEFT JOIN ({_JOBS}) j USING (job, tenant) GROUP BY tenant")
def tenant_point_lookups(spark, sf_dir):
    """jobs asked for by id and tenant; another tenant's job isn't found."""
    asked = read(spark, sf_dir, "lineitem").where("l_discount >= 0.05").select(F.col("l_orderkey").alias("job"), (F.col("l_suppkey") % 5).alias("tenant")).distinct()
    known = jobs(spark, sf_dir).select("job", "tenant", F.lit(1).alias("there"))
    return asked.join(known, ["job", "tenant"], "left").groupBy("tenant").agg(F.count("*").alias("asked"), F.count("there").alias("found"), (F.count("*") - F.count("there")).alias("not_found"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') AND p_size > 30 AND p_type = 'ECONOMY'")
def search_review_list(spark, sf_dir):
    size = F.col("p_size")
    status = F.when(size > 40, "failed").when(size > 30, "rejected").otherwise("approved")
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_name", F.upper("p_name").alias("name"), F.col("p_type").alias("template"), status.alias("status"))
    return searched(rows, "Ring", "failed", "ECONOMY").select("p_partkey", "p_name")


@query("SELECT o_custkey AS batch, count(*) AS total, least(count(*), 8) AS succeeded, greatest(count(*) - 8, 0) AS failed, coalesce(min(CASE WHEN r > 8 THEN o_orderkey END), -1) AS first_rejected FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) GROUP BY o_custkey")
def batch_cap_summary(spark, sf_dir):
    """What goes beyond a batch's cap comes back as errors; totals of a batch."""
    rows = capped(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], 8)
    bad = F.col("error").isNotNull()
    return rows.groupBy(F.col("o_custkey").alias("batch")).agg(F.count("*").alias("total"), F.count_if(~bad).alias("succeeded"), F.count_if(bad).alias("failed"), F.coalesce(F.min(F.when(bad, F.col("o_orderkey"))), F.lit(-1)).alias("first_rejected"))


@query("SELECT c_custkey AS report, o_orderstatus AS status, count(*) AS jobs, CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS total FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
def report_job_ids(spark, sf_dir):
    """A report names its jobs in an array; they are exploded and looked up by a shuffled join."""
    reports = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("report")).agg(F.collect_list("o_orderkey").alias("job_ids"))
    reports = reports.join(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("report")), "report", "left_semi")
    found = reports.select("report", F.explode("job_ids").alias("o_orderkey")).join(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderkey")
    return found.groupBy("report", F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("jobs"), F.sum(F.round("o_totalprice").cast("long")).alias("total"))


@query("SELECT l_orderkey AS job, count(CASE WHEN l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 60 DAY THEN 1 END) AS inside, count(CASE WHEN l_shipdate NOT BETWEEN o_orderdate AND o_orderdate + INTERVAL 60 DAY THEN 1 END) AS outside FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def incidents_in_period(spark, sf_dir):
    """Incidents against their own report's period."""
    reports = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate").join(reports, F.col("l_orderkey") == F.col("o_orderkey"))
    inside = F.col("l_shipdate").between(F.col("o_orderdate"), F.col("o_orderdate") + F.expr("interval 60 days"))
    return rows.groupBy(F.col("l_orderkey").alias("job")).agg(F.count_if(inside).alias("inside"), F.count_if(~inside).alias("outside"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal < 0)")
def membership_exists(spark, sf_dir):
    """J13."""
    members = read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING' and c_acctbal < 0").select(F.col("c_nationkey").alias("s_nationkey"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey").join(members, "s_nationkey", "left_semi").select("s_suppkey", "s_name")


_LEVEL = "CASE {} WHEN 'owner' THEN 3 WHEN 'admin' THEN 2 WHEN 'viewer' THEN 1 ELSE 0 END"
_ROLE = "CASE c_mktsegment WHEN 'BUILDING' THEN 'owner' WHEN 'MACHINERY' THEN 'admin' WHEN 'HOUSEHOLD' THEN 'viewer' ELSE 'guest' END"
_NEEDED = "CASE WHEN c_acctbal < 0 THEN 'owner' WHEN c_acctbal < 3000 THEN 'admin' WHEN c_acctbal < 6000 THEN 'viewer' ELSE 'nobody' END"


@query(f"SELECT c_custkey, {_LEVEL.format(_ROLE)} >= {_LEVEL.format(_NEEDED)} AS allowed FROM customer")
def role_permission(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", role_allows(F.expr(_ROLE), F.expr(_NEEDED)).alias("allowed"))


@query("WITH m AS (SELECT DISTINCT date_trunc('month', o_orderdate) AS m FROM orders), d AS (SELECT m, CAST(unnest(generate_series(m, CAST(last_day(m) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d FROM m), r AS (SELECT m, day(d) AS day, (isodow(CAST(m AS DATE)) - 1 + day(d) - 1) // 7 AS week, isodow(d) AS dow FROM d) SELECT strftime(m, '%Y-%m') AS month, CAST(week AS INTEGER) AS week, CAST(sum(day * CAST(pow(100, dow - 1) AS BIGINT)) AS BIGINT) AS cells, count(*) AS days FROM r GROUP BY 1, 2")
def calendar_grid(spark, sf_dir):
    """The weeks of each month with jobs, Monday first; the days of a week as two digits each, 0 where the month has none there."""
    months = read(spark, sf_dir, "orders").select(F.trunc(F.to_date("o_orderdate"), "month").alias("m")).distinct()
    blank = F.weekday("m")
    cells = F.concat(F.array_repeat(F.lit(0), blank), F.sequence(F.lit(1), F.day(F.last_day("m"))))
    weeks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(cells) / 7).cast("int") - 1), lambda w: F.struct(w.alias("week"), F.slice(cells, w * 7 + 1, 7).alias("days")))
    rows = months.select("m", F.explode(weeks).alias("w")).select("m", "w.week", "w.days")
    packed = F.aggregate(F.transform("days", lambda d, i: d.cast("long") * F.pow(F.lit(100), i).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(F.date_format("m", "yyyy-MM").alias("month"), "week", packed.alias("cells"), F.size(F.filter("days", lambda d: d > 0)).cast("long").alias("days"))


@query("SELECT event_id FROM events WHERE event_type = 'click' AND ts < TIMESTAMP '2024-01-15' - INTERVAL 2 HOUR")
def stuck_documents(spark, sf_dir):
    """F8: documents that have been processed for more than two hours, seen from a fixed time."""
    old = F.col("ts") < F.expr("timestamp_ntz'2024-01-15 00:00:00' - interval 2 hours")
    return read(spark, sf_dir, "events").where((F.col("event_type") == "click") & old).select("event_id")


@query(f"SELECT tenant, strftime(created_at, '%Y-%m-%d') AS day, count(*) AS jobs FROM ({_JOBS}) WHERE status IN ('approved', 'aggregated', 'ready_for_review') GROUP BY 1, 2")
def reportable_jobs(spark, sf_dir):
    """F5."""
    rows = jobs(spark, sf_dir).where(F.col("status").isin("approved", "aggregated", "ready_for_review"))
    return rows.groupBy("tenant", F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("jobs"))


@query(f"SELECT job, d.source AS document, coalesce(p.p_brand, 'none') AS template FROM ({_JOBS}) j LEFT JOIN documents d ON d.doc_id = j.job LEFT JOIN part p ON p.p_partkey = j.batch * 3")
def job_names(spark, sf_dir):
    """A job with its document and its template, either of which may be missing."""
    documents = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("job"), F.col("source").alias("document"))
    templates = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("template"))
    rows = jobs(spark, sf_dir).select("job", "batch").join(documents, "job", "left").join(templates, F.col("batch") * 3 == F.col("key"), "left")
    return rows.select("job", "document", F.coalesce("template", F.lit("none")).alias("template"))


@query("SELECT c_custkey AS member, s_name AS name, c_mktsegment AS role FROM customer JOIN supplier ON s_suppkey = c_custkey - 40 WHERE c_mktsegment <> 'HOUSEHOLD'")
def role_members(spark, sf_dir):
    """Roles with their users; a role whose user is gone is left out."""
    roles = read(spark, sf_dir, "customer").where("c_mktsegment <> 'HOUSEHOLD'").select(F.col("c_custkey").alias("member"), F.col("c_mktsegment").alias("role"))
    users = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("user"), F.col("s_name").alias("name"))
    return roles.join(users, F.col("member") - 40 == F.col("user")).select("member", "name", "role")
