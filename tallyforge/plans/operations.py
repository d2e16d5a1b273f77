"""Validation, job lifecycle and operational queries. Roles: an event is a transition, an order a job."""

from pyspark.sql import functions as F

from tallyforge.operators.lifecycle import audit, retriable
from tallyforge.plans.aggregates import _PIVOT, stat_pivot_named
from tallyforge.plans.registry import query, read

_TYPES = "CASE event_type WHEN 'view' THEN 'processing' WHEN 'click' THEN 'extracted' WHEN 'purchase' THEN 'approved' ELSE 'failed' END"
_OK = " OR ".join(f"(a = '{x}' AND b IN ({y}))" for x, y in {"processing": "'extracted', 'failed'", "extracted": "'enriching', 'ready_for_review', 'failed'", "approved": "'aggregated'", "failed": "'pending'"}.items())


@query(f"SELECT event_id, a AS from_state, b AS state, a IS NULL OR a = b OR {_OK} AS valid, dwell_s FROM (SELECT event_id, {_TYPES} AS b, lag({_TYPES}) OVER w AS a, CAST(floor(epoch(ts)) - floor(epoch(lag(ts) OVER w)) AS BIGINT) AS dwell_s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))")
def transition_audit(spark, sf_dir):
    t = F.col("event_type")
    state = F.when(t == "view", "processing").when(t == "click", "extracted").when(t == "purchase", "approved").otherwise("failed")
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", state.alias("state"))
    return audit(events, "user_id", "state", "ts", "event_id").select("event_id", "from_state", "state", "valid", "dwell_s")


_AS_OF = "1998-08-02"


#: Days after which a job is stuck in each of three states.
_LIMITS = {"O": 600, "P": 300, "F": 1500}


@query(f"SELECT o_orderkey, o_orderstatus AS was FROM orders WHERE {' OR '.join(f"(o_orderstatus = '{s}' AND o_orderdate < TIMESTAMP '{_AS_OF}' - INTERVAL {n} DAY)" for s, n in _LIMITS.items())}")
def stuck_jobs(spark, sf_dir):
    """jobs too long in one of three states, each with its own limit, seen from a fixed time; the condition is pushed to the scan."""
    old = lambda n: F.col("o_orderdate") < F.expr(f"timestamp_ntz'{_AS_OF} 00:00:00' - interval {n} days")
    stuck = F.lit(False)
    for state, days in _LIMITS.items():
        stuck = stuck | ((F.col("o_orderstatus") == state) & old(days))
    return read(spark, sf_dir, "orders").where(stuck).select("o_orderkey", F.col("o_orderstatus").alias("was"))


@query("SELECT o_custkey AS batch, count(*) AS jobs, bool_and(o_orderstatus IN ('F', 'P')) AS all_done, strftime(min(o_orderdate), '%Y-%m-%d') AS oldest FROM orders GROUP BY 1 HAVING (bool_and(o_orderstatus IN ('F', 'P')) OR min(o_orderdate) < TIMESTAMP '1993-01-01') AND count(CASE WHEN o_orderstatus = 'F' THEN 1 END) >= 1")
def batch_closer_candidates(spark, sf_dir):
    batches = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("batch")).agg(F.count("*").alias("jobs"), F.bool_and(F.col("o_orderstatus").isin("F", "P")).alias("all_done"), F.min("o_orderdate").alias("m"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    ready = batches.where("(all_done or m < timestamp_ntz'1993-01-01 00:00:00') and f >= 1")
    return ready.select("batch", "jobs", "all_done", F.date_format("m", "yyyy-MM-dd").alias("oldest"))


@query("SELECT event_id, event_id % 5 IN (0, 3) AS retry FROM events")
def retry_classification(spark, sf_dir):
    said = F.array(*map(F.lit, ["Read TIMEOUT after 30 s", "HTTP 429 too many requests: timeout", "division by zero", "Bad Gateway from upstream", "Template not found; network"]))
    return read(spark, sf_dir, "events").select("event_id", retriable(F.element_at(said, (F.col("event_id") % 5).cast("int") + 1)).alias("retry"))


@query("SELECT event_type AS metric, count(*) AS n, CAST(round(sum(CAST(round(value * 100) AS BIGINT)) / count(*)) AS BIGINT) AS mean_cents FROM events WHERE value IS NOT NULL GROUP BY 1")
def pipeline_metrics(spark, sf_dir):
    rows = read(spark, sf_dir, "events").where("value is not null")
    return rows.groupBy(F.col("event_type").alias("metric")).agg(F.count("*").alias("n"), F.round(F.sum(F.round(F.col("value") * 100).cast("long")) / F.count("*")).cast("long").alias("mean_cents"))


@query("SELECT o_orderkey, code FROM (SELECT o_orderkey, CASE WHEN o_totalprice IS NULL THEN 'missing_price' END AS a, CASE WHEN o_totalprice < 1000 THEN 'price_out_of_range' END AS b, CASE WHEN o_orderkey % 10 = 3 THEN 'invalid_so_bao_cao_format' END AS c, CASE WHEN year(o_orderdate) NOT BETWEEN 1993 AND 1997 THEN 'date_year_out_of_range' END AS d FROM orders), LATERAL (SELECT unnest([a, b, c, d]) AS code) WHERE code IS NOT NULL")
def validation_codes(spark, sf_dir):
    """Each broken rule of each record as a row."""
    number = F.concat("o_orderkey", F.when(F.col("o_orderkey") % 10 == 3, "-BC").otherwise("/BC-KV30"))
    rules = F.array(
        F.when(F.col("o_totalprice").isNull(), "missing_price"), F.when(F.col("o_totalprice") < 1000, "price_out_of_range"),
        F.when(~number.rlike(r"^\d+/BC-.+"), "invalid_so_bao_cao_format"), F.when(~F.year("o_orderdate").between(1993, 1997), "date_year_out_of_range"),
    )
    return read(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.filter(rules, lambda c: c.isNotNull())).alias("code"))


@query(f"SELECT report, code FROM (SELECT report, [CASE WHEN stt_01 IS NULL THEN 'missing_stt:1' END, CASE WHEN stt_04 IS NULL THEN 'missing_stt:4' END, CASE WHEN coalesce(stt_01, 0) <> coalesce(stt_02, 0) + coalesce(stt_03, 0) THEN 'formula_mismatch:stt1!=stt2+stt3' END, CASE WHEN coalesce(stt_04, 0) <> coalesce(stt_05, 0) + coalesce(stt_06, 0) + coalesce(stt_07, 0) THEN 'formula_mismatch:stt4!=sum(stt5..stt7)' END] AS codes FROM ({_PIVOT})), LATERAL (SELECT unnest(codes) AS code) WHERE code IS NOT NULL")
def invariant_codes(spark, sf_dir):
    v = lambda n: F.coalesce(f"stt_{n:02d}", F.lit(0))
    rules = F.array(
        F.when(F.col("stt_01").isNull(), "missing_stt:1"), F.when(F.col("stt_04").isNull(), "missing_stt:4"),
        F.when(v(1) != v(2) + v(3), "formula_mismatch:stt1!=stt2+stt3"), F.when(v(4) != v(5) + v(6) + v(7), "formula_mismatch:stt4!=sum(stt5..stt7)"),
    )
    return stat_pivot_named(spark, sf_dir).select("report", F.explode(F.filter(rules, lambda c: c.isNotNull())).alias("code"))


@query("SELECT doc_id, code FROM (SELECT doc_id, [CASE WHEN n_chars < 200 THEN 'hallucination_total_without_evidence:n_chars' END, CASE WHEN quality IS NULL THEN 'missing_required_field:quality' END, CASE WHEN NOT regexp_matches(source, '[0-9]') THEN 'invalid_document_item_code_no_digit' END] AS codes FROM documents LEFT JOIN labels USING (doc_id)), LATERAL (SELECT unnest(codes) AS code) WHERE code IS NOT NULL")
def safety_codes(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "n_chars", "source").join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    rules = F.array(
        F.when(F.col("n_chars") < 200, "hallucination_total_without_evidence:n_chars"), F.when(F.col("quality").isNull(), "missing_required_field:quality"),
        F.when(~F.col("source").rlike(r"\d"), "invalid_document_item_code_no_digit"),
    )
    return docs.select("doc_id", F.explode(F.filter(rules, lambda c: c.isNotNull())).alias("code"))


@query("SELECT o_orderkey, n AS present, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS missing, CASE WHEN n >= 6 THEN 'warning' ELSE 'error' END AS severity FROM (SELECT o_orderkey, count(DISTINCT l_linenumber) AS n, list(DISTINCT l_linenumber) AS held FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1), (SELECT unnest(range(1, 8))::INTEGER AS c) WHERE NOT coalesce(list_contains(held, c), false) GROUP BY 1, 2, 4")
def completeness_warnings(spark, sf_dir):
    """Codes that a job lacks; an order without lines lacks all."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("held"))
    jobs = read(spark, sf_dir, "orders").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("held", F.coalesce("held", F.array().cast("array<int>")))
    lacking = F.array_except(F.sequence(F.lit(1), F.lit(7)), "held")
    rows = jobs.where(F.size(lacking) > 0)
    return rows.select("o_orderkey", F.size("held").cast("long").alias("present"), F.array_join(lacking.cast("array<string>"), ",").alias("missing"), F.when(F.size("held") >= 6, "warning").otherwise("error").alias("severity"))


@query("SELECT status_group, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM orders), 1) AS percent FROM (SELECT CASE WHEN o_orderstatus IN ('F', 'P') THEN 'done' ELSE 'open' END AS status_group FROM orders) GROUP BY 1")
def status_groups(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").groupBy(F.when(F.col("o_orderstatus").isin("F", "P"), "done").otherwise("open").alias("status_group")).agg(F.count("*").alias("n"))
    total = orders.agg(F.sum("n").alias("t"))
    return orders.crossJoin(total).select("status_group", "n", F.round(100.0 * F.col("n") / F.col("t"), 1).cast("double").alias("percent"))
