"""Queries whose rows a stream makes; each runs over all files there are and ends."""

from pyspark.sql import functions as F

from tallyforge.operators.lifecycle import TRANSITIONS, transitions
from tallyforge.plans.registry import query, read
from tallyforge.streaming.intake import Intake
from tallyforge.streaming.jobs import STEPS, closed_batches, daily_counts, event_stream, run_once, shared_folder, state_machine, without_repeats


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_daily_window(spark, sf_dir):
    out = run_once(daily_counts(event_stream(spark, sf_dir)), "complete")
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("SELECT user_id, event_type FROM events GROUP BY 1, 2")
def stream_dedup(spark, sf_dir):
    return run_once(without_repeats(event_stream(spark, sf_dir), ["user_id", "event_type"])).select("user_id", "event_type")


def _may(old: str, to: str) -> str:
    return f"({old} = {to} OR " + " OR ".join(f"({old} = '{x}' AND {to} IN ({', '.join(repr(y) for y in ys)}))" for x, ys in TRANSITIONS.items() if ys) + ")"


_STEPS = f"""WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, CASE event_type WHEN 'view' THEN 'processing' WHEN 'click' THEN 'extracted' WHEN 'purchase' THEN 'approved' ELSE 'failed' END AS b FROM events),
r AS (SELECT user_id, event_id, k, 'pending' AS a, b FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.event_id, e.k, CASE WHEN {_may('r.a', 'r.b')} THEN r.b ELSE r.a END, e.b FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id, event_id, a AS from_state, b AS to_state, {_may('a', 'b')} AS valid FROM r"""


@query(_STEPS)
def stream_state_machine(spark, sf_dir):
    """M2 over a stream: transitions of each job in order, those that aren't allowed marked."""
    return state_machine(event_stream(spark, sf_dir)).drop("late")


_MINUTES = 20_160

_CLOSES = f"""WITH RECURSIVE e AS (SELECT user_id AS batch, epoch_us(ts) AS t, event_id AS tie, CAST(event_id % 3 AS INTEGER) AS job, CASE event_type WHEN 'view' THEN 'processing' WHEN 'click' THEN 'rejected' WHEN 'purchase' THEN 'approved' WHEN 'signup' THEN 'ready_for_review' ELSE 'failed' END AS status FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY t, tie NULLS LAST) AS k FROM (SELECT * FROM e UNION ALL SELECT batch, min(t) + {_MINUTES * 60_000_000}, NULL, NULL, NULL FROM e GROUP BY batch)),
s AS (SELECT *, CASE WHEN job = 0 THEN status END AS a, CASE WHEN job = 1 THEN status END AS b, CASE WHEN job = 2 THEN status END AS c FROM o),
r AS (SELECT batch, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS t, CAST(NULL AS VARCHAR) AS a, CAST(NULL AS VARCHAR) AS b, CAST(NULL AS VARCHAR) AS c, false AS passed, false AS closes, false AS forced FROM (SELECT DISTINCT batch FROM e)
  UNION ALL SELECT batch, k, t, a, b, c, passed, passed OR settled, NOT settled FROM (SELECT *, (a IS NULL OR a IN {{0}}) AND (b IS NULL OR b IN {{0}}) AND (c IS NULL OR c IN {{0}}) AS settled FROM
    (SELECT s.batch, s.k, s.t, coalesce(s.a, CASE WHEN r.closes AND r.a = 'approved' THEN 'aggregated' ELSE r.a END) AS a, coalesce(s.b, CASE WHEN r.closes AND r.b = 'approved' THEN 'aggregated' ELSE r.b END) AS b, coalesce(s.c, CASE WHEN r.closes AND r.c = 'approved' THEN 'aggregated' ELSE r.c END) AS c, r.passed OR s.job IS NULL AS passed FROM r JOIN s ON s.batch = r.batch AND s.k = r.k + 1)))
SELECT batch, 'daily' AS template, t AS closed_at, '0' AS jobs, forced FROM r WHERE closes AND a = 'approved'
UNION ALL SELECT batch, 'weekly', t, CASE WHEN b = 'approved' AND c = 'approved' THEN '1,2' WHEN b = 'approved' THEN '1' ELSE '2' END, forced FROM r WHERE closes AND (b = 'approved' OR c = 'approved')""".format("('approved', 'rejected', 'aggregated', 'failed')")


@query(_CLOSES)
def stream_batch_closer(spark, sf_dir):
    """R3 over a stream: each close of a batch, once a template, with the jobs that are aggregated from then on."""
    closes = closed_batches(event_stream(spark, sf_dir), _MINUTES)
    return closes.where("not late").select("batch", "template", "closed_at", F.array_join(F.col("jobs").cast("array<string>"), ",").alias("jobs"), "forced")


@query(_STEPS)
def state_machine_audit(spark, sf_dir):
    """M2 over a table."""
    events = read(spark, sf_dir, "events")
    to = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in STEPS.items()), F.lit("failed"))
    told = transitions(events.select(F.col("user_id").alias("job"), F.col("ts").alias("at"), F.col("event_id").alias("tie"), to.alias("to")))
    return told.select(F.col("job").alias("user_id"), F.col("tie").alias("event_id"), "from_state", "to_state", "valid")


@query("SELECT count(*) AS n, count(DISTINCT user_id) AS jobs FROM events")
def stream_input_audit(spark, sf_dir):
    return read(spark, sf_dir, "events").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("jobs"))


@query("SELECT source AS tenant, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path, lpad(CAST(min(doc_id) OVER (PARTITION BY source, md5(text)) AS VARCHAR), 12, '0') AS first_path, doc_id = min(doc_id) OVER (PARTITION BY source, md5(text)) AS is_new FROM documents WHERE source IS NOT NULL")
def stream_intake_history(spark, sf_dir):
    """Documents that come in four polls, in order; each gets the first of its content in its source, from whichever poll."""
    docs = read(spark, sf_dir, "documents")
    files = docs.select(F.col("source").alias("tenant"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.md5("text").alias("checksum"), "doc_id")
    run = Intake(spark, shared_folder(spark))
    ends = docs.agg(F.percentile_approx("doc_id", [0.25, 0.5, 0.75]).alias("q")).first().q or []
    for poll, (low, high) in enumerate(zip([None, *ends], [*ends, None], strict=True)):
        after = F.lit(True) if low is None else F.col("doc_id") > low
        run.poll(files.where(after & (F.lit(True) if high is None else F.col("doc_id") <= high)), poll)
    return run.taken().select("tenant", "path", "first_path", "is_new")
