"""Job lifecycle (survey rows M1, M2, M6, F7, F14, R3, W9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The states that may follow each state.
TRANSITIONS = {
    "pending": ("processing", "failed"), "processing": ("extracted", "failed"), "extracted": ("enriching", "ready_for_review", "failed"), "enriching": ("ready_for_review", "failed"),
    "ready_for_review": ("approved", "rejected"), "approved": ("aggregated",), "rejected": ("pending",), "aggregated": (), "failed": ("pending",),
}
TERMINAL = ("ready_for_review", "approved", "rejected", "aggregated", "failed")


def allowed(old: Column, new: Column) -> Column:
    """Whether a job may go from one state to another; staying is allowed, and any may be the first."""
    step = F.lit(False)
    for state, following in TRANSITIONS.items():
        if following:
            step = step | ((old == state) & new.isin(*following))
    return old.isNull() | (old == new) | step


def audit(events: DataFrame, job: str, state: str, at: str, tie: str) -> DataFrame:
    """Each event with the state before it, whether the step is allowed, and the seconds spent in that state."""
    order = Window.partitionBy(job).orderBy(at, tie)
    before = F.lag(state).over(order)
    seconds = F.unix_timestamp(F.col(at).cast("timestamp")) - F.unix_timestamp(F.lag(at).over(order).cast("timestamp"))
    return events.select("*", before.alias("from_state"), allowed(before, F.col(state)).alias("valid"), seconds.alias("dwell_s"))


#: Marks of errors that are not, and that are, worth another try.
FINAL_MARKS = ["resource_exhausted", "quota exceeded", "too many requests", " 429 ", "validation error for", "err_schema_validation", "thoi_gian không đúng định dạng", "value error", "job not found", "extraction job", "template not found", "document not found", "template or document not found", "json_parse_error", "soft time limit exceeded"]
TRANSIENT_MARKS = ["timeout", "temporarily unavailable", "connection reset", "connection aborted", "connection refused", "service unavailable", "bad gateway", "gateway timeout", "network"]


def retriable(message: Column) -> Column:
    """Final marks are looked at first."""
    text = F.lower(message)
    has = lambda marks: F.exists(F.array(*map(F.lit, marks)), lambda m: text.contains(m))
    return ~has(FINAL_MARKS) & has(TRANSIENT_MARKS)


#: Kinds of errors by their type, then by words in their text.
DATA_TYPES, SYSTEM_TYPES = ("ValidationError",), ("RequestException", "TimeoutError")
DATA_WORDS, SYSTEM_WORDS = ("validation", "schema", "pydantic", "json"), ("timeout", "connection", "rate limit", "503", "502", "network")


def error_class(kind: Column, message: Column) -> Column:
    """M7: data, system or logic error; null where there is none."""
    text = F.lower(F.coalesce(message, F.lit("")))
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: text.contains(w))
    none = kind.isNull() & message.isNull()
    return F.when(none, None).when(kind.isin(*DATA_TYPES), "AI_OR_DATA_ERROR").when(kind.isin(*SYSTEM_TYPES), "SYSTEM_ERROR").when(has(DATA_WORDS), "AI_OR_DATA_ERROR").when(has(SYSTEM_WORDS), "SYSTEM_ERROR").otherwise("LOGIC_ERROR")


def stage1_events(results: DataFrame) -> DataFrame:
    """M3: the transitions that a first extraction's results (job, ok, detail) make, in order: (job, step, from_state, to_state, enrichment)."""
    detail = F.coalesce(F.col("detail"), F.lit("")) != ""
    event = lambda step, old, new, enrichment: F.struct(F.lit(step).alias("step"), F.lit(old).alias("from_state"), new.alias("to_state"), enrichment.alias("enrichment"))
    none = F.lit(None).cast("string")
    good = F.array(event(1, "processing", F.lit("extracted"), none), event(2, "extracted", F.when(detail, "enriching").otherwise("ready_for_review"), F.when(detail, "pending").otherwise("skipped")))
    bad = F.array(event(1, "processing", F.lit("failed"), F.lit("skipped")))
    return results.select("job", F.explode(F.when(F.col("ok"), good).otherwise(bad)).alias("e")).select("job", "e.*")


def enriched(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """M4: ``jobs`` (job, status) with what an enrichment (job, items, error) makes of those that are enriching; the others stay as they are.

    An error is kept (2000 characters at most, as the record has), items are, or it was skipped; the job is ready for review in each case.
    """
    both = jobs.join(results.withColumn("answered", F.lit(True)), "job", "left")
    on = (F.col("status") == "enriching") & F.coalesce("answered", F.lit(False))
    outcome = F.when(F.coalesce("error", F.lit("")) != "", "failed").when(F.col("items").isNotNull(), "enriched").otherwise("skipped")
    return both.select("job", F.when(on, "ready_for_review").otherwise(F.col("status")).alias("status"), F.when(on, outcome).alias("enrichment"), F.when(on & (outcome == "failed"), F.substring("error", 1, 2000)).alias("error"), F.when(on & (outcome == "enriched"), F.col("items")).alias("items"))


def reviewed(jobs: DataFrame, actions: DataFrame) -> DataFrame:
    """M5: what each action (job, action) does to a job (job, status): (job, action, to_state, error). Approval and rejection need a job ready for review, another try one that failed or was rejected, deletion one at rest."""
    both = actions.join(jobs, "job", "left")
    a, s = F.col("action"), F.col("status")
    fits = ((a.isin("approve", "reject")) & (s == "ready_for_review")) | ((a == "retry") & s.isin("failed", "rejected")) | ((a == "delete") & s.isin(*TERMINAL))
    to = F.when(a == "approve", "approved").when(a == "reject", "rejected").when(a == "retry", "pending").when(a == "delete", "deleted")
    error = F.when(s.isNull(), "not_found").when(~F.coalesce(fits, F.lit(False)), F.concat(F.lit("cannot "), a, F.lit(" a job that is "), s))
    return both.select("job", "action", F.when(error.isNull(), to).alias("to_state"), error.alias("error"))


def bounded_trace(rows: DataFrame, key: str, order: list[str], entry: Column, most: int = 100) -> DataFrame:
    """Of each key the last ``most`` entries (the feature), in order. Only these are gathered, however many there are."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(c) for c in order)))
    last = rows.withColumn("_entry", entry).withColumn("_r", place).where(F.col("_r") <= most)
    return last.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_r")).alias("r"), "_entry"))), lambda x: x["_entry"]).alias("trace"))


_STATES = list(TRANSITIONS)


def _may() -> Column:
    """For each state to go to, whether each state may go there (or is it)."""
    return F.array(*(F.array(*(F.lit(to == old or to in TRANSITIONS[old]) for old in _STATES)) for to in _STATES))


def _number_of(state: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, _STATES)), state).cast("int") - 1


def transitions(events: DataFrame, initial: DataFrame | None = None, slice_: str = "hour", block: int = 256) -> DataFrame:
    """M2: ``events`` (job, at, tie, to) in order, each with the state before it (``from_state``) and whether it is ``valid``; a step that isn't leaves the job where it is.

    A step is a map from each state to the next. Events are cut into blocks (a slice of time, and ``block`` events of it); the maps of a
    block are composed to one, a job's blocks are folded in order to tell each block's first state, and each block's events are told from it. So
    no more of a job than a block, or one map a block, is ever in one row, however many events it has. ``initial`` (job, state): where jobs
    stand before; they begin as pending elsewhere.
    """
    at = F.date_trunc(slice_, "at")
    rows = events.select("job", at.alias("slice"), "at", "tie", _number_of(F.col("to")).alias("to"))
    place = F.row_number().over(Window.partitionBy("job", "slice").orderBy("at", "tie"))
    rows = rows.withColumn("block", ((place - 1) / block).cast("int"))
    blocks = rows.groupBy("job", "slice", "block").agg(F.array_sort(F.collect_list(F.struct("at", "tie", "to"))).alias("steps")).withColumn("may", _may())
    go = lambda s, to: F.when(F.col("may")[to][s], to).otherwise(s)
    identity = F.sequence(F.lit(0), F.lit(len(_STATES) - 1))
    whole = F.aggregate("steps", identity, lambda acc, step: F.transform(acc, lambda s: go(s, step["to"])))
    maps = blocks.select("job", "slice", "block", whole.alias("whole")).groupBy("job").agg(F.array_sort(F.collect_list(F.struct("slice", "block", "whole"))).alias("maps"))
    if initial is not None:
        maps = maps.join(initial.select("job", _number_of(F.col("state")).alias("begun")), "job", "left")
    begun = F.coalesce("begun", F.lit(0)) if initial is not None else F.lit(0)
    seen = F.aggregate("maps", F.struct(begun.alias("now"), F.array().cast("array<int>").alias("starts")), lambda acc, m: F.struct(m["whole"][acc["now"]].alias("now"), F.concat(acc["starts"], F.array(acc["now"])).alias("starts")), lambda acc: acc["starts"])
    starts = maps.select("job", F.explode(F.arrays_zip(F.transform("maps", lambda m: m["slice"]).alias("slice"), F.transform("maps", lambda m: m["block"]).alias("block"), seen.alias("start"))).alias("x")).select("job", "x.*")
    out = F.struct(F.col("start").alias("now"), F.array().cast("array<int>").alias("before"))
    told = F.aggregate("steps", out, lambda acc, step: F.struct(go(acc["now"], step["to"]).alias("now"), F.concat(acc["before"], F.array(acc["now"])).alias("before")), lambda acc: acc["before"])
    each = blocks.join(starts, ["job", "slice", "block"]).select("job", "may", F.explode(F.arrays_zip("steps", told.alias("before"))).alias("x"))
    name = lambda i: F.array(*map(F.lit, _STATES))[i]
    return each.select("job", "x.steps.at", "x.steps.tie", name(F.col("x.before")).alias("from_state"), name(F.col("x.steps.to")).alias("to_state"), F.col("may")[F.col("x.steps.to")][F.col("x.before")].alias("valid"))


def last_states(told: DataFrame) -> DataFrame:
    """(job, state) after the events of ``transitions``."""
    after = F.when(F.col("valid"), F.col("to_state")).otherwise(F.col("from_state"))
    return told.groupBy("job").agg(F.max_by(after, F.struct("at", "tie")).alias("state"))
