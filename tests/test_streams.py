"""Streams with state: the same rows for any split of the log, late events apart, restarts that lose and repeat nothing."""

import random
import sys
from datetime import datetime, timedelta, timezone

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tallyforge.operators.lifecycle import TRANSITIONS
from tallyforge.streaming import jobs
from tallyforge.streaming.ordered import SETTLED, Closer, Machine

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "job long, ts timestamp, tie long, to string"
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def log(n=240, keys=6, seed=1):
    rng = random.Random(seed)
    states = list(TRANSITIONS)
    likely = ["processing", "extracted", "ready_for_review", "approved", "aggregated", "pending", *states]
    return [(rng.choice([0, *range(keys)]), START + timedelta(minutes=i // 2 * 7), i, rng.choice(likely)) for i in range(n)]


def machine(rows):
    now, out = {}, []
    for job, _, tie, to in sorted(rows, key=lambda r: (r[1], r[2])):
        old = now.get(job, "pending")
        valid = to == old or to in TRANSITIONS[old]
        out.append((job, tie, old, to, valid))
        now[job] = to if valid else old
    return sorted(out)


def write(spark, folder, rows, files, shuffled=False, schema=SCHEMA):
    rows = sorted(rows, key=lambda r: r[1])
    size = -(-len(rows) // files)
    parts = [rows[k : k + size] for k in range(0, len(rows), size)]
    if shuffled:
        random.Random(9).shuffle(parts)
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))


def stream(spark, folder, a_trigger, schema=SCHEMA):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", a_trigger).parquet(str(folder))


@pytest.mark.parametrize(("files", "a_trigger", "late", "shuffled"), [(1, 1, "1 hour", False), (4, 1, "1 hour", False), (4, 64, "1 hour", True), (6, 1, "10 days", True), (6, 3, "10 days", True)])
def test_states_are_the_same_for_any_split(spark, tmp_path, files, a_trigger, late, shuffled):
    rows = log()
    write(spark, tmp_path / "in", rows, files, shuffled)
    told = jobs.replay(stream(spark, tmp_path / "in", a_trigger), "job", Machine(), late, str(tmp_path / "run")).collect()
    assert not any(r.late for r in told)
    assert sorted((r.job, r.tie, r.from_state, r.to_state, r.valid) for r in told) == machine(rows)


def test_what_comes_too_late_is_told_apart(spark, tmp_path):
    rows = log(60)
    write(spark, tmp_path / "in", rows[:50], 2)
    events = stream(spark, tmp_path / "in", 1)
    jobs.replay(events, "job", Machine(), "0 seconds", str(tmp_path / "run"), ended=False)
    late = [(0, START + timedelta(minutes=1), 1000, "processing"), (5, START, 1001, "failed")]
    write(spark, tmp_path / "in", late + rows[50:], 1)
    told = jobs.replay(events, "job", Machine(), "0 seconds", str(tmp_path / "run")).collect()
    assert sorted((r.job, r.tie, r.to_state) for r in told if r.late) == [(0, 1000, "processing"), (5, 1001, "failed")]
    assert sorted((r.job, r.tie, r.from_state, r.to_state, r.valid) for r in told if not r.late) == machine(rows)


class Breaking(Machine):
    """Fails as long as a file is there."""

    def __init__(self, flag):
        self.flag = flag

    def step(self, key, event):
        import os

        if event[1] == 150 and os.path.exists(self.flag):
            raise RuntimeError("broken")
        yield from super().step(key, event)


def test_a_run_that_broke_goes_on(spark, tmp_path):
    rows = log()
    write(spark, tmp_path / "in", rows, 4)
    flag = tmp_path / "flag"
    flag.write_text("")
    events, run = stream(spark, tmp_path / "in", 1), str(tmp_path / "run")
    with pytest.raises(Exception, match="broken"):
        jobs.replay(events, "job", Breaking(str(flag)), "1 hour", run)
    assert 0 < spark.read.schema("job long").parquet(f"{run}/rows").count() < len(rows)
    flag.unlink()
    told = jobs.replay(events, "job", Breaking(str(flag)), "1 hour", run).collect()
    assert sorted((r.job, r.tie, r.from_state, r.to_state, r.valid) for r in told) == machine(rows)


BATCH = "batch long, ts timestamp, tie long, job long, template string, status string"


def closes(rows, minutes):
    """What each batch closes, event by event, with its deadline between them."""
    out = []
    for batch in {r[0] for r in rows}:
        own = sorted((r[1], r[2], r) for r in rows if r[0] == batch)
        limit, held, passed = own[0][0] + timedelta(minutes=minutes), {}, False

        def close(at):
            settled = all(s in SETTLED for _, s in held.values())
            if settled or passed:
                for t in sorted({t for t, s in held.values() if s == "approved"}):
                    ids = sorted(j for j, (x, s) in held.items() if x == t and s == "approved")
                    out.append((batch, t, at, tuple(ids), not settled))
                    for j in ids:
                        held[j] = (t, "aggregated")

        for at, _, (_, _, _, job, template, status) in own:
            if not passed and limit < at:
                passed = True
                close(limit)
            held[job] = (template, status)
            close(at)
        if not passed:
            passed = True
            close(limit)
    return sorted(out)


@pytest.mark.parametrize(("files", "a_trigger"), [(1, 1), (5, 1), (5, 64)])
def test_batches_close_once_a_template(spark, tmp_path, files, a_trigger):
    rng = random.Random(3)
    status = ["processing", "approved", "approved", "rejected", "ready_for_review", "failed"]
    rows = []
    for batch in range(12):
        begin = START + timedelta(minutes=rng.randrange(500))
        for k in range(rng.randrange(1, 14)):
            job = rng.randrange(3)
            rows.append((batch, begin + timedelta(minutes=rng.randrange(0, 90)), batch * 100 + k, job, "ab"[job % 2], rng.choice(status)))
    write(spark, tmp_path / "in", rows, files, schema=BATCH)
    told = jobs.replay(stream(spark, tmp_path / "in", a_trigger, BATCH), "batch", Closer(60), "1 hour", str(tmp_path / "run")).collect()
    assert not any(r.late for r in told)
    got = sorted((r.batch, r.template, START + timedelta(microseconds=r.closed_at - int(START.timestamp() * 1e6)), tuple(r.jobs), r.forced) for r in told)
    want = closes(rows, 60)
    assert got == want
    assert any(w[4] for w in want) and any(not w[4] for w in want)


def test_state_holds_what_is_open(spark, tmp_path):
    """Events that are told leave the state."""
    write(spark, tmp_path / "in", log(400, keys=3), 8)
    events = jobs.in_order(stream(spark, tmp_path / "in", 1), "job", Machine(), "1 minute")
    q = events.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    q.awaitTermination()
    held = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in q.recentProgress]
    assert max(held) <= 120 and held[-1] <= 20


def test_events_of_a_key_wait_in_blocks(spark, tmp_path):
    """A trigger's events of a key are one value of state, of a key with very many some; whatever the block, the rows are the same."""
    rows = log(900, keys=3) + [(7, START + timedelta(minutes=k % 500), 10_000 + k, ("processing", "failed", "pending")[k % 3]) for k in range(9000)]
    rows += [(None, START, 30_000, "processing"), (None, START, 30_001, "approved")]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "in"))
    events, run = stream(spark, tmp_path / "in", 64), str(tmp_path / "run")
    jobs.replay(events, "job", Machine(), "10 days", run, ended=False)
    held = spark.read.format("statestore").option("path", f"{run}/log").option("stateVarName", "events").load()
    values = {r.job: r.n for r in held.groupBy("key.job").agg(F.count("*").alias("n")).collect()}
    assert set(values) == {0, 1, 2, 7, None}
    assert values[7] == 3
    assert max(n for job, n in values.items() if job != 7) == 1
    told = jobs.replay(events, "job", Machine(), "10 days", run).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = sorted(((r.job, r.tie, r.from_state, r.to_state, r.valid) for r in told), key=order)
    assert got == sorted(machine([r for r in rows if r[0] is not None]) + machine([r for r in rows if r[0] is None]), key=order)


def test_a_deadline_comes_when_nothing_waits(spark, tmp_path):
    """The events of a batch are told two triggers before its deadline passes."""
    for minutes, batch in ((0, 1), (30, 2), (120, 3), (121, 3)):
        rows = [(batch, START + timedelta(minutes=minutes), 10 * minutes + job, job, "ab"[job], ("processing", "approved")[job]) for job in range(2)]
        write(spark, tmp_path / "in", rows, 1, schema=BATCH)
    run = str(tmp_path / "run")
    told = jobs.replay(stream(spark, tmp_path / "in", 1, BATCH), "batch", Closer(60), "0 seconds", run, ended=False).collect()
    assert [(r.batch, r.template, r.jobs, r.forced, r.late) for r in sorted(told)] == [(1, "b", [1], True, False), (2, "b", [1], True, False)]
    assert {r.batch: r.closed_at - int(START.timestamp() * 1e6) for r in told} == {1: 3_600_000_000, 2: 5_400_000_000}
