"""Tables updated in place: what is touched, who reads what, writers that die or meet; reports from changes against reports of everything."""

import random
from datetime import date, datetime, timedelta

import pytest

from tallyforge.operators.incremental import Reports, distinct_details
from tallyforge.sources.versioned import Conflict, Versioned, merged

ROWS = "tenant long, week date, jobs long, created_by string"
W = [date(2024, 1, 1) + timedelta(weeks=k) for k in range(4)]


def table(spark, base):
    return Versioned(spark, str(base), ROWS, ["week"])


def rows(spark, *values):
    return spark.createDataFrame(list(values), ROWS)


def content(t):
    return sorted(map(tuple, t.read().collect()), key=repr)


def test_only_touched_partitions_are_rewritten(spark, tmp_path):
    t = table(spark, tmp_path)
    assert content(t) == []
    t.upsert(rows(spark, (1, W[0], 5, "a"), (2, W[0], 6, "a"), (1, W[1], 7, "a"), (1, None, 1, "a")), ["tenant", "week"], keep=("created_by",))
    first = {r.week: r.version for r in t.manifest().collect()}
    t.upsert(rows(spark, (1, W[1], None, "b"), (3, W[2], 1, "b"), (1, None, 2, "b")), ["tenant", "week"], keep=("created_by",))
    second = {r.week: r.version for r in t.manifest().collect()}
    assert content(t) == sorted([(1, W[0], 5, "a"), (2, W[0], 6, "a"), (1, W[1], None, "a"), (1, None, 2, "a"), (3, W[2], 1, "b")], key=repr)
    assert second[W[0]] == first[W[0]] and second[W[1]] != first[W[1]] and second[W[2]] == second[W[1]]
    t.vacuum()
    assert len(content(t)) == 5
    t.replace(spark.createDataFrame([(W[0],)], "week date"), rows(spark))
    assert W[0] not in {r.week for r in t.manifest().collect()} and len(content(t)) == 3


def test_a_writer_that_dies_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    t.upsert(rows(spark, (1, W[0], 5, "a")), ["tenant", "week"])
    before = content(t)
    reader = t.read()

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(Versioned, "_commit", killed)
    with pytest.raises(KeyboardInterrupt):
        t.upsert(rows(spark, (1, W[0], 9, "b"), (2, W[1], 1, "b")), ["tenant", "week"])
    assert content(t) == before == sorted(map(tuple, reader.collect()), key=repr)
    monkeypatch.undo()
    t.upsert(rows(spark, (1, W[0], 9, "b"), (2, W[1], 1, "b")), ["tenant", "week"])
    assert content(t) == [(1, W[0], 9, "b"), (2, W[1], 1, "b")]
    assert len(t.vacuum()) == 2  # the first version, and what the dead writer left


def test_of_two_writers_the_second_is_told(spark, tmp_path):
    t, other = table(spark, tmp_path), table(spark, tmp_path)
    t.upsert(rows(spark, (1, W[0], 5, "a")), ["tenant", "week"])
    begun = other._last()
    t.upsert(rows(spark, (1, W[0], 6, "a")), ["tenant", "week"])
    other._last = lambda: begun  # read before the other committed
    with pytest.raises(Conflict):
        other.upsert(rows(spark, (1, W[0], 7, "b")), ["tenant", "week"])
    assert content(t) == [(1, W[0], 6, "a")]


def test_nulls_replace_values(spark):
    old, new = spark.createDataFrame([(1, "x", "p")], "k int, v string, by string"), spark.createDataFrame([(1, None, None), (2, None, "q")], "k int, v string, by string")
    assert sorted(map(tuple, merged(old, new, ["k"], ("by",)).collect())) == [(1, None, "p"), (2, None, "q")]


JOBS = "job long, at timestamp_ntz, total long, place string, said string"


def test_reports_from_changes_equal_reports_of_everything(spark, tmp_path):
    rng = random.Random(6)
    start = datetime(2024, 1, 25)
    make = lambda job: (job, start + timedelta(hours=rng.randrange(24 * 30)), rng.choice([None, *range(9)]), rng.choice(["a", " a", "b", None]), rng.choice(["x", "y", ""]))
    now = {k: make(k) for k in range(60)}
    reports = Reports(spark, str(tmp_path / "kept"), ["total"], ["place", "said"])
    frame = lambda: spark.createDataFrame(list(now.values()), JOBS)
    reports.refresh(frame(), frame().select("at"))
    for turn in range(2):
        changed = []
        for k in rng.sample(sorted(now), 8):  # deletions and corrections
            changed.append(now.pop(k)[1])
            if rng.random() < 0.6:
                now[k] = make(k)
                changed.append(now[k][1])
        k = 100 + turn
        now[k] = make(k)
        changed.append(now[k][1])
        reports.refresh(frame(), spark.createDataFrame([(c,) for c in changed], "at timestamp_ntz"))
    whole = Reports(spark, str(tmp_path / "whole"), ["total"], ["place", "said"])
    whole.refresh(frame(), frame().select("at"))
    for ours, theirs in ((reports.weeks(), whole.weeks()), (reports.week_details(), whole.week_details())):
        assert sorted(map(tuple, ours.collect()), key=repr) == sorted(map(tuple, theirs.collect()), key=repr)
    week = lambda d: (d - timedelta(days=d.weekday())).date()
    want = {}
    for _, at, total, place, said in now.values():
        w = want.setdefault(week(at), [set(), 0, 0, set()])
        w[0].add(at.date()), w[3].add(((place or "").strip(), said.strip()))
        w[1] += 1
        w[2] += total or 0
    assert {r.week: (r.days, r.jobs, r.total, r.details) for r in reports.weeks().collect()} == {k: (len(a), n, t, len(d - {("", "")})) for k, (a, n, t, d) in want.items()}


def test_the_first_row_of_a_detail_is_carried(spark):
    rows = spark.createDataFrame([(1, 2, " a ", None, "late"), (1, 1, "a", "", "first"), (1, 3, "", None, "empty"), (2, 1, "a", "b", "other")], "g int, ord int, x string, y string, more string")
    got = distinct_details(rows, ["g"], ["x", "y"], ["ord"]).orderBy("g").select("g", "more").collect()
    assert [tuple(r) for r in got] == [(1, "first"), (2, "other")]
    assert distinct_details(rows.limit(0), ["g"], ["x", "y"], ["ord"]).count() == 0
