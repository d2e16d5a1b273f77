"""Streams that keep state over time (survey rows M2, R3, R4): events of a key in order of their time, whatever files bring them.

``InOrder`` is a processor of ``transformWithState``. It holds the events of a key in a list
until the watermark has passed them and then gives them to ``step`` in order of (at, tie); so the
rows don't depend on how a log is cut into files and triggers. An event that comes after the watermark
has passed its time is told as late, in a row of its own, and changes nothing. State is the
events that wait, bounded by the lateness that is allowed, and what a processor keeps of a key. A deadline
that a processor asks for comes between events like an event.

Between Spark and its Python workers each row, value of state and row told costs far more than an event's step, so all three go
in blocks: tasks that events are dealt to by key make the events of a key one row (pickled, as a value of state is anyway), which
is kept as one value if none of it is late; what a key tells is one row of arrays that Spark takes apart again. A block has a bounded
number of events, however many a key has, and a task holds a bounded number of bytes while it makes them.

State lives in RocksDB and moves with the checkpoint: a run that was cut off goes on where
it was, and files of the sink are committed by batch, so no row is lost or written twice.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from itertools import batched, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from tallyforge.operators.lifecycle import TRANSITIONS

#: States in which a job of a batch needs no more work, and minutes after which a batch is closed in any case.
SETTLED = ("approved", "rejected", "aggregated", "failed")
MOST_MINUTES = 60

#: Events in a value of state, rows told in a row of arrays; bytes of events that a task holds while it makes blocks of them.
BLOCK = 4096
HELD_BYTES = 32 << 20

_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _names(ddl: str) -> list[str]:
    return [x.split()[0] for x in ddl.split(", ")]


def _block(events: Iterable[tuple]) -> tuple[bytes]:
    """A value of state."""
    return (pickle.dumps(list(events), protocol=5),)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a key, ``at`` and what else waits, to blocks of a key: (key, newest, soonest, block)."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= HELD_BYTES:
            yield from _by_key(pa.Table.from_batches(held))
            held, size = [], 0
    if held:
        yield from _by_key(pa.Table.from_batches(held))


def _by_key(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    if not rows.num_rows:
        return
    codes = rows.column(0).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    rows = rows.take(pa.array(order)).combine_chunks()
    ends = [*(np.flatnonzero(np.diff(codes[order])) + 1).tolist(), rows.num_rows]
    cuts = [x for a, b in pairwise([0, *ends]) for x in range(a, b, BLOCK)]
    keys, at = (c.chunk(0) for c in rows.columns[:2])
    at = at.to_numpy()  # refuses events without a time
    newest, soonest = np.maximum.reduceat(at, cuts), np.minimum.reduceat(at, cuts)
    for some in batched(enumerate(pairwise([*cuts, rows.num_rows])), BLOCK):
        made = [_block(zip(*(c.to_pylist() for c in rows.slice(a, b - a).columns[1:]), strict=True))[0] for _, (a, b) in some]
        these = slice(some[0][0], some[-1][0] + 1)
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(cuts[these])), pa.array(newest[these]), pa.array(soonest[these]), pa.array(made, pa.binary())], names=[rows.column_names[0], "newest", "soonest", "block"])


class InOrder(StatefulProcessor):
    """Base of processors: ``waiting`` is the schema of an event, which begins with ``at`` (microseconds) and ``tie``; ``output`` that of what is told, in tuples."""

    waiting = ""
    output = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "block binary")
        self.timer = handle.getValueState("timer", "ms long")
        self.told = Row(*_names(self.output))
        self.open(handle)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        return self._blocks(self._take(key, rows, timerValues.getCurrentWatermarkInMs() * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self._blocks(self._tell(key, timerValues.getCurrentWatermarkInMs() * 1000))

    def _blocks(self, told: Iterator[tuple]) -> Iterator[Row]:
        for block in batched(told, BLOCK):
            yield self.told(*zip(*block, strict=True))

    def _take(self, key, rows: Iterator[Row], mark: int) -> Iterator[tuple]:
        soonest = None
        for row in rows:
            at, block = row[-2:]
            if at < mark:
                events = pickle.loads(block)
                for event in events:
                    if event[0] < mark:
                        yield self.late(key, event)
                kept = [e for e in events if e[0] >= mark]
                if not kept:
                    continue
                at, (block,) = min(e[0] for e in kept), _block(kept)
            self.events.appendValue((block,))
            soonest = at if soonest is None else min(at, soonest)
        if soonest is not None:
            self._wake(soonest)

    def _tell(self, key, mark: int) -> Iterator[tuple]:
        self.timer.clear()
        held = [e for (block,) in self.events.get() for e in pickle.loads(block)]
        due = sorted(e for e in held if e[0] < mark)
        rest = [e for e in held if e[0] >= mark]
        self.begin(key)
        for event in due:
            # a deadline that passed before this event comes first
            while (limit := self.deadline()) is not None and limit < event[0]:
                yield from self.expire(key, limit)
            yield from self.step(key, event)
        while (limit := self.deadline()) is not None and limit < mark:
            yield from self.expire(key, limit)
        self.end(key)
        if due:
            self.events.put([_block(b) for b in batched(rest, BLOCK)]) if rest else self.events.clear()
        soonest = [e[0] for e in rest] + [x for x in [self.deadline()] if x is not None]
        if soonest:
            self._wake(min(soonest))

    def _wake(self, at: int) -> None:
        """One timer a key: for the earliest event that waits, or the deadline."""
        ms = at // 1000 + 1
        known = (self.timer.get() or (None,))[0]
        if known is None or ms < known:
            if known is not None:
                self.handle.deleteTimer(known)
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    # what a processor adds

    def open(self, handle: StatefulProcessorHandle) -> None: ...

    def begin(self, key) -> None:
        """Reads the state of a key, once for all events that are due."""

    def end(self, key) -> None:
        """Writes it back."""

    def step(self, key, event: tuple) -> Iterator[tuple]:
        raise NotImplementedError

    def deadline(self) -> int | None:
        """When ``expire`` is to be called if no event changes that."""

    def expire(self, key, at: int) -> Iterator[tuple]:
        return iter(())

    def late(self, key, event: tuple) -> tuple:
        raise NotImplementedError

    def close(self) -> None: ...


class Machine(InOrder):
    """M2: valid steps move a job, others are told and leave it where it is. State of a job: where it stands."""

    waiting = "at long, tie long, to string"
    output = "job long, tie long, from_state string, to_state string, valid boolean, late boolean"

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "state string")

    def begin(self, key) -> None:
        self.now = (self.state.get() or ("pending",))[0]

    def end(self, key) -> None:
        self.state.update((self.now,))

    def step(self, key, event: tuple) -> Iterator[tuple]:
        _, tie, to = event
        valid = to == self.now or to in TRANSITIONS.get(self.now, ())
        yield key[0], tie, self.now, to, valid, False
        if valid:
            self.now = to

    def late(self, key, event: tuple) -> tuple:
        return key[0], event[1], None, event[2], None, True


class Closer(InOrder):
    """Closes a batch of jobs once a template, and R4's limit on its age.

    A batch is closed when all its jobs are settled, or when its oldest job is ``minutes`` old, each time if at least
    one is approved; the approved jobs of a template are one close, and are aggregated from then on. A batch past its age
    closes with each job that is approved later. State of a batch: a job's template and status, its oldest time.
    """

    waiting = "at long, tie long, job long, template string, status string"
    output = "batch long, template string, closed_at long, jobs array<long>, forced boolean, late boolean"

    def __init__(self, minutes: int = MOST_MINUTES):
        self.minutes = minutes

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.jobs = handle.getMapState("jobs", "job long", "template string, status string")
        self.oldest = handle.getValueState("oldest", "at long, passed boolean")

    def begin(self, key) -> None:
        self.held = {k[0]: (v[0], v[1]) for k, v in self.jobs.iterator()}
        self.since, self.passed = self.oldest.get() or (None, False)
        self.changed: set[int] = set()

    def end(self, key) -> None:
        for job in self.changed:
            self.jobs.updateValue((job,), self.held[job])
        if self.since is not None:
            self.oldest.update((self.since, self.passed))

    def step(self, key, event: tuple) -> Iterator[tuple]:
        at, _, job, template, status = event
        if self.since is None:
            self.since = at
        self.held[job] = (template, status)
        self.changed.add(job)
        yield from self._closes(key, at)

    def deadline(self) -> int | None:
        return None if self.since is None or self.passed else self.since + self.minutes * 60_000_000

    def expire(self, key, at: int) -> Iterator[tuple]:
        self.passed = True
        yield from self._closes(key, at)

    def _closes(self, key, at: int) -> Iterator[tuple]:
        settled = all(status in SETTLED for _, status in self.held.values())
        if not settled and not self.passed:
            return
        approved: dict[str, list[int]] = {}
        for job, (template, status) in self.held.items():
            if status == "approved":
                approved.setdefault(template, []).append(job)
        for template in sorted(approved, key=lambda t: (t is not None, t)):
            yield key[0], template, at, sorted(approved[template]), not settled, False
            for job in approved[template]:
                self.held[job] = (template, "aggregated")
                self.changed.add(job)

    def late(self, key, event: tuple) -> tuple:
        return key[0], event[3], event[0], [event[2]], None, True


def in_order(events: DataFrame, key: str, processor: InOrder, late: str) -> DataFrame:
    """``events`` (``key``, ts: instant, tie and what ``processor`` waits with) through ``processor``; events may come ``late`` behind the newest."""
    for name, value in _STORE.items():
        events.sparkSession.conf.set(name, value)
    more = _names(processor.waiting)[1:]
    spark = events.sparkSession
    dealt = events.select(key, F.unix_micros("ts").alias("at"), *more).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key)
    made = StructType([events.schema[key], StructField("newest", LongType()), StructField("soonest", LongType()), StructField("block", BinaryType())])
    # without the column that carries the watermark Spark leaves late rows in, and the processor tells them
    rows = dealt.mapInArrow(blocks, made).withColumn("ts", F.timestamp_micros("newest")).withWatermark("ts", late).select(key, "soonest", "block")
    told = StructType([StructField(f.name, ArrayType(f.dataType)) for f in StructType.fromDDL(processor.output)])
    return rows.groupBy(key).transformWithState(processor, told, "append", "EventTime").select(F.inline(F.arrays_zip(*told.names)))
