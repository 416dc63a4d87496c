"""Jobs as a stateful stream: each job's state is kept between batches, and a timer ends the wait for one that runs too long.

Events may come late, twice and out of order: a job's state holds the ids that it has counted, so the rows that the stream leaves are those
that ``jobs.current`` and ``jobs.over_time`` give for all distinct events so far. The clock decides, not a watermark, which would drop late events:
the timer of a job stands at its start and the timeout, and marks it as overdue in the first batch after that if no final event has come. A finished
job's state goes after ``keep`` seconds without news of it; an event that comes later still can't undo what the target says, as
the row of most events counts.

State is in RocksDB and goes with the stream's checkpoint, so a stream that was stopped or lost its executors goes on where it was.
"""

from __future__ import annotations

import datetime as dt
import sys
from collections.abc import Iterator
from typing import Any

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillgrid import schemas as S
from quillgrid.streaming.ingest import RUN, replace_batch, run_id_of

# the driver's own worker, which sets a processor up, lacks the files that were sent to the executors
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
#: Seconds that a finished job's state stays without news.
KEEP_SECONDS = 30 * 86_400

_FIELDS = (("ts", T.LongType()), ("event_id", T.LongType()), ("state", T.StringType()), ("started", T.LongType()), ("seen", T.BinaryType()))
#: A job between batches: its last event, when it started, and the ids that count (times in microseconds, ids as bytes: Spark handles a list's items one by one).
JOB_STATE = T.StructType([T.StructField(n, t) for n, t in _FIELDS])
LIVE = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("event_id", T.LongType()),
        T.StructField("n_events", T.LongType()),
        T.StructField("started", T.TimestampNTZType()),
        T.StructField("overdue", T.BooleanType()),
    ]
)
_EPOCH = dt.datetime(1970, 1, 1)


def _micros(ts: dt.datetime | None) -> int | None:
    return None if ts is None else (ts - _EPOCH) // dt.timedelta(microseconds=1)


def _time(micros: int | None) -> dt.datetime | None:
    return None if micros is None else _EPOCH + dt.timedelta(microseconds=micros)


def _event(text: str) -> tuple[int | None, int | None, str | None]:
    """Time, id and state out of ``packed``."""
    at, event, *state = text.split(",", 2)
    return _micros(dt.datetime.fromisoformat(at)) if at else None, int(event) if event else None, state[0] if state else None


def packed(events: DataFrame) -> DataFrame:
    """``job_id, event``: an event as one text, since Spark's Python worker takes rows apart value by value."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    event = F.concat_ws(",", text(F.col("ts").cast("timestamp_ntz")), text(F.col("event_id").cast("long")), "state")
    return events.select(F.col("job_id").cast("string").alias("job_id"), event.alias("event"))


def _order(ts: int | None, event: int | None, state: str | None) -> tuple:
    """As structs are ordered: a null comes first."""
    return tuple((x is not None, x or type(d)()) for x, d in ((ts, 0), (event, 0), (state, "")))


def _ids(seen: bytes) -> set[int | None]:
    """A leading byte says whether an event without an id was seen."""
    ids: set[int | None] = set(np.frombuffer(seen[1:], "<i8").tolist())
    return ids | {None} if seen[:1] == b"\1" else ids


def _bytes(ids: set[int | None]) -> bytes:
    return (b"\1" if None in ids else b"\0") + np.array(sorted(i for i in ids if i is not None), "<i8").tobytes()


class JobStates(StatefulProcessor):
    def __init__(self, timeout: int, keep: int, final: tuple[str, ...]):
        self.timeout, self.keep, self.final = timeout, keep, final

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", JOB_STATE)
        self.finished = handle.getValueState("finished", JOB_STATE, ttlDurationMs=self.keep * 1000)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        opened = self.open.get()
        closed = None if opened else self.finished.get()
        held = opened or closed
        ts, event, state, started, seen = held if held else (None, None, None, None, b"")
        ids, was = _ids(seen), started
        n = len(ids)
        for r in rows:
            own = _event(r[1])
            at, i, named = own
            if i in ids:
                continue
            ids.add(i)
            if len(ids) == 1 or _order(*own) > _order(ts, event, state):
                ts, event, state = own
            if named == "running" and at is not None:
                started = at if started is None else min(started, at)
        if len(ids) == n:
            return
        final = state in self.final
        (self.finished if final else self.open).update((ts, event, state, started, _bytes(ids)))
        if opened if final else closed:
            (self.open if final else self.finished).clear()
        now = timerValues.getCurrentProcessingTimeInMs()
        # past its time a job needs no timer, as its row says so at once; a start that was earlier than thought leaves a later timer, whose row says nothing new
        if started != was and self._deadline(started) > now:
            self.handle.registerTimer(self._deadline(started))
        yield self._row(key, (ts, event, state, started), len(ids), now)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        held = self.open.get()
        if held and held[3] is not None and expiredTimerInfo.getExpiryTimeInMs() >= self._deadline(held[3]):
            yield self._row(key, held[:4], len(_ids(held[4])), timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass

    def _deadline(self, started: int) -> int:
        """The first millisecond at which a job that started then is over time, in whole seconds."""
        return (started // 1_000_000 + self.timeout + 1) * 1000

    def _row(self, key: Any, held: Any, n_events: int, now: int) -> Row:
        ts, event, state, started = held
        overdue = started is not None and state is not None and state not in self.final and now >= self._deadline(started)
        return Row(job_id=key[0], state=state, ts=_time(ts), event_id=event, n_events=n_events, started=_time(started), overdue=overdue)


def live_jobs(events: DataFrame, timeout: int = S.JOB_TIMEOUT_SECONDS, keep: int = KEEP_SECONDS) -> DataFrame:
    """A stream of ``job_id, state, ts, event_id, n_events, started, overdue``: a row for each change of a job, from a stream of job events."""
    return packed(events).groupBy("job_id").transformWithState(JobStates(timeout, keep, S.FINAL_STATES), LIVE, "Update", "ProcessingTime")


def follow_jobs(spark: SparkSession, source: str, schema: T.StructType, checkpoint: str, target: str, timeout: int = S.JOB_TIMEOUT_SECONDS, keep: int = KEEP_SECONDS, max_files: int | None = None) -> None:
    """Bring ``target`` up to date with the event files below ``source``; returns when all are done."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    # without data no batch runs: timers by the clock would keep the stream going for ever
    wanted = {PROVIDER: ROCKS, EMPTY_BATCHES: "false"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        stream = live_jobs(reader.parquet(source), timeout, keep)
        write = lambda batch, n: replace_batch(batch, run_id_of(batch.sparkSession, checkpoint), n, target)
        stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_live_jobs(spark: SparkSession, target: str) -> DataFrame:
    """Each job's row as the stream left it last, that of most events; a new checkpoint that reads events again changes nothing."""
    stored = spark.read.schema(T.StructType([*LIVE.fields, *RUN.fields])).parquet(target)
    own = F.struct(*[F.col(c) for c in LIVE.names if c != "job_id"])
    last = F.max_by(own, F.struct("n_events", "overdue", "ts", "event_id")).alias("last")
    return stored.groupBy("job_id").agg(last).select("job_id", "last.*")


def overdue(jobs: DataFrame, now: str) -> DataFrame:
    """``job_id, state, started, seconds`` of the jobs that the stream marked, as ``jobs.over_time`` has them."""
    seconds = F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("started").cast("timestamp"))
    return jobs.where("overdue").select("job_id", "state", "started", seconds.alias("seconds"))
