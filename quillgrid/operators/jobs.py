"""Jobs as append-only events: current state, timeouts, failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.schemas import FINAL_STATES, JOB_EVENT, JOB_STATES, JOB_TIMEOUT_SECONDS

#: Which state may follow which.
NEXT = {None: ("queued",), "queued": ("running", "failed"), "running": ("succeeded", "failed", "timed_out")}


def current(events: DataFrame, job: str = "job_id", state: str = "state", ts: str = "ts", event: str = "event_id") -> DataFrame:
    """The latest state of each job, by time and then event."""
    last = F.max(F.struct(ts, event, state)).alias("_last")
    return events.groupBy(job).agg(last, F.count("*").alias("n_events")).select(job, F.col(f"_last.{state}").alias(state), F.col(f"_last.{ts}").alias(ts), "n_events")


def over_time(events: DataFrame, now: str, timeout: int = JOB_TIMEOUT_SECONDS) -> DataFrame:
    """Jobs that aren't finished and started over ``timeout`` seconds before ``now``."""
    started = events.groupBy("job_id").agg(F.min(F.when(F.col("state") == "running", F.col("ts"))).alias("started"))
    state = current(events)
    late = F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("started").cast("timestamp"))
    return state.join(started, "job_id").where(~F.col("state").isin(*FINAL_STATES) & (late > timeout)).select("job_id", "state", "started", late.alias("seconds"))


def time_out(events: DataFrame, now: str, timeout: int = JOB_TIMEOUT_SECONDS) -> DataFrame:
    """The events to append for jobs that are over time."""
    late = over_time(events, now, timeout).join(events.groupBy("job_id").agg(F.max("event_id").alias("last")), "job_id")
    return late.select("job_id", (F.col("last") + 1).alias("event_id"), F.lit("timed_out").alias("state"), F.lit(now).cast("timestamp_ntz").alias("ts"), F.concat(F.lit("over "), F.lit(timeout), F.lit(" s")).alias("reason"))


def gaps(events: DataFrame, key: str, ts: str, order: str, seconds: int = JOB_TIMEOUT_SECONDS) -> DataFrame:
    """``events`` with ``gap_seconds`` to the next one of its key and ``late``."""
    nxt = F.lead(ts).over(Window.partitionBy(key).orderBy(ts, order))
    gap = F.timestamp_diff("SECOND", F.col(ts), nxt)
    return events.withColumn("gap_seconds", gap).withColumn("late", F.coalesce(gap > seconds, F.lit(False)))


def failures(events: DataFrame) -> DataFrame:
    """The failure trail: failed and timed-out events with their reasons, in order."""
    return events.where(F.col("state").isin("failed", "timed_out")).orderBy("job_id", "ts", "event_id")


def invalid(events: DataFrame) -> DataFrame:
    """Events with an unknown state, or one that may not follow the state before."""
    before = F.lag("state").over(Window.partitionBy("job_id").orderBy("ts", "event_id"))
    allowed = F.lit(False)
    for state, following in NEXT.items():
        allowed = allowed | ((before.isNull() if state is None else before == state) & F.col("state").isin(*following))
    marked = events.withColumn("_ok", F.coalesce(F.col("state").isin(*JOB_STATES) & allowed, F.lit(False)))
    return marked.where(~F.col("_ok")).drop("_ok")


def event(spark, job_id: str, event_id: int, state: str, ts, reason: str | None = None) -> DataFrame:
    if state not in JOB_STATES:
        raise ValueError(f"state must be one of {', '.join(JOB_STATES)}")
    return spark.createDataFrame([(job_id, event_id, state, ts, reason)], JOB_EVENT)
