"""Jobs as a stateful stream against the batch functions: late, repeated and unordered events, restarts and timers."""

from __future__ import annotations

import datetime as dt
import random
import time

from quillgrid import schemas as S
from quillgrid.operators import jobs
from quillgrid.streaming.live_jobs import JobStates, follow_jobs, overdue, packed, read_live_jobs


def now():
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_late_repeated_and_unordered_events(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    rng, begun, events = random.Random(4), now(), []
    for j in range(40):
        at = begun - dt.timedelta(seconds=rng.choice([60, 7000, 7300, 90_000]))
        path = ["queued", "running", rng.choice(["succeeded", "failed", "timed_out"])][: rng.randrange(1, 4)]
        events += [(f"j{j}", n, state, at + dt.timedelta(seconds=n // 2), None) for n, state in enumerate(path, 1)]
    events += [("odd", 1, None, begun, None), ("odd", 2, "running", None, None)]
    sent = events + rng.sample(events, 30)
    rng.shuffle(sent)
    seen = set()
    for k in range(0, len(sent), 25):
        batch = sent[k : k + 25]
        seen |= set(batch)
        spark.createDataFrame(batch, S.JOB_EVENT).coalesce(1).write.mode("append").parquet(source)
        follow_jobs(spark, source, S.JOB_EVENT, checkpoint, target)  # each call starts again from the checkpoint
        if k in (0, 75) or k + 25 >= len(sent):
            every = spark.createDataFrame(sorted(seen, key=str), S.JOB_EVENT)
            live = read_live_jobs(spark, target)
            assert rows(live, "job_id", "state", "ts", "n_events") == rows(jobs.current(every), "job_id", "state", "ts", "n_events")
            at = now().isoformat(sep=" ")
            assert rows(overdue(live, at), "job_id", "state", "started", "seconds") == rows(jobs.over_time(every, at), "job_id", "state", "started", "seconds")
    before = rows(read_live_jobs(spark, target), "job_id", "state", "n_events", "overdue")
    assert any(r[-1] for r in before)
    follow_jobs(spark, source, S.JOB_EVENT, checkpoint, target)  # nothing new
    follow_jobs(spark, source, S.JOB_EVENT, str(tmp_path / "another"), target, max_files=3)  # all events again
    assert rows(read_live_jobs(spark, target), "job_id", "state", "n_events", "overdue") == before


def test_a_timer_marks_a_job_that_sends_nothing_more(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))

    def arrive(*events):
        spark.createDataFrame(list(events), S.JOB_EVENT).coalesce(1).write.mode("append").parquet(source)
        follow_jobs(spark, source, S.JOB_EVENT, checkpoint, target, timeout=20)
        return {r["job_id"]: (r["state"], r["overdue"]) for r in read_live_jobs(spark, target).collect()}

    start = now()
    assert arrive(("slow", 1, "running", start, None), ("done", 1, "running", start, None))["slow"] == ("running", False)
    arrive(("done", 2, "succeeded", now(), None))
    time.sleep(max(0, 22 - (now() - start).total_seconds()))
    # a batch about another job is enough
    assert arrive(("other", 1, "queued", now(), None)) == {"slow": ("running", True), "done": ("succeeded", False), "other": ("queued", False)}
    assert arrive(("slow", 2, "failed", now(), "late"))["slow"] == ("failed", False)


def test_an_overdue_job_needs_no_timer_and_events_go_as_one_value(spark):
    class State:
        def __init__(self):
            self.held, self.cleared = None, 0

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

        def clear(self):
            self.held, self.cleared = None, self.cleared + 1

    class Handle:
        timers: list = []

        def getValueState(self, *_, **__):
            return State()

        def registerTimer(self, at):
            self.timers.append(at)

    class Clock:
        def getCurrentProcessingTimeInMs(self):
            return 1_000_000

    at = lambda s: dt.datetime(1970, 1, 1) + dt.timedelta(seconds=s)
    rows_ = [("a", 1, "running", at(100), None), ("a", 1, "running", at(100), None), ("b", 2, "running", at(990), None), ("a", 3, "succeeded", at(200.25), None), ("c", None, "a,b", None, None), ("c", 4, None, at(5), None)]
    events = packed(spark.createDataFrame(rows_, S.JOB_EVENT)).collect()
    assert len(events[0]) == 2
    p = JobStates(20, 60, S.FINAL_STATES)
    p.init(Handle())
    of = lambda job, own: [r.asDict() for r in p.handleInputRows((job,), iter([e for e in own if e["job_id"] == job]), Clock())]
    assert of("a", events[:3])[0]["overdue"] and not Handle.timers and not p.finished.cleared
    assert of("a", events[:2]) == []
    done = of("a", events)[0]
    assert (done["state"], done["n_events"], done["ts"], done["overdue"]) == ("succeeded", 2, at(200.25), False) and p.open.cleared == 1
    p.init(Handle())
    assert not of("b", events)[0]["overdue"] and Handle.timers == [1_011_000]
    p.init(Handle())
    odd = of("c", events)[0]
    assert (odd["state"], odd["ts"], odd["event_id"], odd["n_events"]) == (None, at(5), 4, 2) and of("c", events) == []
