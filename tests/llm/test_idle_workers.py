"""What a Python worker keeps between tasks goes once it idles."""

from __future__ import annotations

import time

import pyarrow as pa

from quillgrid.llm import common


def test_what_is_kept_goes_when_no_task_follows(monkeypatch):
    monkeypatch.setattr(common, "IDLE_SECONDS", 0.2)
    batch = pa.record_batch([pa.array([1, 2]), pa.array(["a", "b"])], ["doc_id", "text"])
    made = []

    def task():
        found = common.kept(("a store",), lambda: made.append(1) or [1])
        list(common.arrow_batches([batch]))
        return found

    first = task()
    assert task() is first and len(made) == 1  # the next task comes in time
    time.sleep(0.8)
    assert ("a store",) not in common._KEPT
    task()
    assert len(made) == 2
    common.forget()


def test_a_task_that_runs_keeps_its_store(monkeypatch):
    monkeypatch.setattr(common, "IDLE_SECONDS", 0.1)
    batch = pa.record_batch([pa.array([1]), pa.array(["a"])], ["doc_id", "text"])
    common.kept(("a store",), list)
    list(common.arrow_batches([batch]))
    again = common.kept(("a store",), list)
    time.sleep(0.4)  # longer than the time to idle, but a task has begun meanwhile
    assert common.kept(("a store",), list) is again
    common.forget()
