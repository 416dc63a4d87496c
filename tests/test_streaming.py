"""Incremental ingest: files come in several runs, a copy long after its original."""

from __future__ import annotations

from quillgrid import schemas as S
from quillgrid.streaming.ingest import ingest_new, job_states, read_job_states


def test_known_files_never_come_back(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    schema = spark.createDataFrame([], "doc_id bigint, text string").schema

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        ingest_new(spark, source, schema, target, checkpoint)
        return sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(target).collect())

    assert arrive([(1, "a"), (2, "b"), (3, "a")]) == [(1, "a"), (2, "b")]
    assert arrive([(4, "c")]) == [(1, "a"), (2, "b"), (4, "c")]
    assert arrive([(5, "a"), (6, "d")]) == [(1, "a"), (2, "b"), (4, "c"), (6, "d")]
    ingest_new(spark, source, schema, target, checkpoint)  # nothing new
    assert spark.read.parquet(target).count() == 4


def test_new_checkpoint_keeps_rows_of_files_that_are_gone(spark, tmp_path):
    target = str(tmp_path / "out")
    schema = spark.createDataFrame([], "doc_id bigint, text string").schema
    for n, (text, source) in enumerate((("a", "in0"), ("b", "in1"))):
        spark.createDataFrame([(n, text)], schema).write.parquet(str(tmp_path / source))
        ingest_new(spark, str(tmp_path / source), schema, target, str(tmp_path / f"cp{n}"))
    assert sorted(r["text"] for r in spark.read.parquet(target).collect()) == ["a", "b"]


def test_job_states(spark, tmp_path):
    import datetime as dt

    from quillgrid.operators.jobs import current

    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))

    def arrive(*events):
        rows = [(job, n, state, dt.datetime(2024, 1, n), None) for job, n, state in events]
        spark.createDataFrame(rows, S.JOB_EVENT).coalesce(1).write.mode("append").parquet(source)

    def states():
        return sorted(tuple(r) for r in read_job_states(spark, target).collect())

    for events in ([("j", 1, "queued")], [("k", 3, "queued"), ("j", 2, "running")], [("k", 1, "queued")]):
        arrive(*events)
        job_states(spark, source, S.JOB_EVENT, checkpoint, target)
        assert states() == sorted(tuple(r) for r in current(spark.read.parquet(source)).collect())
    before = states()
    assert [s[:2] for s in before] == [("j", "running"), ("k", "queued")]
    job_states(spark, source, S.JOB_EVENT, str(tmp_path / "another"), target)  # reads all events again
    assert states() == before


def test_job_states_of_checkpoints_that_saw_parts(spark, tmp_path):
    import datetime as dt

    target = str(tmp_path / "out")
    for n, events in enumerate(([1, 2], [2, 3], [4])):
        rows = [("j", k, "running", dt.datetime(2024, 1, k), None) for k in events]
        spark.createDataFrame(rows, S.JOB_EVENT).write.parquet(str(tmp_path / f"in{n}"))
        job_states(spark, str(tmp_path / f"in{n}"), S.JOB_EVENT, str(tmp_path / f"cp{n}"), target)
    assert [tuple(r) for r in read_job_states(spark, target).collect()] == [("j", "running", dt.datetime(2024, 1, 4), 4)]
