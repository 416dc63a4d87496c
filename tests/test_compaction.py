"""Versions of runtime tables: equal reads before, during and after, and few files."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid import schemas as S
from quillgrid.platform import Platform
from quillgrid.sources.tables import Store

KEPT = T.StructType([T.StructField("k", T.StringType()), T.StructField("n", T.LongType())])
CATALOGUE = [("E01", "E", "quantitative", "t", r"emissions of ([0-9][0-9,.]*) ?(kt|t)\b")]


def held(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "seed"), str(tmp_path / "run"))
    for i in range(5):
        store.append(spark.createDataFrame([("a", i), (None, i), ("a", i)], KEPT), "t")
    before = held(store.of_runtime("t", KEPT))
    reader, n = store.of_runtime("t", KEPT), store.n_files("t")
    assert store.compact("t", KEPT, "k") == 1 and store.n_files("t") == 1 < n
    assert held(store.of_runtime("t", KEPT)) == before == held(reader)
    store.append(spark.createDataFrame([("b", 9)], KEPT), "t")
    assert held(store.of_runtime("t", KEPT)) == sorted([*before, ("b", 9)], key=str)
    assert store.drop_superseded("t", 3600) == 0
    assert store.drop_superseded("t", 0) >= 5 and held(reader.limit(0)) == []
    assert store.compact("t", KEPT, "k", lambda rows: rows.where("n <> 2 OR n IS NULL")) == 2
    assert held(store.of_runtime("t", KEPT)) == sorted([*(r for r in before if r[1] != 2), ("b", 9)], key=str)
    assert store.drop_superseded("t", 0) >= 2 and store.n_files("t") == 1


def test_rows_appended_while_it_runs(spark, tmp_path):
    store = Store(spark, str(tmp_path / "seed"), str(tmp_path / "run"))
    store.append(spark.createDataFrame([("a", 1)], KEPT), "t")

    def meanwhile(rows):
        store.append(spark.createDataFrame([("late", 2)], KEPT), "t")
        return rows

    store.compact("t", KEPT, "k", meanwhile)
    assert held(store.of_runtime("t", KEPT)) == [("a", 1), ("late", 2)]
    store.drop_superseded("t", 0)
    assert held(store.of_runtime("t", KEPT)) == [("a", 1), ("late", 2)]


def test_of_two_compactions_one_is_published(spark, tmp_path):
    store = Store(spark, str(tmp_path / "seed"), str(tmp_path / "run"))
    store.append(spark.createDataFrame([("a", 1)], KEPT), "t")

    def other(rows):
        store.compact("t", KEPT, "k")
        store.drop_superseded("t", 0)
        return spark.createDataFrame([("never seen", 0)], KEPT)

    with pytest.raises(RuntimeError, match="another writer"):
        store.compact("t", KEPT, "k", other)
    assert held(store.of_runtime("t", KEPT)) == [("a", 1)]
    # a number that was claimed by a driver that then ended is passed over
    assert store.claim("version-t-000000002") and store.compact("t", KEPT, "k") == 3
    assert held(store.of_runtime("t", KEPT)) == [("a", 1)]


def test_hot_key_fills_several_files(spark, tmp_path):
    store = Store(spark, str(tmp_path / "seed"), str(tmp_path / "run"))
    rows = spark.range(20000).select(F.lit("hot").alias("k"), F.xxhash64("id").alias("n"))
    store.append(rows, "t")
    store.compact("t", KEPT, "k", file_bytes=40_000)
    sizes = [r[0] for r in store.of_runtime("t", KEPT).groupBy(F.input_file_name()).count().select("count").collect()]
    assert len(sizes) > 2 and max(sizes) < 12000 and sum(sizes) == 20000


def test_empty_and_partitioned_tables(spark, tmp_path):
    store = Store(spark, str(tmp_path / "seed"), str(tmp_path / "run"))
    assert store.compact("none", KEPT, "k") == 1 and held(store.of_runtime("none", KEPT)) == []
    store.append(spark.createDataFrame([("a", 1)], KEPT), "parts", "k")
    with pytest.raises(ValueError, match="partitioned"):
        store.compact("parts", KEPT, "k")
    assert store.of_runtime("parts", KEPT).count() == 1


def test_platform(spark, tmp_path):
    seed = spark.createDataFrame([("s1", "c0", 2020, "ESG", "h0", 1, "x", "pass")], S.REPORT)
    seed.write.parquet(str(tmp_path / "seed/reports"))
    p = Platform(spark, str(tmp_path / "seed"), str(tmp_path / "run"), spark.createDataFrame(CATALOGUE, S.INDICATOR))
    p.initialise()
    (tmp_path / "a.pdf").write_text("%PDF-1.4\nIn 2024 emissions of 7 kt were counted.\n", "utf-8")
    report = p.register(str(tmp_path / "a.pdf"), "c1", 2024, "ESG").first()["report_id"]
    p.create_job(report)

    def shown():
        return [held(df) for df in (p.reports(), p._plain_results(), p.candidates(), p._evidence().select("evidence_id", "report_id"), p.job(last), p.summary())]

    last = p.create_job(report)

    def broken(content):
        raise OSError("unreadable")

    failed = p.create_job(report, broken)
    # a run that failed long ago has left rows
    old = dt.datetime(2020, 1, 1)
    p.store.append(spark.createDataFrame([("gone", 1, "queued", old, None), ("gone", 2, "running", old, None), ("gone", 3, "failed", old, "x")], S.JOB_EVENT), "job_events")
    full = T.StructType([*S.CANDIDATE.fields, T.StructField("run_id", T.StringType())])
    p.store.append(p.candidates().withColumn("run_id", F.lit("gone#1")).select(*full.fieldNames()), "candidates")
    before, n = shown(), sum(p.store.n_files(t) for t in ("candidates", "job_events", "results"))
    assert set(p.compact()) >= {"results", "runs", "lines"}
    assert shown() == before
    runs = {r["run_id"] for r in p.store.of_runtime("candidates", full).select("run_id").collect()}
    assert runs == {last} and p.store.of_runtime("runs", S.RUN).count() == 1
    assert sum(p.store.n_files(t) for t in ("candidates", "job_events", "results")) == 3 < n
    p.drop_superseded(0)
    assert shown() == before and p.job(failed).first()["state"] == "failed"
    p.create_job(report)
    assert [r["value"] for r in p._plain_results().collect()] == [7000]
    p.restore()
    assert held(p.reports()) == held(seed)


def test_rows_of_a_file_are_bounded(spark, tmp_path):
    """Rows that pack well fill several files, as a task sorts what a file holds."""
    store = Store(spark, str(tmp_path / "seed"), str(tmp_path / "run"))
    store.append(spark.range(4000).select(F.lit("a").alias("k"), F.col("id").alias("n")), "t")
    before = held(store.of_runtime("t", KEPT))
    store.compact("t", KEPT, "k", file_rows=1000)
    assert store.n_files("t") == 4 and held(store.of_runtime("t", KEPT)) == before
