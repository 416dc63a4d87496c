"""States of batches against a full recount."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.operators import analytics as A
from quillgrid.operators.increments import Increments

REPORTS = "report_id long, company_id long, year long, order long"
RESULTS = "result_id long, company_id long, indicator string, unit string, year long, value long"


def held(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def check(own, r, v):
    for total in (False, True):
        counted = {}
        for name, rows, k in (("reports", r, 0), ("companies", r, 1), ("results", v, 0)):
            for row in rows:
                if row[k] is not None:
                    counted.setdefault((name, None if total else row[2 if rows is r else 4]), set()).add(row[k])
        assert held(own.summary() if total else own.by_year()) == sorted(((*k, len(ids)) for k, ids in counted.items()), key=str)
    firsts = {}
    for report, company, year, order in r:
        if year in (2020, 2021) and report is not None:
            firsts[company, year] = min(firsts.get((company, year), (order, report)), (order, report))
    full = sorted((c, y, x[1]) for (c, y), x in firsts.items() if (c, 2020) in firsts and (c, 2021) in firsts)
    assert held(own.complete_years([2020, 2021])) == sorted(full, key=str)
    series = {}
    for i, c, n, u, y, value in v:
        if i is not None and y is not None:
            series[c, n, u, y] = min(series.get((c, n, u, y), (i, value)), (i, value))
    got = {tuple(t[:4]): t[4] for t in own.trends().select("company_id", "indicator", "unit", "year", "value").collect()}
    years = {}
    for k in series:
        years.setdefault(k[:3], []).append(k[3])
    assert got == {k: x[1] for k, x in series.items() if len(years[k[:3]]) > 1} and got
    return series


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split(spark, tmp_path, seed):
    dice = random.Random(seed)
    year = lambda: dice.choice([2020, 2021, 2022, None])
    r = [(dice.choice([None, *[i * 9973] * 9]), dice.randrange(-3, 9), year(), dice.randrange(5)) for i in range(80)]
    v = [(i * 40_000 - 70_000, dice.randrange(4), dice.choice("ab"), dice.choice(["t", "kg"]), year(), dice.randrange(99)) for i in range(120)]
    own = Increments(spark, str(tmp_path / "states"), T.LongType(), T.LongType())
    assert held(own.summary()) == [] == held(own.trends())
    cut = dice.randrange(20, 60)
    batches = {"x": (r[:cut], v[:cut]), "y": (r[cut - 10 :], v[cut - 5 :]), "none": ([], [])}
    for batch in ("y", "none", "x", "y"):
        own.add(batch, spark.createDataFrame(batches[batch][0], REPORTS).withColumn("extra", F.lit(1)), spark.createDataFrame(batches[batch][1], RESULTS))
    series = check(own, r, v)
    touched = {k[:3] for k in series if any(k == t[1:5] for t in batches["x"][1])}
    assert {tuple(t) for t in own.trends("x").select("company_id", "indicator", "unit").collect()} == {k for k in touched if sum(s[:3] == k for s in series) > 1}
    own.fold()
    assert own._states("ids").select("batch_id").distinct().count() == 1
    check(own, r, v)
    own.add("x", spark.createDataFrame(batches["x"][0], REPORTS), spark.createDataFrame(batches["x"][1], RESULTS))
    check(own, r, v)


def test_equal_to_the_operators_over_all(spark, tmp_path):
    r = spark.range(400).select(F.col("id").alias("report_id"), (F.col("id") % 37).alias("company_id"), (F.col("id") % 5 + 2018).alias("year"), (F.col("id") * 7 % 11).alias("order"))
    own = Increments(spark, str(tmp_path / "states"), T.LongType(), T.LongType())
    v = r.select(F.col("report_id").alias("result_id"), "company_id", F.lit("a").alias("indicator"), F.lit("t").alias("unit"), "year", F.col("order").alias("value"))
    for k in range(3):
        own.add(str(k), r.where(F.col("report_id") % 3 == k), v.where(F.col("result_id") % 3 == k))
    full = A.complete_years(r, "company_id", "year", [2018, 2020], [F.col("order"), F.col("report_id")]).select("company_id", "year", "report_id")
    assert held(own.complete_years([2018, 2020])) == held(full)


def test_batches_read_what_was_joined_once(spark, sf_dir, monkeypatch):
    """The query's four batches read the joined results, not the tables again."""
    from quillgrid.plans import queries

    seen = []
    add = Increments.add
    monkeypatch.setattr(Increments, "add", lambda self, batch, reports, results: (seen.extend(results.inputFiles()), add(self, batch, reports, results)))
    queries._in_batches(spark, sf_dir)
    assert seen and all("increment-results" in x for x in seen)
