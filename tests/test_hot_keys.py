"""Hot hosts, many rules and known hashes: the plans spread and prune, the results stay."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from quillgrid.operators import collect
from quillgrid.streaming.ingest import add_hashes, hashes_of, ingest_new, known_hashes


@pytest.fixture
def uncoalesced(spark):
    """Small partitions stay apart, as large ones would."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


def test_pace_of_one_host_with_nearly_all_addresses(spark, uncoalesced):
    urls = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.concat(F.lit("https://h"), F.col("id") % 70, F.lit("/x"), F.col("id"))).when(F.col("id") % 97 == 1, F.lit("no address")).otherwise(F.concat(F.lit("https://hot/"), F.lpad("id", 6, "0"))).alias("url"), F.lit(1).alias("part"), F.lit("x").alias("before"))
    got = collect.paced(urls.select("url"), 2.0)
    rows = got.collect()
    by_host = {}
    for r in rows:
        by_host.setdefault(r["host"], []).append((r["slot"], r["url"], r["not_before_seconds"]))
    for own in by_host.values():
        own.sort()
        assert [x[0] for x in own] == list(range(len(own))) and [x[1] for x in own] == sorted(x[1] for x in own) and all(x[2] == 2.0 * x[0] for x in own)
    assert len(rows) == 20_000 and len(by_host["hot"]) > 17_000
    # the hot host's rows come out of several tasks
    assert got.where("host = 'hot'").select(F.spark_partition_id()).distinct().count() > 1


def plain_verdict(path, rules):
    best = None
    for prefix, allow in rules:
        body, end = (prefix[:-1], "$") if prefix.endswith("$") else (prefix, "")
        if re.match("(?s)" + ".*".join(map(re.escape, body.split("*"))) + ("$" if end else ""), path):
            best = max(best or (0, False), (len(prefix), allow))
    return True if best is None else best[1]


def test_robots_of_a_host_with_ten_thousand_rules(spark):
    rng = random.Random(9)
    part = lambda: "".join(rng.choice("ab/") for _ in range(rng.randrange(0, 6)))
    rules = [("/" + part() + rng.choice(["", "", "*" + part(), "$", "*.pdf$"]), rng.random() < 0.5) for _ in range(300)]
    many = [(f"/n{k}/", False) for k in range(10_000)]
    paths = ["/" + "".join(rng.choice("ab/.pdf") for _ in range(rng.randrange(0, 12))) for _ in range(300)] + [f"/n{k}/x" for k in range(0, 10_000, 400)]
    urls = spark.createDataFrame([(n, f"https://h{p}") for n, p in enumerate(paths)], "id int, url string")
    table = spark.createDataFrame([("h", p, a) for p, a in rules + many], "host string, prefix string, allow boolean")
    got = {r["id"]: r["robots_allowed"] for r in collect.robots_verdict(urls, table).collect()}
    assert got == {n: plain_verdict(p, rules + [x for x in many if p.startswith(x[0])]) for n, p in enumerate(paths)}


def test_a_batch_reads_the_partitions_of_its_hashes(spark, tmp_path):
    target = str(tmp_path / "out")
    hashed = spark.range(4000).select(F.sha2(F.col("id").cast("string"), 256).alias("file_sha256"), F.lit("r").alias("run_id"), F.lit(0).cast("long").alias("batch_id"))
    add_hashes(hashed, target)
    few = hashed.limit(3)
    found = known_hashes(spark, few, target)
    assert few.join(found, "file_sha256", "left_anti").count() == 0
    prefixes = {r[0][:2] for r in few.select("file_sha256").collect()}
    assert {r[0][:2] for r in found.select("file_sha256").collect()} == prefixes and found.count() < 150
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*prefix", plan)


def test_hashes_of_an_older_target_are_made(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    schema = spark.createDataFrame([], "doc_id bigint, text string").schema
    old = spark.createDataFrame([(1, "a")], schema).withColumns({"file_sha256": F.sha2("text", 256), "run_id": F.lit("old"), "batch_id": F.lit(0).cast("long")})
    old.write.partitionBy("run_id", "batch_id").parquet(target)
    spark.createDataFrame([(2, "a"), (3, "b"), (4, None)], schema).write.parquet(source)
    ingest_new(spark, source, schema, target, checkpoint)
    assert sorted(str(r["text"]) for r in spark.read.parquet(target).collect()) == ["None", "a", "b"] or sorted(str(r["text"]) for r in spark.read.parquet(target).collect()) == ["a", "b"]
    assert spark.read.parquet(hashes_of(target)).count() >= 2
