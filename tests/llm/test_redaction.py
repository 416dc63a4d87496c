"""Redaction of long texts: the same as joining pieces by hand, in time that grows with the text."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from quillgrid.llm import secrets
from tests.llm.test_llm_operators import documents


def plain(text, spans):
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


@pytest.mark.parametrize("chunk", [1, 3, 16, 1024])
def test_marks_fall_anywhere_in_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(secrets, "CHUNK", chunk)
    rng = random.Random(chunk)
    rows = []
    for key in range(60):
        text = "".join(rng.choice("ab é日\U0001f600\n") for _ in range(rng.randrange(0, 90)))
        spans = [tuple(sorted(rng.sample(range(len(text) + 1), 2))) for _ in range(rng.randrange(1, 12))] if len(text) > 1 else [(0, len(text))]
        rows.append((key, text, spans))
    each = spark.createDataFrame([(k, a, b) for k, _, s in rows for a, b in s], "k int, start int, end int")
    texts = spark.createDataFrame([(k, t) for k, t, _ in rows], "k int, text string")
    met = texts.join(secrets.gaps(each, "k"), "k").select("k", secrets.marked(F.col("text"), F.col("gaps"), "[SECRET]").alias("text"))
    assert {r["k"]: r["text"] for r in met.collect()} == {k: plain(t, s) for k, t, s in rows}


def test_redaction_of_a_log_dump(spark):
    dump = lambda n: "\n".join(f"é token = {i:032x}" for i in range(n))
    secrets.redact(documents(spark, [(1, dump(10), "s")])).collect()
    begun = time.monotonic()
    got = secrets.redact(documents(spark, [(1, dump(64_000), "s"), (2, "plain", "s")])).select("doc_id", "text").collect()
    took = time.monotonic() - begun
    assert {r["doc_id"]: r["text"] for r in got} == {1: "\n".join(["é [SECRET]"] * 64_000), 2: "plain"}
    print(f"redaction of 64,000 spans: {took:.1f} s")
    assert took < 60
