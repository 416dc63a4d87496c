"""Search by the inverted index against ``contains``, term by term and text by text."""

from __future__ import annotations

import random
import re

import pytest

from quillgrid.operators import postings as P


def plain(texts, term):
    out = []
    for i, t in texts:
        at = [m.start() for m in re.finditer(f"(?={re.escape(term)})", t or "")]
        if at:
            out.append((i, len(at), at[0] + 1))
    return sorted(out)


def found(spark, path, term):
    return sorted(tuple(r) for r in P.search(spark, path, term).collect())


TEXTS = [
    (1, "公司2024年温室气体排放总量为1,200吨，用电量5万千瓦时。"),
    (2, "温室气体排放 emissions of 7 kt\nin 2019"),
    (3, "that thatthat  hat\ttha"),
    (4, ""),
    (5, None),
    (6, "排放"),
    (7, "a"),
    (8, "é\U0001f600\U00020000国x排放a\x00b"),
    (9, "aaaaaa"),
]


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("postings") / "index")
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    for batch, own in (("a", df.where("doc_id < 5")), ("b", df.where("doc_id >= 5")), ("a", df.where("doc_id < 5"))):
        P.index(own, path, batch)
    P.index(df.where("doc_id = 3"), path, "c")  # a document that comes again
    return path


def test_every_substring_is_found(spark, path):
    rng = random.Random(3)
    terms = {t[a : a + n] for _, t in TEXTS if t for n in (1, 2, 3, 4, 7) for a in rng.sample(range(len(t)), min(2, len(t))) if t[a : a + n]}
    for term in sorted(terms)[::2] + ["温室气体", "排放", "国x", "放a", "aaa", "zz", "hat\t", "that", "no such", "  "]:
        assert found(spark, path, term) == plain(TEXTS, term), term


def test_only_the_buckets_of_the_term_are_read(spark, path):
    plan = P.search(spark, path, "温室气体")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and re.search(r"bucket#\d+ (IN|INSET)|\(bucket#\d+ =", plan)
    read = P.search(spark, path, "温室").inputFiles()
    assert read  # all files of the table; the scan itself is pruned by the filter above
    for term in ("", "a" + P.PAD):
        with pytest.raises(ValueError):
            P.search(spark, path, term)


def test_cover_takes_few_grams():
    assert P.cover("emissions of") == [(0, "emi", False), (3, "ssi", False), (6, "ons", False), (9, " of", False)]
    assert P.cover("温室气体") == [(0, "温室", False), (2, "气体", False)]
    assert P.cover("温室a") == [(0, "温室", False), (1, "室a", True)]
    assert P.cover("a") == [(0, "a", True)] and P.cover("ab") == [(0, "ab", True)]
    assert [g for _, g, _ in P.cover("温室气体x排放")] == ["温室", "气体", "x排放"]


def test_texts_share_a_posting_and_none_is_moved(spark):
    rows = [(i, f"common words {i}") for i in range(200)] + [(3, "common words 3"), (None, "common"), (500, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = P.postings(df)
    assert "Exchange" not in found.sortWithinPartitions("bucket", "gram")._jdf.queryExecution().executedPlan().toString()
    kept = {r["gram"]: r for r in found.collect()}
    assert len(kept) == found.count()  # one row for all documents of a block
    own = kept["mon"]
    assert own["docs"] == [i for i in range(200)] + [3] and own["ends"] == list(range(1, 202)) and own["at"] == [3] * 201
