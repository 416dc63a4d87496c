"""The filter interaction audit against plain counting, and on odd tables."""

from __future__ import annotations

import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from quillgrid.llm import filter_audit as audit
from tests.llm.test_llm_operators import ODD, SF, documents, duck, none, odd, same_as_sql, values  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_mask(text, limits=audit.Limits()):
    words = WORD.findall(text)
    return (len(words) < limits.words) + 2 * (100 * len(set(words)) < limits.distinct * len(words)) + 4 * (100 * sum("A" <= c <= "Z" for c in text) > limits.capitals * len(text)) + 8 * bool(re.search(r"[#$%&*|]", text))


def plain(rows, labels):
    """(part, order, step) to the counts; rows: (doc_id, text, part)."""
    least, masks = {}, []
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    for i, text, part in rows:
        masks.append((part or "", plain_mask(text or "") + 16 * (i is not None and i > least[text or ""]), i in good, i in toxic))
    out = {}
    for part in {m[0] for m in masks}:
        own = [m[1:] for m in masks if m[0] == part]
        sums = Counter()
        for order in permutations("ABCDE"):
            before = 0
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                gone = [m for m in own if m[0] & bit and not m[0] & before]
                sums[letter] += len(gone)
                out[part, "".join(order), step] = [sum(not m[0] & (before | bit) for m in own), len(gone), sum(1 for m in own if m[0] & bit and m[0] & before), sum(m[0] == bit for m in own), sum(m[1] for m in gone), sum(m[2] for m in gone), letter]
                before |= bit
        for order in permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                out[part, "".join(order), step][-1] = sums[letter]
    return sorted((*k, *v) for k, v in out.items())


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
LABELS = [(1, 1, 0), (2, 0, 1), (3, 1, 1), (3, 0, 0), (4, None, 1), (6, 1, None), (None, 1, 1)]


def labelled(spark, rows=LABELS):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").selectExpr("*", "'x' AS text", "'x' AS mask", "'x' AS salt")


def test_op12_whole_table(spark, duck):  # noqa: F811
    same_as_sql(spark, duck, "op12_filter_audit")


def test_op12_odd_rows(spark, odd):  # noqa: F811
    got = values(audit.audit(odd, labelled(spark)), *COLUMNS)
    assert got == sorted(plain([(i, t, None) for i, t, _ in ODD], LABELS), key=str)
    assert len(got) == 600


def test_op12_no_rows(spark, none, odd):  # noqa: F811
    assert values(audit.audit(none, labelled(spark))) == []
    assert {r[8] for r in values(audit.audit(odd, labelled(spark, [])), *COLUMNS)} == {0}


def test_op12_copies_across_parts(spark):
    """A third of all rows hold one text, in three parts; ids repeat within and across texts."""
    rows = [(i % 701, "one text" if i % 3 == 0 else f"text {i % 50} " * (i % 7) + "#" * (i % 11 == 0), ["en", "de", None, ""][i % 4]) for i in range(3000)]
    rows += [(None, "one text", "en")] * 5
    df = spark.createDataFrame([(*r[:2], "s", r[2], None) for r in rows], "doc_id long, text string, source string, lang string, n_chars long").repartition(7)
    labels = [(i, i % 2, i % 5 == 0 and 1 or 0) for i in range(0, 701, 3)]
    assert values(audit.audit(df, labelled(spark, labels)), *COLUMNS) == sorted(plain(rows, labels), key=str)


@pytest.mark.parametrize("block", [5, 64, audit.BLOCK])
def test_op12_scan(block, monkeypatch):
    """Blocks end within words and code points; edges fall on every kind of byte."""
    monkeypatch.setattr(audit, "BLOCK", block)
    monkeypatch.setattr(audit, "_UP", audit._powers(audit._ODD, block))
    monkeypatch.setattr(audit, "_DOWN", audit._powers(audit._INVERSE, block))
    rng = np.random.default_rng(5)
    pool = ["a", "b", "ab", "ba", "Ab", " ", "\t", "\n", "\v", "\f", "\r", "\x00", "\x1f", "\x85", "\xa0", "é", "日本", "\U0001f600", "#", "|", "Z", "long" * 5, "　"]
    texts = ["", " ", "x", "", *("".join(rng.choice(pool, rng.integers(0, 40))) for _ in range(400)), "", "tail"]
    for column in (pa.array(texts), pa.array(["skipped", *texts, "cut"]).slice(1, len(texts))):
        data, edges = audit.text_buffers(column)
        limits = audit.Limits(words=5)
        assert audit.masks(data, edges, limits).tolist() == [plain_mask(t, limits) for t in texts]
        starts, ends = audit.words(data, edges)
        assert [data[a:b].tobytes() for a, b in zip(starts, ends)] == [w.encode() for t in texts for w in WORD.findall(t)]
        expected = [len(set(WORD.findall(t))) for t in texts]
        assert audit.distinct(data, edges, starts, ends).tolist() == expected
        # all hashes equal: only the comparison of bytes tells words apart
        assert audit.distinct(data, edges, starts, ends, np.zeros(len(starts), np.uint64)).tolist() == expected


def test_op12_long_text(spark):
    text = " ".join(f"Word{i % 9001}" for i in range(400_000)) + " " + "é" * 3_000_000
    df = documents(spark, [(1, text, "s"), (2, text, "s")])
    assert values(audit.audit(df, labelled(spark)), *COLUMNS) == sorted(plain([(1, text, None), (2, text, None)], LABELS), key=str)
