"""Language identification against a plain cross-parsing, on held-out rows and odd tables."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgrid.llm import language, registry
from tests.llm.test_llm_operators import ODD, SF, documents, none, odd, source, values  # noqa: F401


def plain_text(text):
    """Lower-cased UTF-8, runs of ASCII bytes other than letters as one space, a space at both ends."""
    out = b""
    for b in b" " + text.lower().encode() + b" ":
        c = bytes([b]) if b >= 128 or 97 <= b <= 122 else b" "
        if not (c == b" " and out.endswith(b" ")):
            out += c
    return out


def plain_parse(data, spans, size, block):
    """Phrases and bits of a text by searching the sample; a byte that no span has is a phrase of its own."""
    phrases, bits = 0, 0.0
    for a in range(0, len(data), block):
        part = data[a : a + block]
        i = 0
        while i < len(part):
            j = i
            while j < len(part) and any(part[i : j + 1] in s for s in spans):
                j += 1
            phrases += 1
            if j == i:
                bits += math.log2(size) + 1
                i += 1
            else:
                times = sum(s[k : k + j - i] == part[i:j] for s in spans for k in range(len(s)))
                bits += math.log2(size / times)
                i = j
    return phrases, bits


@pytest.mark.parametrize("block", [7, 64, 512])
def test_op11_parse_is_the_plain_one(block, monkeypatch):
    monkeypatch.setattr(language, "BLOCK", block)
    rng = random.Random(block)
    words = {"x": ["aba", "abab", "bé", "c"], "y": ["bab", "éb", "dd", "日本"], "z": ["abc", "cab"]}
    draw = lambda own, n: " ".join(rng.choice(own) for _ in range(n))
    samples = {k: [plain_text(draw(own, 12)) for _ in range(4)] for k, own in words.items()}
    every = [w for own in words.values() for w in own] + ["q", "ÉB", "!", "1 2", "Ω", "日"]
    texts = ["", "!", "q", "Ωq", *(draw(every, rng.randrange(1, 40)) for _ in range(40))]
    parser = language.Parser(samples)
    phrases, bits, sizes = parser.parse(texts)
    assert parser.languages == ["x", "y", "z"]
    for i, t in enumerate(texts):
        data = plain_text(t)
        assert sizes[i] == len(data)
        for row, k in enumerate(parser.languages):
            size = sum(len(s) + 1 for s in samples[k])
            wanted = plain_parse(data, samples[k], size, block)
            assert phrases[row, i] == wanted[0] and bits[row, i] == pytest.approx(wanted[1])
    # the language of fewest normalised phrases, then of fewest bits, then the first
    found, score, _ = parser.predict(texts)
    for i, t in enumerate(texts):
        rates = [(round(phrases[r, i] * math.log2(parser.automata[r].size) / sizes[i], 12), round(bits[r, i], 6), k) for r, k in enumerate(parser.languages)]
        assert found[i] == (min(rates)[2] if any(c.isalpha() for c in t) else "und")
        if found[i] != "und":
            best, second = sorted(r[0] for r in rates)[:2]
            assert score[i] == pytest.approx(1 - best / second)


def test_op11_automaton_occurrences():
    """Every substring is a walk, its state tells how often it occurs, and nothing else is a walk."""
    rng = np.random.default_rng(2)
    classes = np.full(256, 4, np.uint8)
    classes[[0x20, 0x61, 0x62]] = [1, 2, 3]
    spans = [bytes(rng.choice([0x20, 0x61, 0x62], 60).astype(np.uint8)) for _ in range(3)]
    a = language.Automaton(spans, classes)
    for n in range(1, 9):
        for _ in range(200):
            w = bytes(rng.choice([0x20, 0x61, 0x62], n).astype(np.uint8))
            lanes = classes[np.frombuffer(w, np.uint8)][:, None]
            phrases, bits = a.parse(lanes, np.ones(n, np.int64))
            times = sum(s[k : k + n] == w for s in spans for k in range(len(s)))
            assert (phrases[0] == 1) == (times > 0)
            if times:
                assert bits[0] == pytest.approx(math.log2(a.size / times))


def test_op11_held_out(spark):
    rows = registry.QUERIES["op11_language"](spark, SF).collect()
    docs = {r[0]: r for r in source()}
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]][2] for r in held) >= 0.98 * len(held)


def test_op11_learns_nothing_from_held_out_rows(spark):
    """Rows of the held-out fold, rows without id or language and other columns change no sample."""
    rows = [(i, f"wort{i} und der {i}" if i % 2 else f"the word{i} of {i}", "de" if i % 2 else "en", "s") for i in range(80)]
    schema = "doc_id long, text string, lang string, source string"
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    other = [(i, "zzz " * 9, "en", "t") if held(i) else (i, t, lang, "t") for i, t, lang, _ in rows] + [(None, "qqq", "en", "s"), (900, "qqq", None, "s")]
    one, two = (language.learn(spark.createDataFrame(x, schema)) for x in (rows, other))
    assert one == two and set(one) == {"de", "en"}
    assert not any(b"zzz" in s or b"qqq" in s for spans in two.values() for s in spans)


def test_op11_sample_is_bounded(spark):
    """A language of many rows and one id of a third of all rows: about the number of rows asked for, spans of fixed length."""
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("word "), F.repeat(F.concat(F.lit("é"), F.col("id").cast("string"), F.lit(" ab")), 400)).alias("text"), F.lit("en").alias("lang"))
    found = language.learn(df, most_rows=100)
    assert 60 < len(found["en"]) < 140
    assert all(len(s.decode("utf-8", "ignore")) <= language.SPAN + 2 for s in found["en"])


def test_op11_odd_rows(spark, odd, none):  # noqa: F811
    samples = {"en": [b" the word of ab "], "de": [b" das wort "]}
    got = values(language.predict(odd, samples), "doc_id", "lang_pred")
    assert len(got) == len(ODD)
    assert {(i, x) for i, x in got if i in (1, 2, 5)} == {(1, "und"), (2, "und"), (5, "und")}
    assert all(x in samples for i, x in got if i not in (1, 2, 5))
    # nothing learnt: every text is unknown; no rows: none
    assert language.learn(odd) == {} and {r["lang_pred"] for r in language.predict(odd, {}).collect()} == {"und"}
    assert values(language.predict(none, samples)) == [] and language.learn(none) == {}
    # one language alone
    assert {(r["lang_pred"], r["score"]) for r in language.predict(odd, {"en": samples["en"]}).where("lang_pred <> 'und'").collect()} == {("en", 1.0)}


def test_op11_long_text_counts_whole(spark):
    """The end of a long text decides as much as its start."""
    samples = {"de": [plain_text("der wort und haus ") * 3], "en": [plain_text("the house and word ") * 3]}
    text = "der wort und haus " * 20_000 + "the house and word " * 60_000
    row = language.predict(documents(spark, [(1, text, "s")]), samples).first()
    assert row["lang_pred"] == "en" and row["phrases"] > 40_000
