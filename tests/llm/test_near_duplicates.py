"""The near-duplicate stage compares what can be alike, not all pairs and not all that hangs together by chance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from quillgrid.llm import simhash


def together(links):
    """The groups of two or more that links make."""
    group = {}
    for a, b in links:
        own = group.get(a, {a}) | group.get(b, {b})
        group.update(dict.fromkeys(own, own))
    return {frozenset(x) for x in group.values()}


def words(rng, n):
    return ["".join(rng.choice(list("abcdefghijklmnop"), 7)) for _ in range(n)]


def rooted(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return simhash.sets(docs, 5, 0.8).where("prefix is not null").selectExpr("*", "node as root").cache()


def test_chance_meetings_are_no_candidates(spark):
    """Each text shares a third of its words with the next: a chain of one group, in which no two are alike but the last."""
    rng = np.random.default_rng(11)
    long = words(rng, 200 + 60 * 70)
    texts = [" ".join(long[70 * i : 70 * i + 200]) for i in range(60)]
    texts.append(texts[-1].rsplit(" ", 15)[0])
    prints = rooted(spark, texts)
    node = {r.doc_id: r.node for r in prints.select("doc_id", "node").collect()}
    assert {frozenset(r) for r in simhash.candidate_links(prints, 0.8).collect()} == {frozenset((node[59], node[60]))}
    assert simhash.bucket_pairs(prints, 0.8).count() > 40


@pytest.mark.parametrize("small", [4, 64])
def test_candidates_of_crowds(spark, monkeypatch, small):
    """Texts that share much: whatever the size from which they are a crowd, similar ones are connected."""
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = np.random.default_rng(12)
    base, texts = words(rng, 150), []
    for _ in range(40):
        own = list(base)
        for at in rng.choice(150, int(rng.integers(1, 9)), replace=False):
            own[at] = "x" + str(rng.integers(1 << 30))
        texts.append(" ".join(own))
    prints = rooted(spark, texts)
    node = {r.doc_id: r.node for r in prints.select("doc_id", "node").collect()}
    sets = [set(simhash.shingle_hashes(x, 5)) for x in texts]
    alike = [(node[a], node[b]) for a in range(40) for b in range(a) if (m := len(sets[a] & sets[b])) >= 0.8 * (len(sets[a]) + len(sets[b]) - m)]
    found = together(map(tuple, simhash.candidate_links(prints, 0.8).collect()))
    assert alike and all(any(x <= y for y in found) for x in together(alike))


def test_maps_of_two_lengths():
    rng = np.random.default_rng(13)
    own = np.unique(rng.integers(0, 1 << 63, 3100, np.uint64))
    cut = own[200:]
    maps = [simhash.parity_map(own), simhash.parity_map(cut), simhash.parity_map(np.unique(rng.integers(0, 1 << 63, 2900, np.uint64)))]
    assert len(maps[0]) > len(maps[1])
    n = np.array([len(own)] * 2 + [len(cut)])
    assert simhash.map_pairs(n, np.array([len(cut), 2900, len(own)]), [maps[0], maps[0], maps[1]], [maps[1], maps[2], maps[0]], 0.8).tolist() == [True, False, True]


@pytest.mark.parametrize("most", [8192, 10])
@pytest.mark.parametrize("radius", [0, 1, 4])
def test_fingerprints_meet_by_parts(spark, monkeypatch, radius, most):
    """As if all pairs were compared, also where many agree in their parts; no step compares all with all."""
    monkeypatch.setattr(simhash, "MOST_PRINTS", most)
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 64, 40, np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (500, 3), np.uint64)
    v = np.unique(np.concatenate([base[rng.integers(0, 40, 500)] ^ flips[:, 0] ^ flips[:, 1] ^ flips[:, 2], base, rng.integers(0, 1 << 64, 300, np.uint64), np.arange(90, dtype=np.uint64) << np.uint64(50)]))
    near = np.triu(np.bitwise_count(v[:, None] ^ v[None, :]) <= radius, 1)
    signed = v.view(np.int64).tolist()
    wanted = together((signed[a], signed[b]) for a, b in zip(*np.nonzero(near)))
    found = [tuple(r) for r in simhash.table_links(spark.createDataFrame([(x,) for x in signed], "fp long"), radius).collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= radius for a, b in found)
    assert together(found) == wanted


def test_keep_one_does_not_compare_all_fingerprints(spark, monkeypatch):
    def all_pairs(*_):
        raise AssertionError("all pairs")

    monkeypatch.setattr(simhash, "links", all_pairs)
    rng = np.random.default_rng(14)
    text = words(rng, 400)
    docs = spark.createDataFrame([(0, " ".join(text)), (1, " ".join(text[:-1])), (2, " ".join(words(rng, 50)))], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [0, 2]


@pytest.mark.parametrize("cut", [1, 2, 3, 7, 100])
def test_groups_stay_whole(cut):
    h = np.repeat(np.arange(9), [1, 4, 1, 9, 2, 2, 1, 1, 5])
    batches = [pa.record_batch([pa.array(x), pa.array(-x)], ["h", "v"]) for x in np.split(h, range(cut, len(h), cut))]
    got = list(simhash.whole_groups(batches, least_rows=3))
    assert np.concatenate([x[0] for x in got]).tolist() == h.tolist() and all((x[0] == -x[1]).all() for x in got)
    assert all(x[0][-1] != y[0][0] for x, y in zip(got, got[1:]))


@pytest.mark.parametrize("size", [1, 2, 5, 8])
def test_shingles_as_their_words_say(size):
    """As many distinct shingles as there are runs of words, and as many shared ones, whatever their order, case and repeats."""
    rng = np.random.default_rng(size)
    few = ["a", "b", "c", "A", "\u00e9", "\u00c9", "x" * 40, "\ud800"]
    texts = ["", " \n", "a", "a b", "b a", "a a", "a a a"] + [" ".join(rng.choice(few, int(k))) for k in rng.integers(1, 40, 60)]
    plain = []
    for x in texts:
        own = "".join(c.lower() if c.isascii() else c for c in x).split()
        plain.append({tuple(own[i : i + size]) for i in range(max(1, len(own) - size + 1))} if own else set())
    got = [simhash.distinct_shingles(x, size) for x in texts]
    assert all((np.sort(x) == x).all() for x in got) and [len(x) for x in got] == [len(x) for x in plain]
    for i in range(len(texts)):
        assert [len(np.intersect1d(got[i], y)) for y in got[:i]] == [len(plain[i] & y) for y in plain[:i]]
