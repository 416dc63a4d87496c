"""The Merkle manifest against a plain tree, the forests as a monoid, and odd tables."""

from __future__ import annotations

import hashlib
import random
import zlib
from functools import reduce

import pytest
from pyspark.sql import functions as F

from quillgrid.llm import merkle
from tests.llm.test_llm_operators import ODD, SF, documents, duck, none, odd, same_as_sql, values  # noqa: F401


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, lower=False):
    shown = list(row)
    if lower and shown[4] is not None:
        shown[4] = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in shown[4])
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in shown))


def plain_tree(nodes):
    """Root, and each leaf's siblings (before, after) from its level up."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i // 8 * 8 : i // 8 * 8 + 8]
            paths[k].append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
        nodes, at = [sha(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)], [i // 8 for i in at]
    return nodes[0], paths


def plain(rows):
    """The rows that the operator returns; rows: (doc_id, source, lang, n_chars, text)."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees.append((own, *plain_tree([plain_leaf(r) for r in own])))
    root, above = plain_tree([t[1] for t in trees]) if trees else (None, [])
    out = []
    for (own, subroot, paths), over in zip(trees, above):
        for r, path in zip(own, paths):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            folded = plain_leaf(r, tampered)
            for before, after in path + over:
                folded = sha(before, folded, after)
            out.append((r[0], plain_leaf(r), subroot, root, sha(*(x for pair in path + over for x in pair)), folded, folded == root))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def proved(df, height=None):
    return values(merkle.build(merkle.leaves(df), height).proofs(df.sparkSession), *COLUMNS)


def test_op13_whole_table(spark, duck):  # noqa: F811
    same_as_sql(spark, duck, "op13_merkle_manifest")


@pytest.mark.parametrize("height", [1, 2, None])
def test_op13_sizes(spark, height):
    """Trees of one leaf, of full and of broken runs, in chunks of every height; ten trees make two levels above."""
    sizes = {"a": 1, "b": 2, "c": 8, "d": 9, "e": 64, "é": 65, "": 513, None: 73, "Z": 7, "zz": 520}
    rows = [(i * 7 % 1009, "s", lang, i, f"Text {lang} {i}") for lang, n in sizes.items() for i in range(n)]
    random.Random(3).shuffle(rows)
    assert proved(frame(spark, rows).repartition(5), height) == plain(rows)


def test_op13_odd_rows(spark, odd):  # noqa: F811
    rows = [(i, s, None, None, t) for i, t, s in ODD]
    found = proved(odd, 1)
    assert found == plain(rows)
    # null values aren't tampered with, and a text without capitals stays true
    assert all(r[-1] for r in found)


def test_op13_ties_and_repeated_rows(spark):
    rows = [(5, "s", "x", 1, f"Text {i % 3}") for i in range(700)] + [(None, None, None, None, None)] * 90 + [(None, "s", "x", 1, "T")]
    assert proved(frame(spark, rows).repartition(4), 1) == plain(rows)


def test_op13_no_rows_and_one(spark, none):  # noqa: F811
    assert proved(none) == []
    assert merkle.build(merkle.leaves(none)).subroots == []
    rows = [(3, "s", "en", 1, "A")]
    assert proved(frame(spark, rows)) == plain(rows)
    assert plain(rows)[0][4] == sha("")


def test_op13_tampering_is_told(spark):
    rows = [(i, "s", "en", 1, "Capital") for i in range(100)]
    found = proved(frame(spark, rows), 1)
    assert {r[0] for r in found if not r[-1]} == {i for i in range(100) if zlib.crc32(str(i).encode()) % 3 == 0}


def test_op13_siblings(spark):
    df = frame(spark, [(i, "s", f"l{i % 3}", 1, f"t{i}") for i in range(200)])
    manifest = merkle.build(merkle.leaves(df), 1)
    found = manifest.proofs(spark, siblings=True).withColumn("again", F.sha2(F.concat_ws("", "siblings").cast("binary"), 256)).collect()
    assert len(found) == 200 and all(r["again"] == r["proof_sha256"] and all(len(x) == 64 for x in r["siblings"]) for r in found)
    assert [p for p, _ in manifest.subroots] == ["l0", "l1", "l2"]


@pytest.mark.parametrize("seed", range(6))
def test_op13_forest_is_a_monoid(seed):
    """Any split of the nodes, added in any order and grouping, gives one forest: that of the whole tree."""
    rng = random.Random(seed)
    sizes = {t: rng.choice([1, 7, 8, 9, 63, 64, 65, 200, 511]) for t in "abc"}
    nodes = [(t, 0, i, sha(t, str(i))) for t, n in sizes.items() for i in range(n)]
    rng.shuffle(nodes)
    cuts = sorted(rng.sample(range(len(nodes) + 1), min(9, len(nodes))))
    pieces = [nodes[a:b] for a, b in zip([0, *cuts], [*cuts, len(nodes)])]

    def forest(some):
        return reduce(lambda f, n: f.put(*n), some, merkle.Forest(sizes))

    def shown(f):
        return f.open, f.runs

    left = reduce(lambda a, b: a + b, map(forest, pieces), merkle.Forest(sizes))
    right = reduce(lambda a, b: b + a, map(forest, reversed(pieces)))
    grouped = (forest(pieces[0]) + forest(pieces[1])) + reduce(lambda a, b: a + b, map(forest, pieces[2:]), merkle.Forest(sizes))
    assert shown(left) == shown(right) == shown(grouped)
    for t, n in sizes.items():
        root, paths = plain_tree([sha(t, str(i)) for i in range(n)])
        assert left.root(t) == root
        assert [left.path(t, 0, i) for i in range(n)] == paths


def test_op13_height_keeps_the_crown_small():
    for total in (1, 10**6, 4 * 10**10, 10**13):
        height = merkle.height_of([total])
        assert total // 8**height <= merkle.CROWN
        assert height == merkle.LEAST_HEIGHT or total // 8 ** (height - 1) > merkle.CROWN
