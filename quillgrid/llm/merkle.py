"""Merkle manifest of a dataset: a leaf per row, a tree per part, a root over the parts' subroots, and a proof per row.

A tree's leaves stand in the order of their ids; at each level runs of eight neighbours become the SHA-256 of their
digests' hex text, and the last run of a level may be shorter. How many nodes each level has is known from the tree's number of leaves, so
a node can be placed by (tree, level, index) alone and a run is known to be complete when all of its siblings are there.

That makes sparse forests a monoid: a ``Forest`` holds the nodes that are not yet resolved, and adding two forests joins their
nodes and turns each completed run into its parent, again and again. Partitions make forests of their own rows, and
``treeReduce`` adds them until only the subroots are open.

Rows are numbered by two passes: sorted by range, counted by partition, and shifted by the counts before them. They are then dealt
in chunks of ``8**height`` neighbours, which are whole subtrees; only digests and ids are moved, never texts. The runs above the chunks (the crown,
at most about ``CROWN`` nodes, since the height grows with the rows) go to every task, which rebuilds its chunks and reads each row's siblings off them.

Defined results: a null value is ``-`` in its leaf; the null part is a tree of its own and comes first, the empty one is another; rows of a null
id come first in their tree and are never tampered with; rows of one id stand in the order of their leaves; equal rows each
have their own place and proof; a lone leaf is its tree's subroot, a lone subroot is the root, and a row without siblings has the proof of
an empty text; an empty table gives no rows; other columns are ignored. Parts are taken to be few (languages): their subroots meet on the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgrid.llm.common import arrow_batches, shared_dir, table, written

#: Children of a node.
ARITY = 8
#: Most chunks, beside one a tree, above which the runs go to every task: under 20 MB.
CROWN = 1 << 18
LEAST_HEIGHT = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def width(leaves: int, level: int) -> int:
    """Nodes of a level of a tree."""
    return -(-leaves // ARITY**level)


@dataclass
class Forest:
    """Unresolved nodes by (tree, level) and index, and the runs that were resolved here; digests are hex text."""

    sizes: dict[str, int]
    open: dict[tuple[str, int], dict[int, str]] = field(default_factory=dict)
    runs: dict[tuple[str, int, int], str] = field(default_factory=dict)

    def put(self, tree: str, level: int, index: int, node: str) -> Forest:
        """Add a node; a run that it completes becomes the parent, which is added in turn."""
        while True:
            here = self.open.setdefault((tree, level), {})
            here[index] = node
            n, run = width(self.sizes[tree], level), index // ARITY
            siblings = range(run * ARITY, min(n, (run + 1) * ARITY))
            if n == 1 or not all(i in here for i in siblings):
                return self
            whole = self.runs[tree, level, run] = "".join(here.pop(i) for i in siblings)
            if not here:
                del self.open[tree, level]
            level, index, node = level + 1, run, digest(whole)

    def __add__(self, other: Forest) -> Forest:
        """Associative and commutative; the empty forest changes nothing. The sum takes this forest's place."""
        self.runs.update(other.runs)
        for (tree, level), nodes in other.open.items():
            for index, node in nodes.items():
                self.put(tree, level, index, node)
        return self

    def root(self, tree: str) -> str:
        """A whole tree's root."""
        level = next(k for k in range(64) if width(self.sizes[tree], k) == 1)
        return self.open[tree, level][0]

    def path(self, tree: str, level: int, index: int) -> list[tuple[str, str]]:
        """Siblings before and after a node and each of its ancestors, from its level up, by the runs resolved here."""
        out = []
        while width(self.sizes[tree], level) > 1:
            run, at = self.runs[tree, level, index // ARITY], 64 * (index % ARITY)
            out.append((run[:at], run[at + 64 :]))
            level, index = level + 1, index // ARITY
        return out


def subtree(leaves: list[str], height: int) -> list[str]:
    """Levels of a chunk's subtree as joined hex, the leaves first, up to its one node (at ``height`` at most)."""
    levels = ["".join(leaves)]
    size = 64 * ARITY
    for _ in range(height):
        levels.append("".join(digest(levels[-1][i : i + size]) for i in range(0, len(levels[-1]), size)))
    return levels


def height_of(sizes: Iterable[int], least: int = LEAST_HEIGHT, most: int = CROWN) -> int:
    """The chunks' height: the least at which at most ``most`` of them are full."""
    total, height = sum(sizes), least
    while total // ARITY**height > most:
        height += 1
    return height


# --- rows to numbered leaves ---------------------------------------------------------------------


def _framed(x: Column) -> Column:
    """A value's UTF-8 length and the value, ``-`` where it is null."""
    return F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-"))


def leaf_of(fields: Iterable[Column]) -> Column:
    return F.sha2(F.concat(*[_framed(x) for x in fields]).cast("binary"), 256)


def leaves(docs: DataFrame, fields: Iterable[str] = FIELDS, id_col: str = "doc_id", part_col: str = "lang", text_col: str = "text", tamper: int = 3) -> DataFrame:
    """``doc_id, tree, leaf, forged, row``: digests of every row; ``forged`` is the tampered one where ``tamper`` divides the id's crc32 (0: never)."""
    own = {c: F.col(f"`{c}`").cast("string") for c in fields}
    key = F.col(f"`{id_col}`").cast("long")
    picked = F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(tamper)) == 0 if tamper else F.lit(False)
    forged = own | {text_col: F.translate(own[text_col], _UPPER, _LOWER)} if text_col in own else own
    tree = F.coalesce(F.concat(F.lit("="), F.col(f"`{part_col}`").cast("string")), F.lit(""))
    return docs.select(key.alias("doc_id"), tree.alias("tree"), F.unhex(leaf_of(own.values())).alias("leaf"), F.when(picked, F.unhex(leaf_of(forged.values()))).alias("forged"), F.monotonically_increasing_id().alias("row"))


def numbered(own: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """Each leaf's index in its tree (``at``), and the leaves of each tree."""
    order = ["tree", "doc_id", "leaf", "row"]
    place = F.monotonically_increasing_id()
    placed = written(own.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", place).drop("row"), "merkle-ordered")
    part = F.shiftright("place", 33).alias("part")
    # one row for each partition and tree that meet there
    spans = placed.groupBy(part, "tree").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = written(spans.withColumn("shift", before - F.col("first")), "merkle-spans")
    sizes = {r["tree"]: r["n"] for r in shifts.groupBy("tree").agg(F.sum("n").alias("n")).collect()}
    met = placed.withColumn("part", part).join(F.broadcast(shifts.select("part", "tree", "shift")), ["part", "tree"])
    return met.select("doc_id", "tree", (F.col("place") + F.col("shift")).alias("at"), "leaf", "forged"), sizes


# --- manifest and proofs -------------------------------------------------------------------------


def _chunks(batches: Iterable[pa.RecordBatch], height: int) -> Iterator[tuple[str, int, list[tuple]]]:
    """(tree, chunk, its rows in order); a task's rows are sorted by tree and index."""
    rows = (row for b in arrow_batches(batches, column=3) for row in zip(*(c.to_pylist() for c in b.columns)))
    for (tree, chunk), own in groupby(rows, lambda r: (r[1], r[2] // ARITY**height)):
        yield tree, chunk, list(own)


def _top(height: int, leaves_of_tree: int) -> int:
    """The level of a chunk's one node: its height, or the tree's own where the tree is one chunk."""
    return next(k for k in range(height + 1) if k == height or width(leaves_of_tree, k) == 1)


@dataclass
class Manifest:
    """A dataset's root, its parts' subroots in order (the null part first), and what proofs need."""

    root: str
    subroots: list[tuple[str | None, str]]
    _dealt: DataFrame | None = None
    _height: int = 0
    _crown: Any = None
    _above: dict[str, list[tuple[str, str]]] = field(default_factory=dict)

    def proofs(self, spark: SparkSession, siblings: bool = False) -> DataFrame:
        """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` and, if asked for, ``siblings`` (hex digests from the leaf up) of every row."""
        schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + ", siblings array<string>" * siblings
        if self._dealt is None:
            return spark.createDataFrame([], schema)
        height, root, above, crown = self._height, self.root, self._above, self._crown
        subroots = {"" if part is None else "=" + part: digest_ for part, digest_ in self.subroots}

        def rows_of(tree: str, chunk: int, own: list[tuple]) -> Iterator[tuple]:
            forest: Forest = crown.value
            top = _top(height, forest.sizes[tree])
            levels = subtree([r[3].hex() for r in own], top)
            upper = forest.path(tree, top, chunk) + above[tree]
            upper_text = "".join(x for pair in upper for x in pair)
            for i, (doc_id, _, _, leaf, forged) in enumerate(own):
                pairs, j = [], i
                for level in levels[:-1]:
                    run = level[512 * (j // ARITY) : 512 * (j // ARITY + 1)]
                    at = 64 * (j % ARITY)
                    pairs.append((run[:at], run[at + 64 :]))
                    j //= ARITY
                inner = "".join(x for pair in pairs for x in pair)
                folded = (forged or leaf).hex()
                for before, after in (*pairs, *upper):
                    folded = digest(before + folded + after)
                out = doc_id, leaf.hex(), subroots[tree], root, digest(inner + upper_text), folded, folded == root
                both = inner + upper_text
                yield (*out, [both[k : k + 64] for k in range(0, len(both), 64)]) if siblings else out

        names = [x.split()[0] for x in schema.split(", ")]

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for tree, chunk, own in _chunks(batches, height):
                kept: list[tuple] = []
                for row in rows_of(tree, chunk, own):
                    kept.append(row)
                    if len(kept) == 4096:
                        yield _batch(kept, names)
                        kept = []
                if kept:
                    yield _batch(kept, names)

        return self._dealt.mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    kinds = {"doc_id": pa.int64(), "verified": pa.bool_(), "siblings": pa.list_(pa.string())}
    return pa.record_batch([pa.array(c, kinds.get(n, pa.string())) for c, n in zip(columns, names)], names)


def build(own: DataFrame, height: int | None = None) -> Manifest:
    """The manifest of the rows of ``leaves``."""
    spark = own.sparkSession
    shared_dir(spark)  # where checkpoints go
    rows, sizes = numbered(written(own, "merkle-leaves"))
    if not sizes:
        return Manifest(digest(""), [])
    height = height_of(sizes.values()) if height is None else height
    chunk = F.expr(f"at div {ARITY**height}")
    # a checkpoint keeps the partitions: both passes below read whole chunks, also after a loss of executors
    dealt = rows.repartition("tree", chunk).sortWithinPartitions("tree", "at").checkpoint()
    known = spark.sparkContext.broadcast(sizes)  # one number a tree

    def tops(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, chunk, own in _chunks(batches, height):
            top = _top(height, known.value[tree])
            yield pa.record_batch([pa.array([tree]), pa.array([top], pa.int32()), pa.array([chunk]), pa.array([subtree([r[3].hex() for r in own], top)[-1]])], ["tree", "level", "at", "node"])

    def forest(nodes: Iterable[Any]) -> Iterator[Forest]:
        out = Forest(known.value)
        for r in nodes:
            out.put(r["tree"], r["level"], r["at"], r["node"])
        yield out

    whole = dealt.mapInArrow(tops, "tree string, level int, at long, node string").rdd.mapPartitions(forest).treeReduce(lambda a, b: a + b)
    trees = sorted(sizes, key=str.encode)
    over = Forest({"": len(trees)})
    subroots = [whole.root(t) for t in trees]
    for i, node in enumerate(subroots):
        over.put("", 0, i, node)
    crown = spark.sparkContext.broadcast(whole)  # at most CROWN chunks, one more a tree, and an eighth above them
    parts = [None if t == "" else t[1:] for t in trees]
    return Manifest(over.root(""), list(zip(parts, subroots)), dealt, height, crown, {t: over.path("", 0, i) for i, t in enumerate(trees)})


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and what a tampered text folds to."""
    return build(leaves(table(spark, sf_dir, "documents"))).proofs(spark)


def oracle_sql(levels: int = 8, over: int = 4) -> str:
    """For up to 8**levels documents a language and 8**over languages."""
    framed = lambda x: f"coalesce(strlen({x}) || ':' || {x}, '-')"
    leaf = lambda text: f"sha256({' || '.join(framed(x) for x in ('doc_id::VARCHAR', 'source', 'lang', 'n_chars::VARCHAR', text))})"
    crc = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda s, b: list_reduce(list_concat([xor(s, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295)"

    def ladder(p: str, first: str, n: int) -> list[str]:
        """Nodes (tree, i, h, n of the level) of each level, and the siblings of each node."""
        out = [f"{p}0 AS (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM ({first}))"]
        out += [f"{p}{k + 1} AS (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM (SELECT tree, i // 8 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {p}{k} WHERE n > 1 GROUP BY tree, i // 8))" for k in range(n)]
        side = lambda frame: f"coalesce(string_agg(h, '') OVER (PARTITION BY tree, i // 8 ORDER BY i ROWS BETWEEN {frame}), '')"
        out += [f"{p}s{k} AS (SELECT tree, i, {side('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS b, {side('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS a FROM {p}{k} WHERE n > 1)" for k in range(n)]
        out.append(f"{p}top AS ({' UNION ALL '.join(f'SELECT tree, h FROM {p}{k} WHERE n = 1' for k in range(n + 1))})")
        return out

    def climb(p: str, source: str, name: str, tree: str, at: str, n: int) -> list[str]:
        """Fold and proof of each row, a level at a time."""
        out = []
        for k in range(n):
            now = f"{name}{k}"
            out.append(f"{now} AS (SELECT d.* REPLACE (CASE WHEN s.b IS NULL THEN d.folded ELSE sha256(s.b || d.folded || s.a) END AS folded, d.proof || coalesce(s.b || s.a, '') AS proof) FROM {source} d LEFT JOIN {p}s{k} s ON s.tree = {tree} AND s.i = {at} // {8**k})")
            source = now
        return out

    rows = f"SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM (SELECT doc_id, coalesce('=' || lang, '') AS tree, {leaf('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf(f'translate(text, {_UPPER!r}, {_LOWER!r})')} END AS forged FROM documents)"
    parts = [
        f"docs AS ({rows})",
        *ladder("l", "SELECT tree, i, leaf AS h FROM docs", levels),
        *ladder("r", "SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, h FROM ltop", over),
        "trees AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place FROM ltop)",
        "start AS (SELECT docs.*, subroot, place, coalesce(forged, leaf) AS folded, '' AS proof FROM docs JOIN trees USING (tree))",
        *climb("l", "start", "u", "d.tree", "d.i", levels),
        *climb("r", f"u{levels - 1}", "v", "''", "d.place", over),
    ]
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = h AS verified FROM v{over - 1}, rtop"
