"""SimHash near-duplicates: fingerprints, a tiled exact comparison, and components.

Fingerprints. A text's ASCII letters are lower-cased, words are what stands between ASCII white
space, shingles are runs of ``size`` words joined by one space (repeats count; fewer words: the
whole sequence). A bit is set if it is set in over half of the shingles' XXH64 values (seed 42).

Comparison. Equal fingerprints are one node. The nodes are split into blocks by population count
(a histogram of 65 rows decides; a crowded count is split further by hash), each pair of blocks
whose counts can differ by at most the radius is one task, and inside a task rows lie in tiles of
equal population counts of both halves; a tile pair whose counts differ beyond the radius is
skipped, every other is compared in full with exclusive-or and bit counts in numpy. A task returns
a minimum spanning forest of the links it finds, never all pairs.

Similarity (``keep_one``). A set of distinct shingles is one node. First, nodes are linked by SimHash (of the distinct shingles, as repeats
say nothing about a Jaccard similarity; fingerprints meet where two of ``radius`` + 2 parts of their bits agree, so not all with all), and within each component so found all pairs are compared: links of ``least`` or more stay, and their components are the nodes' roots.
Fingerprints can be far apart for such a pair, so an exact way follows for the rest, i.e. for pairs of different roots. The shingles of a set have an order (common ones last); of two similar sets,
the first shared shingle lies in a prefix of both, of about 1 - ``least`` of their length. Rows are dealt by the prefix's
shingles. Pairs that sizes, places and then the two sets' parity maps rule out are dropped one by one; only where over ``SMALL`` sets meet in one shingle, components of what sizes and places
leave are taken first and split by maps. Within a component of what is left all pairs of sets are compared, in blocks of bounded size.

Components. Each task turns its links into stars; these are contracted by alternating large and small stars
until each node has one centre, with a table in the shared folder after each round. Nothing but a count reaches the driver.

The comparison of ``near_duplicates`` is exact and so grows with the square of the number of distinct fingerprints; block
size is bounded, hence so is a task's memory.

Defined results: a null text is empty and has fingerprint zero, linked like any other; rows whose
doc_id is null are kept and belong to the component of their fingerprint, whose id is the smallest
doc_id that is not null (null if there is none); repeated rows and doc_ids are kept; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm.common import arrow_batches, drop_written, forget, id_and_text, table, written, written_at

#: Rows of a block at most (up to the unevenness of a hash); a task holds two blocks.
BLOCK_ROWS = 1 << 17
#: Blocks at least, so that small inputs keep several cores busy too.
LEAST_BLOCKS = 6
#: Rows and columns of a comparison at most.
TILE = 512
#: One of so many texts counts for common shingles; counts from LEAST_COMMON on, MOST_COMMON shingles at most.
SAMPLE_OF, LEAST_COMMON, MOST_COMMON = 16, 3, 100_000
#: Nodes that a task holds when it turns links into stars.
STAR_NODES = 1 << 18
#: Keeps rounding from making a bound too strict.
SLACK = 1e-6
#: Nodes of one shingle up to which each pair is tried, and of one group up to which sets are intersected one by one.
SMALL, FEW = 64, 6
#: Fingerprints of one key that are compared in one task, two blocks of them at most; cells that keys are counted by first.
MOST_PRINTS, PRINT_CELLS = 8192, 1 << 16
#: Blocks of a group: rows aimed at, in how many blocks at most, then rows and shingles of a block at most (but for one hash's unevenness).
GROUP_ROWS, GROUP_WAYS, MOST_GROUP_ROWS, GROUP_SHINGLES = 256, 16, 1024, 1 << 20
#: Larger groups are first split by parity maps: bytes of a map, those of sets of over LONG shingles, rows of a block.
LARGE, MAP_BYTES, LONG_BYTES, LONG, MAP_ROWS = 64, 256, 2048, 3000, 2048
#: Shingles of a matrix product.
COLUMNS = 4096


def shingle_hashes(text: str, size: int) -> list[int]:
    """XXH64 (seed 42) of each shingle, in order."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= size:
        return [digest(joined, 42)]
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    return [digest(joined[a : b - 1], 42) for a, b in zip(starts, ends[size - 1 :])]


def fingerprint_batch(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints of texts as unsigned 64-bit integers, and their numbers of distinct shingles."""
    hashes = [shingle_hashes(x, size) for x in texts]
    counts = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        flat = np.fromiter((h for hs in hashes for h in hs), "<u8", int(counts.sum()))
        bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = (np.cumsum(counts) - counts)[some]
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        out[some] = np.packbits(2 * ones > counts[some, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out, np.array([len(set(h)) for h in hashes], np.int64)


def fingerprints(docs: DataFrame, size: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, tie, fp, n``: the fingerprint as a (signed) long; ``tie`` is a hash of the text, ``n`` its number of distinct shingles."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in arrow_batches(batches, column=2, most_bytes=1 << 20):
            found, sizes = fingerprint_batch(b.column(2).to_pylist(), size)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(found.view(np.int64)), pa.array(sizes)], ["doc_id", "tie", "fp", "n"])

    source = id_and_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("tie"), "text")
    return source.mapInArrow(run, "doc_id long, tie long, fp long, n long")


def plan_blocks(histogram: dict[int, int], block_rows: int = BLOCK_ROWS, least_blocks: int = LEAST_BLOCKS) -> list[tuple[int, int, int]]:
    """Blocks as (lowest count, highest count, ways): population counts lowest to highest, ``ways`` hash parts."""
    rows = sum(histogram.values())
    target = max(1, min(block_rows, math.ceil(rows / least_blocks)))
    out: list[tuple[int, int, int]] = []
    low, total = None, 0
    counts = sorted(histogram)
    for i, p in enumerate(counts):
        if low is None:
            low, total = p, 0
        total += histogram[p]
        follows = histogram[counts[i + 1]] if i + 1 < len(counts) else 0
        if total + follows > target or i + 1 == len(counts):
            out.append((low, p, math.ceil(total / target)))
            low = None
    return out


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def _spanning(distance: np.ndarray, allowed: np.ndarray, radius: int, one_side: bool) -> list[tuple[int, int, int]]:
    """(row, column, distance): a minimum spanning forest of a dense tile, nearest links first.

    ``one_side``: rows and columns are the same nodes.
    """
    rows, cols = distance.shape
    forest = Forest(rows + cols)
    for i in range(rows if one_side else 0):
        forest.join(i, rows + i)
    out = []
    for d in range(radius + 1):
        near = allowed & (distance == d)
        while True:
            label = np.fromiter(map(forest.root, range(rows + cols)), np.int64, rows + cols)
            open_ = near & (label[:rows, None] != label[None, rows:])
            some = np.flatnonzero(open_.any(1))
            if not len(some):
                break
            for i, j in zip(some.tolist(), open_[some].argmax(1).tolist()):
                if forest.root(i) != forest.root(rows + j):
                    forest.join(i, rows + j)
                    out.append((i, j, d))
    return out


def _tiles(values: np.ndarray, offset: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(count of the low half, count of the high half, values, indices): tiles of equal counts."""
    low = np.bitwise_count(values & np.uint64(0xFFFFFFFF)).astype(np.int64)
    high = np.bitwise_count(values >> np.uint64(32)).astype(np.int64)
    order = np.argsort(low * 64 + high, kind="stable")
    key = (low * 64 + high)[order]
    edges = np.flatnonzero(np.diff(key)) + 1
    out = []
    for part in np.split(order, edges) if len(order) else []:
        for at in range(0, len(part), TILE):
            own = part[at : at + TILE]
            out.append((int(low[own[0]]), int(high[own[0]]), values[own], own + offset))
    return out


def _forest_of(found: np.ndarray, n: int) -> np.ndarray:
    """The links (first, second, distance) that a minimum spanning forest keeps."""
    forest, kept = Forest(n), []
    order = np.argsort(found[:, 2], kind="stable")
    for at, (x, y) in zip(order.tolist(), found[order, :2].tolist()):
        if forest.root(x) != forest.root(y):
            forest.join(x, y)
            kept.append(at)
    return found[kept]


def compare_blocks(first: np.ndarray, second: np.ndarray | None, radius: int) -> np.ndarray:
    """Links (indices, distance) within the radius that connect all nodes which links within the radius connect.

    ``second`` follows ``first``, None: a block with itself. They are a minimum spanning forest of all such links.
    """
    n = len(first) + (0 if second is None else len(second))
    left = _tiles(first, 0)
    right = left if second is None else _tiles(second, len(first))
    lows, highs = np.array([t[0] for t in right], np.int64), np.array([t[1] for t in right], np.int64)
    found, held = [np.empty((0, 3), np.int64)], 0
    for i, (low, high, values, indices) in enumerate(left):
        near = np.flatnonzero(np.abs(lows - low) + np.abs(highs - high) <= radius)
        for j in near[near >= i] if second is None else near:
            _, _, others, their = right[j]
            distance = np.bitwise_count(values[:, None] ^ others[None, :])
            hit = distance <= radius
            same = second is None and i == j
            if same:
                hit = np.triu(hit, 1)
            if not hit.any():
                continue
            dense = np.count_nonzero(hit) > len(values) + len(others)
            if dense:
                spans = np.array(_spanning(distance, hit | hit.T if same else hit, radius, same), np.int64)
                x, y = spans[:, 0], spans[:, 1]
            else:
                x, y = np.nonzero(hit)
            own = np.stack([indices[x], their[y], distance[x, y].astype(np.int64)], axis=1)
            found.append(own)
            held += len(own)
            if held > 1_000_000:
                found = [_forest_of(np.concatenate(found), n)]
                held = len(found[0])
    return _forest_of(np.concatenate(found), n)


def links(nodes: DataFrame, radius: int, block_rows: int = BLOCK_ROWS, least_blocks: int = LEAST_BLOCKS) -> DataFrame:
    """``a, b``: links of distinct ``fp`` under the radius, as ``compare_blocks`` gives them."""
    spark = nodes.sparkSession
    counted = nodes.select("fp", F.bit_count("fp").alias("ones"))
    blocks = plan_blocks({r["ones"]: r["n"] for r in counted.groupBy("ones").agg(F.count("*").alias("n")).collect()}, block_rows, least_blocks)
    if not blocks:
        return spark.createDataFrame([], "a long, b long")
    firsts = [0, *accumulate(ways for *_, ways in blocks)]
    # for each of 65 counts: its first block, hash parts, and the first and last block that it must meet
    plan: dict[int, tuple[int, int, int, int]] = {}
    for i, (low, high, ways) in enumerate(blocks):
        near = [j for j, (lo, hi, _) in enumerate(blocks) if max(lo - high, low - hi) <= radius]
        for p in range(low, high + 1):
            plan[p] = firsts[i], ways, firsts[near[0]], firsts[near[-1] + 1] - 1
    names = ("first", "ways", "low", "high")
    by_count = F.create_map(*[x for p, own in plan.items() for x in (F.lit(p), F.struct(*[F.lit(v).alias(name) for name, v in zip(names, own)]))])
    blocked = counted.select("fp", by_count[F.col("ones")].alias("own")).select("fp", (F.col("own.first") + F.pmod(F.xxhash64("fp"), F.col("own.ways"))).cast("int").alias("block"), "own.low", "own.high")
    met = blocked.select("fp", "block", F.explode(F.sequence("low", "high")).alias("other"))
    sent = met.select(F.least("block", "other").alias("k"), F.greatest("block", "other").alias("m"), (F.col("block") > F.col("other")).alias("second"), "fp")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        forget()
        values = pdf["fp"].to_numpy(np.int64).view(np.uint64)
        second = pdf["second"].to_numpy(bool)
        a, b = values[~second], values[second]
        found = compare_blocks(a, None if pdf["k"].iloc[0] == pdf["m"].iloc[0] else b, radius)
        both = np.concatenate([a, b]).view(np.int64)
        return pd.DataFrame({"a": both[found[:, 0]], "b": both[found[:, 1]]})

    # an own exchange with a fixed number of partitions: a pair is few bytes and much work
    dealt = sent.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "k", "m")
    return dealt.groupBy("k", "m").applyInPandas(run, "a long, b long")


def in_stars(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``u, v``: links that connect the nodes that a task's links ``a, b`` connect, from each node to its tree's smallest.

    Trees go once they have ``STAR_NODES`` nodes in all, which bounds a task's memory; they then overlap.
    """
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    def stars() -> pa.RecordBatch:
        found = [(x, y) for x in list(up) if (y := root(x)) != x]
        up.clear()
        got = np.array(found, np.int64).reshape(-1, 2)
        return pa.record_batch([pa.array(got[:, 0]), pa.array(got[:, 1])], ["u", "v"])

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = root(x), root(y)
            up[max(x, y)] = min(x, y)
            if len(up) >= STAR_NODES:
                yield stars()
    if up:
        yield stars()


def are_stars(links: DataFrame) -> bool:
    """Whether each ``u`` has one ``v``, which is no ``u`` itself."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    counted = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not counted.where("up > 1 or up = 1 and down = 1").agg(F.count("*")).first()[0]


def components(edges: DataFrame, what: str = "links") -> DataFrame:
    """``node, root``: the smallest node of each component, for nodes that have a link."""
    pairs = edges.select("a", "b").where("a <> b")
    now, path = written_at(pairs.mapInArrow(in_stars, "u long, v long").distinct(), what)
    while not are_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        # large star: a node's larger neighbours go to the smallest of its neighbours and itself
        large = now.join(least, "v").select("u", F.col("m").alias("v")).distinct()
        # small star: a node's smaller neighbours and itself go to the smallest of them
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after, later = written_at(small.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct(), what)
        drop_written(now.sparkSession, path)
        now, path = after, later
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _spanning_of(n: int, linked: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links of a spanning forest of 0..n-1; ``linked`` says which of some nodes one node is linked with."""
    rest, out = np.arange(n), []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            hit = linked(x, rest)
            met = rest[hit].tolist()
            out += [(x, y) for y in met]
            queue += met
            rest = rest[~hit]
    return out


def distinct_shingles(text: str, size: int) -> np.ndarray:
    """The sorted distinct shingles of a text as hashes: of their words' XXH64, each weighted by its place, and their number."""
    import xxhash

    own = text.encode("utf-8", "surrogatepass").lower().split()
    if not own:
        return np.empty(0, np.uint64)
    # one hash a word and no other step a word: shingles are put together in numpy
    each = np.frombuffer(b"".join(map(xxhash.xxh64_digest, own)), "<u8")
    wide = min(size, len(own))
    many = len(own) - wide + 1
    found = np.full(many, wide, np.uint64)
    for i in range(wide):
        # an odd weight of its own for each place
        found += each[i : i + many] * np.uint64(pow(0x9E3779B97F4A7C15, i + 1, 1 << 64))
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        found ^= found >> np.uint64(33)
        found *= np.uint64(factor)
    found ^= found >> np.uint64(33)
    found.sort()
    new = np.ones(many, bool)
    new[1:] = found[1:] != found[:-1]
    return found[new]


def fingerprint_of(own: np.ndarray) -> int:
    """The SimHash of distinct shingles as a signed integer: a bit is set if it is set in over half of them."""
    ones = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(own), bitorder="little").view("<i8")[0])


def common_shingles(source: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that several texts of a sample have, and their counts.

    They come last in the order of a prefix. Any order gives the same links; this one keeps groups small.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in arrow_batches(batches, column=0, most_bytes=1 << 18):
            found = [distinct_shingles(x, size) for x in b.column(0).to_pylist()]
            yield pa.record_batch([pa.array(np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64))], ["h"])

    tie = F.xxhash64("text")
    sample = source.select(tie.alias("tie"), "text").where(F.pmod("tie", F.lit(SAMPLE_OF)) == 0).dropDuplicates(["tie"]).select("text")
    counted = sample.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COMMON)
    top = counted.orderBy(F.desc("n"), "h").limit(MOST_COMMON).toArrow()
    hashes, counts = top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def prefix(own: np.ndarray, least: float, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first of the sorted distinct shingles ``own`` in the order of (count among common ones, hash).

    Of two sets with a Jaccard similarity of ``least`` or more, the first shared shingle is in both prefixes.
    """
    many = len(own) - max(1, math.ceil(least * len(own) - SLACK)) + 1
    hashes, counts = common
    if len(hashes):
        at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
        own = own[np.argsort(np.where(hashes[at] == own, counts[at], 0), kind="stable")]
    return own[:many]


def parity_map(own: np.ndarray) -> bytes:
    """A bit for each value of the hashes' last bits: set if an odd number of the shingles has it."""
    size = LONG_BYTES if len(own) > LONG else MAP_BYTES
    seen = np.bincount((own & np.uint64(8 * size - 1)).astype(np.int64), minlength=8 * size)
    return np.packbits(seen & 1, bitorder="little").tobytes()


def map_links(maps: list[bytes], n: np.ndarray, least: float, roots: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of all pairs that sizes and parity maps don't rule out, and that aren't of one root.

    Two maps differ in no more bits than their sets in shingles. A longer map is folded to the shortest one's length.
    """
    short = min(map(len, maps))
    words = np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, short // 8), axis=0) for x in maps])
    share = (1 - least) / (1 + least)

    def can(x: int, rest: np.ndarray) -> np.ndarray:
        out = (roots[x] != roots[rest]) & (np.minimum(n[x], n[rest]) >= least * np.maximum(n[x], n[rest]) - SLACK)
        near = rest[out]
        out[out] = np.bitwise_count(words[near] ^ words[x]).sum(axis=1, dtype=np.int64) <= share * (n[x] + n[near]) + SLACK
        return out

    return _spanning_of(len(maps), can)


def sets(source: DataFrame, size: int, least: float) -> DataFrame:
    """``doc_id, tie, node, n, fp, prefix, map``: ``tie`` is a hash of the text, ``node`` of its ``n`` distinct shingles; a task gives a node's fingerprint, prefix and map once."""
    common = common_shingles(source, size)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        forget()
        seen: set[int] = set()
        for b in arrow_batches(batches, column=2, most_bytes=1 << 20):
            nodes, sizes, prints, first, maps = [], [], [], [], []
            for text in b.column(2).to_pylist():
                own = distinct_shingles(text, size)
                node = xxhash.xxh64_intdigest(own.tobytes(), 42)
                nodes.append(node)
                sizes.append(len(own))
                first.append(prefix(own, least, common).tobytes() if len(own) and node not in seen else None)
                prints.append(fingerprint_of(own) if first[-1] is not None else None)
                maps.append(parity_map(own) if first[-1] is not None else None)
                seen.add(node)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), pa.array(first, pa.binary()), pa.array(maps, pa.binary())], ["doc_id", "tie", "node", "n", "fp", "prefix", "map"])

    return source.select("doc_id", F.xxhash64("text").alias("tie"), "text").mapInArrow(run, "doc_id long, tie long, node long, n long, fp long, prefix binary, map binary")


def whole_groups(batches: Iterable[pa.RecordBatch], least_rows: int = 100_000) -> Iterator[np.ndarray]:
    """The batches' integer columns as the rows of an array, cut so that equal values of the first column, by which rows are sorted, stay together."""
    held: list[np.ndarray] = []
    for b in batches:
        if not b.num_rows:
            continue
        rows = np.stack([x.to_numpy().astype(np.int64) for x in b.columns])
        # the last value's group may go on in the next batch
        edge = int(np.searchsorted(rows[0], rows[0, -1]))
        if edge or held and held[-1][0, -1] != rows[0, 0]:
            held.append(rows[:, :edge])
            if sum(x.shape[1] for x in held) >= least_rows:
                yield np.concatenate(held, axis=1)
                held = []
            held.append(rows[:, edge:])
        else:
            held.append(rows)
    if held:
        yield np.concatenate(held, axis=1)


def near_prints(key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all fingerprints of one key which links within ``radius`` connect, for rows sorted by key."""
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    many = np.diff(np.append(starts, len(key)))
    out_a, out_b, bits = [np.empty(0, np.int64)], [np.empty(0, np.int64)], fp.view(np.uint64)
    for x, y in _pairs_of(starts, many):
        hit = np.bitwise_count(bits[x] ^ bits[y]) <= radius
        out_a.append(fp[x[hit]])
        out_b.append(fp[y[hit]])
    for start, count in zip(starts[many > SMALL].tolist(), many[many > SMALL].tolist()):
        own, of = fp[start : start + count], bits[start : start + count]
        found = np.array(_spanning_of(count, lambda x, rest: np.bitwise_count(of[x] ^ of[rest]) <= radius), np.int64).reshape(-1, 2)
        out_a.append(own[found[:, 0]])
        out_b.append(own[found[:, 1]])
    return np.concatenate(out_a), np.concatenate(out_b)


def _pairs_of(starts: np.ndarray, many: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs within groups of 2 to ``SMALL`` rows, a distance of places at a time."""
    some = (many > 1) & (many <= SMALL)
    rest = np.repeat(many[some], many[some])
    at = np.arange(len(rest)) - np.repeat(np.cumsum(many[some]) - many[some], many[some])
    rest, at = rest - at, at + np.repeat(starts[some], many[some])
    for lag in range(1, SMALL):
        at = at[rest > lag]
        rest = rest[rest > lag]
        if not len(at):
            return
        yield at, at + lag


def table_links(prints: DataFrame, radius: int) -> DataFrame:
    """``a, b``: links that connect all of the distinct ``fp`` which links within ``radius`` connect.

    Of ``radius`` + 2 parts of the bits, two such fingerprints agree in two at least, so each meets only those of its two
    parts, once for each choice of two. Where many agree they are dealt to blocks, and every two blocks meet in one task.
    """
    parts = radius + 2
    edges = [64 * i // parts for i in range(parts + 1)]
    part = [((1 << high) - 1) ^ ((1 << low) - 1) for low, high in zip(edges, edges[1:])]
    masks = [(x | y) - (1 << 64 if (x | y) >> 63 else 0) for i, x in enumerate(part) for y in part[:i]]
    met = prints.select("fp", F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(masks)])).alias("key"))
    # few cells are counted first, then only the keys of crowded ones
    cell = F.pmod("key", F.lit(PRINT_CELLS)).cast("int")
    crowded = met.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).where(F.col("n") > MOST_PRINTS).select("cell")
    ways = met.withColumn("cell", cell).join(F.broadcast(crowded), "cell", "left_semi").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > MOST_PRINTS)
    ways = ways.select("key", F.ceil(F.col("n") / MOST_PRINTS).cast("int").alias("ways"))
    placed = met.join(F.broadcast(ways), "key", "left").withColumn("ways", F.coalesce("ways", F.lit(1)))
    block = F.pmod(F.xxhash64("fp"), F.col("ways")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("ways") - 1), lambda o: (F.col("ways") == 1) | (o != F.col("block")))
    dealt = placed.withColumn("block", block).select("key", "fp", "block", F.explode(others).alias("other"))
    sent = dealt.select(F.when((F.col("block") == 0) & (F.col("other") == 0), F.col("key")).otherwise(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))).alias("key"), "fp")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for rows in whole_groups(batches):
            a, b = near_prints(*rows, radius)
            yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sent.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def fingerprint_links(prints: DataFrame, radius: int) -> DataFrame:
    """``a, b``: links that connect all nodes whose fingerprints' links within ``radius`` connect; equal fingerprints are linked too."""
    own = written(prints.where("fp is not null").select("fp", "node").distinct(), "fingerprints")
    first = written(own.groupBy("fp").agg(F.min("node").alias("first")), "nodes")
    equal = own.join(first, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    of = lambda name: first.select(F.col("fp").alias(name), F.col("first").alias(f"{name}_node"))
    near = table_links(first, radius).distinct().join(of("a"), "a").join(of("b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    return equal.unionByName(near)


def bucket_links(h: np.ndarray, node: np.ndarray, n: np.ndarray, left: np.ndarray, roots: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of nodes of different ``roots`` whose prefixes share a shingle and that can reach ``least``, for rows sorted by shingle, and whether they are but links of a crowd.

    ``n`` is a node's number of shingles and ``left`` of those from this one on: two nodes whose first
    shared shingle this is share no more than the lesser ``left``. Groups of over ``SMALL`` are crowds and give a spanning forest, others all pairs.
    """
    # most shingles have one row, which is done with
    same = h[1:] == h[:-1]
    some = np.append(same, False) | np.append(False, same) if len(h) else np.empty(0, bool)
    h, node, n, left, roots = h[some], node[some], n[some], left[some], roots[some]
    order = np.lexsort((node, h))
    new = np.ones(len(h), bool)
    new[1:] = (h[order[1:]] != h[order[:-1]]) | (node[order[1:]] != node[order[:-1]])
    order = order[new]
    h, node, n, left, roots = h[order], node[order], n[order], left[order], roots[order]
    starts = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.empty(0, np.int64)
    many = np.diff(np.append(starts, len(h)))
    pairs, links = [np.empty((0, 2), np.int64)], [np.empty((0, 2), np.int64)]
    share = least / (1 + least)

    def can(x: np.ndarray | int, y: np.ndarray) -> np.ndarray:
        least_n, most_n = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
        return (roots[x] != roots[y]) & (least_n >= least * most_n - SLACK) & (np.minimum(left[x], left[y]) >= share * (n[x] + n[y]) - SLACK)

    for x, y in _pairs_of(starts, many):
        hit = can(x, y)
        pairs.append(np.stack([node[x[hit]], node[y[hit]]], axis=1))
    for start, count in zip(starts[many > SMALL].tolist(), many[many > SMALL].tolist()):
        found = np.array(_spanning_of(count, lambda x, rest: can(start + x, start + rest)), np.int64).reshape(-1, 2) + start
        links.append(node[found])
    # nodes of a group are sorted, so a pair is told by its order
    own, of_crowd = np.unique(np.concatenate(pairs), axis=0), np.concatenate(links)
    both = np.concatenate([own, of_crowd])
    return both[:, 0], both[:, 1], np.arange(len(both)) >= len(own)


def bucket_pairs(prints: DataFrame, least: float) -> DataFrame:
    """``a, b, crowd``: all pairs that ``bucket_links`` finds, each once, and links that connect those of crowds."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in arrow_batches(batches, column=2, most_bytes=1 << 19):
            parts = [np.frombuffer(x, np.int64) for x in b.column(2).to_pylist()]
            many = np.array([len(x) for x in parts], np.int64)
            node, n, root = (np.repeat(b.column(i).to_numpy(), many) for i in (0, 1, 3))
            place = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            yield pa.record_batch([pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64)), pa.array(node), pa.array(n.astype(np.int32)), pa.array((n - place).astype(np.int32)), pa.array(root)], ["h", "node", "n", "left", "root"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        for rows in whole_groups(batches):
            a, b, crowd = bucket_links(*rows, least)
            keep = ~crowd
            for at in np.flatnonzero(crowd).tolist():
                u, v = root(int(a[at])), root(int(b[at]))
                if u != v:
                    up[max(u, v)] = min(u, v)
                    keep[at] = True
            yield pa.record_batch([pa.array(a[keep]), pa.array(b[keep]), pa.array(crowd[keep])], ["a", "b", "crowd"])

    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = prints.where("prefix is not null").select("node", "n", "prefix", "root").mapInArrow(cut, "h long, node long, n int, left int, root long")
    return rows.repartition(tasks, "h").sortWithinPartitions("h").mapInArrow(run, "a long, b long, crowd boolean").distinct()


def map_pairs(n: np.ndarray, m: np.ndarray, first: list[bytes], second: list[bytes], least: float) -> np.ndarray:
    """Which of the pairs of sets of ``n`` and ``m`` shingles their parity maps don't rule out; a longer map is folded."""
    share = (1 - least) / (1 + least)
    bits = np.zeros(len(first), np.int64)
    lengths = np.array([(len(x), len(y)) for x, y in zip(first, second)], np.int64).reshape(-1, 2)
    for a, b in np.unique(lengths, axis=0).tolist():
        at, short = np.flatnonzero((lengths == (a, b)).all(axis=1)), min(a, b)
        x, y = (np.bitwise_xor.reduce(np.frombuffer(b"".join(maps[i] for i in at.tolist()), np.uint64).reshape(len(at), -1, short // 8), axis=1) for maps in (first, second))
        bits[at] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return bits <= share * (n + m) + SLACK


def checked_pairs(pairs: DataFrame, prints: DataFrame, least: float) -> DataFrame:
    """``a, b``: the pairs that parity maps don't rule out, each held against its own two maps."""
    maps = prints.where("map is not null").select("node", "n", "map").dropDuplicates(["node"])
    of = lambda name, n, map_: maps.select(F.col("node").alias(name), F.col("n").alias(n), F.col("map").alias(map_))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in arrow_batches(batches, column=4, most_bytes=1 << 20):
            can = map_pairs(b.column(2).to_numpy(), b.column(3).to_numpy(), b.column(4).to_pylist(), b.column(5).to_pylist(), least)
            yield pa.record_batch([b.column(0).filter(pa.array(can)), b.column(1).filter(pa.array(can))], ["a", "b"])

    met = pairs.join(of("a", "n_a", "map_a"), "a").join(of("b", "n_b", "map_b"), "b")
    return met.select("a", "b", "n_a", "n_b", "map_a", "map_b").mapInArrow(run, "a long, b long")


def candidate_links(prints: DataFrame, least: float) -> DataFrame:
    """``a, b``: links that connect all nodes of different roots whose similarity can be ``least`` or more.

    Pairs are ruled out one by one, so that chance meetings don't join into ever larger groups; only crowds of one shingle are
    taken as groups, which ``refined`` splits.
    """
    found = written(bucket_pairs(prints, least), "pairs")
    coarse = groups_of(found.where("crowd"), "coarse")
    return checked_pairs(found.where("not crowd"), prints, least).unionByName(refined(coarse, prints, least))


def similar_links(own: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links of a spanning forest of all pairs of sets with a Jaccard similarity of ``least`` or more; every pair counts."""
    sizes = np.array([len(x) for x in own], np.int64)
    if len(own) <= FEW:

        def few(x: int, rest: np.ndarray) -> np.ndarray:
            both = np.array([len(np.intersect1d(own[x], own[y], assume_unique=True)) for y in rest.tolist()])
            return both >= least * (sizes[x] + sizes[rest] - both)

        return _spanning_of(len(own), few)
    _, column, count = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    shared = count > 1
    owner, column = np.repeat(np.arange(len(own)), sizes)[shared[column]], (np.cumsum(shared) - 1)[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(own), len(own)), np.float32)
    width = int(shared.sum())
    for low in range(0, width, COLUMNS):
        a, b = np.searchsorted(column, (low, low + COLUMNS))
        held = np.zeros((len(own), min(COLUMNS, width - low)), np.float32)
        held[owner[a:b], column[a:b] - low] = 1
        both += held @ held.T

    def enough(x: int, rest: np.ndarray) -> np.ndarray:
        common = both[x, rest].astype(np.int64)
        return common >= least * (sizes[x] + sizes[rest] - common)

    return _spanning_of(len(own), enough)


def groups_of(candidates: DataFrame, what: str) -> DataFrame:
    """``node, group``: the component of each node that has a link."""
    found = components(candidates, what).withColumnRenamed("root", "group")
    return found.unionByName(found.select(F.col("group").alias("node"), "group").distinct())


def refined(members: DataFrame, prints: DataFrame, least: float) -> DataFrame:
    """``a, b``: links that connect the nodes of a group that can be similar and have different roots; larger groups are split by parity maps.

    Sizes fall in classes so wide that similar sets lie in one class or in neighbours; a window is
    two neighbours. A window's rows are dealt to blocks, and every two blocks meet in one task.
    """
    members = members.join(members.groupBy("group").agg(F.count("*").alias("c")), "group")
    small = members.where(F.col("c") <= LARGE).select(F.col("node").alias("a"), F.col("group").alias("b"))
    maps = prints.where("map is not null").select("node", "n", "map", "root").join(members.where(F.col("c") > LARGE).select("node", "group"), "node").dropDuplicates(["node"])
    # a little wider than needed, so that rounding can't part neighbours
    kind = F.floor(F.log(F.col("n").cast("double")) / F.lit(-1.001 * math.log(least))).cast("int")
    placed = written(maps.withColumn("kind", kind), "maps")
    keyed = placed.select("node", "group", F.explode(F.array(F.col("kind") - 1, F.col("kind"))).alias("window"), "n", "map", "root")
    ways = placed.select("group", F.explode(F.array(F.col("kind") - 1, F.col("kind"))).alias("window")).groupBy("group", "window").agg(F.ceil(F.count("*") / MAP_ROWS).cast("int").alias("ways"))
    block = F.pmod(F.xxhash64("node"), F.col("ways")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("ways") - 1), lambda o: (F.col("ways") == 1) | (o != F.col("block")))
    met = keyed.join(ways, ["group", "window"]).withColumn("block", block).select("group", "window", "node", "n", "map", "root", "block", F.explode(others).alias("other"))
    sent = met.select("group", "window", F.least("block", "other").alias("k"), F.greatest("block", "other").alias("m"), "node", "n", "map", "root")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()

        def linked(names: list[int], sizes: list[int], maps: list[bytes], roots: list[int]) -> pa.RecordBatch:
            found = map_links(maps, np.array(sizes, np.int64), least, np.array(roots, np.int64))
            return pa.record_batch([pa.array([names[x] for x, _ in found], pa.int64()), pa.array([names[y] for _, y in found], pa.int64())], ["a", "b"])

        now, names, sizes, maps, roots = None, [], [], [], []
        for b in batches:
            for *key, name, n, own, root in zip(*(b.column(i).to_pylist() for i in range(8))):
                if key != now:
                    if len(names) > 1:
                        yield linked(names, sizes, maps, roots)
                    now, names, sizes, maps, roots = key, [], [], [], []
                names.append(name)
                sizes.append(n)
                maps.append(own)
                roots.append(root)
        if len(names) > 1:
            yield linked(names, sizes, maps, roots)

    keys = ["group", "window", "k", "m"]
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return small.unionByName(sent.repartition(tasks, *keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long"))


def similar(candidates: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, least: float, what: str = "candidates") -> DataFrame:
    """``a, b``: links that connect all nodes of a similarity of ``least`` or more.

    Components of the candidates are groups; within a group all pairs are compared. Larger groups are dealt
    to blocks, and every two blocks meet in one task, which has the texts of both and returns a forest.
    A node's text is that of its row of the smallest doc_id; only texts of groups are moved.
    """
    spark = nodes.sparkSession
    members = nodes.join(groups_of(candidates, what), "node")
    counted = members.groupBy("group").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    ways = F.greatest(F.least(F.ceil(F.col("c") / GROUP_ROWS), F.lit(GROUP_WAYS)), F.ceil(F.col("c") / MOST_GROUP_ROWS), F.ceil(F.col("n") / GROUP_SHINGLES))
    wanted = written(members.select("node", "group", F.col("least_row.doc_id").alias("i"), F.col("least_row.tie").alias("t")).join(counted.select("group", ways.cast("int").alias("ways")), "group"), "wanted")
    rows = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    texts = rows.join(wanted, rows.doc_id.eqNullSafe(wanted.i) & (rows.tie == wanted.t)).select("group", "ways", "node", "text").dropDuplicates(["node"])
    block = F.pmod(F.xxhash64("node"), F.col("ways")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("ways") - 1), lambda o: (F.col("ways") == 1) | (o != F.col("block")))
    met = texts.withColumn("block", block).select("group", "node", "text", "block", F.explode(others).alias("other"))
    sent = met.select("group", F.least("block", "other").alias("k"), F.greatest("block", "other").alias("m"), "node", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()

        def linked(names: list[int], own: list[np.ndarray]) -> pa.RecordBatch:
            found = similar_links(own, least)
            return pa.record_batch([pa.array([names[x] for x, _ in found], pa.int64()), pa.array([names[y] for _, y in found], pa.int64())], ["a", "b"])

        now, names, own = None, [], []
        for b in arrow_batches(batches, column=4, most_bytes=1 << 20):
            for key, name, text in zip(zip(*(b.column(i).to_pylist() for i in range(3))), b.column(3).to_pylist(), b.column(4).to_pylist()):
                if key != now:
                    if len(own) > 1:
                        yield linked(names, own)
                    now, names, own = key, [], []
                names.append(name)
                own.append(distinct_shingles(text, size))
        if len(own) > 1:
            yield linked(names, own)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return sent.repartition(tasks, "group", "k", "m").sortWithinPartitions("group", "k", "m").mapInArrow(run, "a long, b long")


def resemblances(docs: DataFrame, size: int, least: float, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, tie, root``: a row for each row of ``docs``; rows of one root are linked by Jaccard similarities of ``least`` or more.

    Fingerprints within ``radius`` are linked first and their links held against the texts; what they leave apart is then
    compared exactly: pairs of different roots only.
    """
    source = id_and_text(docs, id_col, text_col)
    prints = written(sets(source, size, least), "sets")
    nodes = prints.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("least_row"), F.first("n").alias("n"))
    near = written(similar(fingerprint_links(prints, radius), nodes, source, size, least, "near"), "near-links")
    rooted = prints.where("prefix is not null").join(components(near, "near-roots"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rest = similar(candidate_links(rooted, least), nodes, source, size, least)
    return prints.join(components(near.unionByName(rest)), "node", "left").select("doc_id", "tie", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame, size: int = 4, radius: int = 4, block_rows: int = BLOCK_ROWS, least_blocks: int = LEAST_BLOCKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, tie, fingerprint, component_id, root``: a row for each row of ``docs``.

    ``tie`` is a hash of the text, ``root`` tells components apart whose smallest doc_id is the same or null.
    """
    source = id_and_text(docs, id_col, text_col)
    prints = written(fingerprints(source, size), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie", "n")).alias("least_row")).withColumn("n", F.col("least_row.n")), "nodes")
    edges = links(nodes, radius, block_rows, least_blocks)
    roots = components(edges).withColumnRenamed("node", "fp")
    placed = nodes.join(roots, "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    ids = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_print = placed.join(ids, "root").select("fp", "component_id", "root")
    return prints.join(of_print, "fp").select("doc_id", "tie", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root")


def keep_one(docs: DataFrame, size: int = 5, least: float = 0.8, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the smallest doc_id; all columns stay.

    Groups are linked by SimHash fingerprints that differ in ``radius`` bits or fewer and whose shingles have a Jaccard similarity of ``least``
    or more, and by that similarity alone where fingerprints are farther apart.

    Rows of one doc_id and one text count once; groups whose doc_ids are all null keep one row.
    """
    spare = "quillgrid_" + "_".join(sorted(docs.columns))
    keys = [spare + "i", spare + "t"]
    found = resemblances(docs, size, least, radius, id_col, text_col)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("least"))
    first = first.select(F.xxhash64("least.doc_id").alias(keys[0]), F.col("least.tie").alias(keys[1]))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    keyed = docs.withColumns({keys[0]: F.xxhash64(F.col(f"`{id_col}`").cast("long")), keys[1]: F.xxhash64(text)})
    # one exchange of the texts serves the join and the last step: the same row twice, of which one stays
    return keyed.join(first, keys, "left_semi").dropDuplicates(keys).drop(*keys)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of ``documents``: four-word shingles, four bits."""
    return near_duplicates(table(spark, sf_dir, "documents"), size=4, radius=4).drop("tie", "root")
