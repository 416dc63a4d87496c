"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

A text becomes words (runs of letters and digits, lower-cased; a point or comma between digits belongs
to the number), and words that a re-parameterised question would change become typed placeholders:
numbers (also spelled), units, and names, i.e. words that start with a capital and a small letter, wherever they
stand. Of a run of such words only the first two become placeholders, so that a window always has plain words
too. The benchmark's templates come in three versions, as a copy may be written: as it is, with plain words at the
starts of sentences, and with names as plain words.

Windows of ``WINDOW`` words over these templates are hashed and joined with those of the
benchmark; an item of fewer words is one window of its own length. Matches of a document and an item lie on diagonals (the
window's place in the document less its place in the item); a diagonal with ``LEAST_RUN`` windows (all, of an item
that has fewer) is a hit if its slots are consistent: one value in the item always stands for one value in
the document, and the other way round. Windows whose slots hold the item's own values are a hit without that, if they are as many.

The benchmark is small against the corpus; its windows are broadcast where they are counted to be
at most ``BROADCAST_WINDOWS`` and joined by a shuffle beyond it. Only hashes of windows meet them. The texts are read a second time
for slots, for documents on whose diagonals there are enough windows: these are told by 64-bit keys,
broadcast up to ``BROADCAST_KEYS`` of them and joined by a shuffle beyond it.

Defined results: a null text is empty and never hit, and so is an item without words; repeated rows of a document each count
(a null doc_id is a row of its own); equal items are each reported, an item_id once; an empty table gives no rows; other columns
are ignored by ``hits`` and kept by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm.common import table, written

WINDOW = 8
#: Windows on one diagonal at least: eleven words in a row.
LEAST_RUN = 4
BROADCAST_WINDOWS = 1_000_000
BROADCAST_KEYS = 1_000_000

# Words for units of measure, currency and time, and for numbers.
UNITS = (
    "mm cm dm km meter meters metre metres kilometer kilometers kilometre kilometres mile miles inch inches foot feet yard yards "
    "mg kg gram grams kilogram kilograms ton tons tonne tonnes pound pounds ounce ounces ml liter liters litre litres gallon gallons "
    "second seconds minute minutes hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros percent degrees mph kmh watt watts volt volts joule joules"
).split()
NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()

NAME_MARK, INNER_MARK, START_MARK = "\x01", "\x04", "\x05"
NUMBER, UNIT, NAME = "\x02num", "\x02unit", "\x02name"


def _cut(text: Column, marks: str = "") -> Column:
    joined = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<=[0-9])[.,](?=[0-9])", INNER_MARK)
    return F.array_remove(F.split(joined, rf"[^\p{{L}}\p{{N}}\x04{marks}]+"), "")


def words(text: Column) -> Column:
    """Lower-cased words; a name has a mark before it."""

    def marked(w: Column) -> Column:
        first = F.left(w, F.lit(1))
        return F.when((F.lower(first) != first) & w.rlike(r"^\p{Lu}\p{Ll}"), F.concat(F.lit(NAME_MARK), F.lower(w))).otherwise(F.lower(w))

    return F.transform(_cut(text), marked)


def item_words(text: Column) -> Column:
    """The versions of a benchmark item's words: names marked, names inside sentences marked, none marked."""
    starts = F.regexp_replace(F.coalesce(text, F.lit("")), r"((?:^|[.!?]\s)[^\p{L}\p{N}]*)(?=\p{Lu}\p{Ll})", "$1" + START_MARK)
    cut = _cut(starts, r"\x05")
    plain = lambda w: F.lower(F.replace(w, F.lit(START_MARK), F.lit("")))
    named = lambda w: F.concat(F.lit(NAME_MARK), plain(w))
    return F.array(
        F.transform(cut, lambda w: F.when(w.rlike(r"^\x05?\p{Lu}\p{Ll}"), named(w)).otherwise(plain(w))),
        F.transform(cut, lambda w: F.when(w.rlike(r"^\p{Lu}\p{Ll}"), named(w)).otherwise(plain(w))),
        F.transform(cut, plain),
    )


def placeholder(word: Column) -> Column:
    """The word's placeholder, or null for a plain word."""
    return F.when(word.startswith(NAME_MARK), NAME).when(((word >= "0") & (word < ":")) | word.isin(NUMBERS), NUMBER).when(word.isin(UNITS), UNIT)


def templates(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``words``) with ``canon``: the words, of each run of changeable ones the first two as placeholders."""
    typed = rows.withColumn("types", F.transform("words", placeholder))
    kind = lambda i: F.get(F.col("types"), i)
    canon = F.transform("words", lambda w, i: F.when(kind(i).isNull() | (kind(i - 1).isNotNull() & kind(i - 2).isNotNull()), w).otherwise(kind(i)))
    return typed.withColumn("canon", canon).drop("types")


def windows(rows: DataFrame, keys: list[str], lengths: list[int]) -> DataFrame:
    """``keys, at, size, hash``: each window of a row's ``canon`` (from 1), for windows of the given lengths."""

    def of(n: int) -> Column:
        cut = lambda i: F.struct(i.alias("at"), F.lit(n).alias("size"), F.xxhash64(F.slice("canon", i, n)).alias("hash"))
        none = F.array().cast("array<struct<at:int,size:int,hash:bigint>>")
        return F.when(F.size("canon") >= n, F.transform(F.sequence(F.lit(1), F.size("canon") - (n - 1)), cut)).otherwise(none)

    return rows.select(*keys, F.inline(F.concat(*map(of, lengths))))


def _key(df: DataFrame, id_col: str, text_col: str) -> Column:
    """What tells a document: its id and its text, as one number."""
    return F.xxhash64(F.col(f"`{id_col}`"), F.xxhash64(F.col(f"`{text_col}`").cast("string")))


def found_in(keyed: DataFrame, benchmark: DataFrame, least_run: int, broadcast_windows: int, item_col: str, item_text_col: str) -> DataFrame:
    """``key, row.., item_id, n_windows, n_slots, exact``: for each row of ``keyed`` (``key, text`` and others) and item that it holds."""
    own = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.col(f"`{item_text_col}`").cast("string").alias("text")).distinct()
    versions = item_words(F.col("text"))
    items = own.select(F.monotonically_increasing_id().alias("item"), "item_id", versions.alias("versions")).where(F.size(F.get("versions", F.lit(0))) > 0)
    items = written(items, "items")
    lengths = [r[0] for r in items.select(F.least(F.size(F.get("versions", F.lit(0))), F.lit(WINDOW))).distinct().collect()]  # WINDOW values at most
    each = templates(items.select("item", F.size(F.get("versions", F.lit(0))).alias("n"), F.explode("versions").alias("words")))
    known = windows(each, ["item", "n"], lengths or [WINDOW]).where(F.col("size") == F.least("n", F.lit(WINDOW)))
    known = written(known.select("item", F.col("at").alias("item_at"), "hash", "size", F.least(F.lit(least_run), F.col("n") - F.col("size") + 1).alias("least")).distinct(), "benchmark")
    small = known.count() <= broadcast_windows
    met = windows(templates(keyed.select("key", words(F.col("text")).alias("words"))), ["key"], lengths or [WINDOW]).drop("size")
    met = met.join(F.broadcast(known) if small else known, "hash")
    runs = met.groupBy("key", "item", (F.col("at") - F.col("item_at")).alias("diagonal")).agg(F.collect_set("at").alias("ats"), F.first("size").alias("size"), F.first("least").alias("least"))
    runs = written(runs.where(F.size("ats") >= F.col("least")), "runs")
    keys = runs.select("key").distinct()
    few = keys.count() <= BROADCAST_KEYS
    # texts of documents with runs alone go on
    again = keyed.join(F.broadcast(keys) if few else keys, "key", "left_semi").withColumn("words", words(F.col("text"))).drop("text")
    there = items.select("item", "item_id", F.get("versions", F.lit(2)).alias("theirs"))
    both = templates(again).join(runs, "key").join(F.broadcast(there) if small else there, "item")
    places = F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + F.col("size") - 1))))
    slots = F.filter(places, lambda p: F.get(F.col("canon"), p - 1).startswith("\x02"))
    bare = lambda w: F.replace(w, F.lit(NAME_MARK), F.lit(""))
    pairs = F.transform("slots", lambda p: F.struct(p.alias("at"), F.get(F.col("theirs"), p - F.col("diagonal") - 1).alias("a"), bare(F.get(F.col("words"), p - 1)).alias("b")))
    kept = [c for c in keyed.columns if c not in ("key", "text")]
    sided = both.withColumn("slots", slots).select("key", *kept, "item_id", "ats", "size", "least", pairs.alias("pairs"))
    judged = sided.withColumns({"values": F.array_distinct(F.transform("pairs", lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b")))), "other": F.filter("pairs", lambda p: p["a"] != p["b"])})
    one = lambda side: F.size("values") == F.size(F.array_distinct(F.transform("values", lambda p: p[side])))
    same = F.size(F.filter("ats", lambda a: ~F.exists("other", lambda p: (p["at"] >= a) & (p["at"] < a + F.col("size")))))
    n_same = F.size(F.filter("values", lambda p: p["a"] == p["b"]))
    outcome = F.when(one("a") & one("b"), F.struct(F.size("ats").alias("n"), (F.size("other") == 0).alias("exact"), F.size("values").alias("n_slots")))
    outcome = outcome.when(same >= F.col("least"), F.struct(same.alias("n"), F.lit(True).alias("exact"), n_same.alias("n_slots")))
    best = judged.select("key", *kept, "item_id", outcome.alias("best")).where("best is not null").groupBy("key", *kept, "item_id").agg(F.max("best").alias("best"))
    return best.select("key", *kept, "item_id", F.col("best.n").cast("long").alias("n_windows"), F.col("best.n_slots").cast("long").alias("n_slots"), "best.exact")


def hits(docs: DataFrame, benchmark: DataFrame, least_run: int = LEAST_RUN, broadcast_windows: int = BROADCAST_WINDOWS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``row, doc_id, item_id, n_windows, n_slots, exact``: a row for each document and item that it holds.

    ``row`` tells rows of ``docs`` with one doc_id apart; ``exact`` is false where slots were filled anew.
    """
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), _key(docs, id_col, text_col).alias("key"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return found_in(own, benchmark, least_run, broadcast_windows, item_col, item_text_col).drop("key")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; every other row and column stays.

    A hit is told by doc_id and text, so repeated ids go only with their own text.
    """
    key = _key(docs, id_col, text_col)
    found = found_in(docs.select(key.alias("key"), F.col(f"`{text_col}`").cast("string").alias("text")), benchmark, LEAST_RUN, BROADCAST_WINDOWS, "item_id", "text")
    spare = "quillgrid_" + "_".join(sorted(docs.columns))
    gone = written(found.select(F.col("key").alias(spare)).distinct(), "hits")
    few = gone.count() <= BROADCAST_KEYS
    return docs.join(F.broadcast(gone) if few else gone, key == F.col(f"`{spare}`"), "left_anti")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark, re-parameterised or not."""
    return hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


def oracle_sql() -> str:
    """The same in DuckDB's SQL: windows joined as text, and slots compared word by word."""
    listed = lambda names: ", ".join(f"'{x}'" for x in names)
    split = "list_filter(string_split_regex({}, '[^\\p{{L}}\\p{{N}}\\x04\\x05]+'), lambda w: w <> '')"

    def inner(text: str) -> str:
        for _ in range(2):  # matches can't overlap, so neighbours come with the second
            text = f"regexp_replace({text}, '([0-9])[.,]([0-9])', '\\1' || chr(4) || '\\2', 'g')"
        return text

    def named(pattern: str) -> str:
        return f"list_transform(w, lambda x: CASE WHEN regexp_matches(x, '{pattern}') THEN chr(1) ELSE '' END || lower(replace(x, chr(5), '')))"

    def canonical(source: str, keys: str) -> str:
        return f"""
{source}_t AS (SELECT {keys}, a, list_transform(a, lambda x: CASE WHEN starts_with(x, chr(1)) THEN '<name>' WHEN (x >= '0' AND x < ':') OR x IN ({listed(NUMBERS)}) THEN '<num>' WHEN x IN ({listed(UNITS)}) THEN '<unit>' END) AS t FROM {source}_a),
{source}_c AS (SELECT {keys}, a, list_transform(range(1, len(a) + 1), lambda i: CASE WHEN t[i] IS NULL OR (i > 2 AND t[i - 1] IS NOT NULL AND t[i - 2] IS NOT NULL) THEN a[i] ELSE t[i] END) AS c FROM {source}_t)"""

    return f"""
WITH docs_a AS (SELECT r, {named('^\\p{Lu}\\p{Ll}')} AS a FROM (SELECT row_number() OVER () AS r, {split.format(inner("replace(coalesce(text, ''), chr(5), ' ')"))} AS w FROM documents)),
{canonical("docs", "r")},
bench AS (SELECT row_number() OVER () AS item, item_id, {split.format(inner("regexp_replace(coalesce(text, ''), '((?:^|[.!?]\\s)[^\\p{L}\\p{N}]*)(\\p{Lu}\\p{Ll})', '\\1' || chr(5) || '\\2', 'g')"))} AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
bench_a AS (SELECT item, item_id, unnest([{named('^\\x05?\\p{Lu}\\p{Ll}')}, {named('^\\p{Lu}\\p{Ll}')}, {named('^$')}]) AS a FROM bench),
{canonical("bench", "item, item_id")},
known AS (SELECT DISTINCT item, i, least({WINDOW}, len(c)) AS size, least({LEAST_RUN}, len(c) - least({WINDOW}, len(c)) + 1) AS least, array_to_string(c[i:i + least({WINDOW}, len(c)) - 1], ' ') AS template FROM bench_c, unnest(range(1, len(c) - least({WINDOW}, len(c)) + 2)) AS u(i) WHERE len(c) > 0),
own AS (SELECT r, i, size, array_to_string(c[i:i + size - 1], ' ') AS template FROM docs_c, (SELECT DISTINCT size FROM known) AS s, unnest(range(1, len(c) - size + 2)) AS u(i)),
runs AS (SELECT r, item, o.i - k.i AS diagonal, list(DISTINCT o.i) AS ats, any_value(k.size) AS size, any_value(k.least) AS least FROM own AS o JOIN known AS k USING (template, size) GROUP BY ALL HAVING count(DISTINCT o.i) >= any_value(k.least)),
p AS (SELECT DISTINCT r, item, diagonal, place + j AS place FROM (SELECT r, item, diagonal, size, unnest(ats) AS place FROM runs), unnest(range(0, size)) AS u(j)),
v AS (SELECT r, p.item, diagonal, place, replace(b.w[place - diagonal], chr(5), '').lower() AS x, replace(d.a[place], chr(1), '') AS y FROM p JOIN docs_c AS d USING (r) JOIN bench AS b ON b.item = p.item WHERE starts_with(d.c[place], '<')),
s AS (SELECT r, item, diagonal, count(DISTINCT {{'x': x, 'y': y}}) AS n_values, count(DISTINCT x) AS n_x, count(DISTINCT y) AS n_y, coalesce(list(place) FILTER (x <> y), []) AS other, count(DISTINCT x) FILTER (x = y) AS n_same FROM v GROUP BY ALL),
j AS (SELECT runs.r, runs.item, len(ats) AS n, coalesce(n_values, 0) AS n_values, coalesce(n_same, 0) AS n_same, least, coalesce(n_values = n_x AND n_values = n_y, true) AS consistent, len(coalesce(other, [])) = 0 AS exact,
  len(list_filter(ats, lambda a: len(list_filter(coalesce(other, []), lambda o: o >= a AND o < a + size)) = 0)) AS n_exact FROM runs LEFT JOIN s USING (r, item, diagonal)),
g AS (SELECT r, item_id, CASE WHEN consistent THEN {{'n': n, 'exact': exact, 'n_slots': n_values}} ELSE {{'n': n_exact, 'exact': true, 'n_slots': n_same}} END AS best FROM j JOIN bench USING (item) WHERE consistent OR n_exact >= least)
SELECT d.doc_id, item_id, m.best.n::BIGINT AS n_windows, m.best.n_slots::BIGINT AS n_slots, m.best.exact AS exact
FROM (SELECT r, item_id, max(best) AS best FROM g GROUP BY ALL) AS m JOIN (SELECT row_number() OVER () AS r, doc_id FROM documents) AS d USING (r)"""
