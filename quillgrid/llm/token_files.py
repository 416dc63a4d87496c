"""Token-ID output: flat unsigned integer files, 64-bit document offsets, memory-mapped reads.

Layout of a token folder (all integers little-endian):

* ``ids-*.bin``      the ids of one partition, back to back, unsigned 16-bit where the vocabulary
                     has at most 65,536 ids, else unsigned 32-bit;
* ``docs-*.idx``     for each document of that partition a pair of signed 64-bit integers: doc_id
                     and the offset of its first id within the partition (a null doc_id is
                     stored as the smallest 64-bit integer);
* ``manifest.json``  the partitions in ascending doc_id order with their base, i.e. the number
                     of ids in all partitions before (a prefix sum of the partition totals).

The global 64-bit offset of a document is base + local offset. A task writes files whose names no
other attempt uses and reports them in its result row; only files that the manifest names count,
so lost executors and repeated attempts leave nothing wrong behind.

Defined results: a null text is an empty text and gives one end id; a null doc_id sorts first and
is kept; repeated doc_ids are kept, ordered by the hash of their text; an empty table gives no
part; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm.common import arrow_batches, id_and_text, kept, new_folder

NULL_ID = -(1 << 63)
#: Distinct words, and distinct pieces of words, whose ids a Python worker keeps at most.
MEMO_WORDS = 350_000
MEMO_PIECES = 500_000
#: ASCII punctuation at which the patterns always cut behind a letter (no apostrophe, no part of a special token).
EDGE = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
_LETTERS = re.compile("[a-zA-ZÀ-ÖØ-öø-ÿ]+")


class WordEncoder:
    """Ids of a text by the tokenizers library, a word at a time, remembered.

    The tokenizers used here drop white space and no rule of theirs looks across it, so a text's
    ids are its words' ids in order. A word is cut once more between a letter and the ASCII
    punctuation at its end (Latin letters only: others may change as they are lower-cased), where their patterns
    always cut, and ASCII letters are lower-cased as the
    normaliser does; the library encodes each distinct piece that remains, many in one call. Pieces of
    letters alone give one run of ids each, whose last has the end-of-word mark; others stand between
    special tokens. With ``by_words=False`` (any other tokenizer) whole texts go to the library.
    """

    SPECIAL, MARK = "<|endoftext|>", "</w>"
    # Fixed value: the pattern that cuts texts; nothing it matches holds white space.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str, by_words: bool = True, memo_words: int = MEMO_WORDS, memo_pieces: int = MEMO_PIECES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = by_words
        self.memo_words, self.memo_pieces = memo_words, memo_pieces
        n = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.wide = np.dtype("<u2") if n <= 1 << 16 else np.dtype("<u4")
        self.words: dict[str, bytes] = {"": b""}
        self.pieces: dict[str, bytes] = {}
        self.special = self.tokenizer.token_to_id(self.SPECIAL)
        self.ends = np.fromiter(((self.tokenizer.id_to_token(i) or "").endswith(self.MARK) for i in range(n)), bool, n)
        if by_words and (self.special is None or not self._by_words(json.loads(self.tokenizer.to_str()))):
            raise ValueError("a lower-casing tokenizer without rules across white space, with a special token and end-of-word marks, is needed, or by_words=False")

    def _by_words(self, rules: dict) -> bool:
        """Whether a text's ids are its words' ids: the normaliser and the pattern are those that this class knows."""
        normal = [{k: v for k, v in x.items() if k != "type"} | {"kind": x["type"]} for x in (rules["normalizer"] or {}).get("normalizers", [])]
        known = [{"kind": "NFC"}, {"pattern": {"Regex": r"\s+"}, "content": " ", "kind": "Replace"}, {"kind": "Lowercase"}]
        cuts = [(x["type"], x.get("pattern", {}).get("Regex"), x.get("behavior"), x.get("invert"), x.get("add_prefix_space")) for x in (rules["pre_tokenizer"] or {}).get("pretokenizers", [])]
        model = rules["model"]
        return normal == known and cuts == [("Split", self.PATTERN, "Removed", True, None), ("ByteLevel", None, None, None, False)] and model.get("end_of_word_suffix") == self.MARK and not model.get("dropout")

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, dtype=self.wide).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, pieces: list[str], letters: bool) -> None:
        """Encode pieces joined: letters alone by spaces, others by special tokens."""
        groups = [pieces[i : i + 512] for i in range(0, len(pieces), 512)]
        by = " " if letters else f" {self.SPECIAL} "
        size = self.wide.itemsize
        for group, found in zip(groups, self.tokenizer.encode_batch_fast([by.join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(found.ids, dtype=self.wide)
            ends = np.flatnonzero(self.ends[ids]) + 1 if letters else np.append(np.flatnonzero(ids == self.special), len(ids))
            raw, start = ids.tobytes(), 0
            for x, end in zip(group, (ends * size).tolist(), strict=True):
                self.pieces[x] = raw[start:end]
                start = end if letters else end + size

    def _learn(self, words: list[str]) -> None:
        """Remember the ids of new words: look up their pieces, and encode the new ones."""
        cut = []
        for w in words:
            stem = w.rstrip(EDGE)
            if len(stem) < len(w) and _LETTERS.fullmatch(stem):
                cut.append((stem.lower() if stem.isascii() else stem, w[len(stem) :]))
            else:
                cut.append((w.lower() if w.isascii() and "<|" not in w else w,))
        new = set(chain.from_iterable(cut)).difference(self.pieces)
        letters = [x for x in new if _LETTERS.fullmatch(x)]
        others = new.difference(letters)
        odd = [x for x in others if "<|" in x]
        self.pieces.update(zip(odd, self._library(odd)) if odd else ())
        self._joined(letters, True)
        self._joined(list(others.difference(odd)), False)
        get = self.pieces.__getitem__
        self.words.update((w, get(c[0]) if len(c) == 1 else get(c[0]) + get(c[1])) for w, c in zip(words, cut))

    def encode(self, texts: pa.StringArray, end_id: int | None = None) -> pa.BinaryArray:
        """The ids of each text as bytes of ``wide`` integers, with an end id if given."""
        end = b"" if end_id is None else np.array([end_id], self.wide).tobytes()
        if not self.by_words:
            return pa.array([x + end for x in self._library(texts.to_pylist())], pa.binary())
        # only U+0020 and line feeds are cut at: white space for every library involved
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = cut.flatten().dictionary_encode()
        distinct, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if len(self.words) > self.memo_words:
            self.words.clear()
            self.words[""] = b""
        if len(self.pieces) > self.memo_pieces:
            self.pieces.clear()
        new = [w for w in distinct if w not in self.words]
        if new:
            self._learn(new)
        found = list(map(self.words.__getitem__, distinct))
        size = self.wide.itemsize
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // size
        ids = np.frombuffer(b"".join(found), self.wide)
        first = np.cumsum(lengths) - lengths
        # ids of every word in turn, out of those of the distinct ones
        own = lengths[index]
        stops = np.cumsum(own)
        total = int(own.sum())
        words = np.diff(cut.offsets.to_numpy())
        edges = np.concatenate([[0], np.concatenate([[0], stops])[np.cumsum(words)]])
        flat = ids[np.repeat(first[index] - (stops - own), own) + np.arange(total)]
        if end:
            flat = np.insert(flat, edges[1:], self.wide.type(end_id))
            edges = edges + np.arange(len(edges))
        offsets = pa.py_buffer((edges * size).astype(np.int32))
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, offsets, pa.py_buffer(np.ascontiguousarray(flat))])


def encoder(path: str, by_words: bool) -> WordEncoder:
    """One encoder per worker process and tokenizer, so that its memory serves later tasks too."""
    return kept(("tokens", path, by_words), lambda: WordEncoder(path, by_words))


def in_order(docs: DataFrame, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` in ascending order over range partitions, equal ids by a hash of the text.

    Texts are dealt out before they are encoded: the sampling of a range partitioning runs what stands before it.
    """
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    source = id_and_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("tie"), "text")
    return source.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")


def _file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write_token_files(ordered: DataFrame, folder: str, tokenizer_path: str, end_id: int | None = 1, by_words: bool = True) -> dict:
    """Encode ``doc_id, text`` (ordered partitions) and write a part for each below ``folder``; return the manifest.

    The driver sees one row per partition (name and totals), never ids or documents.
    """
    fs, path = _file_system(folder)
    fs.create_dir(path, recursive=True)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, by_words)
        width = enc.wide.itemsize
        fs, path = _file_system(folder)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        at, docs = 0, 0
        with fs.open_output_stream(f"{path}/ids-{name}.bin") as ids, fs.open_output_stream(f"{path}/docs-{name}.idx") as index:
            for b in arrow_batches(batches, most_bytes=6 << 20):
                found = enc.encode(b.column(1), end_id)
                lengths = pc.binary_length(found).to_numpy(zero_copy_only=False).astype(np.int64) // width
                rows = np.empty((len(lengths), 2), "<i8")
                rows[:, 0] = b.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
                rows[:, 1] = at + np.cumsum(lengths) - lengths
                index.write(rows.tobytes())
                ids.write(b"".join(found.to_pylist()))
                at, docs = at + int(lengths.sum()), docs + len(lengths)
        if docs:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([name]), pa.array([docs], pa.int64()), pa.array([at], pa.int64())], ["part", "name", "n_docs", "n_ids"])

    parts = ordered.mapInArrow(run, "part int, name string, n_docs long, n_ids long").collect()
    parts.sort(key=lambda r: r["part"])
    totals = np.array([r["n_ids"] for r in parts], np.int64)
    bases = np.cumsum(totals) - totals
    manifest = {"dtype": encoder(tokenizer_path, by_words).wide.str, "n_ids": int(totals.sum()), "parts": [{"name": r["name"], "n_docs": r["n_docs"], "n_ids": r["n_ids"], "base": int(b)} for r, b in zip(parts, bases)]}
    with fs.open_output_stream(f"{path}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def _mapped(fs: pafs.FileSystem, path: str, kind: str) -> np.ndarray:
    """A file as an array: memory-mapped where it lies in a mounted folder, else read."""
    if fs.get_file_info(path).size == 0:
        return np.empty(0, kind)
    if fs.type_name == "local":
        return np.memmap(path, dtype=kind, mode="r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), dtype=kind)


def open_part(folder: str, name: str, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a part, and its (doc_id, local offset) rows; both memory-mapped if possible."""
    fs, path = _file_system(folder)
    return _mapped(fs, f"{path}/ids-{name}.bin", dtype), _mapped(fs, f"{path}/docs-{name}.idx", "<i8").reshape(-1, 2)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32``, a row per document, from the files alone.

    ``ids_crc32`` is over the ids as little-endian unsigned 32-bit integers.
    """
    fs, path = _file_system(folder)
    with fs.open_input_file(f"{path}/manifest.json") as f:
        manifest = json.loads(f.readall())
    kind = manifest["dtype"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids, rows = open_part(folder, name, kind)
                ends = np.append(rows[1:, 1], len(ids))
                for at in range(0, len(rows), 4096):
                    part, stop = rows[at : at + 4096], ends[at : at + 4096]
                    crcs = [zlib.crc32(ids[s:e].astype("<u4").tobytes()) for s, e in zip(part[:, 1], stop)]
                    doc = np.asarray(part[:, 0])
                    yield pa.record_batch([pa.array(doc, pa.int64(), mask=doc == NULL_ID), pa.array(part[:, 1] + base, pa.int64()), pa.array(stop - part[:, 1], pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    parts = spark.createDataFrame([(p["name"], p["base"]) for p in manifest["parts"]], "name string, base long")
    if manifest["parts"]:
        parts = parts.repartition(len(manifest["parts"]), "name")
    return parts.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_token_files(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """Encode, write and read back every text of ``documents``."""
    from quillgrid.llm.common import table

    tokenizer_path = tokenizer_path or default_tokenizer()
    folder = new_folder(spark, "tokens")
    write_token_files(in_order(table(spark, sf_dir, "documents")), folder, tokenizer_path, end_id=1)
    return read_token_files(spark, folder)
