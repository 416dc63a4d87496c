"""SentencePiece BPE encoding by a score-ordered agenda, decoding, and the check against the library.

The agenda: every adjacent pair of symbols whose union is a piece waits in a heap, the highest
score first and the leftmost first among equals; the top pair is merged if both symbols are still
there, and the two pairs it makes join the heap. Symbols that stay outside the vocabulary fall back
to byte pieces.

A text is cut where no piece of the vocabulary can cross: before each run of the space mark when the
vocabulary has no piece with another character before a space mark. Merges never cross such a cut
and the agenda's order inside a chunk does not depend on other chunks, so ids of a text are the ids
of its chunks in order; each distinct chunk runs through the agenda once and is remembered. As a
chunk is new in an Arrow batch, its ids are compared with the library's; a difference raises.

Normalisation is the identity but for the space mark: models with other rules are refused.
Defined results: a null text is empty (no ids, decoded empty); very long texts need no more memory
than their ids; repeated rows and doc_ids are kept; a null doc_id is kept; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillgrid.llm.common import arrow_batches, id_and_text, kept, table

SPACE = "▁"
#: Distinct chunks that a Python worker remembers: when half as many are new, those not seen since the half before are dropped.
MEMO_CHUNKS = 500_000
#: New chunks that are encoded and checked in one go.
NEW_CHUNKS = 10_000


class AgendaEncoder:
    def __init__(self, model_path: str, memo_chunks: int = MEMO_CHUNKS, check: bool = True):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = self.library.get_piece_size()
        plain = [i for i in range(n) if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) or self.library.is_unused(i))]
        self.ids = {self.library.id_to_piece(i): i for i in plain}
        self.scores = {p: self.library.get_score(i) for p, i in self.ids.items()}
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = self.library.unk_id()
        if any(self.bytes[b] == self.unknown for b in range(256)):
            raise ValueError("a vocabulary with byte pieces is needed")
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces go across words: texts can't be cut at spaces")
        if self.library.normalize("  a  ﬁ ") != f"{SPACE}{SPACE}{SPACE}a {SPACE}ﬁ{SPACE}":
            raise ValueError("a model without normalisation and with a leading space mark is needed")
        #: ids of each chunk as bytes of ``wide`` integers: a third of a tuple's memory
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.wide = np.dtype("<u2") if n <= 1 << 16 else np.dtype("<u4")
        self.memo_chunks = memo_chunks
        self.check = check

    def agenda(self, chunk: str) -> tuple[int, ...]:
        """The ids of one chunk (space marks in place of spaces)."""
        ids, scores = self.ids, self.scores
        whole = ids.get(chunk)
        if whole is not None and len(chunk) == 1:
            return (whole,)
        symbols: list[str] = list(chunk)
        n = len(symbols)
        prev, nxt = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            score = scores.get(symbols[i] + symbols[i + 1])
            if score is not None:
                heap.append((-score, i, symbols[i] + symbols[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, union = heapq.heappop(heap)
            j = nxt[i]
            # gone, or one of the two has grown since the pair was put on the agenda
            if not symbols[i] or j >= n or symbols[i] + symbols[j] != union:
                continue
            symbols[i], symbols[j] = union, ""
            k = nxt[i] = nxt[j]
            if k < n:
                prev[k] = i
                pair = union + symbols[k]
                score = scores.get(pair)
                if score is not None:
                    heapq.heappush(heap, (-score, i, pair))
            h = prev[i]
            if h >= 0:
                pair = symbols[h] + union
                score = scores.get(pair)
                if score is not None:
                    heapq.heappush(heap, (-score, h, pair))
        out: list[int] = []
        for s in symbols:
            if s:
                i = ids.get(s)
                if i is not None:
                    out.append(i)
                else:
                    out.extend(self.bytes[b] for b in s.encode())
        return tuple(out)

    @staticmethod
    def chunks(text: str) -> list[str]:
        """The text cut before each run of spaces; each chunk stands without the first space mark of its run."""
        if not text:
            return []
        if text[0] == " " or "  " in text or SPACE in text:
            marked = SPACE + text.replace(" ", SPACE)
            return [x[1:] for x in re.findall(f"{SPACE}*[^{SPACE}]*", marked)[:-1]]
        return text.split(" ")

    def arrays(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        cut = [self.chunks(x) for x in texts]
        if len(self.memo) > self.memo_chunks // 2:
            self.older, self.memo = self.memo, {}
        memo, older = self.memo, self.older
        missing = set(chain.from_iterable(cut)).difference(memo)
        memo.update((x, older[x]) for x in missing if x in older)
        new = [x for x in missing if x not in older]
        for at in range(0, len(new), NEW_CHUNKS):
            part = new[at : at + NEW_CHUNKS]
            found = [self.agenda(SPACE + x) for x in part]
            if self.check:
                self.compare(part, found)
            memo.update((x, np.array(ids, self.wide).tobytes()) for x, ids in zip(part, found))
        get = memo.__getitem__
        return [np.frombuffer(b"".join(map(get, x)), self.wide) for x in cut]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.tolist() for x in self.arrays(texts)]

    def compare(self, chunks: list[str], found: list[tuple[int, ...]]) -> None:
        """Hold new chunks against the library, which sets the first space mark itself."""
        theirs = self.library.encode([x.replace(SPACE, " ") for x in chunks], num_threads=1)
        for chunk, mine, other in zip(chunks, found, theirs):
            if chunk and list(mine) != other:
                raise AssertionError(f"{chunk!r}: {mine} here, {other} by the library")

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def encoder(model_path: str, check: bool = True) -> AgendaEncoder:
    """One encoder per worker process and model, so that its memory serves later tasks too."""
    return kept(("pieces", model_path, check), lambda: AgendaEncoder(model_path, check=check))


def encode_decode(docs: DataFrame, model_path: str, keep_ids: bool = True, check: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, with ``keep_ids``, ``ids, decoded``.

    ``check`` compares every chunk that is new to a worker with the library.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_path, check)
        for b in arrow_batches(batches, most_bytes=2 << 20):
            ids = enc.arrays(b.column(1).to_pylist())
            decoded, digests, of_decoded = [], [], []
            for x in ids:  # one text's ids as numbers at a time
                own = x.tolist()
                digests.append(hashlib.sha256(str(own)[1:-1].replace(" ", "").encode()).hexdigest())
                text = enc.decode(own)
                of_decoded.append(hashlib.sha256(text.encode()).hexdigest())
                if keep_ids:
                    decoded.append(text)
            columns = [b.column(0), pa.array(map(len, ids), pa.int64()), pa.array(digests, pa.string()), pa.array(of_decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                columns += [pa.ListArray.from_arrays(offsets, np.concatenate([*ids, np.empty(0, enc.wide)]).astype(np.int32)), pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            yield pa.record_batch(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op7_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    """Encode and decode every text of ``documents``; digests of ids and decoded texts."""
    return encode_decode(table(spark, sf_dir, "documents"), model_path or default_model(), keep_ids=False)
