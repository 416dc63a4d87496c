"""Media columns: baseline JPEG written and read in numpy.

A payload becomes a JPEG whose quantised coefficients are its bytes less 128, in zigzag order and
with all quantiser steps 1: 192 bytes fill one minimum coded unit of three 8x8 blocks (Y, Cb, Cr).
Each unit is a restart interval of its own, so units are coded, and later decoded, side by side in
numpy; a comment segment keeps the payload's length, and units after it are zero.

The decoder is a general one for sequential baseline JPEG with one scan: markers are parsed,
the scan's intervals are Huffman-decoded in lockstep (one symbol of every interval at a time, with a
look-up table of 16 bits), and the DC terms of the luminance blocks give a thumbnail with a pixel a
block. Stored are the dimensions and a 64-bit difference hash of the thumbnail.

Defined results: a null or empty text has the payload of 192 blanks; a text of any length works
(slices of ``SLICE`` units bound the memory); equal texts give equal values; a null doc_id and repeated
rows are kept; an empty table gives no rows; other columns are ignored. ``media_features`` of
bytes that are no such JPEG, or of null, are null.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillgrid.llm.common import arrow_batches, forget, id_and_text, table

UNIT = 192
#: Units that are coded or decoded side by side.
SLICE = 8192
COMMENT = b"payload "


# --- Huffman tables: code lengths by rule -----------------------------------------------------

#: Differences of DC terms: twelve categories, four bits each.
DC_LENGTHS = {s: 4 for s in range(12)}
#: AC symbols (run * 16 + category): no zeros before and the categories of text bytes are short.
AC_LENGTHS = {run * 16 + s: 9 for run in range(16) for s in range(1, 11)} | {0x00: 6, 0xF0: 6, 0x01: 6, 0x02: 6} | {s: 4 for s in range(3, 9)}


def canonical(lengths: dict[int, int]) -> tuple[list[int], list[int]]:
    """(number of codes of 1..16 bits, symbols in the order of their codes)."""
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    return [sum(1 for n in lengths.values() if n == k) for k in range(1, 17)], symbols


def codes(counts: list[int], symbols: list[int]) -> Iterator[tuple[int, int, int]]:
    """(symbol, code, bits) of a table as a DHT segment has it."""
    code = at = 0
    for bits, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            yield s, code, bits
            code += 1
        at += n
        code <<= 1


def _code_arrays(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    code, bits = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    for s, c, n in codes(*canonical(lengths)):
        code[s], bits[s] = c, n
    return code, bits


DC_CODE, DC_BITS = _code_arrays(DC_LENGTHS)
AC_CODE, AC_BITS = _code_arrays(AC_LENGTHS)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _dht(kind: int, lengths: dict[int, int]) -> bytes:
    counts, symbols = canonical(lengths)
    return _segment(0xC4, bytes([kind, *counts, *symbols]))


TABLES = _segment(0xDB, bytes([0] + [1] * 64)) + _dht(0x00, DC_LENGTHS) + _dht(0x10, AC_LENGTHS) + _segment(0xDD, b"\0\1")
SCAN = _segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))


# --- Writing ----------------------------------------------------------------------------------


def _category(values: np.ndarray) -> np.ndarray:
    """Bits of the magnitude."""
    return np.frexp(np.abs(values).astype(np.float32))[1].astype(np.int64)


def code_units(coefficients: np.ndarray, number: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code units of shape (n, 3, 64): the bytes, each interval with its restart marker, and their lengths.

    ``number``: the unit's place in its picture; ``last``: no marker follows.
    """
    n = len(coefficients)
    blocks = coefficients.reshape(-1, 64).astype(np.int64)
    value = blocks.ravel()
    size = _category(value)
    amplitude = np.where(value < 0, value + (1 << size) - 1, value).astype(np.uint64)
    place = np.arange(len(value)) & 63
    ac = (place > 0) & (value != 0)
    # zeros since the last non-zero term of the block (or its DC term)
    at = np.arange(len(value))
    before = np.maximum.accumulate(np.where(ac | (place == 0), at, 0))
    run = np.zeros(len(value), np.int64)
    run[1:] = at[1:] - before[:-1] - 1
    run[place == 0] = 0
    long_runs = np.where(ac, run >> 4, 0)
    ends = before.reshape(-1, 64)[:, 63] != np.arange(63, len(value), 64)
    # entries: the term itself, 16-zero symbols before it, the end of the block, padding of the unit
    keep = ac | (place == 0)
    count = np.where(keep, 1 + long_runs, 0)
    count[63::64] += ends
    count[191::192] += 1
    stop = np.cumsum(count)
    total = int(stop[-1])
    bits = np.full(total, AC_BITS[0xF0], np.int64)
    code = np.full(total, AC_CODE[0xF0], np.uint64)
    own = np.flatnonzero(keep)
    tail = np.zeros(len(value), np.int64)
    tail[63::64] += ends
    tail[191::192] += 1
    spot = stop[own] - 1 - tail[own]
    symbol = ((run[own] & 15) << 4) | size[own]
    dc = place[own] == 0
    bits[spot] = np.where(dc, DC_BITS[size[own]], AC_BITS[symbol]) + size[own]
    code[spot] = (np.where(dc, DC_CODE[size[own]], AC_CODE[symbol]) << size[own].astype(np.uint64)) | amplitude[own]
    unit_end = np.zeros(len(value), np.int64)
    unit_end[191::192] = 1
    eob = np.flatnonzero(ends) * 64 + 63
    spot = stop[eob] - 1 - unit_end[eob]
    bits[spot], code[spot] = AC_BITS[0], AC_CODE[0]
    pads = stop[191::192] - 1
    bits[pads] = 0
    reached = np.cumsum(bits)[pads]
    used = np.diff(reached, prepend=0)
    pad = -used % 8
    bits[pads], code[pads] = pad, (1 << pad) - 1
    # bits into 32-bit words: each entry touches two at most, and sums of disjoint bits are exact
    begin = np.cumsum(bits) - bits
    word, shift = begin >> 5, (64 - bits - (begin & 31)).astype(np.uint64)
    shift[bits == 0] = 0
    wide = np.where(bits > 0, code << shift, 0).astype(np.uint64)
    words = int((begin[-1] + bits[-1] + 31) >> 5) + 1
    high = np.bincount(word, (wide >> np.uint64(32)).astype(np.float64), words)
    low = np.bincount(word + 1, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), words + 1)[:words]
    raw = (high + low).astype(">u4").view(np.uint8)
    lengths = (used + pad) >> 3
    raw = raw[: int(lengths.sum())]
    # stuffing after 0xFF, then a restart marker after each interval but a picture's last
    full = raw == 0xFF
    stuffed = np.cumsum(full)
    unit_of = np.repeat(np.arange(n), lengths)
    marks = np.where(last, 0, 2)
    marked = np.cumsum(marks) - marks
    out = np.zeros(len(raw) + int(stuffed[-1]) + int(marks.sum()), np.uint8)
    out[np.arange(len(raw)) + stuffed - full + marked[unit_of]] = raw
    finish = np.cumsum(lengths)
    lengths = lengths + np.diff(stuffed[finish - 1], prepend=0) + marks
    sent = np.flatnonzero(~last)
    tip = np.cumsum(lengths)[sent] - 2
    out[tip], out[tip + 1] = 0xFF, 0xD0 + (number[sent] & 7)
    return out, lengths


def picture_units(n_units: int) -> tuple[int, int]:
    """Units in a row and in a column of a picture for so many units: nearly a square."""
    across = math.isqrt(n_units - 1) + 1
    return across, -(-n_units // across)


def padded(text: bytes) -> bytes:
    """The payload of a text: blanks up to a positive multiple of 192 bytes."""
    return text + b" " * (-len(text) % UNIT or (0 if text else UNIT))


def encode_pictures(payloads: list[bytes]) -> list[bytes]:
    """A JPEG for each payload, whose length is a positive multiple of 192."""
    shapes = [picture_units(len(p) // UNIT) for p in payloads]
    sizes = np.array([a * d for a, d in shapes], np.int64)
    ends = np.cumsum(sizes)
    scans: list[list[bytes]] = [[] for _ in payloads]
    done, first = 0, 0
    total = int(ends[-1]) if len(ends) else 0
    while done < total:
        stop = min(total, done + SLICE)
        units = np.zeros((stop - done, 3, 64), np.int16)
        number, last, owners = np.empty(stop - done, np.int64), np.zeros(stop - done, bool), []
        k, at = first, done
        while at < stop:
            begin, end = int(ends[k] - sizes[k]), min(int(ends[k]), stop)
            own = np.frombuffer(payloads[k], np.uint8)[(at - begin) * UNIT : (end - begin) * UNIT]
            units.reshape(-1)[(at - done) * UNIT : (at - done) * UNIT + len(own)] = own.astype(np.int16) - 128
            number[at - done : end - done] = np.arange(at - begin, end - begin)
            last[end - done - 1] = end == ends[k]
            owners.append((k, at - done, end - done))
            at = end
            k += end == ends[k]
        raw, lengths = code_units(units, number, last)
        edges = np.concatenate([[0], np.cumsum(lengths)])
        for owner, a, b in owners:
            scans[owner].append(raw[edges[a] : edges[b]].tobytes())
        done, first = stop, k
    out = []
    for p, (across, down), scan in zip(payloads, shapes, scans):
        frame = struct.pack(">BHHB", 8, down * 8, across * 8, 3) + bytes([1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0])
        out.append(b"\xff\xd8" + _segment(0xFE, COMMENT + str(len(p)).encode()) + TABLES + _segment(0xC0, frame) + SCAN + b"".join(scan) + b"\xff\xd9")
    return out


# --- Reading ----------------------------------------------------------------------------------


@dataclass
class Picture:
    """What the markers of a JPEG say, and its scan without stuffing."""

    width: int = 0
    height: int = 0
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, across, down, quantiser
    tables: dict[int, tuple] = field(default_factory=dict)  # class * 16 + number: counts, symbols
    steps: dict[int, int] = field(default_factory=dict)  # the DC step of each quantiser
    chosen: dict[int, tuple[int, int]] = field(default_factory=dict)  # component: DC and AC table
    interval: int = 0
    payload: int | None = None
    data: np.ndarray | None = None  # the scan's bytes
    starts: np.ndarray | None = None  # of the intervals in data

    @property
    def layout(self) -> tuple:
        """What two pictures must share to be decoded side by side."""
        return tuple(self.parts), tuple(sorted(self.tables.items())), tuple(sorted(self.chosen.items()))

    @property
    def grid(self) -> tuple[int, int]:
        """Units across and down."""
        if len(self.parts) == 1:  # one component: a unit is a block, whatever its sampling says
            return -(-self.width // 8), -(-self.height // 8)
        return -(-self.width // (8 * max(p[1] for p in self.parts))), -(-self.height // (8 * max(p[2] for p in self.parts)))


def parse(media: bytes) -> Picture:
    """Read the markers; ValueError for what is no baseline JPEG with one scan of all components."""
    if media[:2] != b"\xff\xd8":
        raise ValueError("no start of an image")
    x, at = Picture(), 2
    while True:
        while media[at : at + 2] == b"\xff\xff":
            at += 1
        if at + 4 > len(media) or media[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker, n = media[at + 1], int.from_bytes(media[at + 2 : at + 4], "big")
        body = media[at + 4 : at + 2 + n]
        at += 2 + n
        if len(body) != n - 2:
            raise ValueError("a segment is cut off")
        if marker == 0xC0:
            if body[0] != 8 or len(body) != 6 + 3 * body[5]:
                raise ValueError("samples of other than 8 bits")
            x.height, x.width = struct.unpack(">HH", body[1:5])
            x.parts = [(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, len(body), 3)]
            if not x.height or not x.width or any(not p[1] or not p[2] for p in x.parts):
                raise ValueError("an empty frame")
        elif marker in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("not baseline")
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                counts = tuple(body[k + 1 : k + 17])
                x.tables[body[k]] = (counts, tuple(body[k + 17 : k + 17 + sum(counts)]))
                k += 17 + sum(counts)
        elif marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                x.steps[body[k] & 15] = int.from_bytes(body[k + 1 : k + 2 + wide], "big")
                k += 1 + 64 * (1 + wide)
        elif marker == 0xDD:
            x.interval = int.from_bytes(body, "big")
        elif marker == 0xFE and body.startswith(COMMENT):
            x.payload = int(body[len(COMMENT) :])
        elif marker == 0xDA:
            if not x.parts or body[0] != len(x.parts):
                raise ValueError("several scans")
            x.chosen = {body[k]: (body[k + 1] >> 4, body[k + 1] & 15) for k in range(1, 1 + 2 * body[0], 2)}
            if any(p[0] not in x.chosen or x.chosen[p[0]][0] not in x.tables or 16 + x.chosen[p[0]][1] not in x.tables for p in x.parts):
                raise ValueError("a table is missing")
            break
    scan = np.frombuffer(media, np.uint8, offset=at)
    full = np.flatnonzero(scan[:-1] == 0xFF)
    follow = scan[full + 1]
    end = full[(follow != 0) & ((follow < 0xD0) | (follow > 0xD7))]
    stop = int(end[0]) if len(end) else len(scan)
    full, follow = full[full < stop], follow[full < stop]
    keep = np.ones(stop, bool)
    keep[full[follow == 0] + 1] = False
    restarts = full[follow != 0]
    keep[restarts] = keep[restarts + 1] = False
    x.data = scan[:stop][keep]
    x.starts = np.concatenate([[0], restarts - 2 * np.arange(len(restarts)) - np.searchsorted(full[follow == 0], restarts)])
    across, down = x.grid
    if len(x.starts) != (-(-across * down // x.interval) if x.interval else 1):
        raise ValueError("restart intervals are missing")
    return x


def _look_up(table: tuple) -> np.ndarray:
    """symbol * 32 + bits for each next 16 bits; bits 0: no code."""
    out = np.zeros(1 << 16, np.int32)
    for s, code, bits in codes(list(table[0]), list(table[1])):
        out[code << (16 - bits) : (code + 1) << (16 - bits)] = s * 32 + bits
    return out


_LOOK_UPS: dict[tuple, tuple] = {}


def _plan(picture: Picture) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Look-up tables, and for each block of a unit: its component, its first table; luminance blocks."""
    key = picture.layout
    if key not in _LOOK_UPS:
        if len(_LOOK_UPS) > 32:
            _LOOK_UPS.clear()
        component = [i for i, p in enumerate(picture.parts) for _ in range(p[1] * p[2] if len(picture.parts) > 1 else 1)]
        looks = [_look_up(picture.tables[k]) for p in picture.parts for k in (picture.chosen[p[0]][0], 16 + picture.chosen[p[0]][1])]
        _LOOK_UPS[key] = np.concatenate(looks), np.array(component), component.count(0)
    return _LOOK_UPS[key]


def decode_intervals(picture: Picture, data: np.ndarray, starts: np.ndarray, units: np.ndarray) -> np.ndarray:
    """Coefficients (unit, block, 64) of intervals that begin at ``starts`` and have ``units`` units.

    One symbol of every interval that isn't over is decoded at a time.
    """
    looks, component, _ = _plan(picture)
    each, parts = len(component), len(picture.parts)
    raw = np.concatenate([data, np.full(8, 0xFF, np.uint8)])
    window = np.zeros(len(data) + 1, np.uint64)
    for k in range(8):
        window |= raw[k : k + len(data) + 1].astype(np.uint64) << np.uint64(56 - 8 * k)
    out = np.zeros(int(units.sum()) * each * 64, np.int16)
    position = starts.astype(np.int64) * 8
    limit = len(data) * 8
    left = units.astype(np.int64) * each
    base = (np.cumsum(units) - units) * each * 64
    block, k = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    predicted = np.zeros(len(starts) * parts, np.int64)
    lane = np.arange(len(starts)) * parts
    one = np.uint64(1)
    while len(position):
        word = window[position >> 3]
        skip = (position & 7).astype(np.uint64)
        of = component[block % each]
        dc = k == 0
        found = looks[((of * 2 + ~dc) << 16) + ((word >> (np.uint64(48) - skip)) & np.uint64(0xFFFF)).astype(np.int64)]
        bits, symbol = found & 31, found >> 5
        if not bits.all():
            raise ValueError("no such code")
        size = symbol & 15
        wide = size.astype(np.uint64)
        mask = (one << wide) - one
        amplitude = ((word >> (np.uint64(64) - skip - bits.astype(np.uint64) - wide * (wide > 0))) & mask).astype(np.int64) if size.any() else np.zeros(len(size), np.int64)
        value = np.where(amplitude < ((1 << size) >> 1), amplitude - (1 << size) + 1, amplitude)
        position = position + bits + size
        if position.max() > limit:
            raise ValueError("a scan is cut off")
        run = np.where(dc, 0, symbol >> 4)
        k = k + run
        if k.max() > 63 + 15:
            raise ValueError("a block is too long")
        target = lane + of
        predicted[target] += np.where(dc, value, 0)
        store = np.where(dc, predicted[target], value)
        write = (dc | (size > 0)) & (k < 64)
        out[(base + block * 64 + k)[write]] = store[write]
        over = ~dc & (symbol == 0)
        k = np.where(over, 64, k + 1)
        full = k >= 64
        block = block + full
        k = np.where(full, 0, k)
        going = block < left
        if not going.all():
            position, left, base, block, k, lane = position[going], left[going], base[going], block[going], k[going], lane[going]
    return out.reshape(-1, each, 64)


def decode_pictures(pictures: list[Picture]) -> Iterator[tuple[int, np.ndarray]]:
    """(index, coefficients) of each picture; pictures of one layout share the slices."""
    groups: dict[tuple, list[int]] = {}
    for i, x in enumerate(pictures):
        groups.setdefault(x.layout, []).append(i)
    for members in groups.values():
        batch: list[int] = []
        total = 0
        for i in members:
            across, down = pictures[i].grid
            if batch and total + across * down > SLICE:
                yield from _decode_group(pictures, batch)
                batch, total = [], 0
            batch.append(i)
            total += across * down
        yield from _decode_group(pictures, batch)


def _decode_group(pictures: list[Picture], members: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    model = pictures[members[0]]
    starts, units, at, lengths = [], [], 0, []
    for i in members:
        x = pictures[i]
        across, down = x.grid
        n, every = across * down, x.interval or across * down
        own = np.full(len(x.starts), every, np.int64)
        own[-1] = n - every * (len(x.starts) - 1)
        starts.append(x.starts + at)
        units.append(own)
        lengths.append(n)
        at += len(x.data)
    starts, units = np.concatenate(starts), np.concatenate(units)
    data = np.concatenate([pictures[i].data for i in members])
    found, k = [], 0
    while k < len(starts):  # a long picture in slices of whole intervals
        reach = np.cumsum(units[k:])
        stop = k + max(1, int(np.searchsorted(reach, SLICE, "right")))
        first, last = int(starts[k]), int(starts[stop]) if stop < len(starts) else len(data)
        found.append(decode_intervals(model, data[first:last], starts[k:stop] - first, units[k:stop]))
        k = stop
    whole = np.concatenate(found) if len(found) > 1 else found[0]
    edges = np.concatenate([[0], np.cumsum(lengths)])
    for i, a, b in zip(members, edges, edges[1:]):
        yield i, whole[a:b]


def thumbnail(picture: Picture, coefficients: np.ndarray) -> np.ndarray:
    """Luminance with a pixel a block, from the DC terms alone."""
    across, down = picture.grid
    _, wide, high, quantiser = picture.parts[0] if len(picture.parts) > 1 else (0, 1, 1, picture.parts[0][3])
    dc = coefficients[:, : wide * high, 0].astype(np.int64) * picture.steps.get(quantiser, 1)
    plane = dc.reshape(down, across, high, wide).transpose(0, 2, 1, 3).reshape(down * high, across * wide)
    rows, columns = -(-picture.height // 8), -(-picture.width // 8)
    if len(picture.parts) > 1:
        rows = min(plane.shape[0], -(-rows * high // max(p[2] for p in picture.parts)))
        columns = min(plane.shape[1], -(-columns * wide // max(p[1] for p in picture.parts)))
    return np.clip((plane[:rows, :columns] >> 3) + 128, 0, 255).astype(np.uint8)


def difference_hash(image: np.ndarray) -> int:
    """64 bits: whether the mean of each of 8 x 9 fields is darker than its right neighbour's.

    The fields cover all pixels; below 8 rows or 9 columns, some share theirs.
    """
    rows = (np.arange(8) * image.shape[0]) // 8
    columns = (np.arange(9) * image.shape[1]) // 9
    total = np.add.reduceat(np.add.reduceat(image.astype(np.int64), rows, axis=0), columns, axis=1)
    wide = np.maximum(np.diff(np.append(columns, image.shape[1])), 1)
    return int.from_bytes(np.packbits(total[:, :-1] * wide[1:] < total[:, 1:] * wide[:-1]).tobytes(), "big")


def payload_of(picture: Picture, coefficients: np.ndarray) -> bytes:
    """The bytes that ``encode_pictures`` has stored."""
    raw = (coefficients.reshape(-1) + np.int16(128)).astype(np.uint8).tobytes()
    return raw if picture.payload is None else raw[: picture.payload]


# --- DataFrames -------------------------------------------------------------------------------


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: each text as a JPEG in a binary column."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in arrow_batches(batches, most_bytes=1 << 20):
            raw = [x.encode() for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(map(len, raw), pa.int64()), pa.array(encode_pictures([padded(x) for x in raw]), pa.binary())], ["doc_id", "n_bytes", "media"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


FEATURES = "media_bytes long, media_sha256 string, width int, height int, thumb_hash string, payload_bytes long, payload_sha256 string, tail_crc32 long"


def features(media: list[bytes | None]) -> list[tuple | None]:
    """The columns of FEATURES for each picture, from its bytes; None for what can't be read."""
    out: list[tuple | None] = [None] * len(media)
    pictures, index = [], []
    for i, x in enumerate(media):
        try:
            pictures.append(parse(x or b""))
            index.append(i)
        except (ValueError, IndexError):
            continue
    try:
        decoded = list(decode_pictures(pictures))
    except ValueError:  # a broken one among them: one by one
        decoded = []
        for i, x in enumerate(pictures):
            try:
                decoded += [(i, c) for _, c in decode_pictures([x])]
            except ValueError:
                continue
    for i, coefficients in decoded:
        x, raw = pictures[i], media[index[i]]
        payload = payload_of(x, coefficients)
        out[index[i]] = (len(raw), hashlib.sha256(raw).hexdigest(), x.width, x.height, f"{difference_hash(thumbnail(x, coefficients)):016x}", len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    return out


def media_features(pictures: DataFrame, media_col: str = "media") -> DataFrame:
    """All other columns of ``pictures``, then those of FEATURES, read from the media column."""
    others = [c for c in pictures.columns if c != media_col]
    source = pictures.select(*[pictures[f"`{c}`"] for c in others], pictures[f"`{media_col}`"])
    kinds = ["int64", "string", "int32", "int32", "string", "int64", "string", "int64"]
    names = [x.split()[0] for x in FEATURES.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in arrow_batches(batches, column=len(others), most_bytes=1 << 20):
            found = features(b.column(len(others)).to_pylist())
            columns = [pa.array([x and x[k] for x in found], pa.type_for_alias(kind)) for k, kind in enumerate(kinds)]
            yield pa.record_batch([*b.columns[: len(others)], *columns], [*others, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(others)]), FEATURES])
    return source.mapInArrow(run, schema)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every text of ``documents`` as a JPEG, read it back and compute its features."""
    from pyspark.sql import functions as F

    found = media_features(encode_media(table(spark, sf_dir, "documents")))
    feature = F.concat_ws(":", F.concat_ws("x", "width", "height"), "thumb_hash").alias("feature")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature)
