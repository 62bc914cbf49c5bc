"""Media columns: payloads as baseline JPEG files, and DC-only thumbnails of any baseline JPEG.

Writing: every 192 bytes of a payload become one 8x8 minimum coded unit, three components of 64 quantised
coefficients (the format's own unit) in coded order, with quantiser 1, so nothing is lost. Byte b becomes
coefficient b + 256, all of one category, whose code is one bit long: ten bits each, 240 bytes a unit. A
restart marker follows every unit, so units decode side by side.
Reading: parse the markers, Huffman-decode the scan, give back the coefficients; the thumbnail is built from
the luminance DC coefficients alone.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loomwork.llm.common import chunks, read

UNIT = 192
BLOCK = 64
CATEGORY = 9
PLUS = 256  # 256 to 511 is category 9
MOST = 8191  # units in a row: 65535 pixels
PAYLOAD = re.compile(rb"payload ([0-9]+)")


class Frame(NamedTuple):
    width: int
    height: int
    parts: tuple[tuple[int, int, int, int, int, int], ...]  # of each component: horizontal, vertical sampling, quantiser, DC table, AC table, its id
    quantisers: tuple[tuple[int, int], ...]  # (table, first entry)
    tables: tuple[tuple[int, bytes, bytes], ...]  # class << 4 | id, counts by length, symbols
    restart: int
    comment: bytes
    scan: tuple[int, int]


def huffman_codes(counts: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """(symbol, length, code) of a table as a file states it."""
    out, code, at = [], 0, 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[at : at + n]:
            out.append((symbol, length, code))
            code += 1
        at += n
        code <<= 1
    return out


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def grid(units: int) -> tuple[int, int]:
    """Columns and rows of units: as square as may be, with less than a row to spare."""
    columns = min(MOST, int(np.ceil(np.sqrt(units))))
    return columns, -(-units // columns)


def header(columns: int, rows: int, length: int) -> bytes:
    table = bytes([1] + [0] * 15) + bytes([CATEGORY])  # one symbol, code 0
    parts = b"".join(bytes([i, 0x11, 0]) for i in (1, 2, 3))
    return b"".join((
        b"\xff\xd8",
        segment(0xFE, b"payload " + str(length).encode()),
        segment(0xDB, b"\0" + b"\1" * BLOCK),
        segment(0xC0, struct.pack(">BHHB", 8, 8 * rows, 8 * columns, 3) + parts),
        segment(0xC4, b"\x00" + table),
        segment(0xC4, b"\x10" + table),
        segment(0xDD, struct.pack(">H", 1)),
        segment(0xDA, b"\3" + b"".join(bytes([i, 0]) for i in (1, 2, 3)) + b"\0\x3f\0"),
    ))


def encode(payloads: list[bytes]) -> list[bytes]:
    """A baseline JPEG file for each payload, whose length is a positive multiple of 192."""
    shapes = [grid(len(p) // UNIT) for p in payloads]
    full = [p.ljust(c * r * UNIT) for p, (c, r) in zip(payloads, shapes)]
    units = np.array([len(p) // UNIT for p in full])
    # code 0, then the nine bits of b + 256, which are 1 and the byte: four make five bytes
    four = np.frombuffer(b"".join(full), "u1").reshape(-1, 4).astype("u8") | PLUS
    packed = four[:, 0] << 30 | four[:, 1] << 20 | four[:, 2] << 10 | four[:, 3]
    raw = packed.astype(">u8").view("u1").reshape(-1, 8)[:, 3:].ravel()
    size = np.full(units.sum(), UNIT * 10 // 8)
    stuffed = np.flatnonzero(raw == 0xFF) + 1
    ends = np.cumsum(size)
    out = np.insert(raw, stuffed, 0) if len(stuffed) else raw
    ends = ends + np.searchsorted(stuffed, ends, "right")
    within = np.arange(len(size)) - np.repeat(np.cumsum(units) - units, units)
    inner = within < np.repeat(units, units) - 1  # a marker after each unit of a file but its last
    markers = np.stack([np.full(inner.sum(), 0xFF), 0xD0 + within[inner] % 8], axis=1).astype("u1").ravel()
    out = np.insert(out, np.repeat(ends[inner], 2), markers)
    stops = (ends + 2 * np.cumsum(inner))[np.cumsum(units) - 1].tolist()
    whole, start, files = out.tobytes(), 0, []
    for p, (c, r), stop in zip(payloads, shapes, stops):
        files.append(header(c, r, len(p)) + whole[start:stop] + b"\xff\xd9")
        start = stop
    return files


def parse(file: bytes) -> Frame:
    """The markers of a baseline JPEG file; ValueError if it isn't one."""
    if file[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    at, restart, comment, size, found, quantisers, tables = 2, 0, b"", None, {}, {}, {}
    while True:
        while file[at + 1 : at + 2] == b"\xff":
            at += 1
        if file[at : at + 1] != b"\xff":
            raise ValueError("no marker")
        marker, (length,) = file[at + 1], struct.unpack_from(">H", file, at + 2)
        body = file[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xFE:
            comment = body
        elif marker == 0xDD:
            (restart,) = struct.unpack(">H", body)
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quantisers[body[0] & 15] = struct.unpack(">H", body[1:3])[0] if wide else body[1]
                body = body[1 + BLOCK * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC0:
            bits, height, width, n = struct.unpack_from(">BHHB", body)
            if bits != 8:
                raise ValueError("not 8-bit")
            size = width, height
            found = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)}
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a baseline file")
        elif marker == 0xDA:
            if size is None:
                raise ValueError("no frame")
            picked = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
            parts = tuple((*found[i], t >> 4, 0x10 | t & 15, i) for i, t in picked)
            if not parts or any(p[2] not in quantisers or p[3] not in tables or p[4] not in tables for p in parts):
                raise ValueError("a table is missing")
            if not all(size) or any(not 1 <= n <= 4 for p in parts for n in p[:2]):
                raise ValueError("no size")
            if len(parts) == 1:  # a scan of one component has single blocks, whatever its sampling
                parts = ((1, 1, *parts[0][2:]),)
            end = len(file) - 2 if file[-2:] == b"\xff\xd9" else len(file)
            return Frame(*size, parts, tuple(sorted(quantisers.items())), tuple((k, *v) for k, v in sorted(tables.items())), restart, comment, (at, end))


@lru_cache(maxsize=64)
def lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """By the next 16 bits: length << 8 | symbol; 0 where there is no code."""
    out = np.zeros(1 << 16, "i4")
    for symbol, length, code in huffman_codes(counts, symbols):
        out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
    return out


def unit_counts(f: Frame) -> tuple[int, int]:
    wide, tall = max(p[0] for p in f.parts), max(p[1] for p in f.parts)
    return -(-f.width // (8 * wide)), -(-f.height // (8 * tall))


def decode(files: list[bytes]) -> list[tuple[Frame, np.ndarray]]:
    """Of each file: its frame, and its coefficients (units, blocks of a unit, 64) in coded order.

    Files with the same tables and components are decoded side by side, all their restart intervals at once.
    """
    frames = [parse(x) for x in files]
    groups: dict[tuple, list[int]] = defaultdict(list)
    for i, f in enumerate(frames):
        groups[f.parts, f.tables, f.restart].append(i)
    out: list = [None] * len(files)
    for (parts, tables, restart), members in groups.items():
        blocks = [c for c, p in enumerate(parts) for _ in range(p[0] * p[1])]
        joined, starts, units = [], [], []
        at = 0
        for i in members:
            data = np.frombuffer(files[i], "u1")[slice(*frames[i].scan)]
            total = int(np.prod(unit_counts(frames[i])))
            step = restart or total
            counts = np.full(-(-total // step), step)
            counts[-1] = total - step * (len(counts) - 1)
            lead = np.flatnonzero(data[:-1] == 0xFF)
            mark = lead[(data[lead + 1] & 0xF8) == 0xD0]
            gone = np.concatenate([lead[data[lead + 1] == 0] + 1, mark, mark + 1])
            keep = np.ones(len(data), bool)
            keep[gone] = False
            begin = np.concatenate([[0], mark + 2])
            begin -= np.searchsorted(np.sort(gone), begin)
            if len(begin) != len(counts):
                raise ValueError("restart markers and size disagree")
            joined.append(data[keep])
            starts.append(begin + at)
            units.append(counts)
            at += int(keep.sum())
        got = intervals(np.concatenate(joined), np.concatenate(starts), np.concatenate(units), blocks, parts, {k: lookup(c, s) for k, c, s in tables})
        done = 0
        for i, counts in zip(members, units):
            out[i] = frames[i], got[done : done + counts.sum()]
            done += counts.sum()
    return out


def intervals(data: np.ndarray, starts: np.ndarray, units: np.ndarray, blocks: list[int], parts: tuple, luts: dict[int, np.ndarray]) -> np.ndarray:
    """Huffman-decode restart intervals in step, one symbol of each at a time."""
    ids = sorted(luts)
    lut = np.concatenate([luts[i] for i in ids])
    dc = np.array([ids.index(parts[c][3]) for c in blocks]) << 16
    ac = np.array([ids.index(parts[c][4]) for c in blocks]) << 16
    padded = np.concatenate([data, np.full(16, 0xFF, "u1")])
    window = np.ndarray((len(data) + 8,), ">u8", padded, strides=(1,))  # eight bytes from each place
    most = len(data) * 8
    n_blocks = len(blocks)
    total = units * n_blocks
    base = np.cumsum(total) - total
    out = np.zeros(int(total.sum()) * BLOCK, "i2")
    component = np.array(blocks)
    prediction = np.zeros((len(starts), len(parts)), "i4")
    pos, one = starts.astype("u8") * 8, np.uint64(1)

    def symbols(table: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """The next symbol of each interval and the value behind it."""
        nonlocal pos
        w = window[pos >> np.uint64(3)].astype("u8") << (pos & np.uint64(7))
        found = lut[(w >> np.uint64(48)).astype("i8") + table]
        if not found.all():
            raise ValueError("no such code")
        length, size = (found >> 8).astype("u8"), (found & 15).astype("u8")
        value = (((w << length) >> one) >> (np.uint64(63) - size)).astype("i4")
        pos = pos + (length + size)
        if pos.max() > most:
            raise ValueError("the scan ends early")
        size = size.astype("i4")
        value -= np.where(value < (1 << size) >> 1, (1 << size) - 1, 0)
        return found & 255, value

    # While all intervals are at the same coefficient, one number says where they are.
    step, even = 0, bool((total == total[0]).all())
    grid_ = out.reshape(len(starts), -1) if even else out
    while even and step < total[0] * BLOCK:
        c = (step // BLOCK) % n_blocks
        if step % BLOCK:
            held = pos
            symbol, value = symbols(int(ac[c]))
            if ((symbol > 15) | (symbol == 0)).any():
                pos, even = held, False
                break
        else:
            _, value = symbols(int(dc[c]))
            value = prediction[:, component[c]] = prediction[:, component[c]] + value
        grid_[:, step] = value
        step += 1
    live = np.arange(len(starts) if step < total[0] * BLOCK else 0)
    block, k = np.full(len(live), step // BLOCK), np.full(len(live), step % BLOCK)
    while len(live):
        which = block % n_blocks
        first = k == 0
        symbol, value = symbols(np.where(first, dc[which], ac[which]))
        if first.any():
            r, c = live[first], component[which[first]]
            value[first] += prediction[r, c]
            prediction[r, c] = value[first]
        k = k + np.where(first, 0, symbol >> 4)
        coded = first | ((symbol & 15) > 0)
        if (k[coded] > 63).any():
            raise ValueError("a run beyond its block")
        out[((base[live] + block) * BLOCK + k)[coded]] = value[coded]
        k += 1
        k[~first & (symbol == 0)] = BLOCK
        over = k >= BLOCK
        if over.any():
            block = block + over
            k[over] = 0
            go = block < total[live]
            pos, block, k, live = pos[go], block[go], k[go], live[go]
    return out.reshape(-1, n_blocks, BLOCK)


def thumbnail(f: Frame, coefficients: np.ndarray) -> np.ndarray:
    """Luminance at an eighth of the size, from DC coefficients alone: the first component's blocks in place."""
    columns, rows = unit_counts(f)
    h, v, q = f.parts[0][:3]
    level = coefficients[:, : h * v, 0].astype("f8") * dict(f.quantisers)[q] / 8 + 128
    image = level.reshape(rows, columns, v, h).transpose(0, 2, 1, 3).reshape(rows * v, columns * h)
    tall, wide = max(p[1] for p in f.parts), max(p[0] for p in f.parts)
    height, width = -(-(-(-f.height * v // tall)) // 8), -(-(-(-f.width * h // wide)) // 8)
    return np.clip(np.rint(image[:height, :width]), 0, 255).astype("u1")


def average_hash(image: np.ndarray) -> str:
    """64 bits: which cells of an 8x8 grid over the image are brighter than the grid's mean."""
    rows, cols = (np.linspace(0, n, 9).astype(int) for n in image.shape)
    total = np.pad(image.astype("i8").cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    r0, c0 = np.minimum(rows[:-1], image.shape[0] - 1), np.minimum(cols[:-1], image.shape[1] - 1)
    r1, c1 = np.maximum(rows[1:], r0 + 1), np.maximum(cols[1:], c0 + 1)
    cells = total[np.ix_(r1, c1)] - total[np.ix_(r0, c1)] - total[np.ix_(r1, c0)] + total[np.ix_(r0, c0)]
    cells = cells / np.outer(r1 - r0, c1 - c0)
    return np.packbits(cells > cells.mean()).tobytes().hex()


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8")
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT))


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): the whole text of each row as a baseline JPEG file in a binary column.

    A null text counts as empty (one unit of spaces); repeated rows give repeated files; other columns are
    ignored; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole, "text", 2 << 20):
                texts = b.column("text").to_pylist()
                sizes = [len((x or "").encode("utf-8")) for x in texts]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(encode([payload_of(x) for x in texts]), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


def decoded(files: list[bytes | None]) -> list[tuple[Frame, np.ndarray, str] | str]:
    """Each file's frame, coefficients and thumbnail's hash, or why there are none. One bad file doesn't touch the others."""
    broken = (ValueError, IndexError, KeyError, struct.error)
    out: list = ["null" if x is None else "" for x in files]
    sound = []
    for i, x in enumerate(files):
        if x is not None:
            try:
                f = parse(x)
                if int(np.prod(unit_counts(f))) > 4 * len(x):  # a block takes two bits at least
                    raise ValueError("the scan ends early")
                sound.append(i)
            except (*broken, ZeroDivisionError) as e:
                out[i] = str(e) or "unreadable"
    try:
        for i, got in zip(sound, decode([files[i] for i in sound])):
            out[i] = (*got, average_hash(thumbnail(*got)))
    except broken:
        for i in sound:
            try:
                (got,) = decode([files[i]])
                out[i] = (*got, average_hash(thumbnail(*got)))
            except broken as e:
                out[i] = str(e) or "unreadable"
    return out


def payload_in(f: Frame, coefficients: np.ndarray) -> bytes | None:
    """The payload of a file that ``encode`` wrote; None in any other file."""
    stated = PAYLOAD.fullmatch(f.comment)
    if not stated or coefficients.shape[1:] != (3, BLOCK) or coefficients.min() < PLUS or coefficients.max() > PLUS + 255:
        return None
    return (coefficients.ravel() - PLUS).astype("u1").tobytes()[: int(stated.group(1))]


def features(media: DataFrame, keep_payload: bool = False) -> DataFrame:
    """What the stored files of ``media(doc_id, n_bytes, media, ...)`` say when they are read back.

    payload_bytes, payload_sha256, tail_crc32 (of the last 16 bytes), media_bytes, media_sha256, width, height,
    feature (``<width>x<height>:<hash of the DC-only thumbnail>``) and error; with ``keep_payload`` also the payload. The
    payload columns are null for files that hold none (any other baseline JPEG). A null, broken or foreign file gives a row
    with nulls and says why in ``error``, which is null otherwise; repeated files give repeated rows; other columns
    are ignored; an empty table gives none.
    """
    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, width int, height int, error string" + ", payload binary" * keep_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole, "media", 2 << 20):
                files = b.column("media").to_pylist()
                rows = []
                for file, got in zip(files, decoded(files)):
                    stored_as = [None, None] if file is None else [len(file), hashlib.sha256(file).hexdigest()]
                    if isinstance(got, str):
                        rows.append([None, None, None, *stored_as, None, None, None, got] + [None] * keep_payload)
                        continue
                    f, c, shown = got
                    payload = payload_in(f, c)
                    said = [None] * 3 if payload is None else [len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])]
                    rows.append([*said, *stored_as, f"{f.width}x{f.height}:{shown}", f.width, f.height, None] + [payload] * keep_payload)
                types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.binary()]
                names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "error", "payload"]
                cols = [b.column("doc_id"), b.column("n_bytes"), *(pa.array(c, t) for c, t in zip(zip(*rows), types))]
                yield pa.RecordBatch.from_arrays(cols, names=names[: len(cols)])

    return media.selectExpr("cast(doc_id as bigint) doc_id", "cast(n_bytes as bigint) n_bytes", "media").mapInArrow(run, schema)


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(store(read(spark, sf_dir, "documents")))
