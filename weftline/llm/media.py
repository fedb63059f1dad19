"""Media columns: baseline JPEG, written and read in numpy.

A payload's bytes are the quantised coefficients of grey 8x8 blocks, 64 bytes a
block in zigzag order, so the picture carries them without loss: a baseline
sequential JPEG with a quantisation table of ones, one Huffman table for DC and
one for AC, and a restart after every block. The restarts let the decoder read
all blocks of a batch side by side, one symbol of each at a time. From the
decoded DC coefficients comes a luminance thumbnail, a pixel a block, without
any inverse transform; dimensions and a hash of the thumbnail are the features.
Baseline JPEGs of other makers (DC prediction, any restart interval, colour at
any sampling, several scans) are decoded block by block, their luminance alone.

Blocks fill rows of a near-square picture; blocks of zeros complete the last
row, and a comment segment holds the payload's length.

Defined results: null and empty texts give one block of zeros; a text of any
length is taken whole, in slices of bounded memory while it is coded; repeated
rows give equal values; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Coefficients a block; and blocks that are coded at a time.
BLOCK, SLICE = 64, 1 << 14
#: Code lengths 1, 2, ... of the categories that text bytes use most.
DC_FIRST, AC_FIRST = (7, 6, 8, 5), (0x07, 0x06, 0x08, 0x00, 0x05)
DC_REST = [k for k in range(9) if k not in DC_FIRST]
AC_REST = [r << 4 | s for r in range(16) for s in range(1, 9) if (r << 4 | s) not in AC_FIRST] + [0xF0]
THUMB = 16


def huffman(first: tuple[int, ...], rest: list[int], length: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """A DHT body (counts and symbols), code and length by symbol, and a lookup by 16 bits: length << 8 | symbol."""
    counts = [0] * 16
    for k in range(len(first)):
        counts[k] = 1
    counts[length - 1] += len(rest)
    codes, lengths, look = np.zeros(256, np.uint64), np.zeros(256, np.int64), np.zeros(1 << 16, np.int64)
    code, symbols = 0, [*first, *rest]
    at = iter(symbols)
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            s = next(at)
            codes[s], lengths[s] = code, n
            look[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | s
            code += 1
        code <<= 1
    return bytes(counts) + bytes(symbols), codes, lengths, look


DC_TABLE, DC_CODE, DC_LENGTH, _ = huffman(DC_FIRST, DC_REST, 7)
AC_TABLE, AC_CODE, AC_LENGTH, _ = huffman(AC_FIRST, AC_REST, 12)
#: Bits of a value, by value.
CATEGORY = np.array([v.bit_length() for v in range(256)], np.int64)


def lookup(table: bytes) -> np.ndarray:
    """length << 8 | symbol by the next 16 bits, from a DHT body."""
    look, code, at = np.zeros(1 << 16, np.int64), 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            look[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | table[at]
            code, at = code + 1, at + 1
        code <<= 1
    return look


def scan(blocks: np.ndarray, first: int) -> bytes:
    """Entropy-coded blocks (n x 64 bytes), a restart marker before each but number 0."""
    n = len(blocks)
    row, col = np.nonzero(np.concatenate([np.ones((n, 1), bool), blocks[:, 1:] != 0], axis=1))
    value = blocks[row, col].astype(np.int64)
    before = np.empty_like(col)
    before[1:] = col[:-1]
    before[0] = 0
    gap = np.where(col == 0, 0, col - before - 1)
    size = CATEGORY[value]
    dc = col == 0
    symbol = (gap & 15) << 4 | size
    bits = np.where(dc, DC_CODE[size], AC_CODE[symbol])
    wide = np.where(dc, DC_LENGTH[size], AC_LENGTH[symbol])
    bits = bits << size.astype(np.uint64) | value.astype(np.uint64)
    wide = wide + size
    # runs of 16 zeros before a value; an end of block after the last one but at 63
    zrl = np.where(dc, 0, gap >> 4)
    last = np.r_[row[1:] != row[:-1], True]
    eob = last & (col != BLOCK - 1)
    many = 1 + zrl + eob
    if int(many.max(initial=1)) == 1:
        out_bits, out_wide, out_row = bits, wide, row
    else:
        at = np.cumsum(many) - many
        total = int(many.sum())
        out_row = np.repeat(row, many)
        out_bits = np.full(total, AC_CODE[0xF0], np.uint64)
        out_wide = np.full(total, AC_LENGTH[0xF0], np.int64)
        out_bits[at + zrl], out_wide[at + zrl] = bits, wide
        e = at[eob] + zrl[eob] + 1
        out_bits[e], out_wide[e] = AC_CODE[0x00], AC_LENGTH[0x00]
    ends = np.cumsum(out_wide)
    lasts = np.flatnonzero(np.r_[out_row[1:] != out_row[:-1], True])
    used = np.diff(np.r_[0, ends[lasts]])
    full = (used + 7) >> 3
    start = np.cumsum(full) - full  # byte at which each block starts
    shift = 8 * start - (ends[lasts] - used)
    place = ends - out_wide + shift[out_row]
    total = int(full.sum())
    # each code goes into a window of 8 bytes, as numbers that cannot overlap
    window = out_bits << (np.uint64(64) - out_wide.astype(np.uint64)) >> (place & 7).astype(np.uint64)
    raw = np.zeros(total + 8, np.uint8)
    byte = place >> 3
    parts = window.astype(">u8").view(np.uint8).reshape(-1, 8)
    for k in range(5):  # 12 + 8 + 7 bits at most
        part = parts[:, k].astype(np.float64)
        raw[: total + 8] |= np.bincount(byte + k, part, minlength=total + 8)[: total + 8].astype(np.uint8)
    raw = raw[:total]
    pad = (8 * full - used).astype(np.uint8)
    raw[start + full - 1] |= ((1 << pad.astype(np.int64)) - 1).astype(np.uint8)
    # zero after each 0xFF; markers between blocks
    mask = raw == 0xFF
    width = np.ones(total, np.int64) + mask
    width[start[(0 if first else 1) :]] += 2
    head = np.zeros(total, np.int64)
    head[start[(0 if first else 1) :]] = 2
    at = np.cumsum(width) - width + head
    out = np.zeros(int(width.sum()), np.uint8)
    out[at] = raw
    marks = at[start[(0 if first else 1) :]]
    out[marks - 2] = 0xFF
    out[marks - 1] = 0xD0 + (np.arange(first + (0 if first else 1), first + n) - 1) % 8
    return out.tobytes()


def shape(blocks: int) -> tuple[int, int]:
    """Columns and rows of a near-square picture of at least so many blocks."""
    cols = max(1, int(np.ceil(np.sqrt(blocks))))
    if cols > 8191:
        raise ValueError("a baseline JPEG has at most 65535 pixels a side")
    return cols, -(-blocks // cols)


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def encode(payload: bytes) -> bytes:
    """A payload, a positive multiple of 64 bytes, as a baseline JPEG."""
    n = len(payload) // BLOCK
    cols, rows = shape(n)
    head = b"\xff\xd8" + segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + segment(0xFE, b"payload=%d" % len(payload))
    head += segment(0xDB, b"\0" + b"\1" * 64) + segment(0xC0, struct.pack(">BHHBBBB", 8, 8 * rows, 8 * cols, 1, 1, 0x11, 0))
    head += segment(0xC4, b"\x00" + DC_TABLE) + segment(0xC4, b"\x10" + AC_TABLE) + segment(0xDD, struct.pack(">H", 1)) + segment(0xDA, b"\1\1\0\0\x3f\0")
    data = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK)
    parts = [scan(data[k : k + SLICE], k) for k in range(0, n, SLICE)]
    if cols * rows > n:
        parts.append(scan(np.zeros((cols * rows - n, BLOCK), np.uint8), n))
    return b"".join([head, *parts, b"\xff\xd9"])


def segments(media: bytes) -> tuple[dict, list[dict]]:
    """A JPEG's sizes and comment, and its scans with the tables that hold for them.

    ``components``: (name, columns and rows of blocks in an MCU, quantisation
    table) in the frame's order. A scan: its components as (place in the frame,
    DC table, AC table), ``restart`` (MCUs an interval, 0: none) and ``data``.
    """
    if media[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    raw = np.frombuffer(media, np.uint8)
    # where entropy-coded data ends: a marker that is neither a stuffed byte nor a restart
    marks = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] != 0) & (raw[1:] != 0xFF) & ((raw[1:] & 0xF8) != 0xD0))
    found: dict = {"comment": b""}
    quant, huffman, restart, scans, at = {}, {}, 0, [], 2
    while True:
        if at + 2 > len(media) or media[at] != 0xFF:
            raise ValueError("a marker is missing")
        while at + 1 < len(media) and media[at + 1] == 0xFF:  # fill bytes
            at += 1
        marker = media[at + 1]
        if marker == 0xD9:
            return found, scans
        (length,) = struct.unpack_from(">H", media, at + 2)
        body = media[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xC0:
            depth, found["height"], found["width"], n = struct.unpack_from(">BHHB", body)
            found["components"] = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            if depth != 8 or n not in (1, 3) or not found["height"] or not found["width"]:
                raise ValueError("only pictures of 8 bits, grey or YCbCr, with their height in the frame are read")
        elif marker in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("only baseline JPEG is read")
        elif marker == 0xC4:
            while body:
                size = 17 + sum(body[1:17])
                huffman[body[0]] = bytes(body[1:size])
                body = body[size:]
        elif marker == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4)
                quant[body[0] & 15] = [int.from_bytes(body[1 + wide * k : 1 + wide * (k + 1)], "big") for k in range(64)]
                body = body[1 + 64 * wide :]
        elif marker == 0xDD:
            (restart,) = struct.unpack(">H", body)
        elif marker == 0xFE:
            found["comment"] = bytes(body)
        elif marker == 0xEE and body[:5] == b"Adobe" and body[11] != 1:
            found["transform"] = body[11]
        elif marker == 0xDA:
            if "components" not in found:
                raise ValueError("a scan before its frame")
            if len(found["components"]) == 3 and found.get("transform") is not None:
                raise ValueError("only YCbCr has its luminance apart")
            names = [c[0] for c in found["components"]]
            parts = [(names.index(body[1 + 2 * k]), huffman[body[2 + 2 * k] >> 4], huffman[0x10 | body[2 + 2 * k] & 15]) for k in range(body[0])]
            k = int(np.searchsorted(marks, at))
            end = int(marks[k]) if k < len(marks) else len(media)
            scans.append({"parts": parts, "restart": restart, "data": memoryview(media)[at:end]})
            found.setdefault("dc_scale", quant[found["components"][0][3]][0])
            at = end


def grid(info: dict, place: int = 0) -> tuple[int, int]:
    """Columns and rows of blocks that a component's samples need."""
    most = max(c[1] for c in info["components"]), max(c[2] for c in info["components"])
    _, h, v, _ = info["components"][place]
    return -(-(-(-info["width"] * h // most[0])) // 8), -(-(-(-info["height"] * v // most[1])) // 8)


def markers(media: bytes) -> tuple[dict, memoryview]:
    """Sizes, first scan's tables (``huffman``: 0x00 DC, 0x10 AC) and its entropy-coded data."""
    found, scans = segments(media)
    if not scans:
        raise ValueError("a picture without a scan")
    _, dc, ac = scans[0]["parts"][0]
    return found | {"huffman": {0x00: dc, 0x10: ac}, "restart": scans[0]["restart"], "scans": scans}, scans[0]["data"]


def plain(info: dict) -> np.ndarray:
    """The luminance coefficients of any baseline JPEG, block by block: with DC
    prediction, any restart interval, colour at any sampling, one scan or several."""
    for scan in info["scans"]:
        if any(place == 0 for place, _, _ in scan["parts"]):
            break
    else:
        raise ValueError("no scan of the luminance")
    cols, rows = grid(info)
    if len(scan["parts"]) == 1:
        wide, high, units = cols, rows, [(0, *scan["parts"][0][1:], 1, 1)]
    else:
        most = max(c[1] for c in info["components"]), max(c[2] for c in info["components"])
        wide, high = -(-info["width"] // (8 * most[0])), -(-info["height"] // (8 * most[1]))
        units = [(place, dc, ac, *info["components"][place][1:3]) for place, dc, ac in scan["parts"]]
    # blocks of an MCU in order: component, place in the MCU, tables
    order = [(place, x, y, table_of(dc).tolist(), table_of(ac).tolist()) for place, dc, ac, h, v in units for y in range(v) for x in range(h)]
    _, _, _, h0, v0 = next(u for u in units if u[0] == 0)
    raw = np.frombuffer(scan["data"], np.uint8)
    mark = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] & 0xF8 == 0xD0)) if len(raw) > 1 else np.empty(0, np.int64)
    parts = [raw[a:b] for a, b in zip(np.r_[0, mark + 2], np.r_[mark, len(raw)], strict=True)]
    out = np.zeros((rows, cols, BLOCK), np.int16)
    mcu, total = 0, wide * high
    for part in parts:
        keep = np.ones(len(part), bool)
        keep[1:] &= ~((part[:-1] == 0xFF) & (part[1:] == 0))
        data = np.r_[part[keep], np.full(8, 0xFF, np.uint8)].astype(np.int64)
        quad = memoryview(data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:])
        end, bit, last = 8 * int(keep.sum()), 0, [0] * len(info["components"])
        for _ in range(min(scan["restart"] or total, total - mcu)):
            for place, x, y, dc, ac in order:
                k, look, block = 0, dc, {}
                while k < BLOCK:
                    if bit > end:
                        raise ValueError("a picture's blocks are not complete")
                    hit = look[quad[bit >> 3] >> (16 - (bit & 7)) & 0xFFFF]
                    if not hit:
                        raise ValueError("a code that no table has")
                    bit += hit >> 8
                    size = hit & 15
                    value = (quad[bit >> 3] >> (32 - (bit & 7) - size)) & ((1 << size) - 1) if size else 0
                    if size and not value >> (size - 1):
                        value -= (1 << size) - 1
                    bit += size
                    if not k:
                        last[place] += value
                        block[0], look = last[place], ac
                    elif not size:
                        if hit & 0xF0 != 0xF0:
                            break
                        k += 15
                    else:
                        k += hit >> 4 & 15
                        if k >= BLOCK:
                            raise ValueError("a block with too many coefficients")
                        block[k] = value
                    k += 1
                if place == 0:
                    row, col = mcu // wide * v0 + y, mcu % wide * h0 + x
                    if row < rows and col < cols:  # others only fill an MCU
                        out[row, col, list(block)] = list(block.values())
            mcu += 1
        if bit > end:
            raise ValueError("a picture's blocks are not complete")
    if mcu < total:
        raise ValueError("a picture's blocks are not complete")
    return out.reshape(-1, BLOCK)


def unscan(raw: np.ndarray, dc: np.ndarray, ac: np.ndarray) -> np.ndarray:
    """All blocks of entropy-coded data with a restart after each: n x 64 coefficients."""
    mark = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] >= 0xD0) & (raw[1:] <= 0xD7))
    keep = np.ones(len(raw), bool)
    keep[1:] &= ~((raw[:-1] == 0xFF) & (raw[1:] == 0))
    keep[mark] = keep[mark + 1] = False
    place = np.cumsum(keep) - keep
    start = np.r_[0, place[mark + 1]].astype(np.int64)
    data = np.r_[raw[keep], np.zeros(8, np.uint8)].astype(np.uint32)
    # 32 bits from each byte on
    quad = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
    out = np.zeros(len(start) * BLOCK, np.int16)
    base = np.arange(len(start)) * BLOCK
    bit, k = start * 8, np.zeros(len(start), np.int64)
    look = dc
    while len(base):
        word = quad[bit >> 3].astype(np.int64) << (bit & 7) & 0xFFFFFFFF  # 25 bits at least are real
        hit = look[word >> 16]
        symbol, length = hit & 0xFF, hit >> 8
        size = symbol & 15
        extra = (word << length & 0xFFFFFFFF) >> (32 - size)
        value = np.where(extra >> np.maximum(size - 1, 0) & 1, extra, extra - (1 << size) + 1)
        if look is ac:
            k = k + (symbol >> 4)
            some = size > 0
            put = base[some] + k[some]
            out[put] = value[some]
            done = (symbol == 0) | (k >= BLOCK - 1)
        else:
            out[base] = np.where(size > 0, value, 0)
            done, look = np.zeros(len(base), bool), ac
        bit = bit + length + size
        k = k + 1
        if done.any():
            go = ~done
            base, bit, k = base[go], bit[go], k[go]
    return out.reshape(-1, BLOCK)


_tables: dict[bytes, np.ndarray] = {}


def table_of(body: bytes) -> np.ndarray:
    if body not in _tables:
        if len(_tables) > 64:
            _tables.clear()
        _tables[body] = lookup(body)
    return _tables[body]


@functools.lru_cache(64)
def short_codes(body: bytes) -> bool:
    """Whether no code with its value is longer than 25 bits."""
    look = table_of(body)
    return int(((look >> 8) + (look & 15)).max()) <= 25


def side_by_side(info: dict) -> bool:
    """Whether the blocks can be read all at once: grey, a restart after each, codes and values within 25 bits."""
    return len(info["components"]) == 1 and info["restart"] == 1 and all(map(short_codes, info["huffman"].values()))


def decode(media: list[bytes]) -> list[tuple[dict, np.ndarray]]:
    """Segments and luminance coefficients of baseline JPEGs.

    Grey pictures with a restart after each block that share their Huffman
    tables are decoded side by side, any others block by block.
    """
    found = [markers(m) for m in media]
    out: list = [None] * len(media)
    groups: dict[tuple[bytes, bytes], list[int]] = {}
    for k, (info, _) in enumerate(found):
        if side_by_side(info):
            groups.setdefault((info["huffman"][0x00], info["huffman"][0x10]), []).append(k)
        else:
            out[k] = info, plain(info)
    for (dc, ac), ks in groups.items():
        glue = b"\xff\xd0".join(bytes(found[k][1]) for k in ks)
        blocks = np.concatenate([unscan(part, table_of(dc), table_of(ac)) for part in slices(np.frombuffer(glue, np.uint8))])
        at = 0
        for k in ks:
            cols, rows = grid(found[k][0])
            out[k] = found[k][0], blocks[at : at + cols * rows]
            at += cols * rows
        if at != len(blocks):
            raise ValueError("a picture's blocks are not complete")
    return out


def slices(raw: np.ndarray, size: int = 1 << 20) -> Iterator[np.ndarray]:
    """Cut entropy-coded data at restart markers into parts of about ``size`` bytes."""
    at = 0
    while len(raw) - at > 2 * size:
        part = raw[at + size : at + 2 * size]
        cut = np.flatnonzero((part[:-1] == 0xFF) & (part[1:] >= 0xD0) & (part[1:] <= 0xD7))
        if not len(cut):
            raise ValueError("a block is longer than any block can be")
        end = at + size + int(cut[0])
        yield raw[at:end]
        at = end + 2
    yield raw[at:]


def thumbnail(info: dict, blocks: np.ndarray) -> np.ndarray:
    """Luminance by block from the DC coefficients alone."""
    light = blocks[:, 0].astype(np.int64) * info["dc_scale"] // 8 + 128
    return np.clip(light, 0, 255).astype(np.uint8).reshape(grid(info)[::-1])


def thumb_hash(thumb: np.ndarray) -> str:
    """A mean hash over a grid of at most 16 x 16 cells, and the thumbnail's CRC."""
    rows = np.linspace(0, thumb.shape[0], min(THUMB, thumb.shape[0]) + 1).astype(int)[:-1]
    cols = np.linspace(0, thumb.shape[1], min(THUMB, thumb.shape[1]) + 1).astype(int)[:-1]
    cells = np.add.reduceat(np.add.reduceat(thumb.astype(np.int64), rows, 0), cols, 1)
    many = np.outer(np.diff(np.r_[rows, thumb.shape[0]]), np.diff(np.r_[cols, thumb.shape[1]]))
    over = cells * thumb.size > many * int(thumb.sum(dtype=np.int64))
    return f"{np.packbits(over.ravel()).tobytes().hex()}-{zlib.crc32(thumb.tobytes()):08x}"


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % BLOCK or (0 if raw else BLOCK))


def features(info: dict, blocks: np.ndarray, media: bytes) -> tuple:
    """payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    size = int(info["comment"].removeprefix(b"payload="))
    payload = blocks.astype(np.uint8).tobytes()[:size]
    thumb = thumbnail(info, blocks)
    return size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), f"{info['width']}x{info['height']}:{thumb_hash(thumb)}"


def pieces(b: pa.RecordBatch, column: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``most`` bytes of ``column``, a row at least."""
    size = [len(x) if (x := v.as_py()) else 0 for v in b.column(column)]
    at = held = 0
    for k, n in enumerate(size):
        if held and held + n > most:
            yield b.slice(at, k - at)
            at, held = k, 0
        held += n
    if b.num_rows > at:
        yield b.slice(at)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in pieces(batch, "text"):
            n, media = [], []
            for t in b.column("text"):
                size, payload = payload_of(t.as_py())
                n.append(size)
                media.append(encode(payload))
            yield pa.record_batch([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        for b in pieces(batch, "media"):
            media = b.column("media").to_pylist()
            rows = [features(*d, m) for d, m in zip(decode(media), media, strict=True)]
            yield pa.record_batch([b.column("doc_id"), b.column("n_bytes"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=["doc_id", "n_bytes", *names])


def as_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each text's bytes as a JPEG."""
    return small_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Read the pictures back: digests of payload and picture, and the feature."""
    return media.mapInArrow(_read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
