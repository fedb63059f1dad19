import hashlib
import os
import random
import zlib

import numpy as np
import pytest

from weftline.llm import media

random.seed(1)
PAYLOADS = [
    bytes(64), bytes(range(256)), b"a" * 448, bytes([255]) * 6400, bytes(random.choice([0] * 19 + [1, 200]) for _ in range(6400)),
    os.urandom(64 * 300), bytes(63) + b"a" + bytes(64), (bytes(40) + b"x" + bytes(23)) * 5,
]


@pytest.mark.parametrize("payload", PAYLOADS)
def test_round_trip(payload):
    jpeg = media.encode(payload)
    ((info, blocks),) = media.decode([jpeg])
    assert blocks.astype(np.uint8).tobytes()[: len(payload)] == payload
    assert media.features(info, blocks, jpeg)[0] == len(payload)


def plain_decode(jpeg):
    """Bit by bit, one code at a time."""
    info, raw = media.markers(jpeg)
    tables = {}
    for kind, body in info["huffman"].items():
        code, at, codes = 0, 16, {}
        for n in range(1, 17):
            for _ in range(body[n - 1]):
                codes[n, code] = body[at]
                code, at = code + 1, at + 1
            code <<= 1
        tables[kind] = codes
    out, part, k, raw = [], bytearray(), 0, bytes(raw)
    parts = []
    while k < len(raw):
        if raw[k] == 0xFF and 0xD0 <= raw[k + 1] <= 0xD7:
            parts.append(part)
            part, k = bytearray(), k + 2
        else:
            part.append(raw[k])
            k += 2 if raw[k] == 0xFF else 1
    for p in [*parts, part]:
        bits, at = "".join(f"{b:08b}" for b in p), 0

        def symbol(codes):
            nonlocal at
            n, code = 0, 0
            while (n, code) not in codes:
                code, n, at = code << 1 | int(bits[at]), n + 1, at + 1
            return codes[n, code]

        def value(size):
            nonlocal at
            v = int(bits[at : at + size], 2) if size else 0
            at += size
            return v if not size or v >> (size - 1) else v - (1 << size) + 1

        block, i = [0] * 64, 1
        block[0] = value(symbol(tables[0x00]))
        while i < 64:
            s = symbol(tables[0x10])
            if s == 0:
                break
            i += s >> 4
            if s & 15:
                block[i] = value(s & 15)
            i += 1
        out.append(block)
    return np.array(out)


@pytest.mark.parametrize("payload", PAYLOADS[:5])
def test_decoder_equals_the_plain_one(payload):
    jpeg = media.encode(payload[:1280])
    ((_, blocks),) = media.decode([jpeg])
    assert np.array_equal(plain_decode(jpeg), blocks)


def test_many_pictures_and_slices_at_once():
    payloads = [os.urandom(64 * k) for k in (1, 7, 40, 2)] + [os.urandom(64 * (media.SLICE + 5))]
    for (info, blocks), p in zip(media.decode([media.encode(p) for p in payloads]), payloads):
        assert blocks.astype(np.uint8).tobytes()[: len(p)] == p


def test_thumbnail_is_each_blocks_light():
    p = b"".join(bytes([v]) + bytes(63) for v in (0, 8, 80, 160))
    ((info, blocks),) = media.decode([media.encode(p)])
    assert media.thumbnail(info, blocks).tolist() == [[128, 129], [138, 148]]
    assert (info["width"], info["height"]) == (16, 16)


def test_damage_is_noticed():
    jpeg = media.encode(PAYLOADS[1])
    with pytest.raises(ValueError):
        media.decode([b"xx" + jpeg])
    with pytest.raises(ValueError):
        media.markers(jpeg.replace(b"\xff\xc0", b"\xff\xc2"))


def foreign(spark, pixels, quality=0.8):
    """A JPEG (and the picture that it shows) by the Java runtime's own writer and reader; pixels: rows of (r, g, b), or of grey values."""
    jvm = spark._jvm
    high, wide = pixels.shape[:2]
    grey = pixels.ndim == 2
    image = jvm.java.awt.image.BufferedImage(wide, high, jvm.java.awt.image.BufferedImage.TYPE_BYTE_GRAY if grey else jvm.java.awt.image.BufferedImage.TYPE_INT_RGB)
    raster = image.getRaster()
    flat = spark.sparkContext._gateway.new_array(jvm.int, pixels.size)
    for k, v in enumerate(pixels.ravel().tolist()):
        flat[k] = v
    raster.setPixels(0, 0, wide, high, flat)
    stream = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", stream)
    jpeg = bytes(stream.toByteArray())
    shown = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(jpeg)).getRaster()
    back = np.array(list(shown.getPixels(0, 0, wide, high, spark.sparkContext._gateway.new_array(jvm.int, pixels.size)))).reshape(pixels.shape)
    return jpeg, back if grey else back @ np.array([0.299, 0.587, 0.114])


def smooth(high, wide, seed, colours):
    rng = np.random.default_rng(seed)
    x, y = np.meshgrid(np.arange(wide), np.arange(high))
    return np.stack([127 + 120 * np.sin(x / rng.uniform(4, 20) + y / rng.uniform(4, 20) + rng.uniform(0, 6)) for _ in range(colours)], axis=-1).round().astype(int)


@pytest.mark.parametrize("high,wide,colours", [(16, 16, 3), (37, 51, 3), (64, 24, 1), (9, 70, 1), (1, 1, 3)])
def test_pictures_of_another_maker(spark, high, wide, colours):
    pixels = smooth(high, wide, high, colours)
    jpeg, light = foreign(spark, pixels[:, :, 0] if colours == 1 else pixels)
    ((info, blocks),) = media.decode([jpeg])
    thumb = media.thumbnail(info, blocks)
    assert (info["width"], info["height"]) == (wide, high) and thumb.shape == (-(-high // 8), -(-wide // 8))
    for row in range(high // 8):
        for col in range(wide // 8):
            assert abs(light[8 * row : 8 * row + 8, 8 * col : 8 * col + 8].mean() - thumb[row, col]) < 4


def grey_jpeg(blocks, cols, rows, restart, tables):
    """A plain writer with DC prediction: one bit after the other."""
    codes = {}
    for kind, body in tables.items():
        code, at = 0, 16
        for n in range(1, 17):
            for _ in range(body[n - 1]):
                codes[kind, body[at]] = f"{code:0{n}b}"
                code, at = code + 1, at + 1
            code <<= 1

    def number(v):
        n = abs(v).bit_length()
        return n, f"{v if v > 0 else v + (1 << n) - 1:0{n}b}" if n else ""

    out, bits, last = bytearray(), "", 0

    def flush():
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        for k in range(0, len(bits), 8):
            byte = int(bits[k : k + 8], 2)
            out.append(byte)
            if byte == 0xFF:
                out.append(0)
        bits = ""

    for k, block in enumerate(blocks):
        if restart and k and k % restart == 0:
            flush()
            out.extend([0xFF, 0xD0 + (k // restart - 1) % 8])
            last = 0
        n, tail = number(block[0] - last)
        last = block[0]
        bits += codes[0x00, n] + tail
        run = 0
        top = max([j for j in range(1, 64) if block[j]], default=0)
        for j in range(1, top + 1):
            if not block[j]:
                run += 1
                continue
            while run > 15:
                bits, run = bits + codes[0x10, 0xF0], run - 16
            n, tail = number(block[j])
            bits += codes[0x10, run << 4 | n] + tail
            run = 0
        if top < 63:
            bits += codes[0x10, 0]
    flush()
    head = b"\xff\xd8" + media.segment(0xDB, b"\0" + bytes([16] + [1] * 63)) + media.segment(0xC0, bytes([8, 0, 8 * rows, 0, 8 * cols, 1, 1, 0x11, 0]))
    head += b"\xff" + media.segment(0xC4, b"\x00" + tables[0x00]) + media.segment(0xC4, b"\x10" + tables[0x10])  # a fill byte before a marker
    head += (media.segment(0xDD, restart.to_bytes(2, "big")) if restart else b"") + media.segment(0xDA, b"\1\1\0\0\x3f\0")
    return head + bytes(out) + b"\xff\xd9"


@pytest.mark.parametrize("restart", [0, 1, 3, 12])
def test_prediction_and_any_restart_interval(spark, restart):
    tables = media.markers(foreign(spark, smooth(16, 16, 1, 1)[:, :, 0])[0])[0]["huffman"]
    rng = np.random.default_rng(restart)
    blocks = np.where(rng.random((12, 64)) < 0.2, rng.integers(-900, 900, (12, 64)), 0)
    blocks[3] = 0
    jpeg = grey_jpeg(blocks.tolist(), 4, 3, restart, tables)
    ((info, got),) = media.decode([jpeg])
    assert np.array_equal(got, blocks) and info["dc_scale"] == 16
    both = media.decode([media.encode(PAYLOADS[1]), jpeg])
    assert np.array_equal(both[1][1], blocks)
    with pytest.raises(ValueError):
        media.decode([jpeg[:-40] + b"\xff\xd9"])


def test_query_over_odd_rows(spark):
    texts = [None, "", "é😀", "x" * 64, "y" * 65, "long " * 60_000, "x" * 64]
    docs = spark.createDataFrame([(k, t, "m") for k, t in enumerate(texts)], "doc_id long, text string, media string")
    out = {r.doc_id: r for r in media.media_features(media.as_media(docs)).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        pad = raw + bytes((-len(raw)) % 64 or (64 if not raw else 0))
        r = out[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
        assert r.media_bytes == len(media.encode(pad)) and r.media_sha256 == hashlib.sha256(media.encode(pad)).hexdigest()
    assert out[3].feature == out[6].feature and out[0].feature == out[1].feature
    assert media.media_features(media.as_media(docs.limit(0))).count() == 0
