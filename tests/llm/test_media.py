import math
import struct

import numpy as np
import pytest

from factloom.llm import media as M

SCHEMA = "doc_id long, media binary, status string"
HUFF = {0: (M.DC_BITS, M.DC_VALUES), 16: (M.AC_BITS, M.AC_VALUES)}


def colour_jpeg(terms, h, v, width, height, restart=0, interleaved=True):
    """A JPEG of three components from quantised blocks: terms[c][y][x] is 64 numbers in zigzag order."""
    bits = []
    pred = [0, 0, 0]

    def put(code, size):
        bits.extend((int(code) >> (size - 1 - i)) & 1 for i in range(int(size)))

    def number(value):
        n = int(value).bit_length() if value >= 0 else int(-value).bit_length()
        return n, value if value >= 0 else value + (1 << n) - 1

    dc, ac = M.codes(*HUFF[0]), M.codes(*HUFF[16])

    def block(c, t):
        n, e = number(int(t[0]) - pred[c])
        pred[c] = int(t[0])
        put(dc[0][n], dc[1][n])
        put(e, n)
        run = 0
        last = max((i for i in range(1, 64) if t[i]), default=0)
        for i in range(1, last + 1):
            if not t[i]:
                run += 1
                continue
            while run > 15:
                put(ac[0][0xF0], ac[1][0xF0])
                run -= 16
            n, e = number(int(t[i]))
            put(ac[0][run << 4 | n], ac[1][run << 4 | n])
            put(e, n)
            run = 0
        if last < 63:
            put(ac[0][0], ac[1][0])

    def flush():
        while len(bits) % 8:
            bits.append(1)
        raw = bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
        bits.clear()
        pred[:] = [0, 0, 0]
        return raw

    mx, my = math.ceil(width / 8 / h), math.ceil(height / 8 / v)
    out = b"\xff\xd8" + M.segment(0xE0, b"JFIF\0") + M.segment(0xDB, b"\0" + bytes([10] * 64)) + M.segment(0xC4, b"\0" + M.DC_BITS + M.DC_VALUES) + M.segment(0xC4, b"\x10" + M.AC_BITS + M.AC_VALUES)
    out += M.segment(0xC0, struct.pack(">BHHB", 8, height, width, 3) + bytes([1, h << 4 | v, 0, 2, 0x11, 0, 3, 0x11, 0]))
    if restart:
        out += M.segment(0xDD, struct.pack(">H", restart))
    if interleaved:
        out += M.segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
        for m in range(mx * my):
            if restart and m and m % restart == 0:
                out += flush() + bytes([255, 0xD0 + (m // restart - 1) % 8])
            y, x = divmod(m, mx)
            for c in range(3):
                for j in range(v if c == 0 else 1):
                    for i in range(h if c == 0 else 1):
                        block(c, terms[c][y * (v if c == 0 else 1) + j][x * (h if c == 0 else 1) + i])
        return out + flush() + b"\xff\xd9"
    for c in (1, 0, 2):
        out += M.segment(0xDA, bytes([1, c + 1, 0, 0, 63, 0]))
        w, d = (math.ceil(width / 8), math.ceil(height / 8)) if c == 0 else (mx, my)
        for y in range(d):
            for x in range(w):
                block(c, terms[c][y][x])
        out += flush()
    return out + b"\xff\xd9"


@pytest.mark.parametrize("h,v,restart,interleaved", [(1, 1, 0, True), (2, 2, 0, True), (2, 1, 2, True), (2, 2, 0, False), (1, 2, 1, True)])
def test_colour_images(h, v, restart, interleaved):
    rng = np.random.default_rng(h * 8 + v + restart)
    width, height = 53, 37
    mx, my = math.ceil(width / 8 / h), math.ceil(height / 8 / v)
    terms = []
    for c in range(3):
        t = np.where(rng.random((my * (v if c == 0 else 1), mx * (h if c == 0 else 1), 64)) < 0.1, rng.integers(-40, 40, (my * (v if c == 0 else 1), mx * (h if c == 0 else 1), 64)), 0)
        t[..., 0] = rng.integers(-100, 100, t.shape[:2])
        t[0, 0, 63] = 5  # a block without end mark
        terms.append(t)
    image = M.parse(colour_jpeg(terms, h, v, width, height, restart, interleaved))
    assert image.status == "ok"
    M.decode([image])
    want = np.clip(np.rint(terms[0][: math.ceil(height / 8), : math.ceil(width / 8), 0] * 10 / 8 + 128), 0, 255)
    assert (image.thumb == want).all()


def test_pictures_of_texts():
    texts = [b"a", b"x" * 64, bytes(range(256)) * 40, b"\xff" * 5000, bytes(np.random.default_rng(1).integers(0, 256, 70_000, dtype=np.uint8))]
    offs = np.cumsum([0, *map(len, texts)])
    made = M.draw(np.frombuffer(b"".join(texts), np.uint8), offs)
    images = [M.parse(x) for x in made]
    M.decode(images)
    for text, image in zip(texts, images):
        n = -(-len(text) // 64)
        w = math.ceil(math.sqrt(n))
        px = np.full(w * -(-n // w) * 64, 128.0)
        px[: len(text)] = np.frombuffer(text, np.uint8)
        dc = np.rint((px.reshape(-1, 64) - 128).sum(1) / 64)
        assert image.status == "ok"
        assert np.abs(image.thumb.reshape(-1) - np.clip(dc + 128, 0, 255)).max() <= 1


def test_hostile_files(spark):
    good = M.draw(np.frombuffer(b"hello world" * 30, np.uint8), np.array([0, 330]))[0]
    frame = good.index(b"\xff\xc0")
    huge = good[: frame + 5] + struct.pack(">HH", 65500, 65500) + good[frame + 9 :]
    huge = huge.replace(M.segment(0xDD, struct.pack(">H", M.INTERVAL)), b"")
    parts = bytes(x for c in range(5) for x in (c + 1, 0x11, 0))
    tail = good[frame + 2 + struct.unpack_from(">H", good, frame + 2)[0] :]
    five = good[:frame] + M.segment(0xC0, struct.pack(">BHHB", 8, 16, 16, 5) + parts) + tail
    twice = good[:frame] + M.segment(0xC0, struct.pack(">BHHB", 8, 16, 16, 2) + bytes([1, 0x11, 0, 1, 0x11, 0])) + tail
    terms = [np.zeros((2, 2, 64), int)] * 3
    colour = colour_jpeg(terms, 1, 1, 16, 16)
    rgb = colour[:2] + M.segment(0xEE, b"Adobe" + bytes(6) + b"\0") + colour[2:]
    ycc = colour[:2] + M.segment(0xEE, b"Adobe" + bytes(6) + b"\1") + colour[2:]
    extended = good[:frame] + b"\xff\xc1" + good[frame + 2 :]
    want = [(huge, "corrupt"), (five, "unsupported"), (twice, "corrupt"), (rgb, "unsupported"), (ycc, "ok"), (extended, "unsupported"), (good, "ok")]
    for data, status in want:
        image = M.parse(data)
        M.decode([image])
        assert image.status == status
    rows = M.describe(spark.createDataFrame([(i, bytearray(d)) for i, (d, _) in enumerate(want * 30)], "doc_id long, media binary")).collect()
    assert {(r.doc_id % len(want), r.status) for r in rows} == {(i, s) for i, (_, s) in enumerate(want)}
    for cut in range(0, len(colour), 3):  # whatever is damaged, nothing is raised
        for data in (colour[:cut], colour[:cut] + bytes([colour[cut] ^ 255]) + colour[cut + 1 :]):
            image = M.parse(data)
            M.decode([image])


def test_near_copies_share_bits():
    x = np.random.default_rng(3).integers(0, 256, (40, 60)).astype(np.uint8)
    y = np.clip(x.astype(int) + 2, 0, 255).astype(np.uint8)
    assert bin((M.area_hash(x) ^ M.area_hash(y)) & (2**64 - 1)).count("1") <= 4
    assert isinstance(M.area_hash(x[:1, :1]), int)


def test_defined_results(spark):
    good = M.draw(np.frombuffer(b"hello world" * 30, np.uint8), np.array([0, 330]))[0]
    frame = good.index(b"\xff\xc0")
    progressive = good[: frame + 1] + b"\xc2" + good[frame + 2 :]
    wrong_table = good.replace(M.segment(0xC4, b"\0" + M.DC_BITS + M.DC_VALUES + b"\x10" + M.AC_BITS + M.AC_VALUES), M.segment(0xC4, b"\0" + bytes([1] + [0] * 15) + b"\0"))
    cases = [(1, good, "ok"), (1, good, "ok"), (2, None, "null"), (3, b"", "not_jpeg"), (4, b"GIF89a", "not_jpeg"), (5, good[:-40], "corrupt"), (6, progressive, "unsupported"), (7, b"\xff\xd8", "corrupt"), (8, wrong_table, "corrupt"), (None, good, "ok")]
    rows = M.describe(spark.createDataFrame([(a, bytearray(b) if b is not None else None, c) for a, b, c in cases], SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.status) for r in rows) == sorted((str(a), c) for a, _, c in cases)
    ok = [r for r in rows if r.status == "ok"]
    assert len({(r.width, r.height, r.thumb_hash, r.thumb_digest) for r in ok}) == 1
    assert all((r.thumb_hash is None) == (r.status != "ok") for r in rows)
    assert next(r for r in rows if r.status == "unsupported").width == ok[0].width
    assert M.describe(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_of_texts(spark):
    docs = spark.createDataFrame([(1, "abc", 5), (1, "abc", 5), (2, None, 1), (3, "", 1), (4, "é" * 300_000, 2)], "doc_id long, text string, status int")
    rows = M.describe(M.render(docs)).collect()
    assert sorted((r.doc_id, r.status) for r in rows) == [(1, "ok"), (1, "ok"), (2, "null"), (3, "null"), (4, "ok")]
    assert max(r.thumb_width * r.thumb_height for r in rows if r.status == "ok") >= 600_000 // 64
