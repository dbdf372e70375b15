"""Media columns: baseline JPEG to dimensions and thumbnail hashes.

A media value is parsed marker by marker (frame, quantisation and Huffman tables, restart interval, scans); progressive
and arithmetic frames are named and not decoded. Of a baseline image only the luminance DC terms are rebuilt: one pixel
for each 8 x 8 block, so the inverse transform is a division. Every AC term must still be read to find the next block.
Huffman decoding is sequential within a restart interval and independent between intervals and images, so all
intervals of a batch are decoded in lockstep by NumPy, one symbol of each at a time, through 16-bit lookup tables. The
thumbnail gives two hashes: ``thumb_hash``, one bit for each of 8 x 8 areas brighter than their mean, which near
copies share, and ``thumb_digest``, equal for equal thumbnails only.

The tables at hand have no images, so :func:`render` draws one for each text: every 64 bytes are an 8 x 8 block of grey,
blocks run in rows of a square, and the picture is written as a baseline JPEG with restart markers.

Defined results (``status``): ``null`` for a null value; ``not_jpeg`` without a start marker (an empty value too);
``unsupported`` for another kind of frame than 8-bit baseline (SOF0), of more than three components, or of red, green and
blue instead of luminance first, which keeps its dimensions; ``corrupt`` for what is truncated, breaks the syntax or the
codes, or has fewer bits than the blocks that its header claims, with dimensions if they were read; else ``ok``. Hashes are
null unless ``ok``; of thumbnails with equal areas no bit is set. Memory follows a file's bytes, whatever it claims to be;
a very long text is one picture, drawn and read by itself. Repeated rows, and rows of a null or repeated id, are decoded
each; an empty table gives an empty result; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.blocks import blocks, text_buffer

U64 = np.uint64
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
DC_BITS, DC_VALUES = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1] + [0] * 7), bytes(range(12))
AC_BITS = bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125])
AC_VALUES = bytes.fromhex("01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a") + bytes(
    16 * hi + lo for hi, first, last in [(1, 6, 10), (2, 5, 10), (3, 4, 10), *((h, 3, 10) for h in range(4, 9)), *((h, 2, 10) for h in range(9, 14)), (14, 1, 10), (15, 1, 10)] for lo in range(first, last + 1)
)
DC_STEP, AC_STEP, INTERVAL = 8, 160, 64
TABLES_AT_ONCE = 64  # lookup tables, of 256 KB each, in one lockstep group


# writing


def codes(bits: bytes, values: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Canonical code and its length for every symbol (length 0: none)."""
    code, at = 0, 0
    out, size = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    for length, n in enumerate(bits, 1):
        for v in values[at : at + n]:
            out[v], size[v] = code, length
            code += 1
        at += n
        code <<= 1
    return out, size


@functools.cache
def transform() -> np.ndarray:
    """64 pixels to 64 quantised terms in zigzag order, as one matrix."""
    c = np.array([[np.sqrt((1 + (u > 0)) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
    k = np.einsum("uy,vx->yxuv", c, c).reshape(64, 64)[:, ZIGZAG]
    k[:, 0] /= DC_STEP
    k[:, 1:] /= AC_STEP
    return k.astype(np.float32)


def magnitude(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Category of a term and its extra bits."""
    size = np.ceil(np.log2(np.abs(v) + 1)).astype(np.int64)
    return size, np.where(v >= 0, v, v + (1 << size) - 1).astype(np.uint64)


def segment(marker: int, data: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(data) + 2) + data


@functools.cache
def tables() -> bytes:
    return (
        segment(0xDB, b"\0" + bytes([DC_STEP] + [AC_STEP] * 63))
        + segment(0xC4, b"\0" + DC_BITS + DC_VALUES + b"\x10" + AC_BITS + AC_VALUES)
        + segment(0xDD, struct.pack(">H", INTERVAL))
    )


def encode_blocks(pixels: np.ndarray, count: np.ndarray) -> list[bytes]:
    """Entropy-coded data, restart markers included, of images of ``count`` blocks each (rows of 64 grey levels)."""
    coef = np.rint((pixels.astype(np.float32) - 128) @ transform()).astype(np.int64)
    n = len(coef)
    image = np.repeat(np.arange(len(count)), count)
    start = np.cumsum(count) - count
    first = (np.arange(n) - start[image]) % INTERVAL == 0
    interval = np.cumsum(first) - 1
    diff = coef[:, 0].copy()
    diff[1:] -= np.where(first[1:], 0, coef[:-1, 0])
    row, col = np.nonzero(coef[:, 1:])
    value, k = coef[row, col + 1], col + 1
    before = np.zeros(len(k), np.int64)
    same = row[1:] == row[:-1]
    before[1:] = np.where(same, k[:-1], 0)
    run = k - before - 1
    skips = run >> 4
    last = np.zeros(n, np.int64)
    last[row] = k  # of a row the last written wins: the greatest
    end = (last < 63).astype(np.int64)
    per = 1 + np.bincount(row, 1 + skips, n).astype(np.int64) + end
    at = np.cumsum(per) - per
    done = np.cumsum(1 + skips)
    ac = at[row] + done - (done - 1 - skips)[np.searchsorted(row, row)] if len(row) else np.zeros(0, np.int64)
    code, size = np.zeros(int(per.sum()), np.uint64), np.zeros(int(per.sum()), np.int64)
    dc_code, dc_size = codes(DC_BITS, DC_VALUES)
    ac_code, ac_size = codes(AC_BITS, AC_VALUES)
    cat, extra = magnitude(diff)
    code[at], size[at] = dc_code[cat] << cat.astype(np.uint64) | extra, dc_size[cat] + cat
    cat, extra = magnitude(value)
    symbol = (run & 15) << 4 | cat
    code[ac], size[ac] = ac_code[symbol] << cat.astype(np.uint64) | extra, ac_size[symbol] + cat
    if skips.any():
        zrl = np.repeat(ac - skips, skips) + np.arange(skips.sum()) - np.repeat(np.cumsum(skips) - skips, skips)
        code[zrl], size[zrl] = ac_code[0xF0], ac_size[0xF0]
    eob = (at + per - 1)[end == 1]
    code[eob], size[eob] = ac_code[0], ac_size[0]
    owner = np.repeat(interval, per)
    bits = np.bincount(owner, size).astype(np.int64)
    width = -(-bits // 8)
    base = np.cumsum(width) - width
    ends = np.cumsum(size)
    pos = ends - size - (np.cumsum(bits) - bits)[owner] + base[owner] * 8
    pad = width * 8 - bits
    code, size, pos = np.concatenate([code, (U64(1) << pad.astype(np.uint64)) - U64(1)]), np.concatenate([size, pad]), np.concatenate([pos, base * 8 + bits])
    code, size, pos = code[size > 0], size[size > 0], pos[size > 0]
    word = code << (64 - size - (pos & 7)).astype(np.uint64)
    total = int(width.sum())
    out = np.zeros(total + 8)
    for b in range(5):
        out += np.bincount((pos >> 3) + b, ((word >> U64(56 - 8 * b)) & U64(255)).astype(np.float64), total + 8)
    data = out[:total].astype(np.uint8)
    # a zero follows each 255; a restart marker each interval but an image's last
    heads = np.flatnonzero(first)
    of = image[heads]
    number = (heads - start[of]) // INTERVAL
    marked = np.append(of[1:] == of[:-1], False)
    tail = np.zeros(total, np.int64)
    tail[(base + width - 1)[marked]] = 2
    stuffed = (data == 255).astype(np.int64)
    slots = 1 + stuffed + tail
    place = np.cumsum(slots) - slots
    wide = np.zeros(int(slots.sum()), np.uint8)
    wide[place] = data
    m = (base + width - 1)[marked]
    wide[place[m] + 1 + stuffed[m]] = 255
    wide[place[m] + 2 + stuffed[m]] = 0xD0 + number[marked] % 8
    raw = wide.tobytes()
    starts = np.append(place[base[np.searchsorted(of, np.arange(len(count)))]], len(raw))
    return [raw[x:y] for x, y in zip(starts[:-1], starts[1:])]


def draw(raw: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
    """A grey picture of each row's bytes; None for an empty row."""
    size = np.diff(offsets)
    need = -(-size // 64)
    across = np.ceil(np.sqrt(need)).astype(np.int64)
    down = -(-need // np.maximum(across, 1))
    some = np.flatnonzero(size > 0)
    out: list[bytes | None] = [None] * len(size)
    if not len(some):
        return out
    count = (across * down)[some]
    start = np.cumsum(count) - count
    pixels = np.full(int(count.sum()) * 64, 128, np.uint8)
    own = np.repeat(np.arange(len(some)), size[some])
    pixels[np.arange(len(raw)) - offsets[some][own] + start[own] * 64] = raw
    for i, data in zip(some, encode_blocks(pixels.reshape(-1, 64), count)):
        frame = segment(0xC0, struct.pack(">BHHB3B", 8, 8 * int(down[i]), 8 * int(across[i]), 1, 1, 0x11, 0))
        out[i] = b"\xff\xd8" + tables() + frame + segment(0xDA, bytes([1, 1, 0, 0, 63, 0])) + data + b"\xff\xd9"
    return out


def render(docs: DataFrame) -> DataFrame:
    """``doc_id, media``: a picture of each text; null where the text is null or empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = text_buffer(batch.column(1))
            for a, b in blocks(offs):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(draw(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a]), pa.binary())], ["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, media binary")


# reading


class Image:
    """What the markers of one file say; ``intervals`` are its luminance scan's pieces, without stuffing."""

    __slots__ = ("status", "width", "height", "parts", "step", "restart", "scan", "intervals", "grid", "first", "thumb")

    def __init__(self, status: str) -> None:
        self.status, self.width, self.height, self.parts, self.restart, self.scan, self.thumb = status, None, None, [], 0, None, None


def parse(data: bytes | None) -> Image:
    if data is None:
        return Image("null")
    if data[:2] != b"\xff\xd8":
        return Image("not_jpeg")
    image = Image("corrupt")
    try:
        _markers(data, image)
    except (IndexError, struct.error, KeyError, ValueError):
        pass
    return image


def _markers(data: bytes, image: Image) -> None:
    at, quant, huff, colours = 2, {}, {}, None
    while True:
        if data[at] != 0xFF:
            raise ValueError("no marker")
        while data[at] == 0xFF:
            at += 1
        marker = data[at]
        at += 1
        if marker == 0xD9:
            return
        if marker == 0x01 or 0xD0 <= marker <= 0xD7:
            continue
        length = struct.unpack_from(">H", data, at)[0]
        body = data[at + 2 : at + length]
        if len(body) != length - 2:
            raise ValueError("truncated")
        at += length
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                values = struct.unpack_from(">64H" if wide else "64B", body, k + 1)
                quant[body[k] & 15] = values[0]
                k += 129 if wide else 65
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                n = sum(body[k + 1 : k + 17])
                if k + 17 + n > len(body):
                    raise ValueError("truncated")
                huff[body[k]] = (body[k + 1 : k + 17], body[k + 17 : k + 17 + n])
                k += 17 + n
        elif marker == 0xDD:
            image.restart = struct.unpack(">H", body)[0]
        elif marker == 0xEE and body[:5] == b"Adobe" and len(body) > 11:
            colours = body[11]
        elif 0xC0 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            depth, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            image.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            names = bytes(p[0] for p in image.parts)
            if marker != 0xC0 or depth != 8 or n > 3 or n == 3 and (colours == 0 or names == b"RGB"):
                image.status = "unsupported"
                return
            if not n or len(set(names)) < n or not image.width or not image.height or any(not 1 <= x <= 4 for p in image.parts for x in p[1:3]):
                raise ValueError("bad frame")
        elif marker == 0xDA:
            if not image.parts:
                raise ValueError("scan before frame")
            of = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            if not 1 <= body[0] <= 4 or len(of) != body[0] or of.keys() - {p[0] for p in image.parts}:
                raise ValueError("bad scan")
            pieces, at = _intervals(data, at)
            if image.parts[0][0] in of:
                _scan(image, of, quant, huff, pieces)
                return


def _intervals(data: bytes, at: int) -> tuple[list[bytes], int]:
    """Entropy-coded pieces from ``at`` on, and where the next marker stands."""
    pieces, begin, look = [], at, at
    while True:
        look = data.find(b"\xff", look)
        if look < 0 or look + 1 >= len(data):
            raise ValueError("no end of scan")
        code = data[look + 1]
        if code == 0:
            look += 2
        elif code == 0xFF:
            look += 1
        else:
            pieces.append(data[begin:look].replace(b"\xff\x00", b"\xff"))
            if not 0xD0 <= code <= 0xD7:
                return pieces, look
            begin = look = look + 2


def _scan(image: Image, of: dict[int, int], quant: dict, huff: dict, pieces: list[bytes]) -> None:
    name, h0, v0, q0 = image.parts[0]
    hmax, vmax = max(p[1] for p in image.parts), max(p[2] for p in image.parts)
    across, down = -(-image.width * h0 // (hmax * 8)), -(-image.height * v0 // (vmax * 8))
    image.step = quant[q0]
    if len(of) == 1:
        seq, mx, my, h, v = [(0, of[name])], across, down, 1, 1
    else:
        seq = [(c, of[p[0]]) for c, p in enumerate(image.parts) if p[0] in of for _ in range(p[1] * p[2])]
        mx, my, h, v = -(-image.width // (8 * hmax)), -(-image.height // (8 * vmax)), h0, v0
    if len(of) > 1 and len(seq) > 10:
        raise ValueError("too many blocks in a unit")
    image.scan = [(c, huff[t >> 4], huff[16 | t & 15]) for c, t in seq]
    image.grid = (mx, my, h, v, across, down)
    units = mx * my
    each = image.restart or units
    want = -(-units // each)
    if len(pieces) != want:
        raise ValueError("restart intervals missing")
    image.intervals = [(p, min(each, units - i * each) * len(seq)) for i, p in enumerate(pieces)]
    # a block has two codes of a bit at least; so what is made room for follows the bytes, not what the header claims
    if any(8 * len(p) < 2 * n for p, n in image.intervals):
        raise ValueError("fewer bits than blocks")
    image.status = "ok"


@functools.lru_cache(TABLES_AT_ONCE)
def lookup(bits: bytes, values: bytes) -> np.ndarray:
    """For every 16 bits: code length << 8 | symbol; 0 where no code begins so."""
    out, code, at = np.zeros(1 << 16, np.int32), 0, 0
    for length, n in enumerate(bits, 1):
        for v in values[at : at + n]:
            lo = code << (16 - length)
            if lo >= 1 << 16:
                return out
            out[lo : lo + (1 << (16 - length))] = length << 8 | v
            code += 1
        at += n
        code <<= 1
    return out


def decode_group(images: list[Image]) -> None:
    """Luminance DC terms of images in lockstep over all restart intervals; sets ``thumb`` or the status."""
    index: dict[tuple, int] = {}
    seqs: dict[tuple, int] = {}
    comp, dc, ac, start, size, lum = [], [], [], [], [], 0
    lanes, data, at = [], [], 0
    for i, image in enumerate(images):
        key = tuple(image.scan)
        if key not in seqs:
            seqs[key] = len(seqs)
            start.append(len(comp)), size.append(len(key))
            for c, d, a in key:
                comp.append(c), dc.append(index.setdefault(d, len(index))), ac.append(index.setdefault(a, len(index)))
        image.first = lum
        per = sum(c == 0 for c, _, _ in key)
        for piece, n in image.intervals:
            lanes.append((i, at * 8, (at + len(piece)) * 8, n, seqs[key], lum))
            data.append(piece)
            at += len(piece)
            lum += n // len(key) * per
    buffer = np.frombuffer(b"".join(data) + b"\xff" * 16, np.uint8)
    words = np.zeros(len(buffer) - 7, np.uint64)
    for b in range(8):
        words = words << U64(8) | buffer[b : len(buffer) - 7 + b]
    luts = np.concatenate([lookup(*t) for t in index])
    comp, dc, ac, start, size = (np.array(x, np.int64) for x in (comp, dc, ac, start, size))
    who, pos, stop, left, seq, out = (np.array(x, np.int64) for x in zip(*lanes))
    k, turn = np.zeros(len(who), np.int64), np.zeros(len(who), np.int64)
    pred = np.zeros((len(who), 4), np.int64)
    lane = np.arange(len(who))
    found = np.zeros(lum, np.int64)
    bad = np.zeros(len(images), bool)
    while len(who):
        unit = start[seq] + turn
        is_dc = k == 0
        w = words[pos >> 3] << (pos & 7).astype(np.uint64)
        entry = luts[(np.where(is_dc, dc[unit], ac[unit]) << 16) + (w >> U64(48)).astype(np.int64)]
        length, symbol = entry >> 8, entry & 255
        s = np.where(is_dc, symbol, symbol & 15).astype(np.int64)
        wrong = (length == 0) | (s > 15)
        s = np.minimum(s, 15)
        extra = ((w << length.astype(np.uint64)) >> U64(1) >> (63 - s).astype(np.uint64)).astype(np.int64)
        pos += length + s
        at = np.flatnonzero(is_dc)
        value = np.where(extra[at] < (1 << s[at]) >> 1, extra[at] - (1 << s[at]) + 1, extra[at])
        c = comp[unit[at]]
        pred[lane[at], c] += value
        light = at[c == 0]
        found[out[light]] = pred[lane[light], 0]
        out[light] += 1
        k = np.where(is_dc, 1, np.where(s > 0, k + (symbol >> 4) + 1, np.where(symbol == 0xF0, k + 16, 64)))
        wrong |= (pos > stop) | (k > 64)
        over = k >= 64
        k[over] = 0
        left = left - over
        turn = np.where(over, np.where(turn + 1 == size[seq], 0, turn + 1), turn)
        if wrong.any():
            bad[who[wrong]] = True
        gone = wrong | (left == 0)
        if gone.any():
            stay = ~gone
            who, pos, stop, left, seq, out, k, turn, lane = (x[stay] for x in (who, pos, stop, left, seq, out, k, turn, lane))
    for i, image in enumerate(images):
        if bad[i]:
            image.status = "corrupt"
            continue
        mx, my, h, v, across, down = image.grid
        terms = found[image.first : image.first + mx * my * h * v].reshape(my, mx, v, h).transpose(0, 2, 1, 3).reshape(my * v, mx * h)
        image.thumb = np.clip(np.rint(terms[:down, :across] * image.step / 8 + 128), 0, 255).astype(np.uint8)


def decode(images: list[Image]) -> None:
    """All ``ok`` images, in groups of few lookup tables."""
    group: list[Image] = []
    names: set = set()
    for image in images:
        if image.status != "ok":
            continue
        own = {t for _, d, a in image.scan for t in (d, a)}
        if group and len(names | own) > TABLES_AT_ONCE:
            decode_group(group)
            group, names = [], set()
        group.append(image)
        names |= own
    if group:
        decode_group(group)


def area_hash(thumb: np.ndarray) -> int:
    """64 bits, signed: whether each of 8 x 8 areas is brighter than the mean of all."""
    h, w = thumb.shape
    sums = np.zeros((h + 1, w + 1), np.int64)
    sums[1:, 1:] = thumb.cumsum(0, dtype=np.int64).cumsum(1)
    y0, x0 = np.arange(8) * h // 8, np.arange(8) * w // 8
    y1, x1 = np.maximum(y0 + 1, -(-np.arange(1, 9) * h // 8)), np.maximum(x0 + 1, -(-np.arange(1, 9) * w // 8))
    total = sums[y1][:, x1] - sums[y0][:, x1] - sums[y1][:, x0] + sums[y0][:, x0]
    mean = total / ((y1 - y0)[:, None] * (x1 - x0))
    return int(np.packbits(mean > mean.mean()).view(">i8")[0])


RESULT = pa.schema(
    [("doc_id", pa.int64()), ("status", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("components", pa.int32()), ("thumb_width", pa.int32()), ("thumb_height", pa.int32()), ("thumb_hash", pa.int64()), ("thumb_digest", pa.string())]
)


def image_row(image: Image) -> tuple:
    t = image.thumb if image.status == "ok" else None
    known = image.width is not None
    size = (image.width, image.height, len(image.parts)) if known else (None,) * 3
    if t is None:
        return (image.status, *size, None, None, None, None)
    return (image.status, *size, t.shape[1], t.shape[0], area_hash(t), hashlib.blake2b(struct.pack("<HH", *t.shape) + t.tobytes(), digest_size=16).hexdigest())


def describe(table: DataFrame) -> DataFrame:
    """``doc_id, status, width, height, components, thumb_width, thumb_height, thumb_hash, thumb_digest`` of a
    ``media`` column: one row for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = pa.array([0 if x is None else x for x in pa.compute.binary_length(batch.column(1)).to_pylist()], pa.int64()).to_numpy()
            offs = np.concatenate([[0], np.cumsum(held)])
            for a, b in blocks(offs):
                images = [parse(x) for x in batch.column(1).slice(a, b - a).to_pylist()]
                decode(images)
                columns = zip(*map(image_row, images))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(c, f.type) for c, f in zip(columns, list(RESULT)[1:]))], schema=RESULT)

    return table.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("media").cast("binary").alias("media")).mapInArrow(
        run, "doc_id long, status string, width int, height int, components int, thumb_width int, thumb_height int, thumb_hash long, thumb_digest string"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe(render(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
