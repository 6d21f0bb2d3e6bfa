"""Texts kept as baseline JPEG, and a reader that rebuilds luminance thumbnails from the DC coefficients alone.

``encode`` writes one flat 8x8 block for each payload byte: the byte is the block's luminance, so the DC-only (1/8 scale)
thumbnail is the payload itself, without loss. A row of 24 blocks is a restart interval, so rows decode independently.
A payload longer than one picture can hold (65,535 lines) becomes several pictures, one after another.

``thumbnails`` reads any baseline JPEG of 8-bit samples: it parses the markers, Huffman-decodes the scan (AC codes are
read and skipped) and returns the luminance thumbnail; restart intervals of all pictures are decoded in step by numpy.

Null text counts as empty; an empty text is stored as 576 bytes of 255. Repeated rows give repeated results. A very long text
is held whole by one task, with some tens of bytes of memory for each of its own. An empty table gives an empty result; further
columns do not matter, nor does their order.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import single, slices

#: Blocks in a row, bytes that a payload is filled up to, and rows of blocks that one picture holds.
WIDTH, UNIT, MOST_ROWS = 24, 576, 8184

# The DC luminance code lengths and symbols of the JPEG standard, and an AC table with the end-of-block code only.
DC_BITS = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0])
DC_SYMBOLS = bytes(range(12))
AC_BITS = bytes([1] + [0] * 15)
AC_SYMBOLS = bytes([0])


def codes(bits: bytes, symbols: bytes) -> dict[int, tuple[int, int]]:
    """Canonical codes: symbol to (code, length)."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(bits, 1):
        for _ in range(n):
            out[symbols[at]] = (code, length)
            code, at = code + 1, at + 1
        code <<= 1
    return out


def lookup(bits: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each 16-bit look-ahead: the symbol, and the code's length (0: no such code)."""
    symbol, length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for s, (code, n) in codes(bits, symbols).items():
        symbol[code << (16 - n) : (code + 1) << (16 - n)] = s
        length[code << (16 - n) : (code + 1) << (16 - n)] = n
    return symbol, length


def segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def header(rows: int) -> bytes:
    quant = bytes([0, 8]) + bytes([1]) * 63
    frame = bytes([8]) + (rows * 8).to_bytes(2, "big") + (WIDTH * 8).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])
    return b"".join([
        b"\xff\xd8", segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"), segment(0xDB, quant), segment(0xC0, frame),
        segment(0xC4, b"\0" + DC_BITS + DC_SYMBOLS), segment(0xC4, b"\x10" + AC_BITS + AC_SYMBOLS),
        segment(0xDD, WIDTH.to_bytes(2, "big")), segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
    ])


def difference_codes() -> tuple[np.ndarray, np.ndarray]:
    """For each DC difference from -255 to 255: the bits of a whole block (category, value, end of block) and their number."""
    dc, (_, eob) = codes(DC_BITS, DC_SYMBOLS), codes(AC_BITS, AC_SYMBOLS)[0]
    bits, size = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        n = abs(d).bit_length()
        code, length = dc[n]
        bits[d + 255] = (code << n | (d if d > 0 else d + (1 << n) - 1)) << eob
        size[d + 255] = length + n + eob
    return bits, size


def encode(payloads: list[bytes]) -> list[bytes]:
    """A JPEG stream for each payload, whose length is a positive multiple of 576."""
    v = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, WIDTH).astype(np.int64) - 128
    pictures = []  # of each payload: the rows of its pictures
    for p in payloads:
        rows = len(p) // WIDTH
        pictures.append([min(MOST_ROWS, rows - at) for at in range(0, rows, MOST_ROWS)])
    table, sizes = difference_codes()
    step = np.diff(v, axis=1, prepend=0) + 255
    bits, size = table[step], sizes[step]
    end = np.cumsum(size, axis=1)
    row_bytes = (end[:, -1] + 7) >> 3
    first = np.cumsum(row_bytes) - row_bytes
    out = np.zeros(int(row_bytes.sum()) + 3, np.uint8)
    at = first[:, None] * 8 + end - size
    shifted, byte = bits << (24 - size - (at & 7)), at >> 3
    for k in range(WIDTH):  # in one column each row has bytes of its own
        for j in range(3):
            out[byte[:, k] + j] |= ((shifted[:, k] >> (16 - 8 * j)) & 255).astype(np.uint8)
    out = out[:-3]
    out[first + row_bytes - 1] |= ((1 << (row_bytes * 8 - end[:, -1])) - 1).astype(np.uint8)
    ff = out == 255
    grow = np.cumsum(ff)
    row = np.repeat(np.arange(len(v)), row_bytes)
    place = np.arange(len(out)) + grow - ff + 2 * row
    data = np.zeros(len(out) + int(grow[-1]) + 2 * len(v), np.uint8)
    data[place] = out
    last = place[first + row_bytes - 1] + ff[first + row_bytes - 1]
    data[last + 1] = 255
    counts = np.array([r for p in pictures for r in p])
    within = np.arange(len(v)) - np.repeat(np.cumsum(counts) - counts, counts)
    marker = 0xD0 + (within & 7)
    marker[np.cumsum(counts) - 1] = 0xD9
    data[last + 2] = marker
    stop = last + 3
    whole, streams, r = data.tobytes(), [], 0
    for p in pictures:
        parts = []
        for rows in p:
            parts += [header(rows), whole[stop[r - 1] if r else 0 : stop[r + rows - 1]]]
            r += rows
        streams.append(b"".join(parts))
    return streams


class Picture:
    """What the markers of one JPEG say, and where its scan lies."""

    def __init__(self, data: bytes, at: int):
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("not a JPEG stream")
        at, self.interval, self.quant, tables, frame = at + 2, 0, {}, {}, None
        while True:
            if data[at] != 0xFF:
                raise ValueError("marker expected")
            kind = data[at + 1]
            if kind == 0xFF:
                at += 1
                continue
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if kind == 0xDB:
                i = 0
                while i < len(body):
                    wide, name = body[i] >> 4, body[i] & 15
                    self.quant[name] = int.from_bytes(body[i + 1 : i + 2 + wide], "big")
                    i += 1 + 64 * (1 + wide)
            elif kind == 0xC4:
                i = 0
                while i < len(body):
                    n = sum(body[i + 1 : i + 17])
                    tables[body[i]] = (bytes(body[i + 1 : i + 17]), bytes(body[i + 17 : i + 17 + n]))
                    i += 17 + n
            elif kind in (0xC0, 0xC1):
                if body[0] != 8:
                    raise ValueError("only 8-bit samples are supported")
                self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                frame = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            elif 0xC2 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
                raise ValueError("only baseline JPEG is supported")
            elif kind == 0xDD:
                self.interval = int.from_bytes(body, "big")
            elif kind == 0xDA:
                chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
                break
        if len(chosen) != len(frame):
            raise ValueError("only interleaved scans are supported")
        self.high, self.wide = (1, 1) if len(frame) == 1 else (max(c[2] for c in frame), max(c[1] for c in frame))
        #: For each block of an MCU: component, DC table, AC table, and its place if it is luminance.
        self.blocks = []
        for i, (name, h, v, _) in enumerate(frame):
            h, v = (1, 1) if len(frame) == 1 else (h, v)
            self.blocks += [(i, tables[chosen[name] >> 4], tables[0x10 | chosen[name] & 15], (y, x) if i == 0 else None) for y in range(v) for x in range(h)]
        self.luma = (1, 1) if len(frame) == 1 else (frame[0][2], frame[0][1])
        self.step = self.quant[frame[0][3]]
        self.down, self.across = -(-self.height // (8 * self.high)), -(-self.width // (8 * self.wide))
        self.start = at
        self.end = data.index(b"\xff\xd9", at)

    def key(self):
        return tuple(self.blocks), self.interval or self.down * self.across


def unstuffed(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The scans (one after another, scan i up to ends[i]) without stuffed zeros and restart markers, and where each interval starts."""
    ff = np.flatnonzero(data[:-1] == 255)
    after = data[ff + 1]
    marks = ff[(after >= 0xD0) & (after <= 0xD7)]
    keep = np.ones(len(data), bool)
    keep[ff[after == 0] + 1] = False
    keep[marks] = keep[marks + 1] = False
    begins = np.sort(np.concatenate([[0], ends[:-1], marks + 2]))
    return data[keep], (np.cumsum(keep) - keep)[begins]


def decode_scans(pictures: list[Picture], scans: list[bytes]) -> list[np.ndarray]:
    """The luminance thumbnails of pictures with the same tables and restart interval."""
    blocks, interval = pictures[0].key()
    ends = np.cumsum([len(s) for s in scans])
    data, begin = unstuffed(np.frombuffer(b"".join(scans) + b"\xff", np.uint8)[:-1], ends)
    data = np.concatenate([data, np.full(8, 255, np.uint8)]).astype(np.int64)
    mcus = np.array([p.down * p.across for p in pictures])
    lanes = -(-mcus // interval)
    if lanes.sum() != len(begin):
        raise ValueError("a restart marker is missing")
    owner = np.repeat(np.arange(len(pictures)), lanes)
    number = np.arange(len(begin)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    todo = np.minimum(interval, mcus[owner] - number * interval)
    luma = [(k, b[3]) for k, b in enumerate(blocks) if b[3] is not None]
    found = np.zeros((len(begin), interval, len(luma)), np.int64)
    luts = {t: lookup(*t) for b in blocks for t in b[1:3]}
    position, predicted = begin * 8, np.zeros((len(begin), 1 + max(b[0] for b in blocks)), np.int64)

    def peek(at: np.ndarray) -> np.ndarray:
        """32 bits from bit ``at`` on, the last 7 of which may be missing."""
        i = at >> 3
        word = data[i] << 24 | data[i + 1] << 16 | data[i + 2] << 8 | data[i + 3]
        return word << (at & 7) & 0xFFFFFFFF

    for m in range(interval):
        on = np.flatnonzero(todo > m) if todo.min() <= m else slice(None)
        at = position[on]
        slot = 0
        for component, dc, ac, place in blocks:
            word = peek(at)
            symbol, length = luts[dc][0][word >> 16], luts[dc][1][word >> 16]
            value = (word << length & 0xFFFFFFFF) >> (32 - symbol)
            value = np.where(symbol > 0, np.where(value >> np.maximum(symbol - 1, 0), value, value - (1 << symbol) + 1), 0)
            predicted[on, component] += value
            at = at + length + symbol
            left, live = np.full(len(at), 63), np.arange(len(at))
            while len(live):
                word = peek(at[live]) >> 16
                symbol, length = luts[ac][0][word], luts[ac][1][word]
                at[live] += length + (symbol & 15)
                left[live] -= (symbol >> 4) + 1
                live = live[(symbol != 0) & (left[live] > 0)]
            if place is not None:
                found[on, m, slot] = predicted[on, component]
                slot += 1
        position[on] = at
    out, lane = [], 0
    for p, n, m in zip(pictures, lanes, mcus, strict=True):
        dc = found[lane : lane + n].reshape(-1, len(luma))[:m]
        lane += n
        v, h = p.luma
        grid = dc.reshape(p.down, p.across, v, h).transpose(0, 2, 1, 3).reshape(p.down * v, p.across * h)
        grid = grid[: -(-p.height * v // (8 * p.high)), : -(-p.width * h // (8 * p.wide))]
        out.append(np.clip((grid * p.step + 4) // 8 + 128, 0, 255).astype(np.uint8))
    return out


def thumbnails(streams: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """For each stream, its pictures: width, height, DC-only luminance thumbnail."""
    groups = defaultdict(list)
    for i, data in enumerate(streams):
        at = 0
        while at < len(data):
            p = Picture(data, at)
            groups[p.key()].append((i, p, data[p.start : p.end]))
            at = p.end + 2
    out: list[list] = [[] for _ in streams]
    for members in groups.values():
        for (i, p, _), t in zip(members, decode_scans([p for _, p, _ in members], [s for _, _, s in members]), strict=True):
            out[i].append((p.start, p.width, p.height, t))
    return [[x[1:] for x in sorted(pictures, key=lambda x: x[0])] for pictures in out]


def cells(thumb: np.ndarray, down: int, across: int) -> np.ndarray:
    """Means over a grid; cells of a thumbnail smaller than the grid repeat its pixels."""
    y = np.minimum(np.arange(down + 1) * thumb.shape[0] // down, thumb.shape[0])
    x = np.minimum(np.arange(across + 1) * thumb.shape[1] // across, thumb.shape[1])
    total = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1))
    total[1:, 1:] = thumb.cumsum(0, dtype=np.float64).cumsum(1)
    y0, y1, x0, x1 = np.minimum(y[:-1], thumb.shape[0] - 1), None, np.minimum(x[:-1], thumb.shape[1] - 1), None
    y1, x1 = np.maximum(y[1:], y0 + 1), np.maximum(x[1:], x0 + 1)
    area = (y1 - y0)[:, None] * (x1 - x0)[None, :]
    return (total[y1][:, x1] - total[y0][:, x1] - total[y1][:, x0] + total[y0][:, x0]) / area


def hashes(thumb: np.ndarray) -> tuple[str, str]:
    """Average hash (cells brighter than the mean) and difference hash (cells brighter than their left neighbour), 64 bits each."""
    small, steps = cells(thumb, 8, 8), cells(thumb, 8, 9)
    return np.packbits(small > small.mean()).tobytes().hex(), np.packbits(steps[:, 1:] > steps[:, :-1]).tobytes().hex()


def filled(text: bytes) -> bytes:
    size = max(UNIT, -(-len(text) // UNIT) * UNIT)
    return text + b"\xff" * (size - len(text))


def media_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: the JPEG stream, and what reading that stream back gives: dimensions, thumbnail bytes and hashes.

    Returns (id_col, n_bytes, media, n_pictures, width, height, thumbnail, average_hash, difference_hash); the last two
    are of the stream's pictures one below the other. A narrow map, without a shuffle.
    """
    source = docs.select(docs[id_col], F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("_text"))
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, media binary, n_pictures int, width int, height int, thumbnail binary, average_hash string, difference_hash string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                texts = [x.as_buffer().to_pybytes() for x in single(part.column(1)).cast(pa.binary())]
                streams = encode([filled(t) for t in texts])
                read = thumbnails(streams)
                thumbs = [np.concatenate([t for _, _, t in p]) for p in read]
                found = [hashes(t) for t in thumbs]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(streams, pa.binary()), pa.array([len(p) for p in read], pa.int32()),
                    pa.array([p[0][0] for p in read], pa.int32()), pa.array([sum(x[1] for x in p) for p in read], pa.int32()), pa.array([t.tobytes() for t in thumbs], pa.binary()),
                    pa.array([a for a, _ in found]), pa.array([d for _, d in found]),
                ], [id_col, "n_bytes", "media", "n_pictures", "width", "height", "thumbnail", "average_hash", "difference_hash"])

    return source.mapInArrow(run, schema)
