"""Baseline JPEG in numpy: whole files, or shared tables with stripped bodies as TIFF keeps them.

Colour is stored as luminance and two colour differences without subsampling, or one grey component.
All blocks of an image are transformed at once; entropy coding puts the codes of all symbols into one
bit array. Codes are made by a rule from how likely a run of zeros and a size are, so that every
image shares one table. The reader takes any baseline file with sampling factors of 1 or 2; other
kinds (progressive, lossless, arithmetic) are an error.
"""

from __future__ import annotations

import heapq
import struct
from functools import lru_cache

import numpy as np

#: Quantisation steps at quality 50 in rows of eight, for luminance and for colour. Fixed values.
LUMINANCE = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
COLOUR_CORNER, COLOUR_REST = ((17, 18, 24, 47), (18, 21, 26, 66), (24, 26, 56, 99), (47, 66, 99, 99)), 99


class JpegError(ValueError):
    """A payload that isn't a baseline JPEG file this codec reads."""


@lru_cache(maxsize=1)
def zigzag() -> np.ndarray:
    """Place in a block (row by row) of each coefficient in diagonal order."""
    # odd diagonals run downwards, even ones upwards
    out = []
    for d in range(15):
        own = [(r, d - r) for r in range(8) if 0 <= d - r < 8]
        out += own if d % 2 else own[::-1]
    return np.array([8 * r + c for r, c in out])


@lru_cache(maxsize=1)
def cosines() -> np.ndarray:
    k, n = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    return np.where(k == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * n + 1) * k * np.pi / 16)


def steps(quality: int, colour: bool) -> np.ndarray:
    """Quantisation steps for a quality from 1 to 100."""
    if colour:
        base = np.full((8, 8), COLOUR_REST)
        base[:4, :4] = COLOUR_CORNER
        base = base.ravel()
    else:
        base = np.array(LUMINANCE)
    q = min(max(int(quality), 1), 100)
    scale = 5000 // q if q < 50 else 200 - 2 * q
    return np.clip((base * scale + 50) // 100, 1, 255)


@lru_cache(maxsize=2)
def code_lengths(direct: bool) -> tuple[tuple[int, int], ...]:
    """(symbol, code length), shortest first, at most 16 bits; the all-ones code stays free.

    A direct symbol is a size; others are a run of zeros and a size. Likelihood falls with both."""
    if direct:
        weight = {s: 2.0 ** -abs(s - 2.5) for s in range(12)}
    else:
        weight = {(run << 4) | size: 2.0 ** (-0.55 * run - 1.1 * size) for run in range(16) for size in range(1, 11)}
        weight |= {0x00: 0.5, 0xF0: 2.0**-9}
    floor = sum(weight.values()) * 2.0**-13  # so that no code gets longer than 16 bits
    heap = [(max(w, floor), i, (s,)) for i, (s, w) in enumerate(sorted(weight.items()))]
    heap.append((floor / 4, len(heap), (None,)))  # takes the all-ones code
    heapq.heapify(heap)
    length = dict.fromkeys([*weight, None], 0)
    while len(heap) > 1:
        (a, _, x), (b, i, y) = heapq.heappop(heap), heapq.heappop(heap)
        for s in x + y:
            length[s] += 1
        heapq.heappush(heap, (a + b, i + 1000, x + y))
    free = length.pop(None)
    assert max(length.values()) <= free <= 16
    return tuple(sorted(length.items(), key=lambda x: (x[1], x[0])))


@lru_cache(maxsize=2)
def codes(direct: bool) -> tuple[np.ndarray, np.ndarray]:
    """Code and length of each symbol."""
    code, size, at, last = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 0
    for symbol, n in code_lengths(direct):
        at <<= n - last
        code[symbol], size[symbol], last = at, n, n
        at += 1
    return code, size


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def tables(quality: int, components: int) -> bytes:
    """Quantisation and code tables as a file of their own, which stripped bodies refer to."""
    out = b"\xff\xd8"
    for i in range(1 if components == 1 else 2):
        out += segment(0xDB, bytes([i]) + bytes(steps(quality, i == 1)[zigzag()].tolist()))
    for direct in (True, False):
        entries = code_lengths(direct)
        counts = bytes(sum(n == k for _, n in entries) for k in range(1, 17))
        out += segment(0xC4, bytes([0 if direct else 0x10]) + counts + bytes(s for s, _ in entries))
    return out + b"\xff\xd9"


def blocks_of(plane: np.ndarray) -> np.ndarray:
    """Blocks of 8 x 8 in rows; edges are repeated to whole blocks."""
    h, w = plane.shape
    full = np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge")
    return full.reshape(full.shape[0] // 8, 8, full.shape[1] // 8, 8).swapaxes(1, 2).reshape(-1, 8, 8)


def sizes_of(values: np.ndarray) -> np.ndarray:
    """Number of bits of the absolute value."""
    return np.ceil(np.log2(np.abs(values) + 1)).astype(np.int64)


def entropy_coded(levels: np.ndarray) -> bytes:
    """Coded scan of quantised blocks (blocks x components x 64, in zigzag order)."""
    n, comps, _ = levels.shape
    flat = levels.reshape(n * comps, 64)
    first = levels[:, :, 0]
    diff = np.diff(first, axis=0, prepend=0).reshape(-1)
    # symbols with a place that orders them: block, coefficient, step
    block, at = np.nonzero(flat[:, 1:])
    at += 1
    value = flat[block, at]
    before = np.where(np.append(-1, block[:-1]) == block, np.append(0, at[:-1]), 0) if len(block) else at
    run = at - before - 1
    long = run // 16
    rows = [(np.arange(len(flat)) * 4096, sizes_of(diff), diff, True)]
    rows.append((block * 4096 + at * 8 + 7, (run % 16 << 4) | sizes_of(value), value, False))
    if long.any():
        i = np.repeat(np.arange(len(run)), long)
        rows.append((block[i] * 4096 + at[i] * 8 + np.arange(len(i)) % 4, np.full(len(i), 0xF0), np.zeros(len(i), np.int64), False))
    last = np.zeros(len(flat), np.int64)
    np.maximum.at(last, block, at)
    ends = np.flatnonzero(last < 63)
    rows.append((ends * 4096 + 4095, np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64), False))
    place = np.concatenate([r[0] for r in rows])
    symbol, value = (np.concatenate([r[i] for r in rows]) for i in (1, 2))
    direct = np.concatenate([np.full(len(r[0]), r[3]) for r in rows])
    order = np.argsort(place, kind="stable")
    symbol, value, direct = symbol[order], value[order], direct[order]
    (dc_code, dc_size), (ac_code, ac_size) = codes(True), codes(False)
    code, length = np.where(direct, dc_code[symbol], ac_code[symbol]), np.where(direct, dc_size[symbol], ac_size[symbol])
    more = np.where(direct, symbol, symbol & 15)
    bits = np.where(value < 0, value + (1 << more) - 1, value)
    word, length = (code << more) | bits, length + more
    index = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    stream = (np.repeat(word, length) >> (np.repeat(length, length) - 1 - index)) & 1
    stream = np.append(stream, np.ones(-len(stream) % 8, np.int64)).astype(np.uint8)
    return np.packbits(stream).tobytes().replace(b"\xff", b"\xff\x00")


def to_components(pixels: np.ndarray) -> np.ndarray:
    if pixels.shape[2] == 1:
        return pixels.astype(np.float64) - 128
    r, g, b = (pixels[..., i].astype(np.float64) for i in range(3))
    y = 0.299 * r + 0.587 * g + 0.114 * b
    return np.stack([y - 128, (b - y) / 1.772, (r - y) / 1.402], 2)


def from_components(planes: np.ndarray) -> np.ndarray:
    if planes.shape[2] == 1:
        out = planes + 128
    else:
        y, cb, cr = (planes[..., i] for i in range(3))
        y = y + 128
        out = np.stack([y + 1.402 * cr, y - (0.114 * 1.772 * cb + 0.299 * 1.402 * cr) / 0.587, y + 1.772 * cb], 2)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def encode(pixels: np.ndarray, quality: int = 90, *, stripped: bool = False) -> bytes:
    """A file from rows x columns x (1 or 3) samples of 8 bits; stripped, it lacks the tables."""
    pixels = pixels[:, :, None] if pixels.ndim == 2 else pixels
    h, w, comps = pixels.shape
    if comps not in (1, 3) or not h or not w:
        raise JpegError(f"{h} x {w} x {comps} samples")
    planes, basis = to_components(pixels), cosines()
    levels = []
    for i in range(comps):
        changed = basis @ blocks_of(planes[..., i]) @ basis.T
        levels.append(np.rint(changed.reshape(-1, 64) / steps(quality, i > 0)).astype(np.int64)[:, zigzag()])
    frame = struct.pack(">BHHB", 8, h, w, comps) + b"".join(bytes([i + 1, 0x11, min(i, 1)]) for i in range(comps))
    scan = bytes([comps]) + b"".join(bytes([i + 1, 0]) for i in range(comps)) + b"\x00\x3f\x00"
    head = b"\xff\xd8" if stripped else tables(quality, comps)[:-2]
    return head + segment(0xC0, frame) + segment(0xDA, scan) + entropy_coded(np.stack(levels, 1)) + b"\xff\xd9"


# ---------------------------------------------------------------- reading


@lru_cache(maxsize=64)
def lookup(definition: bytes) -> tuple[list[int], list[int]]:
    """Symbol and length for each 16-bit prefix; length 0 where no code begins so."""
    counts, symbols = definition[:16], definition[16:]
    symbol, length, at, k = [0] * 65536, [0] * 65536, 0, 0
    for n, c in enumerate(counts, 1):
        for _ in range(c):
            span = 1 << (16 - n)
            if at + span > 65536 or k >= len(symbols):
                raise JpegError("code table overflows")
            symbol[at : at + span], length[at : at + span] = [symbols[k]] * span, [n] * span
            at, k = at + span, k + 1
    return symbol, length


class Bits:
    """Bits of an entropy-coded part, without stuffing; ones follow its end."""

    def __init__(self, data: bytes):
        self.value, self.count, self.data, self.at = 0, 0, data, 0

    def fill(self, n: int) -> None:
        while self.count < n:
            chunk = self.data[self.at : self.at + 8]
            self.at += 8
            chunk = chunk.ljust(8, b"\xff")
            self.value = (self.value << 64) | int.from_bytes(chunk, "big")
            self.count += 64
            if self.at > len(self.data) + 64:
                raise JpegError("scan ends early")

    def peek(self, n: int) -> int:
        self.fill(n)
        return (self.value >> (self.count - n)) & ((1 << n) - 1)

    def skip(self, n: int) -> None:
        self.count -= n
        self.value &= (1 << self.count) - 1

    def symbol(self, table: tuple[list[int], list[int]]) -> int:
        prefix = self.peek(16)
        n = table[1][prefix]
        if not n:
            raise JpegError("no such code")
        self.skip(n)
        return table[0][prefix]

    def signed(self, n: int) -> int:
        if not n:
            return 0
        v = self.peek(n)
        self.skip(n)
        return v if v >> (n - 1) else v - (1 << n) + 1


def read_segments(data: bytes, quant: dict, trees: dict) -> tuple[tuple | None, list, int, bytes]:
    """Tables of a file are added to quant and trees; frame, components of the scan, restart interval, and coded bytes."""
    frame, scan, restart, at = None, [], 0, 2
    if data[:2] != b"\xff\xd8":
        raise JpegError("no file begins here")
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise JpegError("marker expected")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        (size,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 128 if wide else 64
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else "u1").astype(np.int64)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                trees[body[0]] = lookup(bytes(body[1 : 17 + n]))
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            bits, h, w, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or n not in (1, 3):
                raise JpegError(f"{bits} bits, {n} components")
            frame = (h, w, [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)])
        elif 0xC2 <= marker <= 0xCF and marker != 0xCC:
            raise JpegError("not a baseline file")
        elif marker == 0xDD:
            (restart,) = struct.unpack(">H", body[:2])
        elif marker == 0xDA:
            scan = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            return frame, scan, restart, data[at:]
    return frame, scan, restart, b""


def decode(data: bytes, shared: bytes | None = None, *, rgb: bool = False) -> np.ndarray:
    """Samples (rows x columns x components) of a file, whose tables may be in ``shared``; with
    ``rgb`` the three components are colours themselves."""
    quant, trees = {}, {}
    if shared:
        read_segments(shared, quant, trees)
    frame, scan, restart, coded = read_segments(data, quant, trees)
    if frame is None or len(scan) != len(frame[2]):
        raise JpegError("no frame, or several scans")
    h, w, comps = frame
    most_h, most_v = max(c[1] for c in comps), max(c[2] for c in comps)
    if len(comps) == 1:
        comps, most_h, most_v = [(comps[0][0], 1, 1, comps[0][3])], 1, 1
    across, down = -(-w // (8 * most_h)), -(-h // (8 * most_v))
    out = [np.zeros((down * c[2], across * c[1], 64), np.int64) for c in comps]
    by_id = {s[0]: s for s in scan}
    plan = [(i, v, x, (trees[by_id[c[0]][1]], trees[0x10 | by_id[c[0]][2]])) for i, c in enumerate(comps) for v in range(c[2]) for x in range(c[1])]
    parts = split_restarts(coded)
    unit, order = 0, zigzag().tolist()
    for part in parts:
        bits, last = Bits(part), [0] * len(comps)
        until = min(unit + restart, across * down) if restart else across * down
        while unit < until:
            row, column = divmod(unit, across)
            for i, v, x, (dc, ac) in plan:
                c = comps[i]
                block = out[i][row * c[2] + v, column * c[1] + x]
                last[i] += bits.signed(bits.symbol(dc))
                block[0] = last[i]
                k = 1
                while k < 64:
                    s = bits.symbol(ac)
                    size = s & 15
                    if not size:
                        if s != 0xF0:
                            break
                        k += 16
                        continue
                    k += s >> 4
                    if k > 63:
                        raise JpegError("block overflows")
                    block[order[k]] = bits.signed(size)
                    k += 1
            unit += 1
    if unit < across * down:
        raise JpegError("scan ends early")
    planes, basis = [], cosines()
    for c, levels in zip(comps, out):
        table = np.empty(64, np.int64)
        table[zigzag()] = quant[c[3]]
        blocks = basis.T @ (levels * table).reshape(-1, 8, 8) @ basis
        rows, columns = levels.shape[:2]
        plane = blocks.reshape(rows, columns, 8, 8).swapaxes(1, 2).reshape(rows * 8, columns * 8)
        planes.append(plane.repeat(most_v // c[2], 0).repeat(most_h // c[1], 1)[:h, :w])
    stacked = np.stack(planes, 2)
    return np.clip(np.rint(stacked + 128), 0, 255).astype(np.uint8) if rgb else from_components(stacked)


def split_restarts(coded: bytes) -> list[bytes]:
    """Coded parts between restart markers, up to the next other marker, without stuffing."""
    parts, start, at = [], 0, 0
    while (at := coded.find(b"\xff", at)) >= 0 and at + 1 < len(coded):
        marker = coded[at + 1]
        if marker == 0 or marker == 0xFF:
            at += 2 if marker == 0 else 1
        elif 0xD0 <= marker <= 0xD7:
            parts.append(coded[start:at])
            start = at = at + 2
        else:
            return [p.replace(b"\xff\x00", b"\xff") for p in [*parts, coded[start:at]]]
    return [p.replace(b"\xff\x00", b"\xff") for p in [*parts, coded[start:]]]
