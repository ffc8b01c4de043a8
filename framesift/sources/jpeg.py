"""Baseline JPEG in batches: pictures at an eighth of the size, whole small ones, and encoding.

Huffman codes have to be read one after the other, but not one stream after the other: all streams of a batch are
lanes that advance by one code at a time together. A long stream is cut into several lanes; a lane begins with a
guess, reads on until its end, and hands its true state to the next one, which reads again only if the guess was wrong.
Such codes fall into step after a few symbols, so few rounds are needed, and what comes out is exact.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

#: Bytes of a lane at least, and lanes of a batch at most, if its streams are long.
LANE_BYTES, LANES = 512, 4096
#: Pictures whose code tables are in memory at once.
GROUP = 64

#: The quantisation tables for brightness and colour that quality 50 stands for, in row order.
_BRIGHTNESS = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
_COLOUR = (17, 18, 24, 47, 18, 21, 26, 66, 24, 26, 56, 99, 47, 66, 99, 99)  # the upper left corner; 99 elsewhere

_PLACES = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
#: Place in row order of each coefficient of the stream, from low to high frequencies along diagonals.
ZIGZAG = np.array([8 * y + x for y, x in _PLACES])
_COSINES = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
#: Reasons of files that end before their picture does: no other decoder has more of it.
CUT_OFF = ("a part of the picture is missing", "the picture is cut off")
_MARK = re.compile(rb"\xff+([\x01-\xfe])")


@dataclass
class Header:
    """What a file says about its picture; ``parts`` are (across, down, quantiser, code of the first coefficient, code of the others)."""

    width: int = 0
    height: int = 0
    parts: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    codes: dict[tuple[int, int], tuple[bytes, bytes]] = field(default_factory=dict)
    interval: int = 0
    body: int = 0

    @property
    def most(self) -> tuple[int, int]:
        """How many blocks a unit has at most, across and down; a picture of one part has units of one block."""
        return (1, 1) if len(self.parts) == 1 else (max(p[0] for p in self.parts), max(p[1] for p in self.parts))

    @property
    def units(self) -> tuple[int, int]:
        across, down = self.most
        return -(-self.width // (8 * across)), -(-self.height // (8 * down))

    @property
    def layout(self) -> list[tuple[int, int]]:
        """Blocks of each part in a unit, across and down."""
        return [(1, 1)] if len(self.parts) == 1 else [p[:2] for p in self.parts]


def header(data: bytes) -> Header:
    """The header of a file with one scan of 8-bit Huffman-coded blocks; ValueError for any other."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    found, at, frame = Header(), 2, {}
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("cut off before the picture")
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if marker == 0xFF:
            at += 1
            continue
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if size < 2 or at > len(data):
            raise ValueError("a segment is cut off")
        try:
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    n = 128 if wide else 64
                    found.quantisers[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else "u1", 64).astype(np.int64)
                    body = body[1 + n :]
            elif marker == 0xC4:
                while body:
                    n = 17 + sum(body[1:17])
                    found.codes[body[0] >> 4, body[0] & 15] = body[1:17], body[17:n]
                    body = body[n:]
            elif marker in (0xC0, 0xC1):
                if body[0] != 8:
                    raise ValueError("not of 8 bits")
                found.height, found.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                frame = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])}
            elif 0xC2 <= marker <= 0xCF and marker != 0xC8:
                raise ValueError("progressive, or coded in another way")
            elif marker == 0xDD:
                found.interval = int.from_bytes(body[:2], "big")
            elif marker == 0xDA:
                if body[0] != len(frame) or len(frame) not in (1, 3) or not found.width or not found.height:
                    raise ValueError("not one scan of one or three parts")
                found.parts = [(*frame[body[1 + 2 * i]], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
                for across, down, q, dc, ac in found.parts:
                    if not (1 <= across <= 4 and 1 <= down <= 4 and q in found.quantisers and (0, dc) in found.codes and (1, ac) in found.codes):
                        raise ValueError("a table is missing")
                found.body = at
                return found
        except (IndexError, KeyError) as e:
            raise ValueError("a segment is broken") from e


@lru_cache(4 * GROUP)
def _table(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 16 bits the length of the code they begin with, above its symbol; 0 for no code."""
    table, code, k = np.zeros(1 << 16, np.uint16), 0, 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[k : k + n]:
            table[code << 16 - length : code + 1 << 16 - length] = length << 8 | symbol
            code += 1
        k, code = k + n, code << 1
    return table


class _Streams:
    """The coded bytes of some pictures in a row, and their lanes."""

    def __init__(self, files: Sequence[tuple[bytes, Header]]):
        self.known: dict[tuple[bytes, bytes], int] = {}
        dc, ac, sizes, bases, parts, held = [], [], [], [], [], bytearray()
        begin, end, base, first, limit, owner = [], [], [], [], [], []
        self.errors: dict[int, str] = {}
        blocks = 0
        for i, (data, h) in enumerate(files):
            bases.append(len(dc))
            for (across, down), (*_, d, a) in zip(h.layout, h.parts):
                for _ in range(across * down):
                    dc.append(self._known(h.codes[0, d]))
                    ac.append(self._known(h.codes[1, a]))
            size = len(dc) - bases[i]
            pairs = list(zip(dc[bases[i] :], ac[bases[i] :]))
            sizes.append(next(n for n in range(1, size + 1) if pairs == (pairs[:n] * size)[:size]))  # blocks of one code can't be told apart, and needn't be
            parts.append(blocks)
            units = h.units[0] * h.units[1]
            step = h.interval or units
            pieces = self._pieces(data, h.body)
            if len(pieces) < -(-units // step):
                self.errors[i] = CUT_OFF[0]
            for k, piece in enumerate(pieces[: -(-units // step)]):
                begin.append(8 * len(held))
                held += piece + bytes(8)
                end.append(begin[-1] + 8 * len(piece))
                base.append(bases[i])
                owner.append(i)
                first.append(blocks + k * step * size)
                limit.append(min(step, units - k * step) * size)
            blocks += units * size
        self.blocks, self.starts_of = blocks, parts
        self.dc, self.ac = np.array(dc, np.int64), np.array(ac, np.int64)
        self.tables = np.stack([_table(*key) for key in self.known]) if self.known else np.zeros((1, 1 << 16), np.uint16)
        size_at = np.zeros(len(dc), np.int64)
        size_at[bases] = sizes
        self.size = size_at
        raw = np.frombuffer(bytes(held) + bytes(8), np.uint8)
        words = np.zeros(max(len(raw) - 7, 1), np.uint64)
        for j in range(8 if len(raw) > 8 else 0):
            words |= raw[j : len(words) + j].astype(np.uint64) << np.uint64(8 * (7 - j))
        self.words = words
        self.begin, self.end, self.base, self.first, self.limit, self.owner = (np.array(x, np.int64) for x in (begin, end, base, first, limit, owner))

    def _known(self, code: tuple[bytes, bytes]) -> int:
        return self.known.setdefault(code, len(self.known))

    @staticmethod
    def _pieces(data: bytes, at: int) -> list[bytes]:
        """The coded bytes between restart marks, as they were before marks were told apart from them."""
        out = []
        for mark in _MARK.finditer(data, at):
            out.append(data[at : mark.start()].replace(b"\xff\0", b"\xff"))
            at = mark.end()
            if not 0xD0 <= mark[1][0] <= 0xD7:
                return out
        return [*out, data[at:].replace(b"\xff\0", b"\xff")]

    def advance(self, pos, at, z, stop, limit, base, out=None, first=None, whole=False):
        """Read each lane until ``stop`` or for ``limit`` blocks: the places, blocks of a unit, coefficients, and numbers of blocks reached.

        With ``out``, the first coefficients (or, ``whole``, all of them) go there, from block ``first`` on.
        """
        n = len(pos)
        ends = [np.array(x, np.int64) for x in (pos, at, z, np.zeros(n))]
        lane = np.flatnonzero((pos < stop) & (limit > 0))
        p, c, k, done, stop, limit, base = (x[lane].astype(np.int64) for x in (pos, at, z, np.zeros(n, np.int64), stop, limit, base))
        size = self.size[base]
        first = first[lane] if first is not None else None
        one = np.uint64(1)
        while len(lane):
            window = self.words[p >> 3] << (p & 7).astype(np.uint64)
            is_first = k == 0
            entry = self.tables[np.where(is_first, self.dc[base + c], self.ac[base + c]), (window >> np.uint64(48)).astype(np.int64)]
            length, symbol = (entry >> 8).astype(np.int64), (entry & 255).astype(np.int64)
            bits = np.where(is_first, np.minimum(symbol, 16), symbol & 15)
            run = np.where(is_first, 0, symbol >> 4)
            place = k + run
            if out is not None:
                take = (bits > 0) & (place < 64) if whole else is_first & (bits > 0)
                raw = ((window << length.astype(np.uint64)) >> one >> (63 - bits).astype(np.uint64)).astype(np.int64)
                value = np.where(raw >= 1 << np.maximum(bits - 1, 0), raw, raw - (1 << bits) + 1)
                if whole:
                    out[(first + done)[take], ZIGZAG[place[take]]] = value[take]
                else:
                    out[(first + done)[take]] = value[take]
            bad = length == 0  # a wrong guess, or a broken file
            p = p + np.where(bad, 1, length + bits)
            k = np.where(is_first, 1, np.where(symbol == 0, 64, place + 1))
            over = k >= 64
            done = done + (over & ~bad)
            c = np.where(bad, 0, np.where(over, c + 1, c))
            c = np.where(c >= size, 0, c)
            k = np.where(over | bad, 0, k)
            over = (p >= stop) | (done >= limit)
            if over.any():
                for x, y in zip(ends, (p, c, k, done)):
                    x[lane[over]] = y[over]
                go = ~over
                lane, p, c, k, done, stop, limit, base, size = (x[go] for x in (lane, p, c, k, done, stop, limit, base, size))
                first = first[go] if first is not None else None
        return ends

    def read(self, whole: bool) -> np.ndarray:
        """The first coefficients of all blocks, or all of them: differences where the stream has differences."""
        out = np.zeros((self.blocks, 64) if whole else self.blocks, np.int16)
        length = max(8 * LANE_BYTES, int((self.end - self.begin).sum()) // LANES)
        cuts = np.maximum(1, -(-(self.end - self.begin) // length))
        stream = np.repeat(np.arange(len(cuts)), cuts)
        nth = np.arange(len(stream)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        pos = self.begin[stream] + nth * length
        stop = np.where(nth == cuts[stream] - 1, self.end[stream], pos + length)
        base, endless = self.base[stream], np.full(len(stream), 1 << 60)
        start = [pos, np.zeros_like(pos), np.zeros_like(pos)]
        reached = self.advance(*start, stop, endless, base) if len(stream) else [pos] * 4
        again = np.flatnonzero(nth > 0)
        while len(again):  # a lane at most settles each time, and nearly all do at once
            handed = [x[again - 1] for x in reached[:3]]
            moved = np.any([a != b[again] for a, b in zip(handed, start)], axis=0)
            again, handed = again[moved], [x[moved] for x in handed]
            if not len(again):
                break
            for x, y in zip(start, handed):
                x[again] = y
            for x, y in zip(reached, self.advance(*handed, stop[again], endless[again], base[again])):
                x[again] = y
            again = again[again + 1 < len(nth)] + 1
            again = again[nth[again] > 0]
        before = np.cumsum(reached[3]) - reached[3]
        before = before - before[np.cumsum(cuts) - cuts][stream] if len(stream) else before
        left = np.clip(self.limit[stream] - before, 0, None)
        _, _, _, done = self.advance(*start, stop, left, base, out, self.first[stream] + before, whole)
        short = np.bincount(stream, done, len(cuts)).astype(np.int64) < self.limit if len(stream) else np.empty(0, bool)
        for i in self.owner[short].tolist():
            self.errors.setdefault(i, CUT_OFF[1])
        return out

    def summed(self, coefficients: np.ndarray, i: int, h: Header) -> list[np.ndarray]:
        """The blocks of each part of a picture by rows of blocks, first coefficients as they are."""
        size = sum(a * d for a, d in h.layout)
        across, down = h.units
        own = coefficients[self.starts_of[i] : self.starts_of[i] + across * down * size].astype(np.int32)
        own = own.reshape(across * down, size, *own.shape[1:])
        step, out, at = h.interval or across * down, [], 0
        for a, d in h.layout:
            part = own[:, at : at + a * d].copy()
            at += a * d
            firsts = part[..., 0] if part.ndim == 3 else part
            for k in range(0, across * down, step):
                firsts[k : k + step] = np.cumsum(firsts[k : k + step].ravel()).reshape(-1, a * d)
            grid = part.reshape(down, across, d, a, *part.shape[2:])
            out.append(grid.swapaxes(1, 2).reshape(down * d, across * a, *part.shape[2:]))
        return out


def _pixels(planes: list[np.ndarray], h: Header, scale: int) -> np.ndarray:
    """Planes of brightness and colour differences as rows of red, green and blue, cut to the picture at 1/``scale``."""
    height, width = -(-h.height // scale), -(-h.width // scale)
    most, full = h.most, []
    for plane, (a, d) in zip(planes, h.layout):
        full.append(plane.repeat(most[1] // d, axis=0).repeat(most[0] // a, axis=1)[:height, :width])
    y = full[0]
    if len(full) == 1:
        rgb = np.stack([y, y, y], axis=-1)
    else:
        cb, cr = full[1] - 128, full[2] - 128
        rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=-1)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)


def _decoded(files: Sequence[bytes], whole: bool) -> list[np.ndarray | str]:
    out: list[np.ndarray | str] = [""] * len(files)
    held: list[tuple[int, bytes, Header]] = []

    def flush() -> None:
        streams = _Streams([(data, h) for _, data, h in held])
        coefficients = streams.read(whole)
        for j, (i, _, h) in enumerate(held):
            if j in streams.errors:
                out[i] = streams.errors[j]
                continue
            planes = []
            for blocks, (_, _, q, _, _) in zip(streams.summed(coefficients, j, h), h.parts):
                if whole:
                    factors = np.empty(64)
                    factors[ZIGZAG] = h.quantisers[q]
                    squares = (blocks * factors).reshape(*blocks.shape[:2], 8, 8)
                    plane = (_COSINES.T @ squares @ _COSINES).swapaxes(1, 2).reshape(8 * blocks.shape[0], 8 * blocks.shape[1])
                else:
                    plane = blocks * h.quantisers[q][0] / 8
                planes.append(np.clip(plane + 128, 0, 255))
            out[i] = _pixels(planes, h, 1 if whole else 8)
        held.clear()

    for i, data in enumerate(files):
        try:
            h = header(data)
            if any(h.most[0] % a or h.most[1] % d for a, d in h.layout):
                raise ValueError("parts of uneven sizes")
            held.append((i, data, h))
        except ValueError as e:
            out[i] = str(e)
        if len(held) == GROUP:
            flush()
    flush()
    return out


def eighths(files: Sequence[bytes]) -> list[np.ndarray | str]:
    """Each picture at an eighth of its size, from the mean of each block, as rows of red, green and blue; a reason where that can't be."""
    return _decoded(files, False)


def decoded(files: Sequence[bytes]) -> list[np.ndarray | str]:
    """Each picture whole, as rows of red, green and blue; for small ones, as all coefficients are in memory. A reason where that can't be."""
    return _decoded(files, True)


def quantisers(quality: int) -> tuple[np.ndarray, np.ndarray]:
    """The tables for brightness and colour at a quality from 1 to 100, in row order."""
    share = 5000 // quality if quality < 50 else 200 - 2 * quality
    colour = np.full((8, 8), 99)
    colour[:4, :4] = np.reshape(_COLOUR, (4, 4))
    return tuple(np.clip((t * share + 50) // 100, 1, 255) for t in (np.array(_BRIGHTNESS), colour.ravel()))


def _code(weights: dict[int, float]) -> tuple[bytes, bytes]:
    """A Huffman code of 16 bits at most for some symbols: numbers of codes by length, and symbols by code. No code is all ones."""
    heap = [(w, i, (s,)) for i, (s, w) in enumerate(sorted(weights.items()))] + [(0.0, -1, (-1,))]
    lengths = dict.fromkeys((-1, *weights), 0)
    heapq.heapify(heap)
    while len(heap) > 1:
        (w, i, a), (v, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        for s in (*a, *b):
            lengths[s] += 1
        heapq.heappush(heap, (w + v, i, a + b))
    counts = np.bincount(list(lengths.values()), minlength=40)
    for n in range(len(counts) - 1, 16, -1):  # two codes that are too long make room for each other under a shorter one
        while counts[n]:
            m = next(m for m in range(n - 2, 0, -1) if counts[m])
            for length, change in ((n, -2), (n - 1, 1), (m + 1, 2), (m, -1)):
                counts[length] += change
    counts[max(n for n in range(17) if counts[n])] -= 1  # that of no symbol, all ones
    order = sorted(weights, key=lambda s: (lengths[s], s))
    return bytes(counts[1:17].tolist()), bytes(order)


@lru_cache(1)
def _codes() -> list[tuple[bytes, bytes]]:
    """The codes that files are written with, for first and other coefficients: rarer by half with each bit and each zero before."""
    firsts = {bits: 0.5 ** abs(bits - 3) for bits in range(12)}
    others = {run << 4 | bits: 0.5 ** (bits + 0.8 * run) for run in range(16) for bits in range(1, 11)}
    return [_code(firsts), _code({**others, 0x00: 0.3, 0xF0: 0.5**13})]


def _codewords(code: tuple[bytes, bytes]) -> np.ndarray:
    """(256, 2): the code of each symbol and its length."""
    out, value, k = np.zeros((256, 2), np.int64), 0, 0
    for length, n in enumerate(code[0], 1):
        for symbol in code[1][k : k + n]:
            out[symbol] = value, length
            value += 1
        k, value = k + n, value << 1
    return out


def _bits_of(values: np.ndarray) -> np.ndarray:
    return np.frexp(np.abs(values).astype(np.float64))[1].astype(np.int64)


def encoded(rgb: np.ndarray, quality: int) -> bytes:
    """A picture of rows of red, green and blue as a baseline JPEG file."""
    height, width = rgb.shape[:2]
    down, across = -(-height // 8), -(-width // 8)
    whole = np.pad(rgb.astype(np.float64), ((0, 8 * down - height), (0, 8 * across - width), (0, 0)), "edge")
    r, g, b = np.moveaxis(whole, -1, 0)
    planes = [0.299 * r + 0.587 * g + 0.114 * b - 128, -0.168736 * r - 0.331264 * g + 0.5 * b, 0.5 * r - 0.418688 * g - 0.081312 * b]
    tables = quantisers(quality)
    blocks = np.empty((down * across, 3, 64), np.int64)
    for i, plane in enumerate(planes):
        squares = plane.reshape(down, 8, across, 8).swapaxes(1, 2)
        blocks[:, i] = np.rint((_COSINES @ squares @ _COSINES.T).reshape(-1, 64) / tables[min(i, 1)])[:, ZIGZAG]
    blocks[1:, :, 0] = np.diff(blocks[:, :, 0], axis=0)
    flat = blocks.reshape(-1, 64)
    # symbols and their order: block, then coefficient; zeros beyond 15 in a row before it, the end after all
    row, col = np.nonzero(flat[:, 1:])
    col += 1
    gap = np.diff(col, prepend=0) - 1
    new = np.r_[True, row[1:] != row[:-1]][: len(row)]
    gap[new] = col[new] - 1
    value = flat[row, col]
    last = np.zeros(len(flat), np.int64)
    np.maximum.at(last, row, col)
    ends, zeros = np.flatnonzero(last < 63), np.repeat(np.arange(len(row)), gap >> 4)
    n = len(flat)
    keys = np.concatenate([np.arange(n) * 256, row * 256 + 2 * col + 1, row[zeros] * 256 + 2 * col[zeros], ends * 256 + 255])
    firsts, others = map(_codewords, _codes())
    dc_bits, ac_bits = _bits_of(flat[:, 0]), _bits_of(value)
    code = np.concatenate([firsts[dc_bits], others[(gap & 15) << 4 | ac_bits], others[np.full(len(zeros), 0xF0)], others[np.zeros(len(ends), np.int64)]])
    extra = np.concatenate([np.where(flat[:, 0] < 0, flat[:, 0] + (1 << dc_bits) - 1, flat[:, 0]), np.where(value < 0, value + (1 << ac_bits) - 1, value), np.zeros(len(zeros) + len(ends), np.int64)])
    bits = np.concatenate([dc_bits, ac_bits, np.zeros(len(zeros) + len(ends), np.int64)])
    order = np.argsort(keys, kind="stable")
    words, lengths = (code[:, 0] << bits | extra)[order], (code[:, 1] + bits)[order]
    at = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    stream = (np.repeat(words, lengths) >> (np.repeat(lengths, lengths) - 1 - at) & 1).astype(np.uint8)
    body = np.packbits(np.r_[stream, np.ones(-len(stream) % 8, np.uint8)]).tobytes().replace(b"\xff", b"\xff\0")

    def segment(marker: int, content: bytes) -> bytes:
        return bytes((0xFF, marker)) + (len(content) + 2).to_bytes(2, "big") + content

    shape = b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + b"\x03" + b"".join(bytes((i + 1, 0x11, min(i, 1))) for i in range(3))
    return b"".join((
        b"\xff\xd8", segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"), *(segment(0xDB, bytes((i, *t[ZIGZAG].tolist()))) for i, t in enumerate(tables)), segment(0xC0, shape),
        *(segment(0xC4, bytes((kind << 4,)) + counts + symbols) for kind, (counts, symbols) in enumerate(_codes())), segment(0xDA, b"\3\1\0\2\0\3\0\0\x3f\0"), body, b"\xff\xd9",
    ))
