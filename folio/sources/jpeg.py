"""A baseline JPEG encoder in numpy: colours at half the resolution, Huffman codes made for each image."""

from __future__ import annotations

import heapq
import struct

import numpy as np

# The standard's quantisation steps of brightness and colour, row by row.
LUMINANCE = [16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99]
CHROMINANCE = [17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99, *[99] * 32]
#: Red, green and blue to brightness and two colours.
_TO_YCC = np.array([[0.299, 0.587, 0.114], [-0.168735892, -0.331264108, 0.5], [0.5, -0.418687589, -0.081312411]])
#: The cosine transform of eight samples, and the order in which a block's coefficients are written:
#: along the diagonals, every other one upwards.
_COSINES = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
_ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_NOTHING = 256  # stands for the code of ones only, which must not be used
_REST_ZERO, _ZEROS_16 = 0x00, 0xF0


def steps(quality: int) -> list[np.ndarray]:
    """Quantisation steps of brightness and colour for a quality from 1 to 100; 50 is the standard's."""
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return [np.clip((np.array(t) * scale + 50) // 100, 1, 255) for t in (LUMINANCE, CHROMINANCE)]


def _blocks(plane: np.ndarray, step: np.ndarray) -> np.ndarray:
    """(rows, columns, 64): quantised coefficients of a plane's blocks, in the order of writing."""
    h, w = plane.shape
    cells = plane.reshape(h // 8, 8, w // 8, 8).transpose(0, 2, 1, 3) - 128
    found = np.rint((_COSINES @ cells @ _COSINES.T) / step.reshape(8, 8)).astype(np.int64)
    return found.reshape(h // 8, w // 8, 64)[:, :, _ZIGZAG]


def _size(values: np.ndarray) -> np.ndarray:
    """Bits that a value's magnitude takes."""
    return np.frexp(np.abs(values).astype(np.float64))[1]


def code_lengths(counts: np.ndarray) -> dict[int, int]:
    """Symbol to length of its Huffman code, at most 16; rare symbols count for more until that holds."""
    weights = {int(s): 2 * int(counts[s]) for s in np.flatnonzero(counts)} | {_NOTHING: 1}
    while True:
        heap = [(w, s, (s,)) for s, w in weights.items()]
        heapq.heapify(heap)
        lengths = dict.fromkeys(weights, 0)
        while len(heap) > 1:
            (a, x, some), (b, y, more) = heapq.heappop(heap), heapq.heappop(heap)
            for s in some + more:
                lengths[s] += 1
            heapq.heappush(heap, (a + b, max(x, y), some + more))
        if max(lengths.values()) <= 16:
            return lengths
        weights = {s: 1 if s == _NOTHING else 2 * (w // 4 + 1) for s, w in weights.items()}


def _table(lengths: dict[int, int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(what a file says of the codes, code of each symbol, its length)."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    code, before = 0, 0
    codes, sizes = np.zeros(257, np.int64), np.zeros(257, np.int64)
    for s in order:
        code <<= lengths[s] - before
        before = lengths[s]
        codes[s], sizes[s] = code, before
        code += 1
    real = [s for s in order if s != _NOTHING]
    return bytes(sum(lengths[s] == n for s in real) for n in range(1, 17)) + bytes(real), codes, sizes


def _packed(values: np.ndarray, sizes: np.ndarray) -> bytes:
    """The lowest bits of each value, one after another; filled up with ones, a zero byte behind each of ones."""
    begin = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    left = np.repeat(begin + sizes, sizes) - np.arange(total) - 1
    bits = np.concatenate(((np.repeat(values, sizes) >> left) & 1, np.ones(-total % 8, np.int64))).astype(np.uint8)
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def encoded(pixels: np.ndarray, quality: int = 85) -> bytes:
    """A JPEG file of height x width x 3 bytes of red, green and blue."""
    height, width, _ = pixels.shape
    padded = np.pad(pixels, ((0, -height % 16), (0, -width % 16), (0, 0)), "edge").astype(np.float64)
    planes = np.moveaxis(padded @ _TO_YCC.T, 2, 0)
    planes[1:] += 128
    quant = steps(quality)
    h, w = padded.shape[:2]
    y = _blocks(planes[0], quant[0])
    colours = [_blocks(p.reshape(h // 2, 2, w // 2, 2).mean((1, 3)), quant[1]).reshape(-1, 1, 64) for p in planes[1:]]
    y = y.reshape(h // 16, 2, w // 16, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 4, 64)
    blocks = np.concatenate([y, *colours], axis=1).reshape(-1, 64)
    part = np.tile([0, 0, 0, 0, 1, 2], len(y))

    # Events in the order of writing: (block, place, table, symbol, further bits, their number).
    dc = blocks[:, 0].copy()
    for c in range(3):
        dc[part == c] = np.diff(dc[part == c], prepend=0)
    table = np.minimum(part, 1)
    at, place = np.nonzero(blocks[:, 1:])
    place += 1
    first = np.flatnonzero(np.diff(at, prepend=-1))
    zeros = place - np.concatenate(([0], place[:-1])) - 1
    zeros[first] = place[first] - 1
    value = blocks[at, place]
    long = np.repeat(np.arange(len(at)), zeros // 16)
    last = np.zeros(len(blocks), np.int64)
    last[at] = place
    short = np.flatnonzero(last < 63)
    everywhere = np.arange(len(blocks))
    n, size = len(long), [_size(dc), _size(value)]
    events = [
        (everywhere, np.zeros(len(blocks), np.int64), table, size[0], dc, size[0]),
        (at[long], place[long] * 2 - 1, 2 + table[at[long]], np.full(n, _ZEROS_16), np.zeros(n, np.int64), np.zeros(n, np.int64)),
        (at, place * 2, 2 + table[at], zeros % 16 * 16 + size[1], value, size[1]),
        (short, np.full(len(short), 200), 2 + table[short], np.full(len(short), _REST_ZERO), np.zeros(len(short), np.int64), np.zeros(len(short), np.int64)),
    ]
    block, place, table, symbol, value, size = (np.concatenate([e[k] for e in events]) for k in range(6))
    order = np.lexsort((place, block))
    table, symbol, value, size = table[order], symbol[order], value[order], size[order]
    value = np.where(value < 0, value + (1 << size) - 1, value)

    made = [_table(code_lengths(np.bincount(symbol[table == t], minlength=256))) for t in range(4)]
    codes, lengths = np.stack([m[1] for m in made]), np.stack([m[2] for m in made])
    data = _packed(codes[table, symbol] << size | value, lengths[table, symbol] + size)

    segment = lambda mark, body: struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body
    out = [b"\xff\xd8", segment(0xE0, b"JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00")]
    out += [segment(0xDB, bytes([k]) + bytes(q[_ZIGZAG].astype(np.uint8))) for k, q in enumerate(quant)]
    out.append(segment(0xC0, struct.pack(">BHHB", 8, height, width, 3) + bytes([1, 0x22, 0, 2, 0x11, 1, 3, 0x11, 1])))
    out += [segment(0xC4, bytes([(t // 2) << 4 | t % 2]) + m[0]) for t, m in enumerate(made)]
    out += [segment(0xDA, bytes([3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0])), data, b"\xff\xd9"]
    return b"".join(out)
