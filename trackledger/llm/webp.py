"""Media columns as lossless WebP (VP8L): decoding, and a writer for byte payloads.

``decode`` reads any VP8L stream: prefix codes (simple and normal, several groups through an
entropy image), literals, back-references with the two-dimensional distance map, the colour
cache, and the inverse predictor, cross-colour, subtract-green and palette transforms.

A text column is stored by laying its bytes into the green samples of grey strips of at most
``STRIP`` bytes, each an image with its own prefix codes, literals and back-references. Per
strip the writer takes what needs the fewest bits: a packed palette where few different bytes
occur, the left predictor where neighbours differ little, else subtract-green alone. A text is
one file: a plain image, or for several strips an animation whose frames fill the canvas.
Both ways all strips of a block advance in lockstep: the writer's step k asks each strip's hash
table for an earlier equal window, the reader's step k looks up the k-th symbol of every strip
with a table gather; then the reader follows the back-references and undoes the transforms. Streams the lockstep reader does not cover (other transforms, colour cache, several
groups of codes) go through ``decode_image``.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 576
STRIP = 16 * TILE
#: Texts taken together, and samples worked on at once.
BATCH_BYTES, BLOCK_BYTES = 24 << 20, 5 << 20
MAX_BITS = 11
#: A back-reference takes at least the window that finds it; the format ends it at LONGEST.
WINDOW, LONGEST = 8, 4096
HASH_BITS = 12
#: Fixed values of the format: order of the code-length code, symbols of the alphabets.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
LITERALS, LENGTHS, DISTANCES = 256, 24, 40
CACHE_FACTOR = 0x1E35A7BD
#: The distance map: neighbours at most 7 rows up, nearest first, then by column.
NEAR = sorted(
    ((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0)
)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)


def reversed_bits(bits: int) -> np.ndarray:
    """For each number of ``bits`` bits, its bits in reverse order."""
    out = np.zeros(1, np.int64)
    for _ in range(bits):
        out = np.concatenate((out * 2, out * 2 + 1))
    return out


REVERSED = {b: reversed_bits(b) for b in range(16)}


class Bits:
    """Reads little-endian bit fields."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def peek(self, n: int) -> int:
        i = self.at >> 3
        return (int.from_bytes(self.data[i : i + 8], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        v = self.peek(n)
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("the stream ends early")
        return v


# -- prefix codes --------------------------------------------------------------------------


def lookup_table(lengths: np.ndarray, bits: int) -> np.ndarray:
    """``symbol << 4 | length`` for every ``bits`` upcoming bits of a complete prefix code."""
    used = np.flatnonzero(lengths)
    if len(used) == 1:
        return np.full(1 << bits, used[0] << 4, np.int32)
    used = used[np.argsort(lengths[used], kind="stable")]
    size = lengths[used]
    spread = np.repeat((used << 4) | size, 1 << (bits - size))
    if len(spread) != 1 << bits:
        raise ValueError("the prefix code is not complete")
    return spread[REVERSED[bits]].astype(np.int32)


def read_code_lengths(bits: Bits, size: int) -> np.ndarray:
    lengths = np.zeros(size, np.int64)
    if bits.read(1):
        several, wide = bits.read(1), bits.read(1)
        for s in [bits.read(8 if wide else 1)] + ([bits.read(8)] if several else []):
            lengths[s] = 1
        return lengths
    own = np.zeros(19, np.int64)
    for i in LENGTH_ORDER[: 4 + bits.read(4)]:
        own[i] = bits.read(3)
    table = lookup_table(own, 7).tolist()
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    out: list[int] = []
    previous = 8
    while len(out) < size and left > 0:
        left -= 1
        entry = table[bits.peek(7)]
        bits.at += entry & 15
        s = entry >> 4
        if s < 16:
            out.append(s)
            previous = s or previous
        elif s == 16:
            out += [previous] * (3 + bits.read(2))
        else:
            out += [0] * (3 + bits.read(3) if s == 17 else 11 + bits.read(7))
    if len(out) > size:
        raise ValueError("code lengths run over the alphabet")
    lengths[: len(out)] = out
    return lengths


class Code:
    """One prefix code, ready for lookups."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        if not lengths.any():
            lengths = np.eye(1, len(lengths), dtype=np.int64)[0]
        self.bits = int(lengths.max())
        self.table = lookup_table(lengths, self.bits).tolist()

    def next(self, bits: Bits) -> int:
        entry = self.table[bits.peek(self.bits)]
        bits.at += entry & 15
        return entry >> 4


def read_group(bits: Bits, cache_bits: int) -> list[Code]:
    sizes = (LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0), LITERALS, LITERALS, LITERALS, DISTANCES)
    return [Code(read_code_lengths(bits, n)) for n in sizes]


def prefix_value(bits: Bits, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


# -- pixels --------------------------------------------------------------------------------


def read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """Flat ARGB samples of an entropy-coded image; only the main one may have groups."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    block, meta, columns = 0, None, 0
    if main and bits.read(1):
        block = bits.read(3) + 2
        columns = -(-width >> block)
        meta = ((read_pixels(bits, columns, -(-height >> block), False) >> 8) & 0xFFFF).tolist()
    groups = [read_group(bits, cache_bits) for _ in range(1 + max(meta) if meta else 1)]
    total = width * height
    out = [0] * total
    cache = [0] * (1 << cache_bits) if cache_bits else None
    at = 0
    while at < total:
        y, x = divmod(at, width)
        green, red, blue, alpha, distance = groups[meta[(y >> block) * columns + (x >> block)] if meta else 0]
        s = green.next(bits)
        if s < LITERALS:
            r = red.next(bits)
            b = blue.next(bits)
            run = [alpha.next(bits) << 24 | r << 16 | s << 8 | b]
        elif s < LITERALS + LENGTHS:
            length = prefix_value(bits, s - LITERALS)
            code = prefix_value(bits, distance.next(bits))
            if code > len(NEAR):
                back = code - len(NEAR)
            else:
                dx, dy = NEAR[code - 1]
                back = max(1, dx + dy * width)
            if back > at or length > total - at:
                raise ValueError("a back-reference leaves the image")
            piece = out[at - back : at - back + min(length, back)]
            run = (piece * (length // back + 1))[:length]
        else:
            run = [cache[s - LITERALS - LENGTHS]]
        out[at : at + len(run)] = run
        at += len(run)
        if cache is not None:
            for p in run:
                cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
    if bits.at > 8 * len(bits.data):
        raise ValueError("the stream ends early")
    return np.array(out, np.uint32)


def split(argb: np.ndarray) -> np.ndarray:
    """(n, 4) samples in the order blue, green, red, alpha."""
    return argb.astype("<u4").view(np.uint8).reshape(-1, 4)


def signed_product(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (t.astype(np.int8).astype(np.int32) * c.astype(np.int8).astype(np.int32)) >> 5


def block_values(blocks: np.ndarray, width: int, height: int, bits: int) -> np.ndarray:
    """The block image spread over the pixels."""
    columns = -(-width >> bits)
    grid = blocks.reshape(-1, columns)
    return grid[np.arange(height)[:, None] >> bits, np.arange(width)[None] >> bits].ravel()


def undo_cross_colour(argb: np.ndarray, blocks: np.ndarray, width: int, height: int, bits: int) -> np.ndarray:
    px, t = split(argb).copy(), split(block_values(blocks, width, height, bits))
    red = (px[:, 2] + signed_product(t[:, 0], px[:, 1])).astype(np.uint8)
    blue = px[:, 0] + signed_product(t[:, 1], px[:, 1]) + signed_product(t[:, 2], red)
    px[:, 0], px[:, 2] = blue.astype(np.uint8), red
    return px.view("<u4").ravel().astype(np.uint32)


def undo_subtract_green(argb: np.ndarray) -> np.ndarray:
    px = split(argb).copy()
    px[:, 0] += px[:, 1]
    px[:, 2] += px[:, 1]
    return px.view("<u4").ravel().astype(np.uint32)


def undo_palette(packed: np.ndarray, colours: np.ndarray, width: int, height: int, bits: int) -> np.ndarray:
    """Indices lie ``1 << bits`` to a green sample, lowest bits first."""
    index = (packed >> 8) & 0xFF
    if bits:
        per = 8 >> bits
        index = (index.reshape(height, -1, 1) >> (np.arange(1 << bits) * per)) & ((1 << per) - 1)
        index = index.reshape(height, -1)[:, :width].ravel()
    table = np.zeros(256, np.uint32)
    table[: len(colours)] = colours
    return table[index]


def predict(mode: int, left, top, top_right, top_left) -> list[int]:
    """Prediction of one pixel from four samples per neighbour."""
    if mode == 0 or mode > 13:
        return [0, 0, 0, 255]
    if mode <= 4:
        return list((left, top, top_right, top_left)[mode - 1])
    mean = lambda a, b: [(x + y) // 2 for x, y in zip(a, b, strict=True)]
    clamp = lambda v: min(255, max(0, v))
    if mode == 5:
        return mean(mean(left, top_right), top)
    if mode <= 9:
        return mean(*((left, top_left), (left, top), (top_left, top), (top, top_right))[mode - 6])
    if mode == 10:
        return mean(mean(left, top_left), mean(top, top_right))
    if mode == 11:
        near = lambda a: sum(abs(lx + tx - cx - ax) for lx, tx, cx, ax in zip(left, top, top_left, a, strict=True))
        return list(left if near(left) < near(top) else top)
    if mode == 12:
        return [clamp(x + y - c) for x, y, c in zip(left, top, top_left, strict=True)]
    out = []
    for a, c in zip(mean(left, top), top_left, strict=True):
        half = (abs(a - c) // 2) * (1 if a >= c else -1)  # division towards zero
        out.append(clamp(a + half))
    return out


def undo_predictor(argb: np.ndarray, blocks: np.ndarray, width: int, height: int, bits: int) -> np.ndarray:
    if ((blocks >> 8 & 15) == 1).all():  # left neighbours alone: sums down the first column, then along the rows
        px = split(argb).reshape(height, width, 4).astype(np.int64)
        px[0, 0, 3] += 255
        px[:, 0] = np.cumsum(px[:, 0], axis=0)
        return np.cumsum(px, axis=1).astype(np.uint8).reshape(-1, 4).copy().view("<u4").ravel().astype(np.uint32)
    rest = split(argb).tolist()
    modes = ((block_values(blocks, width, height, bits) >> 8) & 15).tolist()
    out: list[list[int]] = []
    for i, px in enumerate(rest):
        y, x = divmod(i, width)
        if not i:
            guess = [0, 0, 0, 255]
        elif not y:
            guess = out[i - 1]
        elif not x:
            guess = out[i - width]
        else:
            guess = predict(modes[i], out[i - 1], out[i - width], out[i - width + 1], out[i - width - 1])
        out.append([(a + b) & 255 for a, b in zip(px, guess, strict=True)])
    return np.array(out, np.uint8).reshape(-1, 4).copy().view("<u4").ravel().astype(np.uint32)


def chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes]]:
    """(tag, body) of the chunks between two places."""
    while at + 8 <= min(end, len(data)):
        n = int.from_bytes(data[at + 4 : at + 8], "little")
        yield data[at : at + 4], data[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)


def file_end(data: bytes) -> int:
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    return 8 + int.from_bytes(data[4:8], "little")


def images_of(data: bytes) -> list[tuple[int, int, bytes]]:
    """(x, y, lossless image) of every image or frame of a file, in order."""
    out = []
    for tag, body in chunks(data, 12, file_end(data)):
        if tag == b"VP8L":
            out.append((0, 0, body))
        elif tag == b"ANMF":
            x, y = (2 * int.from_bytes(body[i : i + 3], "little") for i in (0, 3))
            out += [(x, y, inner) for t, inner in chunks(body, 16, len(body)) if t == b"VP8L"]
    if not out:
        raise ValueError("no lossless image in the file")
    return out


def container(data: bytes) -> tuple[bytes, int]:
    """The first lossless image of a file and where the file ends."""
    end = file_end(data)
    return images_of(data)[0][2], end + (end & 1)


def chunk(tag: bytes, body: bytes) -> bytes:
    return tag + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) & 1)


def one_file(images: Sequence[tuple[bytes, int]], width: int) -> bytes:
    """One file of images (stream, rows) that lie one below the other: frames when there are several."""
    three = lambda n: n.to_bytes(3, "little")
    if len(images) == 1:
        body = [chunk(b"VP8L", images[0][0])]
    else:
        size = three(width - 1) + three(sum(h for _, h in images) - 1)
        body, y = [chunk(b"VP8X", b"\2\0\0\0" + size), chunk(b"ANIM", b"\0\0\0\0\1\0")], 0
        for stream, h in images:
            place = three(0) + three(y // 2) + three(width - 1) + three(h - 1) + three(0) + b"\2"
            body.append(chunk(b"ANMF", place + chunk(b"VP8L", stream)))
            y += h
    return b"RIFF" + (4 + sum(map(len, body))).to_bytes(4, "little") + b"WEBP" + b"".join(body)


def read_header(bits: Bits) -> tuple[int, int]:
    if bits.read(8) != 0x2F:
        raise ValueError("wrong signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    return width, height


def read_transforms(bits: Bits, width: int, height: int) -> tuple[list[tuple], int]:
    """Transforms in stream order and the width of the image that follows."""
    steps: list[tuple] = []
    while bits.read(1):
        kind = bits.read(2)
        if any(s[0] == kind for s in steps):
            raise ValueError("a transform occurs twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            size = bits.read(3) + 2
            steps.append((kind, width, size, read_pixels(bits, -(-width >> size), -(-height >> size), False)))
        elif kind == SUBTRACT_GREEN:
            steps.append((kind,))
        else:
            n = bits.read(8) + 1
            colours = np.cumsum(split(read_pixels(bits, n, 1, False)), axis=0, dtype=np.uint8)
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            steps.append((kind, width, pack, colours.copy().view("<u4").ravel().astype(np.uint32)))
            width = -(-width >> pack)
    return steps, width


def undo(steps: list[tuple], argb: np.ndarray, height: int) -> np.ndarray:
    for step in reversed(steps):
        if step[0] == SUBTRACT_GREEN:
            argb = undo_subtract_green(argb)
            continue
        _, width, bits, extra = step
        inverse = {PREDICTOR: undo_predictor, CROSS_COLOUR: undo_cross_colour, PALETTE: undo_palette}[step[0]]
        argb = inverse(argb, extra, width, height, bits)
    return argb


def decode_image(data: bytes) -> np.ndarray:
    """Pixels of one lossless image, (height, width, 4) in the order red, green, blue, alpha."""
    bits = Bits(data)
    width, height = read_header(bits)
    steps, coded = read_transforms(bits, width, height)
    argb = undo(steps, read_pixels(bits, coded, height, True), height)
    return split(argb)[:, [2, 1, 0, 3]].reshape(height, width, 4)


def decode(data: bytes) -> np.ndarray:
    """Pixels of one WebP file; frames of an animation are laid over each other."""
    parts = [(x, y, decode_image(image)) for x, y, image in images_of(data)]
    if len(parts) == 1:
        return parts[0][2]
    canvas = np.zeros((max(y + p.shape[0] for _, y, p in parts), max(x + p.shape[1] for x, _, p in parts), 4), np.uint8)
    for x, y, p in parts:
        canvas[y : y + p.shape[0], x : x + p.shape[1]] = p
    return canvas


# -- writing byte payloads -----------------------------------------------------------------


def code_lengths(counts: Sequence[int], limit: int = MAX_BITS) -> list[int]:
    """Huffman code lengths of the (at least two) positive counts, none over ``limit``."""
    counts = list(counts)
    while True:
        n = len(counts)
        parent = [0] * (2 * n - 1)
        heap = [(c, i) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        for k in range(n, 2 * n - 1):
            a, i = heapq.heappop(heap)
            b, j = heap[0]
            parent[i] = parent[j] = k
            heapq.heapreplace(heap, (a + b, k))
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[:n]) <= limit:
            return depth[:n]
        counts = [(c + 1) // 2 for c in counts]


# Lengths of the code-length code: complete over 0..11, 17 and 18, the same in every file.
_OWN_LENGTHS = np.zeros(19, np.int64)
_OWN_LENGTHS[[*range(MAX_BITS + 1), 17, 18]] = 4
_OWN_LENGTHS[[6, 7]] = 3


def canonical(lengths: np.ndarray, bits: int) -> np.ndarray:
    """Codes, bits in stream order, of the symbols with a length."""
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    step = 1 << (bits - lengths[used])
    codes = np.zeros(len(lengths), np.int64)
    codes[used] = REVERSED[bits][np.cumsum(step) - step]
    return codes


_OWN_CODES = canonical(_OWN_LENGTHS, 4).tolist()
_OWN_SIZES = _OWN_LENGTHS.tolist()


class BitText:
    """Collects bit fields in one number."""

    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


def _code_prefix() -> tuple[int, int]:
    out = BitText()
    out.put(0, 1)
    last = max(i for i, s in enumerate(LENGTH_ORDER) if _OWN_SIZES[s])
    out.put(last + 1 - 4, 4)
    for s in LENGTH_ORDER[: last + 1]:
        out.put(_OWN_SIZES[s], 3)
    out.put(0, 1)
    return out.value, out.n


_CODE_PREFIX = _code_prefix()


def put_code(out: BitText, symbols: Sequence[int], sizes: Sequence[int], alphabet: int) -> None:
    """A prefix code with the given lengths of ascending symbols."""
    if len(symbols) == 1:
        out.put(0b101 if symbols[0] > 1 else 0b001, 3)
        out.put(symbols[0], 8 if symbols[0] > 1 else 1)
        return
    out.put(*_CODE_PREFIX)
    at = 0
    for s, n in zip([*symbols, alphabet], [*sizes, 0], strict=True):
        gap = s - at
        while gap:
            if gap < 3:
                run = 1
                out.put(_OWN_CODES[0], _OWN_SIZES[0])
            elif gap < 11:
                run = gap
                out.put(_OWN_CODES[17] | (run - 3) << _OWN_SIZES[17], _OWN_SIZES[17] + 3)
            else:
                run = min(gap, 138)
                out.put(_OWN_CODES[18] | (run - 11) << _OWN_SIZES[18], _OWN_SIZES[18] + 7)
            gap -= run
        if s < alphabet:
            out.put(_OWN_CODES[n], _OWN_SIZES[n])
        at = s + 1


def length_prefix(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, number of extra bits, extra bits) of lengths and distance codes."""
    v = value.astype(np.int64) - 1
    high = np.floor(np.log2(np.maximum(v, 1))).astype(np.int64)
    extra = np.where(v < 4, 0, high - 1)
    symbol = np.where(v < 4, v, 2 * extra + (v >> extra))
    return symbol, extra, v & ((1 << extra) - 1)


def find_repeats(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, distance) of back-references in the strips laid end to end.

    Step k looks at the window of WINDOW samples from the k-th sample of every strip: the
    strip's hash table names the last place of such a window. Neighbouring starts with one
    distance are one repeat; a repeat ends where the next begins.
    """
    n = len(sizes)
    order = np.argsort(-sizes, kind="stable")
    first = (np.cumsum(sizes) - sizes)[order]
    key = np.zeros(len(flat), np.uint64)
    for j in range(WINDOW):
        key[: len(flat) - j] |= flat[j:].astype(np.uint64) << np.uint64(8 * j)
    slot = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - HASH_BITS)).astype(np.int32)
    table = np.full(n << HASH_BITS, -1, np.int32)
    lane = np.arange(n, dtype=np.int64) << HASH_BITS
    back = np.zeros(len(flat), np.int32)
    sorted_sizes = sizes[order]
    steps = int(sorted_sizes[0]) - WINDOW + 1
    live = n - np.searchsorted(sorted_sizes[::-1], np.arange(steps) + WINDOW, side="left")
    for k, m in enumerate(live.tolist()):
        at = first[:m] + k
        cell = lane[:m] + slot[at]
        seen = table[cell]
        table[cell] = k
        hit = np.flatnonzero(seen >= 0)
        if len(hit):
            hit = hit[key[first[hit] + seen[hit]] == key[at[hit]]]
            back[at[hit]] = k - seen[hit]
    strip = np.repeat(np.arange(n), sizes)
    new = np.concatenate(([True], (back[1:] != back[:-1]) | (strip[1:] != strip[:-1])))
    start = np.flatnonzero(new)
    run = np.diff(np.append(start, len(flat)))
    keep = back[start] > 0
    start, run = start[keep], run[keep]
    if not len(start):
        return start, run, run
    room = np.append(start[1:], len(flat)) - start
    length = np.minimum(run + WINDOW - 1, room)
    pieces = -(-length // LONGEST)
    part = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start, whole, distance = (np.repeat(x, pieces) for x in (start, length, back[start].astype(np.int64)))
    return start + part * LONGEST, np.minimum(whole - part * LONGEST, LONGEST), distance


def prefix_codes(histogram: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """(lengths, codes, symbols) per row of a histogram; a lone symbol needs no bits."""
    length, code, used = np.zeros(histogram.shape, np.int64), np.zeros(histogram.shape, np.int64), []
    for i, row in enumerate(histogram):
        symbols = np.flatnonzero(row)
        if len(symbols) > 1:
            length[i, symbols] = code_lengths(row[symbols].tolist())
            code[i] = canonical(length[i], MAX_BITS)
        used.append(symbols.tolist() or [0])
    return length, code, used


def put_lone_codes(out: BitText, green: int, alpha: int) -> None:
    """The five codes of an image of one colour whose red and blue are zero: no bits per pixel."""
    for only, alphabet in ((green, LITERALS + LENGTHS), (0, LITERALS), (0, LITERALS), (alpha, LITERALS), (0, DISTANCES)):
        put_code(out, [only], [0], alphabet)


def put_palette(out: BitText, colours: np.ndarray) -> None:
    """A palette of greys, ascending: differences, each channel under a code of its own."""
    n = len(colours)
    grey = np.diff(colours.astype(np.int64), prepend=0)
    alpha = np.where(np.arange(n), 0, 255)
    out.put(n - 1, 8)
    out.put(0, 1)  # no colour cache
    fields = []
    for values, alphabet in ((grey, LITERALS + LENGTHS), (grey, LITERALS), (grey, LITERALS), (alpha, LITERALS), (None, DISTANCES)):
        if values is None:
            put_code(out, [0], [0], alphabet)
            continue
        size, code, used = prefix_codes(np.bincount(values, minlength=256)[None])
        put_code(out, used[0], size[0, used[0]].tolist(), alphabet)
        fields.append([(int(code[0, v]), int(size[0, v])) for v in values.tolist()])
    for pixel in zip(*fields, strict=True):
        for field in pixel:
            out.put(*field)


class Plan:
    """How a strip is stored: its transforms and the samples that remain to be coded."""

    def __init__(self, kind: int, width: int, rows: int, samples: np.ndarray, colours: np.ndarray | None = None):
        self.kind, self.width, self.rows, self.samples, self.colours = kind, width, rows, samples, colours

    def put(self, out: BitText) -> None:
        out.put(1 | self.kind << 1, 3)
        if self.kind == PALETTE:
            put_palette(out, self.colours)
        elif self.kind == PREDICTOR:
            out.put(9 - 2, 3)
            out.put(0, 1)  # no colour cache
            put_lone_codes(out, 1, 255)
            out.put(1 | SUBTRACT_GREEN << 1, 3)
        out.put(0, 1)


#: Bits that a palette or the modes of a predictor cost at most, beside what they save.
TRANSFORM_BITS = 600


def plan_strips(strips: Sequence[np.ndarray], width: int) -> list[Plan]:
    """The cheapest of the three forms per strip, by the entropy of the samples to code."""
    n = len(strips)
    sizes = np.array([len(s) for s in strips], np.int64)
    flat = np.concatenate(strips)
    rows = flat.reshape(-1, width)
    first = (np.cumsum(sizes) - sizes) // width
    rest = rows.copy()
    rest[:, 1:] -= rows[:, :-1]
    rest[1:, 0] -= rows[:-1, 0]
    rest[first, 0] = rows[first, 0]
    strip = np.repeat(np.arange(n) << 8, sizes)

    def entropy(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = np.bincount(strip + samples, minlength=n << 8).reshape(n, 256)
        return counts, (counts * np.log2(sizes[:, None] / np.maximum(counts, 1))).sum(axis=1)

    counts, plain = entropy(flat)
    _, predicted = entropy(rest.ravel())
    distinct = (counts > 0).sum(axis=1)
    out = []
    for i, s in enumerate(strips):
        height = len(s) // width
        if distinct[i] <= 16 and plain[i] > TRANSFORM_BITS:
            colours = np.flatnonzero(counts[i])
            pack = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1
            index = np.searchsorted(colours, s).reshape(-1, 1 << pack) << (np.arange(1 << pack) * (8 >> pack))
            out.append(Plan(PALETTE, width >> pack, height, index.sum(axis=1).astype(np.uint8), colours))
        elif predicted[i] + TRANSFORM_BITS < plain[i]:
            out.append(Plan(PREDICTOR, width, height, rest[first[i] : first[i] + height].ravel()))
        else:
            out.append(Plan(SUBTRACT_GREEN, width, height, s))
    return out


def strip_header(width: int, plan: Plan, green: tuple[list[int], list[int]], distance: tuple[list[int], list[int]]) -> BitText:
    """Everything of a grey image before its samples: signature, size, transforms, codes."""
    out = BitText()
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(plan.rows - 1, 14)
    out.put(0, 4)
    plan.put(out)
    out.put(0, 2)  # no colour cache, one group of codes
    put_code(out, *green, LITERALS + LENGTHS)
    for only in (0, 0, 0 if plan.kind == PREDICTOR else 255):
        put_code(out, [only], [0], LITERALS)
    put_code(out, *distance, DISTANCES)
    return out


def encode_strips(strips: Sequence[np.ndarray], width: int = TILE) -> list[bytes]:
    """One WebP file per strip (bytes, a positive multiple of ``width``)."""
    return [one_file([(stream, len(s) // width)], width) for s, stream in zip(strips, encode_images(strips, width), strict=True)]


def encode_images(strips: Sequence[np.ndarray], width: int = TILE) -> list[bytes]:
    """One lossless image per strip."""
    n = len(strips)
    plans = plan_strips(strips, width)
    sizes = np.array([len(p.samples) for p in plans], np.int64)
    flat = np.concatenate([p.samples for p in plans])
    start, length, distance = find_repeats(flat, sizes)
    # Tokens: every sample that no repeat covers, and the first sample of every repeat.
    cover = np.zeros(len(flat) + 1, np.int32)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + length, -1)
    token = np.cumsum(cover[:-1]) == 0
    token[start] = True
    at = np.flatnonzero(token)
    strip = np.repeat(np.arange(n), sizes)[at]
    copy = np.searchsorted(at, start)
    symbol = flat[at].astype(np.int64)
    long_symbol, long_n, long_extra = length_prefix(length)
    far_symbol, far_n, far_extra = length_prefix(distance + len(NEAR))
    symbol[copy] = LITERALS + long_symbol
    alphabet = LITERALS + LENGTHS
    green_size, green_code, green_used = prefix_codes(np.bincount(strip * alphabet + symbol, minlength=alphabet * n).reshape(n, -1))
    far_size, far_code, far_used = prefix_codes(np.bincount(strip[copy] * DISTANCES + far_symbol, minlength=DISTANCES * n).reshape(n, -1))
    used = green_size[strip, symbol]
    value = green_code[strip, symbol].astype(np.uint64)
    for field, bits in (
        (long_extra, long_n), (far_code[strip[copy], far_symbol], far_size[strip[copy], far_symbol]), (far_extra, far_n),
    ):
        value[copy] |= field.astype(np.uint64) << used[copy].astype(np.uint64)
        used[copy] += bits
    heads = [
        strip_header(width, plans[i], *[(u[i], s[i, u[i]].tolist()) for u, s in ((green_used, green_size), (far_used, far_size))])
        for i in range(n)
    ]
    ends = np.cumsum(used)
    begin = np.searchsorted(strip, np.arange(n))
    before = ends[begin] - used[begin]
    body = np.append(before[1:], ends[-1]) - before
    head_bits = np.array([h.n for h in heads], np.int64)
    words = (head_bits + body + 63) // 64 + 1
    base = np.cumsum(words) - words
    bit = ends - used + (base * 64 + head_bits - before)[strip]
    word, shift = bit >> 6, (bit & 63).astype(np.uint64)
    packed = np.zeros(int(words.sum()) + 1, np.uint64)
    starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    packed[word[starts]] = np.bitwise_or.reduceat(value << shift, starts)
    over = np.flatnonzero((shift + used.astype(np.uint64)) > 64)
    packed[word[over] + 1] |= value[over] >> (np.uint64(64) - shift[over])
    raw = packed.view(np.uint8)
    out = []
    for i, h in enumerate(heads):
        n_bytes = int(head_bits[i] + body[i] + 7) // 8
        data = bytearray(raw[8 * base[i] : 8 * base[i] + n_bytes].tobytes())
        front = h.value.to_bytes((h.n + 7) // 8, "little")
        last = len(front) - 1
        joint = data[last] | front[last]
        data[: last + 1] = front
        data[last] = joint
        out.append(bytes(data))
    return out


# -- reading byte payloads -----------------------------------------------------------------


class Head:
    """What stands before the samples of a grey image as ``encode_images`` writes it."""

    def __init__(self, data: bytes):
        bits = Bits(data)
        width, self.height = read_header(bits)
        self.steps, self.width = read_transforms(bits, width, self.height)
        kinds = [s[0] for s in self.steps]
        self.plain = kinds in ([SUBTRACT_GREEN], [PREDICTOR, SUBTRACT_GREEN], [PALETTE]) and not bits.read(2)
        if not self.plain:
            return
        self.green = read_code_lengths(bits, LITERALS + LENGTHS)
        red, blue, alpha = (read_code_lengths(bits, LITERALS) for _ in range(3))
        self.distance = read_code_lengths(bits, DISTANCES)
        self.first_bit = bits.at
        self.alpha = int(np.argmax(alpha))
        self.plain = max(self.green.max(), self.distance.max()) <= MAX_BITS and self.green.any() and self.distance.any()
        self.plain &= all(np.count_nonzero(c) == 1 for c in (red, blue, alpha)) and bool(red[0] and blue[0])

    @property
    def size(self) -> int:
        return self.width * self.height

    def finish(self, samples: np.ndarray) -> np.ndarray:
        """Green samples of the image once its transforms are undone."""
        if len(self.steps) == 1 and self.steps[0][0] == SUBTRACT_GREEN:
            return samples  # green itself stays as it is
        argb = samples.astype(np.uint32) << 8 | np.uint32(self.alpha << 24)
        return split(undo(self.steps, argb, self.height))[:, 1].copy()


def prefix_tables(symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """(extra bits, smallest value) of each length or distance symbol, as ``prefix_value`` reads them."""
    s = np.arange(symbols, dtype=np.int64)
    extra = np.where(s < 4, 0, (s - 2) >> 1)
    return extra, np.where(s < 4, s, (2 + (s & 1)) << extra) + 1


def decode_strips(files: Sequence[bytes]) -> list[np.ndarray]:
    """The green samples of the first image of every file."""
    return decode_images([container(f)[0] for f in files])


def decode_images(images: Sequence[bytes]) -> list[np.ndarray]:
    """The green samples of every image; grey images of the writer's kind advance in lockstep."""
    out: list[np.ndarray | None] = [None] * len(images)
    found = []
    for i, data in enumerate(images):
        head = Head(data)
        if head.plain:
            found.append((head.size, i, data, head))
        else:
            out[i] = decode_image(data)[:, :, 1].ravel()
    found.sort(key=lambda x: (-x[0], x[1]))
    at = 0
    while at < len(found):  # as many lanes as a bounded block of samples holds
        count = max(1, (64 << 20) // found[at][0])
        part = found[at : at + count]
        for (_, i, _, head), samples in zip(part, lockstep(part), strict=True):
            out[i] = head.finish(samples)
        at += count
    return out


#: Steps between two looks at which streams have ended; a stream that has ended reads on into padding.
LOOK = 32


def lockstep(found: Sequence[tuple]) -> list[np.ndarray]:
    """Samples of the images, one symbol of every image per step.

    Nothing that is read depends on samples, so copies are resolved behind the last step.
    """
    n = len(found)
    size = np.array([x[0] for x in found], np.int64)
    streams = [x[2] for x in found]
    room = np.array([len(x) for x in streams], np.int64)
    begin = (np.cumsum(room) - room) * 8
    joined = b"".join(streams) + b"\0" * (8 * LOOK + 16)
    window = np.ndarray(len(joined) - 7, "<u8", joined, strides=(1,))  # 64 bits from every byte on
    green = np.concatenate([lookup_table(x[3].green, MAX_BITS) for x in found])
    far = np.concatenate([lookup_table(x[3].distance, MAX_BITS) for x in found])
    extra, least = prefix_tables(max(LENGTHS, DISTANCES))
    mask = (1 << MAX_BITS) - 1
    lane = np.arange(n)
    position = begin + np.array([x[3].first_bit for x in found], np.int64)
    symbols, counts, spent = [], [], []
    refs: list[tuple[np.ndarray, ...]] = []
    parts: list[tuple[np.ndarray, int]] = []
    made, k = np.zeros(n, np.int64), 0
    while len(lane):
        offset, table = lane << MAX_BITS, []
        for _ in range(LOOK):
            bits = window[position >> 3] >> (position & 7).astype(np.uint64)
            entry = green[offset + (bits & mask).astype(np.int64)]
            symbol, used = entry >> 4, (entry & 15).astype(np.int64)
            length = np.ones(len(lane), np.int64)
            at = np.flatnonzero(symbol >= LITERALS)
            if len(at):
                rest = (bits[at] >> used[at].astype(np.uint64)).astype(np.int64)
                s = symbol[at] - LITERALS
                n_long = extra[s]
                length[at] = least[s] + (rest & ((1 << n_long) - 1))
                rest >>= n_long
                entry = far[offset[at] + (rest & mask)].astype(np.int64)
                rest >>= entry & 15
                s = entry >> 4
                refs.append((np.full(len(at), k), lane[at], least[s] + (rest & ((1 << extra[s]) - 1))))
                used[at] += n_long + (entry & 15) + extra[s]
            position += used
            made += length
            table.append((symbol.astype(np.uint16), length.astype(np.int16), used.astype(np.uint8)))
            k += 1
        for held, columns in zip((symbols, counts, spent), zip(*table, strict=True), strict=True):
            held.append(np.stack(columns))
        parts.append((lane, k))
        open_ = made < size[lane]
        if not open_.all():
            lane, position, made = lane[open_], position[open_], made[open_]
    whole = [np.zeros((k, n), d) for d in (np.uint16, np.int32, np.int32)]
    for held, out in zip((symbols, counts, spent), whole, strict=True):
        for block, (lanes, end) in zip(held, parts, strict=True):
            out[end - LOOK : end, lanes] = block
    symbol, count, spent = whole
    start = np.cumsum(count, axis=0, dtype=np.int32) - count
    valid = (start < size) & (count > 0)
    if (begin + np.array([x[3].first_bit for x in found]) + np.where(valid, spent, 0).sum(axis=0) > begin + room * 8).any():
        raise ValueError("a stream ends early")
    base = np.cumsum(size) - size
    samples = np.zeros(int(size.sum()), np.uint8)
    source = np.full(len(samples), -1, np.int64)
    plain = valid & (symbol < LITERALS)
    samples[(start + base)[plain]] = symbol[plain]
    if refs:
        step, of, code = (np.concatenate(x) for x in zip(*refs, strict=True))
        keep = valid[step, of]
        step, of, code = step[keep], of[keep], code[keep]
        near_x, near_y = (np.array([p[j] for p in NEAR], np.int64) for j in (0, 1))
        near = np.minimum(code, len(NEAR)) - 1
        width = np.array([x[3].width for x in found], np.int64)[of]
        back = np.where(code > len(NEAR), code - len(NEAR), np.maximum(1, near_x[near] + near_y[near] * width))
        first, length = start[step, of].astype(np.int64), count[step, of].astype(np.int64)
        if (back > first).any() or (first + length > size[of]).any():
            raise ValueError("a back-reference leaves the image")
        place = np.repeat(first + base[of] - np.cumsum(length) + length, length) + np.arange(length.sum())
        source[place] = place - np.repeat(back, length)
        resolve(samples, source, place)
    return [samples[b : b + s] for b, s in zip(base.tolist(), size.tolist(), strict=True)]


def resolve(samples: np.ndarray, source: np.ndarray, place: np.ndarray) -> None:
    """Fills the copied samples: sources of sources are followed, twice as far each round."""
    while len(place):
        on = source[source[place]]
        copied = on >= 0
        ready = place[~copied]
        samples[ready] = samples[source[ready]]
        source[place[copied]] = on[copied]
        place = place[copied]


# -- columns -------------------------------------------------------------------------------


def strips_of(text: str | None) -> Iterator[np.ndarray]:
    """The padded payload of a text in strips."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    total = max(1, -(-len(raw) // TILE)) * TILE
    for a in range(0, total, STRIP):
        part = raw[a : a + STRIP]
        size = min(STRIP, total - a)
        yield part if len(part) == size else np.concatenate((part, np.full(size - len(part), 255, np.uint8)))


def digest(text: str | None, media: bytes, strips: Sequence[np.ndarray]) -> tuple:
    """What the query keeps of one stored text: of its file and of the samples read back."""
    payload = hashlib.sha256()
    bins, total, size = np.zeros(16, np.int64), 0, 0
    for samples in strips:
        payload.update(samples.tobytes())
        bins += np.bincount(samples >> 4, minlength=16)
        total += int(samples.sum(dtype=np.int64))
        size += len(samples)
    shares = ",".join(str(int(b) * 10_000 // size) for b in bins)
    return (
        len((text or "").encode("utf-8", "surrogatepass")), size, payload.hexdigest(), zlib.crc32(strips[-1][-32:].tobytes()),
        len(media), hashlib.sha256(media).hexdigest(), f"rows={size // TILE};mean={total * 100 // size};bins={shares}",
    )


FIELDS = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
SCHEMA = (
    "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "feature string"
)


def in_blocks(work, items: Sequence, sizes: Sequence[int]) -> list:
    """``work`` over blocks of about BLOCK_BYTES, items of about one size together; results in the order of the items."""
    order = sorted(range(len(items)), key=lambda i: -sizes[i])
    out: list = [None] * len(items)
    begin = 0
    while begin < len(order):
        end, held = begin, 0
        while end < len(order) and (end == begin or held + sizes[order[end]] <= BLOCK_BYTES):
            held += sizes[order[end]]
            end += 1
        for i, result in zip(order[begin:end], work([items[i] for i in order[begin:end]]), strict=True):
            out[i] = result
        begin = end
    return out


def store_texts(texts: Sequence[str | None]) -> list[bytes]:
    """The stored form of each text: one WebP file."""
    strips = [list(strips_of(t)) for t in texts]
    flat = [s for of_text in strips for s in of_text]
    streams = iter(in_blocks(encode_images, flat, list(map(len, flat))))
    return [one_file([(next(streams), len(s) // TILE) for s in of_text], TILE) for of_text in strips]


def pixels_of(image: bytes) -> int:
    size = int.from_bytes(image[1:5], "little")
    return ((size & 0x3FFF) + 1) * ((size >> 14 & 0x3FFF) + 1)


def load_strips(media: Sequence[bytes]) -> list[list[np.ndarray]]:
    """The strips of the payload out of each stored form."""
    images = [[image for _, _, image in images_of(m)] for m in media]
    flat = [image for of_text in images for image in of_text]
    samples = iter(in_blocks(decode_images, flat, list(map(pixels_of, flat))))
    return [[next(samples) for _ in of_text] for of_text in images]


def digests(texts: Iterable[str | None]) -> Iterator[tuple]:
    """Store every text, read the stored bytes back, and digest what was read; bounded memory."""
    held: list[str | None] = []
    size = 0

    def rows() -> Iterator[tuple]:
        media = store_texts(held)
        yield from map(digest, held, media, load_strips(media))

    for text in texts:
        held.append(text)
        size += max(TILE, len(text or ""))
        if size >= BATCH_BYTES:
            yield from rows()
            held, size = [], 0
    if held:
        yield from rows()


def store_text(text: str | None) -> bytes:
    """The stored form of a text: one WebP file."""
    return store_texts([text])[0]


def load_payload(media: bytes) -> bytes:
    """The padded payload out of a stored form."""
    return b"".join(s.tobytes() for s in load_strips([media])[0])


def media_digests(docs: DataFrame, *, text_col: str = "text", into: str = "media") -> DataFrame:
    """``docs`` with a struct ``into`` of sizes, digests and a feature of the stored text.

    Null texts count as empty (one tile of padding); rows are independent, so repeated rows
    and equal texts give equal values; an empty table stays empty. A column named ``into``
    is replaced.
    """

    @F.pandas_udf(SCHEMA)
    def stored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(list(digests(texts)), columns=list(FIELDS))

    return docs.withColumn(into, stored(docs[text_col]))


def media_column(docs: DataFrame, *, text_col: str = "text", into: str = "media") -> DataFrame:
    """``docs`` with the stored form of the text itself in ``into`` (binary)."""
    store = F.pandas_udf(lambda s: pd.Series([store_text(t) for t in s], dtype=object), "binary")
    return docs.withColumn(into, store(docs[text_col]))


def pixel_column(media: DataFrame, *, media_col: str = "media", into: str = "pixels") -> DataFrame:
    """``media`` with a struct (width, height, rgba) of each single WebP file; null stays null,
    a damaged file gives null."""

    @F.pandas_udf("width int, height int, rgba binary")
    def pixels(files: pd.Series) -> pd.DataFrame:
        rows = []
        for f in files:
            try:
                px = decode(f)
                rows.append((px.shape[1], px.shape[0], px.tobytes()))
            except (ValueError, TypeError, IndexError):
                rows.append((None, None, None))
        return pd.DataFrame(rows, columns=["width", "height", "rgba"]).astype({"width": "Int32", "height": "Int32"})

    return media.withColumn(into, pixels(media[media_col]))
