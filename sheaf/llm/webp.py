"""Lossless WebP (VP8L): a plain decoder, and an encoder for 8-bit samples.

The decoder reads prefix codes (simple and normal), entropy images with meta prefix codes, back-references
with the 2-D distance map, the colour cache, and inverts all four transforms: predictor, cross-colour,
subtract-green and palette (with bundled pixels). ``decode`` handles any stream, one pixel after the other;
``lockstep`` does the same for thousands of streams at once.

The encoder stores three samples to a pixel (red, green, blue). For each image it estimates what every
transform would cost and takes the cheapest, or none; then it writes back-references, a colour cache where
that pays, and its own prefix codes.

Pixels are unsigned 32-bit ARGB.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Sequence
from functools import lru_cache
from itertools import chain

import numpy as np

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
GREEN, LENGTHS, DISTANCES = 256, 24, 40
SIGNATURE = 0x2F
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3
CACHE_MULTIPLIER = 0x1E35A7BD
MAX_SIDE = 1 << 14
#: Longest code the encoder writes, so that one table look-up decodes a symbol.
MAX_BITS = 11


class Unsupported(ValueError):
    """A stream that lock step can't read, but the plain decoder can."""


def near_offsets() -> list[tuple[int, int]]:
    """The 120 short distance codes as (dx, dy): nearer first, then the larger dy, then the larger dx."""
    places = [(dx, dy) for dy in range(8) for dx in range(-7, 9) if dy or dx > 0]
    return sorted(places, key=lambda p: (p[0] ** 2 + p[1] ** 2, -p[1], -p[0]))


class Bits:
    """Bits of a byte string, least significant first; reads past the end give zeros, then an error."""

    def __init__(self, raw: bytes):
        self.value, self.at, self.size = int.from_bytes(raw, "little"), 0, 8 * len(raw)
        self.raw = raw + b"\0" * 8

    def peek(self, n: int) -> int:
        word = int.from_bytes(self.raw[self.at >> 3 : (self.at >> 3) + 8], "little")
        return (word >> (self.at & 7)) & ((1 << n) - 1)

    def skip(self, n: int) -> None:
        self.at += n
        if self.at > self.size:
            raise ValueError("the stream ends early")

    def read(self, n: int) -> int:
        got = self.peek(n)
        self.skip(n)
        return got


#: Every 15-bit number with its bits in reverse, the longest code's length.
LONGEST = 15
MIRROR = np.zeros(1 << LONGEST, np.int64)
for _bit in range(LONGEST):
    MIRROR |= (np.arange(1 << LONGEST) >> _bit & 1) << (LONGEST - 1 - _bit)
_MIRROR = MIRROR.tolist()


def reverse(code: int, n: int) -> int:
    return _MIRROR[code] >> (LONGEST - n)


def canonical(lengths: list[int]) -> dict[int, tuple[int, int]]:
    """symbol: (code with its first bit lowest, length), of the canonical prefix code."""
    used = [(n, s) for s, n in enumerate(lengths) if n]
    if len(used) == 1:
        return {used[0][1]: (0, 0)}
    if sum([1 << (15 - n) for n, _ in used]) != 1 << 15:
        raise ValueError("a prefix code is not complete")
    out, code, last = {}, 0, 0
    for n, s in sorted(used):
        code <<= n - last
        out[s] = (reverse(code, n), n)
        code, last = code + 1, n
    return out


SHORT = 4


class PrefixCode:
    """A prefix code by its lengths; the look-up table is made when a symbol is first read."""

    def __init__(self, lengths: list[int], only: int | None = None):
        self.lengths, self.only, self.table, self.short = lengths, only, None, None

    def _prepare(self) -> None:
        codes = canonical(self.lengths)
        self.only = next(iter(codes)) if len(codes) == 1 else None
        longest = max(n for _, n in codes.values())
        self.table = {(n, c): s for s, (c, n) in codes.items()}
        self.least = min(n for _, n in codes.values())
        if 0 < longest <= SHORT:  # one look-up: symbol and length for every window
            self.short = [(0, 0)] * (1 << SHORT)
            for s, (c, n) in codes.items():
                for rest in range(1 << (SHORT - n)):
                    self.short[c | rest << n] = (s, n)

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        if self.table is None:
            self._prepare()
            return self.read(bits)
        if self.short:
            s, n = self.short[bits.peek(SHORT)]
            bits.skip(n)
            return s
        window, n = bits.peek(15), self.least
        while n <= 15:
            got = self.table.get((n, window & ((1 << n) - 1)))
            if got is not None:
                bits.skip(n)
                return got
            n += 1
        raise ValueError("no such code")


def read_code(bits: Bits, alphabet: int) -> PrefixCode:
    lengths = [0] * alphabet
    if bits.read(1):
        two = bits.read(1)
        symbols = [bits.read(8 if bits.read(1) else 1)] + ([bits.read(8)] if two else [])
        for s in symbols:
            lengths[s] = 1
        return PrefixCode(lengths, symbols[0] if len(set(symbols)) == 1 else None)
    helper = [0] * len(CODE_LENGTH_ORDER)
    for s in CODE_LENGTH_ORDER[: 4 + bits.read(4)]:
        helper[s] = bits.read(3)
    code = PrefixCode(helper)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    at, last = 0, 8
    while at < alphabet and left:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths[at], at = s, at + 1
            last = s or last
        else:
            value = last if s == 16 else 0
            n = 3 + bits.read(2) if s == 16 else 3 + bits.read(3) if s == 17 else 11 + bits.read(7)
            if at + n > alphabet:
                raise ValueError("too many code lengths")
            lengths[at : at + n] = [value] * n
            at += n
    return PrefixCode(lengths)


def read_amount(bits: Bits, symbol: int) -> int:
    """A length or distance from its prefix symbol and extra bits."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def read_image(bits: Bits, width: int, height: int, top: bool) -> list[int]:
    """One entropy-coded image; only the top-level one may have meta prefix codes."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    groups, meta, block, across = 1, None, 0, 0
    if top and bits.read(1):
        block = bits.read(3) + 2
        across = (width + (1 << block) - 1) >> block
        meta = [(p >> 8) & 0xFFFF for p in read_image(bits, across, (height + (1 << block) - 1) >> block, False)]
        groups = max(meta) + 1
    size = 1 << cache_bits if cache_bits else 0
    sizes = (GREEN + LENGTHS + size, 256, 256, 256, DISTANCES)
    codes = [[read_code(bits, n) for n in sizes] for _ in range(groups)]
    cache, total, out = [0] * size, width * height, []
    near = None

    def remember(pixel: int) -> None:
        if size:
            cache[(CACHE_MULTIPLIER * pixel & 0xFFFFFFFF) >> (32 - cache_bits)] = pixel

    while len(out) < total:
        at = len(out)
        group = codes[meta[((at // width) >> block) * across + ((at % width) >> block)] if meta else 0]
        s = group[0].read(bits)
        if s < GREEN:
            red, blue, alpha = group[1].read(bits), group[2].read(bits), group[3].read(bits)
            out.append(alpha << 24 | red << 16 | s << 8 | blue)
            remember(out[-1])
        elif s < GREEN + LENGTHS:
            n = read_amount(bits, s - GREEN)
            d = read_amount(bits, group[4].read(bits))
            if d > 120:
                d -= 120
            else:
                near = near or near_offsets()
                dx, dy = near[d - 1]
                d = max(1, dx + dy * width)
            if d > at or at + n > total:
                raise ValueError("a back-reference leaves the image")
            for _ in range(n):
                out.append(out[-d])
                remember(out[-1])
        else:
            out.append(cache[s - GREEN - LENGTHS])
            remember(out[-1])
    return out


def channels(pixels: np.ndarray) -> np.ndarray:
    """(..., 4) of uint8 in the order blue, green, red, alpha."""
    return np.ascontiguousarray(pixels, "<u4").view(np.uint8).reshape(*pixels.shape, 4)


def _average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def predict(mode: int, left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Predicted pixels (last axis: four channels as int) from left, top, top-right and top-left ones."""
    if mode == 0 or mode > 13:
        return np.broadcast_to(np.array([0, 0, 0, 255], left.dtype), left.shape)
    if mode <= 4:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return _average(_average(left, right), top)
    if mode in (6, 7):
        return _average(left, corner if mode == 6 else top)
    if mode in (8, 9):
        return _average(top, corner if mode == 8 else right)
    if mode == 10:
        return _average(_average(left, corner), _average(top, right))
    if mode == 11:
        toward = np.abs(top - corner).sum(axis=-1, keepdims=True) < np.abs(left - corner).sum(axis=-1, keepdims=True)
        return np.where(toward, left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    mean = _average(left, top)
    difference = mean - corner
    return np.clip(mean + (np.abs(difference) >> 1) * np.sign(difference), 0, 255)


def undo_predictor(pixels: np.ndarray, modes: np.ndarray, block: int) -> np.ndarray:
    height, width = pixels.shape
    out = channels(pixels).astype(int)
    for y in range(height):
        for x in range(width):
            if y == 0:
                guess = np.array([0, 0, 0, 255]) if x == 0 else out[0, x - 1]
            elif x == 0:
                guess = out[y - 1, 0]
            else:
                mode = int(modes[y >> block, x >> block] >> 8) & 15
                right = out[y - 1, x + 1] if x + 1 < width else out[y, 0]
                guess = predict(mode, out[y, x - 1], out[y - 1, x], right, out[y - 1, x - 1])
            out[y, x] = (out[y, x] + guess) & 255
    return out.astype(np.uint8).view("<u4").reshape(height, width)


def undo_cross_colour(pixels: np.ndarray, factors: np.ndarray, block: int) -> np.ndarray:
    height, width = pixels.shape
    rows, columns = np.arange(height) >> block, np.arange(width) >> block
    f = channels(factors)[rows[:, None], columns[None, :]].view(np.int8).astype(int)
    c = channels(pixels).astype(int)
    signed = lambda x: ((x + 128) & 255) - 128
    green = signed(c[..., 1])
    red = (c[..., 2] + ((f[..., 0] * green) >> 5)) & 255
    blue = c[..., 0] + ((f[..., 1] * green) >> 5) + ((f[..., 2] * signed(red)) >> 5)
    c[..., 2], c[..., 0] = red, blue & 255
    return c.astype(np.uint8).view("<u4").reshape(height, width)


def undo_subtract_green(pixels: np.ndarray) -> np.ndarray:
    c = channels(pixels).copy()
    c[..., 0] += c[..., 1]
    c[..., 2] += c[..., 1]
    return c.view("<u4").reshape(pixels.shape)


def undo_palette(pixels: np.ndarray, palette: np.ndarray, width: int, bundle: int) -> np.ndarray:
    """bundle: log2 of how many indices a green value holds."""
    depth = 8 >> bundle
    green = channels(pixels)[..., 1].astype(int)
    index = (green[..., None] >> (np.arange(1 << bundle) * depth)) & ((1 << depth) - 1)
    index = index.reshape(len(pixels), -1)[:, :width]
    return np.append(palette, np.zeros(256, "<u4"))[index]


def chunk_of(raw: bytes) -> tuple[bytes, int]:
    """The VP8L payload of the first image in ``raw``, and where the image ends."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WEBP" or raw[12:16] != b"VP8L":
        raise ValueError("not a lossless WebP image")
    end, n = struct.unpack("<I", raw[4:8])[0] + 8, struct.unpack("<I", raw[16:20])[0]
    if end > len(raw) or 20 + n > end:
        raise ValueError("the file ends early")
    return raw[20 : 20 + n], end


def header(bits: Bits) -> tuple[int, int]:
    if bits.read(8) != SIGNATURE:
        raise ValueError("not a lossless stream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    return width, height


def decode(stream: bytes) -> np.ndarray:
    """The (height, width) array of ARGB pixels of any VP8L stream."""
    bits = Bits(stream)
    width, height = header(bits)
    undo, inner, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform is repeated")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = bits.read(3) + 2
            w, h = (inner + (1 << block) - 1) >> block, (height + (1 << block) - 1) >> block
            data = np.array(read_image(bits, w, h, False), "<u4").reshape(h, w)
            undo.append((kind, data, block))
        elif kind == SUBTRACT_GREEN:
            undo.append((kind, None, 0))
        else:
            n = bits.read(8) + 1
            steps = channels(np.array(read_image(bits, n, 1, False), "<u4").reshape(1, n))
            palette = np.cumsum(steps, axis=1, dtype=np.uint8).view("<u4").reshape(n)
            bundle = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((kind, (palette, inner), bundle))
            inner = (inner + (1 << bundle) - 1) >> bundle
    pixels = np.array(read_image(bits, inner, height, True), "<u4").reshape(height, inner)
    for kind, data, n in reversed(undo):
        if kind == PREDICTOR:
            pixels = undo_predictor(pixels, data, n)
        elif kind == CROSS_COLOUR:
            pixels = undo_cross_colour(pixels, data, n)
        elif kind == SUBTRACT_GREEN:
            pixels = undo_subtract_green(pixels)
        else:
            pixels = undo_palette(pixels, data[0], data[1], n)
    return pixels


class BitWriter:
    def __init__(self):
        self.value, self.at = 0, 0

    def write(self, value: int, n: int) -> None:
        self.value |= value << self.at
        self.at += n


#: Bits of a node's number in a Huffman tree.
NODE = 16


def code_lengths(counts: np.ndarray, longest: int = MAX_BITS) -> list[int]:
    """Huffman code lengths; flattened counts are tried until none is longer than ``longest``."""
    used = np.flatnonzero(counts)
    lengths = [0] * len(counts)
    if len(used) == 1:
        lengths[used[0]] = 1
        return lengths
    weights = counts[used].tolist()
    while True:
        # weight and number in one integer, the weight above
        heap = [w << NODE | k for k, w in enumerate(weights)]
        heapq.heapify(heap)
        parent, n, number = [0] * (2 * len(used)), len(used), (1 << NODE) - 1
        while len(heap) > 1:
            a = heapq.heappop(heap)
            b = heap[0]
            x, y = a & number, b & number
            parent[x] = parent[y] = n
            heapq.heapreplace(heap, a - x + b - y | n)
            n += 1
        depth = [0] * n
        for k in range(n - 2, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[: len(used)]) <= longest:
            break
        weights = [(w + 1) // 2 + sum(weights) // (1 << longest) for w in weights]
    for s, d in zip(used.tolist(), depth):
        lengths[s] = d
    return lengths


#: The encoder's own code for code lengths: runs of zeros get 3 bits, the lengths 0 to MAX_BITS 4.
HELPER = [4] * (MAX_BITS + 1) + [0] * (17 - MAX_BITS - 1) + [3, 3]
HELPER_CODES = canonical(HELPER)
#: What stands before the lengths of every code that isn't of one symbol.
HELPER_PARTS = [(0, 1), (len(CODE_LENGTH_ORDER) - 4, 4), *[(HELPER[s], 3) for s in CODE_LENGTH_ORDER], (0, 1)]


def gap_parts(gap: int) -> list[tuple[int, int]]:
    """The parts of so many lengths of zero."""
    out = []
    while gap >= 3:
        run = min(gap, 138)
        out.append(HELPER_CODES[18 if run >= 11 else 17])
        out.append((run - (11 if run >= 11 else 3), 7 if run >= 11 else 3))
        gap -= run
    return out + [HELPER_CODES[0]] * gap


GAPS = [gap_parts(n) for n in range(GREEN + LENGTHS)]


def code_parts(lengths: list[int]) -> list[tuple[int, int]]:
    """A prefix code as (value, bits) parts: the simple form for one symbol, else lengths with runs of zeros."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) == 1 and used[0] < 256:
        small = used[0] < 2
        return [(1, 1), (0, 1), (not small, 1), (used[0], 1 if small else 8)]
    out, at = HELPER_PARTS.copy(), 0
    for s in [*used, len(lengths)]:
        if s > at:
            out += GAPS[s - at] if s - at < len(GAPS) else gap_parts(s - at)
        if s < len(lengths):
            out.append(HELPER_CODES[lengths[s]])
        at = s + 1
    return out


def write_code(out: BitWriter, lengths: list[int]) -> None:
    for part in code_parts(lengths):
        out.write(*part)


def container(stream: bytes) -> bytes:
    body = b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


# The encoder. Candidates are measured and streams are written over a batch of images at once.

#: Predictor modes that are tried (left, top), transforms' block (the largest, so that one block holds a whole image),
#: shortest and longest back-reference, smallest image with a colour cache, largest cache in bits, and pixels that
#: are written together, about.
MODES, BLOCK_BITS = (1, 2), 9
SHORTEST, LONGEST_COPY, CACHED_PIXELS, CACHE_BITS, TOGETHER = 3, 4096, 64, 9, 1 << 17
HASH = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def entropies(image: np.ndarray, symbols: np.ndarray, images: int, alphabet: int = 256) -> np.ndarray:
    """Bits that each image's symbols need under a code of their own, the code's own bits included."""
    counts = np.bincount(image * alphabet + symbols, minlength=images * alphabet).reshape(images, alphabet)
    total = counts.sum(axis=1)
    level = np.arange(int(total.max(initial=0)) + 1)
    share = level * np.log2(np.maximum(level, 1))
    return share[total] - share[counts].sum(axis=1) + 6.0 * (counts > 0).sum(axis=1)


class Batch:
    """Images of ``width`` pixels to a row, whose samples stand one after the other."""

    def __init__(self, samples: list[np.ndarray], width: int):
        self.width, self.pixels = width, np.array([len(s) // 3 for s in samples], np.int64)
        self.begin = np.cumsum(self.pixels) - self.pixels
        self.of = np.repeat(np.arange(len(samples)), self.pixels)
        self.place = np.arange(len(self.of)) - self.begin[self.of]
        self.rgb = np.concatenate(samples).reshape(-1, 3)

    def cost(self, rgb: np.ndarray) -> np.ndarray:
        return sum(entropies(self.of, rgb[:, c].astype(np.int64), len(self.pixels)) for c in range(3))

    def predicted(self, mode: int) -> np.ndarray:
        """What is left of the pixels by mode 1 (left) or 2 (top); the first row goes by the left, the first column by the top."""
        back = np.full(len(self.of), {1: 1, 2: self.width}[mode])
        back[self.place < self.width] = 1
        back[self.place % self.width == 0] = self.width
        guess = self.rgb[np.maximum(np.arange(len(back)) - back, 0)]
        guess[self.begin] = 0
        return self.rgb - guess

    def factors(self) -> np.ndarray:
        """(images, 2) cross-colour factors of red and of blue by green, in 32nds, by least squares."""
        signed = self.rgb.view(np.int8).astype(np.float64)
        n = np.maximum(self.pixels, 1)
        mean = np.stack([np.add.reduceat(signed[:, c], self.begin) / n for c in range(3)], axis=1)
        off = signed - mean[self.of]
        spread = np.maximum(np.add.reduceat(off[:, 1] ** 2, self.begin), 1.0)
        both = [np.add.reduceat(off[:, c] * off[:, 1], self.begin) / spread for c in (0, 2)]
        return np.clip(np.rint(32 * np.stack(both, axis=1)), -128, 127).astype(np.int64)

    def crossed(self, factors: np.ndarray) -> np.ndarray:
        green, out = self.rgb[:, 1].view(np.int8).astype(np.int64), self.rgb.copy()
        for c, k in ((0, 0), (2, 1)):
            out[:, c] = (self.rgb[:, c] - (factors[self.of, k] * green >> 5)) & 255
        return out

    def argb(self, rgb: np.ndarray) -> np.ndarray:
        c = rgb.astype(np.uint32)
        return 0xFF000000 | c[:, 0] << 16 | c[:, 1] << 8 | c[:, 2]


def transformed(batch: Batch) -> list[tuple[list[tuple[int, int]], np.ndarray, int]]:
    """For each image the parts that state its transforms, its pixels after them, and how many make a row."""
    n = len(batch.pixels)
    green = batch.rgb[:, 1:2]
    less_green = batch.rgb - green * np.array([1, 0, 1], np.uint8)
    factors = batch.factors()
    forms = [batch.rgb, less_green, batch.crossed(factors), *[batch.predicted(m) for m in MODES]]
    costs = np.stack([batch.cost(f) for f in forms], axis=1)
    costs[:, 2:] += 48
    # palettes: the distinct colours of every image, and the entropy of their numbers
    plain = batch.argb(batch.rgb)
    names, number, counts = np.unique(batch.of << 24 | (plain & 0xFFFFFF).astype(np.int64), return_inverse=True, return_counts=True)
    owner = names >> 24
    colours = np.bincount(owner, minlength=n)
    body = batch.pixels * np.log2(batch.pixels) - np.bincount(owner, counts * np.log2(counts), n)
    palette_cost = np.where(colours <= 256, body + 6.0 * colours + 20.0 * colours + 64, np.inf)
    best, out = costs.argmin(axis=1), []
    first_name = np.cumsum(colours) - colours
    shaped = {k: plain if k == 0 else batch.argb(forms[k]) for k in np.unique(best).tolist()}
    for k in shaped.keys() - {0, 1, 2}:  # alpha is predicted like any channel: nothing is left of it
        shaped[k] &= np.uint32(0xFFFFFF)
    for k in range(n):
        a, z = int(batch.begin[k]), int(batch.begin[k] + batch.pixels[k])
        form = int(best[k])
        if palette_cost[k] < costs[k, form]:
            palette = names[first_name[k] : first_name[k] + colours[k]].astype(np.int64) & 0xFFFFFF
            out.append(bundled(palette, number[a:z] - first_name[k], batch.width))
        elif form == 0:
            out.append(([], shaped[0][a:z], batch.width))
        elif form == 1:
            out.append(([(1, 1), (SUBTRACT_GREEN, 2)], shaped[1][a:z], batch.width))
        else:
            kind = CROSS_COLOUR if form == 2 else PREDICTOR
            data = (int(factors[k, 0]) & 255) | (int(factors[k, 1]) & 255) << 8 if form == 2 else MODES[form - 3] << 8
            head = [(1, 1), (kind, 2), (BLOCK_BITS - 2, 3), *image_parts([0xFF000000 | data])]
            height = (z - a) // batch.width
            blocks = (-(-batch.width >> BLOCK_BITS) or 1, -(-height >> BLOCK_BITS) or 1)
            if blocks != (1, 1):
                raise ValueError("an image of the encoder is one block")
            out.append((head, shaped[form][a:z], batch.width))
    return out


def image_parts(pixels: list[int]) -> list[tuple[int, int]]:
    """A small image of literals, without a cache."""
    out, codes = [(0, 1)], []
    columns = [[p >> 8 & 255 for p in pixels], [p >> 16 & 255 for p in pixels], [p & 255 for p in pixels], [p >> 24 for p in pixels]]
    for values, size in zip(columns, (GREEN + LENGTHS, 256, 256, 256)):
        lengths = code_lengths(np.bincount(values, minlength=size))
        out += code_parts(lengths)
        codes.append(canonical(lengths))
    out += code_parts([1] + [0] * (DISTANCES - 1))
    for row in zip(*columns):
        out += [code[v] for code, v in zip(codes, row)]
    return out


def bundled(palette: np.ndarray, index: np.ndarray, width: int) -> tuple[list[tuple[int, int]], np.ndarray, int]:
    n = len(palette)
    steps = channels((palette | 0xFF000000).astype("<u4").reshape(1, -1)).copy()
    steps[0, 1:] -= steps[0, :-1].copy()
    head = [(1, 1), (PALETTE, 2), (n - 1, 8), *image_parts(steps.view("<u4").ravel().tolist())]
    bundle = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
    depth, per = 8 >> bundle, 1 << bundle
    across = -(-width // per)
    rows = np.zeros((len(index) // width, across * per), np.int64)
    rows[:, :width] = index.reshape(-1, width)
    green = (rows.reshape(len(rows), across, per) << np.arange(per) * depth).sum(axis=-1)
    return head, (0xFF000000 | green.ravel() << 8).astype(np.uint32), across


def equal_run(pixels: np.ndarray, at: int, distance: int, stop: int) -> int:
    """How many pixels from ``at`` on, before ``stop``, equal those ``distance`` before them."""
    size, step = 0, 16
    while at + size < stop:
        a, z = at + size, min(at + size + step, stop)
        unequal = np.flatnonzero(pixels[a:z] != pixels[a - distance : z - distance])
        if len(unequal):
            return size + int(unequal[0])
        size, step = z - at, 4 * step
    return size


def earlier(key: np.ndarray) -> np.ndarray:
    """Each place's nearest earlier place with the same key, or -1; only bits above those of a place's number are compared."""
    low = np.uint64((1 << len(key).bit_length()) - 1)
    whole = np.sort((key & ~low) | np.arange(len(key), dtype=np.uint64))
    place = (whole & low).astype(np.int64)
    same = np.flatnonzero((whole[1:] ^ whole[:-1]) <= low)
    out = np.full(len(key), -1)
    out[place[same + 1]] = place[same]
    return out


def references(pixels: np.ndarray, of: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(place, pixels, distance) of back-references in images one after the other.

    The nearest earlier three equal pixels of its image begin each. Places that follow each other at one distance
    are one run, which is looked at once.
    """
    if len(pixels) <= SHORTEST:
        return np.zeros((0, 3), np.int64)
    wide = pixels.astype(np.uint64)
    before = earlier(wide[:-2] * HASH[0] ^ wide[1:-1] * HASH[1] ^ wide[2:] * HASH[2])
    c = np.flatnonzero(before >= 0)
    c = c[(before[c] >= begin[of[c]]) & (c + 2 < end[of[c]])]
    p = before[c]
    c = c[(pixels[c] == pixels[p]) & (pixels[c + 1] == pixels[p + 1]) & (pixels[c + 2] == pixels[p + 2])]
    if not len(c):
        return np.zeros((0, 3), np.int64)
    distance = c - before[c]
    edge = np.flatnonzero((np.diff(c) != 1) | (np.diff(distance) != 0))
    first, stop = c[np.append(0, edge + 1)], c[np.append(edge, len(c) - 1)] + 1
    far, last = distance[np.append(0, edge + 1)], end[of[first]]
    after = np.minimum(stop + 2, len(pixels) - 1)
    more = (stop + 2 < last) & (pixels[after] == pixels[after - far])
    out, at = [], 0
    for a, z, d, goes_on, bound in zip(first.tolist(), stop.tolist(), far.tolist(), more.tolist(), last.tolist()):
        while at < z:
            at = max(at, a)
            size = z + 2 - at
            if goes_on and size < LONGEST_COPY:
                size += equal_run(pixels, z + 2, d, min(bound, at + LONGEST_COPY))
            size = min(size, LONGEST_COPY)
            out.append((at, size, d))
            at += size
    return np.array(out, np.int64)


def lengths_of_bits(values: np.ndarray) -> np.ndarray:
    """``bit_length`` of every number."""
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def amounts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths or distances as their prefix symbols, extra bits and how many those are."""
    v = values - 1
    top = np.maximum(lengths_of_bits(v) - 1, 0)
    extra = np.where(v < 4, 0, top - 1)
    return np.where(v < 4, v, 2 * top + (v >> extra & 1)), v & ((1 << extra) - 1), extra


@lru_cache(maxsize=64)
def short_codes(width: int) -> np.ndarray:
    """The short code of each small distance in rows of ``width`` pixels, or 0."""
    out = np.zeros(8 * width + 9, np.int64)
    for k, (dx, dy) in reversed(list(enumerate(near_offsets()))):
        out[max(1, dx + dy * width)] = k + 1
    return out


def distance_codes(distance: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The short codes of distances that have one, else the distances behind those codes."""
    out = distance + 120
    for w in np.unique(width).tolist():
        table = short_codes(w)
        k = np.flatnonzero((width == w) & (distance < len(table)))
        short = table[distance[k]]
        out[k[short > 0]] = short[short > 0]
    return out


def many_lengths(row: np.ndarray, counts: np.ndarray, rows: int, longest: int = MAX_BITS) -> np.ndarray:
    """``code_lengths`` of many codes at once: ``row`` (ascending) tells whose symbol each count is.

    Leaves by weight and inner nodes, which come about by weight, are two queues; one step joins two nodes of
    every code that isn't done.
    """
    size = np.bincount(row, minlength=rows)
    begin = np.cumsum(size) - size
    out, weights = np.ones(len(row), np.int64), counts.astype(np.int64)
    todo = np.flatnonzero(size > 1)
    while len(todo):
        todo = todo[np.argsort(-size[todo], kind="stable")]
        m = size[todo]
        of = np.repeat(np.arange(len(m)), m)
        within = np.arange(len(of)) - np.repeat(np.cumsum(m) - m, m)
        source = begin[todo][of] + within
        # equal weights stay in the order of their symbols
        key = np.sort(of << 44 | weights[source] << 10 | within)
        leaf = np.cumsum(m + 1) - m - 1
        inner = np.cumsum(m) - m + int(leaf[-1] + m[-1] + 1)
        weight = np.full(int(inner[-1] + m[-1]), np.iinfo(np.int64).max // 4)
        place = leaf[of] + within
        weight[place] = key >> 10 & (1 << 34) - 1
        parent, depth = np.zeros(len(weight), np.int64), np.zeros(len(weight), np.int64)
        steps = np.arange(int(m[0]) - 1)
        active = np.searchsorted(1 - m, -steps, side="left").tolist()
        next_leaf, next_inner = leaf.copy(), inner.copy()
        for t, n in enumerate(active):
            a, b, total = next_leaf[:n], next_inner[:n], 0
            for _ in range(2):
                x, y = weight[a], weight[b]
                is_leaf = x <= y
                parent[np.where(is_leaf, a, b)] = t
                total = total + np.minimum(x, y)
                a += is_leaf
                b += ~is_leaf
            weight[inner[:n] + t] = total
        for t, n in enumerate(active[1:], 1):
            node = inner[:n] + m[:n] - 2 - t
            depth[node] = depth[inner[:n] + parent[node]] + 1
        found = depth[inner[of] + parent[place]] + 1
        out[begin[todo][of] + (key & 1023)] = found
        over = np.maximum.reduceat(found, np.cumsum(m) - m) > longest
        for r in todo[over].tolist():  # flattened counts, as in ``code_lengths``
            own = weights[begin[r] : begin[r] + size[r]]
            weights[begin[r] : begin[r] + size[r]] = (own + 1) // 2 + int(own.sum()) // (1 << longest)
        todo = todo[over]
    return out


def many_codes(row: np.ndarray, length: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes of ``canonical`` for many codes' symbols: value with its first bit lowest, and length."""
    count = np.bincount(row, minlength=rows)
    begin = np.cumsum(count) - count
    key = np.sort(row << 16 | length << 10 | np.arange(len(row)) - begin[row])
    place, own = begin[row] + (key & 1023), key >> 10 & 63
    share = 1 << (LONGEST - own)
    code = np.cumsum(share) - share
    code = (code - code[begin][row]) >> (LONGEST - own)
    value, size = np.empty(len(row), np.int64), np.empty(len(row), np.int64)
    value[place], size[place] = MIRROR[code] >> (LONGEST - own), own
    single = count[row] == 1
    value[single] = size[single] = 0
    return value, size


def joined(parts: list[tuple[int, int]]) -> tuple[int, int]:
    """Parts of a stream as one."""
    out = BitWriter()
    for part in parts:
        out.write(*part)
    return out.value, out.at


#: Symbols of the codes for green, red, blue, alpha and distances at most, and where each begins in an image's table of codes.
ALPHABETS = np.array([GREEN + LENGTHS + (1 << CACHE_BITS), 256, 256, 256, DISTANCES])
TABLE_AT = np.cumsum(ALPHABETS) - ALPHABETS
#: The gaps of ``gap_parts``, each joined into one part, what stands before any code's lengths, and their codes.
GAP_VALUES, GAP_BITS = (np.array(x, np.uint64) for x in zip(*[joined(gap_parts(n)) for n in range(ALPHABETS[0] + 1)]))
HELPER_VALUE, HELPER_SIZE = joined(HELPER_PARTS)
LENGTH_VALUES = np.array([HELPER_CODES[n][0] for n in range(MAX_BITS + 1)], np.uint64)
LENGTH_BITS = HELPER_CODES[0][1]


def many_code_parts(
    row: np.ndarray, symbol: np.ndarray, length: np.ndarray, alphabet: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``code_parts`` of many codes: values, bits, and how many parts each code has."""
    count = np.bincount(row, minlength=len(alphabet))
    begin = np.cumsum(count) - count
    head = begin + 2 * np.arange(len(count))
    place = np.arange(len(row)) + 2 * row + 1
    value, bits = np.zeros(len(row) + 2 * len(count), np.uint64), np.zeros(len(row) + 2 * len(count), np.int64)
    value[head], bits[head] = HELPER_VALUE, HELPER_SIZE
    gap = symbol - 1 - np.append(-1, symbol[:-1])
    gap[begin] = symbol[begin]
    value[place] = GAP_VALUES[gap] | LENGTH_VALUES[length] << GAP_BITS[gap]
    bits[place] = GAP_BITS[gap].astype(np.int64) + LENGTH_BITS
    rest, last = alphabet - 1 - symbol[begin + count - 1], head + count + 1
    value[last], bits[last] = GAP_VALUES[rest], GAP_BITS[rest]
    # the simple form for one symbol
    simple = np.flatnonzero((count == 1) & (symbol[begin] < 256))
    only, at = symbol[begin[simple]], head[simple]
    value[at], bits[at] = np.where(only < 2, 1 | only << 3, 5 | only << 3).astype(np.uint64), np.where(only < 2, 4, 11)
    bits[at + 1] = bits[at + 2] = 0
    value[at + 1] = value[at + 2] = 0
    return value, bits, count + 2


def put(words: np.ndarray, at: np.ndarray, value: np.ndarray, bits: np.ndarray) -> None:
    """Values of up to 64 bits into 64-bit words from the given bit positions on, which ascend."""
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    words[word[first]] |= np.bitwise_or.reduceat(value << shift, first)
    over = np.flatnonzero((at & 63) + bits > 64)
    words[word[over] + 1] |= value[over] >> (np.uint64(64) - shift[over])


def streams_of(
    width: int, heights: np.ndarray, transforms: Sequence[list[tuple[int, int]]], images: Sequence[np.ndarray], across: np.ndarray
) -> list[bytes]:
    """VP8L streams of already transformed images, ``across`` pixels to a row each."""
    n, count = len(images), np.array([len(p) for p in images], np.int64)
    end, pixels = np.cumsum(count), np.concatenate(images)
    begin, of = end - count, np.repeat(np.arange(n), count)
    alpha = pixels[begin] >> 24
    if (pixels >> 24 != alpha[of]).any():
        raise ValueError("the encoder writes one alpha")
    copies, sizes, far = references(pixels, of, begin, end).T
    covered = np.zeros(len(pixels) + 1, np.int8)
    covered[copies] += 1
    covered[copies + sizes] -= 1
    literal = np.cumsum(covered[:-1], dtype=np.int8) == 0
    # the colour cache: the pixel before in each pixel's place, where that is the same one
    bits = np.where(count >= CACHED_PIXELS, np.minimum(CACHE_BITS, lengths_of_bits(count) - 2), 0)
    slot = (pixels * np.uint32(CACHE_MULTIPLIER)) >> (32 - np.maximum(bits, 1)).astype(np.uint32)[of]
    named = of << CACHE_BITS | slot
    before = earlier(named.astype(np.uint64) << np.uint64(len(pixels).bit_length()))
    hits = literal & (before >= 0) & (pixels[before] == pixels) & (bits > 0)[of]
    used = (np.bincount(named[hits], minlength=n << CACHE_BITS) > 0).reshape(n, -1).sum(axis=1)
    # a hit saves about 5 bits, and each symbol that is used costs about 6 in the prefix code
    pays = 5 * np.bincount(of[hits], minlength=n) > 6 * used + 40
    cached, bits = hits & pays[of], np.where(pays, bits, 0)
    # tokens: a literal, a place in the cache or a copy
    token = literal.copy()
    token[copies] = True
    places = np.flatnonzero(token)
    image, p = of[places], pixels[places]
    green = (p >> 8 & 255).astype(np.int64)
    from_cache = cached[places]
    green[from_cache] = GREEN + LENGTHS + slot[places[from_cache]]
    copy = np.flatnonzero(~literal[places])
    length, length_rest, length_bits = amounts(sizes)
    distance, distance_rest, distance_bits = amounts(distance_codes(far, across[of[copies]]))
    green[copy] = GREEN + length
    plain = np.flatnonzero(literal[places] & ~from_cache)
    red, blue = (p[plain] >> 16 & 255).astype(np.int64), (p[plain] & 255).astype(np.int64)
    # the symbols of the five codes of each image, with their counts
    rows, symbols, counts = [], [], []
    streams = ((image, green), (image[plain], red), (image[plain], blue), (np.arange(n), alpha.astype(np.int64)), (image[copy], distance))
    for k, (owner, symbol) in enumerate(streams):
        size = int(ALPHABETS[k])
        table = np.bincount(owner * size + symbol, minlength=n * size).reshape(n, size)
        table[~table.any(axis=1), 0] = 1
        row, symbol = np.nonzero(table)
        rows.append(5 * row + k)
        symbols.append(symbol)
        counts.append(table[row, symbol])
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    row, symbol, weight = row[order], np.concatenate(symbols)[order], np.concatenate(counts)[order]
    lengths = many_lengths(row, weight, 5 * n)
    value, size = many_codes(row, lengths, 5 * n)
    # value and length of every symbol's code, image by image
    table = np.zeros(n * int(ALPHABETS.sum()), np.int64)
    table[row // 5 * int(ALPHABETS.sum()) + TABLE_AT[row % 5] + symbol] = value << 8 | size
    base = image * int(ALPHABETS.sum())
    codes = np.zeros((len(places), 3), np.int64)
    codes[:, 0] = table[base + green]
    codes[plain, 1] = table[base[plain] + TABLE_AT[1] + red]
    codes[plain, 2] = table[base[plain] + TABLE_AT[2] + blue]
    codes[copy, 1] = length_rest << 8 | length_bits
    codes[copy, 2] = table[base[copy] + TABLE_AT[4] + distance]
    shift, codes = codes & 255, codes >> 8
    token_bits = shift.sum(axis=1)
    token_value = codes[:, 0] | codes[:, 1] << shift[:, 0] | codes[:, 2] << shift[:, 0] + shift[:, 1]
    token_value[copy] |= distance_rest << token_bits[copy]
    token_bits[copy] += distance_bits
    # the front of each stream, with the parts of its transforms
    fronts = [
        [(SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (0, 4), *parts, (0, 1), *([(1, 1), (b, 4)] if b else [(0, 1)]), (0, 1)]
        if parts
        else [(SIGNATURE | (width - 1) << 8 | (height - 1) << 22, 40), ((1 | b << 1) << 1 if b else 0, 7 if b else 3)]
        for height, parts, b in zip(heights.tolist(), transforms, bits.tolist())
    ]
    front = np.array(list(chain.from_iterable(chain.from_iterable(fronts))), np.int64)
    alphabet = np.tile(ALPHABETS, (n, 1))
    alphabet[:, 0] = GREEN + LENGTHS + np.where(bits > 0, 1 << bits, 0)
    code_value, code_bits, code_count = many_code_parts(row, symbol, lengths, alphabet.ravel())
    phases = (
        (front[::2].astype(np.uint64), front[1::2], np.array([len(f) for f in fronts])),
        (code_value, code_bits, code_count.reshape(n, 5).sum(axis=1)),
        (token_value.astype(np.uint64), token_bits, np.bincount(image, minlength=n)),
    )
    ends = [np.cumsum(b) for _, b, _ in phases]
    size = np.stack([np.diff(z[np.cumsum(c) - 1], prepend=0) for z, (_, _, c) in zip(ends, phases)])
    whole = size.sum(axis=0)
    room = (whole + 63) >> 6
    start = 64 * (np.cumsum(room) - room)
    words = np.zeros(int(room.sum()) + 2, np.uint64)
    for (v, b, c), z, own in zip(phases, ends, size):
        put(words, z - b + np.repeat(start - (z[np.cumsum(c) - 1] - own), c), v, b)
        start = start + own
    raw = words.astype("<u8", copy=False).tobytes()
    first = 8 * (np.cumsum(room) - room)
    return [raw[a:z] for a, z in zip(first.tolist(), (first + ((whole + 7) >> 3)).tolist())]


def encode_many(samples: list[np.ndarray], width: int) -> list[bytes]:
    """WebP files of 8-bit samples, three to a pixel (red, green, blue), ``width`` pixels to a row."""
    for s in samples:
        if not len(s) or len(s) % (3 * width) or not len(s) <= 3 * width * (1 << BLOCK_BITS) or width > 1 << BLOCK_BITS:
            raise ValueError("the samples don't fill the rows of one image of the encoder")
    out: list[bytes] = []
    bounds = np.cumsum([max(len(s) // 3, CACHED_PIXELS) for s in samples]) // TOGETHER
    for part in np.split(np.arange(len(samples)), np.flatnonzero(np.diff(bounds)) + 1) if samples else []:
        some = samples[part[0] : part[-1] + 1]
        transforms, images, across = zip(*transformed(Batch(some, width)))
        heights = np.array([len(s) // (3 * width) for s in some])
        out += [container(s) for s in streams_of(width, heights, transforms, images, np.array(across))]
    return out
