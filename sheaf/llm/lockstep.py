"""Many lossless WebP (VP8L) streams decoded in lock step with numpy.

All streams of a batch go through the format's phases together: transforms and their images, colour
cache, meta prefix codes, prefix codes, pixels, inverse transforms. In each phase one step moves every
stream that is in it by one symbol, so the cost of a step is shared by thousands of streams. Nothing of
the format is left out but prefix codes longer than ``BITS``; ``decode_each`` gives a stream that has one
to the plain decoder of ``webp``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from sheaf.llm import webp
from sheaf.llm.webp import CODE_LENGTH_ORDER, CROSS_COLOUR, DISTANCES, GREEN, LENGTHS, PALETTE, PREDICTOR, SUBTRACT_GREEN, Unsupported

#: Longest prefix code that one look-up decodes, and streams whose tables are made at once.
BITS, TABLE_ROWS = webp.MAX_BITS, 256
HELPER_BITS = 7
ENTRY = 12
SYMBOL = (1 << ENTRY) - 1


class Streams:
    """Bytes of many streams one after the other, with a bit position for each."""

    def __init__(self, streams: list[bytes]):
        raw = np.frombuffer(b"".join(streams) + bytes(16), np.uint8)
        self.words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
        sizes = np.array([len(s) for s in streams], np.int64)
        self.end = 8 * np.cumsum(sizes)
        self.at = self.end - 8 * sizes

    def peek(self, i: np.ndarray) -> np.ndarray:
        at = np.minimum(self.at[i], 8 * (len(self.words) - 1))
        return self.words[at >> 3] >> (at & 7).astype(np.uint64)

    def read(self, i: np.ndarray, n) -> np.ndarray:
        """The next n bits (one number, or one for each) of the streams i."""
        n = np.asarray(n, np.int64)
        got = self.peek(i) & ((np.uint64(1) << n.astype(np.uint64)) - np.uint64(1))
        self.at[i] += n
        return got.astype(np.int64)

    def check(self) -> None:
        if (self.at > self.end).any():
            raise ValueError("a stream ends early")


def tables(lengths: np.ndarray, bits: int) -> np.ndarray:
    """(codes, 2**bits) entries symbol | length << ENTRY, by the next bits of a stream."""
    out = np.empty((len(lengths), 1 << bits), np.uint16)
    mirror = webp.MIRROR[: 1 << bits] >> (webp.LONGEST - bits)
    for at in range(0, len(lengths), TABLE_ROWS):
        part = lengths[at : at + TABLE_ROWS]
        part = part[:, : np.flatnonzero(part.any(axis=0))[-1] + 1] if part.any() else part
        used = (part > 0).sum(axis=1)
        if (used == 0).any():
            raise ValueError("a prefix code has no symbol")
        single = used == 1
        out[at : at + TABLE_ROWS][single] = part[single].argmax(axis=1).astype(np.uint16)[:, None]
        several = np.flatnonzero(~single)
        if not len(several):
            continue
        part = part[several].astype(np.int64)
        order = np.argsort(np.where(part > 0, part, 99), axis=1, kind="stable")
        n = np.take_along_axis(part, order, 1)
        if n.max() > bits:
            raise Unsupported("a prefix code is longer than the tables")
        runs = np.where(n > 0, 1 << (bits - n), 0)
        if (runs.sum(axis=1) != 1 << bits).any():
            raise ValueError("a prefix code is not complete")
        natural = np.repeat((order | n << ENTRY).ravel(), runs.ravel()).reshape(len(several), -1)
        out[at + several] = natural[:, mirror]
    return out


def read_codes(bits: Streams, i: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """Code lengths (streams, symbols) of one prefix code of each of the streams i."""
    out = np.zeros((len(i), int(alphabet.max())), np.uint8)
    simple = bits.read(i, 1) == 1
    s = np.flatnonzero(simple)
    if len(s):
        two = bits.read(i[s], 1)
        wide = bits.read(i[s], 1)
        out[s, bits.read(i[s], np.where(wide, 8, 1))] = 1
        t = s[two == 1]
        out[t, bits.read(i[t], 8)] = 1
    r = np.flatnonzero(~simple)
    if not len(r):
        return out
    j, size = i[r], alphabet[r]
    given = 4 + bits.read(j, 4)
    helper = np.zeros((len(r), len(CODE_LENGTH_ORDER)), np.uint8)
    for k, symbol in enumerate(CODE_LENGTH_ORDER):
        on = np.flatnonzero(k < given)
        if not len(on):
            break
        helper[on, symbol] = bits.read(j[on], 3)
    table = tables(helper, HELPER_BITS)
    left = size.copy()
    on = np.flatnonzero(bits.read(j, 1))
    if len(on):
        left[on] = 2 + bits.read(j[on], 2 + 2 * bits.read(j[on], 3))
    place, last = np.zeros(len(r), np.int64), np.full(len(r), 8)
    active = np.flatnonzero(left > 0)
    while len(active):
        a = active
        entry = table[a, (bits.peek(j[a]) & np.uint64(127)).astype(np.int64)].astype(np.int64)
        symbol = entry & SYMBOL
        bits.at[j[a]] += entry >> ENTRY
        plain = symbol < 16
        p, s = a[plain], symbol[plain]
        out[r[p], place[p]] = s
        last[p] = np.where(s > 0, s, last[p])
        place[p] += 1
        q, s = a[~plain], symbol[~plain]
        if len(q):
            run = bits.read(j[q], np.where(s == 16, 2, np.where(s == 17, 3, 7))) + np.where(s == 18, 11, 3)
            if (place[q] + run > size[q]).any():
                raise ValueError("too many code lengths")
            again = s == 16
            if again.any():
                rows = np.repeat(q[again], run[again])
                within = np.arange(len(rows)) - np.repeat(np.cumsum(run[again]) - run[again], run[again])
                out[r[rows], place[rows] + within] = last[rows]
            place[q] += run
        left[a] -= 1
        active = a[(place[a] < size[a]) & (left[a] > 0)]
        if (bits.at[j[a]] > bits.end[j[a]]).any():
            raise ValueError("a stream ends early")
    return out


def read_amounts(bits: Streams, i: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Lengths or distances from their prefix symbols and extra bits."""
    extra = np.maximum((symbol - 2) >> 1, 0)
    base = np.where(symbol < 4, symbol, (2 + (symbol & 1)) << extra)
    return base + bits.read(i, extra) + 1


def shorts(widths: np.ndarray) -> np.ndarray:
    """Distances of the 120 short codes in images of the given widths."""
    near = np.array(webp.near_offsets())
    return np.maximum(1, near[None, :, 0] + near[None, :, 1] * widths[:, None])


def read_images(bits: Streams, i: np.ndarray, width: np.ndarray, height: np.ndarray, top: bool) -> list[np.ndarray]:
    """One entropy-coded image of each of the streams i; only top-level ones may have meta prefix codes."""
    n = len(i)
    cache_bits = np.zeros(n, np.int64)
    on = np.flatnonzero(bits.read(i, 1))
    cache_bits[on] = bits.read(i[on], 4)
    if (cache_bits > 11).any():
        raise ValueError("the colour cache is too large")
    groups, metas = np.ones(n, np.int64), np.zeros(0, np.int64)
    if top:
        metas = np.flatnonzero(bits.read(i, 1))
    if len(metas):
        block = bits.read(i[metas], 3) + 2
        across = (width[metas] + (1 << block) - 1) >> block
        images = read_images(bits, i[metas], across, (height[metas] + (1 << block) - 1) >> block, False)
        chosen = [((p >> 8) & 0xFFFF).astype(np.int64) for p in images]
        groups[metas] = [m.max() + 1 for m in chosen]
        meta_at = np.cumsum([0, *map(len, chosen)])[:-1]
        chosen = np.concatenate(chosen)
    first = np.cumsum(groups) - groups
    sizes = (GREEN + LENGTHS + np.where(cache_bits > 0, 1 << cache_bits, 0), *[np.full(n, x) for x in (256, 256, 256, DISTANCES)])
    code = [np.empty((int(groups.sum()), 1 << BITS), np.uint16) for _ in sizes]
    for g in range(int(groups.max())):
        on = np.flatnonzero(groups > g)
        for k, size in enumerate(sizes):
            code[k][first[on] + g] = tables(read_codes(bits, i[on], size[on]), BITS)
    green, red, blue, alpha, distance = [c.ravel() for c in code]

    # streams in the order of their pixels, so that those still at work are the first ones
    total = width * height
    order = np.argsort(-total, kind="stable")
    ends = np.cumsum(total[order])
    out = np.empty(int(ends[-1]), np.uint32)
    begin = ends - total[order]
    target, group = begin.copy(), first[order] << BITS
    number, wide = i[order], width[order]
    at = bits.at[number]
    left, back = np.zeros(n, np.int64), np.zeros(n, np.int64)
    short = shorts(np.unique(wide))
    short_row = np.searchsorted(np.unique(wide), wide)
    size = np.where(cache_bits > 0, 1 << cache_bits, 0)[order]
    caching = bool(size.any())
    row = int(size.max()) if caching else 0
    cache = np.zeros(n * max(1, row), np.uint32)
    cache_row, shift = np.arange(n) * row, (32 - np.where(size > 0, cache_bits[order], 1)).astype(np.uint32)
    meta_of = np.full(n, -1)
    meta_of[metas] = np.arange(len(metas))
    with_meta = np.flatnonzero(meta_of[order] >= 0)
    mask, limit = np.uint64((1 << BITS) - 1), 8 * (len(bits.words) - 1)
    plain_alpha = None  # where every stream has one alpha throughout, it is looked up once
    if not len(with_meta) and (code[3] == code[3][:, :1]).all():
        plain_alpha = (code[3][first[order], 0] & SYMBOL).astype(np.uint32) << 24
    active = np.searchsorted(-total[order], -np.arange(1, int(total.max()) + 1), side="right")
    for t, n in enumerate(active.tolist()):
        if len(with_meta):
            m = with_meta[with_meta < n]
            k = meta_of[order[m]]
            b = block[k]
            group[m] = (first[order[m]] + chosen[meta_at[k] + (t // wide[m] >> b) * across[k] + (t % wide[m] >> b)]) << BITS
        place, base = np.minimum(at[:n], limit), group[:n]
        w = bits.words[place >> 3] >> (place & 7).astype(np.uint64)
        entry = green[base + (w & mask).view(np.int64)]
        symbol, used = (entry & SYMBOL).astype(np.int64), entry >> ENTRY
        fresh = left[:n] == 0
        literal = fresh & (symbol < GREEN)
        w >>= used
        r = red[base + (w & mask).view(np.int64)]
        w >>= r >> ENTRY
        b = blue[base + (w & mask).view(np.int64)]
        if plain_alpha is None:
            w >>= b >> ENTRY
            a = alpha[base + (w & mask).view(np.int64)]
            far_alpha, alpha_bits = (a & SYMBOL).astype(np.uint32) << 24, a >> ENTRY
        else:
            far_alpha, alpha_bits = plain_alpha[:n], 0
        pixel = symbol.astype(np.uint32) << 8
        pixel |= far_alpha
        pixel |= (r & SYMBOL).astype(np.uint32) << 16
        pixel |= b & SYMBOL
        took = np.where(literal, used + (r >> ENTRY) + (b >> ENTRY) + alpha_bits, 0).astype(np.int64)
        other = np.flatnonzero(~literal)
        if len(other):
            begun = other[fresh[other] & (symbol[other] < GREEN + LENGTHS)]
            if len(begun):
                bits.at[number[begun]] = at[begun] + used[begun]
                left[begun] = read_amounts(bits, number[begun], symbol[begun] - GREEN)
                window = (bits.peek(number[begun]) & mask).astype(np.int64)
                entry = distance[group[begun] + window].astype(np.int64)
                bits.at[number[begun]] += entry >> ENTRY
                far = read_amounts(bits, number[begun], entry & SYMBOL)
                back[begun] = np.where(far > 120, far - 120, short[short_row[begun], np.minimum(far, 120) - 1])
                at[begun] = bits.at[number[begun]]
                if (back[begun] > t).any() or (t + left[begun] > total[order[begun]]).any():
                    raise ValueError("a back-reference leaves the image")
            cached = other[fresh[other] & (symbol[other] >= GREEN + LENGTHS)]
            if len(cached):
                pixel[cached] = cache[cache_row[cached] + symbol[cached] - GREEN - LENGTHS]
                took[cached] = used[cached]
            copying = other[left[other] > 0]
            pixel[copying] = out[target[copying] - back[copying]]
            left[copying] -= 1
        at[:n] += took
        out[target[:n]] = pixel
        target[:n] += 1
        if caching:
            slot = (pixel * np.uint32(webp.CACHE_MULTIPLIER)) >> shift[:n]
            has = size[:n] > 0
            cache[(cache_row[:n] + slot)[has]] = pixel[has]
    bits.at[number] = at
    bits.check()
    images: list[np.ndarray] = [out[:0]] * len(order)
    for k, a, z in zip(order.tolist(), begin.tolist(), ends.tolist()):
        images[k] = out[a:z]
    return images


def undo_predictors(images: list[np.ndarray], modes: list[np.ndarray], blocks: list[int]) -> list[np.ndarray]:
    """The predictor inverted in many (height, width) images, a pixel of each at a time."""
    sizes = np.array([p.size for p in images])
    order = np.argsort(-sizes, kind="stable")
    images, modes = [images[k] for k in order], [modes[k] for k in order]
    wide, block = np.array([p.shape[1] for p in images]), np.array([blocks[k] for k in order])
    flat = np.concatenate([webp.channels(p).reshape(-1, 4) for p in images]).astype(np.int16)
    begin = np.cumsum(sizes[order]) - sizes[order]
    mode_at, across = np.cumsum([0, *[m.size for m in modes]])[:-1], np.array([m.shape[1] for m in modes])
    every_mode = np.concatenate([(m >> 8 & 15).ravel() for m in modes]).astype(np.int64)
    active = np.searchsorted(-sizes[order], -np.arange(1, int(sizes.max()) + 1), side="right")
    for t, n in enumerate(active.tolist()):
        x, y, at = t % wide[:n], t // wide[:n], begin[:n] + t
        mode = every_mode[mode_at[:n] + (y >> block[:n]) * across[:n] + (x >> block[:n])]
        mode = np.where(y == 0, 0 if t == 0 else 1, np.where(x == 0, 2, mode))
        for m in np.unique(mode):
            k = np.flatnonzero(mode == m)
            near = [flat[np.maximum(at[k] - d, 0)] for d in (1, wide[k], wide[k] - 1, wide[k] + 1)]
            flat[at[k]] = (flat[at[k]] + webp.predict(int(m), *near)) & 255
    done = flat.astype(np.uint8).view("<u4").ravel()
    out: list[np.ndarray] = [done] * len(order)
    for k, a, p in zip(order.tolist(), begin.tolist(), images):
        out[k] = done[a : a + p.size].reshape(p.shape)
    return out


def decode_batch(streams: list[bytes]) -> list[np.ndarray]:
    """(height, width) arrays of ARGB pixels."""
    bits, every = Streams(streams), np.arange(len(streams))
    if (bits.read(every, 8) != webp.SIGNATURE).any():
        raise ValueError("not a lossless stream")
    width, height = bits.read(every, 14) + 1, bits.read(every, 14) + 1
    bits.read(every, 1)
    if bits.read(every, 3).any():
        raise ValueError("unknown version")
    inner, seen = width.copy(), np.zeros(len(streams), np.int64)
    undo: list[list[tuple]] = [[] for _ in streams]
    going = every[bits.read(every, 1) == 1]
    while len(going):
        kind = bits.read(going, 2)
        if (seen[going] >> kind & 1).any():
            raise ValueError("a transform is repeated")
        seen[going] |= 1 << kind
        for k in (PREDICTOR, CROSS_COLOUR):
            i = going[kind == k]
            if len(i):
                block = bits.read(i, 3) + 2
                w, h = (inner[i] + (1 << block) - 1) >> block, (height[i] + (1 << block) - 1) >> block
                for s, b, x, y, data in zip(i.tolist(), block.tolist(), w.tolist(), h.tolist(), read_images(bits, i, w, h, False)):
                    undo[s].append((k, data.reshape(y, x), b))
        for s in going[kind == SUBTRACT_GREEN].tolist():
            undo[s].append((SUBTRACT_GREEN, None, 0))
        i = going[kind == PALETTE]
        if len(i):
            n = bits.read(i, 8) + 1
            bundle = np.select([n <= 2, n <= 4, n <= 16], [3, 2, 1], 0)
            for s, b, data in zip(i.tolist(), bundle.tolist(), read_images(bits, i, n, np.ones_like(n), False)):
                steps = webp.channels(data.reshape(1, -1))
                palette = np.cumsum(steps, axis=1, dtype=np.uint8).view("<u4").ravel()
                undo[s].append((PALETTE, (palette, int(inner[s])), b))
            inner[i] = (inner[i] + (1 << bundle) - 1) >> bundle
        going = going[bits.read(going, 1) == 1]
    pixels = [p.reshape(h, w) for p, h, w in zip(read_images(bits, every, inner, height, True), height.tolist(), inner.tolist())]
    while True:
        last = [u.pop() if u else None for u in undo]
        if not any(last):
            return pixels
        predicted = [s for s, u in enumerate(last) if u and u[0] == PREDICTOR]
        if predicted:
            done = undo_predictors([pixels[s] for s in predicted], [last[s][1] for s in predicted], [last[s][2] for s in predicted])
            for s, p in zip(predicted, done):
                pixels[s] = p
        for s, u in enumerate(last):
            if not u or u[0] == PREDICTOR:
                continue
            kind, data, n = u
            if kind == CROSS_COLOUR:
                pixels[s] = webp.undo_cross_colour(pixels[s], data, n)
            elif kind == SUBTRACT_GREEN:
                pixels[s] = webp.undo_subtract_green(pixels[s])
            else:
                pixels[s] = webp.undo_palette(pixels[s], data[0], data[1], n)


def _decoded(streams: list[bytes]) -> list[np.ndarray]:
    """A batch with a stream that lock step can't read is halved until that stream is alone."""
    try:
        return decode_batch(streams)
    except Unsupported:
        if len(streams) == 1:
            return [webp.decode(streams[0])]
        half = len(streams) // 2
        return _decoded(streams[:half]) + _decoded(streams[half:])


def decode_each(streams: list[bytes], together: int = 2048) -> Iterator[np.ndarray]:
    """ARGB arrays of many streams, in turn."""
    for at in range(0, len(streams), together):
        yield from _decoded(streams[at : at + together])
