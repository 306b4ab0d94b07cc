"""Lossless WebP: a full decoder to pixel arrays, and a writer with prefix codes, back-references, a colour cache and a palette.

Pixels are arrays (height, width, 4) of 8-bit samples in the order green, red, blue, alpha, as they stand in the stream.
"""

from __future__ import annotations

from array import array

import numpy as np

SIGNATURE = 0x2F
GREEN, RED, BLUE, ALPHA = range(4)

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: (x, y) of the 120 short distance codes.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD
ALPHABETS = (256 + 24, 256, 256, 256, 40)


class BitWriter:
    def __init__(self) -> None:
        self.value, self.n = 0, 0

    def put(self, value: int, bits: int) -> None:
        self.value |= value << self.n
        self.n += bits

    def bits(self) -> np.ndarray:
        raw = np.frombuffer(self.value.to_bytes((self.n + 7) // 8, "little"), np.uint8)
        return np.unpackbits(raw, bitorder="little")[: self.n]


class BitReader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def peek(self, bits: int) -> int:
        first = self.at >> 3
        return (int.from_bytes(self.data[first : first + 8], "little") >> (self.at & 7)) & ((1 << bits) - 1)

    def span(self, start: int, bits: int) -> int:
        first = start >> 3
        return (int.from_bytes(self.data[first : first + (bits + 15) // 8], "little") >> (start & 7)) & ((1 << bits) - 1)

    def get(self, bits: int) -> int:
        value = self.peek(bits)
        self.at += bits
        if self.at > len(self.data) * 8:
            raise ValueError("the stream ends early")
        return value


def _backwards(bits: int) -> np.ndarray:
    """All numbers of so many bits, each with its bits in reverse."""
    out = np.zeros(1, np.int64)
    for _ in range(bits):
        out = np.concatenate([out * 2, out * 2 + 1])
    return out


_BACKWARDS = [_backwards(n) for n in range(16)]


def assign(lengths: list[int] | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code, first bit lowest, and length of each symbol of a prefix code; a single symbol has no bits."""
    lengths = np.asarray(lengths)
    codes, sizes = np.zeros(len(lengths), np.uint64), np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    if len(used) > 1:
        used = used[np.argsort(lengths[used], kind="stable")]
        longest = int(lengths[used[-1]])
        shares = 1 << (longest - lengths[used])
        if shares.sum() != 1 << longest:
            raise ValueError("prefix code isn't complete")
        codes[used], sizes[used] = _BACKWARDS[longest][np.cumsum(shares) - shares], lengths[used]
    return codes, sizes


def canonical(lengths: list[int] | np.ndarray) -> list[tuple[int, int, int]]:
    """(symbol, length, code with its first bit lowest) of the symbols in use."""
    codes, sizes = assign(lengths)
    return [(int(s), int(sizes[s]), int(codes[s])) for s in np.flatnonzero(lengths)]


class PrefixCode:
    """``entries[bits]`` is ``symbol << 4 | length`` of the code that the next ``longest`` bits begin with."""

    def __init__(self, lengths: list[int] | np.ndarray) -> None:
        lengths = np.asarray(lengths)
        used = np.flatnonzero(lengths)
        if len(used) < 2:
            self.longest, self.table = 0, (used[:1] if len(used) else np.zeros(1, np.int64)) << 4
        else:
            used = used[np.argsort(lengths[used], kind="stable")]
            sizes = lengths[used]
            self.longest = int(sizes[-1])
            shares = 1 << (self.longest - sizes)
            if shares.sum() != 1 << self.longest:
                raise ValueError("prefix code isn't complete")
            self.table = np.repeat(used << 4 | sizes, shares)[_BACKWARDS[self.longest]]
        self.mask = (1 << self.longest) - 1

    def read(self, r: BitReader) -> int:
        entry = int(self.table[r.peek(self.longest)])
        r.get(entry & 15)
        return entry >> 4


class Group:
    """The codes of a pixel's channels and of distances.

    ``lists`` has for green, red, blue and alpha the entries ``sample << place in the pixel << 6 | length``, so that those of a
    literal add up to its pixel and its length; entries of other green symbols are ``~(symbol << 6 | length)``.
    """

    def __init__(self, codes: list[PrefixCode]) -> None:
        self.lists: list[list[int]] = []
        self.masks = [c.mask for c in codes[:4]]
        self.distance = codes[4]
        self.wide = sum(c.longest for c in codes[:4]) > 57
        for code, place in zip(codes, (8, 16, 0, 24), strict=False):
            symbols, sizes = code.table >> 4, code.table & 15
            entries = symbols << (place + 6) | sizes
            self.lists.append((entries if self.lists else np.where(symbols < 256, entries, ~(symbols << 6 | sizes))).tolist())


#: Groups read lately: (alphabet sizes, bits, their value, group).
_groups: list[tuple[tuple[int, ...], int, int, Group]] = []


def read_group(r: BitReader, sizes: tuple[int, ...]) -> Group:
    """The prefix codes of a group; the same bits read again give the codes read before."""
    for known, n, value, group in _groups:
        if known == sizes and r.span(r.at, n) == value:
            r.get(0)
            r.at += n
            return group
    start = r.at
    codes: list[PrefixCode] = []
    for i, symbols in enumerate(sizes):
        if codes and symbols == sizes[i - 1] and r.span(r.at, n) == bits:
            r.at += n
            codes.append(codes[-1])
            continue
        first = r.at
        codes.append(read_code(r, symbols))
        n = r.at - first
        bits = r.span(first, n)
    group = Group(codes)
    _groups.insert(0, (sizes, r.at - start, r.span(start, r.at - start), group))
    del _groups[4:]
    return group


def read_code(r: BitReader, symbols: int) -> PrefixCode:
    lengths = [0] * symbols
    if r.get(1):
        count = r.get(1) + 1
        lengths[r.get(8 if r.get(1) else 1)] = 1
        if count == 2:
            lengths[r.get(8)] = 1
        return PrefixCode(lengths)
    of_lengths = [0] * 19
    for place in CODE_LENGTH_ORDER[: 4 + r.get(4)]:
        of_lengths[place] = r.get(3)
    code = PrefixCode(of_lengths)
    left = 2 + r.get(2 + 2 * r.get(3)) if r.get(1) else symbols
    entries, mask, data, place = code.table.tolist(), code.mask, r.data, r.at
    at, before = 0, 8
    while at < symbols and left:
        left -= 1
        x = int.from_bytes(data[place >> 3 : (place >> 3) + 4], "little") >> (place & 7)
        entry = entries[x & mask]
        n, s = entry & 15, entry >> 4
        place += n
        if s < 16:
            lengths[at] = s
            at += 1
            before = s or before
            continue
        bits, least = ((2, 3), (3, 3), (7, 11))[s - 16]
        times = least + (x >> n & ((1 << bits) - 1))
        place += bits
        if at + times > symbols:
            raise ValueError("code lengths run over")
        if s == 16:
            lengths[at : at + times] = [before] * times
        at += times
    r.at = place
    r.get(0)
    return PrefixCode(lengths)


def _extra(r: BitReader, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    bits = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << bits) + r.get(bits) + 1


def read_image(r: BitReader, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image; only the main one may have several groups of prefix codes."""
    cache_bits = r.get(4) if r.get(1) else 0
    groups, place, shift = 1, None, 0
    if main and r.get(1):
        shift = r.get(3) + 2
        meta = read_image(r, (width + (1 << shift) - 1) >> shift, (height + (1 << shift) - 1) >> shift, False)
        place = meta[:, :, RED].astype(int) << 8 | meta[:, :, GREEN]
        groups = int(place.max()) + 1
    cache = 1 << cache_bits if cache_bits else 0
    sizes = (ALPHABETS[0] + cache, *ALPHABETS[1:])
    codes = [read_group(r, sizes) for _ in range(groups)]
    return _read_pixels(r, codes, place, shift, width, height, cache_bits)


def cache_slots(argb: np.ndarray, cache_bits: int) -> np.ndarray:
    return (argb.astype(np.uint64) * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits)


#: Bytes of the stream that are laid out at once.
BLOCK = 1 << 14


def _windows(data: bytes, first: int, wide: bool) -> list[int]:
    """The next 8 bytes, or 9 where codes may need them, from each byte of a block on."""
    block = data[first : first + BLOCK + 9]
    block += bytes(min(BLOCK, len(block) + 9) + 9 - len(block))
    if wide:
        return [int.from_bytes(block[i : i + 9], "little") for i in range(len(block) - 9)]
    return np.ndarray(len(block) - 9, "<u8", block, 0, (1,)).tolist()


def _read_pixels(r: BitReader, groups: list[Group], place: np.ndarray | None, shift: int, width: int, height: int, cache_bits: int) -> np.ndarray:
    """Literals, cache symbols and copies, symbol by symbol; ``place`` has the group of each block of the image."""
    n, data, p = width * height, r.data, r.at
    pixels = array("I", bytes(4 * n))  # alpha, red, green, blue from the highest byte, as the colour cache hashes them
    held, down = [0] * (1 << cache_bits), 32 - cache_bits
    limit = at = noted = 0
    wide = any(g.wide for g in groups)
    while at < n:
        group, end = groups[0], n
        if place is not None:
            y, x = divmod(at, width)
            group, end = groups[place[y >> shift, x >> shift]], y * width + min(width, ((x >> shift) + 1) << shift)
        (greens, reds, blues, alphas), (mask_g, mask_r, mask_b, mask_a) = group.lists, group.masks
        while at < end:
            if p >= limit:
                if p > len(data) * 8:
                    raise ValueError("the stream ends early")
                origin = p >> 3 << 3
                ahead = _windows(data, p >> 3, wide)
                limit = origin + 8 * len(ahead)
            x = ahead[p - origin >> 3] >> (p & 7)
            g = greens[x & mask_g]
            if g >= 0:
                x >>= g & 63
                red = reds[x & mask_r]
                x >>= red & 63
                b = blues[x & mask_b]
                g += red + b + alphas[x >> (b & 63) & mask_a]
                p += g & 63
                pixels[at] = g >> 6
                at += 1
                continue
            s, p = ~g >> 6, p + (~g & 63)
            if s >= 280:
                for x in pixels[noted:at]:
                    held[(CACHE_FACTOR * x & 0xFFFFFFFF) >> down] = x
                noted = at
                pixels[at] = held[s - 280]
                at += 1
                continue
            r.at = p
            length = _extra(r, s - 256)
            distance = _extra(r, group.distance.read(r))
            p = r.at
            if distance > 120:
                distance -= 120
            else:
                across, up = NEAR[distance - 1]
                distance = max(1, across + up * width)
            if distance > at or at + length > n:
                raise ValueError("a back-reference points outside")
            while length:  # doubles what is there if it overlaps
                part = min(length, distance)
                pixels[at : at + part] = pixels[at - distance : at - distance + part]
                at, length = at + part, length - part
    r.at = p
    r.get(0)
    return np.frombuffer(pixels, np.uint8).reshape(height, width, 4)[:, :, [1, 2, 0, 3]]


def _average(a: list[int], b: list[int]) -> list[int]:
    return [(x + y) >> 1 for x, y in zip(a, b, strict=True)]


def _clamp(x: int) -> int:
    return 0 if x < 0 else 255 if x > 255 else x


def predict(mode: int, left: list[int], top: list[int], top_left: list[int], top_right: list[int]) -> list[int]:
    if mode == 0 or mode > 13:
        return [0, 0, 0, 255]
    if mode <= 4:
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return _average(_average(left, top_right), top)
    if mode <= 9:
        return _average(*((left, top_left), (left, top), (top_left, top), (top, top_right))[mode - 6])
    if mode == 10:
        return _average(_average(left, top_left), _average(top, top_right))
    if mode == 11:
        to_left = sum(abs(t - tl) for t, tl in zip(top, top_left, strict=True))
        to_top = sum(abs(x - tl) for x, tl in zip(left, top_left, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return [_clamp(x + t - tl) for x, t, tl in zip(left, top, top_left, strict=True)]
    return [_clamp(m + int((m - tl) / 2)) for m, tl in zip(_average(left, top), top_left, strict=True)]


def undo_predictor(pixels: np.ndarray, modes: np.ndarray, shift: int) -> np.ndarray:
    height, width, _ = pixels.shape
    rows = pixels.tolist()
    black = [0, 0, 0, 255]
    for y, row in enumerate(rows):
        above = rows[y - 1] if y else None
        for x, p in enumerate(row):
            if not y:
                guess = row[x - 1] if x else black
            elif not x:
                guess = above[0]
            else:
                guess = predict(int(modes[y >> shift, x >> shift, GREEN]), row[x - 1], above[x], above[x - 1], above[x + 1] if x + 1 < width else row[0])
            row[x] = [(a + b) & 255 for a, b in zip(p, guess, strict=True)]
    return np.array(rows, np.uint8).reshape(height, width, 4)


def undo_cross_colour(pixels: np.ndarray, elements: np.ndarray, shift: int) -> np.ndarray:
    height, width, _ = pixels.shape
    e = elements[np.arange(height)[:, None] >> shift, np.arange(width) >> shift].view(np.int8).astype(np.int32)
    signed = lambda v: v.astype(np.uint8).view(np.int8).astype(np.int32)
    green = signed(pixels[:, :, GREEN])
    out = pixels.copy()
    red = pixels[:, :, RED].astype(np.int32) + (e[:, :, BLUE] * green >> 5)
    blue = pixels[:, :, BLUE].astype(np.int32) + (e[:, :, GREEN] * green >> 5) + (e[:, :, RED] * signed(red & 255) >> 5)
    out[:, :, RED], out[:, :, BLUE] = red & 255, blue & 255
    return out


def undo_palette(pixels: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    per = 8 if len(table) <= 2 else 4 if len(table) <= 4 else 2 if len(table) <= 16 else 1
    bits = 8 // per
    x = np.arange(width)
    index = pixels[:, x // per, GREEN] >> (x % per * bits).astype(np.uint8) & ((1 << bits) - 1)
    full = np.zeros((256, 4), np.uint8)
    full[: len(table)] = table
    return full[index]


def decode(data: bytes) -> np.ndarray:
    """The pixels of a WebP file with a lossless image."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at, end = 12, min(len(data), 8 + int.from_bytes(data[4:8], "little"))
    while data[at : at + 4] != b"VP8L":
        if at + 8 > end:
            raise ValueError("no lossless image")
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        at += 8 + size + (size & 1)
    r = BitReader(data[at + 8 : at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")])
    if r.get(8) != SIGNATURE:
        raise ValueError("wrong signature")
    width, height, has_alpha = r.get(14) + 1, r.get(14) + 1, r.get(1)
    if r.get(3):
        raise ValueError("unknown version")
    full, undo = width, []
    while r.get(1):
        kind = r.get(2)
        if kind == 2:
            undo.append((kind, None, 0, width))
        elif kind == 3:
            count = r.get(8) + 1
            table = np.cumsum(read_image(r, count, 1, False)[0].astype(int), axis=0).astype(np.uint8)
            undo.append((kind, table, 0, width))
            per = 8 if count <= 2 else 4 if count <= 4 else 2 if count <= 16 else 1
            width = (width + per - 1) // per
        else:
            shift = r.get(3) + 2
            side = (1 << shift) - 1
            undo.append((kind, read_image(r, (width + side) >> shift, (height + side) >> shift, False), shift, width))
    pixels = read_image(r, width, height, True)
    for kind, what, shift, wide in reversed(undo):
        if kind == 0:
            pixels = undo_predictor(pixels, what, shift)
        elif kind == 1:
            pixels = undo_cross_colour(pixels, what, shift)
        elif kind == 2:
            pixels = pixels.copy()
            pixels[:, :, RED] += pixels[:, :, GREEN]
            pixels[:, :, BLUE] += pixels[:, :, GREEN]
        else:
            pixels = undo_palette(pixels, what, wide)
    assert pixels.shape[1] == full
    if not has_alpha:
        pixels = pixels.copy()
        pixels[:, :, ALPHA] = 255
    return pixels


def choose_lengths(counts: np.ndarray, longest: int) -> np.ndarray:
    """Lengths, at most ``longest``, of a complete prefix code for symbols of these counts.

    Each length is the logarithm of a smoothed share, rounded up; what that leaves of the code space goes to the frequent
    symbols first.
    """
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) < 3:
        out[used] = 1
        return out
    used = used[np.argsort(-counts[used], kind="stable")]
    weight = counts[used] + counts.sum() / (1 << (longest - 1))
    sizes = np.maximum(1, np.ceil(np.log2(weight.sum() / weight))).astype(np.int64)
    shares = 1 << (longest - sizes)
    free = (1 << longest) - int(shares.sum())
    sizes, shares = sizes.tolist(), shares.tolist()
    while free:
        for i, share in enumerate(shares):
            if share <= free and sizes[i] > 1:
                sizes[i] -= 1
                shares[i] *= 2
                free -= share
                if not free:
                    break
    out[used] = sizes
    return out


def _runs(lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """(symbol, extra, bits of it) of the code of code lengths for these."""
    out = []
    first = np.flatnonzero(np.diff(lengths, prepend=-1))
    for n, times in zip(lengths[first].tolist(), np.diff(first, append=len(lengths)).tolist(), strict=True):
        if n:
            out.append((n, 0, 0))
            times -= 1
        while times >= 3:
            part = min(times, 6 if n else 138)
            out.append((16, part - 3, 2) if n else (17, part - 3, 3) if part < 11 else (18, part - 11, 7))
            times -= part
        out += [(n, 0, 0)] * times
    return out


def put_lengths(w: BitWriter, lengths: list[int] | np.ndarray) -> None:
    """Write the code lengths of an alphabet."""
    used = np.flatnonzero(lengths).tolist()
    if len(used) <= 2 and (not used or used[-1] < 256):
        used = used or [0]
        w.put(1, 1)
        w.put(len(used) - 1, 1)
        w.put(1, 1)
        for s in used:
            w.put(s, 8)
        return
    runs = _runs(np.asarray(lengths)[: used[-1] + 1])
    of_lengths = choose_lengths(np.bincount([s for s, _, _ in runs], minlength=19), 7)
    codes, sizes = (x.tolist() for x in assign(of_lengths))
    value, n = 15 << 1, 5
    of_lengths = of_lengths.tolist()
    for place in CODE_LENGTH_ORDER:
        value |= of_lengths[place] << n
        n += 3
    count = len(runs) - 2
    bits = max(2, count.bit_length())
    bits += bits & 1
    value |= (1 | (bits - 2) // 2 << 1 | count << 4) << n
    n += 4 + bits
    w.put(value, n)
    value = n = 0
    for s, extra, bits in runs:
        value |= (codes[s] | extra << sizes[s]) << n
        n += sizes[s] + bits
    w.put(value, n)


def container(bits: np.ndarray) -> bytes:
    """A WebP file around the bits of a lossless image."""
    body = np.packbits(bits, bitorder="little").tobytes()
    chunk = b"VP8L" + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) & 1)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


def put_size(w: BitWriter, width: int, height: int, alpha: bool = True) -> None:
    w.put(SIGNATURE, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(int(alpha), 1)
    w.put(0, 3)


def _prefix(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, extra bits and their number of lengths or distances."""
    x = values - 1
    high = np.log2(np.maximum(x, 1)).astype(np.int64)
    bits = np.where(x < 4, 0, high - 1)
    return np.where(x < 4, x, 2 * high + (x >> np.maximum(high - 1, 0) & 1)), x & ((1 << bits) - 1), bits


def _last_like(keys: np.ndarray) -> np.ndarray:
    """For each place the last place before it with the same key, or -1."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.full(len(keys), -1, np.int64)
    out[order[1:][same]] = order[:-1][same]
    return out


#: The longest copy, and the farthest that a distance reaches beyond the short codes.
LONGEST, FARTHEST = 4096, (1 << 20) - 120


def _pack(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bits of values of up to 63 bits each, one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1])
    starts = ends - sizes
    word, shift = (starts >> np.uint64(6)).astype(np.int64), starts & np.uint64(63)
    out = np.zeros(total // 64 + 2, np.uint64)
    first = np.append(0, np.flatnonzero(word[1:] != word[:-1]) + 1)
    out[word[first]] = np.bitwise_or.reduceat(values << shift, first)
    over = np.flatnonzero(shift + sizes > 64)
    out[word[over] + 1] |= values[over] >> (np.uint64(64) - shift[over])
    return np.unpackbits(out.view(np.uint8), bitorder="little", count=total)


#: Bytes of text, the commoner first, for the standing codes.
COMMON = b" etaoinsrhldcumfpgwybv\xff.,k\n-TASxICMjBPqDNzRLEFHWGO0123456789'\"()"


class Codes:
    """The codes of a group, and the bits that tell them."""

    def __init__(self, cache_bits: int, main: bool, *counts: np.ndarray) -> None:
        self.cache_bits = cache_bits
        lengths = [choose_lengths(c, longest) for c, longest in zip(counts, (11, 10, 10), strict=True)]
        self.green, self.other, self.back = map(assign, lengths)
        w = BitWriter()
        w.put(int(cache_bits > 0), 1)
        if cache_bits:
            w.put(cache_bits, 4)
        if main:
            w.put(0, 1)
        for i in (0, 1, 1, 1, 2):
            put_lengths(w, lengths[i])
        self.bits = w.bits()


_standing: list[Codes] = []


def standing_codes() -> Codes:
    """Codes for images too small to pay for their own, by a rule: a text's bytes by rank, then copies and cached pixels."""
    if not _standing:
        other = np.ones(256, np.int64)
        other[list(COMMON)] = [int(2000 * 0.92**i) + 8 for i in range(len(COMMON))]
        share = int(other.sum())
        green = np.concatenate([other, [share // 100] * 12, [1] * 12, [share // 1280] * 256])
        _standing.append(Codes(8, True, green, other, np.array([1, 9, *[1] * 12, *[16] * 12, *[1] * 14])))
    return _standing[0]


#: Images of fewer pixels, and without a palette, use the standing codes.
SMALL = 4096


def _image_bits(pixels: np.ndarray, main: bool, small: bool = False) -> list[np.ndarray]:
    """An entropy-coded image of pixels held as green, red, blue, alpha from the lowest byte.

    Two or more pixels that stand at one distance from their last like are copied; of the others, those that the colour
    cache holds are cache symbols where that saves more than the symbols cost; the rest are literals.  A small image has
    the standing codes.
    """
    n = len(pixels)
    pairs = pixels[:-1].astype(np.uint64) << np.uint64(32) | pixels[1:]
    distance = np.append(np.arange(n - 1) - _last_like(pairs), 0)
    distance[distance > np.arange(n)] = 0  # a pair that wasn't there before
    starts = np.append(0, np.flatnonzero(distance[1:] != distance[:-1]) + 1)
    apart = distance[starts]
    starts += (apart == 0) & (starts > 0)  # the last pair of the run before ends a pixel later
    lengths = np.append(starts[1:], n) - starts
    keep = (apart > 0) & (apart <= FARTHEST) & (lengths > 1)
    copied = np.repeat(keep, lengths)
    parts = -(-lengths[keep] // LONGEST)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = np.repeat(starts[keep], parts) + nth * LONGEST
    length = np.minimum(np.repeat(lengths[keep], parts) - nth * LONGEST, LONGEST)
    cache_bits = 8 if small else 9
    argb = (pixels & 0xFF000000) | (pixels >> 8 & 255) << 16 | (pixels & 255) << 8 | (pixels >> 16 & 255)
    slots = cache_slots(argb, cache_bits).astype(np.int64)
    held = _last_like(slots)
    hit = (held >= 0) & (pixels[held] == pixels) & ~copied
    if not small and 12 * hit.sum() <= 8 * len(np.unique(slots[hit])):
        cache_bits, hit = 0, np.zeros(n, bool)
    literal = ~copied & ~hit
    symbol = np.where(hit, 280 + slots, pixels & 255).astype(np.int64)
    symbol[begin], length_extra, length_bits = (lambda p, x, b: (256 + p, x, b))(*_prefix(length))
    token = literal | hit
    token[begin] = True
    far = np.repeat(apart[keep], parts)
    stored = np.where(far == 1, 2, far + 120)  # of the short codes only that of the pixel before
    far_symbol, far_extra, far_bits = _prefix(stored)

    spots = np.flatnonzero(literal)
    samples = pixels[spots].view(np.uint8).reshape(-1, 4)
    told = (
        standing_codes()
        if small
        else Codes(
            cache_bits, main,
            np.bincount(symbol[token], minlength=ALPHABETS[0] + (1 << cache_bits if cache_bits else 0)),
            np.bincount(samples[:, RED:].ravel(), minlength=256), np.bincount(far_symbol, minlength=40),
        )
    )
    codes, sizes = told.green
    value, size = codes[symbol], sizes[symbol]
    codes, sizes = told.other
    whole, taken = value[spots], size[spots]
    for channel in (RED, BLUE, ALPHA):
        whole |= codes[samples[:, channel]] << taken
        taken += sizes[samples[:, channel]]
    value[spots], size[spots] = whole, taken
    codes, sizes = told.back
    for extra, bits in ((length_extra, length_bits), (codes[far_symbol], sizes[far_symbol]), (far_extra, far_bits)):
        value[begin] |= extra.astype(np.uint64) << size[begin]
        size[begin] += bits.astype(np.uint64)
    return [told.bits, _pack(value[token], size[token])]


def encode(pixels: np.ndarray) -> bytes:
    """Write pixels (height, width, 4), as indices into a palette where they have at most 16 colours."""
    height, width, _ = pixels.shape
    flat = np.ascontiguousarray(pixels).reshape(-1).view("<u4")
    w = BitWriter()
    put_size(w, width, height)
    parts = []
    colours = np.unique(flat) if len(np.unique(flat[:64])) <= 16 else flat
    small = 16 < len(colours) and len(flat) < SMALL
    if len(colours) <= 16:
        w.put(1, 1)
        w.put(3, 2)
        w.put(len(colours) - 1, 8)
        deltas = np.diff(colours.view(np.uint8).reshape(-1, 4).astype(int), axis=0, prepend=0).astype(np.uint8)
        parts = [w.bits(), *_image_bits(deltas.reshape(-1).view("<u4"), False)]
        per = 8 if len(colours) <= 2 else 4 if len(colours) <= 4 else 2
        index = np.zeros((height, -(-width // per) * per), np.uint32)
        index[:, :width] = np.searchsorted(colours, flat).reshape(height, width)
        index = index.reshape(height, -1, per) << (np.arange(per) * (8 // per)).astype(np.uint32)
        flat = index.sum(axis=2, dtype=np.uint32).reshape(-1)
        w = BitWriter()
    w.put(0, 1)
    return container(np.concatenate([*parts, w.bits(), *_image_bits(flat, True, small)]))
