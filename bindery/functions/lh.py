"""The static Huffman LZ77 codecs lh5, lh6 and lh7: matches of 3 to 256 bytes, code tables before every block."""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np

from bindery.functions.bits import Bits

#: Bits of the window, and of the field that counts the position codes.
VARIANTS = {"lh5": (13, 4), "lh6": (15, 5), "lh7": (16, 5)}
LITERALS, SHORTEST, LONGEST, BLOCK = 256, 3, 256, 16384
#: A piece is searched at once, its window before it; matches are measured to CAP bytes at once, longer ones when they are taken.
PIECE, CAP, FAR = 1 << 18, 32, 1 << 11


def lengths(counts: Counter) -> dict[int, int]:
    """Huffman code lengths of up to 16 bits; counts are flattened until the tree is shallow enough."""
    while True:
        heap = [(n, s, (s,)) for s, n in counts.items()]
        heapq.heapify(heap)
        depth = dict.fromkeys(counts, 0)
        while len(heap) > 1:
            (n1, s1, a), (n2, s2, b) = heapq.heappop(heap), heapq.heappop(heap)
            for s in a + b:
                depth[s] += 1
            heapq.heappush(heap, (n1 + n2, min(s1, s2), a + b))
        if max(depth.values(), default=0) <= 16:
            return depth
        counts = Counter({s: n // 2 + 1 for s, n in counts.items()})


def codes(depth: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Canonical codes: shorter ones first, then by symbol."""
    out, code, last = {}, 0, 0
    for n, s in sorted((n, s) for s, n in depth.items() if n):
        code <<= n - last
        out[s], last = (code, n), n
        code += 1
    return out


def put_small_table(bits: Bits, depth: dict[int, int], width: int, gap: bool) -> dict[int, tuple[int, int]]:
    """Lengths of a table in three bits each, more in unary; with a gap, zeros after the third are counted in two bits."""
    if len(depth) < 2:
        bits.put(0, width)
        bits.put(next(iter(depth), 0), width)
        return dict.fromkeys(depth, (0, 0))
    n = max(depth) + 1
    bits.put(n, width)
    i = 0
    while i < n:
        d = depth.get(i, 0)
        bits.put(*((d, 3) if d <= 6 else ((1 << d - 3) - 2, d - 3)))
        i += 1
        if gap and i == 3:
            skipped = 0
            while skipped < 3 and not depth.get(i, 0):
                i, skipped = i + 1, skipped + 1
            bits.put(skipped, 2)
    return codes(depth)


def runs_of(depth: dict[int, int]) -> list[tuple[int, int, int]]:
    """The big table as (code, extra, bits): lengths from 3 on, and runs of zeros by three codes."""
    out, i, n = [], 0, max(depth) + 1
    while i < n:
        if d := depth.get(i, 0):
            out.append((d + 2, 0, 0))
            i += 1
            continue
        end = i
        while end < n and not depth.get(end, 0):
            end += 1
        run, i = end - i, end
        if run < 3:
            out += [(0, 0, 0)] * run
        elif run < 19:
            out.append((1, run - 3, 4))
        elif run == 19:
            out += [(0, 0, 0), (1, 15, 4)]
        else:
            out.append((2, run - 20, 9))
    return out


def put_block(bits: Bits, symbols: np.ndarray, places: np.ndarray, position_width: int) -> None:
    """Symbols, and distance - 1 of those that are matches (-1: a literal)."""
    counts = np.bincount(symbols, minlength=LITERALS + LONGEST)
    depth = lengths(Counter({int(s): int(counts[s]) for s in np.flatnonzero(counts)}))
    bits.put(len(symbols), 16)
    if len(depth) == 1:
        bits.put(0, 10)
        bits.put(0, 9)
        bits.put(next(iter(depth)), 9)
        table = dict.fromkeys(depth, (0, 0))
    else:
        runs = runs_of(depth)
        outer = put_small_table(bits, lengths(Counter(c for c, _, _ in runs)), 5, True)
        bits.put(max(depth) + 1, 9)
        for c, extra, width in runs:
            bits.put(*outer[c])
            bits.put(extra, width)
        table = codes(depth)
    match = np.flatnonzero(places >= 0)
    far = places[match]
    kind = np.frexp(far.astype(np.float64))[1].astype(np.int64)  # bits of the distance
    n_kinds = np.bincount(kind, minlength=18)
    place_table = put_small_table(bits, lengths(Counter({int(k): int(n_kinds[k]) for k in np.flatnonzero(n_kinds)})), position_width, False)
    values, widths = (column[symbols] for column in columns(table, LITERALS + LONGEST))
    place_values, place_widths = (column[kind] for column in columns(place_table, 18))
    more = np.maximum(kind - 1, 0)
    rest = np.where(kind > 1, far - (1 << more), 0)
    values[match] = (values[match] << place_widths | place_values) << more | rest
    widths[match] += place_widths + more
    bits.put_all(values.astype(np.uint64), widths)


def columns(table: dict[int, tuple[int, int]], n: int) -> np.ndarray:
    """Codes and widths by symbol."""
    out = np.zeros((2, n), np.int64)
    for s, code in table.items():
        out[:, s] = code
    return out


def last_same(keys: np.ndarray) -> np.ndarray:
    """Where the same key (up to 40 bits) came last, -1 if nowhere; at most 2^24 keys."""
    n, mask = len(keys), np.uint64((1 << 24) - 1)
    order = np.sort(keys << np.uint64(24) | np.arange(n, dtype=np.uint64))
    place = (order & mask).astype(np.int32)
    same = np.flatnonzero(order[1:] >> np.uint64(24) == order[:-1] >> np.uint64(24))
    out = np.full(n, -1, np.int32)
    out[place[same + 1]] = place[same]
    return out


def measured(words: np.ndarray, at: np.ndarray, before: np.ndarray) -> np.ndarray:
    """How many bytes are equal from two places on, up to CAP. words: the eight bytes from every place on."""
    size, open_ = np.zeros(len(at), np.int64), np.arange(len(at))
    for done in range(0, CAP, 8):
        differ = words[at[open_] + done] ^ words[before[open_] + done]
        low = (differ & (~differ + np.uint64(1))).astype(np.float64)
        size[open_] = done + np.where(differ == 0, 8, (np.frexp(low)[1] - 1) // 8)
        open_ = open_[differ == 0]
    return size


def parsed(data: bytes, start: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and distances - 1 of data from start on; what lies before may be copied from.

    Two earlier places are tried, where the same three and the same six bytes came last; a match gives way to a longer one that
    begins a byte later, and one of three bytes from afar isn't worth its place.
    """
    n = len(data)
    a = np.frombuffer(data, np.uint8)
    size, back = np.zeros(n, np.int32), np.zeros(n, np.int32)
    if n >= 3:
        padded = data + bytes(CAP + 8)
        words = np.ndarray(n + CAP, "<u8", padded, strides=(1,)).astype(np.uint64)
        three = words[: n - 2] & np.uint64(0xFFFFFF)
        six = (words[: n - 2] & np.uint64((1 << 48) - 1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24)
        for keys in (three, six):
            before = last_same(keys)
            at = np.flatnonzero(before >= 0)
            at = at[(at >= start) & (at - before[at] <= window)]
            found = np.minimum(measured(words, at, before[at]), n - at)
            better = found > size[at]
            size[at[better]], back[at[better]] = found[better], (at - before[at])[better]
        size[(size < SHORTEST) | (size == SHORTEST) & (back > FAR)] = 0
        size[:-1][size[1:] > size[:-1]] = 0
    place = np.flatnonzero(size)
    # the matches in order: from each the first that begins where it ends or later; those of CAP bytes are measured when they are taken
    after = np.where(size[place] == CAP, -1, np.searchsorted(place, place + size[place]))
    after, taken, i = after.tolist(), [], 0
    while i < len(after):
        taken.append(i)
        following = after[i]
        if following < 0:
            at = int(place[i])
            size[at] = grown(data, at, at - int(back[at]), min(LONGEST, n - at))
            following = int(np.searchsorted(place, at + size[at]))
        i = following
    starts = place[np.array(taken, np.int64)]
    taken = size[starts].astype(np.int64)
    ends = np.zeros(n + 1, np.int8)
    ends[starts] += 1
    ends[starts + taken] -= 1  # no two matches begin, or end, at one place
    own = np.cumsum(ends[:-1], dtype=np.int8) == 0
    own[starts] = True
    own[:start] = False
    symbols, places = a.astype(np.int64), np.full(n, -1, np.int64)
    symbols[starts], places[starts] = LITERALS + taken - SHORTEST, back[starts] - 1
    return symbols[own], places[own]


def grown(data: bytes, at: int, before: int, most: int) -> int:
    """A match of CAP bytes, measured to its end."""
    n = CAP
    while n < most and data[at + n : min(at + n + CAP, at + most)] == data[before + n : before + min(n + CAP, most)]:
        n += CAP
    while n < most and data[at + n] == data[before + n]:
        n += 1
    return min(n, most)


def static_huffman(data: bytes, variant: str) -> bytes:
    window, width = VARIANTS[variant]
    window, bits = (1 << window) - 1, Bits()
    for at in range(0, len(data), PIECE):
        from_ = max(0, at - window)
        symbols, places = parsed(data[from_ : at + PIECE], at - from_, window)
        for k in range(0, len(symbols), BLOCK):
            put_block(bits, symbols[k : k + BLOCK], places[k : k + BLOCK], width)
    return bits.end()
