"""Where everything lies in an archive: units of tar and LHA, records of ZIP, the model of 7z, each with byte ranges.

A layout is read by positioned reads of headers alone; payloads are never touched. What an editor may not safely move is
refused with a code: P (ZIP gatekeepers), R (tar), L (LHA), S (7z).
"""

from __future__ import annotations

import os
import struct
import zlib
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np

from bindery.functions.checksums import crc16_of

BLOCK, LIMIT32, TAIL = 512, 0xFFFFFFFF, 22 + 65_535 + (1 << 20)
READ_AHEAD = 1 << 16


class Refusal(ValueError):
    """The archive can be read but not edited in place; code names the rule."""

    def __init__(self, code: str, reason: str):
        super().__init__(f"{code}: {reason}")
        self.code, self.reason = code, reason

    def __reduce__(self):
        return Refusal, (self.code, self.reason)


class Ranged:
    """Positioned reads of one file; short reads fail, small ones come from a window read ahead."""

    def __init__(self, path: str):
        self.path, self.file = path, os.open(path, os.O_RDONLY)
        self.length = os.fstat(self.file).st_size
        self.start, self.window = 0, b""

    def read(self, at: int, n: int) -> bytes:
        if at < 0 or n < 0 or at + n > self.length:
            raise Refusal("R8", f"{n} bytes at {at} are out of the file")
        if not self.start <= at or at + n > self.start + len(self.window):
            size = max(n, min(READ_AHEAD, self.length - at)) if n < READ_AHEAD else n
            self.start, self.window = at, self.some(at, size)
        return self.window[at - self.start : at - self.start + n]

    def some(self, at: int, n: int) -> bytes:
        """Exactly n bytes, by as many reads as it takes."""
        parts = []
        while n:
            part = os.pread(self.file, n, at)
            if not part:
                raise Refusal("R8", "short read")
            parts.append(part)
            at, n = at + len(part), n - len(part)
        return b"".join(parts)

    def close(self) -> None:
        os.close(self.file)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()


# tar


@dataclass
class TarUnit:
    """A member with its extension headers: [lo, header) extensions, [header, data) the header block, [data, end) the body, hi padded."""

    lo: int
    header: int
    data: int
    end: int
    hi: int
    type: bytes
    name: bytes
    link: bytes
    mode: int
    mtime: int
    pax: list[tuple[str, bytes]] = field(default_factory=list)
    extensions: list[tuple[bytes, bytes]] = field(default_factory=list)  # type, whole bytes with padding
    sparse: bool = False

    @property
    def kind(self) -> str:
        return {b"1": "hardlink", b"2": "symlink", b"5": "directory", b"g": "global"}.get(self.type, "file" if self.type in (b"0", b"\0", b"7") else "other")


def tar_number(raw: bytes) -> int:
    """Octal, or base-256 where the top bit is set."""
    if raw[0] & 0x80:
        if raw[0] & 0x40:
            raise Refusal("R8", "negative field")
        return int.from_bytes(bytes([raw[0] & 0x7F]) + raw[1:], "big")
    text = raw.split(b"\0")[0].strip(b" ")
    if text.strip(b"01234567") or raw[len(raw.split(b"\0")[0]) :].strip(b"\0 "):
        raise Refusal("R8", "octal field")
    return int(text or b"0", 8)


def checksum_holds(header: bytes) -> bool:
    """Of a tar header: the sum of its bytes, unsigned or signed, with the field itself as spaces."""
    body = header[:148] + b" " * 8 + header[156:]
    return tar_number(header[148:156]) in (sum(body), sum(b - 256 if b > 127 else b for b in body))


def pax_records(data: bytes) -> list[tuple[str, bytes]]:
    out, at = [], 0
    while at < len(data):
        size, _, _ = data[at:].partition(b" ")
        if not size.isdigit() or not 0 < int(size) <= len(data) - at:
            raise Refusal("R8", "pax length")
        key, equals, value = data[at + len(size) + 1 : at + int(size)].partition(b"=")
        if not equals or not value.endswith(b"\n"):
            raise Refusal("R8", "pax record")
        out.append((key.decode("utf-8", "replace"), value[:-1]))
        at += int(size)
    return out


def padded(n: int) -> int:
    return n + -n % BLOCK


def cstring(raw: bytes) -> bytes:
    return raw.split(b"\0")[0]


def tar_units(src) -> tuple[list[TarUnit], int]:
    """Units in order, global headers among them, and where the members end."""
    return drained(tar_walk(src))


def drained(walk) -> tuple[list, int]:
    """What a walk gives, and what it returns."""
    out = []
    while True:
        try:
            out.append(next(walk))
        except StopIteration as end:
            return out, end.value


def tar_walk(src, at: int = 0, stop: int | None = None):
    """Units from the one that begins at `at`, up to `stop`; returns where they end. A stream needs not know its length: more(at)
    tells whether it has a byte there."""
    lo, more = at, getattr(src, "more", None) or (lambda place: place < src.length)
    extensions, records, long_name, long_link = [], [], None, None
    while (stop is None or at < stop) and more(at):
        header = src.read(at, BLOCK)
        if not header.strip(b"\0"):
            break
        if not checksum_holds(header):
            raise Refusal("R8", "checksum")
        kind, size, body = header[156:157], tar_number(header[124:136]), at + BLOCK
        if kind in b"xgXLK" and kind:
            end = body + padded(size)
            payload, raw = src.read(body, size), src.read(at, end - at)
            if kind == b"g":
                if extensions or any(k != "comment" for k, _ in pax_records(payload)):
                    raise Refusal("R1", "global pax header")
                yield TarUnit(at, at, body, body + size, end, kind, b"", b"", 0, 0)
                lo = end
            else:
                extensions.append((kind, raw))
                if kind in b"xX":
                    if records:
                        raise Refusal("R8", "two pax headers")
                    records = pax_records(payload)
                    if any(k == "hdrcharset" for k, _ in records):
                        raise Refusal("R4", "hdrcharset")
                elif kind == b"L":
                    long_name = payload.rstrip(b"\0")
                else:
                    long_link = payload.rstrip(b"\0")
            at = end
            continue
        if kind == b"S":
            raise Refusal("R2", "old sparse member")
        pax = {k: v for k, v in records if v}
        try:
            size = int(pax["size"]) if "size" in pax else size
            mtime = int(float(pax["mtime"])) if "mtime" in pax else tar_number(header[136:148])
        except ValueError:
            raise Refusal("R8", "pax number") from None
        if kind == b"1" and size:
            raise Refusal("R3", "hard link with a body")
        if kind in b"123456" and kind and "size" not in pax:
            size = 0
        end = body + padded(size)
        if not more(end - 1):
            raise Refusal("R8", "body out of the file")
        sparse = any(k.startswith("GNU.sparse.") for k in pax)
        prefix = cstring(header[345:500]) if header[257:265] == b"ustar\x0000" else b""
        plain = (prefix + b"/" if prefix else b"") + cstring(header[:100])
        name = pax.get("GNU.sparse.name") or pax.get("path") or long_name or plain
        yield TarUnit(lo, at, body, body + size, end, kind, name, pax.get("linkpath") or long_link or cstring(header[157:257]), tar_number(header[100:108]) & 0o7777, mtime, records, extensions, sparse)
        at = lo = end
        extensions, records, long_name, long_link = [], [], None, None
    if extensions:
        raise Refusal("R8", "extension header without a member")
    return at


# ZIP


@dataclass
class ZipRecord:
    """Central record at [c_lo, c_hi), local record at [lo, hi) with its payload from `data` on."""

    idx: int
    name: bytes
    flags: int
    method: int
    stamp: int
    crc: int
    packed: int
    size: int
    attributes: int
    c_lo: int
    c_hi: int
    lo: int
    data: int
    end: int
    hi: int
    extra: bytes
    canonical: bool
    descriptor: bool
    zip64: bool

    @property
    def text(self) -> str:
        return self.name.decode("utf-8" if self.flags & 0x800 else "cp437")

    @property
    def kind(self) -> str:
        mode = self.attributes >> 16
        return "directory" if self.name.endswith(b"/") else "symlink" if mode & 0o170000 == 0o120000 else "file"


@dataclass
class ZipTail:
    count: int
    size: int
    offset: int
    comment: bytes
    end: int  # where the end records begin


def extra_fields(extra: bytes) -> list[tuple[int, int, int]]:
    """(id, from, to) of each whole field."""
    out, at = [], 0
    while len(extra) - at >= 4:
        kind, n = struct.unpack_from("<HH", extra, at)
        if at + 4 + n > len(extra):
            break
        out.append((kind, at, at + 4 + n))
        at += 4 + n
    return out


def zip_tail(src) -> ZipTail:
    """The one end record; ambiguous ends, prefixes, trailing bytes and offsets that point elsewhere are refused."""
    if src.length < 22:
        raise ValueError("no end record")
    low = max(0, src.length - TAIL)
    tail = src.some(low, src.length - low)
    found, at = [], tail.rfind(b"PK\5\6")
    while at >= 0:
        if len(tail) - at >= 22:
            stop = at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little")
            if stop <= len(tail) and len(tail) - stop <= 1 << 20:
                found.append((at, stop))
        at = tail.rfind(b"PK\5\6", 0, at)
    if not found:
        raise ValueError("no end record")
    at, stop = found[0]
    if sum(e == len(tail) for _, e in found) > 1 or any(a + 22 <= at and at + 22 <= e for a, e in found[1:]):
        raise Refusal("P4", "ambiguous end record")
    _, disk, first_disk, here, count, size, offset, _ = struct.unpack_from("<IHHHHIIH", tail, at)
    if disk or first_disk or here != count:
        raise ValueError("archive of several volumes")
    if src.read(0, 4) not in (b"PK\3\4", b"PK\5\6", b"PK\6\6"):
        raise Refusal("P1", "prefix before the first record")
    if stop != len(tail):
        raise Refusal("P2", "bytes after the end record")
    end = low + at
    if end >= 20 and src.read(end - 20, 4) == b"PK\6\7":
        big = int.from_bytes(src.read(end - 12, 8), "little")
        record = src.read(big, 56)
        n, where, wide, far = struct.unpack_from("<QQ", record, 24)[1], big, *struct.unpack_from("<QQ", record, 40)
        agree = (count in (0xFFFF, n)) and size in (LIMIT32, wide) and offset in (LIMIT32, far)
        if record[:4] != b"PK\6\6" or big + 12 + int.from_bytes(record[4:12], "little") != end - 20 or not agree:
            raise ValueError("64-bit end records disagree")
        count, size, offset, end = n, wide, far, where
    elif count == 0xFFFF or LIMIT32 in (size, offset):
        raise ValueError("64-bit end record missing")
    if count and (offset + 4 > src.length or src.read(offset, 4) != b"PK\1\2"):
        raise Refusal("P3", "the end record doesn't point to the directory")
    if offset + size != end or count * 46 > size or not count and (offset or size):
        raise ValueError("size of the directory")
    return ZipTail(count, size, offset, tail[at + 22 : stop], end)


@dataclass
class ZipSlice:
    """Records [first, last), whose central records are at [c_lo, c_hi) of the directory, and by what place each must have ended."""

    first: int
    last: int
    c_lo: int
    c_hi: int
    bounds: bytes


SLICE = 1 << 14  # records of a directory that are held at once


def zip_slices(src, tail: ZipTail, max_bytes: int | None = None) -> list[ZipSlice]:
    """The directory in slices of up to SLICE records, or as soon as their contents have more than max_bytes. Of the directory numbers alone are held."""
    at, central, places, cuts, held, here = 0, np.empty(tail.count + 1, np.int64), np.empty(tail.count, np.int64), [0], 0, Ranged(src.path) if isinstance(src, Ranged) else src
    try:
        for idx in range(tail.count):
            if tail.size - at < 46 or (fixed := here.read(tail.offset + at, 46))[:4] != b"PK\1\2":
                raise ValueError("directory record")
            packed, size, n, e, c = struct.unpack_from("<IIHHH", fixed, 20)
            lo = int.from_bytes(fixed[42:46], "little")
            if LIMIT32 in (packed, size, lo):
                extra = here.read(tail.offset + at + 46 + n, e)
                wide = next((extra[a + 4 : b] for k, a, b in extra_fields(extra) if k == 1), b"")
                values = [size, packed, lo]
                for i, v in enumerate(values):
                    if v == LIMIT32:
                        if len(wide) < 8:
                            raise ValueError("64-bit field missing")
                        values[i], wide = int.from_bytes(wide[:8], "little"), wide[8:]
                size, packed, lo = values
            central[idx], places[idx] = at, lo
            if idx - cuts[-1] >= SLICE or max_bytes is not None and held > max_bytes:
                cuts.append(idx)
                held = 0
            held, at = held + size, at + 46 + n + e + c
    finally:
        if here is not src:
            here.close()
    if at != tail.size:
        raise ValueError("the directory is longer than its records")
    central[tail.count] = at
    order = np.argsort(places, kind="stable")
    bounds = np.full(tail.count, tail.offset, np.int64)
    bounds[order[:-1]] = places[order[1:]]
    edges = [*cuts, tail.count] if tail.count else []
    return [ZipSlice(a, b, int(central[a]), int(central[b]), bounds[a:b].tobytes()) for a, b in zip(edges, edges[1:], strict=False)]


def zip_walk(src, tail: ZipTail, part: ZipSlice):
    """Records of a slice in directory order, each held against its local header and the record that lies behind it."""
    directory, at = src.some(tail.offset + part.c_lo, part.c_hi - part.c_lo), 0
    for idx, bound in zip(range(part.first, part.last), np.frombuffer(part.bounds, np.int64).tolist(), strict=True):
        if directory[at : at + 4] != b"PK\1\2" or len(directory) - at < 46:
            raise ValueError("directory record")
        flags, method, stamp, crc, packed, size, n, e, c, disk = struct.unpack_from("<HHIIIIHHHH", directory, at + 8)
        attributes, lo = struct.unpack_from("<II", directory, at + 38)
        name, extra = directory[at + 46 : at + 46 + n], directory[at + 46 + n : at + 46 + n + e]
        wide = next((extra[a + 4 : b] for k, a, b in extra_fields(extra) if k == 1), None)
        values, canonical = [size, packed, lo], wide is None and disk == 0 and LIMIT32 not in (size, packed, lo)
        for i, v in enumerate(values):
            if v == LIMIT32:
                if wide is None or len(wide) < 8:
                    raise ValueError("64-bit field missing")
                values[i], wide = int.from_bytes(wide[:8], "little"), wide[8:]
        size, packed, lo = values
        local = src.read(lo, 30)
        ln, le = struct.unpack_from("<HH", local, 26)
        data = lo + 30 + ln + le
        if local[:4] != b"PK\3\4" or src.read(lo + 30, ln) != name or data + packed > tail.offset:
            raise ValueError(f"local record of {name!r}")
        local_extra = src.read(lo + 30 + ln, le)
        zip64 = any(k == 1 for k, _, _ in extra_fields(extra) + extra_fields(local_extra))
        end = hi = data + packed
        if flags & 8:  # a descriptor: signature or not, then crc and two sizes
            signed = src.read(end, 4) == b"PK\7\x08"
            hi = end + 4 * signed + 4 + (16 if zip64 else 8)
        if hi > bound:
            raise ValueError(f"the record of {name!r} and the next overlap")
        size_of = 46 + n + e + c
        yield ZipRecord(idx, name, flags, method, stamp, crc, packed, size, attributes, part.c_lo + at, part.c_lo + at + size_of, lo, data, end, hi, extra, canonical, bool(flags & 8), zip64)
        at += size_of


def zip_records(src) -> tuple[list[ZipRecord], ZipTail]:
    """Records in directory order, each held against its local header; local records reach up to the next one."""
    tail = zip_tail(src)
    return [r for part in zip_slices(src, tail) for r in zip_walk(src, tail, part)], tail


# LHA


@dataclass
class LhaUnit:
    lo: int
    data: int
    hi: int
    level: int
    method: str
    os: int
    crc: int
    size: int
    name: bytes
    mtime: int
    mode: int | None


def lha_unit(src, at: int) -> LhaUnit:
    first = src.read(at, 22)
    level = first[20]
    if level > 2:
        raise Refusal("L5", f"header level {level}")
    total = int.from_bytes(first[:2], "little") if level == 2 else first[0] + 2
    head = bytearray(src.read(at, total))
    method = bytes(head[2:7])
    if not (method[:1] == method[-1:] == b"-") or not method[1:-1].isalnum():
        raise Refusal("R8", "method")
    packed, size, stamp = struct.unpack_from("<III", head, 7)
    records, folder, leaf, mode, crc_at = [], b"", b"", None, None
    if level < 2:
        if sum(head[2:]) & 255 != head[1]:
            raise Refusal("R8", "byte checksum")
        n = head[21]
        leaf, after = bytes(head[22 : 22 + n]), 22 + n
        crc, system = int.from_bytes(head[after : after + 2], "little"), head[after + 2] if after + 2 < len(head) else 0
        if level == 1:
            nxt, used = int.from_bytes(head[-2:], "little"), 0
            while nxt:
                if nxt < 3 or used + nxt > packed:
                    raise Refusal("R8", "extension")
                record = src.read(at + len(head), nxt)
                records.append((record[0], record[1:-2], len(head) + 1))
                head += record
                used, nxt = used + nxt, int.from_bytes(record[-2:], "little")
            packed -= used
    else:
        crc, system, cursor = int.from_bytes(head[21:23], "little"), head[23], 24
        while nxt := int.from_bytes(head[cursor : cursor + 2], "little"):
            if nxt < 3 or cursor + nxt + 2 > len(head):
                raise Refusal("R8", "extension")
            records.append((head[cursor + 2], bytes(head[cursor + 3 : cursor + nxt]), cursor + 3))
            cursor += nxt
    for kind, body, where in records:
        if kind == 0:
            crc_at = where
        elif kind == 1 and body:
            leaf = body
        elif kind == 2 and body:
            folder = body
        elif kind == 0x42 and len(body) == 16:
            packed, size = struct.unpack("<QQ", body)
        elif kind == 0x50 and len(body) == 2:
            mode = int.from_bytes(body, "little")
    if crc_at is not None:
        want = int.from_bytes(head[crc_at : crc_at + 2], "little")
        if crc16_of(bytes(head[:crc_at]) + b"\0\0" + bytes(head[crc_at + 2 :])) != want:
            raise Refusal("R8", "header CRC")
    folder = folder.replace(b"\xff", b"/")
    name = (folder + b"/" if folder and not folder.endswith(b"/") and leaf else folder) + leaf.split(b"\0")[0].replace(b"\xff", b"/").replace(b"\\", b"\\")
    data = at + len(head)
    if data + packed > src.length:
        raise Refusal("R8", "payload out of the file")
    return LhaUnit(at, data, data + packed, level, method.decode(), system, crc, size, name, stamp if level == 2 else dos_seconds(stamp), mode)


def dos_seconds(stamp: int) -> int:
    import calendar

    date, time = stamp >> 16, stamp & 0xFFFF
    return calendar.timegm((1980 + (date >> 9), max(1, date >> 5 & 15), max(1, date & 31), time >> 11, time >> 5 & 63, (time & 31) * 2, 0, 0, 0))


def lha_units(src) -> tuple[list[LhaUnit], int]:
    """Members and where the terminator stands; what a member-wise edit could not keep is refused."""
    return drained(lha_walk(src))


def lha_walk(src, at: int = 0, stop: int | None = None):
    """Members from the one that begins at `at`, up to `stop`; returns where they end."""
    if src.length >= 2 and src.read(0, 2) == b"MZ":
        raise Refusal("L1", "prefix before the first member")
    while (stop is None or at < stop) and at < src.length and src.read(at, 1) != b"\0":
        unit = lha_unit(src, at)
        if unit.method == "-lhd-" and (unit.hi > unit.data or unit.size):
            raise Refusal("L7", "directory with data")
        if unit.method == "-lh7-" and unit.os == 0x20:
            raise Refusal("L8", "LHArk method")
        if unit.hi - unit.data > LIMIT32:
            raise Refusal("L9", "packed size")
        try:
            unit.name.decode("cp932")
        except UnicodeError:
            raise Refusal("R10", "name encoding") from None
        yield unit
        at = unit.hi
    if stop is not None:
        return at
    if at >= src.length:
        raise Refusal("L2", "no terminator")
    if src.some(at, min(src.length - at, 1 << 20)).strip(b"\0"):
        raise Refusal("L3", "bytes after the terminator")
    return at


# 7z


@dataclass
class Coder:
    id: bytes
    properties: bytes = b""
    inputs: int = 1
    outputs: int = 1


@dataclass
class Folder:
    coders: list[Coder]
    binds: list[tuple[int, int]]  # input, output
    packed_inputs: list[int]
    sizes: list[int]
    crc: int | None
    packs: range
    streams: range = range(0)

    @cached_property
    def final(self) -> int:
        bound = {o for _, o in self.binds}
        return next(i for i in range(len(self.sizes)) if i not in bound)

    @property
    def size(self) -> int:
        return self.sizes[self.final]

    @property
    def encrypted(self) -> bool:
        return any(c.id == AES for c in self.coders)

    @property
    def can_reencrypt(self) -> bool:
        """One packed stream, and no cipher or just one, which takes that stream."""
        ciphers = [i for i, c in enumerate(self.coders) if c.id == AES]
        if len(self.packed_inputs) != 1 or len(ciphers) > 1:
            return False
        return not ciphers or (self.coders[ciphers[0]].inputs, self.coders[ciphers[0]].outputs) == (1, 1) and sum(c.inputs for c in self.coders[: ciphers[0]]) == self.packed_inputs[0]


AES = b"\x06\xf1\x07\x01"  # fixed value: the id of the cipher


@dataclass(slots=True)
class File:
    name: str
    stream: int | None
    directory: bool
    empty: bool
    anti: bool = False
    created: int | None = None
    accessed: int | None = None
    modified: int | None = None
    attributes: int | None = None


@dataclass
class Model:
    packs: list[tuple[int, int]]  # lo, hi
    folders: list[Folder]
    streams: list[tuple[int, int, int, int | None]]  # folder, offset in it, size, crc
    files: list[File]
    header: tuple[int, int]
    encoded: bool = False
    order: list[int] = field(default_factory=list)  # property ids as they stood

    def reason(self) -> str | None:
        """Why the archive cannot be edited by folders; null if it can."""
        at = 32
        for lo, hi in self.packs:
            if lo != at:
                return "S2: packs are not contiguous"
            at = hi
        pack = stream = 0
        for k, f in enumerate(self.folders):
            if f.packs.start != pack or len(f.packs) != len(f.packed_inputs) or f.streams.start != stream or len(f.sizes) != sum(c.outputs for c in f.coders):
                return "S3: folder layout"
            inside = self.streams[f.streams.start : f.streams.stop]
            if any(s[0] != k for s in inside) or (inside and sum(s[2] for s in inside) != f.size):
                return "S4: sizes of a folder"
            pack, stream = f.packs.stop, f.streams.stop
        if pack != len(self.packs) or stream != len(self.streams):
            return "S3: folder layout"
        if [f.stream for f in self.files if f.stream is not None] != list(range(len(self.streams))):
            return "S5: files and streams"
        return None


class Bytes:
    """Reads a 7z header."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("7z header ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def byte(self) -> int:
        return self.take(1)[0]

    def number(self) -> int:
        first, value = self.byte(), 0
        for i in range(8):
            if not first & 0x80 >> i:
                return value | (first & (0x80 >> i) - 1) << 8 * i
            value |= self.byte() << 8 * i
        return value

    def bits(self, n: int) -> list[bool]:
        raw = self.take((n + 7) // 8)
        return [bool(raw[i // 8] & 0x80 >> i % 8) for i in range(n)]

    def some(self, n: int) -> list[bool]:
        return [True] * n if self.byte() else self.bits(n)

    def digests(self, n: int) -> list[int | None]:
        return [int.from_bytes(self.take(4), "little") if d else None for d in self.some(n)]


def streams_of(b: Bytes) -> tuple[list[tuple[int, int]], list[Folder], list]:
    packs, folders, streams, kind = [], [], [], b.byte()
    if kind == 6:
        at, n = 32 + b.number(), b.number()
        while (kind := b.byte()) != 0:
            if kind == 9:
                for _ in range(n):
                    size = b.number()
                    packs.append((at, at + size))
                    at += size
            elif kind == 10:
                b.digests(n)
        kind = b.byte()
    if kind == 7:
        if b.byte() != 11:
            raise ValueError("7z folders")
        n, pack = b.number(), 0
        if b.byte():
            raise Refusal("S6", "external folders")
        for _ in range(n):
            coders = []
            for _ in range(b.number()):
                flags = b.byte()
                code = b.take(flags & 15)
                ins, outs = (b.number(), b.number()) if flags & 16 else (1, 1)
                coders.append(Coder(code, b.take(b.number()) if flags & 32 else b"", ins, outs))
            ins, outs = sum(c.inputs for c in coders), sum(c.outputs for c in coders)
            binds = [(b.number(), b.number()) for _ in range(outs - 1)]
            n_packed = ins - len(binds)
            inputs = [i for i in range(ins) if i not in {x for x, _ in binds}] if n_packed == 1 else [b.number() for _ in range(n_packed)]
            folders.append(Folder(coders, binds, inputs, [], None, range(pack, pack + n_packed)))
            pack += n_packed
        if b.byte() != 12:
            raise ValueError("7z sizes")
        for f in folders:
            f.sizes = [b.number() for _ in range(sum(c.outputs for c in f.coders))]
        while (kind := b.byte()) != 0:
            if kind == 10:
                for f, crc in zip(folders, b.digests(len(folders)), strict=True):
                    f.crc = crc
        kind = b.byte()
    counts = [1] * len(folders)
    if kind == 8:
        kind = b.byte()
        if kind == 13:
            counts = [b.number() for _ in folders]
            kind = b.byte()
        sizes = []
        for f, n in zip(folders, counts, strict=True):
            own = [b.number() for _ in range(n - 1)] if kind == 9 else []
            sizes.append([*own, f.size - sum(own)] if n else [])
        if kind == 9:
            kind = b.byte()
        crcs = []
        if kind == 10:
            unknown = sum(n for f, n in zip(folders, counts, strict=True) if n != 1 or f.crc is None)
            crcs = b.digests(unknown)
            kind = b.byte()
        given = iter(crcs)
        for k, (f, own) in enumerate(zip(folders, sizes, strict=True)):
            f.streams, at = range(len(streams), len(streams) + len(own)), 0
            for size in own:
                streams.append((k, at, size, f.crc if len(own) == 1 and f.crc is not None else next(given, None)))
                at += size
        if kind != 0:
            raise ValueError("7z streams")
        kind = b.byte()
    else:
        for k, f in enumerate(folders):
            f.streams = range(k, k + 1)
            streams.append((k, 0, f.size, f.crc))
    if kind != 0:
        raise ValueError("7z streams")
    return packs, folders, streams


def seven_zip_model(src, password: str | None = None) -> Model:
    """The whole model; an encoded header is decoded first, with the password if it is encrypted."""
    start = src.read(0, 32)
    if start[:6] != b"7z\xbc\xaf\x27\x1c":
        raise Refusal("S1", "prefix before the signature")
    if zlib.crc32(start[12:32]) != int.from_bytes(start[8:12], "little"):
        raise ValueError("7z start header")
    offset, size, crc = struct.unpack_from("<QQI", start, 12)
    if not size:
        return Model([], [], [], [], (32, 32))
    header = src.some(32 + offset, size)
    if zlib.crc32(header) != crc:
        raise ValueError("7z header CRC")
    encoded = header[:1] == b"\x17"
    while header[:1] == b"\x17":
        from bindery.functions.decoders import folder_plain

        packs, folders, _ = streams_of(b := Bytes(header[1:]))
        header = folder_plain(folders[0], [src.some(lo, hi - lo) for lo, hi in packs], password)
    b = Bytes(header)
    if b.byte() != 1:
        raise ValueError("7z header")
    packs, folders, streams, files, order, kind = [], [], [], [], [], b.byte()
    if kind == 2:
        raise Refusal("S6", "archive properties")
    if kind == 3:
        raise Refusal("S6", "additional streams")
    if kind == 4:
        packs, folders, streams = streams_of(b)
        kind = b.byte()
    if kind == 5:
        n = b.number()
        empty, empty_file, anti = [False] * n, [], []
        values: dict[int, list] = {}
        while (kind := b.byte()) != 0:
            body = Bytes(b.take(b.number()))
            order.append(kind)
            if kind == 14:
                empty = body.bits(n)
            elif kind == 15:
                empty_file = body.bits(sum(empty))
            elif kind == 16:
                anti = body.bits(sum(empty))
            elif kind == 17:
                if body.byte():
                    raise Refusal("S6", "external names")
                names = body.data[1:].decode("utf-16-le", "surrogatepass").split("\0")[:n]
            elif kind in (18, 19, 20, 21):
                known = body.some(n)
                if body.byte():
                    raise Refusal("S6", "external times")
                width = 4 if kind == 21 else 8
                values[kind] = [int.from_bytes(body.take(width), "little") if k else None for k in known]
            elif kind not in (24, 25):
                raise Refusal("S7", f"unknown file property {kind:#04x}")
        stream, gone = 0, 0
        for i in range(n):
            is_empty = empty[i]
            e = is_empty and gone < len(empty_file) and empty_file[gone]
            a = is_empty and gone < len(anti) and anti[gone]
            gone += is_empty
            of = lambda k: values[k][i] if k in values else None  # noqa: B023, E731
            files.append(File(names[i], None if is_empty else stream, bool(is_empty and not e), bool(e), bool(a), of(18), of(19), of(20), of(21)))
            stream += not is_empty
    return Model(packs, folders, streams, files, (32 + offset, 32 + offset + size), encoded, order)


def form_of(src) -> str:
    """zip, 7z, lha, tar, or the codec that wraps a tar or a single stream. Brotli has no mark, so it goes by the name's end."""
    if getattr(src, "path", "").endswith(".br"):
        return "brotli"
    head = src.read(0, min(src.length, 8))
    for magic, form in ((b"PK\3\4", "zip"), (b"PK\5\6", "zip"), (b"PK\6\6", "zip"), (b"7z\xbc\xaf\x27\x1c", "7z"), (b"\x1f\x8b", "gzip"), (b"BZh", "bzip2"), (b"\xfd7zXZ\0", "xz"), (b"\x28\xb5\x2f\xfd", "zstd"), (b"LZIP", "lzip"), (b"\x04\x22\x4d\x18", "lz4"), (b"\x1f\x9d", "compress"), (b"\x5d\0\0", "lzma")):
        if head.startswith(magic):
            return form
    if src.length >= 22 and head[2:4] == b"-l" and head[6:7] == b"-":
        return "lha"
    if src.length >= BLOCK and checksum_holds(src.read(0, BLOCK)):
        return "tar"
    return "lha" if head[:1] == b"\0" and src.length == 1 else "tar" if not src.length % BLOCK and not head.strip(b"\0") else "other"
