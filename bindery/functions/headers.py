"""Headers written anew: tar members with pax records, and ZIP and tar headers that an edit renames or moves."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

from bindery.functions.fields import LIMIT32

BLOCK, RECORD = 512, 10_240
#: Extra fields of ZIP that hold a name among other things.
UNICODE_PATH, NAMING = 0x7075, (0x2605, 0x2705, 0x334D)


# tar, as values


def split_name(path: bytes) -> tuple[bytes, bytes] | None:
    """(name, prefix) of a path that fits the two fields of a ustar header, cut at its last fitting slash; none if it doesn't fit."""
    if len(path) <= 100:
        return path, b""
    cut = path.rfind(b"/", 0, min(156, len(path) - 1))
    return (path[cut + 1 :], path[:cut]) if cut > 0 and len(path) - cut - 1 <= 100 else None


def pax_name(path: bytes) -> bytes:
    """The name of the header that holds the pax records of a path: PaxHeader between its folder and its leaf, 100 bytes at most."""
    folder, slash, leaf = path.rstrip(b"/").rpartition(b"/")
    head = folder + slash + b"PaxHeader/"
    return head + leaf[-(100 - len(head)) :] if len(head) < 100 else b"PaxHeader"


def tar_field(value: int, width: int) -> bytes:
    """Octal and a NUL; what doesn't fit, and what is negative, in base 256."""
    if 0 <= value < 8 ** (width - 1):
        return b"%0*o\0" % (width - 1, value)
    return bytes([0xFF if value < 0 else 0x80]) + (value & (1 << 8 * (width - 1)) - 1).to_bytes(width - 1, "big")


def pax_record(key: str, value: bytes) -> bytes:
    rest = len(key.encode()) + len(value) + 3
    size = rest + len(str(rest))
    size = rest + len(str(size))
    return b"%d %s=%s\n" % (size, key.encode(), value)


def summed(header: bytearray) -> bytes:
    """A header block with its checksum."""
    header[148:156] = b" " * 8
    header[148:156] = b"%06o\0 " % sum(header)
    return bytes(header)


def tar_block(name: bytes, kind: bytes, size: int, mode: int = 0o644, mtime: int = 0, link: bytes = b"", owner: tuple[int, int] = (0, 0)) -> bytes:
    header = bytearray(BLOCK)
    leaf, prefix = split_name(name) or (name[:100], b"")
    header[: len(leaf)] = leaf
    header[345 : 345 + len(prefix)] = prefix
    for at, width, value in ((100, 8, mode), (108, 8, owner[0]), (116, 8, owner[1]), (124, 12, size), (136, 12, mtime)):
        header[at : at + width] = tar_field(value, width)
    header[156:157] = kind
    header[157 : 157 + min(100, len(link))] = link[:100]
    header[257:265] = b"ustar\x0000"
    return summed(header)


def pax_block(name: bytes, records: list[tuple[str, bytes]]) -> bytes:
    """The extension header of a member, none without records."""
    body = b"".join(pax_record(k, v) for k, v in records)
    return tar_block(pax_name(name), b"x", len(body)) + body + bytes(-len(body) % BLOCK) if records else b""


def plain(name: bytes) -> bool:
    return name.isascii()


def tar_member(name: bytes, kind: str, size: int, mode: int, mtime: int, link: bytes = b"", owner: tuple[int, int] = (0, 0)) -> bytes:
    """All headers of a new member; pax records only for what the fields cannot hold."""
    records = []
    if not plain(name) or split_name(name) is None:
        records.append(("path", name))
    if link and (not plain(link) or len(link) > 100):
        records.append(("linkpath", link))
    for key, value, width in (("size", size, 12), ("uid", owner[0], 8), ("gid", owner[1], 8), ("mtime", mtime, 12)):
        if not 0 <= value < 8 ** (width - 1):
            records.append((key, b"%d" % value))
    code = {"file": b"0", "hardlink": b"1", "symlink": b"2", "directory": b"5"}[kind]
    return pax_block(name, records) + tar_block(name, code, size, mode, mtime, link, owner)


def tar_rewritten(unit, header: bytes, name: bytes | None = None, link: bytes | None = None, size: int | None = None) -> bytes:
    """The headers of a unit under another name, to another link target, or as a file of `size` that was a link.

    Records and extension headers that an edit doesn't touch stay as they were, in their order.
    """
    records, fresh = list(unit.pax), bytearray(header)

    def put(key: str, value: bytes | None) -> None:
        at = next((i for i, (k, _) in enumerate(records) if k == key), len(records))
        records[:] = [r for r in records if r[0] != key]
        if value is not None:
            records.insert(min(at, len(records)), (key, value))

    ustar = header[257:265] == b"ustar\x0000"
    if name is not None:
        fits = split_name(name) if ustar else (name, b"") if len(name) <= 100 else None
        if unit.sparse and any(k == "GNU.sparse.name" for k, _ in records):
            put("path", None)
            put("GNU.sparse.name", name)
        else:
            put("path", None if fits and plain(name) else name)
        leaf, prefix = fits or (name[:100], b"")
        fresh[:100] = leaf.ljust(100, b"\0")
        if ustar:
            fresh[345:500] = prefix.ljust(155, b"\0")
    if size is not None:
        put("linkpath", None)
        put("size", b"%d" % size if size >= 8**11 else None)
        fresh[124:136], fresh[156:157], fresh[157:257] = tar_field(size, 12), b"0", bytes(100)
    elif link is not None:
        put("linkpath", None if plain(link) and len(link) <= 100 else link)
        fresh[157:257] = link[:100].ljust(100, b"\0")
    block = pax_block(name if name is not None else unit.name, records)
    kept = [raw for kind, raw in unit.extensions if kind == b"L" and name is None or kind == b"K" and link is None and size is None]
    return block + b"".join(kept) + summed(fresh)


def tar_end(members: int) -> bytes:
    """Two empty blocks and what fills the last record, after `members` bytes."""
    return bytes(2 * BLOCK + -(members + 2 * BLOCK) % RECORD)


# ZIP, as values


def renamed_extra(extra: bytes) -> bytes:
    """Extra fields of an entry that gets another name: a copy of the old one is blanked, fields that mix names are refused."""
    from bindery.sources.layouts import extra_fields

    out, end = bytearray(extra), 0
    for kind, lo, hi in extra_fields(extra):
        if kind in NAMING:
            raise ValueError(f"extra field {kind:#06x} holds the old name")
        if kind == UNICODE_PATH:
            out[lo : lo + 2] = b"\xff\xff"
            out[lo + 4 : hi] = bytes(hi - lo - 4)
        end = hi
    if extra[end:].strip(b"\0"):
        raise ValueError("extra fields end in bytes that may hold the old name")
    return bytes(out)


def zip_local_renamed(header: bytes, name: bytes) -> bytes:
    n, e = struct.unpack_from("<HH", header, 26)
    out = bytearray(header[:30])
    struct.pack_into("<H", out, 6, int.from_bytes(out[6:8], "little") | 0x800)
    struct.pack_into("<H", out, 26, len(name))
    return bytes(out) + name + renamed_extra(header[30 + n : 30 + n + e])


def zip_central_moved(record: bytes, offset: int, size: int, packed: int, name: bytes | None = None, marker: bool = False) -> bytes:
    """A directory record for another place, and another name; its 64-bit field holds just what passes 32 bits."""
    from bindery.sources.layouts import extra_fields

    n, e, c = struct.unpack_from("<HHH", record, 28)
    out, old, extra, comment = bytearray(record[:46]), record[46 : 46 + n], record[46 + n : 46 + n + e], record[46 + n + e : 46 + n + e + c]
    wide = b"".join(v.to_bytes(8, "little") for v in (size, packed, offset) if v >= LIMIT32)
    fields = extra_fields(extra)
    rest = b"".join(extra[lo:hi] for kind, lo, hi in fields if kind != 1) + extra[fields[-1][2] if fields else 0 :]
    rest = (struct.pack("<HH", 1, len(wide)) + wide if wide or marker else b"") + rest
    if name is not None:
        rest = renamed_extra(rest)
        struct.pack_into("<H", out, 8, int.from_bytes(out[8:10], "little") | 0x800)
    if wide or marker:
        struct.pack_into("<H", out, 6, max(int.from_bytes(out[6:8], "little"), 45))
    struct.pack_into("<II", out, 20, min(packed, LIMIT32), min(size, LIMIT32))
    struct.pack_into("<HH", out, 28, len(old if name is None else name), len(rest))
    struct.pack_into("<H", out, 34, 0)
    struct.pack_into("<I", out, 42, min(offset, LIMIT32))
    return bytes(out) + (old if name is None else name) + rest + comment


# the same as columns, where SQL says it too


def ustar_cut(path: Column) -> Column:
    """Where an ASCII path is cut into prefix and name: 0 if it needs no cut, null if no cut fits."""
    size = F.length(path)
    slashes = F.filter(F.sequence(F.lit(1), F.least(size, F.lit(156))), lambda i: (F.substr(path, i, F.lit(1)) == "/") & (i < size) & (i > 1) & (size - i <= 100))
    return F.when(size <= 100, F.lit(0)).otherwise(F.array_max(slashes))


def pax_header_name(path: Column) -> Column:
    body = F.regexp_replace(path, "/+$", "")
    folder, leaf = F.regexp_extract(body, "^(.*/)?[^/]*$", 1), F.regexp_extract(body, "([^/]*)$", 1)
    head = F.concat(folder, F.lit("PaxHeader/"))
    room = F.lit(100) - F.length(head)
    return F.when(room > 0, F.concat(head, F.right(leaf, room))).otherwise(F.lit("PaxHeader"))


def tar_number(value: Column, width: int) -> Column:
    """The field's bytes in hexadecimal: octal and a NUL, or base 256."""
    text = F.conv(value.cast("string"), 10, 8)
    octal = F.concat(F.hex(F.lpad(text, width - 1, "0")), F.lit("00"))
    return F.when((value >= 0) & (F.length(text) < width), octal).otherwise(F.concat(F.when(value < 0, "FF").otherwise("80"), F.lpad(F.hex(value), 2 * (width - 1), F.when(value < 0, "F").otherwise("0"))))


def executable_filter(prefix: Column) -> Column:
    """x86, arm64 or none, by the magic numbers of the first bytes; prefix: binary, up to 64 KiB."""
    h = F.hex(prefix)
    at = lambda i, n: F.substr(h, F.lit(2 * i + 1), F.lit(2 * n))
    little = lambda i, n: F.concat(*[at(i + n - 1 - k, 1) for k in range(n)])
    magic = at(0, 4)
    cpu = F.when(magic.isin("CEFAEDFE", "CFFAEDFE"), little(4, 4)).otherwise(at(4, 4))
    mach = F.when(magic.isin("FEEDFACE", "FEEDFACF", "CEFAEDFE", "CFFAEDFE"), F.when(cpu.isin("00000007", "01000007"), "x86").when(cpu == "0100000C", "arm64"))
    machine = F.when(at(5, 1) == "01", little(18, 2)).when(at(5, 1) == "02", at(18, 2))
    elf = F.when((magic == "7F454C46") & (at(4, 1) == "02") & (machine == "00B7"), "arm64")
    offset = F.conv(little(60, 4), 16, 10).cast("long")
    pe = F.substr(h, (2 * F.least(offset, F.lit(1 << 20)) + 1).cast("int"), F.lit(12))
    kind = F.concat(F.substr(pe, F.lit(11), F.lit(2)), F.substr(pe, F.lit(9), F.lit(2)))
    dos = F.when((at(0, 2) == "4D5A") & (F.octet_length(prefix) >= 64) & F.startswith(pe, F.lit("50450000")), F.when(kind.isin("014C", "8664"), "x86").when(kind == "AA64", "arm64"))
    return F.when(F.octet_length(prefix) >= 20, F.coalesce(mach, elf, dos, F.lit("none"))).otherwise("none")
