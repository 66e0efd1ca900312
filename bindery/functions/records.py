"""Binary records of ZIP, 7z and LHA archives, and names as those formats encode them."""

from __future__ import annotations

import struct
import unicodedata
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from bindery.functions.checksums import crc16_of
from bindery.functions.fields import LIMIT32


def nfc(path: str) -> Column:
    """Names in composed form."""

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    return run(path)


def cp932(path: str) -> Column:
    """Names in CP932, null where they don't come back the same."""

    @F.pandas_udf("binary")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: None if x is None else cp932_of(x))

    return run(path)


def cp932_of(name: str) -> bytes | None:
    try:
        raw = name.encode("cp932")
        return raw if raw.decode("cp932") == name else None
    except UnicodeError:
        return None


def zip_local(name: bytes, flags: int, method: int, stamp: int, crc: int, packed: int, size: int, extra: bytes = b"", version: int = 20) -> bytes:
    """Local header; stamp is DOS date << 16 | time. Sizes that pass 32 bits go to a ZIP64 field."""
    if max(packed, size) >= LIMIT32:
        extra, version, packed, size = struct.pack("<HHQQ", 1, 16, size, packed) + extra, max(version, 45), LIMIT32, LIMIT32
    return struct.pack("<IHHHIIIIHH", 0x04034B50, version, flags, method, stamp, crc, packed, size, len(name), len(extra)) + name + extra


def zip_central(name: bytes, flags: int, method: int, stamp: int, crc: int, packed: int, size: int, offset: int, attributes: int, extra: bytes = b"", version: int = 20) -> bytes:
    """Directory record, made by Unix; a ZIP64 field holds what passes 32 bits, in fixed order."""
    big = [v for v in (size, packed, offset) if v >= LIMIT32]
    if big:
        extra, version = struct.pack(f"<HH{len(big)}Q", 1, 8 * len(big), *big) + extra, max(version, 45)
    low = [min(v, LIMIT32) for v in (packed, size, offset)]
    return struct.pack("<IHHHHIIIIHHHHHII", 0x02014B50, 3 << 8 | version, version, flags, method, stamp, crc, low[0], low[1], len(name), len(extra), 0, 0, 0, attributes, low[2]) + name + extra


def zip_end(count: int, size: int, offset: int) -> bytes:
    """End record, after a ZIP64 end record and its locator where counts or offsets need them."""
    out = b""
    if count >= 0xFFFF or max(size, offset) >= LIMIT32:
        out = struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 3 << 8 | 45, 45, 0, 0, count, count, size, offset) + struct.pack("<IIQI", 0x07064B50, 0, offset + size, 1)
    return out + struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, min(count, 0xFFFF), min(count, 0xFFFF), min(size, LIMIT32), min(offset, LIMIT32), 0)


def zip_aes_extra(method: int, version: int) -> bytes:
    """Field of AES-256 entries, whose own method is 99."""
    return struct.pack("<HHHHBH", 0x9901, 7, version, 0x4541, 3, method)


def number(value: int) -> bytes:
    """7z integer: the leading ones of the first byte tell how many bytes follow."""
    for extra in range(8):
        if value < 1 << 7 * (extra + 1):
            return bytes([(0xFF00 >> extra & 255) | value >> 8 * extra]) + (value & (1 << 8 * extra) - 1).to_bytes(extra, "little")
    return b"\xff" + value.to_bytes(8, "little")


def xz_number(value: int) -> bytes:
    """XZ integer: seven bits a byte, the low ones first."""
    out = bytearray()
    while value >= 0x80:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    return bytes([*out, value])


def bits(flags: list[bool]) -> bytes:
    """Flags from the top bit of each byte."""
    flags = [*flags, *[False] * (-len(flags) % 8)]
    return bytes(sum(f << 7 - j for j, f in enumerate(flags[i : i + 8])) for i in range(0, len(flags), 8))


def seven_zip_header(folders: list[dict], files: list[dict], pack_at: int = 0) -> bytes:
    """Plain header. folders: coders (id, properties) from the packer to the filter on top of it, packed, sizes and crcs of their
    files; files: name, attributes, filetime, has_stream, directory."""
    out = bytearray(b"\x01")
    if folders:
        out += b"\x04\x06" + number(pack_at) + number(len(folders)) + b"\x09" + b"".join(number(f["packed"]) for f in folders) + b"\0"
        out += b"\x07\x0b" + number(len(folders)) + b"\0"
        for f in folders:
            out += number(len(f["coders"]))
            for code, properties in f["coders"]:
                out += bytes([len(code) | (0x20 if properties else 0)]) + code + (number(len(properties)) + properties if properties else b"")
            for i in range(len(f["coders"]) - 1):
                out += number(i + 1) + number(i)
        out += b"\x0c" + b"".join(number(sum(f["sizes"])) * len(f["coders"]) for f in folders) + b"\0"
        out += b"\x08\x0d" + b"".join(number(len(f["sizes"])) for f in folders)
        out += b"\x09" + b"".join(number(n) for f in folders for n in f["sizes"][:-1])
        out += b"\x0a\x01" + b"".join(struct.pack("<I", c) for f in folders for c in f["crcs"]) + b"\0\0"
    out += b"\x05" + number(len(files))

    def field(kind: int, body: bytes) -> bytes:
        return bytes([kind]) + number(len(body)) + body

    empty = [f for f in files if not f["has_stream"]]
    if empty:
        out += field(0x0E, bits([not f["has_stream"] for f in files]))
        if not all(f["directory"] for f in empty):
            out += field(0x0F, bits([not f["directory"] for f in empty]))
    if files:
        out += field(0x11, b"\0" + b"".join(f["name"].encode("utf-16-le") + b"\0\0" for f in files))
        out += field(0x14, b"\x01\0" + b"".join(struct.pack("<Q", f["filetime"]) for f in files))
        out += field(0x15, b"\x01\0" + b"".join(struct.pack("<I", f["attributes"]) for f in files))
    return bytes(out + b"\0\0")


def seven_zip_start(header: bytes, packed: int) -> bytes:
    """The first 32 bytes, which point to the header behind all packed data."""
    body = struct.pack("<QQI", packed, len(header), zlib.crc32(header))
    return b"7z\xbc\xaf\x27\x1c\0\4" + struct.pack("<I", zlib.crc32(body)) + body


def lha_header(method: str, path: str, packed: int, size: int, mtime: int, crc: int, mode: int) -> bytes:
    """Level-2 header: leaf and folder in fields of their own, a CRC-16 of the header, never a multiple of 256 long."""
    folder, _, leaf = path.rstrip("/").rpartition("/") if method != "-lhd-" else (path.rstrip("/"), "", "")
    names = [(1, cp932_of(leaf))] + ([(2, b"\xff".join(cp932_of(p) or b"" for p in folder.split("/")) + b"\xff")] if folder else [])
    if cp932_of(path) is None:
        raise ValueError(f"{path!r} has no CP932 form")
    fields = [(0, b"\0\0"), *names, (0x50, struct.pack("<H", mode))]
    tail = b"".join(struct.pack("<HB", len(body) + 3, kind) + body for kind, body in fields) + b"\0\0"
    total = 24 + len(tail)
    if total % 256 == 0:
        tail, total = tail + b"\0", total + 1
    head = struct.pack("<H5sIIIBBHc", total, method.encode(), packed, size, mtime, 0x20, 2, crc, b"U") + tail
    at = 24 + 3  # where the header's CRC stands, zero while it is computed
    return head[:at] + struct.pack("<H", crc16_of(head)) + head[at + 2 :]
