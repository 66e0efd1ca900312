"""One entry of an archive as its bytes: ZIP local records, tar members, LHA members.

An entry is a dict of ord, path, kind, data, mode, mtime and link; the last four may be missing or null.
"""

from __future__ import annotations

import lzma
import struct
import time
import zlib

from bindery.functions import crypto, headers, records
from bindery.functions.checksums import crc16_of
from bindery.functions.codecs import leveled
from bindery.functions.fields import STORED_EXTENSIONS, ZIP_METHODS
from bindery.functions.lh import static_huffman

#: Seconds that stand for no date.
NO_DATE = 1_700_000_001


def content(r: dict) -> bytes:
    """What an entry's stream holds: a symlink's target, a file's bytes, nothing of a folder."""
    return (r.get("link") or "").encode() if r["kind"] == "symlink" else bytes(r.get("data") or b"") if r["kind"] == "file" else b""


def mode_of(r: dict) -> int:
    if r["kind"] not in ("file", "directory", "symlink"):
        raise ValueError(f"{r['path']!r}: a {r['kind']} can't be stored in this form")
    kind = {"file": 0o100000, "directory": 0o040000, "symlink": 0o120000}[r["kind"]]
    return kind | (r.get("mode") or (0o755 if r["kind"] == "directory" else 0o644))


def seconds(r: dict) -> int:
    return NO_DATE if r.get("mtime") is None else r["mtime"]


def packed_lzma(data: bytes, preset: int = 6) -> tuple[bytes, bytes]:
    """Properties and stream of LZMA, the stream with an end mark."""
    alone = lzma.compress(data, lzma.FORMAT_ALONE, preset=preset)
    return alone[:5], alone[13:]


def dos_stamp(at: int) -> int:
    t = time.gmtime(at)
    y, mo, d, h, mi, s = (1980, 1, 1, 0, 0, 0) if t.tm_year < 1980 else (2107, 12, 31, 23, 59, 58) if t.tm_year > 2107 else t[:6]
    return (y - 1980) << 25 | mo << 21 | d << 16 | h << 11 | mi << 5 | s // 2


def zip_entry(r: dict, chosen: str, password: str | None = None, cipher: str = "aes", secret: bytes = b"", heuristic: bool = True, levels: dict | None = None) -> tuple[bytes, tuple]:
    """The local record with its payload, and what the directory says of it but for the offset."""
    data, name, mode = content(r), r["path"].encode(), mode_of(r)
    crc, extra = zlib.crc32(data), b""
    known = heuristic and r["path"].rpartition("/")[2].rpartition(".")[2].lower() in STORED_EXTENSIONS
    method = "stored" if r["kind"] != "file" or not data or known else chosen
    if method == "lzma":
        properties, packed = packed_lzma(data, (levels or {}).get("preset", 6))
        packed = b"\x09\x04" + struct.pack("<H", len(properties)) + properties + packed
    else:
        packed = leveled(method, **(levels or {}))(data)
    flags = (0 if r["path"].isascii() else 0x800) | (2 if method == "lzma" else 0)
    version = 63 if method in ("lzma", "zstd") else 46 if method == "bzip2" else 20
    code, listed = ZIP_METHODS[method], crc
    if password and r["kind"] != "directory":
        flags, salt = flags | 1, crypto.entry_salt(secret, r["path"], crc)
        if cipher == "aes":
            packed, kind, version = crypto.zip_aes(packed, password, salt), 1 if len(data) < 20 else 2, max(version, 51)
            extra, code, listed = records.zip_aes_extra(code, kind), 99, crc if kind == 1 else 0
        else:
            packed = crypto.zip_stream(packed, password, crc, salt)
    stamp = dos_stamp(seconds(r))
    local = records.zip_local(name, flags, code, stamp, listed, len(packed), len(data), extra, version) + packed
    return local, (name, flags, code, stamp, listed, len(packed), len(data), mode << 16 | (0x10 if r["kind"] == "directory" else 0), extra, version)


def zip_central(known: tuple, offset: int) -> bytes:
    name, flags, code, stamp, crc, packed, size, attributes, extra, version = known
    return records.zip_central(name, flags, code, stamp, crc, packed, size, offset, attributes, extra, version)


def tar_entry(r: dict) -> bytes:
    """Headers, data and padding of a member."""
    data = bytes(r.get("data") or b"") if r["kind"] == "file" else b""
    if r["kind"] not in ("file", "directory", "symlink", "hardlink"):
        raise ValueError(f"{r['path']!r}: a {r['kind']} can't be stored in this form")
    mode = r.get("mode") or (0o755 if r["kind"] == "directory" else 0o644)
    return headers.tar_member(r["path"].encode(), r["kind"], len(data), mode, seconds(r), (r.get("link") or "").encode()) + data + bytes(-len(data) % headers.BLOCK)


def lha_entry(r: dict, method: str) -> bytes:
    """Header of level 2 and payload; one that its codec doesn't make smaller is stored."""
    if r["kind"] == "symlink" or not 0 <= seconds(r) < 1 << 32:
        raise ValueError(f"{r['path']!r}: kind or date can't be stored in this form")
    data, mode = content(r), mode_of(r)
    packed = data if method == "lh0" else static_huffman(data, method)
    if len(packed) >= len(data):
        packed, method = data, "lh0"
    if r["kind"] == "directory":
        method = "lhd"
    return records.lha_header(f"-{method}-", r["path"], len(packed), len(data), seconds(r), crc16_of(data), mode) + packed
