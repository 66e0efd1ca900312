"""Payloads back from archives: ZIP methods and ciphers, 7z folders, LHA methods, compressed tars and single streams."""

from __future__ import annotations

import bz2
import functools
import gzip
import hashlib
import lzma
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard

from bindery.functions import crypto
from bindery.functions.lh import VARIANTS


class WrongPassword(ValueError):
    """No password where one is needed, or not the right one."""


# ZIP


def raw_lzma(data: bytes, properties: bytes, size: int | None = None) -> bytes:
    """LZMA without a header; with a size, no more than that is asked for."""
    first, dictionary = properties[0], int.from_bytes(properties[1:5], "little")
    chain = [{"id": lzma.FILTER_LZMA1, "dict_size": max(4096, dictionary), "lc": first % 9, "lp": first // 9 % 5, "pb": first // 45}]
    return lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=chain).decompress(data, -1 if size is None else size)


def zip_lzma(data: bytes, size: int) -> bytes:
    return raw_lzma(data[9:], data[4:9], size)


ZIP_DECODERS = {
    0: lambda d, n: d,
    8: lambda d, n: zlib.decompress(d, -15),
    12: lambda d, n: bz2.decompress(d),
    14: zip_lzma,
    93: lambda d, n: zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(d),
    95: lambda d, n: lzma.decompress(d, lzma.FORMAT_XZ),
}


def zip_payload(raw: bytes, method: int, size: int, crc: int, flags: int, stamp: int, extra: bytes, password: str | None) -> bytes:
    """An entry's bytes; ciphers are undone, sizes and checksums held against the directory."""
    checked = True
    if flags & 1:
        if password is None:
            raise WrongPassword("a password is needed")
        try:
            if method == 99:
                at = next(a for k, a, _ in _fields(extra) if k == 0x9901)
                version, _, _, method = struct.unpack_from("<HHBH", extra, at + 4)
                raw, checked = crypto.zip_aes_opened(raw, password), version == 1
            else:
                raw = crypto.zip_stream_opened(raw, password, (stamp & 0xFFFF) << 16 if flags & 8 else crc)
        except ValueError as e:
            raise WrongPassword(str(e)) from None
    if method not in ZIP_DECODERS:
        raise ValueError(f"ZIP method {method} can't be read")
    data = ZIP_DECODERS[method](raw, size) if size or method else b""
    if len(data) != size or checked and zlib.crc32(data) != crc:
        raise ValueError("size or checksum of an entry")
    return data


def _fields(extra: bytes):
    from bindery.sources.layouts import extra_fields

    return extra_fields(extra)


# filters of 7z


def undo_delta(data: bytes, distance: int = 1) -> bytes:
    a = np.frombuffer(data, np.uint8)
    whole = np.concatenate([a, np.zeros(-len(a) % distance, np.uint8)]).reshape(-1, distance)
    return np.cumsum(whole, axis=0, dtype=np.uint8).ravel()[: len(a)].tobytes()


def undo_x86(data: bytes) -> bytes:
    """The library's filter, behind a packer that is applied at once."""
    packer = {"id": lzma.FILTER_LZMA2, "preset": 0}
    return lzma.decompress(lzma.compress(data, lzma.FORMAT_RAW, filters=[packer]), lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_X86}, packer]) if data else b""


def coder_plain(coder, data: bytes, size: int, password: str | None) -> bytes:
    from bindery.functions.codecs import branch_arm64

    code, properties = coder.id, coder.properties
    if code == b"\x00":
        return data
    if code == b"\x21":
        n = properties[0]
        chain = [{"id": lzma.FILTER_LZMA2, "dict_size": 0xFFFFFFFF if n == 40 else (2 | n & 1) << n // 2 + 11}]
        return lzma.decompress(data, lzma.FORMAT_RAW, filters=chain)
    if code == b"\x03\x01\x01":
        return raw_lzma(data, properties, size)
    if code == b"\x04\x01\x08":
        return zlib.decompress(data, -15)
    if code == b"\x04\x02\x02":
        return bz2.decompress(data)
    if code == b"\x03":
        return undo_delta(data, properties[0] + 1 if properties else 1)
    if code == b"\x03\x03\x01\x03":
        return undo_x86(data)
    if code == b"\x0a":
        return branch_arm64(data, undo=True)
    if code == b"\x06\xf1\x07\x01":
        if password is None:
            raise WrongPassword("a password is needed")
        cycles, salt, iv = aes_properties(properties)
        return crypto.cbc_decrypted(seven_zip_key(password, cycles, salt), iv.ljust(16, b"\0"), data)[:size]
    raise ValueError(f"7z method {code.hex()} can't be read")


def aes_properties(raw: bytes) -> tuple[int, bytes, bytes]:
    """Cycles, salt and IV."""
    first = raw[0]
    if not first & 0xC0:
        return first & 63, b"", b""
    n_salt, n_iv = (first >> 7 & 1) + (raw[1] >> 4), (first >> 6 & 1) + (raw[1] & 15)
    return first & 63, raw[2 : 2 + n_salt], raw[2 + n_salt : 2 + n_salt + n_iv]


@functools.lru_cache(16)
def seven_zip_key(password: str, cycles: int, salt: bytes = b"") -> bytes:
    secret = salt + password.encode("utf-16-le")
    if cycles == 63:
        return secret[:32].ljust(32, b"\0")
    digest, step = hashlib.sha256(), 1 << 12
    for at in range(0, 1 << cycles, step):
        digest.update(b"".join(secret + i.to_bytes(8, "little") for i in range(at, min(at + step, 1 << cycles))))
    return digest.digest()


def folder_plain(folder, packs: list[bytes], password: str | None = None, check: bool = True) -> bytes:
    """The bytes of a chain of one-input coders, from the packed stream to the final output."""
    if len(packs) != 1 or any((c.inputs, c.outputs) != (1, 1) for c in folder.coders):
        raise ValueError("a folder of several packed streams can't be read")
    data, i, by_output = packs[0], folder.packed_inputs[0], {o: i for i, o in folder.binds}
    for _ in folder.coders:
        try:
            data = coder_plain(folder.coders[i], data, folder.sizes[i], password)
        except (lzma.LZMAError, zlib.error, OSError, EOFError) as e:
            if folder.encrypted:
                raise WrongPassword("wrong password") from None
            raise ValueError(f"a folder doesn't decode: {e}") from None
        if i == folder.final:
            break
        i = by_output[i]
    if len(data) < folder.size or check and folder.crc is not None and zlib.crc32(data[: folder.size]) != folder.crc:
        raise WrongPassword("wrong password") if folder.encrypted else ValueError("checksum of a folder")
    return data[: folder.size]


# LHA


class BitsIn:
    """Bits from the top of each byte; zeros after the end."""

    def __init__(self, data: bytes):
        self.whole, self.n, self.at = int.from_bytes(data + b"\0\0\0\0", "big"), 8 * len(data) + 32, 0
        self.data = data + b"\0" * 8

    def peek16(self) -> int:
        at = self.at
        return int.from_bytes(self.data[at >> 3 : (at >> 3) + 3], "big") >> 8 - (at & 7) & 0xFFFF

    def take(self, n: int) -> int:
        at = self.at
        self.at += n
        return int.from_bytes(self.data[at >> 3 : (at >> 3) + 4], "big") >> 32 - (at & 7) - n & (1 << n) - 1 if n else 0


def table_of(depth: list[int]) -> list[tuple[int, int]]:
    """(symbol, bits) for all values of the next 16 bits."""
    out: list[tuple[int, int]] = []
    for n, s in sorted((n, s) for s, n in enumerate(depth) if n):
        out += [(s, n)] * (1 << 16 - n)
    return out + [(0, 0)] * ((1 << 16) - len(out))


def small_table(bits: BitsIn, width: int, gap: bool) -> list[tuple[int, int]]:
    n = bits.take(width)
    if not n:
        return [(bits.take(width), 0)] * (1 << 16)
    depth: list[int] = []
    while len(depth) < n:
        d = bits.take(3)
        while d >= 7 and bits.take(1):
            d += 1
        depth.append(d)
        if gap and len(depth) == 3:
            depth += [0] * bits.take(2)
    return table_of(depth[: max(n, len(depth))])


def lh_plain(data: bytes, variant: str, size: int) -> bytes:
    """The inverse of lh.static_huffman."""
    _, width = VARIANTS[variant]
    bits, out, left = BitsIn(data), bytearray(), 0
    while len(out) < size:
        if not left:
            left = bits.take(16) or 1 << 16
            outer = small_table(bits, 5, True)
            n = bits.take(9)
            if n:
                depth: list[int] = []
                while len(depth) < n:
                    s, used = outer[bits.peek16()]
                    bits.at += used
                    if s > 2:
                        depth.append(s - 2)
                    else:
                        depth += [0] * (1 if s == 0 else bits.take(4) + 3 if s == 1 else bits.take(9) + 20)
                symbols = table_of(depth)
            else:
                symbols = [(bits.take(9), 0)] * (1 << 16)
            places = small_table(bits, width, False)
        left -= 1
        s, used = symbols[bits.peek16()]
        bits.at += used
        if s < 256:
            out.append(s)
            continue
        k, used = places[bits.peek16()]
        bits.at += used
        back = (1 << k - 1 | bits.take(k - 1) if k > 1 else k) + 1
        n = s - 253
        if back > len(out):
            raise ValueError("a match begins before the data")
        if back >= n:
            out += out[-back : len(out) - back + n]
        else:
            piece = bytes(out[-back:])
            out += (piece * (n // back + 1))[:n]
    return bytes(out[:size])


def lha_payload(raw: bytes, method: str, size: int, crc: int) -> bytes:
    from bindery.functions.checksums import crc16_of

    name = method.strip("-")
    if name in ("lh0", "lz4", "pm0", "lhd"):
        data = raw
    elif name in VARIANTS:
        data = lh_plain(raw, name, size)
    else:
        raise ValueError(f"LHA method {method} can't be read")
    if len(data) != size or crc16_of(data) != crc and name != "lhd":
        raise ValueError("size or checksum of a member")
    return data


# streams


def arrow_plain(data: bytes, codec: str) -> bytes:
    """Joined streams of a codec that Arrow reads."""
    with pa.CompressedInputStream(pa.BufferReader(data), codec) as stream:
        return stream.read()


def lz4_plain(data: bytes) -> bytes:
    return arrow_plain(data, "lz4")


def brotli_plain(data: bytes) -> bytes:
    return arrow_plain(data, "brotli")


def lzw_plain(data: bytes) -> bytes:
    table, width, bit, out, last, in_width = [bytes([i]) for i in range(256)] + [b""], 9, 24, [], None, 0
    total = len(data) * 8
    while bit + width <= total:
        code = int.from_bytes(data[bit // 8 : bit // 8 + 4], "little") >> bit % 8 & ((1 << width) - 1)
        bit, in_width = bit + width, in_width + 1
        word = table[code] if code < len(table) else last + last[:1]
        out.append(word)
        if last is not None and len(table) < 1 << 16:
            table.append(last + word[:1])
        last = word
        if len(table) + 1 > 1 << width and width < 16:
            bit += (-in_width % 8) * width
            width, in_width = width + 1, 0
    return b"".join(out)


def lzip_members(data: bytes) -> list[tuple[int, int]]:
    """(from, to) of every member, from the sizes in their trailers."""
    out, at = [], len(data)
    while at > 0:
        size = int.from_bytes(data[at - 8 : at], "little")
        out.append((at - size, at))
        at -= size
    return out[::-1]


def lzip_plain(data: bytes) -> bytes:
    parts = []
    for lo, hi in lzip_members(data):
        code = data[lo + 5]
        size = 1 << (code & 31)
        size -= size // 16 * (code >> 5)
        head = b"\x5d" + size.to_bytes(4, "little") + b"\xff" * 8
        part = lzma.decompress(head + data[lo + 6 : hi - 20], lzma.FORMAT_ALONE)
        if zlib.crc32(part) != int.from_bytes(data[hi - 20 : hi - 16], "little"):
            raise ValueError("checksum of a member")
        parts.append(part)
    return b"".join(parts)


STREAM_DECODERS = {
    "gzip": gzip.decompress,
    "bzip2": bz2.decompress,
    "xz": lambda d: lzma.decompress(d, lzma.FORMAT_XZ),
    "lzma": lambda d: lzma.decompress(d, lzma.FORMAT_ALONE),
    "zstd": lambda d: zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(d),
    "lzip": lzip_plain,
    "lz4": lz4_plain,
    "compress": lzw_plain,
    "brotli": brotli_plain,
}


#: Decoders that take a stream bit by bit, a new one for each of joined streams.
ENGINES = {"gzip": lambda: zlib.decompressobj(31), "bzip2": bz2.BZ2Decompressor, "xz": lambda: lzma.LZMADecompressor(lzma.FORMAT_XZ), "zstd": lambda: zstandard.ZstdDecompressor().decompressobj()}
#: Packed bytes that are decoded at once.
READ = 1 << 16


def streamed(src, codec: str):
    """(plain bytes, where a stream ends in the file or null) of a file of joined streams, as it is decoded; what can't be decoded in
    parts comes whole."""
    if codec == "lzip":
        for lo, hi in lzip_spans(src):
            yield lzip_plain(src.some(lo, hi - lo)), hi
        return
    if codec not in ENGINES:
        yield STREAM_DECODERS[codec](src.some(0, src.length)), src.length
        return
    at, engine, begun, whole = 0, ENGINES[codec](), False, 0
    while at < src.length:
        n = min(READ, src.length - at)
        packed, at = src.some(at, n), at + n
        while packed:
            if not begun and codec in ("gzip", "xz") and not packed.strip(b"\0"):
                break  # padding after a stream
            try:
                plain, begun = engine.decompress(packed), True
            except (OSError, lzma.LZMAError):
                if whole and not begun and codec in ("bzip2", "xz"):
                    return  # no stream: the library leaves out what follows too
                raise
            if not engine.eof:
                yield plain, None
                break
            packed = engine.unused_data
            yield plain, at - len(packed)
            engine, begun, whole = ENGINES[codec](), False, whole + 1
    if begun:
        raise ValueError("a stream ends early")


def lzip_spans(src) -> list[tuple[int, int]]:
    """lzip_members() by reads of their trailers."""
    out, at = [], src.length
    while at > 0:
        size = int.from_bytes(src.some(at - 8, 8), "little")
        if not 26 < size <= at:
            raise ValueError("size of a member")
        out.append((at - size, at))
        at -= size
    return out[::-1]


class Stream:
    """A compressed file that is read like its plain bytes, forwards: what lies before the last read is given up."""

    def __init__(self, src, codec: str):
        self.parts, self.start, self.held, self.done = streamed(src, codec), 0, bytearray(), False

    def more(self, at: int) -> bool:
        """Whether there is a byte at a place; all from the last read to there is held."""
        while not self.done and at >= self.start + len(self.held):
            part = next(self.parts, None)
            self.done = part is None
            self.held += part[0] if part else b""
        return at < self.start + len(self.held)

    def read(self, at: int, n: int) -> bytes:
        from bindery.sources.layouts import Refusal

        if at < self.start or n and not self.more(at + n - 1):
            raise Refusal("R8", f"{n} bytes at {at} are out of the image")
        if at - self.start > 1 << 20:
            del self.held[: at - self.start]
            self.start = at
        return bytes(self.held[at - self.start : at - self.start + n])

    def rest(self) -> bytes:
        """All from what is held to the end."""
        self.more(1 << 62)
        return bytes(self.held)


def stream_chunks(data: bytes, codec: str) -> list[tuple[int, int, int]]:
    """(from, to, plain size) of each stream that stands on its own in a file of joined streams; one for the others."""

    class Held:
        length = len(data)

        def some(self, at: int, n: int) -> bytes:
            return data[at : at + n]

    return chunks_of(streamed(Held(), codec))


def chunks_of(parts, put=None) -> list[tuple[int, int, int]]:
    """(from, to, plain size) of each stream of streamed(); put is given what is decoded."""
    out, at, n = [], 0, 0
    for plain, end in parts:
        n += len(plain)
        if put:
            put(plain)
        if end is not None:
            out.append((at, end, n))
            at, n = end, 0
    return out
