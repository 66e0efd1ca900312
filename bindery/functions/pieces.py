"""One stream from pieces that tasks encode on their own: deflate, bzip2 and XZ.

Where a piece begins follows from the position in the content alone, so the bytes don't depend on the number of tasks.
"""

from __future__ import annotations

import bz2
import lzma
import struct
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.functions.checksums import crc32_combine
from bindery.functions.records import xz_number
from bindery.operators import ranges

WINDOW, DEFLATE_PIECE = 32 << 10, 1 << 20


# deflate: a piece sees the end of the one before as its dictionary


def deflate_piece(data: bytes, dictionary: bytes = b"", last: bool = True, level: int = 6) -> bytes:
    """A part of a raw deflate stream that ends on a byte; parts in order are one stream."""
    engine = zlib.compressobj(level, zlib.DEFLATED, -15, 8, 0, dictionary[-WINDOW:]) if dictionary else zlib.compressobj(level, zlib.DEFLATED, -15)
    return engine.compress(data) + engine.flush(zlib.Z_FINISH if last else zlib.Z_SYNC_FLUSH)


def deflated(pieces: DataFrame, keys: list[str], order: str, data: str, level: int = 6) -> DataFrame:
    """pieces with `block`, `crc` and `size`: the blocks of a key in order are its stream."""
    rows = ranges.previous(pieces.withColumn("_tail", F.substring(data, -WINDOW, WINDOW)), keys, [order], "_tail", "_dictionary")
    last = pieces.groupBy(*keys).agg(F.max(order).alias("_last"))
    rows = rows.join(last, keys)

    @F.pandas_udf("binary")
    def encode(part: pd.Series, before: pd.Series, end: pd.Series) -> pd.Series:
        return pd.Series([deflate_piece(bytes(p or b""), bytes(b or b""), bool(e), level) for p, b, e in zip(part, before, end, strict=True)], dtype=object)

    rows = rows.withColumn("block", encode(F.col(data), F.col("_dictionary"), F.col(order) == F.col("_last")))
    return rows.withColumn("crc", F.crc32(data)).withColumn("size", F.octet_length(data).cast("long")).drop("_tail", "_dictionary", "_last")


def gzip_of(blocks: list[bytes], crcs: list[int], sizes: list[int]) -> bytes:
    """A gzip member of a key's blocks; checksums are merged, not computed anew."""
    crc, size = 0, 0
    for c, n in zip(crcs, sizes, strict=True):
        crc, size = crc32_combine(crc, c, n), size + n
    return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + b"".join(blocks) + struct.pack("<II", crc, size & 0xFFFFFFFF)


# bzip2: blocks end anywhere in a byte, so they are put together bit by bit

BLOCK_MAGIC, END_MAGIC = 0x314159265359, 0x177245385090  # fixed values


def bzip2_cap(level: int = 9) -> int:
    """Bytes that make one block whatever they are: the first coding stage makes at most five of four."""
    return (level * 100_000 - 20) * 4 // 5


def bzip2_block(data: bytes, level: int = 9) -> tuple[int, int, int]:
    """(bits as a number, how many, checksum) of the one block of a piece of up to bzip2_cap() bytes."""
    if not 0 < len(data) <= bzip2_cap(level):
        raise ValueError("a piece of a block is empty or too large")
    raw = bz2.compress(data, level)
    whole, n = int.from_bytes(raw[4:], "big"), 8 * (len(raw) - 4)
    for pad in range(8):
        if whole >> pad + 32 & (1 << 48) - 1 == END_MAGIC and not whole & (1 << pad) - 1:
            crc = whole >> pad & 0xFFFFFFFF
            bits = whole >> pad + 80
            if bits >> n - pad - 80 - 80 & 0xFFFFFFFF == crc and bits >> n - pad - 80 - 48 == BLOCK_MAGIC:
                return bits, n - pad - 80, crc
    raise ValueError("no block found")


def bzip2_stream(blocks: list[tuple[int, int, int]], level: int = 9) -> bytes:
    """One stream of blocks in order; the stream's checksum is made of theirs."""
    out, held, bits, crc = bytearray(b"BZh%d" % level), 0, 0, 0
    for value, n, own in [*blocks, (END_MAGIC, 48, None), (None, 32, None)]:
        if own is not None:
            crc = ((crc << 1 | crc >> 31) & 0xFFFFFFFF) ^ own
        held, bits = held << n | (crc if value is None else value), bits + n
        rest = bits % 8
        out += (held >> rest).to_bytes(bits // 8, "big")
        held, bits = held & (1 << rest) - 1, rest
    return bytes(out + bytes([held << 8 - bits]) if bits else out)


# XZ: blocks stand on their own, an index at the end lists them


def xz_block(data: bytes, preset: int = 6) -> tuple[bytes, int, int]:
    """(bytes, size without padding, plain size) of a block with a CRC-32."""
    dictionary = (18, 20, 21, 22, 22, 23, 23, 24, 25, 26)[preset & 15]
    body = lzma.compress(data, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "preset": preset}])
    fields = b"\0" + xz_number(0x21) + xz_number(1) + bytes([2 * (dictionary - 12)])
    size = -(-(len(fields) + 1) // 4) * 4
    head = bytes([size // 4]) + fields
    head = head.ljust(size, b"\0")
    head += struct.pack("<I", zlib.crc32(head))
    unpadded = len(head) + len(body) + 4
    return head + body + bytes(-len(body) % 4) + struct.pack("<I", zlib.crc32(data)), unpadded, len(data)


def xz_stream(blocks: list[tuple[bytes, int, int]]) -> bytes:
    flags = b"\0\x01"
    index = b"\0" + xz_number(len(blocks)) + b"".join(xz_number(u) + xz_number(n) for _, u, n in blocks)
    index += bytes(-len(index) % 4)
    index += struct.pack("<I", zlib.crc32(index))
    tail = struct.pack("<I", len(index) // 4 - 1) + flags
    return b"\xfd7zXZ\0" + flags + struct.pack("<I", zlib.crc32(flags)) + b"".join(b for b, _, _ in blocks) + index + struct.pack("<I", zlib.crc32(tail)) + tail + b"YZ"


def cut(data: Column, piece: int) -> Column:
    """The pieces of a payload, (number, bytes) each."""
    count = F.greatest(F.lit(1), F.ceil(F.octet_length(data) / piece)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.alias("piece"), F.substring(data, i * piece + 1, F.lit(piece)).alias("bytes")))
