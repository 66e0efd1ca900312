"""Codecs by name, on whole payloads or chunks; chunk borders come from content positions only."""

from __future__ import annotations

import bz2
import functools
import gzip
import lzma
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.functions.bits import joined
from bindery.functions.lh import static_huffman


def deflate_raw(data: bytes, level: int = 6, dictionary: bytes = b"") -> bytes:
    engine = zlib.compressobj(level, zlib.DEFLATED, -15, 8, 0, dictionary[-32768:]) if dictionary else zlib.compressobj(level, zlib.DEFLATED, -15)
    return engine.compress(data) + engine.flush()


def lzip(data: bytes) -> bytes:
    """One lzip member: LZMA1 with lc 3, lp 0, pb 2 and a trailer of CRC and sizes."""
    code = min(29, max(12, (max(len(data), 1) - 1).bit_length()))
    body = lzma.compress(data, lzma.FORMAT_ALONE, filters=[{"id": lzma.FILTER_LZMA1, "dict_size": 1 << code}])[13:]
    head = b"LZIP\1" + bytes([code])
    return head + body + struct.pack("<IQQ", zlib.crc32(data), len(data), len(head) + len(body) + 20)


def lz4_frame(data: bytes, block: int = 4 << 20) -> bytes:
    """LZ4 frame of independent blocks, with content checksum."""
    pack = pa.Codec("lz4_raw").compress
    head = bytes([0x64, 0x70])
    out = [b"\x04\x22\x4d\x18", head, bytes([xxhash.xxh32_intdigest(head) >> 8 & 255])]
    for at in range(0, len(data), block):
        part = data[at : at + block]
        packed = pack(part, asbytes=True)
        out += [struct.pack("<I", len(packed)), packed] if len(packed) < len(part) else [struct.pack("<I", len(part) | 1 << 31), part]
    return b"".join([*out, struct.pack("<II", 0, xxhash.xxh32_intdigest(data))])


def brotli(data: bytes, level: int = 2) -> bytes:
    """One Brotli stream."""
    return pa.Codec("brotli", level).compress(data, asbytes=True) if data else b"\x06"  # an empty last block


def unix_compress(data: bytes) -> bytes:
    """LZW with codes of 9 to 16 bits and block mode, the table is kept once full.

    A code may use the width that numbers every entry there is; codes of one width are 2^k, so the groups of eight are always full.
    """
    if not data:
        return b"\x1f\x9d\x90"
    table, put = {}, []
    found, emit, free, current = table.get, put.append, 257, data[0]
    for b in memoryview(data)[1:]:
        key = current << 8 | b
        longer = found(key)
        if longer is not None:
            current = longer
            continue
        emit(current)
        current = b
        if free < 1 << 16:
            table[key] = free
            free += 1
    emit(current)
    widths = np.frexp(np.arange(len(put), dtype=np.float64) + 256)[1].clip(9, 16)
    return b"\x1f\x9d\x90" + joined(np.array(put, np.uint64), widths, big=False)[0]


CODECS = {
    "stored": bytes,
    "deflate": deflate_raw,
    "zlib": lambda d: zlib.compress(d, 6),
    "gzip": lambda d: gzip.compress(d, 6, mtime=0),
    "bzip2": lambda d: bz2.compress(d, 9),
    "xz": lambda d: lzma.compress(d, lzma.FORMAT_XZ),
    "lzma": lambda d: lzma.compress(d, lzma.FORMAT_ALONE),
    "lzip": lzip,
    "zstd": lambda d: zstandard.ZstdCompressor(level=3, write_checksum=True).compress(d),
    "lz4": lz4_frame,
    "compress": unix_compress,
    "brotli": brotli,
    "lh5": lambda d: static_huffman(d, "lh5"),
    "lh6": lambda d: static_huffman(d, "lh6"),
    "lh7": lambda d: static_huffman(d, "lh7"),
}


def leveled(codec: str, deflate: int = 6, bzip2: int = 9, zstd: int = 3, preset: int = 6):
    """The codec at chosen levels; those without levels as they are. A preset may be made extreme (lzma.PRESET_EXTREME)."""
    chosen = {
        "deflate": lambda d: deflate_raw(d, deflate),
        "zlib": lambda d: zlib.compress(d, deflate),
        "gzip": lambda d: gzip.compress(d, deflate, mtime=0),
        "bzip2": lambda d: bz2.compress(d, bzip2),
        "xz": lambda d: lzma.compress(d, lzma.FORMAT_XZ, preset=preset),
        "lzma": lambda d: lzma.compress(d, lzma.FORMAT_ALONE, preset=preset),
        "zstd": lambda d: zstandard.ZstdCompressor(level=zstd, write_checksum=True).compress(d),
    }
    return chosen.get(codec, CODECS[codec])


#: Codecs whose outputs may be written one after the other: the parts decode to the joined data.
JOINABLE = ("gzip", "bzip2", "xz", "lzip", "zstd", "lz4")


def slices(batch: pa.RecordBatch, max_bytes: int = 1 << 20):
    """Parts of a batch of about max_bytes each, or a row."""
    step = max(1, int(batch.num_rows * max_bytes / max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


OUT_BYTES, OUT_ROWS = 4 << 20, 10_000


def gathered(found, schema: pa.Schema):
    """Batches of rows (tuples) of about OUT_BYTES, by the bytes of their binary columns."""
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
    held, size = [], 0
    for row in found:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, bytes))
        if size > OUT_BYTES or len(held) >= OUT_ROWS:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def encoded(data: str, codec: str) -> Column:
    """Arrow UDF of a codec over a binary column, null stays null."""
    encode = CODECS[codec]

    @F.pandas_udf("binary")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: None if x is None else encode(bytes(x)))

    return run(data)


def measured(rows: DataFrame, ident: str, columns: dict[str, tuple[pa.DataType, str, object]]) -> DataFrame:
    """ident and what functions of each payload (`data`) tell, null of a null; columns: Arrow type, SQL type and function by name.

    Payloads go through Python one by one, and only what is told of them comes back, so a task never holds a batch in all its forms.
    """
    kinds = ", ".join([f"{ident} {dict(rows.dtypes)[ident]}", *[f"{c} {sql}" for c, (_, sql, _) in columns.items()]])

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                payloads = part.column(1)
                told = [[] for _ in columns]
                for p in payloads:
                    data = p.as_py()
                    for out, (_, _, of) in zip(told, columns.values(), strict=True):
                        out.append(None if data is None else of(data))
                arrays = [pa.array(out, kind) for out, (kind, _, _) in zip(told, columns.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=[ident, *columns])

    return rows.select(ident, "data").mapInArrow(run, kinds)


def delta(data: bytes, distance: int = 1) -> bytes:
    a = np.frombuffer(data, np.uint8)
    before = np.concatenate([np.zeros(min(distance, len(a)), np.uint8), a[:-distance]])
    return (a - before).tobytes()


def branch_x86(data: bytes) -> bytes:
    """Jump targets of x86 code made absolute: the library's filter, seen through a packer that is undone at once."""
    packer = {"id": lzma.FILTER_LZMA2, "preset": 0}
    return lzma.decompress(lzma.compress(data, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_X86}, packer]), lzma.FORMAT_RAW, filters=[packer]) if data else b""


def branch_arm64(data: bytes, undo: bool = False) -> bytes:
    """BL targets, and ADRP pages within 512 MB, made absolute; instructions are aligned, so all are converted at once."""
    n = len(data) // 4
    code, at = np.frombuffer(data, "<u4", n).copy(), np.arange(n, dtype=np.uint32)
    sign = np.uint32(0xFFFFFFFF if undo else 1)
    with np.errstate(over="ignore"):
        calls = code >> 26 == 0x25
        page = (code >> 29 & 3) | (code >> 3 & 0x1FFFFC)
        near = (code & 0x9F000000 == 0x90000000) & ((page + 0x20000) & 0x1C0000 == 0)
        moved = page + sign * (at * 4 >> 12)
        packed = (code & 0x9000001F) | (moved & 3) << 29 | (moved & 0x3FFFC) << 3 | np.where(moved & 0x20000, np.uint32(0xE00000), np.uint32(0))
        code = np.where(calls, 0x94000000 | (code + sign * at & 0x3FFFFFF), np.where(near, packed, code)).astype("<u4")
    return code.tobytes() + data[n * 4 :]


FILTERS = {"delta": delta, "x86": branch_x86, "arm64": branch_arm64}


def filtered(data: str, kind: str, distance: int = 1) -> Column:
    """Reversible byte filters before compression: delta, x86 and arm64 branches."""
    if kind not in FILTERS:
        raise ValueError(f"unknown filter {kind}")
    return converted(data, (lambda x: delta(x, distance)) if kind == "delta" else FILTERS[kind])


def undo(data: bytes, kind: str, distance: int = 1) -> bytes:
    from bindery.functions.decoders import undo_delta, undo_x86

    return {"delta": lambda x: undo_delta(x, distance), "x86": undo_x86, "arm64": lambda x: branch_arm64(x, undo=True)}[kind](data)


UNFILTERS = {kind: functools.partial(undo, kind=kind) for kind in FILTERS}


def unfiltered(data: Column, kind: str, distance: int = 1) -> Column:
    """The inverse of filtered()."""
    return converted(data, lambda x: undo(x, kind, distance))


def converted(data, convert) -> Column:
    @F.pandas_udf("binary")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: None if x is None else convert(bytes(x)))

    return run(data)
