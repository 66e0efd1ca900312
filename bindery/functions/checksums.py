"""Checksums and keys: built-in crc32, a mergeable CRC-32, and Arrow UDFs for the others."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def times(matrix: tuple[int, ...], vector: int) -> int:
    """A 32 x 32 matrix over GF(2), by columns, and a vector."""
    out, i = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[i]
        vector >>= 1
        i += 1
    return out


@functools.cache
def squared(power: int) -> tuple[int, ...]:
    """What 2**power zero bits do to a CRC-32."""
    if not power:
        return (0xEDB88320, *(1 << i for i in range(31)))
    half = squared(power - 1)
    return tuple(times(half, column) for column in half)


@functools.lru_cache(1 << 12)
def moved(length: int) -> tuple[int, ...]:
    """What `length` zero bytes do to a CRC-32; chunks mostly have few lengths."""
    out = tuple(1 << i for i in range(32))
    for power in range((length * 8).bit_length()):
        if length * 8 >> power & 1:
            out = tuple(times(squared(power), column) for column in out)
    return out


def crc32_combine(first: int, second: int, second_length: int) -> int:
    """CRC-32 of two parts from theirs: first is moved on by second_length zero bytes."""
    return times(moved(second_length), first) ^ second if second_length else first


def folded(n_keys: int):
    """One row for each run of rows of a key, sorted by key and order: the key, the first order, and the CRC and length of all chunks."""

    def run(batches):
        key, order, crc, size, schema = None, None, 0, 0, None

        def row():
            values = [*key, order, crc, size]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

        for batch in batches:
            schema = batch.schema
            columns = [c.to_pylist() for c in batch.columns]
            for i, own in enumerate(zip(*columns[:n_keys], strict=True)):
                if own != key:
                    if key is not None:
                        yield row()
                    key, order, crc, size = own, columns[n_keys][i], 0, 0
                crc, size = crc32_combine(crc, columns[n_keys + 1][i], columns[n_keys + 2][i]), size + columns[n_keys + 2][i]
        if key is not None:
            yield row()

    return run


def merged_crc32(chunks: DataFrame, keys: list[str], order: str, data: str) -> DataFrame:
    """CRC-32 and length of each key's chunks in order.

    Chunk CRCs are built-in; (crc, length) pairs are folded twice: within ranges of the sort order, so one key may reach over
    many tasks, and then a row a range.
    """
    pairs = chunks.select(*keys, F.col(order).alias("_o"), F.crc32(data).alias("_c"), F.octet_length(data).cast("long").alias("_n"))
    ranged = pairs.repartitionByRange(*keys, "_o").sortWithinPartitions(*keys, "_o").mapInArrow(folded(len(keys)), pairs.schema)
    whole = ranged.repartition(*keys).sortWithinPartitions(*keys, "_o").mapInArrow(folded(len(keys)), pairs.schema)
    return whole.select(*keys, F.col("_c").alias("crc32"), F.col("_n").alias("size"))


_CRC16 = []
for _i in range(256):
    _c = _i
    for _ in range(8):
        _c = _c >> 1 ^ (0xA001 if _c & 1 else 0)
    _CRC16.append(_c)


def crc16_of(data: bytes) -> int:
    crc = 0
    for b in data:
        crc = crc >> 8 ^ _CRC16[(crc ^ b) & 255]
    return crc


def _udf(kind: str, of):
    @F.pandas_udf(kind)
    def call(data: pd.Series) -> pd.Series:
        return data.map(lambda x: None if x is None else of(bytes(x)))

    return call


def crc16(data: str) -> Column:
    return _udf("int", crc16_of)(data)


def xxh32(data: str) -> Column:
    return _udf("long", lambda x: xxhash.xxh32_intdigest(x))(data)


def xxh64(data: str) -> Column:
    """Seed 0, as a signed long."""
    return _udf("long", lambda x: int(np.uint64(xxhash.xxh64_intdigest(x)).astype(np.int64)))(data)


def byte_sum(data: str) -> Column:
    return _udf("long", lambda x: int(np.frombuffer(x, np.uint8).sum(dtype=np.int64)))(data)


def zip_aes_key(password: str, salt: str) -> Column:
    """66 bytes: AES key, authentication key, password check; PBKDF2-HMAC-SHA1, 1,000 rounds."""
    return _udf("binary", lambda s: hashlib.pbkdf2_hmac("sha1", password.encode(), s, 1000, 66))(salt)


def seven_zip_key(password: str, cycles: int = 19) -> bytes:
    """SHA-256 over 2**cycles records of password (UTF-16LE) and counter."""
    secret, digest = password.encode("utf-16-le"), hashlib.sha256()
    for i in range(1 << cycles):
        digest.update(secret + i.to_bytes(8, "little"))
    return digest.digest()


def byte_counts(rows: DataFrame, column: str) -> DataFrame:
    """byte and n of all bytes of a column; a task sends one row a byte at most."""

    def run(batches):
        total = np.zeros(256, np.int64)
        for batch in batches:
            for data in batch.column(0):
                if data.is_valid:
                    total += np.bincount(np.frombuffer(data.as_buffer(), np.uint8), minlength=256)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found], pa.int64())], names=["byte", "n"])

    return rows.select(F.col(column).cast("binary").alias("data")).mapInArrow(run, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n"))
