"""One file from many tasks: segments are ranges of existing files or bytes, in order; tasks write disjoint ranges.

segments: ord long, part int, src string, src_lo long, src_hi long, bytes binary. A segment has either a source range or
bytes. Bytes are spooled first, to a file a task, and are ranges from then on: what is put in order, joined and laid out are
numbers. The file is staged beside its destination, written, read back, and published by one rename; what is staged and
spooled is the only thing ever removed. All machines must see the folder.
"""

from __future__ import annotations

import contextlib
import os
import shutil
import uuid
import zlib
from collections import OrderedDict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.operators import ranges
from bindery.shipping import checkpointed

SEGMENTS = "ord long, part int, src string, src_lo long, src_hi long, bytes binary"
PIECE = 32 << 20  # bytes that a row may make a task write
FILES = 64  # sources that a task has open at once


class OutputError(ValueError):
    """What was written is not what was planned."""


def literal(order: Column, part: int, data: Column) -> list[Column]:
    return [order.cast("long").alias("ord"), F.lit(part).alias("part"), F.lit(None).cast("string").alias("src"), F.lit(None).cast("long").alias("src_lo"), F.lit(None).cast("long").alias("src_hi"), data.cast("binary").alias("bytes")]


def carried(order: Column, part: int, src: Column, lo: Column, hi: Column) -> list[Column]:
    return [order.cast("long").alias("ord"), F.lit(part).alias("part"), src.alias("src"), lo.cast("long").alias("src_lo"), hi.cast("long").alias("src_hi"), F.lit(None).cast("binary").alias("bytes")]


def length() -> Column:
    return F.coalesce(F.col("src_hi") - F.col("src_lo"), F.octet_length("bytes").cast("long"), F.lit(0))


@contextlib.contextmanager
def spool(dest: str):
    """A new folder beside dest, which goes with all that is in it."""
    folder = os.path.join(os.path.dirname(os.path.abspath(dest)), f".{os.path.basename(dest)}.{uuid.uuid4().hex}.parts")
    os.mkdir(folder)
    try:
        yield folder
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def spooled(segments: DataFrame, folder: str) -> DataFrame:
    """segments, cut, of ranges alone: bytes stand in a file of the task, one after the other. Each attempt has its own file."""

    def run(batches):
        path, at, file = os.path.join(folder, uuid.uuid4().hex), 0, None
        try:
            for batch in batches:
                src, lo, hi = (batch.column(k).to_pylist() for k in (2, 3, 4))
                for i, data in enumerate(batch.column(5)):
                    if src[i] is None and data.is_valid and (view := data.as_buffer()).size:
                        file = file or open(path, "xb")
                        file.write(view)
                        src[i], lo[i], hi[i] = path, at, at + view.size
                        at = hi[i]
                kept = [pa.array(src, pa.string()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *kept], names=["ord", "part", "src", "src_lo", "src_hi"])
            if file:
                file.flush()
                os.fsync(file.fileno())
        finally:
            if file:
                file.close()

    return checkpointed(segments.select("ord", "part", "src", "src_lo", "src_hi", "bytes").mapInArrow(run, "ord long, part int, src string, src_lo long, src_hi long"))


def laid_out(segments: DataFrame) -> DataFrame:
    """spooled segments with `lo`, where each begins in the output; empty ones are gone."""
    n = F.coalesce(F.col("src_hi") - F.col("src_lo"), F.lit(0))
    return ranges.running(segments.filter(n > 0), [], ["ord", "part"], n, "lo")


def coalesced(segments: DataFrame) -> DataFrame:
    """laid-out segments in which source ranges that follow one another, in the source and in the output, are one."""
    own = segments.withColumn("hi", F.col("src_hi"))
    wide = ranges.wide_key(own, ["src"])
    joined = (F.col("_hi") == F.col("src_lo")) & (F.col("_end") == F.col("lo"))
    marked = ranges.previous(ranges.previous(own, ["src"], ["lo"], "hi", "_hi", wide).withColumn("_stop", F.col("lo") + F.col("src_hi") - F.col("src_lo")), ["src"], ["lo"], "_stop", "_end", wide)
    runs = ranges.islands(marked, ["src"], ["lo"], joined, wide=wide)
    return runs.groupBy("src", "island").agg(F.min("src_lo").alias("src_lo"), F.max("src_hi").alias("src_hi"), F.min("lo").alias("lo")).select("lo", "src", "src_lo", "src_hi")


def pieces(laid: DataFrame) -> DataFrame:
    """lo, src, src_lo, n: ranges cut to what one row writes at once."""
    cut = laid.withColumn("_n", F.col("src_hi") - F.col("src_lo")).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / PIECE))))
    at = F.col("_k") * PIECE
    return cut.select((F.col("lo") + at).alias("lo"), "src", (F.col("src_lo") + at).alias("src_lo"), F.least(F.lit(PIECE), F.col("_n") - at).alias("n"))


def read_fully(file: int, at: int, n: int) -> bytes:
    out = []
    while n:
        part = os.pread(file, n, at)
        if not part:
            raise OutputError("a source ended early")
        out.append(part)
        at, n = at + len(part), n - len(part)
    return b"".join(out)


class Sources:
    """Files by path, of which the least used are closed."""

    def __init__(self):
        self.open: OrderedDict[str, int] = OrderedDict()

    def __call__(self, path: str) -> int:
        if path not in self.open:
            if len(self.open) >= FILES:
                os.close(self.open.popitem(last=False)[1])
            self.open[path] = os.open(path, os.O_RDONLY)
        self.open.move_to_end(path)
        return self.open[path]

    def close(self) -> None:
        for file in self.open.values():
            os.close(file)


STEP = 4 << 20  # bytes of a piece that a task holds


def writing(staged: str):
    """Writes rows of pieces(); gives lo, n and the CRC-32 of each. Running it again writes the same bytes again."""

    def run(rows):
        out, sources = os.open(staged, os.O_WRONLY), Sources()
        try:
            for batch in rows:
                done = []
                for lo, src, src_lo, n in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                    crc, file = 0, sources(src)
                    for skip in range(0, n, STEP):
                        data = read_fully(file, src_lo + skip, min(STEP, n - skip))
                        view, at, crc = memoryview(data), lo + skip, zlib.crc32(data, crc)
                        while view:
                            wrote = os.pwrite(out, view, at)
                            view, at = view[wrote:], at + wrote
                    done.append((lo, n, crc))
                if done:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*done, strict=True)], names=["lo", "n", "crc"])
            os.fsync(out)
        finally:
            os.close(out)
            sources.close()

    return run


def reading(staged: str):
    """Rows (lo, n, crc) whose bytes in the file have another checksum."""

    def run(rows):
        file = os.open(staged, os.O_RDONLY)

        def crc_of(lo: int, n: int) -> int:
            crc = 0
            for skip in range(0, n, STEP):
                crc = zlib.crc32(read_fully(file, lo + skip, min(STEP, n - skip)), crc)
            return crc

        try:
            for batch in rows:
                wrong = [r for r in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True) if crc_of(r[0], r[1]) != r[2]]
                if wrong:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*wrong, strict=True)], names=["lo", "n", "crc"])
        finally:
            os.close(file)

    return run


@dataclass
class Statistics:
    """What a commit did: how it was written, its bytes, and how many of them were carried from sources."""

    strategy: str
    bytes: int
    carried: int
    segments: int


def write(segments: DataFrame, dest: str, replace: bool = False, check=None, fault=None) -> Statistics:
    """Writes the segments into a file and publishes it as dest. check(path) may raise before; fault(path) is for tests."""
    if not replace and os.path.lexists(dest):
        raise FileExistsError(dest)
    with spool(dest) as folder:
        return written(spooled(segments, folder), folder, dest, replace, check, fault)


def written(segments: DataFrame, folder: str, dest: str, replace: bool, check, fault) -> Statistics:
    laid, n = checkpointed(coalesced(laid_out(segments))), F.col("src_hi") - F.col("src_lo")
    total = laid.agg(F.coalesce(F.max(F.col("lo") + n), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.when(~F.col("src").startswith(folder), n)), F.lit(0)).alias("carried"), F.count("*").alias("n"), F.coalesce(F.sum(n), F.lit(0)).alias("all")).first()
    if total.bytes != total["all"]:
        raise OutputError("segments leave gaps or overlap")
    staged = os.path.join(os.path.dirname(os.path.abspath(dest)), f".{os.path.basename(dest)}.{uuid.uuid4().hex}")
    file = os.open(staged, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o666)
    try:
        os.ftruncate(file, total.bytes)
        spread = max(1, min(total.n, -(-total.bytes // (4 * PIECE)), 10_000))
        done = checkpointed(pieces(laid).repartitionByRange(spread, "lo").mapInArrow(writing(staged), "lo long, n long, crc long"))
        if (done.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n, os.fstat(file).st_size) != (total.bytes, total.bytes):
            raise OutputError("V4: length")
        if fault:
            fault(staged)
        if os.path.getsize(staged) != total.bytes:
            raise OutputError("V4: length")
        if bad := done.mapInArrow(reading(staged), "lo long, n long, crc long").take(1):
            raise OutputError(f"V5: bytes at {bad[0].lo}")
        if check:
            check(staged)
        if replace:
            if os.path.exists(dest):
                os.chmod(staged, os.stat(dest).st_mode & 0o7777)
            os.replace(staged, dest)
        else:
            os.link(staged, dest)  # fails if somebody else has made it meanwhile
            os.unlink(staged)
    except BaseException:
        if os.path.lexists(staged):
            os.unlink(staged)
        raise
    finally:
        os.close(file)
    return Statistics("rebuild", total.bytes, total.carried, total.n)
