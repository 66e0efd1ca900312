"""One archive from many tasks: entries are encoded where they are, laid out, and written as segments.

entries: ord long, path string, kind string, data binary, mode int, mtime long, link string; the last four may be missing.
An entry's payload is one cell, so at most 2 GB; a task holds the entries it encodes one by one, a 7z block or a chunk of
a compressed tar whole.
"""

from __future__ import annotations

import secrets
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.functions import crypto, decoders, entries, fields, headers, records, seven_zip
from bindery.functions.codecs import JOINABLE, gathered, leveled, slices
from bindery.operators import editing, ranges
from bindery.plans import segments
from bindery.plans.options import Options
from bindery.sources.layouts import Coder, File, Folder

CENTRAL, END = 1 << 61, 1 << 62  # places of ZIP directory records and of what ends an archive
COLUMNS = {"ord": "long", "path": "string", "kind": "string", "data": "binary", "mode": "int", "mtime": "long", "link": "string"}


class EntryError(ValueError):
    """The entry of the smallest number that cannot be stored, and why."""


def shaped(rows: DataFrame) -> DataFrame:
    """rows with all columns of an entry; names in composed form, those of directories with a slash at their end."""
    rows = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()])
    path = records.nfc("path")
    kind = F.coalesce("kind", F.lit("file"))
    return rows.withColumn("kind", kind).withColumn("path", F.when(F.col("kind") == "directory", F.concat(F.regexp_replace(path, "/+$", ""), F.lit("/"))).otherwise(path))


def refused(rows: DataFrame, form: str) -> None:
    """Raises for the first entry, by number, that the form cannot hold: by its name, kind, link or date, or by names that collide."""
    family = "tar" if form.startswith("tar") else {"lzh": "lha"}.get(form, form)
    names = segments.checkpointed(rows.select("ord", "path", "kind", "mtime", "link"))
    stored = F.regexp_replace("path", "/$", "")
    by_rule = names.withColumn("target", F.when(F.col("link").isNotNull(), F.lit(0)).otherwise(F.lit(None)).cast("long"))
    reason = editing.first_violation(stored, F.when(F.col("kind").isin("file", "directory", "symlink", "hardlink"), F.col("kind")).otherwise("other"), F.coalesce("mtime", F.lit(0)), F.col("target"), F.col("ord") + 1, family)
    reason = F.coalesce(reason, F.when((F.col("kind") == "hardlink") & ~F.lit(family == "tar"), "kind"))
    if family == "lha":
        reason = F.coalesce(reason, F.when(records.cp932("path").isNull(), "name"))
    bad = by_rule.withColumn("reason", reason).filter("reason is not null").agg(F.min_by(F.struct("ord", "path", "reason"), "ord").alias("e")).first().e
    if bad:
        raise EntryError(f"entry {bad.ord}, {bad.path!r}: {bad.reason}")
    keyed = names.select(F.col("ord").alias("idx"), stored.alias("path"), "kind")
    for found, what in ((editing.duplicate_names(keyed).withColumnRenamed("first_idx", "idx"), "is there twice"), (editing.files_above_entries(keyed), "is a file above others")):
        bad = found.agg(F.min_by(F.struct("idx", "path"), "idx").alias("e")).first().e
        if bad:
            raise EntryError(f"entry {bad.idx}, {bad.path!r} {what}")


def as_dicts(batch: pa.RecordBatch):
    """Rows of a batch, of which those of about a megabyte are dicts at once."""
    for part in slices(batch):
        yield from part.to_pylist()


# ZIP

ZIP_ROWS = "ord long, bytes binary, n long, name binary, flags int, method int, stamp long, crc long, packed long, size long, attributes long, extra binary, version int"


def zip_rows(rows: DataFrame, options: Options) -> DataFrame:
    """Local records, and what the directory says of each."""
    secret = secrets.token_bytes(32)
    chosen, password, cipher, heuristic, levels = options.method, options.password, options.cipher, options.heuristic, options.levels
    schema = segments_schema(ZIP_ROWS)

    def rows_of(batches):
        for batch in batches:
            for r in as_dicts(batch):
                local, known = entries.zip_entry(r, chosen, password, cipher, secret, heuristic, levels)
                yield (r["ord"], local, len(local), *known)

    def run(batches):
        yield from gathered(rows_of(batches), schema)

    return rows.mapInArrow(run, ZIP_ROWS)


def zip_directory(known: DataFrame, comment: bytes = b"", given: DataFrame | None = None) -> DataFrame:
    """Segments of the directory and end of records (ZIP_ROWS with `at`, their offsets), and of given records (ord, bytes)."""

    def run(batches):
        for batch in batches:
            out = []
            for r in as_dicts(batch):
                out.append((r["ord"], entries.zip_central(tuple(r[c] for c in ("name", "flags", "method", "stamp", "crc", "packed", "size", "attributes", "extra", "version")), r["at"])))
            yield pa.RecordBatch.from_arrays([pa.array([o for o, _ in out], pa.int64()), pa.array([b for _, b in out], pa.binary())], names=["ord", "bytes"])

    own = known.drop("bytes").mapInArrow(run, "ord long, bytes binary")
    records_ = segments.checkpointed(own if given is None else own.unionByName(given))
    total = records_.agg(F.count("*").alias("count"), F.coalesce(F.sum(F.octet_length("bytes").cast("long")), F.lit(0)).alias("size")).first()
    return records_, total


def zip_segments(rows: DataFrame, options: Options) -> DataFrame:
    encoded = segments.checkpointed(zip_rows(rows, options))
    placed = ranges.running(encoded.drop("bytes"), [], ["ord"], "n", "at")
    directory, total = zip_directory(placed)
    offset = encoded.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    end = records.zip_end(total["count"], total["size"], offset)
    return union(
        encoded.select(*segments.literal(F.col("ord"), 0, F.col("bytes"))),
        directory.select(*segments.literal(F.lit(CENTRAL) + F.col("ord"), 0, F.col("bytes"))),
        one(rows, END, end),
    )


# tar


def tar_bytes(rows: DataFrame) -> DataFrame:
    """ord, header (bytes of headers), bytes (headers, data and padding) of every entry."""

    schema = segments_schema("ord long, header long, bytes binary")

    def rows_of(batches):
        for batch in batches:
            for r in as_dicts(batch):
                whole = entries.tar_entry(r)
                body = len(r["data"] or b"") if r["kind"] == "file" else 0
                yield r["ord"], len(whole) - body - -body % headers.BLOCK, whole

    def run(batches):
        yield from gathered(rows_of(batches), schema)

    return rows.mapInArrow(run, "ord long, header long, bytes binary")


def tar_segments(rows: DataFrame) -> DataFrame:
    encoded = segments.checkpointed(tar_bytes(rows))
    total = encoded.agg(F.coalesce(F.sum(F.octet_length("bytes").cast("long")), F.lit(0)).alias("n")).first().n
    return union(encoded.select(*segments.literal(F.col("ord"), 0, F.col("bytes"))), one(rows, END, headers.tar_end(total)))


class Cutter:
    """Where a tar image is cut into chunks, from the sizes of its members alone, so chunks don't depend on tasks.

    Members of up to `packing` bytes share chunks of up to `packing`; of a larger one the headers are a chunk and the body is
    cut every `piece` bytes. What ends the archive is a chunk of its own.
    """

    def __init__(self, packing: int, piece: int):
        if not 1 <= packing <= piece:
            raise ValueError("packing must be 1 to piece bytes")
        self.packing, self.piece, self.chunk, self.held = packing, piece, -1, 0

    def cut(self, header: int, body: int) -> list[tuple[int, int, int]]:
        """(chunk, from, to) of the parts of the next member."""
        size = header + body
        if size <= self.packing:
            if not self.held or self.held + size > self.packing:
                self.chunk, self.held = self.chunk + 1, 0
            self.held += size
            return [(self.chunk, 0, size)]
        out, self.held = [], 0
        edges = [0, *([header] if header else []), *range(header + self.piece, size, self.piece), size]
        for lo, hi in zip(edges, edges[1:], strict=False):
            self.chunk += 1
            out.append((self.chunk, lo, hi))
        return out


def chunks_of(members: DataFrame, packing: int, piece: int) -> DataFrame:
    """ord, chunk, from, to of members (ord, header, body): numbers alone go through one task, in order, and are not held there."""

    def run(batches):
        cutter = Cutter(packing, piece)
        for batch in batches:
            out = [(o, *c) for o, h, b in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True) for c in cutter.cut(h, b)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["ord", "chunk", "from", "to"])

    return members.select("ord", "header", "body").repartition(1).sortWithinPartitions("ord").mapInArrow(run, "ord long, chunk long, from long, to long")


def chunk_limits(codec: str, piece: int) -> tuple[int, int]:
    return (min(4 << 20, piece), piece) if codec in ("xz", "lzip", "zstd") else (piece, piece)


def encoded_chunks(parts: DataFrame, codec: str, levels: dict) -> DataFrame:
    """chunk, bytes: parts (chunk, ord, bytes) joined in order and encoded, a stream a chunk."""

    def run(table: pa.Table) -> pa.Table:
        order = table.sort_by("ord")
        return pa.table({"chunk": order.column("chunk").slice(0, 1), "bytes": pa.array([leveled(codec, **levels)(b"".join(order.column("bytes").to_pylist()))], pa.binary())})

    return parts.select("chunk", "ord", "bytes").groupBy("chunk").applyInArrow(run, "chunk long, bytes binary")


def compressed_tar_segments(rows: DataFrame, codec: str, piece: int, levels: dict) -> DataFrame:
    """Chunks are streams of their own where the codec's streams may be joined; else the archive is one stream and one task's."""
    encoded = segments.checkpointed(tar_bytes(rows))
    total = encoded.agg(F.coalesce(F.sum(F.octet_length("bytes").cast("long")), F.lit(0)).alias("n")).first().n
    end = one(rows, END, headers.tar_end(total)).select("ord", F.lit(0).cast("long").alias("header"), "bytes")
    whole = encoded.unionByName(end)
    if codec not in JOINABLE:
        parts = whole.withColumn("chunk", F.lit(0).cast("long"))
    else:
        sizes = encoded.select("ord", "header", (F.octet_length("bytes").cast("long") - F.col("header")).alias("body"))
        cut = chunks_of(sizes, *chunk_limits(codec, piece)).unionByName(end.select("ord", F.lit(END).cast("long").alias("chunk"), F.lit(0).cast("long").alias("from"), F.octet_length("bytes").cast("long").alias("to")))
        parts = whole.join(cut, "ord").select("chunk", "ord", F.substring("bytes", F.col("from").cast("int") + 1, (F.col("to") - F.col("from")).cast("int")).alias("bytes"))
    return encoded_chunks(parts, codec, levels).select(*segments.literal(F.col("chunk"), 0, F.col("bytes")))


# LHA


def lha_segments(rows: DataFrame, method: str) -> DataFrame:
    return union(lha_rows(rows, method).select(*segments.literal(F.col("ord"), 0, F.col("bytes"))), one(rows, END, b"\0"))


def lha_rows(rows: DataFrame, method: str) -> DataFrame:
    schema = segments_schema("ord long, bytes binary")

    def run(batches):
        yield from gathered(((r["ord"], entries.lha_entry(r, method)) for batch in batches for r in as_dicts(batch)), schema)

    return rows.mapInArrow(run, "ord long, bytes binary")


# 7z

FOLDERS = "block long, first long, coders array<struct<id binary, properties binary>>, sizes array<long>, streams array<struct<ord long, size long, crc long>>, bytes binary"


def blocked(rows: DataFrame, options: Options) -> DataFrame:
    """rows with the solid block each file is in: null without data; a change of filter closes a block. Only sizes are put in order."""
    size = F.when(F.col("kind") == "symlink", F.octet_length("link")).when(F.col("kind") == "file", F.octet_length("data")).otherwise(0).cast("long")
    chain = fixed_filter(options) if options.filter != "auto" else F.when(F.col("kind") == "file", headers.executable_filter(F.substring("data", 1, 65536))).otherwise("none")
    listed = rows.select(F.lit(0).alias("archive"), "ord", F.coalesce(size, F.lit(0)).alias("size"), F.coalesce(chain, F.lit("none")).alias("filter"))
    return editing.solid_blocks(listed, ["archive"], options.block_bytes, options.block_files).drop("archive").withColumnRenamed("size", "n")


def fixed_filter(options: Options) -> Column:
    return F.lit(options.filter or "none")


def folders(rows: DataFrame, options: Options) -> DataFrame:
    """Encoded folders: coders, sizes, the streams in them, and the packed bytes."""
    packer, distance, preset, schema = options.packer, options.distance, options.preset, segments_schema(FOLDERS)

    def run(table: pa.Table) -> pa.Table:
        order = table.sort_by("ord").to_pylist()
        contents = [entries.content(r) for r in order]
        chain = order[0]["filter"]
        folder, data = seven_zip.packed(b"".join(contents), packer, None if chain == "none" else chain, distance, preset)
        row = {"block": order[0]["block"], "first": order[0]["ord"], "coders": [{"id": c.id, "properties": c.properties} for c in folder.coders], "sizes": folder.sizes, "streams": [{"ord": r["ord"], "size": len(x), "crc": zlib.crc32(x)} for r, x in zip(order, contents, strict=True)], "bytes": data}
        return pa.Table.from_pylist([row], schema=schema)

    dealt = rows.join(blocked(rows, options).select("ord", "filter", "block"), "ord").filter("block is not null")
    return dealt.groupBy("block").applyInArrow(run, FOLDERS)


def segments_schema(columns: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(columns))


def ciphered(found: DataFrame, password: str | None, ident: str = "block") -> DataFrame:
    """found (bytes) with `cipher`, the properties of a folder's cipher (null without password), and bytes behind it.

    The key is derived once; each folder has an IV of its own, drawn from a secret of the job, so a retried task agrees.
    """
    if password is None:
        return found.withColumn("cipher", F.lit(None).cast("binary")).withColumn("plain_packed", F.octet_length("bytes").cast("long"))
    key, secret = decoders.seven_zip_key(password, 19), secrets.token_hex(32)
    found = found.withColumn("iv", F.unhex(F.substring(F.sha2(F.concat(F.lit(secret), F.col(ident).cast("string")), 256), 1, 32)))
    found = found.withColumn("plain_packed", F.octet_length("bytes").cast("long")).withColumn("bytes", crypto.cbc_encrypted(F.col("bytes"), F.lit(key), F.col("iv")))
    return found.withColumn("cipher", F.concat(F.lit(seven_zip.aes_properties(b"")), F.col("iv"))).drop("iv")


def folder_of(row: dict) -> tuple[Folder, list[int], list[tuple[int, int]]]:
    """A part of a model from a row of FOLDERS with cipher, plain_packed and n (the packed bytes)."""
    coders = [Coder(c["id"], c["properties"]) for c in row["coders"]]
    streams = [(s["size"], s["crc"]) for s in row["streams"]]
    folder = Folder(coders, [(i + 1, i) for i in range(len(coders) - 1)], [0], row["sizes"], None, range(1))
    if row["cipher"] is not None:
        folder = seven_zip.with_cipher(folder, row["cipher"], row["plain_packed"])
    return folder, [row["n"]], streams


def listed(rows: DataFrame):
    """The rows as dicts, some at a time; what is collected stays in columns."""
    for batch in rows.toArrow().to_batches():
        for part in slices(batch, 1 << 16):
            yield from part.to_pylist()


def file_of(row: dict) -> File:
    kind = {"file": 0o100000, "directory": 0o040000, "symlink": 0o120000}.get(row["kind"])
    if kind is None:
        raise EntryError(f"{row['path']!r}: a {row['kind']} can't be stored in this form")
    mode = kind | (row["mode"] or (0o755 if row["kind"] == "directory" else 0o644))
    mtime = entries.NO_DATE if row["mtime"] is None else row["mtime"]
    directory = row["kind"] == "directory"
    return File(row["path"].rstrip("/"), None, directory, not directory, False, None, None, (mtime + 11_644_473_600) * 10**7, mode << 16 | 0x8000 | (0x10 if directory else 0x20))


def seven_zip_parts(rows: DataFrame, options: Options) -> tuple[DataFrame, list, list[File], dict]:
    """Packed folders (first, bytes), and for the header, which is one block of bytes as large as the metadata of all files:
    parts, files and where each file's stream is."""
    found = segments.checkpointed(ciphered(folders(rows, options), options.password).withColumn("n", F.octet_length("bytes").cast("long")))
    parts, place = [], {}
    for k, block in enumerate(listed(found.drop("bytes").orderBy("block"))):
        parts.append(folder_of(block))
        place.update((r["ord"], (k, i)) for i, r in enumerate(block["streams"]))
    files, where = [], {}
    for i, r in enumerate(listed(rows.select("ord", "path", "kind", "mode", "mtime").orderBy("ord"))):
        f = file_of(r)
        if (at := place.pop(r["ord"], None)) is not None:
            where[i], f.empty = at, False
        files.append(f)
    return found, parts, files, where


def seven_zip_segments(rows: DataFrame, options: Options) -> DataFrame:
    found, parts, files, where = seven_zip_parts(rows, options)
    model = seven_zip.assembled(parts, files, where, [])
    header = seven_zip.header_of(model)
    return union(found.select(*segments.literal(F.col("block"), 0, F.col("bytes"))), one(rows, -1, seven_zip.start_of(header, model.header[0])), one(rows, END, header))


# all forms


def one(rows: DataFrame, order: int, data: bytes) -> DataFrame:
    """Bytes that the driver made, in parts."""
    step = 1 << 20
    return rows.sparkSession.createDataFrame([(order, k, None, None, None, bytes(data[at : at + step])) for k, at in enumerate(range(0, max(1, len(data)), step))], segments.SEGMENTS)


def union(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def segments_of(rows: DataFrame, form: str, options: Options) -> DataFrame:
    """The archive's segments; with options.threads, no more tasks than that hold payloads at once."""
    if options.threads:
        rows = rows.coalesce(options.threads)
    if form == "zip":
        return zip_segments(rows, options)
    if form == "7z":
        return seven_zip_segments(rows, options)
    if form == "lzh":
        return lha_segments(rows, options.lha)
    if form == "tar":
        return tar_segments(rows)
    return compressed_tar_segments(rows, options.codec_of(form), options.piece(form), options.levels)


def create(rows: DataFrame, dest: str, form: str, options: Options | None = None, replace: bool = False) -> segments.Statistics:
    """Writes entries into one archive, which must not exist unless it is to be replaced; all are checked before a byte is written."""
    options = (options or Options()).checked(form)
    rows = shaped(rows)
    refused(rows, form)
    return segments.write(segments_of(rows, form, options), dest, replace)
