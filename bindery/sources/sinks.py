"""Archive and single-stream sinks: df.write.format("archive").option("form", "tar.zst").save(folder).

Rows: ord long, path string, data binary, kind string, mode int, mtime long, link string (the last four may
be missing or null). Every task writes archives of its own into a staging folder, in order of ord within
the task; commit renames them into place and abort removes the staging folder only. So an archive is never
put together on the driver, and one that exists is never overwritten.
"""

from __future__ import annotations

import bz2
import io
import lzma
import os
import secrets
import shutil
import tarfile
import uuid
import zlib
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Forms of ZIP and 7z archives, and the method or packer each uses.
ZIP_FORMS = {"zip": "deflate", "zip.stored": "stored", "zip.bzip2": "bzip2", "zip.lzma": "lzma", "zip.zst": "zstd", "zip.xz": "xz"}
SEVEN_ZIP_FORMS = {"7z": "lzma2", "7z.lzma": "lzma", "7z.deflate": "deflate", "7z.bzip2": "bzip2", "7z.copy": "copy"}
#: Coder ids of 7z packers and filters.
CODERS = {"copy": b"\x00", "lzma2": b"\x21", "lzma": b"\x03\x01\x01", "deflate": b"\x04\x01\x08", "bzip2": b"\x04\x02\x02", "delta": b"\x03", "x86": b"\x03\x03\x01\x03", "arm64": b"\x0a"}
LHA_FORMS = {"lzh": "lh5", "lzh.lh6": "lh6", "lzh.lh7": "lh7", "lzh.stored": "lh0"}
DICTIONARY = 1 << 23
TAR_CODECS = {"tar": None, "tar.gz": "gzip", "tar.bz2": "bzip2", "tar.xz": "xz", "tar.zst": "zstd", "tar.lzma": "lzma", "tar.lz": "lzip", "tar.lz4": "lz4", "tar.br": "brotli", "tar.Z": "compress"}
STREAMS = {"gz": "gzip", "bz2": "bzip2", "xz": "xz", "zst": "zstd", "lzma": "lzma", "lz": "lzip", "lz4": "lz4", "br": "brotli", "Z": "compress"}
CHUNK = 16 << 20


@dataclass
class Written(WriterCommitMessage):
    files: list


def checked(path: str, directory: bool, tar: bool) -> str:
    import unicodedata

    name = unicodedata.normalize("NFC", path or "")
    body = name[:-1] if directory and name.endswith("/") else name
    parts = body.split("/")
    if not body or "\0" in body or (not tar and ("\\" in body or ":" in body)) or any(p in ("", ".", "..") for p in parts) or len(name.encode()) > 65535:
        raise ValueError(f"invalid path: {path!r}")
    return body + "/" if directory else body


class ChunkedCodec(io.RawIOBase):
    """Compresses what is written, in pieces of CHUNK bytes where the codec's outputs may be joined."""

    def __init__(self, codec: str, out):
        from bindery.functions.codecs import CODECS, JOINABLE

        self.encode, self.join, self.out, self.held = CODECS[codec], codec in JOINABLE, out, bytearray()

    def writable(self):
        return True

    def write(self, data):
        self.held += data
        while self.join and len(self.held) > CHUNK:
            self.out.write(self.encode(bytes(self.held[:CHUNK])))
            del self.held[:CHUNK]
        return len(data)

    def finish(self):
        self.out.write(self.encode(bytes(self.held)))
        self.held.clear()


def folder_packed(data: bytes, packer: str, chain: str | None) -> tuple[list, bytes]:
    """Coders, from the packer to the filter, and the packed stream of a 7z folder."""
    from bindery.functions.codecs import FILTERS, deflate_raw
    from bindery.functions.entries import packed_lzma

    coders = [(CODERS[chain], b"\0" if chain == "delta" else b"")] if chain else []
    data, properties = FILTERS[chain](data) if chain else data, b""
    if packer == "lzma2":
        data, properties = lzma.compress(data, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "dict_size": DICTIONARY}]), bytes([2 * (DICTIONARY.bit_length() - 13)])
    elif packer == "lzma":
        properties, data = packed_lzma(data)
    elif packer != "copy":
        data = deflate_raw(data) if packer == "deflate" else bz2.compress(data, 9)
    return [(CODERS[packer], properties), *coders], data


class ArchiveWriter(DataSourceWriter):
    """Options: form; prefix of file names; password and cipher (aes, stream) of ZIP entries; filter (delta, x86, arm64),
    block_bytes and block_files of 7z folders. Passwords of other forms are refused."""

    def __init__(self, options):
        self.form, self.folder, self.prefix = options.get("form", "zip"), options["path"], options.get("prefix", "part")
        if not any(self.form in forms for forms in (ZIP_FORMS, SEVEN_ZIP_FORMS, LHA_FORMS, TAR_CODECS, STREAMS)):
            raise ValueError(f"unknown form {self.form}")
        self.password, self.cipher, self.secret = options.get("password"), options.get("cipher", "aes"), secrets.token_bytes(32)
        if self.password is not None and (self.form not in ZIP_FORMS or not self.password or self.cipher not in ("aes", "stream")):
            raise ValueError(f"{self.form} with cipher {self.cipher} and this password can't be written")
        self.filter, self.block_bytes, self.block_files = options.get("filter"), int(options.get("block_bytes", 16 << 20)), int(options.get("block_files", 1 << 20))
        if self.filter not in (None, "delta", "x86", "arm64") or min(self.block_bytes, self.block_files) < 1:
            raise ValueError("unknown filter, or an empty block")
        self.staging = os.path.join(self.folder, f"_staging-{uuid.uuid4().hex}")

    def write(self, rows):
        os.makedirs(self.staging, exist_ok=True)
        held = sorted((r.asDict() for r in rows), key=lambda r: r["ord"])
        if not held:
            return Written([])
        at = os.path.join(self.staging, uuid.uuid4().hex)
        if self.form in STREAMS:
            return Written(list(map(self.stream, held)))
        seen = set()
        for r in held:
            r["kind"] = r.get("kind") or "file"
            r["path"] = checked(r["path"], r["kind"] == "directory", self.form in TAR_CODECS)
            if r["path"].rstrip("/") in seen:
                raise ValueError(f"two entries are named {r['path']!r}")
            seen.add(r["path"].rstrip("/"))
        with open(at, "xb") as file:
            kind = next((k for k, forms in (("zip", ZIP_FORMS), ("7z", SEVEN_ZIP_FORMS), ("lzh", LHA_FORMS)) if self.form in forms), self.form)
            {"zip": self.zip, "7z": self.seven_zip, "lzh": self.lha}.get(kind, self.tar)(file, held)
        return Written([(at, f"{self.prefix}-{held[0]['ord']:012d}.{kind}")])

    def stream(self, r):
        from bindery.functions.codecs import CODECS

        at = os.path.join(self.staging, uuid.uuid4().hex)
        with open(at, "xb") as file:
            file.write(CODECS[STREAMS[self.form]](bytes(r["data"] or b"")))
        return at, f"{os.path.basename(checked(r['path'], False, True))}.{self.form}"

    def zip(self, file, rows):
        from bindery.functions import entries, records

        directory, count = bytearray(), 0
        for r in rows:
            local, central = entries.zip_entry(r, ZIP_FORMS[self.form], self.password, self.cipher, self.secret)
            directory += entries.zip_central(central, file.tell())
            file.write(local)
            count += 1
        at = file.tell()
        file.write(directory + records.zip_end(count, len(directory), at))

    def seven_zip(self, file, rows):
        """Folders are filled in order, up to the block limits; a file is never split. The header comes last, the start is then set."""
        from bindery.functions import entries, records

        file.write(bytes(32))
        folders, files, block, sizes, crcs = [], [], bytearray(), [], []

        def close():
            if sizes:
                coders, packed = folder_packed(bytes(block), SEVEN_ZIP_FORMS[self.form], self.filter)
                file.write(packed)
                folders.append({"coders": coders, "packed": len(packed), "sizes": [*sizes], "crcs": [*crcs]})
                for x in (block, sizes, crcs):
                    x.clear()

        for r in rows:
            data, mode = entries.content(r), entries.mode_of(r)
            files.append({"name": r["path"].rstrip("/"), "attributes": mode << 16 | 0x8000 | (0x10 if r["kind"] == "directory" else 0x20), "filetime": (entries.seconds(r) + 11_644_473_600) * 10**7, "has_stream": bool(data), "directory": r["kind"] == "directory"})
            if data:
                if sizes and (len(block) + len(data) > self.block_bytes or len(sizes) == self.block_files):
                    close()
                block += data
                sizes.append(len(data))
                crcs.append(zlib.crc32(data))
        close()
        header, end = records.seven_zip_header(folders, files), file.tell()
        file.write(header)
        file.seek(0)
        file.write(records.seven_zip_start(header, end - 32))

    def lha(self, file, rows):
        """Members of level 2; one that its codec doesn't make smaller is stored."""
        from bindery.functions import entries

        for r in rows:
            file.write(entries.lha_entry(r, LHA_FORMS[self.form]))
        file.write(b"\0")

    def tar(self, file, rows):
        codec = TAR_CODECS[self.form]
        out = ChunkedCodec(codec, file) if codec else file
        with tarfile.open(fileobj=out, mode="w|" if codec else "w", format=tarfile.PAX_FORMAT) as t:
            for r in rows:
                info = tarfile.TarInfo(r["path"].rstrip("/"))
                info.type = {"file": tarfile.REGTYPE, "directory": tarfile.DIRTYPE, "symlink": tarfile.SYMTYPE, "hardlink": tarfile.LNKTYPE}[r["kind"]]
                info.mode, info.mtime, info.linkname = r.get("mode") or (0o755 if r["kind"] == "directory" else 0o644), 1_700_000_001 if r.get("mtime") is None else r["mtime"], r.get("link") or ""
                data = bytes(r.get("data") or b"") if r["kind"] == "file" else b""
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
        if codec:
            out.finish()

    def commit(self, messages):
        files = [f for m in messages if m for f in m.files]
        taken = [n for _, n in files if os.path.lexists(os.path.join(self.folder, n))]
        if taken or len({n for _, n in files}) < len(files):
            shutil.rmtree(self.staging, ignore_errors=True)
            raise FileExistsError(f"would overwrite {taken[:3]}")
        for at, name in files:
            os.rename(at, os.path.join(self.folder, name))
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages):
        shutil.rmtree(self.staging, ignore_errors=True)


class ArchiveSink(DataSource):
    @classmethod
    def name(cls):
        return "archive"

    def schema(self):
        return "ord long, path string, data binary, kind string, mode int, mtime long, link string"

    def writer(self, schema, overwrite):
        return ArchiveWriter(self.options)


def register(spark) -> None:
    """Makes the archive sink and the readers of archives and folders known to a session."""
    from bindery.sources.listing import ArchiveListing, FileTree

    from bindery.sources.units import SOURCES

    for source in (ArchiveSink, ArchiveListing, FileTree, *SOURCES):
        spark.dataSource.register(source)
