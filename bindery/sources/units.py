"""Readers of existing archives: where their members lie, what the members hold, and whether they may be edited.

archive_units: a row a member, or ZIP record, with its byte ranges. archive_entries: a row a member with its payload; the
members of an archive are dealt to tasks by bytes, those of 7z by folders. archive_assessment: a row an archive.
Paths are local or on a file system that is mounted on all machines.
"""

from __future__ import annotations

import glob
import os
import pickle
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from bindery.functions import decoders
from bindery.functions.codecs import gathered
from bindery.sources import layouts

UNITS = (
    "archive string, form string, idx long, pos long, path string, raw binary, kind string, size long, mode int, mtime long, link string, lo long, data long, end long, hi long, "
    "method int, crc long, flags int, stamp long, attributes long, extra binary, c_lo long, c_hi long, canonical boolean, descriptor boolean, zip64 boolean, level int, folder int"
)
ENTRIES = "archive string, idx long, path string, kind string, size long, mode int, mtime long, link string, data binary"
SCHEMA = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[c.split()[1]]) for c in ENTRIES.split(", ")])
ASSESSMENT = "archive string, form string, members long, editable boolean, code string, reason string"
SPLIT = 64 << 20  # bytes of payload a task


def unit(archive: str, form: str, **values) -> tuple:
    values |= {"archive": archive, "form": form}
    return tuple(values.get(name.split()[0]) for name in UNITS.split(", "))


def text_of(raw: bytes) -> str:
    return raw.decode("utf-8", "surrogateescape").encode("utf-8", "replace").decode() if raw else ""


def zip_unit(path: str, r) -> tuple:
    mode = r.attributes >> 16
    return unit(path, "zip", idx=r.idx, pos=r.idx, path=r.text, raw=r.name, kind=r.kind, size=r.size, mode=mode & 0o7777 or None, mtime=layouts.dos_seconds(r.stamp), lo=r.lo, data=r.data, end=r.end, hi=r.hi, method=r.method, crc=r.crc, flags=r.flags, stamp=r.stamp, attributes=r.attributes, extra=r.extra, c_lo=r.c_lo, c_hi=r.c_hi, canonical=r.canonical, descriptor=r.descriptor, zip64=r.zip64)


def tar_unit(path: str, pos: int, own: int | None, u) -> tuple:
    return unit(path, "tar", idx=own, pos=pos, path=text_of(u.name), raw=u.name, kind=u.kind, size=u.end - u.data, mode=u.mode, mtime=u.mtime, link=text_of(u.link) or None, lo=u.lo, data=u.data, end=u.end, hi=u.hi)


def lha_unit(path: str, idx: int, u) -> tuple:
    kind = "directory" if u.method == "-lhd-" else "file"
    return unit(path, "lha", idx=idx, pos=idx, path=u.name.decode("cp932"), raw=u.name, kind=kind, size=u.size, mode=u.mode and u.mode & 0o7777, mtime=u.mtime, lo=u.lo, data=u.data, end=u.hi, hi=u.hi, crc=u.crc, level=u.level, extra=u.method.encode())


def seven_zip_unit(path: str, idx: int, model, f) -> tuple:
    folder, at, size, crc = model.streams[f.stream] if f.stream is not None else (None, None, 0, None)
    mode = (f.attributes or 0) >> 16
    kind = "directory" if f.directory else "symlink" if mode & 0o170000 == 0o120000 else "file"
    mtime = None if f.modified is None else f.modified // 10**7 - 11_644_473_600
    return unit(path, "7z", idx=idx, pos=idx, path=f.name, raw=f.name.encode("utf-16-le", "surrogatepass"), kind=kind, size=size, mode=mode & 0o7777 or None, mtime=mtime, lo=at, hi=None if at is None else at + size, crc=crc, attributes=f.attributes, folder=folder)


def units_of(path: str, password: str | None = None, part: Part | None = None):
    """Rows of UNITS of one archive, or of a part of it, in order; of tar, ZIP and LHA one after the other, never all."""
    first, lo, hi, idx = (part.first, part.lo, part.hi, part.idx) if part and part.hi is not None else (0, 0, None, 0)
    with layouts.Ranged(path) as src:
        form = layouts.form_of(src)
        if form == "zip":
            tail = layouts.zip_tail(src)
            for piece in [part.slice] if part and part.slice else layouts.zip_slices(src, tail):
                for r in layouts.zip_walk(src, tail, piece):
                    yield zip_unit(path, r)
        elif form == "tar":
            for pos, u in enumerate(layouts.tar_walk(src, lo, hi), first):
                own = None if u.kind == "global" else idx
                yield tar_unit(path, pos, own, u)
                idx += own is not None
        elif form == "lha":
            for pos, u in enumerate(layouts.lha_walk(src, lo, hi), first):
                yield lha_unit(path, pos, u)
        elif form == "7z":
            model = layouts.seven_zip_model(src, password)
            for pos, f in enumerate(model.files):
                yield seven_zip_unit(path, pos, model, f)
        else:
            raise ValueError(f"{path}: not an archive that can be listed")


def assessed(path: str, password: str | None = None) -> tuple:
    """archive, form, members, editable, code and reason."""
    with layouts.Ranged(path) as src:
        form = layouts.form_of(src)
    try:
        if form == "7z":
            with layouts.Ranged(path) as src:
                model = layouts.seven_zip_model(src, password)
            if reason := model.reason():
                return path, form, len(model.files), False, *reason.split(": ", 1)
            return path, form, len(model.files), True, None, None
        return path, form, sum(r[2] is not None for r in units_of(path, password)), True, None, None
    except layouts.Refusal as e:
        return path, form, None, False, e.code, e.reason
    except decoders.WrongPassword as e:
        return path, form, None, False, "password", str(e)
    except ValueError as e:
        return path, form, None, False, "invalid", str(e)


def entry_of(src, form: str, row: dict, plain, password: str | None) -> bytes | None:
    """An entry's payload; for 7z from its folder's bytes."""
    if row["kind"] not in ("file", "symlink") or form == "tar" and row["kind"] == "symlink":
        return None
    if form == "zip":
        return decoders.zip_payload(src.some(row["data"], row["end"] - row["data"]), row["method"], row["size"], row["crc"], row["flags"], row["stamp"], row["extra"], password)
    if form == "tar":
        return src.some(row["data"], row["end"] - row["data"])
    if form == "lha":
        return decoders.lha_payload(src.some(row["data"], row["end"] - row["data"]), row["extra"].decode(), row["size"], row["crc"])
    return plain[row["lo"] : row["hi"]] if row["folder"] is not None else b""


@dataclass
class Part(InputPartition):
    """All of an archive, or what a task needs of it: of tar and LHA the bytes [lo, hi) and the numbers of the first unit and
    entry in them, of ZIP a slice of the directory, of 7z the packed model of some folders and the files in them."""

    path: str
    first: int = 0
    lo: int = 0
    hi: int | None = None
    idx: int = 0
    slice: layouts.ZipSlice | None = None
    model: bytes | None = None


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.password = options["path"], options.get("password")

    def files(self) -> list[str]:
        if not os.path.isdir(self.path):
            return [self.path]
        found = glob.glob(os.path.join(glob.escape(self.path), "**"), recursive=True)
        return sorted(p for p in found if os.path.isfile(p) and not os.path.basename(p).startswith(("_", ".")))

    def partitions(self):
        return [Part(p) for p in self.files()]


class UnitsReader(Reader):
    """A directory of ZIP is dealt by slices; the headers of other forms can only be walked."""

    def partitions(self):
        files = self.files()
        if len(files) == 1:
            with layouts.Ranged(files[0]) as src:
                try:
                    if layouts.form_of(src) == "zip":
                        return [Part(files[0], slice=s) for s in layouts.zip_slices(src, layouts.zip_tail(src))] or [Part(files[0])]
                except (layouts.Refusal, ValueError):
                    return [Part(files[0])]  # the task says why
        return super().partitions()

    def read(self, partition):
        yield from units_of(partition.path, self.password, partition)


class AssessmentReader(Reader):
    def read(self, partition):
        yield assessed(partition.path, self.password)


class EntriesReader(Reader):
    """One archive is dealt to tasks by bytes of payload; of a folder of archives each is a task."""

    def partitions(self):
        files = self.files()
        if len(files) > 1:
            return super().partitions()
        path = files[0]
        with layouts.Ranged(path) as src:
            form = layouts.form_of(src)
            if form == "zip":
                return [Part(path, slice=s) for s in layouts.zip_slices(src, layouts.zip_tail(src), SPLIT)] or [Part(path)]
            if form == "7z":
                return [Part(path, model=m) for m in seven_zip_slices(layouts.seven_zip_model(src, self.password))] or [Part(path)]
            if form not in ("tar", "lha"):
                return [Part(path)]
            parts, held, idx, part, at = [], 0, 0, Part(path), 0
            for pos, u in enumerate((layouts.tar_walk if form == "tar" else layouts.lha_walk)(src)):
                if held > SPLIT:
                    part.hi = u.lo
                    parts.append(part)
                    part, held = Part(path, pos, u.lo, idx=idx), 0
                held, at = held + (u.end - u.data if form == "tar" else u.size), u.hi
                idx += form != "tar" or u.kind != "global"
            part.hi = at
            return [*parts, part]

    def read(self, partition):
        """In batches of some megabytes, however large the entries are."""
        yield from gathered(self.rows(partition), SCHEMA)

    def rows(self, partition):
        path, names = partition.path, [n.split()[0] for n in UNITS.split(", ")]
        with layouts.Ranged(path) as src:
            form = layouts.form_of(src)
            if form in decoders.STREAM_DECODERS:
                yield from self.wrapped(path, form, src)
                return
            if form == "7z":
                yield from self.folders(partition, src)
                return
            for r in units_of(path, self.password, partition):
                row = dict(zip(names, r, strict=True))
                if row["idx"] is not None:
                    yield self.entry(src, form, row, b"")

    def entry(self, src, form: str, row: dict, plain: bytes) -> tuple:
        data, link = entry_of(src, form, row, plain, self.password), row["link"]
        if row["kind"] == "symlink" and form in ("zip", "7z"):
            link, data = data.decode("utf-8", "replace"), None
        return row["archive"], row["idx"], row["path"], row["kind"], row["size"], row["mode"], row["mtime"], link, data

    def folders(self, partition, src):
        """Files of a part of the folders, each decoded once."""
        parts = [partition.model] if partition.model else seven_zip_slices(layouts.seven_zip_model(src, self.password))
        for packed in parts:
            folders, files = pickle.loads(zlib.decompress(packed))
            number, plain = None, b""
            for idx, name, kind, size, mode, mtime, folder, lo in files:
                if folder is not None and folder != number:
                    number, (chain, packs) = folder, folders[folder]
                    plain = decoders.folder_plain(chain, [src.some(a, b - a) for a, b in packs], self.password)
                row = {"archive": partition.path, "idx": idx, "path": name, "kind": kind, "size": size, "mode": mode, "mtime": mtime, "link": None, "folder": folder, "lo": lo, "hi": None if lo is None else lo + size}
                yield self.entry(src, "7z", row, plain)

    def wrapped(self, path: str, codec: str, src):
        """A compressed tar, decoded as it is read, or one compressed file."""
        inner = decoders.Stream(src, codec)
        inner.more(layouts.BLOCK - 1)
        head = Image(bytes(inner.held[: layouts.BLOCK]))
        if self.blank(inner) if head.data and not head.data.strip(b"\0") else head.data and layouts.form_of(head) == "tar":
            idx = 0
            for u in layouts.tar_walk(inner):
                if u.kind != "global":
                    data = inner.read(u.data, u.end - u.data) if u.kind == "file" else None
                    yield path, idx, text_of(u.name), u.kind, u.end - u.data, u.mode, u.mtime, text_of(u.link) or None, data
                    idx += 1
        else:
            image = inner.rest()
            yield path, 0, os.path.splitext(os.path.basename(path))[0], "file", len(image), None, None, None, image

    @staticmethod
    def blank(inner) -> bool:
        """A tar without members: blocks, of which the first is zeros."""
        return not len(inner.rest()) % layouts.BLOCK


def seven_zip_slices(model) -> list[bytes]:
    """The model, packed, in parts of whole folders of about SPLIT bytes of files."""
    out, folders, files, held, last = [], {}, [], 0, None
    for idx, f in enumerate(model.files):
        folder, at, size, _ = model.streams[f.stream] if f.stream is not None else (None, None, 0, None)
        if held > SPLIT and folder != last:
            out.append(zlib.compress(pickle.dumps((folders, files)), 1))
            folders, files, held = {}, [], 0
        if folder is not None and folder not in folders:
            own = model.folders[folder]
            folders[folder] = own, [model.packs[i] for i in own.packs]
        mode = (f.attributes or 0) >> 16
        kind = "directory" if f.directory else "symlink" if mode & 0o170000 == 0o120000 else "file"
        files.append((idx, f.name, kind, size, mode & 0o7777 or None, None if f.modified is None else f.modified // 10**7 - 11_644_473_600, folder, at))
        held, last = held + size, folder
    return [*out, zlib.compress(pickle.dumps((folders, files)), 1)] if files else out


class Image:
    """Bytes that are read like a file."""

    def __init__(self, data: bytes):
        self.data, self.length = data, len(data)

    def read(self, at: int, n: int) -> bytes:
        if at < 0 or at + n > self.length:
            raise layouts.Refusal("R8", f"{n} bytes at {at} are out of the image")
        return self.data[at : at + n]

    some = read


def source(kind: str, columns: str, of: type):
    class Source(DataSource):
        @classmethod
        def name(cls):
            return kind

        def schema(self):
            return columns

        def reader(self, schema):
            return of(self.options)

    return Source


SOURCES = [source("archive_units", UNITS, UnitsReader), source("archive_entries", ENTRIES, EntriesReader), source("archive_assessment", ASSESSMENT, AssessmentReader)]
