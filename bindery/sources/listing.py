"""Listings of tar and zip archives as a data source: spark.read.format("archive_listing").load(folder_or_file).

One partition a file; headers are read, payloads are skipped. Paths are local or on a mounted file system.
"""

from __future__ import annotations

import glob
import os
import tarfile
import zipfile

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "archive string, idx long, path string, kind string, size long, packed long, offset long, mode int, mtime long, link string, crc long, method string"


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ListingReader(DataSourceReader):
    def __init__(self, options):
        self.path = options.get("path")

    def partitions(self):
        found = sorted(p for p in glob.glob(os.path.join(self.path, "**"), recursive=True) if os.path.isfile(p)) if os.path.isdir(self.path) else [self.path]
        return [File(p) for p in found if not os.path.basename(p).startswith(("_", "."))]

    def read(self, partition):
        path = partition.path
        name = os.path.basename(path)
        if zipfile.is_zipfile(path):
            with zipfile.ZipFile(path) as z:
                for i, e in enumerate(z.infolist()):
                    mode = e.external_attr >> 16
                    kind = "directory" if e.is_dir() else "symlink" if mode & 0o170000 == 0o120000 else "file"
                    yield name, i, e.filename, kind, e.file_size, e.compress_size, e.header_offset, mode & 0o7777, None, None, e.CRC, str(e.compress_type)
        else:
            with tarfile.open(path) as t:
                for i, e in enumerate(t):
                    kind = "directory" if e.isdir() else "symlink" if e.issym() else "hardlink" if e.islnk() else "file" if e.isreg() else "other"
                    yield name, i, e.name, kind, e.size, e.size, e.offset, e.mode, int(e.mtime), e.linkname or None, None, "stored"


class ArchiveListing(DataSource):
    @classmethod
    def name(cls):
        return "archive_listing"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ListingReader(self.options)


class FilesReader(ListingReader):
    """Folders are listed level by level until there are enough of them to deal out; a task takes one of these, or a folder's files.

    With the option payload, files are read too; one that changes meanwhile fails.
    """

    ENOUGH = 256

    def __init__(self, options):
        super().__init__(options)
        self.payload = str(options.get("payload", "false")).lower() == "true"

    def partitions(self):
        parts, todo = [], [self.path]
        while todo and len(parts) + len(todo) < self.ENOUGH:
            at, todo = todo[0], todo[1:]
            for e in sorted(os.scandir(at), key=lambda e: e.name):
                if e.is_dir(follow_symlinks=False):
                    todo.append(e.path)
                    parts.append(Listed(e.path, False))
                else:
                    parts.append(Listed(e.path, False))
        return parts + [Listed(p, True) for p in todo]

    def read(self, partition):
        """An entry, or all below a folder, names in order; symlinks are entries and not followed."""
        todo = [partition.path]
        if partition.below:
            todo = sorted((os.path.join(partition.path, x) for x in os.listdir(partition.path)), reverse=True)
        while todo:
            at = todo.pop()
            yield self.row(at)
            if partition.below and os.path.isdir(at) and not os.path.islink(at):
                todo += sorted((os.path.join(at, x) for x in os.listdir(at)), reverse=True)

    def row(self, at: str) -> tuple:
        info, name = os.lstat(at), os.path.relpath(at, self.path)
        kind = "symlink" if os.path.islink(at) else "directory" if os.path.isdir(at) else "file" if os.path.isfile(at) else "other"
        if kind == "other":
            raise ValueError(f"{at}: this kind of file can't be stored")
        data = None
        if self.payload and kind == "file":
            with open(at, "rb") as file:
                data = file.read()
            again = os.lstat(at)
            if (again.st_ino, again.st_mode, again.st_size, again.st_mtime_ns) != (info.st_ino, info.st_mode, info.st_size, info.st_mtime_ns) or len(data) != info.st_size:
                raise ValueError(f"{at}: changed while it was read")
        return name, kind, info.st_size if kind == "file" else 0, info.st_mode & 0o7777, int(info.st_mtime // 1), os.readlink(at) if kind == "symlink" else None, info.st_dev, info.st_ino, data


class Listed(InputPartition):
    def __init__(self, path: str, below: bool):
        self.path, self.below = path, below


class FileTree(DataSource):
    """spark.read.format("file_tree").load(folder): what an archive of the folder would list; with payload, what it would hold."""

    @classmethod
    def name(cls):
        return "file_tree"

    def schema(self):
        return "path string, kind string, size long, mode int, mtime long, link string, dev long, ino long, data binary"

    def reader(self, schema):
        return FilesReader(self.options)


def changed(before, after):
    """Files whose inode, mode, size or mtime differ between two listings of file_tree."""
    columns = ["path", "kind", "size", "mode", "mtime", "dev", "ino"]
    a, b = before.select(*columns), after.select(*columns)
    return a.exceptAll(b).unionByName(b.exceptAll(a)).select("path").distinct()
