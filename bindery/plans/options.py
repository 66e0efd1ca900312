"""Options of writers, checked in a fixed order before anything is written, and the sizes that follow from them."""

from __future__ import annotations

import os
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

TAR_FORMS = {"tar.gz": "gzip", "tar.bz2": "bzip2", "tar.xz": "xz", "tar.zst": "zstd", "tar.lzma": "lzma", "tar.lz": "lzip", "tar.lz4": "lz4", "tar.br": "brotli", "tar.Z": "compress"}
FORMS = ("zip", "7z", "lzh", "tar", *TAR_FORMS)
MIB = 1 << 20


class OptionError(ValueError):
    """The first option that is out of range, or that the form doesn't have."""


@dataclass(frozen=True)
class Options:
    method: str = "deflate"
    packer: str = "lzma2"
    filter: str | None = None
    distance: int = 1
    solid: bool = True
    block_bytes: int = 64 * MIB
    block_files: int = 1 << 20
    lha: str = "lh5"
    deflate_level: int = 6
    bzip2_level: int = 9
    zstd_level: int = 3
    preset: int = 6
    memory_limit: int | None = None
    threads: int | None = None
    heuristic: bool = True
    prefers_speed: bool = False
    password: str | None = None
    cipher: str = "aes"
    placement: str = "end"
    owner_ids: bool = False

    def checked(self, form: str) -> Options:
        """Itself; a file is a block of its own where blocks are not solid."""
        if form not in FORMS:
            raise OptionError(f"form {form}")
        for name, low, high in (("deflate_level", 0, 9), ("bzip2_level", 1, 9), ("zstd_level", 1, 19)):
            if not low <= getattr(self, name) <= high:
                raise OptionError(name)
        if self.method not in ("stored", "deflate", "bzip2", "lzma", "zstd", "xz"):
            raise OptionError("method")
        if self.packer not in ("copy", "lzma2", "lzma", "deflate", "bzip2"):
            raise OptionError("packer")
        if self.lha not in ("lh0", "lh5", "lh6", "lh7"):
            raise OptionError("lha")
        if min(self.block_bytes, self.block_files) < 1:
            raise OptionError("solid")
        if self.filter not in (None, "none", "auto", "delta", "x86", "arm64") or not 1 <= self.distance <= 256:
            raise OptionError("filter")
        if not 0 <= self.preset & 0x7FFFFFFF <= 9:
            raise OptionError("preset")
        if self.memory_limit is not None and self.memory_limit < 1:
            raise OptionError("memory_limit")
        if self.threads is not None and not 1 <= self.threads <= 1024:
            raise OptionError("threads")
        if self.owner_ids and form in ("7z", "lzh"):
            raise OptionError("owner_ids")
        if self.password is not None and (not self.password or form not in ("zip", "7z")):
            raise OptionError("password")
        if self.cipher not in ("aes", "stream"):
            raise OptionError("cipher")
        if self.placement not in ("end", "beginning"):
            raise OptionError("placement")
        return self if self.solid else replace(self, block_files=1)

    @property
    def levels(self) -> dict:
        """Levels as codecs.leveled() takes them."""
        return {"deflate": self.deflate_level, "bzip2": self.bzip2_level, "zstd": self.zstd_level, "preset": self.preset}

    @staticmethod
    def codec_of(form: str) -> str:
        return TAR_FORMS[form]

    def piece(self, form: str) -> int:
        """Bytes of an image that a stream of its own may hold."""
        return {"tar.gz": MIB, "tar.bz2": self.bzip2_level * 500_000, "tar.zst": 4 * MIB, "tar.lz4": 4 * MIB}.get(form, 16 * MIB)

    def pending(self, form: str, memory: int | None = None) -> int:
        """An upper bound of the input bytes that tasks hold and have not put out yet."""
        slots = self.threads or automatic_threads(os.cpu_count() or 1, memory or 1 << 62)
        if form in ("tar", "tar.lzma", "tar.br", "tar.Z"):
            return 0
        if form in TAR_FORMS:
            return (slots + 1) * self.piece(form)
        if form == "7z":
            return 0 if self.packer == "copy" and not self.filter else slots * self.block_bytes
        return slots * 16 * MIB


def automatic_threads(cpus: int, memory: int, reduced: bool = False) -> int:
    """Tasks at once: all processors, half of them where power is to be saved, and a gibibyte of memory for each."""
    return max(1, min((cpus + 1) // 2 if reduced else cpus, memory >> 30))


def piece_size(size: Column, standard: int, floor: int = 2 * MIB) -> Column:
    """About a sixteenth of a known input in whole MiB, from `floor` to `standard`; of unknown or empty input the standard."""
    units = F.floor((size - 1) / (16 * MIB)) + 1
    return F.when(size.isNull() | (size <= 0), F.lit(standard)).otherwise(F.greatest(F.lit(floor), F.least(F.lit(standard), units * MIB))).cast("long")


def size_bound(method: Column, size: Column) -> Column:
    """No encoder of a method puts out more bytes than this."""
    blocks = lambda n: F.floor((size + n - 1) / n)
    bound = F.when(method == "stored", size).when(method == "bzip2", size + F.floor(size / 100) + 600).when(method == "lzma", size * 16 + 1024)
    bound = bound.when(method == "zstd", size + (F.floor(size / (128 << 10)) + 1) * 3 + 18).when(method == "xz", size * 2 + blocks(16 * MIB) * (65_536 + 1_024) + 1_024)
    return bound.when(method == "deflate", size + 5 * (F.floor(size / 16_000) + 1) + 64 * blocks(MIB) + 64).cast("long")

