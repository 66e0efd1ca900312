"""Scalar fields of archive headers as column expressions; each has the same arithmetic in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions whose content is compressed already and is stored as it is.
STORED_EXTENSIONS = (
    "zip", "gz", "bz2", "xz", "7z", "rar", "jpg", "jpeg", "png", "gif", "webp", "heic", "mp3", "mp4", "mov", "pdf", "avif", "jxl", "heif", "jp2",
    "cbz", "cbr", "cb7", "epub", "zst", "lz4", "lzma", "tgz", "txz", "m4a", "aac", "flac", "ogg", "opus", "webm", "mkv", "m4v", "docx", "xlsx",
    "pptx",
)
LIMIT32 = 0xFFFFFFFF
#: ZIP method numbers.
ZIP_METHODS = {"stored": 0, "deflate": 8, "bzip2": 12, "lzma": 14, "zstd": 93, "xz": 95, "ppmd": 98}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def is_stored_extension(path: Column) -> Column:
    return extension(path).isin(*STORED_EXTENSIONS)


def path_violation(path: Column, directory: Column, tar: bool) -> Column:
    """First broken rule of an output name, null if none."""
    body = F.when(directory, F.regexp_replace(path, "/$", "")).otherwise(path)
    parts = F.split(body, "/")
    rule = F.when(F.length(body) == 0, "empty").when(F.contains(body, F.lit("\x00")), "nul")
    if not tar:
        rule = rule.when(F.contains(body, F.lit("\\")) | F.contains(body, F.lit(":")), "forbidden")
    rule = rule.when(F.exists(parts, lambda p: (p == "") | (p == ".") | (p == "..")), "component")
    return rule.when(F.octet_length(path) + (directory & ~path.endswith("/")).cast("int") > 65535, "long")


def padding(size: Column, block: int = 512) -> Column:
    return F.pmod(-size, F.lit(block))


def tar_span(size: Column) -> Column:
    return F.lit(512) + size + padding(size)


def octal(value: Column, width: int) -> Column:
    """Octal text of a tar field, null where it takes base-256."""
    text = F.conv(value.cast("string"), 10, 8)
    return F.when((value >= 0) & (F.length(text) < width), F.lpad(text, width - 1, "0"))


def pax_length(key: str, value: Column) -> Column:
    """Length of '<length> key=value\\n', whose first number counts itself."""
    rest = F.octet_length(value) + len(key) + 3
    one = rest + F.length(rest.cast("string"))
    return rest + F.length(one.cast("string"))


def filetime(seconds: Column) -> Column:
    """100 ns since 1601; DECIMAL as it may pass 2**63."""
    return ((seconds + F.lit(11_644_473_600)).cast("decimal(20,0)") * F.lit(10_000_000)).cast("decimal(20,0)")


def dos_time(ts: Column) -> Column:
    inside = F.shiftleft(F.hour(ts), 11).bitwiseOR(F.shiftleft(F.minute(ts), 5)).bitwiseOR(F.floor(F.second(ts) / 2).cast("int"))
    return F.when(F.year(ts) < 1980, 0).when(F.year(ts) > 2107, 0xBF7D).otherwise(inside)


def dos_date(ts: Column) -> Column:
    inside = F.shiftleft(F.year(ts) - 1980, 9).bitwiseOR(F.shiftleft(F.month(ts), 5)).bitwiseOR(F.dayofmonth(ts))
    return F.when(F.year(ts) < 1980, 0x21).when(F.year(ts) > 2107, 0xFF9F).otherwise(inside)


def unix_attributes(mode: Column, directory: Column) -> Column:
    """7z attributes: the mode in the high half, the extension bit, and the kind."""
    return (mode.cast("long") * 65536).bitwiseOR(F.lit(0x8000).cast("long")).bitwiseOR(F.when(directory, 0x10).otherwise(0x20).cast("long"))


def file_kind(mode: Column) -> Column:
    kind = mode.bitwiseAND(F.lit(0o170000))
    return F.when(kind == 0o100000, "file").when(kind == 0o040000, "directory").when(kind == 0o120000, "symlink").otherwise("other")


def zip_method(path: Column, kind: Column, size: Column, chosen: str, heuristic: bool = True) -> Column:
    stored = (kind != "file") | (size == 0)
    if heuristic:
        stored |= is_stored_extension(path)
    return F.when(stored, "stored").otherwise(chosen)


def seven_zip_copies(stored: Column, kind: Column, size: Column, heuristic: Column) -> Column:
    """Whether a 7z writer stores a file as it is: it has data, its extension says it is compressed, and the heuristic is on."""
    return (kind == "file") & (size > 0) & stored & heuristic


def aes_version(encrypted: Column, size: Column) -> Column:
    return F.when(encrypted, F.when(size < 20, 1).otherwise(2))


def extraction_version(method: Column, aes: Column, size: Column, packed: Column, offset: Column) -> Column:
    by_method = F.when(method.isin("lzma", "zstd", "ppmd"), 63).when(method == "bzip2", 46).otherwise(20)
    big = (size >= LIMIT32) | (packed >= LIMIT32) | (offset >= LIMIT32)
    return F.greatest(by_method, F.when(aes.isNotNull(), 51).otherwise(20), F.when(big, 45).otherwise(20))


def lzip_dictionary_code(size: Column) -> Column:
    """Exponent of the least power of two from 2**12 to 2**29 that holds size."""
    power = F.ceil(F.log2(F.greatest(size, F.lit(1)).cast("double"))).cast("int")
    return F.least(F.greatest(power, F.lit(12)), F.lit(29))


def timestamp_fits(seconds: Column, form: str) -> Column:
    low, high = {"zip": (-(2**31), 2**31 - 1), "lha": (0, 2**32 - 1), "7z": (-11_644_473_600, 2**60 // 10**7), "tar": (-(2**62), 2**62)}[form]
    return seconds.between(low, high)
