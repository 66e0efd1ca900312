"""The header of a 7z archive from its model, and folders encoded anew."""

from __future__ import annotations

import bz2
import lzma
import struct
import zlib

from bindery.functions.records import bits, number
from bindery.sources.layouts import AES, Coder, File, Folder, Model

#: File properties in the order in which writers put them.
CANONICAL = (0x0E, 0x0F, 0x10, 0x11, 0x12, 0x13, 0x14, 0x18, 0x15)
PACKERS = {b"\x00": "copy", b"\x21": "lzma2", b"\x03\x01\x01": "lzma", b"\x04\x01\x08": "deflate", b"\x04\x02\x02": "bzip2"}
#: The code of the dictionary of each preset.
DICTIONARIES = (12, 16, 18, 20, 20, 22, 22, 24, 26, 28)
FILTERS = {b"\x03": "delta", b"\x03\x03\x01\x03": "x86", b"\x0a": "arm64"}


def property_order(original: list[int], needed: set[int]) -> list[int]:
    """Needed properties as the archive had them; new ones before the first that comes after them in the usual order."""
    order = [p for p in original if p in needed]
    for p in CANONICAL:
        if p in needed and p not in order:
            after = [i for i, q in enumerate(order) if q in CANONICAL and CANONICAL.index(q) > CANONICAL.index(p)]
            order.insert(after[0] if after else len(order), p)
    return order


def some(values: list, width: str) -> bytes:
    """A vector of which some may be unknown."""
    known = [v is not None for v in values]
    return (b"\x01" if all(known) else b"\0" + bits(known)) + b"\0" + b"".join(struct.pack(width, v) for v in values if v is not None)


def digests(values: list) -> bytes:
    known = [v is not None for v in values]
    return b"\x0a" + (b"\x01" if all(known) else b"\0" + bits(known)) + b"".join(struct.pack("<I", v) for v in values if v is not None)


def header_of(model: Model) -> bytes:
    """The plain header; an archive without files has none."""
    if not model.files:
        return b""
    out = bytearray(b"\x01")
    if model.folders:
        out += b"\x04\x06" + number(model.packs[0][0] - 32) + number(len(model.packs)) + b"\x09" + b"".join(number(hi - lo) for lo, hi in model.packs) + b"\0"
        out += b"\x07\x0b" + number(len(model.folders)) + b"\0"
        for f in model.folders:
            out += number(len(f.coders))
            for c in f.coders:
                complex_ = (c.inputs, c.outputs) != (1, 1)
                out += bytes([len(c.id) | 0x10 * complex_ | 0x20 * bool(c.properties)]) + c.id
                out += number(c.inputs) + number(c.outputs) if complex_ else b""
                out += number(len(c.properties)) + c.properties if c.properties else b""
            out += b"".join(number(i) + number(o) for i, o in f.binds)
            if len(f.packed_inputs) > 1:
                out += b"".join(map(number, f.packed_inputs))
        out += b"\x0c" + b"".join(number(n) for f in model.folders for n in f.sizes)
        if any(f.crc is not None for f in model.folders):
            out += digests([f.crc for f in model.folders])
        out += b"\0\x08"
        if any(len(f.streams) != 1 for f in model.folders):
            out += b"\x0d" + b"".join(number(len(f.streams)) for f in model.folders)
        if any(len(f.streams) > 1 for f in model.folders):
            out += b"\x09" + b"".join(number(model.streams[s][2]) for f in model.folders for s in list(f.streams)[:-1])
        crcs = [model.streams[s][3] for f in model.folders if len(f.streams) != 1 or f.crc is None for s in f.streams]
        out += (digests(crcs) if crcs else b"") + b"\0\0"
    out += b"\x05" + number(len(model.files))
    empty = [f for f in model.files if f.stream is None]
    bodies = {0x11: b"\0" + b"".join(f.name.encode("utf-16-le", "surrogatepass") + b"\0\0" for f in model.files)}
    if empty:
        bodies[0x0E] = bits([f.stream is None for f in model.files])
        for kind, flags in ((0x0F, [f.empty for f in empty]), (0x10, [f.anti for f in empty])):
            if any(flags):
                bodies[kind] = bits(flags)
    for kind, values, width in ((0x12, [f.created for f in model.files], "<Q"), (0x13, [f.accessed for f in model.files], "<Q"), (0x14, [f.modified for f in model.files], "<Q"), (0x15, [f.attributes for f in model.files], "<I")):
        if any(v is not None for v in values):
            bodies[kind] = some(values, width)
    for kind in property_order(model.order, set(bodies)):
        out += bytes([kind]) + number(len(bodies[kind])) + bodies[kind]
    return bytes(out + b"\0\0")


def start_of(header: bytes, at: int) -> bytes:
    """The first 32 bytes; the header stands at `at`."""
    body = struct.pack("<QQI", at - 32 if header else 0, len(header), zlib.crc32(header))
    return b"7z\xbc\xaf\x27\x1c\0\4" + struct.pack("<I", zlib.crc32(body)) + body


def assembled(parts: list[tuple[Folder, list[int], list[tuple[int, int | None]]]], files: list[File], streams_of_files: dict[int, tuple[int, int]], order: list[int]) -> Model:
    """A model of folders in order, which takes over the files. parts: folder, sizes of its packs, (size, crc) of its streams;
    streams_of_files: file to (part, stream in it). Files must use the streams in order."""
    model, at, firsts = Model([], [], [], [], (0, 0), order=order), 32, []
    for k, (folder, packs, streams) in enumerate(parts):
        firsts.append(len(model.streams))
        own = Folder(folder.coders, folder.binds, folder.packed_inputs, folder.sizes, folder.crc, range(len(model.packs), len(model.packs) + len(packs)), range(len(model.streams), len(model.streams) + len(streams)))
        for n in packs:
            model.packs.append((at, at + n))
            at += n
        inside = 0
        for size, crc in streams:
            model.streams.append((k, inside, size, crc))
            inside += size
        model.folders.append(own)
    for i, f in enumerate(files):
        where = streams_of_files.get(i)
        f.stream = None if where is None else firsts[where[0]] + where[1]
        model.files.append(f)
    model.header = (at, at)
    if reason := model.reason():
        raise ValueError(f"V0: {reason}")
    return model


def chain_of(folder: Folder) -> tuple[str, str | None, int]:
    """Packer, filter and delta distance of a folder that can be written anew."""
    packer = next((PACKERS[c.id] for c in folder.coders if c.id in PACKERS), "copy")
    chain = next((c for c in folder.coders if c.id in FILTERS), None)
    if any(c.id not in PACKERS and c.id not in FILTERS and c.id != AES for c in folder.coders):
        raise ValueError("a folder of an unknown method can't be written anew")
    return packer, FILTERS[chain.id] if chain else None, chain.properties[0] + 1 if chain and chain.properties and FILTERS[chain.id] == "delta" else 1


def packed(data: bytes, packer: str = "lzma2", chain: str | None = None, distance: int = 1, preset: int = 6) -> tuple[Folder, bytes]:
    """A folder without its streams, and its packed bytes; the chain is packer, then filter."""
    from bindery.functions.codecs import FILTERS as APPLY
    from bindery.functions.codecs import deflate_raw, delta

    plain, size = data, len(data)
    coders = []
    if chain:
        data = delta(data, distance) if chain == "delta" else APPLY[chain](data)
        coders = [Coder(next(k for k, v in FILTERS.items() if v == chain), bytes([distance - 1]) if chain == "delta" else b"")]
    level, properties = preset, b""
    if packer == "lzma2":
        chosen = {"id": lzma.FILTER_LZMA2, "preset": level}
        data, properties = lzma.compress(data, lzma.FORMAT_RAW, filters=[chosen]), bytes([DICTIONARIES[level & 15]])
    elif packer == "lzma":
        alone = lzma.compress(data, lzma.FORMAT_ALONE, preset=level)
        properties, data = alone[:5], alone[13:]
    elif packer == "deflate":
        data = deflate_raw(data)
    elif packer == "bzip2":
        data = bz2.compress(data, 9)
    coders = [Coder(next(k for k, v in PACKERS.items() if v == packer), properties), *coders]
    folder = Folder(coders, [(i + 1, i) for i in range(len(coders) - 1)], [0], [size] * len(coders), zlib.crc32(plain), range(1))
    return folder, data


def with_cipher(folder: Folder, properties: bytes, n: int) -> Folder:
    """The folder behind a cipher of n packed bytes (before padding)."""
    moved = [(i + 1, o + 1) for i, o in folder.binds]
    return Folder([Coder(AES, properties), *folder.coders], [(folder.packed_inputs[0] + 1, 0), *moved], [0], [n, *folder.sizes], folder.crc, folder.packs, folder.streams)


def without_cipher(folder: Folder) -> Folder:
    """The folder without its cipher, which comes first in every chain that may lose it."""
    at = next(i for i, c in enumerate(folder.coders) if c.id == AES)
    binds = [(i, o) for i, o in folder.binds if o != at]
    fed = next((i for i, o in folder.binds if o == at), 0)
    less = lambda i: i - (i > at)
    return Folder([c for i, c in enumerate(folder.coders) if i != at], [(less(i), less(o)) for i, o in binds], [less(fed)], [n for i, n in enumerate(folder.sizes) if i != at], folder.crc, folder.packs, folder.streams)


def aes_properties(iv: bytes, cycles: int = 19) -> bytes:
    """Of a key without salt and an IV of 16 bytes."""
    return bytes([cycles | 0x40, 15]) + iv
