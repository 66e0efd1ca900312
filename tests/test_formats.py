import os
import random
import tarfile
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bindery.functions import codecs, crypto, decoders, headers, lh, records, seven_zip
from bindery.sources import layouts, sinks, units

RND = random.Random(4)
ROWS = [{"ord": i, "path": f"d/e{i:03d}.txt", "data": (b"text %d " % i) * i * 9} for i in range(40)]
ROWS += [{"ord": 100, "path": "d/random.bin", "data": RND.randbytes(5000)}, {"ord": 101, "path": "d/表.exe", "data": bytes(RND.choice(b"\xe8\xe9\x00\xff\x10\x94\x90") for _ in range(40000))}, {"ord": 102, "path": "dir", "kind": "directory", "data": None}]


class Row(dict):
    def asDict(self):
        return dict(self)


def written(folder, form, **options):
    writer = sinks.ArchiveWriter({"path": str(folder), "form": form, **options})
    writer.commit([writer.write(Row(r) for r in ROWS)])
    return folder / os.listdir(folder)[0]


def extracted(path, password=None):
    """What the decoders, which share no code with the encoders, make of an archive: files and folders."""
    names = [n.split()[0] for n in units.UNITS.split(", ")]
    reader = units.EntriesReader({"path": str(path)} | ({"password": password} if password else {}))
    rows = [r for part in reader.partitions() for r in reader.read(part)]
    assert names[0] == "archive" and [r[1] for r in rows] == list(range(len(rows)))
    return {r[2]: r[8] for r in rows if r[3] == "file"}, "dir" in {r[2].rstrip("/") for r in rows if r[3] == "directory"}


WANT = {r["path"]: r["data"] for r in ROWS if r["data"] is not None}
FORMS = [(f, {}) for f in (*sinks.ZIP_FORMS, *sinks.SEVEN_ZIP_FORMS, *sinks.LHA_FORMS)] + [("zip", {"password": "pw", "cipher": c}) for c in ("aes", "stream")]
FORMS += [("7z", {"filter": f}) for f in ("delta", "x86", "arm64")] + [("7z", {"block_bytes": "3000", "block_files": "4"}), ("7z.copy", {"filter": "x86"})]


@pytest.mark.parametrize(("form", "options"), FORMS)
def test_decoders_extract_the_same(tmp_path, form, options):
    (tmp_path / "a").mkdir()
    assert extracted(written(tmp_path / "a", form, **options), options.get("password")) == (WANT, True)


def test_stream_cipher_opens_with_zipfile_and_aes_by_hand(tmp_path):
    for cipher in ("stream", "aes"):
        (folder := tmp_path / cipher).mkdir()
        path = written(folder, "zip", password="secret", cipher=cipher)
        with zipfile.ZipFile(path) as z:
            if cipher == "stream":
                assert {n: z.read(n, b"secret") for n in z.namelist() if not n.endswith("/")} == WANT
                with pytest.raises(RuntimeError):
                    z.read("d/e005.txt", b"wrong")
            else:
                info = z.getinfo("d/e005.txt")
                raw = path.read_bytes()[info.header_offset :]
                body = raw[30 + len(info.filename.encode()) + 11 :][: info.compress_size]
                assert zlib.decompress(crypto.zip_aes_opened(body, "secret"), -15) == WANT["d/e005.txt"]
                with pytest.raises(ValueError, match="password"):
                    crypto.zip_aes_opened(body, "other")
                with pytest.raises(ValueError, match="authentication"):
                    crypto.zip_aes_opened(body[:-1] + bytes([body[-1] ^ 1]), "secret")


def test_aes_known_values():
    key, plain = bytes(range(32)), bytes.fromhex("00112233445566778899aabbccddeeff")  # FIPS 197, C.3
    block = crypto.encrypt_blocks(key, np.frombuffer(plain, np.uint8)[None])
    assert block.tobytes().hex() == "8ea2b7ca516745bfeafc49904b496089"
    assert crypto.decrypt_blocks(key, block).tobytes() == plain


def test_cbc_of_columns_is_undone(spark):
    key, iv = RND.randbytes(32), RND.randbytes(16)
    data = [b"", b"a", RND.randbytes(16), RND.randbytes(1000)]
    rows = spark.createDataFrame([(d,) for d in data], "d binary").select("d", crypto.cbc_encrypted(F.col("d"), F.lit(key), F.lit(iv)).alias("e")).collect()
    for r in rows:
        d, e = bytes(r.d), bytes(r.e)
        assert len(e) == -(-len(d) // 16) * 16
        assert crypto.cbc_decrypted(key, iv, e) == d + bytes(len(e) - len(d))


def test_reencryption_keeps_the_packed_bytes(spark):
    data = [b"", b"abc", RND.randbytes(999), None]
    df = spark.createDataFrame([(d, zlib.crc32(d or b""), RND.randbytes(16)) for d in data], "d binary, crc long, salt binary")
    old, new = ("stream", "a"), ("aes", "b")
    df = df.withColumn("x", crypto.reencrypted("d", "crc", "salt", None, old)).withColumn("y", crypto.reencrypted("x", "crc", "salt", old, new))
    got = df.select("d", crypto.reencrypted("y", "crc", "salt", new, None).alias("back")).collect()
    assert all(r.d == r.back for r in got)


def test_filters_and_names(spark):
    data = np.array([RND.choice([0x94000005, 0x97FFFFF0, 0x90000001, 0xB0FFFFE3, 0xD503201F]) for _ in range(3000)], "<u4").tobytes() + b"xyz"
    assert codecs.branch_arm64(codecs.branch_arm64(data), undo=True) == data != codecs.branch_arm64(data)
    assert codecs.branch_arm64(b"") == codecs.branch_x86(b"") == b""
    rows = spark.createDataFrame([("é",), ("表",), ("\U0001f600",), (None,)], "p string").select(records.nfc("p").alias("n"), records.cp932("p").alias("c")).collect()
    assert [(r.n, r.c and bytes(r.c)) for r in rows] == [("é", None), ("表", b"\x95\\"), ("\U0001f600", None), (None, None)]


def test_numbers_and_bits():
    assert [records.number(v).hex() for v in (0, 127, 128, 16383, 16384, 2**56 - 1, 2**64 - 1)] == ["00", "7f", "8080", "bfff", "c00040", "fe" + "ff" * 7, "ff" * 9]
    assert records.xz_number(300) == b"\xac\x02"
    assert records.bits([True, False, True] + [False] * 6 + [True]) == b"\xa0\x40"


def test_zip64_records():
    end = records.zip_end(70000, 10, 2**33)
    assert end[:4] == b"PK\6\6" and end[56:60] == b"PK\6\7" and end[76:80] == b"PK\5\6"
    assert records.zip_central(b"a", 0, 0, 0, 0, 5, 5, 2**33, 0)[-12:] == b"\1\0\x08\0" + (2**33).to_bytes(8, "little")


def test_deep_trees_stay_within_16_bits():
    from collections import Counter

    a, b, counts = 1, 1, Counter()
    for s in range(40):
        counts[s], a, b = a, b, a + b
    depth = lh.lengths(counts)
    assert max(depth.values()) <= 16 and sum(2.0**-n for n in depth.values()) <= 1


def test_sink_refuses_what_a_form_cannot_hold(tmp_path):
    for options in ({"form": "7z", "password": "x"}, {"form": "zip", "password": ""}, {"form": "zip", "password": "x", "cipher": "rot"}, {"form": "7z", "filter": "y"}, {"form": "q"}):
        with pytest.raises(ValueError):
            sinks.ArchiveWriter({"path": str(tmp_path), **options})
    with pytest.raises(ValueError, match="can't be stored"):
        sinks.ArchiveWriter({"path": str(tmp_path), "form": "zip"}).write([Row(ord=0, path="x", kind="hardlink", link="y")])


PAYLOADS = [b"", b"a", b"abc" * 5000, RND.randbytes(70_000), b"the cat and the hat " * 9000]


@pytest.mark.parametrize("variant", list(lh.VARIANTS))
def test_lh_codecs_are_undone(variant):
    for data in PAYLOADS:
        assert decoders.lh_plain(lh.static_huffman(data, variant), variant, len(data)) == data


def test_lh_matches_cross_pieces_and_stay_in_the_window():
    """A copy from the piece before, runs longer than the longest match, and repeats just inside and outside every window."""
    unit = RND.randbytes(500)
    for variant, (window, _) in lh.VARIANTS.items():
        near = unit + RND.randbytes((1 << window) - 1001) + unit
        for data in (near, unit + RND.randbytes(1 << window) + unit, RND.randbytes(lh.PIECE - 250) + unit + unit, bytes(lh.PIECE + 77), *(bytes(RND.choice(b"ab") for _ in range(n)) for n in range(12))):
            assert decoders.lh_plain(lh.static_huffman(data, variant), variant, len(data)) == data
        assert len(lh.static_huffman(near, variant)) < len(lh.static_huffman(near[:-500] + RND.randbytes(500), variant)) - 400


def test_stream_cipher_at_once_equals_byte_by_byte():
    data = RND.randbytes(3000) + b"text " * 600_000
    whole, parts = crypto.StreamCipher(b"pw"), crypto.StreamCipher(b"pw")
    sealed = whole.apply(data)
    assert sealed[:70_000] == b"".join(parts.apply(data[at : at + 1000]) for at in range(0, 70_000, 1000))
    assert crypto.StreamCipher(b"pw").apply(sealed, True) == data


def test_brotli_shrinks_and_joins_nothing():
    data = b"the cat and the hat " * 9000
    assert len(codecs.brotli(data)) < len(data) // 100 and "brotli" not in codecs.JOINABLE
    assert decoders.brotli_plain(codecs.brotli(b"")) == b""


def test_streams_and_filters_are_undone():
    for data in PAYLOADS:
        for codec, plain in decoders.STREAM_DECODERS.items():
            assert plain(codecs.CODECS[codec](data)) == data, codec
        assert decoders.undo_delta(codecs.delta(data, 3), 3) == data and decoders.undo_x86(codecs.branch_x86(data)) == data
        for codec in codecs.JOINABLE[:5]:
            encode = codecs.CODECS[codec]
            chunks = decoders.stream_chunks(encode(data) + encode(b"x" * 100) + encode(data), codec)
            assert [n for _, _, n in chunks] == [len(data), 100, len(data)] and all(a[1] == b[0] for a, b in zip(chunks, chunks[1:], strict=False))


def test_tar_headers_are_read_by_the_library(tmp_path):
    names = ["a", "d/" * 45 + "leaf" * 20, "x" * 140, "dir/" + "y" * 120 + "/" + "z" * 90, "表/é", "p" * 300]
    body = b"".join(headers.tar_member(n.encode(), "file", 3, 0o640, t, b"") + b"abc" + bytes(509) for n, t in zip(names, (0, 1, 8**11, -5, 10, 2**40), strict=True))
    body += headers.tar_member(b"link", "hardlink", 0, 0o644, 5, ("x" * 140).encode()) + headers.tar_member(b"sym", "symlink", 0, 0o777, 5, "表".encode())
    (tmp_path / "t.tar").write_bytes(body + headers.tar_end(len(body)))
    with tarfile.open(tmp_path / "t.tar") as t:
        got = t.getmembers()
        assert [m.name for m in got] == [*names, "link", "sym"] and [int(m.mtime) for m in got[:6]] == [0, 1, 8**11, -5, 10, 2**40]
        assert got[6].linkname == "x" * 140 and got[7].linkname == "表" and all(t.extractfile(m).read() == b"abc" for m in got[:6])
    assert (tmp_path / "t.tar").stat().st_size % headers.RECORD == 0
    with layouts.Ranged(str(tmp_path / "t.tar")) as src:
        found, end = layouts.tar_units(src)
        assert [u.name.decode() for u in found] == [*names, "link", "sym"] and end == len(body)
        for u in found[:6]:
            new = "renamed/" + "表" * 60
            part = src.some(u.lo, u.hi - u.lo)
            fresh = headers.tar_rewritten(u, part[u.header - u.lo : u.data - u.lo], new.encode())
            (tmp_path / "one.tar").write_bytes(fresh + part[u.data - u.lo :] + bytes(1024))
            with tarfile.open(tmp_path / "one.tar") as one:
                assert [(m.name, one.extractfile(m).read()) for m in one] == [(new, b"abc")]


def test_ustar_fields():
    assert headers.split_name(b"a" * 100) == (b"a" * 100, b"") and headers.split_name(b"a" * 101) is None
    assert headers.split_name(b"p" * 155 + b"/" + b"n" * 100) == (b"n" * 100, b"p" * 155) and headers.split_name(b"p" * 156 + b"/" + b"n") is None
    leaf, prefix = headers.split_name(b"d/" * 60)
    assert prefix + b"/" + leaf == b"d/" * 60 and leaf.endswith(b"/")
    assert headers.tar_field(8**11 - 1, 12) == b"7" * 11 + b"\0" and headers.tar_field(8**11, 12)[0] == 0x80 and headers.tar_field(-1, 12) == b"\xff" * 12
    assert layouts.tar_number(headers.tar_field(8**11 + 5, 12)) == 8**11 + 5 and headers.pax_name(b"a/b/c") == b"a/b/PaxHeader/c"
    for n in (1, 5, 90, 91, 92, 990, 991, 992):
        record = headers.pax_record("k", b"v" * n)
        assert int(record.split(b" ")[0]) == len(record) and layouts.pax_records(record) == [("k", b"v" * n)]


def refusal(tmp_path, data):
    path = tmp_path / "x"
    path.write_bytes(data)
    return units.assessed(str(path))[3:5]


def test_archives_that_may_not_be_edited_are_refused(tmp_path):
    (tmp_path / "z").mkdir(), (tmp_path / "l").mkdir(), (tmp_path / "s").mkdir()
    good = written(tmp_path / "z", "zip").read_bytes()
    assert refusal(tmp_path, good) == (True, None)
    assert refusal(tmp_path, good + b"trailing") == (False, "P2") and refusal(tmp_path, good[:-22] + good[-22:-6] + b"\0\0\0\0" + good[-2:])[1] in ("P3", "invalid")
    nested = good[:-2] + (22).to_bytes(2, "little") + good[-22:-2] + b"\0\0"
    assert refusal(tmp_path, nested) == (False, "P4")
    member = headers.tar_member(b"a", "file", 0, 0o644, 1)
    end = headers.tar_end(0)
    for code, raw in (("R1", headers.pax_block(b"g", [("path", b"x")]).replace(b"x\0", b"g\0", 1)), ("R4", headers.pax_block(b"a", [("hdrcharset", b"BINARY")]) + member)):
        header = bytearray(raw[:512])
        if code == "R1":
            header = bytearray(headers.tar_block(b"g", b"g", len(headers.pax_record("path", b"x"))))
        assert refusal(tmp_path, bytes(header) + raw[512:] + end) == (False, code)
    assert refusal(tmp_path, member + headers.tar_block(b"s", b"S", 0) + end) == (False, "R2")
    assert refusal(tmp_path, member + headers.tar_block(b"s", b"1", 5) + bytes(512) + end) == (False, "R3")
    assert refusal(tmp_path, member + bytes(100) + b"x" + bytes(411) + end) == (False, "R8")
    assert refusal(tmp_path, member + headers.pax_block(b"a", [("path", b"x")]) + end) == (False, "R8")
    lzh = written(tmp_path / "l", "lzh.stored").read_bytes()
    assert refusal(tmp_path, lzh) == (True, None) and refusal(tmp_path, lzh[:-1]) == (False, "L2") and refusal(tmp_path, lzh + b"x") == (False, "L3")
    seven = written(tmp_path / "s", "7z").read_bytes()
    assert refusal(tmp_path, seven) == (True, None) and refusal(tmp_path, seven[:-1])[0] is False


def test_seven_zip_models_are_written_as_they_are_read(tmp_path):
    path = written(tmp_path, "7z", filter="x86", block_bytes="3000", block_files="4")
    with layouts.Ranged(str(path)) as src:
        model = layouts.seven_zip_model(src)
        header = seven_zip.header_of(model)
        raw = seven_zip.start_of(header, model.header[0]) + src.some(32, model.header[0] - 32) + header
    (tmp_path / "again.7z").write_bytes(raw)
    assert extracted(tmp_path / "again.7z") == (WANT, True)
    assert seven_zip.property_order([0x15, 0x11], {0x11, 0x15, 0x0E, 0x14}) == [0x0E, 0x14, 0x15, 0x11]
    folder, data = seven_zip.packed(b"abc" * 99, "lzma2", "delta", 3)
    hidden = seven_zip.with_cipher(folder, seven_zip.aes_properties(bytes(16)), len(data))
    assert hidden.can_reencrypt and hidden.encrypted and not folder.encrypted and decoders.folder_plain(folder, [data]) == b"abc" * 99
    bare = seven_zip.without_cipher(hidden)
    assert (bare.coders, bare.binds, bare.packed_inputs, bare.sizes) == (folder.coders, folder.binds, folder.packed_inputs, folder.sizes)
    two = layouts.Folder([*hidden.coders, layouts.Coder(layouts.AES)], [], [0], [], None, range(1))
    assert not two.can_reencrypt


def test_zip_headers_of_renamed_entries():
    extra = b"\x75\x70\x03\x00abc" + b"\x99\x99\x02\x00zz"
    assert headers.renamed_extra(extra) == b"\xff\xff\x03\x00\0\0\0" + b"\x99\x99\x02\x00zz"
    for bad in (b"\x05\x26\x01\x00x", extra + b"old"):
        with pytest.raises(ValueError, match="old name"):
            headers.renamed_extra(bad)
    record = records.zip_central(b"name", 0, 8, 0, 1, 5, 9, 77, 0, b"\x99\x99\x02\x00zz")
    moved = headers.zip_central_moved(record, 2**33, 9, 5, "é".encode())
    assert moved[46:48] == "é".encode() and moved[42:46] == b"\xff" * 4 and b"\x01\x00\x08\x00" + (2**33).to_bytes(8, "little") in moved and moved[8:10] == b"\x00\x08"
    assert headers.zip_central_moved(moved, 5, 9, 5).endswith("é".encode() + b"\x99\x99\x02\x00zz")


def test_pieces_make_one_stream(spark):
    import bz2
    import gzip
    import lzma

    from bindery.functions import pieces

    for data in (b"", b"a" * 900_000, RND.randbytes(800_000), b"the cat and the hat " * 60_000, bytes(RND.choice(b"ab") for _ in range(300_000))):
        parts = [data[i : i + pieces.bzip2_cap(2)] for i in range(0, len(data), pieces.bzip2_cap(2))]
        assert bz2.decompress(pieces.bzip2_stream([pieces.bzip2_block(p, 2) for p in parts], 2)) == data
        parts = [data[i : i + 250_000] for i in range(0, len(data), 250_000)]
        assert lzma.decompress(pieces.xz_stream([pieces.xz_block(p, 1) for p in parts])) == data
    whole = {k: b"some words of text, " * n for k, n in (("a", 4000), ("b", 10), ("c", 0))}
    df = spark.createDataFrame(list(whole.items()), "k string, data binary").select("k", F.explode(pieces.cut(F.col("data"), 30_000)).alias("p")).select("k", "p.piece", "p.bytes")
    rows = pieces.deflated(df, ["k"], "piece", "bytes").collect()
    for k, data in whole.items():
        own = sorted((r for r in rows if r.k == k), key=lambda r: r.piece)
        packed = pieces.gzip_of([bytes(r.block) for r in own], [r.crc for r in own], [r.size for r in own])
        assert gzip.decompress(packed) == data and (len(own) == 3 or k != "a")
        assert len(packed) < 2000  # pieces after the first find their words in the one before
