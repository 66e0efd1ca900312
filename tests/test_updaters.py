import io
import os
import random
import tarfile
import zipfile

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from bindery.functions import decoders, headers
from bindery.operators import ranges
from bindery.plans import create, options, segments, updaters
from bindery.sources import layouts, sinks, units

ROWS = "ord long, path string, kind string, data binary, link string"


def read(spark, path, password=None):
    reader = spark.read.option("password", password) if password else spark.read
    return {r.path.rstrip("/"): (r.kind, bytes(r.data) if r.data is not None else None, r.link) for r in reader.format("archive_entries").load(str(path)).collect()}


@pytest.fixture(scope="module")
def rows(spark):
    sinks.register(spark)
    values = [(i, f"d/表{i:02d}.txt", "file", b"text %d " % i * (i + 1) * 9, None) for i in range(12)] + [(20, "empty", "file", b"", None), (30, "dir", "directory", None, None)]
    return spark.createDataFrame(values, ROWS)


def tar_of(rnd):
    """A tar with hard links to files and to links, long and composed names, and its members."""
    members, out = [], io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT) as t:
        for i in range(rnd.randrange(12, 25)):
            name = f"m{i}" + ("/é" if i % 5 == 1 else "") + ("x" * 120 if i % 7 == 2 else "")
            files = [m for m in members if m["kind"] in ("file", "hardlink")]
            kind = "hardlink" if files and rnd.random() < 0.4 else "file"
            info = tarfile.TarInfo(name)
            data, target = b"", None
            if kind == "hardlink":
                target = rnd.choice(files)
                info.type, info.linkname = tarfile.LNKTYPE, target["name"]
                data = target["data"]
            else:
                data = rnd.randbytes(rnd.randrange(0, 1500))
                info.size = len(data)
            t.addfile(info, io.BytesIO(data) if kind == "file" else None)
            members.append({"name": name, "kind": kind, "data": data, "target": target})
    return out.getvalue(), members


@pytest.mark.parametrize("seed", [1, 2])
def test_tar_edits_equal_a_plain_model(spark, tmp_path, seed):
    """Removals and renames of files that links need: every surviving name has its data, whoever holds it; updater and rewriter agree."""
    rnd = random.Random(seed)
    raw, members = tar_of(rnd)
    (tmp_path / "t.tar").write_bytes(raw)
    gone = set(rnd.sample(range(len(members)), 6))
    names = {i: f"new/{i}" + ("表" * 40 if i % 2 else "") for i in rnd.sample(sorted(set(range(len(members))) - gone), 4)}
    new = spark.createDataFrame([("added", "file", b"new data")], "path string, kind string, data binary")
    want = {names.get(i, m["name"]): m["data"] for i, m in enumerate(members) if i not in gone} | {"added": b"new data"}
    other = updaters.Rewriter(spark, str(tmp_path / "t.tar"))
    other.remove(sorted(gone)).rename(names).add(new)
    other.commit("tar", str(tmp_path / "other.tar"))
    updater = updaters.TarUpdater(spark, str(tmp_path / "t.tar"))
    updater.remove(sorted(gone)).rename(names).add(new)
    seen = []
    stats = updater.commit(lambda done, total: seen.append((done, total)))
    assert stats.strategy == "rebuild" and stats.carried > 0 and seen == sorted(seen) and seen[-1][0] == seen[-1][1]
    for path in ("t.tar", "other.tar"):
        with tarfile.open(tmp_path / path) as t:
            assert {m.name: t.extractfile(m).read() for m in t} == want
            order = [m.name for m in t]
            assert order == [names.get(i, m["name"]) for i, m in enumerate(members) if i not in gone] + ["added"]
    assert len(os.listdir(tmp_path)) == 2


def test_faults_are_found_before_the_archive_is_replaced(spark, rows, tmp_path):
    path = str(tmp_path / "t.tar")
    create.create(rows, path, "tar")
    before = open(path, "rb").read()
    with pytest.raises(FileExistsError):
        create.create(rows, path, "tar")

    def flip(staged):
        with open(staged, "r+b") as f:
            f.seek(3000)
            b = f.read(1)
            f.seek(3000)
            f.write(bytes([b[0] ^ 1]))

    with pytest.raises(segments.OutputError, match="V5"):
        updaters.TarUpdater(spark, path).remove([0]).commit(fault=flip)
    with pytest.raises(segments.OutputError, match="V4"):
        updaters.TarUpdater(spark, path).remove([0]).commit(fault=lambda p: os.truncate(p, 512))

    def stop(done, total):
        raise KeyError("stop")

    with pytest.raises(KeyError, match="stop"):
        updaters.TarUpdater(spark, path).remove([0]).commit(stop)
    changed = updaters.TarUpdater(spark, path).remove([0])
    os.utime(path, (1, 1))
    with pytest.raises(updaters.SourceChanged):
        changed.commit()
    assert open(path, "rb").read() == before and os.listdir(tmp_path) == ["t.tar"]
    assert updaters.TarUpdater(spark, path).commit().strategy == "unchanged"


def test_zip_strategies_and_placement(spark, rows, tmp_path):
    path = str(tmp_path / "t.zip")
    create.create(rows, path, "zip")
    new = spark.createDataFrame([("b", "file", b"bb" * 99), ("a", "file", b"a")], "path string, kind string, data binary")
    same = units.units_of(path)
    first = next(same)[4]
    u = updaters.ZipUpdater(spark, path)
    assert u.strategy() == "unchanged"
    assert updaters.ZipUpdater(spark, path).rename({0: first[:-4] + ".abc"}).strategy() == "patch"
    assert updaters.ZipUpdater(spark, path).add(new).strategy() == "append" and updaters.ZipUpdater(spark, path).remove([1]).strategy() == "rebuild"
    begin = updaters.ZipUpdater(spark, path, options=options.Options(placement="beginning")).rename({3: "long/" + "n" * 200}).add(new)
    begin.commit()
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and z.namelist()[:2] == ["a", "b"] and "long/" + "n" * 200 in z.namelist() and z.read("b") == b"bb" * 99


def test_seven_zip_changes_its_password(spark, rows, tmp_path):
    path = str(tmp_path / "t.7z")
    create.create(rows, path, "7z", options.Options(password="one", block_bytes=900, preset=1))
    with pytest.raises(decoders.WrongPassword):
        updaters.SevenZipUpdater(spark, path, "two").remove([0]).commit()
    updaters.SevenZipUpdater(spark, path, "one", new_password="two").commit()
    plain = read(spark, path, "two")
    assert len(plain) == 14 and plain["d/表11.txt"][1] == b"text 11 " * 12 * 9
    updaters.SevenZipUpdater(spark, path, "two", new_password=None).remove([0]).commit()
    with layouts.Ranged(path) as src:
        assert not any(f.encrypted for f in layouts.seven_zip_model(src).folders)
    assert len(read(spark, path)) == 13


def test_compressed_tars_carry_chunks(spark, tmp_path):
    rnd = random.Random(3)
    path = str(tmp_path / "t.tar.bz2")
    values = [(i, f"f{i:02d}", "file", rnd.randbytes(300_000), None) for i in range(12)]
    create.create(spark.createDataFrame(values, ROWS), path, "tar.bz2", options.Options(bzip2_level=1))
    u = updaters.CompressedTarUpdater(spark, path, options.Options(bzip2_level=1))
    assert len(u.chunks) > 6
    stats = u.remove([9]).commit()
    assert stats.carried > 5 * 300_000 and os.listdir(tmp_path) == ["t.tar.bz2"]
    with tarfile.open(path) as t:
        assert {m.name: t.extractfile(m).read() for m in t} == {p: d for i, p, _, d, _ in values if i != 9}


def test_options_are_checked_in_order(spark, rows, tmp_path):
    for bad, form, name in (({"deflate_level": 10, "zstd_level": 0}, "zip", "deflate_level"), ({"zstd_level": 0, "password": ""}, "zip", "zstd_level"), ({"password": "x"}, "tar", "password"), ({"distance": 257}, "7z", "filter"), ({"preset": 11}, "7z", "preset"), ({"threads": 0}, "zip", "threads"), ({"block_bytes": 0}, "7z", "solid"), ({"owner_ids": True}, "lzh", "owner_ids"), ({}, "tar.rar", "form")):
        with pytest.raises(options.OptionError, match=name):
            create.create(rows, str(tmp_path / "x"), form, options.Options(**bad))
    assert options.automatic_threads(8, 4 << 30) == 4 and options.automatic_threads(8, 1 << 60, True) == 4 and options.automatic_threads(1, 0) == 1
    assert options.Options().pending("tar") == 0 and options.Options(threads=3).pending("tar.gz") == 4 << 20
    for form, path in (("zip", "a\\b"), ("tar", "a/../b"), ("lzh", "é")):
        with pytest.raises(create.EntryError, match="path|name"):
            create.create(spark.createDataFrame([(0, "fine", "file", b"", None), (1, path, "file", b"", None)], ROWS), str(tmp_path / "x"), form)
    with pytest.raises(create.EntryError, match="twice"):
        create.create(spark.createDataFrame([(0, "é", "file", b"", None), (1, "é", "file", b"", None)], ROWS), str(tmp_path / "x"), "tar")
    assert os.listdir(tmp_path) == []


def test_cutter_holds_its_limits():
    rnd, cutter, seen = random.Random(6), create.Cutter(1000, 2500), {}
    for m in range(400):
        header, body = rnd.choice([(512, 0), (512, rnd.randrange(600)), (512, rnd.randrange(20_000)), (1536, 3000)])
        parts = cutter.cut(header, body)
        assert parts[0][1] == 0 and parts[-1][2] == header + body and all(a[2] == b[1] for a, b in zip(parts, parts[1:], strict=False))
        for chunk, lo, hi in parts:
            seen.setdefault(chunk, []).append((m, hi - lo, header + body))
    assert sorted(seen) == list(range(len(seen)))
    for own in seen.values():
        assert sum(n for _, n, _ in own) <= (1000 if len(own) > 1 or own[0][2] <= 1000 else 2500)


def test_file_trees_and_changes(spark, tmp_path):
    sinks.register(spark)
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "f").write_bytes(b"12345")
    os.link(tmp_path / "a" / "b" / "f", tmp_path / "g")
    os.symlink("g", tmp_path / "s")
    tree = spark.read.format("file_tree").load(str(tmp_path))
    before = spark.createDataFrame(tree.collect(), tree.schema)
    assert [(r.path, r.kind, r.size, r.link) for r in before.orderBy("path").collect()] == [("a", "directory", 0, None), ("a/b", "directory", 0, None), ("a/b/f", "file", 5, None), ("g", "file", 5, None), ("s", "symlink", 0, "g")]
    from bindery.sources.listing import changed

    (tmp_path / "new").write_bytes(b"")
    assert {r.path for r in changed(before, spark.read.format("file_tree").load(str(tmp_path))).collect()} >= {"new"}
    stored = spark.read.format("file_tree").option("payload", "true").load(str(tmp_path))
    out = str(tmp_path / "tree.tar")
    create.create(stored.withColumn("ord", F.row_number().over(Window.orderBy("path")).cast("long")), out, "tar")
    with tarfile.open(out) as t:
        assert [(m.name, m.issym()) for m in t] == [("a", False), ("a/b", False), ("a/b/f", False), ("g", False), ("new", False), ("s", True)] and t.extractfile("a/b/f").read() == b"12345"
    assert headers.BLOCK == 512


def test_levels_and_single_streams(spark, rows, tmp_path):
    import bz2
    import gzip
    import lzma

    text = spark.createDataFrame([(0, "a.txt", "file", " ".join(str(i * i) for i in range(9000)).encode(), None)], ROWS)
    data = bytes(text.first().data)
    sizes = {}
    for name, form, chosen in (("d1", "zip", {"deflate_level": 1}), ("d9", "zip", {"deflate_level": 9}), ("z1", "tar.zst", {"zstd_level": 1}), ("z19", "tar.zst", {"zstd_level": 19, "threads": 1}), ("b.tar.br", "tar.br", {})):
        create.create(text, str(tmp_path / name), form, options.Options(**chosen))
        assert read(spark, tmp_path / name)["a.txt"][1] == data
        sizes[name] = os.path.getsize(tmp_path / name)
    assert sizes["d9"] < sizes["d1"] and sizes["z19"] < sizes["z1"]
    for form, plain in (("gz", gzip.decompress), ("bz2", bz2.decompress), ("xz", lzma.decompress), ("lz", decoders.lzip_plain), ("Z", decoders.lzw_plain), ("lz4", decoders.lz4_plain), ("br", decoders.brotli_plain)):
        text.selectExpr("ord", "path", "data", "kind", "cast(null as int) mode", "cast(null as long) mtime", "link").write.format("archive").mode("append").option("form", form).save(str(tmp_path / form))
        assert plain((tmp_path / form / f"a.txt.{form}").read_bytes()) == data


def test_payloads_are_not_put_in_order(spark, rows, tmp_path, monkeypatch):
    """What one window may bring into one task is numbers."""
    sums = ranges.running

    def running(df, *args):
        assert not {"bytes", "data"} & set(df.columns)
        return sums(df, *args)

    monkeypatch.setattr(ranges, "running", running)
    create.create(rows, path := str(tmp_path / "t.tar"), "tar")
    assert read(spark, path)["d/表11.txt"][1] == b"text 11 " * 12 * 9 and os.listdir(tmp_path) == ["t.tar"]


@pytest.mark.parametrize("form", ["tar", "zip", "lzh", "7z"])
def test_tasks_walk_their_own_part(spark, rows, tmp_path, monkeypatch, form):
    """What a task reads of an archive's headers doesn't grow with the archive."""
    path = str(tmp_path / f"t.{form}")
    create.create(rows, path, form, options.Options(lha="lh0") if form == "lzh" else options.Options(block_bytes=900, preset=1) if form == "7z" else None)
    whole = [r[:8] + (bytes(r[8]) if r[8] is not None else None,) for r in (units.EntriesReader({"path": path}).rows(units.Part(path)))]
    monkeypatch.setattr(units, "SPLIT", 500)
    calls, one = [], units.unit
    monkeypatch.setattr(units, "unit", lambda *a, **k: calls.append(1) or one(*a, **k))
    reader = units.EntriesReader({"path": path})
    parts = reader.partitions()
    calls.clear()
    found = [tuple(r.values()) for p in parts for batch in reader.read(p) for r in batch.to_pylist()]
    assert len(parts) > 3 and found == whole and len(calls) <= len(whole)


@pytest.mark.parametrize("codec", ["gzip", "bzip2", "xz", "zstd", "lzip"])
def test_streams_are_decoded_as_they_are_read(tmp_path, codec):
    body = b"".join(headers.tar_member(b"f%d" % i, "file", 600_000, 0o644, 1, b"") + bytes([i]) * 600_000 + bytes(64) for i in range(20))
    packed = b"".join(updaters.leveled(codec)(body[at : at + 1_000_000]) for at in range(0, len(body), 1_000_000))
    (tmp_path / "t").write_bytes(packed)
    with layouts.Ranged(str(tmp_path / "t")) as src:
        inner, most, sizes = decoders.Stream(src, codec), 0, []
        for u in layouts.tar_walk(inner):
            assert inner.read(u.data, 600_000) == bytes([len(sizes)]) * 600_000
            sizes.append(u.end - u.data)
            most = max(most, len(inner.held))
        assert sizes == [600_000] * 20 and most < len(body) / 2
        assert decoders.chunks_of(decoders.streamed(src, codec)) == decoders.stream_chunks(packed, codec) and inner.start > 0


def test_tasks_of_seven_zip_are_not_sent_the_model(spark, tmp_path, monkeypatch):
    from pyspark import cloudpickle
    from pyspark.sql.classic.dataframe import DataFrame

    path, own, seen = str(tmp_path / "t.7z"), DataFrame.mapInArrow, []
    values = spark.range(600).selectExpr("id as ord", "concat('a/long/name/of/a/file/', id) as path", "'file' as kind", "cast(repeat(cast(id as string), 20) as binary) as data")
    create.create(values, path, "7z", options.Options(block_bytes=2000, preset=1))
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, f, *a, **k: seen.append(len(cloudpickle.dumps(f))) or own(self, f, *a, **k))
    updaters.SevenZipUpdater(spark, path).remove([3, 300]).rename({5: "n"}).commit()
    assert len(seen) > 3 and max(seen) < 20_000 and len(read(spark, path)) == 598


@pytest.mark.parametrize("form", ["7z", "tar.bz2"])
def test_what_is_encoded_anew_is_dealt_by_its_bytes(spark, tmp_path, monkeypatch, form):
    """Not by the bytes of the rows that tell of it, which fit one task."""
    path, seen = str(tmp_path / f"t.{form}"), []
    values = spark.range(64).selectExpr("id as ord", "concat('f', id) as path", "'file' as kind", "cast(repeat(cast(id as string), 2000) as binary) as data")
    create.create(values, path, form, options.Options(block_bytes=9000, preset=1) if form == "7z" else None)
    monkeypatch.setattr(updaters, "ENCODED", 5000)
    u = (updaters.SevenZipUpdater if form == "7z" else updaters.CompressedTarUpdater)(spark, path)
    own = type(u).encoded
    monkeypatch.setattr(type(u), "encoded", lambda self, *a: seen.append(own(self, *a)) or seen[0])
    u.remove(list(range(0, 64, 2))).commit()
    assert seen[0].rdd.getNumPartitions() > 4 and len(read(spark, path)) == 32
