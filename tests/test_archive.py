import bz2
import datetime
import decimal
import gzip
import lzma
import os
import random
import tarfile
import zipfile
import zlib

import duckdb
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from bindery.functions import checksums, codecs
from bindery.operators import editing, ranges
from bindery.plans import archives, catalog  # noqa: F401
from bindery.plans.editor import Editor, EditError
from bindery.sources import sinks
from bindery.streaming import progress

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        return str(int(v))
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows(names, found):
    order = sorted(names)
    return sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    got = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, got.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


PAYLOADS = [b"", b"a", b"abc" * 5000, bytes(random.Random(3).randrange(256) for _ in range(5000)), b"the cat and the hat and the bat " * 300]


def test_codecs_round_trip():
    readers = {"stored": bytes, "deflate": lambda d: zlib.decompress(d, -15), "zlib": zlib.decompress, "gzip": gzip.decompress, "bzip2": bz2.decompress, "xz": lzma.decompress, "lzma": lzma.decompress, "zstd": lambda d: zstandard.ZstdDecompressor().decompress(d, max_output_size=1 << 20)}
    for name, back in readers.items():
        for data in PAYLOADS:
            assert back(codecs.CODECS[name](data)) == data, name
    for data in PAYLOADS:
        packed = codecs.lzip(data)
        code = 1 << packed[5]
        assert lzma.decompress(b"\x5d" + code.to_bytes(4, "little") + b"\xff" * 8 + packed[6:-20], lzma.FORMAT_ALONE) == data
        assert lz4_decoded(codecs.lz4_frame(data)) == data
        assert lzw_decoded(codecs.unix_compress(data)) == data


def lz4_decoded(frame):
    at, out = 7, bytearray()
    while size := int.from_bytes(frame[at : at + 4], "little"):
        block, at = frame[at + 4 : at + 4 + (size & 0x7FFFFFFF)], at + 4 + (size & 0x7FFFFFFF)
        if size >> 31:
            out += block
            continue
        i, part = 0, bytearray()
        while i < len(block):
            token, i = block[i], i + 1

            def more(n, i):
                while n >= 15:
                    n, i, go = n + block[i], i + 1, block[i] == 255
                    if not go:
                        break
                return n, i

            n, i = more(token >> 4, i)
            part += block[i : i + n]
            i += n
            if i >= len(block):
                break
            offset, i = int.from_bytes(block[i : i + 2], "little"), i + 2
            n, i = more(token & 15, i)
            for _ in range(n + 4):
                part.append(part[-offset])
        out += part
    return bytes(out)


def lzw_decoded(data):
    table, width, bit, out, last, in_width = [bytes([i]) for i in range(256)] + [b""], 9, 24, bytearray(), None, 0
    while bit + width <= len(data) * 8:
        code = int.from_bytes(data[bit // 8 : bit // 8 + 4], "little") >> bit % 8 & ((1 << width) - 1)
        bit, in_width = bit + width, in_width + 1
        word = table[code] if code < len(table) else last + last[:1]
        out += word
        if last is not None and len(table) < 1 << 16:
            table.append(last + word[:1])
        last = word
        if len(table) + 1 > 1 << width and width < 16:
            bit += (-in_width % 8) * width
            width, in_width = width + 1, 0
    return bytes(out)


def test_crc32_combines():
    for a in PAYLOADS:
        for b in PAYLOADS:
            assert checksums.crc32_combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_merged_crc32_over_many_tasks(spark):
    rnd = random.Random(8)
    chunks = [(k, i, bytes(rnd.randrange(256) for _ in range(rnd.choice([0, 1, 7, 100])))) for k in ("a", "b", None) for i in range(70)]
    got = {r.k: (r.crc32, r.size) for r in checksums.merged_crc32(spark.createDataFrame(chunks, "k string, i int, d binary").repartition(5), ["k"], "i", "d").collect()}
    for k in ("a", "b", None):
        whole = b"".join(d for x, _, d in chunks if x == k)
        assert got[k] == (zlib.crc32(whole), len(whole))


def test_crc16_known_value():
    assert checksums.crc16_of(b"123456789") == 0xBB3D


@pytest.mark.parametrize("form", ["zip", "zip.stored", "zip.bzip2", "zip.lzma", "tar", "tar.gz", "tar.bz2", "tar.xz", "tar.zst"])
def test_archives_round_trip(spark, tmp_path, form):
    sinks.register(spark)
    entries = [(i, f"d/é{i:03d}.txt", f"text {i} ".encode() * i) for i in range(40)]
    df = spark.createDataFrame(entries, "ord long, path string, data binary").selectExpr("ord", "path", "data", "'file' kind", "420 mode", "1700000001L mtime", "cast(null as string) link")
    df.repartition(3).write.format("archive").mode("append").option("form", form).save(str(tmp_path))
    got = {}
    for name in os.listdir(tmp_path):
        path = tmp_path / name
        if form.startswith("zip"):
            with zipfile.ZipFile(path) as z:
                got |= {n: z.read(n) for n in z.namelist()}
        else:
            raw = path.read_bytes()
            if form == "tar.zst":
                raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
                (tmp_path / "x").write_bytes(raw)
                path = tmp_path / "x"
            with tarfile.open(path) as t:
                got |= {m.name: t.extractfile(m).read() for m in t}
    assert got == {p: d for _, p, d in entries}


def test_sink_leaves_nothing_on_failure_and_never_overwrites(spark, tmp_path):
    sinks.register(spark)
    df = spark.createDataFrame([(0, "../x", b"1")], "ord long, path string, data binary").selectExpr("*", "'file' kind", "420 mode", "0L mtime", "'' link")
    with pytest.raises(Exception, match="invalid path"):
        df.write.format("archive").mode("append").option("form", "tar").save(str(tmp_path))
    assert not [n for n in os.listdir(tmp_path) if n.endswith(".tar")]
    good = df.selectExpr("ord", "'x' path", "data", "kind", "mode", "mtime", "link")
    good.write.format("archive").mode("append").option("form", "tar").save(str(tmp_path))
    with pytest.raises(Exception, match="overwrite"):
        good.write.format("archive").mode("append").option("form", "tar").save(str(tmp_path))
    listed = spark.read.format("archive_listing").load(str(tmp_path)).collect()
    assert [(r.path, r.size, r.kind) for r in listed] == [("x", 1, "file")]


def test_editor(spark):
    entries = spark.createDataFrame([(i, f"a/{i}", "file", i * 10) for i in range(6)], "idx long, path string, kind string, size long")
    one = lambda i: spark.createDataFrame([(i,)], "idx long")
    named = lambda i, p: spark.createDataFrame([(i, p)], "idx long, path string")
    assert Editor(entries).unchanged()
    e = Editor(entries, "tar").rename(named(1, "b")).rename(named(1, "c")).remove(one(2)).remove(one(2)).add(spark.createDataFrame([("z", "file", 5)], "path string, kind string, size long"))
    e.check()
    assert [(r.idx, r.path) for r in e.final().orderBy("ord").collect()] == [(0, "a/0"), (1, "c"), (3, "a/3"), (4, "a/4"), (5, "a/5"), (None, "z")]
    assert [r.offset for r in e.layout().orderBy("ord").collect()] == [0, 512, 1536, 2560, 3584, 4608]
    for bad, why in ((Editor(entries).remove(one(3)).rename(named(3, "q")), "after removal"), (Editor(entries).remove(one(77)), "unknown"), (Editor(entries).rename(named(1, "a/../b")), "component"), (Editor(entries).rename(named(1, "a/0")), "twice"), (Editor(entries).rename(named(1, "a")), "above")):
        with pytest.raises(EditError, match=why):
            bad.check()


@pytest.mark.parametrize("rows", [7, 10**6])
def test_ranges_do_not_depend_on_cells(spark, monkeypatch, rows):
    """Sums, lags, islands and as-of lookups over several cells of one archive and over sparse order numbers."""
    monkeypatch.setattr(ranges, "CELL_ROWS", rows)
    rnd = random.Random(5)
    data = [(k, i * rnd.choice([1, 10**7]) + i, rnd.randrange(100)) for k in ("a", "b", None) for i in range(60)]
    data = [(k, o, n) for (k, o), n in {(k, o): n for k, o, n in data}.items()]
    df = spark.createDataFrame(data, "k string, o long, n long")
    by_key = {k: sorted((o, n) for x, o, n in data if x == k) for k in ("a", "b", None)}
    sums, lags = {}, {}
    for k, own in by_key.items():
        total, last = 0, None
        for o, n in own:
            sums[k, o], lags[k, o], total, last = total, last, total + n, n
    assert {(r.k, r.o): r.lo for r in ranges.prefix_sum_within(df, ["k"], ["o"], "n").collect()} == sums
    assert {(r.k, r.o): r.p for r in ranges.previous(df, ["k"], ["o"], "n", "p").collect()} == lags
    everything, total = {}, 0
    for o, n in sorted((o, n) for o, n in by_key["a"]):
        everything[o], total = total, total + n
    assert {r.o: r.lo for r in ranges.exclusive_prefix_sum(df.filter("k = 'a'"), "o", "n").collect()} == everything
    runs = ranges.islands(df, ["k"], ["o"], F.col("n") % 3 != 0).collect()
    for k, own in by_key.items():
        want, number = {}, 0
        for o, n in own:
            number += n % 3 == 0
            want[o] = number
        assert {r.o: r.island for r in runs if r.k == k} == want
    points = df.filter("n % 2 = 0").select("k", (F.col("o") + 1).alias("o")).distinct()
    found = ranges.at_or_before(points, df.filter("n % 5 <> 0 and k is not null"), ["k"], "o", "n").collect()
    assert found and all(r.found == next((n for o, n in reversed(by_key[r.k]) if o <= r.o and n % 5 and r.k), None) for r in found)


def test_rows_of_small_keys_are_evaluated_twice_at_most(spark, monkeypatch):
    """However many keys there are: once to count the rows of keys, once for the result."""
    monkeypatch.setattr(ranges, "CELL_ROWS", 100)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(3000).selectExpr("id div 3 as k", "id as o", "id * 10 as lo", "id * 10 + if(id % 3 = 0, 10, 9) as hi", "3000000000 as image_length")
    for f, n in ((lambda d: ranges.coalesced(d, ["k"], ["o"]), 2000), (lambda d: ranges.absorbed(d, ["k"], 320), 1)):
        seen.value = 0
        assert f(df.mapInArrow(counted, df.schema)).count() == n
        assert seen.value <= 2 * 3000


@pytest.mark.parametrize("name", ["splice_absorb", "chunk_reuse", "member_at_position", "record_action_case"])
def test_queries_do_not_depend_on_cells(spark, monkeypatch, name):
    """One bucket holds all keys, so the rows are parted into cells."""
    whole = sorted(map(tuple, catalog.QUERIES[name](spark, SF).collect()))
    monkeypatch.setattr(ranges, "CELL_ROWS", 2000)
    monkeypatch.setattr(ranges, "BUCKETS", 1)
    assert sorted(map(tuple, catalog.QUERIES[name](spark, SF).collect())) == whole


def test_overlapping(spark):
    records = spark.createDataFrame([("a", 0, 10), ("a", 10, 20), ("a", 20, 20), ("b", 0, 5)], "k string, lo long, hi long")
    written = spark.createDataFrame([("a", 9, 10), ("a", 15, 400), ("b", 5, 9)], "k string, w_lo long, w_hi long")
    assert sorted((r.k, r.lo) for r in ranges.overlapping(records, written, ["k"], 8).collect()) == [("a", 0), ("a", 10)]


def test_solid_blocks(spark):
    files = spark.createDataFrame([("a", i, s) for i, s in enumerate([5, 0, 6, 20, 1, 1, 1])], "k string, ord long, size long")
    got = {r.ord: r.block for r in editing.solid_blocks(files, ["k"], 10, 2).collect()}
    assert got == {0: 0, 1: None, 2: 1, 3: 2, 4: 3, 5: 3, 6: 4}


def test_byte_counts(spark):
    texts = ["aé", None, "", "\x00😀a"]
    want = {}
    for b in "".join(t or "" for t in texts).encode():
        want[b] = want.get(b, 0) + 1
    got = checksums.byte_counts(spark.createDataFrame([(t,) for t in texts], "text string"), "text").collect()
    assert {r.byte: r.n for r in got} == want and len(got) == len(want)


def test_text_byte_histogram_counts_every_byte_of_the_texts(spark):
    got = catalog.QUERIES["text_byte_histogram"](spark, SF).collect()
    size = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("sum(octet_length(text))").first()[0]
    assert sum(r.n for r in got) == size and max(r.byte for r in got) < 256


def test_payload_operators_take_whole_documents(spark):
    docs = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert max(map(len, docs.values())) > 10_000
    sizes = catalog.QUERIES["document_codec_sizes"](spark, SF).select("doc_id", "size", "stored", "zlib", "bzip2").collect()
    assert {r.doc_id: (r.size, r.stored, r.zlib, r.bzip2) for r in sizes} == {i: (len(d), len(d), len(zlib.compress(d, 6)), len(bz2.compress(d, 9))) for i, d in docs.items()}
    sums = catalog.QUERIES["document_checksums"](spark, SF).select("doc_id", "crc32", "byte_sum").collect()
    assert {r.doc_id: r.crc32 for r in sums} == {i: zlib.crc32(d) for i, d in docs.items()}


def by_greedy_steps(events, step):
    """(key, order, done) kept of each key's sorted events."""
    out = []
    for key in {e[0] for e in events}:
        own = sorted(e for e in events if e[0] == key)
        kept = [own[0]]
        for e in own[1:]:
            if e[2] - kept[-1][2] >= step:
                kept.append(e)
        out += kept + ([own[-1]] if kept[-1] != own[-1] else [])
    return sorted(out)


def test_progress_steps(spark):
    rnd = random.Random(4)
    events = []
    for key in range(20):
        done = 0
        for k in range(rnd.randrange(1, 60)):
            events.append((key, k, done))
            done += rnd.choice([1, 5, 30, 99, 100, 250])
    df = spark.createDataFrame(events, "k long, o int, d long")
    for size in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = progress.steps(df, "k", "o", "d", 100).collect()
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert sorted((r.k, r.o, r.d) for r in got) == by_greedy_steps(events, 100)
    assert all(r.step == r.d // 100 for r in got) and progress.steps(df.limit(0), "k", "o", "d").collect() == []
    turns = catalog.QUERIES["progress_steps"](spark, SF).collect()
    assert len({r.conv_id for r in turns}) == spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count()


def test_payloads_are_measured_one_by_one(spark):
    """Whatever the size of Arrow's batches, what leaves a task at once is a small part of one."""
    rows = spark.range(40).selectExpr("id as item_id", "if(id = 7, null, cast(repeat(cast(id as string), 200000) as binary)) as data").coalesce(1)
    own = codecs.measured(rows, "item_id", {"n": (pa.int32(), "int", len)})

    assert {r.item_id: r.n for r in own.collect()} == {i: None if i == 7 else 200_000 * len(str(i)) for i in range(40)}
    assert max(p.num_rows for b in [pa.record_batch({"i": list(range(40)), "d": [b"x" * 200_000] * 40})] for p in codecs.slices(b)) <= 6
    for q in ("document_codec_sizes", "filtered_document_sizes"):
        plan = catalog.QUERIES[q](spark, SF)._jdf.queryExecution().toString()
        assert "ArrowEvalPython" not in plan and "MapInArrow" in plan
