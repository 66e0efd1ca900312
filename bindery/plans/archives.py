"""Registered queries that make, edit and read archives of the driver's tables, and the sizes and names that plans need."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from bindery.functions import headers
from bindery.operators import editing, ranges
from bindery.plans import create, options, segments, updaters
from bindery.plans.catalog import ANCESTORS, EDITS, ENTRIES, FINAL, SITES, SPANS, STATE, entries, query, read, sites, spans, wide
from bindery.sources.sinks import register

DIGESTS = "SELECT e.path, 'file' AS kind, strlen(d.text)::BIGINT AS size, sha256(d.text) AS digest FROM {} e JOIN documents d ON d.doc_id = e.idx"
ADDED = "SELECT 'added/' || item_id || '.txt' AS path, 'file' AS kind, strlen(text)::BIGINT AS size, sha256(text) AS digest FROM benchmark"
#: Edits without those that fail: of entries that are there, and no rename after a removal.
GOOD = EDITS.replace("edits AS (", "edits AS (SELECT * FROM (", 1) + " WHERE seq % 4 < 3 AND idx IN (SELECT doc_id FROM documents))"
EDITED = f"WITH {ENTRIES}, {GOOD}, {STATE}, {FINAL} {DIGESTS.format('final')} UNION ALL {ADDED}"


def folder(spark) -> str:
    """A new folder in the shared one; archives are written at positions, so it must be mounted."""
    segments.checkpointed(spark.range(0))
    at = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    if "://" in at:
        raise ValueError(f"{at}: archives need a mounted file system")
    os.makedirs(path := os.path.join(at, f"archives-{uuid.uuid4().hex}"))
    return path


def contents(spark, sf):
    paths = entries(spark, sf).select("idx", "path", "mtime")
    texts = read(spark, sf, "documents").select(F.col("doc_id").alias("idx"), F.col("text").cast("binary").alias("data"))
    return paths.join(texts, "idx").select(F.col("idx").alias("ord"), "path", F.lit("file").alias("kind"), "data", (F.col("mtime") % 2**31).alias("mtime"))


def additions(spark, sf):
    return read(spark, sf, "benchmark").select(F.concat(F.lit("added/"), "item_id", F.lit(".txt")).alias("path"), F.lit("file").alias("kind"), F.col("text").cast("binary").alias("data"))


def digests(spark, path, password=None):
    reader = spark.read.option("password", password) if password else spark.read
    return reader.format("archive_entries").load(path).select("path", "kind", "size", F.sha2(F.coalesce("data", F.lit(b"")), 256).alias("digest"))


def made(spark, sf, form, chosen=None, rows=None):
    register(spark)
    path = os.path.join(folder(spark), f"a.{form}")
    create.create(contents(spark, sf) if rows is None else rows, path, form, chosen)
    return path


CREATED = f"WITH {ENTRIES} {DIGESTS.format('entries')}"


@query(CREATED)
def created_zip(spark, sf):
    return digests(spark, made(spark, sf, "zip"))


@query(CREATED)
def created_encrypted_zip(spark, sf):
    return digests(spark, made(spark, sf, "zip", options.Options(password="word", method="zstd")), "word")


@query(CREATED)
def created_tar(spark, sf):
    return digests(spark, made(spark, sf, "tar"))


@query(CREATED)
def created_tar_zst(spark, sf):
    return digests(spark, made(spark, sf, "tar.zst"))


@query(CREATED)
def created_7z(spark, sf):
    return digests(spark, made(spark, sf, "7z", options.Options(preset=1, block_bytes=1 << 20)))


@query(ADDED)
def created_lha(spark, sf):
    rows = additions(spark, sf).withColumn("ord", F.monotonically_increasing_id())
    return digests(spark, made(spark, sf, "lzh", rows=rows))


def edited(spark, sf, updater):
    """An editor with the edits of the tables: two renames of poor documents, removals of toxic ones, and additions."""
    known = read(spark, sf, "documents").select("doc_id").distinct()
    marks = read(spark, sf, "labels").join(known, "doc_id", "left_semi")
    poor, ident = marks.filter("quality = 0").select("doc_id").distinct(), F.col("doc_id")
    # an archive's members are numbered in its order, documents by their ids
    numbered = updater.entries.select("idx", F.regexp_extract("path", "([0-9]+)[.]txt$", 1).cast("long").alias("doc_id"))
    of = lambda df: df.join(numbered, "doc_id")
    updater.rename(of(poor).select("idx", F.concat(F.lit("first/"), ident).alias("path")))
    updater.rename(of(poor).select("idx", F.concat(F.lit("moved/"), ident % 97, F.lit("/"), ident).alias("path")))
    updater.remove(of(marks.filter("toxic = 1").select("doc_id").distinct()).select("idx"))
    return updater.add(additions(spark, sf))


@query(EDITED)
def updated_zip(spark, sf):
    path = made(spark, sf, "zip")
    edited(spark, sf, updaters.ZipUpdater(spark, path)).commit()
    return digests(spark, path)


@query(EDITED)
def updated_tar(spark, sf):
    path = made(spark, sf, "tar")
    edited(spark, sf, updaters.TarUpdater(spark, path)).commit()
    return digests(spark, path)


@query(EDITED)
def updated_7z(spark, sf):
    path = made(spark, sf, "7z", options.Options(preset=1, block_bytes=1 << 18))
    edited(spark, sf, updaters.SevenZipUpdater(spark, path)).commit()
    return digests(spark, path)


@query(EDITED)
def updated_lha(spark, sf):
    path = made(spark, sf, "lzh", options.Options(lha="lh0"))
    edited(spark, sf, updaters.LhaUpdater(spark, path, options=options.Options(lha="lh0"))).commit()
    return digests(spark, path)


@query(EDITED)
def updated_tar_bz2(spark, sf):
    path = made(spark, sf, "tar.bz2")
    edited(spark, sf, updaters.CompressedTarUpdater(spark, path)).commit()
    return digests(spark, path)


@query(EDITED)
def rewritten_zip(spark, sf):
    """A tar, edited and written as ZIP."""
    path = made(spark, sf, "tar")
    edited(spark, sf, updaters.Rewriter(spark, path)).commit("zip", path + ".zip")
    return digests(spark, path + ".zip")


@query(EDITED)
def rewritten_tar(spark, sf):
    """A ZIP, edited and written as a compressed tar."""
    path = made(spark, sf, "zip")
    edited(spark, sf, updaters.Rewriter(spark, path)).commit("tar.gz", path + ".tar.gz")
    return digests(spark, path + ".tar.gz")


@query(f"""WITH {ENTRIES}, o AS (SELECT idx, size + 30 + strlen(path) AS n, sum(size + 30 + strlen(path)) OVER (ORDER BY idx) AS hi FROM entries)
SELECT idx, (hi - n)::BIGINT AS lo, n::BIGINT AS n FROM o""")
def stored_zip_layout(spark, sf):
    """Where the records of a ZIP of stored entries lie, as read back from the directory."""
    path = made(spark, sf, "zip", options.Options(method="stored"), contents(spark, sf))
    return spark.read.format("archive_units").load(path).select(F.regexp_extract("path", "([0-9]+)[.]txt$", 1).cast("long").alias("idx"), "lo", (F.col("hi") - F.col("lo")).alias("n"))


# names and numbers of headers

LONG = f"{SITES}, p AS (SELECT idx, path || '/' || path || '/' || path || '/' || path AS path FROM sites)"


def long_paths(spark, sf):
    return sites(spark, sf).select("idx", F.concat_ws("/", *["path"] * 4).alias("path"))


@query(f"""WITH {LONG} SELECT idx, CASE WHEN length(path) <= 100 THEN 0 ELSE list_max(list_filter(range(2, least(length(path), 156) + 1), lambda i: path[i] = '/' AND i < length(path) AND length(path) - i <= 100)) END::INT AS cut FROM p""")
def ustar_split(spark, sf):
    return long_paths(spark, sf).select("idx", headers.ustar_cut(F.col("path")).cast("int").alias("cut"))


@query(f"""WITH {LONG}, b AS (SELECT idx, regexp_replace(path, '/+$', '') AS body FROM p), h AS (SELECT idx, regexp_extract(body, '^(.*/)?[^/]*$', 1) || 'PaxHeader/' AS head, regexp_extract(body, '([^/]*)$', 1) AS leaf FROM b)
SELECT idx, CASE WHEN length(head) < 100 THEN head || right(leaf, 100 - length(head)) ELSE 'PaxHeader' END AS name FROM h""")
def pax_header_names(spark, sf):
    return long_paths(spark, sf).select("idx", headers.pax_header_name(F.col("path")).alias("name"))


NUMBERS = f"{ENTRIES}, v AS (SELECT idx, CASE idx % 7 WHEN 0 THEN -size * idx WHEN 1 THEN size * idx * 100000 ELSE size END AS v FROM entries)"


@query(f"""WITH {NUMBERS} SELECT idx, CASE WHEN v >= 0 AND v < 8589934592 THEN hex(lpad(format('{{:o}}', v), 11, '0')) || '00'
ELSE CASE WHEN v < 0 THEN 'FF' ELSE '80' END || lpad(hex(v), 22, CASE WHEN v < 0 THEN 'F' ELSE '0' END) END AS field FROM v""")
def tar_numbers(spark, sf):
    size, idx = F.col("size"), F.col("idx")
    v = F.when(idx % 7 == 0, -size * idx).when(idx % 7 == 1, size * idx * 100000).otherwise(size)
    return entries(spark, sf).select("idx", headers.tar_number(v, 12).alias("field"))


MAGICS = (
    "CASE doc_id % 6 WHEN 0 THEN '7F454C4602010100' || repeat('00', 8) || '0200B700' || repeat('00', 60) WHEN 1 THEN 'CFFAEDFE0C000001' || repeat('00', 60) "
    "WHEN 2 THEN 'FEEDFACF01000007' || repeat('00', 60) WHEN 3 THEN '4D5A' || repeat('00', 58) || '40000000504500006486' || '0000' WHEN 4 THEN '7F45' ELSE '504B0304' || repeat('00', 40) END"
)


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'arm64' WHEN 1 THEN 'arm64' WHEN 2 THEN 'x86' WHEN 3 THEN 'x86' ELSE 'none' END AS filter FROM documents")
def executable_filters(spark, sf):
    return read(spark, sf, "documents").select("doc_id", headers.executable_filter(F.unhex(F.expr(MAGICS))).alias("filter"))


# sizes


@query(f"""WITH {ENTRIES}, m AS (SELECT idx, size * (idx % 5) AS size, CASE idx % 6 WHEN 0 THEN 'stored' WHEN 1 THEN 'deflate' WHEN 2 THEN 'bzip2' WHEN 3 THEN 'lzma' WHEN 4 THEN 'zstd' ELSE 'xz' END AS method FROM entries)
SELECT idx, CASE method WHEN 'stored' THEN size WHEN 'bzip2' THEN size + size // 100 + 600 WHEN 'lzma' THEN size * 16 + 1024 WHEN 'zstd' THEN size + (size // 131072 + 1) * 3 + 18
WHEN 'xz' THEN size * 2 + (size + 16777215) // 16777216 * 66560 + 1024 ELSE size + 5 * (size // 16000 + 1) + 64 * ((size + 1048575) // 1048576) + 64 END::BIGINT AS bound FROM m""")
def size_bounds(spark, sf):
    idx = F.col("idx")
    method = F.when(idx % 6 == 0, "stored").when(idx % 6 == 1, "deflate").when(idx % 6 == 2, "bzip2").when(idx % 6 == 3, "lzma").when(idx % 6 == 4, "zstd").otherwise("xz")
    return entries(spark, sf).select("idx", options.size_bound(method, F.col("size") * (idx % 5)).alias("bound"))


@query(f"""WITH {ENTRIES}, m AS (SELECT idx, size * (idx % 9) * 10000 AS size FROM entries)
SELECT idx, CASE WHEN size <= 0 THEN 16777216 ELSE greatest(2097152, least(16777216, ((size - 1) // 16777216 + 1) * 1048576)) END::BIGINT AS piece FROM m""")
def piece_sizes(spark, sf):
    return entries(spark, sf).select("idx", options.piece_size(F.col("size") * (F.col("idx") % 9) * 10_000, 16 << 20).alias("piece"))


@query(f"""WITH {SITES} SELECT idx, kind = 'file' AND size > 0 AND lower(regexp_extract(path, '[^/]\\.([^./]+)$', 1)) IN ('zip', 'gz', 'jpg', 'png', 'pdf') AND idx % 2 = 0 AS copied FROM sites""")
def copied_entries(spark, sf):
    """Files a 7z writer stores as they are: of stored extensions, where the heuristic is on."""
    from bindery.functions import fields

    stored = fields.extension(F.col("path")).isin("zip", "gz", "jpg", "png", "pdf")
    return sites(spark, sf).select("idx", fields.seven_zip_copies(stored, F.col("kind"), F.col("size"), F.col("idx") % 2 == 0).alias("copied"))


@query(f"""WITH {ENTRIES}, s AS (SELECT CASE idx % 3 WHEN 0 THEN 'source' WHEN 1 THEN 'literal' ELSE 'scratch' END AS kind, size AS length FROM entries)
SELECT sum(length * CASE kind WHEN 'source' THEN 3 WHEN 'scratch' THEN 2 ELSE 1 END)::BIGINT AS units, sum(length)::BIGINT AS bytes FROM s""")
def commit_work(spark, sf):
    idx = F.col("idx")
    kind = F.when(idx % 3 == 0, "source").when(idx % 3 == 1, "literal").otherwise("scratch")
    return editing.work_units(entries(spark, sf).select(kind.alias("kind"), F.col("size").alias("length")))


@query("""WITH f AS (SELECT conv_id AS folder, sum(strlen(text))::BIGINT AS size, CASE conv_id % 4 WHEN 0 THEN 'carry' WHEN 1 THEN 'reencode' WHEN 2 THEN 'convert' ELSE 'added' END AS work FROM conversations GROUP BY conv_id)
SELECT (sum(CASE work WHEN 'carry' THEN 0 WHEN 'convert' THEN size // 3 ELSE size END) + 100)::BIGINT AS units FROM f""")
def verification_work(spark, sf):
    folders = read(spark, sf, "conversations").groupBy(F.col("conv_id").alias("folder")).agg(F.sum(F.octet_length("text").cast("long")).alias("size"))
    k = F.col("folder") % 4
    work = F.when(k == 0, "carry").when(k == 1, "reencode").when(k == 2, "convert").otherwise("added")
    return editing.verification_units(folders.withColumn("work", work).withColumn("packed", F.floor(F.col("size") / 3)), 100)


# lookups


@query(f"""WITH {ENTRIES}, m AS (SELECT idx, path, size FROM entries WHERE idx % 17 <> 3), r AS (SELECT idx, CASE WHEN idx % 29 = 5 THEN path || 'x' ELSE path END AS path, CASE WHEN idx % 31 = 7 THEN size + 1 ELSE size END AS size FROM entries WHERE idx % 19 <> 4)
SELECT idx, fault FROM (SELECT coalesce(m.idx, r.idx) AS idx, CASE WHEN m.idx IS NULL THEN 'not in the model' WHEN r.idx IS NULL THEN 'not read' WHEN m.path IS DISTINCT FROM r.path THEN 'name' WHEN m.size IS DISTINCT FROM r.size THEN 'size' END AS fault FROM m FULL JOIN r ON m.idx = r.idx) WHERE fault IS NOT NULL""")
def model_positions(spark, sf):
    rows, idx = entries(spark, sf).select("idx", "path", "size"), F.col("idx")
    reader = rows.filter(idx % 19 != 4).withColumn("path", F.when(idx % 29 == 5, F.concat("path", F.lit("x"))).otherwise(F.col("path"))).withColumn("size", F.when(idx % 31 == 7, F.col("size") + 1).otherwise(F.col("size")))
    return editing.position_faults(rows.filter(idx % 17 != 3), reader)


@query(f"""WITH {SPANS}, w AS (SELECT archive, lo + 100 AS w_lo, hi + 100 AS w_hi FROM spans WHERE part % 9 = 0)
SELECT DISTINCT s.archive, s.ord, s.lo, s.hi FROM spans s JOIN w USING (archive) WHERE s.lo < w_hi AND w_lo < s.hi AND s.hi > s.lo""")
def written_overlaps(spark, sf):
    rows = spans(spark, sf, wide(spark, sf))
    written = rows.filter("part % 9 = 0").select("archive", (F.col("lo") + 100).alias("w_lo"), (F.col("hi") + 100).alias("w_hi"))
    return ranges.overlapping(rows.select("archive", "ord", "lo", "hi"), written, ["archive"], 1 << 16)


@query(f"""WITH {SITES}, {ANCESTORS}, old AS (SELECT regexp_replace(path, '/$', '') AS path FROM sites),
c AS (SELECT idx AS candidate, regexp_replace(CASE idx % 3 WHEN 0 THEN path WHEN 1 THEN path || '/leaf' ELSE regexp_replace(path, '/[^/]*$', '') END, '/$', '') AS path FROM sites),
ca AS (SELECT candidate, array_to_string(p[1:n], '/') AS ancestor FROM (SELECT *, unnest(range(1, len(p))) AS n FROM (SELECT *, string_split(path, '/') AS p FROM c))),
x AS (SELECT candidate, path, path IN (SELECT path FROM old) AS exact, candidate IN (SELECT candidate FROM ca WHERE ancestor IN (SELECT path FROM old)) AS below_file, path IN (SELECT ancestor FROM anc) AS over_entries FROM c)
SELECT * FROM x WHERE exact OR below_file OR over_entries""")
def live_names(spark, sf):
    rows, k = sites(spark, sf), F.col("idx") % 3
    new = F.when(k == 0, F.col("path")).when(k == 1, F.concat("path", F.lit("/leaf"))).otherwise(F.regexp_replace("path", "/[^/]*$", ""))
    return editing.name_conflicts(rows.select(F.col("idx").alias("candidate"), new.alias("path")), rows)


@query(f"""WITH RECURSIVE {ENTRIES}, f AS (SELECT idx, size, 512 + size AS n, row_number() OVER (ORDER BY idx) AS k FROM entries),
c AS (SELECT idx, k, 0::BIGINT AS first, CASE WHEN n <= 4096 THEN 1 ELSE 1 + (size + 8191) // 8192 END AS parts, CASE WHEN n <= 4096 THEN n ELSE 0 END AS held, CASE WHEN n <= 4096 THEN 0 ELSE (size + 8191) // 8192 END AS last FROM f WHERE k = 1 UNION ALL
SELECT f.idx, f.k, CASE WHEN f.n <= 4096 AND held > 0 AND held + f.n <= 4096 THEN last ELSE last + 1 END, CASE WHEN f.n <= 4096 THEN 1 ELSE 1 + (f.size + 8191) // 8192 END,
CASE WHEN f.n > 4096 THEN 0 WHEN held > 0 AND held + f.n <= 4096 THEN held + f.n ELSE f.n END, CASE WHEN f.n <= 4096 THEN CASE WHEN held > 0 AND held + f.n <= 4096 THEN last ELSE last + 1 END ELSE last + 1 + (f.size + 8191) // 8192 END
FROM c JOIN f ON f.k = c.k + 1) SELECT idx AS ord, first AS first_chunk, parts::BIGINT AS parts FROM c""")
def tar_chunks(spark, sf):
    """Where a tar of unpadded members is cut: the first chunk of each, and how many it lies in."""
    members = entries(spark, sf).select(F.col("idx").alias("ord"), F.lit(512).cast("long").alias("header"), F.col("size").alias("body"))
    return create.chunks_of(members, 4096, 8192).groupBy("ord").agg(F.min("chunk").alias("first_chunk"), F.count("*").alias("parts"))
