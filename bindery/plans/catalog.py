"""Registered queries: the driver's tables as archive listings, edits and byte ranges, with their SQL."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bindery.functions import checksums, codecs, crypto, fields
from bindery.functions import records as headers
from bindery.operators import editing, ranges
from bindery.plans import segments
from bindery.shipping import ship
from bindery.streaming import progress

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ENTRIES = """entries AS (SELECT doc_id AS idx, lang || '/' || source || '/' || lpad(doc_id::VARCHAR, 8, '0') || '.txt' AS path,
  'file' AS kind, strlen(text)::BIGINT AS size, 1700000001 + doc_id * 86399 AS mtime FROM documents)"""
REMOVED = "removed AS (SELECT DISTINCT doc_id AS idx FROM labels WHERE toxic = 1)"
EDITS = """edits AS (SELECT * FROM (
  SELECT doc_id * 4 AS seq, 'rename' AS op, doc_id AS idx, 'first/' || doc_id AS path FROM labels WHERE quality = 0 UNION ALL
  SELECT doc_id * 4 + 1, 'rename', doc_id, 'moved/' || (doc_id % 97) || '/' || doc_id FROM labels WHERE quality = 0 UNION ALL
  SELECT doc_id * 4 + 2, 'remove', doc_id, NULL FROM labels WHERE toxic = 1 UNION ALL
  SELECT doc_id * 4 + 3, 'rename', doc_id, 'late/' || doc_id FROM labels WHERE toxic = 1 AND doc_id % 7 = 0))"""
STATE = """state AS (SELECT idx, bool_or(op = 'remove') AS removed, max_by(path, seq) FILTER (WHERE op = 'rename') AS p FROM edits GROUP BY idx)"""
FINAL = """final AS (SELECT e.idx, CASE WHEN s.p IS NULL THEN e.path ELSE s.p END AS path, e.kind, e.size
  FROM entries e LEFT JOIN state s USING (idx) WHERE NOT coalesce(s.removed, false))"""
#: Lines of an order are the members of an archive; lines of one number are one member.
MEMBERS = """members AS (SELECT l_orderkey AS archive, l_linenumber AS ord, sum((l_quantity * 1000)::BIGINT + l_partkey % 997)::BIGINT AS size, min(l_partkey) AS part, min(l_suppkey) AS supp FROM lineitem GROUP BY ALL)"""
SITES = """sites AS (SELECT page_id AS idx, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path, 'file' AS kind, strlen(html)::BIGINT AS size FROM pages)"""


def query(sql: str | None = None):
    def add(f):
        @functools.wraps(f)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ship(spark)
            return f(spark, sf)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def entries(spark, sf):
    path = F.concat_ws("/", "lang", "source", F.concat(F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".txt")))
    return read(spark, sf, "documents").select(F.col("doc_id").alias("idx"), path.alias("path"), F.lit("file").alias("kind"), F.octet_length("text").cast("long").alias("size"), (F.lit(1_700_000_001) + F.col("doc_id") * 86399).alias("mtime"))


def removed(spark, sf):
    return read(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("idx")).distinct()


def edits(spark, sf):
    """All from one pass over labels."""
    ident = F.col("doc_id")
    row = lambda n, op, path: F.struct((ident * 4 + n).alias("seq"), F.lit(op).alias("op"), ident.alias("idx"), path.cast("string").alias("path"))
    poor, toxic = F.col("quality") == 0, F.col("toxic") == 1
    wanted = F.array(
        F.when(poor, row(0, "rename", F.concat(F.lit("first/"), ident))), F.when(poor, row(1, "rename", F.concat(F.lit("moved/"), ident % 97, F.lit("/"), ident))),
        F.when(toxic, row(2, "remove", F.lit(None))), F.when(toxic & (ident % 7 == 0), row(3, "rename", F.concat(F.lit("late/"), ident))),
    )
    return read(spark, sf, "labels").select(F.explode(F.filter(wanted, lambda e: e.isNotNull())).alias("e")).select("e.*")


def wide(spark, sf) -> bool:
    """Whether an archive may have more members than a cell, which the keys alone tell; none has more members than lines."""
    return ranges.wide_key(read(spark, sf, "lineitem"), ["l_orderkey"])


def members(spark, sf, wide=True):
    """Of archives that fit a cell all lines are brought together at first, so that what follows by archive is not dealt out again."""
    size = (F.col("l_quantity") * 1000).cast("long") + F.col("l_partkey") % 997
    rows = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("archive"), F.col("l_linenumber").alias("ord"), size.alias("size"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"))
    return (rows if wide else rows.repartition("archive")).groupBy("archive", "ord").agg(F.sum("size").alias("size"), F.min("part").alias("part"), F.min("supp").alias("supp"))


def sites(spark, sf):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return read(spark, sf, "pages").select(F.col("page_id").alias("idx"), path.alias("path"), F.lit("file").alias("kind"), F.octet_length("html").cast("long").alias("size"))


@query(f"WITH {ENTRIES} SELECT * FROM entries")
def entry_listing(spark, sf):
    return entries(spark, sf)


@query(f"WITH {ENTRIES} SELECT path FROM entries ORDER BY path")
def name_order(spark, sf):
    return entries(spark, sf).select("path").orderBy("path")


@query(f"WITH {ENTRIES}, {REMOVED} SELECT idx, path, size FROM entries WHERE idx NOT IN (SELECT idx FROM removed)")
def removed_anti_join(spark, sf):
    return editing.without(entries(spark, sf).select("idx", "path", "size"), removed(spark, sf))


@query(f"WITH {EDITS}, {STATE} SELECT idx, removed, CASE WHEN NOT removed THEN p END AS new_path FROM state")
def edit_fold(spark, sf):
    return editing.folded(edits(spark, sf))


@query(f"""WITH {ENTRIES}, {EDITS}, gone AS (SELECT idx, min(seq) AS g FROM edits WHERE op = 'remove' GROUP BY idx)
SELECT seq, idx, reason FROM (SELECT e.seq, e.idx, CASE WHEN n.idx IS NULL THEN 'unknown' WHEN e.op = 'rename' AND e.seq > g.g THEN 'renamed after removal' END AS reason
FROM edits e LEFT JOIN gone g USING (idx) LEFT JOIN (SELECT idx FROM entries) n ON n.idx = e.idx) WHERE reason IS NOT NULL""")
def edit_violations(spark, sf):
    return editing.edit_violations(edits(spark, sf), entries(spark, sf))


@query(f"WITH {ENTRIES}, {EDITS}, {STATE}, {FINAL} SELECT idx, path, kind, size FROM final")
def survivors_renamed(spark, sf):
    return editing.survivors(entries(spark, sf).drop("mtime"), editing.folded(edits(spark, sf)))


@query(f"""WITH {ENTRIES}, {EDITS}, {STATE}, {FINAL} SELECT idx AS ord, path, size FROM final
UNION ALL SELECT 1000000000 + item_id, 'added/' || item_id || '.txt', strlen(text)::BIGINT FROM benchmark""")
def survivors_and_additions(spark, sf):
    kept = editing.survivors(entries(spark, sf).drop("mtime"), editing.folded(edits(spark, sf))).select(F.col("idx").alias("ord"), "path", "size")
    new = read(spark, sf, "benchmark").select((F.lit(1_000_000_000) + F.col("item_id")).alias("ord"), F.concat(F.lit("added/"), "item_id", F.lit(".txt")).alias("path"), F.octet_length("text").cast("long").alias("size"))
    return kept.unionByName(new)


@query(f"""WITH {SITES}, s AS (SELECT *, string_split(path, '/') AS p FROM sites)
SELECT idx, path, CASE WHEN length(path) = 0 THEN 'empty' WHEN contains(path, '\\') OR contains(path, ':') THEN 'forbidden'
WHEN len(list_filter(p, lambda x: x IN ('', '.', '..'))) > 0 THEN 'component' WHEN strlen(path) > 65535 THEN 'long' END AS rule FROM s""")
def path_validation(spark, sf):
    return sites(spark, sf).select("idx", "path", fields.path_violation(F.col("path"), F.lit(False), False).alias("rule"))


@query(f"""WITH {SITES}, x AS (SELECT *, lower(regexp_extract(path, '[^/]\\.([^./]+)$', 1)) AS ext FROM sites)
SELECT idx, ext, ext IN ({", ".join(f"'{e}'" for e in fields.STORED_EXTENSIONS)}) AS stored FROM x""")
def extension_store(spark, sf):
    return sites(spark, sf).select("idx", fields.extension(F.col("path")).alias("ext"), fields.is_stored_extension(F.col("path")).alias("stored"))


@query(f"""WITH {SITES}, m AS (SELECT idx, size, CASE WHEN size = 0 OR lower(regexp_extract(path, '[^/]\\.([^./]+)$', 1)) IN ({", ".join(f"'{e}'" for e in fields.STORED_EXTENSIONS)}) THEN 'stored' WHEN idx % 3 = 0 THEN 'deflate' WHEN idx % 3 = 1 THEN 'zstd' ELSE 'bzip2' END AS method, idx % 5 = 0 AS enc FROM sites),
a AS (SELECT *, CASE WHEN enc THEN CASE WHEN size < 20 THEN 1 ELSE 2 END END AS aes FROM m)
SELECT idx, method, aes, greatest(CASE WHEN method IN ('lzma', 'zstd', 'ppmd') THEN 63 WHEN method = 'bzip2' THEN 46 ELSE 20 END, CASE WHEN aes IS NOT NULL THEN 51 ELSE 20 END, CASE WHEN size >= 4294967295 OR idx * 100000000 >= 4294967295 THEN 45 ELSE 20 END) AS version FROM a""")
def zip_method_version(spark, sf):
    rows = sites(spark, sf)
    chosen = F.when(F.col("idx") % 3 == 0, "deflate").when(F.col("idx") % 3 == 1, "zstd").otherwise("bzip2")
    rows = rows.select("idx", "size", F.when(fields.zip_method(F.col("path"), F.col("kind"), F.col("size"), "x") == "stored", "stored").otherwise(chosen).alias("method"))
    rows = rows.withColumn("aes", fields.aes_version(F.col("idx") % 5 == 0, F.col("size")))
    return rows.select("idx", "method", "aes", fields.extraction_version(F.col("method"), F.col("aes"), F.col("size"), F.col("size"), F.col("idx") * 100_000_000).alias("version"))


@query(f"WITH {ENTRIES} SELECT idx, size, coalesce(sum(size) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lo FROM entries")
def offset_prefix_sum(spark, sf):
    return ranges.exclusive_prefix_sum(entries(spark, sf).select("idx", "size"), "idx", "size")


@query(f"WITH {MEMBERS}, t AS (SELECT *, 512 + size + (512 - size % 512) % 512 AS span FROM members) SELECT archive, ord, span, coalesce(sum(span) OVER (PARTITION BY archive ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lo FROM t")
def tar_padded_offsets(spark, sf):
    rows = members(spark, sf, many := wide(spark, sf)).select("archive", "ord", fields.tar_span(F.col("size")).alias("span"))
    return ranges.prefix_sum_within(rows, ["archive"], ["ord"], "span", wide=many)


@query(f"WITH {ENTRIES} SELECT count(*) AS n, sum(size)::BIGINT AS bytes, sum(512 + size + (512 - size % 512) % 512)::BIGINT AS tar_bytes, sum(CASE idx % 3 WHEN 0 THEN size WHEN 1 THEN 2 * size ELSE 3 * size END)::BIGINT AS work FROM entries")
def plan_total_bytes(spark, sf):
    size = F.col("size")
    weight = F.when(F.col("idx") % 3 == 0, size).when(F.col("idx") % 3 == 1, 2 * size).otherwise(3 * size)
    return entries(spark, sf).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.sum(fields.tar_span(size)).alias("tar_bytes"), F.sum(weight).alias("work"))


@query("SELECT conv_id AS folder, count(*) AS streams, sum(strlen(text))::BIGINT AS unpacked, max(turn) AS last FROM conversations GROUP BY conv_id")
def folder_sizes(spark, sf):
    return read(spark, sf, "conversations").groupBy(F.col("conv_id").alias("folder")).agg(F.count("*").alias("streams"), F.sum(F.octet_length("text").cast("long")).alias("unpacked"), F.max("turn").alias("last"))


@query("""WITH f AS (SELECT conv_id AS folder, conv_id * 1000 + turn AS idx FROM conversations), r AS (SELECT DISTINCT idx FROM f WHERE idx % 7 = 0 OR folder % 11 = 0),
c AS (SELECT folder, count(*) AS files, count(r.idx) AS gone FROM f LEFT JOIN r USING (idx) GROUP BY folder)
SELECT *, CASE WHEN gone = files THEN 'drop' WHEN gone > 0 THEN 'reencode' ELSE 'carry' END AS work FROM c""")
def folder_work_kind(spark, sf):
    files = read(spark, sf, "conversations").select(F.col("conv_id").alias("folder"), (F.col("conv_id") * 1000 + F.col("turn")).alias("idx"))
    return editing.folder_work(files, files.filter("idx % 7 = 0 or folder % 11 = 0"))


@query(f"WITH {SITES} SELECT path, count(*) AS n, min(idx) AS first_idx FROM sites GROUP BY path HAVING count(*) > 1")
def duplicate_names(spark, sf):
    return editing.duplicate_names(sites(spark, sf))


ANCESTORS = """anc AS (SELECT idx, size, kind, path, array_to_string(p[1:n], '/') AS ancestor FROM (SELECT *, unnest(range(1, len(p))) AS n FROM (SELECT *, string_split(regexp_replace(path, '/$', ''), '/') AS p FROM sites)))"""


@query(f"WITH {SITES}, {ANCESTORS}, a AS (SELECT ancestor, count(*) AS below FROM anc GROUP BY ancestor) SELECT idx, path, below FROM sites JOIN a ON path = ancestor")
def ancestor_file_collision(spark, sf):
    return editing.files_above_entries(sites(spark, sf))


@query(f"WITH {SITES}, {ANCESTORS} SELECT DISTINCT s.idx, s.path FROM (SELECT idx, regexp_replace(path, '/[^/]*$', '') AS path FROM sites) s WHERE s.path IN (SELECT ancestor FROM anc)")
def subtree_collision(spark, sf):
    rows = sites(spark, sf)
    new = rows.select("idx", F.regexp_replace("path", "/[^/]*$", "").alias("path"), "kind")
    return editing.files_over_subtrees(new, rows).select("idx", "path").distinct()


@query(f"WITH {SITES}, {ANCESTORS} SELECT ancestor, count(*) AS entries, count(*) AS files, sum(size)::BIGINT AS bytes FROM anc GROUP BY ancestor")
def subtree_counts(spark, sf):
    return editing.subtree_counts(sites(spark, sf))


LINKS = "links AS (SELECT doc_id AS idx, doc_id // 2 AS target FROM documents WHERE doc_id > 0 AND doc_id % 3 <> 0)"


def links(spark, sf):
    return read(spark, sf, "documents").filter("doc_id > 0 and doc_id % 3 <> 0").select(F.col("doc_id").alias("idx"), F.floor(F.col("doc_id") / 2).alias("target"))


CHASE = f"""WITH RECURSIVE {LINKS}, chase AS (SELECT idx, target, target AS data_target FROM links UNION ALL
SELECT c.idx, c.target, l.target FROM chase c JOIN links l ON c.data_target = l.idx), t AS (SELECT idx, target, min(data_target) AS data_target FROM chase GROUP BY ALL)"""


def targets(spark, sf):
    return editing.link_targets(links(spark, sf), segments.checkpointed)


@query(f"{CHASE} SELECT * FROM t")
def hardlink_targets(spark, sf):
    return targets(spark, sf)


@query(f"{CHASE}, {REMOVED} SELECT data_target, min(idx) AS holder, count(*) AS links FROM t WHERE idx NOT IN (SELECT idx FROM removed) AND data_target IN (SELECT idx FROM removed) GROUP BY data_target")
def link_holder_min(spark, sf):
    return editing.new_holders(targets(spark, sf), removed(spark, sf))


@query("""WITH e AS (SELECT l_orderkey * 8 + l_linenumber AS idx, l_suppkey AS dev, l_partkey AS ino FROM lineitem)
SELECT idx, dev, ino, min(idx) OVER (PARTITION BY dev, ino) AS first_idx, idx <> min(idx) OVER (PARTITION BY dev, ino) AS is_link FROM e""")
def inode_first(spark, sf):
    return editing.first_of_inode(read(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("idx"), F.col("l_suppkey").alias("dev"), F.col("l_partkey").alias("ino")))


SPANS = f"""{MEMBERS}, spans AS (SELECT archive, ord, lo, lo + size AS hi, part FROM (SELECT *, coalesce(sum(size) OVER (PARTITION BY archive ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lo FROM members))"""


def spans(spark, sf, many: bool):
    rows = ranges.prefix_sum_within(members(spark, sf, many), ["archive"], ["ord"], "size", wide=many).select("archive", "ord", "lo", (F.col("lo") + F.col("size")).alias("hi"), "part")
    return segments.checkpointed(rows) if many else rows


ISLANDS = """k AS (SELECT * FROM spans WHERE part % 4 <> 0), g AS (SELECT *, CASE WHEN lag(hi) OVER w = lo THEN 0 ELSE 1 END AS s FROM k WINDOW w AS (PARTITION BY archive ORDER BY ord)),
r AS (SELECT *, sum(s) OVER (PARTITION BY archive ORDER BY ord)::BIGINT AS island FROM g)"""


@query(f"WITH {SPANS}, {ISLANDS} SELECT archive, island, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM r GROUP BY archive, island")
def range_coalesce(spark, sf):
    return ranges.coalesced(spans(spark, sf, many := wide(spark, sf)).filter("part % 4 <> 0"), ["archive"], ["ord"], wide=many)


@query(f"WITH {SPANS}, k AS (SELECT archive, ord, lo, hi, lag(hi) OVER (PARTITION BY archive ORDER BY ord) AS prev_hi FROM spans WHERE part % 4 <> 0) SELECT * FROM k WHERE prev_hi <> lo")
def pack_contiguity(spark, sf):
    return ranges.gaps(spans(spark, sf, many := wide(spark, sf)).filter("part % 4 <> 0").select("archive", "ord", "lo", "hi"), ["archive"], "ord", many)


@query(f"""WITH {SPANS}, {ISLANDS}, old AS (SELECT archive, min(lo) AS s_lo, max(hi) AS s_hi FROM r GROUP BY archive, island),
c AS (SELECT archive, ord, lo + 16 AS c_lo, hi - 8 AS c_hi FROM spans)
SELECT c.archive, ord, c_lo, c_hi, s_lo, s_hi FROM c JOIN old USING (archive) WHERE c_lo - least(32768, c_lo) >= s_lo AND c_hi <= s_hi AND c_hi > c_lo""")
def chunk_reuse(spark, sf):
    rows = spans(spark, sf, many := wide(spark, sf))
    old = ranges.coalesced(rows.filter("part % 4 <> 0"), ["archive"], ["ord"], wide=many).select("archive", F.col("lo").alias("s_lo"), F.col("hi").alias("s_hi"))
    chunks = rows.select("archive", "ord", (F.col("lo") + 16).alias("c_lo"), (F.col("hi") - 8).alias("c_hi"))
    return ranges.contained(chunks, old, ["archive"], 32768, 1 << 16)


@query(f"""WITH {SPANS}, {ISLANDS}, e AS (SELECT archive, max(hi) AS image_length FROM spans GROUP BY archive),
w AS (SELECT r.archive, lo, hi, image_length, island, (hi - lo) * 16 < 400000 AS small, min(lo) OVER i > 0 AS l, max(hi) OVER i < image_length AS rr, lo = min(lo) OVER i AS f, hi = max(hi) OVER i AS la FROM r JOIN e USING (archive) WINDOW i AS (PARTITION BY r.archive, island)),
x AS (SELECT *, bool_and(small) OVER (PARTITION BY archive, island) AS alls FROM w)
SELECT archive, lo, hi, image_length FROM x WHERE NOT (small AND ((l AND rr AND alls) OR (l AND f) OR (rr AND la)))""")
def splice_absorb(spark, sf):
    rows = spans(spark, sf, many := wide(spark, sf))
    if many:
        rows = rows.join(rows.groupBy("archive").agg(F.max("hi").alias("image_length")), "archive")
    else:
        rows = rows.withColumn("image_length", F.max("hi").over(Window.partitionBy("archive")))
    return ranges.absorbed(rows.filter("part % 4 <> 0").select("archive", "lo", "hi", "image_length"), ["archive"], 400_000, many)


@query(f"""WITH {SPANS}, m AS (SELECT archive, ord AS at_ord, (lo + hi) // 2 AS at FROM spans WHERE part % 5 = 0) SELECT DISTINCT m.archive, m.at, s.ord AS found FROM m JOIN spans s ON s.archive = m.archive AND m.at >= s.lo AND m.at < s.hi""")
def member_at_position(spark, sf):
    rows = spans(spark, sf, many := wide(spark, sf))
    points = rows.filter("part % 5 = 0").select("archive", F.floor((F.col("lo") + F.col("hi")) / 2).alias("at"))
    return ranges.at_or_before(points, rows.select("archive", F.col("lo").alias("at"), "ord"), ["archive"], "at", "ord", many).distinct()


RECORDS = f"""{SPANS}, n AS (SELECT archive, ord, lo AS old_lo, hi - lo AS len, part, 30 + part % 40 AS header_length, CASE WHEN part % 3 = 0 THEN 30 + (part + archive) % 40 END AS new_header_length FROM spans WHERE part % 11 <> 0),
a AS (SELECT *, coalesce(sum(len + coalesce(new_header_length - header_length, 0)) OVER (PARTITION BY archive ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS new_lo FROM n),
act AS (SELECT archive, ord, old_lo, new_lo, CASE WHEN new_header_length IS NULL THEN CASE WHEN old_lo = new_lo THEN 'keep' ELSE 'copy' END WHEN new_header_length = header_length AND old_lo = new_lo THEN 'patchHeader' ELSE 'headerThenCopy' END AS action FROM a)"""


def records(spark, sf):
    n = spans(spark, sf, many := wide(spark, sf)).filter("part % 11 <> 0").select("archive", "ord", F.col("lo").alias("old_lo"), (F.col("hi") - F.col("lo")).alias("len"), (30 + F.col("part") % 40).alias("header_length"), F.when(F.col("part") % 3 == 0, 30 + (F.col("part") + F.col("archive")) % 40).alias("new_header_length"))
    n = n.withColumn("new_len", F.col("len") + F.coalesce(F.col("new_header_length") - F.col("header_length"), F.lit(0)))
    rows = ranges.prefix_sum_within(n, ["archive"], ["ord"], "new_len", "new_lo", many).withColumn("dirty", F.lit(False))
    return editing.record_actions(rows).select("archive", "ord", "old_lo", "new_lo", "action")


@query(f"WITH {RECORDS} SELECT * FROM act")
def record_action_case(spark, sf):
    return records(spark, sf)


@query(f"WITH {RECORDS} SELECT archive, count(*) AS n, CASE WHEN bool_and(action = 'keep') THEN 'unchanged' WHEN bool_and(action IN ('keep', 'patchHeader')) THEN 'patch' ELSE 'rebuild' END AS strategy FROM act GROUP BY archive")
def commit_strategy(spark, sf):
    plan = F.when(F.every(F.col("action") == "keep"), "unchanged").when(F.every(F.col("action").isin("keep", "patchHeader")), "patch").otherwise("rebuild")
    return records(spark, sf).groupBy("archive").agg(F.count("*").alias("n"), plan.alias("strategy"))


@query("""WITH e AS (SELECT user_id, event_id, (value * 1000)::BIGINT AS done, lag((value * 1000)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT user_id, event_id, done, before FROM e WHERE done < before""")
def progress_monotone(spark, sf):
    rows = read(spark, sf, "events").select("user_id", "event_id", "ts", F.round(F.col("value") * 1000).cast("long").alias("done"))
    return editing.progress_faults(rows, ["user_id"], ["ts", "event_id"], "done").select("user_id", "event_id", "done", "before")


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, sum(user_id)::BIGINT AS total FROM events GROUP BY ALL")
def progress_windows(spark, sf):
    rows = read(spark, sf, "events")
    return progress.totals(rows, "ts", ["event_type"], "user_id").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(f"""WITH {ENTRIES}, l AS (SELECT idx, size, ((greatest(size, 1) + 999) // 1000)::INT AS last FROM entries), x AS (SELECT *, unnest(range(0, last + 1))::INT AS seq FROM l)
SELECT idx, seq, CASE seq WHEN 0 THEN 'start' WHEN last THEN 'finish' ELSE 'progress' END AS event, least(seq::BIGINT * 1000, size) AS done FROM x""")
def entry_events(spark, sf):
    return progress.entry_events(entries(spark, sf), 1000)


@query(f"""WITH {ENTRIES}, e AS (SELECT *, CASE idx % 6 WHEN 0 THEN 'other' WHEN 1 THEN 'symlink' WHEN 2 THEN 'hardlink' ELSE 'file' END AS k, CASE WHEN idx % 12 = 2 THEN idx + 1 ELSE idx - 1 END AS t, mtime * (idx % 9) AS m FROM entries)
SELECT idx, CASE WHEN k = 'other' THEN 'kind' WHEN k = 'symlink' THEN 'symlink' WHEN k = 'hardlink' AND (t < 0 OR t >= idx) THEN 'target' WHEN NOT m BETWEEN 0 AND 4294967295 THEN 'date' END AS reason FROM e""")
def first_violation(spark, sf):
    idx = F.col("idx")
    kind = F.when(idx % 6 == 0, "other").when(idx % 6 == 1, "symlink").when(idx % 6 == 2, "hardlink").otherwise("file")
    target = F.when(idx % 12 == 2, idx + 1).otherwise(idx - 1)
    return entries(spark, sf).select("idx", editing.first_violation(F.col("path"), kind, F.col("mtime") * (idx % 9), target, idx, "lha").alias("reason"))


@query(f"""WITH {ENTRIES}, t AS (SELECT idx, make_timestamp((mtime - 1500000000 + (idx % 5) * 900000000) * 1000000) AS ts FROM entries)
SELECT idx, CASE WHEN year(ts) < 1980 THEN 33 WHEN year(ts) > 2107 THEN 65439 ELSE ((year(ts) - 1980) << 9) | (month(ts) << 5) | day(ts) END::INT AS d,
CASE WHEN year(ts) < 1980 THEN 0 WHEN year(ts) > 2107 THEN 49021 ELSE (hour(ts) << 11) | (minute(ts) << 5) | (second(ts) // 2) END::INT AS t FROM t""")
def dos_date_pack(spark, sf):
    ts = F.timestamp_seconds(F.col("mtime") - 1_500_000_000 + (F.col("idx") % 5) * 900_000_000)
    utc = F.to_utc_timestamp(ts, "UTC") if spark.conf.get("spark.sql.session.timeZone") == "UTC" else F.convert_timezone(None, F.lit("UTC"), ts.cast("timestamp_ntz"))
    return entries(spark, sf).select("idx", utc.alias("ts")).select("idx", fields.dos_date(F.col("ts")).cast("int").alias("d"), fields.dos_time(F.col("ts")).cast("int").alias("t"))


@query(f"WITH {ENTRIES} SELECT idx, ((mtime + 11644473600) * 10000000)::DECIMAL(20, 0) AS filetime FROM entries")
def filetime(spark, sf):
    return entries(spark, sf).select("idx", fields.filetime(F.col("mtime")).alias("filetime"))


@query(f"WITH {ENTRIES} SELECT idx, (33188 + idx % 8) * 65536 + 32768 + CASE WHEN idx % 2 = 0 THEN 16 ELSE 32 END AS attributes FROM entries")
def unix_attr(spark, sf):
    return entries(spark, sf).select("idx", fields.unix_attributes(F.lit(33188) + F.col("idx") % 8, F.col("idx") % 2 == 0).alias("attributes"))


@query(f"WITH {ENTRIES} SELECT idx, CASE WHEN size * (idx % 3) < 2097152 THEN lpad(format('{{:o}}', size * (idx % 3)), 7, '0') END AS field, (512 - size % 512) % 512 AS padding FROM entries")
def octal_field(spark, sf):
    return entries(spark, sf).select("idx", fields.octal(F.col("size") * (F.col("idx") % 3), 8).alias("field"), fields.padding(F.col("size")).alias("padding"))


@query(f"WITH {ENTRIES}, r AS (SELECT idx, strlen(path) + 7 AS n FROM entries) SELECT idx, n + length((n + length(n::VARCHAR))::VARCHAR) AS record FROM r")
def pax_record_length(spark, sf):
    return entries(spark, sf).select("idx", fields.pax_length("path", F.col("path")).cast("long").alias("record"))


@query(f"""WITH {ENTRIES}, p AS (SELECT idx, path, size FROM entries), a AS (SELECT idx, path, size + (idx % 100 = 0)::INT AS size FROM entries WHERE idx % 131 <> 7)
SELECT *, 'planned' AS side FROM (SELECT * FROM p EXCEPT ALL SELECT * FROM a) UNION ALL SELECT *, 'actual' FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM p)""")
def plan_vs_actual_diff(spark, sf):
    planned = entries(spark, sf).select("idx", "path", "size")
    actual = planned.filter("idx % 131 <> 7").withColumn("size", F.col("size") + (F.col("idx") % 100 == 0).cast("int"))
    return editing.differences(planned, actual)


@query(f"WITH {MEMBERS} SELECT archive, count(*) AS n, max_by(ord, struct_pack(a := size, b := -ord)) AS longest, max(size) AS bytes FROM members GROUP BY archive")
def longest_member(spark, sf):
    return members(spark, sf).groupBy("archive").agg(F.count("*").alias("n"), F.max_by("ord", F.struct("size", -F.col("ord"))).alias("longest"), F.max("size").alias("bytes"))


@query("SELECT ascii(c) AS byte, count(*) AS n FROM (SELECT unnest(string_split(source, '')) AS c FROM documents) GROUP BY byte")
def byte_histogram(spark, sf):
    return read(spark, sf, "documents").select(F.explode(F.split("source", "")).alias("c")).filter("c <> ''").groupBy(F.ascii("c").alias("byte")).agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS h FROM documents)
SELECT ((instr('0123456789ABCDEF', h[1]) - 1) * 16 + instr('0123456789ABCDEF', h[2]) - 1)::INT AS byte, count(*) AS n FROM b GROUP BY byte""")
def text_byte_histogram(spark, sf):
    """The UTF-8 bytes of the whole texts; byte_histogram counts the characters of the short source names."""
    return checksums.byte_counts(read(spark, sf, "documents"), "text")


@query("""WITH RECURSIVE e AS (SELECT conv_id, turn, sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS done FROM conversations),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, done) AS k, count(*) OVER (PARTITION BY conv_id) AS m FROM e),
r AS (SELECT conv_id, turn, done, k, m, done AS notified, true AS kept FROM f WHERE k = 1 UNION ALL
SELECT f.conv_id, f.turn, f.done, f.k, f.m, CASE WHEN f.done - notified >= 512 THEN f.done ELSE notified END, f.done - notified >= 512 FROM r JOIN f ON f.conv_id = r.conv_id AND f.k = r.k + 1)
SELECT conv_id, done // 512 AS step, turn, done FROM r WHERE kept OR k = m""")
def progress_steps(spark, sf):
    """Turns of a conversation as bytes done, thinned to steps of 512 bytes."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    events = read(spark, sf, "conversations").select("conv_id", "turn", F.sum(F.octet_length("text").cast("long")).over(by).alias("done"))
    return progress.steps(events, "conv_id", "turn", "done", 512)


def bytes_of(text: str) -> str:
    """The UTF-8 bytes of a text as a list of numbers, in SQL."""
    digit = "instr('0123456789ABCDEF', h[{}]) - 1"
    return f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ({digit.format(1)}) * 16 + {digit.format(2)})"


def crc_of(listed: str, poly: int, start: int) -> str:
    """A reflected CRC of a list of bytes, in SQL, by the table of its polynomial."""
    table = list(range(256))
    for _ in range(8):
        table = [n >> 1 ^ (poly if n & 1 else 0) for n in table]
    return f"list_reduce({listed}, lambda a, b: xor(a >> 8, ({table})[(xor(a, b) & 255) + 1]), {start}::BIGINT)"


@query(f"""SELECT conv_id, xor({crc_of(bytes_of("whole"), 0xEDB88320, 0xFFFFFFFF)}, 4294967295)::BIGINT AS crc32, strlen(whole)::BIGINT AS size
FROM (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS whole FROM conversations GROUP BY conv_id)""")
def crc32_merged(spark, sf):
    chunks = read(spark, sf, "conversations").select("conv_id", "turn", F.col("text").cast("binary").alias("data"))
    return checksums.merged_crc32(chunks, ["conv_id"], "turn", "data")


def payloads(spark, sf, name, ident):
    return read(spark, sf, name).select(ident, F.col("text").cast("binary").alias("data"))


def in_codecs(rows, ident):
    size = lambda encode: (pa.int32(), "int", lambda data: len(encode(data)))
    return codecs.measured(rows, ident, {"size": (pa.int32(), "int", len)} | {c: size(encode) for c, encode in codecs.CODECS.items()})


@query()
def codec_sizes(spark, sf):
    return in_codecs(payloads(spark, sf, "benchmark", "item_id"), "item_id")


@query()
def document_codec_sizes(spark, sf):
    return in_codecs(payloads(spark, sf, "documents", "doc_id"), "doc_id")


def packing(files: str, max_bytes: int, max_files: int, filtered: bool = False) -> str:
    """Greedy packing in SQL, one row a step of a recursion."""
    opens = f"held + f.size > {max_bytes} OR n + 1 > {max_files}" + (" OR f.filter <> b.filter" if filtered else "")
    extra = ", filter" if filtered else ""
    return f"""WITH RECURSIVE files AS ({files}), f AS (SELECT *, row_number() OVER (PARTITION BY archive ORDER BY ord) AS k FROM files WHERE size > 0),
b AS (SELECT archive, ord, size{extra}, k, 0::BIGINT AS block, size AS held, 1 AS n FROM f WHERE k = 1 UNION ALL
SELECT f.archive, f.ord, f.size{", f.filter" if filtered else ""}, f.k, CASE WHEN {opens} THEN block + 1 ELSE block END, CASE WHEN {opens} THEN f.size ELSE held + f.size END, CASE WHEN {opens} THEN 1 ELSE n + 1 END
FROM b JOIN f ON f.archive = b.archive AND f.k = b.k + 1)
SELECT archive, ord, size{extra}, block FROM b UNION ALL SELECT archive, ord, size{extra}, NULL FROM files WHERE size IS NULL OR size = 0"""


TURNS = "SELECT conv_id % 16 AS archive, conv_id * 1000 + turn AS ord, strlen(text)::BIGINT AS size{} FROM conversations"


def turns(spark, sf):
    return read(spark, sf, "conversations").select(F.pmod("conv_id", F.lit(16)).alias("archive"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.octet_length("text").cast("long").alias("size"))


@query(packing(TURNS.format(""), 65536, 50))
def solid_packing(spark, sf):
    return editing.solid_blocks(turns(spark, sf), ["archive"], 65536, 50)


@query(packing(TURNS.format(", CASE WHEN (conv_id * 1000 + turn) % 7 < 5 THEN 'none' ELSE 'x86' END AS filter"), 65536, 50, True))
def filter_blocks(spark, sf):
    rows = turns(spark, sf).withColumn("filter", F.when(F.col("ord") % 7 < 5, "none").otherwise("x86"))
    return editing.solid_blocks(rows, ["archive"], 65536, 50)


def checked(rows, ident):
    return rows.select(ident, F.crc32("data").alias("crc32"), checksums.crc16("data").alias("crc16"), checksums.xxh32("data").alias("xxh32"), checksums.xxh64("data").alias("xxh64"), checksums.byte_sum("data").alias("byte_sum"))


@query(f"""SELECT item_id, xor({crc_of(bytes_of("text"), 0xEDB88320, 0xFFFFFFFF)}, 4294967295)::BIGINT AS crc32, {crc_of(bytes_of("text"), 0xA001, 0)}::INT AS crc16,
list_sum({bytes_of("text")})::BIGINT AS byte_sum FROM benchmark""")
def payload_sums(spark, sf):
    """The checksums that SQL can tell too."""
    return checked(payloads(spark, sf, "benchmark", "item_id"), "item_id").select("item_id", "crc32", "crc16", "byte_sum")


@query()
def member_checksums(spark, sf):
    return checked(payloads(spark, sf, "benchmark", "item_id"), "item_id")


@query()
def document_checksums(spark, sf):
    return checked(payloads(spark, sf, "documents", "doc_id"), "doc_id")


@query("SELECT conv_id, turn, nfc_normalize(text || chr(97) || chr(776)) AS name FROM conversations")
def composed_names(spark, sf):
    rows = read(spark, sf, "conversations").select("conv_id", "turn", F.concat("text", F.lit("a\u0308")).alias("name"))
    return rows.select("conv_id", "turn", headers.nfc("name").alias("name"))


def encrypted(rows, ident):
    """Entries under the ZIP stream cipher, then AES, then plain again; and their CBC form."""
    rows = rows.withColumn("crc", F.crc32("data"))
    rows = rows.withColumn("salt", F.unhex(F.substring(F.sha2(F.concat(F.col(ident).cast("string"), F.lit("salt")), 256), 1, 32)))
    stream, aes = ("stream", "one"), ("aes", "two")
    rows = rows.withColumn("a", crypto.reencrypted("data", "crc", "salt", None, stream))
    rows = rows.withColumn("b", crypto.reencrypted("a", "crc", "salt", stream, aes)).withColumn("c", crypto.reencrypted("b", "crc", "salt", aes, None))
    cbc = crypto.cbc_encrypted(F.col("data"), F.unhex(F.sha2(F.lit("key"), 256)), F.col("salt"))
    size = lambda c: F.octet_length(c).cast("long")
    hidden = (F.col("a") != F.col("data")) & (F.col("b") != F.col("data"))
    return rows.select(ident, size(cbc).alias("cbc_bytes"), size("b").alias("aes_bytes"), size("a").alias("stream_bytes"), F.sha2("c", 256).alias("opened"), hidden.alias("hidden"))


@query("""SELECT item_id, (strlen(text) + (16 - strlen(text) % 16) % 16)::BIGINT AS cbc_bytes, strlen(text)::BIGINT + 28 AS aes_bytes,
  strlen(text)::BIGINT + 12 AS stream_bytes, sha256(text) AS opened, true AS hidden FROM benchmark""")
def encrypted_entries(spark, sf):
    return encrypted(payloads(spark, sf, "benchmark", "item_id"), "item_id")


@query("""SELECT doc_id, (strlen(text) + (16 - strlen(text) % 16) % 16)::BIGINT AS cbc_bytes, strlen(text)::BIGINT + 28 AS aes_bytes,
  strlen(text)::BIGINT + 12 AS stream_bytes, sha256(text) AS opened, true AS hidden FROM documents""")
def encrypted_documents(spark, sf):
    return encrypted(payloads(spark, sf, "documents", "doc_id"), "doc_id")


def in_filters(rows, ident):
    """Filters keep every length and can be undone; differences of neighbours are other bytes."""
    undone = lambda k: (pa.string(), "string", lambda data: hashlib.sha256(codecs.UNFILTERS[k](codecs.FILTERS[k](data))).hexdigest())
    told = {"bytes": (pa.int64(), "long", lambda data: len(codecs.delta(data)))} | {f"{k}_undone": undone(k) for k in codecs.FILTERS}
    return codecs.measured(rows, ident, told | {"delta_differs": (pa.bool_(), "boolean", lambda data: codecs.delta(data) != data)})


@query("SELECT item_id, strlen(text)::BIGINT AS bytes, sha256(text) AS delta_undone, sha256(text) AS x86_undone, sha256(text) AS arm64_undone, len(text) > 1 AS delta_differs FROM benchmark")
def filtered_sizes(spark, sf):
    return in_filters(payloads(spark, sf, "benchmark", "item_id"), "item_id")


@query("SELECT doc_id, strlen(text)::BIGINT AS bytes, sha256(text) AS delta_undone, sha256(text) AS x86_undone, sha256(text) AS arm64_undone, len(text) > 1 AS delta_differs FROM documents")
def filtered_document_sizes(spark, sf):
    return in_filters(payloads(spark, sf, "documents", "doc_id"), "doc_id")
