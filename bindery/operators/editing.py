"""Edits of an archive listing: folding, survivors, collisions, links, validation and actions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bindery.functions import fields, records
from bindery.operators import ranges


def folded(edits: DataFrame) -> DataFrame:
    """One state an entry of edits(seq, op, idx, path): a removal is final and drops any rename; of renames the last wins."""
    return edits.groupBy("idx").agg(F.bool_or(F.col("op") == "remove").alias("removed"), F.max_by("path", F.when(F.col("op") == "rename", F.col("seq"))).alias("_path")).select("idx", "removed", F.when(~F.col("removed"), F.col("_path")).alias("new_path"))


def edit_violations(edits: DataFrame, entries: DataFrame) -> DataFrame:
    """Edits that fail: of an unknown entry, or renames after the entry's removal; seq and reason."""
    first = edits.filter("op = 'remove'").groupBy("idx").agg(F.min("seq").alias("_gone"))
    known = entries.select("idx", F.lit(True).alias("_known"))
    rows = edits.join(first, "idx", "left").join(known, "idx", "left")
    reason = F.when(F.col("_known").isNull(), "unknown").when((F.col("op") == "rename") & (F.col("seq") > F.col("_gone")), "renamed after removal")
    return rows.select("seq", "idx", reason.alias("reason")).filter("reason is not null")


def survivors(entries: DataFrame, state: DataFrame) -> DataFrame:
    """Entries that stay, under their final names; those whose name is empty are no entries."""
    rows = entries.join(state, "idx", "left").filter(~F.coalesce("removed", F.lit(False)))
    return rows.withColumn("path", F.coalesce("new_path", "path")).filter("path <> ''").drop("removed", "new_path")


def without(entries: DataFrame, removed: DataFrame) -> DataFrame:
    return entries.join(removed.select("idx").distinct(), "idx", "left_anti")


def ancestors(paths: DataFrame, path: str = "path", own: bool = False) -> DataFrame:
    """A row for every proper ancestor of every path (with own: and the path itself)."""
    parts = F.split(F.regexp_replace(path, "/$", ""), "/")
    ends = F.sequence(F.lit(1), F.size(parts) - (0 if own else 1))
    listed = F.when(F.size(parts) > (0 if own else 1), F.transform(ends, lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))
    return paths.withColumn("ancestor", F.explode(listed))


def duplicate_names(entries: DataFrame) -> DataFrame:
    return entries.groupBy("path").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx")).filter("n > 1")


def files_above_entries(entries: DataFrame) -> DataFrame:
    """Files whose path is an ancestor of another entry's: exploded ancestors meet files by equality."""
    above = ancestors(entries.select("idx", "path")).groupBy("ancestor").agg(F.count("*").alias("below"))
    return entries.filter("kind = 'file'").join(above, F.col("path") == F.col("ancestor")).select("idx", "path", "below")


def files_over_subtrees(additions: DataFrame, entries: DataFrame) -> DataFrame:
    """New files whose path is a directory, explicit or implied, of the listing."""
    above = ancestors(entries.select("path")).select("ancestor").unionByName(entries.filter("kind = 'directory'").select(F.regexp_replace("path", "/$", "").alias("ancestor")))
    return additions.filter("kind = 'file'").join(above, F.col("path") == F.col("ancestor"), "left_semi")


def subtree_counts(entries: DataFrame) -> DataFrame:
    """Entries, files and bytes below every directory."""
    return ancestors(entries).groupBy("ancestor").agg(F.count("*").alias("entries"), F.count_if(F.col("kind") == "file").alias("files"), F.sum("size").alias("bytes"))


def direct_targets(links: DataFrame, members: DataFrame) -> DataFrame:
    """idx, target of hard links (idx, link): the last member before the link that has the name it points to and holds data or a link."""
    named = members.select(F.col("idx").alias("_t"), F.col("path").alias("_name"))
    met = links.select("idx", "link").join(named, (F.col("link") == F.col("_name")) & (F.col("_t") < F.col("idx")))
    return met.groupBy("idx").agg(F.max("_t").alias("target"))


def link_targets(links: DataFrame, cut=None) -> DataFrame:
    """idx, target, data_target of links that point backwards, by pointer doubling: log2 of the longest chain joins.

    Each round is cut (by default checkpointed), its changes are counted on what was cut, and rounds end when there are none.
    """
    cut = cut or (lambda df: df.checkpoint())
    rows = cut(links.filter("target < idx").select("idx", "target", F.col("target").alias("data_target")))
    while True:
        step = rows.select(F.col("idx").alias("_i"), F.col("data_target").alias("_t"))
        nxt = cut(rows.join(step, F.col("data_target") == F.col("_i"), "left").select("idx", "target", F.coalesce("_t", "data_target").alias("data_target"), F.col("_i").isNotNull().alias("_moved")))
        if nxt.filter("_moved").isEmpty():
            return rows
        rows = nxt.drop("_moved")


def new_holders(targets: DataFrame, removed: DataFrame) -> DataFrame:
    """For each removed data target the first surviving link, which takes over the data."""
    gone = removed.select(F.col("idx").alias("data_target")).distinct()
    return without(targets, removed).join(gone, "data_target", "left_semi").groupBy("data_target").agg(F.min("idx").alias("holder"), F.count("*").alias("links"))


def first_of_inode(entries: DataFrame) -> DataFrame:
    """Entries of one (device, inode): the first is the file, the others are links to it."""
    first = entries.groupBy("dev", "ino").agg(F.min("idx").alias("first_idx"))
    return entries.join(first, ["dev", "ino"]).withColumn("is_link", F.col("idx") != F.col("first_idx"))


def first_violation(path: Column, kind: Column, mtime: Column, target: Column, idx: Column, form: str, target_kind: Column | None = None) -> Column:
    """The first rule, in order, by which an entry cannot be written in a format; null if it can.

    A hard link must point back, and, where target_kind is given, to a file or to another such link.
    """
    rule = F.when(fields.path_violation(path, kind == "directory", form.startswith("tar")).isNotNull(), "path").when(kind == "other", "kind")
    if form == "lha":
        rule = rule.when(kind == "symlink", "symlink")
    back = target.isNull() | (target < 0) | (target >= idx)
    if target_kind is not None:
        back |= ~F.coalesce(target_kind.isin("file", "hardlink"), F.lit(False))
    rule = rule.when((kind == "hardlink") & back, "target")
    return rule.when(~fields.timestamp_fits(mtime, "tar" if form.startswith("tar") else form), "date")


def record_actions(listed: DataFrame) -> DataFrame:
    """Action of each surviving ZIP record. listed: old_lo, new_lo, header_length, new_header_length (null: not renamed), dirty."""
    still = (F.col("new_lo") == F.col("old_lo")) & ~F.col("dirty")
    same = F.col("new_header_length") == F.col("header_length")
    action = F.when(F.col("new_header_length").isNull(), F.when(still, "keep").otherwise("copy")).when(same & still, "patchHeader").otherwise("headerThenCopy")
    return listed.withColumn("action", action)


def folder_work(files: DataFrame, removed: DataFrame) -> DataFrame:
    """What becomes of each 7z folder: dropped with all its files, encoded again with some, carried with none."""
    marks = removed.select("idx", F.lit(1).alias("_r")).distinct()
    counts = files.join(marks, "idx", "left").groupBy("folder").agg(F.count("*").alias("files"), F.count("_r").alias("gone"))
    return counts.select("folder", "files", "gone", F.when(F.col("gone") == F.col("files"), "drop").when(F.col("gone") > 0, "reencode").otherwise("carry").alias("work"))


def packed_blocks(n_keys: int, filtered: bool, max_bytes: int, max_files: int):
    """Numbers the blocks of rows (keys, ord, size, filter) sorted by keys and ord."""

    def run(batches):
        key, block, size, count, chain = None, -1, 0, 0, None
        for batch in batches:
            out: list[int | None] = []
            columns = [batch.column(k).to_pylist() for k in range(n_keys)]
            chains = batch.column(n_keys + 2).to_pylist() if filtered else [None] * batch.num_rows
            for own, n, f in zip(zip(*columns, strict=True), batch.column(n_keys + 1).to_pylist(), chains, strict=True):
                if own != key:
                    key, block, size, count = own, -1, 0, 0
                if not n:
                    out.append(None)
                    continue
                if block < 0 or size + n > max_bytes or count + 1 > max_files or f != chain:
                    block, size, count, chain = block + 1, 0, 0, f
                size, count = size + n, count + 1
                out.append(block)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, "block"])

    return run


def solid_blocks(files: DataFrame, keys: list[str], max_bytes: int, max_files: int) -> DataFrame:
    """Greedy solid blocks in order: a file that no longer fits opens a block, files are never split, empty ones have none.

    With a column `filter`, files of another filter open a block too. Greedy packing carries state from row to row, so the
    numbers of an archive (no payload) pass through one task, sorted, but are never held there.
    """
    filtered = "filter" in files.columns
    kept = files.select(*keys, "ord", "size", *(["filter"] if filtered else []))
    schema = T.StructType([*kept.schema.fields, T.StructField("block", T.LongType())])
    return kept.repartition(*keys).sortWithinPartitions(*keys, "ord").mapInArrow(packed_blocks(len(keys), filtered, max_bytes, max_files), schema)


def progress_faults(events: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Events whose progress is below the one before."""
    return ranges.previous(events, keys, order, value, "before").filter(F.col(value) < F.col("before"))


def differences(planned: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows of one side only, with multiplicity: what verification reports."""
    return planned.exceptAll(actual).withColumn("side", F.lit("planned")).unionByName(actual.exceptAll(planned).withColumn("side", F.lit("actual")))


def position_faults(model: DataFrame, reader: DataFrame) -> DataFrame:
    """Entries (idx, path, size) of which a model and a reader don't say the same, position by position: idx and fault."""
    a = model.select("idx", F.col("path").alias("_p1"), F.col("size").alias("_s1"), F.lit(True).alias("_m"))
    b = reader.select("idx", F.col("path").alias("_p2"), F.col("size").alias("_s2"), F.lit(True).alias("_r"))
    fault = F.when(F.col("_m").isNull(), "not in the model").when(F.col("_r").isNull(), "not read").when(~F.col("_p1").eqNullSafe(F.col("_p2")), "name").when(~F.col("_s1").eqNullSafe(F.col("_s2")), "size")
    return a.join(b, "idx", "full").select("idx", fault.alias("fault")).filter("fault is not null")


def name_conflicts(candidates: DataFrame, live: DataFrame) -> DataFrame:
    """candidate, path, exact, below_file and over_entries of new names that collide with live entries (path, kind).

    Both sides are compared in composed form, live names as they were stored; ancestors meet by equality, so no name is
    compared with all others.
    """
    new = candidates.select("candidate", F.regexp_replace(records.nfc("path"), "/$", "").alias("path"))
    old = live.select(F.regexp_replace(records.nfc("path"), "/$", "").alias("path"), "kind")
    files = old.filter("kind <> 'directory'").select(F.col("path").alias("ancestor")).distinct()
    exact = new.join(old.select("path").distinct(), "path", "left_semi").select("candidate", F.lit("exact").alias("why"))
    below = ancestors(new).join(files, "ancestor", "left_semi").select("candidate", F.lit("below").alias("why"))
    over = new.join(ancestors(old).select(F.col("ancestor").alias("path")).distinct(), "path", "left_semi").select("candidate", F.lit("over").alias("why"))
    found = exact.unionByName(below).unionByName(over).groupBy("candidate").agg(*[F.bool_or(F.col("why") == w).alias(n) for w, n in (("exact", "exact"), ("below", "below_file"), ("over", "over_entries"))])
    return new.join(found, "candidate")


def work_units(segments: DataFrame) -> DataFrame:
    """One row: work units of a commit, by the kind of each segment (kind, length): sources are read, written and read back."""
    weight = F.when(F.col("kind") == "source", 3).when(F.col("kind") == "scratch", 2).otherwise(1)
    return segments.agg(F.coalesce(F.sum(F.col("length") * weight), F.lit(0)).alias("units"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def verification_units(folders: DataFrame, header: int = 0) -> DataFrame:
    """One row: bytes that verifying an edited 7z archive decodes: the header, folders that were written, and of converted ones their packed plain bytes."""
    size = F.when(F.col("work").isin("reencode", "added"), F.col("size")).when(F.col("work") == "convert", F.col("packed")).otherwise(0)
    return folders.agg((F.coalesce(F.sum(size), F.lit(0)) + F.lit(header)).alias("units"))
