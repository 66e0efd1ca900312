"""Archives edited in place, and rewritten into other forms.

An updater reads where the members of an archive lie, takes edits, and commits: what stays is carried as ranges of the old
file, headers that change and new members are written, and the new file replaces the old one by one rename after it has been
read back and held against the plan. Everything between is a relation: units, edits, links, segments.
"""

from __future__ import annotations

import os
import pickle
import uuid
import zlib

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.functions import decoders, headers, records, seven_zip
from bindery.functions.codecs import JOINABLE, leveled
from bindery.operators import editing, ranges
from bindery.plans import create, segments
from bindery.plans.editor import Editor
from bindery.plans.options import TAR_FORMS, Options
from bindery.sources import layouts
from bindery.sources.sinks import register

LAST = 1 << 62
VERIFIED, ENCODED = 16 << 20, 4 << 20  # bytes that a task decodes to verify them, and that it encodes anew


class SourceChanged(ValueError):
    """The archive is not the one that was opened."""


class Window:
    """A part of a file, read as if it were all of it."""

    def __init__(self, src, lo: int, hi: int):
        self.src, self.lo, self.length = src, lo, hi - lo

    def read(self, at: int, n: int) -> bytes:
        if at < 0 or at + n > self.length:
            raise layouts.Refusal("R8", "read out of a unit")
        return self.src.read(self.lo + at, n)

    some = read


def signature(path: str) -> tuple:
    s = os.stat(path)
    return s.st_dev, s.st_ino, s.st_mode, s.st_size, s.st_mtime_ns


class Updater:
    """Base of all editors of one archive. Rows of edits: remove (idx), rename (idx, path), add (path, kind, data, mode, mtime, link)."""

    forms: tuple[str, ...] = ()

    def __init__(self, spark: SparkSession, path: str, password: str | None = None, options: Options | None = None):
        register(spark)
        self.spark, self.path, self.password, self.done = spark, os.path.abspath(path), password, False
        self.signature = signature(self.path)
        reader = spark.read.option("password", password) if password else spark.read
        verdict = reader.format("archive_assessment").load(self.path).first()
        if self.forms and verdict.form not in self.forms:
            raise ValueError(f"{path}: {verdict.form} is not edited here")
        if not verdict.editable:
            if verdict.code == "password":
                raise decoders.WrongPassword(verdict.reason)
            raise ValueError(verdict.reason) if verdict.code == "invalid" else layouts.Refusal(verdict.code, verdict.reason)
        self.form = {"lha": "lzh"}.get(verdict.form, verdict.form)
        self.options = (options or Options(password=password if self.form in ("zip", "7z") else None)).checked(self.form)
        self.units = segments.checkpointed(reader.format("archive_units").load(self.path))
        self.entries = self.units.filter("idx is not null")
        self.editor = Editor(self.entries.select("idx", "path", "kind", "size"), self.form, self.options.placement)

    def rows(self, values: list, schema: str) -> DataFrame:
        return self.spark.createDataFrame(values, schema)

    def remove(self, indices) -> Updater:
        self.editor.remove(indices if isinstance(indices, DataFrame) else self.rows([(i,) for i in indices], "idx long"))
        return self

    def rename(self, names) -> Updater:
        self.editor.rename(names if isinstance(names, DataFrame) else self.rows(list(names.items()), "idx long, path string"))
        return self

    def add(self, rows: DataFrame) -> Updater:
        """New entries; their payloads are read at commit."""
        shaped = create.shaped(rows.withColumn("ord", F.lit(0)))
        size = F.when(F.col("kind") == "file", F.coalesce(F.octet_length("data"), F.lit(0))).otherwise(0).cast("long")
        self.editor.add(shaped.drop("ord").withColumn("size", size))
        return self

    def finish_additions(self) -> None:
        """Reads what add() was given now, so that its sources may change or go; payloads wait in the shared folder."""
        self.editor.added = [a if i < self.read else segments.checkpointed(a) for i, a in enumerate(self.editor.added)]
        self.read = len(self.editor.added)

    read = 0  # additions that have been read

    def cancel(self) -> None:
        """Ends the jobs of a running commit, from another thread; the archive stays as it was."""
        self.spark.sparkContext.cancelJobGroup(f"commit-{id(self)}")

    def added(self) -> DataFrame | None:
        """Entries to add, with `ord`."""
        found = self.editor.additions()
        return create.union(*[f.select(*create.COLUMNS) for f in found]) if found else None

    def freeze(self) -> None:
        """Edits are read once, when a commit begins."""
        self.editor.edits = segments.checkpointed(self.editor.edits)
        self.frozen = segments.checkpointed(self.joined())

    frozen: DataFrame | None = None

    def state(self) -> DataFrame:
        """Units with what the edits make of them: gone, and new_path where the name changes."""
        return self.joined() if self.frozen is None else self.frozen

    def joined(self) -> DataFrame:
        found = editing.folded(self.editor.edits)
        rows = self.units.join(found, "idx", "left")
        return rows.withColumn("gone", F.coalesce("removed", F.lit(False))).withColumn("new_path", F.when(~F.coalesce("removed", F.lit(False)) & (F.col("new_path") != F.col("path")), F.col("new_path"))).drop("removed")

    def commit(self, progress=None, fault=None) -> segments.Statistics:
        """Writes and publishes; progress(done, total) is called in order and ends the commit if it raises."""
        if self.done:
            raise ValueError("already committed")
        self.freeze()
        self.editor.check()
        if (added := self.added()) is not None:
            create.refused(added, self.form)
        total = os.path.getsize(self.path)
        tell = progress or (lambda *_: None)
        tell(0, total)
        self.finish_additions()
        self.spark.sparkContext.setJobGroup(f"commit-{id(self)}", f"commit of {self.path}", True)
        try:
            if self.unchanged():
                stats = segments.Statistics("unchanged", total, total, 0)
            else:
                plan = self.segments(added)
                if signature(self.path) != self.signature:
                    raise SourceChanged(self.path)

                def check(staged: str) -> None:
                    tell(total // 2, total)
                    self.verify(staged)
                    if signature(self.path) != self.signature:
                        raise SourceChanged(self.path)
                    tell(total, total)

                stats = segments.write(plan, self.path, True, check, fault)
        except PySparkException as e:
            if "WrongPassword" in str(e):
                raise decoders.WrongPassword("the password doesn't open the archive") from None
            raise
        finally:
            for name in ("spark.jobGroup.id", "spark.job.description"):
                self.spark.sparkContext.setLocalProperty(name, None)
        self.done = True
        return stats

    def unchanged(self) -> bool:
        return not self.editor.added and self.state().filter("gone or new_path is not null").isEmpty()

    def segments(self, added: DataFrame | None) -> DataFrame:
        raise NotImplementedError

    def expected(self) -> DataFrame:
        """path, kind and size of all entries of the result."""
        return self.editor.final().select("path", "kind", "size")

    def verify(self, staged: str) -> None:
        """V1: the new file, read like any other, lists what the plan says."""
        reader = self.spark.read.option("password", self.options.password) if self.options.password else self.spark.read
        found = reader.format("archive_units").load(staged).filter("idx is not null").select("path", "kind", "size")
        strip = lambda df: df.select(F.regexp_replace("path", "/$", "").alias("path"), "kind", "size")
        if wrong := editing.differences(strip(self.expected()), strip(found)).take(1):
            raise segments.OutputError(f"V1: {wrong[0].path!r} is {wrong[0].side} only")


# tar


def rewritten_headers(changed: DataFrame, archive: str, ident: str = "pos") -> DataFrame:
    """ord, bytes: the headers of units (lo, hi) under new_name, with new_link, or as files of m_size bytes."""

    def run(batches):
        with layouts.Ranged(archive) as src:
            for batch in batches:
                out = []
                for r in batch.to_pylist():
                    part = Window(src, r["lo"], r["hi"])
                    unit = layouts.tar_units(part)[0][0]
                    out.append((r["ord"], headers.tar_rewritten(unit, part.read(unit.header, layouts.BLOCK), r["new_name"], r["new_link"], r["m_size"])))
                yield pa.RecordBatch.from_arrays([pa.array([o for o, _ in out], pa.int64()), pa.array([b for _, b in out], pa.binary())], names=["ord", "bytes"])

    return changed.select(F.col(ident).alias("ord"), "lo", "hi", F.col("new_name").cast("binary").alias("new_name"), F.col("new_link").cast("binary").alias("new_link"), "m_size").mapInArrow(run, "ord long, bytes binary")


class TarUpdater(Updater):
    """Members are carried with their padding; a removed file that links need is written where its first surviving link stands."""

    forms = ("tar",)

    def links(self, state: DataFrame) -> DataFrame:
        """idx, new_link and the range (m_lo, m_hi) to copy, of surviving links that change."""
        holders = state.filter("kind in ('file', 'hardlink')")
        direct = editing.direct_targets(self.entries.filter("kind = 'hardlink'"), holders)
        chased = segments.checkpointed(editing.link_targets(direct, segments.checkpointed))
        gone = state.filter("gone").select("idx")
        holder = editing.new_holders(chased, gone).select(F.col("data_target").alias("h_target"), "holder")
        known = lambda prefix: state.select(F.col("idx").alias(f"{prefix}_idx"), F.col("gone").alias(f"{prefix}_gone"), F.col("new_path").alias(f"{prefix}_new"), F.coalesce("new_path", "path").alias(f"{prefix}_path"), F.col("data").alias(f"{prefix}_lo"), F.col("end").alias(f"{prefix}_hi"))
        rows = editing.without(chased, gone).join(known("t"), F.col("target") == F.col("t_idx")).join(known("d"), F.col("data_target") == F.col("d_idx"))
        rows = rows.join(holder, F.col("data_target") == F.col("h_target"), "left").join(known("h").select("h_idx", "h_path"), F.col("holder") == F.col("h_idx"), "left")
        takes = F.col("t_gone") & F.col("d_gone") & (F.col("holder") == F.col("idx"))
        link = F.when(~F.col("t_gone"), F.col("t_new")).when(~F.col("d_gone"), F.col("d_path")).when(F.col("holder") != F.col("idx"), F.col("h_path"))
        return rows.select("idx", link.alias("new_link"), F.when(takes, F.col("d_lo")).alias("m_lo"), F.when(takes, F.col("d_hi")).alias("m_hi")).filter("new_link is not null or m_lo is not null")

    def planned(self) -> DataFrame:
        """Units that stay, with what changes in their headers."""
        state = self.state()
        rows = state.filter("not gone").join(self.links(state), "idx", "left")
        name = F.when(F.col("new_path").isNotNull(), F.concat(F.regexp_replace("new_path", "/+$", ""), F.when((F.col("kind") == "directory") & F.col("path").endswith("/"), "/").otherwise("")))
        return rows.withColumn("new_name", name).withColumn("m_size", F.col("m_hi") - F.col("m_lo"))

    def body(self, added: DataFrame | None, archive: str) -> DataFrame:
        """Segments of all members: carried ones, rewritten headers, new members."""
        rows = segments.checkpointed(self.planned())
        changes = F.col("new_name").isNotNull() | F.col("new_link").isNotNull() | F.col("m_size").isNotNull()
        changed, src = rows.filter(changes), F.lit(archive)
        taking = changed.filter("m_size is not null")
        out = [
            rows.filter(~changes).select(*segments.carried(F.col("pos"), 0, src, F.col("lo"), F.col("hi"))),
            rewritten_headers(changed, archive).select(*segments.literal(F.col("ord"), 0, F.col("bytes"))),
            changed.filter("m_size is null").select(*segments.carried(F.col("pos"), 1, src, F.col("data"), F.col("hi"))),
            taking.select(*segments.carried(F.col("pos"), 1, src, F.col("m_lo"), F.col("m_hi"))),
            taking.select(*segments.literal(F.col("pos"), 2, F.unhex(F.repeat(F.lit("00"), F.pmod(-F.col("m_size"), F.lit(512)).cast("int"))))),
        ]
        if added is not None:
            out.append(create.tar_bytes(added).select(*segments.literal(F.col("ord"), 0, F.col("bytes"))))
        return segments.checkpointed(create.union(*out))

    def segments(self, added: DataFrame | None) -> DataFrame:
        body = self.body(added, self.path)
        members = body.agg(F.coalesce(F.sum(segments.length()), F.lit(0)).alias("n")).first().n
        return create.union(body, create.one(body, LAST, headers.tar_end(members)))

    def expected(self) -> DataFrame:
        rows = self.planned().filter("idx is not null")
        kind, size = F.when(F.col("m_size").isNotNull(), "file").otherwise(F.col("kind")), F.coalesce("m_size", "size")
        own = rows.select(F.coalesce("new_path", "path").alias("path"), kind.alias("kind"), size.alias("size"))
        return create.union(own, *[a.select("path", "kind", "size") for a in self.editor.added])


# ZIP


class ZipUpdater(Updater):
    """Records are carried whole; renamed ones get a new local header; the directory is made of the old records, moved."""

    forms = ("zip",)

    def planned(self) -> DataFrame:
        """Records that stay, with the length of their new local header (null: as it was), their offset and the action that follows."""
        rows = self.state().filter("not gone").withColumn("header_length", F.col("data") - F.col("lo"))
        name = F.concat(F.regexp_replace("new_path", "/+$", ""), F.when(F.col("kind") == "directory", "/").otherwise(""))
        rows = rows.withColumn("new_name", F.when(F.col("new_path").isNotNull(), name))
        rows = rows.withColumn("new_header_length", F.when(F.col("new_name").isNotNull(), F.col("header_length") - F.octet_length("raw") + F.octet_length("new_name")).cast("long"))
        rows = rows.withColumn("n", F.col("hi") - F.col("lo") + F.coalesce(F.col("new_header_length") - F.col("header_length"), F.lit(0)))
        front = self.front
        rows = ranges.running(rows, [], ["pos"], "n", "new_lo").withColumn("new_lo", F.col("new_lo") + F.lit(front)).withColumn("old_lo", F.col("lo")).withColumn("dirty", F.lit(front > 0))
        return editing.record_actions(rows)

    front = 0  # bytes of additions that stand before all records

    def strategy(self) -> str:
        """unchanged, patch (headers of equal length in place), append or rebuild: what an editor of files in place would do."""
        if self.unchanged():
            return "unchanged"
        r = self.planned().agg(F.every(F.col("action") == "keep").alias("keep"), F.every(F.col("action").isin("keep", "patchHeader")).alias("patch"), F.count("*").alias("n")).first()
        whole = r.n == self.entries.count()
        return "append" if self.editor.added and r.keep and whole else "patch" if not self.editor.added and r.patch and whole else "rebuild"

    def segments(self, added: DataFrame | None) -> DataFrame:
        fresh = None
        if added is not None:
            fresh = segments.checkpointed(create.zip_rows(added, self.options))
            if self.options.placement == "beginning":
                self.front = fresh.agg(F.sum("n").alias("n")).first().n or 0
        rows = segments.checkpointed(self.planned())
        with layouts.Ranged(self.path) as src:
            tail = layouts.zip_tail(src)
        archive, offset, limit = self.path, tail.offset, layouts.LIMIT32

        def local(batches):
            with layouts.Ranged(archive) as src:
                for batch in batches:
                    out = [(r["pos"], headers.zip_local_renamed(src.read(r["lo"], r["data"] - r["lo"]), r["new_name"].encode())) for r in batch.to_pylist()]
                    yield pa.RecordBatch.from_arrays([pa.array([o for o, _ in out], pa.int64()), pa.array([b for _, b in out], pa.binary())], names=["ord", "bytes"])

        def central(batches):
            with layouts.Ranged(archive) as src:
                for batch in batches:
                    out = []
                    for r in batch.to_pylist():
                        if r["descriptor"] and not r["zip64"] and r["new_lo"] >= limit:
                            raise ValueError(f"{r['path']!r}: its descriptor can't move beyond 4 GiB")
                        record = src.read(offset + r["c_lo"], r["c_hi"] - r["c_lo"])
                        out.append((r["pos"], headers.zip_central_moved(record, r["new_lo"], r["size"], r["end"] - r["data"], r["new_name"] and r["new_name"].encode(), r["descriptor"] and r["zip64"] and not r["canonical"])))
                    yield pa.RecordBatch.from_arrays([pa.array([o for o, _ in out], pa.int64()), pa.array([b for _, b in out], pa.binary())], names=["ord", "bytes"])

        here, renamed = F.lit(archive), rows.filter("new_name is not null")
        out = [
            rows.filter("new_name is null").select(*segments.carried(F.col("pos"), 0, here, F.col("lo"), F.col("hi"))),
            renamed.select("pos", "lo", "data", "new_name").mapInArrow(local, "ord long, bytes binary").select(*segments.literal(F.col("ord"), 0, F.col("bytes"))),
            renamed.select(*segments.carried(F.col("pos"), 1, here, F.col("data"), F.col("hi"))),
        ]
        moved = rows.select("pos", "path", "c_lo", "c_hi", "new_lo", "size", "data", "end", "new_name", "descriptor", "zip64", "canonical").mapInArrow(central, "ord long, bytes binary")
        kept = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
        if fresh is None:
            fresh = self.spark.createDataFrame([], create.ZIP_ROWS)
        else:
            out.append(fresh.select(*segments.literal(F.col("ord"), 0, F.col("bytes"))))
        placed = ranges.running(fresh.drop("bytes"), [], ["ord"], "n", "at").withColumn("at", F.col("at") + F.lit(0 if self.front else kept))
        directory, total = create.zip_directory(placed, given=moved)
        size = kept + (fresh.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n)
        end = records.zip_end(total["count"], total["size"], size)
        end = end[:-2] + len(tail.comment).to_bytes(2, "little") + tail.comment
        out += [directory.select(*segments.literal(F.lit(create.CENTRAL) + F.col("ord"), 0, F.col("bytes"))), create.one(rows, create.END, end)]
        return create.union(*out)


# LHA


class LhaUpdater(Updater):
    """Members are carried whole; renamed ones get a header of level 2."""

    forms = ("lha",)

    def segments(self, added: DataFrame | None) -> DataFrame:
        rows = segments.checkpointed(self.state().filter("not gone"))
        archive = self.path

        def renamed(batches):
            for batch in batches:
                out = []
                for r in batch.to_pylist():
                    mode = r["mode"] or (0o755 if r["kind"] == "directory" else 0o644)
                    name = r["new_path"].rstrip("/") + ("/" if r["kind"] == "directory" else "")
                    kind = 0o040000 if r["kind"] == "directory" else 0o100000
                    out.append((r["pos"], records.lha_header(r["extra"].decode(), name, r["hi"] - r["data"], r["size"], r["mtime"], r["crc"], kind | mode)))
                yield pa.RecordBatch.from_arrays([pa.array([o for o, _ in out], pa.int64()), pa.array([b for _, b in out], pa.binary())], names=["ord", "bytes"])

        here, changed = F.lit(archive), rows.filter("new_path is not null")
        out = [
            rows.filter("new_path is null").select(*segments.carried(F.col("pos"), 0, here, F.col("lo"), F.col("hi"))),
            changed.select("pos", "kind", "mode", "new_path", "extra", "hi", "data", "size", "mtime", "crc").mapInArrow(renamed, "ord long, bytes binary").select(*segments.literal(F.col("ord"), 0, F.col("bytes"))),
            changed.select(*segments.carried(F.col("pos"), 1, here, F.col("data"), F.col("hi"))),
            create.one(rows, LAST, b"\0"),
        ]
        if added is not None:
            out.append(create.lha_rows(added, self.options.lha).select(*segments.literal(F.col("ord"), 0, F.col("bytes"))))
        return create.union(*out)


# 7z


class SevenZipUpdater(Updater):
    """Folders of which all files stay are carried packed, those of which none stays are dropped, others are encoded anew, a task
    a folder, with their own method and filter. With a new password (or none) folders change their cipher without being
    encoded anew. The header is one block of bytes, as large as the metadata of all files; the driver puts it together."""

    forms = ("7z",)

    def __init__(self, spark, path, password=None, options=None, new_password: str | None | bool = False):
        super().__init__(spark, path, password, options)
        self.new_password = password if new_password is False else new_password
        with layouts.Ranged(self.path) as src:
            self.model = layouts.seven_zip_model(src, password)

    def work(self) -> DataFrame:
        """folder, files, gone and work (carry, convert, reencode or drop) of every folder."""
        files = self.entries.filter("folder is not null").select("folder", "idx")
        found = editing.folder_work(files, self.state().filter("gone").select("idx"))
        if self.new_password != self.password:
            for f in self.model.folders:
                if not f.can_reencrypt:
                    raise layouts.Refusal("S8", "a folder's cipher can't be changed")
            ciphered = self.rows([(k, f.encrypted) for k, f in enumerate(self.model.folders)], "folder long, encrypted boolean")
            change = (F.col("work") == "carry") & (F.col("encrypted") | F.lit(self.new_password is not None))
            found = found.join(ciphered, "folder").withColumn("work", F.when(change, "convert").otherwise(F.col("work"))).drop("encrypted")
        return found

    def unchanged(self) -> bool:
        return super().unchanged() and self.new_password == self.password

    def encoded(self, work: DataFrame) -> DataFrame:
        """Folders that are written: FOLDERS and n; converted ones keep their packed bytes."""
        archive, password = self.path, self.password
        kept = self.state().filter("not gone and folder is not null").groupBy("folder").agg(F.array_sort(F.collect_list(F.struct("pos", "lo", "hi"))).alias("members"))
        todo = work.filter("work in ('reencode', 'convert')").join(kept, "folder").join(self.chains(self.model), "folder")
        schema = create.segments_schema(create.FOLDERS)

        def run(batches):
            with layouts.Ranged(archive) as src:
                for batch in batches:
                    for r in create.as_dicts(batch):
                        folder, own, _ = pickle.loads(r["chain"])
                        packs = [src.some(lo, hi - lo) for lo, hi in own]
                        plain = decoders.folder_plain(folder, packs, password)
                        contents = [plain[f["lo"] : f["hi"]] for f in r["members"]]
                        if r["work"] == "reencode":
                            made, data = seven_zip.packed(b"".join(contents), *seven_zip.chain_of(folder))
                        else:
                            made, data = folder, packs[0]
                            if folder.encrypted:
                                cipher = next(i for i, c in enumerate(folder.coders) if c.id == layouts.AES)
                                data, made = decoders.coder_plain(folder.coders[cipher], packs[0], folder.sizes[cipher], password), seven_zip.without_cipher(folder)
                            if made.binds != [(i + 1, i) for i in range(len(made.coders) - 1)]:
                                raise layouts.Refusal("S8", "a folder's cipher can't be changed")
                        row = {"block": r["folder"], "first": 0, "coders": [{"id": c.id, "properties": c.properties} for c in made.coders], "sizes": made.sizes, "streams": [{"ord": f["pos"], "size": len(x), "crc": zlib.crc32(x)} for f, x in zip(r["members"], contents, strict=True)], "bytes": data}
                        yield pa.RecordBatch.from_pylist([row], schema=schema)

        # by a number of tasks: rows are small whatever they make a task encode, so Spark would put all in one
        due = [r.folder for r in work.filter("work in ('reencode', 'convert')").select("folder").collect()]
        tasks = max(1, min(len(due), -(-sum(self.model.folders[k].size for k in due) // ENCODED)))
        made = todo.select("folder", "work", "members", "chain").repartition(tasks, "folder").mapInArrow(run, create.FOLDERS)
        return create.ciphered(made, self.new_password).withColumn("n", F.octet_length("bytes").cast("long"))

    def chains(self, model) -> DataFrame:
        """folder and chain: all that a task must know of a folder, packed, so that none is sent the whole model."""
        return self.rows([(k, pickle.dumps((f, [model.packs[i] for i in f.packs], [model.streams[i][1:] for i in f.streams]))) for k, f in enumerate(model.folders)], "folder long, chain binary")

    def segments(self, added: DataFrame | None) -> DataFrame:
        work = segments.checkpointed(self.work())
        made = segments.checkpointed(self.encoded(work))
        rows = {r["block"]: create.folder_of(r) for r in create.listed(made.drop("bytes"))}
        kinds = {r.folder: r.work for r in work.select("folder", "work").collect()}
        gone, names = set(), {}
        for r in create.listed(self.state().filter("gone or new_path is not null").select("idx", "gone", "new_path")):
            if r["gone"]:
                gone.add(r["idx"])
            else:
                names[r["idx"]] = r["new_path"].rstrip("/")
        parts, packs, where_folder = [], [], {}
        for k, folder in enumerate(self.model.folders):
            kind = kinds.get(k, "carry")
            if kind == "drop":
                continue
            where_folder[k] = len(parts)
            if kind == "carry":
                own = [self.model.packs[i] for i in folder.packs]
                packs += [(k, j, lo, hi) for j, (lo, hi) in enumerate(own)]
                parts.append((folder, [hi - lo for lo, hi in own], [self.model.streams[s][2:] for s in folder.streams]))
            else:
                parts.append(rows[k])
        files, where, used = [], {}, {}
        for i, f in enumerate(self.model.files):
            if i in gone:
                continue
            if f.stream is not None:
                k = self.model.streams[f.stream][0]
                where[len(files)] = (where_folder[k], used.get(k, 0))
                used[k] = used.get(k, 0) + 1
            files.append(layouts.File(names.get(i, f.name), None, f.directory, f.empty, f.anti, f.created, f.accessed, f.modified, f.attributes))
        out = [self.rows(packs, "k long, j int, lo long, hi long").select(F.col("k").alias("ord"), F.col("j").alias("part"), F.lit(self.path).alias("src"), F.col("lo").alias("src_lo"), F.col("hi").alias("src_hi"), F.lit(None).cast("binary").alias("bytes"))]
        out.append(made.select(*segments.literal(F.col("block"), 0, F.col("bytes"))))
        if added is not None:
            new_options = Options(**{**self.options.__dict__, "password": self.new_password})
            found, new_parts, new_files, new_where = create.seven_zip_parts(added, new_options)
            for i, at in new_where.items():
                where[len(files) + i] = (len(parts) + at[0], at[1])
            if self.model.files and not any(f.attributes is not None for f in self.model.files):
                for f in new_files:
                    f.attributes = None
            parts, files = parts + new_parts, files + new_files
            out.append(found.select(*segments.literal(F.lit(1 << 50) + F.col("block"), 0, F.col("bytes"))))
        model = seven_zip.assembled(parts, files, where, self.model.order)
        header = seven_zip.header_of(model)
        out += [create.one(work, -1, seven_zip.start_of(header, model.header[0])), create.one(work, LAST, header)]
        return create.union(*out)

    def verify(self, staged: str) -> None:
        """V1, and V3: every folder that was written decodes to bytes of the checksums in the header."""
        self.options = Options(**{**self.options.__dict__, "password": self.new_password})
        super().verify(staged)
        with layouts.Ranged(staged) as src:
            model = layouts.seven_zip_model(src, self.new_password)
        password, size = self.new_password, sum(f.size for f in model.folders)

        def run(batches):
            with layouts.Ranged(staged) as src:
                for batch in batches:
                    bad = []
                    for k, chain in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                        folder, packs, own = pickle.loads(chain)
                        plain = decoders.folder_plain(folder, [src.some(lo, hi - lo) for lo, hi in packs], password)
                        bad += [k for at, n, crc in own if crc is not None and zlib.crc32(plain[at : at + n]) != crc]
                    yield pa.RecordBatch.from_arrays([pa.array(bad, pa.int64())], names=["folder"])

        if not self.chains(model).repartition(max(1, min(len(model.folders), -(-size // VERIFIED)))).mapInArrow(run, "folder long").isEmpty():
            raise segments.OutputError("V3: checksum of a folder")


# compressed tar


class CompressedTarUpdater(TarUpdater):
    """A compressed tar whose chunks are streams of their own: chunks that lie wholly in bytes that don't change are carried
    compressed, the rest of the new image is cut anew and encoded. The old image is decoded once, beside the archive, into a
    scratch file that is removed in the end."""

    forms = ()

    def __init__(self, spark, path, options=None):
        with layouts.Ranged(path) as src:
            self.codec = layouts.form_of(src)
        if self.codec not in TAR_FORMS.values():
            raise ValueError(f"{path}: not a compressed tar")
        if self.codec not in JOINABLE:
            raise layouts.Refusal("C1", f"{self.codec} is one stream")
        self.whole, self.options_given = os.path.abspath(path), options or Options()
        self.scratch = os.path.join(os.path.dirname(self.whole), f".{os.path.basename(path)}.{uuid.uuid4().hex}.image")
        try:
            at, self.chunks = 0, []
            with layouts.Ranged(path) as src, open(self.scratch, "xb") as file:
                for k, (lo, hi, n) in enumerate(decoders.chunks_of(decoders.streamed(src, self.codec), file.write)):
                    self.chunks.append((k, lo, hi, at, at + n))
                    at += n
            self.before = signature(self.whole)
            super().__init__(spark, self.scratch, options=options)
        except BaseException:
            self.close()
            raise

    def close(self) -> None:
        if os.path.lexists(self.scratch):
            os.unlink(self.scratch)

    def spliced(self, added: DataFrame | None, folder: str) -> tuple[DataFrame, DataFrame, int]:
        """The new image as laid-out segments over the scratch file and what is spooled in a folder; the chunks that are carried
        (k, lo, hi in the new image); its length."""
        body = self.body(added, self.path)
        members = body.agg(F.coalesce(F.sum(segments.length()), F.lit(0)).alias("n")).first().n
        end = headers.tar_end(members)
        image = segments.checkpointed(segments.coalesced(segments.laid_out(segments.spooled(create.union(body, create.one(body, LAST, end)), folder))))
        total = members + len(end)
        spans = image.filter(F.col("src") == self.path).select(F.lit(0).alias("key"), F.col("src_lo").alias("s_lo"), F.col("src_hi").alias("s_hi"), F.col("lo").alias("to"))
        old = self.rows(self.chunks, "k long, c_from long, c_to long, c_lo long, c_hi long").withColumn("key", F.lit(0))
        inside = ranges.contained(old, spans, ["key"]).withColumn("lo", F.col("to") + F.col("c_lo") - F.col("s_lo")).withColumn("hi", F.col("lo") + F.col("c_hi") - F.col("c_lo"))
        packing, _ = create.chunk_limits(self.codec, self.piece())
        kept = ranges.absorbed(inside.select("key", "k", "c_from", "c_to", "lo", "hi", F.lit(total).alias("image_length")), ["key"], packing)
        return image, segments.checkpointed(kept), total

    def piece(self) -> int:
        return self.options_given.piece(next(f for f, c in TAR_FORMS.items() if c == self.codec))

    def segments(self, added: DataFrame | None, folder: str) -> DataFrame:
        image, kept, total = self.spliced(added, folder)
        limit, _ = create.chunk_limits(self.codec, self.piece())
        # what lies between carried chunks is cut into chunks of its own
        stops = kept.select("key", "lo", "hi").unionByName(self.rows([(0, total, total)], "key int, lo long, hi long"))
        gaps = ranges.previous(stops, ["key"], ["lo", "hi"], "hi", "from").withColumn("from", F.coalesce("from", F.lit(0).cast("long"))).filter(F.col("from") < F.col("lo"))
        cuts = gaps.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("lo") - F.col("from") - 1) / limit))))
        cuts = cuts.select((F.col("from") + F.col("i") * limit).alias("p_lo"), F.least("lo", F.col("from") + (F.col("i") + 1) * limit).alias("p_hi"))
        fresh = self.encoded(cuts, image, limit)
        carried = kept.select(*segments.carried(F.col("lo"), 0, F.lit(self.whole), F.col("c_from"), F.col("c_to")))
        return create.union(carried, fresh.select(*segments.literal(F.col("chunk"), 0, F.col("bytes"))))

    def encoded(self, cuts: DataFrame, image: DataFrame, width: int) -> DataFrame:
        """chunk (its place in the image) and bytes: the parts of segments that a cut covers, joined in order and encoded."""
        cells = lambda df, lo, hi: df.withColumn("cell", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width))))
        spread = cells(image.withColumn("hi", F.col("lo") + F.col("src_hi") - F.col("src_lo")), "lo", "hi")
        met = cells(cuts, "p_lo", "p_hi").join(spread, "cell").filter((F.col("lo") < F.col("p_hi")) & (F.col("p_lo") < F.col("hi"))).drop("cell")
        met = met.dropDuplicates(["p_lo", "lo"])
        begin, stop = F.greatest("lo", "p_lo"), F.least("hi", "p_hi")
        part = met.select(F.col("p_lo").alias("chunk"), begin.alias("ord"), "src", (F.col("src_lo") + begin - F.col("lo")).alias("at"), (stop - begin).alias("n"))
        codec, levels = self.codec, self.options_given.levels

        def run(table: pa.Table) -> pa.Table:
            rows, parts, sources = table.sort_by("ord").to_pylist(), [], segments.Sources()
            try:
                parts = [segments.read_fully(sources(r["src"]), r["at"], r["n"]) for r in rows]
            finally:
                sources.close()
            return pa.table({"chunk": pa.array([rows[0]["chunk"]], pa.int64()), "bytes": pa.array([leveled(codec, **levels)(b"".join(parts))], pa.binary())})

        # ranges are small whatever they make a task encode, so the number of tasks is given
        size = cuts.agg(F.coalesce(F.sum(F.col("p_hi") - F.col("p_lo")), F.lit(0)).alias("n")).first().n
        return part.repartition(max(1, -(-size // ENCODED)), "chunk").groupBy("chunk").applyInArrow(run, "chunk long, bytes binary")

    def commit(self, progress=None, fault=None) -> segments.Statistics:
        try:
            self.freeze()
            self.editor.check()
            added = self.added()
            if added is not None:
                create.refused(added, "tar")
            if self.unchanged():
                self.done = True
                return segments.Statistics("unchanged", self.before[3], self.before[3], 0)
            with segments.spool(self.whole) as folder:
                plan = segments.checkpointed(self.segments(added, folder))
            expected = segments.checkpointed(self.expected())

            def check(staged: str) -> None:
                if signature(self.whole) != self.before:
                    raise SourceChanged(self.whole)
                reader = self.spark.read.format("archive_entries").load(staged)
                found = reader.select("path", "kind", "size")
                if wrong := editing.differences(expected, found).take(1):
                    raise segments.OutputError(f"V1: {wrong[0].path!r} is {wrong[0].side} only")
                if progress:
                    progress(self.before[3], self.before[3])

            stats = segments.write(plan, self.whole, True, check, fault)
            self.done = True
            return stats
        finally:
            self.close()


# any form into any other


class Rewriter(Updater):
    """Reads every entry that stays, and writes all anew, in the form of the archive or another one."""

    def __init__(self, spark, path, password=None, options=None):
        register(spark)
        self.spark, self.path, self.password, self.done = spark, os.path.abspath(path), password, False
        self.signature = signature(self.path)
        reader = spark.read.option("password", password) if password else spark.read
        self.payloads = reader.format("archive_entries").load(self.path)
        self.units = segments.checkpointed(self.payloads.drop("data").withColumn("pos", F.col("idx")))
        self.entries, self.options = self.units, options or Options(password=password)
        self.editor = Editor(self.entries.select("idx", "path", "kind", "size"), "tar", self.options.placement)

    def result(self, form: str) -> DataFrame:
        """The entries of the new archive with their payloads. A link whose file goes takes its data, as do all links in a form
        without links; the first surviving one stands for it where there are links."""
        state = self.state()
        rows = state.filter("not gone").join(self.payloads.select("idx", "data"), "idx")
        links = state.filter("kind = 'hardlink'").select("idx", "link")
        if not links.isEmpty():
            chased = segments.checkpointed(editing.link_targets(editing.direct_targets(links, state.filter("kind in ('file', 'hardlink')")), segments.checkpointed))
            gone = state.filter("gone").select("idx")
            holder = editing.new_holders(chased, gone).select(F.col("data_target").alias("h_target"), "holder")
            final = state.select(F.col("idx").alias("n_idx"), F.coalesce("new_path", "path").alias("n_path"))
            plan = editing.without(chased, gone).join(holder, F.col("data_target") == F.col("h_target"), "left")
            plan = plan.withColumn("shown", F.coalesce("holder", "data_target")).join(final, F.col("shown") == F.col("n_idx"))
            linked = F.lit(form.startswith("tar")) & (F.col("idx") != F.col("shown"))
            plan = plan.select("idx", "data_target", linked.alias("linked"), "n_path")
            spooled = self.payloads.select(F.col("idx").alias("data_target"), F.col("data").alias("t_data")).join(plan.filter("not linked").select("data_target").distinct(), "data_target")
            rows = rows.join(plan, "idx", "left").join(spooled, "data_target", "left")
            loose = (F.col("kind") == "hardlink") & ~F.coalesce("linked", F.lit(True))
            rows = rows.withColumn("data", F.when(loose, F.col("t_data")).otherwise(F.col("data"))).withColumn("link", F.when(F.col("linked"), F.col("n_path")).when(loose, F.lit(None)).otherwise(F.col("link"))).withColumn("kind", F.when(loose, "file").otherwise(F.col("kind")))
        kept = rows.select(F.col("idx").alias("ord"), F.coalesce("new_path", "path").alias("path"), "kind", "data", "mode", "mtime", "link")
        added = self.added()
        return kept if added is None else kept.unionByName(added)

    def unchanged(self) -> bool:
        return False

    def budget(self, form: str) -> int:
        """Bytes that a commit reads, and at most those that wait to be put out."""
        kept = self.state().filter("not gone").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first().n
        new = sum(a.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first().n for a in self.editor.added)
        return kept + new + min(kept + new, self.options.pending(form))

    def commit(self, form: str = "zip", dest: str | None = None, progress=None) -> segments.Statistics:
        """Writes dest, which must not exist, or replaces the archive."""
        if self.done:
            raise ValueError("already committed")
        self.freeze()
        options = self.options.checked(form)
        self.editor.form = form
        self.editor.check()
        rows = segments.checkpointed(create.shaped(self.result(form)))
        create.refused(rows, form)
        if signature(self.path) != self.signature:
            raise SourceChanged(self.path)
        total = self.budget(form)
        if progress:
            progress(0, total)
        stats = segments.write(create.segments_of(rows, form, options), dest or self.path, dest is None, (lambda _: progress(total, total)) if progress else None)
        self.done = True
        return stats


EDITORS = {"zip": ZipUpdater, "tar": TarUpdater, "lha": LhaUpdater, "7z": SevenZipUpdater}


def edit(spark: SparkSession, path: str, password: str | None = None, options: Options | None = None) -> Updater:
    """The editor of an archive by its form; of forms that are one stream, and of refused archives, a rewriter."""
    with layouts.Ranged(path) as src:
        form = layouts.form_of(src)
    try:
        if form in EDITORS:
            return EDITORS[form](spark, path, password, options)
        return CompressedTarUpdater(spark, path, options)
    except layouts.Refusal:
        return Rewriter(spark, path, password, options)
