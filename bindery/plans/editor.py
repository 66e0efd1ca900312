"""An archive edit session over DataFrames: nothing runs until a plan's rows are asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.functions import fields, records
from bindery.operators import editing, ranges
from bindery.plans import segments


class EditError(ValueError):
    """The edit of the smallest number that fails, and why."""


class Editor:
    """entries: idx, path, kind, size. Edits get numbers in the order of the calls; names are compared in composed form."""

    def __init__(self, entries: DataFrame, form: str = "zip", placement: str = "end"):
        if placement not in ("end", "beginning"):
            raise ValueError(f"placement {placement}")
        self.entries, self.form, self.placement = entries, form, placement
        spark = entries.sparkSession
        self.edits = spark.createDataFrame([], "seq long, op string, idx long, path string")
        self.added: list[DataFrame] = []
        self.count = 0

    def _add(self, rows: DataFrame, op: str) -> Editor:
        path = F.col("path") if op == "rename" else F.lit(None).cast("string")
        self.edits = self.edits.unionByName(rows.select(F.lit(self.count).cast("long").alias("seq"), F.lit(op).alias("op"), F.col("idx").cast("long").alias("idx"), path.alias("path")))
        self.count += 1
        return self

    def remove(self, rows: DataFrame) -> Editor:
        return self._add(rows, "remove")

    def rename(self, rows: DataFrame) -> Editor:
        return self._add(rows, "rename")

    def add(self, rows: DataFrame) -> Editor:
        """New entries: path, kind, size, and whatever else a commit needs; those of a call stand in order of path."""
        self.added.append(rows)
        return self

    def additions(self) -> list[DataFrame]:
        """The rows of every add() with `ord`: behind all entries, or before them; the same on every evaluation."""
        out = []
        for i, rows in enumerate(self.added):
            base = (1 << 50) + (i << 44) if self.placement == "end" else -(1 << 60) + (i << 44)
            out.append(ranges.running(rows, [], ["path"], F.lit(1).cast("long"), "ord").withColumn("ord", F.col("ord") + F.lit(base)))
        return out

    def check(self) -> None:
        """Raises for the first edit that fails, then for the first final name that does."""
        bad = editing.edit_violations(self.edits, self.entries).agg(F.min_by(F.struct("seq", "idx", "reason"), F.struct("seq", "idx")).alias("e")).first().e
        if bad:
            raise EditError(f"edit {bad.seq} of entry {bad.idx}: {bad.reason}")
        names = segments.checkpointed(self.final().withColumn("path", records.nfc("path")))
        wrong = names.withColumn("rule", fields.path_violation(F.col("path"), F.col("kind") == "directory", self.form.startswith("tar"))).filter("rule is not null").agg(F.min_by(F.struct("path", "rule"), "ord").alias("e")).first().e
        if wrong:
            raise EditError(f"{wrong.path!r}: {wrong.rule}")
        keyed = names.select(F.col("ord").alias("idx"), F.regexp_replace("path", "/$", "").alias("path"), "kind")
        for rows, what in ((editing.duplicate_names(keyed), "is there twice"), (editing.files_above_entries(keyed), "is a file above others")):
            first = rows.agg(F.min("path").alias("p")).first().p
            if first is not None:
                raise EditError(f"{first!r} {what}")

    def final(self) -> DataFrame:
        """ord, idx (null: added), path, kind, size of the edited archive."""
        kept = editing.survivors(self.entries.select("idx", "path", "kind", "size"), editing.folded(self.edits))
        rows = kept.select(F.col("idx").alias("ord"), "idx", "path", "kind", "size")
        for new in self.additions():
            rows = rows.unionByName(new.select("ord", F.lit(None).cast("long").alias("idx"), "path", "kind", F.col("size").cast("long").alias("size")))
        return rows

    def layout(self) -> DataFrame:
        """final() with the offset of every entry in an uncompressed tar image."""
        return ranges.exclusive_prefix_sum(self.final().withColumn("span", fields.tar_span(F.col("size"))), "ord", "span", "offset")

    def unchanged(self) -> bool:
        return not self.added and self.edits.isEmpty()
