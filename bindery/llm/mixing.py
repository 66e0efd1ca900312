"""Mixing sources to target weights by hash thresholds.

A document's rank in its source is a 60-bit hash, never a sort. Sizes are summed by source and hash
bucket; the running sum over the fixed number of buckets finds the bucket in which a source's budget
ends; the rows of that bucket alone are split again, bit range by bit range, until it is one hash value.
Budget that the document on the boundary is too large for goes, by a second threshold, to the documents
after it that fit. Every document then knows from its hash and size alone whether the mix takes it once
more. Sizes, targets and thresholds are tables of a row a source; the driver sees numbers of rows and the
level to which targets are filled, so there may be as many sources as there are documents.

Targets: sources in order of code points (null last) weigh 1, 2, 3, 1, 2, 3, ...; they share all sizes;
no target passes `most` times its source's size and what is cut off goes to the others by weight, until
none is above. A source whose target is r times its size takes every document floor(r) times and the
documents below its threshold once more, so no document is taken more than `most` times.

Defined cases: null or empty text has size 0 and is never taken; null source is a source of its own;
repeated rows (same id and text) have one hash and are taken together; an empty table gives no rows.
A single source gets all of itself. mixed() carries all columns on, whatever their names, mix() ignores
other ones. Whole documents only: a source's taken words miss its target by less
than half of the document on the boundary, or group of repeated rows there, and mostly by far less.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bindery.llm.common import cut, shuffle_partitions, word_count

SOURCES = 20_000
BITS, ROUNDS = 15, 4  # 2**15 buckets a source and round; four rounds settle 60 bits


def sizes_of(slim: DataFrame, weights=(1, 2, 3)) -> DataFrame:
    """source, n (its size) and w (its weight by rank) of every source; ranks come from sorted ranges, counted one by one."""
    totals = slim.groupBy("source").agg(F.sum("size").cast("long").alias("n"))
    by = [F.col("source").isNull(), F.col("source")]
    ranged = cut(totals.repartitionByRange(shuffle_partitions(slim), *by).withColumn("part", F.spark_partition_id()))
    counts = sorted((r.part, r["count"]) for r in ranged.groupBy("part").count().collect())  # a row a partition
    before, at = [], 0
    for part, n in counts:
        before.append((part, at))
        at += n
    offsets = slim.sparkSession.createDataFrame(before, "part int, before long")
    ranked = ranged.join(F.broadcast(offsets), "part").withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*by)) - 1)
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int"))
    return cut(ranked.select("source", "n", weight.alias("w")))


def with_targets(sizes: DataFrame, most: int = 3) -> DataFrame:
    """sizes (source, n, w) and target: all sizes shared by weight, each source at most `most` times its own.

    Sources are full below a level of target a weight; each round the level rises by what the full ones leave, until no
    more are full.
    """
    level, full = 0.0, -1
    while True:
        below = F.col("n") * most < F.lit(level) * F.col("w")
        r = sizes.agg(F.count_if(below).alias("full"), F.sum(F.when(below, F.col("n") * most).otherwise(0)).alias("given"), F.sum(F.when(below, 0.0).otherwise(F.col("w"))).alias("w"), F.sum("n").alias("n")).first()
        if r.full == full or not r.w:
            break
        full, level = r.full, float(r.n - r.given) / r.w
    below = F.col("n") * most < F.lit(level) * F.col("w")
    return sizes.withColumn("target", F.when(below, (F.col("n") * most).cast("double")).otherwise(F.lit(level) * F.col("w")))


def row_hash(id_col: str, text_col: str):
    """60 bits of a row's id and text."""
    return F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))), 4)


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=(1, 2, 3), most: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, taken and times (how often the mix takes it) of every row."""
    slim = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), row_hash(id_col, text_col).alias("h")))
    return decided(slim, plan(slim, weights, most)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times")


def mixed(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=(1, 2, 3), most: int = 3) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = docs.toDF(*names)
    at = {c: names[docs.columns.index(c)] for c in (id_col, text_col, source_col)}
    keyed = [F.col(at[source_col]).alias("source"), word_count(at[text_col]).alias("size"), row_hash(at[id_col], at[text_col]).alias("h")]
    thresholds = plan(cut(own.select(*keyed)), weights, most)
    rows = decided(own.select(*names, *keyed), thresholds).filter("times > 0")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), "times"))).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def sized(known: DataFrame, rows: int) -> DataFrame:
    """A table of a row a source, broadcast where it has at most SOURCES of them; beyond, Spark joins by shuffle."""
    return F.broadcast(known) if rows <= SOURCES else known


def decided(rows: DataFrame, thresholds: tuple[DataFrame, int]) -> DataFrame:
    """Rows (source, size, h, ...) with source_size, target and times, by hash and size alone."""
    known = thresholds[0].withColumnRenamed("source", "s")
    joined = rows.join(sized(known, thresholds[1]), rows["source"].eqNullSafe(known["s"]))
    once_more = (F.col("h") < F.col("below")) | ((F.col("h") > F.col("below")) & (F.col("h") < F.col("more")) & (F.col("size") <= F.col("cap")))
    return joined.withColumn("times", F.when(F.col("size") > 0, F.col("base") + once_more.cast("int")).otherwise(0))


def of_sources(rows: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """Rows with the columns that known has for their source."""
    named = known.withColumnRenamed("source", "s")
    return rows.join(sized(named, n), rows["source"].eqNullSafe(named["s"])).drop("s")


def boundaries(slim: DataFrame, asked: DataFrame, sources: int) -> DataFrame:
    """Where the running sum, by hash, of the sizes from hash `least` on and up to size `most` first passes `rest`.

    asked: source, rest, least, most. Result: source, total of those sizes, and at (the hash), left (of rest before it) and
    on (the words at it), null where the total doesn't pass rest. All rows are read twice: for the first histogram, and for
    the rows of the boundary buckets, of which the other rounds are made.
    """
    rows = of_sources(slim, asked, sources).filter((F.col("h") >= F.col("least")) & (F.col("size") <= F.col("most"))).select("source", "h", "size", "rest")
    totals = None
    for step in range(ROUNDS):
        shift = BITS * (ROUNDS - 1 - step)
        # at most 2**BITS rows a source
        histogram = rows.groupBy("source", "rest", F.shiftrightunsigned("h", shift).alias("bucket")).agg(F.sum("size").alias("n"))
        running = histogram.withColumn("upto", F.sum("n").over(Window.partitionBy("source").orderBy("bucket")))
        end = F.min_by(F.when(F.col("upto") > F.col("rest"), F.struct("bucket", "upto", "n")), F.when(F.col("upto") > F.col("rest"), F.col("bucket")))
        found = running.groupBy("source", "rest").agg(end.alias("e"), F.sum("n").alias("total"))
        found = cut(found.select("source", "total", F.col("e.bucket").alias("at"), (F.col("rest") - (F.col("e.upto") - F.col("e.n"))).alias("left"), F.col("e.n").alias("on")))
        totals = found.select("source", "total") if totals is None else totals
        if step < ROUNDS - 1:
            kept = found.filter("at is not null").select("source", "at", "left")
            rows = of_sources(rows, kept, sources).filter(F.shiftrightunsigned("h", shift) == F.col("at")).select("source", "h", "size", F.col("left").alias("rest"))
            rows = cut(rows) if step == 0 else rows
    named = found.select(F.col("source").alias("s"), "at", "left", "on")
    return cut(totals.join(named, totals["source"].eqNullSafe(named["s"]), "left").drop("s"))


def plan(slim: DataFrame, weights=(1, 2, 3), most: int = 3) -> tuple[DataFrame, int]:
    """source, source_size, target, whole repeats, threshold, second threshold and size cap below it; and the number of sources."""
    sizes = sizes_of(slim, weights)
    n_sources = sizes.count()
    goal = with_targets(sizes, most)
    base = F.when(F.col("n") > 0, F.floor(F.least(F.lit(float(most)), F.col("target") / F.col("n")) + 1e-12)).otherwise(0).cast("int")
    goal = cut(goal.withColumn("base", base).withColumn("want", F.col("target") - F.col("base") * F.col("n")))
    everything = F.lit(1 << (BITS * ROUNDS)).cast("long")
    asked = goal.filter("want > 0").select("source", F.col("want").alias("rest"), F.lit(0).cast("long").alias("least"), F.lit(2**62).alias("most"))
    first = boundaries(slim, asked, n_sources).filter("at is not null")
    # what the document on the boundary is too large for goes to smaller documents after it
    cap = F.floor("left").cast("long")
    again = first.filter("left >= 1").select("source", F.col("left").alias("rest"), (F.col("at") + 1).alias("least"), cap.alias("most"))
    second = boundaries(slim, again, n_sources).select(F.col("source").alias("s2"), F.col("total").alias("total2"), F.col("at").alias("at2"), F.col("left").alias("left2"), F.col("on").alias("on2"))
    first = first.select(F.col("source").alias("s1"), "at", "left", "on", cap.alias("cap"))
    rows = goal.join(first, goal["source"].eqNullSafe(first["s1"]) & (goal["want"] > 0), "left")
    rows = rows.join(second, rows["source"].eqNullSafe(second["s2"]) & F.col("at").isNotNull(), "left")
    past = F.col("left2") > F.col("on2") / 2  # the smaller document on the second boundary is taken if most of it fits
    more = F.when(F.col("at2").isNull(), everything).otherwise(F.col("at2") + past.cast("int"))
    missed = F.when(F.col("at2").isNull(), F.col("left") - F.coalesce("total2", F.lit(0))).otherwise(F.when(past, F.col("on2") - F.col("left2")).otherwise(F.col("left2")))
    rows = rows.withColumn("whole", F.coalesce((F.col("left") > 0) & (F.col("on") - F.col("left") < missed), F.lit(False))).withColumn("filled", F.coalesce(F.col("left") > 0, F.lit(False)) & ~F.col("whole"))
    below = F.when(F.col("at").isNull(), F.when(F.col("want") > 0, everything).otherwise(0)).otherwise(F.col("at") + F.col("whole").cast("int"))
    known = rows.select("source", F.col("n").alias("source_size"), "target", "base", below.cast("long").alias("below"), F.when(F.col("filled"), more).otherwise(0).cast("long").alias("more"), F.when(F.col("filled"), F.col("cap")).otherwise(0).cast("long").alias("cap"))
    return cut(known), n_sources
