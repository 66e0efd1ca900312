"""Offsets, ranges and their joins. No window runs over more rows than a cell holds, however large one archive is.

Where no key has more rows than a cell, a window by key is enough, whatever the number of keys. `wide` tells whether one may have
more: None lets it be counted, which evaluates the rows once; what is built of several steps counts once and hands it on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindery.shipping import checkpointed

#: Rows that one window may hold; keys of more are parted into cells, ranges of the sort order of about this many rows.
CELL_ROWS = 4_000_000
#: Rows are counted in so many buckets of keys, so the counts are as many whatever the number of keys.
BUCKETS = 1 << 14


def wide_key(df: DataFrame, keys: list[str]) -> bool:
    """Whether a key may have more rows than a cell: no bucket has fewer rows than one of its keys."""
    if not keys:
        return df.count() > CELL_ROWS
    return (df.groupBy(F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("_bucket")).count().agg(F.max("count").alias("n")).first().n or 0) > CELL_ROWS


def cells(df: DataFrame, keys: list[str], order: list[str], wide: bool | None = None) -> DataFrame | None:
    """df, cut, with its cell, a number that grows with the columns of keys and order; none if a window by key is enough.

    A first sort, of these columns alone, gives the least row of every range (a row a cell goes to the driver); a row finds
    its cell among these by bisection, so every evaluation gives it the same one.
    """
    if not (wide_key(df, keys) if wide is None else wide):
        return None
    by, df = [*keys, *order], checkpointed(df)
    parts = -(-df.count() // CELL_ROWS)
    if parts < 2:
        return None
    at = F.struct(*[F.col(c) for c in by])
    ranged = df.select(at.alias("at")).repartitionByRange(parts, "at").groupBy(F.spark_partition_id()).agg(F.min("at").alias("lo"))
    bounds = [r.lo for r in ranged.select("lo").orderBy("lo").collect()][1:]
    kinds = {f.name: f.dataType for f in df.schema.fields}
    literal = F.array(*[F.struct(*[F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(by, b, strict=True)]) for b in bounds])

    def halve(span, _):
        middle = F.floor((span["lo"] + span["hi"]) / 2).cast("int")
        up = (span["lo"] < span["hi"]) & (F.get(literal, middle) <= at)
        return F.struct(F.when(up, middle + 1).otherwise(span["lo"]).alias("lo"), F.when((span["lo"] < span["hi"]) & ~up, middle).otherwise(span["hi"]).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length())), F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")), halve)
    return df.withColumn("_cell", found["lo"])


def running(df: DataFrame, keys: list[str], order: list[str], length: Column | str, out: str, wide: bool | None = None) -> DataFrame:
    """Sum of length over the rows before each one, in order within keys.

    In cells: each cell is summed, the sums of the cells before (a row a cell) are added, and a key's first sum is taken
    off, so a key may reach over any number of cells.
    """
    df = df.withColumn("_n", F.col(length) if isinstance(length, str) else length)
    parted = cells(df, keys, order, wide)
    if parted is None:
        by = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)
        return df.withColumn(out, F.coalesce(F.sum("_n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    sums = parted.groupBy("_cell").agg(F.sum("_n").alias("_all"))
    ahead = sums.select("_cell", F.coalesce(F.sum("_all").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    by = Window.partitionBy("_cell").orderBy(*keys, *order).rowsBetween(Window.unboundedPreceding, -1)
    rows = parted.join(F.broadcast(ahead), "_cell").withColumn(out, F.col("_ahead") + F.coalesce(F.sum("_n").over(by), F.lit(0))).drop("_n", "_ahead", "_cell")
    if not keys:
        return rows
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    first = rows.groupBy(*named).agg(F.min(out).alias("_first"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return rows.join(first, same).withColumn(out, F.col(out) - F.col("_first")).drop("_first", *[f"_k{i}" for i in range(len(keys))])


def previous(df: DataFrame, keys: list[str], order: list[str], column: str, out: str, wide: bool | None = None) -> DataFrame:
    """The column's value in the row before, in order within keys; null in a key's first row."""
    parted = cells(df, keys, order, wide)
    if parted is None:
        return df.withColumn(out, F.lag(column).over(Window.partitionBy(*keys).orderBy(*order)))
    ends = parted.groupBy("_cell").agg(F.max_by(F.struct(*keys, F.col(column).alias("_value")), F.struct(*keys, *order)).alias("_end"))
    ends = ends.select(F.col("_cell"), F.lead("_cell").over(Window.orderBy("_cell")).alias("_next"), "_end")  # a row a cell
    ends = ends.filter("_next is not null").select(F.col("_next").alias("_cell"), "_end")
    rows = parted.join(F.broadcast(ends), "_cell", "left")
    inside = Window.partitionBy("_cell").orderBy(*keys, *order)
    before = F.lag(F.struct(*keys, F.col(column).alias("_value"))).over(inside)
    rows = rows.withColumn("_before", F.coalesce(before, "_end"))
    same = F.lit(True)
    for k in keys:
        same &= F.col("_before")[k].eqNullSafe(F.col(k))
    return rows.withColumn(out, F.when(F.col("_before").isNotNull() & same, F.col("_before")["_value"])).drop("_before", "_end", "_cell")


def exclusive_prefix_sum(df: DataFrame, order: str, length: str, out: str = "lo") -> DataFrame:
    """Sum of length over all rows of smaller order (a unique column)."""
    return running(df, [], [order], length, out)


def prefix_sum_within(df: DataFrame, keys: list[str], order: list[str], length: str, out: str = "lo", wide: bool | None = None) -> DataFrame:
    return running(df, keys, order, length, out, wide)


def islands(df: DataFrame, keys: list[str], order: list[str], joined: Column, out: str = "island", wide: bool | None = None) -> DataFrame:
    """Numbers runs of rows, from 1, in which `joined` holds for each row against the one before (column names with _prev)."""
    marked = df.withColumn("_new", F.when(joined, 0).otherwise(1))
    return running(marked, keys, order, F.col("_new").cast("long"), out, wide).withColumn(out, F.col(out) + F.col("_new")).drop("_new")


def coalesced(ranges: DataFrame, keys: list[str], order: list[str], lo: str = "lo", hi: str = "hi", wide: bool | None = None) -> DataFrame:
    """Adjacent source ranges, in output order, become one."""
    wide = wide_key(ranges, keys) if wide is None else wide
    runs = islands(previous(ranges, keys, order, hi, "_p", wide), keys, order, F.col("_p") == F.col(lo), wide=wide)
    return runs.groupBy(*keys, "island").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"), F.count("*").alias("n"))


def gaps(packs: DataFrame, keys: list[str], order: str, wide: bool | None = None) -> DataFrame:
    """Packs that do not begin where the one before ends."""
    return previous(packs, keys, [order], "hi", "prev_hi", wide).filter(F.col("prev_hi") != F.col("lo"))


def contained(chunks: DataFrame, spans: DataFrame, keys: list[str], lookback: int = 0, width: int = 1 << 20) -> DataFrame:
    """Chunks (c_lo, c_hi) wholly inside one of the disjoint spans (s_lo, s_hi), lookback bytes before them too.

    An equi-join: a span is repeated for each cell of width bytes that it touches, a chunk looks up the
    cell it starts in.
    """
    cells = spans.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("s_lo") / width), F.floor((F.greatest("s_hi", F.col("s_lo") + 1) - 1) / width))))
    asked = chunks.withColumn("_cell", F.floor(F.col("c_lo") / width))
    inside = (F.col("c_lo") - F.least(F.lit(lookback), F.col("c_lo")) >= F.col("s_lo")) & (F.col("c_hi") <= F.col("s_hi")) & (F.col("c_hi") > F.col("c_lo"))
    return asked.join(cells, [*keys, "_cell"]).filter(inside).drop("_cell")


def absorbed(parts: DataFrame, keys: list[str], packing: int, wide: bool | None = None) -> DataFrame:
    """Reused parts that stay: small ones (under packing / 16) at inner edges of a run of adjacent parts go, and
    runs of small parts only with neighbours on both sides. parts: lo, hi, image_length by keys.

    What decides is known of a run, one row each: its ends and whether all its parts are small.
    """
    wide = wide_key(parts, keys) if wide is None else wide
    runs = islands(previous(parts, keys, ["lo"], "hi", "_p", wide), keys, ["lo"], F.col("_p") == F.col("lo"), wide=wide)
    small = (F.col("hi") - F.col("lo")) * 16 < packing
    known = {"_lo": F.min("lo"), "_hi": F.max("hi"), "_small": F.every(small)}
    left, right = F.col("_lo") > 0, F.col("_hi") < F.col("image_length")
    gone = small & ((left & right & F.col("_small")) | (left & (F.col("lo") == F.col("_lo"))) | (right & (F.col("hi") == F.col("_hi"))))
    if wide:
        runs = checkpointed(runs)
        rows = runs.join(runs.groupBy(*keys, "island").agg(*[v.alias(c) for c, v in known.items()]), [*keys, "island"])
    else:
        run = Window.partitionBy(*keys, "island")
        rows = runs.withColumns({c: v.over(run) for c, v in known.items()})
    return rows.filter(~gone).drop("_p", "island", *known)


def at_or_before(points: DataFrame, marks: DataFrame, keys: list[str], at: str, value: str, wide: bool | None = None) -> DataFrame:
    """As-of lookup: each point's last mark at or before it, by union and one window a cell of a key."""
    both = points.select(*keys, F.col(at), F.lit(1).alias("_p"), F.lit(None).cast(dict(marks.dtypes)[value]).alias(value)).unionByName(marks.select(*keys, F.col(at), F.lit(0).alias("_p"), value))
    parted = cells(both, keys, [at, "_p"], wide)
    if parted is None:
        by = Window.partitionBy(*keys).orderBy(at, "_p").rowsBetween(Window.unboundedPreceding, 0)
        return both.withColumn("found", F.last(value, ignorenulls=True).over(by)).filter("_p = 1").select(*keys, at, "found")
    mark = F.when(F.col("_p") == 0, F.struct(*keys, F.col(value).alias("_value")))
    place = F.struct(*keys, at, "_p")
    ends = parted.groupBy("_cell").agg(F.max_by(mark, F.when(F.col("_p") == 0, place)).alias("_end"))
    # the last mark of all cells before, a row a cell
    ends = ends.select("_cell", F.last("_end", ignorenulls=True).over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)).alias("_end"))
    by = Window.partitionBy("_cell").orderBy(*keys, at, "_p").rowsBetween(Window.unboundedPreceding, 0)
    rows = parted.join(F.broadcast(ends), "_cell").withColumn("_mark", F.coalesce(F.last(mark, ignorenulls=True).over(by), "_end"))
    same = F.col("_mark").isNotNull()
    for k in keys:
        same &= F.col("_mark")[k].eqNullSafe(F.col(k))
    return rows.withColumn("found", F.when(same, F.col("_mark")["_value"])).filter("_p = 1").select(*keys, at, "found")


def overlapping(records: DataFrame, written: DataFrame, keys: list[str], width: int = 1 << 20) -> DataFrame:
    """Records (lo, hi) that share a byte with a written range (w_lo, w_hi), by an equi-join on cells of width bytes."""
    spread = lambda df, lo, hi: df.filter(F.col(hi) > F.col(lo)).withColumn("_cell", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width))))
    own, other = spread(records, "lo", "hi"), spread(written, "w_lo", "w_hi").select(*keys, "_cell", "w_lo", "w_hi")
    met = own.join(other, [*keys, "_cell"]).filter((F.col("lo") < F.col("w_hi")) & (F.col("w_lo") < F.col("hi")))
    return met.drop("_cell", "w_lo", "w_hi").distinct()
