"""Progress of archive jobs as streams: thinned steps, totals a window, late rows by watermark."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def totals(events: DataFrame, ts: str, keys: list[str], value: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and values a key and window; on a stream, windows close once the watermark has passed them."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, window).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def thinned(step: int):
    """Of rows (key, order, done) sorted by all of them: each key's first, those at least step past the last one kept, and its last."""

    def run(batches):
        begun, key, notified, held = False, None, 0, None  # held: the row before, if it is not kept so far
        for batch in batches:
            keep: list[int] = []
            for i, (k, d) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if not begun or k != key:
                    if i and keep[-1:] != [i - 1]:
                        keep.append(i - 1)
                    elif not i and held is not None:
                        yield held
                    begun, key, notified = True, k, d or 0
                    keep.append(i)
                elif d is not None and d - notified >= step:
                    keep.append(i)
                    notified = d
            if batch.num_rows:
                held = None if keep[-1:] == [batch.num_rows - 1] else batch.slice(batch.num_rows - 1, 1)
            if keep:
                yield batch.take(pa.array(keep, pa.int64()))
        if held is not None:
            yield held

    return run


def steps(events: DataFrame, key: str, order: str, done: str, step: int = 4 << 20) -> DataFrame:
    """Each key's first event, then, in order, those at least `step` bytes past the last one kept, and its last one.

    step is the number of whole steps done. A key's events pass through one task, sorted, but are never held together.
    """
    rows = events.select(key, order, done)
    kept = rows.repartition(key).sortWithinPartitions(key, order, done).mapInArrow(thinned(step), rows.schema)
    return kept.select(key, F.floor(F.col(done) / step).alias("step"), order, done)


def entry_events(entries: DataFrame, step: int = 4 << 20) -> DataFrame:
    """idx, seq, event and done of every entry (idx, size): its start, a progress event a whole step, its finish; in order of idx and seq.

    What a listener of a writer is told, as a relation: a stream or a report sorts by these two.
    """
    last = F.ceil(F.greatest(F.col("size"), F.lit(1)) / step).cast("int")
    rows = entries.select("idx", "size", last.alias("_last"), F.explode(F.sequence(F.lit(0), last)).alias("seq"))
    event = F.when(F.col("seq") == 0, "start").when(F.col("seq") == F.col("_last"), "finish").otherwise("progress")
    return rows.select("idx", "seq", event.alias("event"), F.least(F.col("seq").cast("long") * step, F.col("size")).alias("done"))
