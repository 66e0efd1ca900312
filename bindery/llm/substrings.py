"""Removal of repeated word windows by recompression.

A window is `window` consecutive words; a word goes if a window that covers it also starts in a document
with a smaller id. Texts are read as sequences of symbols that grow from round to round. A symbol's name is
a hash of the names it stands for, so all tasks agree on names, and the tables of names are Spark shuffles
that tell which symbols two documents share.

Round 1 pairs words: every word falls, by its name, on a left or a right side, and a left one followed by a
right one becomes one symbol. Whether two words are one symbol depends on these two alone, so equal word
sequences have the same symbols but for their edges. Neighbours that are equal fall on one side and never
pair: a run stays a run of equal symbols, with one name however long it is, and needs no symbol of its own.
The table of round 1 tells which of these symbols another document has too.

Round 2 pairs the symbols of round 1 in the same way; where such a pair begins there is an anchor. The JOINED
symbols from an anchor on are named as one high-level symbol, if all of them are shared. Of `window` equal
words those of at most the first and last belong to symbols that reach out of them, so (window - 2) / 2
symbols, rounded up, are whole; the first or the second of these is an anchor, as a symbol on the left side
doesn't pair with the one before and one on the right side doesn't with the one after. So every repeated
window holds a whole high-level symbol of all symbols but one, and the table of round 2 reveals it.

Round 3 verifies: the windows that hold a shared high-level symbol are named by 96-bit hashes of all their
words, the table of these finds the smallest document of each, and documents drop the words under windows
whose smallest document is not themselves.

The texts are shuffled once, into batches of bounded bytes; the rounds read that same shuffle. A batch sends
each round's distinct names, six or twelve bytes each, to the buckets they fall in, a message a bucket in use,
and gets back one bit for each. Groups of copies are one entry a batch and name, so no hot name gathers
anywhere; repeated rows are dealt over all batches.

Defined cases: null text has no words; a null id is larger than any other, and never smaller than
another null; rows with the same id never remove words from each other; texts of fewer words than a
window stay; an empty table gives no rows; other columns are carried on unchanged, but those called
n_words, n_removed or kept are replaced by the result's. Kept words are joined by one space.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bindery.llm.common import arrow_schema, shuffle_partitions, utf8

BATCH_BYTES, BUCKET_NAMES, MOST_PARALLEL = 4 << 20, 2_000_000, 64
NO_ID = 2**63 - 1
_RANDOM = np.random.default_rng(20240607)
ODD = _RANDOM.integers(0, 2**64, (3, 256), dtype=np.uint64) | np.uint64(1)
ODD2 = _RANDOM.integers(0, 2**64, (2, 256), dtype=np.uint64) | np.uint64(1)
SEED = _RANDOM.integers(0, 2**64, 2, dtype=np.uint64) | np.uint64(1)
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Words of up to LANE_BYTES are hashed for all words at once, eight bytes a step; longer ones each by XXH3.
LANE_BYTES = 32
MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def scrambled(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every bit of the input sways every bit of the output."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def planes(x: np.ndarray) -> bytes:
    """The bytes of an array, all lowest bytes first: high bytes that are equal compress to nothing."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def from_planes(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


class Batch:
    """Words, names and windows of the documents of one batch; the same in every step."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], window: int):
        self.window, self.joined = window, joined_symbols(window)
        self.texts = texts
        end = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) + 1
        self.data = b" ".join([b"", *texts, b""])
        self.data += b" " * (LANE_BYTES + 16 - len(self.data) % 8)  # eight bytes can be read from anywhere in a word
        gap = SPACE[np.frombuffer(self.data, np.uint8)]  # ASCII white space only
        self.begin = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
        self.length = np.flatnonzero(~gap[:-1] & gap[1:]) + 1 - self.begin
        self.ends = np.searchsorted(self.begin, end)
        self.sizes = np.diff(self.ends, prepend=0)
        self.low = self.digests(slice(None), 0)
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        self.ids = ids
        self.end = np.repeat(self.ends, self.sizes)  # where the word's document ends
        self.name_pairs()

    def digests(self, which, half: int) -> np.ndarray:
        """One of two independent 64-bit hashes of words, of their length and all their bytes."""
        eights = np.frombuffer(self.data, "<u8")
        begin, length = self.begin[which], self.length[which]
        out = length.astype(np.uint64) * SEED[half]
        left = np.flatnonzero(length <= LANE_BYTES)
        for k in range(0, LANE_BYTES, 8):
            left = left[length[left] > k]
            at, shift = np.divmod(begin[left] + k, 8)
            shift = (shift * 8).astype(np.uint64)
            value = (eights[at] >> shift) | (eights[at + 1] << np.uint64(1) << (np.uint64(63) - shift))
            out[left] = scrambled(out[left] + (value & MASK[np.minimum(length[left] - k, 8)]))
        known: dict[bytes, int] = {}
        for i in np.flatnonzero(length > LANE_BYTES).tolist():
            word = self.data[begin[i] : begin[i] + length[i]]
            if word not in known:
                known[word] = (xxhash.xxh3_128_intdigest(word) >> 64 * half) & 0xFFFFFFFFFFFFFFFF
            out[i] = known[word]
        return out

    def hashed(self, starts: np.ndarray, n: int, values: np.ndarray, odd: np.ndarray) -> np.ndarray:
        """Multilinear hash of n words from each start."""
        out = np.full(len(starts), odd[n], np.uint64)
        for j in range(n):
            out += values[starts + j] * odd[j]
        return mixed(out)

    def distinct(self, names: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct names, the number of each name among these, and whether two documents of the batch have it."""
        names, inverse = np.unique(names >> np.uint64(16), return_inverse=True)
        lo, hi = np.full(len(names), NO_ID), np.full(len(names), -1)
        np.minimum.at(lo, inverse, docs)
        np.maximum.at(hi, inverse, docs)
        return names, inverse, lo < hi

    def name_pairs(self) -> None:
        """Round 1: where the symbols of one or two words begin, and their names."""
        n = len(self.low)
        first = np.append(True, self.doc[1:] != self.doc[:-1])[:n]
        self.starts1 = starts = np.flatnonzero(first | ~paired(self.low)) if n else np.zeros(0, np.int64)
        both = np.diff(np.append(starts, n)) == 2
        second = self.low[np.minimum(starts + 1, n - 1)] if n else self.low
        self.symbols = np.where(both, mixed(self.low[starts] * ODD[1, 0] + second * ODD[1, 1]), mixed(self.low[starts]))
        self.doc1, self.first1 = self.doc[starts], first[starts]
        self.names, self.inverse, self.shared = self.distinct(self.symbols, self.doc1)

    def name_joined(self, bits: np.ndarray) -> None:
        """Round 2: the high-level symbols of which every part is shared, here or, by the bits, elsewhere."""
        n, m = len(self.symbols), self.joined
        known = (self.shared | bits)[self.inverse] if n else np.zeros(0, bool)
        at = np.flatnonzero(self.first1 | ~paired(self.symbols)) if n else np.zeros(0, np.int64)
        at = at[at + m <= n]
        whole = np.cumsum(np.append(0, known))
        at = at[(self.doc1[at + m - 1] == self.doc1[at]) & (whole[at + m] - whole[at] == m)] if len(at) else at
        self.from1 = self.starts1[at]
        self.upto1 = np.append(self.starts1, len(self.low))[at + m]
        self.joined_names, self.joined_inverse, self.joined_shared = self.distinct(self.hashed(at, m, self.symbols, ODD[0]), self.doc1[at])

    def windows(self, bits: np.ndarray) -> None:
        """Round 3: the windows around high-level symbols that are shared here or, by the bits, elsewhere; sorted distinct with the smallest id."""
        chosen = (self.joined_shared | bits)[self.joined_inverse] if len(self.joined_names) else np.zeros(0, bool)
        since, upto = self.from1[chosen], self.upto1[chosen]
        step = np.zeros(len(self.low) + 1, np.int64)
        low = np.maximum(upto - self.window, np.concatenate([[0], self.ends[:-1]])[self.doc[since]] if len(since) else since)
        fits = low <= since
        np.add.at(step, low[fits], 1)
        np.add.at(step, since[fits] + 1, -1)
        starts = np.flatnonzero(np.cumsum(step[:-1]) > 0)
        self.starts = starts = starts[starts + self.window <= self.end[starts]]
        h = self.hashed(starts, self.window, self.low, ODD[2])
        inside = np.flatnonzero(self.covered(starts))
        high = np.zeros(len(self.low), np.uint64)
        high[inside] = self.digests(inside, 1)
        x = (self.hashed(starts, self.window, high, ODD2[0]) >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((x, h))
        fresh = np.append(True, (np.diff(h[order]) != 0) | (np.diff(x[order]) != 0))[: len(order)]
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.cumsum(fresh) - 1
        self.h, self.x = h[order][fresh], x[order][fresh]
        ids = self.ids[self.doc[starts]]
        self.least = np.minimum.reduceat(ids[order], np.flatnonzero(fresh)) if len(order) else ids

    def covered(self, starts: np.ndarray) -> np.ndarray:
        """Whether each word is in a window that begins at one of these distinct starts."""
        step = np.zeros(len(self.low) + 1, np.int64)
        step[starts] += 1
        step[starts + self.window] -= 1
        return np.cumsum(step[:-1]) > 0

    def kept(self, bits: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """Each document's kept words, and the number of removed ones."""
        gone = self.starts[(bits[self.group] | (self.least[self.group] < self.ids[self.doc[self.starts]]))] if len(self.starts) else self.starts
        covered = self.covered(gone)
        begins = self.ends - self.sizes
        removed = np.add.reduceat(np.append(covered, False).astype(np.int64), np.minimum(begins, len(covered))) * (self.sizes > 0) if len(begins) else begins
        out = []
        for text, n, a, b in zip(self.texts, removed.tolist(), begins.tolist(), self.ends.tolist(), strict=True):
            words = text.split()  # bytes: ASCII white space only
            out.append(b" ".join(words if not n else [w for w, gone_ in zip(words, covered[a:b].tolist(), strict=True) if not gone_]))
        return out, removed


def joined_symbols(window: int) -> int:
    """Round-1 symbols in a high-level symbol: all that are whole in every window, but one."""
    return (window - 1) // 2 - 1


def paired(names: np.ndarray) -> np.ndarray:
    """Whether a symbol becomes one with the symbol before it: that is on the left side, it on the right one."""
    side = names >> np.uint64(63)
    return np.append(False, (side[:-1] == 0) & (side[1:] == 1))


def cuts(keys: np.ndarray, shift: int, buckets: int) -> tuple[list[int], list[int], list[int]]:
    """The buckets of the sorted keys (64 - shift bits), where each begins and ends; buckets are equal ranges of keys."""
    if not len(keys):
        return [], [], []
    top = (keys >> np.uint64(32 - shift)).astype(np.uint64)
    of = (top * np.uint64(buckets)) >> np.uint64(32)
    begin = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    return of[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(keys)]


def bits_of(rows: pa.Table, step: int, n: int) -> np.ndarray:
    """The answers of all buckets, in order."""
    found = sorted(zip(rows.column("step").to_pylist(), rows.column("bucket").to_pylist(), rows.column("n").to_pylist(), rows.column("bits").to_pylist(), strict=True), key=lambda r: r[:2])
    parts = [np.unpackbits(np.frombuffer(b, np.uint8), count=k).astype(bool) for s, _, k, b in found if s == step]
    out = np.concatenate(parts) if parts else np.zeros(0, bool)
    if len(out) != n:
        raise RuntimeError(f"step {step}: {len(out)} answers to {n} names")
    return out


SENT = "bucket int, batch int, n int, keys binary, more binary, ids binary"
ANSWER = "batch int, step int, bucket int, n int, bits binary"


def dedup_substrings(docs: DataFrame, id_col="doc_id", text_col="text", window: int = 13, spaced: bool = True) -> DataFrame:
    """All columns of docs but the text, and n_words, n_removed (longs) and kept (string).

    Kept words are joined by one space; with spaced=False, texts that lose nothing stay as they were.
    """
    if window < 7 or window > 200:
        raise ValueError("window must be 7 to 200 words")
    parts = shuffle_partitions(docs)
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col).cast("long")), F.lit(0))).first()[0]
    # a batch sends a bucket one row at most: no more of either than memory and parallelism ask for
    n_batches = max(-(-size // BATCH_BYTES), parts)
    buckets = max(-(-size // (6 * BUCKET_NAMES)), min(parts, MOST_PARALLEL))
    carried = [f"c{i}" for i in range(len(docs.columns))]
    own = docs.toDF(*carried)
    of = dict(zip(docs.columns, carried, strict=True))
    rows = own.select(F.pmod(F.xxhash64(of[id_col], of[text_col], F.monotonically_increasing_id()), F.lit(n_batches)).cast("int").alias("batch"), F.coalesce(F.col(of[id_col]).cast("long"), F.lit(NO_ID)).alias("id"), utf8(of[text_col]).alias("data"), *[c for c in carried if c != of[text_col]])
    grouped = rows.groupBy("batch")
    sent_as, answer_as = arrow_schema(SENT), arrow_schema(ANSWER)

    def batch_of(table: pa.Table) -> Batch:
        return Batch(table.column("id").to_numpy(), table.column("data").to_pylist(), window)

    def sent(table, keys, shift, *others):
        number = table.column("batch")[0].as_py()
        out = [(b, number, hi - lo, *[f(x[lo:hi]) if len(x) else b"" for x, f in others]) for b, lo, hi in zip(*cuts(keys, shift, buckets), strict=True)]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 6, sent_as.types, strict=True)], schema=sent_as)

    none = (np.zeros(0), bytes)

    def sent_names(table, names):
        return sent(table, names, 16, (names, lambda x: planes(x.astype(np.uint32))), (names, lambda x: planes((x >> np.uint64(32)).astype(np.uint16))), none)

    def send_pairs(table: pa.Table) -> pa.Table:
        return sent_names(table, batch_of(table).names)

    def after_pairs(table: pa.Table, answers: pa.Table) -> Batch:
        b = batch_of(table)
        b.name_joined(bits_of(answers, 1, len(b.names)))
        return b

    def send_joined(table: pa.Table, answers: pa.Table) -> pa.Table:
        return sent_names(table, after_pairs(table, answers).joined_names)

    def send_windows(table: pa.Table, answers: pa.Table) -> pa.Table:
        b = after_pairs(table, answers)
        b.windows(bits_of(answers, 2, len(b.joined_names)))
        return sent(table, b.h, 0, (b.h, planes), (b.x, planes), (b.least, planes))

    def answered(table, step, found):
        n = table.column("n").to_pylist()
        parts_ = np.split(found, np.cumsum(n)[:-1])
        columns = [table.column("batch"), pa.array([step] * len(n), pa.int32()), table.column("bucket"), table.column("n"), pa.array([np.packbits(p).tobytes() for p in parts_], pa.binary())]
        return pa.Table.from_arrays(columns, schema=answer_as)

    def column(table, name, kind):
        return np.concatenate([from_planes(x, kind) for x in table.column(name).to_pylist()])

    def meet_names(table: pa.Table, step: int) -> pa.Table:
        names = column(table, "keys", np.uint32).astype(np.uint64) | column(table, "more", np.uint16).astype(np.uint64) << np.uint64(32)
        order = np.argsort(names)
        same = np.diff(names[order]) == 0
        found = np.zeros(len(names), bool)
        found[order] = np.append(same, False) | np.append(False, same)
        return answered(table, step, found)

    def meet_windows(table: pa.Table) -> pa.Table:
        h, x, ids = column(table, "keys", np.uint64), column(table, "more", np.uint32), column(table, "ids", np.int64)
        order = np.lexsort((x, h))
        fresh = np.append(True, (np.diff(h[order]) != 0) | (np.diff(x[order]) != 0))
        least = np.minimum.reduceat(ids[order], np.flatnonzero(fresh))
        found = np.empty(len(h), bool)
        found[order] = least[np.cumsum(fresh) - 1] < ids[order]
        return answered(table, 3, found)

    kinds = {f.name: f.dataType for f in rows.schema.fields}
    schema = T.StructType([*[T.StructField(c, kinds.get(c, T.StringType())) for c in carried], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    text_at = carried.index(of[text_col])
    as_arrow = arrow_schema(schema)

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        b = after_pairs(table, answers)
        b.windows(bits_of(answers, 2, len(b.joined_names)))
        kept, removed = b.kept(bits_of(answers, 3, len(b.h)))
        if not spaced:
            kept = [k if n else t for k, n, t in zip(kept, removed.tolist(), table.column("data").to_pylist(), strict=True)]
        columns = [pa.nulls(table.num_rows, pa.string()) if i == text_at else table.column(c) for i, c in enumerate(carried)]
        columns += [pa.array(b.sizes), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
        return pa.Table.from_arrays([c.cast(k) if c.type != k else c for c, k in zip(columns, as_arrow.types, strict=True)], schema=as_arrow)

    def met(sent_rows: DataFrame, meet) -> DataFrame:
        return sent_rows.groupBy("bucket").applyInArrow(meet, ANSWER)

    def answered_with(answers: DataFrame):
        return grouped.cogroup(answers.groupBy("batch"))

    answers = met(grouped.applyInArrow(send_pairs, SENT), lambda t: meet_names(t, 1))
    answers = answers.unionByName(met(answered_with(answers).applyInArrow(send_joined, SENT), lambda t: meet_names(t, 2)))
    answers = answers.unionByName(met(answered_with(answers).applyInArrow(send_windows, SENT), meet_windows))
    done = answered_with(answers).applyInArrow(finish, schema)
    rest = [F.col(of[c]).alias(c) for c in docs.columns if c not in (text_col, "n_words", "n_removed", "kept")]
    return done.select(*rest, "n_words", "n_removed", "kept")
