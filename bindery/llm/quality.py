"""A text quality classifier: a factorisation machine on hashed words and structure.

Features of a text: its distinct words hashed into 2**BITS slots, scaled by their number, and one slot a
bin of each structure statistic (sizes, shares of letters, case, digits and marks, repetition of words,
neighbours and lines) and of each numeric metadata column that is asked for, by its logarithm. Score =
sigmoid(w0 + sum w x + pairwise part), the pairwise part in linear time by
1/2 sum_f ((sum v x)^2 - sum v^2 x^2).

Labels are learned from at most TRAIN_ROWS labelled ids, those of the smallest hash: a documented bound,
the one place where not all rows count. Of an id on several rows one text is learned from, the one of the
smallest hash. A row sends the driver its distinct slots, at most 2**BITS and a few, however long its
text, so the driver holds at most TRAIN_ROWS * 66 KB and mostly a hundredth of that. Training is seeded
and runs on the driver; the model is 2 MB whatever the input.

Defined cases: null text is empty and scored like any other, as are texts of one word or of millions; null
metadata has a bin of its own; labels that are null are not used, of repeated labels the mean counts, 0.5
and more as 1; with no labels at all every score is 0.5; equal rows have equal scores, so ties stay ties;
an empty table gives no rows. score() with carry keeps all other columns, whatever their names; one that
is called score is replaced.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bindery.llm.common import batches, utf8

BITS, FACTORS, TRAIN_ROWS, EPOCHS, FOLDS, THRESHOLD = 14, 8, 10_000, 12, 5, 0.3
WORD_WEIGHT = 0.3
SLOTS, BINS = 1 << BITS, 16
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"-()?")
UPPER, LOWER, DIGITS = (bytes(range(*r)) for r in ((65, 91), (97, 123), (48, 58)))


def statistics(data: bytes, words: list[bytes]) -> list[float]:
    """Structure of a text, each from 0 to 1."""
    n, size = len(words) or 1, len(data) or 1
    counts = Counter(words)
    most = counts.most_common(1)[0][1] if words else 0
    lines = [x for x in data.split(b"\n") if x.strip()]
    share = lambda of: (len(data) - len(data.translate(None, of))) / size
    marked = sum(c for w, c in counts.items() if w[-1:] in MARKS and len(w) > 1)
    bare = sum(c for w, c in counts.items() if not w.translate(None, MARKS))
    upper = share(UPPER)
    sentences = [x for x in data.replace(b"\n", b" ").split(b". ") if x]
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        min(1, np.log1p(len(words)) / 10), len(counts) / n, max(0, most - 1) / n,
        sum(map(len, words)) / n / 16, share(MARKS) * 4, share(DIGITS) * 4, upper / (upper + share(LOWER) + 1e-9),
        marked / n, bare / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        len(set(lines)) / max(1, len(lines)), len(set(sentences)) / max(1, len(sentences)), pairs / n, min(1, len(lines) / n * 4),
    ]


N_STATISTICS = 14


def logarithm_bin(value) -> int:
    """0: null or no number; else 1 and more by the size of the value."""
    if value is None or value != value:
        return 0
    return 1 + min(BINS - 2, int(np.log2(1 + min(max(float(value), 0.0), 1e15)) / 2))


class Featurizer:
    """Slots and values of texts; remembers the slots of short words."""

    def __init__(self):
        self.slot: dict[bytes, int] = {}

    def __call__(self, data: bytes, metadata: tuple = ()) -> tuple[np.ndarray, np.ndarray]:
        """Slots, distinct ones of words and then one a statistic, and the number of words in each of the former."""
        words = data.split()
        stats = statistics(data, words)
        if len(self.slot) > 500_000:
            self.slot.clear()
        slots = []
        for w in dict.fromkeys(words):
            if (s := self.slot.get(w)) is None:
                s = xxhash.xxh64_intdigest(w.lower()) & (SLOTS - 1)
                if len(w) <= 64:
                    self.slot[w] = s
            slots.append(s)
        bins = [SLOTS + i * BINS + min(BINS - 1, int(max(0.0, x) * BINS)) for i, x in enumerate(stats)]
        bins += [SLOTS + (N_STATISTICS + i) * BINS + logarithm_bin(x) for i, x in enumerate(metadata)]
        own, counts = np.unique(np.array(slots, np.int32), return_counts=True)
        return np.concatenate([own, np.array(bins, np.int32)]).astype(np.int32), counts


def values_of(slots: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Values of a text's slots: words weigh less the more there are, a statistic's bin is 1."""
    return np.concatenate([counts * (WORD_WEIGHT / np.sqrt(max(1, counts.sum()))), np.ones(len(slots) - len(counts))]).astype(np.float32)


def margins(model, slots: np.ndarray, values: np.ndarray, starts: np.ndarray):
    """Score before the sigmoid for rows that begin at starts, and the sums the gradient needs."""
    bias, w, v = model
    vx = v[slots] * values[:, None]
    sums = np.add.reduceat(vx, starts)
    pairwise = 0.5 * ((sums**2).sum(1) - np.add.reduceat((vx**2).sum(1), starts))
    return bias[0] + np.add.reduceat(w[slots] * values, starts) + pairwise, sums


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7, n_metadata: int = 0):
    """bias, w, v by AdaGrad on the log loss, with weight decay on what a batch touches."""
    random = np.random.default_rng(seed)
    n = SLOTS + (N_STATISTICS + n_metadata) * BINS
    model = [np.zeros(1, np.float32), np.zeros(n, np.float32), random.normal(0, 0.05, (n, FACTORS)).astype(np.float32)]
    if not len(rows):
        return model
    rate = np.clip(labels.mean(), 0.02, 0.98)
    model[0][0] = np.log(rate / (1 - rate))
    squares = [np.full_like(x, 1e-2) for x in model]
    for _ in range(min(200, max(EPOCHS, 60_000 // len(rows)))):  # few rows are seen more often
        order = random.permutation(len(rows))
        for at in range(0, len(order), 128):
            part = order[at : at + 128]
            slots, values = (np.concatenate([rows[i][k] for i in part]) for k in (0, 1))
            sizes = np.array([len(rows[i][0]) for i in part])
            starts = np.cumsum(sizes) - sizes
            z, sums = margins(model, slots, values, starts)
            err = ((1 / (1 + np.exp(-z)) - labels[part]) / len(part)).astype(np.float32)
            each = np.repeat(err, sizes) * values
            touched, to = np.unique(slots, return_inverse=True)
            gw = np.bincount(to, each, len(touched)).astype(np.float32)
            gv = np.stack([np.bincount(to, each * (np.repeat(sums[:, f], sizes) - model[2][slots, f] * values), len(touched)) for f in range(FACTORS)], 1).astype(np.float32)
            for i, (g, where) in enumerate(((np.array([err.sum()]), np.array([0])), (gw + 1e-4 * model[1][touched], touched), (gv + 1e-3 * model[2][touched], touched))):
                squares[i][where] += g * g
                model[i][where] -= 0.1 * g / np.sqrt(squares[i][where])
    return model


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", metadata: tuple[str, ...] = ()):
    """The model, from labelled rows outside the held-out fold. metadata: numeric columns of docs that are features too."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).filter("id is not null and y is not null").groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    chosen = known.filter(~held_out("id")).orderBy(F.xxhash64("id"), "id").limit(TRAIN_ROWS)
    # at most TRAIN_ROWS pairs of numbers
    picked = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("data"), *numbers(docs, metadata)).join(F.broadcast(chosen), "id").select("id", "y", "data", *[f"m{i}" for i in range(len(metadata))])

    def run(rows):
        features = Featurizer()
        for batch in batches(rows):
            found = [features(x, m) for x, m in zip(batch.column("data").to_pylist(), metadata_of(batch, len(metadata)), strict=True)]
            order = [xxhash.xxh64_intdigest(x) >> 1 for x in batch.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").cast(pa.int64()), batch.column("y"), pa.array(order, pa.int64()), pa.array([s.astype(np.uint16).tobytes() for s, _ in found], pa.binary()), pa.array([np.minimum(c, 65535).astype(np.uint16).tobytes() for _, c in found], pa.binary())],
                names=["id", "y", "of", "slots", "counts"],
            )

    rows = picked.mapInArrow(run, "id long, y int, of long, slots binary, counts binary")
    got = rows.groupBy("id").agg(F.min(F.struct("of", "y", "slots", "counts")).alias("r")).select("id", "r.*").toArrow().to_pydict()
    order = sorted(range(len(got["id"])), key=lambda i: got["id"][i])
    found = []
    for i in order:
        slots, counts = (np.frombuffer(got[c][i], np.uint16).astype(np.int32) for c in ("slots", "counts"))
        found.append((slots, values_of(slots, counts)))
    return train(found, np.array([got["y"][i] for i in order], np.float32), n_metadata=len(metadata))


def numbers(docs: DataFrame, metadata: tuple[str, ...]) -> list[Column]:
    return [F.col(c).cast("double").alias(f"m{i}") for i, c in enumerate(metadata)]


def metadata_of(batch: pa.RecordBatch, n: int) -> list[tuple]:
    """The batch's metadata, a tuple a row."""
    return list(zip(*(batch.column(f"m{i}").to_pylist() for i in range(n)), strict=True)) if n else [()] * batch.num_rows


def score(docs: DataFrame, model, id_col="doc_id", text_col="text", carry: bool = False, metadata: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and score of every row; with carry, all columns of docs but one called score, and score."""
    shared = docs.sparkSession.sparkContext.broadcast([np.asarray(x) for x in model])
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = docs.toDF(*names)
    text, ident = names[docs.columns.index(text_col)], names[docs.columns.index(id_col)]
    kept = names if carry else [ident]
    rows = own.select(*kept, utf8(text).alias("data"), *numbers(own, tuple(names[docs.columns.index(c)] for c in metadata)))

    def run(rows):
        features = Featurizer()
        for batch in batches(rows):
            found = [features(x, m) for x, m in zip(batch.column("data").to_pylist(), metadata_of(batch, len(metadata)), strict=True)]
            if not found:
                continue
            sizes = np.array([len(s) for s, _ in found])
            z, _ = margins(shared.value, np.concatenate([s for s, _ in found]), np.concatenate([values_of(s, c) for s, c in found]), np.cumsum(sizes) - sizes)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(1 / (1 + np.exp(-z.astype(np.float64))))], names=[*batch.schema.names[: len(kept)], "score"])

    schema = T.StructType([*rows.schema.fields[: len(kept)], T.StructField("score", T.DoubleType())])
    out = rows.mapInArrow(run, schema)
    if not carry:
        return out.select(F.col(ident).alias("doc_id"), "score")
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True) if c != "score"], "score")


def predicted(column: str = "score") -> Column:
    return (F.col(column) >= THRESHOLD).cast("int")
