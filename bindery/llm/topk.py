"""Exact top-k inner-product search over tiled matrix products.

Vectors become integers, floor(256 * x). Rows of the two sides are packed into blocks (queries) and
shards (candidates) of a fixed number of rows. Blocks form super-blocks of SUPER blocks, shards form as
many groups as there are tasks to fill; every pair of a super-block and a shard group is a tile of a grid
with a key of its own. So a shard moves once a super-block, not once a block, and a block once a group. In
a tile every (block, shard) pair is one matrix product, a partial selection keeps k candidates a query, a
pair whose largest possible product is below all k-th scores so far is passed over, and the per-query lists
of all tiles are merged in two rounds of a tree.

Defined cases: a vector that is null, empty, or holds a null or non-finite component takes no part, nor
does a null id; vectors of different lengths are never compared; rows with the query's own id are never its
candidates, and repeated rows of other ids are candidates each; rows that repeat a query's id and integers
are one query, rows that repeat its id with other integers are queries of their own, each with ranks from
1; equal scores rank by smaller id; fewer candidates than k give fewer rows; an empty table gives no rows;
other columns are ignored. Scores are ranked exactly whatever their size; one beyond 64 bits is returned as
the nearest long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.llm.common import cut, shuffle_partitions

QUERY_BLOCK, SHARD, SUPER = 2048, 4096, 16
PACKED = "dim int, ids binary, uids binary, data binary, n int"
LISTS = "query_id long, uid long, part int, top array<struct<neg long, wide binary, vec_id long>>"
NONE, LONGEST = -(2**62), 2**63 - 1


def packer(rows_per_block: int):
    """Packs (id, uid, vector) rows by dimension into blocks of at most rows_per_block."""

    def pack(rows):
        held: dict[int, list] = {}

        def block(dim):
            ids, uids, mats = zip(*held.pop(dim), strict=True)
            return dim, np.concatenate(ids), np.concatenate(uids), np.concatenate(mats)

        def emit(blocks):
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([d for d, *_ in blocks], pa.int32()),
                    pa.array([i.tobytes() for _, i, _, _ in blocks], pa.binary()),
                    pa.array([u.tobytes() for _, _, u, _ in blocks], pa.binary()),
                    pa.array([(m.astype(np.float32) if np.abs(m).max() < 2**24 else m).tobytes() for *_, m in blocks], pa.binary()),
                    pa.array([len(i) for _, i, _, _ in blocks], pa.int32()),
                ],
                names=["dim", "ids", "uids", "data", "n"],
            )

        for batch in rows:
            ids, uids = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            vectors = batch.column(2)
            lengths = np.diff(vectors.offsets.to_numpy())
            flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * 256)
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            for dim in np.unique(lengths):
                here = np.flatnonzero(lengths == dim)
                matrix = flat[starts[here][:, None] + np.arange(dim)]
                for at in range(0, len(here), rows_per_block):
                    part = here[at : at + rows_per_block]
                    held.setdefault(int(dim), []).append((ids[part], uids[part], matrix[at : at + rows_per_block]))
                    if sum(len(x) for x, _, _ in held[int(dim)]) >= rows_per_block:
                        dim_, *all_ = block(int(dim))
                        full = len(all_[0]) // rows_per_block * rows_per_block
                        yield emit([(dim_, *(x[a : a + rows_per_block] for x in all_)) for a in range(0, full, rows_per_block)])
                        if full < len(all_[0]):
                            held[dim_] = [tuple(x[full:] for x in all_)]
        if held:
            yield emit([block(d) for d in list(held)])

    return pack


def unpacked(dim: int, ids: bytes, data: bytes):
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(data, np.float32 if len(data) == 4 * dim * len(ids) else np.float64).reshape(-1, dim)


def largest(x: np.ndarray) -> float:
    return float(np.abs(x).max(initial=0))


def length(x: np.ndarray) -> float:
    """The longest row's length, rounded up."""
    return float(np.sqrt((x.astype(np.float64) ** 2).sum(1)).max(initial=0)) * (1 + 1e-9)


class Block:
    """Queries of one block and their k best so far: arrays while products fit doubles, else lists of whole numbers."""

    def __init__(self, ids: np.ndarray, uids: np.ndarray, data: np.ndarray, k: int):
        self.ids, self.uids, self.q, self.k = ids, uids, data, k
        self.most, self.length = largest(data), length(data)
        self.scores, self.found = np.full((len(ids), k), NONE, np.int64), np.full((len(ids), k), LONGEST, np.int64)
        self.wide: list[list[tuple[int, int]]] = [[] for _ in ids]

    def take(self, c_ids: np.ndarray, c: np.ndarray, c_most: float, c_length: float) -> None:
        """Compares with a shard whose ids are sorted."""
        most, s = self.most * c_most * max(1, c.shape[1]), len(c_ids)
        if most * (s + 1) >= 2**52:
            return self.take_wide(c_ids, c)
        if self.length * c_length < self.scores[:, -1].min(initial=LONGEST):
            return None  # not one can come in
        kind = np.float32 if most < 2**24 else np.float64
        q, c = self.q.astype(kind), c.astype(kind)
        for at in range(0, len(self.ids), 256):
            scores = q[at : at + 256] @ c.T
            own = self.ids[at : at + 256][:, None] == c_ids[None, :]
            keys = scores.astype(np.float64) * s + np.arange(s - 1, -1, -1)  # one number a candidate: score, then smaller id
            keys[own] = -np.inf
            top = np.argpartition(-keys, min(self.k, s) - 1, axis=1)[:, : self.k]
            valid = np.take_along_axis(keys, top, 1) > -np.inf
            new = np.where(valid, np.take_along_axis(scores, top, 1).astype(np.int64), NONE)
            scores = np.concatenate([self.scores[at : at + 256], new], 1)
            ids = np.concatenate([self.found[at : at + 256], np.where(valid, c_ids[top], LONGEST)], 1)
            order = np.lexsort((ids, -scores), axis=-1)[:, : self.k]
            self.scores[at : at + 256], self.found[at : at + 256] = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)
        return None

    def take_wide(self, c_ids: np.ndarray, c: np.ndarray) -> None:
        """The same in whole numbers of any size."""
        c = np.array([[int(v) for v in row] for row in c], object).reshape(c.shape)
        for i, row in enumerate(self.q):
            scores = c @ np.array([int(v) for v in row], object)
            both = self.wide[i] + [(-v, j) for v, j in zip(scores.tolist(), c_ids.tolist(), strict=True) if j != self.ids[i]]
            self.wide[i] = sorted(both)[: self.k]

    def lists(self):
        """(id, uid, hits) of every query that has any."""
        for i, (ident, uid, scores, found) in enumerate(zip(self.ids.tolist(), self.uids.tolist(), self.scores.tolist(), self.found.tolist(), strict=True)):
            hits = sorted([(-s, j) for s, j in zip(scores, found, strict=True) if s > NONE] + self.wide[i])[: self.k]
            if hits:
                yield ident, uid, [{"neg": ~long_of(-s), "wide": wide_of(-s), "vec_id": j} for s, j in hits]


def long_of(score: int) -> int:
    return max(-(2**63), min(LONGEST, score))


def wide_of(score: int) -> bytes:
    """Bytes by which scores beyond 64 bits sort, larger scores first; nothing for others."""
    if score == long_of(score):
        return b""
    size = score.bit_length()
    digits = abs(score).to_bytes((size + 7) // 8, "big")
    return (0xFFFFFFFF - size).to_bytes(4, "big") + bytes(255 - b for b in digits) if score > 0 else size.to_bytes(4, "big") + digits


def tiles_to_lists(k: int):
    def search(rows):
        tile, blocks = None, []

        def flush():
            found = [x for b in blocks for x in b.lists()]
            kind = pa.list_(pa.struct([("neg", pa.int64()), ("wide", pa.binary()), ("vec_id", pa.int64())]))
            return pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([(tile[1] * 31 + tile[2]) & 15] * len(found), pa.int32()), pa.array([x[2] for x in found], kind)],
                names=["query_id", "uid", "part", "top"],
            )

        for batch in rows:
            for *key, side, ids, uids, data in zip(*(batch.column(n).to_pylist() for n in ("dim", "block", "shard", "side", "ids", "uids", "data")), strict=True):
                ids, data = unpacked(key[0], ids, data)
                if key != tile:
                    if blocks:
                        yield flush()
                    tile, blocks = key, []
                if side == 0:
                    blocks.append(Block(ids, np.frombuffer(uids, np.int64), data, k))
                elif blocks:
                    order = np.argsort(ids, kind="stable")
                    ids, data = ids[order], data[order]
                    most, longest = largest(data), length(data)
                    for b in blocks:
                        b.take(ids, data, most, longest)
        if blocks:
            yield flush()

    return search


def top_k(vectors: DataFrame, k: int, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of vectors for each row where is_query holds."""
    spark, n_parts = vectors.sparkSession, shuffle_partitions(vectors)
    whole = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    clean = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    clean = clean.filter(F.col("id").isNotNull() & whole)
    # packed once and kept: a task that is run again must find the same blocks
    shards = cut(clean.select("id", F.lit(0).cast("long").alias("uid"), "v").mapInArrow(packer(SHARD), PACKED).withColumn("at", F.monotonically_increasing_id()))
    integers = F.transform("v", lambda x: x * 256 - F.pmod(x * 256, F.lit(1.0)))
    asked = clean.filter("q").select("id", F.xxhash64(integers).alias("uid"), "v").dropDuplicates(["id", "uid"])
    blocks = cut(asked.repartition(-(-asked.count() // QUERY_BLOCK) or 1).mapInArrow(packer(QUERY_BLOCK), PACKED).withColumn("at", F.monotonically_increasing_id()))
    n_supers, n_shards = -(-blocks.count() // SUPER), shards.count()
    if not n_supers:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n_groups = min(n_shards, max(1, -(-4 * n_parts // n_supers)))
    own = lambda n: F.pmod(F.xxhash64("at"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = blocks.select("dim", own(n_supers).alias("block"), every(n_groups).alias("shard"), F.lit(0).alias("side"), "ids", "uids", "data")
    right = shards.select("dim", every(n_supers).alias("block"), own(n_groups).alias("shard"), F.lit(1).alias("side"), "ids", "uids", "data")
    dealt = left.unionByName(right).repartition(max(n_parts, min(n_supers * n_groups, 20_000)), "dim", "block", "shard").sortWithinPartitions("dim", "block", "shard", "side")
    lists = dealt.mapInArrow(tiles_to_lists(k), LISTS)

    for keys in (("query_id", "uid", "part"), ("query_id", "uid")):
        lists = lists.groupBy(*keys).agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
    ranked = lists.select("query_id", F.posexplode("top").alias("at", "hit"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.bitwise_not("hit.neg").alias("score"))
