"""SimHash fingerprints and their groups by bit-sliced comparison.

Equal fingerprints are one row. Two fingerprints within `radius` bits agree in at least 2 of radius + 2
blocks of bits, so every pair of blocks is a key under which all links meet. Rows under a key that
occurs twice are compared bit-sliced: each of the 64 bit planes is a vector over the block's rows,
carry-save counters in two bit planes add up the differing bits of many pairs at once, and rows whose
distances have all passed the radius are abandoned. A key with many rows is dealt out as tile pairs. A
comparison emits a spanning forest of the links it finds, at most one edge a row, and connected
components follow on the forests.

near_copies() is the same comparison at a wide radius, for texts whose sets of five-word shingles have a
Jaccard likeness of at least 0.8. Fingerprints of such texts differ in about 10 of 64 bits, 12 in the
shortest; WIDE bits are four standard deviations more. Pairs of blocks can't index so wide a radius, so
texts meet under keys of BANDS bands of ROWS MinHashes (a pair of likeness 0.8 is missed with a chance of
about 3 in 100,000). Under a key the bit planes are compared; what lies within WIDE bits is a loose link.
The components of loose links are then compared exactly, by the shingles of their texts, so no link is
taken on trust; components of exact links are the groups.

Defined cases: null or wordless texts have fingerprint 0, linked like any other; fewer words than a
shingle are one shingle; repeated rows and equal texts share a fingerprint; a null id takes no part in
the choice of component_id (null if a group has no other); an empty table gives no rows; other columns
are ignored. one_of_each_group() and one_of_each_near_copy() carry all columns on, whatever their names; in
them null and wordless texts are one group.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.llm.common import batches, cut, shuffle_partitions, utf8
from bindery.llm.components import components, node_of, one_of_each

TILE = 1024
SIZE, BANDS, ROWS, WIDE = 5, 20, 4, 24
LIKE = (4, 5)
TEXT_TILE = 512
_RANDOM = np.random.default_rng(20240611)
ODD = _RANDOM.integers(0, 2**64, SIZE + 2, dtype=np.uint64) | np.uint64(1)
TURNS = _RANDOM.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
SHIFTS = _RANDOM.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)
BAND_ODD = _RANDOM.integers(0, 2**64, (BANDS, ROWS + 1), dtype=np.uint64) | np.uint64(1)


def fingerprint(data: bytes, size: int = 3, seed: int = 42) -> int:
    """64 bits: bit b is set if it is in over half of the shingles' XXH64."""
    words = data.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[: len(words) - size]]).tolist()
    stops = (ends[size - 1 :] - 1).tolist()
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << b for b in np.flatnonzero(counts * 2 > len(hashes)).tolist()))


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text", size: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) of every row."""

    def run(rows):
        for batch in batches(rows):
            fps = np.array([fingerprint(x, size) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("data")).mapInArrow(run, "doc_id long, fp long")


def bit_sliced_links(fps: np.ndarray, radius: int, group: np.ndarray | None = None) -> dict[int, np.ndarray]:
    """row: packed bits of the rows within radius of it (its own among them), for rows with such neighbours.

    With a group a row, only rows of one group are compared.
    """
    n = len(fps)
    pad = -n % 64
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(np.concatenate([bits, np.zeros((pad, 64), np.uint8)]).T, axis=1, bitorder="little")).view("<u8")
    valid = np.packbits(np.concatenate([np.ones(n, np.uint8), np.zeros(pad, np.uint8)]), bitorder="little").view("<u8")
    need = max(1, radius.bit_length())
    rows = np.arange(n)
    counters = [np.zeros((n, planes.shape[1]), "<u8") for _ in range(need)]
    if group is None:
        dead = np.broadcast_to(~valid, (n, planes.shape[1])).copy()
    else:
        others = np.ones((n, n + pad), np.uint8)
        others[:, :n] = group[:, None] != group[None, :]
        dead = np.packbits(others, axis=1, bitorder="little").view("<u8")
    for b in range(64):
        carry = planes[b] ^ -(bits[rows, b].astype(np.uint64))[:, None]
        for c in counters:  # carry-save: add one bit to each column's counter
            carry, c[:] = c & carry, c ^ carry
        dead |= carry
        if b % 4 == 3 or b == 63:
            over = dead.copy()
            for value in range(radius + 1, 1 << need):
                hit = np.full_like(dead, ~np.uint64(0))
                for i, c in enumerate(counters):
                    hit &= c if value >> i & 1 else ~c
                over |= hit
            # a row is its own neighbour: it is abandoned once nothing else is left
            alive = np.bitwise_count(~over).sum(1) > 1
            if not alive.all():
                rows, dead = rows[alive], over[alive]
                counters = [c[alive] for c in counters]
            else:
                dead = over
            if not len(rows):
                break
    return dict(zip(rows.tolist(), ~dead, strict=True))


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(fingerprint, smallest of its group here) for every fingerprint that has a link in fps."""
    links = bit_sliced_links(fps, radius)
    out, seen = [], set()
    for first in links:
        if first in seen:
            continue
        group, wave = {first}, [first]
        while wave:
            near = np.bitwise_or.reduce([links[i] for i in wave])
            found = np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little"))
            wave = [i for i in found.tolist() if i not in group]
            group.update(wave)
        seen |= group
        members = fps[sorted(group)].view(np.int64)
        out += [(int(x), int(members.min())) for x in members if x != members.min()]
    return out


def compare_blocks(radius: int):
    def run(rows):
        held, key, run_ = [], None, []

        def linked():
            fps = np.unique(np.concatenate(held)).view(np.uint64)
            found = forest(fps, radius)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

        # whole runs of equal keys are put together up to a tile; links across keys are links too
        for batch in rows:
            keys = batch.column(0).to_numpy()
            fps = batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.diff(keys)) + 1
            for part, k in zip(np.split(fps, cuts), keys[np.concatenate([[0], cuts])].tolist() if len(keys) else [], strict=False):
                if k != key and run_:
                    held.append(np.concatenate(run_))
                    run_ = []
                    if sum(map(len, held)) >= TILE:
                        yield linked()
                key = k
                run_.append(part)
        if run_:
            held.append(np.concatenate(run_))
        if held:
            yield linked()

    return run


def block_keys(radius: int):
    """(mask of the bits of one pair of blocks) for all pairs of radius + 2 blocks."""
    n = radius + 2
    edges = [64 * i // n for i in range(n + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(n)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(a | b) for a, b in combinations(masks, 2)]


def link(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Spanning edges (a, b) of the links within radius between the distinct values of fps.fp."""
    keyed = F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(block_keys(radius))]))
    keys = fps.select("fp", keyed.alias("key"))
    crowd = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    dealt = keys.join(crowd, "key").withColumn("own", F.pmod(F.xxhash64("fp"), tiles).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    cell = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    dealt = dealt.select(cell.alias("cell"), "fp").repartition(shuffle_partitions(fps), "cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(compare_blocks(radius), "a long, b long")


def simhash_groups(docs: DataFrame, id_col="doc_id", text_col="text", size: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fp, component_id of every row."""
    own = cut(fingerprints(docs, id_col, text_col, size))
    distinct = cut(own.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(link(distinct.select("fp"), radius)).select(F.col("node").alias("fp"), "root")
    named = distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return own.join(named.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def one_of_each_group(docs: DataFrame, id_col="doc_id", text_col="text", size: int = 3, radius: int = 2) -> DataFrame:
    """One row of docs for each group of simhash_groups(), chosen as in one_of_each()."""
    own = cut(fingerprints(docs.select(node_of(text_col).alias("node"), text_col), "node", text_col, size).distinct())
    roots = components(link(own.select("fp").distinct(), radius)).select(F.col("node").alias("fp"), "root")
    named = own.join(roots, "fp", "left").select(F.col("doc_id").alias("node"), F.coalesce("root", "fp").alias("root"))
    return one_of_each(docs, named, node_of(text_col), id_col)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles, text by text, and how many each text has (repeated ones included)."""
    words = [t.lower().split() for t in texts]  # bytes: A-Z and ASCII white space only
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = [w for ws in words for w in ws]
    number = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    digests = np.fromiter((xxhash.xxh64_intdigest(w) for w in number), np.uint64, len(number))
    values = digests[np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))] if flat else np.zeros(0, np.uint64)
    counts = np.where(sizes >= SIZE, sizes - SIZE + 1, np.minimum(sizes, 1))
    begins = np.cumsum(sizes) - sizes
    starts = np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    long = np.repeat(np.minimum(sizes, SIZE), counts)
    values = np.append(values, np.zeros(SIZE, np.uint64))
    out = ODD[SIZE] + long.astype(np.uint64) * ODD[SIZE + 1]
    for j in range(SIZE):
        out += np.where(j < long, values[starts + j], np.uint64(0)) * ODD[j]
    return mixed(out), counts


def minhashes(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A row of BANDS * ROWS minhashes (32 bits) for every text; of wordless texts all are the highest."""
    out = np.full((len(counts), BANDS * ROWS), 2**32 - 1, np.uint32)
    some = counts > 0
    if some.any():
        begins = (np.cumsum(counts) - counts)[some]
        for k in range(BANDS * ROWS):
            out[some, k] = np.minimum.reduceat((hashes * TURNS[k] + SHIFTS[k]) >> np.uint64(32), begins)
    return out


def wide_fingerprints(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of texts from the hashes of all their shingles, text by text; 0 of wordless texts."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts > 0)
    if len(some):
        begins = (np.cumsum(counts) - counts)[some]
        for bit in range(64):
            ones = np.add.reduceat((hashes >> np.uint64(bit) & np.uint64(1)).astype(np.int64), begins)
            out[some] |= (ones * 2 > counts[some]).astype(np.uint64) << np.uint64(bit)
    return out


def signed(docs: DataFrame) -> DataFrame:
    """node, fp (its five-word fingerprint) and keys (one a band) of every row of docs(node, data)."""

    def run(rows):
        for batch in batches(rows, 1 << 20):
            hashes, counts = shingles(batch.column(1).to_pylist())
            wide = minhashes(hashes, counts).astype(np.uint64)
            keys = np.stack([mixed((wide[:, k * ROWS : (k + 1) * ROWS] * BAND_ODD[k, :ROWS]).sum(1, dtype=np.uint64) + BAND_ODD[k, ROWS]) for k in range(BANDS)], 1)
            lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(wide_fingerprints(hashes, counts).view(np.int64)), lists], names=["node", "fp", "keys"])

    return docs.mapInArrow(run, "node long, fp long, keys array<long>")


def loose_links(radius: int):
    """Edges (a, b) between nodes of the same cell within radius bits, of rows (cell, node, fp) sorted by cell.

    Whole cells are put together up to a tile and compared bit-sliced at once, each row with those of its cell.
    """

    def run(rows):
        held: list[tuple] = []

        def linked(whole: bool):
            cell, node, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            if not whole:  # the last cell may go on
                at = int(np.flatnonzero(cell != cell[-1])[-1]) + 1 if (cell != cell[-1]).any() else 0
                held.append((cell[at:], node[at:], fp[at:]))
                cell, node, fp = cell[:at], node[:at], fp[:at]
            edges = []
            starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
            begin = 0
            while begin < len(cell):  # as many whole cells as fit a tile, one at least
                ends = starts[(starts > begin) & (starts <= begin + TILE)]
                later = starts[starts > begin]
                end = int(ends[-1]) if len(ends) and len(cell) - begin > TILE else int(later[0]) if len(later) and len(cell) - begin > TILE else len(cell)
                links = bit_sliced_links(fp[begin:end].view(np.uint64), radius, cell[begin:end])
                own = node[begin:end]
                seen: set[int] = set()
                for first in links:
                    if first in seen:
                        continue
                    group, wave = {first}, [first]
                    while wave:
                        near = np.bitwise_or.reduce([links[i] for i in wave])
                        wave = [i for i in np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little")).tolist() if i not in group]
                        group.update(wave)
                    seen |= group
                    edges += [(int(own[i]), int(own[first])) for i in group if own[i] != own[first]]
                begin = end
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in edges], pa.int64()), pa.array([b for _, b in edges], pa.int64())], names=["a", "b"])

        for batch in rows:
            if batch.num_rows:
                held.append(tuple(batch.column(k).to_numpy() for k in range(3)))
            if sum(len(h[0]) for h in held) >= 8 * TILE:
                yield linked(False)
        if held:
            yield linked(True)

    return run


def exact_forest(n: int, near) -> list[tuple[int, int]]:
    """(member, first of its group) of n rows; near(i, left) gives which of the rows not yet reached are linked to i."""
    left, out = np.ones(n, bool), []
    for first in range(n):
        if not left[first]:
            continue
        left[first] = False
        wave = [first]
        for i in wave:
            if not left.any():
                return out
            found = np.flatnonzero(left)[near(i, left)].tolist()
            left[found] = False
            wave += found
            out += [(j, first) for j in found]
    return out


def exact_links(texts: list[bytes]) -> list[tuple[int, int]]:
    hashes, counts = shingles(texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    order = np.lexsort((owner, hashes))
    hashes, owner = hashes[order], owner[order]
    fresh = np.append(True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1]))[: len(order)]
    hashes, owner = hashes[fresh], owner[fresh]
    sizes = np.bincount(owner, minlength=len(texts))
    # texts by shingle, and shingles by text
    first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])[: len(hashes)])
    many = np.diff(np.append(first, len(hashes)))
    code = np.repeat(np.arange(len(first)), many)[np.argsort(owner, kind="stable")]
    begins = np.cumsum(sizes) - sizes

    def near(i, left):
        own = code[begins[i] : begins[i] + sizes[i]]
        n = many[own]
        at = np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        common = np.bincount(owner[at], minlength=len(texts))[left]
        return LIKE[1] * common >= LIKE[0] * (sizes[i] + sizes[left] - common)

    return exact_forest(len(texts), near)


def compared(links):
    """Edges (a, b) between nodes of the same cell, of rows (cell, node, value) sorted by cell."""

    def run(rows):
        key, nodes, values = None, [], []
        found: list[tuple[int, int]] = []

        def close():
            own = {}
            for node, value in zip(nodes, values, strict=True):
                own.setdefault(node, value)
            if len(own) > 1:
                names = list(own)
                found.extend((names[a], names[b]) for a, b in links(list(own.values())))
            nodes.clear()
            values.clear()

        def edges():
            out = pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])
            found.clear()
            return out

        for batch in rows:
            for cell, node, value in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if cell != key:
                    close()
                    key = cell
                nodes.append(node)
                values.append(value)
            if found:
                yield edges()
        close()
        if found:
            yield edges()

    return run


def dealt(members: DataFrame, values: DataFrame, tile: int) -> DataFrame:
    """cell, node and value of the nodes of members(key, node) that share a key, sorted by cell; a key of many nodes is dealt as tile pairs."""
    crowd = members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    tiles = F.ceil(F.col("n") / tile).cast("int")
    rows = members.join(crowd, "key").withColumn("own", F.pmod(F.xxhash64("node"), tiles).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    cell = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    rows = rows.select(cell.alias("cell"), "node").join(values, "node").select("cell", "node", "value")
    return rows.repartition(shuffle_partitions(members), "cell").sortWithinPartitions("cell")


def near_copies(docs: DataFrame, text_col="text", radius: int = WIDE) -> DataFrame:
    """node, root of every text that has a near copy other than itself; node is node_of() the text."""
    texts = docs.select(node_of(text_col).alias("node"), utf8(text_col).alias("value"))
    own = cut(signed(texts).groupBy("node").agg(F.first("fp").alias("value"), F.first("keys").alias("keys")))
    keys = own.select(F.explode("keys").alias("key"), "node")
    loose = components(dealt(keys, own.select("node", "value"), TILE).mapInArrow(loose_links(radius), "a long, b long"))
    members = cut(loose.select(F.col("root").alias("key"), "node"))
    once = texts.groupBy("node").agg(F.first("value").alias("value"))
    return components(dealt(members, once, TEXT_TILE).mapInArrow(compared(exact_links), "a long, b long"))


def one_of_each_near_copy(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """The rows of docs without near copies (likeness 0.8 and more) of rows with smaller ids, see one_of_each()."""
    return one_of_each(docs, cut(near_copies(docs, text_col)), node_of(text_col), id_col)
