"""SentencePiece encoding and decoding (BPE models) by suffix-array matching.

A batch's distinct units of text are laid end to end. A suffix array over them is binary-searched for
every piece of the vocabulary; the ranges found are the piece's occurrences, that is edges from a start
to an end. Edges are ordered by position into a table, and relaxed: in every round each unit applies its
best-ranked edge that joins exactly two of its current symbols, at all its places, until none is left.
That is the model's own merge order, so results equal the library's. The model at hand ranks merges and
has no additive scores, so the relaxation is by rank and not by path length.

Units are runs of spaces with the word after them; at load it is proven that no piece crosses from a
word into a following space, so units are independent. Characters that are no piece become byte pieces.

Defined cases: null text counts as empty and has no pieces; U+2581 in a text is a space, as in the
library; decoding undoes encoding but for that; decoding drops control ids and turns bytes that are no
UTF-8 into U+FFFD; repeated rows give repeated rows; an empty table gives no rows. encode() and decode()
carry the other columns on, whatever their names; coded() ignores them. Units of any length are taken,
one of a single character or of a whole text without spaces.
"""

from __future__ import annotations

import functools
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bindery.llm.common import batches

SPACE, END, NONE = "▁", 0x110000, 1 << 30
CHUNK = 3 << 15  # characters of one suffix array
BATCH = 2 << 20  # bytes of a batch, which pays for a hash table over the memo
MEMO = 700_000  # units a task remembers, about 65 MB
LONG_UNIT, MEMO_BYTES = 48, 160 << 20  # units of more characters are forgotten after their batch


def gathered(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about BATCH bytes: larger ones are sliced, smaller ones joined."""
    held, size = [], 0
    for batch in batches(rows, BATCH):
        if held and size + batch.nbytes > BATCH:
            yield pa.concat_batches(held) if len(held) > 1 else held[0]
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.concat_batches(held)


def released(run):
    """run, after which Arrow gives back what it has freed, since other stages use the worker again."""

    def to_the_end(rows):
        for batch in run(rows):
            yield batch
            del batch
            pa.default_memory_pool().release_unused()
        pa.default_memory_pool().release_unused()

    return to_the_end


def offsets(array: pa.Array) -> np.ndarray:
    """Where the values of a large string or binary array start, and the last one's end, in its buffer."""
    return np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)


def values(array: pa.Array) -> memoryview:
    """The bytes of all values of a large string or binary array, end to end."""
    at = offsets(array)
    return memoryview(array.buffers()[2] or b"")[at[0] : at[-1]]


def parts(array: pa.Array, cuts: np.ndarray) -> Iterator[memoryview]:
    """The bytes of the values between two cuts."""
    at, data = offsets(array), values(array)
    ends = (at - at[0])[cuts].tolist()
    return (data[a:b] for a, b in zip(ends, ends[1:], strict=False))


def sliced(kind: pa.DataType, data: pa.Buffer, at: np.ndarray) -> pa.Array:
    """Array of the slices of data between the offsets."""
    return pa.Array.from_buffers(kind, len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), data])


def joined(array: pa.LargeStringArray, cuts: np.ndarray) -> pa.LargeStringArray:
    """The values between two cuts joined to one."""
    return sliced(pa.large_string(), array.buffers()[2] or pa.py_buffer(b""), offsets(array)[cuts])


def units_of(texts: pa.Array) -> tuple[pa.LargeStringArray, np.ndarray]:
    """Units of all texts, and where those of each start and the last's end: runs of spaces with the word after them, a space put before the text."""
    plain = pc.replace_substring(texts.fill_null("").cast(pa.large_string()), SPACE, " ")
    spaced = pc.binary_join_element_wise(pc.if_else(pc.equal(plain, ""), "", " ").cast(pa.large_string()), plain, pa.scalar("", pa.large_string()))
    at, data = offsets(spaced), np.frombuffer(values(spaced), np.uint8)
    at = at - at[0]
    space = data == ord(" ")
    first = space.copy()
    first[1:] &= ~space[:-1]
    first[at[:-1][np.diff(at) > 0]] = True
    starts = np.flatnonzero(first)
    return sliced(pa.large_string(), pa.py_buffer(data), np.append(starts, len(data))), np.searchsorted(starts, at)


class Model:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        spec, norm = proto.trainer_spec, proto.normalizer_spec
        kinds = {p.type for p in proto.pieces}
        if spec.model_type != 2 or not spec.byte_fallback or spec.treat_whitespace_as_suffix or norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces or kinds - {1, 2, 3, 6}:
            raise ValueError(f"{path}: only BPE models with byte fallback and the identity normalizer are taken")
        self.pieces = [p.piece for p in proto.pieces]
        self.kind = [p.type for p in proto.pieces]
        #: text and decimal number of each id; None where decoding needs more than the piece
        self.plain = [p.piece.replace(SPACE, " ") if p.type == 1 else chr(int(p.piece[3:5], 16)) if p.type == 6 and p.piece < "<0x80" else None for p in proto.pieces]
        self.plain_text = pa.array([p or "" for p in self.plain], pa.large_string())
        self.rest = np.array([p is None for p in self.plain])
        self.decimal = pa.array([f"{i} " for i in range(len(proto.pieces))], pa.large_string())
        self.id = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        of_byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.byte_id = np.array([of_byte[b] for b in range(256)])
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError(f"{path}: pieces cross words")
        scores = Counter(proto.pieces[i].score for p, i in self.id.items() if len(p) > 1)
        order = {score: r for r, score in enumerate(sorted(scores, reverse=True))}
        self.rank = {p: order[proto.pieces[i].score] for p, i in self.id.items() if len(p) > 1}
        self.tied = np.array([order[score] for score, n in scores.items() if n > 1], np.int32)
        self.check_order()
        multi = sorted(p for p in self.id if len(p) > 1)
        self.width = max(map(len, multi))
        grid = np.zeros((len(multi), self.width + 1), np.uint32)
        for i, p in enumerate(multi):
            grid[i, : len(p)] = [ord(c) for c in p]
        self.length = np.array([len(p) for p in multi])
        self.low = grid.view(f"U{self.width + 1}").ravel()
        top = grid.copy()
        top[np.arange(len(multi)), self.length] = END + 1
        self.high = top.view(f"U{self.width + 1}").ravel()
        self.multi_rank = np.array([*(self.rank[p] for p in multi), NONE], np.int32)
        self.multi_id = np.array([self.id[p] for p in multi])
        self.single = np.full(END + 2, -1, np.int32)
        for p, i in self.id.items():
            if len(p) == 1:
                self.single[ord(p)] = i

    def check_order(self) -> None:
        """A piece with a score of its own must be made of better-ranked pieces or characters: then its edges may be applied together."""
        tied = set(self.tied.tolist())
        for p, r in self.rank.items():
            if r in tied:
                continue
            parts = list(p)
            while len(parts) > 2:
                best = min((self.rank.get(a + b, NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if best[0] >= r:
                    raise ValueError(f"merges of {p!r} are not in order of rank")
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            if any(c not in self.id for c in p):
                raise ValueError(f"{p!r} holds a character that is no piece")

    def suffixes(self, codes: np.ndarray) -> np.ndarray:
        """Suffix array of codes as far as the longest piece tells suffixes apart, by prefix doubling."""
        rank, step, n = np.unique(codes, return_inverse=True)[1].astype(np.int64), 1, len(codes)
        while True:
            after = np.zeros(n, np.int64)
            after[: max(0, n - step)] = rank[step:] + 1
            key = rank * (n + 1) + after
            order = np.argsort(key)
            step *= 2
            if step >= self.width:
                return order
            new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            rank = np.empty(n, np.int64)
            rank[order] = new

    def edges(self, codes: np.ndarray) -> np.ndarray:
        """Table by start and length of the number of the piece there, the number after the last where there is none."""
        order = self.suffixes(codes)
        padded = np.concatenate([codes, np.zeros(self.width + 1, np.uint32)])
        windows = np.lib.stride_tricks.sliding_window_view(padded, self.width + 1)[order].view(f"U{self.width + 1}").ravel()
        lo, hi = np.searchsorted(windows, self.low), np.searchsorted(windows, self.high)
        n = hi - lo
        del windows  # the table takes as much
        found = np.flatnonzero(n)
        which = np.repeat(found, n[found])
        at = order[np.arange(len(which)) - np.repeat(np.cumsum(n[found]) - n[found], n[found]) + np.repeat(lo[found], n[found])]
        table = np.full((len(codes), self.width + 1), len(self.length), np.int32)
        table[at, self.length[which]] = which
        return table

    def relax(self, table: np.ndarray, codes: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """start, end and unit of the symbols that are left when no edge joins two of them."""
        start = np.flatnonzero(codes != END)
        end, of = start + 1, unit[start]
        done = []
        while len(start):
            length = end[1:] - start[:-1]
            ok = (of[1:] == of[:-1]) & (length <= self.width)
            rank = np.append(np.where(ok, self.multi_rank[table[start[:-1], np.minimum(length, self.width)]], NONE), NONE)
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            least = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(start)))
            best = np.repeat(least, sizes)
            over = best == NONE
            if over.any():
                done.append((start[over], end[over], of[over]))
                keep = ~over
                start, end, of, rank, best = start[keep], end[keep], of[keep], rank[keep], best[keep]
                if not len(start):
                    break
            hit = np.flatnonzero(rank == best)
            # of hits side by side the first, third, ... apply
            tied = np.isin(best[hit], self.tied)  # of edges that share a score, only a unit's first
            if tied.any():
                hit = hit[~tied | np.append(True, of[hit][1:] != of[hit][:-1])]
            run = np.append(True, np.diff(hit) != 1)
            nth = np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[nth % 2 == 0]
            end[hit] = end[hit + 1]
            keep = np.ones(len(start), bool)
            keep[hit + 1] = False
            start, end, of = start[keep], end[keep], of[keep]
        out = [np.concatenate(x) for x in zip(*done, strict=True)]
        order = np.argsort(out[0])
        return tuple(x[order] for x in out)

    def encode_units(self, units: list[str]) -> list[list[int]]:
        """Piece ids of each unit; a unit has spaces for U+2581."""
        ids, cuts = self.encode_array(pa.array(units, pa.large_string()))
        return [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:], strict=False)]

    def encode_array(self, units: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all units end to end, and where those of each start and the last's end; a unit has spaces for U+2581."""
        lengths = pc.utf8_length(units).to_numpy()
        size, at, ids, sizes = np.cumsum(lengths + 1), 0, [np.empty(0, np.int32)], [np.zeros(1, np.int64)]
        while at < len(units):
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK)))
            flat, n = self._encode(values(units[at:to]), lengths[at:to])
            ids.append(flat)
            sizes.append(n)
            at = to
        return np.concatenate(ids), np.cumsum(np.concatenate(sizes))

    def _encode(self, text: memoryview, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of the units that text is cut into by lengths in characters, and their number in each."""
        chars = np.frombuffer(str(text, "utf-8").encode("utf-32-le"), np.uint32)
        n = len(lengths)
        codes = np.full(len(chars) + n - 1, END, np.uint32)  # a unit may hold NUL itself
        codes[np.arange(len(chars)) + np.repeat(np.arange(n), lengths)] = np.where(chars == ord(" "), ord(SPACE), chars)
        unit = np.repeat(np.arange(n), lengths + 1)[: len(codes)]
        table = self.edges(codes)
        start, end, of = self.relax(table, codes, unit)
        ids = np.where(end - start > 1, self.multi_id[np.minimum(table[start, end - start], len(self.multi_id) - 1)], self.single[codes[start]])
        other = ids < 0
        if other.any():
            char = codes[start[other]]
            width = np.ones(len(ids), np.int64)
            width[other] = 1 + (char > 0x7F) + (char > 0x7FF) + (char > 0xFFFF)
            ids, other, of = np.repeat(ids, width), np.repeat(other, width), np.repeat(of, width)
            ids[other] = self.byte_id[np.frombuffer(char.tobytes().decode("utf-32-le").encode(), np.uint8)]
        return ids.astype(np.int32), np.bincount(of, minlength=n)

    def decode_array(self, ids: np.ndarray, cuts: np.ndarray) -> pa.LargeStringArray:
        """The text of each list of ids, which cuts part, with the dummy space at its start."""
        texts = joined(self.plain_text.take(pa.array(ids)), cuts)
        rest = np.unique(np.searchsorted(cuts, np.flatnonzero(self.rest[ids]), "right") - 1)
        if not len(rest):
            return texts
        which = np.arange(len(texts))
        which[rest] = len(texts) + np.arange(len(rest))
        other = pa.array([self.decode(ids[cuts[k] : cuts[k + 1]].tolist()) for k in rest.tolist()], pa.large_string())
        return pa.concat_arrays([texts, other]).take(pa.array(which))

    def decode(self, ids: list[int]) -> str:
        """The text of ids, with the dummy space at its start."""
        try:
            return "".join(map(self.plain.__getitem__, ids))
        except TypeError:
            pass  # bytes or control ids
        out, raw = [], bytearray()
        for i in [*ids, -1]:
            kind = self.kind[i] if i >= 0 else 0
            if kind == 6:
                raw.append(int(self.pieces[i][3:5], 16))
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if kind == 1:
                out.append(self.pieces[i].replace(SPACE, " "))
            elif kind == 2:
                out.append(" ⁇ ")
        return "".join(out)


class Coder:
    """Encodes texts by batches; a memo of units with ids (as int32 bytes), their decoded text and, to spell, their decimal ids, each with a space after it.

    One is made for every task and goes with it, so a reused worker holds no more than the model. The memo is bounded by
    units and by bytes; long units, such as texts without spaces, are held for their batch only. All of it is Arrow
    arrays: a batch's units are numbered by one hash table over the memo and the batch, and results are taken by number.
    """

    def __init__(self, model: Model, spell: bool = False):
        self.model, self.spell = model, spell
        self.known = self.text = self.spelled = pa.array([], pa.large_string())
        self.coded, self.kept = pa.array([], pa.large_binary()), 0

    @property
    def at(self) -> dict[str, int]:
        return {u: i for i, u in enumerate(self.known.to_pylist())}

    @property
    def ids(self) -> list[bytes]:
        return self.coded.to_pylist()

    def numbers(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Numbers in the memo of all texts' units, and where those of each text start and the last's end. They hold until forget()."""
        if len(self.known) > MEMO or self.known.nbytes + self.text.nbytes + self.spelled.nbytes + self.coded.nbytes > MEMO_BYTES:
            self.__init__(self.model, self.spell)
        units, cuts = units_of(texts)
        self.kept = len(self.known)
        if not len(units):
            return pa.array([], pa.int32()), cuts
        found = pa.chunked_array([self.known, units]).dictionary_encode().chunks[-1]
        at, new = found.indices, found.dictionary[len(self.known) :]
        long = pc.greater(pc.utf8_length(new), LONG_UNIT).to_numpy(zero_copy_only=False)
        if long.any():  # they come last, to be forgotten
            order = np.argsort(long, kind="stable")
            number = np.arange(len(self.known) + len(new), dtype=np.int32)
            number[len(self.known) + order] = len(self.known) + np.arange(len(new))
            at, new = pa.array(number[at.to_numpy()]), new.take(pa.array(order))
        self.kept += len(new) - int(long.sum())
        if len(new):
            ids, ends = self.model.encode_array(new)
            self.known = pa.concat_arrays([self.known, new])
            self.coded = pa.concat_arrays([self.coded, sliced(pa.large_binary(), pa.py_buffer(ids), 4 * ends)])
            if self.spell:
                self.text = pa.concat_arrays([self.text, self.model.decode_array(ids, ends)])
                self.spelled = pa.concat_arrays([self.spelled, joined(self.model.decimal.take(pa.array(ids)), ends)])
        return at, cuts

    def forget(self) -> None:
        """Forgets the long units of the last batch."""
        if len(self.known) > self.kept:
            # copies, as a slice would hold the long ones
            self.known, self.coded, self.text, self.spelled = (pa.concat_arrays([x[: self.kept], x[:0]]) for x in (self.known, self.coded, self.text, self.spelled))

    def units(self, texts: list[str]):
        """Numbers in the memo of each text's units, text by text."""
        at, cuts = self.numbers(pa.array(texts, pa.string()))
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield at[a:b].to_pylist()
        self.forget()


@functools.lru_cache(2)
def model_of(path: str) -> Model:
    return Model(path)


def with_column(docs: DataFrame, source: str, name: str, kind: T.DataType, of) -> DataFrame:
    """All columns of docs but one called `name`, in their order, and `name`: of(column of source, batch by batch).

    Columns travel under numbers, so no name of the input can clash with one of the operator.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = docs.toDF(*names)
    kept = [(n, c) for n, c in zip(names, docs.columns, strict=True) if c != name]
    rows = own.select(*[n for n, _ in kept], F.col(names[docs.columns.index(source)]).alias("source"))

    def run(rows_):
        convert = of()
        for batch in gathered(rows_):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], convert(batch.column(batch.num_columns - 1))], names=[*batch.schema.names[:-1], "result"])

    out = rows.mapInArrow(released(run), T.StructType([*rows.schema.fields[:-1], T.StructField("result", kind)]))
    return out.toDF(*[c for _, c in kept], name)


def encode(docs: DataFrame, model_path: str, text_col="text", ids_col="piece_ids") -> DataFrame:
    """All columns of docs and the piece ids of its text; a column that has the name of ids_col is replaced."""

    def of():
        own = Coder(model_of(model_path))

        def convert(texts):
            at, cuts = own.numbers(texts)
            coded_ = own.coded.take(at)
            own.forget()
            return pa.ListArray.from_arrays(pa.array((offsets(coded_)[cuts] // 4).astype(np.int32)), pa.array(np.frombuffer(values(coded_), np.int32)))

        return convert

    return with_column(docs, text_col, ids_col, T.ArrayType(T.IntegerType()), of)


def decode(docs: DataFrame, model_path: str, ids_col="piece_ids", text_col="decoded") -> DataFrame:
    """All columns of docs and the text of its ids (null ids: null); a column that has the name of text_col is replaced."""

    def of():
        model = model_of(model_path)
        return lambda lists: pa.array([None if ids is None else model.decode(ids).removeprefix(" ") for ids in lists.to_pylist()], pa.string())

    return with_column(docs, ids_col, text_col, T.StringType(), of)


def coded(docs: DataFrame, model_path: str, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_pieces, ids_sha256 (decimal ids joined by spaces), decoded_sha256 and round_trip of every row."""

    def run(rows):
        own = Coder(model_of(model_path), spell=True)
        for batch in gathered(rows):
            texts = batch.column(1).fill_null("").cast(pa.large_string())
            at, cuts = own.numbers(texts)
            numbers, back = own.spelled.take(at), own.text.take(at)
            n = np.diff(np.concatenate([[0], np.cumsum((np.diff(offsets(own.coded)) // 4)[at])])[cuts])
            own.forget()
            digests, decoded, same = [], [], []
            for text, plain, spelled in zip(parts(texts, np.arange(len(texts) + 1)), parts(back, cuts), parts(numbers, cuts), strict=True):
                digests.append(hashlib.sha256(spelled[:-1]).hexdigest())
                plain = bytes(plain).removeprefix(b" ")
                decoded.append(hashlib.sha256(plain).hexdigest())
                same.append(plain == bytes(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests), pa.array(decoded), pa.array(same)], names=["doc_id", "n_pieces", "ids_sha256", "decoded_sha256", "round_trip"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(released(run), "doc_id long, n_pieces long, ids_sha256 string, decoded_sha256 string, round_trip boolean")
