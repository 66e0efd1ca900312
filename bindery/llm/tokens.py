"""Token counts of a byte-level BPE with a whole-token shortcut.

Before the scan every vocabulary string is merged once on its own; those that come out as one token are
proven, and a pre-token that is one of them counts 1 without a merge. Only the rest is merged, each
distinct string once while a memo, bounded by strings and by characters, holds it.

Defined cases: null text counts as empty (0 bytes, 0 tokens); special strings inside a text are one token
each, as the tokenizers library has it by default; no other special tokens, truncation or padding;
repeated rows give repeated rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
import json
import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.llm.common import batches

#: Fixed value: the split pattern of this family of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO, MEMO_CHARS, LONG = 800_000, 24 << 20, 64  # strings a task remembers and their characters; longer ones are counted anew
NONE = 1 << 62


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in such vocabularies: itself if visible in Latin-1, else from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class ByteBpe:
    """Ranks of merges of byte strings, the special strings, and the proven whole tokens."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model, pre = spec["model"], spec["pre_tokenizer"]
        plain = pre == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": pre.get("trim_offsets"), "use_regex": True}
        added = spec["added_tokens"]
        if not plain or spec["normalizer"] or model.get("dropout") or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError(f"{path}: only plain byte-level BPE files are taken")
        of = {c: b for b, c in byte_alphabet().items()}
        as_bytes = lambda s: bytes(map(of.__getitem__, s))
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = {as_bytes(v): i for v, i in model["vocab"].items() if all(c in of for c in v)}
        self.first = [ids[bytes([b])] for b in range(256)]
        #: (left id, right id) as one number: (rank, id of the merged string) as one number
        self.merges = {ids[x := as_bytes(a)] << 32 | ids[y := as_bytes(b)]: rank << 32 | ids[x + y] for rank, (a, b) in enumerate(pairs)}
        self.special = re.compile("|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        self.whole = {v for v in ids if self.count(v) == 1}

    def count(self, data: bytes) -> int:
        """Tokens of one pre-token: the lowest rank is merged first, the leftmost of equals."""
        if len(data) > 200:
            return self.count_long(data)
        first, get = self.first, self.merges.get
        part = [first[b] for b in data]
        rank = [get(x << 32 | y, NONE) for x, y in zip(part, part[1:], strict=False)]
        while rank and (best := min(rank)) != NONE:
            i = rank.index(best)
            part[i : i + 2] = [best & 0xFFFFFFFF]
            del rank[i]
            if i:
                rank[i - 1] = get(part[i - 1] << 32 | part[i], NONE)
            if i < len(rank):
                rank[i] = get(part[i] << 32 | part[i + 1], NONE)
        return len(part)

    def count_long(self, data: bytes) -> int:
        """The same by a heap over a linked list, so that one very long pre-token takes n log n steps."""
        get, part = self.merges.get, [self.first[b] for b in data]
        end = n = len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := get(part[i] << 32 | part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if part[i] < 0 or j >= end or get(part[i] << 32 | part[j]) != r:
                continue  # one of the two has been merged since
            part[i], part[j] = r & 0xFFFFFFFF, -1
            after[i] = k = after[j]
            if k < end:
                before[k] = i
                if (r := get(part[i] << 32 | part[k])) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := get(part[h] << 32 | part[i])) is not None:
                heapq.heappush(heap, (r, h))
            n -= 1
        return n


class Counts(dict):
    """Tokens of a pre-token; whole tokens are in it from the start and stay."""

    def __init__(self, bpe: ByteBpe):
        self.bpe, self.start = bpe, {}
        for v in bpe.whole:
            try:
                self.start[v.decode()] = 1
            except UnicodeDecodeError:
                pass  # no text gives this as a pre-token of its own
        super().__init__(self.start)
        self.held = 0

    def __missing__(self, text: str) -> int:
        n = self.bpe.count(text.encode("utf-8", "surrogatepass"))
        if len(text) <= LONG:
            if len(self) > len(self.start) + MEMO or self.held > MEMO_CHARS:
                self.clear()
                self.update(self.start)
                self.held = 0
            self[text] = n
            self.held += len(text)
        return n


@functools.lru_cache(2)
def bpe_of(path: str) -> ByteBpe:
    return ByteBpe(path)


def counter(path: str):
    """text -> number of tokens, with a memo of its own."""
    bpe = bpe_of(path)
    look_up, pieces = Counts(bpe).__getitem__, regex.compile(PATTERN).findall

    def count(text: str) -> int:
        parts = [text] if bpe.special is None else bpe.special.split(text)
        return len(parts) - 1 + sum(sum(map(look_up, pieces(p))) for p in parts)

    return count


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col="doc_id", text_col="text", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row."""

    def run(rows):
        count = counter(tokenizer_path)
        for batch in batches(rows):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = [count(t) for t in texts]
            size = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
