"""Numbers of given widths joined to bytes, many at once."""

from __future__ import annotations

import numpy as np


def joined(values: np.ndarray, widths: np.ndarray, big: bool = True) -> tuple[bytes, int]:
    """Values of up to 57 bits one after the other, from the top of each byte or from the bottom; the bytes, zeros at the end, and the bits."""
    values, widths = np.asarray(values, np.uint64), np.asarray(widths, np.int64)
    values, widths = values[widths > 0], widths[widths > 0]
    ends = np.cumsum(widths)
    total = int(ends[-1]) if len(ends) else 0
    words = np.zeros(total // 64 + 2, np.uint64)
    if total:
        at = ends - widths
        word, within = at >> 6, at & 63
        spare = 64 - within - widths  # below zero: the rest lies in the next word
        over = np.flatnonzero(spare < 0)
        if big:
            here = np.where(spare >= 0, values << np.maximum(spare, 0).astype(np.uint64), values >> np.maximum(-spare, 0).astype(np.uint64))
            rest = values[over] << (64 + spare[over]).astype(np.uint64)
        else:
            here = values << within.astype(np.uint64)
            rest = values[over] >> (64 - within[over]).astype(np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[first]] = np.bitwise_or.reduceat(here, first)
        words[word[over] + 1] |= rest
    return words.astype(">u8" if big else "<u8").tobytes()[: -(-total // 8)], total


class Bits:
    """Bits from the top of each byte; what is put is held until an array comes or the end."""

    def __init__(self):
        self.out, self.held = bytearray(), []

    def put(self, value: int, width: int) -> None:
        self.held.append((value, width))

    def put_all(self, values: np.ndarray, widths: np.ndarray) -> None:
        held = np.array(self.held, np.int64).reshape(-1, 2)
        data, n = joined(np.concatenate([held[:, 0].astype(np.uint64), values]), np.concatenate([held[:, 1], widths]))
        self.out += data[: n // 8]
        self.held = [(data[-1] >> 8 - n % 8, n % 8)] if n % 8 else []

    def end(self) -> bytes:
        data, _ = joined(*(np.array(self.held, np.int64).reshape(-1, 2).T))
        return bytes(self.out + data)
