"""Ciphers of archive entries: AES in counter mode (ZIP), AES in CBC mode (7z) and the ZIP stream cipher.

AES works on arrays of blocks at once. CBC encryption chains its blocks, so as a column expression it is the
built-in aes_encrypt on zero-padded data; only the padding that the built-in adds is cut off again.
"""

from __future__ import annotations

import hashlib
import hmac
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PIECE = 4 << 20


def _double(x: int) -> int:
    return x << 1 ^ (0x11B if x & 0x80 else 0)


def _substitution() -> np.ndarray:
    """Inverse in GF(2**8), then the affine map; inverses come from powers of the generator 3."""
    power, log, x = [0] * 255, [0] * 256, 1
    for i in range(255):
        power[i], log[x] = x, i
        x ^= _double(x)
    out = []
    for v in range(256):
        a = power[-log[v] % 255] if v else 0
        wide = a ^ a << 1 ^ a << 2 ^ a << 3 ^ a << 4
        out.append(wide & 255 ^ wide >> 8 ^ 0x63)
    return np.array(out, np.uint8)


SUBST = _substitution()
UNSUBST = np.argsort(SUBST).astype(np.uint8)
DOUBLE = np.array([_double(x) for x in range(256)], np.uint8)
SHIFT = [(4 * (c + r)) % 16 + r for c in range(4) for r in range(4)]
UNSHIFT = np.argsort(SHIFT)


def round_keys(key: bytes) -> np.ndarray:
    n, words, constant = len(key) // 4, [key[i : i + 4] for i in range(0, len(key), 4)], 1
    for i in range(n, 4 * (n + 7)):
        t = words[-1]
        if i % n == 0:
            t = bytes(SUBST[list(t[1:] + t[:1])])
            t = bytes([t[0] ^ constant]) + t[1:]
            constant = _double(constant)
        elif n > 6 and i % n == 4:
            t = bytes(SUBST[list(t)])
        words.append(bytes(a ^ b for a, b in zip(words[i - n], t, strict=True)))
    return np.frombuffer(b"".join(words), np.uint8).reshape(-1, 16)


def _mixed(s: np.ndarray) -> np.ndarray:
    s = s.reshape(-1, 4, 4)
    whole = np.bitwise_xor.reduce(s, axis=2, keepdims=True)
    return (s ^ whole ^ DOUBLE[s ^ np.roll(s, -1, axis=2)]).reshape(-1, 16)


def encrypt_blocks(key: bytes, blocks: np.ndarray) -> np.ndarray:
    """AES of every row of an array of n x 16 bytes."""
    keys = round_keys(key)
    s = blocks ^ keys[0]
    for k in keys[1:-1]:
        s = _mixed(SUBST[s][:, SHIFT]) ^ k
    return SUBST[s][:, SHIFT] ^ keys[-1]


def decrypt_blocks(key: bytes, blocks: np.ndarray) -> np.ndarray:
    """The inverse; mixing a column four times leaves it as it was, so three times undo one."""
    keys = round_keys(key)
    s = blocks ^ keys[-1]
    for k in keys[-2:0:-1]:
        s = _mixed(_mixed(_mixed(UNSUBST[s[:, UNSHIFT]] ^ k)))
    return UNSUBST[s[:, UNSHIFT]] ^ keys[0]


def counter_mode(key: bytes, data: bytes) -> bytes:
    """AES counter mode of ZIP entries: a little-endian counter from 1. It is its own inverse."""
    out = []
    for at in range(0, len(data), PIECE):
        part = np.frombuffer(data[at : at + PIECE], np.uint8)
        n = -(-len(part) // 16)
        counters = np.zeros((n, 2), "<u8")
        counters[:, 0] = np.arange(at // 16 + 1, at // 16 + 1 + n, dtype=np.uint64)
        out.append((part ^ encrypt_blocks(key, counters.view(np.uint8)).ravel()[: len(part)]).tobytes())
    return b"".join(out)


def cbc_decrypted(key: bytes, iv: bytes, data: bytes) -> bytes:
    """CBC without padding rules; zeros that filled the last block stay."""
    blocks = np.frombuffer(data, np.uint8).reshape(-1, 16)
    before = np.vstack([np.frombuffer(iv, np.uint8)[None], blocks[:-1]]) if len(blocks) else blocks
    return (decrypt_blocks(key, blocks) ^ before).tobytes()


def cbc_encrypted(data: Column, key: Column, iv: Column) -> Column:
    """CBC of zero-padded data without IV or extra block, as 7z folders hold it; all JVM-side."""
    padded = F.concat(data, F.unhex(F.repeat(F.lit("00"), F.pmod(-F.octet_length(data), F.lit(16)))))
    return F.substr(F.aes_encrypt(padded, key, F.lit("CBC"), F.lit("PKCS"), iv), F.lit(17), F.octet_length(padded))


def zip_aes(packed: bytes, password: str, salt: bytes) -> bytes:
    """Salt, password check, cipher text and authentication code of one ZIP entry (AES-256, salt of 16 bytes)."""
    keys = hashlib.pbkdf2_hmac("sha1", password.encode(), salt, 1000, 66)
    body = counter_mode(keys[:32], packed)
    return salt + keys[64:] + body + hmac.new(keys[32:64], body, "sha1").digest()[:10]


def zip_aes_opened(data: bytes, password: str) -> bytes:
    keys = hashlib.pbkdf2_hmac("sha1", password.encode(), data[:16], 1000, 66)
    if data[16:18] != keys[64:]:
        raise ValueError("wrong password")
    if not hmac.compare_digest(hmac.new(keys[32:64], data[18:-10], "sha1").digest()[:10], data[-10:]):
        raise ValueError("authentication failed")
    return counter_mode(keys[:32], data[18:-10])


def _crc_step(n: int) -> int:
    for _ in range(8):
        n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
    return n


CRC_STEP = [_crc_step(n) for n in range(256)]


class StreamCipher:
    """The ZIP stream cipher; three keys move with every plain byte, so it is sequential within an entry."""

    def __init__(self, password: bytes):
        self.keys = (0x12345678, 0x23456789, 0x34567890)  # fixed values
        for b in password:
            self.move(b)

    def move(self, b: int) -> None:
        a, m, c = self.keys
        a = a >> 8 ^ CRC_STEP[(a ^ b) & 255]
        m = ((m + (a & 255)) * 134775813 + 1) & 0xFFFFFFFF
        self.keys = a, m, c >> 8 ^ CRC_STEP[(c ^ m >> 24) & 255]

    def apply(self, data: bytes, decrypt: bool = False) -> bytes:
        """Decryption goes byte by byte; the keys of encryption depend on known bytes alone, so all of a piece are found at once."""
        if not decrypt and len(data) >= LANE * 16:
            return b"".join(self.sealed(data[at : at + SPAN]) for at in range(0, len(data), SPAN))
        (a, m, c), step, out = self.keys, CRC_STEP, bytearray()
        for b in data:
            k = c & 0xFFFF | 2
            x = b ^ (k * (k ^ 1) >> 8 & 255)
            out.append(x)
            a = a >> 8 ^ step[(a ^ (x if decrypt else b)) & 255]
            m = ((m + (a & 255)) * 134775813 + 1) & 0xFFFFFFFF
            c = c >> 8 ^ step[(c ^ m >> 24) & 255]
        self.keys = a, m, c
        return bytes(out)

    def sealed(self, data: bytes) -> bytes:
        """The middle key is a linear congruence: a running sum of the steps, each divided by its power of the factor."""
        a, m, c = self.keys
        first = crc_registers(data, a)
        power, inverse = (np.cumprod(np.full(len(data), f, np.uint32), dtype=np.uint32) for f in (134775813, pow(134775813, -1, 1 << 32)))
        steps = ((first & 255) * np.uint32(134775813) + np.uint32(1)) * inverse
        middle = power * (np.uint32(m) + np.cumsum(steps, dtype=np.uint32))
        last = crc_registers((middle >> 24).astype(np.uint8).tobytes(), c)
        k = np.concatenate([np.array([c], np.uint32), last[:-1]]) & 0xFFFF | 2
        self.keys = int(first[-1]), int(middle[-1]), int(last[-1])
        return (np.frombuffer(data, np.uint8) ^ (k * (k ^ 1) >> 8).astype(np.uint8)).tobytes()


#: Bytes a lane, and bytes whose keys are held at once.
LANE, SPAN = 256, 1 << 20
CRC_TABLE = np.array(CRC_STEP, np.uint32)


def crc_registers(data: bytes, start: int) -> np.ndarray:
    """The register of CRC-32 after each byte: lanes run side by side, each from where the one before it ends."""
    starts = [start]
    for at in range(0, len(data) - LANE, LANE):
        starts.append(zlib.crc32(data[at : at + LANE], starts[-1] ^ 0xFFFFFFFF) ^ 0xFFFFFFFF)
    lanes = np.frombuffer(data.ljust(len(starts) * LANE, b"\0"), np.uint8).reshape(-1, LANE)
    register, out = np.array(starts, np.uint32), np.empty((LANE, len(starts)), np.uint32)
    for t in range(LANE):
        register = register >> 8 ^ CRC_TABLE[(register ^ lanes[:, t]) & 255]
        out[t] = register
    return out.T.ravel()[: len(data)]


def zip_stream(packed: bytes, password: str, crc: int, salt: bytes) -> bytes:
    """Twelve bytes of header (eleven of salt and the top byte of the CRC) and the cipher text."""
    return StreamCipher(password.encode()).apply(salt[:11] + bytes([crc >> 24]) + packed)


def zip_stream_opened(data: bytes, password: str, crc: int) -> bytes:
    plain = StreamCipher(password.encode()).apply(data, True)
    if plain[11] != crc >> 24:
        raise ValueError("wrong password")
    return plain[12:]


def entry_salt(secret: bytes, path: str, crc: int) -> bytes:
    """16 bytes that differ between entries; a secret of random bytes is drawn once a write, so retried tasks agree."""
    return hmac.new(secret, path.encode() + crc.to_bytes(4, "little"), "sha256").digest()[:16]


def reencrypted(packed: str, crc: str, salt: str, old: tuple[str, str] | None, new: tuple[str, str] | None) -> Column:
    """Entries under another (cipher, password), None for plain, without compressing anew; ciphers are aes and stream."""

    @F.pandas_udf("binary")
    def run(data: pd.Series, crcs: pd.Series, salts: pd.Series) -> pd.Series:
        def one(d, c, s):
            if d is None:
                return None
            d = bytes(d)
            if old:
                d = zip_aes_opened(d, old[1]) if old[0] == "aes" else zip_stream_opened(d, old[1], int(c))
            if new:
                d = zip_aes(d, new[1], bytes(s)) if new[0] == "aes" else zip_stream(d, new[1], int(c), bytes(s))
            return d

        return pd.Series([one(*r) for r in zip(data, crcs, salts, strict=True)], dtype=object)

    return run(packed, crc, salt)
