"""Hashes of sliding character windows, for whole Arrow batches at once, and a bitmap of a fixed size to look hashes up in."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
BITS = 26  # log2 of the bits of a bitmap: 8 MB, whatever the size of the table


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3: a bijection that spreads every bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts one after another, and where each text starts (with the end as the last entry)."""
    joined = "".join(texts).encode("utf-32-le", "surrogatepass")
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    return np.frombuffer(joined, dtype=np.uint32), starts


def window_hashes(texts: list[str], width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the text, position, hash) of every window of ``width`` characters; equal windows have equal hashes."""
    chars, starts = code_points(texts)
    n = len(chars) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    spread = mix(chars.astype(U64) + U64(1 + (seed << 32)))
    h = np.zeros(n, U64)
    step = U64(0x9E3779B97F4A7C15 | 1)
    for k in range(width):
        h = h * step + spread[k : k + n]
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))[:n]
    pos = np.arange(n) - starts[owner]
    inside = pos + width <= np.diff(starts)[owner]
    return owner[inside], pos[inside], mix(h[inside])


def fixed_bitmap(df: DataFrame, hash_: str, bits: int = BITS) -> np.ndarray:
    """A bitmap of 2 ** bits bits with those set that the 64-bit hashes of df fall on. Bits are set in parts of 2 ** 15 by Spark; the driver gets
    2 ** bits / 8 bytes at most."""
    bit = F.col(hash_).bitwiseAND((1 << bits) - 1)
    parts = df.select(F.shiftright(bit, 15).alias("part"), bit.bitwiseAND((1 << 15) - 1).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("map"))
    out = np.zeros((1 << (bits - 15), 1 << 12), dtype=np.uint8)
    for row in parts.toLocalIterator():
        out[row["part"]] = np.frombuffer(row["map"], dtype=np.uint8)
    return out.ravel()


def has_bit(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the 64-bit hashes fall on a bit that is set."""
    bit = h & U64(len(bitmap) * 8 - 1)
    return (bitmap[(bit >> U64(3)).astype(np.int64)] >> (bit & U64(7)).astype(np.uint8)) & np.uint8(1) > 0
