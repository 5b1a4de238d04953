"""Filling fixed-capacity containers with items (problem 8): shortest-pack-first over the length histogram.

Only the histogram of lengths, of at most ``capacity`` entries, comes to the driver. Lengths are placed longest first; each goes to
the open packs with the most room left, many equal packs at once, and what is kept is the number of packs of every
packing pattern. Patterns are joined back to the items by their rank among the items of the same length; ranks are counted in
two levels (shard, place in the shard), so that a length that a third of all items have is spread over many tasks.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motifloom.session import cut, read

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CAPACITY = 2048
RANKS_PER_SHARD = 100_000

# Fixed value: how the public byte-level BPE vocabulary splits a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _encoding(name: str):
    """The vocabulary that ``token_counts`` has sent to this worker."""
    import tiktoken

    with open(SparkFiles.get(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, id_: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, n_tokens) of every record with a text; tokenizer: path of a .tiktoken vocabulary that the driver can read and sends to the workers."""
    df.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(t) for t in _encoding(name).encode_ordinary_batch(texts.tolist(), num_threads=1)], dtype="int64")

    rows = df.select(F.col(id_).alias("id"), F.col(text).alias("text")).dropna()
    return rows.select("id", count("text").alias("n_tokens"))


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(number of packs, {length: items of it in each pack}) of every pattern; lengths lie in 1..capacity.

    Room left is looked up from the largest down, and a length goes to the packs with the most room, which are the shortest.
    """
    open_: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    heap: list[int] = []  # rooms that are open, as negative numbers; may hold emptied ones

    def put(room: int, packs: int, pattern: tuple[int, ...]) -> None:
        if not open_[room]:
            heapq.heappush(heap, -room)
        open_[room].append((packs, pattern))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while heap and not open_[-heap[0]]:
                heapq.heappop(heap)
            room = -heap[0] if heap else 0
            if room < length:
                each = capacity // length if length * 2 <= capacity else 1
                full = left // each
                if full:  # so many new packs hold nothing but this length
                    put(capacity - each * length, full, (length,) * each)
                if rest := left - full * each:
                    put(capacity - rest * length, 1, (length,) * rest)
                left = 0
                continue
            packs, pattern = open_[room].pop()
            fit = min(packs, left // (room // length)) if left >= room // length else 0
            if fit:  # these packs take as many of this length as they have room for
                put(room - (room // length) * length, fit, pattern + (length,) * (room // length))
                left -= fit * (room // length)
                if packs > fit:
                    put(room, packs - fit, pattern)
            else:
                put(room - left * length, 1, pattern + (length,) * left)
                if packs > 1:
                    put(room, packs - 1, pattern)
                left = 0
    merged: dict[tuple[int, ...], int] = defaultdict(int)
    for groups in open_.values():
        for packs, pattern in groups:
            merged[pattern] += packs
    out = []
    for pattern in sorted(merged, reverse=True):
        held: dict[int, int] = defaultdict(int)
        for length in pattern:
            held[length] += 1
        out.append((merged[pattern], dict(held)))
    return out


def pack_windows(lengths: DataFrame, id_: str, n: str, capacity: int = CAPACITY, ranks_per_shard: int = RANKS_PER_SHARD) -> DataFrame:
    """(id, piece, piece_start, n_tokens, window_id, window_offset): which window holds which tokens of every item.

    An item longer than ``capacity`` is cut into full pieces and a rest (piece 0, 1, ...), any other stays whole. Nulls and lengths
    below 1 give no rows. Ids are unique; the same input gives the same windows for every layout of the files.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    spark = lengths.sparkSession
    items = lengths.select(F.col(id_).alias("id"), F.col(n).cast("long").alias("n")).dropna().filter("n > 0")
    pieces = items.withColumn("piece", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / capacity).cast("int") - 1)))
    start = F.col("piece").cast("long") * capacity
    pieces = pieces.select("id", "piece", start.alias("piece_start"), F.least(F.col("n") - start, F.lit(capacity)).cast("int").alias("len"))
    pieces = cut(pieces)
    histogram = {r["len"]: r["c"] for r in pieces.groupBy("len").agg(F.count(F.lit(1)).alias("c")).collect()}  # at most capacity rows
    slots, base, used = [], 0, defaultdict(int)
    for packs, held in shortest_pack_first(histogram, capacity):
        offset = 0
        for length, each in held.items():
            slots.append((length, used[length], base, each, offset))
            used[length] += packs * each
            offset += length * each
        base += packs
    place_of = _placer(np.array(sorted(slots), dtype=np.int64).reshape(-1, 5))
    shards = max(1, -(-max(histogram.values(), default=0) // ranks_per_shard))
    sharded = pieces.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
    sizes = sharded.groupBy("len", "shard").agg(F.count(F.lit(1)).alias("c"))
    earlier = Window.partitionBy("len").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("len", "shard", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("len", "shard").orderBy("id", "piece")) - 1
    ranked = sharded.withColumn("place", place).join(sizes, ["len", "shard"]).withColumn("rank", F.col("before") + F.col("place"))
    found = ranked.withColumn("at", place_of("len", "rank"))
    return found.select("id", "piece", "piece_start", F.col("len").alias("n_tokens"), F.col("at.window_id").alias("window_id"), F.col("at.window_offset").alias("window_offset"))


def _placer(slots: np.ndarray):
    """A function of (len, rank): window and offset of the item of that rank among those of its length. slots (len, first rank, first window, items in each window,
    offset) are in order; there is one row a pattern and length, however many items there are, and each rank finds its row by binary search."""
    length, first, base, each, offset = slots.T
    by_len = np.searchsorted(length, np.arange(length.max(initial=0) + 2))

    @F.pandas_udf("window_id long, window_offset int")
    def place(n: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, rank = n.to_numpy(), rank.to_numpy()
        lo, hi = by_len[n], by_len[n + 1]
        while (lo + 1 < hi).any():  # the last slot of the length that begins at the rank or before
            mid = (lo + hi) // 2
            below = first[mid] <= rank
            lo, hi = np.where(below, mid, lo), np.where(below, hi, np.maximum(mid, lo + 1))
        k = rank - first[lo]
        return pd.DataFrame({"window_id": base[lo] + k // each[lo], "window_offset": (offset[lo] + k % each[lo] * n).astype("int32")})

    return place


def packed_documents(spark, sf_dir, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    counts = cut(token_counts(read(spark, sf_dir, "documents"), "doc_id", "text", tokenizer))
    return pack_windows(counts, "id", "n_tokens", capacity).withColumnRenamed("id", "doc_id")


def p8_windows(spark, sf_dir):
    return packed_documents(spark, sf_dir)


def p8_fill(spark, sf_dir):
    """Windows by how full they are, in steps of five per cent."""
    w = packed_documents(spark, sf_dir).groupBy("window_id").agg(F.sum("n_tokens").alias("t"))
    w = w.groupBy(F.floor(F.col("t") * 20 / CAPACITY).alias("twentieths")).agg(F.count(F.lit(1)).alias("n_windows"), F.sum("t").alias("n_tokens"))
    return w.select(F.col("twentieths").cast("int").alias("twentieths"), "n_windows", "n_tokens")


QUERIES = {"p8_windows": p8_windows, "p8_fill": p8_fill}
SQL: dict[str, str] = {}
