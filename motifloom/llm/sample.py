"""Reproducible sample that stays as data grows (problem 3): randomised block selection.

Persistent sequence numbers are cut into fixed blocks of a prime number B of places. A keyed hash of (seed, block number) alone
gives two numbers a in 1..B-1 and c in 0..B-1; the chosen places p of the block are those with (a * p + c) mod B < k. As B is
prime this is a permutation of the places, so exactly k places of every block are chosen in advance, filled or not, and the choice of two
places is pairwise independent. Whether a row is chosen depends on its number and the seed only: not on the other rows, their order,
files or partitions. It is one JVM-side filter without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifloom.operators.skew import normal_word
from motifloom.session import read

BLOCK = 1009


def chosen(seq: Column, k: int, block: int = BLOCK, seed: str = "s1") -> Column:
    """Whether sequence number seq (>= 0) is chosen: k places of every ``block`` (a prime)."""
    if block < 2 or any(block % d == 0 for d in range(2, int(block**0.5) + 1)):
        raise ValueError("block must be a prime")
    if not 0 <= k <= block:
        raise ValueError("k must lie in 0..block")
    seq = seq.cast("long")
    digest = F.md5(F.concat(F.lit(seed + ":"), F.floor(seq / block).cast("string")))
    part = lambda at: F.conv(F.substring(digest, at, 12), 16, 10).cast("long")
    a, c = part(1) % (block - 1) + 1, part(13) % block
    return (a * (seq % block) + c) % block < k


def block_sample(df: DataFrame, seq: str, k: int, block: int = BLOCK, seed: str = "s1") -> DataFrame:
    """The rows of df whose ``seq`` is chosen; a sample of the share k / block.

    Rows with a null or negative seq are never chosen. Rows that repeat a number are chosen together. Other columns pass unchanged.
    """
    return df.filter(F.col(seq).isNotNull() & (F.col(seq) >= 0)).filter(chosen(F.col(seq), k, block, seed))


def sample_words(words: DataFrame, k: int = 101, block: int = BLOCK, seed: str = "s1") -> DataFrame:
    """(word_id, word, first_batch) of the sampled words: the normalised non-null word and the first batch that has it.

    Ids without a word in any row are left out. A word chosen from the batches up to b is chosen with any later ones too.
    """
    rows = block_sample(words, "word_id", k, block, seed).filter(F.col("word").isNotNull())
    return rows.groupBy("word_id").agg(F.min(normal_word()).alias("word"), F.min("batch_id").alias("first_batch"))


def p3_sample(spark, sf_dir):
    return sample_words(read(spark, sf_dir, "words"))


QUERIES = {"p3_sample": p3_sample}

SQL = {
    "p3_sample": """
with h as (select *, md5('s1:' || cast(word_id // 1009 as varchar)) d from words where word_id >= 0 and word is not null)
select word_id, min(upper(trim(word))) word, min(batch_id) first_batch from h
where ((cast('0x' || substr(d, 1, 12) as bigint) % 1008 + 1) * (word_id % 1009) + cast('0x' || substr(d, 13, 12) as bigint) % 1009) % 1009 < 101
group by 1"""
}
