"""Work on keys of which a few hold most rows.

``salted_key_stats`` is the two-stage salted aggregation (problem 2), ``lookup_join`` the join of skewed rows with a table that has one row
a key. A key is hot by its share of all rows, so there are at most as many hot keys as the share allows, whatever the table's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 512  # a key is hot from this part of all rows on, so at most so many keys are


def normal_frag(c: str | Column = "frag_id") -> Column:
    """A frag_id as it is compared: trimmed, in lower case."""
    return F.lower(F.trim(F.col(c) if isinstance(c, str) else c))


def normal_word(c: str | Column = "word") -> Column:
    """A word as it is compared: trimmed, in upper case."""
    return F.upper(F.trim(F.col(c) if isinstance(c, str) else c))


def hot_keys(df: DataFrame, key: str, least_rows: int = 50_000, share: int = HOT_SHARE) -> list:
    """The keys that hold at least one in ``share`` of all rows with a key, and ``least_rows`` rows or more; so at most ``share`` keys.

    Counts are combined before the shuffle; the driver gets ``share`` rows at most, whatever the size of df.
    """
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least_rows)
    top = counts.orderBy(F.desc("_n"), key).limit(share).collect()  # the limit cuts off no key that has the share
    if not top:
        return []
    total = df.select(key).count()
    return [r[0] for r in top if r["_n"] * share >= total]


def lookup_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", least_rows: int = 50_000, hot: list | None = None) -> DataFrame:
    """Join left, whose keys may be skewed, with right, which has one row a key at most.

    Rows of hot keys stay where they are and meet a broadcast of the rows that right has for them, at most one a hot key; all others are
    shuffled by key. how: inner, left, left_semi or left_anti. A null key matches nothing. hot: the hot keys, if the caller knows them, say from
    a base table that is cheaper to count in; else left is computed once more to count its keys, so cut it first where it is dear.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"lookup_join can't do {how}")
    hot = hot_keys(left, key, least_rows) if hot is None else hot
    nulls = left.filter(F.col(key).isNull())
    known = left.filter(F.col(key).isNotNull())
    keep_nulls = how in ("left", "left_anti")
    if not hot:
        return left.join(right, key, how) if keep_nulls else known.join(right, key, how)
    is_hot = F.col(key).isin(hot)
    out = known.filter(~is_hot).join(right, key, how).unionByName(known.filter(is_hot).join(F.broadcast(right.filter(is_hot)), key, how))
    return out.unionByName(nulls.join(right.limit(0), key, how)) if keep_nulls else out


def in_block_pairs(df: DataFrame, key: list[str], member: str, size: str, split: int) -> DataFrame:
    """df for a self-join on ``key`` in which no task gets a whole large group: with _p, _q and _b to be joined on together with the key.

    A group of ``size`` (a column) members is cut into ceil(size / split) blocks by a hash of ``member``; _b is a row's block, and the row
    comes out once for every pair (_p, _q) of blocks that has it. Rows of one block meet where _p = _q only: see ``once_in_blocks``.
    """
    blocks = F.greatest(F.ceil(F.col(size) / split), F.lit(1)).cast("int")
    cut_up = df.withColumn("_n", blocks).withColumn("_b", F.pmod(F.xxhash64(*key, member), F.col("_n")).cast("int"))
    every = cut_up.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return every.withColumns({"_p": F.least("_b", "_o"), "_q": F.greatest("_b", "_o")}).drop("_n", "_o")


def once_in_blocks(x: str, y: str) -> Column:
    """Condition on a self-join of ``in_block_pairs`` (x, y: the columns with _b of the two sides) that keeps every pair of rows once."""
    return (F.col("_p") == F.col("_q")) | (F.col(x) != F.col(y))


def fair_share(n_rows: int, partitions: int) -> int:
    """A quarter of the rows that each of the partitions would have."""
    return max(1, -(-n_rows // (4 * partitions)))


def heavy_salts(rows: DataFrame, key: list[str], rows_per_salt: int) -> DataFrame:
    """(key, _salts) of the keys with more than ``rows_per_salt`` rows: one salt for each so many rows begun."""
    heavy = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows_per_salt)
    return heavy.select(*key, F.ceil(F.col("_n") / rows_per_salt).cast("int").alias("_salts"))


def salted_key_stats(df: DataFrame, key: list[str], partner: str, pos: str, rows_per_salt: int | None = None) -> DataFrame:
    """Rows, distinct partners, first and last pos of every key, in two stages.

    Every key with more than ``rows_per_salt`` rows is heavy and gets ceil(rows / rows_per_salt) salts; without one given it is a quarter of
    a shuffle partition's fair share, so a key is split before it can make a task longer than the others, and there are at most
    four times as many heavy keys as partitions. The salt is a hash of the partner: it spreads like a random one, is the same when a lost task
    runs again, and keeps a partner in one salt, so that distinct partners of the salts add up. Stage 1 shuffles the rows once, by (key, salt),
    and aggregates there; stage 2 merges the salts of a key, one row each.

    Nulls: rows with a null in ``key`` are left out; null partners and positions count as rows only. Repeated rows count in
    ``n_rows`` each time. An empty input gives an empty result. Result: key columns, n_rows, n_partners, first_pos, last_pos.
    """
    spark = df.sparkSession
    rows = df.select(*key, F.col(partner).alias("_partner"), F.col(pos).alias("_pos")).dropna(subset=key)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows_per_salt = fair_share(df.count(), partitions) if rows_per_salt is None else rows_per_salt
    heavy = heavy_salts(rows, key, rows_per_salt)
    salt = F.when(F.col("_salts") > 1, F.pmod(F.xxhash64(F.lit("salt"), "_partner"), F.col("_salts"))).otherwise(F.lit(0)).cast("int")
    salted = rows.join(F.broadcast(heavy), key, "left").withColumn("_salt", salt).repartition(partitions, *key, "_salt")
    by_partner = salted.groupBy(*key, "_salt", "_partner").agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_lo"), F.max("_pos").alias("_hi"))
    partial = by_partner.groupBy(*key, "_salt").agg(
        F.sum("_n").alias("_n"), F.count("_partner").alias("_d"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")
    )
    return partial.groupBy(*key).agg(
        F.sum("_n").alias("n_rows"), F.sum("_d").alias("n_partners"), F.min("_lo").alias("first_pos"), F.max("_hi").alias("last_pos")
    )


def frag_word_key_stats(word_frags: DataFrame, rows_per_salt: int | None = None) -> DataFrame:
    """``salted_key_stats`` of both keys of word_frags at once: (key_kind, key_value, n_rows, n_partners, first_pos, last_pos)."""
    frag, word = normal_frag(), F.col("word_id").cast("string")
    both = word_frags.select(
        "pos",
        F.explode(
            F.array(
                F.struct(F.lit("frag").alias("key_kind"), frag.alias("key_value"), word.alias("partner")),
                F.struct(F.lit("word").alias("key_kind"), word.alias("key_value"), frag.alias("partner")),
            )
        ).alias("k"),
    ).select("k.*", "pos")
    return salted_key_stats(both, ["key_kind", "key_value"], "partner", "pos", rows_per_salt)


def dominant_keys(word_frags: DataFrame, percent: float = 3.0, rows_per_salt: int | None = None) -> DataFrame:
    """Keys that hold at least ``percent`` of all rows, rows with null keys included in the total."""
    total = word_frags.agg(F.count(F.lit(1)).alias("total"))
    stats = frag_word_key_stats(word_frags, rows_per_salt)
    n = total.first()["total"]
    return stats.filter(F.col("n_rows") * F.lit(100.0) >= F.lit(float(percent) * n)).select("key_kind", "key_value")
