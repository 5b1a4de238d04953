"""Top N items within every group (problem 7): partition lower bounds.

1. Each task reads its partition in Arrow batches and finds, for every group with N items or more in it, the N-th best: at least N items of the
   group are as good, so it is a lower bound for the group. Only bounds leave the task, one row a group.
2. The largest bound of each group is taken, and those of the groups with the most rows (at most ``PRUNED_GROUPS``) meet all rows in a broadcast,
   before anything is shuffled; what is worse than its group's bound is dropped there. Bounds follow the whole order, score and
   then item, so equal scores are cut as well.
3. The survivors are shuffled once, by group, and ranked. A group with a third of all rows sends little more than its N best; groups that
   aren't among the largest go as they are, and no task has to hold more of them than of the largest that was left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motifloom.llm.neighbor_rows import resolved_neighbors
from motifloom.session import read

BUFFER_ROWS = 1_000_000
PRUNED_GROUPS = 100_000


def _best(group: np.ndarray, item: np.ndarray, score: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """Of the rows: one for each (group, item), with its highest score, and of these the n best of each group, with their rank."""
    order = np.lexsort((-score, item, group))
    group, item, score = group[order], item[order], score[order]
    new = np.ones(len(group), dtype=bool)
    new[1:] = (group[1:] != group[:-1]) | (item[1:] != item[:-1])
    group, item, score = group[new], item[new], score[new]
    order = np.lexsort((item, -score, group))
    group, item, score = group[order], item[order], score[order]
    first = np.ones(len(group), dtype=bool)
    first[1:] = group[1:] != group[:-1]
    starts = np.flatnonzero(first)
    rank = np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))
    keep = rank < n
    return group[keep], item[keep], score[keep], rank[keep]


def _bounds(n: int):
    """Per buffer of rows (g, i, s): (g, s, i, rows) with the N-th best of every group that has N items there, and the group's rows."""

    def bounds(held):
        g, i, s = (np.concatenate([h[k] for h in held]) for k in range(3))
        group, item, score, rank = _best(g, i, s, n)
        last = rank == n - 1
        names, size = np.unique(g, return_counts=True)
        size = size[np.searchsorted(names, group[last])]
        return pa.RecordBatch.from_arrays([pa.array(group[last]), pa.array(score[last]), pa.array(item[last]), pa.array(size)], names=["g", "s", "i", "rows"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)))
                size += batch.num_rows
            if size > BUFFER_ROWS:
                yield bounds(held)
                held, size = [], 0
        if held:
            yield bounds(held)

    return run


def survivors(clean: DataFrame, n: int, groups: int = PRUNED_GROUPS) -> DataFrame:
    """The rows (g, i, s) that aren't worse than the bound of their group, where it is one of the ``groups`` with the most rows."""
    local = clean.mapInArrow(_bounds(n), "g long, s double, i long, rows long")
    best = local.groupBy("g").agg(F.max(F.struct("s", (-F.col("i")).alias("i"))).alias("b"), F.sum("rows").alias("rows"))
    largest = best.orderBy(F.desc("rows"), "g").limit(groups).select("g", F.col("b.s").alias("bs"), (-F.col("b.i")).alias("bi"))
    good = F.col("bs").isNull() | (F.col("s") > F.col("bs")) | ((F.col("s") == F.col("bs")) & (F.col("i") <= F.col("bi")))
    return clean.join(F.broadcast(largest), "g", "left").filter(good).select("g", "i", "s")


def top_n(df: DataFrame, group: str, item: str, score: str, n: int = 5, groups: int = PRUNED_GROUPS) -> DataFrame:
    """(group, item, score, rank) of the n items with the highest score in every group, all if fewer; ties go to the smaller item.

    group and item are whole numbers. An item listed more than once in a group counts once, with its highest score. Rows with a
    null in any of the three, or a NaN score, are left out; n < 1 and an empty table give no rows; other columns are ignored.
    df is read twice.
    """
    clean = df.select(F.col(group).cast("long").alias("g"), F.col(item).cast("long").alias("i"), F.col(score).cast("double").alias("s"))
    clean = clean.dropna().filter(~F.isnan("s") & F.lit(n >= 1))
    once = survivors(clean, max(n, 1), groups).repartition("g").groupBy("g", "i").agg(F.max("s").alias("s"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("s"), "i"))).filter(F.col("rank") <= n)
    kinds = {c: df.schema[c].dataType for c in (group, item, score)}
    return ranked.select(
        F.col("g").cast(kinds[group]).alias(group), F.col("i").cast(kinds[item]).alias(item), F.col("s").cast(kinds[score]).alias(score), "rank"
    )


def top_listing_words(spark, sf_dir, n: int = 5) -> DataFrame:
    """For every neighbor_id in words, the n words that list it with the highest scores; self listings don't count."""
    rows = resolved_neighbors(spark, sf_dir).filter(F.col("word_id") != F.col("neighbor_id"))
    known = read(spark, sf_dir, "words").select(F.col("word_id").alias("neighbor_id")).dropna().distinct()
    return top_n(rows, "neighbor_id", "word_id", "score", n).join(known, "neighbor_id", "left_semi")


def p7_found(spark, sf_dir):
    return top_listing_words(spark, sf_dir).select("neighbor_id", "word_id")


def p7_ranked(spark, sf_dir):
    return top_listing_words(spark, sf_dir).select("neighbor_id", "word_id", F.col("score").cast("double").alias("score"), F.col("rank").cast("int").alias("rank"))


QUERIES = {"p7_found": p7_found, "p7_ranked": p7_ranked}

RESOLVED = """
p as (select word_id, indptr, lead(indptr, 1, 9223372036854775807) over (order by word_id) nxt from word_ptr where word_id is not null and indptr is not null),
r as (select coalesce(n.word_id, p.word_id) word_id, n.neighbor_id, n.score from neighbors n
      left join p on n.word_id is null and n.edge_pos >= p.indptr and n.edge_pos < p.nxt)"""
_SQL = f"""
with {RESOLVED},
b as (select neighbor_id, word_id, max(cast(score as double)) score from r
      where neighbor_id in (select word_id from words) and word_id <> neighbor_id and score is not null and not isnan(score) group by 1, 2)
select neighbor_id, word_id{{more}} from (select *, row_number() over (partition by neighbor_id order by score desc, word_id) rk from b) where rk <= 5"""
SQL = {"p7_found": _SQL.format(more=""), "p7_ranked": _SQL.format(more=", score, cast(rk as int) rank")}
