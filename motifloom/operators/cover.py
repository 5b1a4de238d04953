"""Rules against words: pattern joins, the negative pool, and the greedy cover."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motifloom.functions.rules import hits
from motifloom.operators.skew import lookup_join
from motifloom.session import cut, spread

TILE = 4096


def rule_hits(rules: DataFrame, words: DataFrame, group: str, tile: int = TILE) -> DataFrame:
    """(group, rid, ord): the words (group, ord, word) that match the rules (group, rid, regex, exact) of their group as a whole.

    A rule without wildcards (``exact`` holds its only word, else null) is an equi-join. The others meet the words in tiles of at
    most about ``tile`` rules and ``tile`` words, each scanned by one task, so no task gets a whole large group; rows of large groups stay where they
    are until they have a tile. rules and words are read more than once: cut them first.
    """
    same = rules.filter(F.col("exact").isNotNull()).select(group, "rid", F.col("exact").alias("word")).join(words, [group, "word"]).select(group, "rid", "ord")
    wild = rules.filter(F.col("exact").isNull()).select(group, "rid", "regex")
    n_words = words.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("wt"))
    n_rules = wild.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("rt"))
    tiles = n_words.join(n_rules, group)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    r = lookup_join(wild, tiles, group, least_rows=tile).withColumn("rb", F.pmod(F.hash("rid"), F.col("rt"))).withColumn("wb", each("wt")).select(group, "wb", "rb", "rid", "regex")
    w = lookup_join(words, tiles, group, least_rows=tile).withColumn("wb", F.pmod(F.hash("ord"), F.col("wt"))).withColumn("rb", each("rt")).select(group, "wb", "rb", "ord", "word")

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        found = hits(left["regex"].to_pylist(), right["word"].to_pylist()) if left.num_rows and right.num_rows else []
        size = [len(f) for f in found]
        ord_ = right["ord"].to_numpy()[np.concatenate(found)] if sum(size) else np.zeros(0, np.int64)
        rid = np.repeat(left["rid"].to_numpy(), size) if sum(size) else np.zeros(0, np.int64)
        key = (left if left.num_rows else right)[group][0].as_py()
        return pa.table({group: pa.array([key] * len(rid), left.schema.field(group).type), "rid": pa.array(rid, pa.int64()), "ord": pa.array(ord_, pa.int64())})

    kind = words.schema[group].dataType.simpleString()
    keys = [group, "wb", "rb"]
    tiled = spread(r, *keys).groupBy(*keys).cogroup(spread(w, *keys).groupBy(*keys)).applyInArrow(scan, f"{group} {kind}, rid bigint, ord bigint")
    return same.unionByName(tiled)


def negative_prefix(fw: DataFrame, k: int, seed: str = "42") -> list[tuple[str, str]]:
    """(frag_id, word) of the rows with the smallest keyed hashes, in order, that hold the first k rows of other fragments for each fragment.

    Every row (frag_id, ord, word) is hashed once, whatever fragment asks. The first 2 k rows do for all fragments but one that holds more
    than k of them; for that one the first k rows of all others are added. So 3 k rows come to the driver at most, however skewed the table is.
    """
    digest = F.md5(F.concat_ws("|", F.lit(seed), "frag_id", "word", F.col("ord").cast("string")))
    rows = fw.select(digest.alias("h"), "frag_id", "ord", "word")
    first = lambda df, n: [tuple(r) for r in df.orderBy("h", "frag_id", "ord").limit(n).collect()]
    prefix = first(rows, 2 * k)
    frag, own = Counter(r[1] for r in prefix).most_common(1)[0] if prefix else (None, 0)
    if own > k:
        prefix = sorted({*prefix, *first(rows.filter(F.col("frag_id") != frag), k)})
    return [(r[1], r[3]) for r in prefix]


def negative_hits(rules: DataFrame, prefix: list[tuple[str, str]], k: int) -> DataFrame:
    """(frag_id, rid, negs, pool): the places in the prefix of the negatives of its fragment that each rule matches, and the pool's size."""
    frags = np.array([f for f, _ in prefix], dtype=object)
    words = [w for _, w in prefix]

    def run(batches):
        of: dict[str, np.ndarray] = {}
        by_word: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            by_word.setdefault(w, []).append(i)
        for batch in batches:
            frag, rid, regex, exact = (batch.column(i).to_pylist() for i in range(4))
            found = iter(hits([r for r, e in zip(regex, exact) if e is None], words))
            negs, pool = [], []
            for f, e in zip(frag, exact):
                if f not in of:
                    allowed = np.zeros(len(words), dtype=bool)
                    allowed[np.flatnonzero(frags != f)[:k]] = True
                    of[f] = allowed
                at = np.array(by_word.get(e, []) if e is not None else next(found), dtype=np.int64)
                negs.append(at[of[f][at]].tolist())
                pool.append(int(of[f].sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(negs, pa.list_(pa.int32())), pa.array(pool, pa.int32())], names=["frag_id", "rid", "negs", "pool"])

    return spread(rules.select("frag_id", "rid", "regex", "exact")).mapInArrow(run, "frag_id string, rid bigint, negs array<int>, pool int")


def first_cover(ranked: DataFrame, group: str) -> DataFrame:
    """(group, place, n_new): rules that cover something no rule before them covers, from hits (group, place, ord).

    place is an orderable column, unique for each rule in its group. A word belongs to the first rule that matches it, which needs no sort of the group."""
    first = ranked.groupBy(group, "ord").agg(F.min("place").alias("place"))
    return first.groupBy(group, "place").agg(F.count(F.lit(1)).alias("n_new"))


def until_target(cover: DataFrame, totals: DataFrame, group: str, target: float) -> DataFrame:
    """The rules of ``first_cover`` that a walk takes until ``target`` of the group's ``n`` words is covered; totals: group, n, and ``had`` words
    that are covered already."""
    earlier = Window.partitionBy(group).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("had") + F.coalesce(F.sum("n_new").over(earlier), F.lit(0))
    return cover.join(totals, group).withColumn("_before", before).filter((F.col("_before") == 0) | (F.col("_before") / F.col("n") < target)).select(group, "place", "n_new")


def covered_by(hits: DataFrame, chosen: DataFrame, group: str) -> DataFrame:
    """(group, ord, place): every covered word under the first of the chosen rules (group, place) that matches it, from hits (group, place, ord)."""
    return hits.join(chosen.select(group, "place"), [group, "place"]).groupBy(group, "ord").agg(F.min("place").alias("place"))


def greedy_cover(hits: DataFrame, negs: DataFrame, totals: DataFrame, group: str, target: float, max_fpr: float) -> DataFrame:
    """(group, place, n_new): the rules that a walk in the order of place takes. It skips a rule that covers nothing new, or with which more than
    ``max_fpr`` of the group's ``pool`` of negatives would be matched by the rules taken, and ends at ``target`` of the group's ``n`` words.

    hits (group, place, ord), negs (group, place, neg) with each rule's negatives, totals (group, n, pool); place as in ``first_cover``.

    While no rule is skipped for its negatives, the walk is ``first_cover`` up to the target. So each step takes that for all groups at once, looks
    up the first place at which the negatives are too many, keeps what stands before it, and goes on behind it with the words, rules and room that are
    left; rules that need more than this room are skipped for good, as it only shrinks. Every step uses up one more negative of
    each group that goes on, or ends it, so there are at most max_fpr * pool + 1 steps, whatever the number of rules and words. No
    group is gathered: the sums that end a group go over one row a rule (the target) and one row a negative (the room).
    """
    state = totals.select(group, "n", "pool", F.lit(0).cast("long").alias("had"), F.lit(0).cast("long").alias("bad"))
    live, seen, rules, out = hits, negs.select(group, "neg").limit(0), negs, None
    upto = Window.partitionBy(group).orderBy("place")
    while True:
        new = cut(until_target(first_cover(live, group), state.select(group, "n", "had"), group, target))
        fresh = rules.join(new, [group, "place"], "left_semi").groupBy(group, "neg").agg(F.min("place").alias("place"))
        grown = fresh.groupBy(group, "place").agg(F.count(F.lit(1)).alias("c")).withColumn("u", F.sum("c").over(upto))
        over = grown.join(state.select(group, "pool", "bad"), group).filter((F.col("pool") > 0) & ((F.col("bad") + F.col("u")) / F.col("pool") > max_fpr))
        stop = cut(over.groupBy(group).agg(F.min("place").alias("stop")))
        if stop.isEmpty():
            return new if out is None else out.unionByName(new)
        before = lambda df: df.join(stop, group).filter(F.col("place") < F.col("stop")).drop("stop")
        behind = lambda df: df.join(stop, group).filter(F.col("place") > F.col("stop")).drop("stop")
        taken = new.join(stop, group, "left").filter(F.col("stop").isNull() | (F.col("place") < F.col("stop"))).drop("stop")
        out = cut(taken if out is None else out.unionByName(taken))
        mine = before(new)
        seen = cut(seen.unionByName(before(fresh).select(group, "neg")).join(stop, group, "left_semi"))
        grew = mine.groupBy(group).agg(F.sum("n_new").alias("more"))
        state = state.drop("bad").join(stop, group, "left_semi").join(grew, group, "left").join(seen.groupBy(group).agg(F.count(F.lit(1)).alias("bad")), group, "left")
        state = cut(state.select(group, "n", "pool", (F.col("had") + F.coalesce("more", F.lit(0))).alias("had"), F.coalesce("bad", F.lit(0)).alias("bad")))
        rules = cut(behind(rules).join(seen, [group, "neg"], "left_anti"))
        asks = rules.groupBy(group, "place").agg(F.count(F.lit(1)).alias("c")).join(state.select(group, "pool", "bad"), group)
        barred = asks.filter((F.col("bad") + F.col("c")) / F.col("pool") > max_fpr).select(group, "place")
        covered = before(live).join(mine, [group, "place"], "left_semi").select(group, "ord").distinct()
        live = cut(behind(live).join(barred, [group, "place"], "left_anti").join(covered, [group, "ord"], "left_anti"))
