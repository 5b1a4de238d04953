"""Words, fragments and the relation between them; dense numbers and running sums without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motifloom.operators.skew import hot_keys, lookup_join, normal_frag, normal_word
from motifloom.session import cut


def clean_words(words: DataFrame) -> DataFrame:
    """(word_id, word): the normalised non-null word of every id; of several the smallest. Ids without a word are left out."""
    return words.select("word_id", normal_word().alias("word")).dropna().groupBy("word_id").agg(F.min("word").alias("word"))


def clean_pairs(word_frags: DataFrame) -> DataFrame:
    """(frag_id, word_id, pos): each pair once, at its first place; rows with a null key are left out, a null place counts as 0."""
    rows = word_frags.select(normal_frag().alias("frag_id"), "word_id", F.coalesce("pos", F.lit(0)).alias("pos")).dropna()
    return rows.groupBy("frag_id", "word_id").agg(F.min("pos").alias("pos"))


def frag_words(words: DataFrame, word_frags: DataFrame) -> DataFrame:
    """(frag_id, ord, word_id, word): the words of every fragment; ord orders them by place, then id, and is unique in a fragment."""
    named = lookup_join(clean_pairs(word_frags), clean_words(words), "word_id", hot=hot_keys(word_frags, "word_id"))
    order = F.shiftleft(F.col("pos").cast("long"), 32) + F.col("word_id")
    return named.select("frag_id", order.alias("ord"), "word_id", "word")


def named_ends(edges: DataFrame, words: DataFrame) -> DataFrame:
    """edges (i, j) with the words of both ends, wi and wj, from words (word_id, word); edges is read more than once: cut it first."""
    hot = {c: hot_keys(edges, c) for c in ("i", "j")}
    one = lookup_join(edges, words.select(F.col("word_id").alias("i"), F.col("word").alias("wi")), "i", hot=hot["i"])
    return lookup_join(one, words.select(F.col("word_id").alias("j"), F.col("word").alias("wj")), "j", hot=hot["j"])


def clean_pair_scores(pair_scores: DataFrame) -> DataFrame:
    """(word, frag_id, score): the mean of the valid scores (in 0..1) of every pair as normalised; nulls, NaN and others are left out."""
    rows = pair_scores.select(normal_word().alias("word"), normal_frag().alias("frag_id"), "score").dropna()
    return rows.filter(~F.isnan("score") & F.col("score").between(0, 1)).groupBy("word", "frag_id").agg(F.avg("score").alias("score"))


def fragment_library(fragments: DataFrame) -> DataFrame:
    """(frag_id, n_sets, total_frequency, n_sources, and every other text column): one row a fragment; repeated rows are one, of several texts the
    largest stays, nulls give 0."""
    count = F.aggregate(F.map_values("frequency"), F.lit(0).cast("long"), lambda a, x: a + x)
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    texts = [c for c, kind in fragments.dtypes if kind == "string" and c != "frag_id"]
    rows = fragments.select(normal_frag().alias("frag_id"), size(F.map_keys("frequency")).alias("_n"), F.coalesce(count, F.lit(0)).alias("_t"), size("frag_from").alias("_s"), *texts)
    return rows.filter(F.col("frag_id").isNotNull()).groupBy("frag_id").agg(
        F.max("_n").cast("int").alias("n_sets"), F.max("_t").alias("total_frequency"), F.max("_s").cast("int").alias("n_sources"), *[F.max(c).alias(c) for c in texts]
    )


def dense_number(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with 0, 1, 2, ... in the order given, which must be total. Rows are range-partitioned and counted by partition, so that no task
    sees all of them; only the partitions' counts are gathered."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = cut(placed).withColumn("_part", F.shiftright("_at", 33)).withColumn("_in", F.col("_at").bitwiseAND((1 << 33) - 1))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_in")).drop("_part", "_in", "_at", "_start")


def number_batches(pairs: DataFrame, batch_size: int) -> DataFrame:
    """(i, j, batch_id): pairs in the order of i and j, batch_size of them a batch, numbered from 0."""
    return dense_number(pairs.select("i", "j"), [F.col("i"), F.col("j")], "_n").select("i", "j", F.floor(F.col("_n") / batch_size).cast("long").alias("batch_id"))


def running_start(df: DataFrame, key: str, value: str, name: str, width: int = 1 << 16) -> DataFrame:
    """df with the sum of ``value`` over all smaller whole-number keys (keys are unique), in two levels: inside buckets of
    ``width`` keys, and over one row a bucket."""
    bucketed = df.withColumn("_b", F.floor(F.col(key) / width))
    inside = F.sum(value).over(Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1))
    each = bucketed.groupBy("_b").agg(F.sum(value).alias("_s"))
    earlier = F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))  # one row a bucket
    starts = each.select("_b", F.coalesce(earlier, F.lit(0)).alias("_start"))
    out = bucketed.withColumn("_in", F.coalesce(inside, F.lit(0))).join(starts, "_b")
    return out.withColumn(name, F.col("_start") + F.col("_in")).drop("_b", "_in", "_start")


def word_index(fw: DataFrame) -> DataFrame:
    """(idx, word, first_frag): dense numbers of the distinct words by first occurrence, fragments in their own order."""
    first = fw.groupBy("word").agg(F.min(F.struct("frag_id", "ord")).alias("first"))
    named = first.select("word", F.col("first.frag_id").alias("first_frag"), F.col("first.ord").alias("first_ord"))
    return dense_number(named, [F.col("first_frag"), F.col("first_ord")], "idx").select("idx", "word", "first_frag")


def with_word_ids(fw: DataFrame) -> DataFrame:
    """frag_words(frag_id, ord, word) with word_id, the word's number in ``word_index``: equal words have one id, others never share it."""
    fw = cut(fw)
    return fw.join(word_index(fw).select("word", F.col("idx").alias("word_id")), "word").select("frag_id", "ord", "word_id", "word")


def word_fragment_counts(fw: DataFrame) -> DataFrame:
    """(word_id, n_frags, first_frag, last_frag) of every word; the long table is the word's list of fragments."""
    return fw.groupBy("word_id").agg(F.count(F.lit(1)).alias("n_frags"), F.min("frag_id").alias("first_frag"), F.max("frag_id").alias("last_frag"))
