"""The neighbour graph: cleaning, both directions, rule pool, top-k, CSR, coverage and inspection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motifloom.functions.alphabet import edge_type_name
from motifloom.operators.skew import hot_keys, lookup_join
from motifloom.operators.words import dense_number, running_start
from motifloom.session import cut


def both_directions(edges: DataFrame) -> DataFrame:
    """edges(i, j, ...) and the same with i and j exchanged."""
    rest = [c for c in edges.columns if c not in ("i", "j")]
    return edges.select("i", "j", *rest).unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), *rest))


def undirected(neighbors: DataFrame) -> DataFrame:
    """(i, j, score, edge_type), i < j: each linked pair of ``neighbors`` once, with its highest score and that row's type.

    Rows with a null end, an unknown neighbour (-1), itself as the neighbour, or a null or NaN score are left out."""
    ok = (F.col("neighbor_id") >= 0) & (F.col("word_id") != F.col("neighbor_id")) & ~F.isnan("score")
    rows = neighbors.dropna(subset=["word_id", "neighbor_id", "score"]).filter(ok)
    pair = rows.select(F.least("word_id", "neighbor_id").alias("i"), F.greatest("word_id", "neighbor_id").alias("j"), "score", "edge_type")
    best = pair.groupBy("i", "j").agg(F.max(F.struct("score", "edge_type")).alias("b"))
    return best.select("i", "j", "b.score", "b.edge_type")


def top_neighbours(edges: DataFrame, k: int = 100) -> DataFrame:
    """(i, rank, j, score, edge_type): the k best neighbours of every word in edges that stand in both directions; ties go to the smaller j.

    Spark limits each group within every partition before the shuffle (WindowGroupLimit), so a hot word sends k rows a partition.
    """
    order = Window.partitionBy("i").orderBy(F.desc("score"), "j")
    return edges.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def degrees(words: DataFrame, top: DataFrame) -> DataFrame:
    """(word_id, degree, indptr) of all words, those without neighbours included; indptr is where the word's slice begins."""
    ids = words.select("word_id").dropna().distinct()
    size = top.groupBy("i").agg(F.count(F.lit(1)).alias("degree")).withColumnRenamed("i", "word_id")
    every = ids.join(size, "word_id", "left").select("word_id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))
    return running_start(every, "word_id", "degree", "indptr")


def rule_pool(rules: DataFrame) -> DataFrame:
    """(rule_id, rule): the distinct rules with dense numbers in their own order; nulls are left out."""
    return dense_number(rules.select("rule").dropna().distinct(), [F.col("rule")], "rule_id").select("rule_id", "rule")


def edge_type_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n_edges")).withColumn("edge_type_name", edge_type_name(F.col("edge_type")))


def graph_coverage(degree: DataFrame) -> DataFrame:
    """One row: n_words, n_linked, coverage."""
    linked = F.sum((F.col("degree") > 0).cast("long"))
    return degree.agg(F.count(F.lit(1)).alias("n_words"), F.coalesce(linked, F.lit(0)).alias("n_linked")).withColumn(
        "coverage", F.when(F.col("n_words") > 0, F.col("n_linked") / F.col("n_words"))
    )


def inspect_words(neighbors: DataFrame, words: DataFrame, rules: DataFrame, top: int = 20) -> DataFrame:
    """(word_id, rank, neighbor_id, neighbour, score, rule, edge_type_name): the first ``top`` listed neighbours of every word, by name.

    A row delivered again is one; unknown neighbours and rules stay with a null name, a NaN score is none."""
    score = F.when(~F.isnan("score"), F.col("score"))
    rows = neighbors.filter(F.col("word_id").isNotNull() & (F.col("rank") <= top)).groupBy("word_id", "rank", "edge_pos").agg(
        F.max("neighbor_id").alias("neighbor_id"), F.max(score).alias("score"), F.max("rule_id").alias("rule_id"), F.max("edge_type").alias("edge_type")
    )
    rows = cut(rows)
    hot = {c: hot_keys(rows, c) for c in ("neighbor_id", "rule_id")}
    named = lookup_join(rows, words.select(F.col("word_id").alias("neighbor_id"), F.col("word").alias("neighbour")), "neighbor_id", "left", hot=hot["neighbor_id"])
    ruled = lookup_join(named, rules, "rule_id", "left", hot=hot["rule_id"])
    return ruled.select("word_id", "rank", "neighbor_id", "neighbour", F.col("score").cast("double").alias("score"), "rule", edge_type_name(F.col("edge_type")).alias("edge_type_name"))


def inspect_fragments(pairs: DataFrame, degree: DataFrame, hot: list | None = None) -> DataFrame:
    """(frag_id, num_words, num_linked, num_edges, coverage_bound) of every fragment; edges count its words' neighbours in ``degree``. hot: the word_ids of
    very many fragments, if the caller has counted them."""
    rows = lookup_join(pairs.select("frag_id", "word_id"), degree.select("word_id", "degree"), "word_id", "left", hot=hot)
    rows = rows.withColumn("degree", F.coalesce("degree", F.lit(0)))
    out = rows.groupBy("frag_id").agg(
        F.count(F.lit(1)).alias("num_words"), F.sum((F.col("degree") > 0).cast("long")).alias("num_linked"), F.sum("degree").alias("num_edges")
    )
    return out.withColumn("coverage_bound", F.col("num_linked") / F.col("num_words"))


def induced_edges(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(frag_id, n_induced): edges with both ends in the fragment, each once; fragments without any are left out.

    Edges meet the fragments of their first end, and the second end is then looked up as (fragment, word)."""
    side = pairs.select("frag_id", "word_id")
    first = edges.select(F.col("i").alias("word_id"), "j").join(side, "word_id").select("frag_id", F.col("j").alias("word_id"))
    return first.join(side, ["frag_id", "word_id"], "left_semi").groupBy("frag_id").agg(F.count(F.lit(1)).alias("n_induced"))
