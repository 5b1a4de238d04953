"""Sources and sinks: fragment lists as JSON or Parquet, trusted pickles, graph artefacts, results."""

from __future__ import annotations

import pickle
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifloom.operators.words import with_word_ids
from motifloom.plans.mine import Mined
from motifloom.plans.neighbours import Graph
from motifloom.session import cut

WRAPPERS = ("frag2words", "frag_to_words", "fragment_to_words")


def fragment_lists(data: Mapping) -> Mapping:
    """The fragment -> words mapping inside one of the known wrappers, or itself if all its keys begin with ``frag_``."""
    for key in WRAPPERS:
        if key in data:
            return data[key]
    if all(str(k).startswith("frag_") for k in data):
        return data
    raise ValueError(f"no fragment lists: expected one of {', '.join(WRAPPERS)} or keys that begin with frag_")


def read_pickle(spark: SparkSession, path: str, wrapped: bool = True) -> DataFrame:
    """(frag_id, ord, word) of a pickle that maps fragments to a list, set or dict of words. Pickles run code when they are read: only
    for trusted files, which this reads on the driver; use Parquet or JSON for data of any size. Words of sets come in their own order."""
    with open(path, "rb") as f:
        data = pickle.load(f)
    lists = fragment_lists(data) if wrapped else data
    ordered = lambda ws: sorted(ws) if isinstance(ws, (set, frozenset)) else list(ws)
    rows = [(str(frag), k, w) for frag, ws in lists.items() for k, w in enumerate(ordered(ws))]
    return spark.createDataFrame(rows, "frag_id string, ord long, word string")


def read_lists(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """(frag_id, ord, word) of a table (frag_id, words ARRAY<STRING>) in any format Spark reads; null lists and words are left out."""
    rows = spark.read.schema("frag_id string, words array<string>").format(form).load(path)
    long = rows.select("frag_id", F.posexplode("words").alias("ord", "word"))
    return long.select("frag_id", F.col("ord").cast("long").alias("ord"), "word").dropna()


def first_fragments(fw: DataFrame, n: int) -> DataFrame:
    """The words of the first n fragments in their own order; 0 takes all."""
    return fw if n == 0 else fw.join(fw.select("frag_id").distinct().orderBy("frag_id").limit(n), "frag_id", "left_semi")


def read_pair_scores(spark: SparkSession, path: str, form: str = "json") -> DataFrame:
    """(word, frag_id, score) of a table (pair STRING, score DOUBLE) whose pairs are a word and a fragment with one space between."""
    rows = spark.read.schema("pair string, score double").format(form).load(path)
    parts = F.split("pair", " ")
    return rows.filter(F.size(parts) == 2).select(parts[0].alias("word"), parts[1].alias("frag_id"), "score")


def write_graph(graph: Graph, path: str) -> None:
    """Edges, rules, neighbours (sorted by word), degrees and the summary, each below ``path``."""
    graph.edges.write.mode("overwrite").parquet(f"{path}/edges")
    graph.rules.write.mode("overwrite").parquet(f"{path}/rules")
    graph.neighbors.repartitionByRange("word_id").sortWithinPartitions("word_id", "rank").write.mode("overwrite").parquet(f"{path}/neighbors")
    graph.degrees.write.mode("overwrite").parquet(f"{path}/degrees")
    graph.summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def read_graph(spark: SparkSession, path: str) -> Graph:
    return Graph(*[spark.read.parquet(f"{path}/{x}") for x in ("edges", "rules", "neighbors", "degrees")], spark.read.json(f"{path}/summary"))


def write_word_index(fw: DataFrame, path: str) -> None:
    """The word index of frag_words(frag_id, ord, word): ``words`` (word_id, word) and ``word_frags`` (word_id, frag_id, pos), sorted by fragment, below ``path``.

    Both directions of the index are the long table: a word's fragments are its rows, a fragment's words its rows in the order of pos."""
    named = cut(with_word_ids(fw))
    named.select("word_id", "word").distinct().write.mode("overwrite").parquet(f"{path}/words")
    long = named.select("word_id", "frag_id", F.col("ord").alias("pos"))
    long.repartitionByRange("frag_id", "pos").sortWithinPartitions("frag_id", "pos").write.mode("overwrite").parquet(f"{path}/word_frags")


def read_word_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """words (word_id, word) and word_frags (word_id, frag_id, pos) of ``write_word_index``."""
    return spark.read.parquet(f"{path}/words"), spark.read.parquet(f"{path}/word_frags")


def write_results(mined: Mined, path: str, objects: bool = False) -> None:
    """Rules and the words that each covers as Parquet by fragment, the fragments' summaries as JSON lines with full characters, below ``path``.

    objects: also one JSON object a fragment, with its rules and their words inside, to ``path``/fragments. Such a row holds a whole fragment, so
    it is for fragments of moderate size; the tables hold fragments of any size."""
    order = [F.desc("covered_count"), "rule"]
    mined.rules.repartitionByRange("frag_id", "rid").sortWithinPartitions("frag_id", *order).write.mode("overwrite").parquet(f"{path}/rules")
    mined.covered.repartitionByRange("frag_id", "rid").sortWithinPartitions("frag_id", "rid", "ord").write.mode("overwrite").parquet(f"{path}/covered")
    mined.summary.write.mode("overwrite").json(f"{path}/summary")
    if objects:
        fragment_objects(mined).write.mode("overwrite").json(f"{path}/fragments")


def fragment_objects(mined: Mined) -> DataFrame:
    """One row a fragment: frag_id, total_words, rules (pattern, covered_words, covered_count, average_score, false_positive_rate; most words first),
    coverage, gen_coverage, overall_fpr."""
    words = mined.covered.groupBy("frag_id", "rid").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "word"))), lambda x: x["word"]).alias("covered_words"))
    rule = F.struct(
        (-F.col("covered_count")).alias("_by"), F.col("rule").alias("pattern"), "covered_words", "covered_count", "average_score", F.coalesce("rule_fpr", F.lit(0.0)).alias("false_positive_rate")
    )
    rules = mined.rules.join(words, ["frag_id", "rid"]).groupBy("frag_id").agg(F.transform(F.array_sort(F.collect_list(rule)), lambda x: x.dropFields("_by")).alias("rules"))
    return mined.summary.join(rules, "frag_id").select("frag_id", "total_words", "rules", "coverage", "gen_coverage", "overall_fpr")
