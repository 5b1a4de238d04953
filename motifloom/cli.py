"""spark-submit entry: mine rules, build the graph, or look into a graph.

    python -m motifloom.cli mine --input lists.parquet --output out --num-fragments 0 --target-coverage 0.85 --max-fpr 0.1 --objects
    python -m motifloom.cli graph --input lists.parquet --output out --topk 100 --score-threshold 3.0 --max-posting 300 --batch-size 100000
    python -m motifloom.cli inspect --graph out --word ABC --top 20
    python -m motifloom.cli inspect --graph out --fragment frag_1

A graph run that broke goes on where it stopped if it is started again with the same output.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from motifloom.functions.alphabet import edge_type_name
from motifloom.operators.graph import inspect_fragments
from motifloom.operators.words import with_word_ids
from motifloom.plans.mine import mine_rules, run_totals
from motifloom.plans.neighbours import build_graph
from motifloom.sources import io


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="motifloom")
    sub = p.add_subparsers(dest="what", required=True)
    m = sub.add_parser("mine")
    m.add_argument("--input", required=True)
    m.add_argument("--format", default="parquet")
    m.add_argument("--output", required=True)
    m.add_argument("--num-fragments", type=int, default=0)
    m.add_argument("--target-coverage", type=float, default=0.85)
    m.add_argument("--max-fpr", type=float, default=0.1)
    m.add_argument("--negative-sample-size", type=int, default=1000)
    m.add_argument("--objects", action="store_true", help="also one JSON object a fragment")
    g = sub.add_parser("graph")
    g.add_argument("--input", required=True)
    g.add_argument("--format", default="parquet")
    g.add_argument("--output", required=True)
    g.add_argument("--topk", type=int, default=100)
    g.add_argument("--score-threshold", type=float, default=3.0)
    g.add_argument("--max-posting", type=int, default=300, help="0 takes all anchors")
    g.add_argument("--batch-size", type=int, default=100_000)
    i = sub.add_parser("inspect")
    i.add_argument("--graph", required=True)
    i.add_argument("--word")
    i.add_argument("--fragment")
    i.add_argument("--top", type=int, default=20)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName(f"motifloom {a.what}").getOrCreate()
    if a.what == "mine":
        lists = io.first_fragments(io.read_lists(spark, a.input, a.format), a.num_fragments)
        mined = mine_rules(with_word_ids(lists), a.target_coverage, a.max_fpr, a.negative_sample_size)
        io.write_results(mined, a.output, a.objects)
        run_totals(mined.summary).show(truncate=False)
        mined.rules.orderBy(F.desc("covered_count"), "frag_id", "rule").select("frag_id", "rule", "covered_count").show(3, truncate=False)
    elif a.what == "graph":
        lists = io.read_lists(spark, a.input, a.format)
        io.write_word_index(lists, f"{a.output}/index")
        words, pairs = io.read_word_index(spark, f"{a.output}/index")
        n = pairs.select("frag_id").distinct().count()
        graph = build_graph(words, a.topk, a.score_threshold, a.max_posting or None, f"{a.output}/batches", a.batch_size, n)
        io.write_graph(graph, a.output)
        graph.summary.show(truncate=False)
    else:
        graph = io.read_graph(spark, a.graph)
        words, pairs = io.read_word_index(spark, f"{a.graph}/index")
        if a.word:
            one = words.filter(F.col("word") == a.word.strip().upper()).select("word_id")
            near = graph.neighbors.join(one, "word_id", "left_semi").filter(F.col("rank") <= a.top)
            named = near.join(words.withColumnsRenamed({"word_id": "neighbor_id", "word": "neighbour"}), "neighbor_id").join(graph.rules, "rule_id")
            named.orderBy("word_id", "rank").select("rank", "neighbour", "score", "rule", edge_type_name(F.col("edge_type")).alias("edge_type")).show(a.top, truncate=False)
        if a.fragment:
            inspect_fragments(pairs.filter(F.col("frag_id") == a.fragment), graph.degrees).show(truncate=False)


if __name__ == "__main__":
    main()
