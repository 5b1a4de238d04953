"""Queries of the whole pipelines."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from motifloom.operators.queries_core import _COVER, _FW, _selected, frag_words, words
from motifloom.operators.words import with_word_ids
from motifloom.plans.mine import LONGEST, SHORTEST, fragment_edges, fragment_tiles, mine_rules, run_totals
from motifloom.plans.neighbours import build_graph
from motifloom.session import cut, read


def q_fragment_edges(spark, d):
    return fragment_edges(cut(frag_words(spark, d))).withColumn("s", F.round(F.col("s").cast("double"), 5))


def q_fragment_pairs(spark, d):
    """Pairs of words that each fragment's tiles bring together: every pair of its words of a length that a rule can match, once."""
    each = fragment_tiles(cut(frag_words(spark, d))).groupBy("frag_id", "i", "j", "blk").agg(F.count(F.lit(1)).alias("c"))
    tiles = each.groupBy("frag_id", "i", "j").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"))
    within = F.when(F.col("i") == F.col("j"), F.col("s")).otherwise(F.col("q"))
    return tiles.groupBy("frag_id").agg(F.sum((F.col("s") * F.col("s") - within) / 2).cast("long").alias("n_pairs"))


def part_words(spark, d):
    """Brands and the two-token names of their parts as fragments and words, in the order of the names."""
    p = read(spark, d, "part").select(F.col("p_brand").alias("frag_id"), F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("word")).dropna().distinct()
    order = F.row_number().over(Window.partitionBy("frag_id").orderBy("word")) - 1
    return with_word_ids(p.select("frag_id", order.cast("long").alias("ord"), "word"))


def q_mine_part_words(spark, d):
    return mine_rules(part_words(spark, d)).rules.drop("rid").withColumn("rule_fpr", F.round("rule_fpr", 9))


def q_mine_rules(spark, d):
    return mine_rules(frag_words(spark, d)).rules.drop("rid").withColumn("rule_fpr", F.round("rule_fpr", 9))


def q_covered_words(spark, d):
    """Every word of every fragment under the mined rule that covers it."""
    mined = mine_rules(frag_words(spark, d))
    return mined.covered.join(mined.rules.select("frag_id", "rid", "rule", "kind"), ["frag_id", "rid"]).select("frag_id", "rule", "kind", "word")


def q_mine_summary(spark, d):
    summary = mine_rules(frag_words(spark, d)).summary
    return summary.select("frag_id", "total_words", "n_rules", *[F.round(c, 9).alias(c) for c in ("coverage", "gen_coverage", "overall_fpr", "selected_fpr")])


def q_run_totals(spark, d):
    return run_totals(mine_rules(frag_words(spark, d)).summary)


def q_build_graph(spark, d):
    return build_graph(words(spark, d)).neighbors.withColumn("score", F.round(F.col("score").cast("double"), 4))


def q_build_graph_all(spark, d):
    """The graph from all anchors; q_build_graph leaves out the reference's stop anchors."""
    return build_graph(words(spark, d), max_posting=None).neighbors.withColumn("score", F.round(F.col("score").cast("double"), 4))


def q_pool_totals(spark, d):
    """Run totals over all fragments of the rule pool's cover, with an exact rule for every word that it leaves out."""
    chosen, found, totals = _selected(spark, d)
    taken = cut(found.join(chosen, ["frag_id", "rule_id"], "left_semi"))
    several = found.groupBy("frag_id", "rule_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    per = lambda df, name: df.groupBy("frag_id").agg(F.countDistinct("word_id").alias(name))
    n_rules = chosen.groupBy("frag_id").agg(F.count(F.lit(1)).alias("r"))
    every = totals.join(n_rules, "frag_id", "left").join(per(taken, "covered"), "frag_id", "left").join(per(taken.join(several, ["frag_id", "rule_id"], "left_semi"), "gen"), "frag_id", "left")
    some = lambda c: F.coalesce(c, F.lit(0))
    summary = every.select(F.col("n").alias("total_words"), (some("r") + F.col("n") - some("covered")).alias("n_rules"), F.lit(1.0).alias("coverage"), (some("gen") / F.col("n")).alias("gen_coverage"))
    return run_totals(summary).withColumns({c: F.round(c, 9) for c in ("coverage", "gen_coverage")})


QUERIES = {f.__name__: f for f in (q_fragment_pairs, q_fragment_edges, q_mine_part_words, q_mine_rules, q_covered_words, q_mine_summary, q_run_totals, q_pool_totals, q_build_graph, q_build_graph_all)}
SQL = {
    "q_fragment_pairs": f"with {_FW} select a.frag_id, count(b.ord) n_pairs from fw a left join fw b on b.frag_id = a.frag_id and b.ord > a.ord and length(b.word) between {SHORTEST} and {LONGEST} where length(a.word) between {SHORTEST} and {LONGEST} group by 1",
    "q_pool_totals": f"""with {_COVER}, t as (select distinct frag_id, rule_id, word_id, n_pos from sel join fh using (frag_id, rule_id) join n using (frag_id, rule_id)),
c as (select frag_id, count(distinct word_id) covered, count(distinct case when n_pos > 1 then word_id end) gen from t group by 1), r as (select frag_id, count(*) r from sel group by 1),
s as (select tot.n, coalesce(r, 0) + tot.n - coalesce(covered, 0) n_rules, coalesce(gen, 0) gen from tot left join r using (frag_id) left join c using (frag_id))
select count(*) n_fragments, cast(sum(n) as bigint) n_words, cast(sum(n_rules) as bigint) n_rules, 1.0::double coverage, round(sum(gen) / sum(n), 9) gen_coverage from s"""
}
