"""Queries of the cover under a limit on false positives, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from motifloom.operators import cover as V
from motifloom.operators.queries_core import _COST, _COVER, _HITS, K_NEG, _selected, frag_hits, negatives, pairs, pool_hits, ranked_pool, words
from motifloom.operators.skew import lookup_join
from motifloom.session import cut

QUERIES, SQL = {}, {}
TARGET, MAX_FPR, STRICT_FPR = 0.85, 0.1, 0.002

_NEGATIVE = f"""nfw as (select frag_id, cast(pos as bigint) * 4294967296 + word_id ord, word from p join w using (word_id)),
pre as (select frag_id, word, md5(concat_ws('|', '42', frag_id, word, cast(ord as varchar))) h from nfw order by h, frag_id, ord limit 20000),
neg as (select fr.frag_id, pre.word, row_number() over (partition by fr.frag_id order by pre.h) rk from (select distinct frag_id from nfw) fr join pre on pre.frag_id <> fr.frag_id qualify rk <= {K_NEG}),
nw as (select rule_id, word from rx join (select distinct word from neg) on regexp_full_match(word, regex)),
nn as (select frag_id, rule_id, rk from neg join nw using (word))"""


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


def negative_hits_of_pool(spark, d, neg):
    """(frag_id, rule_id, at): the negatives of a fragment that each rule of the pool matches."""
    named = lookup_join(pool_hits(spark, d), words(spark, d), "word_id", hot=[]).select("word", "rule_id").distinct()
    return neg.join(named, "word").select("frag_id", "rule_id", "at")


@query(f"with {_HITS}, {_NEGATIVE} select frag_id, rule_id, count(*) n_negatives from nn group by 1, 2")
def q_neg_scan(spark, d):
    """How many of a fragment's negatives each rule of the pool matches."""
    return negative_hits_of_pool(spark, d, negatives(spark, d)).groupBy("frag_id", "rule_id").agg(F.count(F.lit(1)).alias("n_negatives"))


def _walk_sql(max_fpr: float) -> str:
    return f"""with {_HITS}, {_COST}, {_NEGATIVE}, n as (select frag_id, rule_id, count(*) n_pos, list(word_id) ws from fh group by 1, 2),
ng as (select frag_id, rule_id, list(rk) negs from nn group by 1, 2), tot as (select frag_id, count(*) n from p group by 1), po as (select frag_id, count(*) pool from neg group by 1),
els as (select frag_id, n_pos, complexity, rule_id, struct_pack(cov := ws, bad := coalesce(negs, []), sel := [struct_pack(id := rule_id, c := 0)]) el from n join cost using (rule_id) left join ng using (frag_id, rule_id)),
walk as (select frag_id, [struct_pack(cov := []::int[], bad := []::bigint[], sel := []::struct(id int, c int)[])] || list(el order by n_pos desc, complexity, rule_id) rs from els group by 1),
done as (select frag_id, list_reduce(rs, lambda acc, r: case when len(acc.cov) > 0 and len(acc.cov) / n >= {TARGET} then acc
   when len(list_filter(r.cov, lambda x: not list_contains(acc.cov, x))) = 0 then acc when len(list_distinct(acc.bad || r.bad)) / pool > {max_fpr} then acc
   else struct_pack(cov := list_distinct(acc.cov || r.cov), bad := list_distinct(acc.bad || r.bad),
     sel := acc.sel || [struct_pack(id := r.sel[1].id, c := cast(len(list_filter(r.cov, lambda x: not list_contains(acc.cov, x))) as int))]) end).sel s
  from walk join tot using (frag_id) join po using (frag_id))
select frag_id, e.id rule_id, cast(e.c as bigint) n_new from (select frag_id, unnest(s) e from done)"""


def _limited_cover(spark, d, max_fpr: float):
    """(frag_id, rule_id, n_new): the pool's rules that a greedy walk takes in every fragment under a limit on false positives."""
    found = cut(frag_hits(spark, d))
    neg = cut(negatives(spark, d))
    placed, hits = ranked_pool(spark, d, found)
    placed, hits = cut(placed), cut(hits)
    negs = cut(negative_hits_of_pool(spark, d, neg).join(placed, ["frag_id", "rule_id"]).select("frag_id", "place", F.col("at").alias("neg")))
    pools = neg.groupBy("frag_id").agg(F.count(F.lit(1)).alias("pool"))
    totals = pairs(spark, d).groupBy("frag_id").agg(F.count(F.lit(1)).alias("n")).join(pools, "frag_id")
    return V.greedy_cover(hits, negs, totals, "frag_id", TARGET, max_fpr).select("frag_id", F.col("place.rule_id").alias("rule_id"), "n_new")


@query(_walk_sql(MAX_FPR))
def q_set_cover_fpr(spark, d):
    return _limited_cover(spark, d, MAX_FPR)


@query(_walk_sql(STRICT_FPR))
def q_set_cover_strict(spark, d):
    """The same under a limit that the rules of the pool do reach, so that some are skipped."""
    return _limited_cover(spark, d, STRICT_FPR)


@query(f"with {_COVER} select frag_id, rule_id, word_id from f join rk using (frag_id, place) join sel using (frag_id, rule_id)")
def q_newly_covered(spark, d):
    """The words that each chosen rule is the first to cover."""
    chosen, found, _ = _selected(spark, d)
    placed, hits = ranked_pool(spark, d, found)
    taken = placed.join(chosen, ["frag_id", "rule_id"], "left_semi")
    return V.covered_by(hits, taken, "frag_id").select("frag_id", F.col("place.rule_id").alias("rule_id"), F.col("ord").alias("word_id"))
