"""Queries of the word, anchor, graph, rule and cover operators, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from motifloom.functions import alphabet as A
from motifloom.functions import rules as R
from motifloom.operators import anchors as N
from motifloom.operators import cover as V
from motifloom.operators import graph as G
from motifloom.operators import words as W
from motifloom.operators.align import align_pairs, score_pairs
from motifloom.operators.matching import greedy_matching
from motifloom.operators.neighbor_rows import owned_neighbors
from motifloom.operators.skew import hot_keys, lookup_join
from motifloom.session import cut, read

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


_W = "w as (select word_id, min(upper(trim(word))) word from words where word_id is not null and word is not null group by 1)"
_P = "p as (select lower(trim(frag_id)) frag_id, word_id, min(coalesce(pos, 0)) pos from word_frags where frag_id is not null and word_id is not null group by 1, 2)"
_FW = f"{_W}, {_P}, fw as (select frag_id, cast(pos as bigint) * 4294967296 + word_id ord, word_id, word from p join w using (word_id))"


def words(spark, d):
    return W.clean_words(read(spark, d, "words"))


def pairs(spark, d):
    return W.clean_pairs(read(spark, d, "word_frags"))


def frag_words(spark, d):
    return W.frag_words(read(spark, d, "words"), read(spark, d, "word_frags"))


# ---- words and fragments ---------------------------------------------------------------------------------------------------


@query(f"with {_FW} select * from fw")
def q_frag_words(spark, d):
    return frag_words(spark, d)


@query(f"""with {_FW}, f as (select word, min(struct_pack(a := frag_id, b := ord)) x from fw group by 1)
select row_number() over (order by x.a, x.b) - 1 idx, word, x.a first_frag from f""")
def q_word_index(spark, d):
    return W.word_index(frag_words(spark, d))


@query(f"with {_P} select word_id, count(*) n_frags, min(frag_id) first_frag, max(frag_id) last_frag from p group by 1")
def q_word_frags(spark, d):
    return W.word_fragment_counts(pairs(spark, d))


@query(f"with {_P} select frag_id, word_id, pos from p")
def q_frag_word_ids(spark, d):
    return pairs(spark, d).select("frag_id", "word_id", "pos")


@query("""select upper(trim(word)) word, lower(trim(frag_id)) frag_id, round(avg(score), 9) score from pair_scores
where word is not null and frag_id is not null and score is not null and not isnan(score) and score between 0 and 1 group by 1, 2""")
def q_pair_scores(spark, d):
    return W.clean_pair_scores(read(spark, d, "pair_scores")).withColumn("score", F.round("score", 9))


@query("""with f as (select lower(trim(frag_id)) fid, coalesce(cardinality(frequency), 0) n, coalesce(list_sum(map_values(frequency)), 0) t, coalesce(len(frag_from), 0) s,
       columns(* exclude (frag_id, frequency, frag_from)) from fragments where frag_id is not null)
select fid frag_id, cast(max(n) as int) n_sets, cast(max(t) as bigint) total_frequency, cast(max(s) as int) n_sources, max(columns(* exclude (fid, n, t, s))) from f group by 1""")
def q_fragment_library(spark, d):
    return W.fragment_library(read(spark, d, "fragments"))


@query(f"""with {_W} select word_id, replace(word, '_', '') bare, regexp_replace(word, '[^A-Z]', '', 'g') residues from w""")
def q_aa_only(spark, d):
    return words(spark, d).select("word_id", N.bare(F.col("word")).alias("bare"), A.residues_only(F.col("word")).alias("residues"))


_CLASS_VALUES = ", ".join(f"({i}, '{c.name}', '{c.residues}', {c.tier}, {c.mine}, {c.graph})" for i, c in enumerate(A.CLASSES))


@query(f"""with c(o, name, aas, tier, mine, graph) as (values {_CLASS_VALUES}), {_W},
t as (select substr(word, cast(i as int), 1) a, substr(word, cast(i as int) + 1, 1) b from w, unnest(range(1, length(word))) u(i)),
n as (select a, b, count(*) n_seen from t group by 1, 2),
f as (select n.*, (select min_by(struct_pack(m := mine, g := graph), o) from c where contains(aas, n.a) and contains(aas, n.b)) s from n)
select a, b, n_seen, cast(case when a = b then 1.0 when '_' in (a, b) then 0.5 else coalesce(s.m, 0.3) end as double) mining_score,
       cast(case when a = b then 1.0 else coalesce(s.g, -1.0) end as double) graph_score from f""")
def q_residue_pair_scores(spark, d):
    """Pairs of residues that stand next to each other in words, how often, and both scores."""
    w = words(spark, d).filter(F.length("word") > 1)
    at = w.select("word", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("i"))
    two = at.select(F.substring("word", F.col("i"), F.lit(1)).alias("a"), F.substring("word", F.col("i") + 1, F.lit(1)).alias("b"))
    n = two.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_seen"))
    return n.withColumns({"mining_score": A.residue_score(F.col("a"), F.col("b")), "graph_score": A.residue_score(F.col("a"), F.col("b"), "graph")})


@query(f"""with {_W}, n as (select length(word) n, count(*) n_words from w group by 1)
select n, n_words, round(cast(case when n = 1 then -0.8 when n = 2 then -1.2 when n = 3 then -1.8 else -2.0 - (n - 4) * 0.5 end as double), 9) optional_mining,
round(cast(case when n <= 0 then 0 when n <= 2 then -0.3 when n <= 4 then -0.5 else -1.0 - (n - 4) * 0.3 end as double), 9) flank_mining,
round(cast(case when n = 1 then -0.15 when n = 2 then -0.4 when n = 3 then -0.9 when n = 4 then -1.6 else -2.0 end as double), 9) optional_graph,
round(cast(case when n <= 0 then 0 else -0.2 * n - 0.2 end as double), 9) flank_graph from n""")
def q_penalties(spark, d):
    """Penalties for as many characters as words have."""
    n = words(spark, d).groupBy(F.length("word").alias("n")).agg(F.count(F.lit(1)).alias("n_words"))
    c = F.col("n")
    kinds = {"optional_mining": A.optional_penalty(c), "flank_mining": A.flank_penalty(c), "optional_graph": A.optional_penalty(c, "graph"), "flank_graph": A.flank_penalty(c, "graph")}
    return n.select("n", "n_words", *[F.round(v.cast("double"), 9).alias(k) for k, v in kinds.items()])


# ---- anchors and candidates ------------------------------------------------------------------------------------------------

_AW = f"{_W}, a as (select word_id, word, replace(word, '_', '') aa from w)"
_EXACT = "select word_id, 'exact' || k || ':' || substr(aa, cast(i as int), cast(k as int)) anchor from a, unnest([3, 4, 5]) t(k), unnest(range(1, length(aa) - k + 2)) u(i)"
_ENDS = "select word_id, unnest(['prefix' || k || ':' || substr(aa, 1, k), 'suffix' || k || ':' || right(aa, k)]) anchor from a, unnest([3, 4, 5, 6]) t(k) where length(aa) >= k"
_SPACED = "select word_id, 'spaced:' || substr(aa, cast(i as int), 3) || '***' || substr(aa, cast(i + 3 + g as int), 3) anchor from a, unnest(range(0, 5)) t(g), unnest(range(1, length(aa) - g - 4)) u(i)"
_GAP = """select word_id, 'gap:' || p[i] || '***' || p[i + 1] anchor from (select word_id, string_split(word, '_') p from a) s, unnest(range(1, len(p))) u(i)
          where p[i] <> '' and p[i + 1] <> ''"""
_ALL = f"{_AW}, anc as ({_EXACT} union all {_ENDS} union all {_SPACED} union all {_GAP})"
_GROUPED = "select word_id, anchor, count(*) n from x group by 1, 2"


def _anchor_query(kinds):
    return lambda spark, d: N.anchors(words(spark, d), kinds).groupBy("word_id", "anchor").agg(F.count(F.lit(1)).alias("n"))


for _name, _kinds, _sql in (("exact", ("exact",), _EXACT), ("prefix_suffix", ("prefix_suffix",), _ENDS), ("spaced", ("spaced",), _SPACED), ("gap", ("gap",), _GAP)):
    QUERIES[f"q_anchor_{_name}"] = _anchor_query(_kinds)
    SQL[f"q_anchor_{_name}"] = f"with {_AW}, x as ({_sql}) {_GROUPED}"


@query(f"with {_ALL} select word_id, count(*) n_anchors, count(distinct anchor) n_distinct from anc group by 1")
def q_anchor_all(spark, d):
    by = N.anchors(words(spark, d)).groupBy("word_id", "anchor").agg(F.count(F.lit(1)).alias("m"))
    return by.groupBy("word_id").agg(F.sum("m").alias("n_anchors"), F.count(F.lit(1)).alias("n_distinct"))


@query(f"with {_ALL} select anchor, count(*) n_rows, count(distinct word_id) n_words from anc group by 1")
def q_postings(spark, d):
    return N.postings(words(spark, d))


_WEIGHT = "case split_part(anchor, ':', 1) " + " ".join(f"when '{k}' then {v}" for k, v in N.WEIGHTS.items()) + f" else {N.OTHER_WEIGHT} end"
_CAND = f"""{_ALL}, m as (select anchor, word_id, count(*) m, {_WEIGHT} wt from anc group by 1, 2),
k as (select anchor from m group by 1 having sum(m) <= 300), l as (select word_id, length(aa) len from a)
select x.word_id i, y.word_id j, cast(sum(x.m * y.m * x.wt) as bigint) tenths from m x join m y on x.anchor = y.anchor and x.word_id < y.word_id
join k on k.anchor = x.anchor join l p on p.word_id = x.word_id join l q on q.word_id = y.word_id
where least(p.len, q.len) >= 3 and greatest(p.len, q.len) <= 5 * least(p.len, q.len) group by 1, 2 having sum(x.m * y.m * x.wt) >= 10"""


@query(f"with {_ALL} select anchor, count(*) n_rows from anc group by 1 having count(*) > 300")
def q_posting_cap(spark, d):
    """Stop anchors: those that candidate pairs leave out by definition."""
    return N.stop_anchors(words(spark, d))


@query(f"with {_ALL} select anchor, count(*) n_rows from anc group by 1 having count(*) > 30")
def q_posting_cap_30(spark, d):
    """Stop anchors under a cap that small tables reach too."""
    return N.stop_anchors(words(spark, d), 30)


@query(f"with {_CAND}")
def q_candidates(spark, d):
    return N.candidate_pairs(words(spark, d))


_CAND_ALL = f"""{_ALL}, m as (select anchor, word_id, count(*) m, {_WEIGHT} wt from anc group by 1, 2), l as (select word_id, length(aa) len from a)
select x.word_id i, y.word_id j, cast(sum(x.m * y.m * x.wt) as bigint) tenths from m x join m y on x.anchor = y.anchor and x.word_id < y.word_id
join l p on p.word_id = x.word_id join l q on q.word_id = y.word_id
where least(p.len, q.len) >= 3 and greatest(p.len, q.len) <= 5 * least(p.len, q.len) group by 1, 2 having sum(x.m * y.m * x.wt) >= 10"""


@query(f"with {_CAND_ALL}")
def q_candidates_all(spark, d):
    """Candidate pairs of all anchors; q_candidates leaves out the reference's stop anchors."""
    return N.candidate_pairs(words(spark, d), None)


# ---- alignments of the linked words (rows are checked in tests against one cell at a time) ------------------------------------------


def linked_words(spark, d):
    """(i, j, wi, wj), i < j: the linked words."""
    edges = cut(G.undirected(owned_neighbors(spark, d)).select("i", "j"))
    return W.named_ends(edges, cut(words(spark, d)))


@query()
def q_align_rule(spark, d):
    return align_pairs(linked_words(spark, d), "wi", "wj").drop("wi", "wj").withColumn("score", F.round(F.col("score").cast("double"), 5))


@query()
def q_score_pairs(spark, d):
    return score_pairs(linked_words(spark, d), "wi", "wj").drop("wi", "wj").withColumn("score", F.round("score", 9))


# ---- rules -----------------------------------------------------------------------------------------------------------------

_TOK = "t as (select rule_id, rule, unnest(string_split(rule, '-')) tok from rules where rule is not null)"
_NAMES = " ".join(f"when '[{c.name}]' then '[{c.residues}]'" for c in A.CLASSES)
_RX = f"""string_agg(case when tok = '_' then '.{{1,4}}' when tok like 'x(%' then replace(replace(replace(tok, 'x(', '.{{'), ')', '}}'), ' ', '')
   when tok like '[%' then (case tok {_NAMES} else '[^\\x00-\\x{{10FFFF}}]' end) when tok like '(%' then tok || '?' else tok end, '' order by k)"""
_RULES = f"""r0 as (select rule_id, rule, unnest(string_split(rule, '-')) tok, generate_subscripts(string_split(rule, '-'), 1) k from rules where rule is not null and rule_id is not null),
rx as (select rule_id, rule, {_RX} regex from r0 group by 1, 2)"""


def clean_rules(spark, d):
    return read(spark, d, "rules").dropna(subset=["rule_id", "rule"]).dropDuplicates(["rule_id"])


@query(f"""with {_RULES}, n as (select rule_id, rule, tok, k, cast(regexp_extract(tok, '(\\d+)', 1) as varchar) lo, regexp_extract(tok, ',(\\d+)', 1) hi from r0),
c as (select rule_id, rule,
 cast(count(*) filter (length(tok) = 1 and tok <> '_') as int) literals,
 cast(count(*) filter (tok in ('[small]', '[nonpolar]', '[polar]', '[bulky]')) as int) tier3,
 cast(coalesce(max(case when tok = '_' then 4 when tok like 'x(%' then cast(hi as int) else 0 end), 0) as int) max_wildcard,
 cast(coalesce(sum(case when tok = '_' then 4 when tok like 'x(%' then cast(hi as int) else 0 end), 0) as int) sum_wildcard,
 cast(sum(case when tok = '_' or tok like '(%' then 2.0 when tok like '[%' then 1.5 when tok like 'x(%' then 1 + 0.5 * (cast(hi as int) - cast(lo as int)) else 1.0 end) as double) complexity
 from n group by 1, 2)
select *, literals >= 3 and max_wildcard <= 4 and sum_wildcard <= 6 and tier3 <= 1 and complexity <= 12 allowed from c""")
def q_rule_costs(spark, d):
    c = clean_rules(spark, d).select("rule_id", "rule", R.rule_costs(F.col("rule")).alias("c"))
    return c.select("rule_id", "rule", "c.*", R.rule_allowed(F.col("c")).alias("allowed"))


@query(f"with {_RULES}, {_W} select rule_id, word_id from rx join w on regexp_full_match(word, regex)")
def q_rule_match(spark, d):
    """Every rule of the pool against every word. The rules are a stated set that Spark sends to the tasks where it is small."""
    return pool_hits(spark, d)


def pool_hits(spark, d):
    """(rule_id, word_id): the rule pool against all words, in tiles of rules and words."""
    rules = clean_rules(spark, d).select(F.lit("all").alias("grp"), F.col("rule_id").cast("long").alias("rid"), R.rule_regex(F.col("rule")).alias("regex"), F.lit(None).cast("string").alias("exact"))
    w = words(spark, d).select(F.lit("all").alias("grp"), F.col("word_id").cast("long").alias("ord"), "word")
    found = V.rule_hits(cut(rules), cut(w), "grp")
    return found.select(F.col("rid").cast("int").alias("rule_id"), F.col("ord").cast("int").alias("word_id"))


_HITS = f"{_RULES}, {_W}, {_P}, h as (select rule_id, word_id from rx join w on regexp_full_match(word, regex)), fh as (select frag_id, rule_id, word_id from h join p using (word_id))"


def frag_hits(spark, d):
    """(frag_id, rule_id, word_id): rules of the pool that match words of fragments."""
    hot = hot_keys(read(spark, d, "word_frags"), "word_id")
    return lookup_join(pairs(spark, d).select("frag_id", "word_id"), pool_hits(spark, d).groupBy("word_id").agg(F.collect_set("rule_id").alias("rs")), "word_id", hot=hot).select(
        "frag_id", F.explode("rs").alias("rule_id"), "word_id"
    )  # a word's set of rules is at most the pool


@query(f"with {_HITS} select frag_id, rule_id, count(*) n_words from fh group by 1, 2")
def q_pos_scan(spark, d):
    return frag_hits(spark, d).groupBy("frag_id", "rule_id").agg(F.count(F.lit(1)).alias("n_words"))


_COST = """cost as (select rule_id, cast(sum(case when tok = '_' or tok like '(%' then 2.0 when tok like '[%' then 1.5
 when tok like 'x(%' then 1 + 0.5 * (cast(regexp_extract(tok, ',(\\d+)', 1) as int) - cast(regexp_extract(tok, '(\\d+)', 1) as int)) else 1.0 end) as double) complexity from r0 group by 1)"""
_COVER = f"""{_HITS}, {_COST}, n as (select frag_id, rule_id, count(*) n_pos from fh group by 1, 2),
rk as (select frag_id, rule_id, row_number() over (partition by frag_id order by n_pos desc, complexity, rule_id) place from n join cost using (rule_id)),
f as (select frag_id, word_id, min(place) place from fh join rk using (frag_id, rule_id) group by 1, 2),
a as (select frag_id, place, count(*) n_new from f group by 1, 2),
tot as (select frag_id, count(*) n from p group by 1),
b as (select frag_id, place, n_new, n, coalesce(sum(n_new) over (partition by frag_id order by place rows between unbounded preceding and 1 preceding), 0) before from a join tot using (frag_id)),
sel as (select frag_id, rule_id, n_new from b join rk using (frag_id, place) where before = 0 or before / n < 0.85)"""


def ranked_pool(spark, d, found):
    """The pool's rules in the order of the walk in every fragment: (frag_id, rule_id, place), and the hits (frag_id, place, ord)."""
    cost = clean_rules(spark, d).select("rule_id", R.rule_costs(F.col("rule"))["complexity"].alias("c"))
    n = found.groupBy("frag_id", "rule_id").agg(F.count(F.lit(1)).alias("n_pos")).join(cost, "rule_id")
    placed = n.select("frag_id", "rule_id", F.struct((-F.col("n_pos")).alias("n"), "c", "rule_id").alias("place"))
    return placed, found.join(placed, ["frag_id", "rule_id"]).select("frag_id", "place", F.col("word_id").alias("ord"))


def _selected(spark, d):
    """The pool's rules that a greedy walk takes in every fragment: (frag_id, rule_id, n_new), and the hits."""
    found = cut(frag_hits(spark, d))
    _, hits = ranked_pool(spark, d, found)
    totals = pairs(spark, d).groupBy("frag_id").agg(F.count(F.lit(1)).alias("n"), F.lit(0).alias("had"))
    chosen = V.until_target(V.first_cover(hits, "frag_id"), totals, "frag_id", 0.85)
    return chosen.select("frag_id", F.col("place.rule_id").alias("rule_id"), "n_new"), found, totals


@query(f"with {_COVER} select * from sel")
def q_set_cover(spark, d):
    return _selected(spark, d)[0]


@query(f"""with {_COVER}, g as (select frag_id, count(distinct word_id) gen from sel join fh using (frag_id, rule_id) join n using (frag_id, rule_id) where n_pos > 1 group by 1)
select frag_id, tot.n total_words, coalesce(gen, 0) gen_words, round(coalesce(gen, 0) / tot.n, 9) gen_coverage from tot left join g using (frag_id)""")
def q_gen_coverage(spark, d):
    chosen, found, totals = _selected(spark, d)
    n = found.groupBy("frag_id", "rule_id").agg(F.count(F.lit(1)).alias("n_pos")).filter("n_pos > 1")
    gen = found.join(chosen.join(n, ["frag_id", "rule_id"], "left_semi"), ["frag_id", "rule_id"], "left_semi").groupBy("frag_id").agg(F.countDistinct("word_id").alias("gen"))
    out = totals.join(gen, "frag_id", "left").select("frag_id", F.col("n").alias("total_words"), F.coalesce("gen", F.lit(0)).alias("gen_words"))
    return out.withColumn("gen_coverage", F.round(F.col("gen_words") / F.col("total_words"), 9))


@query(f"with {_COVER} select frag_id, word_id from p where not exists (select 1 from sel join fh using (frag_id, rule_id) where sel.frag_id = p.frag_id and fh.word_id = p.word_id)")
def q_exact_rules(spark, d):
    """Words that no chosen rule covers, which get an exact rule."""
    chosen, found, _ = _selected(spark, d)
    covered = found.join(chosen, ["frag_id", "rule_id"], "left_semi").select("frag_id", "word_id").distinct()
    return pairs(spark, d).select("frag_id", "word_id").join(covered, ["frag_id", "word_id"], "left_anti")


@query(f"""with {_COVER}, ps as (select upper(trim(word)) word, lower(trim(frag_id)) frag_id, avg(score) score from pair_scores
  where word is not null and frag_id is not null and score is not null and not isnan(score) and score between 0 and 1 group by 1, 2)
select frag_id, rule_id, count(*) n_words, count(score) n_scored, round(avg(score), 9) mean_pair_score
from sel join fh using (frag_id, rule_id) join w using (word_id) left join ps using (frag_id, word) group by 1, 2""")
def q_mean_pair_score(spark, d):
    """Mean of the pair scores of the words that each chosen rule matches; null where none of them has a score."""
    chosen, found, _ = _selected(spark, d)
    matched = found.join(chosen.select("frag_id", "rule_id"), ["frag_id", "rule_id"], "left_semi")
    named = lookup_join(matched, words(spark, d), "word_id")
    scored = named.join(W.clean_pair_scores(read(spark, d, "pair_scores")), ["frag_id", "word"], "left")
    return scored.groupBy("frag_id", "rule_id").agg(F.count(F.lit(1)).alias("n_words"), F.count("score").alias("n_scored"), F.round(F.avg("score"), 9).alias("mean_pair_score"))


K_NEG = 1000
_NEG = f"""{_FW}, h as (select frag_id, word, md5(concat_ws('|', '42', frag_id, word, cast(ord as varchar))) h, ord from fw),
fr as (select distinct frag_id from fw), pre as (select * from h order by h, frag_id, ord limit 20000),
neg as (select fr.frag_id, pre.word, pre.h, row_number() over (partition by fr.frag_id order by pre.h) rk from fr join pre on pre.frag_id <> fr.frag_id qualify rk <= {K_NEG})"""


@query(f"with {_NEG} select frag_id, count(*) n_negatives, count(distinct word) n_words, min(word) first_word, max(word) last_word from neg group by 1")
def q_negative_pool(spark, d):
    """What every fragment's sample of K_NEG words of other fragments holds."""
    return negatives(spark, d).groupBy("frag_id").agg(
        F.count(F.lit(1)).alias("n_negatives"), F.countDistinct("word").alias("n_words"), F.min("word").alias("first_word"), F.max("word").alias("last_word")
    )


def negatives(spark, d, k: int = K_NEG):
    """(frag_id, at, word): k rows of other fragments for each fragment. Each fragment meets one row, the prefix of at most 3 k rows."""
    fw = cut(frag_words(spark, d))
    prefix = V.negative_prefix(fw, k)
    array = F.array_sort(F.collect_list(F.struct("at", "f", "word")))
    held = spark.createDataFrame([(i, f, w) for i, (f, w) in enumerate(prefix)], "at int, f string, word string").agg(array.alias("a")).withColumn("one", F.lit(1))
    frags = fw.select("frag_id").distinct().withColumn("one", F.lit(1))
    own = F.slice(F.filter("a", lambda x: x["f"] != F.col("frag_id")), 1, k)
    return frags.join(F.broadcast(held), "one").select("frag_id", F.explode(own).alias("x")).select("frag_id", "x.at", "x.word")


@query(f"""with {_NEG}, {_RULES}, nh as (select neg.frag_id, count(distinct neg.h) filter (exists (select 1 from rx where regexp_full_match(neg.word, rx.regex))) hit, count(*) n from neg group by 1)
select frag_id, n pool, hit, round(hit / n, 9) overall_fpr from nh""")
def q_overall_fpr(spark, d):
    """Share of a fragment's negatives that any rule of the pool matches."""
    neg = negatives(spark, d)
    w = words(spark, d)
    hit = lookup_join(pool_hits(spark, d).select("word_id").distinct(), w, "word_id").select("word").distinct()
    marked = lookup_join(neg, hit.withColumn("m", F.lit(1)), "word", "left")
    out = marked.groupBy("frag_id").agg(F.count(F.lit(1)).alias("pool"), F.sum(F.coalesce("m", F.lit(0)).cast("long")).alias("hit"))
    return out.withColumn("overall_fpr", F.round(F.col("hit") / F.col("pool"), 9))


# ---- graph -----------------------------------------------------------------------------------------------------------------

_NB = """ptr as (select word_id, indptr, lead(indptr, 1, 9223372036854775807) over (order by word_id) nxt from word_ptr where word_id is not null and indptr is not null),
nb as (select coalesce(n.word_id, ptr.word_id) word_id, n.edge_pos, n.rank, n.neighbor_id, n.score, n.rule_id, n.edge_type from neighbors n
  left join ptr on n.word_id is null and n.edge_pos >= ptr.indptr and n.edge_pos < ptr.nxt)"""
_E = f"""{_NB}, e0 as (select least(word_id, neighbor_id) i, greatest(word_id, neighbor_id) j, score, edge_type from nb
  where word_id is not null and neighbor_id >= 0 and word_id <> neighbor_id and score is not null and not isnan(score)),
e as (select i, j, max(score) score, max_by(edge_type, struct_pack(s := score, t := edge_type)) edge_type from e0 group by 1, 2),
s as (select i, j, score, edge_type from e union all select j, i, score, edge_type from e)"""
K_TOP = 10
_TOP = f"{_E}, top as (select *, row_number() over (partition by i order by score desc, j) rank from s qualify rank <= {K_TOP})"
_DEG_ALL = f"{_E}, ids as (select distinct word_id from words where word_id is not null), dg as (select word_id, count(i) degree from ids left join s on i = word_id group by 1)"
_DEG = f"{_TOP}, ids as (select distinct word_id from words where word_id is not null), dg as (select word_id, count(i) degree from ids left join top on i = word_id group by 1)"


def _edges(spark, d):
    return G.undirected(owned_neighbors(spark, d))


def _degrees(spark, d):
    top = G.top_neighbours(G.both_directions(_edges(spark, d)), K_TOP)
    return G.degrees(read(spark, d, "words"), top)


def _all_degrees(spark, d):
    return G.degrees(read(spark, d, "words"), G.both_directions(_edges(spark, d)))


@query(f"with {_E} select i, j, cast(score as double) score, edge_type from s")
def q_symmetrise(spark, d):
    return G.both_directions(_edges(spark, d)).withColumn("score", F.col("score").cast("double"))


@query(f"with {_TOP} select i, cast(rank as int) rank, j, cast(score as double) score, edge_type from top")
def q_topk(spark, d):
    return G.top_neighbours(G.both_directions(_edges(spark, d)), K_TOP).select("i", "rank", "j", F.col("score").cast("double").alias("score"), "edge_type")


@query(f"with {_DEG} select word_id, degree, cast(sum(degree) over (order by word_id) - degree as bigint) indptr from dg")
def q_csr(spark, d):
    """CSR offsets of the table of q_topk, with its K_TOP neighbours a word."""
    return _degrees(spark, d)


@query(f"with {_DEG_ALL} select word_id, degree, cast(sum(degree) over (order by word_id) - degree as bigint) indptr from dg")
def q_csr_all(spark, d):
    """CSR offsets of all neighbours."""
    return _all_degrees(spark, d)


@query(f"with {_DEG} select count(*) n_words, cast(count(*) filter (degree > 0) as bigint) n_linked, count(*) filter (degree > 0) / count(*) coverage from dg")
def q_graph_coverage(spark, d):
    return G.graph_coverage(_degrees(spark, d))


_TYPE = "case edge_type " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(A.EDGE_TYPES)) + " end"


@query(f"with {_E} select edge_type, count(*) n_edges, {_TYPE} edge_type_name from e group by 1")
def q_edge_type_counts(spark, d):
    return G.edge_type_counts(_edges(spark, d))


@query("select row_number() over (order by rule) - 1 rule_id, rule from (select distinct rule from rules where rule is not null)")
def q_rule_pool(spark, d):
    return G.rule_pool(read(spark, d, "rules"))


@query(f"""with {_W}, {_NB}, n as (select word_id, rank, edge_pos, max(neighbor_id) neighbor_id, max(case when not isnan(score) then score end) score, max(rule_id) rule_id, max(edge_type) edge_type
  from nb where word_id is not null and rank <= 20 group by 1, 2, 3)
select n.word_id, n.rank, n.neighbor_id, w.word neighbour, cast(n.score as double) score, r.rule, {_TYPE} edge_type_name
from n left join w on w.word_id = n.neighbor_id left join rules r on r.rule_id = n.rule_id""")
def q_inspect_word(spark, d):
    return G.inspect_words(owned_neighbors(spark, d), words(spark, d), clean_rules(spark, d))


@query(f"""with {_DEG}, {_P} select frag_id, count(*) num_words, cast(count(*) filter (degree > 0) as bigint) num_linked, cast(coalesce(sum(degree), 0) as bigint) num_edges,
count(*) filter (degree > 0) / count(*) coverage_bound from p left join dg using (word_id) group by 1""")
def q_inspect_fragment(spark, d):
    """Fragments over the table of q_topk: num_edges counts K_TOP neighbours of a word at most."""
    return G.inspect_fragments(pairs(spark, d), _degrees(spark, d), hot_keys(read(spark, d, "word_frags"), "word_id"))


@query(f"""with {_DEG_ALL}, {_P} select frag_id, count(*) num_words, cast(count(*) filter (degree > 0) as bigint) num_linked, cast(coalesce(sum(degree), 0) as bigint) num_edges,
count(*) filter (degree > 0) / count(*) coverage_bound from p left join dg using (word_id) group by 1""")
def q_inspect_fragment_all(spark, d):
    """Fragments with all neighbours of their words."""
    return G.inspect_fragments(pairs(spark, d), _all_degrees(spark, d), hot_keys(read(spark, d, "word_frags"), "word_id"))


@query(f"with {_E}, {_P} select x.frag_id, count(*) n_induced from e join p x on x.word_id = e.i join p y on y.word_id = e.j and y.frag_id = x.frag_id group by 1")
def q_induced_edges(spark, d):
    return G.induced_edges(pairs(spark, d), _edges(spark, d))


# ---- matching --------------------------------------------------------------------------------------------------------------

_M = f"""{_NB}, m0 as (select rule_id, least(word_id, neighbor_id) a, greatest(word_id, neighbor_id) b, max(cast(score as double)) s from nb
 where rule_id is not null and word_id is not null and neighbor_id >= 0 and word_id <> neighbor_id and score is not null and not isnan(score) group by 1, 2, 3),
l as (select rule_id, list(struct_pack(a := a, b := b) order by s desc, a, b) es from m0 group by 1),
f as (select rule_id, unnest(list_reduce(list_transform(es, lambda e: [e]), lambda acc, x: case when len(list_filter(acc, lambda y: y.a in (x[1].a, x[1].b) or y.b in (x[1].a, x[1].b))) > 0 then acc else acc || x end)) e from l)"""


def _ruled_links(spark, d):
    """(rule_id, a, b, s), a < b: the linked words that share a rule, each pair once with its highest score."""
    ok = (F.col("neighbor_id") >= 0) & (F.col("word_id") != F.col("neighbor_id")) & ~F.isnan("score")
    e = owned_neighbors(spark, d).dropna(subset=["rule_id", "word_id", "neighbor_id", "score"]).filter(ok)
    e = e.select("rule_id", F.least("word_id", "neighbor_id").cast("long").alias("a"), F.greatest("word_id", "neighbor_id").cast("long").alias("b"), F.col("score").cast("double").alias("s"))
    return e.groupBy("rule_id", "a", "b").agg(F.max("s").alias("s"))


def _matched(spark, d):
    return greedy_matching(_ruled_links(spark, d), "rule_id")


@query(f"with {_M} select f.rule_id, cast(e.a as bigint) a, cast(e.b as bigint) b, s from f join m0 on m0.rule_id = f.rule_id and m0.a = f.e.a and m0.b = f.e.b")
def q_matching(spark, d):
    """Greedy matching of the linked words that share a rule."""
    return _matched(spark, d).select("rule_id", "a", "b", "s")


@query(f"""with {_M}, ends as (select rule_id, a x from m0 union select rule_id, b from m0), used as (select rule_id, e.a x from f union all select rule_id, e.b from f)
select rule_id, cast(x as bigint) word_id from ends where not exists (select 1 from used where used.rule_id = ends.rule_id and used.x = ends.x)""")
def q_singletons(spark, d):
    """Words of a rule's links that the matching leaves alone."""
    links = cut(_ruled_links(spark, d))
    ends = links.select("rule_id", F.explode(F.array("a", "b")).alias("word_id")).distinct()
    used = greedy_matching(links, "rule_id").select("rule_id", F.explode(F.array("a", "b")).alias("word_id"))
    return ends.join(used, ["rule_id", "word_id"], "left_anti")
