"""Queries of alignment scores, parsed rules and lookups, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from motifloom.functions import alphabet as A
from motifloom.functions import rules as R
from motifloom.operators import graph as G
from motifloom.operators.align import align_pairs, register, score_pairs
from motifloom.operators.anchors import numbered_pairs
from motifloom.operators.neighbor_rows import owned_neighbors
from motifloom.operators.queries_core import _CAND, _E, _NB, _RULES, _W, clean_rules, linked_words, words
from motifloom.operators.skew import hot_keys, lookup_join
from motifloom.session import cut, read

QUERIES, SQL = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


_CLASSES = ", ".join(f"({i}, '{c.name}', '{c.residues}', {c.mine}, {c.graph})" for i, c in enumerate(A.CLASSES))
_LINKED = f"{_W}, {_E}, lk as (select i, j, p.word wi, q.word wj from e join w p on p.word_id = i join w q on q.word_id = j), c(o, name, aas, mine, graph) as (values {_CLASSES})"


@query(f"with {_LINKED} select i, j, wi, wj from lk")
def q_linked_words(spark, d):
    return linked_words(spark, d)


# The scores in SQL: one row of cells a step of the recursion. A step back in the same row costs the same wherever it starts, so the best of these is a running maximum.
@query(f"""with recursive {_LINKED},
p as (select row_number() over () id, i pi, j pj, wi q, wj t, length(wi) m, length(wj) n from lk),
ch as (select distinct unnest(string_split(word, '')) x from w),
sc as (select a.x x, b.x y, cast(case when a.x = b.x then 1.0 when '_' in (a.x, b.x) then 0.5 else coalesce((select min_by(mine, o) from c where contains(aas, a.x) and contains(aas, b.x)), 0.3) end as double) s from ch a, ch b),
fl as (select cast(k as int) k, cast(case when k <= 0 then 0 when k <= 2 then -0.3 when k <= 4 then -0.5 else -1.0 - (k - 4) * 0.3 end as double) f from range(0, (select max(length(word)) + 1 from w)) u(k)),
dp as (select id, 0 as i, fl.k as j, f v, -1e300::double v2, -1e300::double v3, -1e300::double v4 from p join fl on fl.k <= n
 union all
 select id, i + 1, j, max(x + 0.3 * j) over (partition by id order by j) - 0.3 * j, v, v2, v3 from (
   select dp.id, dp.i, dp.j, v, v2, v3, case when dp.j = 0 then v - 0.8 else greatest(lag(v, 1) over k + sc.s, v - 0.8,
      case when sc.x = '_' and sc.y <> '_' then greatest(lag(v, 1) over k + 0.5, coalesce(lag(v, 2) over k + 1.0, -1e300), coalesce(lag(v, 3) over k + 1.5, -1e300), coalesce(lag(v, 4) over k + 2.0, -1e300)) else -1e300 end,
      case when sc.x <> '_' and sc.y = '_' then greatest(lag(v, 1) over k + 0.5, lag(v2, 1) over k + 1.0, lag(v3, 1) over k + 1.5, lag(v4, 1) over k + 2.0) else -1e300 end) end x
   from dp join p on p.id = dp.id and dp.i < p.m left join sc on sc.x = p.q[dp.i + 1] and sc.y = p.t[dp.j] window k as (partition by dp.id order by dp.j)) z)
select pi i, pj j, round(max(v + f), 3) + 0.0::double score from dp join p on p.id = dp.id and dp.i = p.m join fl on fl.k = p.n - dp.j group by 1, 2""")
def q_align_score(spark, d):
    """Scores of the mining alignment of all linked words, the word with the smaller id first."""
    return align_pairs(linked_words(spark, d), "wi", "wj", float("-inf")).select("i", "j", F.round(F.col("score").cast("double"), 3).alias("score"))


@query(f"""with recursive {_LINKED},
l2 as (select i, j, regexp_replace(wi, '[^A-Z]', '', 'g') a, regexp_replace(wj, '[^A-Z]', '', 'g') b from lk),
p as (select row_number() over () id, i pi, j pj, q, t, length(q) m, length(t) n from (select i, j, a q, b t from l2 union all select i, j, b, a from l2) where q <> '' and t <> ''),
ch as (select chr(cast(x as int)) x from range(65, 91) u(x)),
sc as (select a.x x, b.x y, case when a.x = b.x then 1.0 else coalesce((select min_by(graph, o) from c where contains(aas, a.x) and contains(aas, b.x)), -1.0) end s from ch a, ch b),
dp as (select id, 0 as i, cast(k as int) as j, cast(case when k = 0 then 0 else -0.2 * k - 0.2 end as double) v from p, unnest(range(0, n + 1)) u(k)
 union all
 select id, i + 1, j, max(x + 0.15 * j) over (partition by id order by j) - 0.15 * j from (
   select dp.id, dp.i, dp.j, greatest(lag(v, 1, -1e300) over (partition by dp.id order by dp.j) + coalesce(sc.s, -1.0), case when dp.j = 0 then -1e300 else v - 0.15 end) x
   from dp join p on p.id = dp.id and dp.i < p.m left join sc on sc.x = p.q[dp.i + 1] and sc.y = p.t[dp.j]) z),
b as (select pi i, pj j, max(v + case when p.n > dp.j then -0.2 * (p.n - dp.j) - 0.2 else 0 end) s from dp join p on p.id = dp.id and dp.i = p.m group by 1, 2)
select i, j, round(coalesce(s, 0.0), 6) + 0.0::double score from l2 left join b using (i, j)""")
def q_graph_score(spark, d):
    """Scores of the graph's alignment of all linked words in the better direction."""
    return score_pairs(linked_words(spark, d), "wi", "wj", None).select("i", "j", F.round("score", 6).alias("score"))


@query(f"""with {_W}, c(o, name, aas, mine, graph) as (values {_CLASSES}),
t as (select distinct substr(word, cast(i as int), 1) a, substr(word, cast(i as int) + 1, 1) b from w, unnest(range(1, length(word))) u(i))
select a, b, cast(case when a = b then 1.0 when '_' in (a, b) then 0.5 else coalesce(min_by(mine, o), 0.3) end as double) score, coalesce(string_agg(name, ' ' order by o), '') classes
from t left join c on contains(aas, a) and contains(aas, b) group by a, b""")
def q_residue_match(spark, d):
    """The SQL function residue_match of all residues that stand next to each other."""
    register(spark)
    w = words(spark, d).filter(F.length("word") > 1)
    at = w.select("word", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("i"))
    two = at.select(F.substring("word", F.col("i"), F.lit(1)).alias("a"), F.substring("word", F.col("i") + 1, F.lit(1)).alias("b")).distinct()
    return two.withColumn("m", F.expr("residue_match(a, b)")).select("a", "b", "m.score", F.array_join("m.classes", " ").alias("classes"))


@query("""with t as (select rule_id, unnest(string_split(rule, '-')) text, generate_subscripts(string_split(rule, '-'), 1) place from rules where rule is not null and rule_id is not null)
select rule_id, cast(place - 1 as int) place, text,
 case when text = '_' then 'gap' when text like 'x(%' then 'range' when text like '[%' then 'class' when text like '(%' then 'optional' else 'literal' end kind,
 case when text = '_' or text like 'x(%' then '' else regexp_extract(text, '[A-Za-z]+') end "value",
 cast(case when text like 'x(%' then regexp_extract(text, '(\\d+),', 1) else '1' end as int) least,
 cast(case when text = '_' then '4' when text like 'x(%' then regexp_extract(text, ',(\\d+)', 1) else '1' end as int) most from t""")
def q_rule_parse(spark, d):
    """The tokens of every rule, parsed and written back."""
    tokens = clean_rules(spark, d).select("rule_id", F.posexplode(R.parsed_rule("rule")).alias("place", "t"))
    return tokens.select("rule_id", "place", "t.*")


@query(f"""with {_W}, {_RULES}, {_NB}, k as (select distinct word_id, neighbor_id, rule_id from nb where word_id is not null and neighbor_id is not null and rule_id is not null)
select k.word_id, k.neighbor_id, k.rule_id, regexp_full_match(a.word, regex) covers_word, regexp_full_match(b.word, regex) covers_neighbor
from k join rx using (rule_id) join w a on a.word_id = k.word_id join w b on b.word_id = k.neighbor_id""")
def q_rule_covers(spark, d):
    """Whether the rule of each row of neighbors covers both its words, by the function for any rule text."""
    rows = cut(owned_neighbors(spark, d).select("word_id", "neighbor_id", "rule_id").dropna().distinct())
    w = cut(words(spark, d))
    named = lookup_join(rows, w.withColumnRenamed("word", "a"), "word_id")
    named = lookup_join(named, w.select(F.col("word_id").alias("neighbor_id"), F.col("word").alias("b")), "neighbor_id", hot=hot_keys(rows, "neighbor_id"))
    ruled = lookup_join(named, clean_rules(spark, d).select("rule_id", "rule"), "rule_id", hot=hot_keys(rows, "rule_id"))
    return ruled.select("word_id", "neighbor_id", "rule_id", R.rule_covers_word("rule", "a").alias("covers_word"), R.rule_covers_word("rule", "b").alias("covers_neighbor"))


@query("""with r as (select rule_id, rule from rules where rule is not null and rule_id is not null)
select rule_id, cast(dense_rank() over (order by rule) - 1 as bigint) rule_no from r""")
def q_rule_numbers(spark, d):
    """Every rule's number in the pool of distinct rules."""
    rules = clean_rules(spark, d).select("rule_id", "rule")
    return lookup_join(rules, G.rule_pool(read(spark, d, "rules")).withColumnRenamed("rule_id", "rule_no"), "rule").select("rule_id", "rule_no")


BATCH = 10_000


@query(f"select i, j, cast((row_number() over (order by i, j) - 1) // {BATCH} as bigint) batch_id from ({'with ' + _CAND})")
def q_pair_batches(spark, d):
    """Candidate pairs in batches, as a graph is built that can be taken up again."""
    return numbered_pairs(words(spark, d), BATCH)
