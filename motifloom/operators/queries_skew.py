"""Queries of problem 2."""

from motifloom.operators.skew import dominant_keys, frag_word_key_stats
from motifloom.session import read


def p2_found(spark, sf_dir):
    return dominant_keys(read(spark, sf_dir, "word_frags"))


def p2_key_stats(spark, sf_dir):
    return frag_word_key_stats(read(spark, sf_dir, "word_frags"))


QUERIES = {"p2_found": p2_found, "p2_key_stats": p2_key_stats}

_KEYS = """
select 'frag' key_kind, lower(trim(frag_id)) key_value, cast(word_id as varchar) partner, pos from word_frags where frag_id is not null
union all
select 'word', cast(word_id as varchar), lower(trim(frag_id)), pos from word_frags where word_id is not null
"""

SQL = {
    "p2_found": f"""
with k as ({_KEYS})
select key_kind, key_value from k group by 1, 2 having count(*) * 100 >= 3 * (select count(*) from word_frags)""",
    "p2_key_stats": f"""
with k as ({_KEYS})
select key_kind, key_value, count(*) n_rows, count(distinct partner) n_partners, min(pos) first_pos, max(pos) last_pos
from k group by 1, 2""",
}
