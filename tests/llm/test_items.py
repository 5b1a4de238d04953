"""Problems 1, 3 and 7 against brute force, and their edge cases."""

import itertools
import random
from collections import defaultdict

import pytest

from motifloom.llm.cooccur import cooccurring_pairs
from motifloom.llm.sample import block_sample, sample_words
from motifloom.llm.topn import survivors, top_n


def _brute_pairs(rows, support, lift):
    of = defaultdict(set)
    for r, i in rows:
        if r is not None and i is not None:
            of[i].add(r)
    n = len(set().union(*of.values())) if of else 0
    out = {}
    for a, b in itertools.combinations(sorted(of), 2):
        c = len(of[a] & of[b])
        if c >= support and c * n >= lift * len(of[a]) * len(of[b]):
            out[a, b] = (c, len(of[a]), len(of[b]), n)
    return out


@pytest.mark.parametrize("options", [{}, {"max_heavy": 3}, {"heavy_share": 1}, {"block_records": 16}, {"big_record_items": 5}, {"heavy_share": 8, "big_record_items": 5, "block_records": 64}, {"max_heavy": 0, "block_items": 3}])
def test_pairs_equal_brute_force(spark, options):
    random.seed(2)
    rows = [(r, f"i{int(random.paretovariate(0.7)) % 25:02d}") for r in range(300) for _ in range(random.randint(1, 5))]
    rows += [(7, f"i{k:02d}") for k in range(25)] + [(8, f"i{k:02d}") for k in range(25)]  # records that hold all items
    rows += [(r, x) for r in range(50, 80) for x in ("z1", "z2")] + [(None, "i01"), (3, None)] + [(1, "i01")] * 5
    for support, lift in ((3, 1.5), (1, 0.0)):
        df = spark.createDataFrame(rows, "rec int, it string").repartition(5)
        got = {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.n_records) for r in cooccurring_pairs(df, "rec", "it", support, lift, **options).collect()}
        assert got == _brute_pairs(rows, support, lift) and ("z1", "z2") in got


def test_pairs_edges(spark):
    empty = spark.createDataFrame([], "record int, item string, n_ab int")  # names that clash with the operator's own
    assert cooccurring_pairs(empty, "record", "item", 1, 0.0).collect() == []
    one = spark.createDataFrame([(1, "a", 9), (1, "b", 9)], "record int, item string, n_ab int")
    (row,) = cooccurring_pairs(one, "record", "item", 1, 0.0).collect()
    assert (row.item_a, row.item_b, row.n_ab, row.lift) == ("a", "b", 1, 1.0)


def test_sample_is_stable(spark):
    rows = [(i, f" w{i} ", 1 + i % 7) for i in range(20_000)]
    df = spark.createDataFrame(rows, "word_id int, word string, batch_id int")
    all_ = {r.word_id for r in sample_words(df).collect()}
    assert all_ == {r.word_id for r in sample_words(df.repartition(7).orderBy("word")).collect()}
    for b in (1, 3, 6):
        early = {r.word_id for r in sample_words(df.filter(df.batch_id <= b)).collect()}
        assert early == {i for i in all_ if 1 + i % 7 <= b}
    # exactly k places of each whole block, spread over the block
    for block in range(19):
        assert sum(block * 1009 <= i < (block + 1) * 1009 for i in all_) == 101
    assert {r.word_id for r in sample_words(df, seed="other").collect()} != all_


def test_sample_edges(spark):
    rows = [(None, "a", 1), (-5, "b", 1), (3, None, 1), (4, "x", 2), (4, " X", 1), (10**12, "far", None)]
    df = spark.createDataFrame(rows, "word_id long, word string, batch_id int")
    assert [tuple(r) for r in sample_words(df, k=1009).orderBy("word_id").collect()] == [(4, "X", 1), (10**12, "FAR", None)]
    assert sample_words(df.limit(0)).collect() == [] and block_sample(df, "word_id", 0).collect() == []
    with pytest.raises(ValueError):
        block_sample(df, "word_id", 1, block=100)
    with pytest.raises(ValueError):
        block_sample(df, "word_id", 2000)


def _brute_top(rows, n):
    best = {}
    for g, i, s in rows:
        if None not in (g, i, s) and s == s:
            best[g, i] = max(best.get((g, i), float("-inf")), s)
    by = defaultdict(list)
    for (g, i), s in best.items():
        by[g].append((-s, i))
    return {(g, i, -s, k + 1) for g, v in by.items() for k, (s, i) in enumerate(sorted(v)[:n])}


@pytest.mark.parametrize("n", [1, 5, 1000])
def test_top_equals_brute_force(spark, monkeypatch, n):
    random.seed(4)
    rows = [(random.choice([0, 0, 0, 1, random.randint(2, 60)]), random.randint(0, 80), random.choice([1.0, 2.0, 2.5, 3.0, -1.0])) for _ in range(4000)]
    rows += [(None, 1, 9.0), (1, None, 9.0), (1, 1, None), (1, 2, float("nan")), (90, 1, float("inf")), (90, 2, float("-inf"))]
    df = spark.createDataFrame(rows, "g int, item int, s double")  # g clashes with the operator's own name
    for parts in (1, 9):
        assert {tuple(r) for r in top_n(df.repartition(parts), "g", "item", "s", n).collect()} == _brute_top(rows, n)


@pytest.mark.parametrize("groups", [1, 3, 1000])
def test_bounds_prune_hot_groups_before_the_shuffle(spark, monkeypatch, groups):
    random.seed(6)
    rows = [(0, k, float(k % 7)) for k in range(6000)] + [(1 + k % 50, k, random.random()) for k in range(3000)]
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "g long, i long, s double").repartition(6)
    kept = survivors(df, 5, groups).groupBy("g").count().collect()
    assert {r.g: r["count"] for r in kept}[0] < 60  # of 6,000 rows with many equal scores
    assert {tuple(r) for r in top_n(df, "g", "i", "s", 5, groups).collect()} == _brute_top(rows, 5)


def test_bounds_of_full_buffers(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from motifloom.llm import topn

    monkeypatch.setattr(topn, "BUFFER_ROWS", 500)
    rng = np.random.default_rng(1)
    g, i, s = rng.integers(0, 40, 2000), rng.integers(0, 100, 2000), rng.integers(0, 5, 2000).astype(float)
    batch = lambda k: pa.RecordBatch.from_arrays([pa.array(x[k : k + 37]) for x in (g, i, s)], names=["g", "i", "s"])
    out = pa.Table.from_batches(list(topn._bounds(3)(batch(k) for k in range(0, 2000, 37))))
    best = {(g, rank): (s, -i) for g, i, s, rank in _brute_top(zip(g.tolist(), i.tolist(), s.tolist()), 3)}
    assert out.num_rows > 40 and all((x["s"], -x["i"]) <= best[x["g"], 3] for x in out.to_pylist())


def test_top_edges(spark):
    df = spark.createDataFrame([(1, 1, 1.0)], "a int, b int, c float")
    assert top_n(df, "a", "b", "c", 0).collect() == [] and top_n(df.limit(0), "a", "b", "c").collect() == []
    assert top_n(df, "a", "b", "c").schema["c"].dataType.simpleString() == "float"
