"""Problems 4, 5 and 6 against brute force, and their edge cases."""

import random

import numpy as np
import pytest

from motifloom.llm import components, neardup
from motifloom.llm.components import connected_components, spanning_forest
from motifloom.llm.grams import window_hashes
from motifloom.llm.neardup import candidate_pairs, near_duplicate_groups, near_duplicate_pairs, similarity_sketch
from motifloom.llm.neighbor_rows import slice_owner
from motifloom.llm.spans import shared_share, shared_spans


def _components(links):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(up)}


def _links():
    random.seed(7)
    chain = [(k, k + 1) for k in range(1000, 1300)]
    star = [(0, k) for k in range(1, 200)]
    some = [(random.randint(2000, 2600), random.randint(2000, 2600)) for _ in range(350)]
    ladder = [(5000 - k, 5001 + k) for k in range(50)] + [(5001 + k, 4999 - k) for k in range(50)]
    links = chain + star + some + ladder + [(9, 9), (None, 4), (4, None), (11, 0), (11, 0)]
    random.shuffle(links)
    return links


@pytest.mark.parametrize("bound", [components.BOUND, 40, 3])
def test_components(spark, bound):
    links = _links()
    df = spark.createDataFrame([(a, b, 1) for a, b in links], "c int, p int, node int").repartition(6)  # clashing names
    assert {tuple(r) for r in connected_components(df, "c", "p", bound).collect()} == set(_components(links).items())
    assert connected_components(df.limit(0), "c", "p", bound).collect() == []


def test_components_take_several_levels(spark, monkeypatch):
    """A chain in order of its ids, the worst case of passing labels on, with a star on top of it."""
    links = [(k, k + 1) for k in range(3000)] + [(5, 10_000 + k) for k in range(1000)] + [(20_000 + 2 * k, 20_001 + 2 * k) for k in range(500)]
    sizes, cut = [], components.cut

    def counted(df):
        out = cut(df)
        if df.columns == ["c", "p", "child"]:
            sizes.append(out.filter("child").count())
        return out

    monkeypatch.setattr(components, "cut", counted)
    df = spark.createDataFrame(links, "a long, b long").repartition(16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else few bytes come together in one task
    try:
        assert {tuple(r) for r in connected_components(df, "a", "b", 20).collect()} == set(_components(links).items())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) >= 3 and all(y < x for x, y in zip(sizes, sizes[1:]))


def test_names_are_found_again():
    x = np.array([0, 1, -1, 2**62, 12345], dtype=np.int64)
    assert (components.unmix(components.mix(x.view(np.uint64))).view(np.int64) == x).all()


def test_spanning_forest():
    links = [(a, b) for a, b in _links() if None not in (a, b) and a != b]
    u, v = (np.array(x) for x in zip(*links))
    c, p = spanning_forest(np.maximum(u, v), np.minimum(u, v))
    want = {x: r for x, r in _components(links).items() if x != r}
    assert dict(zip(c.tolist(), p.tolist())) == want


def test_slice_owner(spark):
    ptr = [(0, 0), (1, 3), (2, 3), (3, 700), (4, None), (None, 5), (5, 2000)]
    pos = [0, 2, 3, 699, 700, 1999, 2000, 10_000, -1]
    p = spark.createDataFrame(ptr, "word_id int, indptr long")
    e = spark.createDataFrame([(x, f"r{x}", 77) for x in pos], "edge_pos long, more string, word_id int")
    for width in (4, 1 << 18):
        got = {r.edge_pos: r.word_id for r in slice_owner(e, p, width=width).collect()}
        assert got == {0: 0, 2: 0, 3: 2, 699: 2, 700: 3, 1999: 3, 2000: 5, 10_000: 5, -1: None}


def _grams(t, k=4):
    return {t[i : i + k] for i in range(len(t) - k + 1)}


def _texts(n=120):
    random.seed(3)
    base = ["".join(random.choice("ACDEFGHIKLMNPQRSTVWY_") for _ in range(random.randint(20, 90))) for _ in range(n // 3)]
    out = list(base)
    for t in base:
        at = random.randrange(len(t))
        out += [t[:at] + random.choice(["", "K", "WW"]) + t[at + 1 :], t[at:] + t[:at]]
    return out


def test_near_duplicates(spark):
    texts = _texts()
    rows = list(enumerate(texts)) + [(1000, texts[0]), (1001, texts[0]), (1002, None), (None, texts[1]), (1003, "abc"), (1004, ""), (1005, "long" * 5000), (5, texts[5])]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "id int, text string, rep string").repartition(5)
    ids = sorted({(i, t) for i, t in rows if i is not None and t is not None})
    want = set()
    for k, (i, s) in enumerate(ids):
        for j, t in ids[k + 1 :]:
            a, b = _grams(s), _grams(t)
            if a and b and len(a & b) >= 0.5 * len(a | b):
                want.add((i, j))
    got = [tuple(r) for r in near_duplicate_pairs(df, "id", "text").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 60
    groups = {r.id: r for r in near_duplicate_groups(df, "id", "text").collect()}
    label = _components(want)
    assert {i: r.group_id for i, r in groups.items()} == {i: label.get(i, i) for i, _ in ids}
    assert groups[1001].class_id == 0 and groups[1003].n_links == 0 and len(groups) == len(ids)
    assert groups[0].n_links == len({dict(ids)[j if i == 0 else i] for i, j in want if 0 in (i, j)} - {texts[0]})
    assert near_duplicate_pairs(df.limit(0), "id", "text").collect() == [] == near_duplicate_groups(df.limit(0), "id", "text").collect()


def test_large_classes_keep_all_their_pairs(spark):
    texts = _texts(9)
    near = texts[0][:30] + "K" + texts[0][31:]
    rows = [(k, texts[0]) for k in range(70)] + [(100 + k, near) for k in range(66)] + [(300, texts[1])]
    df = spark.createDataFrame(rows, "id int, text string").repartition(5)
    a, b = _grams(texts[0]), _grams(near)
    assert len(a & b) >= 0.5 * len(a | b)
    want = {(i, j) for i, s in rows for j, t in rows if i < j and 300 not in (i, j)}
    for split in (512, 16):
        got = [tuple(r) for r in near_duplicate_pairs(df, "id", "text", split=split).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    groups = {r.id: r for r in near_duplicate_groups(df, "id", "text").collect()}
    assert groups[69].class_id == 0 and groups[165].class_id == 100 and groups[165].group_id == 0 and groups[165].n_links == 1


def test_large_buckets_are_split_without_loss(spark):
    keys = spark.createDataFrame([(i, 10 + i % 3, 1) for i in range(150)] + [(i, 10, 2) for i in range(5)] + [(999, 10, 3)], "rep int, n int, key long").select("key", "rep", "n")
    whole = {tuple(r) for r in candidate_pairs(keys, 0.9, split=1000).collect()}
    parts = [tuple(r) for r in candidate_pairs(keys, 0.9, split=20).collect()]
    assert set(parts) == whole and len(parts) == len(whole)
    sizes = {i: 10 + i % 3 for i in range(150)}
    assert {(a, b) for a in range(5, 150) for b in range(a + 1, 150) if min(sizes[a], sizes[b]) >= 0.9 * max(sizes[a], sizes[b])} <= whole


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(5)
    bins, errors = 64, []
    for share in (0.1, 0.5, 0.9):
        for size in (5, 40, 400):
            same = max(1, int(size * share))
            pool = rng.integers(1, 2**63, 2 * size - same, dtype=np.uint64)
            a, b = pool[:size], np.concatenate([pool[:same], pool[size:]])
            sk = similarity_sketch(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), 3, bins)
            assert (sk[:2] != np.iinfo(np.uint64).max).all() and (sk[2] == np.iinfo(np.uint64).max).all()
            errors.append(abs((sk[0] == sk[1]).mean() - same / len(pool)))
    assert max(errors) < 0.25 and np.mean(errors) < 0.1


def test_window_hashes():
    texts = ["", "abc", "abcabc", "xéabc", "ab"]
    owner, pos, h = window_hashes(texts, 3)
    by = {}
    for o, p, x in zip(owner.tolist(), pos.tolist(), h.tolist()):
        by.setdefault(texts[o][p : p + 3], set()).add(x)
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)
    assert len(owner) == sum(max(0, len(t) - 2) for t in texts) and window_hashes(["a"], 3)[0].size == 0


def _brute_spans(rows, n, keep_first):
    first, ids = {}, {}
    for i, t in sorted(rows.items()):
        for p in range(len(t) - n + 1):
            first.setdefault(t[p : p + n], (i, p))
            ids.setdefault(t[p : p + n], set()).add(i)
    out = set()
    for i, t in rows.items():
        hit = [p for p in range(len(t) - n + 1) if len(ids[t[p : p + n]]) > 1 and not (keep_first and first[t[p : p + n]] == (i, p))]
        mark = {c for p in hit for c in range(p, p + n)}
        for c in sorted(mark):
            if c - 1 not in mark:
                e = c
                while e in mark:
                    e += 1
                out.add((i, c, e))
    return out


@pytest.mark.parametrize("keep_first", [False, True])
def test_spans(spark, keep_first):
    random.seed(8)
    parts = ["".join(random.choice("ABCDEFGH_") for _ in range(random.randint(5, 30))) for _ in range(12)]
    rows = {i: "".join(random.choice(parts) for _ in range(random.randint(1, 4))) for i in range(60)}
    rows |= {100: "Z" * 40, 101: "short", 102: "", 103: "Q" * 15, 104: "Q" * 15 + "R" + "Q" * 15, 105: "MNOP" * 8000}
    data = [(i, t, 0) for i, t in rows.items()] + [(None, "Q" * 20, 0), (106, None, 0), (3, rows[3], 0)]
    df = spark.createDataFrame(data, "id int, text string, pos int").repartition(4)
    got = [tuple(r) for r in shared_spans(df, "id", "text", 15, keep_first).collect()]
    assert set(got) == _brute_spans(rows, 15, keep_first) and len(got) == len(set(got))
    assert shared_spans(df.limit(0), "id", "text").collect() == []


def test_spans_with_a_full_bitmap(spark, monkeypatch):
    from motifloom.llm import spans

    monkeypatch.setattr(spans, "fixed_bitmap", lambda df, h: np.full(1 << 12, 255, np.uint8))
    monkeypatch.setattr(spans, "STRETCH", 8)
    rows = {1: "ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 3, 2: "xx" + "ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 2, 3: "JKLMNOPQRSTUVWXYZABCDEF", 4: "q" * 40, 5: "ABCDEFGHIJKLMNO" + "-" * 20 + "KLMNOPQRSTUVWXYZ", 9: "q" * 40}
    df = spark.createDataFrame(list(rows.items()), "id int, text string")
    for first in (False, True):
        got = [tuple(r) for r in shared_spans(df, "id", "text", 15, first).collect()]
        assert set(got) == _brute_spans(rows, 15, first) and len(got) == len(set(got))


def test_bitmap(spark):
    from motifloom.llm.grams import fixed_bitmap, has_bit

    h = np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 500)
    bits = fixed_bitmap(spark.createDataFrame([(int(x),) for x in h[:250]], "h long"), "h")
    found = has_bit(bits, h.view(np.uint64))
    assert bits.nbytes == 1 << 23 and found[:250].all() and found[250:].sum() < 3
    assert not has_bit(fixed_bitmap(spark.createDataFrame([], "h long"), "h"), h.view(np.uint64)).any()


def test_share(spark):
    df = spark.createDataFrame([(1, "ABCDEFGHIJKLMNOPQRST"), (2, "xxABCDEFGHIJKLMNO"), (3, ""), (4, None)], "id int, text string")
    got = {r.id: (r.n_chars, r.shared_chars, r.share) for r in shared_share(df, "id", "text").collect()}
    assert got == {1: (20, 15, 0.75), 2: (17, 15, round(15 / 17, 9)), 3: (0, 0, 0.0)}
