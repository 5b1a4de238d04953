"""Problems 8, 9 and 10: exact round trips, brute force, held-out accuracy, edge cases."""

import base64
import random
import re
from pathlib import Path

import numpy as np
import pytest

from motifloom.llm.languages import KernelModel, document_languages, fit, grams, label_language, prose_languages
from motifloom.llm.leaks import END, _windows_of, cgk_embed, edit_distance, leaked_items, signatures, span_signatures, word_codes
from motifloom.llm.mail import blocks, units
from motifloom.llm.packing import TOKENIZER, pack_windows, shortest_pack_first, token_counts

DATA = Path("/root/testdata/sf0.01")
needs_data = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")


# ---- packing ----


@pytest.mark.parametrize("lengths, least_fill", [([2048] * 5, 1.0), ([1024] * 9, 0.9), ([1500] * 10, 0.7), (list(range(1, 2049)), 0.95), ([3] * 10_000, 0.97), ([1] * 7, 0.0)])
def test_patterns(lengths, least_fill):
    h = {n: lengths.count(n) for n in set(lengths)}
    got = shortest_pack_first(h, 2048)
    held = {}
    for packs, pattern in got:
        assert packs > 0 and sum(n * c for n, c in pattern.items()) <= 2048
        for n, c in pattern.items():
            held[n] = held.get(n, 0) + packs * c
    assert held == h and sum(lengths) >= least_fill * 2048 * sum(p for p, _ in got)
    assert shortest_pack_first({}, 2048) == []


def test_windows(spark):
    random.seed(1)
    rows = [(i, min(400, int(random.lognormvariate(3.5, 1))), "x") for i in range(3000)]
    rows += [(5000 + i, 37, "x") for i in range(1500)] + [(9001, None, "x"), (None, 5, "x"), (9002, 0, "x"), (9003, -4, "x"), (9004, 10_007, "x"), (9005, 128, "x")]
    df = spark.createDataFrame(rows, "id int, n int, len string")
    frames = [pack_windows(df.repartition(k), "id", "n", 128, ranks_per_shard=s).collect() for k, s in ((1, 10**6), (6, 10**6), (5, 50))]
    assert sorted(map(tuple, frames[0])) == sorted(map(tuple, frames[1]))
    for got in frames:
        length = {i: n for i, n, _ in rows if i is not None and n and n > 0}
        seen, used = {}, {}
        for r in got:
            seen.setdefault(r.id, []).append((r.piece, r.piece_start, r.n_tokens))
            used.setdefault(r.window_id, []).append((r.window_offset, r.n_tokens))
        assert set(seen) == set(length)
        for i, pieces in seen.items():
            pieces.sort()
            assert [p for p, _, _ in pieces] == list(range(len(pieces))) and sum(n for _, _, n in pieces) == length[i]
            assert len(pieces) == -(-length[i] // 128) and [s for _, s, _ in pieces] == [128 * p for p, _, _ in pieces]
        for held in used.values():
            held.sort()
            assert all(a + n <= b for (a, n), (b, _) in zip(held, held[1:])) and held[-1][0] + held[-1][1] <= 128
        assert sorted(used) == list(range(len(used))) and sum(length.values()) / 128 / len(used) > 0.97
    assert pack_windows(df.limit(0), "id", "n").collect() == []


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world", 0), (2, "", 0), (3, None, 0), (4, "a b " * 50_000, 0)], "id int, text string, n_tokens int")
    got = {r.id: r.n_tokens for r in token_counts(df, "id", "text", TOKENIZER).collect()}
    assert got[1] == 2 and got[2] == 0 and set(got) == {1, 2, 4} and got[4] > 90_000


# ---- mail ----

_B64 = base64.encodebytes("Zwölf Kästen\n\nund mehr".encode("latin-1")).decode()
_MAIL = (
    'From: a@b.example\r\nContent-Type: multipart/mixed; boundary="=_x"\r\n\r\n--=_x\r\nContent-Type: text/plain; charset=iso-8859-1\r\n'
    "Content-Transfer-Encoding: quoted-printable\r\n\r\nSch=F6ne Gr=\r\n=FC=DFe\r\n \r\n\r\nzweiter Block\r\n\r\n--=_x\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    "<p>a<b>b</b> &ouml;</p>\r\n\r\n--=_x\r\nContent-Type: text/plain; charset=iso-8859-1\r\nContent-Transfer-Encoding: base64\r\n\r\n"
    + _B64[:8] + "\r\n\r\n" + _B64[8:] + "\r\n--=_x\r\nContent-Type: text/plain\r\n\r\nlast"
)


def test_units():
    got = [tuple(u) for u in units(_MAIL)]
    assert (2, "body", "Schöne Grüße") in got and (3, "body", "zweiter Block") in got
    assert [" ".join(t.split()) for b, k, t in got if b == 5] == ["a b ö"]
    assert [t for _, k, t in got if k == "base64"] == ["Zwölf Kästen\n\nund mehr"]
    assert got[-1][1:] == ("body", "last") and [k for k, *_ in got] == [0, 1, 2, 3, 4, 5, 6, 7, 9, 10]
    assert list(units("")) == [] and list(units(" \n\t\n")) == []
    assert blocks("a\n\n \n\nb\r\rc") == ["a", "b", "c"]


def test_units_never_fail():
    random.seed(9)
    for _ in range(300):
        t = "".join(random.choice([*"ab=-<>&;\n\r ", "--=_x", "Content-Type: text/html; charset=nope\n", "Content-Transfer-Encoding: base64\n", "=C3", "\n\n", _MAIL[:80]]) for _ in range(40))
        list(units(t))
        list(units(_MAIL[: random.randrange(len(_MAIL))] + t))


# ---- leaks ----


def _words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(n)]


def test_embedding_and_distance():
    rng = np.random.default_rng(2)
    a = rng.integers(1, 50, (400, 12))
    assert (cgk_embed(a, 1) == cgk_embed(a.copy(), 1)).all() and (edit_distance(a, a) == 0).all()
    b = a.copy()
    b[:, 5] = 60
    assert (edit_distance(a, b) == 1).all()
    c = np.concatenate([a[:, 1:], np.full((400, 1), 70)], axis=1)
    assert (edit_distance(a, c) == 2).all()
    assert (edit_distance(np.zeros((1, 4), int), np.zeros((1, 4), int)) == 4).all()  # unknown words equal nothing
    same = (signatures(a) == signatures(b)).any(axis=1).mean()
    assert same >= 0.9 and (signatures(a) == signatures(a[::-1].copy())).any(axis=1).mean() < 0.05


def test_windows_of():
    codes = np.array([1, 2, 3, END, 4, 9, 5])
    odd = codes == 9
    assert _windows_of(codes, 3, odd, 0).tolist() == [0] and _windows_of(codes, 3, odd, 1).tolist() == [0, 4]
    assert _windows_of(codes[:1], 3, odd[:1], 1).size == 0


def test_word_codes():
    texts = ["Straße, 12a_b\0c", "", "straße 12A b?C", "-- \n", "𝐀𝐛 ǅ İx"]
    codes, owner = word_codes(texts)
    per = [codes[owner == k].tolist() for k in range(len(texts))]
    assert per[0] == per[2] and len(per[0]) == 5 and per[1] == per[3] == [END]
    assert [len(p) - 1 for p in per] == [len(re.findall(r"[^\W_]+", t.lower())) for t in texts] and word_codes([])[0].size == 0
    vocab = [f"w{k}x{k * k}" for k in range(20_000)]
    assert len(set(word_codes([" ".join(vocab)])[0].tolist())) == 20_001 and word_codes(["ab ba"])[0][0] != word_codes(["ab ba"])[0][1]


def test_leaks(spark):
    vocab = _words(300, 1)
    random.seed(2)
    item = {k: [random.choice(vocab) for _ in range(40)] for k in range(8)}
    item[8] = item[0][:20] + item[1][:20]
    item[9] = item[2][:11]  # too short
    say = lambda ws: " ".join(ws)
    edited = item[3][5:17]
    edited[6] = "other"
    docs = {
        1: "From: x\n\n" + say(_words(30, 5)) + " " + say(item[0][3:16]).upper().replace(" ", ",\n> ") + " end",
        2: "From: x\n\nintro " + say(item[1][:11]),  # one word short
        3: "From: x\n\n" + say(item[1][:6]) + "\n\n" + say(item[1][6:14]),  # across blocks
        4: "Content-Transfer-Encoding: base64\n\n" + base64.encodebytes(("x\n\n" + say(item[4][2:9]) + "\n\n" + say(item[4][9:16])).encode()).decode(),
        5: "Content-Type: text/html\n\n<p>" + "</b> <b>".join(item[5]) + "</p>",
        6: "From: x\n\n" + say(edited), 7: None, 8: "", 9: "From: x\n\n" + say(item[9]) + " z", 10: "From: x\n\n" + "lorem ipsum " * 20_000 + say(item[6]),
    }
    d = spark.createDataFrame([(k, t, 1) for k, t in docs.items()] + [(None, "From: x\n\n" + say(item[0]), 1), (1, docs[1], 1)], "id long, text string, item int")
    i = spark.createDataFrame([(k, say(w)) for k, w in item.items()] + [(None, say(item[0])), (0, say(item[0])), (50, None)], "item_id long, t string")
    want = {(1, 0): 0, (1, 8): 0, (4, 4): 0, (5, 5): 0, (6, 3): 1, (10, 6): 0}
    for parts in (1, 3):
        got = {(r.id, r.item): r.edits for r in leaked_items(d.repartition(parts), "id", "text", i, "item_id", "t").collect()}
        assert {k: v for k, v in got.items() if v == 0 or k == (6, 3)} == want and set(got) - set(want) <= {(2, 1), (2, 8), (9, 2)}
    assert leaked_items(d.limit(0), "id", "text", i, "item_id", "t").collect() == [] == leaked_items(d, "id", "text", i.limit(0), "item_id", "t").collect()


def test_leaks_by_inserted_and_dropped_words(spark):
    item = _words(16, 21)
    docs, want = [], {}
    for p in range(1, 11):  # at every inner place of a 12-word passage, between other words
        head, tail = _words(9, 100 + p), _words(9, 200 + p)
        for k, edited in enumerate((item[2 : 2 + p] + ["other"] + item[2 + p : 14], item[2 : 2 + p] + item[3 + p : 14], item[2 : 2 + p] + ["other"] + item[3 + p : 14])):
            docs.append((10 * p + k, "From: x\n\n" + " ".join(head + edited + tail)))
        docs.append((10 * p + 3, "From: x\n\n" + " ".join(head + item[2 : 2 + p] + ["other", "words"] + item[2 + p : 14] + tail)))
    index = [tuple(item[k : k + 12]) for k in range(5)]

    def distance(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a):
            now = [i + 1]
            for j, y in enumerate(b):
                now.append(min(last[j + 1] + 1, now[j] + 1, last[j] + (x != y)))
            last = now
        return last[-1]

    for k, text in docs:
        ws = text.split("\n\n")[1].split()
        least = min(distance(ws[i : i + n], w) for n in (11, 12, 13) for i in range(len(ws) - n + 1) for w in index)
        if least <= 1:
            want[k] = least
    d, i = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, t string")
    got = {r.id: r.edits for r in leaked_items(d, "id", "text", i, "item_id", "t").collect()}
    assert got == want and {10 * p + k for p in range(1, 11) for k in range(3)} <= set(want)


def test_recall_of_single_edits():
    rng = np.random.default_rng(4)
    base = rng.integers(1, 2**60, (3000, 12))
    row, at, new = np.arange(3000), rng.integers(1, 11, 3000), rng.integers(1, 2**60, 3000)
    keep = np.arange(12) != at[:, None]
    changed = base.copy()
    changed[row, at] = new
    shorter = base[keep].reshape(3000, 11)
    longer = np.insert(base.ravel(), row * 12 + at, new).reshape(3000, 13)
    item = signatures(base)
    for edited in (changed, shorter, longer):
        found = (span_signatures(edited, 12, (edited.shape[1],))[0] == item).any(axis=1).mean()
        assert found >= 0.99, edited.shape


@needs_data
def test_leaks_equal_brute_force(spark):
    docs, items = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/eval_items.parquet")
    word = re.compile(r"[^\W_]+")
    wins = {}
    for r in items.collect():
        ws = word.findall(r.text.lower())
        for k in range(len(ws) - 11):
            wins.setdefault(tuple(ws[k : k + 12]), set()).add(r.item_id)
    want = set()
    for r in docs.select("doc_id", "text").dropna().collect():
        for u in units(r.text):
            ws = word.findall(u.text.lower())
            for k in range(len(ws) - 11):
                want |= {(r.doc_id, i) for i in wins.get(tuple(ws[k : k + 12]), ())}
    got = {(r.id, r.item) for r in leaked_items(docs, "doc_id", "text", items, "item_id", "text").filter("edits = 0").collect()}
    assert got == want and len(want) > 20


# ---- languages ----

_TRAIN = {"aa": "the quick brown fox jumps over the lazy dog near this old house", "bb": "der schnelle braune Fuchs springt über den faulen Hund am alten Haus"}


def test_grams_are_distinct_and_stay_inside_their_text():
    text, gram, words = grams(["ab ab", "", "12 ?", "É", "ab"])
    assert words.tolist() == [2, 0, 0, 1, 1]
    per = {k: set(gram[text == k].tolist()) for k in range(5)}
    assert per[1] == set() == per[2] and per[4] <= per[0] and len(per[0]) == (text == 0).sum() and len(per[3]) >= 1
    alone = {k: set(grams([t])[1].tolist()) for k, t in enumerate(["ab ab", "É", "ab"])}
    assert (alone[0], alone[1], alone[2]) == (per[0], per[3], per[4])
    assert grams([])[0].size == 0


def test_kernel_scores_equal_the_kernel():
    texts, labels = list(_TRAIN.values()) * 2, list(_TRAIN) * 2
    m = KernelModel(texts, labels)
    lang, conf, words = m.classify(["the old dog", "der alte Hund", ""])
    assert [m.languages[k] for k in lang[:2]] == ["aa", "bb"] and (conf <= 1).all() and (conf >= 0.5 - 1e-9).all() and words.tolist() == [3, 3, 0]


@needs_data
def test_held_out_accuracy(spark):
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{DATA}/lang_samples.parquet").collect()]
    random.seed(1)
    random.shuffle(rows)
    for k in range(3):
        test, train = rows[k::3], [r for i, r in enumerate(rows) if i % 3 != k]
        m = KernelModel(*map(list, zip(*train)))
        lang, _, _ = m.classify([t for t, _ in test])
        assert np.mean([m.languages[a] == b for a, (_, b) in zip(lang, test)]) >= 0.98


def test_labels(spark):
    given = ["de", " DE", "deu", "German", "en_US", "en-XA", "nld", "Dutch", "fre", "xx", "", "und", None]
    df = spark.createDataFrame([(g,) for g in given], "l string")
    assert [r[0] for r in df.select(label_language(df.l)).collect()] == ["de", "de", "de", "de", "en", "en", "nl", "nl", "fr", None, None, None, None]


def test_document_languages(spark):
    a, b = _TRAIN["aa"], _TRAIN["bb"]
    train = spark.createDataFrame([(t, k) for k, t in _TRAIN.items()] * 2 + [(None, "aa"), ("x", None)], "text string, lang string")
    model = fit(train, "text", "lang")
    model.languages = ["en", "de"]  # aa, bb
    docs = [
        (1, f"From: x\n\n{a} {a}\n\n{b}\n\nshort one", None), (2, f"From: x\n\n{b}", "German"), (3, f"From: x\n\n{b}", "en"), (4, None, "en"), (5, "", None),
        (6, "From: x\n\n12 13 14 15 16 17 18 19 20", "de"), (None, f"From: x\n\n{a}", "de"), (7, f"From: x\n\n{a}\n\n \n\n{'9 ' * 30}\n\n{b} " + f"{b} " * 2000, "de"),
    ]
    df = spark.createDataFrame([(*d, 0) for d in docs], "id int, text string, lang string, segment int")
    got = {(r.id, r.segment): (r.lang, r.label_ok) for r in document_languages(df, "id", "text", "lang", model).collect()}
    assert got == {(1, 0): ("en", False), (1, 2): ("de", None), (2, 0): ("de", True), (3, 0): ("de", False), (7, 0): ("de", True), (7, 1): ("en", None)}
    assert {(r.id, r.segment) for r in prose_languages(df, "id", "text", model).collect()} == {(1, 1), (1, 2), (2, 1), (3, 1), (7, 1), (7, 3)}
    assert document_languages(df.limit(0), "id", "text", "lang", model).collect() == []
    with pytest.raises(ValueError):
        fit(train.limit(0), "text", "lang")
