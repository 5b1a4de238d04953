"""Anchors of words, their postings, and candidate pairs that share anchors."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motifloom.operators.align import graph_scores, residues_of, with_spelled_rules
from motifloom.operators.words import running_start
from motifloom.session import cut, spread

MAX_POSTING, MIN_SCORE, MIN_LENGTH, MAX_RATIO = 300, 10, 3, 5
SPLIT, LEAST_WORDS, LEAST_BLOCKS, MOST_TASKS = 1 << 15, 1 << 11, 8, 1 << 14
HITS_AT_ONCE = 1 << 20
EDGE_SPLIT, EDGE_BLOCKS = 1 << 14, 16  # pairs that are aligned make longer tasks, so there are more

# Weights in tenths, by the text before the colon of an anchor.
WEIGHTS = {"exact3": 5, "exact4": 10, "exact5": 15, "prefix3": 3, "prefix4": 6, "prefix5": 10, "prefix6": 13, "suffix3": 3, "suffix4": 6, "suffix5": 10, "suffix6": 13, "spaced": 12}
OTHER_WEIGHT = 5
LABELS = {label: k for k, label in enumerate([*WEIGHTS, "gap"])}
WORTH = np.array([WEIGHTS.get(label, OTHER_WEIGHT) for label in LABELS], dtype=np.int64)


def bare(word: Column) -> Column:
    return F.replace(word, F.lit("_"), F.lit(""))


def bare_text(word: str) -> str:
    return word.replace("_", "")


# Label, letters on the left, letters skipped, letters on the right of the anchors that slide over a word.
SLIDING = {"exact": [("exact3:", 3, 0, 0), ("exact4:", 4, 0, 0), ("exact5:", 5, 0, 0)], "spaced": [("spaced:", 3, gap, 3) for gap in range(5)]}
ENDS = (3, 4, 5, 6)


def _sliding(words: DataFrame, specs: list[tuple[str, int, int, int]], more: tuple[str, ...]) -> DataFrame:
    """One row a place: places are exploded rather than transformed in arrays, which keeps the substrings in generated code."""
    spec = F.array(*[F.struct(F.lit(t).alias("label"), F.lit(a).alias("a"), F.lit(g).alias("g"), F.lit(b).alias("b")) for t, a, g, b in specs])
    by = words.select("word_id", *more, bare(F.col("word")).alias("aa"), F.explode(spec).alias("s"))
    width = F.col("s.a") + F.col("s.g") + F.col("s.b")
    by = by.filter(F.length("aa") >= width).withColumn("i", F.explode(F.sequence(F.lit(1), F.length("aa") - width + 1)))
    left = F.substring("aa", F.col("i"), F.col("s.a"))
    right = F.concat(F.lit("***"), F.substring("aa", F.col("i") + F.col("s.a") + F.col("s.g"), F.col("s.b")))
    return by.select("word_id", *more, F.concat("s.label", left, F.when(F.col("s.b") > 0, right).otherwise("")).alias("anchor"))


def _ends(words: DataFrame, more: tuple[str, ...]) -> DataFrame:
    aa = bare(F.col("word"))
    both = lambda k: (F.concat(F.lit(f"prefix{k}:"), F.left(aa, F.lit(k))), F.concat(F.lit(f"suffix{k}:"), F.right(aa, F.lit(k))))
    every = F.array(*[F.when(F.length(aa) >= k, c) for k in ENDS for c in both(k)])
    return words.select("word_id", *more, F.explode(every).alias("anchor")).filter(F.col("anchor").isNotNull())


def _gaps(words: DataFrame, more: tuple[str, ...]) -> DataFrame:
    parts = words.filter(F.col("word").contains("_")).select("word_id", *more, F.split("word", "_").alias("p"))
    at = parts.withColumn("i", F.explode(F.sequence(F.lit(0), F.size("p") - 2)))
    left, right = F.get("p", F.col("i")), F.get("p", F.col("i") + 1)
    return at.filter((left != "") & (right != "")).select("word_id", *more, F.concat(F.lit("gap:"), left, F.lit("***"), right).alias("anchor"))


KINDS = ("exact", "prefix_suffix", "spaced", "gap")


def anchors(words: DataFrame, kinds: tuple[str, ...] = KINDS, more: tuple[str, ...] = ()) -> DataFrame:
    """(word_id, anchor) with one row for every occurrence, so repeated anchors of a word stay repeated; ``more`` names columns of words to keep. Null words have none."""
    known = spread(words.filter(F.col("word").isNotNull()).select("word_id", "word", *more))  # a word makes about a hundred anchors
    sliding = [s for k in kinds for s in SLIDING.get(k, ())]
    parts = [_sliding(known, sliding, more)] if sliding else []
    parts += [make(known, more) for k, make in (("prefix_suffix", _ends), ("gap", _gaps)) if k in kinds]
    return reduce(DataFrame.unionByName, parts)


def anchor_weight(anchor: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    return F.coalesce(table[F.split(anchor, ":")[0]], F.lit(OTHER_WEIGHT))


def postings(words: DataFrame) -> DataFrame:
    """(anchor, n_rows, n_words) of every anchor; n_rows counts repeats."""
    by = anchors(words).groupBy("anchor", "word_id").agg(F.count(F.lit(1)).alias("m"))
    return by.groupBy("anchor").agg(F.sum("m").alias("n_rows"), F.count(F.lit(1)).alias("n_words"))


def stop_anchors(words: DataFrame, max_posting: int = MAX_POSTING) -> DataFrame:
    """(anchor, n_rows) of the anchors with more than ``max_posting`` rows."""
    return postings(words).filter(F.col("n_rows") > max_posting).select("anchor", "n_rows")


def hot_anchors(words: DataFrame, cap: int) -> list[str]:
    """The anchors with more than ``cap`` rows, at most one in ``cap`` rows. Rows are first counted in 2^20 buckets by hash, which is little to shuffle; exactly, only
    in the buckets that have more than ``cap``. words is read twice: cut it first."""
    rows = anchors(words).select("anchor", F.pmod(F.xxhash64("anchor"), F.lit(1 << 20)).cast("int").alias("_h"))
    full = rows.groupBy("_h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cap).select("_h")
    counts = rows.join(F.broadcast(full), "_h", "left_semi").groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    return [r[0] for r in counts.filter(F.col("n") > cap).select("anchor").collect()]


def candidate_pairs(words: DataFrame, max_posting: int | None = MAX_POSTING, min_tenths: int = MIN_SCORE, split: int = SPLIT) -> DataFrame:
    """(i, j, tenths), i < j: pairs of words that share anchors, with the sum of the anchors' weights in tenths; for words with one row an id.

    Pairs need ``min_tenths``, ``MIN_LENGTH`` residues in both words and lengths that differ by a factor of ``MAX_RATIO`` at most. Anchors with more
    than ``max_posting`` rows are stop anchors by the operator's definition; they are counted beforehand and all tasks know them. None takes all anchors.

    Words are cut into blocks of about ``split`` words (a word of more than 16 letters counts as several), more and smaller ones in a small table. A task
    makes the anchors of two blocks, their hits and the sums, so words are shuffled but neither anchors nor hits, and it holds the anchors of two
    blocks and a few million hits however hot an anchor is.
    """
    kind = words.schema["word_id"].dataType.simpleString()
    tiles, stops = word_tiles(words, max_posting, split)
    return tiles.mapInArrow(_by_tile(_tile_of_pairs(min_tenths, stops)), f"i {kind}, j {kind}, tenths bigint")


def _coded_anchors(words: list[str], stops: Sequence[str] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, place of the word in words) of every occurrence of an anchor, and the codes of the anchors ``stops``; equal anchors, and only those, have equal codes.

    All anchors but those of a gap have at most 6 letters, so the first and the last three and the label tell them: 27 bits each and 4."""
    named = [x.split(":", 1) for x in stops]
    fixed = [(LABELS[label], text.replace("***", "", 1)) for label, text in named if label != "gap"]
    plain = [bare_text(w) for w in words] + [text for _, text in fixed]
    size = np.fromiter(map(len, plain), np.int64, len(plain))
    letters, code = np.unique(np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), return_inverse=True)
    two = code[:-2] * len(letters) + code[1:-1]
    if len(letters) > 512:  # three don't fit into 27 bits: pairs and triples that occur are numbered
        two = np.unique(two, return_inverse=True)[1]
    three = two * len(letters) + code[2:]
    if len(letters) > 512:
        three = np.unique(three, return_inverse=True)[1]
    start = np.cumsum(size) - size
    label, at = np.array([x for x, _ in fixed], dtype=np.int64), start[len(words) :]
    stopped = label << 54 | three[at] << 27 | three[at + size[len(words) :] - 3]
    start, size = start[: len(words)], size[: len(words)]
    owner = np.repeat(np.arange(len(words)), size)
    left = size[owner] - (np.arange(len(owner)) - start[owner])
    parts = []

    def add(label: str, at: np.ndarray, width: int) -> None:
        parts.append((LABELS[label] << 54 | three[at] << 27 | three[at + width - 3], owner[at]))

    for specs in SLIDING.values():
        for label, a, gap, b in specs:
            add(label[:-1], np.flatnonzero(left >= a + gap + b), a + gap + b)
    for k in ENDS:
        add(f"prefix{k}", start[size >= k], k)
        add(f"suffix{k}", (start + size - k)[size >= k], k)
    number: dict[str, int] = {}
    gaps = [(number.setdefault(f"{x}***{y}", len(number)), n) for n, w in enumerate(words) if "_" in w for x, y in pairwise(w.split("_")) if x and y]
    code, word = np.array(gaps, dtype=np.int64).reshape(-1, 2).T
    parts.append((LABELS["gap"] << 54 | code, word))
    code, word = (np.concatenate(c) for c in zip(*parts))
    gaps = [LABELS["gap"] << 54 | number[text] for label, text in named if label == "gap" and text in number]
    return code, word, np.concatenate([stopped, np.array(gaps, dtype=np.int64)])


def _summed(cell: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct cells in order, and the sum of each one's weights."""
    bits = int(weight.max(initial=0)).bit_length()
    if int(cell.max(initial=0)).bit_length() + bits <= 62:
        both = np.sort(cell << bits | weight)  # much faster than to sort places
        cell, weight = both >> bits, both & ((1 << bits) - 1)
    else:
        order = np.argsort(cell)
        cell, weight = cell[order], weight[order]
    begin = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
    return cell[begin], np.add.reduceat(weight, begin) if len(begin) else weight


def _met(code: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether a code may be among others: by a table of bits, so that most anchors of a single word leave before they are sorted."""
    place = lambda c: (c.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)
    seen = np.zeros(1 << 22, dtype=bool)
    seen[place(others)] = True
    return seen[place(code)]


class _Joined(NamedTuple):
    word: np.ndarray  # of x, ascending: one row for each of its anchors that y has
    begin: np.ndarray  # where the anchor's words begin in y_word
    count: np.ndarray
    tenths: np.ndarray
    y_word: np.ndarray
    y_times: np.ndarray | None  # None: each once


def _joined_anchors(x: list[str], y: list[str] | None, stops: Sequence[str]) -> _Joined:
    nx, ny = len(x), len(x if y is None else y)
    code, word, stopped = _coded_anchors(x if y is None else x + y, stops)
    if y is not None:
        mine = word < nx
        in_x = mine.copy()
        in_x[mine] = _met(code[mine], code[~mine])
        in_y = ~mine
        in_y[in_y] = _met(code[in_y], code[mine])
        code, word = np.concatenate([code[in_x], code[in_y]]), np.concatenate([word[in_x], word[in_y] - nx])
        of_x, of_y = slice(np.count_nonzero(in_x)), slice(np.count_nonzero(in_x), None)
    else:
        of_x = of_y = slice(None)
    codes, number = np.unique(code, return_inverse=True)
    worth, n = WORTH[codes >> 54], max(1, len(codes))
    at = np.searchsorted(codes, stopped)
    at, stopped = at[at < len(codes)], stopped[at < len(codes)]
    never = at[codes[at] == stopped]
    del code, codes
    xrow, times = np.unique(word[of_x] * n + number[of_x], return_counts=True)
    yrow, y_times = np.unique(number[of_y] * ny + word[of_y], return_counts=True)
    del word, number
    anchor = xrow % n
    held = np.bincount(yrow // ny, minlength=n)
    some = held > 0
    some[never] = False
    some = some[anchor]
    xrow, anchor, times = xrow[some], anchor[some], times[some]
    return _Joined(xrow // n, (np.cumsum(held) - held)[anchor], held[anchor], times * worth[anchor], yrow % ny, y_times if (y_times > 1).any() else None)


def _block_pairs(x: list[str], y: list[str] | None, least: int, at_once: int, stops: Sequence[str] = ()):
    """(place in x, place in y, tenths) of the pairs of words of two blocks, or of one block (y is None) with the first before the second, that have ``least`` tenths.

    Words of x are met with all of y, ``at_once`` hits and a row's hits at a time; the sum for a word that needs more goes on in the next step.
    """
    ny = len(x if y is None else y)
    word, begin, count, each, y_word, y_times = _joined_anchors(x, y, stops)
    upto = np.cumsum(count)
    row, cell, tenths = 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
    while row < len(word):
        had = upto[row] - count[row]
        stop = max(row + 1, int(np.searchsorted(upto, had + at_once, side="right")))
        part, c = slice(row, stop), count[row:stop]
        at = np.repeat(begin[part] - (upto[part] - c - had), c) + np.arange(upto[stop - 1] - had)
        hit, weight = np.repeat(word[part] * ny, c) + y_word[at], np.repeat(each[part], c)
        if y_times is not None:
            weight *= y_times[at]
        if y is None:
            later = y_word[at] > np.repeat(word[part], c)
            hit, weight = hit[later], weight[later]
        if len(cell):
            hit, weight = np.concatenate([cell, hit]), np.concatenate([tenths, weight])
        cell, tenths = _summed(hit, weight)
        whole = len(cell) if stop == len(word) else int(np.searchsorted(cell, word[stop] * ny))  # the next word's sums aren't whole yet
        good = np.flatnonzero(tenths[:whole] >= least)
        yield cell[good] // ny, cell[good] % ny, tenths[good]
        row, cell, tenths = stop, cell[whole:], tenths[whole:]


class Tile(NamedTuple):
    """The words of two blocks p <= q, or of one, in the order of their ids; and rows that came with them."""

    p: int
    q: int
    ids: list[np.ndarray]
    texts: list[list[str]]
    more: pa.Table

    def pairs(self, least: int, stops: Sequence[str]):
        """(place in the first block, place in the last, tenths) of the candidate pairs, in the order of both; all of a word of the first come at once."""
        size = [np.fromiter((len(bare_text(w)) for w in t), np.int64, len(t)) for t in self.texts]
        for a, b, tenths in _block_pairs(self.texts[0], self.texts[1] if self.p != self.q else None, least, HITS_AT_ONCE, stops):
            ratio = np.maximum(size[0][a], size[-1][b]) <= MAX_RATIO * np.minimum(size[0][a], size[-1][b])
            yield a[ratio], b[ratio], tenths[ratio]


def record_batches(schema: dict[str, np.ndarray | pa.Array], rows: int = 1 << 17):
    made = [pa.array(c) if isinstance(c, np.ndarray) else c for c in schema.values()]
    for k in range(0, len(made[0]), rows):
        yield pa.RecordBatch.from_arrays([c[k : k + rows] for c in made], names=list(schema))


def _tile_of_pairs(least: int, stops: Broadcast):
    def tile(t: Tile):
        for a, b, tenths in t.pairs(least, stops.value):
            x, y = t.ids[0][a], t.ids[-1][b]
            yield from record_batches({"i": np.minimum(x, y), "j": np.maximum(x, y), "tenths": tenths})

    return tile


def _tile_of_edges(threshold: float, least: int, stops: Broadcast):
    """(i, j, score, rule in bytes, edge_type) of the pairs whose better alignment scores ``threshold`` or more, and one row with n_pairs, how many pairs the tile has."""
    names = ("i", "j", "score", "rule", "edge_type", "n_pairs")

    def tile(t: Tile):
        words, n = residues_of([w for texts in t.texts for w in texts]), 0
        ids, begin = np.concatenate(t.ids), len(t.ids[0]) * (t.p != t.q)  # where the last block's words begin
        for a, b, _ in t.pairs(least, stops.value):
            n += len(a)
            b = b + begin
            one = ids[a] < ids[b]  # the word with the smaller id is the first of the alignment
            a, b = np.where(one, a, b), np.where(one, b, a)
            for found in graph_scores(words, a, b, threshold):
                i, j = ids[a[found.place]], ids[b[found.place]]
                made = [i, j, found.score, found.rule, pa.array(found.edge_type, pa.int8()), pa.nulls(len(i), pa.int64())]
                yield from record_batches(dict(zip(names, made)))
        kinds = [pa.from_numpy_dtype(t.ids[0].dtype)] * 2 + [pa.float64(), pa.binary(), pa.int8()]
        yield pa.RecordBatch.from_arrays([pa.nulls(1, k) for k in kinds] + [pa.array([n], pa.int64())], names=list(names))

    return tile


def coded_edges(words: DataFrame, max_posting: int | None, threshold: float, min_tenths: int = MIN_SCORE, split: int = EDGE_SPLIT) -> DataFrame:
    """``_tile_of_edges`` of the ``candidate_pairs`` of words, which are aligned where they are made: pairs aren't shuffled to meet their words."""
    kind = words.schema["word_id"].dataType.simpleString()
    tiles, stops = word_tiles(words, max_posting, split, EDGE_BLOCKS)
    return tiles.mapInArrow(_by_tile(_tile_of_edges(threshold, min_tenths, stops)), f"i {kind}, j {kind}, score double, rule binary, edge_type tinyint, n_pairs bigint")


def candidate_edges(words: DataFrame, max_posting: int | None, threshold: float, min_tenths: int = MIN_SCORE, split: int = EDGE_SPLIT) -> DataFrame:
    """``coded_edges`` with the texts of the rules."""
    return with_spelled_rules(coded_edges(words, max_posting, threshold, min_tenths, split))


def _tile_of_counts(least: int, stops: Broadcast):
    """(_p, _q, i, n): how many pairs a tile has with each word of its first block."""

    def tile(t: Tile):
        n = np.zeros(len(t.ids[0]), np.int64)
        for a, _, _ in t.pairs(least, stops.value):
            n += np.bincount(a, minlength=len(n))
        some = np.flatnonzero(n)
        yield from record_batches({"_p": np.full(len(some), t.p, np.int32), "_q": np.full(len(some), t.q, np.int32), "i": t.ids[0][some], "n": n[some]})

    return tile


def _tile_of_numbers(least: int, stops: Broadcast, batch_size: int):
    """(i, j, batch_id) of a tile whose further rows say which number the first pair of a word of the first block has."""

    def tile(t: Tile):
        begin = np.zeros(len(t.ids[0]), np.int64)
        begin[np.searchsorted(t.ids[0], t.more["word_id"].to_numpy())] = t.more["_start"].to_numpy()
        for a, b, _ in t.pairs(least, stops.value):
            number = begin[a] + np.arange(len(a)) - np.searchsorted(a, a)
            yield from record_batches({"i": t.ids[0][a], "j": t.ids[-1][b], "batch_id": number // batch_size})

    return tile


def _by_tile(tile):
    """What ``tile`` makes of each pair of blocks, from rows (_p, _q, _b, word_id, word) sorted by the pair (_p, _q); rows without a word go into ``more``."""

    def whole(rows: pa.Table):
        p, q = rows["_p"][0].as_py(), rows["_q"][0].as_py()
        known = rows.filter(pc.is_valid(rows["word"]))
        sides = [known.filter(pc.equal(known["_b"], b)).sort_by("word_id") for b in ([p] if p == q else [p, q])]
        if all(s.num_rows for s in sides):
            yield from tile(Tile(p, q, [s["word_id"].to_numpy() for s in sides], [s["word"].to_pylist() for s in sides], rows.filter(pc.is_null(rows["word"]))))

    def run(batches):
        held, key = [], None
        for batch in batches:
            p, q = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            begin = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (q[1:] != q[:-1])])) if len(p) else []
            for k, b in enumerate(begin):
                if held and (p[b], q[b]) != key:
                    yield from whole(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(b, (begin[k + 1] if k + 1 < len(begin) else len(p)) - b))
                key = (p[b], q[b])
        if held:
            yield from whole(pa.Table.from_batches(held))

    return run


def _sorted_tiles(rows: DataFrame, blocks: int) -> DataFrame:
    return rows.repartition(max(1, min(blocks * (blocks + 1) // 2, MOST_TASKS)), "_p", "_q").sortWithinPartitions("_p", "_q")


def _blocks(words: DataFrame, split: int, least_blocks: int) -> tuple[DataFrame, int, int]:
    """(word_id, word) of words that may be in a pair, the number of blocks to cut them into, and the letters that a block is to have."""
    known = words.select("word_id", "word").dropna().filter(F.length(bare(F.col("word"))) >= MIN_LENGTH)
    n, letters = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.greatest(F.length("word"), F.lit(16))), F.lit(0))).first()
    return known, max(1, -(-letters // (16 * split)), min(least_blocks, n // LEAST_WORDS)), letters


def _in_tiles(blocked: DataFrame, blocks: int) -> DataFrame:
    """(_p, _q, _b, word_id, word): every word once for each pair of blocks that has its block _b."""
    placed = blocked.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return placed.select(F.least("_b", "_o").alias("_p"), F.greatest("_b", "_o").alias("_q"), "_b", "word_id", "word")


def _stops(words: DataFrame, max_posting: int | None) -> Broadcast:
    return words.sparkSession.sparkContext.broadcast([] if max_posting is None else hot_anchors(words, max_posting))


def word_tiles(words: DataFrame, max_posting: int | None, split: int = SPLIT, least_blocks: int = LEAST_BLOCKS) -> tuple[DataFrame, Broadcast]:
    """The rows that ``_by_tile`` takes, and the stop anchors."""
    if max_posting is not None:
        words = cut(words.select("word_id", "word"))
    known, blocks, _ = _blocks(words, split, least_blocks)
    blocked = known.withColumn("_b", F.pmod(F.xxhash64("word_id"), F.lit(blocks)).cast("int"))
    return _sorted_tiles(_in_tiles(blocked, blocks), blocks), _stops(words, max_posting)


def numbered_pairs(words: DataFrame, batch_size: int, max_posting: int | None = MAX_POSTING, min_tenths: int = MIN_SCORE, split: int = SPLIT) -> DataFrame:
    """(i, j, batch_id): ``candidate_pairs`` in the order of i and j, ``batch_size`` of them a batch, numbered from 0; word_id must be a whole number.

    Pairs are neither sorted nor kept: blocks hold words in the order of their ids, so a pair's number follows from how many pairs the words before
    have, and the word itself in the blocks before. These are counted first; then the pairs are made again and numbered where they are made.
    """
    kind = words.schema["word_id"].dataType.simpleString()
    words = cut(words.select("word_id", "word"))
    known, blocks, letters = _blocks(words, split, LEAST_BLOCKS)
    sized = running_start(known.withColumn("_l", F.greatest(F.length("word"), F.lit(16)).cast("long")), "word_id", "_l", "_s")
    blocked = cut(sized.select("word_id", "word", F.expr(f"cast(_s * {blocks} div {max(1, letters)} as int)").alias("_b")))
    stops = _stops(words, max_posting)
    tiles = _in_tiles(blocked, blocks)
    counts = cut(_sorted_tiles(tiles, blocks).mapInArrow(_by_tile(_tile_of_counts(min_tenths, stops)), f"_p int, _q int, i {kind}, n bigint"))
    begin = running_start(counts.groupBy("i").agg(F.sum("n").alias("n")), "i", "n", "_first").select("i", "_first")
    inside = F.sum("n").over(Window.partitionBy("i").orderBy("_q").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.withColumn("_in", F.coalesce(inside, F.lit(0))).join(begin, "i")
    starts = starts.select("_p", "_q", F.lit(-1).alias("_b"), F.col("i").alias("word_id"), F.lit(None).cast("string").alias("word"), (F.col("_first") + F.col("_in")).alias("_start"))
    rows = _sorted_tiles(tiles.withColumn("_start", F.lit(None).cast("long")).unionByName(starts), blocks)
    return rows.mapInArrow(_by_tile(_tile_of_numbers(min_tenths, stops, batch_size)), f"i {kind}, j {kind}, batch_id bigint")
