"""Evaluation texts leaking into training text (problem 9): CGK random-walk embedding, bit-sampling LSH, exact edit verification.

Every window of ``width`` words of an item is looked for; windows of a document have up to ``max_edits`` words less or more, since a dropped or
inserted word changes the length. A random walk copies a window into 3 * width places: after every place
it moves on in the window or stays, as a hash of (place, word) tells, the same for all windows. Windows with few word edits then
differ in few places. In each of ``rounds`` rounds, with a walk of its own, a sample of the places is hashed; windows of documents and items
that agree in a round are candidates, and the edit distance of each candidate is computed exactly.

1. Mails are decoded once. A document window is kept if it may be near an item: ``max_edits`` edits leave at most as many words that no item has,
   and leave one of the pieces of ceil((width - max_edits) / (max_edits + 1)) words or more as it was. Words and pieces of the items set bits
   in a bitmap of a fixed size, the only thing that goes to all tasks, so the query set may have any size; a bit set by chance keeps a window too
   many, and none is lost.
2. Kept windows and item windows, each different one once, get their signatures, and meet in a join on them.
3. Candidates fetch both windows, are verified, and find the documents and items that hold these windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifloom.llm.grams import U64, fixed_bitmap, has_bit, mix
from motifloom.llm.mail import units
from motifloom.session import cut, read

WIDTH, MAX_EDITS = 12, 1
ROUNDS, SAMPLED = 20, 5
END = -1  # stands between the blocks of texts
_PLACES = 1 << 12
_WORD_SEED, _PIECE_SEED = U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F)


def _letters() -> np.ndarray:
    return np.array([chr(x).isalnum() for x in range(1 << 16)])


_LETTERS: np.ndarray | None = None
_FACTORS = mix(np.arange(1, _PLACES + 1, dtype=U64)) | U64(1)


def word_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of the texts, in lower case, with ``END`` behind each text; and the text of each. Words are runs of letters and digits."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = _letters()
    joined = "".join([t.replace("\0", " ") + "\0" for t in texts]).lower()
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _LETTERS[np.minimum(points, 0xFFFF)]
    far = np.flatnonzero(points > 0xFFFF)
    letter[far] = [chr(c).isalnum() for c in points[far]]
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    at = np.flatnonzero(letter)
    first = np.flatnonzero(begins[at])  # of each word, in at
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    part = (points[at].astype(U64) + U64(0x9E3779B9)) * _FACTORS[place % _PLACES]
    words = mix(np.add.reduceat(part, first)).view(np.int64) if len(first) else np.zeros(0, np.int64)
    words = np.where((words == END) | (words == 0), 1, words)
    marks = np.flatnonzero(begins | (points == 0))
    codes = np.full(len(marks), END, dtype=np.int64)
    codes[points[marks] != 0] = words
    ends = codes == END
    return codes, np.cumsum(ends) - ends


def _walk(windows: np.ndarray, seed: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, at): for each of ``size`` places of the embedding its word, -1 past the end, and where in the window it stands."""
    n, width = windows.shape
    out, where = np.full((size, n), -1, dtype=np.int64), np.zeros((size, n), dtype=np.int64)
    at, row = np.zeros(n, dtype=np.int64), np.arange(n)
    for j in range(size):
        inside = at < width
        word = np.where(inside, windows[row, np.minimum(at, width - 1)], -1)
        out[j], where[j] = word, at
        step = mix(word.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(seed * 1_000_003 + j + 1)) & U64(1)
        at += step.astype(np.int64) * inside
    return out, where


def cgk_embed(windows: np.ndarray, seed: int) -> np.ndarray:
    """The embedding of each row of word codes (1 and up, 0 for a word no item has); places past the end hold -1."""
    return _walk(windows, seed, 3 * windows.shape[1])[0].T


def signatures(windows: np.ndarray, rounds: int = ROUNDS, sampled: int = SAMPLED) -> np.ndarray:
    """One 64-bit key for each window and round, from ``sampled`` places of the round's embedding."""
    return span_signatures(windows, windows.shape[1], (windows.shape[1],), rounds, sampled)[0]


def span_signatures(windows: np.ndarray, width: int, lengths: tuple[int, ...], rounds: int = ROUNDS, sampled: int = SAMPLED) -> np.ndarray:
    """For each of ``lengths`` the signatures of the first so many codes of every row, to be compared with those of windows of ``width``
    codes. Up to its end a shorter window walks as a longer one does, so one walk serves all lengths."""
    keys = np.zeros((len(lengths), len(windows), rounds), dtype=U64)
    for r in range(rounds):
        places = np.random.default_rng(1000 + r).choice(2 * width, sampled, replace=False)  # later places are mostly past the end
        word, at = _walk(windows, r, int(places.max()) + 1)
        for k, length in enumerate(lengths):
            key = np.full(len(windows), r + 1, dtype=U64)
            for p in places:
                key = mix(key * U64(31) + np.where(at[p] < length, word[p], -1).astype(U64))
            keys[k, :, r] = key
    return keys.view(np.int64)


def edit_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Levenshtein distances of the rows of a and b, words as symbols; code 0 equals nothing."""
    n, width = a.shape
    last = np.broadcast_to(np.arange(b.shape[1] + 1), (n, b.shape[1] + 1)).copy()
    for i in range(width):
        now = np.empty_like(last)
        now[:, 0] = i + 1
        for j in range(b.shape[1]):
            differ = (a[:, i] != b[:, j]) | (a[:, i] == 0)
            now[:, j + 1] = np.minimum(np.minimum(last[:, j + 1], now[:, j]) + 1, last[:, j] + differ)
        last = now
    return last[:, -1]


def _within(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """``edit_distance`` where it is ``most`` or less, else some larger number: only cells at most ``most`` off the diagonal count."""
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    far = np.full(a.shape[1], most + 1, dtype=np.int64)
    last = {j: np.full(a.shape[1], j) for j in range(min(most, len(b)) + 1)}
    for i in range(len(a)):
        now = {}
        for j in range(max(0, i + 1 - most), min(len(b), i + 1 + most) + 1):
            if j == 0:
                now[j] = np.full(a.shape[1], i + 1)
                continue
            differ = (a[i] != b[j - 1]) | (a[i] == 0)
            now[j] = np.minimum(np.minimum(last.get(j, far), now.get(j - 1, far)) + 1, last.get(j - 1, far) + differ)
        last = now
    return last.get(len(b), far)


def _windows_of(codes: np.ndarray, width: int, strange: np.ndarray, most: int) -> np.ndarray:
    """Starts of the windows of ``width`` codes without an ``END`` and with at most ``most`` strange ones."""
    if len(codes) < width:
        return np.zeros(0, np.int64)
    inside = lambda c: c[width:] - c[:-width]
    odd, end = (np.concatenate([[0], np.cumsum(x)]) for x in (strange, codes == END))
    return np.flatnonzero((inside(odd) <= most) & (inside(end) == 0))


def _pieces(codes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` codes from each start on."""
    key = np.full(len(starts), _PIECE_SEED, dtype=U64)
    for k in range(size):
        key = mix(key * U64(31) + codes[starts + k].astype(U64))
    return key


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(np.ascontiguousarray(rows).ravel()))


def _padded(column: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The lists as rows of ``width`` codes, filled up with -1, and their lengths."""
    size = np.diff(column.offsets.to_numpy())
    out = np.full((len(column), width), END, dtype=np.int64)
    out[np.arange(width) < size[:, None]] = column.flatten().to_numpy()
    return out, size


def _piece_size(width: int, max_edits: int) -> int:
    return max(1, -(-(width - max_edits) // (max_edits + 1)))


def _item_windows(width: int):
    """(item, codes) of every window of every item (item, text)."""

    def run(batches):
        for batch in batches:
            codes, owner = word_codes(batch.column(1).to_pylist())
            starts = _windows_of(codes, width, np.zeros(len(codes), bool), 0)
            if len(starts):
                rows = np.lib.stride_tricks.sliding_window_view(codes, width)[starts]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[starts])), _lists(rows)], names=["item", "codes"])

    return run


def _marks(width: int, piece: int):
    """(h): what the words and pieces of item windows (codes) set in the bitmap."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                codes = _padded(batch.column(0), width)[0].ravel()
                starts = (np.arange(batch.num_rows)[:, None] * width + np.arange(width - piece + 1)).ravel()
                marks = np.unique(np.concatenate([mix(codes.astype(U64) ^ _WORD_SEED), _pieces(codes, starts, piece)]))
                yield pa.RecordBatch.from_arrays([pa.array(marks.view(np.int64))], names=["h"])

    return run


def _near_windows(bits, lengths: tuple[int, ...], max_edits: int, piece: int, docs: int = 512):
    """(id, codes) of the windows of documents (id, text) that may be near an item."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, docs):
                part = batch.slice(at, docs)
                texts, owners = [], []
                for d, text in enumerate(part.column(1).to_pylist()):
                    mine = [u.text for u in units(text)]
                    texts += mine
                    owners += [d] * len(mine)
                if not texts:
                    continue
                codes, unit = word_codes(texts)
                strange = ~has_bit(bits.value, mix(codes.astype(U64) ^ _WORD_SEED))
                whole = _windows_of(codes, piece, strange, 0)
                held = np.zeros(len(codes) + 1, dtype=np.int64)
                held[whole[has_bit(bits.value, _pieces(codes, whole, piece))] + 1] = 1
                held = np.cumsum(held)
                longer = np.concatenate([codes, np.full(lengths[-1], END)])
                for length in lengths:
                    starts = _windows_of(codes, length, strange, max_edits)
                    starts = starts[held[starts + length - piece + 1] > held[starts]] if length >= piece else starts
                    if len(starts):
                        rows = np.lib.stride_tricks.sliding_window_view(longer, length)[starts]
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.array(owners)[unit[starts]])), _lists(rows)], names=["id", "codes"])

    return run


def _signed(width: int, lengths: tuple[int, ...], rounds: int, sampled: int, piece: int = 4096):
    """(key, w) for every round of the windows (w, codes)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, piece):
                part = batch.slice(at, piece)
                rows, size = _padded(part.column(1), lengths[-1])
                for length in lengths:
                    mine = np.flatnonzero(size == length)
                    if len(mine):
                        keys = span_signatures(rows[mine], width, (length,), rounds, sampled)[0]
                        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), part.column(0).take(pa.array(np.repeat(mine, rounds)))], names=["key", "w"])

    return run


def _verified(lengths: tuple[int, ...], width: int, max_edits: int):
    """(codes, wanted, edits) of the pairs (codes, wanted) of a document's and an item's window with at most ``max_edits`` edits."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, size = _padded(batch.column(0), lengths[-1])
            b, _ = _padded(batch.column(1), width)
            edits = np.full(batch.num_rows, max_edits + 1)
            for length in lengths:
                mine = np.flatnonzero(size == length)
                edits[mine] = _within(a[mine, :length], b[mine], max_edits)
            near = pa.array(np.flatnonzero(edits <= max_edits))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(near), batch.column(1).take(near), pa.array(edits.astype(np.int32)).take(near)], names=["codes", "wanted", "edits"])

    return run


def leaked_items(
    docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, width: int = WIDTH, max_edits: int = MAX_EDITS,
    rounds: int = ROUNDS, sampled: int = SAMPLED,
) -> DataFrame:
    """(id, item, edits): documents with a run of words within ``max_edits`` word edits of a window of ``width`` words of an item; edits is
    the least distance found. Such a run has width - max_edits to width + max_edits words, and all these lengths are probed. Runs at
    distance 0 agree in every round, so all are found; others are found with the probability that a round agrees, 0.99 or more for one edit.

    Words are runs of letters and digits, compared in lower case, inside one block or one decoded base64 part. Null ids or texts
    and texts of fewer than ``width`` words have no rows; repeated rows of an item count once. item_id is a whole number.
    """
    lengths = tuple(range(max(1, width - max_edits), width + max_edits + 1))
    piece = _piece_size(width, max_edits)
    corpus = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).dropna()
    queries = items.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("t")).dropna().distinct()
    wanted = cut(queries.mapInArrow(_item_windows(width), "item long, codes array<long>").distinct())
    windows = lambda df: df.select(F.xxhash64("codes").alias("w"), "codes").distinct()
    sought = cut(windows(wanted))
    bits = docs.sparkSession.sparkContext.broadcast(fixed_bitmap(sought.select("codes").mapInArrow(_marks(width, piece), "h long"), "h"))
    kind = corpus.schema["id"].dataType.simpleString()
    held = cut(corpus.mapInArrow(_near_windows(bits, lengths, max_edits, piece), f"id {kind}, codes array<long>"))
    met = cut(windows(held))
    keys = lambda df, name: df.mapInArrow(_signed(width, lengths, rounds, sampled), "key long, w long").withColumnRenamed("w", name)
    pairs = keys(met, "w").join(keys(sought, "i"), "key").select("w", "i").distinct()
    both = pairs.join(met, "w").join(sought.select(F.col("w").alias("i"), F.col("codes").alias("wanted")), "i").select("codes", "wanted")
    near = both.mapInArrow(_verified(lengths, width, max_edits), "codes array<long>, wanted array<long>, edits int")
    found = held.join(near, "codes").select("id", "wanted", "edits").join(wanted.withColumnRenamed("codes", "wanted"), "wanted")
    return found.groupBy("id", "item").agg(F.min("edits").alias("edits"))


def _leaks(spark, sf_dir):
    docs, items = read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items")
    return leaked_items(docs, "doc_id", "text", items, "item_id", "text").withColumnsRenamed({"id": "doc_id", "item": "item_id"})


def p9_found(spark, sf_dir):
    return _leaks(spark, sf_dir).filter("edits = 0").select("doc_id", "item_id")


def p9_near(spark, sf_dir):
    return _leaks(spark, sf_dir)


QUERIES = {"p9_found": p9_found, "p9_near": p9_near}
SQL: dict[str, str] = {}
