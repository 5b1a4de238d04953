"""Near-duplicate records with small edits (problem 4): fast similarity sketching, banding, exact verification.

The sketch of a set has ``bins`` coordinates. In round i every element gets a bin and a value: in the first ``bins`` rounds both
come from a hash, in the next ``bins`` rounds the bin is i - bins, so that every coordinate is filled for certain. A
coordinate keeps the least (round, value), and rounds stop as soon as all are filled. Two sets agree in a coordinate with
probability equal to their Jaccard similarity, with concentration like that of independent draws.

``rows`` coordinates make a band; texts that agree in a band are candidates, and the Jaccard similarity of each is
computed exactly from the whole window sets of both texts. Equal texts are one class: one representative is sketched and compared, and the
copies come back as members.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifloom.llm.components import connected_components
from motifloom.llm.grams import U64, mix, window_hashes
from motifloom.operators.skew import hot_keys, in_block_pairs, lookup_join, normal_word, once_in_blocks
from motifloom.session import cut, read

BANDS, ROWS = 40, 2
SPLIT = 512


def similarity_sketch(owner: np.ndarray, element: np.ndarray, n_sets: int, bins: int) -> np.ndarray:
    """The sketches of n_sets sets; (owner, element) are their distinct elements as 64-bit hashes. Empty sets get the largest value."""
    empty = np.iinfo(np.uint64).max
    sketch = np.full(n_sets * bins, empty, dtype=U64)
    filled = np.bincount(owner, minlength=n_sets) == 0  # nothing to do for empty sets
    for i in range(2 * bins):
        live = ~filled[owner]
        if not live.any():
            break
        o, h = owner[live], mix(element[live] + U64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        to = (h >> U64(32)) % U64(bins) if i < bins else np.full(len(h), i - bins, U64)
        value = (U64(i) << U64(32)) | (h & U64(0xFFFFFFFF))
        np.minimum.at(sketch, o * bins + to.astype(np.int64), value)
        filled |= (sketch.reshape(n_sets, bins) != empty).all(axis=1)
    return sketch.reshape(n_sets, bins)


PIECE = 2048  # texts or pairs that are worked on together
_LOW = U64(52)  # a text's or pair's place in a piece stands above 52 bits of a window's hash


def _distinct_windows(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, hash of 52 bits) of the distinct windows of each of at most 4,096 texts, in order."""
    owner, _, h = window_hashes(texts, width)
    key = np.unique((owner.astype(U64) << _LOW) | (h >> U64(12)))
    return (key >> _LOW).astype(np.int64), key & ((U64(1) << _LOW) - U64(1))


def _sketches(width: int, bands: int, rows: int):
    """(rep, n, keys) of every text with windows: the number of its distinct windows and one key a band."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                part = batch.slice(at, PIECE)
                owner, h = _distinct_windows(part.column(1).to_pylist(), width)
                size = np.bincount(owner, minlength=part.num_rows)
                sketch = similarity_sketch(owner, h, part.num_rows, bands * rows).reshape(part.num_rows, bands, rows)
                key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=U64)), (part.num_rows, bands)).copy()
                for r in range(rows):
                    key = mix(key * U64(31) + sketch[:, :, r])
                keys = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * bands, pa.int32()), pa.array(key.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size.astype(np.int32)), keys], names=["rep", "n", "keys"]).filter(pa.array(size > 0))

    return run


def _similarities(width: int, threshold: float):
    """(a, b, similarity) of the pairs (a, b, text of a, text of b) that reach the threshold; every distinct text of a piece is hashed once."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                part = batch.slice(at, PIECE)
                n = part.num_rows
                both = pa.chunked_array([part.column(2), part.column(3)]).combine_chunks().dictionary_encode()
                owner, h = _distinct_windows(both.dictionary.to_pylist(), width)
                first = np.searchsorted(owner, np.arange(len(both.dictionary) + 1))
                code = both.indices.to_numpy()
                size = np.diff(first)[code]
                # the windows of both texts of a pair one after another; those that stand there twice are common
                take = np.arange(size.sum()) + np.repeat(first[code] - np.cumsum(size) + size, size)
                key = np.sort((np.repeat(np.tile(np.arange(n), 2), size).astype(U64) << _LOW) | h[take])
                common = np.bincount((key[1:][key[1:] == key[:-1]] >> _LOW).astype(np.int64), minlength=n)
                union = size[:n] + size[n:] - common
                similarity = common / np.maximum(union, 1)
                near = pa.array(np.flatnonzero((similarity >= threshold - 1e-12) & (union > 0)))
                yield pa.RecordBatch.from_arrays([part.column(0).take(near), part.column(1).take(near), pa.array(similarity).take(near)], names=["a", "b", "similarity"])

    return run


def text_classes(df: DataFrame, id_: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Texts and members: (rep, text) with one row a distinct text, rep its smallest id, and (id, rep) with one row an id."""
    rows = df.select(F.col(id_).alias("id"), F.col(text).alias("text")).dropna().groupBy("id").agg(F.min("text").alias("text"))
    rows = cut(rows.withColumn("digest", F.unhex(F.md5("text"))))
    first = rows.groupBy("digest").agg(F.min("id").alias("rep"))
    members = lookup_join(rows.select("id", "digest"), first, "digest").select("id", "rep")
    return rows.join(first.select(F.col("rep").alias("id")), "id", "left_semi").select(F.col("id").alias("rep"), "text"), members


def candidate_pairs(keys: DataFrame, threshold: float, split: int = SPLIT) -> DataFrame:
    """(a, b), a < b, of rows (key, rep, n) with a common key and sizes n that allow the threshold; no row for keys that one row has.

    A key's members are cut into blocks of ``split``, and a pair of blocks is a join key of its own, so that no task gets a whole large bucket,
    and none is capped. keys is read twice.
    """
    several = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    on = ["key", "_p", "_q"]
    kept = in_block_pairs(lookup_join(keys, several, "key", hot=[]), ["key"], "rep", "m", split).select(*on, "rep", "n", "_b").repartition(*on)  # one shuffle for both sides
    fits = (F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb") - 1e-9) & (F.col("a") < F.col("b"))
    side = lambda s: kept.select(*on, F.col("rep").alias(s), F.col("n").alias(f"n{s}"), F.col("_b").alias(f"_{s}"))
    return side("a").join(side("b"), on).filter(once_in_blocks("_a", "_b") & fits).select("a", "b").distinct()


def similar_texts(texts: DataFrame, threshold: float, width: int = 4, bands: int = BANDS, rows: int = ROWS, split: int = SPLIT) -> DataFrame:
    """(a, b, similarity) of distinct texts (rep, text) whose sets of ``width``-character windows have a Jaccard similarity of at least
    ``threshold``. Texts shorter than a window have no set and no pairs. A pair at the threshold is missed with probability
    (1 - threshold ** rows) ** bands, 1e-5 for 0.5 with the defaults; every reported pair is exact. texts is read several times: cut it first."""
    kind = texts.schema["rep"].dataType.simpleString()
    sketches = cut(texts.mapInArrow(_sketches(width, bands, rows), f"rep {kind}, n int, keys array<bigint>"))
    pairs = cut(candidate_pairs(sketches.select(F.explode("keys").alias("key"), "rep", "n"), threshold, split))
    hot_a, hot_b = hot_keys(pairs, "a"), hot_keys(pairs, "b")
    both = lookup_join(pairs, texts.select(F.col("rep").alias("a"), F.col("text").alias("ta")), "a", hot=hot_a)
    both = lookup_join(both, texts.select(F.col("rep").alias("b"), F.col("text").alias("tb")), "b", hot=hot_b)
    return both.select("a", "b", "ta", "tb").mapInArrow(_similarities(width, threshold), f"a {kind}, b {kind}, similarity double")


def near_duplicate_pairs(df: DataFrame, id_: str, text: str, threshold: float = 0.5, width: int = 4, split: int = SPLIT) -> DataFrame:
    """(id_a, id_b) with id_a < id_b of all records whose texts are similar (see ``similar_texts``); ids are whole numbers.

    Equal texts are similar too. Representatives are compared, and the members of their classes are written out pair by pair, whatever the
    size of a class, since this result is defined by records; classes are cut into blocks of ``split``, so no task writes a large
    class. ``near_duplicate_groups`` gives the same links as one row a record, for data in which classes are large.
    Null ids or texts are left out, an id with several texts has its smallest, texts shorter than ``width`` have no pairs.
    """
    texts, members = text_classes(df.filter(F.length(text) >= width), id_, text)
    texts, members = cut(texts), cut(members)
    pairs = similar_texts(texts, threshold, width, split=split).select("a", "b")
    copies = candidate_pairs(members.select(F.col("rep").alias("key"), F.col("id").alias("rep"), F.lit(1).alias("n")), threshold, split)
    of = lambda s: members.select(F.col("rep").alias(s), F.col("id").alias(f"id_{s}"))
    cross = pairs.join(of("a"), "a").join(of("b"), "b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    return cross.unionByName(copies.select(F.col("a").alias("id_a"), F.col("b").alias("id_b")))


def near_duplicate_groups(df: DataFrame, id_: str, text: str, threshold: float = 0.5, width: int = 4) -> DataFrame:
    """One row for each record: (id, class_id, group_id, n_links). class_id is the smallest id with the same text, group_id the
    smallest id reached over similar texts, n_links the number of other texts that are similar to the record's. Nulls as in
    ``near_duplicate_pairs``; records shorter than a window are groups of their own with their copies."""
    texts, members = text_classes(df, id_, text)
    members = cut(members)
    pairs = cut(similar_texts(cut(texts), threshold, width).select("a", "b"))
    groups = connected_components(pairs, "a", "b").withColumnsRenamed({"node": "rep", "component": "group_id"})
    links = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    about = groups.join(links, "rep")
    out = lookup_join(members, about, "rep", "left")
    return out.select(
        "id", F.col("rep").alias("class_id"), F.coalesce("group_id", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


def long_words(spark, sf_dir, least: int = 20) -> DataFrame:
    """(word_id, word): the normalised non-null word of every id, of at least ``least`` characters."""
    words = read(spark, sf_dir, "words").select("word_id", normal_word().alias("word")).dropna()
    return words.groupBy("word_id").agg(F.min("word").alias("word")).filter(F.length("word") >= least)


def p4_found(spark, sf_dir):
    found = near_duplicate_pairs(long_words(spark, sf_dir), "word_id", "word", 0.5, 4)
    return found.select(F.col("id_a").alias("word_id_a"), F.col("id_b").alias("word_id_b"))


def p4_groups(spark, sf_dir):
    return near_duplicate_groups(long_words(spark, sf_dir), "word_id", "word", 0.5, 4).withColumnRenamed("id", "word_id")


QUERIES = {"p4_found": p4_found, "p4_groups": p4_groups}

WORDS = "w as (select word_id, min(upper(trim(word))) word from words where word_id is not null and word is not null group by 1)"
_PAIRS = f"""
{WORDS},
g as (select distinct word_id, substr(word, cast(i as int), 4) g from w, unnest(range(1, length(word) - 2)) t(i) where length(word) >= 20),
n as (select word_id, count(*) n from g group by 1),
c as (select a.word_id a, b.word_id b, count(*) c from g a join g b on a.g = b.g and a.word_id < b.word_id group by 1, 2),
f as (select a, b from c join n x on x.word_id = a join n y on y.word_id = b where 2 * c >= x.n + y.n - c)"""
SQL = {
    "p4_found": f"with {_PAIRS} select a word_id_a, b word_id_b from f",
    "p4_groups": f"""
with recursive {_PAIRS},
l as (select word_id, word, min(word_id) over (partition by word) class_id from w where length(word) >= 20),
d as (select a, b from f union all select b, a from f),
reach as (select word_id node, word_id seen from l union select reach.node, d.b from reach join d on d.a = reach.seen),
k as (select d.a, count(distinct y.class_id) n from d join l x on x.word_id = d.a join l y on y.word_id = d.b where x.class_id <> y.class_id group by 1)
select l.word_id, l.class_id, (select min(seen) from reach r where r.node = l.word_id) group_id, coalesce(k.n, 0) n_links
from l left join k on k.a = l.word_id""",
}
