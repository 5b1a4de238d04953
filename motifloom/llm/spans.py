"""Long exact spans shared between records (problem 5): hashed units, grouped globally.

Units are hashed in two sizes. The first is the whole text: records with the same text are grouped, and one of them stands for all. The second is
the sliding window of ``length`` characters, so that spans are found wherever they begin:

1. One 64-bit digest a window, with the first and last record it stands in, is combined and grouped over all texts. A digest is shared if it stands in two
   records or more. Shared digests set a bit in a bitmap of a fixed size (``BITS``), which goes to the tasks.
2. Windows whose bit is set, and no others, are shuffled with a second digest, their record and offset. Grouped by both digests they are
   shared for certain or not; the earliest ranked occurrence is that with the smallest (id, offset). A bitmap that is
   full for very large tables lets more windows through, and loses none.

Windows of shared digests, or for removal all but the earliest occurrences, are merged into maximal spans in the original offsets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motifloom.llm.grams import fixed_bitmap, has_bit, window_hashes
from motifloom.llm.neardup import WORDS, long_words, text_classes
from motifloom.operators.skew import lookup_join
from motifloom.session import cut

STRETCH = 1 << 16


def _digests(length: int, piece: int = 1024):
    """(h1, rep, last) of every window of (rep, last, text)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, piece):
                part = batch.slice(at, piece)
                owner, _, h = window_hashes(part.column(2).to_pylist(), length, 1)
                for x in range(0, len(owner), 1 << 20):
                    of = pa.array(owner[x : x + (1 << 20)])
                    yield pa.RecordBatch.from_arrays([pa.array(h[x : x + (1 << 20)].view(np.int64)), part.column(0).take(of), part.column(1).take(of)], names=["h1", "rep", "last"])

    return run


def _windows(length: int, bits, piece: int = 1024):
    """(h1, h2, rep, last, pos) of the windows of (rep, last, text) whose bit is set."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, piece):
                part = batch.slice(at, piece)
                texts = part.column(2).to_pylist()
                owner, pos, h1 = window_hashes(texts, length, 1)
                kept = np.flatnonzero(has_bit(bits.value, h1))
                h2 = window_hashes(texts, length, 2)[2][kept]
                owner, pos, h1 = owner[kept], pos[kept], h1[kept]
                for x in range(0, len(owner), 1 << 20):
                    s = slice(x, x + (1 << 20))
                    of = pa.array(owner[s])
                    cols = [pa.array(h1[s].view(np.int64)), pa.array(h2[s].view(np.int64)), part.column(0).take(of), part.column(1).take(of), pa.array(pos[s].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(cols, names=["h1", "h2", "rep", "last", "pos"])

    return run


def _runs(marked: DataFrame, length: int) -> DataFrame:
    """(id, span_start, span_end): maximal runs of the windows (id, pos). Windows are merged inside stretches of a record first, then the runs of its stretches,
    so that a task never sorts all windows of a very long record."""
    start, end = F.col("span_start"), F.col("span_end")

    def merged(df, *keys):
        w = Window.partitionBy("id", *keys).orderBy("span_start")
        until = F.max("span_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
        run = F.sum((until.isNull() | (start > until)).cast("int")).over(w)
        return df.withColumn("_run", run).groupBy("id", *keys, "_run").agg(F.min(start).alias("span_start"), F.max(end).alias("span_end")).drop("_run")

    at = marked.select("id", F.col("pos").alias("span_start"), (F.col("pos") + length).alias("span_end")).withColumn("_s", F.floor(F.col("span_start") / STRETCH))
    return merged(merged(at, "_s").drop("_s"))


def shared_spans(df: DataFrame, id_: str, text: str, length: int = 15, keep_first: bool = False) -> DataFrame:
    """(id, span_start, span_end): maximal runs of characters in windows of ``length`` that stand in another record as well.

    keep_first: leave out the windows that are the earliest occurrence of their digest, which gives the spans to remove.
    Offsets are 0-based, span_end is exclusive. Null ids or texts are left out, an id with several texts has its smallest; records shorter than a
    window have no spans; a window that repeats within one record only isn't shared.
    """
    texts, members = text_classes(df.filter(F.length(text) >= length), id_, text)
    members = cut(members)
    classes = members.groupBy("rep").agg(F.max("id").alias("last"))
    units = cut(texts.join(classes, "rep").select("rep", "last", "text"))
    kind = units.schema["rep"].dataType.simpleString()
    digests = units.mapInArrow(_digests(length), f"h1 bigint, rep {kind}, last {kind}").groupBy("h1").agg(F.min("rep").alias("rep"), F.max("last").alias("last"))
    bits = df.sparkSession.sparkContext.broadcast(fixed_bitmap(digests.filter("rep < last"), "h1"))
    windows = cut(units.mapInArrow(_windows(length, bits), f"h1 bigint, h2 bigint, rep {kind}, last {kind}, pos int"))
    first = [F.min(F.struct("rep", "pos")).alias("first")] if keep_first else []
    shared = windows.groupBy("h1", "h2").agg(F.min("rep").alias("least"), F.max("last").alias("last"), *first).filter("least < last").drop("least", "last")
    marked = windows.select("h1", "h2", F.col("rep").alias("id"), "pos").join(shared, ["h1", "h2"])
    if keep_first:
        marked = marked.filter((F.col("id") != F.col("first.rep")) | (F.col("pos") != F.col("first.pos")))
    spans = _runs(marked.select("id", "pos"), length)
    # a copy shares its whole text with the record that stands for it
    whole = texts.select("rep", F.length("text").alias("n"))
    copies = lookup_join(members.filter("id <> rep"), whole, "rep").select("id", F.lit(0).alias("span_start"), F.col("n").alias("span_end"))
    return spans.unionByName(copies)


def shared_share(df: DataFrame, id_: str, text: str, length: int = 15) -> DataFrame:
    """One row for each record with a text: (id, n_chars, shared_chars, share), share 0.0 for an empty text."""
    rows = df.select(F.col(id_).alias("id"), F.col(text).alias("text")).dropna().groupBy("id").agg(F.min("text").alias("text"))
    rows = cut(rows)
    spans = shared_spans(rows, "id", "text", length).groupBy("id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared"))
    out = rows.select("id", F.length("text").cast("long").alias("n_chars")).join(spans, "id", "left")
    out = out.withColumn("shared_chars", F.coalesce("shared", F.lit(0)).cast("long")).drop("shared")
    return out.withColumn("share", F.round(F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(0.0), 9))


def p5_found(spark, sf_dir):
    return shared_spans(long_words(spark, sf_dir, 15), "word_id", "word").withColumnRenamed("id", "word_id")


def p5_share(spark, sf_dir):
    return shared_share(long_words(spark, sf_dir, 15), "word_id", "word").withColumnRenamed("id", "word_id")


def p5_removals(spark, sf_dir):
    return shared_spans(long_words(spark, sf_dir, 15), "word_id", "word", keep_first=True).withColumnRenamed("id", "word_id")


QUERIES = {"p5_found": p5_found, "p5_share": p5_share, "p5_removals": p5_removals}

_SPANS = f"""
{WORDS},
g as (select word_id, i - 1 pos, substr(word, cast(i as int), 15) g from w, unnest(range(1, length(word) - 13)) t(i) where length(word) >= 15),
s as (select g, min(cast(word_id as bigint) * 1000000 + pos) fst from g group by 1 having count(distinct word_id) > 1),
m as (select word_id, pos from g join s using (g){{only}}),
r as (select *, sum(case when pos <= prev + 15 then 0 else 1 end) over (partition by word_id order by pos) run
      from (select *, lag(pos) over (partition by word_id order by pos) prev from m)),
f as (select word_id, cast(min(pos) as int) span_start, cast(max(pos) + 15 as int) span_end from r group by word_id, run)"""
SQL = {
    "p5_found": f"with {_SPANS.format(only='')} select * from f",
    "p5_removals": f"with {_SPANS.format(only=' where cast(word_id as bigint) * 1000000 + pos <> fst')} select * from f",
    "p5_share": f"""with {_SPANS.format(only="")}
select w.word_id, length(w.word) n_chars, cast(coalesce(sum(span_end - span_start), 0) as bigint) shared_chars,
       round(coalesce(sum(span_end - span_start), 0) / length(w.word), 9) share
from w left join f using (word_id) where length(w.word) >= 15 group by w.word_id, w.word""",
}
