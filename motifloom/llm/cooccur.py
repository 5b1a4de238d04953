"""Items that appear together (problem 1): pair counts and lift over records of any size.

Heavy-light decomposition. An item is heavy if at least one record in ``HEAVY_SHARE`` holds it (at most ``MAX_HEAVY`` items;
further ones count as light, which changes the path but not the result).

* heavy with heavy: records are spread over blocks of about ``BLOCK_RECORDS``; a block is a dense bit matrix, and the popcounts of
  the ANDed rows are summed over blocks;
* light with light: pairs within a record, counted by hash aggregation with combining before the shuffle; a record's light items are
  cut into blocks of ``BLOCK_ITEMS``, and each pair of blocks is a task's work of its own, so that a record with very many is spread;
* light with heavy: each light item's records are probed in the records' heavy lists, of at most ``MAX_HEAVY`` items; items of records with very many
  stay where they are and meet the lists of those records in a broadcast.

With a support of at least s, the s - 1 records with the most items ("big" records) alone can't make a pair frequent. So
pairs of up to 62 of them are never written out: a pair found in the other records gets what these add from one bit mask an item.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motifloom.operators.skew import hot_keys, in_block_pairs, lookup_join, normal_frag, once_in_blocks
from motifloom.session import cut, read

HEAVY_SHARE = 256
MAX_HEAVY = 1024
BLOCK_RECORDS = 65_536
BIG_RECORD_ITEMS = 256
BLOCK_ITEMS = 512


def _block_counts(table: pa.Table) -> pa.Table:
    """Pair counts of one block by popcounts of ANDed bit rows."""
    record = np.unique(table["record"].to_numpy(), return_inverse=True)[1]
    item, row = np.unique(table["hid"].to_numpy(), return_inverse=True)
    words = (int(record.max()) >> 6) + 1
    bits = np.zeros((len(item), words * 64), dtype=np.bool_)
    bits[row, record] = True
    packed = np.packbits(bits, axis=1).view(np.uint64)
    del bits
    a, b, n = [], [], []
    for i in range(len(item) - 1):
        count = np.bitwise_count(packed[i] & packed[i + 1 :]).sum(axis=1, dtype=np.int64)
        hit = np.flatnonzero(count)
        a.append(np.full(len(hit), item[i], dtype=np.int32))
        b.append(item[i + 1 + hit].astype(np.int32))
        n.append(count[hit])
    if not a:
        return pa.table({"ha": pa.array([], pa.int32()), "hb": pa.array([], pa.int32()), "n": pa.array([], pa.int64())})
    return pa.table({"ha": np.concatenate(a), "hb": np.concatenate(b), "n": np.concatenate(n)})


def cooccurring_pairs(
    df: DataFrame, record: str, item: str, min_support: int = 30, min_lift: float = 6.0, max_heavy: int = MAX_HEAVY, heavy_share: int = HEAVY_SHARE,
    block_records: int = BLOCK_RECORDS, big_record_items: int = BIG_RECORD_ITEMS,
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """Pairs of items with n_ab >= min_support common records and n_ab * N >= min_lift * n_a * n_b, N the number of records.

    Result: item_a < item_b, n_ab, n_a, n_b, n_records, lift. Rows with a null record or item are left out, repeated rows count
    once, an empty table gives no rows, other columns are ignored. Exact for every size and skew: thresholds only choose paths.
    """
    spark = df.sparkSession
    rows = cut(df.select(F.col(record).alias("record"), F.col(item).alias("item")).dropna().distinct())
    n_records = rows.select("record").distinct().count()
    items = rows.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    # n_ab <= min(n_a, n_b): neither rarer items than the support nor items in more than N / lift records can be in a result pair
    items = items.filter((F.col("n") >= min_support) & (F.col("n") * F.lit(float(min_lift)) <= F.lit(float(n_records))))

    heavy = items.filter(F.col("n") * heavy_share >= n_records).orderBy(F.desc("n"), "item").limit(max_heavy).collect()
    kind = T.StructType([T.StructField("item", df.schema[item].dataType if item in df.columns else T.StringType()), T.StructField("hid", T.IntegerType())])
    heavy_ids = F.broadcast(spark.createDataFrame([(r["item"], i) for i, r in enumerate(heavy)], kind))  # at most max_heavy rows

    degree = rows.groupBy("record").agg(F.count(F.lit(1)).alias("d")).filter(F.col("d") >= big_record_items)
    big = [r["record"] for r in degree.orderBy(F.desc("d"), "record").limit(min(62, max(0, min_support - 1))).collect()]

    kept = cut(rows.join(items.select("item"), "item", "left_semi").join(heavy_ids, "item", "left"))
    dense = kept.filter(F.col("hid").isNotNull())
    blocks = max(1, -(-n_records // block_records))
    hh = (
        dense.select(F.xxhash64("record").alias("record"), "hid")
        .withColumn("block", F.pmod(F.xxhash64("record"), F.lit(blocks)))
        .groupBy("block")
        .applyInArrow(_block_counts, "ha int, hb int, n bigint")
        .groupBy("ha", "hb")
        .agg(F.sum("n").alias("n_ab"))
    )
    hh = (
        hh.join(heavy_ids.select(F.col("hid").alias("ha"), F.col("item").alias("x")), "ha")
        .join(heavy_ids.select(F.col("hid").alias("hb"), F.col("item").alias("y")), "hb")
        .select("x", "y", "n_ab")
    )

    usual = kept.filter(~F.col("record").isin(big)) if big else kept
    hot_records = [r for r in hot_keys(rows, "record") if r not in big]
    light = usual.filter(F.col("hid").isNull()).select("record", "item")
    held = light.groupBy("record").agg(F.count(F.lit(1)).alias("n"))
    on = ["record", "_p", "_q"]
    sized = in_block_pairs(lookup_join(light, held.filter("n > 1"), "record", hot=hot_records), ["record"], "item", "n", block_items)
    sized = sized.select(*on, "item", "_b").repartition(*on)  # one shuffle for both sides
    side = lambda c, b: sized.select(*on, F.col("item").alias(c), F.col("_b").alias(b))
    ll = side("x", "_x").join(side("y", "_y"), on).filter(once_in_blocks("_x", "_y") & (F.col("x") < F.col("y"))).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n_ab"))
    lists = usual.filter(F.col("hid").isNotNull()).groupBy("record").agg(F.collect_list("hid").alias("hids"))
    lh = (
        lookup_join(light, lists, "record", hot=hot_records)
        .select(F.col("item").alias("x"), F.explode("hids").alias("hid"))
        .groupBy("x", "hid")
        .agg(F.count(F.lit(1)).alias("n_ab"))
        .join(heavy_ids.select("hid", F.col("item").alias("y")), "hid")
        .select("x", "y", "n_ab")
    )
    probed = ll.unionByName(lh)

    masks = items.select("item", "n", F.lit(0).cast("long").alias("mask"))
    if big:
        bit = F.create_map(*[x for i, r in enumerate(big) for x in (F.lit(r), F.lit(1 << i).cast("long"))])
        seen = rows.filter(F.col("record").isin(big)).groupBy("item").agg(F.bit_or(bit[F.col("record")]).alias("m"))
        masks = items.join(seen, "item", "left").select("item", "n", F.coalesce("m", F.lit(0).cast("long")).alias("mask"))
        probed = probed.filter(F.col("n_ab") >= min_support - len(big))
    masks = cut(masks)
    side = lambda c, s: masks.select(F.col("item").alias(c), F.col("n").alias(f"n_{s}"), F.col("mask").alias(f"m_{s}"))
    added = F.bit_count(F.col("m_x").bitwiseAND(F.col("m_y")))
    pairs = probed.withColumn("rest", F.lit(1)).unionByName(hh.withColumn("rest", F.lit(0))).join(side("x", "x"), "x").join(side("y", "y"), "y")
    pairs = pairs.withColumn("n_ab", F.col("n_ab") + F.when(F.col("rest") == 1, added).otherwise(0))
    swap = F.col("x") > F.col("y")
    pick = lambda p, q: F.when(swap, F.col(q)).otherwise(F.col(p))
    return pairs.select(
        pick("x", "y").alias("item_a"), pick("y", "x").alias("item_b"), "n_ab", pick("n_x", "n_y").alias("n_a"), pick("n_y", "n_x").alias("n_b"),
        F.lit(n_records).cast("long").alias("n_records"),
        (F.col("n_ab") * F.lit(float(n_records)) / (F.col("n_x") * F.col("n_y"))).alias("lift"),
    ).filter(
        (F.col("n_ab") >= min_support) & (F.col("n_ab") * F.lit(float(n_records)) >= F.lit(float(min_lift)) * F.col("n_a") * F.col("n_b"))
    )


def _pairs(spark, sf_dir):
    rows = read(spark, sf_dir, "word_frags").select("word_id", normal_frag().alias("frag_id"))
    return cooccurring_pairs(rows, "word_id", "frag_id")


def p1_found(spark, sf_dir):
    return _pairs(spark, sf_dir).select(F.col("item_a").alias("frag_id_a"), F.col("item_b").alias("frag_id_b"))


def p1_pair_lift(spark, sf_dir):
    cols = (F.col("item_a").alias("frag_id_a"), F.col("item_b").alias("frag_id_b"), "n_ab", "n_a", "n_b", F.round("lift", 6).alias("lift"))
    return _pairs(spark, sf_dir).select(*cols)


QUERIES = {"p1_found": p1_found, "p1_pair_lift": p1_pair_lift}

_SQL = """
with w as (select distinct word_id, lower(trim(frag_id)) f from word_frags where word_id is not null and frag_id is not null),
c as (select f, count(*) n from w group by 1), t as (select count(distinct word_id) n from w),
p as (select a.f fa, b.f fb, count(*) n_ab from w a join w b on a.word_id = b.word_id and a.f < b.f group by 1, 2 having count(*) >= 30)
select fa frag_id_a, fb frag_id_b{more} from p join c x on x.f = fa join c y on y.f = fb, t where n_ab * t.n >= 6 * x.n * y.n"""
SQL = {
    "p1_found": _SQL.format(more=""),
    "p1_pair_lift": _SQL.format(more=", n_ab, x.n n_a, y.n n_b, round(n_ab * cast(t.n as double) / (x.n * y.n), 6) lift"),
}
