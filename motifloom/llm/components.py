"""One group identifier for records linked directly or indirectly (problem 6): union-find in edge partitions.

1. Every task runs union-find over the links of its partition and keeps a spanning forest only: one row (node, root) for each node that
   isn't a root. Nodes are renamed by a bijective hash first, and roots are the smallest names; so roots are spread at random, trees
   are shallow whatever order the ids have, and a fixed part of the nodes drops out at each level.
2. Forests are merged level by level in bounded partitions. Rows are gathered by node, ``bound`` rows a partition, and merged again by union-find.
   A node that then is nobody's root and links no roots is settled: it points to its root and leaves. The links of the
   others go on to the next level, which has at most about two thirds of the nodes.
3. When a level has ``bound`` rows or fewer, the last merge is one partition of that bounded size. Then the settled nodes of every level, the last
   first, look up the root of their root, and each component gets the smallest id in it.

A component that holds a third of all nodes doesn't gather in one task: rows are gathered by node, roots are looked up with ``lookup_join``,
which leaves the rows of hot roots where they are, and the smallest ids are combined before they are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifloom.llm.grams import U64, mix
from motifloom.llm.neighbor_rows import resolved_neighbors
from motifloom.llm.topn import RESOLVED
from motifloom.operators.skew import lookup_join
from motifloom.session import cut, read

BOUND = 1 << 16
BUFFER = 4_000_000
_BACK = [U64(pow(c, -1, 1 << 64)) for c in (0xC4CEB9FE1A85EC53, 0xFF51AFD7ED558CCD)]


def unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of ``grams.mix``."""
    for back in _BACK:
        x = (x ^ (x >> U64(33))) * back
    return x ^ (x >> U64(33))


def spanning_forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for every node of the links that isn't that smallest node itself."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    parent = np.arange(len(ids))
    a, b = at[: len(u)], at[len(u) :]
    while len(a):
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(parent, up := parent[parent]):
            parent = up
    child = np.flatnonzero(parent != np.arange(len(ids)))
    return ids[child], ids[parent[child]]


def _rows(*cols: np.ndarray, names=("c", "p")) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=list(names))


def _forests(rename: bool, buffer: int = BUFFER):
    """Forests of what a task sees; a buffer that is full is replaced by its forest, which is passed on if that is large too."""

    def run(batches):
        us, vs, size = [], [], 0
        for batch in batches:
            u, v = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            if rename:
                u, v = (mix(x.view(U64)).view(np.int64) for x in (np.ascontiguousarray(u), np.ascontiguousarray(v)))
            us.append(u), vs.append(v)
            size += len(u)
            if size > buffer:
                u, v = spanning_forest(np.concatenate(us), np.concatenate(vs))
                us, vs, size = [u], [v], len(u)
                if size > buffer // 2:
                    yield _rows(u, v)
                    us, vs, size = [], [], 0
        if size:
            yield _rows(*spanning_forest(np.concatenate(us), np.concatenate(vs)))

    return run


def _merge(batches):
    """Union-find over the rows of one bounded partition, which has all rows of its children: (c, p, settled) with one row (settled true) a child, and
    the links between roots that the rows bring together (settled false)."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if held:
        c, p = (np.concatenate(x) for x in zip(*held))
        node, root = spanning_forest(c, p)
        yield _rows(node, root, np.isin(node, c), names=("c", "p", "child"))


def _names(batches):
    for b in batches:
        node, root = (unmix(b.column(k).to_numpy().view(U64)).view(np.int64) for k in (0, 1))
        yield _rows(node, root, names=("node", "root"))


def connected_components(links: DataFrame, a: str, b: str, bound: int = BOUND) -> DataFrame:
    """(node, component): for each node with a link to another node, the smallest node reached. Nodes are whole numbers.

    Rows with a null end and links of a node with itself are left out, repeated and two-way links count once, an empty table
    gives no rows, other columns are ignored. The result doesn't depend on partitions or on ``bound``.
    """
    kind = links.schema[a].dataType
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    edges = links.select(x.alias("c"), y.alias("p")).dropna().filter("c <> p")
    forest = cut(edges.mapInArrow(_forests(True), "c long, p long"))
    levels = []
    while (rows := forest.count()) > bound:
        merged = cut(forest.repartition(-(-rows // bound), "c").mapInArrow(_merge, "c long, p long, child boolean"))
        busy = merged.select("p").unionByName(merged.filter("not child").select(F.col("c").alias("p"))).distinct().withColumnsRenamed({"p": "c"}).withColumn("busy", F.lit(True))
        marked = cut(merged.join(busy, "c", "left"))
        levels.append(marked.filter("child and busy is null").select("c", "p"))
        rest = marked.filter("busy").select("c", "p")
        forest = cut(rest.mapInArrow(_forests(False), "c long, p long"))
    found = cut(forest.coalesce(1).mapInArrow(_forests(False), "c long, p long"))  # at most ``bound`` rows
    for settled in reversed(levels):
        up = found.select(F.col("c").alias("p"), F.col("p").alias("r"))
        found = cut(found.unionByName(lookup_join(settled, up, "p", "left").select("c", F.coalesce("r", "p").alias("p"))))
    named = found.unionByName(found.select(F.col("p").alias("c"), "p").distinct()).mapInArrow(_names, "node long, root long")
    named = cut(named) if levels else named
    least = named.groupBy("root").agg(F.min("node").alias("component"))
    out = lookup_join(named, least, "root") if levels else named.join(least, "root")
    return out.select(F.col("node").cast(kind).alias("node"), F.col("component").cast(kind).alias("component"))


def linked_words(spark, sf_dir, least: float = 6.0) -> DataFrame:
    """Links of p6: rows with a score of at least ``least`` whose neighbor_id is in words and isn't the word itself."""
    links = resolved_neighbors(spark, sf_dir, F.col("score") >= F.lit(least).cast("float")).filter(F.col("word_id") != F.col("neighbor_id"))
    links = cut(links.select("word_id", "neighbor_id"))
    known = read(spark, sf_dir, "words").select(F.col("word_id").alias("neighbor_id")).dropna().distinct()
    return lookup_join(links, known, "neighbor_id", "left_semi")


def p6_found(spark, sf_dir):
    found = connected_components(linked_words(spark, sf_dir), "word_id", "neighbor_id")
    return found.select(F.col("node").cast("int").alias("word_id"), F.col("component").cast("int").alias("group_id"))


QUERIES = {"p6_found": p6_found}

SQL = {
    "p6_found": f"""
with recursive {RESOLVED},
e as (select word_id a, neighbor_id b from r where score >= 6 and not isnan(score) and word_id <> neighbor_id and neighbor_id in (select word_id from words)),
d as (select a, b from e union select b, a from e),
reach as (select a node, a seen from d union select reach.node, d.b from reach join d on d.a = reach.seen)
select node word_id, min(seen) group_id from reach group by 1"""
}
