"""Residues, residue classes and the scores and penalties built on them, as numpy tables and as Columns."""

from __future__ import annotations

from functools import cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class ResidueClass(NamedTuple):
    name: str
    residues: str
    tier: int
    mine: float
    graph: float


# The classes in the order in which they are searched. bulky holds a space, polar holds R twice.
CLASSES = (
    ResidueClass("acidic", "DE", 1, 0.9, 0.80),
    ResidueClass("basic", "KRH", 1, 0.9, 0.80),
    ResidueClass("sulfur", "CM", 1, 0.9, 0.80),
    ResidueClass("amide", "NQ", 1, 0.9, 0.80),
    ResidueClass("hydroxyl", "STY", 1, 0.9, 0.80),
    ResidueClass("tiny", "GAS", 1, 0.9, 0.80),
    ResidueClass("aromatic", "FYW", 2, 0.7, 0.60),
    ResidueClass("aliphatic", "AVLI", 2, 0.7, 0.60),
    ResidueClass("cyclic", "PFYWH", 2, 0.7, 0.55),
    ResidueClass("small", "GASCDPNT", 3, 0.5, 0.40),
    ResidueClass("nonpolar", "AVLIPFMWG", 3, 0.5, 0.35),
    ResidueClass("polar", "STNQYCDERKHR", 3, 0.5, 0.35),
    ResidueClass("bulky", "FYW RKEQMLI", 3, 0.5, 0.30),
)
BY_NAME = {c.name: c for c in CLASSES}
EDGE_TYPES = ("same_length", "optional_indel", "containment", "internal_gap", "underscore", "mixed_semiglobal")


@cache
def common_class(a: str, b: str) -> int:
    """Place of the first class that holds both characters, -1 if none does."""
    return next((k for k, c in enumerate(CLASSES) if a in c.residues and b in c.residues), -1)


def _pair_table(value) -> np.ndarray:
    table = np.zeros((128, 128), dtype=np.float64)
    for a in range(128):
        for b in range(128):
            table[a, b] = value(chr(a), chr(b))
    return table


def mining_score(a: str, b: str) -> float:
    """Equal 1.0, one of them `_` 0.5, in a common class that class's score, else 0.3."""
    if a == b:
        return 1.0
    if "_" in (a, b):
        return 0.5
    k = common_class(a, b)
    return CLASSES[k].mine if k >= 0 else 0.3


def graph_score(a: str, b: str) -> float:
    """Equal 1.0, in a common class that class's score, else -1.0."""
    if a == b:
        return 1.0
    k = common_class(a, b)
    return CLASSES[k].graph if k >= 0 else -1.0


def mining_table() -> np.ndarray:
    return _pair_table(mining_score).astype(np.float32)


def graph_table() -> np.ndarray:
    return _pair_table(graph_score)


def class_table() -> np.ndarray:
    return _pair_table(common_class).astype(np.int8)


def class_rows(spark):
    """The classes as a table: ord, name, residues, tier, score_mine, score_graph."""
    rows = [(i, c.name, c.residues, c.tier, c.mine, c.graph) for i, c in enumerate(CLASSES)]
    return spark.createDataFrame(rows, "ord int, name string, residues string, tier int, score_mine double, score_graph double")


def residue_score(a: Column, b: Column, kind: str = "mine") -> Column:
    """``mining_score`` or ``graph_score`` of two one-character columns, inside code generation."""
    out = F.when(a == b, F.lit(1.0))
    if kind == "mine":
        out = out.when((a == "_") | (b == "_"), F.lit(0.5))
    for c in CLASSES:
        score = c.mine if kind == "mine" else c.graph
        out = out.when((F.instr(F.lit(c.residues), a) > 0) & (F.instr(F.lit(c.residues), b) > 0), F.lit(score))
    return out.otherwise(F.lit(0.3 if kind == "mine" else -1.0))


def optional_penalty(n: Column, kind: str = "mine") -> Column:
    steps = (-0.8, -1.2, -1.8) if kind == "mine" else (-0.15, -0.40, -0.90, -1.60)
    out = F.when(n == 1, F.lit(steps[0]))
    for k, v in enumerate(steps[1:], 2):
        out = out.when(n == k, F.lit(v))
    return out.otherwise(F.lit(-2.0) - (n - 4) * 0.5 if kind == "mine" else F.lit(-2.0))


def flank_penalty(n: Column, kind: str = "mine") -> Column:
    if kind == "mine":
        return F.when(n <= 0, F.lit(0.0)).when(n <= 2, F.lit(-0.3)).when(n <= 4, F.lit(-0.5)).otherwise(F.lit(-1.0) - (n - 4) * 0.3)
    return F.when(n <= 0, F.lit(0.0)).otherwise(n * -0.20 - 0.20)


def mining_flank(n: int) -> float:
    return 0.0 if n <= 0 else -0.3 if n <= 2 else -0.5 if n <= 4 else -1.0 - (n - 4) * 0.3


def graph_flank(n: int) -> float:
    return 0.0 if n <= 0 else -0.20 * n - 0.20


def residues_only(word: Column) -> Column:
    """The word without `_` and anything else that isn't a capital letter."""
    return F.regexp_replace(word, "[^A-Z]", "")


def edge_type_name(code: Column) -> Column:
    return F.create_map(*[x for i, n in enumerate(EDGE_TYPES) for x in (F.lit(i), F.lit(n))])[code.cast("int")]
