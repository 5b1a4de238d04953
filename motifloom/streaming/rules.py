"""Incoming words matched against a static set of rules, and counts of matches over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifloom.functions.rules import rule_lengths, rule_matches, rule_regex
from motifloom.operators.skew import normal_word


def match_stream(words: DataFrame, rules: DataFrame) -> DataFrame:
    """A stream (word_id, word, added_at, ...) with rule_id, one row for each rule that matches the word, or one with null if none does.

    A stream-static join: ``rules`` (rule_id, rule) stands once for every length of a word that it can match, and a word is tried against the
    rules of its length only, so the set of rules may have any size. Null words match nothing; null rules are left out.
    """
    length = rule_lengths(F.col("rule"))
    known = rules.select("rule_id", rule_regex(F.col("rule")).alias("_regex"), F.explode(F.sequence(length["least"], length["most"])).alias("_length")).dropna()
    tried = words.withColumn("_word", normal_word()).withColumn("_length", F.length("_word"))
    fits = (tried["_length"] == known["_length"]) & rule_matches(F.col("_word"), F.col("_regex"))
    return tried.join(known, fits, "left").select(*[tried[c] for c in words.columns], "rule_id")


def match_counts(words: DataFrame, rules: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """(window, rule_id, n_words): matches by event-time window; words later than ``late`` behind the newest are dropped by the watermark."""
    hits = match_stream(words.withWatermark("added_at", late), rules).filter(F.col("rule_id").isNotNull())
    return hits.groupBy(F.window("added_at", window), "rule_id").agg(F.count(F.lit(1)).alias("n_words"))
