"""Aggregates that can be stored and merged: how many distinct words, and which are the most frequent.

A sketch a group is a few kilobytes whatever the group's size, so sketches of days or sources are kept and merged
later without the texts. Distinct counts are HyperLogLog (within some 1.04 / 2^(LOG_K / 2) of the truth, one
standard deviation); top words are a frequent-items sketch, whose counts are exact until more than 3/4 of ITEMS
different words are met, and beyond that within 3.5 / ITEMS of all words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOG_K, ITEMS = 14, 16_384


def words(docs: DataFrame, by: str, text: str = "text") -> DataFrame:
    """(by, word): the words of every text, in lower case; null texts have none."""
    found = F.filter(F.split(F.lower(F.col(f"`{text}`")), "[ \\t\\n\\r]+"), lambda w: w != "")
    return docs.select(F.col(f"`{by}`").alias(by), F.explode(found).alias("word"))


def sketched(rows: DataFrame, by: str, item: str = "word", log_k: int = LOG_K, items: int = ITEMS) -> DataFrame:
    """(by, n, distinct_sketch, top_sketch) of the rows (by, item): a row a group; null items are left out."""
    known = rows.where(F.col(f"`{item}`").isNotNull())
    return known.groupBy(F.col(f"`{by}`").alias(by)).agg(F.count("*").alias("n"), F.hll_sketch_agg(item, log_k).alias("distinct_sketch"), F.expr(f"approx_top_k_accumulate(`{item}`, {items})").alias("top_sketch"))


def merged(sketches: DataFrame, *by: str, items: int = ITEMS) -> DataFrame:
    """Sketches of larger groups, or of all, from those of smaller ones."""
    return sketches.groupBy(*[F.col(f"`{c}`") for c in by]).agg(
        F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.expr(f"approx_top_k_combine(top_sketch, {items})").alias("top_sketch")
    )


def read(sketches: DataFrame, k: int = 10) -> DataFrame:
    """What the sketches say: n, n_distinct (rounded), and top, an array of the k most frequent (item, count)."""
    return sketches.withColumns({"n_distinct": F.hll_sketch_estimate("distinct_sketch"), "top": F.expr(f"approx_top_k_estimate(top_sketch, {k})")}).drop("distinct_sketch", "top_sketch")
