"""Confusion matrices, rates, ranks and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.order import summed_before


def confusion(df: DataFrame, flagged: Column, truth: Column, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count_if(flagged & truth).alias("tp"), F.count_if(flagged & ~truth).alias("fp"), F.count_if(~flagged & truth).alias("fn"), F.count_if(~flagged & ~truth).alias("tn")
    )


def rates(df: DataFrame) -> DataFrame:
    """accuracy, precision, recall and F1 to six places; null where the denominator is zero."""
    part = lambda a, b: F.round(F.expr(f"({a}) / nullif({b}, 0)"), 6)
    return df.withColumns(
        {"accuracy": part("tp + tn", "tp + fp + fn + tn"), "precision_": part("tp", "tp + fp"), "recall": part("tp", "tp + fn"), "f1": part("2 * tp", "2 * tp + fp + fn")}
    )


def recall_at(df: DataFrame, score: str, truth: str, key: str, ks: tuple[int, ...]) -> DataFrame:
    """Share of the positives among the first k by score, ties by key."""
    order = W.orderBy(F.desc(score), F.asc(key))
    # only the first max(ks) rows are ranked; Spark takes them by a top-k, not by one big sort
    top = df.orderBy(F.desc(score), F.asc(key)).limit(max(ks)).withColumn("_rank", F.row_number().over(order))
    found = top.agg(*[F.count_if((F.col("_rank") <= k) & (F.col(truth) == 1)).alias(f"_{k}") for k in ks])
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_{k}").alias("hits")) for k in ks])
    positives = df.agg(F.count_if(F.col(truth) == 1).alias("positives"))
    return found.select(F.inline(rows)).join(F.broadcast(positives)).select("k", "hits", "positives", F.round(F.expr("hits / nullif(positives, 0)"), 6).alias("recall"))


def roc_auc(df: DataFrame, score: str, truth: str) -> DataFrame:
    """By rank sum with mean ranks on ties; counts by score are ranked, over ranges of scores.

    Rows with a null score rank below all others; a null truth counts as negative; without positives or
    negatives the area is null.
    """
    by_score = df.groupBy(F.col(score).alias("_score")).agg(F.count("*").alias("_rows"), F.count_if(F.col(truth) == 1).alias("pos"))
    ranked = summed_before(by_score, [F.col("_score").asc_nulls_first()], "_rows", "below").withColumn("mean_rank", F.col("below") + (F.col("_rows") + 1) / 2)
    sums = ranked.agg(F.sum(F.col("mean_rank") * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum(F.col("_rows") - F.col("pos")).alias("q"))
    return sums.select(F.col("p").alias("positives"), F.col("q").alias("negatives"), F.round(F.expr("(r - p * (p + 1) / 2) / nullif(p * q, 0)"), 6).alias("auc"))


def split_of(key: str) -> Column:
    """train, validation or test (8:1:1) by the first hex digits of the id's MD5."""
    bucket = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 6), 16, 10).cast("long") % 10
    return F.when(bucket < 8, "train").when(bucket == 8, "validation").otherwise("test")
