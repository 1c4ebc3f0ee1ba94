"""Tables as multisets: what two have in common, and what one has more of, copies counted.

Nulls are equal to each other, as in set operations. Hot rows cost no more than others: copies are summed before
they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Copies of one row that a task writes; more are dealt to several tasks.
MAX_COPIES = 10_000


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """(line): every line of every text; a null text is one null line."""
    return docs.select(F.explode(F.coalesce(F.split(F.col(f"`{text}`"), "\n"), F.array(F.lit(None).cast("string")))).alias("line"))


def balance(a: DataFrame, b: DataFrame) -> DataFrame:
    """Each distinct row of a or b once, with n_a and n_b, how often it is in either: one aggregation of both."""
    both = a.withColumn("_in_a", F.lit(1)).unionByName(b.withColumn("_in_a", F.lit(0)))
    counted = both.groupBy(*[F.col(f"`{c}`") for c in a.columns]).agg(F.sum("_in_a").alias("n_a"), F.count("*").alias("_n"))
    return counted.withColumn("n_b", F.col("_n") - F.col("n_a")).drop("_n")


def repeated(df: DataFrame, n: Column) -> DataFrame:
    """Each row n times (not at all for 0 or less)."""
    rows = df.withColumn("_n", n.cast("long")).where("_n > 0")
    parts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / MAX_COPIES))
    dealt = rows.withColumn("_part", F.explode(parts)).withColumn("_n", F.least(F.lit(MAX_COPIES), F.col("_n") - F.col("_part") * MAX_COPIES))
    if not rows.where(F.col("_n") > MAX_COPIES).isEmpty():
        dealt = dealt.repartition("_part", *[F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])])
    return dealt.select(*[F.col(f"`{c}`") for c in df.columns], F.explode(F.array_repeat(F.lit(0), F.col("_n").cast("int"))).alias("_")).drop("_")


def surplus(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows of a less those of b, copy by copy (EXCEPT ALL)."""
    return repeated(balance(a, b), F.col("n_a") - F.col("n_b")).select(*[F.col(f"`{c}`") for c in a.columns])


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows that both have, as often as the one that has fewer (INTERSECT ALL)."""
    return repeated(balance(a, b), F.least("n_a", "n_b")).select(*[F.col(f"`{c}`") for c in a.columns])
