"""Classes of linked ids: least-label propagation with pointer jumping, each round written out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.sources.tables import stored


def classes(links: DataFrame) -> DataFrame:
    """(rep, class_id) of every end of a link (a, b); class_id is the least id that links reach."""
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label"))
    while True:
        labels = stored(labels, "labels")
        near = both.join(labels.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        low = labels.join(near, "a").select("a", "label", F.least("label", "near").alias("low"))
        jump = low.join(labels.select(F.col("a").alias("low"), F.col("label").alias("far")), "low").select("a", "label", F.least("low", "far").alias("new"))
        jump = stored(jump, "labels")
        if jump.where("new <> label").isEmpty():
            return labels.select(F.col("a").alias("rep"), F.col("label").alias("class_id"))
        labels = jump.select("a", F.col("new").alias("label"))
