"""Conversations: windows over turns, all on one partitioning by conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import canonical
from millrace.operators.rules import INJECTION, score, with_hits

def _by_turn():
    return W.partitionBy("conv_id").orderBy("turn")


def change_by_role(turns: DataFrame) -> DataFrame:
    size = F.length("text")
    before = F.lag(size).over(W.partitionBy("conv_id", "role").orderBy("turn"))
    return turns.select("conv_id", "turn", "role", (size - before).cast("long").alias("change"))


def running_score(turns: DataFrame) -> DataFrame:
    hit = with_hits(turns, "text")
    total = F.sum(score()).over(_by_turn().rowsBetween(W.unboundedPreceding, 0))
    return hit.select("conv_id", "turn", F.round(score(), 6).alias("turn_score"), F.round(total, 6).alias("running_score"))


def split_payload(turns: DataFrame, span: int = 3) -> DataFrame:
    """User turns where rules hit the last `span` user turns together, but not the turn alone."""
    users = turns.where("role = 'user'")
    joined = F.array_join(F.collect_list("text").over(_by_turn().rowsBetween(1 - span, 0)), " ")
    alone = with_hits(users.withColumn("joined", joined), "text", name="alone")
    both = with_hits(alone, "joined", name="together")
    return both.where("size(together) > size(alone)").select("conv_id", "turn", F.size("alone").cast("long").alias("n_alone"), F.size("together").cast("long").alias("n_together"))


def order_violations(turns: DataFrame) -> DataFrame:
    before = F.lag("role").over(_by_turn())
    marked = turns.withColumn("before", before)
    return marked.where("role = before or (role = 'system' and turn > 0) or (before is null and role = 'assistant')").select("conv_id", "turn", "role", "before")


def length_trend(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.round(F.regr_slope(F.length("text").cast("double"), F.col("turn").cast("double")), 4).alias("slope"))


def first_flagged(turns: DataFrame, threshold: float = 0.7) -> DataFrame:
    flagged = with_hits(turns, "text").where(score() >= threshold)
    return flagged.groupBy("conv_id").agg(F.min("turn").alias("first_turn"), F.min_by("role", "turn").alias("role"))


def verdict(turns: DataFrame, threshold: float = 0.7) -> DataFrame:
    scored = with_hits(turns, "text").withColumn("s", score())
    return scored.groupBy("conv_id").agg(F.round(F.max("s"), 6).alias("top_score"), F.bool_or(F.col("s") >= threshold).alias("flagged"), F.count("*").alias("n_turns"))


def spoofed(turns: DataFrame) -> DataFrame:
    """Turns that imitate role markers or chat templates."""
    marker = next(r for r in INJECTION if r.rule_id == "role_marker").pattern
    return turns.where(canonical(F.col("text")).rlike(marker)).select("conv_id", "turn", "role")
