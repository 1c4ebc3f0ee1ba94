"""Joins in time: the last row before (as-of), and points within intervals.

Neither compares a row with all rows of its key, and neither needs a key's rows in one task: the as-of join works
on ranges of (key, time) and hands what is open from range to range; the interval join works on bins and splits
crowded ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.order import by_range, joined_by_range
from millrace.sources.tables import stored


def _any_null(columns: list[str]) -> Column:
    return F.greatest(F.lit(False), F.lit(False), *[F.col(f"`{c}`").isNull() for c in columns])


def as_of(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str], same_time: bool = True, order: list[str] | None = None) -> DataFrame:
    """Each row of left with `values` of the last row of right that has its keys and isn't later.

    same_time: whether a row of right at the very time counts. Of rows of right at one time the last by `order`
    counts (by `values`, if none is given; nulls come first). A row of left without such a row, or with a null key
    or time, gets nulls; rows of right with a null key or time are left out. `values` mustn't be columns of left.

    One union of both sides, sorted by ranges, with the last row of right filled in forwards: one shuffle of both, no
    pairs of rows. A range's first rows take what the ranges before it left open, a row a range. So a key with any
    share of the rows is spread over ranges.
    """
    key = F.struct(F.lit(0).alias("k"), *[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)])
    known = ~_any_null([*keys, time])
    given = F.struct(*[F.col(f"`{v}`") for v in values])
    tie = F.struct(*[F.col(f"`{c}`") for c in (order or values)])
    row = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    # at one time, rows of right come before those of left where they count for them
    sides = (1, 0) if same_time else (0, 1)
    one = left.select(key.alias("k"), F.col(f"`{time}`").alias("t"), F.lit(sides[0]).alias("side"), row.alias("row"), known.alias("known"))
    other = right.where(known).select(key.alias("k"), F.col(f"`{time}`").alias("t"), F.lit(sides[1]).alias("side"), tie.alias("tie"), given.alias("given"))
    both = one.unionByName(other, allowMissingColumns=True).withColumn("salt", F.when(F.col("row").isNotNull(), F.xxhash64(F.to_json("row"))))
    rows = by_range(both, [F.col("k").asc_nulls_first(), F.col("t").asc_nulls_first(), F.col("side"), F.col("tie").asc_nulls_first(), F.col("salt")])
    last = F.last("given", ignorenulls=True)
    inside = last.over(W.partitionBy("_part", "k").orderBy("_place").rowsBetween(W.unboundedPreceding, 0))
    ends = rows.where("given is not null").groupBy("_part").agg(F.max_by(F.struct("k", "given"), "_place").alias("end"))
    parts = rows.select("_part").distinct().join(ends, "_part", "left")
    carried = parts.select("_part", F.last("end", ignorenulls=True).over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)).alias("carried"))
    filled = joined_by_range(rows.withColumn("inside", inside), carried).where("row is not null")
    open_ = F.when(F.col("carried.k") == F.col("k"), F.col("carried.given"))
    return filled.withColumn("found", F.when(F.col("known"), F.coalesce("inside", open_))).select("row.*", *[F.col(f"found.`{v}`").alias(v) for v in values])


#: Bins that an interval covers at the most, but for the last that it only touches.
BINS = 8
#: Points of one bin that meet its intervals in one task; bins with more are split by the points' hashes.
MAX_POINTS = 100_000


def within(points: DataFrame, intervals: DataFrame, time: str, begin: str, end: str, keys: list[str] | None = None, max_points: int = MAX_POINTS) -> DataFrame:
    """Each pair of a point and an interval (of the same keys, if any) with begin <= time < end, once; all columns of both.

    Times are timestamps, or longs. Rows with a null among keys and times, and intervals that end before they
    begin, are in no pair. Apart from keys, the two sides' columns must have different names.

    Bins are as wide as the intervals need: an interval is filed under the bins of the least width (a power of two) of
    which BINS reach from its begin to its end, so a long one has no more bins than a short one. A point looks
    in its bin of every width in use (at most 64). So each pair meets in one bin, by equality. Bins with more than
    max_points points are split: their points are dealt by hash, their intervals are there for each share. What a task
    makes is pairs, which may be a hundred times the rows that it reads: tasks are as many as shuffles have
    partitions, not fewer for the few bytes that they read.
    """
    keys = keys or []
    ticks = lambda df, c: F.unix_micros(F.col(f"`{c}`").cast("timestamp")) if df.schema[c].dataType.typeName().startswith("timestamp") else F.col(f"`{c}`").cast("long")
    named = lambda df, name: df.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)], F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name), "*")
    ks = [f"_k{i}" for i in range(len(keys))]
    # shift: the bins' width is 2^shift
    span = named(intervals, "_i").where(~_any_null([*keys, begin, end])).withColumns({"_b": ticks(intervals, begin), "_e": ticks(intervals, end)}).where("_b < _e")
    span = span.withColumn("_shift", F.greatest(F.lit(0), F.ceil(F.log2((F.col("_e") - F.col("_b")) / BINS))).cast("int"))
    filed = span.select(*ks, "_i", "_b", "_e", "_shift", F.explode(F.sequence(F.expr("shiftright(_b, _shift)"), F.expr("shiftright(_e - 1, _shift)"))).alias("_bin"))
    filed = stored(filed, "interval-bins")
    shifts = sorted(r[0] for r in filed.select("_shift").distinct().collect())
    looked = named(points, "_p").where(~_any_null([*keys, time])).withColumn("_t", ticks(points, time))
    at = F.array(*[F.struct(F.lit(s).alias("_shift"), F.shiftright("_t", s).alias("_bin")) for s in shifts]) if shifts else F.array().cast("array<struct<_shift:int,_bin:bigint>>")
    looked = looked.select(*ks, "_p", "_t", F.inline(at))
    where = [*ks, "_shift", "_bin"]
    # only bins that have intervals are counted, and only those that are crowded are named
    used = filed.select(where).distinct()
    crowded = looked.select(where).join(used, where, "left_semi").groupBy(where).agg(F.count("*").alias("_n")).where(F.col("_n") > max_points)
    crowded = stored(crowded.select(*where, F.ceil(F.col("_n") / max_points).cast("int").alias("_shares")), "crowded-bins")
    shares = F.coalesce("_shares", F.lit(1))
    left = looked.join(crowded, where, "left").withColumn("_share", F.when(shares > 1, F.pmod(F.xxhash64("_t", F.to_json("_p")), shares).cast("int")).otherwise(F.lit(0)))
    right = filed.join(crowded, where, "left").withColumn("_share", F.explode(F.sequence(F.lit(0), shares - 1)))
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda df, *own: df.select(*where, "_share", *own).repartition(tasks, *where, "_share")
    met = dealt(left, "_p", "_t").join(dealt(right, "_i", "_b", "_e"), [*where, "_share"]).where("_b <= _t and _t < _e")
    return met.select("_p.*", *[F.col(f"_i.`{c}`").alias(c) for c in intervals.columns if c not in keys])
