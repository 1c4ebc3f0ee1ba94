"""Approximate nearest neighbours by an index: inverted lists around k-means centroids.

The centroids come from a bounded sample; every row is in the list of its nearest one. A query looks only through the
lists nearest to it. Lists are split into shares of at most MAX_SHARE rows, and the queries that meet one into
shares of MAX_QUERIES, so no task holds more than one share of each, whatever list a third of the rows is in.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.sources.tables import stored

#: Rows that the centroids are fitted on at most: those with the smallest hashed ids.
SAMPLE = 16_384
ITERATIONS = 8
MAX_SHARE, MAX_QUERIES = 20_000, 2_000


@dataclass
class Index:
    """The lists (list_id, vec_id, v) as a stored table of unit vectors, and their centroids by number."""

    rows: DataFrame
    centroids: np.ndarray


def _unit(lists: pa.ListArray, dim: int) -> np.ndarray:
    """Unit rows; those of another length or of length zero are zeros."""
    x, sizes = np.zeros((len(lists), dim)), np.diff(np.asarray(lists.offsets))
    fits = np.repeat(sizes == dim, sizes)
    x[sizes == dim] = lists.flatten().to_numpy(zero_copy_only=False)[fits].reshape(-1, dim)
    norm = np.sqrt((x**2).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=(norm > 0) & np.isfinite(norm))


def fitted(vectors: DataFrame, dim: int, lists: int, sample: int = SAMPLE) -> np.ndarray:
    """Unit centroids by k-means on the cosine, from at most `sample` rows."""
    rows = vectors.select("embedding", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(sample).toArrow()
    x = _unit(rows.column("embedding").combine_chunks(), dim)
    x = x[(x != 0).any(1)]
    if not len(x):
        return np.zeros((1, dim))
    cents = x[np.random.default_rng(3).permutation(len(x))[:lists]].copy()
    for _ in range(ITERATIONS):
        near = (x @ cents.T).argmax(1)
        total = np.zeros_like(cents)
        np.add.at(total, near, x)
        norm = np.sqrt((total**2).sum(1, keepdims=True))
        cents = np.where(norm > 0, total / np.where(norm > 0, norm, 1), cents)
    return cents


def built(vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE) -> Index:
    """The index of (vec_id, embedding); rows with a null vector, or a null within it, are left out.

    lists: by default twice the square root of the rows, between 1 and 4096. The length of the vectors is that of most.
    """
    given = vectors.where("vec_id is not null and embedding is not null").where(~F.exists("embedding", lambda x: x.isNull())).select("vec_id", "embedding")
    facts = given.agg(F.count("*"), F.mode(F.size("embedding"))).first()
    rows, dim = facts[0], max(1, facts[1] or 1)
    cents = fitted(given, dim, lists or int(min(4096, max(1, 2 * rows**0.5))), sample)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _unit(b.column(1), dim)
            near = pa.array((x @ cents.T).argmax(1).astype(np.int32))
            v = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * dim), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([near, b.column(0), v], names=["list_id", "vec_id", "v"])

    return Index(stored(given.mapInArrow(assign, "list_id int, vec_id long, v array<double>"), "vector-lists"), cents)


def _probed(queries: DataFrame, cents: np.ndarray, probes: int) -> DataFrame:
    """(list_id, query_id, q): each query (vec_id, v) once for each of its nearest lists."""
    n = min(probes, len(cents))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _unit(b.column(1), cents.shape[1])
            near = np.argpartition(-(x @ cents.T), n - 1, axis=1)[:, :n]
            at = np.repeat(np.arange(len(b)), n)
            yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at))], names=["list_id", "query_id", "q"])

    return queries.select("vec_id", "v").mapInArrow(run, "list_id int, query_id long, q array<double>")


def searched(index: Index, queries: DataFrame, k: int = 5, probes: int = 16, max_share: int = MAX_SHARE, max_queries: int = MAX_QUERIES) -> DataFrame:
    """(query_id, vec_id, rank, similarity): the k rows nearest by cosine in the query's lists, itself left out, ties by id.

    queries: rows of the index. Similarities are rounded to four places before they are ranked, as in `neighbours`.
    """
    dim, where = index.centroids.shape[1], ["list_id", "share", "turn"]
    met = stored(_probed(queries, index.centroids, probes), "probes")
    sizes = index.rows.groupBy("list_id").agg(F.count("*").alias("rows")).join(met.groupBy("list_id").agg(F.count("*").alias("asked")), "list_id")
    sizes = stored(sizes.select("list_id", F.ceil(F.col("rows") / max_share).cast("int").alias("shares"), F.ceil(F.col("asked") / max_queries).cast("int").alias("turns")), "list-sizes")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    rows = index.rows.join(sizes, "list_id").withColumn("share", one("vec_id", "shares")).withColumn("turn", each("turns")).select(*where, "vec_id", "v")
    asked = met.join(sizes, "list_id").withColumn("turn", one("query_id", "turns")).withColumn("share", each("shares")).select(*where, "query_id", "q")

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, x = left.column("vec_id").to_numpy(), left.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        out = []
        for q_id, q in zip(right.column("query_id").to_numpy(), right.column("q").combine_chunks().flatten().to_numpy().reshape(-1, dim), strict=True):
            near = np.round(x @ q, 4)
            at = np.flatnonzero(ids != q_id)
            at = at[np.lexsort((ids[at], -near[at]))[:k]]
            out.append((np.full(len(at), q_id), ids[at], near[at]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.array([], t) for t in (np.int64, np.int64, float)]
        return pa.table({"query_id": columns[0], "vec_id": columns[1], "similarity": columns[2]})

    local = rows.groupBy(*where).cogroup(asked.groupBy(*where)).applyInArrow(best, "query_id long, vec_id long, similarity double")
    order = W.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "vec_id", "rank", "similarity")
