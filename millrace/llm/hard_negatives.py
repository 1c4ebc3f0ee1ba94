"""Hard negatives by product quantisation with stored residual norms.

Vectors are cut into subvectors of SUB components, and each is replaced by the number of its nearest centroid;
what that leaves out of a row is kept as one number, the residual's norm. An anchor's inner products with all
centroids form a lookup table, a row's score is the sum of its entries, and the true score differs from it by at
most |anchor| * |residual| (Cauchy-Schwarz), so the bounds leave out only rows that cannot count. Those that can
are scored again in integers. Centroids come from k-means on a bounded sample (MAX_TRAIN rows, those with the
smallest hashed ids); worse centroids cost time, never rows.

Two rounds: each anchor's best rows of its own label are its positives; then, for each positive, the best rows of
other labels whose score is within the given shares of the positive's.

Scale: rows are packed into chunks of CHUNK, anchors into blocks of ANCHORS. The anchors are a stated query set
that meets all rows, block by block; up to MAX_SENT bytes of blocks are sent to the tasks at a time, and each pair of
a block and a chunk gives at most the wanted number of rows an anchor (and positive). Of those, tasks keep the
best before anything is shuffled.

Defined results: rows with a null id, label or vector, or a null or non-finite component, take no part; shorter
vectors count as if zeros followed; of rows that share an id the least (by label, then components) takes part;
rows of equal score go by the smaller id; scores beyond 64 bits count as the nearest long; an anchor without positives or negatives gives no row, as does an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import give_back, table, written

SUB, CENTROIDS, ITERATIONS, MAX_TRAIN = 2, 256, 6, 8192
CHUNK, ANCHORS, MAX_SENT = 4096, 512, 64_000_000
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
#: Bytes that a chunk's components may take; longer vectors make smaller chunks.
CHUNK_BYTES = 16_000_000


def rows_of(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, label, v): the rows that take part, components as floor(scale * x), whole numbers held as doubles."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    finite = ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = vectors.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("v")).where(finite)
    # floor() gives a long, which large components are beyond; those of 2^52 and more are whole as they are
    floor = lambda c: F.when(F.abs(c) < float(1 << 52), F.floor(c).cast("double")).otherwise(c)
    ready = whole.withColumn("v", F.transform("v", lambda c: floor(c * scale)))
    least = ready.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r"))
    return least.select("vec_id", "r.label", "r.v")


def trained(rows: DataFrame, dim: int, max_train: int = MAX_TRAIN) -> np.ndarray:
    """Centroids [subspace, centroid, SUB] by k-means on at most max_train rows."""
    sample = rows.select("v", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(max_train).toArrow()
    if not len(sample):
        return np.zeros((dim // SUB, 1, SUB))
    x = _matrix(sample.column("v").combine_chunks(), dim).reshape(len(sample), -1, SUB).transpose(1, 0, 2)
    rng = np.random.default_rng(1)
    cents = x[:, rng.permutation(x.shape[1])[: min(CENTROIDS, x.shape[1])], :].copy()
    for j in range(len(x)):
        for _ in range(ITERATIONS):
            near = _nearest(x[j], cents[j])
            n = np.bincount(near, minlength=cents.shape[1])
            for k in range(SUB):
                total = np.bincount(near, x[j, :, k], minlength=cents.shape[1])
                cents[j, n > 0, k] = total[n > 0] / n[n > 0]
    return cents


def _matrix(lists: pa.ListArray, dim: int) -> np.ndarray:
    """Rows of dim components (dim a multiple of SUB), zeros after shorter ones."""
    ends = np.asarray(lists.offsets)
    sizes = np.diff(ends)
    out = np.zeros((len(lists), dim))
    out[np.arange(dim) < sizes[:, None]] = np.asarray(lists.values)[ends[0] : ends[-1]]
    return out


def _nearest(x: np.ndarray, cents: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (cents**2).sum(1) / 2
    for i in range(0, len(x), 4096):
        out[i : i + 4096] = (half - x[i : i + 4096] @ cents.T).argmin(1)
    return out


def encoded(x: np.ndarray, cents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes [row, subspace], residual norms) of whole-number rows."""
    codes = np.stack([_nearest(x[:, SUB * j : SUB * j + SUB], c) for j, c in enumerate(cents)], 1).astype(np.uint8)
    back = cents[np.arange(len(cents)), codes].reshape(len(x), -1)
    return codes, np.sqrt(((x - back) ** 2).sum(1))


def _chunks(cents: np.ndarray):
    """Batches of (vec_id, label, v) to packed chunks."""
    dim = len(cents) * SUB
    step = max(1, min(CHUNK, CHUNK_BYTES // (8 * dim)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(t: pa.Table) -> pa.RecordBatch:
            x = _matrix(t.column(2).combine_chunks(), dim)
            codes, norms = encoded(x, cents)
            parts = [t.column(0).to_numpy(), t.column(1).to_numpy(), codes, norms, x]
            return pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], names=["ids", "labels", "codes", "norms", "x"])

        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            while len(held) >= step:
                yield pack(held.slice(0, step))
                held = held.slice(step)
        if held is not None and len(held):
            yield pack(held)

    return run


def _blocks(dim: int):
    """Batches of (vec_id, label, v, wanted scores) to packed blocks of anchors."""
    step = max(1, min(ANCHORS, CHUNK_BYTES // (8 * dim)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), step):
                s = b.slice(i, step)
                wanted = s.column(3)
                parts = [s.column(0).to_numpy(), s.column(1).to_numpy(), _matrix(s.column(2), dim), np.diff(np.asarray(wanted.offsets)).astype(np.int64), np.asarray(wanted.flatten()).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], names=["a_ids", "a_labels", "a_x", "a_sizes", "a_wanted"])

    return run


def exact(x: np.ndarray, q: np.ndarray) -> list[int] | np.ndarray:
    """Integer inner products of whole-number rows with q, whatever their size."""
    top = np.abs(x).max(initial=0.0) * np.abs(q).max(initial=0.0) * x.shape[1]
    if top < 2.0**53:
        return (x @ q).astype(np.int64)
    least, most = -(1 << 63), (1 << 63) - 1
    ints = [int(c) for c in q]
    return np.array([min(max(sum(int(a) * b for a, b in zip(r, ints, strict=True)), least), most) for r in x], np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, ~scores))[:k]


class _Chunk:
    """A chunk's rows, and their possible scores with anchors."""

    def __init__(self, row: dict, cents: np.ndarray):
        self.cents, self.ids, self.labels = cents, np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.codes = np.frombuffer(row["codes"], np.uint8).reshape(len(self.ids), -1).T.astype(np.intp)
        self.norms, self.x = np.frombuffer(row["norms"]), np.frombuffer(row["x"]).reshape(len(self.ids), -1)
        self.sizes = np.sqrt((self.x**2).sum(1))

    def bounds(self, anchors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(anchor, least scores, largest scores) for each anchor: table entries, give or take the residual's share and rounding."""
        for low in range(0, len(anchors), 64):
            q = anchors[low : low + 64]
            tables = np.einsum("ajs,jcs->jca", q.reshape(len(q), len(self.cents), SUB), self.cents)
            sums = np.zeros((len(self.ids), len(q)))
            for entries, codes in zip(tables, self.codes, strict=True):
                sums += entries[codes]
            for i, size in enumerate(np.sqrt((q**2).sum(1))):
                slack = size * (self.norms * (1 + 1e-9) + 1e-9 * self.sizes) + 1e-6
                least, most = sums[:, i] - slack, sums[:, i] + slack
                yield low + i, np.where(np.isfinite(least), least, -np.inf), np.where(np.isfinite(most), most, np.inf)


def _top(bound: np.ndarray, sure: np.ndarray, k: int) -> float:
    """A score that the k-th best of the sure rows reaches at least."""
    return np.partition(bound[sure], -k)[-k] if sure.sum() >= k else -np.inf


def _search(cents: np.ndarray, find):
    """Rows of a chunk and a block to what find gives for each anchor, as (anchor_id, wanted, vec_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                chunk = _Chunk(row, cents)
                a_ids, a_labels = np.frombuffer(row["a_ids"], np.int64), np.frombuffer(row["a_labels"], np.int64)
                anchors = np.frombuffer(row["a_x"]).reshape(len(a_ids), -1)
                wanted = np.split(np.frombuffer(row["a_wanted"], np.int64), np.cumsum(np.frombuffer(row["a_sizes"], np.int64))[:-1])
                found = [np.zeros((0, 4), np.int64)]
                for i, least, most in chunk.bounds(anchors):
                    for mark, at, scores in find(chunk, a_ids[i], a_labels[i], anchors[i], wanted[i].tolist(), least, most):
                        found.append(np.stack([np.full(len(at), a_ids[i]), np.full(len(at), mark), chunk.ids[at], scores], 1))
                e = np.concatenate(found)
                yield pa.RecordBatch.from_arrays([pa.array(e[:, k]) for k in range(4)], names=["anchor_id", "wanted", "vec_id", "score"])
        give_back(heap=False)

    return run


def _positives(k: int):
    def find(chunk, a_id, a_label, q, wanted, least, most):
        """The k best other rows of the anchor's label; wanted is 0."""
        same = (chunk.labels == a_label) & (chunk.ids != a_id)
        at = np.flatnonzero(same & (most >= _top(least, same, k)))
        scores = exact(chunk.x[at], q)
        first = _best(chunk.ids[at], scores, k)
        yield 0, at[first], scores[first]

    return find


def window(positive: int, low: int, high: int) -> tuple[int, int]:
    """Least and largest score with low * positive <= 100 * score <= high * positive."""
    return -((-low * positive) // 100), (high * positive) // 100


def _negatives(k: int, low: int, high: int):
    def find(chunk, a_id, a_label, q, wanted, least, most):
        """For each positive's score the k best rows of other labels within its window."""
        other = chunk.labels != a_label
        for positive in wanted:
            bottom, top = window(positive, low, high)
            maybe = other & (most >= bottom) & (least <= top)
            at = np.flatnonzero(maybe & (most >= _top(least, maybe & (least >= bottom) & (most <= top), k)))
            scores = exact(chunk.x[at], q)
            inside = (scores >= bottom) & (scores <= top)
            at, scores = at[inside], scores[inside]
            first = _best(chunk.ids[at], scores, k)
            yield positive, at[first], scores[first]

    return find


def _searched(chunks: DataFrame, anchors: DataFrame, cents: np.ndarray, find, k: int, max_sent: int) -> DataFrame:
    """(anchor_id, wanted, vec_id, score, rank): the k best over all chunks of what find gives.

    anchors: (vec_id, label, v, wanted), all of which meet all chunks, in blocks of which max_sent bytes at most are sent at a time.
    """
    blocks = written(anchors.mapInArrow(_blocks(len(cents) * SUB), "a_ids binary, a_labels binary, a_x binary, a_sizes binary, a_wanted binary"), "anchor-blocks")
    size = blocks.agg(F.sum(F.octet_length("a_x") + F.octet_length("a_wanted"))).first()[0] or 0
    shares = max(1, -(-size // max_sent))
    share = F.pmod(F.xxhash64("a_ids"), F.lit(shares))
    local = None
    for i in range(shares):
        met = chunks.join(F.broadcast(blocks.where(share == i))).mapInArrow(_search(cents, find), "anchor_id long, wanted long, vec_id long, score long")
        local = met if local is None else local.unionByName(met)
    order = W.partitionBy("anchor_id", "wanted").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mined(
    rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, max_train: int = MAX_TRAIN, max_sent: int = MAX_SENT
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows (vec_id, label, v) with distinct ids.

    Anchors are the rows where is_anchor holds. A negative's score is between low and high hundredths of the positive's.
    """
    rows = written(rows, "vectors")
    dim = rows.agg(F.max(F.size("v"))).first()[0] or 1
    dim += -dim % SUB
    cents = trained(rows, dim, max_train)
    chunks = written(rows.mapInArrow(_chunks(cents), "ids binary, labels binary, codes binary, norms binary, x binary"), "chunks")
    anchors = rows.where(is_anchor)
    bare = anchors.withColumn("wanted", F.array(F.lit(0).cast("long")))
    best = _searched(chunks, bare, cents, _positives(positives), positives, max_sent)
    pairs = written(best.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    wanted = pairs.where("positive_score >= 0").groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_set("positive_score").alias("wanted"))
    found = _searched(chunks, anchors.join(wanted, "vec_id"), cents, _negatives(negatives, low, high), negatives, max_sent)
    chosen = found.select("anchor_id", F.col("wanted").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return pairs.join(chosen, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(table(spark, sf_dir, "embeddings"))
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(rows.withColumn("label", changed), F.col("vec_id") % 50 == 0)


OP12_SQL = """WITH r AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS k
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, k::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE k <= 3"""
