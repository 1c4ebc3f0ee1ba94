"""Packing by non-negative least squares on the length histogram.

Documents are cut into full windows and a rest. The histogram of piece lengths, at most
`window` numbers whatever the corpus, is all that reaches the driver. There, combinations of
up to three lengths that fill a window exactly are enumerated, their repeat counts x are
solved from min |A x - h|, x >= 0, by accelerated projected gradient steps, and rounded within
what is left of the histogram. The residual histogram is packed greedily, longest piece first,
exact completions before largest fits; that too works on counts, so its cost is bounded by the
window. Pieces find their place by their rank among the pieces of their length: ranks
[lo, hi) of a length fill one slot of one combination's sequences.

Ranks need no global sort: a piece knows its rank within its input partition, and the counts
of earlier partitions are summed per length.

Defined results: a null text is empty and gives one piece with just the end id; repeated rows
are packed one by one; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import give_back, table, written
from millrace.llm.tokens import blocks, shared_encoder

WINDOW, STEPS, TOLERANCE = 1024, 2000, 0.01


def pieces(docs: DataFrame, tokenizer: str, kind: str = "bytes", end_id: int = 0, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, part, rank): windows and a rest of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        encoder = shared_encoder(tokenizer, kind, end_id, special=True)
        for batch in batches:
            for b in blocks(batch):
                ids, offsets = encoder.encode(b.column(1))
                n = np.diff(offsets)
                parts = -(-n // window)
                row = np.repeat(np.arange(len(n)), parts)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)) * window
                length = np.minimum(window, n[row] - start)
                values = memoryview(ids.astype("<u4", copy=False)).cast("B")
                at = offsets[row] + start
                crc = [zlib.crc32(values[4 * x : 4 * y]) for x, y in zip(at.tolist(), (at + length).tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                sorted_ = length[order]
                rank = np.empty(len(row), np.int64)
                rank[order] = np.arange(len(row)) - np.searchsorted(sorted_, sorted_) + seen[sorted_]
                seen += np.bincount(length, minlength=window + 1)
                columns = [b.column(0).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(n[row]), pa.array(np.full(len(row), part)), pa.array(rank)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank"])
        give_back(heap=False)

    schema = f"doc_id {docs.schema[key].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, part long, rank long"
    return docs.select(key, text).mapInArrow(run, schema)


def combinations(lengths: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Rows of three lengths, descending, 0 for none, that sum to the window."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    there[0] = True
    a, b = np.meshgrid(np.flatnonzero(there), np.flatnonzero(there), indexing="ij")
    a, b = a.ravel(), b.ravel()
    c = window - a - b
    ok = (a >= b) & (b >= c) & (c >= 0)
    a, b, c = a[ok], b[ok], c[ok]
    ok = there[c]
    return np.stack([a[ok], b[ok], c[ok]], 1)


def solve_counts(combos: np.ndarray, histogram: np.ndarray, steps: int = STEPS, tolerance: float = TOLERANCE) -> np.ndarray:
    """x >= 0 that brings combos' lengths closest to the histogram, by FISTA with restarts.

    Ends when no length's error falls by more than `tolerance` pieces over 50 steps, or after `steps`.
    """
    size = len(histogram)
    h = histogram.astype(float)
    h[0] = 0

    def times(x):  # A x
        y = sum(np.bincount(combos[:, k], x, size) for k in range(3))
        y[0] = 0
        return y

    def back(y):  # A' y
        return y[combos].sum(1)

    v = np.ones(len(combos))
    for _ in range(20):
        v = back(times(v))
        scale = np.linalg.norm(v)
        v /= scale
    x = z = np.zeros(len(combos))
    t, before = 1.0, h
    for step in range(1, steps + 1):
        new = np.maximum(z - back(times(z) - h) / (1.05 * scale), 0)
        if (z - new) @ (new - x) > 0:  # the momentum leads uphill
            t = 1.0
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        z = new + (old - 1) / t * (new - x)
        x = new
        if step % 50 == 0:
            error = times(x) - h
            if np.abs(error - before).max() < tolerance:
                break
            before = error
    return x


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, number of such sequences); every piece is in one."""
    h = np.zeros(window + 1, np.int64)
    for length, n in histogram.items():
        h[length] = n
    out = []
    if h[window]:
        out.append(((window,), int(h[window])))
        h[window] = 0
    lengths = np.flatnonzero(h)
    combos = combinations(lengths, window) if len(lengths) else np.zeros((0, 3), int)
    if len(combos):
        x = solve_counts(combos, h)
        for i in np.argsort(-x, kind="stable"):
            if x[i] < 0.5:
                break
            part, need = np.unique(combos[i][combos[i] > 0], return_counts=True)
            n = int(min(np.rint(x[i]), (h[part] // need).min()))
            if n:
                h[part] -= n * need
                out.append((tuple(int(k) for k in combos[i] if k), n))
    return out + greedy(h, window)


def greedy(h: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """Longest piece first, then whatever one or two pieces close the gap exactly, else the largest that fits."""
    h, out = h.copy(), []
    while h.any():
        used: list[int] = [int(np.flatnonzero(h)[-1])]
        h_left = h.copy()
        h_left[used[0]] -= 1
        while (gap := window - sum(used)) > 0:
            fits = np.flatnonzero(h_left[: gap + 1])
            if not len(fits):
                break
            pair = fits[(h_left[gap - fits] > 0) & ((2 * fits != gap) | (h_left[fits] > 1))]
            new = [gap] if fits[-1] == gap else [int(pair[-1]), int(gap - pair[-1])] if len(pair) else [int(fits[-1])]
            for k in new:
                h_left[k] -= 1
            used += new
        part, need = np.unique(used, return_counts=True)
        n = int((h[part] // need).min())
        h[part] -= n * need
        out.append((tuple(used), n))
    return out


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int]]:
    """(length, first rank, first sequence, offset) of each slot, by length and rank."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for lengths, n in patterns:
        offset = 0
        for length in lengths:
            lo = used.get(length, 0)
            used[length] = lo + n
            out.append((length, lo, sequence, offset))
            offset += length
        sequence += n
    return sorted(out)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, **how) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    cut = written(pieces(docs, tokenizer, window=window, **how), "pieces")
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    by_slot = np.array(slots(plan(histogram, window)), np.int64).reshape(-1, 4)
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, 0)
    earlier = counts.select("part", "length", (F.sum("n").over(before) - F.col("n")).alias("earlier"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    ranked = cut.join(earlier, ["part", "length"]).select(*names, (F.col("rank") + F.col("earlier")).alias("rank"))
    step = int(max(histogram.values(), default=0)) + 1
    firsts = by_slot[:, 0] * step + by_slot[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(2).to_numpy(), b.column(5).to_numpy()
            slot = by_slot[np.searchsorted(firsts, length * step + rank, "right") - 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(slot[:, 2] + rank - slot[:, 1]), pa.array(slot[:, 3])], names=[*names, "sequence_id", "offset"])

    kind = dict(ranked.dtypes)["doc_id"]
    return ranked.mapInArrow(place, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
