"""Quality by naive Bayes support vectors.

A document's n-grams are indicators, hashed to 2^18 places: words and pairs of words; word shapes
(letter case, digits and signs, runs closed up) alone and in pairs, a pair also telling whether
the word itself is repeated; each shape gram at the shares of the text that it reaches; the
text's length and share of distinct words. Indicators are scaled by the classes' log-count ratio, and
a linear hinge-loss model is fit to them by dual coordinate descent. Margins of models that
have not seen the row give the logistic scale of the score.

Scale: the fit takes at most `max_rows` labelled rows with `max_places` indicators in all, those
with the smallest hashes of their id, a documented bound on what reaches the driver (4 bytes an
indicator); scoring is one pass over all whole texts without a shuffle.

Defined results: null and empty texts are scored by their length alone; repeated rows score
alike, and each counts towards the bound; rows with a null id are scored, not held out, and never
learnt from; without labels of both classes every score is the share of class 1, or 0.5 without
any; an empty table gives an empty result; other columns are never inputs.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import table, written
from millrace.llm.tokens import blocks

PLACES, MAX_ROWS, MAX_PLACES, THRESHOLD = 1 << 18, 4_000, 20_000_000, 0.3
_SHARES = (0.02, 0.1, 0.3)
_RUNS = re.compile(r"[0-9]+|[^\W\d_]+")
_KNOWN = 500_000


def shape(word: str) -> str:
    """Its runs of letters and digits by kind, as far as twelve signs: longer shapes would be indicators of single texts."""
    def run(m: re.Match) -> str:
        s = m[0]
        return "0" if s[0].isdigit() else "A" if s.isupper() and len(s) > 1 else "Aa" if s[0].isupper() else "a"

    return _RUNS.sub(run, word)[:12]


def _mix(*parts: np.ndarray | int) -> np.ndarray:
    out = np.uint64(0x9E3779B97F4A7C15)
    for p in parts:
        out = (out ^ np.asarray(p, np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        out = out ^ (out >> np.uint64(29))
    return out


class Indicators:
    """Texts as sorted distinct places of their indicators."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, int]] = {}

    def _codes(self, words: list[str]) -> np.ndarray:
        if len(self.known) > _KNOWN:
            self.known.clear()
        for w in words:
            if w not in self.known:
                self.known[w] = (zlib.crc32(w.lower().encode()), zlib.crc32(shape(w).encode()))
        return np.array([self.known[w] for w in words], np.uint64).reshape(-1, 2)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(places, offsets): each text's places."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        flat = lists.flatten()
        at = lists.offsets.to_numpy()
        at = at - at[0]
        coded = flat.dictionary_encode()
        words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        empty = (pc.binary_length(flat).to_numpy(zero_copy_only=False) == 0) if len(flat) else np.zeros(0, bool)
        row = np.repeat(np.arange(len(texts)), np.diff(at))
        words, row = words[~empty], row[~empty]
        n = np.bincount(row, minlength=len(texts))
        table_ = self._codes(coded.dictionary.to_pylist())
        word, form = (table_[words, 0], table_[words, 1]) if len(words) else (np.zeros(0, np.uint64),) * 2
        mask = np.uint64(PLACES - 1)

        def grams(gram_row: np.ndarray, code: np.ndarray, levels: bool) -> tuple[np.ndarray, np.ndarray]:
            key, counts = np.unique((gram_row.astype(np.uint64) << np.uint64(32)) | (code & np.uint64(0xFFFFFFFF)), return_counts=True)
            r, c = (key >> np.uint64(32)).astype(np.int64), key & np.uint64(0xFFFFFFFF)
            rows, places = [r], [_mix(c, 0) & mask]
            for k, share in enumerate(_SHARES if levels else ()):
                hit = counts >= share * n[r]
                rows.append(r[hit])
                places.append(_mix(c[hit], k + 1) & mask)
            return np.concatenate(rows), np.concatenate(places)

        pair = row[1:] == row[:-1]
        same = (words[1:] == words[:-1])[pair]
        parts = [
            grams(row, _mix(word, 1), False),
            grams(row[1:][pair], _mix(word[:-1][pair], word[1:][pair], 7), False),
            grams(row, _mix(form, 2), True),
            grams(row[1:][pair], _mix(form[:-1][pair], form[1:][pair], 3 + same), True),
        ]
        distinct = np.bincount(np.unique(row * (len(coded.dictionary) + 1) + words) // (len(coded.dictionary) + 1), minlength=len(texts))
        every = np.arange(len(texts))
        parts.append((every, _mix(np.ceil(np.log2(n + 1)), 5) & mask))
        parts.append((every, _mix(np.floor(10 * distinct / np.maximum(n, 1)), 6) & mask))
        key = np.unique(np.concatenate([(r.astype(np.uint64) << np.uint64(18)) | p for r, p in parts]))
        rows = (key >> np.uint64(18)).astype(np.int64)
        return (key & mask).astype(np.int64), np.searchsorted(rows, np.arange(len(texts) + 1))


def log_ratio(x: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """Log ratio of each place's share of the classes' indicators, smoothed by alpha; 0 for those seen in one row or none."""
    p, q = (np.bincount(np.concatenate([np.zeros(0, int), *(r for r, k in zip(x, y, strict=True) if k == c)]), minlength=PLACES) + alpha for c in (1, 0))
    out = np.log(p / p.sum()) - np.log(q / q.sum())
    out[(p + q) <= 2 * alpha + 1] = 0
    return out


def dual_descent(x: list[np.ndarray], v: list[np.ndarray], y: np.ndarray, cost: float = 1.0, rounds: int = 20, seed: int = 0) -> np.ndarray:
    """w of min |w|^2/2 + cost * sum of hinge losses; classes weigh alike. Rows: places x, values v."""
    sign = np.where(y == 1, 1.0, -1.0)
    upper = cost * len(y) / (2 * np.where(y == 1, (y == 1).sum(), (y == 0).sum()))
    w, a = np.zeros(PLACES), np.zeros(len(y))
    square = np.array([r @ r for r in v]) + 1e-12
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(y)):
            g = sign[i] * (v[i] @ w[x[i]]) - 1
            new = min(max(a[i] - g / square[i], 0.0), upper[i])
            if new != a[i]:
                w[x[i]] += (new - a[i]) * sign[i] * v[i]
                moved = max(moved, abs(new - a[i]))
                a[i] = new
        if moved < 1e-3:
            break
    return w


def _weights(x: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Weights of the plain indicators: a text's margin is their sum over the root of their number."""
    r = log_ratio(x, y)
    return r * dual_descent(x, [r[p] / np.sqrt(max(len(p), 1)) for p in x], y)


def _margins(w: np.ndarray, x: list[np.ndarray]) -> np.ndarray:
    return np.array([w[p].sum() / np.sqrt(max(len(p), 1)) for p in x])


def fit(x: list[np.ndarray], y: np.ndarray, folds: int = 3) -> tuple[np.ndarray, float, float]:
    """(weights, slope, shift) of score = logistic(slope * margin + shift)."""
    y = np.asarray(y)
    if len(set(y.tolist())) < 2 or min((y == 0).sum(), (y == 1).sum()) < folds:
        share = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        return np.zeros(PLACES), 0.0, float(np.log(share / (1 - share)))
    fold = np.zeros(len(y), int)
    for c in (0, 1):
        fold[y == c] = np.arange((y == c).sum()) % folds
    m = np.zeros(len(y))
    for k in range(folds):
        w = _weights([p for p, f in zip(x, fold, strict=True) if f != k], y[fold != k])
        m[fold == k] = _margins(w, [p for p, f in zip(x, fold, strict=True) if f == k])
    spread = m.std() + 1e-9
    z, ab = np.stack([m / spread, np.ones(len(y))], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ ab))
        h = (z.T * np.maximum(p * (1 - p), 1e-6)) @ z + 1e-3 * np.eye(2)
        ab -= np.linalg.solve(h, z.T @ (p - y) + 1e-3 * ab)
    return _weights(x, y), float(ab[0] / spread), float(ab[1])


def held_out(key: str = "doc_id"):
    """Remainder 0 of the CRC-32 of the id as text by five: never learnt from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = MAX_ROWS, max_places: int = MAX_PLACES):
    """The fitted (weights, slope, shift) from at most max_rows labelled rows, and max_places places, that are not held out."""
    chosen = labels.select(key, F.col(label).cast("int").alias("_y")).where(F.col("_y").isin(0, 1) & ~held_out(key))
    chosen = chosen.orderBy(F.xxhash64(key), key).limit(max_rows)
    rows = docs.select(key, text).join(F.broadcast(chosen), key).select(text, "_y", key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indicators = Indicators()
        for batch in batches:
            for b in blocks(batch, 0):
                places, offsets = indicators(b.column(0))
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(places.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(2), b.column(1), lists], names=[key, "y", "places"])

    kind = docs.schema[key].dataType.simpleString()
    coded = written(rows.mapInArrow(run, f"{key} {kind}, y int, places array<int>"), "training-rows")
    # a window over the sample: few rows unless ids repeat, and then only their numbers are sorted
    sizes = coded.select(key, "y", F.size("places").alias("n"), F.xxhash64("places").alias("p"))
    order = W.orderBy(F.xxhash64(key), key, "y", "p").rowsBetween(W.unboundedPreceding, 0)
    within = (F.count("*").over(order) <= max_rows) & (F.sum("n").over(order) <= max_places)
    ends = sizes.withColumn("ok", within).where("ok").agg(F.count("*").alias("rows")).first()["rows"]
    got = coded.orderBy(F.xxhash64(key), key, "y", F.xxhash64("places")).limit(ends).toArrow()
    return fit([np.asarray(p.values.to_numpy()) for p in got["places"]] if len(got) else [], got["y"].to_numpy())


def score(docs: DataFrame, model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row."""
    weights, slope, shift = model[0].astype(np.float32), model[1], model[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indicators = Indicators()
        for batch in batches:
            for b in blocks(batch):
                places, offsets = indicators(b.column(1))
                sums = np.concatenate([[0.0], np.cumsum(weights[places], dtype=np.float64)])
                margin = (sums[offsets[1:]] - sums[offsets[:-1]]) / np.sqrt(np.maximum(np.diff(offsets), 1))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(slope * margin + shift, -40, 40))))], names=[key, "score"])

    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, score double")


def op2_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
