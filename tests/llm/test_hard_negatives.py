"""Hard negatives by product quantisation against all pairs, and odd inputs."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import hard_negatives as hn
from millrace.llm.common import table
from millrace.llm.queries import QUERIES


def by_hand(rows, is_anchor):
    """rows: (id, label, vector of whole numbers)."""
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = set()
    for a_id, a_label, a in rows:
        if not is_anchor(a_id):
            continue
        scored = sorted(((score(a, v), i, label) for i, label, v in rows if i != a_id), key=lambda s: (-s[0], s[1]))
        for p, p_id, _ in [s for s in scored if s[2] == a_label][:5]:
            inside = [s for s in scored if s[2] != a_label and 50 * p <= 100 * s[0] <= 95 * p][:3]
            out |= {(a_id, p_id, k + 1, n_id, p, n) for k, (n, n_id, _) in enumerate(inside)}
    return out


def whole(v):
    return [math.floor(256 * x) for x in v]


ORDER = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def mined(spark, rows, schema="vec_id long, embedding array<double>, label int", **how):
    df = hn.rows_of(spark.createDataFrame(rows, schema))
    return set(map(tuple, hn.mined(df, F.col("vec_id") % 5 == 0, **how).select(ORDER).collect()))


@pytest.mark.parametrize("max_train, max_sent, chunk", [(8192, 1 << 26, 4096), (40, 2000, 37)])
def test_agrees_with_all_pairs(spark, monkeypatch, max_train, max_sent, chunk):
    """Clusters, many equal vectors, and labels of one row; with poor centroids, small chunks and many shares as well."""
    monkeypatch.setattr(hn, "CHUNK", chunk)
    monkeypatch.setattr(hn, "ANCHORS", 16)
    rng = random.Random(6)
    centres = [[rng.gauss(0, 1) for _ in range(7)] for _ in range(6)]
    rows = []
    for i in range(300):
        c = rng.randrange(6)
        v = centres[c] if rng.random() < 0.3 else [x + rng.gauss(0, 0.4) for x in centres[c]]
        rows.append((i, v, c if rng.random() < 0.8 else rng.randrange(6)))
    rows.append((300, centres[0], 77))
    want = by_hand([(i, label, whole(v)) for i, v, label in rows], lambda i: i % 5 == 0)
    assert len(want) > 300 and mined(spark, rows, max_train=max_train, max_sent=max_sent) == want


def test_bounds_hold_for_every_pair(spark):
    rng = np.random.default_rng(7)
    x = np.floor(rng.normal(0, 60, (500, 8)))
    rows = spark.createDataFrame([(i, 0, r.tolist()) for i, r in enumerate(x)], "vec_id long, label long, v array<double>")
    cents = hn.trained(rows, 8, 100)
    codes, norms = hn.encoded(x, cents)
    row = {"ids": np.arange(500).tobytes(), "labels": np.zeros(500, np.int64).tobytes(), "codes": codes.tobytes(), "norms": norms.tobytes(), "x": x.tobytes()}
    widths = []
    for i, least, most in hn._Chunk(row, cents).bounds(x):
        true = x @ x[i]
        assert (least <= true).all() and (true <= most).all()
        widths.append((most - least).mean() / np.abs(true).max())
    assert np.mean(widths) < 0.6


def test_rows_that_take_no_part(spark):
    inf, nan = float("inf"), float("nan")
    good = [(i, [float(i % 3), 1.0, 0.5], i % 2) for i in range(1, 30)]
    bad = [(None, [1.0, 1.0, 1.0], 0), (100, None, 0), (105, [1.0, 1.0, 1.0], None), (110, [1.0, None, 1.0], 0), (115, [inf, 0.0, 0.0], 1), (120, [nan, 0.0, 0.0], 1), (125, [-inf, 0.0, 0.0], 0)]
    want = by_hand([(i, label, whole(v)) for i, v, label in good], lambda i: i % 5 == 0)
    assert want and mined(spark, good + bad) == want
    assert mined(spark, good + good + bad) == want
    assert mined(spark, bad) == set() and mined(spark, []) == set()


def test_odd_vectors(spark):
    """Vectors of several lengths count as if zeros followed; empty ones score nothing, and nothing lies between nothing."""
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(i % 5)], i % 2) for i in range(60)]
    assert mined(spark, rows) == by_hand([(i, label, whole(v)) for i, v, label in rows], lambda i: i % 5 == 0)


def test_large_components_count_exactly(spark):
    big = [(i, [float(1 << 40) + i, 1.0], i % 2) for i in range(30)]
    assert mined(spark, big) == set()  # all scores are as large as a long can be
    near = [(i, [float((1 << 21) - (i << 15)) + i / 256, 3.0], i % 2) for i in range(30)]
    want = by_hand([(i, label, whole(v)) for i, v, label in near], lambda i: i % 5 == 0)
    assert max(p for *_, p, _ in want) > 1 << 57 and mined(spark, near) == want
    x = np.array([[3.0, float(1 << 50)], [1.0, -float(1 << 50)]])
    assert hn.exact(x, np.array([1.0, 4096.0])).tolist() == [3 + (1 << 62), 1 - (1 << 62)]


def test_window_of_scores():
    for p in (0, 1, 2, 19, 20, 101, 1 << 62):
        low, high = hn.window(p, 50, 95)
        assert 50 * p <= 100 * low < 50 * p + 100 and 95 * p - 100 < 100 * high <= 95 * p


def test_blocks_hold_wanted_scores():
    batch = pa.RecordBatch.from_pydict({"vec_id": [5, 6], "label": [0, 1], "v": [[1.0, 2.0], [3.0]], "wanted": [[7, 8], [9]]}, schema=pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("v", pa.list_(pa.float64())), ("wanted", pa.list_(pa.int64()))]))
    (block,) = hn._blocks(2)(iter([batch]))
    row = block.to_pylist()[0]
    assert np.frombuffer(row["a_wanted"], np.int64).tolist() == [7, 8, 9] and np.frombuffer(row["a_sizes"], np.int64).tolist() == [2, 1]
    assert np.frombuffer(row["a_x"]).tolist() == [1.0, 2.0, 3.0, 0.0]


def test_op12_rows(spark, small):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, whole(r.embedding)) for r in table(spark, small, "embeddings").collect()]
    got = set(map(tuple, QUERIES["op12_hard_negatives"](spark, small).select(ORDER).collect()))
    assert got == by_hand(rows, lambda i: i % 50 == 0) and len(got) > 100
