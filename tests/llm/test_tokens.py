"""Chunked encoding against the tokenizers library, ORC tables and packing."""

import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import orc_tokens, packing
from millrace.llm.common import scratch, table
from millrace.llm.tokens import ChunkEncoder, shared_encoder

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "The", "don't", "'s", " ", "  ", "\n", "\n\n", "\t", "\r\n", "é", "É", "́", "̸", "=", "-", ".", ",", "1", "$$$", "<|endoftext|>", "日本", " ", "　", "\x1c", "\u0085", "Σ", "😀", "x.y", "O're"]


def plain(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize(("path", "kind"), [(WORDS, "words"), (BYTES, "bytes")])
def test_chunks_have_the_whole_texts_ids(path, kind):
    encoder, tokenizer = ChunkEncoder(path, kind, 7), plain(path)

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(PIECES)).map("".join), st.text()), min_size=1, max_size=5))
    def check(texts):
        texts = [t if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
        ids, offsets = encoder.encode(pa.array(texts, pa.string()))
        for i, t in enumerate(texts):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 7]

    check()


SPECIAL = ["a <|endoftext|> b", "<|startoftext|>x<|endoftext|>", "plain text", None, "<|ENDOFTEXT|> no", "caf\u00e9\u00a0x", "<|endoftext|>"]


@pytest.mark.parametrize(("path", "kind"), [(WORDS, "words"), (BYTES, "bytes")])
def test_special_tokens_as_the_library_has_them(path, kind):
    ids, offsets = ChunkEncoder(path, kind, 7, special=True).encode(pa.array(SPECIAL, pa.string()))
    library = Tokenizer.from_file(path)
    for i, t in enumerate(SPECIAL):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == [*library.encode(t or "", add_special_tokens=False).ids, 7]


def test_special_tokens_in_the_operators(spark):
    df = spark.createDataFrame(list(enumerate(SPECIAL)), "doc_id long, text string")
    path, library = scratch(spark, "special"), Tokenizer.from_file(WORDS)
    orc_tokens.write_tokens(df, path, WORDS)
    assert {r.doc_id: r.ids for r in orc_tokens.read_tokens(spark, path).collect()} == {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(SPECIAL)}
    library = Tokenizer.from_file(BYTES)
    assert sum(r.length for r in packing.pack(df, BYTES).collect()) == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for t in SPECIAL)


def test_a_full_cache_keeps_the_ids(monkeypatch):
    monkeypatch.setattr("millrace.llm.tokens.CACHE", 9)
    rng = random.Random(4)
    for path, kind in [(WORDS, "words"), (BYTES, "bytes")]:
        encoder, tokenizer = ChunkEncoder(path, kind, 0), plain(path)
        for _ in range(60):
            t = " ".join(f"word{rng.randint(0, 12)}" for _ in range(rng.randint(0, 7)))
            assert encoder.encode(pa.array([t]))[0].tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
            assert len(encoder.old.places) <= 9 + 14


def test_one_encoder_a_process():
    assert shared_encoder(BYTES, "bytes", 0) is shared_encoder(BYTES, "bytes", 0)
    assert shared_encoder(BYTES, "bytes", 0).end_id == 0 and shared_encoder(BYTES, "bytes", 5).end_id == 5


def ids_of(rows, path, end):
    t = plain(path)
    return [(i, np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4")) for i, x in rows]


def test_orc_round_trip(spark, small):
    rows = sorted((r.doc_id, r.text) for r in table(spark, small, "documents").collect())
    want, start = [], 0
    for i, ids in ids_of(rows, WORDS, 1):
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, orc_tokens.op3_orc_tokens(spark, small).collect())) == want


def test_orc_odd_rows_and_look_up(spark):
    df = spark.createDataFrame([(5, "five", 1), (1, None, 2), (3, "", 3), (3, "same id", 4), (None, "null id", 5)], "doc_id long, text string, ids int")
    path = scratch(spark, "orc-test")
    orc_tokens.write_tokens(df, path, WORDS)
    got = sorted(map(tuple, orc_tokens.summary(spark, path).select("start", "n_tokens").collect()))
    assert [s for s, _ in got] == list(np.cumsum([0, *(n for _, n in got)])[:-1])
    found = orc_tokens.read_tokens(spark, path, [3])
    assert found.count() == 2
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().toString() or "EqualTo(doc_id,3)" in found._jdf.queryExecution().toString()
    empty = scratch(spark, "orc-empty")
    orc_tokens.write_tokens(df.limit(0), empty, WORDS)
    assert spark.read.schema("doc_id long, seq long, ids array<int>").orc(empty).count() == 0


def test_rows_of_one_id_fill_several_files(spark):
    """4,000 rows of one id among others, and null ids: no file has them all, and every start is the sum of what comes before."""
    rows = [(7, f"text number {i}") for i in range(4000)] + [(i, f"other {i}") for i in (3, 5, 9)] + [(None, "nobody's")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    path = scratch(spark, "orc-one-id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        orc_tokens.write_tokens(df, path, WORDS)
        got = sorted(map(tuple, orc_tokens.summary(spark, path).select("start", "n_tokens", "doc_id").collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    own = spark.read.orc(path).where("doc_id = 7").groupBy(F.col("_metadata.file_path").alias("f")).count().collect()
    assert len(own) > 2 and max(r["count"] for r in own) < 3000
    assert [s for s, *_ in got] == list(np.cumsum([0, *(n for _, n, _ in got)])[:-1])
    assert [i for *_, i in got] == [None] * 2 + [3, 5] + [7] * 4000 + [9]


def check_packing(got, docs):
    """Every document whole, every sequence gapless and at most a window."""
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, ids in docs:
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    return sum(1024 * len(sequences) for _ in [0]) / max(1, sum(r.length for r in got))


def test_packing(spark, small):
    rows = [(r.doc_id, r.text) for r in table(spark, small, "documents").collect()]
    assert check_packing(packing.op9_pack(spark, small).collect(), ids_of(rows, BYTES, 0)) < 1.05


def test_packing_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "word " * 5000, None)], "doc_id long, text string, rank string")
    check_packing(packing.pack(df, BYTES).collect(), ids_of([(1, None), (2, ""), (3, "word " * 5000)], BYTES, 0))
    assert packing.pack(df.limit(0), BYTES).count() == 0


def test_plans_use_every_piece():
    rng = random.Random(3)
    for _ in range(20):
        histogram = {rng.randint(1, 64): rng.randint(1, 50) for _ in range(rng.randint(0, 40))}
        used = {}
        for lengths, n in packing.plan(histogram, 64):
            assert sum(lengths) <= 64
            for k in lengths:
                used[k] = used.get(k, 0) + n
        assert used == histogram


def test_least_squares_finds_exact_fillings():
    """A histogram made of exact combinations is packed without a gap."""
    patterns = packing.plan({700: 300, 324: 300, 512: 40, 256: 80}, 1024)
    assert all(sum(lengths) == 1024 for lengths, _ in patterns)


def least_squares_by_hand(a, h):
    """Lawson and Hanson's active sets."""
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(500):
        w = a.T @ (h - a @ x)
        w[passive] = -1
        if w.max() < 1e-8:
            return x
        passive[w.argmax()] = True
        while True:
            s = np.zeros(len(x))
            s[passive] = np.linalg.lstsq(a[:, passive], h, rcond=None)[0]
            if (s[passive] > 1e-12).all():
                x = s
                break
            low = passive & (s <= 1e-12)
            x = x + min(x[low] / (x[low] - s[low] + 1e-300)) * (s - x)
            passive &= x > 1e-10
            x[~passive] = 0
    return x


def test_counts_are_the_least_squares_solution():
    rng = np.random.default_rng(8)
    for window in (12, 24, 40):
        h = np.where(rng.random(window + 1) < 0.6, rng.integers(0, 60, window + 1), 0)
        h[0] = h[window] = 0
        combos = packing.combinations(np.flatnonzero(h), window)
        if not len(combos):
            continue
        a = np.zeros((window + 1, len(combos)))
        for j, c in enumerate(combos):
            np.add.at(a[:, j], c[c > 0], 1)
        error = lambda x: np.linalg.norm(a @ x - h)
        x = packing.solve_counts(combos, h, tolerance=1e-9, steps=20_000)
        assert (x >= 0).all() and error(x) <= error(least_squares_by_hand(a, h.astype(float))) + 1e-3
        assert error(packing.solve_counts(combos, h)) <= error(x) + 0.5


def fields(data):
    """(number, value) of a protocol buffer's fields; value is a number or bytes."""

    def varint(at):
        n = shift = 0
        while True:
            n |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return n, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        elif tag & 7 == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            size = {1: 8, 5: 4}[tag & 7]
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def stripes(path):
    """Of each stripe of an uncompressed ORC file: rows, {(kind, column)} of its streams, encodings of the columns."""
    data = path.read_bytes()
    post = dict(fields(data[-1 - data[-1] : -1]))
    footer = data[-1 - data[-1] - post[1] : -1 - data[-1]]
    for number, value in fields(footer):
        if number == 3:
            s = dict(fields(value))
            end = s[1] + s.get(2, 0) + s[3]
            own = list(fields(data[end : end + s[4]]))
            streams = [dict(fields(v)) for n, v in own if n == 1]
            yield s[5], {(x.get(1, 0), x.get(2, 0)) for x in streams}, [dict(fields(v)).get(1, 0) for n, v in own if n == 2]


def test_orc_files_hold_indexes_and_filters_and_look_ups_skip(spark, monkeypatch):
    """Several stripes a file, in each a row index and a Bloom filter on the id; a look-up reads a part of the rows."""
    monkeypatch.setattr(orc_tokens, "STRIPE_BYTES", 200_000)
    rng = random.Random(1)
    docs = spark.createDataFrame([(7 * i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))) for i in range(12_000)], "doc_id long, text string")
    path = scratch(spark, "orc-indexed")
    spark.conf.set("spark.sql.orc.compression.codec", "none")
    try:
        orc_tokens.write_tokens(docs, path, WORDS)
    finally:
        spark.conf.unset("spark.sql.orc.compression.codec")
    files = [list(stripes(p)) for p in Path(path.removeprefix("file://")).glob("*.orc")]
    assert sum(rows for f in files for rows, *_ in f) == 12_000 and max(map(len, files)) >= 2
    row_index, bloom_filter, run_length_2 = 6, 8, 2
    for f in files:
        for _, streams, encodings in f:
            assert {(row_index, 1), (bloom_filter, 1)} <= streams
            assert encodings[1] == encodings[4] == run_length_2  # doc_id, and the elements of ids
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for wanted, most in ((7 * 5_000, 1_000), (7 * 5_000 + 3, 1_000)):
            found = orc_tokens.read_tokens(spark, path, [wanted])
            assert len(found.collect()) == (wanted % 7 == 0)
            scan = found._jdf.queryExecution().executedPlan().collectLeaves().head()
            assert scan.metrics().get("numOutputRows").get().value() <= most
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
