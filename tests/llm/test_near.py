"""SimHash with Golay keys, components, suffix arrays and substring dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import golay, near_copies, simhash, substring_dedup, suffix
from millrace.llm.common import table, with_rows_of
from millrace.llm.components import components


def test_golay_words_two_bits_apart_share_a_key():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 3000)
    others = words ^ (1 << rng.integers(0, 23, 3000)) ^ (1 << rng.integers(0, 23, 3000))
    mine, theirs = (set(zip(*(x.tolist() for x in golay.keys(w)), strict=True)) for w in (words, others))
    assert {row for row, _ in mine & theirs} == set(range(3000))
    assert set(np.bincount(golay.keys(words)[0]).tolist()) == {1, 6}


def test_filing_misses_no_link():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 2000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 2000, dtype=np.uint64)
    b = a.copy()
    for _ in range(4):
        b ^= np.uint64(1) << rng.integers(0, 64, 2000, dtype=np.uint64)
    mine, theirs = (set(zip(*(x.tolist() for x in simhash.filing_keys(f)), strict=True)) for f in (a, b))
    assert {row for row, _ in mine & theirs} == set(range(2000))


def connected(fps, bits=4):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


@pytest.mark.parametrize("long_list", [2048, 10])
def test_forests_span_the_links(monkeypatch, long_list):
    monkeypatch.setattr(simhash, "LONG_LIST", long_list)
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(25)})
    edges = simhash.forest(np.array(fps, np.uint64))
    label = {f: f for f in fps}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for x, y in np.concatenate(edges).tolist():
        assert bin(x ^ y).count("1") <= 4
        label[find(x)] = find(y)
    want = connected(fps)
    assert len({find(f) for f in fps}) == len(set(want))


def by_hand(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_op8_against_brute_force(spark, small):
    rows = sorted((r.doc_id, r.text) for r in table(spark, small, "documents").collect())
    fps = [by_hand(t) for _, t in rows]
    want = {i: (format(f, "016x"), rows[c][0]) for (i, _), f, c in zip(rows, fps, connected(fps), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op8_simhash(spark, small).collect()} == want


def test_near_duplicates_of_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(400))
    df = spark.createDataFrame([(4, None, 1), (3, "", 2), (9, text, 3), (7, text, 4), (7, text, 5), (8, "A b\x0bC", 6), (None, "zz", 7)], "doc_id long, text string, fp int")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(4, 3), (3, 3), (9, 7), (7, 7), (7, 7), (8, 8), (None, None)], key=repr)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("max_broadcast", [1_000_000, 0])
def test_groups_are_dealt_with_and_without_a_broadcast(spark, max_broadcast):
    """Each two rows of a group meet, once or more, under one (x, y), and no (x, y) holds more than two blocks."""
    df = spark.createDataFrame([(k, i) for k, n in ((1, 1), (2, 12), (3, 30)) for i in range(n)], "g int, row long")
    dealt = {}
    for r in near_copies._dealt(df, "g", 8, max_broadcast).collect():
        dealt.setdefault((r.g, r.x, r.y), set()).add(r.row)
    for g, n in ((1, 1), (2, 12), (3, 30)):
        met = {(a, b) for (k, _, _), rows in dealt.items() if k == g for a in rows for b in rows}
        assert met == {(a, b) for a in range(n) for b in range(n)}


def shingles_by_hand(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else float(a == b)


def groups_by_hand(texts):
    sets = [shingles_by_hand(t) for t in texts]
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if label[i] != label[j] and jaccard(sets[i], sets[j]) >= 0.8:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def edited(rng, words, vocabulary):
    """words with a run cut out, put in or put in place, or single words changed."""
    out, how = list(words), rng.randrange(4)
    n = max(1, int(len(out) * rng.uniform(0, 0.12)))
    at = rng.randrange(len(out) - n + 1)
    if how == 0:
        del out[at : at + n]
    elif how == 1:
        out[at:at] = rng.choices(vocabulary, k=n)
    elif how == 2:
        out[at : at + n] = rng.choices(vocabulary, k=n)
    else:
        for _ in range(max(1, n // 4)):
            out[rng.randrange(len(out))] = rng.choice(vocabulary)
    return out


def test_near_copies_are_found(spark):
    """Against all pairs: nothing unlinked is joined, and at least 95 % of the linked pairs are."""
    rng = random.Random(11)
    vocabulary = [f"w{int(rng.paretovariate(0.7)) % 5000}" for _ in range(4000)]
    texts = []
    for _ in range(120):
        base = rng.choices(vocabulary, k=rng.randint(12, 300))
        texts += [" ".join(x) for x in [base, *(edited(rng, base, vocabulary) for _ in range(4))]]
    want = groups_by_hand(texts)
    sets = [shingles_by_hand(t) for t in texts]
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if want[i] == want[j] and jaccard(sets[i], sets[j]) >= 0.8]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row long, text string").selectExpr("row", "row AS id", "text").cache()
    for how in ({}, {"max_members": 2, "max_list": 3, "max_broadcast": 0}):
        group = {}
        for r in near_copies.groups(rows, "row", "id", "text", **how).collect():
            group[r.first.row] = r.component
        same = [group.get(i, i) for i in range(len(texts))]
        of_copy = {t: i for i, t in reversed(list(enumerate(texts)))}
        same = [same[of_copy[t]] for t in texts]
        assert all(want[i] == want[g] for i, g in enumerate(same))
        found = sum(same[i] == same[j] for i, j in linked) / len(linked)
        assert len(linked) > 300 and found >= 0.95, found


def test_words_within_eleven_bits_share_two_keys():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, 1 << 63, 500, dtype=np.uint64) for _ in range(2))
    x, y = a.copy(), b.copy()
    for i in range(500):
        for bit in rng.choice(115, 11, replace=False).tolist():
            if bit < 64:
                x[i] ^= np.uint64(1) << np.uint64(bit)
            else:
                y[i] ^= np.uint64(1) << np.uint64(bit - 64)
    shared = np.zeros(500, int)
    for i in range(5):
        mine, theirs = (set(zip(*(v.tolist() for v in golay.keys(near_copies.word_of(p, q, i))), strict=True)) for p, q in ((a, b), (x, y)))
        shared += np.bincount(sorted({row for row, _ in mine & theirs}), minlength=500)
    assert (shared >= 2).all()


def test_stars_keep_components_whole():
    rng = np.random.default_rng(5)
    for n in (0, 1, 30, 400):
        x, y = rng.integers(0, 300, n) * 7, rng.integers(0, 300, n) * 7
        a, b = near_copies.star_edges(x, y)
        label = {v: v for v in [*x.tolist(), *y.tolist()]}
        for p, q in zip(x.tolist(), y.tolist(), strict=True):
            lo, hi = sorted((label[p], label[q]))
            label = {k: lo if v == hi else v for k, v in label.items()}
        assert dict(zip(b.tolist(), a.tolist(), strict=True)) == {k: v for k, v in label.items() if k != v}


def test_links_of_sets():
    rng = np.random.default_rng(0)
    sets = []
    for _ in range(12):
        base = rng.choice(10_000, 60, replace=False)
        sets += [np.unique(np.where(rng.random(60) < p, rng.choice(10_000, 60), base)).astype(np.uint64) for p in (0, 0.02, 0.05, 0.1, 0.3)]
    sets.append(np.zeros(0, np.uint64))
    label = list(range(len(sets)))
    for x, y in near_copies.links(sets):
        assert jaccard(set(sets[x].tolist()), set(sets[y].tolist())) >= 0.8
        a, b = label[x], label[y]
        label = [min(a, b) if v in (a, b) else v for v in label]
    want = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if want[i] != want[j] and len(sets[i]) and jaccard(set(sets[i].tolist()), set(sets[j].tolist())) >= 0.8:
                a, b = want[i], want[j]
                want = [min(a, b) if v in (a, b) else v for v in want]
    assert label == want


def test_one_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(400))
    near = text.replace("w77 ", "other ")
    rows = [(4, None, 1), (3, "", 2), (9, text, 3), (7, near, 4), (7, text, 5), (8, "A b\x0bC", 6), (2, "a B c", 7), (None, "zz", 8), (None, text, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row_number int")
    kept = near_copies.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([(3, "", 2), (7, near, 4), (2, "a B c", 7), (None, "zz", 8)], key=repr)
    assert near_copies.keep_one(df.limit(0)).count() == 0


@pytest.mark.parametrize("max_words", [0, 1000])
def test_rows_by_bitmap(spark, max_words):
    rows = spark.range(1000).withColumnRenamed("id", "n").selectExpr("n", "'x' AS bitmap", "n AS bitmap_word")
    chosen = spark.range(0, 1000, 7).selectExpr("id AS r")
    for wanted in (True, False):
        got = with_rows_of(rows, "n", chosen, wanted, max_words)
        assert got.columns == rows.columns and sorted(r.n for r in got.collect()) == [n for n in range(1000) if (n % 7 == 0) == wanted]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(1, 60)] + [(5, 5), (2000, 1999)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(51)) and all(got[1000 + i] == 1000 for i in range(60)) and got[2000] == 1999
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60), st.sampled_from([0, 2, 1024]))
def test_suffix_array(symbols, few):
    old, suffix._FEW_SYMBOLS = suffix._FEW_SYMBOLS, few
    try:
        t = np.array([*symbols, 0])
        sa = suffix.suffix_array(t)
    finally:
        suffix._FEW_SYMBOLS = old
    order = sorted(range(len(t)), key=lambda i: t[i:].tolist())
    assert sa.tolist() == order
    plcp = suffix.common_prefixes(t, sa, 9)
    for a, b in zip(order, order[1:], strict=False):
        n = 0
        while max(a, b) + n < len(t) and t[a + n] == t[b + n]:
            n += 1
        assert plcp[b] == min(n, 9)


def test_names_of_real_text_are_sorted_recursively(monkeypatch, spark, small):
    """On text the first string of names has thousands of symbols; it and what follows go through induction too."""
    text = " ".join(r.text for r in table(spark, small, "documents").orderBy("doc_id").limit(120).collect()).encode()
    seen, whole = [], suffix.suffix_array
    monkeypatch.setattr(suffix, "suffix_array", lambda t: seen.append((len(t), int(t.max()) + 1)) or whole(t))
    sa = suffix.suffix_array(np.append(np.frombuffer(text, np.uint8).astype(np.int64) + 1, 0))
    assert len(seen) >= 3 and seen[1][1] > 2_000 and all(2 * b <= a for (a, _), (b, _) in zip(seen, seen[1:], strict=False))
    assert sorted(sa.tolist()) == list(range(len(text) + 1))
    assert all(text[a:] < text[b:] for a, b in zip(sa.tolist(), sa[1:].tolist(), strict=False))


def test_other_alphabets_and_long_runs():
    rng = np.random.default_rng(6)
    for t in (rng.integers(1, 5000, 3000), np.ones(4000, np.int64), np.arange(3000, 0, -1), np.tile([3, 2000, 1, 2000], 500), np.repeat(rng.integers(1, 9, 40), 50)):
        t = np.append(t, 0)
        assert suffix.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def dedup_by_hand(rows, window=100):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - window + 1):
            s = b[p : p + window]
            if s in seen:
                gone[p : p + window] = b"\1" * window
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


def test_op6_against_brute_force(spark, small):
    want = dedup_by_hand([(r.doc_id, r.text) for r in table(spark, small, "documents").collect()])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.op6_suffix_dedup(spark, small).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 0


@pytest.mark.parametrize("how", [{}, {"shard_bytes": 500}, {"hot": 0}, {"hot": 0, "sample": 1, "shard_bytes": 500}])
def test_dedup_of_planted_passages(spark, how):
    rng = random.Random(8)
    prose = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared, run = prose(260), "na " * 90
    texts = [prose(300) + shared + prose(40), shared[:99], prose(70) + shared[50:210] + prose(90), shared, run + prose(30) + run, "é" * 130, None, "", shared + prose(10) + shared]
    rows = list(enumerate(texts))
    got = substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), **how)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got.collect()} == dedup_by_hand(rows)


def test_anchors_of_a_common_passage_are_hot(spark):
    """Where a passage stands in many differing texts, its anchors go to no shard; copies of whole texts make none hot."""
    rng = random.Random(3)
    prose = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, copy = prose(150), prose(400)
    raw = spark.createDataFrame([(i, prose(80) + passage + prose(80) if i % 2 else copy) for i in range(200)], "doc long, text string").selectExpr("doc", "cast(text AS binary) AS bytes")
    found = substring_dedup.hot_anchors(raw, hot=40, sample=1)
    inside = set(substring_dedup.gram_hashes(np.frombuffer(passage.encode(), np.uint8)).tolist())
    assert len(found) and set(found.tolist()) <= inside


def test_dedup_of_odd_ids(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdef") for _ in range(200))
    df = spark.createDataFrame([(1, text, 0), (1, text, 0), (None, text, 0)], "doc_id long, text string, start int")
    got = sorted(((r.doc_id, r.n_removed) for r in substring_dedup.dedup(df).collect()), key=repr)
    assert got == [(1, 200), (1, 200), (None, 0)]
    assert substring_dedup.dedup(df.limit(0)).count() == 0


def test_slices_of_a_long_text(monkeypatch):
    data = np.random.default_rng(4).integers(97, 101, 5000).astype(np.uint8)
    whole = substring_dedup.text_contexts(data)
    monkeypatch.setattr(substring_dedup, "SLICE", 700)
    parts = substring_dedup.text_contexts(data)
    for r in (whole, parts):
        starts = np.concatenate([np.arange(lo, lo + hi + 1) for lo, hi in zip(r["lo"].tolist(), r["hi"].tolist(), strict=True)])
        assert sorted(starts.tolist()) == list(range(len(data) - 99))
