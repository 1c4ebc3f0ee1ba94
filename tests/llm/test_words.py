"""Spelling variants and syncmer fingerprints against brute force, and odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import fingerprints, spelling
from millrace.llm.common import table
from millrace.llm.queries import QUERIES


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long_ = sorted((a, b), key=len)
    return len(long_) == len(short) + 1 and any(long_[:i] + long_[i + 1 :] == short for i in range(len(long_)))


def variants_by_hand(counts):
    near = {w: [v for v in counts if v != w and abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, counts[w], form[w], root, len(near[w]), form[w] and counts[form[w]]))
    return out


def found(spark, counts, **how):
    words = spark.createDataFrame(sorted(counts.items()), "word string, n long")
    rows = spelling.variants(words, **how).select("word", "n", "form", "root", "n_near", "form_n").collect()
    assert len(rows) == len(counts)
    return set(map(tuple, rows))


@pytest.mark.parametrize("max_file, max_region", [(10_000, 48), (6, 48), (2, 1), (10_000, 2)])
def test_variants_agree_with_all_pairs(spark, max_file, max_region):
    """Few letters, so runs of one letter and words that are near in two ways abound; files of any size are halved."""
    rng = random.Random(3)
    counts = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))): rng.randint(3, 60) for _ in range(260)}
    counts |= {"aaaaaaa": 9, "aaaaaaaa": 20, "aaaaaaaaa": 3, "é" * 8: 4, "é" * 9: 8}
    assert found(spark, counts, max_file=max_file, max_region=max_region) == variants_by_hand(counts)


def test_chains_ties_and_long_words(spark):
    chain = {f"{'a' * i}{'b' * (12 - i)}": 3 * 2**i for i in range(12)}
    ties = {"house": 4, "mouse": 8, "louse": 8, "hous": 8}
    long_ = {"x" * 3000: 5, "x" * 1500 + "y" + "x" * 1499: 10, "x" * 1500 + "y" + "x" * 1500: 40, "z" * 5000: 3}
    counts = chain | ties | long_
    rows = {r[0]: r for r in found(spark, counts)}
    assert set(rows.values()) == variants_by_hand(counts)
    assert rows["b" * 12][3] == "a" * 11 + "b" and rows["house"][2] == "hous"


def test_variants_of_nothing(spark):
    assert found(spark, {}) == set()


def words_by_hand(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def test_words_of_odd_texts(spark):
    """Kelvin and dotted-I signs, capitals with accents, × and ÷, digits within, nulls, repeated rows, clashing columns."""
    texts = [None, "", "ÀÉÎõü " * 3, "KELVIN Kelvin İstanbul Istanbul ISTANBUL ", "ab×cd÷ef AB×CD÷EF ", "word5word Word5worD ", "straße STRASSE Straße "] * 4
    rows = [(i if i != 5 else None, t) for i, t in enumerate(texts)] + [(3, texts[3])] * 2
    rows += [(i, " ".join(f"Haanth{chr(97 + (i * k) % 26)}" for k in range(60))) for i in range(100, 160)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, Word string, `a.n` long")
    each = spelling.runs(df)
    got = {r.word: r.n for r in spelling.vocabulary(each.select(spelling.noisy(F.col("doc_id"), F.col("run")).alias("word"))).collect()}
    assert got == words_by_hand(rows) and "straße" in got


def test_op11_rows(spark, small):
    counts = words_by_hand([(r.doc_id, r.text) for r in table(spark, small, "documents").collect()])
    rows = QUERIES["op11_spelling"](spark, small).select("word", "n", "form", "root", "n_near", "form_n").collect()
    assert set(map(tuple, rows)) == variants_by_hand(counts) and any(r.form for r in rows)


# fingerprints


def edited_by_hand(rows):
    """(id, n_chars, SHA-256 of the edited text) of each row in turn, by descending id, nulls last."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = []
    for i, (key, text) in enumerate(order):
        text, other = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        out.append((key, len(text), hashlib.sha256((text[: len(text) - half] + other[:half]).encode()).hexdigest()))
    return sorted(out, key=repr)


def compared(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", "y", 0) for r in rows], "doc_id long, text string, block string, Marks string, `a.b` int")
    return fingerprints.compared(df, **how).collect()


@pytest.mark.parametrize("how", [{"block": 1}, {"block": 3}, {}, {"block": 1, "max_blocks": 5}, {"max_copies": 0}])
def test_edited_texts(spark, how):
    rng = random.Random(4)
    rows = [(i * 7 if i != 11 else None, "".join(rng.choice("ab é\n😀") for _ in range(rng.randint(0, 90)))) for i in range(40)] + [(5, None), (6, "")]
    got = compared(spark, rows, **how)
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256) for r in got], key=repr) == edited_by_hand(rows)


def test_op13_texts(spark, small):
    rows = [(r.doc_id, r.text) for r in table(spark, small, "documents").collect()]
    got = QUERIES["op13_fingerprints"](spark, small).collect()
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256) for r in got], key=repr) == edited_by_hand(rows)
    prints, whole = {}, [r for r in got if r.n_chars > 200]
    for r in got:
        prints.setdefault(dict(rows)[r.doc_id], set()).add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(p) == 1 for p in prints.values())
    assert sum(0.3 < r.near_edited < 0.75 for r in whole) > 0.95 * len(whole)
    assert sum(r.near_edited > r.near_next for r in whole) > 0.9 * len(whole)


def test_likeness_is_that_of_the_anchors(spark, small):
    for r in QUERIES["op13_fingerprints"](spark, small).limit(50).collect():
        a, b = ({p[i : i + 8] for i in range(0, len(p), 8)} for p in (r.fingerprint, r.edited_fingerprint))
        assert r.near_edited == (2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0)


def test_anchors_are_closed_syncmers_wherever_they_stand(spark):
    rng = random.Random(5)
    passage = [f"w{rng.randrange(500)}" for _ in range(60)]
    texts = [passage, ["x", "y"] + passage, passage[:30] + ["z"] + passage[30:], passage[:8]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "i long, t string")
    hashed = df.select("i", F.transform(F.split("t", " "), lambda w: F.hash(w)).alias("h"), fingerprints.anchors(F.col("t")).alias("a")).orderBy("i").collect()
    pairs = spark.createDataFrame([(r.i, k, r.h[k], r.h[k + 1]) for r in hashed for k in range(len(r.h) - 1)], "i long, k int, a int, b int")
    runs = {(r.i, r.k): r.h for r in pairs.select("i", "k", F.hash("a", "b").alias("h")).collect()}
    for r in hashed:
        window = [[runs[r.i, k + j] for j in range(4)] for k in range(len(r.h) - 4)]
        assert len(r.a) == sum(min(w) in (w[0], w[-1]) for w in window)
    a, b, c, d = (r.a for r in hashed)
    assert b[-len(a) :] == a and len(set(a) & set(c)) >= 0.8 * len(a) and d and set(d) <= set(a)


def test_odd_texts_have_fingerprints(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "one two three four"), (6, "one two three four"), (7, "w" * 50_000), (8, "a b " * 20_000)]
    got = {r.doc_id: r for r in compared(spark, rows)}
    assert len(got) == 8 and got[1].fingerprint == got[2].fingerprint == got[3].fingerprint == ""
    assert got[5].fingerprint == got[6].fingerprint and len(got[5].fingerprint) == 8 and got[6].near_next == 1.0
    assert got[2].near_next == 1.0 and got[4].near_next == 0.0
    assert compared(spark, []) == []
    (alone,) = compared(spark, [(9, "one two three four five six seven eight nine ten")])
    assert alone.near_next == 1.0 and alone.n_chars == 48


@pytest.mark.parametrize("max_copies", [1000, 2])
def test_equal_rows_follow_each_other(spark, max_copies):
    rows = [(1, "a b c d e f g h")] * 3 + [(2, "q r s t u v w x y")] + [(1, "other words stand in this one here")]
    got = compared(spark, rows, max_copies=max_copies)
    assert len(got) == 5 and sorted(r.near_next for r in got if r.doc_id == 1).count(1.0) == 2
