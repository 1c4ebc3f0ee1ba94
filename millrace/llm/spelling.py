"""Spelling variants by an even-partition pigeonhole join.

A word of n letters is cut into two even segments. Whatever single edit makes another word of it leaves
one of them as it is: at its place in a word of equal length, and there or one place later in a word that
is one longer. So words are filed under (length, segment), equal and one-longer words probe with the
segments at those places, and who meets is verified. The file of a segment says where the edit must lie
(the region [lo, hi), what the segment leaves), so the verification looks for words that are equal but
for one letter there.

Scale: the vocabulary comes from counts summed before they are shuffled, and a pair's counts leave its
task as one row a word and file. A file of more than MAX_FILE words, or of very long words, is halved by
the same principle: the edit lies in one half of the region, and the other half must be equal as well.
Halving ends at regions of one letter, whose files the alphabet bounds. A word is in no two files that could
both find a pair, so candidates need no list of pairs to be told apart: an inserted letter counts at the
last of the places that give the same word.

Defined results: null texts have no words; a null id is an empty text in the noise of `op11_spelling`;
repeated rows count again; words are compared as they are, letter case included; an empty vocabulary gives
an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import give_back, table, written

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
MIN_LENGTH, MIN_COUNT, FACTOR, NOISE = 5, 3, 2, 97
#: Words in one file that a task compares; larger files are halved.
MAX_FILE = 10_000
#: Letters of a region that are tried one by one; longer regions are halved where words share a file.
MAX_REGION = 48
_FILED = "key long, word string, n long, longer boolean, lo int, hi int"


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is; ASCII texts take the quick way."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, run): every maximal run of letters, A-Z in lower case."""
    found = F.regexp_extract_all(lowered(F.col(text)), F.lit(RUN.replace("A-Z", "")), F.lit(0))
    return docs.select(F.col(f"`{key}`").alias(key), F.explode(found).alias("run"))


def noisy(key: Column, run: Column, one_in: int = NOISE) -> Column:
    """The run without one of its letters, where the CRC-32 of `<key>:<run>` is divisible by one_in."""
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(words: DataFrame, word: str = "word", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): words of at least min_length letters that occur min_count times or more."""
    counted = words.select(F.col(word).alias("word")).where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= min_count)


def _key(length: Column) -> Column:
    """Where the edit must lie, and all that stands outside of it."""
    after = F.col("hi") + F.col("longer").cast("int")
    rest = F.substring(F.col("word"), after + 1, F.length("word"))
    return F.xxhash64(length, F.col("lo"), F.col("hi"), F.substring(F.col("word"), F.lit(1), F.col("lo")), rest)


def _filed(rows: DataFrame) -> DataFrame:
    """Rows (word, n, longer, lo, hi) with both halves of their region, and each one's key."""
    mid = (F.col("lo") + F.floor((F.col("hi") - F.col("lo")) / 2)).cast("int")
    span = lambda a, b: F.struct(a.alias("lo"), b.alias("hi"))
    halves = rows.select("word", "n", "longer", F.inline(F.array(span(F.col("lo"), mid), span(mid, F.col("hi")))))
    return halves.select(_key(F.length("word") - F.col("longer").cast("int")).alias("key"), "word", "n", "longer", "lo", "hi")


def files(words: DataFrame, max_file: int = MAX_FILE, max_region: int = MAX_REGION) -> DataFrame:
    """(key, word, n, longer, lo, hi): the words under their segments, and as one-longer probes."""
    whole = lambda longer: words.select("word", "n", F.lit(longer).alias("longer"), F.lit(0).alias("lo"), (F.length("word") - int(longer)).alias("hi"))
    rows = _filed(whole(False).unionByName(whole(True).where("hi > 0")))
    settled = None
    while True:
        rows = written(rows, "spelling-files")
        size, region = F.count("*"), F.max(F.col("hi") - F.col("lo"))
        hot = rows.groupBy("key").agg(size.alias("rows"), region.alias("region")).where("region > 1 and rows > 1").where((F.col("rows") > max_file) | (F.col("region") > max_region))
        hot = written(hot.select("key"), "spelling-hot")
        none = hot.isEmpty()
        calm = rows if none else rows.join(hot, "key", "left_anti")
        settled = calm if settled is None else settled.unionByName(calm)
        if none:
            return settled
        rows = _filed(rows.join(hot, "key", "left_semi"))


def _meet(rows: list[tuple]) -> list[tuple]:
    """One file's rows (word, n, longer, lo, hi) to (word, near words, largest n, its word)."""
    same = {w: n for w, n, longer, _, _ in rows if not longer}
    met: dict[str, list] = {}

    def link(a: str, n: int, b: str, m: int) -> None:
        for one, other, count in ((a, b, m), (b, a, n)):
            k = met.setdefault(one, [0, 0, ""])
            k[0] += 1
            if count > k[1] or (count == k[1] and other < k[2]):
                k[1:] = count, other

    holes = defaultdict(list)
    for w, n, longer, lo, hi in rows:
        if not longer:
            for i in range(lo, hi):
                holes[i, w[:i] + w[i + 1 :]].append((w, n))
            continue
        for i in range(lo, hi + (hi == len(w) - 1)):
            if i + 1 == len(w) or w[i + 1] != w[i]:
                short = w[:i] + w[i + 1 :]
                if short in same:
                    link(w, n, short, same[short])
    for members in holes.values():
        for i, (w, n) in enumerate(members):
            for v, m in members[:i]:
                link(w, n, v, m)
    return [(w, *k) for w, k in met.items()]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; a key's rows may go over several batches."""
    names = ["word", "n_near", "top_n", "top"]
    held: pa.Table | None = None

    def met(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key = t.column("key").to_numpy()
        again = key[1:] == key[:-1]
        t = t.filter(pa.array(np.concatenate([again, [False]]) | np.concatenate([[False], again])))
        if not len(t):
            return
        key = t.column("key").to_numpy()
        rows = list(zip(*(t.column(c).to_pylist() for c in ("word", "n", "longer", "lo", "hi")), strict=True))
        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
        found = [x for a, b in zip(cuts, cuts[1:]) for x in _meet(rows[a:b])]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found, strict=True)], names=names)

    for b in batches:
        if not len(b):
            continue
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        key = t.column("key").to_numpy()
        if key[0] == key[-1] and len(held) < 20 * MAX_FILE:
            continue
        last = int(np.searchsorted(held.column("key").to_numpy(), key[-1]))
        yield from met(held.slice(0, last))
        held = held.slice(last)
    if held is not None:
        yield from met(held)
    give_back(heap=False)


def near_words(words: DataFrame, max_file: int = MAX_FILE, max_region: int = MAX_REGION) -> DataFrame:
    """(word, n_near, top_n, top) of the words that have near words: their number, and the most frequent with its n."""
    sorted_ = files(words, max_file, max_region).repartition("key").sortWithinPartitions("key")
    met = sorted_.mapInArrow(_verified, "word string, n_near long, top_n long, top string")
    best = F.min(F.struct((-F.col("top_n")).alias("m"), F.col("top").alias("w")))
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.m")).alias("top_n"), F.col("best.w").alias("top"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form) without loops: the last form; rounds grow with the logarithm of the longest chain."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        far = now.select(F.col("word").alias("root"), F.col("root").alias("far"))
        step = written(now.join(far, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def variants(words: DataFrame, factor: int = FACTOR, max_file: int = MAX_FILE, max_region: int = MAX_REGION) -> DataFrame:
    """(word, n, form, root, n_near, form_n) for a vocabulary (word, n) of distinct words.

    form: the near word (one letter put in, left out or replaced) of largest n, ties by code points, if it has
    factor times the word's n or more; root: the end of the chain of forms, the word itself where there is none.
    """
    words = written(words, "vocabulary")
    near = near_words(words, max_file, max_region)
    ruled = F.col("top_n") >= factor * F.col("n")
    joined = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(ruled, F.col("top")).alias("form"), F.when(ruled, F.col("top_n")).alias("form_n")
    )
    found = written(joined, "forms")
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = runs(table(spark, sf_dir, "documents"))
    return variants(vocabulary(each.select(noisy(F.col("doc_id"), F.col("run")).alias("word"))))


_CRC = "(SELECT list(v ORDER BY i) FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))"
#: CRC-32 over the bytes' values, then counts, holes in equal words and in one-longer words, and chains of forms.
OP11_SQL = f"""WITH RECURSIVE tab AS MATERIALIZED (SELECT {_CRC} AS t),
occ AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
runs AS (SELECT doc_id, run, count(*) AS k FROM occ GROUP BY ALL),
bytes AS (SELECT doc_id, run, k, list_transform(range(1, length(hex(encode(doc_id || ':' || run))), 2), lambda i: ('0x' || substr(hex(encode(doc_id || ':' || run)), i, 2))::BIGINT) AS b FROM runs),
crc AS (SELECT doc_id, run, k, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, tab),
made AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, k FROM crc),
v AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM made WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
holes AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM v, unnest(range(length(word))) AS u(i)),
pairs AS (SELECT a.word, b.word AS other, b.n AS m FROM holes a JOIN holes b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT h.word, v.word, v.n FROM holes h JOIN v ON v.word = h.rest UNION SELECT v.word, h.word, h.n FROM holes h JOIN v ON v.word = h.rest),
near AS (SELECT word, count(*) AS n_near, max(m) AS top_n FROM pairs GROUP BY word),
top AS (SELECT p.word, min(p.other) AS top FROM pairs p JOIN near q ON p.word = q.word AND p.m = q.top_n GROUP BY p.word),
forms AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= 2 * v.n THEN top END AS form, CASE WHEN top_n >= 2 * v.n THEN top_n END AS form_n FROM v LEFT JOIN near USING (word) LEFT JOIN top USING (word)),
chain AS (SELECT word, form AS far, 1 AS d FROM forms WHERE form IS NOT NULL UNION ALL SELECT c.word, f.form, d + 1 FROM chain c JOIN forms f ON f.word = c.far WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(far, d) AS root FROM chain GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM forms LEFT JOIN ends USING (word)"""
