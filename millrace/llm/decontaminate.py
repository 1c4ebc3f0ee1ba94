"""Benchmark decontamination: a hash set of test n-grams, sent to all tasks, against training windows.

Every window of `n` consecutive words of a benchmark item (or the whole of a shorter item) is
filed in a hash table under its anchor, its longest word. Each word of a document probes the
table; where an anchor matches, the window around it is verified word by word. Anchors are
compared in Unicode lower case, which finds all that A-Z lower case finds. DataFrame functions only.

Scale: the table is a constant of the plan, the benchmark's own words and three numbers a
window, so a document is judged, and cut, in the one pass that reads it: no join, no shuffle.
That holds for benchmarks of up to `max_table_bytes`. A larger one is joined: a bitmap of window
hashes (FILTER_BITS, two probes) picks the document windows that are offered, and these meet the
benchmark's in a hash join, broadcast up to `max_broadcast` windows (some 300 bytes each) and
shuffled beyond, where words are compared. There only the documents with hits, a few in a
hundred, are joined to their spans; the others pass through a row bitmap.

Defined results: a null text has no words and no hits, a null item no windows; windows of an
item without id hit, but name no item; repeated rows are judged one by one; an empty benchmark
contaminates nothing; an empty table gives an empty result; other columns pass through,
whatever their names, except those that `hits` adds.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import constant, fresh, let, plain, table, with_rows_of, written

N, MAX_TABLE_BYTES, MAX_BROADCAST, SHARE, FILTER_BITS = 13, 500_000, 100_000, 20, 1 << 24
#: Runs of what is in no word, before and after lower-casing (words hold digits, letters, all beyond ASCII).
BETWEEN = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
RESULT = ("n_words", "n_hit", "items", "spans")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _raw_words(text: str) -> Column:
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), BETWEEN), lambda w: w != "")


def _lower(w: Column) -> Column:
    return F.translate(w, UPPER, LOWER)


class Table:
    """The windows of a small benchmark as constant arrays, bucket by bucket of the anchors' hashes."""

    def __init__(self, bench: DataFrame, item: str, text: str, n: int):
        words = bench.select(F.col(item).alias("item"), _raw_words(text).alias("raw"))
        keyed = words.select(
            "item",
            F.transform("raw", _lower).alias("words"),
            F.transform("raw", lambda w: F.xxhash64(F.lower(w))).alias("hashes"),
            F.transform("raw", lambda w: F.length(w)).alias("sizes"),
        )
        self.kind = bench.schema[item].dataType.simpleString()
        all_words: list[str] = []
        of: dict[tuple[str, ...], int] = {}
        places, lengths, anchors, hashes, owners = [], [], [], [], defaultdict(set)
        for r in keyed.where(F.size("words") > 0).collect():
            size, base = len(r.words), len(all_words)
            all_words += r.words
            for start in range(max(1, size - n + 1)):
                window = tuple(r.words[start : start + n])
                if window not in of:
                    of[window] = len(places)
                    best = max(range(len(window)), key=lambda i: (r.sizes[start + i], r.words[start + i], -i))
                    places.append(base + start)
                    lengths.append(len(window))
                    anchors.append(best)
                    hashes.append(r.hashes[start + best])
                if r.item is not None:
                    owners[of[window]].add(r.item)
        self.buckets = 1 << max(1, (8 * len(set(hashes))).bit_length())
        bucket = np.array(hashes, np.int64) & (self.buckets - 1)
        order = np.argsort(bucket, kind="stable").tolist()
        of_item = {x: i for i, x in enumerate(sorted({x for s in owners.values() for x in s}))}
        items = [x if isinstance(x, (int, str)) else str(x) for x in of_item]
        first = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        self.constants = F.struct(
            constant(all_words, "string").alias("words"),
            constant((np.diff(first) > 0).tolist(), "boolean").alias("has"),
            constant(first.tolist(), "int").alias("first"),
            constant([{"p": places[j], "n": lengths[j], "k": anchors[j]} for j in order], "struct<p:int,n:int,k:int>").alias("windows"),
            constant([[of_item[x] for x in owners[j]] for j in order], "array<int>").alias("owners"),
            constant(items, self.kind if self.kind in ("string", "bigint", "int") else "string").alias("items"),
        )

    def _found(self, t: Column, ws: Column) -> Column:
        """(s, e, j) of every occurrence of window j in the words ws."""

        def holds(p: Column, j: Column) -> Column:
            w = t["windows"][j]
            inside = (p >= w["k"]) & (p - w["k"] + w["n"] <= F.size(ws)) & (_lower(ws[p]) == t["words"][w["p"] + w["k"]])
            return F.when(inside, F.transform(F.slice(ws, p - w["k"] + 1, w["n"]), _lower) == F.slice(t["words"], w["p"] + 1, w["n"])).otherwise(False)

        def probe(p: Column, b: Column) -> Column:
            there = F.filter(F.sequence(t["first"][b], t["first"][b + 1] - 1), lambda j: holds(p, j))
            return F.transform(there, lambda j: F.struct((p - t["windows"][j]["k"]).alias("s"), (p - t["windows"][j]["k"] + t["windows"][j]["n"]).alias("e"), j.alias("j")))

        def places(bs: Column) -> Column:
            hit = F.filter(F.sequence(F.lit(0), F.size(ws) - 1), lambda p: t["has"][bs[p]])
            return F.flatten(F.transform(hit, lambda p: probe(p, bs[p])))

        bucket = lambda w: F.xxhash64(F.lower(w)).bitwiseAND(self.buckets - 1).cast("int")
        return F.when(F.size(ws) > 0, let(F.transform(ws, bucket), places)).otherwise(F.array().cast("array<struct<s:int,e:int,j:int>>"))

    def judged(self, ws: Column) -> Column:
        """n_words, items, spans of the words ws. The constants are bound once, so the plan holds them once."""

        def verdict(t: Column, x: Column) -> Column:
            items = F.array_sort(F.transform(F.array_distinct(F.flatten(F.transform(x, lambda h: t["owners"][h["j"]]))), lambda i: t["items"][i]))
            spans = F.sort_array(F.array_distinct(F.transform(x, lambda h: F.struct(h["s"].alias("s"), h["e"].alias("e")))))
            return F.struct(F.size(ws).cast("long").alias("n_words"), items.alias("items"), spans.alias("spans"))

        return let(self.constants, lambda t: let(self._found(t, ws), lambda x: verdict(t, x)))


def windows(bench: DataFrame, item: str = "item_id", text: str = "text", n: int = N) -> DataFrame:
    """Distinct windows: win and its items."""
    ws = F.transform(_raw_words(text), _lower)
    size = F.size("_ws")
    starts = F.sequence(F.lit(0), F.greatest(size - n, F.lit(0)))
    wins = F.when(size > 0, F.transform(starts, lambda i: F.slice("_ws", i + 1, n))).otherwise(F.array())
    all_wins = bench.select(F.col(item).alias("item"), ws.alias("_ws")).select("item", F.explode(wins).alias("win"))
    return all_wins.groupBy("win").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _covered(spans: Column) -> Column:
    """Words inside any of the sorted spans."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(x["e"] - F.greatest(x["s"], a["end"]), F.lit(0))).alias("n"), F.greatest(x["e"], a["end"]).alias("end"))
    return F.aggregate(spans, zero, step, lambda a: a["n"]).cast("long")


def _is_small(bench: DataFrame, text: str, limit: int) -> bool:
    return (bench.agg(F.sum(F.octet_length(text))).first()[0] or 0) <= limit


def _in_one_pass(docs: DataFrame, bench: DataFrame, text: str, item: str, n: int) -> tuple[DataFrame, str]:
    """docs with one more column, whose name is returned: n_words, items and spans."""
    (name,) = fresh(docs, "judged")
    # exploding a one-element array keeps the optimizer from judging a text twice
    return docs.select("*", F.explode(F.array(let(_raw_words(text), Table(bench, item, "text", n).judged))).alias(name)), name


def _by_join(docs: DataFrame, bench: DataFrame, text: str, item: str, n: int, max_broadcast: int) -> DataFrame:
    """(doc: struct of docs' other columns, n_words, items, spans), by joins; rows keep apart by a number made at the scan."""
    wins = written(windows(bench, item, "text", n).withColumn("h", F.xxhash64(F.transform("win", F.lower))), "windows")
    lengths = sorted(r[0] for r in wins.select(F.size("win")).distinct().collect())
    places = F.transform(F.array("h", F.xxhash64("h")), lambda h: F.pmod(h, F.lit(FILTER_BITS)))
    marked = wins.select(F.explode(places).alias("p")).groupBy((F.col("p") / 64).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 AS INT)))").alias("bits"))
    bits = {r["word"]: r["bits"] for r in marked.collect()}
    bitmap = constant([bits.get(i, 0) for i in range(FILTER_BITS // 64)], "bigint")
    others = [c for c in docs.columns if c != text]
    raw = docs.select(F.struct(F.lit(0).alias("none"), *others).alias("doc"), F.monotonically_increasing_id().alias("row"), _raw_words(text).alias("raw"))

    def offered(ws: Column, low: Column, filter_: Column) -> Column:
        def known(h: Column) -> Column:
            place = F.pmod(h, F.lit(FILTER_BITS))
            return F.getbit(filter_[(place / 64).cast("int")], (place % 64).cast("int")) == 1

        def of_length(k: int) -> Column:
            at = F.filter(F.sequence(F.lit(0), F.size(ws) - k), lambda i: let(F.xxhash64(F.slice(low, i + 1, k)), lambda h: known(h) & known(F.xxhash64(h))))
            own = lambda i: F.struct(i.alias("s"), F.xxhash64(F.slice(low, i + 1, k)).alias("h"), F.transform(F.slice(ws, i + 1, k), _lower).alias("words"))
            return F.when(F.size(ws) >= k, F.transform(at, own))

        every = [F.coalesce(of_length(k), F.array().cast("array<struct<s:int,h:bigint,words:array<string>>>")) for k in lengths]
        return F.struct(F.size(ws).cast("long").alias("n"), (F.concat(*every) if every else F.array().cast("array<struct<s:int,h:bigint,words:array<string>>>")).alias("offered"))

    judged = let(F.struct(F.col("raw").alias("ws"), F.transform("raw", F.lower).alias("low"), bitmap.alias("f")), lambda x: offered(x["ws"], x["low"], x["f"]))
    seen = raw.select("doc", "row", F.explode(F.array(judged)).alias("x"))
    offers = seen.select("doc", "row", F.col("x.n").alias("n_words"), F.explode_outer("x.offered").alias("o"))
    small = F.broadcast(wins) if wins.count() <= max_broadcast else wins
    found = offers.join(small, (F.col("o.h") == F.col("h")) & (F.col("o.words") == F.col("win")), "left")
    span = F.when(F.col("win").isNotNull(), F.struct(F.col("o.s").alias("s"), (F.col("o.s") + F.size("win")).alias("e")))
    return found.groupBy("row").agg(
        F.first("doc").alias("doc"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.sort_array(F.collect_set(span)).alias("spans"),
    )


def hits(docs: DataFrame, bench: DataFrame, text: str = "text", item: str = "item_id", n: int = N, max_table_bytes: int = MAX_TABLE_BYTES, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """docs' other columns with RESULT: n_words, n_hit, items (array), spans (array of word intervals).

    Input columns of these names give way to the results. Rows keep their identity, so ids may repeat.
    """
    docs, back = plain(docs, text=text)
    others = [c for c in docs.columns if c != "text"]
    if _is_small(bench, "text", max_table_bytes):
        judged, name = _in_one_pass(docs, bench, "text", item, n)
        get = lambda c: F.col(name)[c]
        rows = [F.col(c) for c in others]
    else:
        judged = _by_join(docs, bench, "text", item, n, max_broadcast)
        get = F.col
        rows = [F.col("doc")[c].alias(c) for c in others]
    found = judged.select(*rows, get("n_words").alias("n_words"), _covered(get("spans")).alias("n_hit"), get("items").alias("items"), get("spans").alias("spans"))
    return back(found, *RESULT)


def is_contaminated(share: int = SHARE, n_hit: Column | str = "n_hit", n_words: Column | str = "n_words") -> Column:
    """At least one word in `share` is hit."""
    n_hit, n_words = (F.col(x) if isinstance(x, str) else x for x in (n_hit, n_words))
    return (n_hit > 0) & (share * n_hit >= n_words)


def _without(text: str, spans: Column) -> Column:
    """The text less the words in spans, each with what parts it from the next."""
    word = "[\\x30-\\x39\\x41-\\x5A\\x61-\\x7A\\x{80}-\\x{10FFFF}]"
    parts = F.regexp_extract_all(F.col(text), F.lit(f"{word}+[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*"), F.lit(0))
    lead = F.regexp_extract(F.col(text), f"^{BETWEEN}", 0)
    left = F.filter(parts, lambda w, i: ~F.exists(spans, lambda x: (x["s"] <= i) & (i < x["e"])))
    return F.concat(lead, F.array_join(left, ""))


def decontaminate(
    docs: DataFrame, bench: DataFrame, text: str = "text", item: str = "item_id", n: int = N, share: int = SHARE, max_table_bytes: int = MAX_TABLE_BYTES, max_broadcast: int = MAX_BROADCAST
) -> DataFrame:
    """docs without contaminated documents, and without the hit spans of the others."""
    docs, back = plain(docs, text=text)
    return back(_decontaminated(docs, bench, "text", item, n, share, max_table_bytes, max_broadcast))


def _decontaminated(docs: DataFrame, bench: DataFrame, text: str, item: str, n: int, share: int, max_table_bytes: int, max_broadcast: int) -> DataFrame:
    if _is_small(bench, "text", max_table_bytes):
        judged, name = _in_one_pass(docs, bench, text, item, n)
        n_hit = _covered(F.col(name)["spans"])
        kept = judged.where(~is_contaminated(share, n_hit, F.col(name)["n_words"]))
        cut = F.when(F.size(F.col(name)["spans"]) > 0, _without(text, F.col(name)["spans"])).otherwise(F.col(text))
        return kept.withColumn(text, cut).select(docs.columns)
    row, hit_row, spans, out = fresh(docs, "doc_row", "hit_row", "hit_spans", "contaminated")
    # row numbers are written down with the rows: another scan might split its input otherwise
    whole = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    judged = hits(whole.select(F.col(row).alias("row_"), F.col(text).alias("text")), bench, "text", item, n, max_table_bytes, max_broadcast).where("n_hit > 0")
    judged = written(judged.select(F.col("row_").alias(hit_row), F.col("spans").alias(spans), is_contaminated(share).alias(out)), "contaminated")
    clean = with_rows_of(whole, row, judged.select(hit_row), wanted=False)
    part = with_rows_of(whole, row, judged.where(~F.col(out)).select(hit_row)).join(judged, F.col(row) == F.col(hit_row))
    return clean.select(docs.columns).unionByName(part.withColumn(text, _without(text, F.col(spans))).select(docs.columns))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = hits(docs, table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated")
    )


OP4_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) > 13 THEN list_transform(generate_series(1, len(w) - 12), lambda i: w[i:i + 12]) WHEN len(w) > 0 THEN [w] ELSE [] END) AS g FROM b),
size AS (SELECT DISTINCT len(g) AS n FROM win),
place AS (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, size WHERE len(w) >= n),
hit AS (SELECT doc_id, i, n, item_id FROM (SELECT doc_id, i, n, w[i:i + n - 1] AS g FROM place) JOIN win USING (g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN item USING (doc_id)
"""
