"""Document fingerprints of closed syncmers, and how alike neighbouring documents' fingerprints are.

A word is hashed, and each run of INNER words by its words' hashes. A window of WORDS words is an anchor if the
least hash of the runs within it is the first or the last of them (a closed syncmer). Whether it is one depends on
its own words alone, so an anchor stays one wherever its words are moved to, and of any WORDS - INNER + 1 windows in
a row one at least is an anchor: every shared passage of 2 * WORDS - INNER words shares an anchor. A fingerprint is
the list of all anchors' hashes (32 bits each) in text order; two are alike to twice the anchors in common over all
anchors (distinct ones; 1 if neither has any).

The main path is DataFrame functions only. Scale: ids and hashes alone are put in order (operators/order.py) and
cut into blocks of neighbours, whose first rows' ids are constants of the plan, MAX_BLOCKS of them at most; every
text finds its block by bisection and is shuffled once, to its block. A block's first text goes to the block
before it too. Fingerprints are made after the shuffle, once a text. Rows that are there more than MAX_COPIES
times are summed to one before they are shuffled.

Defined results: null texts are empty; a text without words has the empty fingerprint; one of fewer than WORDS
words has a single anchor, of all its words; a null id comes after all others; rows of one id go by their text's
hash; equal rows follow each other, so all but one of them have their like as next document; a single
document is its own next; an empty table gives an empty result; other columns are left out. Ids are whole
numbers, texts or dates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import let, plain, quoted, table, words
from millrace.operators.order import numbered

WORDS, INNER = 5, 2
#: Neighbouring documents that meet in one group; more only where that would make over MAX_BLOCKS groups.
BLOCK, MAX_BLOCKS = 64, 65_536
MAX_COPIES = 1_000


def anchors(text: Column) -> Column:
    """The anchors' hashes in text order, array<int>."""

    def chosen(runs: Column) -> Column:
        """runs: hashes of each two words in a row; four of them lie in a window."""
        closed = lambda i: F.least(runs[i], runs[i + 3]) <= F.least(runs[i + 1], runs[i + 2])
        window = lambda i: F.when(closed(i), F.hash(runs[i], runs[i + 2], runs[i + 3]))
        return F.array_compact(F.transform(F.sequence(F.lit(0), F.size(runs) - 4), window))

    def hashed(h: Column) -> Column:
        runs = F.zip_with(F.slice(h, 1, F.size(h) - 1), F.slice(h, 2, F.size(h) - 1), lambda a, b: F.hash(a, b))
        return F.when(F.size(h) >= WORDS, let(runs, chosen)).when(F.size(h) > 0, F.array(F.hash(h))).otherwise(F.array().cast("array<int>"))

    return let(F.transform(words(text), lambda w: F.hash(w)), hashed)


def printed(marks: Column) -> Column:
    """An anchor list as eight hexadecimal digits each."""
    return F.array_join(F.transform(marks, lambda m: F.right(F.concat(F.lit("0000000"), F.lower(F.hex(m.cast("long").bitwiseAND(0xFFFFFFFF)))), F.lit(8))), "")


def likeness(a: Column, b: Column) -> Column:
    """Twice the common over all distinct anchors of two lists; 1.0 if neither has any."""
    both = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def _not_after(bound: Column, k: Column, h: Column) -> Column:
    """Whether bound (k, h) isn't after a row in the order: k descending, nulls last, then h."""
    return F.when(bound["k"].eqNullSafe(k), bound["h"] <= h).when(k.isNull(), F.lit(True)).when(bound["k"].isNull(), F.lit(False)).otherwise(bound["k"] > k)


def _block(bounds: Column, n: int, k: Column, h: Column) -> Column:
    """The last of n bounds that isn't after a row, by bisection; bounds start with the first row of all."""

    def halve(span: Column, _: Column) -> Column:
        mid = F.shiftright(span["lo"] + span["hi"], 1)
        right = _not_after(bounds[mid], k, h)
        return F.struct(F.when(right, mid).otherwise(span["lo"]).alias("lo"), F.when(right, span["hi"]).otherwise(mid).alias("hi"))

    whole = F.struct(F.lit(0).alias("lo"), F.lit(max(1, n)).alias("hi"))
    steps = max(1, (n - 1).bit_length()) if n > 1 else 0
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), whole, halve, lambda span: span["lo"]) if steps else F.lit(0)


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK, max_blocks: int = MAX_BLOCKS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(key, text, marks, copies, next_text, next_marks): rows in descending order of key, each with the one after it.

    After the last comes the first. copies: the equal rows that a row stands for. marks: the anchors.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(quoted(key).alias("k"), F.coalesce(quoted(text).cast("string"), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    ids = rows.select("k", "h").groupBy("k", "h").agg(F.count("*").alias("copies"))
    ids = numbered(ids, [F.col("k").desc_nulls_last(), F.col("h")])
    block = max(block, -(-ids.count() // max_blocks))
    firsts = ids.where(F.col("number") % block == 0).agg(F.to_json(F.array_sort(F.collect_list(F.struct("number", "k", "h")))).alias("all"), F.count("*").alias("n")).first()
    bounds, n = F.from_json(F.lit(firsts["all"]), f"array<struct<number:bigint,k:{kind},h:bigint>>"), firsts["n"]
    hot = ids.where(F.col("copies") > max_copies).select(F.col("k").alias("hot_k"), F.col("h").alias("hot_h"))
    each = rows.withColumn("copies", F.lit(1).cast("long"))
    if not hot.isEmpty():
        same = rows.k.eqNullSafe(hot.hot_k) & (rows.h == hot.hot_h)
        summed = rows.join(hot, same, "left_semi").groupBy("k", "h").agg(F.min("t").alias("t"), F.count("*").alias("copies"))
        each = rows.join(hot, same, "left_anti").withColumn("copies", F.lit(1).cast("long")).unionByName(summed)
    placed = each.withColumn("block", _block(bounds, n, F.col("k"), F.col("h")))
    bound = bounds[F.col("block")]
    is_first = F.coalesce(bound["k"].eqNullSafe(F.col("k")) & (bound["h"] == F.col("h")), F.lit(False))
    own = F.struct(F.col("block"), F.lit(False).alias("guest"))
    guest = F.struct(F.pmod(F.col("block") - 1, F.lit(max(1, n))).cast("int").alias("block"), F.lit(True).alias("guest"))
    dealt = placed.select("k", "h", "t", "copies", F.inline(F.when(is_first, F.array(own, guest)).otherwise(F.array(own))))
    marked = dealt.repartition("block").withColumn("marks", anchors(F.col("t")))
    after = W.partitionBy("block").orderBy("guest", F.col("k").desc_nulls_last(), "h")
    found = marked.withColumns({"next_text": F.lead("t").over(after), "next_marks": F.lead("marks").over(after)}).where(~F.col("guest"))
    return found.select(F.col("k").alias(key), F.col("t").alias(text), "marks", "copies", "next_text", "next_marks")


def edited(text: Column, other: Column) -> Column:
    """text with its last half replaced by the first code points of other, as many or all there are."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.left(text, n - half), F.left(other, half))


def compared(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """A row for each of docs: its fingerprint, that of its edited text, and how alike the neighbours' are."""
    docs, back = plain(docs, key=key, text=text)
    key, text = "key", "text"
    met = with_next(docs, key, text, **how)
    # of equal rows one has the next document after it; each other one has its like
    cases = F.array(F.struct(F.lit(1).cast("long").alias("rows"), "next_text", "next_marks"), F.struct((F.col("copies") - 1).alias("rows"), F.col(text).alias("next_text"), F.col("marks").alias("next_marks")))
    each = met.select(key, text, "marks", F.inline(F.filter(cases, lambda c: c["rows"] > 0)))
    made = each.withColumn("edited", edited(F.col(text), F.col("next_text"))).withColumn("edited_marks", anchors(F.col("edited")))
    small = made.select(
        key,
        F.length(text).cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        printed(F.col("marks")).alias("fingerprint"),
        printed(F.col("edited_marks")).alias("edited_fingerprint"),
        likeness(F.col("marks"), F.col("edited_marks")).alias("near_edited"),
        likeness(F.col("marks"), F.col("next_marks")).alias("near_next"),
        "rows",
    )
    names = [c for c in small.columns if c != "rows"]
    return back(small.select(*names, F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).select(names), *names[1:])


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(table(spark, sf_dir, "documents"))
