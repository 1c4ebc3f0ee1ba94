"""Known-text containment, n-gram overlap, copies and neighbours."""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators import automaton
from millrace.operators.graph import classes
from millrace.sources.tables import stored

#: Bytes of known texts' keys that are sent to every executor at the most.
MAX_BROADCAST = 32_000_000
#: Queries that meet all rows at a time.
QUERY_BLOCK = 50_000


def bytes_of(df: DataFrame) -> int:
    """The size of a table's values: texts by their bytes, arrays by eight bytes an item, others by eight; and 16 a row."""
    size = F.lit(16)
    for c in df.schema:
        kind, col = c.dataType.typeName(), F.col(f"`{c.name}`")
        own = F.octet_length(col) if kind in ("string", "binary") else 8 * F.size(col) if kind == "array" else F.lit(8)
        size = size + F.coalesce(own, F.lit(0))
    return df.agg(F.sum(size)).first()[0] or 0


def _known(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if its bytes, counted before, are few enough; else the join shuffles."""
    return F.broadcast(df) if bytes_of(df) <= MAX_BROADCAST else df


def having(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is in keys if these can be broadcast, else all: for use before a join, so that texts aren't shuffled."""
    own = keys.select(key)
    return df.join(F.broadcast(own), key, "left_semi") if bytes_of(own) <= MAX_BROADCAST else df


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    return F.filter(F.split(text, "[ \\t\\n\\r]+"), lambda w: w != "")


#: Length of the character grams that stand in for known texts without an inner word.
GRAM = 4


def contained(docs: DataFrame, known: DataFrame, max_bytes: int = automaton.MAX_BYTES) -> DataFrame:
    """(item_id, doc_id): known texts that stand in a document, letter for letter.

    Known texts of up to max_bytes bytes make one automaton, which finds all in one pass over the documents. More of
    them are joined: a known text's longest inner word is a word of every document that holds the text (its first and
    last could be parts of longer words there); a text without an inner word goes by its first characters. Documents offer
    the hashes of their words (and of their character grams, if need be), not themselves; only those that share a key are
    read again and searched. Texts shorter than a gram go through automata then, in as many passes as their size asks for.

    Null and empty texts are in no pair; items of equal text are found alike; repeated rows of an id count once.
    """
    texts = known.where("text <> ''").groupBy(F.col("text").alias("known")).agg(F.collect_set("item_id").alias("items"))
    keyed_texts = stored(texts.withColumn("known_key", F.monotonically_increasing_id()), "known-texts")
    small = automaton.size_of(keyed_texts) <= max_bytes
    by_automaton = keyed_texts if small else keyed_texts.where(F.length("known") < GRAM)
    pairs = automaton.found(docs, by_automaton, max_bytes=max_bytes) if small or not by_automaton.isEmpty() else None
    if not small:
        joined = _by_keys(docs, keyed_texts.where(F.length("known") >= GRAM))
        pairs = joined if pairs is None else pairs.unionByName(joined)
    items = keyed_texts.select("known_key", F.explode("items").alias("item_id"))
    return pairs.join(_known(items), "known_key").select("item_id", "doc_id").distinct()


def _by_keys(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """(known_key, doc_id) by keys that every document with the text offers, then by the texts themselves."""
    inner = _let(_words(F.col("known")), lambda w: F.slice(w, 2, F.greatest(F.size(w) - 2, F.lit(0))))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("l"), w.alias("w"))))["w"]
    key = F.when(longest.isNotNull(), F.xxhash64(longest)).otherwise(F.xxhash64(F.lit(GRAM), F.substring("known", 1, GRAM)))
    keyed = texts.select("known_key", "known", key.alias("key"), longest.isNull().alias("by_gram"))
    offered = F.transform(_words(F.col("text")), lambda w: F.xxhash64(w))
    if not keyed.where("by_gram").isEmpty():
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - GRAM + 1, F.lit(1))), lambda i: F.xxhash64(F.lit(GRAM), F.substring(F.col("text"), i, F.lit(GRAM))))
        offered = F.concat(offered, grams)
    offers = docs.select("doc_id", F.explode(F.array_distinct(offered)).alias("key"))
    pairs = stored(offers.join(_known(keyed.select("known_key", "key")), "key").select("doc_id", "known_key").distinct(), "pairs")
    found = docs.select("doc_id", "text").join(_known(pairs), "doc_id").join(_known(keyed.select("known_key", "known")), "known_key")
    return found.where(F.col("text").contains(F.col("known"))).select("known_key", "doc_id")


def _grams(df: DataFrame, key: str, n: int, gram, offered=None) -> DataFrame:
    """(key, gram): distinct word n-grams, lower case, each as gram makes it of its words; of them those that `offered` holds for."""
    every = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: gram(w, i))
    some = lambda w: F.filter(every(w), offered) if offered else every(w)
    made = _let(_words(F.lower("text")), lambda w: F.when(F.size(w) >= n, F.array_distinct(some(w))))
    return df.select(key, F.explode(made).alias("gram"))


#: Bits of a bitmap that is a constant of the plan; more keys than fit at one in BITS_A_KEY are offered without one.
MAX_BITS, BITS_A_KEY = 1 << 22, 32


def _in_bitmap(keys: DataFrame, max_bits: int):
    """A test of 64-bit hashes that all keys (gram) pass and few others, or None where there are too many keys."""
    n = keys.count()
    bits = max(64, 1 << (BITS_A_KEY * n - 1).bit_length()) if n else 64
    if bits > max_bits:
        return None
    place = F.pmod(F.col("gram"), F.lit(bits))
    rows = keys.groupBy(F.shiftright(place, 6).cast("int").alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod(gram, {bits}) & 63 AS INT)))").alias("bits")).collect()
    of = {r["word"]: r["bits"] for r in rows}
    bitmap = F.from_json(F.lit(json.dumps([of.get(i, 0) for i in range(bits // 64)])), "array<bigint>")
    # pmod by a power of two is what the low bits say
    low = lambda h: h.bitwiseAND(bits - 1)
    return lambda h: F.getbit(bitmap[F.shiftright(low(h), 6).cast("int")], low(h).bitwiseAND(63).cast("int")) == 1


def shared_ngrams(docs: DataFrame, known: DataFrame, n: int = 8, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, item_id, n_shared): distinct word n-grams, lower case, that both have.

    64-bit hashes of the grams find the documents that share any: a bitmap of the known ones leaves out nearly all
    others in the scan, and what passes is joined. Only these documents are read again, and their grams compared as
    they are. Null texts, and texts of fewer than n words, share nothing; rows that share an id count together.
    """
    hashed = lambda w, i: F.xxhash64(*(w[i + k] for k in range(n)))
    whole = lambda w, i: F.array_join(F.slice(w, i + 1, n), " ")
    keys = stored(_grams(known, "item_id", n, hashed).select("gram").distinct(), "gram-keys")
    hit = stored(_grams(docs, "doc_id", n, hashed, _in_bitmap(keys, max_bits)).join(_known(keys), "gram", "left_semi").select("doc_id").distinct(), "gram-hits")
    few = docs.join(_known(hit), "doc_id", "left_semi")
    texts = stored(_grams(known, "item_id", n, whole), "grams")
    return _grams(few, "doc_id", n, whole).join(_known(texts), "gram").groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"))


def copies(docs: DataFrame) -> DataFrame:
    """Texts, in lower case, that more than one document has."""
    return docs.groupBy(F.md5(F.lower("text")).alias("text_md5")).agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_id")).where("n_docs > 1")


#: MinHash bands and the minima in each: of pairs alike to 0.8, 99 in 100 share a band; to 0.3, one in 100.
BANDS, ROWS = 16, 6
#: Shingles that are hashed at a time.
SLICE = 8_192


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingle hashes to band keys: minima of the hashes under fixed random linear maps, hashed by band."""
    rng = np.random.default_rng(7)
    times = rng.integers(1, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) | np.uint64(1)
    plus = rng.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64)
    mix = rng.integers(1, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)
    for b in batches:
        keys = np.empty((len(b), BANDS), np.int64)
        for i, hashes in enumerate(b.column(1)):
            h = np.asarray(hashes.values.to_numpy()).view(np.uint64)
            least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
            for at in range(0, len(h), SLICE):
                least = np.minimum(least, ((h[at : at + SLICE] * times + plus) >> np.uint64(1)).min(1))
            least = least.reshape(BANDS, ROWS)
            keys[i] = ((least * mix).sum(1, dtype=np.uint64) ^ (np.arange(BANDS, dtype=np.uint64) << np.uint64(59))).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
        yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["rep", "bands"])


def near_copies(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """(doc_id, class_id): near-duplicate classes by MinHash bands over distinct word shingles.

    Exact copies are one representative each. In every band a representative is compared, by its
    whole shingle sets, with the least one that shares the band, so a group of any size gives one
    candidate a member and band; a class is what links of `similarity` or more connect.

    A text of fewer words than a shingle has is one shingle; null and empty texts are alike; rows with a null id are
    left out; rows that share an id are of the class of its texts' least.
    """
    ws = _words(F.lower(F.coalesce("text", F.lit(""))))
    made = _let(ws, lambda w: F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - shingle + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(w, i, shingle), " "))))))
    keyed = docs.select("doc_id", F.col("text"), F.md5(F.lower(F.coalesce("text", F.lit("")))).alias("text_md5"))
    of_text = stored(keyed.groupBy("text_md5").agg(F.min("doc_id").alias("rep")), "reps")
    reps = stored(docs.join(of_text.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), made.alias("shingles")).dropDuplicates(["rep"]), "shingles")
    kind = dict(reps.dtypes)["rep"]
    bands = stored(reps.mapInArrow(_band_rows, f"rep {kind}, bands array<long>").select("rep", F.explode("bands").alias("band")), "bands")
    least = bands.groupBy("band").agg(F.min("rep").alias("a"), F.count("*").alias("n")).where("n > 1").select("band", "a")
    pairs = bands.join(least, "band").where("a <> rep").select("a", F.col("rep").alias("b")).distinct()
    sets = lambda end: reps.select(F.col("rep").alias(end), F.col("shingles").alias(f"of_{end}"))
    both = pairs.join(sets("a"), "a").join(sets("b"), "b")
    common = F.size(F.array_intersect("of_a", "of_b"))
    links = stored(both.where(common >= similarity * (F.size("of_a") + F.size("of_b") - common)).select("a", "b"), "links")
    by_text = of_text.join(classes(links), "rep", "left").select("text_md5", F.coalesce("class_id", "rep").alias("class_id"))
    return keyed.select("doc_id", "text_md5").join(by_text, "text_md5").select("doc_id", "class_id")


#: Bytes of vectors in a packed chunk of rows or block of queries at the most, and rows in either.
CHUNK_BYTES, CHUNK = 2_000_000, 2_048
#: Places of a similarity that rank it; SQL rounds so before it orders.
PLACES = 4
#: Pairs whose exact products are taken at a time.
EXACT_SLICE = 65_536


def _in_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, added from the first component to the last as SQL does, so to the same last bit."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += x[:, j] * y[:, j]
    return out


def _rounded(values: np.ndarray) -> np.ndarray:
    """values in units of the last place, half up on the decimal digits as Spark's round; NaN is above all numbers."""
    scaled = np.abs(values) * 10.0**PLACES
    out = np.copysign(np.floor(scaled + 0.5), values)
    near = np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6)
    if len(near):
        each, back = np.unique(values[near], return_inverse=True)
        out[near] = np.array([float(Decimal(repr(float(v))).quantize(Decimal(1).scaleb(-PLACES), ROUND_HALF_UP).scaleb(PLACES)) for v in each])[back]
    return np.where(np.isnan(values), np.inf, out)


def _packed(dim: int):
    """Batches of (vec_id, embedding) to packed rows of ids, lengths (-1: a component is null) and unit vectors, zeros beyond their length."""
    step = max(1, min(CHUNK, CHUNK_BYTES // (8 * max(1, dim))))

    def pack(ids: pa.Array, lists: pa.Array) -> pa.RecordBatch:
        x, sizes = np.zeros((len(ids), dim)), np.diff(np.asarray(lists.offsets)).astype(np.int64)
        flat = lists.flatten()
        inside = np.arange(dim) < sizes[:, None]
        x[inside] = flat.to_numpy(zero_copy_only=False).astype(np.float64)
        if flat.null_count:
            row = np.repeat(np.arange(len(ids)), sizes)
            sizes[row[np.asarray(flat.is_null())]] = -1
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            # components beyond a vector's length stay zero, whatever its norm
            x = np.where(inside, x / np.sqrt(_in_order(x, x))[:, None], 0.0)
        x[sizes < 0] = 0.0
        return pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in (np.asarray(ids), sizes, x)], names=["ids", "sizes", "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            for i in range(0, len(b), step):
                held.append(b.slice(i, step))
                n += len(held[-1])
                if n >= step:
                    t = pa.Table.from_batches(held).combine_chunks()
                    yield pack(t.column(0).chunk(0)[:step], t.column(1).chunk(0)[:step])
                    held = t.slice(step).to_batches()
                    n -= step
        if n:
            t = pa.Table.from_batches(held).combine_chunks()
            yield pack(t.column(0).chunk(0), t.column(1).chunk(0))

    return run


class _Best:
    """The k best rows so far of each query of a block, by rounded similarity and the smaller id."""

    def __init__(self, row: dict, dim: int, k: int):
        self.ids, self.sizes = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["q_sizes"], np.int64)
        self.q, self.k = np.frombuffer(row["q_x"]).reshape(len(self.ids), dim), k
        #: query's place, rounded similarity, id, similarity
        self.found = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0)]
        self.least = np.full(len(self.ids), -np.inf)

    def meet(self, ids: np.ndarray, sizes: np.ndarray, x: np.ndarray) -> None:
        """A matrix product picks the rows that may be among the best; of these the products are taken in order."""
        with np.errstate(invalid="ignore"):
            near = self.q @ x.T
        near[np.isnan(near)] = np.inf
        near[self.ids[:, None] == ids] = -np.inf
        if (self.sizes != self.q.shape[1]).any() or (sizes != self.q.shape[1]).any():
            near[(self.sizes[:, None] != sizes) | (sizes < 0)] = -np.inf
        half = 0.5 / 10.0**PLACES + 1e-9
        at = np.flatnonzero(near >= (self.least - half)[:, None])
        if len(at) > 4 * self.k * len(self.ids) and len(ids) > self.k:
            kth = np.partition(near, -self.k, axis=1)[:, -self.k]
            at = np.flatnonzero(near >= np.maximum(self.least - half, kth - 2 * half)[:, None])
        for low in range(0, len(at), EXACT_SLICE):
            self._take(at[low : low + EXACT_SLICE], near.ravel(), ids, x)

    def _take(self, at: np.ndarray, near: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        own, row = np.divmod(at, len(ids))
        other = self.ids[own] != ids[row]
        at, own, row = at[other], own[other], row[other]
        null = np.isneginf(near[at])
        with np.errstate(invalid="ignore"):
            similarity = _in_order(x[row], self.q[own])
        rounded = np.where(null, -np.inf, _rounded(similarity))
        place, rounded, vec, similarity = (np.concatenate(c) for c in zip(self.found, [own, rounded, ids[row], similarity], strict=True))
        order = np.lexsort((vec, -rounded, place))
        place = place[order]
        rank = np.arange(len(place)) - np.searchsorted(place, place)
        order = order[rank < self.k]
        self.least[place[rank == self.k - 1]] = rounded[order][(rank[rank < self.k]) == self.k - 1] / 10.0**PLACES
        self.found = [place[rank < self.k], rounded[order], vec[order], similarity[order]]

    def rows(self) -> pa.RecordBatch:
        place, rounded, vec, similarity = self.found
        columns = [pa.array(self.ids[place]), pa.array(vec), pa.array(similarity, mask=np.isneginf(rounded))]
        return pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "similarity"])


def _searched(dim: int, k: int):
    """Chunks of rows, each with every block of queries, to the k best rows of the task for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, _Best] = {}
        for b in batches:
            for i in range(len(b)):
                get = lambda name: b.column(name)[i].as_py()  # noqa: B023, E731
                if get("q_block") not in best:
                    best[get("q_block")] = _Best({name: get(name) for name in ("q_ids", "q_sizes", "q_x")}, dim, k)
                ids = np.frombuffer(get("ids"), np.int64)
                best[get("q_block")].meet(ids, np.frombuffer(get("sizes"), np.int64), np.frombuffer(get("x")).reshape(len(ids), dim))
        for of_block in best.values():
            yield of_block.rows()

    return run


def neighbours(vectors: DataFrame, k: int = 5, step: int = 100, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, vec_id, rank, similarity): cosine top-k of every vector whose id is divisible by step.

    The stated query set meets all rows, in blocks of about `block` queries that are broadcast; each
    task keeps its own k best per query before they are brought together, so what is shuffled is k
    rows a query and task. Chunks of rows meet queries by matrix products; products that may matter are
    taken again in SQL's order of adding, so ties of the rounded similarity are SQL's too.

    A pair of vectors of different lengths, or with a null component, has a null similarity and comes last; one with a
    vector of length zero, or a component that isn't finite, has NaN and comes first, as in SQL.
    """
    rows = vectors.where("embedding is not null and vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    dim = max(1, rows.agg(F.max(F.size("embedding"))).first()[0] or 1)
    kind = "ids binary, sizes binary, x binary"
    # a scan has few tasks for tables of this kind: chunks are dealt to all before they meet queries
    chunks = stored(rows.mapInArrow(_packed(dim), kind).repartition(4 * rows.sparkSession.sparkContext.defaultParallelism), "vector-chunks")
    queries = rows.where(F.col("vec_id") % step == 0)
    n = queries.count()
    blocks = max(1, -(-n // block))
    share = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    local = None
    for i in range(blocks):
        few = queries.where(share == i).repartition(-(-n // blocks // CHUNK) or 1)
        own = stored(few.mapInArrow(_packed(dim), kind).toDF("q_ids", "q_sizes", "q_x").withColumn("q_block", F.monotonically_increasing_id()), "query-blocks")
        best = chunks.join(F.broadcast(own)).mapInArrow(_searched(dim, k), "query_id long, vec_id long, similarity double")
        local = best if local is None else local.unionByName(best)
    local = local.withColumn("similarity", F.round("similarity", PLACES))
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return local.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "vec_id", "rank", "similarity")
