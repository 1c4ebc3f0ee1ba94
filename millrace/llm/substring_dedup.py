"""Exact substring dedup by sharded suffix arrays.

A byte goes if a `window`-byte string over it also starts earlier (smaller document id, or the
same document and an earlier start). Suffix arrays are built in shards, so equal strings must
share a shard, and most text must not get there at all:

1. Sharding. Of each window's k-grams the one with the least hash (the leftmost of equals) is
   its anchor. Equal windows have equal anchors at equal offsets. Consecutive windows with the
   same anchor form a context. Per context a record of hashes goes to the shard of its
   anchor's hash, packed many to a row: of the anchor, of the whole context, and of the 32
   bytes on either side.
2. Equal contexts need no comparing: all but the earliest are covered by removed strings. Of
   the differing contexts of one anchor, only those can share a window that have the same 32
   bytes as another one on the left or on the right of the anchor.
3. Their bytes are concatenated, shard by shard, into one string whose suffix array is built by
   induced sorting; permuted common prefixes of `window` bytes or more mark classes of equal
   windows, in which all but the earliest are removed (see suffix.py).

Contexts and records are first reduced within each block of text, so a passage that is
everywhere sends each block's first copy at most. Anchors with over `hot` differing contexts send
the 128-bit hashes of their windows one by one, each to a shard of its own, so no anchor fills a
shard; equal hashes are equal windows. One text in `sample` tells which anchors will be so, and
their records go to no shard either; what the sample misses, its shard finds.

Hashes have 64 bits; a context is compared by 64 bits among those whose anchors agree in
another 64.

Defined results: a null text is empty; texts shorter than the window stay; a null id comes
before all others; rows that repeat an id are told apart and ordered by their texts (ids times
the most rows of one id must then stay under 2^62); an empty table gives an empty result; other columns are left out of the result. Work for a text is done in slices of a
fixed size, but its bytes are held as one value.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import give_back, table, with_rows_of, written
from millrace.llm.suffix import common_prefixes, suffix_array
from millrace.llm.tokens import blocks

WINDOW, GRAM, SLICE, SHARD_BYTES, HOT, SAMPLE, MAX_HOT = 100, 32, 2 << 20, 4 << 20, 16_384, 64, 10_000
#: Records that a task holds before it reduces and packs them.
HELD_RECORDS = 400_000
_NO_ID = -(1 << 42)
_RECORD = np.dtype([("anchor", "<u8"), ("whole", "<u8"), ("left", "<u4"), ("right", "<u4"), ("doc", "<i8"), ("lo", "<i8"), ("hi", "<u1"), ("at", "<u1")])
_TABLE = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0xD1B54A32D192ED03)


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of all GRAM-byte strings, by doubling."""
    h = _stir(_TABLE[data])
    n = 1
    while n < GRAM:
        h = _stir(h[:-n] * np.uint64(0x9E3779B97F4A7C15 + 2 * n) + h[n:]) if len(h) > n else h[:0]
        n *= 2
    return h


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    rest = width - n
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def contexts(data: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """_RECORDs, without doc, of one text's slice: windows lo to lo + hi share the anchor at lo + at."""
    if len(data) < window:
        return np.zeros(0, _RECORD)
    h = gram_hashes(data)
    packed = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    anchor = (_sliding_min(packed, window - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    lo = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    hi = np.append(lo[1:], len(anchor)) - 1
    m = anchor[lo]
    out = np.zeros(len(lo), _RECORD)
    out["anchor"], out["lo"], out["hi"], out["at"] = h[m], lo, hi - lo, m - lo
    end = hi + window
    whole = (hi - lo).astype(np.uint64) * np.uint64(256) + (m - lo).astype(np.uint64)
    for p in (lo, lo + GRAM, lo + 2 * GRAM, end - 3 * GRAM, end - 2 * GRAM, end - GRAM):
        whole = _stir(whole * np.uint64(0xD6E8FEB86659FD93) + h[p])
    out["whole"] = whole
    short = np.uint64(32)
    out["left"] = np.where(m >= GRAM, (h[np.maximum(m - GRAM, 0)] >> short).astype(np.uint32) | np.uint32(1), 0)
    far = np.minimum(m + GRAM, len(h) - 1)
    out["right"] = np.where(m + GRAM < len(h), (h[far] >> short).astype(np.uint32) | np.uint32(1), 0)
    return out


def text_contexts(data: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """contexts of a whole text, slice by slice; every window is in exactly one slice."""
    if len(data) <= SLICE:
        return contexts(data, window)
    parts = []
    for start in range(0, len(data) - window + 1, SLICE):
        part = contexts(data[start : start + SLICE + window - 1], window)
        part["lo"] += start
        parts.append(part)
    return np.concatenate(parts)


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of overlapping or touching intervals, by document and start."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    # one running maximum over all: each document's intervals are shifted past the last one's
    group = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]]))
    span = int(end.max()) + 2
    reach = np.maximum.accumulate(end + group * span)
    new = np.concatenate([[True], start[1:] + group[1:] * span > reach[:-1]])
    first = np.flatnonzero(new)
    return doc[first], start[first], reach[np.append(first[1:], len(doc)) - 1] - group[first] * span


def _spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Rows of a part of the result: the shard is null, the spans are merged."""
    doc, start, end = merged(doc, start, end)
    n = len(doc)
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(doc), pa.array(start), pa.array(end)], names=_NAMES)


def _packed(shard: np.ndarray, blobs: list[bytes]) -> pa.RecordBatch:
    n = len(blobs)
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(blobs, pa.binary()), *(pa.nulls(n, pa.int64()) for _ in range(3))], names=_NAMES)


_NAMES = ["shard", "blob", "doc", "start", "end"]
_SCHEMA = "shard int, blob binary, doc long, start long, end long"


def _shards(records: np.ndarray, by: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    shard = (_stir(by) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(shard[part[0]]), records[part]


def _reduced(r: np.ndarray, window: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The earliest of equal contexts, and the intervals that the others remove."""
    order = np.lexsort((r["lo"], r["doc"], r["whole"], r["anchor"]))
    r = r[order]
    again = np.concatenate([[False], (r["anchor"][1:] == r["anchor"][:-1]) & (r["whole"][1:] == r["whole"][:-1])])[: len(r)]
    gone = r[again]
    return r[~again], (gone["doc"], gone["lo"], gone["lo"] + gone["hi"].astype(np.int64) + window)


def _anchor_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(anchor, whole) of contexts whose anchor has several in the batch."""
        for batch in batches:
            parts = [text_contexts(np.frombuffer(t.as_buffer(), np.uint8), window) for t in batch.column(1) if t.is_valid]
            r = np.concatenate(parts)[["anchor", "whole"]] if parts else np.zeros(0, _RECORD)[["anchor", "whole"]]
            r = np.unique(r)
            anchor, which, count = np.unique(r["anchor"], return_inverse=True, return_counts=True)
            r = r[count[which] > 1]
            yield pa.RecordBatch.from_arrays([pa.array(r[c].view(np.int64).copy() if len(r) else np.zeros(0, np.int64)) for c in ("anchor", "whole")], names=["anchor", "whole"])

    return run


def hot_anchors(raw: DataFrame, window: int = WINDOW, hot: int = HOT, sample: int = SAMPLE) -> np.ndarray:
    """Sorted anchors, MAX_HOT at most, that by one text in `sample` have over `hot` differing contexts."""
    seen = raw.where(F.pmod(F.xxhash64("doc"), F.lit(sample)) == 0).mapInArrow(_anchor_rows(window), "anchor long, whole long")
    counts = seen.distinct().groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") * sample > hot)
    found = [r["anchor"] for r in counts.orderBy(F.desc("n"), "anchor").limit(MAX_HOT).collect()]
    return np.sort(np.array(found, np.int64).view(np.uint64))


def _record_rows(shards: int, window: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = text_contexts(np.frombuffer(text.as_buffer() if text.is_valid else b"", np.uint8), window)
                part["doc"] = doc
                parts.append(part)
                held += len(part)
                if held >= HELD_RECORDS:
                    yield from _record_batches(parts, shards, window, hot)
                    parts, held = [], 0
        if held:
            yield from _record_batches(parts, shards, window, hot)

    return run


def _record_batches(parts: list[np.ndarray], shards: int, window: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The spans that equal contexts remove right here, contexts of hot anchors, and the other records, packed by shard."""
    first, gone = _reduced(np.concatenate(parts), window)
    yield _spans(*gone)
    is_hot = np.isin(first["anchor"], hot)
    if is_hot.any():
        yield _wanted(first[is_hot], np.ones(int(is_hot.sum()), np.int32), by_span=True)
        first = first[~is_hot]
    numbers, blobs = [], []
    for number, part in _shards(first, first["anchor"], shards):
        numbers.append(number)
        blobs.append(_pressed(part))
    yield _packed(np.array(numbers, np.int32), blobs)
    give_back()


def _wanted(r: np.ndarray, shard: np.ndarray, by_span: bool = False) -> pa.RecordBatch:
    """Contexts to compare by bytes; shard is 0 for whole contexts or 1 for window by window (null on the way there, by_span)."""
    blob = pa.array([x.to_bytes(8, "little") for x in r["anchor"].tolist()], pa.binary())
    shard = pa.nulls(len(r), pa.int32()) if by_span else pa.array(shard)
    return pa.RecordBatch.from_arrays([shard, blob, pa.array(r["doc"].copy()), pa.array(r["lo"].copy()), pa.array(r["lo"] + r["hi"])], names=_NAMES)


def _pressed(r: np.ndarray) -> bytes:
    """Column by column: ids and offsets press well, hashes not at all."""
    import zstandard

    r = np.sort(r, order=("doc", "lo"))
    hashes = b"".join(r[c].tobytes() for c in ("anchor", "whole", "left", "right"))
    rest = np.diff(r["doc"], prepend=0).tobytes() + r["lo"].tobytes() + r["hi"].tobytes() + r["at"].tobytes()
    rest = zstandard.ZstdCompressor(level=1).compress(rest)
    return len(r).to_bytes(8, "little") + hashes + rest


def _unpressed(blob: bytes) -> np.ndarray:
    import zstandard

    n = int.from_bytes(blob[:8], "little")
    data = blob[8 : 8 + 24 * n] + zstandard.ZstdDecompressor().decompress(blob[8 + 24 * n :])
    r, at = np.zeros(n, _RECORD), 0
    for c in ("anchor", "whole", "left", "right", "doc", "lo", "hi", "at"):
        size = _RECORD[c].itemsize * n
        r[c] = np.frombuffer(data[at : at + size], _RECORD[c])
        at += size
    r["doc"] = np.cumsum(r["doc"])
    return r


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """(shard, blobs) from rows sorted by shard."""
    now, held = None, []
    for b in batches:
        for number, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if number != now:
                if held:
                    yield now, held
                now, held = number, []
            held.append(blob)
    if held:
        yield now, held


def _compare_rows(window: int, hot: int):
    """Records of a shard: spans that equal contexts remove, and contexts (start, end packed) to compare by bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in _grouped(batches):
            first, gone = _reduced(np.concatenate([_unpressed(x) for x in blobs]), window)
            yield _spans(*gone)
            change = np.concatenate([[True], first["anchor"][1:] != first["anchor"][:-1]])
            group = np.cumsum(change) - 1
            wanted = np.zeros(len(first), bool)
            for side in ("left", "right"):
                key = (group.astype(np.uint64) << np.uint64(32)) | first[side]
                _, which, count = np.unique(key, return_inverse=True, return_counts=True)
                wanted |= (count[which] > 1) & (first[side] != 0)
            is_hot = np.bincount(group[wanted], minlength=int(group[-1]) + 1 if len(group) else 0)[group] > hot
            yield _wanted(first[wanted], is_hot[wanted].astype(np.int32))

    return run


_CONTEXT = np.dtype([("doc", "<i8"), ("lo", "<i8"), ("size", "<u4")])
_DIGEST = np.dtype([("h0", "<u8"), ("h1", "<u8"), ("doc", "<i8"), ("lo", "<i8")])


def _first_digests(d: np.ndarray, window: int) -> tuple[np.ndarray, pa.RecordBatch]:
    """The earliest of windows with equal hashes, and the spans that the others remove."""
    d = d[np.lexsort((d["lo"], d["doc"], d["h1"], d["h0"]))]
    again = np.append(False, (d["h0"][1:] == d["h0"][:-1]) & (d["h1"][1:] == d["h1"][:-1]))[: len(d)]
    gone = d[again]
    return d[~again], _spans(gone["doc"].copy(), gone["lo"].copy(), gone["lo"] + window)


def _first_bytes(doc: np.ndarray, lo: np.ndarray, strings: list[bytes], window: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Indices of the earliest of equal strings, and the intervals that the others remove."""
    order = np.lexsort((lo, doc)).tolist()
    seen: set[bytes] = set()
    first, again = [], []
    for i in order:
        (again if strings[i] in seen else first).append(i)
        seen.add(strings[i])
    again = np.array(again, np.int64)
    size = np.fromiter((len(strings[i]) for i in again.tolist()), np.int64, len(again))
    return np.array(first, np.int64), (doc[again], lo[again], lo[again] + size)


def _bytes_rows(shards: int, window: int):
    """Texts with their wanted contexts: these contexts' bytes, packed by shard; of hot ones the windows' hashes, by shards from `shards` on."""

    def digests(doc: int, text: memoryview, lo: int, hi: int) -> bytes:
        hashes = b"".join(hashlib.blake2b(text[i : i + window], digest_size=16).digest() for i in range(lo, hi + 1))
        d = np.zeros(hi + 1 - lo, _DIGEST)
        d["h0"], d["h1"] = np.frombuffer(hashes, "<u8").reshape(-1, 2).T
        d["doc"], d["lo"] = doc, np.arange(lo, hi + 1)
        return d.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch):
                docs, los, strings, anchors, hot = [], [], [], [], []
                for doc, text, wanted in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                    text = memoryview(text.as_buffer())
                    for c in wanted:
                        if c["shard"]:
                            hot.append(digests(doc, text, c["start"], c["end"]))
                        else:
                            docs.append(doc)
                            los.append(c["start"])
                            strings.append(bytes(text[c["start"] : c["end"] + window]))
                            anchors.append(int.from_bytes(c["blob"], "little"))
                doc, lo = np.array(docs, np.int64), np.array(los, np.int64)
                first, gone = _first_bytes(doc, lo, strings, window)
                yield _spans(*gone)
                left, spans = _first_digests(np.frombuffer(b"".join(hot), _DIGEST), window)
                yield spans
                numbers, blobs = [], []
                for number, part in _shards(first, np.array(anchors, np.uint64)[first], shards):
                    c = np.zeros(len(part), _CONTEXT)
                    c["doc"], c["lo"], c["size"] = doc[part], lo[part], [len(strings[i]) for i in part.tolist()]
                    numbers.append(number)
                    blobs.append(len(c).to_bytes(8, "little") + c.tobytes() + b"".join(strings[i] for i in part.tolist()))
                for number, part in _shards(left, left["h0"], shards):
                    numbers.append(shards + number)
                    blobs.append(part.tobytes())
                yield _packed(np.array(numbers, np.int32), blobs)

    return run


def repeated_windows(c: np.ndarray, data: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(doc, start) of windows inside the contexts c, whose bytes data holds end to end, with an earlier equal one."""
    size = c["size"].astype(np.int64)
    begin = np.cumsum(size + 1) - size - 1
    string = np.ones(int(size.sum()) + len(c) + 1, np.int16)
    string[-1] = 0
    inner = np.ones(len(string), bool)
    inner[begin + size] = False
    inner[-1] = False
    string[inner] = data.astype(np.int16) + 2
    sa = suffix_array(string)
    # separators never match: windows hold none, and other places are masked out
    prefix = common_prefixes(np.where(string > 1, string - 2, 0), sa, window)
    of = np.repeat(np.arange(len(c)), size + 1)
    at = np.arange(len(string) - 1) - begin[of]
    valid = np.append(at + window <= size[of], False)
    place = sa[valid[sa]]
    # between two equal windows in suffix order stand only windows equal to both
    same = prefix[place] >= window
    follows = np.concatenate([[-1], place[:-1]])
    before = np.full(len(string), -1, np.int64)
    before[sa[1:]] = sa[:-1]
    same &= before[place] == follows
    if len(same):
        same[0] = False
    group = np.cumsum(~same)
    doc, start = c["doc"][of[place]], c["lo"][of[place]] + at[place]
    order = np.lexsort((start, doc, group))
    again = np.concatenate([[False], group[order][1:] == group[order][:-1]])[: len(order)]
    return doc[order][again], start[order][again]


def _suffix_rows(shards: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, blobs in _grouped(batches):
            if number >= shards:
                yield _first_digests(np.frombuffer(b"".join(blobs), _DIGEST), window)[1]
                continue
            cs, datas = [], []
            for x in blobs:
                n = int.from_bytes(x[:8], "little")
                end = 8 + n * _CONTEXT.itemsize
                cs.append(np.frombuffer(x[8:end], _CONTEXT))
                datas.append(np.frombuffer(x[end:], np.uint8))
            doc, start = repeated_windows(np.concatenate(cs), np.concatenate(datas), window)
            yield _spans(doc, start, start + window)
            give_back()

    return run


def repeated_spans(docs: DataFrame, text: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES, hot: int = HOT, sample: int = SAMPLE) -> DataFrame:
    """(doc, start, end) byte spans to remove; docs has a long `doc` that orders its rows. Spans may overlap."""
    raw = docs.select("doc", F.col(text).cast("binary").alias("bytes"))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    sharded = lambda df: df.where("shard is not null").select("shard", "blob").repartition("shard").sortWithinPartitions("shard")
    long = raw.where(F.octet_length("bytes") >= window)
    records = long.mapInArrow(_record_rows(shards, window, hot_anchors(long, window, hot, sample)), _SCHEMA)
    # spans and records leave the scan together; the spans keep their rows under shard -1
    marked = records.select(F.coalesce("shard", F.lit(-1)).alias("shard"), F.when(F.col("shard").isNull(), F.struct("doc", "start", "end")).alias("span"), "blob")
    compared = written(marked.repartition("shard", F.when(F.col("shard") == -1, F.pmod(F.col("span.doc"), F.lit(1009)))).sortWithinPartitions("shard").mapInArrow(_pass_spans(_compare_rows(window, hot)), _SCHEMA), "compared")
    to_compare = compared.where("shard is not null")
    wanted = to_compare.groupBy("doc").agg(F.collect_list(F.struct("shard", "blob", "start", "end")).alias("wanted"))
    # a bitmap picks the texts that have any, so the others are not shuffled
    taken = with_rows_of(raw, "doc", to_compare.select("doc")).join(wanted, "doc").select("doc", "bytes", "wanted").mapInArrow(_bytes_rows(shards, window), _SCHEMA)
    taken = written(taken, "contexts")
    found = sharded(taken).mapInArrow(_suffix_rows(shards, window), _SCHEMA)
    spans = [compared.where("shard is null"), taken.where("shard is null"), found]
    return spans[0].select("doc", "start", "end").unionByName(spans[1].select("doc", "start", "end")).unionByName(spans[2].select("doc", "start", "end"))


def _pass_spans(compare):
    """Rows (shard, span, blob) sorted by shard: spans and hot contexts, under shard -1, go through; the rest is compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []

        def records() -> Iterator[pa.RecordBatch]:
            yield from rest
            for b in batches:
                yield b.select(["shard", "blob"])

        for b in batches:
            own = pc.equal(b.column(0), -1)
            spans = b.filter(own)
            if len(spans):
                s, anchor = spans.column(1), spans.column(2)
                shard = pc.if_else(pc.is_valid(anchor), pa.scalar(1, pa.int32()), pa.scalar(None, pa.int32()))
                yield pa.RecordBatch.from_arrays([shard, anchor, *(s.field(i) for i in range(3))], names=_NAMES)
            left = b.filter(pc.invert(own)).select(["shard", "blob"])
            if len(left):
                rest.append(left)
                break
        yield from compare(records())

    return run


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, **how) -> DataFrame:
    """(key, bytes, kept, n_bytes, n_removed, n_spans): kept is the text's bytes without the repeated strings."""
    numbered = docs.select(key, F.coalesce(F.col(key).cast("long"), F.lit(_NO_ID)).alias("doc"), text)
    most = numbered.groupBy("doc").count().agg(F.max("count")).first()[0] or 1
    if most > 1:
        nth = F.row_number().over(W.partitionBy("doc").orderBy(text)) - 1
        numbered = numbered.withColumn("doc", F.col("doc") * most + nth)
    spans = repeated_spans(numbered.select("doc", text), text, window, **how)
    by_doc = written(spans.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans")), "spans")
    whole = numbered.select(F.col(key).alias("key"), "doc", F.coalesce(F.col(text), F.lit("")).cast("binary").alias("bytes"))
    # only texts that lose something meet their spans
    untouched = with_rows_of(whole, "doc", by_doc.select("doc"), wanted=False).select("key", "bytes", F.lit(None).cast(dict(by_doc.dtypes)["spans"]).alias("spans"))
    joined = with_rows_of(whole, "doc", by_doc.select("doc")).join(by_doc, "doc").select("key", "bytes", "spans").unionByName(untouched)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, removed, count = [], [], []
            for text_, spans_ in zip(b.column(1), b.column(2), strict=True):
                whole, parts, at, n = memoryview(text_.as_buffer()), [], 0, 0
                reach = -1
                for s in spans_.as_py() or ():
                    if s["start"] > reach:
                        n += 1
                        parts.append(whole[at : s["start"]])
                    reach = max(reach, s["end"])
                    at = reach
                parts.append(whole[at:])
                kept.append(b"".join(parts))
                removed.append(len(whole) - len(kept[-1]))
                count.append(n)
            size = pc.binary_length(b.column(1)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary()), size, pa.array(removed, pa.int64()), pa.array(count, pa.int64())], names=[key, "kept", "n_bytes", "n_removed", "n_spans"])

    return joined.mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, kept binary, n_bytes long, n_removed long, n_spans long")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
