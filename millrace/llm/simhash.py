"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprints: 64-bit majority of XXH64 values of word shingles. Two that differ in at most four
bits agree fully on one of five blocks (pigeonhole); of the other 51 or more bits, two 23-bit
words hold at most four errors, so one of the words has at most two and shares a Golay key
(see golay.py). A fingerprint is filed under (block, its bits, word, Golay key), some 53 keys,
and all links are found among those that share a key, then verified bit by bit.

Scale: exact copies collapse to one fingerprint before anything is filed. Within a key the
task emits a spanning forest of the verified links, at most one edge a member, never all
pairs, which keeps every component whole. A key's members are held as 8 bytes each; long
lists are parted once more by the pigeonhole principle, on other blocks, before they are
compared. Components come from distributed star rounds (components.py).

Defined results: null and wordless texts have fingerprint zero and link like any other;
repeated rows and ids share a fingerprint and so a component; rows with a null id link like any
other, and a component of nothing else has a null name; an empty table gives an empty
result; other columns are left out of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import golay
from millrace.llm.common import table, written
from millrace.llm.components import components

SHINGLE, SEED, MAX_BITS = 4, 42, 4
#: Each byte's bits, spread to the eight byte lanes of a 64-bit number.
_LANES = sum(((np.arange(256, dtype=np.uint64) >> np.uint64(j)) & np.uint64(1)) << np.uint64(8 * j) for j in range(8))
#: Bits of the five blocks, low to high.
_BLOCKS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
LONG_LIST = 2048


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """bytes.lower and bytes.split touch just A-Z and the six ASCII white spaces."""
    import xxhash

    ws = (text or b"").lower().split()
    n = len(ws)
    if not n:
        return 0
    line = b" ".join(ws)
    if n <= shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    sizes = np.fromiter(map(len, ws), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: n - shingle + 1].tolist()
    hash_ = xxhash.xxh64_intdigest
    hs = np.array([hash_(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], "<u8")
    sums = np.add.reduceat(_LANES[hs.view(np.uint8).reshape(-1, 8)], np.arange(0, len(hs), 255), axis=0)
    ones = sums.astype("<u8").view(np.uint8).reshape(len(sums), 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hs), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(key, fp): fp is the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.large_binary())
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(b))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=[key, "fp"])

    return docs.select(key, F.col(text)).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, fp long")


def filing_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for unsigned fingerprints."""
    rows, out = [], []
    for k, (low, n) in enumerate(_BLOCKS):
        block = (fps >> np.uint64(low)) & np.uint64((1 << n) - 1)
        below = fps & np.uint64((1 << low) - 1)
        above = (fps >> np.uint64(low + n)) << np.uint64(low) if low + n < 64 else np.zeros_like(fps)
        rest = below | above
        for side in range(2):
            word = (rest >> np.uint64(23 * side)) & np.uint64((1 << 23) - 1)
            r, g = golay.keys(word)
            rows.append(r)
            out.append(((2 * k + side) << 25) | (block[r].astype(np.int64) << 12) | g)
    return np.concatenate(rows), np.concatenate(out).astype(np.int32)


def _file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        all_fps = b.column(0).to_numpy()
        for i in range(0, len(all_fps), 4096):
            fps = all_fps[i : i + 4096]
            row, key = filing_keys(fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[row])], names=["key", "fp"])


def forest(fps: np.ndarray, max_bits: int = MAX_BITS) -> list[np.ndarray]:
    """Edges that span the components of the given distinct fingerprints."""
    if len(fps) > LONG_LIST:
        # other blocks than the filing's: every fifth bit. Links agree on one of the five.
        out = []
        for k in range(5):
            mask = np.uint64(sum(1 << i for i in range(k, 64, 5)))
            order = np.argsort(fps & mask, kind="stable")
            cuts = np.flatnonzero(np.diff((fps & mask)[order])) + 1
            for part in np.split(fps[order], cuts):
                if len(part) > 1:
                    out += _span(part, max_bits)
        return out
    return _span(fps, max_bits)


def _span(fps: np.ndarray, max_bits: int) -> list[np.ndarray]:
    out, left = [], fps
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            now, front = front[:64], front[64:]
            near = np.bitwise_count(left[:, None] ^ now) <= max_bits
            hit = near.any(1)
            if hit.any():
                found = left[hit]
                out.append(np.stack([now[near[hit].argmax(1)], found], 1))
                front, left = np.concatenate([front, found]), left[~hit]
    return out


def _link(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; a key's rows may go over several batches."""
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def edges(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero(np.diff(key)) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])
            out = [np.zeros((0, 2), np.uint64)]
            size = np.repeat(ends - starts, ends - starts)
            for lag in range(1, 8):  # short lists: by lag, all at once
                same = (key[lag:] == key[:-lag]) & (size[lag:] <= 8)
                a, b = fp[lag:][same], fp[:-lag][same]
                near = np.bitwise_count(a ^ b) <= max_bits
                out.append(np.stack([a[near], b[near]], 1))
            for i in np.flatnonzero(ends - starts > 8):
                out += forest(fp[starts[i] : ends[i]], max_bits)
            e = np.unique(np.concatenate(out), axis=0).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["x", "y"])

        for b in batches:
            key, fp = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1]))
            if last == 0 and held and held[-1][0][-1] == key[-1]:
                held.append((key, fp))
                continue
            held.append((key[:last], fp[:last]))
            ready = [np.concatenate(x) for x in zip(*held, strict=True)]
            if len(ready[0]):
                yield edges(*ready)
            held = [(key[last:], fp[last:])]
        if held:
            yield edges(*[np.concatenate(x) for x in zip(*held, strict=True)])

    return run


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(key, fp, component_id): component_id is the least key reachable by links."""
    if max_bits > 4:
        raise ValueError("five blocks and two Golay words find links of at most four bits")
    prints = written(fingerprints(docs, key, text, shingle), "fingerprints")
    groups = written(prints.groupBy("fp").agg(F.min(key).alias("rep")), "groups")
    filed = groups.select("fp").mapInArrow(_file, "key int, fp long").repartition("key").sortWithinPartitions("key")
    links = written(filed.mapInArrow(_link(max_bits), "x long, y long").distinct(), "links")
    # fingerprints name the nodes: a fingerprint links whether or not one of its rows has an id
    found = components(links.select(F.col("x").alias("a"), F.col("y").alias("b")))
    named = groups.join(found, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    ids = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_fp = named.join(ids, "component").select("fp", "component_id")
    return prints.join(by_fp, "fp").select(key, "fp", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
