"""Near copies of whole texts: SimHash candidates under Golay keys, verified by word shingles.

Two texts are linked if their sets of `shingle`-word shingles (A-Z lowered; a shorter text is one
shingle) have a Jaccard similarity of `similarity` or more. Candidates come from 128-bit SimHash
fingerprints of the texts' distinct words: a changed word breaks five shingles but only one word,
so linked texts differ in few bits (at most 11 of 128 on the test tables, where texts without
relation differ in 52 or more). The fingerprint holds five 23-bit words. Texts within 11 bits of
the first 115 agree on the Golay keys of two of them at least (pigeonhole: of five words at most
three can hold three errors); beyond that most still do, up to `max_bits`, where candidates end
(texts of 10 to 25 words can differ in more and still be alike to 0.8; recall of their pairs was 0.98).

1. Texts of the same words are one; the others are filed under the Golay keys of four of the
   five words, some 21 rows of 28 bytes. A task files a key's members again under the words that
   follow, compares what meets there, and emits one edge for each member of what hangs together.
   Keys of over `max_list` members are parted into blocks, and each two blocks meet under a key of
   their own, so that no key holds more than two blocks.
2. Components of these candidates (components.py) hold every link that the keys found. Only
   members of a component of two or more, picked by a row bitmap, give their shingles.
3. Within a component links are verified by exact shingle sets, by a search that takes each
   text once it is linked. Components over `max_members` are parted alike.

Components of the verified links are the groups.

Defined results: null and wordless texts are copies of each other and of nothing else; repeated
rows and ids are copies like any other; of a group the row with the least key stays (null keys
last), of equal keys the first; an empty table gives an empty result; other columns pass
through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import golay
from millrace.llm.common import give_back, plain, with_rows_of, written
from millrace.llm.components import components

SHINGLE, SIMILARITY, MAX_BITS, MAX_MEMBERS, MAX_LIST, MAX_BROADCAST = 5, 0.8, 24, 1_000, 100_000, 1_000_000
WORDS, WORD_BITS = 5, 23
#: Filed rows that a task compares at once; a key's rows stay together.
HELD_ROWS = 50_000


def fingerprint(words: list[bytes]) -> tuple[int, int]:
    """128-bit majority of the hashes of the distinct words, as two signed longs."""
    import xxhash

    distinct = set(words)
    if not distinct:
        return 0, 0
    hashes = np.frombuffer(b"".join(map(xxhash.xxh128_digest, distinct)), np.uint8).reshape(-1, 16)
    ones = np.unpackbits(hashes, axis=1).sum(0, dtype=np.int64)
    a, b = np.packbits(2 * ones > len(distinct)).view("<i8").tolist()
    return a, b


def shingles(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    import xxhash

    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if n <= size:
        return np.array([xxhash.xxh64_intdigest(line)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: n - size + 1].tolist()
    return np.unique(np.array([xxhash.xxh64_intdigest(line[x:y]) for x, y in zip(starts, ends[size - 1 :].tolist(), strict=True)], np.uint64))


def _words(text: pa.Scalar) -> list[bytes]:
    """bytes.lower and bytes.split touch just A-Z and the six ASCII white spaces."""
    return (text.as_py() or b"").lower().split()


def _print_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for b in batches:
        same, bits = [], []
        for text in b.column(2).cast(pa.large_binary()):
            words = _words(text)
            same.append(xxhash.xxh128_digest(b" ".join(words)))
            bits.append(fingerprint(words))
        same = np.frombuffer(b"".join(same), "<i8").reshape(-1, 2)
        bits = np.array(bits, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x[:, i].copy()) for x in (same, bits) for i in (0, 1))], names=["row", "key", "same0", "same1", "a", "b"])
    give_back()


def word_of(a: np.ndarray, b: np.ndarray, i: int) -> np.ndarray:
    """The i-th 23-bit word of unsigned fingerprints."""
    low = WORD_BITS * i
    if low >= 64:
        part = b >> np.uint64(low - 64)
    elif low + WORD_BITS <= 64:
        part = a >> np.uint64(low)
    else:
        part = (a >> np.uint64(low)) | (b << np.uint64(64 - low))
    return (part & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)


def _unsigned(b: pa.RecordBatch, *columns: int) -> list[np.ndarray]:
    return [b.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in columns]


def _file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, row, a, b): each fingerprint under the Golay keys of all words but the last."""
    for batch in batches:
        for at in range(0, len(batch), 4096):
            part = batch.slice(at, 4096)
            a, b = _unsigned(part, 1, 2)
            rows, keys = [], []
            for i in range(WORDS - 1):
                r, g = golay.keys(word_of(a, b, i))
                rows.append(r)
                keys.append((i << 12) | g)
            r = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int32)), *(part.column(c).take(r) for c in range(3))], names=["key", "row", "a", "b"])


def _distance(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a[x] ^ a[y]).astype(np.int64) + np.bitwise_count(b[x] ^ b[y])


def candidate_forest(group: np.ndarray, first: np.ndarray, a: np.ndarray, b: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Edges (x, y) of places that span, within each group, what its members' following words bring within max_bits.

    group: ascending numbers of the lists; first: the word whose Golay key a list's members share.
    """
    member, sub = [], []
    for j in range(1, WORDS):
        of = np.flatnonzero(first < j)
        r, g = golay.keys(word_of(a[of], b[of], j))
        member.append(of[r])
        sub.append((group[of[r]].astype(np.int64) << 16) | (j << 12) | g)
    member, sub = np.concatenate(member), np.concatenate(sub)
    order = np.argsort(sub, kind="stable")
    member, sub = member[order], sub[order]
    cuts = np.flatnonzero(np.diff(sub)) + 1
    starts = np.concatenate([[0], cuts])
    sizes = np.diff(np.append(starts, len(sub)))
    long = np.repeat(sizes > 8, sizes)
    out = [np.zeros((0, 2), np.int64)]
    for lag in range(1, 8):  # short lists: by lag, all at once
        same = (sub[lag:] == sub[:-lag]) & ~long[lag:]
        x, y = member[:-lag][same], member[lag:][same]
        near = _distance(a, b, x, y) <= max_bits
        out.append(np.stack([x[near], y[near]], 1))
    for i in np.flatnonzero(sizes > 8):
        left = member[starts[i] : starts[i] + sizes[i]]
        while len(left) > 1:
            front, left = left[:1], left[1:]
            while len(front) and len(left):
                now, front = front[0], front[1:]
                hit = _distance(a, b, left, np.full(len(left), now)) <= max_bits
                if hit.any():
                    out.append(np.stack([np.full(int(hit.sum()), now), left[hit]], 1))
                    front, left = np.concatenate([front, left[hit]]), left[~hit]
    return np.concatenate(out)


def star_edges(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the graph of edges (x, y): each node but the least of its component, with that least node."""
    nodes, ends = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b = ends[: len(x)], ends[len(x) :]
    label = np.arange(len(nodes))
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low != high
        if not apart.any():
            break
        np.minimum.at(label, high[apart], low[apart])
        while (label[label] != label).any():
            label = label[label]
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[other]], nodes[other]


def _by_key(batches: Iterator[pa.RecordBatch], n_keys: int, least: int) -> Iterator[pa.Table]:
    """Tables of `least` rows or more that end where the first n_keys columns change; rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not len(b):
            continue
        if sum(map(len, held)) >= least:
            change = np.zeros(len(b), bool)
            last = held[-1].slice(len(held[-1]) - 1)
            for c in range(n_keys):
                own = b.column(c).to_numpy(zero_copy_only=False)
                change |= own != np.append(last.column(c).to_numpy(zero_copy_only=False), own[:-1])
            if change.any():
                cut = int(np.argmax(change))
                yield pa.Table.from_batches([*held, b.slice(0, cut)]).combine_chunks()
                held, b = [], b.slice(cut)
        held.append(b)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _candidates(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_key(batches, 3, HELD_ROWS):
            key, x, y, row, a, b = (t.column(i).to_numpy() for i in range(6))
            same = (key[1:] == key[:-1]) & (x[1:] == x[:-1]) & (y[1:] == y[:-1])
            group = np.concatenate([[0], np.cumsum(~same)])
            shared = np.append(False, same) | np.append(same, False)
            group, first, row, a, b = group[shared], key[shared] >> 12, row[shared], a[shared].view(np.uint64), b[shared].view(np.uint64)
            e = row[candidate_forest(group, first, a, b, max_bits)] if len(group) else np.zeros((0, 2), np.int64)
            # only what hangs together matters: one edge a member, whatever number of keys it shares
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in star_edges(e[:, 0], e[:, 1])], names=["a", "b"])
        give_back()

    return run


def _dealt(df: DataFrame, group: str, most: int, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """df, which has a `row`, with x and y: groups of over `most` rows are parted into blocks by row, and each two blocks are x, y once."""
    # at most one in `most` of the rows is in this list, and no more than max_broadcast of it are sent to all tasks
    large = written(df.groupBy(group).agg(F.ceil(F.count("*") / most).cast("int").alias("blocks")).where("blocks > 1"), "large-groups")
    counted = df.join(F.broadcast(large) if large.count() <= max_broadcast else large, group, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    block = F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(block, j).alias("x"), F.greatest(block, j).alias("y")))
    return counted.select(group, F.inline(pairs), *[c for c in df.columns if c != group])


def _shingle_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(_words(t), size).tobytes() for t in b.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["row", "shingles"])
        give_back()

    return run


def links(sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Edges that span the components of the sets' links; each set is compared until it is linked."""
    every, sizes = np.arange(len(sets)), np.array([len(s) for s in sets], np.int64)
    every = every[sizes > 0]
    if len(every) < 2:
        return []
    _, flat = np.unique(np.concatenate([sets[i] for i in every]), return_inverse=True)
    sizes = sizes[every]
    starts = np.cumsum(sizes) - sizes
    own = np.zeros(int(flat.max()) + 1, bool)
    out: list[tuple[int, int]] = []
    # the sets still to be linked, packed anew when half of them are
    live, at, packed = np.arange(len(every)), starts, flat
    alive = np.ones(len(every), bool)
    for pivot in range(len(every)):
        if not alive[pivot]:
            continue
        alive[pivot] = False
        front = [pivot]
        while front:
            x = front.pop()
            left = alive[live]
            if 2 * left.sum() < len(live):
                live = live[left]
                if not len(live):
                    break
                at = np.cumsum(sizes[live]) - sizes[live]
                packed = np.concatenate([flat[starts[i] : starts[i] + sizes[i]] for i in live])
                left = np.ones(len(live), bool)
            mine = flat[starts[x] : starts[x] + sizes[x]]
            own[mine] = True
            common = np.add.reduceat(own[packed], at, dtype=np.int64)
            own[mine] = False
            hit = live[left & (common >= similarity * (sizes[x] + sizes[live] - common) - 1e-9)]
            alive[hit] = False
            front += hit.tolist()
            out += [(int(every[x]), int(every[y])) for y in hit]
    return out


def _verified(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_key(batches, 3, 1):
            group = np.stack([t.column(i).to_numpy() for i in range(3)], 1)
            row = t.column("row").to_numpy()
            cuts = np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1
            edges = []
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(row)], strict=True):
                sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("shingles")[lo:hi]]
                edges += [(row[lo + x], row[lo + y]) for x, y in links(sets, similarity)]
            e = np.array(edges, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(e[:, 0].copy()), pa.array(e[:, 1].copy())], names=["a", "b"])
        give_back()

    return run


def groups(
    rows: DataFrame,
    row: str,
    key: str,
    text: str,
    shingle: int = SHINGLE,
    similarity: float = SIMILARITY,
    max_bits: int = MAX_BITS,
    max_members: int = MAX_MEMBERS,
    max_list: int = MAX_LIST,
    max_broadcast: int = MAX_BROADCAST,
) -> DataFrame:
    """(component, first: struct of null, key, row): a row for each text of distinct words, with the group it is in.

    rows can be read twice alike, and `row` numbers them.
    """
    kind = rows.schema[key].dataType.simpleString()
    prints = rows.select(F.col(row), F.col(key), F.col(text)).mapInArrow(_print_rows, f"row long, key {kind}, same0 long, same1 long, a long, b long")
    first = F.min(F.struct(F.col("key").isNull().alias("null"), "key", "row")).alias("first")
    texts = written(prints.groupBy("same0", "same1").agg(first, F.first("a").alias("a"), F.first("b").alias("b")).select("first", "a", "b"), "texts")
    filed = texts.select(F.col("first.row").alias("row"), "a", "b").mapInArrow(_file, "key int, row long, a long, b long")
    lists = ["key", "x", "y"]
    met = _dealt(filed, "key", max_list, max_broadcast).repartition(*lists).sortWithinPartitions(*lists).mapInArrow(_candidates(max_bits), "a long, b long")
    near = written(components(met), "candidates")
    sets = with_rows_of(rows, row, near.select(F.col("node").alias("row"))).select(F.col(row), F.col(text)).mapInArrow(_shingle_rows(shingle), "row long, shingles binary")
    dealt = written(_dealt(near.select("component", F.col("node").alias("row")), "component", max_members, max_broadcast), "members")
    members = sets.join(F.broadcast(dealt) if dealt.count() <= max_broadcast else dealt, "row").select("component", "x", "y", "row", "shingles")
    keys = ["component", "x", "y"]
    found = components(members.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_verified(similarity), "a long, b long"))
    return texts.join(found, F.col("first.row") == F.col("node"), "left").select(F.coalesce("component", "first.row").alias("component"), "first")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs with one row of each group of near copies.

    Row numbers are written down with the rows: another scan might split its input otherwise.
    """
    docs, back = plain(docs, key=key, text=text)
    rows = written(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    chosen = groups(rows, "row", "key", "text", **how).groupBy("component").agg(F.min("first").alias("first"))
    return back(with_rows_of(rows, "row", chosen.select(F.col("first.row").alias("row"))))
