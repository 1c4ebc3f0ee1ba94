"""Many known texts in one pass: an Aho-Corasick automaton over all of them, run on Arrow batches of documents.

The automaton (a trie whose failure links lead to the longest suffix that is also a prefix) reads each character
once, however many texts are searched for, and tells every text that ends there, also within another. It is
built once a Python worker from the texts, which are broadcast; their size is checked before. What doesn't fit
goes in slices, one pass over the documents each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of known texts (and 16 for each) in one automaton; it takes some 50 bytes of memory for each.
MAX_BYTES = 4_000_000

_built: dict[bytes, object] = {}


def built(texts: list[str]):
    """The automaton of texts, whose values are their places in the list; the last one built is kept."""
    import ahocorasick

    digest = hashlib.sha256("\x00".join(f"{len(t)}:{t}" for t in texts).encode("utf-8", "surrogatepass")).digest()
    if digest not in _built:
        _built.clear()
        made = ahocorasick.Automaton()
        for i, t in enumerate(texts):
            made.add_word(t, i)
        made.make_automaton()
        _built[digest] = made
    return _built[digest]


def size_of(texts: DataFrame, column: str = "known") -> int:
    """Bytes that the texts count for against MAX_BYTES."""
    return texts.agg(F.sum(F.octet_length(column) + 16)).first()[0] or 0


def _slice(docs: DataFrame, key: str, text: str, texts: DataFrame) -> DataFrame:
    known = texts.toArrow()
    words = known.column("known").to_pylist()
    if not words:
        return docs.sparkSession.createDataFrame([], f"known_key long, {key} {docs.schema[key].dataType.simpleString()}")
    shared = docs.sparkSession.sparkContext.broadcast((words, known.column("known_key").to_pylist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, keys = shared.value
        automaton = built(words)
        for b in batches:
            rows, found = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                if t:
                    hit = {k for _, k in automaton.iter(t)}
                    found += [keys[k] for k in hit]
                    rows += [i] * len(hit)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), b.column(0).take(pa.array(rows, pa.int64()))], names=["known_key", key])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias(text)).mapInArrow(run, f"known_key long, `{key}` {kind}")


def found(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text", max_bytes: int = MAX_BYTES) -> DataFrame:
    """(known_key, key): each of known's texts (known_key long, known string) that stands in a document, letter for letter.

    Once a row of docs, however often it stands there; null and empty texts on either side are in no pair.
    """
    texts = known.where("known <> ''").select("known_key", "known")
    slices = max(1, -(-size_of(texts) // max_bytes))
    out = None
    for i in range(slices):
        part = _slice(docs, key, text, texts.where(F.pmod(F.xxhash64("known"), F.lit(slices)) == i))
        out = part if out is None else out.unionByName(part)
    return out
