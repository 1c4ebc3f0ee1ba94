"""Token ids in ORC: integer run-length encoding, row indexes, Bloom filters on document ids.

The table is range-partitioned and sorted by document id (rows of one id by their texts' hashes, so that they may
fill several files), so each file holds an id range, each stripe a smaller one. ids is an array<int> column, which ORC stores by its integer run-length
encoding (RLE v2); stripes are read in parallel; a look-up by id skips files, stripes and
row groups by their minima and maxima, then by the Bloom filter.

Defined results: a null text has just the end id; rows that repeat an id follow each other in
the order of their texts' hashes; an empty table gives an empty ORC table and result; other columns
are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import give_back, scratch, table, written
from millrace.llm.tokens import blocks, shared_encoder

#: Larger blocks than usual meet fewer distinct chunks twice.
STRIPE_BYTES, ROW_STRIDE, BLOCK_BYTES = 16 << 20, 1_000, 4 << 20


def write_tokens(docs: DataFrame, path: str, tokenizer: str, kind: str = "words", end_id: int = 1, key: str = "doc_id", text: str = "text") -> None:
    """ORC files at path: doc_id, seq (place in the file), ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seq = shared_encoder(tokenizer, kind, end_id, special=True), 0
        for batch in batches:
            for b in blocks(batch, size=BLOCK_BYTES):
                ids, offsets = encoder.encode(b.column(1))
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.arange(seq, seq + len(b))), lists], names=["doc_id", "seq", "ids"])
                seq += len(b)
        give_back(heap=False)

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).withColumn("h", F.xxhash64("text"))
    in_order = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    in_order.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema[key].dataType.simpleString()}, seq long, ids array<int>").write.options(
        **{"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.stripe.size": STRIPE_BYTES, "orc.row.index.stride": ROW_STRIDE, "orc.create.index": "true"}
    ).orc(path)


def read_tokens(spark: SparkSession, path: str, ids: list[int] | None = None) -> DataFrame:
    """(doc_id, seq, ids); with ids, the filter reaches the files' indexes and Bloom filters."""
    found = spark.read.orc(path)
    return found if ids is None else found.where(F.col("doc_id").isin(ids))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column(3)
        at = lists.offsets.to_numpy()
        values = memoryview(lists.values.to_numpy().astype("<u4", copy=False)).cast("B")
        crc = [zlib.crc32(values[4 * x : 4 * y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=["file", "doc_id", "seq", "n_tokens", "ids_crc32"])


def summary(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), all from the files.

    Files hold ascending id ranges in the order of their numbers, so a document starts at its file's start plus the
    sum of what precedes it in the file: one running sum over files, one within each.
    """
    read = read_tokens(spark, path).select(F.col("_metadata.file_path").alias("file"), "doc_id", "seq", "ids")
    kind = dict(read.dtypes)["doc_id"]
    rows = written(read.mapInArrow(_sums, f"file string, doc_id {kind}, seq long, n_tokens long, ids_crc32 long"), "token-sums")
    number = F.regexp_extract("file", "part-([0-9]+)", 1).cast("int").alias("number")
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).select("file", "n", number)
    bases = totals.select("file", (F.sum("n").over(W.orderBy("number", "file").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    within = F.sum("n_tokens").over(W.partitionBy("file").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)) - F.col("n_tokens")
    return rows.withColumn("start", within).join(bases, "file").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def op3_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark, "orc-tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return summary(spark, path)
