"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns the
columns of documents; the last returns packed pieces. `n_chars`, where there is one, follows
the text.

Defined results: null and empty texts fail the quality rules; repeated rows are copies, of which
one stays; rows with a null id go through like others; further columns pass through, whatever
their names, as far as packing; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate as contamination
from millrace.llm import line_dedup, near_copies, packing, quality_rules
from millrace.llm.common import quoted, remove, storing, table


def _as_documents(df: DataFrame, docs: DataFrame) -> DataFrame:
    """df with the columns of docs, the text's length brought up to date."""
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return df.select([quoted(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, then documents that fail the base rules or lose too much."""
    return _as_documents(quality_rules.passed(docs), docs)


def site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on more than a tenth of a source's documents go; a document of nothing else stays, empty."""
    return _as_documents(line_dedup.without_boilerplate(docs), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies and near copies (five-word shingles alike to 0.8) the document with the least id stays.

    The operator's wide form: Golay keys of longer fingerprints bring candidates together, shingles verify them.
    """
    return _as_documents(near_copies.keep_one(docs), docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; single benchmark passages are cut out of the others."""
    return _as_documents(contamination.decontaminate(docs, table(spark, sf_dir, "benchmark")), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of what is left, in sequences of at most 1024."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", site_lines),
    ("simhash_near_dedup", near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack),
]
#: Tokenizers and fingerprints are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is stored; what it was made of goes then."""
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with storing(spark) as store:
            docs, new = store(stage(spark, docs, sf_dir), name)
        if path:
            remove(spark, path)
        path = new
    return docs
