"""Encoded payloads: runs of hex digits and of base64 characters, and what they decode to.

A hex run has 16 digits or more, in either case; a base64 run 20 characters or more, with letters
of both cases and digits among them, so that plain words and hex runs are none.

Defined results: a run whose length does not fit its code decodes to no bytes (null); bytes that
are not UTF-8 are no text (null), and rules find nothing there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEX, BASE64 = "[0-9A-Fa-f]{16,}", "[A-Za-z0-9+/]{20,}={0,2}"


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, run, n, times): each distinct run of a document."""
    hexes = F.transform(F.regexp_extract_all("text", F.lit(HEX), F.lit(0)), lambda r: F.struct(F.lit("hex").alias("kind"), r.alias("run")))
    is_base64 = lambda r: r.rlike("[a-z]") & r.rlike("[A-Z]") & r.rlike("[0-9]") & ~r.rlike("^[0-9A-Fa-f]+$")
    base64s = F.transform(F.filter(F.regexp_extract_all("text", F.lit(BASE64), F.lit(0)), is_base64), lambda r: F.struct(F.lit("base64").alias("kind"), r.alias("run")))
    found = docs.select("doc_id", F.inline(F.concat(hexes, base64s)))
    return found.groupBy("doc_id", "kind", "run").agg(F.length("run").cast("long").alias("n"), F.count("*").alias("times"))


def decoded(found: DataFrame) -> DataFrame:
    """found with bytes and text."""
    in_hex = F.when(F.length("run") % 2 == 0, F.expr("try_to_binary(run, 'hex')"))
    in_base64 = F.when(F.length("run") % 4 == 0, F.expr("try_to_binary(run, 'base64')"))
    both = found.withColumn("bytes", F.when(F.col("kind") == "hex", in_hex).otherwise(in_base64))
    return both.withColumn("text", F.try_validate_utf8(F.col("bytes").cast("string")))
