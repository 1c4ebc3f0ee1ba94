"""Column functions on text, all within the JVM but for NFKC."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: Characters without width that split words unseen (fixed values).
ZERO_WIDTH = "​‌‍⁠﻿"
#: Cyrillic and Greek letters that look like Latin ones, and these (fixed values).
HOMOGLYPHS = ("аеорсухіјѕԁһαονιρ", "aeopcyxijsdhaovip")


def contains_any(text: Column, parts: Sequence[str]) -> Column:
    """Whether text has one of the parts, by byte search: a few times faster than a pattern."""
    found = text.contains(parts[0])
    for p in parts[1:]:
        found = found | text.contains(p)
    return found


def canonical(text: Column) -> Column:
    """Lower case, no zero-width characters, white space closed up.

    Patterns run only on texts that have something for them to replace, as byte searches tell.
    """
    odd = lambda t: (F.octet_length(t) > F.length(t)) & contains_any(t, ZERO_WIDTH)
    bare = lambda t: F.when(odd(t), F.regexp_replace(t, f"[{ZERO_WIDTH}]", "")).otherwise(t)
    closed = lambda t: F.when(t.contains("  "), F.regexp_replace(t, "  +", " ")).otherwise(t)
    spaced = F.transform(F.array(F.lower(text)), bare)[0]
    for c in "\t\n\r":
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    return F.trim(F.transform(F.array(spaced), closed)[0])


def unmasked(text: Column) -> Column:
    """canonical, with look-alike letters as Latin ones."""
    return F.translate(canonical(text), *HOMOGLYPHS)


@F.pandas_udf(StringType())
def nfkc(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode NFKC; no built-in function does it."""
    import unicodedata

    for s in parts:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def statistics(text: Column) -> dict[str, Column]:
    n = F.greatest(F.length(text), F.lit(1))
    share = lambda pattern: F.round(F.regexp_count(text, F.lit(pattern)) / n, 6)
    return {
        "n_characters": F.length(text).cast("long"),
        "n_tokens": F.regexp_count(text, F.lit("[^ \\t\\n\\r]+")).cast("long"),
        "n_lines": F.size(F.split(text, "\n")).cast("long"),
        "symbol_share": share("[#*$%&|<>]"),
        "upper_share": share("[A-Z]"),
        "digit_share": share("[0-9]"),
    }


def repetition(text: Column) -> Column:
    """Distinct words over words."""
    ws = F.filter(F.split(text, "[ \\t\\n\\r]+"), lambda w: w != "")
    return F.transform(F.array(ws), lambda w: F.when(F.size(w) > 0, F.round(F.size(F.array_distinct(w)) / F.size(w), 6)))[0]


@F.pandas_udf(DoubleType())
def entropy(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Bits a character; null for null and empty texts.

    Built-in functions would give each character a row or an array element of its own, at some
    twenty times the cost.
    """

    def bits(text: str | None) -> float | None:
        if not text:
            return None
        n = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)[1]
        return float(np.log2(len(text)) - (n * np.log2(n)).sum() / len(text))

    for s in parts:
        yield s.map(bits).astype("float64")
