"""Semi-structured columns as VARIANT: parsed once, read by path, their schema inferred in one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """JSON text as a VARIANT; null where it is null or no JSON."""
    return F.try_parse_json(text)


def value(variant: Column, path: str, kind: str) -> Column:
    """What stands at path, as kind; null where there is nothing, or nothing that can be read as kind."""
    return F.try_variant_get(variant, path, kind)


def schema(df: DataFrame, variant: str) -> str:
    """The schema that holds all values of a column, by one aggregate; broken ones (nulls) are left out."""
    return df.agg(F.schema_of_variant_agg(F.col(variant))).first()[0]


def fields(found: str) -> list[tuple[str, str]]:
    """(name, type) of the top-level fields of a schema `OBJECT<a: BIGINT, b: OBJECT<...>>`; none for other schemas."""
    if not found.startswith("OBJECT<"):
        return []
    out, depth, part, ticked = [], 0, "", False
    for c in found[len("OBJECT<") : -1] + ",":
        ticked ^= c == "`"
        depth += (c in "<(") - (c in ">)") if not ticked else 0
        if c == "," and not depth and not ticked:
            name, _, kind = part.strip().rpartition(": ") if part.count(": ") == 1 else part.strip().partition(": ")
            if name:
                out.append((name.strip("`"), kind))
            part = ""
        else:
            part += c
    return out


#: Types of inferred schemas that are read as such; others stay VARIANT.
_READ = {"BIGINT": "bigint", "STRING": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "DATE": "date"}


def flattened(df: DataFrame, variant: str) -> DataFrame:
    """df with a column a top-level field of the variant instead of it, as the inferred schema has them.

    Whole numbers, texts, doubles and truth values are read as such, all else stays VARIANT. Field names that df has
    already (in any case) get underscores before them.
    """
    taken, out = {c.lower() for c in df.columns if c != variant}, []
    for name, kind in fields(schema(df, variant)):
        as_ = name
        while as_.lower() in taken:
            as_ = f"_{as_}"
        taken.add(as_.lower())
        path = "$['" + name.replace("'", "\\'") + "']"
        out.append(value(F.col(f"`{variant}`"), path, _READ.get(kind, "variant")).alias(as_))
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != variant], *out)
